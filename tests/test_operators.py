"""Edge cases of the operators on small hand-made tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as E
from tidemark.operators import cache_policy as C
from tidemark.operators import delta as D
from tidemark.operators import relational as R


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame([(1, 4, 7), (2, 5, 8), (3, 6, 9)], "aa long, ab long, ac long")


@pytest.fixture(scope="module")
def empty(a):
    return a.where("false")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_group_without_keys_or_aggregates(a, empty):
    assert rows(R.group(a, ["aa"], F.sum("ab").alias("s"))) == [(1, 4), (2, 5), (3, 6)]
    assert rows(R.group(a, [], F.sum("ab").alias("s"))) == [(15,)]
    assert rows(R.group(a, ["ab"])) == [(4,), (5,), (6,)]
    assert rows(R.group(empty, ["aa"], F.sum("ab"))) == []
    assert rows(R.group(empty, [], F.sum("ab"), F.count("*"))) == [(None, 0)]


def test_upper_case_names(a):
    assert rows(R.group(a, ["AA"], F.max("AC"))) == [(1, 7), (2, 8), (3, 9)]


@pytest.mark.parametrize("how,n", [("inner", 0), ("left", 3), ("right", 0), ("full", 3), ("semi", 0), ("anti", 3)])
def test_join_with_empty_side(a, empty, how, n):
    assert R.hash_join(a, empty.withColumnsRenamed({"aa": "ba", "ab": "bb", "ac": "bc"}), [("aa", "ba")], how).count() == n


def test_semi_join_gives_each_row_once(a, spark):
    b = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    assert rows(R.hash_join(a, b, [("aa", "k")], "semi")) == [(1, 4, 7), (3, 6, 9)]


def test_nulls_match_nothing(spark):
    x = spark.createDataFrame([(None,), (1,)], "k long")
    assert R.hash_join(x, x.withColumnRenamed("k", "j"), [("k", "j")]).count() == 1


def test_theta_joins_are_equal_whichever_side_is_broadcast(a):
    b = a.withColumnsRenamed({"aa": "ba", "ab": "bb", "ac": "bc"})
    for how in ("inner", "left", "right", "full"):
        few, many = (rows(R.nested_loop_join(a, b, F.col("aa") < F.col("ba"), how, n)) for n in (10, 1))
        assert few == many


def test_merge_columns_checks_its_input(a):
    b = a.select("aa", F.col("ab").alias("bb"))
    assert rows(R.merge_columns(a, b, ["aa"])) == [(1, 4, 7, 4), (2, 5, 8, 5), (3, 6, 9, 6)]
    with pytest.raises(ValueError, match="both tables"):
        R.merge_columns(a, a, ["aa"])
    with pytest.raises(ValueError, match="same rows"):
        R.merge_columns(a, b.where("aa < 3"), ["aa"])
    with pytest.raises(ValueError, match="same rows"):  # many times in one table, never in the other
        R.merge_columns(a.where("aa = 1").crossJoin(a.sparkSession.range(1001)).drop("id"), b.where("false"), ["aa"])


@pytest.mark.parametrize("max_bits", [1 << 23, 64])
def test_bloom_filter_loses_nothing(spark, max_bits):
    probe = spark.range(5000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    build = spark.range(0, 5000, 7).select(F.when(F.col("id") != 21, F.col("id")).alias("j"))
    want = rows(R.hash_join(probe, build, [("k", "j")]))
    got = R.bloom_join(probe, build, [("k", "j")], max_bits=max_bits)
    assert rows(got) == want and len(want) > 600
    words, bits, hashes = R.bloom_filter(build, ["j"], max_bits=max_bits)
    assert bits <= max_bits and len(words.first()["words"]) == bits // 64 and words.count() == 1
    assert rows(R.bloom_join(probe, build.where("false"), [("k", "j")])) == []


def test_bloom_filter_drops_most_others(spark):
    build = spark.range(1000).select(F.col("id").alias("j"))
    words, bits, hashes = R.bloom_filter(build, ["j"], fpr=0.01)
    held = words.first()["words"]
    places = spark.range(10_000, 30_000).select(*(p.alias(f"p{i}") for i, p in enumerate(R._places(["id"], bits, hashes)))).collect()
    passed = sum(all(held[p >> 6] >> (p & 63) & 1 for p in r) for r in places)
    assert passed < 0.02 * len(places)


def test_nulls_come_last_both_ways(spark):
    x = spark.createDataFrame([(None,), (1,), (2,)], "k long")
    assert [r.k for r in R.sort(x, ("k", "ASC")).collect()] == [1, 2, None]
    assert [r.k for r in R.sort(x, ("k", "DESC")).collect()] == [2, 1, None]
    assert [r.k for r in R.top_k(x, 2, ("k", "DESC")).collect()] == [2, 1]


def test_top_k_is_not_a_full_sort(a):
    assert "TakeOrderedAndProject" in R.top_k(a, 1, ("aa", "ASC"))._jdf.queryExecution().toString()


def test_expressions(spark):
    x = spark.createDataFrame([(7, "12.50", "2024-01-31"), (-7, "x", "2023-12-01")], "n long, t string, d string")
    got = x.select(
        E.divide(F.col("n"), E.num_lit(2), whole=True), E.cast(F.col("t"), "double"), E.date_plus(E.date_lit("2024-01-31"), 1, "MONTH").cast("string"),
        E.date_extract("DAY", F.col("d").cast("date")), E.case([(F.col("n") > 0, E.str_lit("+"))]), E.num_lit(None, "long"), E.is_not_true(F.lit(None).cast("boolean")),
    ).collect()
    assert list(map(tuple, got)) == [(3, 12.5, "2024-02-29", 31, "+", None, True), (-3, None, "2024-02-29", 1, None, None, True)]


# ---- delta merge

def history(seed):
    """Random changes with the table they lead to, by a plain interpreter."""
    rng = random.Random(seed)
    table = {(k, k % 2): k * 10 for k in range(12)}
    base, log = dict(table), []
    for version in range(4):
        for seq in range(rng.randint(0, 12)):
            k = rng.randint(0, 15)
            key, kind = (k, k % 2), rng.choice(["INSERT", "UPDATE", "DELETE"])
            value = rng.randint(0, 99)
            log.append((*key, value, kind, version, seq))
            if kind == "DELETE":
                table.pop(key, None)
            else:
                table[key] = value
    rng.shuffle(log)
    return base, log, table


@pytest.mark.parametrize("seed", range(6))
def test_both_merges_give_the_interpreter_s_table(spark, seed):
    base, log, table = history(seed)
    schema = "k int, j int, v int"
    stable = spark.createDataFrame([(*k, v) for k, v in base.items()], "k long, j long, v long")
    deltas = spark.createDataFrame(log, f"{schema}, type string, _version long, _seq long")
    want = sorted((*k, v) for k, v in table.items())
    keys = ["k", "j"]
    assert rows(D.snapshot(stable, deltas, keys)) == sorted(want, key=repr)
    assert rows(D.fresh(stable, deltas, keys)) == sorted(want, key=repr)
    assert rows(D.fresh(stable, deltas.union(deltas), keys)) == sorted(want, key=repr)
    assert rows(D.fresh(stable, D.compact(deltas, keys), keys)) == sorted(want, key=repr)
    assert D.fresh(stable, deltas, keys).schema == stable.schema
    for v in range(4):
        assert rows(D.fresh(stable, deltas, keys, v)) == rows(D.snapshot(stable, deltas, keys, v))


def test_kept_visibility(spark):
    base, log, table = history(3)
    stable = spark.createDataFrame([(*k, v) for k, v in base.items()], "k long, j long, v long")
    deltas = spark.createDataFrame(log, "k int, j int, v int, type string, _version long, _seq long")
    maps = D.KeepMaps(deltas, ["k", "j"], versions=2)
    for version in (0, 1, 0, None, None, 3):
        assert rows(maps.fresh(stable, version)) == rows(D.fresh(stable, deltas, ["k", "j"], version))
    assert (maps.hits, maps.misses, list(maps.kept)) == (2, 4, [None, 3])
    maps.close()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


# ---- caches

def test_policies():
    a, b, c = (("t", 0, x) for x in "abc")
    lru = C.LRU(2)
    C.replay(lru, [(a, 1), (b, 1), (a, 1), (c, 1)])
    assert set(lru.sizes) == {a, c}
    lfu = C.LFU(2)
    C.replay(lfu, [(a, 1), (a, 1), (b, 1), (b, 1), (c, 1)])
    assert set(lfu.sizes) == {a, b}  # the newcomer was asked for less often
    small = C.LFUS(10)
    C.replay(small, [(a, 9), (b, 1), (c, 5), (c, 5)])
    assert c in small.sizes and a not in small.sizes
    assert C.LRU(3).put(a, 4) is None


def test_no_policy_beats_the_one_that_knows_the_trace():
    rng = random.Random(1)
    segments = [("t", i, "c") for i in range(8)]
    for _ in range(20):
        trace = [rng.choice(segments) for _ in range(60)]
        belady = C.Belady(3, future=trace)
        C.replay(belady, [(s, 1) for s in trace])
        for kind in (C.LRU, C.LFU, C.LFUS):
            p = kind(3)
            C.replay(p, [(s, 1) for s in trace])
            assert p.hits <= belady.hits and p.used <= 3


def test_scan_weight_grows_with_selectivity():
    weights = [C.scan_weight(s, 100, 8, 1, 1) for s in (0.1, 0.5, 1.0)]
    assert all(x < y for x, y in itertools.pairwise(weights))
