"""Catalog, pruning, modes, change logs and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.htap import KEY, changes
from tidemark.plans.ssb import Generator
from tidemark.sources.catalog import Catalog, Partition, Table, store_options
from tidemark.sources.changes import LogReader, envelope
from tidemark.operators.cache_policy import LRU
from tidemark.operators.delta import fresh
from tidemark.sources.modes import Mode, Scans
from tidemark.sources.prune import Column, possible, pruned, simplified
from tidemark.sources.tables import table
from tidemark.streaming.upsert import MergeTable, fresh_batches, run, stream_changes, windowed_counts


def test_catalog(tmp_path, spark):
    (tmp_path / "t.csv").write_text("A|B|C\n1|x|2024-01-02\n2||\n")
    schema = {"tables": [{"name": "T", "format": "csv", "delimiter": "|", "primaryKeyNames": ["A"], "fields": [{"name": "A", "type": "int64"}, {"name": "B", "type": "utf8"}, {"name": "C", "type": "date"}]}]}
    c = Catalog.from_json(f"file://{tmp_path}", json.dumps(schema), json.dumps({"tables": [{"name": "t", "stats": {"rowCount": 2}}]}))
    t = c["t"]
    assert t.primary_key == ("a",) and t.row_count == 2 and t.delta_schema.names == ["a", "b", "c", "type"]
    got = t.read(spark).collect()
    assert got[0].a == 1 and got[0].b == "x" and str(got[0].c) == "2024-01-02" and got[1].b is None
    assert t.read(spark, ["C", "nothing", "a"]).columns == ["c", "a"]
    assert t.read(spark, partitions=[]).count() == 0
    schema["tables"][0]["fields"][0]["type"] = "timestamp"
    with pytest.raises(ValueError, match="no type"):
        Catalog.from_json("x", json.dumps(schema))


def test_store_options(spark, tmp_path):
    assert store_options({}) == {}
    got = store_options({"kind": "compatible", "endpoint": "http://store:9000", "connections": 200})
    assert got == {"fs.s3a.endpoint": "http://store:9000", "fs.s3a.connection.ssl.enabled": "false", "fs.s3a.path.style.access": "true", "fs.s3a.connection.maximum": "200"}
    for wrong in ({"kind": "x"}, {"kind": "compatible"}):
        with pytest.raises(ValueError):
            store_options(wrong)
    spark.range(3).select(F.col("id").alias("a")).write.parquet(f"{tmp_path}/t.parquet")
    schema = {"client": {"region": "here"}, "tables": [{"name": "t", "client": {"endpoint": "https://e"}, "fields": [{"name": "a", "type": "int64"}]}]}
    t = Catalog.from_json(f"file://{tmp_path}", json.dumps(schema))["t"]
    assert t.store["fs.s3a.endpoint.region"] == "here" and t.store["fs.s3a.connection.ssl.enabled"] == "true" and t.read(spark).count() == 3


def test_pruning():
    zones = {"k": (10, 20), "d": (1, 5)}
    k, d = Column("K"), Column("d")
    assert possible(zones, ("=", k, 10)) and not possible(zones, ("=", k, 9))
    assert not possible(zones, ("<", 20, k)) and possible(zones, ("<=", 20, k))
    assert not possible(zones, ("in", k, [1, 2])) and possible(zones, ("in", k, [1, 15]))
    assert possible(zones, ("=", Column("other"), 1)) and possible(zones, ("=", k, "text"))
    both = ("or", (">", k, 30), ("and", (">", d, 2), ("<", k, 15)))
    assert simplified(zones, both) == ("and", (">", d, 2), ("<", k, 15))
    assert simplified(zones, ("and", ("<", k, 5), ("=", d, 1))) is None
    t = Table("t", "parquet", T.StructType(), (), (Partition("a", {"k": (0, 9)}), Partition("b", {"k": (10, 19)}), Partition("c")))
    assert [p.path for p in pruned(t, (">=", k, 10))] == ["b", "c"]


def test_modes_give_one_result(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    results = []
    for mode in Mode:
        for keys in ({}, {"orders": ("o_orderkey",)}):
            with Scans(mode, keys) as scans:
                scans.keep("orders", o, ["o_custkey"]) if mode is Mode.HYBRID else None
                for _ in range(2):
                    results.append(sorted(map(tuple, scans.scan("orders", o, ["o_custkey"], F.col("o_totalprice") > 100_000, ("o_totalprice",)).collect())))
    with pytest.raises(ValueError, match="no key"):
        Scans(Mode.HYBRID, {"orders": ("o_custkey",)}).keep("orders", o, ["o_totalprice"])
    assert all(r == results[0] for r in results) and not spark.sparkContext._jsc.getPersistentRDDs()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_mode_has_its_plan(spark, sf_dir):
    o, where = table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100_000
    keys = {"orders": ("o_orderkey",)}
    scan = lambda scans: plan_of(scans.scan("orders", o, ["o_orderstatus"], where, ("o_totalprice",)))
    assert "GreaterThan(o_totalprice" in scan(Scans(Mode.PUSHDOWN_ONLY))
    up = Scans(Mode.PULL_UP)
    df = up.scan("orders", o, ["o_orderstatus"], where, ("o_totalprice",))
    assert "PushedFilters: []" in plan_of(df) and df.count() < o.count() == up.observed[0].get["rows"]
    with Scans(Mode.HYBRID, keys) as scans:
        assert "InMemoryTableScan" not in scan(scans)
        scans.keep("orders", o, ["o_orderstatus"])
        plan = scan(scans)
        assert "InMemoryTableScan" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan and "GreaterThan(o_totalprice" in plan
        assert scans.metrics()["segment_hits"] == 1 and scans.metrics()["segment_misses"] == 3
    with Scans(Mode.CACHING_ONLY, keys) as scans:
        assert scan(scans).count("InMemoryTableScan") and scans.columns_of("orders") == ["o_totalprice", "o_orderstatus"] or scans.columns_of("orders") == ["o_orderstatus", "o_totalprice"]
        scan(scans)
        assert scans.metrics()["segment_hits"] == 2


def test_the_cache_is_bounded(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    room = Scans.size(o, ["o_totalprice"]) + Scans.size(o, ["o_orderstatus"]) + 1
    with Scans(Mode.CACHING_ONLY, {"orders": ("o_orderkey",), "customer": ("c_custkey",)}, LRU(room)) as scans:
        for columns in (["o_totalprice"], ["o_orderstatus"], ["o_totalprice"]):
            scans.scan("orders", o, columns).count()
        want = sorted(map(tuple, c.select("c_acctbal").collect()))
        assert sorted(map(tuple, scans.scan("customer", c, ["c_acctbal"]).collect())) == want
        assert scans.columns_of("orders") == ["o_totalprice"] and scans.columns_of("customer") == ["c_acctbal"] and scans.policy.used <= room
        assert sorted(scans.kept["orders"].columns) == ["o_orderkey", "o_totalprice"]
        assert sorted(map(tuple, scans.scan("orders", o, ["o_totalprice"]).collect())) == sorted(map(tuple, o.select("o_totalprice").collect()))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = Scans(Mode.PUSHDOWN_ONLY).scan("lineitem", table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_tax") > 0.07, ("l_tax",))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_tax), GreaterThan(l_tax,0.07)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan


def log(folder, number, *rows):
    (folder / f"change.{number:06d}.json").write_text("\n".join(json.dumps({"table": t, "type": kind, "ts": ts, "row": row}) for t, kind, ts, row in rows))


def test_log_reader(tmp_path, spark):
    row = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    assert envelope(row).names == ["table", "type", "ts", "row"]
    log(tmp_path, 1, ("t", "INSERT", 5, {"k": 1, "v": "a"}), ("u", "INSERT", 9, {"k": 9, "v": "z"}), ("t", "UPDATE", 5, {"k": 1, "v": "b"}))
    reader = LogReader(spark, str(tmp_path), "t", row)
    got, newest = reader.pull()
    got = sorted(got.collect(), key=lambda r: r._seq)
    assert [(r.k, r.v, r.type, r._version) for r in got] == [(1, "a", "INSERT", 1), (1, "b", "UPDATE", 1)] and newest == 5
    assert fresh(spark.createDataFrame([], row), reader.pull()[0], ["k"]).count() == 0
    empty, none = reader.pull()
    assert empty.count() == 0 and none is None
    log(tmp_path, 2, ("t", "DELETE", 7, {"k": 1, "v": "b"}))
    again, newest = reader.pull()
    assert [(r.type, r._version) for r in again.collect()] == [("DELETE", 2)] and newest == 7


def test_the_last_record_of_a_split_log_wins(tmp_path, spark):
    """One file read in many ranges; times tie or run backwards."""
    row = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    log(tmp_path, 1, *(("t" if i % 3 else "u", "UPDATE", 1000 - i // 10_000, {"k": i % 2, "v": i}) for i in range(30_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150000")
    try:
        got, _ = LogReader(spark, str(tmp_path), "t", row).pull()
        assert got.rdd.getNumPartitions() > 5 and got.select("_seq").distinct().count() == got.count() == 20_000
        merged = fresh(spark.createDataFrame([(0, -1), (7, 7)], row), got, ["k"])
        assert sorted(map(tuple, merged.collect())) == [(0, 29_998), (1, 29_999), (7, 7)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_replayed_batches_change_nothing(tmp_path, spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    t = MergeTable(spark, f"file://{tmp_path}/t", KEY, compact_every=3)
    t.create(base)
    all_ = changes(spark, sf_dir)
    for batch, version in ((0, 1), (1, 2), (1, 2), (2, 3)):
        t.upsert(all_.where(F.col("_version") == version), batch)
    want = sorted(map(tuple, t.read().collect()))
    assert t.versions() == [-1, 2] and sorted(map(tuple, fresh(base, all_, KEY).collect())) == want
    t.rebase()
    t.upsert(all_.where("_version = 2"), 1)
    assert t.versions() == [2] and sorted(map(tuple, t.read().collect())) == want
    t2 = MergeTable(spark, f"file://{tmp_path}/t2", KEY)
    t2.create(base)
    all_.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        run(stream_changes(spark, f"file://{tmp_path}/in", all_.schema), t2, f"file://{tmp_path}/state").awaitTermination()
    assert sorted(map(tuple, t2.read().collect())) == want and len(t.versions()) <= 3
    assert sum(len(b) for b in fresh_batches(t.read(), 100)) == len(want)


def test_batches_write_their_changes_only(tmp_path, spark):
    stable = spark.range(20_000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    change = lambda k, v, kind, version: spark.createDataFrame([(k, v, kind, version, 0)], "k long, v string, type string, _version long, _seq long")
    t = MergeTable(spark, f"file://{tmp_path}/t", ["k"], compact_every=100)
    t.create(stable)
    for batch in range(4):
        t.upsert(change(batch, f"b{batch}", "UPDATE", batch), batch)
    t.upsert(change(0, None, "DELETE", 9), 4)
    t.upsert(change(0, "late", "UPDATE", 5), 5)  # older than the delete that came before it
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / "t" / name).glob("part-*"))
    assert size("changes=3-3") < size("base=-1") / 10
    rows = lambda df: {r.k: r.v for r in df.where("v <> 'a'").collect()}
    assert rows(t.read()) == {1: "b1", 2: "b2", 3: "b3"} and t.read().count() == 19_999 and rows(t.read(1)) == {0: "b0", 1: "b1"}
    t.compact()
    assert t.changes() == [(0, 5)] and rows(t.read()) == {1: "b1", 2: "b2", 3: "b3"} and t.read().count() == 19_999


def test_periodic_pull(tmp_path, spark):
    schema = "k long, v string, type string, _version long, _seq long"
    t = MergeTable(spark, f"file://{tmp_path}/t", ["k"])
    t.create(spark.createDataFrame([(1, "a")], "k long, v string"))
    (tmp_path / "in").mkdir()
    q = run(stream_changes(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema), t, f"file://{tmp_path}/state", {"processingTime": "1 second"})
    try:
        for k, v in ((1, "b"), (2, "c")):  # files that come while it runs
            spark.createDataFrame([(k, v, "INSERT", k, 0)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            for _ in range(120):
                if v in {r.v for r in t.read().collect()}:
                    break
                time.sleep(0.5)
        assert sorted(map(tuple, t.read().collect())) == [(1, "b"), (2, "c")] and q.isActive
    finally:
        q.stop()


def test_windowed_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    assert windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_generator_repeats_with_its_seed():
    assert Generator(4, 1.0).batch(8, 0.5) == Generator(4, 1.0).batch(8, 0.5)
    assert len(set(Generator(4).batch(30, 0.9))) < 20


def test_generator_batches():
    hot = Generator(4).hot_batch(20, 0.6)
    assert len(hot) == 20 and hot.count(hot[0]) >= 12 and len(set(hot)) > 4
    weighted = Generator(4, 2.0).weighted_batch(40)
    latest = sum("2000" in q for q in weighted)
    assert abs(len(weighted) - 40) <= 3 and latest > len(weighted) / 2
    warm, measured = Generator(4).model(0.25, 0.5, 3)
    assert "SELECT lo_orderkey, lo_linenumber, lo_custkey FROM" in warm and "lo_quantity <= 25" in warm and warm < measured
