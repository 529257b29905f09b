"""Relational operators as functions from DataFrames to DataFrames; Catalyst plans them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(df: DataFrame, renames: dict[str, str] | None = None, **expressions: Column) -> DataFrame:
    """Passed-through columns (old name: new name), then computed ones."""
    return df.select(*(F.col(a).alias(b) for a, b in (renames or {}).items()), *(e.alias(n) for n, e in expressions.items()))


def hash_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on pairs of columns. how: inner, left, right, full, semi (each matched left
    row once) or anti. Nulls match nothing. A right column whose name the left has too
    comes out as <name>_r."""
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    for c in right.columns:
        if c.lower() in clash:
            right = right.withColumnRenamed(c, f"{c}_r")
    on = [left[a] == right[f"{b}_r" if b.lower() in clash else b] for a, b in keys]
    return left.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def nested_loop_join(left: DataFrame, right: DataFrame, predicate: Column | None = None, how: str = "inner", small_rows: int = 10_000) -> DataFrame:
    """Join by any predicate, or all pairs without one. The side that is replicated is
    broadcast only if it is counted to have at most small_rows rows."""
    if how in ("inner", "left") and right.limit(small_rows + 1).count() <= small_rows:
        right = F.broadcast(right)
    elif how in ("inner", "right") and left.limit(small_rows + 1).count() <= small_rows:
        left = F.broadcast(left)
    if predicate is None:
        return left.crossJoin(right)
    return left.join(right, predicate, how)


def group(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Grouped aggregates; without aggregates the distinct keys, without keys one row."""
    if not aggregates:
        return df.select(keys).distinct()
    return df.groupBy(*keys).agg(*aggregates)


def sort(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """keys: (column, ASC or DESC). Nulls come last in both directions."""
    return df.orderBy(*order(*keys))


def top_k(df: DataFrame, k: int, *keys: tuple[str, str]) -> DataFrame:
    """The first k rows of ``sort``, without sorting all of them; add a unique key against ties."""
    return sort(df, *keys).limit(k)


def order(*keys: tuple[str, str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d.upper() == "DESC" else F.col(c).asc_nulls_last() for c, d in keys]


def shuffle(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows dealt out by the hash of their keys."""
    cols = [F.col(k) for k in keys]
    return df.repartition(partitions, *cols) if partitions else df.repartition(*cols)


def split(df: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt out evenly."""
    return df.repartition(partitions)


def merge_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of two tables side by side, matched by a key both have (rows of a
    DataFrame have no position). Raises where another name is in both tables, or where the
    keys differ or repeat: checked by counting before anything is joined."""
    if twice := sorted((set(left.columns) & set(right.columns)) - set(keys)):
        raise ValueError(f"columns in both tables: {', '.join(twice)}")
    side = lambda df, a, b: df.select(*keys, F.lit(a).alias("_left"), F.lit(b).alias("_right"))
    odd = side(left, 1, 0).union(side(right, 0, 1)).groupBy(*keys).agg(F.sum("_left").alias("l"), F.sum("_right").alias("r")).where("l <> 1 OR r <> 1").limit(1).count()
    if odd:
        raise ValueError("the tables don't have the same rows")
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, condition).drop(*(f"_right_{k}" for k in keys))


def bag_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest(df: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """For each key the row that is last by the columns."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in by))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def bloom_filter(build: DataFrame, columns: list[str], fpr: float = 0.01, max_bits: int = 1 << 23) -> tuple[DataFrame, int, int]:
    """A Bloom filter of the distinct keys as one row with an array of 64-bit words, its number
    of bits and of hashes. The bits follow from the number of keys and the rate of false
    positives, up to max_bits: beyond that the rate grows, not the filter. Keys with a null
    set no bit."""
    present = build.select(*columns).dropna()
    n = present.agg(F.approx_count_distinct(F.struct(*columns))).first()[0]
    wanted = math.ceil(max(1, n) * -math.log(fpr) / math.log(2) ** 2)
    bits = min(max_bits, max(64, -(-wanted // 64) * 64))
    hashes = max(1, min(16, round(bits / max(1, n) * math.log(2))))
    places = present.select(F.explode(F.array(*_places(columns, bits, hashes))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("v"))
    every = build.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words")), bits, hashes


def _places(columns: list[str], bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), *columns), F.lit(bits)) for k in range(hashes)]


def bloom_join(probe: DataFrame, build: DataFrame, keys: list[tuple[str, str]], fpr: float = 0.01, max_bits: int = 1 << 23) -> DataFrame:
    """An inner equi-join whose probe rows first pass a Bloom filter of the build side's keys,
    before they are shuffled. The filter decides nothing: a false positive finds no partner
    in the join. Both sides' keys are of one type, as the filter hashes them."""
    words, bits, hashes = bloom_filter(build, [b for _, b in keys], fpr, max_bits)
    held = words.scalar()  # one value of at most max_bits
    may = F.lit(True)
    for p in _places([a for a, _ in keys], bits, hashes):
        may = may & (F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return hash_join(probe.where(may), build, keys)


def semi_reduction(probe: DataFrame, build: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """The probe rows that can match: what a Bloom filter of the build keys would pass, without
    its false positives. Spark adds its own runtime filters to large joins; this is for
    scans whose reduced rows are used more than once."""
    small = build.select(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys))).distinct()
    return probe.join(small, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)], "left_semi")
