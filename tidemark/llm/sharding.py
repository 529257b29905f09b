"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Rows with equal texts form one indivisible group. Every group starts as a partial
partition with all its bytes in one of the k subsets; the two partials with the
largest spread (largest minus smallest subset) are combined over and over, the
heaviest subset of one with the lightest of the other, until one is left.

The differencing is done in levels so that no task holds all groups. Groups of more than a
thousandth of a shard go to the last level as they are (there can't be more than 1,000 for
each shard). The small ones are dealt to blocks of about ``block_groups``, at least 1,000
blocks, each differenced in one task into k bundles of equal bytes. While that leaves more
than 1,000 blocks' bundles, these are dealt to blocks and differenced in turn. Large groups
and the last bundles are then differenced on the driver, each as one number: at most 2,000
for each shard, however many rows there are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import shared_root, ship, shuffle_partitions, table, written


#: groups of more than 1/LARGE of a shard aren't differenced in blocks
LARGE = 1000


def difference(partials: list[list[int]], k: int) -> tuple[np.ndarray, list[int]]:
    """partials: up to k subset sums each. Returns the final subset of each subset of
    each partial, as [partial, subset], and the k sums in descending order. Ties go by
    the order of the list."""
    n = len(partials)
    parent = list(range(n * k))
    heap = []
    for i, sums in enumerate(partials):
        parts = sorted(((s, i * k + j) for j, s in enumerate(sums)), key=lambda x: (-x[0], x[1]))
        sums_ = [s for s, _ in parts] + [0] * (k - len(parts))
        sets = [j for _, j in parts] + [-1] * (k - len(parts))
        heap.append((sums_[-1] - sums_[0], i, sums_, sets))
    heapq.heapify(heap)
    seq = n
    while len(heap) > 1:
        _, _, s1, t1 = heapq.heappop(heap)
        _, _, s2, t2 = heap[0]
        merged = []
        for a, p, b, q in zip(s1, t1, reversed(s2), reversed(t2)):
            if p < 0:
                p = q
            elif q >= 0:
                parent[q] = p
            merged.append((a + b, p))
        merged.sort(key=lambda x: -x[0])
        sums_ = [s for s, _ in merged]
        heapq.heapreplace(heap, (sums_[-1] - sums_[0], seq, sums_, [p for _, p in merged]))
        seq += 1
    if not heap:
        return np.zeros((0, k), np.int32), [0] * k
    _, _, sums_, sets = heap[0]
    index = {p: j for j, p in enumerate(sets) if p >= 0}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return np.array([index.get(root(x), 0) for x in range(n * k)], np.int32).reshape(n, k), sums_


def _difference_blocks(k: int):
    """Rows (block, gkey, gsize), whole blocks in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        blocks, keys, sizes = (t[c].to_numpy() for c in ("block", "gkey", "gsize"))
        order = np.lexsort((keys, -sizes, blocks))
        blocks, keys, sizes = blocks[order], keys[order], sizes[order]
        cut = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(cut, cut[1:]):
            where, _ = difference([[s] for s in sizes[a:b].tolist()], k)
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(sizes[a:b]), pa.array(blocks[a:b].astype(np.int64) * k + where[:, 0])], names=["gkey", "gsize", "bundle"])

    return run


def balanced_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", block_groups: int = 250_000, least_blocks: int = LARGE) -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus 1 (a null text counts as no bytes; its rows are
    a group of their own, apart from empty texts). Equal texts share a shard, so a
    group larger than rows/n_shards makes its shard that large. slot counts from 0
    within a shard without gaps, in no meaningful order; equal rows are kept, each with
    its own slot. Null ids are kept. An empty table gives no rows. Other columns of
    docs are ignored, and a text of any length is only measured. Groups of equal size are
    taken in the order of their hashes. Groups are told apart by a 64-bit hash: two texts
    that collide would share a shard, nothing else.
    """
    spark = docs.sparkSession
    ship(spark)
    shared_root(spark)
    text = F.col(text_col)
    slim = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("gkey"),
        ),
        "shard-rows",
    )
    groups = written(slim.groupBy("gkey").agg(F.sum("size").alias("gsize")), "shard-groups")
    n_groups, n_rows = groups.count(), slim.count()
    block_groups = max(block_groups, 4 * n_shards)  # a level must leave fewer numbers than it takes
    limit = (groups.agg(F.sum("gsize")).first()[0] or 0) // (n_shards * LARGE)
    large = [(r["gkey"], r["gsize"]) for r in groups.where(F.col("gsize") > limit).collect()]  # n_shards * LARGE at most
    level, count, levels = groups.where(F.col("gsize") <= limit), n_groups, []
    while True:
        n_blocks = max(least_blocks, math.ceil(count / block_groups))
        dealt = level.select(F.pmod(F.xxhash64("gkey"), F.lit(n_blocks)).alias("block"), "gkey", "gsize")
        parts = max(shuffle_partitions(spark), count // 1_000_000)
        levels.append(written(dealt.repartition(parts, "block").mapInArrow(_difference_blocks(n_shards), "gkey long, gsize long, bundle long"), "shard-bundles"))
        level = levels[-1].groupBy(F.col("bundle").alias("gkey")).agg(F.sum("gsize").alias("gsize"))
        if n_blocks <= least_blocks:
            break
        count = n_blocks * n_shards
    bundles = [tuple(r) for r in level.collect()]  # n_shards * least_blocks at most
    items = sorted([(-n, 0, key) for key, n in large] + [(-n, 1, bundle) for bundle, n in bundles])
    where, _ = difference([[-n] for n, _, _ in items], n_shards)
    found = [(kind, key, int(where[i, 0])) for i, (_, kind, key) in enumerate(items)]
    direct = spark.createDataFrame([(key, shard) for kind, key, shard in found if kind == 0], "gkey long, shard int")
    shard_of = spark.createDataFrame([(key, shard) for kind, key, shard in found if kind == 1], "gkey long, shard int")
    for bundled in reversed(levels):
        shard_of = bundled.select("gkey", "bundle").join(shard_of.withColumnRenamed("gkey", "bundle"), "bundle").select("gkey", "shard")
    shard_of = shard_of.union(direct)

    n_buckets = max(math.ceil(n_rows / (n_shards * 50_000)), math.ceil(shuffle_partitions(spark) / n_shards))
    dealt = written(slim.join(shard_of, "gkey").withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.lit(n_buckets)).cast("int")), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("shard", "bucket").orderBy("id", "gkey")
    return (
        dealt.withColumn("rn", F.row_number().over(own))
        .join(offsets, ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("rn") - 1).cast("long").alias("slot"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = balanced_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
