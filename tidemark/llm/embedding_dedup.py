"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector o is rotated by a fixed random orthogonal matrix; its code is the signs of
the rotated vector, read as the unit vector x with components +-1/sqrt(D). With the stored
factor f = <x, o> the estimate <x, q> / f of <o, q> is unbiased over the rotation, with a
standard error of sqrt((1 - f^2) / f^2 / (D - 1)). Vectors of few components have codes by
several rotations, 256 bits in all, whose estimates are averaged. q is the other vector's
rotated form in four bits a component, rounded at random (a fixed dither), which adds a
standard error of at most half a step. A pair whose estimate plus ``sigmas`` errors stays below the threshold,
seen from either side, is dropped; all others are recomputed exactly in double precision.

Codes, factors and four-bit forms are computed once and stored: D / 2 + 8 bytes a vector, and
D / 8 + 4 more for each rotation.
Pairs to estimate come from tables of k code bits of further rotations (buckets). k grows
with the logarithm of the number of distinct vectors, and the number of tables is what a
chance of ``miss`` of losing a pair at the threshold asks for. Only the stored codes are
dealt to buckets; a vector itself follows to those buckets where one of its pairs is
undecided. A bucket of more than ``block`` vectors is dealt to block pairs, so no task holds
it all; a pair is counted in the first table in which it meets. Equal vectors are one vector
with a weight, and vectors of different lengths never meet.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import ship, shuffle_partitions, table, written
from tidemark.llm.components import connected_components

SEED = 7


@functools.lru_cache(maxsize=8)
def rotations(dim: int, bits: int, tables: int) -> np.ndarray:
    """[dim, tables * bits]: rows of random rotations, as many as are needed."""
    rng = np.random.default_rng(SEED + 1)
    parts, have = [], 0
    while have < tables * bits:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
        have += dim
    return np.concatenate(parts, axis=1)[:, : tables * bits]


@functools.lru_cache(maxsize=8)
def code_rotations(dim: int) -> tuple[np.ndarray, ...]:
    """The rotations of the codes, 8 at most."""
    rng = np.random.default_rng(SEED)
    return tuple(np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(min(8, -(-256 // dim))))


def plan(n: int, threshold: float, miss: float, per_bucket: int = 512) -> tuple[int, int]:
    """Bits of a bucket and number of tables for n vectors."""
    bits = int(min(30, max(3, round(math.log2(max(n, 2) / per_bucket)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(miss) / math.log(1 - agree)))


def code_of(unit: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, codes (+-1/sqrt(D)) and correction factors."""
    turned = unit @ rotation
    x = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned, x, (x * turned).sum(axis=1)


# ---- stored codes: signs by each rotation, four-bit components by the first, factors,
# ---- smallest component, step

def packed_codes(unit: np.ndarray) -> np.ndarray:
    """[vector, byte] of unit vectors."""
    n, dim = unit.shape
    coded = [code_of(unit, r) for r in code_rotations(dim)]
    turned = coded[0][0]
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-12)
    dither = np.random.default_rng(SEED + 2).random(dim)
    levels = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 15).astype(np.uint8)
    levels = np.concatenate([levels, np.zeros((n, dim % 2), np.uint8)], axis=1)
    numbers = np.stack([*(f for _, _, f in coded), low, step], axis=1).astype("<f4")
    return np.concatenate([*(np.packbits(t >= 0, axis=1) for t, _, _ in coded), levels[:, ::2] << 4 | levels[:, 1::2], numbers.view(np.uint8)], axis=1)


def unpacked_codes(raw: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The mean over the rotations of code / factor, turned into the first one's frame; four-bit
    components; squared standard errors of an estimate by the codes; steps."""
    rotations_, width = code_rotations(dim), -(-dim // 8)
    at, r = width * len(rotations_), len(rotations_)
    to = at + -(-dim // 2)
    numbers = np.ascontiguousarray(raw[:, to:]).view("<f4")
    x = np.zeros((len(raw), dim), np.float32)
    for k, rotation in enumerate(rotations_):
        signs = np.unpackbits(raw[:, k * width : (k + 1) * width], axis=1)[:, :dim].astype(np.float32) * 2 - 1
        signs /= np.float32(r * math.sqrt(dim)) * numbers[:, k : k + 1]
        x += signs if k == 0 else signs @ (rotation.T @ rotations_[0]).astype(np.float32)
    f2 = numbers[:, :r].astype(np.float64) ** 2
    spread = (np.maximum(0, 1 - f2) / f2).sum(axis=1) / (r * r * max(1, dim - 1))
    levels = np.stack([raw[:, at:to] >> 4, raw[:, at:to] & 15], axis=2).reshape(len(raw), -1)[:, :dim]
    return x, levels * numbers[:, r + 1 :] + numbers[:, r : r + 1], spread, numbers[:, r + 1].astype(np.float64)


def undecided(a: tuple, b: tuple, threshold: float, sigmas: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of a, mask [row of a, row of b]) of the pairs that the bounds don't exclude;
    a and b as ``unpacked_codes`` gives them."""

    def bound(q: np.ndarray, q_step: np.ndarray, x: np.ndarray, spread: np.ndarray) -> np.ndarray:
        size = (x * x).sum(axis=1)
        return q @ x.T + np.sqrt(sigmas * sigmas * (spread[None, :] + size[None, :] * (q_step * q_step / 4)[:, None])).astype(np.float32)

    (x1, q1, f1, s1), (x2, q2, f2, s2) = a, b
    for low in range(0, len(x1), 512):
        rows = slice(low, low + 512)
        can = bound(q1[rows], s1[rows], x2, f2) >= threshold - 1e-4
        can &= bound(q2, s2, x1[rows], f1[rows]).T >= threshold - 1e-4
        yield low, can


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Of rows of one length, without nulls."""
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), dim)


def _bucket_keys(v: np.ndarray, planes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (v @ planes >= 0).reshape(len(v), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _scaled(v: np.ndarray) -> np.ndarray:
    """By powers of two, which rounds nothing: squares of very large and very small components
    neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _coded(bits: int, tables: int):
    """Rows (id, dim, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                part = whole.slice(start, 2000)
                dims = part.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    b = part.filter(pa.array(dims == dim))
                    v = _unit(_matrix(b.column(2), dim))
                    keys = _bucket_keys(v, rotations(dim, bits, tables), bits, tables) + (np.arange(tables, dtype=np.int64) << 32)
                    raw = packed_codes(v)
                    code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, lists], names=["id", "dim", "code", "buckets"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], value) -> Iterator[tuple[tuple, int, tuple]]:
    """Rows (dim, bucket, low, high, side, id, ...) sorted by the first five, as ((dim, bucket,
    low, high), side, (ids, what value makes of the other columns, which is a tuple of arrays))."""
    key, held = None, []
    for b in batches:
        keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            if hi == lo:
                continue
            k = tuple(keys[:, lo].tolist())
            if k != key and held:
                yield key[:4], key[4], tuple(np.concatenate(x) for x in zip(*held))
                held = []
            key = k
            held.append((b.column(5).slice(lo, hi - lo).to_numpy(), *value(b.slice(lo, hi - lo), k[0])))
    if held:
        yield key[:4], key[4], tuple(np.concatenate(x) for x in zip(*held))


def _met(batches: Iterator[pa.RecordBatch], value) -> Iterator[tuple[tuple, tuple, tuple, bool]]:
    """((dim, bucket, low, high), one block, another one or itself, whether it is itself)."""
    first = None
    for where, side, group in _groups(batches, value):
        if side == 2:
            yield where, group, group, True
        elif side == 0:
            first = (where, group)
        elif first and first[0] == where:
            yield where, first[1], group, False


def _open(threshold: float, sigmas: float):
    """Rows (dim, bucket, low, high, side, id, code); gives those with an undecided pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = lambda b, dim: (np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(b.num_rows, -1),)
        for (dim, bucket, low, high), (ids1, r1), (ids2, r2), same in _met(batches, raw):
            if same and len(ids1) < 2:
                continue
            a = unpacked_codes(r1, dim)
            b = a if same else unpacked_codes(r2, dim)
            left, right = np.zeros(len(ids1), bool), np.zeros(len(ids2), bool)
            for start, can in undecided(a, b, threshold, sigmas):
                if same:
                    can[np.arange(len(can)), np.arange(start, start + len(can))] = False
                left[start : start + len(can)] |= can.any(axis=1)
                right |= can.any(axis=0)
            for side, ids in ([(2, ids1[left | right])] if same else [(0, ids1[left]), (1, ids2[right])]):
                if n := len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), *(pa.array(np.full(n, x, np.int64)) for x in (bucket, low, high)), pa.array(np.full(n, side, np.int32)), pa.array(ids)], names=["dim", "bucket", "low", "high", "side", "id"])

    return run


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        p, q = root[a], root[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return root


def _bucket_links(bits: int, tables: int, threshold: float, sigmas: float):
    """Rows (dim, bucket, low, high, side, id, v, weight), sorted by the first five: two blocks
    of a bucket (sides 0 and 1), or one that is compared with itself (side 2). Out: for each
    vector with a link its linked weight and the smallest id reachable by the links found here."""

    def compare(dim: int, t: int, a: tuple, b: tuple, same: bool):
        ids1, v1, w1 = a
        ids2, v2, w2 = b
        planes = rotations(dim, bits, tables)
        u1, u2 = _unit(v1), _unit(v2)
        k1, k2 = _bucket_keys(u1, planes, bits, tables)[:, :t], _bucket_keys(u2, planes, bits, tables)[:, :t]
        c1 = unpacked_codes(packed_codes(u1), dim)
        c2 = c1 if same else unpacked_codes(packed_codes(u2), dim)
        out = []
        for low, can in undecided(c1, c2, threshold, sigmas):
            i, j = np.nonzero(can)
            i += low
            if same:
                i, j = i[i < j], j[i < j]
            exact = np.empty(len(i))
            for c in range(0, len(i), 100_000):
                p, q = v1[i[c : c + 100_000]], v2[j[c : c + 100_000]]
                exact[c : c + 100_000] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
            i, j = i[exact >= threshold], j[exact >= threshold]
            if t and len(i):
                new = np.concatenate([~(k1[i[c : c + 100_000]] == k2[j[c : c + 100_000]]).any(axis=1) for c in range(0, len(i), 100_000)])
                i, j = i[new], j[new]
            if len(i):
                out.append((ids1[i], w2[j], ids2[j]))
                out.append((ids2[j], w1[i], ids1[i]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = lambda b, dim: (_scaled(_matrix(b.column(6), dim)), b.column(7).to_numpy())
        for (dim, bucket, _, _), a, b, same in _met(batches, value):
            if found := compare(dim, bucket >> 32, a, b, same):
                who, weight, other = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(who, kind="stable")
                who, weight, other = who[order], weight[order], other[order]
                at = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                ids, linked = who[at], np.add.reduceat(weight, at)
                once = other < who  # each link is there both ways
                root = _roots(np.searchsorted(ids, who[once]), np.searchsorted(ids, other[once]), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked), pa.array(ids[root])], names=["id", "linked", "least"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 1e-6, sigmas: float = 6.0, block: int = 4096) -> DataFrame:
    """id, n_links, component_id, kept for each row.

    n_links: other rows with a cosine of at least the threshold (a tie links). component_id:
    the smallest id reachable by links. A vector that is null, zero, or holds a null or
    non-finite component links with nothing: it is its own component. Vectors of different
    lengths don't link with each other. Repeated ids are rows of their own. Integer ids; a
    null id never is the smallest. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # 0.0 and -0.0 are one value in a key
    rows = written(rows.withColumn("vkey", F.when(F.col("fine"), F.sha2(F.to_json(F.transform("v", lambda x: x + F.lit(0.0))), 256))), "vectors")
    good = rows.where("fine")
    distinct = written(good.groupBy("vkey").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v")).withColumn("node", F.xxhash64("vkey")), "distinct")
    n = distinct.count()
    bits, tables = plan(n, threshold, miss)
    parts = max(shuffle_partitions(spark), n * tables // 2_000_000)
    codes = written(distinct.select(F.col("node").alias("id"), F.size("v").alias("dim"), "v").mapInArrow(_coded(bits, tables), "id long, dim int, code binary, buckets array<long>"), "codes")
    keyed = codes.select("dim", F.explode("buckets").alias("bucket"), "id", "code")
    large = written(keyed.groupBy("dim", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).select("dim", "bucket", F.ceil(F.col("n") / block).alias("nb")), "large-buckets")
    dealt = keyed.join(large, ["dim", "bucket"], "left").withColumn("nb", F.coalesce("nb", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side")
    dealt = dealt.select("dim", "bucket", "id", "code", "own", other.alias("other")).select("dim", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side, "id", "code")
    pair, order = ("dim", "bucket", "low", "high"), ("dim", "bucket", "low", "high", "side", "id")
    open_ = written(dealt.repartition(parts, *pair).sortWithinPartitions(*order).mapInArrow(_open(threshold, sigmas), "dim int, bucket long, low long, high long, side int, id long"), "undecided")
    with_v = open_.join(distinct.select(F.col("node").alias("id"), "v", "weight"), "id").select(*order, "v", "weight")
    found = written(with_v.repartition(parts, *pair).sortWithinPartitions(*order).mapInArrow(_bucket_links(bits, tables, threshold, sigmas), "id long, linked long, least long"), "bucket-links")
    totals = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    labels = connected_components(found.select("id", "least"), "id", "least")
    out = distinct.join(totals.withColumnRenamed("id", "node"), "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = out.groupBy("label").agg(F.min("least").alias("component_id"))
    by_key = written(out.join(lowest, "label").select("vkey", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "by-vector")
    result = good.select("id", "vkey").join(by_key, "vkey").select("id", "n_links", "component_id")
    result = result.union(rows.where("not fine").select("id", F.lit(0).cast("long"), "id"))
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links and components."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x),
k AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT v.vec_id, coalesce(k.k, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN k ON k.x = v.vec_id
"""
