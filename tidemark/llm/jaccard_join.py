"""N-gram Jaccard join over whole documents.

1. Every document becomes its sorted set of distinct 5-word shingles (64-bit hashes).
   Equal sets are one class from here on, however many copies there are.
2. Each class gets 40 tile keys (4 minhashes each). Two sets of Jaccard similarity 0.8
   share no tile with probability (1 - 0.8^4)^40 < 1e-9; nothing else drops a pair.
3. Inside a tile the classes are sorted by size and cut into size bands. The first class
   of a band is its pivot and is compared with each member (links in proportion to rows,
   however large a tile is). Verified links are merged into components.
4. The tiles of six of the keys that still hold more than one component get other pivots,
   drawn at random; a member is compared with its pivot where their components differ.
5. Where a tile then still holds more than one component, all pairs across components are
   compared: sizes, then hashed bitmaps (parity of the shingles per bit; the differing bits
   bound the overlap from above), and the shingles of the classes with a pair that these
   leave open follow to the tile for the exact intersection. A pair is compared in the
   first tile it shares only, and classes that have come together in a tile aren't
   compared any more, so a tile hands on a forest of links: fewer than it has rows.

A tile of very many classes is cut into parts for the pivots and dealt to pairs of blocks
afterwards, of which those of its largest component needn't meet each other. An exact
comparison is an intersection of two sorted arrays: 100*inter >= 80*union.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import forget, ship, shuffle_partitions, table, written
from tidemark.llm.components import connected_components
from tidemark.llm.text import mix, shingle_set, word_hashes

BANDS, ROWS = 40, 4
#: classes of a block, and shingles, beyond which a tile is dealt to pairs of blocks
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: classes of a tile beyond which its pivots are drawn in parts of that many
PART = 50_000
#: links are looked for in the tiles of these bands, round by round
STARS, ROUNDS = (0, 6), ((0, 4), (4, BANDS))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def tile_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[set, band] keys; every set has at least one shingle."""
    a, b = _permutations()
    mins = np.empty((len(a), len(sets)), np.uint32)
    folded = [(s ^ (s >> np.uint64(32))).astype(np.uint32) for s in sets]
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 1 << 15):
            size += len(sets[j])
            j += 1
        x = np.concatenate(folded[i:j])
        at = np.concatenate([[0], np.cumsum([len(s) for s in folded[i : j - 1]], dtype=np.int64)]) if j - i > 1 else np.zeros(1, np.int64)
        y = np.empty_like(x)
        for k in range(len(a)):
            np.multiply(x, a[k], out=y)
            y += b[k]
            y ^= y >> np.uint32(15)
            mins[k, i:j] = np.minimum.reduceat(y, at)
        i = j
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + mins[r::ROWS].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None]).T.view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles per bit; 64 to 16,384 bits, four for each shingle up to there.
    Half of a bitmap xor its other half is the bitmap of half as many bits."""
    bits = 64
    while bits < 4 * len(s) and bits < 16_384:
        bits *= 2
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").astype(np.uint8).tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def alike(inter: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int):
    return 100 * inter >= 80 * (n + m - inter)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            b = whole.slice(start, 1000)
            sets = [shingle_set(w) for w in word_hashes(b.column(1).cast(pa.binary()).to_pylist())]
            full = [s for s in sets if len(s)]
            keys = tile_keys(full) if full else np.zeros((0, BANDS), np.int64)
            lists = iter(pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))).to_pylist()) if len(full) < len(sets) else None
            tiles = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))) if lists is None else pa.array([next(lists) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), tiles],
                names=["id", "tkey", "n", "skey", "bits", "tiles"],
            )


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            sets = [shingle_set(w) for w in word_hashes(whole.column(0).slice(start, 1000).cast(pa.binary()).to_pylist())]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["skey", "shingles"])


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]))


TILE_OUT = "kind int, a binary, b binary, key long, part long, n long, band int"


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, skey, n, band) come sorted by key, part and n. kind 0: a pivot and a
    member of its size band; kind 1: a member of a tile of three or more, for the later
    rounds. part is -1 but in tiles that are cut into parts."""
    key = pivot = pivot_n = None
    early: list[tuple] = []  # the first two members of the tile
    seen = 0
    for batch in batches:
        keys, cuts, ids, ns, bands = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3).to_numpy(), batch.column(4).to_numpy()
        # rows of tiles that lie wholly inside this batch and hold one row say nothing
        alone = cuts < 0
        alone[1:] &= keys[1:] != keys[:-1]
        alone[:-1] &= keys[1:] != keys[:-1]
        if len(keys):
            alone[0] &= key is None or keys[0] != key[0]
            alone[-1] = False
        out: list[tuple] = []
        at = np.flatnonzero(~alone)
        for k, cut, n, band, x in zip(keys[at].tolist(), cuts[at].tolist(), ns[at].tolist(), bands[at].tolist(), ids.take(pa.array(at)).to_pylist()):
            if (k, cut) != key:
                key, pivot, pivot_n, early, seen = (k, cut), x, n, [(x, n)], 1
                if cut >= 0:
                    seen = 3
                    out.append((1, x, None, k, cut, n, band))
                continue
            seen += 1
            if 100 * pivot_n >= 80 * n:
                out.append((0, pivot, x, k, cut, n, band))
            else:
                pivot, pivot_n = x, n
            if seen == 2:
                early.append((x, n))
            elif seen == 3:
                out.extend((1, e, None, k, cut, m, band) for e, m in early)
            if seen >= 3:
                out.append((1, x, None, k, cut, n, band))
        if out:
            kind, a, b, k, cut, n, band = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(k, pa.int64()), pa.array(cut, pa.int64()), pa.array(n, pa.int64()), pa.array(band, pa.int32())], names=["kind", "a", "b", "key", "part", "n", "band"])


class _Tile:
    """Members (skey, n, label, bits, tiles and maybe shingles) of a tile, or of a block of one."""

    def __init__(self, rows: list[tuple]):
        ids, n, label, bits, tiles, *sets = zip(*rows)
        self.ids, self.n, self.label = list(ids), np.array(n, np.int64), list(label)
        arrays = [np.frombuffer(x, np.uint64) for x in bits]
        self.width = min(len(x) for x in arrays)
        self.bits = np.stack([fold(x, self.width) for x in arrays])
        self.tiles = np.array(tiles, np.int64)
        self.sets = [np.frombuffer(x, np.uint64) for x in sets[0]] if sets else []


def _exact(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of a sorted array with each of the others."""
    every = np.concatenate(sets)
    at = np.searchsorted(one, every)
    at[at == len(one)] = len(one) - 1
    return np.add.reduceat(one[at] == every, np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]], dtype=np.int64)]), dtype=np.int64)


def _open(p: _Tile, q: _Tile, band: int, root1: np.ndarray, root2: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(member i of q, members of p that may link with it) by the roots as they are when i's
    turn comes, sizes and bitmaps; of one tile each pair once. Pairs that share a tile of a
    lower band are left out: they are compared there."""
    width = min(p.width, q.width)
    x, y = fold(p.bits, width), fold(q.bits, width)
    for i in range(len(q.ids)):
        upto = i if p is q else len(p.ids)
        n, m = p.n[:upto], q.n[i]
        js = np.flatnonzero((root1[:upto] != root2[i]) & (100 * np.minimum(n, m) >= 80 * np.maximum(n, m)))
        if not len(js):
            continue
        apart = np.bitwise_count(x[js] ^ y[i]).sum(axis=1, dtype=np.int64)
        total, least = p.n[js] + m, np.minimum(p.n[js], m)
        js = js[alike(np.minimum((total - apart) // 2, least), p.n[js], m)]
        if band and len(js):
            js = js[~(p.tiles[js, :band] == q.tiles[i, :band]).any(axis=1)]
        if len(js):
            yield i, js


def _roots(p: _Tile, q: _Tile) -> tuple[np.ndarray, np.ndarray]:
    names = {x: i for i, x in enumerate(dict.fromkeys([*p.label, *q.label]))}
    root1, root2 = (np.array([names[x] for x in t.label]) for t in (p, q))
    return (root1, root1) if p is q else (root1, root2)


def undecided(p: _Tile, q: _Tile, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members of p and of q have a pair that sizes and bitmaps leave open."""
    left, right = np.zeros(len(p.ids), bool), np.zeros(len(q.ids), bool)
    for i, js in _open(p, q, band, *_roots(p, q)):
        left[js] = right[i] = True
    return (left | right,) * 2 if p is q else (left, right)


def forest(p: _Tile, q: _Tile, band: int) -> list[tuple[bytes, bytes]]:
    """Links between members of p and of q (the same tile: between its members) of different
    labels, as many as bring together what is linked."""
    root1, root2 = _roots(p, q)
    out = []
    for i, js in _open(p, q, band, root1, root2):
        m = q.n[i]
        while len(js):
            some, js = js[:32], js[32:]
            inter = _exact(q.sets[i], [p.sets[j] for j in some])
            for j in some[alike(inter, p.n[some], m)].tolist():
                low, high = sorted((int(root1[j]), int(root2[i])))
                if low != high:
                    out.append((min(p.ids[j], q.ids[i]), max(p.ids[j], q.ids[i])))
                    root1[root1 == high] = low
                    root2[root2 == high] = low
            js = js[root1[js] != root2[i]]
    return out


MEMBER = ("skey", "n", "label", "bits", "tiles", "shingles")


def _members(batch: pa.RecordBatch, first: int) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(first, batch.num_columns)))


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.binary()), pa.array([p[1] for p in found], pa.binary())], names=["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, member...) sorted by key and part and at random within. A member is
    compared with the first pivot of a like size if their labels differ; without such a
    pivot it becomes one (as many as size bands). Fewer links than rows."""
    key, pivots = None, []
    for batch in batches:
        found = []
        for start in range(0, batch.num_rows, 500):
            b = batch.slice(start, 500)
            for k, cut, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _members(b, 2)):
                if (k, cut) != key:
                    key, pivots = (k, cut), []
                for pivot in pivots:
                    if 100 * min(row[1], pivot.n[0]) >= 80 * max(row[1], pivot.n[0]):
                        if row[2] != pivot.label[0]:
                            found += forest(pivot, _Tile([row]), 0)
                        break
                else:
                    pivots.append(_Tile([row]))
        yield _pairs(found)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, int, _Tile, _Tile]]:
    """Rows (key, low, high, side, band, member...), sorted by the first four and n: two blocks
    of a tile (sides 0 and 1), or one whose members are compared with each other (side 2), as
    ((key, low, high), band, block, other block or the same)."""
    at, first, rows = None, None, []

    def closed() -> Iterator[tuple[list, int, _Tile, _Tile]]:
        nonlocal first
        if not rows:
            return
        tile = _Tile(rows)
        rows.clear()
        (*where, side), band = at
        if side == 0:
            first = (where, tile)
        elif side == 2:
            yield where, band, tile, tile
        elif first and first[0] == where:
            yield where, band, first[1], tile

    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            b = batch.slice(start, 500)
            for *where, band, row in zip(*(b.column(i).to_pylist() for i in range(5)), _members(b, 5)):
                if at is None or where != at[0]:
                    yield from closed()
                    at = (where, band)
                rows.append(row)
    yield from closed()


def _across_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as ``_met`` takes them, without shingles: those that need theirs."""
    for (key, low, high), band, p, q in _met(batches):
        left, right = undecided(p, q, band)
        for side, t, mask in [(2, p, left)] if p is q else [(0, p, left), (1, q, right)]:
            at = np.flatnonzero(mask).tolist()
            if at:
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([low] * n, pa.int64()), pa.array([high] * n, pa.int64()), pa.array([side] * n, pa.int32()), pa.array([band] * n, pa.int32()), pa.array([t.ids[i] for i in at], pa.binary()), pa.array(t.n[at]), pa.array([t.label[i] for i in at], pa.binary())],
                    names=["key", "low", "high", "side", "band", "skey", "n", "label"],
                )


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as ``_met`` takes them; the links of each pair of blocks."""
    found: list = []
    for _, band, p, q in _met(batches):
        found += forest(p, q, band)
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, x, s, t = (b.column(i).to_pylist() for i in range(4))
        keep = []
        for i in range(b.num_rows):
            if s[i] is None or t[i] is None:
                raise ValueError("a pair without its shingle sets")
            p, q = np.frombuffer(s[i], np.uint64), np.frombuffer(t[i], np.uint64)
            n, m = len(p), len(q)
            if 100 * min(n, m) >= 80 * max(n, m):
                u, v = np.frombuffer(bitmap(p), np.uint64), np.frombuffer(bitmap(q), np.uint64)
                width = min(len(u), len(v))
                apart = int(np.bitwise_count(fold(u, width) ^ fold(v, width)).sum())
                if alike((n + m - apart) // 2, n, m) and alike(overlap(p, q), n, m):
                    keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([x[i] for i in keep], pa.binary())], names=["a", "b"])


def _sets(wanted: DataFrame, docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """skey, shingles of the wanted classes; only one document of each is read again, or those
    of one text where all have no id."""
    one = F.coalesce(F.min_by("tkey", "id"), F.min("tkey")).alias("one_tkey")
    ones = sigs.groupBy("skey").agg(F.min("id").alias("one_id"), one).join(wanted, "skey").select("one_id", "one_tkey")
    same = F.col("id").eqNullSafe(F.col("one_id")) & (F.col("tkey") == F.col("one_tkey"))
    return written(docs.join(ones, same, "left_semi").select("text").mapInArrow(_arrays, "skey binary, shingles binary").dropDuplicates(["skey"]).join(wanted, "skey", "left_semi"), "sets")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold, exactly compared; both need a set."""
    left, right = sets.select(F.col("skey").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("skey").alias("b"), F.col("shingles").alias("t"))
    return written(pairs.join(right, "b", "left").join(left, "a", "left").select("a", "b", "s", "t").mapInArrow(_verify, "a binary, b binary"), "verified")


def _mixed(found: DataFrame, labels: DataFrame, low: int, high: int) -> DataFrame:
    """The members (key, part, band, skey, n, label) of tiles of those bands that hold more
    than one component, with the tile's counts: of all members and of those that are not of
    its largest component (minor says which), each with their shingles."""
    members = found.where(f"kind = 1 AND band >= {low} AND band < {high}").select("key", "part", "band", F.col("a").alias("skey"), "n")
    members = members.join(labels.withColumnRenamed("node", "skey"), "skey", "left").withColumn("label", F.coalesce("label", "skey"))
    by_label = members.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    top = F.max_by(F.struct("label", "c", "s"), F.struct("c", "label")).alias("top")
    tiles = by_label.groupBy("key").agg(top, F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("labels > 1")
    tiles = tiles.select("key", F.col("top.label").alias("top"), F.col("top.c").alias("c0"), F.col("top.s").alias("s0"), (F.col("c") - F.col("top.c")).alias("c1"), (F.col("s") - F.col("top.s")).alias("s1"))
    return members.join(tiles, "key").withColumn("minor", F.col("label") != F.col("top")).drop("top")


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Each member in the pairs of blocks it belongs to. Blocks of the largest component come
    first and don't meet each other."""
    blocks = lambda c, s: F.greatest(F.ceil(F.col(c) / block), F.ceil(F.col(s) / BLOCK_SHINGLES))
    h = F.xxhash64("skey", "key")
    rows = members.withColumn("b0", blocks("c0", "s0")).withColumn("b1", blocks("c1", "s1"))
    rows = rows.withColumn("own", F.when(F.col("minor"), F.col("b0") + F.pmod(h, F.col("b1"))).otherwise(F.pmod(h, F.col("b0"))))
    others = F.sequence(F.when(F.col("minor"), F.lit(0).cast("long")).otherwise(F.col("b0")), F.col("b0") + F.col("b1") - 1)
    rows = rows.withColumn("other", F.explode(others))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side")
    return rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side, "band", "skey", "n", "label")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, part_rows: int = PART) -> DataFrame:
    """id, n_shingles, component_id for each row of docs.

    Two documents link when 100 * |intersection| >= 80 * |union| of their shingle sets.
    component_id: the smallest id of the component, the row's own id for a text that is
    null or has no words (n_shingles 0). Rows with equal sets are always linked, repeated
    rows included. Null ids are ignored by the minimum; a component of null ids only has
    component_id null. An empty table gives no rows; other columns of docs are ignored. A
    pair at exactly 0.8 links. A text of any length is one set: its shingles, 8 bytes each,
    are in one task's memory. block and part_rows only say how large tiles are dealt out.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tkey"))
    kind = docs.schema["id"].dataType.simpleString()
    every = written(docs.mapInArrow(_signatures, f"id {kind}, tkey long, n long, skey binary, bits binary, tiles array<long>"), "signatures")
    sigs = every.where("n > 0")
    classes = written(sigs.groupBy("skey").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("tiles").alias("tiles")), "classes")

    parts = shuffle_partitions(spark)
    rows = classes.select(F.posexplode("tiles").alias("band", "key"), "skey", "n").select("key", "skey", "n", "band")
    n_parts = max(parts, classes.count() * BANDS // 1_000_000)
    # every 64th class tells which tiles are so large that they are cut; what is found isn't affected
    large = written(rows.where(F.pmod(F.xxhash64("skey"), F.lit(64)) == 0).groupBy("key").agg((F.count("*") * 64).alias("c")).where(F.col("c") > part_rows).select("key", F.ceil(F.col("c") / part_rows).alias("parts")), "large-tiles")
    cut = F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("skey", "key"), F.col("parts"))).cast("long").alias("part")
    rows = rows.join(large, "key", "left").select("key", cut, "skey", "n", "band")
    found = written(rows.repartition(n_parts, "key", "part").sortWithinPartitions("key", "part", "n", "skey").mapInArrow(_pivots, TILE_OUT), "tiles")
    pairs = found.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = _sets(found.select(F.col("a").alias("skey")).union(found.where("kind = 0").select("b")).distinct(), docs, sigs)
    links = _links(pairs, sets)
    labels = written(connected_components(links, "a", "b"), "labels")

    member = classes.select("skey", "bits", "tiles").join(sets, "skey")
    for k, (low, high) in enumerate((STARS, *ROUNDS)):
        members = _mixed(found, labels, low, high)
        if k == 0:
            dealt = members.select("key", "part", "skey", "n", "label").join(member, "skey").select("key", "part", *MEMBER)
            dealt = dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part", F.xxhash64("skey", "key")).mapInArrow(_stars, "a binary, b binary")
        else:
            block_of, order = ("key", "low", "high"), ("key", "low", "high", "side", "n", "skey")
            bare = _dealt(members, block).join(classes.select("skey", "bits", "tiles"), "skey").select(*block_of, "side", "band", *MEMBER[:-1])
            open_ = written(bare.repartition(parts, *block_of).sortWithinPartitions(*order).mapInArrow(_across_open, "key long, low long, high long, side int, band int, skey binary, n long, label binary"), "undecided")
            dealt = open_.join(member, "skey").select(*block_of, "side", "band", *MEMBER)
            dealt = dealt.repartition(parts, *block_of).sortWithinPartitions(*order).mapInArrow(_across, "a binary, b binary")
        more = written(dealt.distinct(), "links")
        if more.take(1):
            labels = written(connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").union(more), "a", "b"), "labels")
    forget(found)
    forget(sets)

    rooted = classes.select("skey", "id").join(labels.withColumnRenamed("node", "skey"), "skey", "left").withColumn("label", F.coalesce("label", "skey"))
    lowest = rooted.groupBy("label").agg(F.min("id").alias("component_id"))
    by_class = written(rooted.join(lowest, "label").select("skey", "component_id"), "components")
    out = sigs.select("id", "n", "skey").join(by_class, "skey").select("id", "n", "component_id")
    out = out.union(every.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and its component."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""
