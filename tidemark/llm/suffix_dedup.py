"""Repeated byte strings by suffix sorting with difference covers.

Two occurrences of a string of 200 bytes hold the same anchor at the same place: the
smallest hash among their 64-byte windows. So strings are sorted where they can meet:

1. Equal texts become one text with a count. Every start of a 200-byte string is dealt to
   its anchor; the starts of an anchor are cut into ranges of at most 69, and a range is
   keyed by the hash of its core, the bytes that all its strings share. Keys that occur
   once can hold no repeat and are dropped (counted over all texts; hashes only travel).
2. The bytes of the remaining ranges, equal ones once, are brought together by key. Where
   very many different ranges have one key (a passage in very many documents), they are cut
   into narrower bands of 8 starts and of 1, which have longer cores and so other keys.
3. Each partition of keys is a string, and its suffix array is built by the difference
   cover algorithm with period 3: the triples at positions 1 and 2 modulo 3 are sorted and
   named, the string of names is sorted by recursion, the suffixes at 0 modulo 3 are sorted
   by their first symbol and the following rank and merged in. Symbols are 8 bytes, in eight
   interleaved strings, and recursion ends where names stand for 200 bytes and more.
   Adjacent suffixes with a common prefix of 200 bytes are repeats.
4. The repeats' starts go back to their texts, whose covered bytes are removed.

A partition is sorted in chunks of about ``chunk_bytes``; a chunk holds whole keys.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import forget, release, ship, shuffle_partitions, table, written
from tidemark.llm.text import _BASE, _INVERSE, _power, mix

LENGTH = 200
GRAM = 64
RANGE = 69
CHUNK = 400_000
#: different ranges of one key above which they are cut into narrower bands
MANY = 256


# ---- the difference cover algorithm

def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks (from 1) of keys among the distinct ones, and how many there are."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.empty(len(k), np.int64)
    new[:1] = 1
    new[1:] = k[1:] != k[:-1]
    ranks = np.empty(len(k), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks, int(new.sum())


def ranks_of_suffixes(s: np.ndarray, alphabet: int, depth: int) -> np.ndarray:
    """Rank of each suffix of s (symbols 1 to alphabet, at most 2**20) by its first 3**depth
    symbols at least; equal where those are equal."""
    n = len(s)
    if depth == 0 or n < 3:
        return _named(s)[0] if depth == 0 else _plain_ranks(s)
    t = np.concatenate([s, np.zeros(5, np.int64)])
    bits = int(alphabet).bit_length()
    at1, at2 = np.arange(1, n + 1, 3), np.arange(2, n + 2, 3)  # one position past the end keeps the halves apart
    sample = np.concatenate([at1[at1 <= n], at2[at2 <= n]])
    triples = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
    names, count = _named(triples)
    if count < len(sample):
        names = ranks_of_suffixes(names, count, depth - 1) if depth > 1 else names
    rank = np.zeros(n + 4, np.int64)  # of sampled suffixes; 0 past the end
    rank[sample] = names
    # the suffixes at 0 modulo 3 by first symbol and following rank
    at0 = np.arange(0, n, 3)
    width = int(names.max()).bit_length()
    key0 = (t[at0] << width) | rank[at0 + 1]
    # a place for each class: two sorted lists merged by comparable keys
    first = sample < n
    s1, s2 = sample[(sample % 3 == 1) & first], sample[(sample % 3 == 2) & first]
    k1, k0 = (t[s1] << width) | rank[s1 + 1], key0
    k2, k0b = (t[s2] << (bits + width)) | (t[s2 + 1] << width) | rank[s2 + 2], (t[at0] << (bits + width)) | (t[at0 + 1] << width) | rank[at0 + 2]
    o1, o2 = np.sort(k1), np.sort(k2)
    out = np.empty(n, np.int64)
    sampled = np.sort(names[first])
    order0 = np.sort(k0)
    # rank = number of suffixes that are smaller, which is equal for equal ones
    out[at0] = np.searchsorted(order0, k0) + np.searchsorted(o1, k0) + np.searchsorted(o2, k0b)
    out[s1] = np.searchsorted(sampled, rank[s1]) + np.searchsorted(order0, k1)
    out[s2] = np.searchsorted(sampled, rank[s2]) + np.searchsorted(np.sort(k0b), k2)
    return out + 1


def _plain_ranks(s: np.ndarray) -> np.ndarray:
    suffixes = [tuple(s[i:].tolist()) for i in range(len(s))]
    order = {x: r + 1 for r, x in enumerate(sorted(set(suffixes)))}
    return np.array([order[x] for x in suffixes], np.int64)


def _symbols(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a big-endian number; the end counts as zeros."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    symbol = np.zeros(n, np.uint64)
    for k in range(8):
        symbol = (symbol << np.uint64(8)) | padded[k : k + n]
    return symbol


def suffix_ranks(symbol: np.ndarray, reach: int = LENGTH) -> np.ndarray:
    """Ranks of all suffixes of a byte string, given by its symbols, by their first `reach`
    bytes at least."""
    n = len(symbol)
    # eight interleaved strings of 8-byte symbols, one after the other, each ended by zeros
    lanes = [np.arange(r, n, 8) for r in range(8)]
    names, count = _named(symbol)
    gap = -(-reach // 8)
    parts, places, at = [], [], 0
    for lane in lanes:
        parts += [names[lane], np.zeros(gap, np.int64)]
        places.append(at + np.arange(len(lane)))
        at += len(lane) + gap
    s = np.concatenate(parts) + 1  # zeros become the smallest symbol
    depth = max(1, math.ceil(math.log(max(2, -(-reach // 8)), 3)))
    r = ranks_of_suffixes(s, count + 1, depth)
    out = np.empty(n, np.int64)
    for lane, place in zip(lanes, places):
        out[lane] = r[place]
    return out


def repeated(strings: list[bytes], counts: list[int], reach: int = LENGTH) -> list[np.ndarray]:
    """For each string, which starts hold `reach` bytes that also start elsewhere among the
    strings (a string with a count of two or more repeats all of its own)."""
    lengths = np.array([len(x) for x in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    room = np.repeat(ends, lengths) - np.arange(len(data))
    symbol = _symbols(data)
    ranks = suffix_ranks(symbol, reach)
    owner = np.repeat(np.arange(len(strings)), lengths)
    at = np.flatnonzero(room >= reach)  # only these hold a whole string; others only help to sort
    order = at[np.argsort(ranks[at], kind="stable")]
    same = np.zeros(len(order), bool)  # with the one before: adjacent prefixes are compared by 8 bytes at a time
    k = np.arange(1, len(order))
    for place in (0, (reach - 8) // 2, *range(8, reach - 7, 8), reach - 8):
        k = k[symbol[order[k] + place] == symbol[order[k - 1] + place]]
    same[k] = True
    dup = same.copy()
    dup[:-1] |= same[1:]
    hit = np.zeros(len(data), bool)
    hit[order[dup]] = True
    hit |= (np.array(counts)[owner] > 1) & (room >= reach)
    return [hit[a:b] for a, b in zip(starts, ends)]


# ---- anchors

def _prefix_sums(buf: np.ndarray) -> np.ndarray:
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_INVERSE, len(buf)), out=sums[1:])
    return sums


def _range_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((sums[hi] - sums[lo]) * _power(_BASE, len(sums))[lo] + (hi - lo).astype(np.uint64))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def ranges(text: bytes, step: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the ranges of a text of at least LENGTH bytes; a place packs the first
    start, its offset in the whole band, and the number of starts (``unpacked``).

    Starts with the same anchor are told apart by their distance from it, in bands of
    `step`; all starts of a band share the bytes the key is the hash of, wherever the band is
    cut short by a neighbouring anchor.
    """
    buf = np.frombuffer(text, np.uint8)
    sums = _prefix_sums(buf)
    n, w = len(buf), LENGTH - GRAM + 1
    at = np.arange(n - GRAM + 1)
    h = _range_hash(sums, at, at + GRAM)
    # low bits: the place, so that of equal hashes the leftmost is the smallest
    mask = np.uint64((1 << int(n).bit_length()) - 1)
    place = (_window_min((h & ~mask) | at.astype(np.uint64), w) & mask).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    ends, p = np.concatenate([cut[1:], [len(place)]]), place[cut]
    keys, places = [], []
    for k in range(0, w, step):
        last = min(k + step, w) - 1
        a, b = np.maximum(cut, p - last), np.minimum(ends, p - k + 1)
        ok = a < b
        q = p[ok]
        core = _range_hash(sums, np.maximum(q - k, 0), np.minimum(q - last + LENGTH, n))
        keys.append(mix(core + mix(h[q] + np.uint64(k))))
        places.append((a[ok] << 16) | ((a[ok] - (q - last)) << 8) | (b - a)[ok])
    return np.concatenate(keys).view(np.int64), np.concatenate(places)


def unpacked(place: int) -> tuple[int, int, int]:
    return place >> 16, (place >> 8) & 255, place & 255


# ---- Spark

def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            key, place = ranges(text)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), uid, np.int64)), pa.array(place)], names=["key", "uid", "place"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uid, text, keys, places in zip(*(b.column(i) for i in range(4))):
            uid, text, keys, places = uid.as_py(), text.as_py(), keys.values.to_numpy(), places.values.to_numpy()
            bits = [text[lo : lo + size + LENGTH - 1] for lo, _, size in map(unpacked, places.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in bits], pa.binary()), pa.array(keys), pa.array(np.full(len(bits), uid, np.int64)), pa.array(places), pa.array(bits, pa.binary())],
                names=["h", "key", "uid", "place", "bytes"],
            )


def _pieces(width: int):
    """Rows (h, key, bytes, place) of ranges with the narrower bands they consist of: (parent,
    lo, h, key, bytes, place); place's offset is the piece's in its own band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = []
                for h, key, data, place in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns)):
                    _, off, size = unpacked(place)
                    for band in range(off // width, (off + size - 1) // width + 1):
                        a, b = max(off, band * width), min(off + size, (band + 1) * width)
                        core = data[(band + 1) * width - 1 - off : band * width - off + LENGTH]
                        part = data[a - off : b - off + LENGTH - 1]
                        new = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=key.to_bytes(8, "little", signed=True), person=bytes([width, band])).digest(), "little", signed=True)
                        own = hashlib.blake2b(part, digest_size=16, salt=new.to_bytes(8, "little", signed=True)).digest()
                        out.append((h, a - off, own, new, part, ((a - band * width) << 8) | (b - a)))
                parent, lo, own, new, part, place = zip(*out) if out else ((),) * 6
                yield pa.RecordBatch.from_arrays([pa.array(parent, pa.binary()), pa.array(lo, pa.int32()), pa.array(own, pa.binary()), pa.array(new, pa.int64()), pa.array(part, pa.binary()), pa.array(place, pa.int64())], names=["parent", "lo", "h", "key", "bytes", "place"])

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (parent, [(lo, mask)]): the parents' masks."""
    for batch in batches:
        out = []
        for parent, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mask = np.zeros(256, np.uint8)
            for f in found:
                bits = np.unpackbits(np.frombuffer(f["mask"], np.uint8))
                mask[f["lo"] : f["lo"] + len(bits)] |= bits[: 256 - f["lo"]]
            out.append((parent, np.packbits(mask[: int(np.flatnonzero(mask)[-1]) + 1]).tobytes()))
        parent, mask = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(parent, pa.binary()), pa.array(mask, pa.binary())], names=["h", "mask"])


def _sort(chunk: int):
    def flush(held: list[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        """held: keys with their (h, bytes, count) rows; equal bytes are one string here."""
        rows = [r for _, group in held for r in group]
        masks = [hit[: len(r[1]) - LENGTH + 1] for r, hit in zip(rows, repeated([r[1] for r in rows], [r[2] for r in rows]))]
        keep = [i for i in range(len(rows)) if masks[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in keep], pa.binary()), pa.array([np.packbits(masks[i]).tobytes() for i in keep], pa.binary())], names=["h", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, key = [], 0, 0, None  # whole keys and their bytes; last: bytes of the newest
        for b in batches:
            for k, h, data, count in zip(*(b.column(i).to_pylist() for i in range(4))):
                if k != key:
                    if held and len(held[-1][1]) == 1 and held[-1][1][0][2] == 1:  # alone in its key: no repeat
                        held.pop()
                    elif held and size and size + last > chunk:  # the newest doesn't fit with the others
                        yield from flush(held[:-1])
                        held, size = held[-1:], last
                    else:
                        size += last
                    held.append((k, []))
                    key, last = k, 0
                held[-1][1].append((h, data, count))
                last += len(data)
        if len(held) > 1 and size + last > chunk:
            yield from flush(held[:-1])
            held = held[-1:]
        if held:
            yield from flush(held)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sha, text, [(place, mask)]): what is left of a text."""
    width = RANGE // 8 + 1  # bytes of the longest mask
    for b in batches:
        out, lists = [], b.column(2)
        firsts, flat = lists.offsets.to_numpy(), lists.values
        lows = flat.field("place").to_numpy() >> 16
        masks = b"".join(m.ljust(width, b"\0") for m in flat.field("mask").to_pylist())
        bits = np.frombuffer(masks, np.uint8).reshape(-1, width)
        for i, (sha, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            row, start = np.nonzero(np.unpackbits(bits[firsts[i] : firsts[i + 1]], axis=1))
            begun = np.zeros(len(text), np.int32)
            begun[lows[firsts[i] : firsts[i + 1]][row] + start] = 1
            total = np.cumsum(begun)
            total[LENGTH:] -= total[:-LENGTH].copy()  # starts among the last LENGTH places
            gone = total > 0
            spans = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((sha, int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans.reshape(-1).tolist()))
        sha, removed, n_spans, kept, spans = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["sha", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, many: int = MANY) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends of the maximal
    removed runs, in bytes) for each row.

    A byte is removed where a string of 200 bytes covers it that also starts anywhere else,
    in another row or the same. A null text counts as empty and texts of under 200 bytes
    lose nothing; repeated rows are copies of each other, and where all copies repeat none
    is kept. Null ids are kept. An empty table gives no rows; other columns are ignored,
    whatever their names. A text of n bytes is handled in one task's memory, where its
    ranges take about 100 n bytes: texts of some 30 MB need larger executors.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = shuffle_partitions(spark)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("id"), data.alias("text")).select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    texts = written(slim.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.first("text").alias("text"), F.count("*").alias("n")).select("sha", "text", "n", F.monotonically_increasing_id().alias("uid")), "texts")
    keys = written(texts.select("uid", "text").mapInArrow(_range_rows, "key long, uid long, place long"), "ranges")
    release(spark)
    twice = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    # keys of more than 1/5,000 of the ranges are 5,000 at most: their rows stay where they are
    hot = F.broadcast(twice.where(F.col("n") > max(10_000, keys.count() // 5000)).select("key"))
    again = keys.join(hot, "key").union(keys.join(hot, "key", "left_anti").join(twice.select("key"), "key"))
    found = again.groupBy("uid").agg(F.collect_list(F.struct("key", "place")).alias("f"))
    found = found.join(texts.select("uid", "text"), "uid").select("uid", "text", F.col("f.key").alias("keys"), F.col("f.place").alias("places"))
    contexts = written(found.mapInArrow(_contexts, "h binary, key long, uid long, place long, bytes binary"), "contexts")
    forget(keys)
    del keys, twice, hot, again, found
    release(spark)
    level, sorted_, below = contexts.select("h", "key", "bytes", "place"), None, []
    for width in (8, 1, None):
        release(spark)
        distinct = written(level.groupBy("h").agg(F.first("key").alias("key"), F.first("bytes").alias("bytes"), F.first("place").alias("place"), F.count("*").alias("n")), "distinct")
        hot = written(distinct.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > (many if width else 1 << 62)).select("key"), "hot")
        few = distinct.join(hot, "key", "left_anti")
        part = few.select("key", "h", "bytes", "n").repartition(max(parts, 32), "key").sortWithinPartitions("key").mapInArrow(_sort(chunk_bytes), "h binary, mask binary")
        sorted_ = part if sorted_ is None else sorted_.union(part)
        if not width or not hot.take(1):
            break
        # a string that is there more than once repeats all of itself, whatever it is cut into
        crowd = distinct.join(hot, "key", "left_semi")
        pieces = written(crowd.where("n = 1").select("h", "key", "bytes", "place").mapInArrow(_pieces(width), "parent binary, lo int, h binary, key long, bytes binary, place long").unionByName(crowd.where("n > 1").select("h", "key", "bytes", "place").mapInArrow(_pieces(width), "parent binary, lo int, h binary, key long, bytes binary, place long").withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("twice")), "pieces")
        below.append(pieces)
        level = pieces.select("h", "key", "bytes", "place")
    masks = written(sorted_, "masks")
    release(spark)
    for pieces in reversed(below):
        up = pieces.select("parent", "lo", "h").join(masks, "h").groupBy("parent").agg(F.collect_list(F.struct("lo", "mask")).alias("f")).mapInArrow(_combined, "h binary, mask binary")
        masks = written(masks.union(up), "masks")
    hits = contexts.select("h", "uid", "place").join(masks, "h").groupBy("uid").agg(F.collect_list(F.struct("place", "mask")).alias("f"))
    whole = texts.where("n > 1").select("sha", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.array(F.lit(0).cast("long"), F.octet_length("text").cast("long")).alias("spans"))
    partly = texts.where("n = 1").select("sha", "uid", "text").join(hits, "uid").select("sha", "text", "f").mapInArrow(_removed, "sha binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    by_text = written(whole.union(partly), "removed")
    forget(contexts)
    none = F.array().cast("array<long>")
    long = slim.where(F.col("n_bytes") >= LENGTH).select("id", "n_bytes", "sha")
    out = long.join(by_text, "sha", "left").select("id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), F.coalesce("spans", none).alias("spans"))
    short = slim.where(F.col("n_bytes") < LENGTH).select("id", "n_bytes", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lower(F.hex("sha")), none)
    return out.union(short).withColumnRenamed("id", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated byte strings."""
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
