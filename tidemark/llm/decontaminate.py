"""Benchmark decontamination by size-partitioned MinHash containment search.

The test items are partitioned by their number of shingles, (U/2, U] for powers of two U.
For a partition the documents are read as windows of 2U shingles that start every U, so an
occurrence of an item lies in one of them and the window is of the item's own size: a
passage inside a long document keeps a high Jaccard similarity with its window. Items and
windows have one-permutation MinHash signatures (bins by hash, the smallest hash of each
bin); an item whose minimum agrees with a window's in any bin is a candidate for the
document. The number of bins goes by the size. Items of up to 16 shingles have a bin for
each value, so none is missed; up to U = 256 there are 512 bins and beyond that 128. A shared
shingle is the smallest of its bin in the window with a probability of 0.93 at U = 32 and of
0.60 at U = 256, where 14 and 103 are shared; above that an item and its window have a
Jaccard similarity of 0.19 at least, so all 128 bins differ with probability 2e-12 at most.

A window's minimum can only agree with an item's where it holds that very shingle, so bins
are only looked at where a document's shingle is some item's minimum. Candidates are
verified by exact shingle containment over the whole document.

The items go to the executors in blocks of bounded size; each block is a pass over the
documents without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm._common import ship, table
from tidemark.llm.text import shingle_hashes, word_hashes, words

SHINGLE = 5


def bins_of(upper: int) -> int | None:
    """Bins of a signature for items of at most `upper` shingles; None: one for each value."""
    return None if upper <= 16 else 512 if upper <= 256 else 128


class Index:
    """Signatures of a block of items: ids and texts in equal order."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float):
        self.threshold = threshold
        hashes = [np.unique(shingle_hashes(w, SHINGLE)) for w in word_hashes([None if t is None else t.encode() for t in texts])]
        self.items: list[tuple] = []  # id, words, words a shingle, hashes, U
        minima: dict[int, list[tuple[np.ndarray, int]]] = {}  # by words a shingle: an item's bin minima
        for x, t, h in zip(ids, texts, hashes):
            if not len(h):
                continue
            w = words(t)
            k = min(SHINGLE, len(w))
            upper = 1 << max(0, math.ceil(math.log2(len(h))))
            least = h
            if n_bins := bins_of(upper):
                bins = h & np.uint64(n_bins - 1)
                order = np.lexsort((h, bins))
                least = h[order][np.concatenate([[True], bins[order][1:] != bins[order][:-1]])]
            minima.setdefault(k, []).append((least, len(self.items)))
            self.items.append((x, w, k, h, upper))
        self.by_k = {}
        for k, found in minima.items():
            keys = np.concatenate([m for m, _ in found])
            owner = np.concatenate([np.full(len(m), item, np.int32) for m, item in found])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_k[k] = (keys, seen, owner)

    def matches(self, w: np.ndarray, text: str) -> list[tuple]:
        """(item id, shared shingles, item's shingles) of the items contained in a document of words w."""
        out, spelled = [], None
        for k, (keys, seen, owner) in self.by_k.items():
            if len(w) < k:
                continue
            h = shingle_hashes(w, k)
            at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], side="right")
            candidates: set[int] = set()
            for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                v = h[i]
                for item in owner[a:b].tolist():
                    if item in candidates:
                        continue
                    upper = self.items[item][4]
                    if not (n_bins := bins_of(upper)):
                        candidates.add(item)
                        continue
                    bin_mask = np.uint64(n_bins - 1)
                    for start in {max(0, i // upper - 1) * upper, i // upper * upper}:
                        window = h[start : start + 2 * upper]
                        same = window[(window & bin_mask) == (v & bin_mask)]
                        if same.min() == v:
                            candidates.add(item)
                            break
            own = np.unique(h) if candidates else h
            for item in sorted(candidates):
                x, item_words, _, need, _ = self.items[item]
                if np.isin(need, own, assume_unique=True).sum() < self.threshold * len(need) - 1e-9:
                    continue
                spelled = spelled or words(text)
                exact = {tuple(item_words[i : i + k]) for i in range(len(item_words) - k + 1)}
                shared = len(exact & {tuple(spelled[i : i + k]) for i in range(len(spelled) - k + 1)})
                if shared >= self.threshold * len(exact) - 1e-9:
                    out.append((x, shared, len(exact)))
        return out


def _rows(index, batches: Iterator[pa.RecordBatch], text_at: int):
    held = index.value
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            b = whole.slice(start, 1000)
            texts = b.column(text_at).to_pylist()
            yield b, [held.matches(w, t) if len(w) else [] for w, t in zip(word_hashes([None if t is None else t.encode() for t in texts]), texts)]


def _indexes(items: DataFrame, threshold: float, block_items: int, block_bytes: int) -> Iterator:
    """Broadcast indexes over blocks of the items, each of bounded size."""
    spark = items.sparkSession
    items = items.select(F.col("item_id"), F.col("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil(size / block_bytes))
    for k in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect(), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        yield spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], threshold))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, block_items: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """A row for each document and item where at least `threshold` of the item's distinct
    5-word shingles are in the document: id, item_id, n_shared, n_item.

    An item of fewer than five words is one shingle of all of them, looked for as that run
    of words. Items and documents that are null or have no words match nothing. Documents
    of any length are searched whole; a share of exactly `threshold` counts. Repeated
    documents and items each have their rows, null ids too. Empty tables give no rows;
    other columns are ignored.
    """
    ship(docs.sparkSession)
    kind, item = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def run(index):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, found in _rows(index, batches, 1):
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                flat = [m for f in found for m in f]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([m[0] for m in flat], kind_of), pa.array([m[1] for m in flat], pa.int64()), pa.array([m[2] for m in flat], pa.int64())], names=["id", "item_id", "n_shared", "n_item"])

        return f

    kind_of = to_arrow_type(items.schema["item_id"].dataType)
    slim, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for index in _indexes(items, threshold, block_items, block_bytes):
        part = slim.mapInArrow(run(index), f"id {kind}, item_id {item}, n_shared long, n_item long")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.8, block_items: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, all columns, that contain no item by ``contaminated``'s rule: rows with
    null, empty or blank texts stay, every row of a repeated document goes or stays, a share
    of exactly `threshold` goes, and without items all stay. No shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(index):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, found in _rows(index, batches, at):
                yield b.filter(pa.array([not f for f in found], pa.bool_()))

        return f

    out = docs
    for index in _indexes(items, threshold, block_items, block_bytes):
        out = out.mapInArrow(run(index), docs.schema)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS g
      FROM (SELECT item_id, ws, least(len(ws), 5) AS k, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i : i + k - 1], ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(ws) >= k)),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT g.doc_id, q.item_id, count(*) AS n_shared, max(n.n) AS n_item
FROM q JOIN g ON g.g = q.g AND g.k = q.k JOIN n ON n.item_id = q.item_id
GROUP BY g.doc_id, q.item_id HAVING count(*) >= 0.8 * max(n.n)
"""
