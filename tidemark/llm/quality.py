"""Quality classifier: ordinal cumulative-link (proportional odds) regression.

P(grade <= k) = sigmoid(theta_k - w.x) with thresholds theta_0 < theta_1 < ... and one
weight vector w for all grades over hashed text features. The expected grade and the tail
probability P(grade >= select_grade) are what documents are selected by.

Features are hashed to 2**20 weights: the distinct words (letters only, lower-cased), the
distinct runs of marks, and binned shares of the text (capitals, marks, digits, distinct words and lines, length).
Trained by FTRL-proximal with an L1 term, which leaves words without a say at zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import ship, table
from tidemark.llm.text import hash_spans, mix

DIMS = 1 << 20
BINS = 16
#: byte classes: 0 letter (and all of UTF-8's upper half), 1 capital, 2 mark, 3 digit, 4 white space
_CLASS = np.array([1 if 65 <= b <= 90 else 0 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 4 if b in (32, *range(9, 14)) else 2 for b in range(256)], np.uint8)
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKS = bytes(32 if b <= 32 or 97 <= b <= 122 or 65 <= b <= 90 or 48 <= b <= 57 or b >= 127 else b for b in range(256))
_LINES = bytes(32 if b == 10 else 95 if b == 32 else b for b in range(256))


def _named(kind: int, bucket: int) -> int:
    return int(mix(np.array([(kind << 32) + bucket + 0x51_0000_0000_0000], np.uint64))[0] & np.uint64(DIMS - 1))


_SHARE = np.array([[_named(k, b) for b in range(BINS + 1)] for k in range(8)], np.int32)


def features(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text; a null text has those of an empty one."""
    out = []
    for t in texts:
        t = t or b""
        n = max(1, len(t))
        counts = np.bincount(_CLASS[np.frombuffer(t, np.uint8)], minlength=5)
        h = hash_spans(t.translate(_WORDS)) if t else np.empty(0, np.uint64)
        distinct = np.unique(h)
        marks = np.unique(hash_spans(t.translate(_MARKS))) if t else h
        lines = hash_spans(t.translate(_LINES)) if b"\n" in t else np.empty(0, np.uint64)
        shares = [
            counts[1] / max(1, counts[0] + counts[1]), min(1.0, 4 * counts[2] / n), min(1.0, 4 * counts[3] / n), len(distinct) / max(1, len(h)),
            len(np.unique(lines)) / max(1, len(lines)) if len(lines) else 1.0, min(1.0, np.log2(1 + len(h)) / 16), min(1.0, np.log2(1 + len(h) / (1 + len(lines))) / 12), min(1.0, 32 * t.count(b"|") / n),
        ]
        named = [_SHARE[k, int(round(s * BINS))] for k, s in enumerate(shares)]
        out.append(np.unique(np.concatenate([(distinct & np.uint64(DIMS - 1)).astype(np.int32), (mix(marks) & np.uint64(DIMS - 1)).astype(np.int32), np.array(named, np.int32)])))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """weights: DIMS numbers; thresholds: grades - 1, ascending."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 12, batch: int = 64, alpha: float = 1.0, l1: float = 7.0, l2: float = 0.05, seed: int = 1) -> CumulativeLink:
        """Maximum likelihood. The order of the rows is fixed by the seed."""
        z, norm = np.zeros(DIMS), np.zeros(DIMS)
        share = np.array([(np.sum(grades <= k) + 1) / (len(grades) + 2) for k in range(n_grades - 1)])
        first = np.log(share / (1 - share))
        gaps = np.log(np.maximum(np.diff(first), 0.3))  # theta_k = theta_0 + sum(exp(gaps))
        theta0, g_acc = first[0], np.ones(n_grades - 1)
        rng = np.random.default_rng(seed)

        def weights_of(idx: np.ndarray) -> np.ndarray:
            zi = z[idx]
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(norm[idx])) / alpha + l2))

        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                sizes = np.array([len(rows[i]) for i in pick])
                idx = np.concatenate([rows[i] for i in pick])
                who = np.repeat(np.arange(len(pick)), sizes)
                active, inverse = np.unique(idx, return_inverse=True)
                w = weights_of(active)
                score = np.bincount(who, w[inverse], minlength=len(pick))
                theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
                bounds = np.concatenate([[-np.inf], theta, [np.inf]])
                y = grades[pick]
                up, low = _sigmoid(bounds[y + 1] - score), _sigmoid(bounds[y] - score)
                up[y == n_grades - 1], low[y == 0] = 1.0, 0.0
                p = np.maximum(up - low, 1e-9)
                du, dl = up * (1 - up) / p, low * (1 - low) / p
                g_score = du - dl  # of the negative log likelihood by the score
                g = np.bincount(inverse, g_score[who], minlength=len(active))
                sigma = (np.sqrt(norm[active] + g * g) - np.sqrt(norm[active])) / alpha
                z[active] += g - sigma * w
                norm[active] += g * g
                g_theta = np.zeros(n_grades - 1)
                np.add.at(g_theta, y[y < n_grades - 1], -du[y < n_grades - 1])
                np.add.at(g_theta, y[y > 0] - 1, dl[y > 0])
                g_all = np.concatenate([[g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(gaps)])
                g_acc += g_all * g_all
                step = 0.1 * g_all / np.sqrt(g_acc)
                theta0, gaps = theta0 - step[0], np.clip(gaps - step[1:], -4, 4)
        return cls(weights_of(np.arange(DIMS)).astype(np.float32), theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """[row, k]: P(grade >= k + 1)."""
        score = np.array([float(self.weights[r].sum(dtype=np.float64)) for r in rows])
        return 1 - _sigmoid(self.thresholds[None, :] - score[:, None])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = features(b.column(2).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], names=["id", "grade", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3, max_rows: int = 8000) -> CumulativeLink | None:
    """labels: id, grade (0 to n_grades - 1). Fits on at most max_rows labelled documents,
    those with the smallest hash of their id; None where there are none. Null ids and grades
    teach nothing."""
    ship(docs.sparkSession)
    picked = labels.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade")).orderBy(F.xxhash64("id"), "grade").limit(max_rows)
    kind = docs.schema[id_col].dataType.simpleString()
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "grade", "text")  # max_rows at most
    rows = few.mapInArrow(_featurize, f"id {kind}, grade int, features array<int>").collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["grade"], r["features"]))
    if not rows:
        return None
    return CumulativeLink.fit([np.array(r["features"], np.int32) for r in rows], np.array([r["grade"] for r in rows]), n_grades)


def _judge(held, text_at: int, select_grade: int, threshold: float, keep_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                if model is None:
                    tails = np.full((b.num_rows, select_grade), np.nan)
                    keep = np.ones(b.num_rows, bool)
                else:
                    tails = model.tails(features(b.column(text_at).cast(pa.binary()).to_pylist()))
                    keep = tails[:, select_grade - 1] >= threshold
                if keep_rows:
                    yield b.filter(pa.array(keep))
                else:
                    none = np.isnan(tails[:, 0])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1), mask=none), pa.array(tails[:, select_grade - 1], mask=none), pa.array(keep)], names=["id", "expected_grade", "tail_probability", "keep"])

    return run


def score(docs: DataFrame, model: CumulativeLink | None, id_col: str = "doc_id", text_col: str = "text", select_grade: int = 2, threshold: float = 0.5) -> DataFrame:
    """id, expected_grade, tail_probability (of select_grade or better), keep for each row.

    A null text is scored as an empty one. Without a model (no labels) the scores are null
    and all is kept. Repeated rows are kept; an empty table gives no rows; other columns
    are ignored.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_judge(held, 1, select_grade, threshold, False), f"id {kind}, expected_grade double, tail_probability double, keep boolean")
    return out.withColumnRenamed("id", id_col)


def select(docs: DataFrame, model: CumulativeLink | None, text_col: str = "text", select_grade: int = 2, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that ``score`` keeps. No shuffle."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_judge(held, docs.columns.index(text_col), select_grade, threshold, True), docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 well written but toxic, 2 well written and clean."""
    good, toxic = F.col("quality") >= 1, F.coalesce(F.col("toxic"), F.lit(0)) >= 1
    return labels.select("doc_id", F.when(~good, 0).when(good & toxic, 1).when(good, 2).alias("grade"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the graded labels."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, graded(table(spark, sf_dir, "labels"))))
