"""Secret scan: candidate strings judged by a random forest.

Candidates are the values behind a secret's name and = or :, of any length and of any
characters but blanks and quotes, and elsewhere runs of 16 or more characters of
``[A-Za-z0-9+/_=.-]`` that hold a digit or mixed case, without a ``NAME=`` before them;
found in whole texts. A forest trained from labelled findings removes the
false positives (words, digests, ids, paths, placeholders) by the candidate's length and
character transitions, its dictionary coverage, the document's path and the neighbouring
words. The dictionary is the table of letter trigrams counted over all documents. What the
parts of a path and the words beside a candidate say is learned from the findings: each has
the log odds of the findings it stands at.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import ship, table

LEAST, MOST = 16, 512
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.\-]{%d,}" % LEAST)
REDACTED = "[SECRET]"
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "access")
#: a secret's name, = or :, and the value, which ends at its quote or at a blank
NAMED = re.compile(r"""(?i)(?:%s)[a-z0-9_.\-]{0,40}["'`]?[ \t]{0,8}(?::=|=>|[=:])[ \t]{0,8}(?:(?:bearer|basic)[ \t]+)?(?:"([^"\s]+)"|'([^'\s]+)'|`([^`\s]+)`|["'`]?([^\s"'`<>,;]+))""" % "|".join(SECRET_WORDS))
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*=(?=[^=])")
#: characters of context on each side
AROUND = 48
FEATURES = 22


# ---- the dictionary: letter trigrams of all documents

_LETTER = np.zeros(256, np.int32)
for _c in range(26):
    _LETTER[65 + _c] = _LETTER[97 + _c] = _c + 1
TRIGRAMS = 1 << 15


def trigram_counts(text: bytes) -> np.ndarray:
    """Of a-z, lower-cased; other bytes break a trigram."""
    x = _LETTER[np.frombuffer(text, np.uint8)]
    if len(x) < 3:
        return np.zeros(TRIGRAMS, np.int64)
    code = (x[:-2] << 10) + (x[1:-1] << 5) + x[2:]
    return np.bincount(code[(x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0)], minlength=TRIGRAMS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TRIGRAMS, np.int64)
    for b in batches:
        texts = [t for t in b.column(0).cast(pa.binary()).to_pylist() if t]
        for i in range(0, len(texts), 200):
            total += trigram_counts(b" ".join(texts[i : i + 200]))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["trigram", "n"])


def dictionary(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log share of each trigram among those of all documents, smoothed; 2**15 numbers."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()  # 2**15 at most
    n = np.full(TRIGRAMS, 0.5)
    for r in rows:
        n[r["trigram"]] += r["n"]
    return np.log(n / n.sum()).astype(np.float32)


# ---- features

def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


PART = re.compile(r"[^\W_]+")
#: log odds are kept for this many hashed words
BUCKETS = 1 << 14
FOLDS = 5


def neighbours(before: str, after: str, path: str) -> list[list[int]]:
    """Buckets of the words to the left (the nearest three, in their parts), to the right (two)
    and of the path's parts."""
    left = [p for w in before.lower().split()[-4:] for p in PART.findall(w)][-3:]
    right = PART.findall(after.lower())[:2]
    return [[zlib.crc32(f"{side} {w}".encode()) % BUCKETS for w in dict.fromkeys(words)] for side, words in (("left", left), ("right", right), ("path", PART.findall(path.lower())))]


class Context:
    """Findings of each label by bucket."""

    def __init__(self, findings: list):
        self.counts = np.zeros((2, BUCKETS))
        for _, before, after, path, label in findings:
            for side in neighbours(before, after, path):
                self.counts[label, side] += 1
        total = self.counts.sum(axis=1)
        self.prior = math.log((total[1] + 1) / (total[0] + 1))

    def odds(self, before: str, after: str, path: str) -> list[float]:
        """For each side the sum of the words' log odds, and the largest for the left one."""
        sums, most = [], 0.0
        for k, side in enumerate(neighbours(before, after, path)):
            yes, no = self.counts[1, side], self.counts[0, side]
            logs = np.log((yes + 0.5) / (no + 0.5)) - self.prior * ((yes + no) > 0)
            sums.append(float(logs.sum()))
            if k == 0 and len(logs):
                most = float(logs.max())
        return [*sums, most]


def describe(value: str, before: str, after: str, path: str, trigrams: np.ndarray, context: Context) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    raw = np.frombuffer(value.encode(), np.uint8)
    counts = np.bincount(raw)
    p = counts[counts > 0] / len(raw)
    x = _LETTER[raw]
    whole = (x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0)
    logs = trigrams[(x[:-2] << 10) + (x[1:-1] << 5) + x[2:]][whole]
    odds = context.odds(before, after, path)
    tail = before.rstrip(" \"'`")[-1:]
    return [
        min(n, 128), *share[:3], sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), float(-(p * np.log2(p)).sum()), len(set(value)) / n,
        float((logs > math.log(1 / TRIGRAMS)).sum()) / max(1, n - 2), float(logs.mean()) if len(logs) else -20.0,  # dictionary coverage
        max(len(w) for w in re.findall(r"[A-Za-z]*", value)) / n, float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), value.count("-") / n, (value.count("/") + value.count(".")) / n,
        float(tail in ("=", ":")), float(before[-1:] in "\"'`" and before != ""), float(after[:1] in "\"'`" and after != ""), float(value[:1] in "$%{<" and len(set(value)) < n), float(len(set(value.lower())) <= 4), *odds,
    ]


def _pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Pieces of MOST characters; what is left and under LEAST belongs to the last one."""
    while end - start >= MOST + LEAST:
        yield start, start + MOST
        start += MOST
    yield start, end


def _runs(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text, low, high):
        start = m.start()
        if (name := NAME.match(text, start, m.end())) and m.end() - name.end() >= LEAST:
            start = name.end()
        for a, z in _pieces(start, m.end()):
            v = text[a:z]
            if any(c.isdigit() for c in v) or (v != v.lower() and v != v.upper() and v[1:] != v[1:].lower()):
                yield a, z


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans, in order and apart from each other; one of very many characters is cut."""
    last = 0
    for m in NAMED.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 4:
            end = start + len(text[start:end].rstrip(".:)]}"))
        if end > start:
            name = m.start()
            while name > last and (text[name - 1].isalnum() or text[name - 1] in "_.-"):
                name -= 1
            yield from _runs(text, last, name)
            yield from _pieces(start, end)
            last = end
    yield from _runs(text, last, len(text))


# ---- labelled findings

def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label): n findings as a reviewer would label them and
    n // 3 more of short or mixed values, half of each secrets, from a fixed generator of formats (there is no table of findings)."""
    rng = random.Random(seed)
    pick, alnum = rng.choice, string.ascii_letters + string.digits
    run = lambda chars, k: "".join(pick(chars) for _ in range(k))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ment", "tion", "ich", "que", "ung", "ado"]
    word = lambda k: "".join(pick(syllables) for _ in range(k))
    filler = lambda: " ".join(word(rng.randint(1, 3)) for _ in range(3))
    out = []
    for _ in range(n // 2):
        value = pick([lambda: run("0123456789abcdef", pick([32, 40, 48, 64])), lambda: run(alnum, rng.randint(20, 64)), lambda: pick(["AKIA", "ASIA"]) + run(string.ascii_uppercase + string.digits, 16), lambda: pick(["ghp_", "sk-", "xoxb-", "glpat-"]) + run(alnum, 36), lambda: base64.b64encode(bytes(rng.randrange(256) for _ in range(pick([20, 32, 48])))).decode()])()
        name = pick(["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key", "Bearer"])
        before, after = pick([(f'{filler()} {name} = "', '" ' + filler()), (f"{filler()} {name}: ", " " + filler()), (f"{filler()} {name}='", "' " + filler()), (f"{name.upper()}=", "\n" + filler()), (f'"{name}": "', '",')])
        out.append((value, before, after, pick(["src0", "src7", "app/config", "deploy/env", "crawl"]), 1))
    for _ in range(n - n // 2):
        kind = rng.randrange(9)
        value = before = after = ""
        if kind <= 2:  # ordinary words and identifiers
            value = word(rng.randint(8, 12)) if kind == 0 else pick("-_./").join(word(rng.randint(2, 4)) for _ in range(rng.randint(2, 5))) if kind == 1 else word(8).title() + word(4).title() + str(rng.randint(0, 99))
            before, after = filler() + " ", " " + filler()
        elif kind == 3:  # digests and revisions
            value = run("0123456789abcdef", pick([32, 40, 64]))
            before, after = f"{filler()} {pick(['sha256', 'md5', 'commit', 'checksum', 'digest', 'etag', 'rev'])}{pick([': ', '=', ' '])}", " " + filler()
        elif kind == 4:  # uuids
            value = "-".join(run("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
            before, after = f"{filler()} {pick(['id', 'uuid', 'guid'])}{pick([': ', '=', ' '])}", " " + filler()
        elif kind == 5:  # numbers, dates, cards, phones
            value = pick([run(string.digits, 16), run(string.digits, 19), f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}_{run(string.digits, 6)}", ".".join(run(string.digits, 4) for _ in range(4))])
            before, after = filler() + " ", " " + filler()
        elif kind == 6:  # paths and hosts
            value = pick(["/usr/share/", "www.", "/static/img/", "mail7."]) + "/".join(word(2) for _ in range(3)) + pick([".html", ".com", ".png", "/index.php"])
            before, after = f"{filler()} {pick(['src=', 'href=', 'file ', 'http', ''])}", " " + filler()
        elif kind == 7:  # placeholders behind a secret's name
            value = pick(["x" * 20, "your_token_goes_here1", "0" * 32, "changeme-changeme-1", "REPLACE_WITH_API_KEY1", "1234567890123456"])
            before, after = f'{pick(["token", "secret", "api_key", "password"])} = "', '"'
        else:  # markup and rules
            value = pick(["=" * 20 + "1", "-" * 30 + "2", "a" * 18 + "1", "_".join(["A", "b"] * 10)])
            before, after = filler() + " ", " " + filler()
        out.append((value, before, after, pick(["src0", "src7", "docs/guide", "tests/data", "crawl"]), 0))
    out = [x for x in out if len(x[0]) >= LEAST]
    short = []
    symbols = "!@#$%&*?+-_.:"
    for _ in range(n // 6):  # short or mixed values behind a secret's name, and what else stands there
        name = pick(["token", "secret", "password", "passwd", "pwd", "api_key", "auth_token", "DB_PASSWORD", "client_secret"])
        before, after = pick([(f'{filler()} {name} = "', '" ' + filler()), (f"{filler()} {name}: ", " " + filler()), (f"{filler()} {name}='", "' " + filler()), (f"{name.upper()}=", "\n" + filler()), (f'"{name}": "', '",')])
        strong = pick([lambda: word(rng.randint(2, 3)).title() + run(string.digits, rng.randint(2, 4)) + run(symbols, rng.randint(1, 2)) + run(alnum, rng.randint(0, 2)), lambda: run(alnum + symbols + string.digits, rng.randint(8, 24)), lambda: run(alnum + string.digits, rng.randint(8, 15)), lambda: run("0123456789abcdef", rng.randint(8, 15))])()
        weak = pick([lambda: word(rng.randint(1, 5)), lambda: word(rng.randint(1, 3)).title(), lambda: run(string.digits, rng.randint(1, 4)), lambda: pick(["true", "false", "null", "none", "None", "required", "string", "changeme", "********", "xxxxxxxx", "...", "-", "{", "[", "1", "your-password", "your_token", "${TOKEN}", "$PASSWORD", "%(password)s", "{{secret}}"]), lambda: word(2) + pick(["()", "(" + word(1), "." + word(2), "_" + word(2)])])()
        short.append((strong, before, after, pick(["src0", "src7", "app/config", "deploy/env", "crawl"]), 1))
        short.append((weak, before, after, pick(["src0", "src7", "docs/guide", "tests/data", "crawl"]), 0))
    return out + sorted(short, key=lambda x: -x[4])


# ---- the forest

@dataclass
class Forest:
    """Trees in flat arrays: feature (-1 at a leaf), threshold, left child (right is the next), share."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    share: np.ndarray
    roots: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        feature, threshold, left, share, roots = [], [], [], [], []

        def node() -> int:
            feature.append(-1), threshold.append(0.0), left.append(0), share.append(0.0)
            return len(feature) - 1

        tries = max(1, int(math.sqrt(x.shape[1])))
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            roots.append(node())
            todo = [(roots[-1], rows, 0)]
            while todo:
                at, rows, d = todo.pop()
                own = y[rows]
                share[at] = float(own.mean())
                if d == depth or len(rows) < 2 * least or share[at] in (0.0, 1.0):
                    continue
                best = (0.0, -1, 0.0)
                total, n = own.sum(), len(own)
                for f in rng.choice(x.shape[1], tries, replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, ones = x[rows, f][order], np.cumsum(own[order])[:-1]
                    k = np.arange(1, n)
                    ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
                    if not ok.any():
                        continue
                    gini = ones * (k - ones) / k + (total - ones) * (n - k - total + ones) / (n - k)
                    gain = np.where(ok, total * (n - total) / n - gini, -1)
                    j = int(gain.argmax())
                    if gain[j] > best[0] + 1e-12:
                        best = (float(gain[j]), int(f), float((v[j] + v[j + 1]) / 2))
                if best[1] < 0:
                    continue
                feature[at], threshold[at] = best[1], best[2]
                left[at] = node()
                node()
                side = x[rows, best[1]] <= best[2]
                todo += [(left[at], rows[side], d + 1), (left[at] + 1, rows[~side], d + 1)]
        return cls(np.array(feature), np.array(threshold), np.array(left), np.array(share), roots)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of secrets over the trees."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = self.left[at] + (x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[at])
                at = np.where(inner, go, at)
            total += self.share[at]
        return total / len(self.roots)


@dataclass
class Scanner:
    trigrams: np.ndarray
    context: Context
    forest: Forest
    threshold: float

    def scan(self, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """(start, end, score) of all candidates of each text, in order."""
        spans = [list(candidates(t)) if t else [] for t in texts]
        rows = [describe(t[a:b], t[max(0, a - AROUND) : a], t[b : b + AROUND], p or "", self.trigrams, self.context) for t, p, found in zip(texts, paths, spans) for a, b in found]
        scores = iter(self.forest.predict(np.array(rows)).tolist() if rows else [])
        return [[(a, b, next(scores)) for a, b in found] for found in spans]


def train(docs: DataFrame, text_col: str = "text", findings: list | None = None, threshold: float = 0.5) -> Scanner:
    """findings: (value, before, after, path, label) rows; the fixed ones where none are given."""
    return learned(dictionary(docs, text_col), findings or labelled_findings(), threshold)


def learned(trigrams: np.ndarray, findings: list, threshold: float = 0.5, trees: int = 40) -> Scanner:
    """A finding is described by the log odds of the other folds' findings, so that its own label
    has no say in them; the scanner keeps those of all."""
    apart = [Context([f for i, f in enumerate(findings) if i % FOLDS != k]) for k in range(FOLDS)]
    x = np.array([describe(v, b, a, p, trigrams, apart[i % FOLDS]) for i, (v, b, a, p, _) in enumerate(findings)])
    return Scanner(trigrams, Context(findings), Forest.fit(x, np.array([f[4] for f in findings]), trees), threshold)


def _find(held, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                texts = b.column(1).to_pylist()
                found = scanner.scan(texts, b.column(2).to_pylist())
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                flat = [(texts[i], *s) for i, f in enumerate(found) for s in f]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.int32()), pa.array([hashlib.sha256(s[0][s[1] : s[2]].encode()).hexdigest() for s in flat], pa.string()), pa.array([s[3] for s in flat], pa.float64()), pa.array([s[3] >= scanner.threshold for s in flat], pa.bool_())],
                    names=["id", "start", "end", "value_sha256", "score", "is_secret"],
                )

    return run


def _redact(held, text_at: int, path_at: int | None, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                texts = b.column(text_at).to_pylist()
                paths = [None] * len(texts) if path_at is None else [None if p is None else str(p) for p in b.column(path_at).to_pylist()]
                changed = {}
                for i, found in enumerate(scanner.scan(texts, paths)):
                    if bad := [(a, z) for a, z, s in found if s >= scanner.threshold]:
                        out, last = [], 0
                        for a, z in bad:
                            out += [texts[i][last:a], REDACTED]
                            last = z
                        changed[i] = "".join(out) + texts[i][last:]
                columns = [b.column(i) for i in range(b.num_columns)]
                if changed:
                    columns[text_at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[text_at].type)
                    if chars_at is not None:
                        columns[chars_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[chars_at].to_pylist())], columns[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return run


def find(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row for each candidate: id, start, end (characters), value_sha256, score, is_secret.

    The value itself is never given out. A null or empty text has no candidates, one of any
    length is searched whole; repeated rows have theirs each, null ids too; an empty table
    gives no rows; other columns are ignored. Ties at the threshold count as secrets.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scanner)  # 2**15 numbers and the trees
    kind = docs.schema[id_col].dataType.simpleString()
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path")).mapInArrow(_find(held, kind), f"id {kind}, start int, end int, value_sha256 string, score double, is_secret boolean").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, scanner: Scanner, text_col: str = "text", path_col: str | None = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """docs, all columns and rows, with each secret that ``find`` reports (a tie at the
    threshold too) replaced by [SECRET] in texts of any length; chars_col follows the new
    length, also where it was null. Null and empty texts stay as they are, and a table without
    a path column is judged without paths. No shuffle."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scanner)
    at = {c: i for i, c in enumerate(docs.columns)}
    return docs.mapInArrow(_redact(held, at[text_col], at.get(path_col), at.get(chars_col)), docs.schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with their scores."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
