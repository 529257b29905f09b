"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public .model file (a parameter). For every start in the text the
trie is walked once, which gives all pieces that begin there; the Viterbi recurrence keeps
the best log score for each end. A character without a piece of its own costs the lowest
score minus 10 and becomes its UTF-8 bytes' pieces.

The public file's scores are merge ranks (0, -1, -2, ...), not log probabilities. With
``scores="rank"`` the piece of rank r gets log(1 / (r + 1)) less the log of the harmonic
sum (Zipf's law); ``scores="file"`` takes the file's scores as they are, for models that
hold log probabilities.

Where no piece has a whitespace marker after another character and none has a line feed,
the best path always cuts before a run of markers and around a line feed. The text is
then encoded unit by unit and the units' ids are kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import ship, table

MARK = "▁"
DEFAULT_MODEL = os.environ.get("TIDEMARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
UNITS = re.compile(r" *[^ \n]+|\n| +")
UNKNOWN_PENALTY = 10.0


@dataclass
class DoubleArray:
    """A trie over characters in two arrays: the child of node s by a character's code c is
    base[s] + c where check says s. Codes count from 1; 0 stands for characters in no key."""

    codes: dict[str, int]
    base: list[int]
    check: list[int]
    value: list[int]

    @classmethod
    def build(cls, keys: dict[str, int]) -> DoubleArray:
        counts: dict[str, int] = {}
        for key in keys:
            for ch in key:
                counts[ch] = counts.get(ch, 0) + 1
        codes = {ch: k + 1 for k, ch in enumerate(sorted(counts, key=lambda ch: (-counts[ch], ch)))}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, v in keys.items():
            node = 0
            for ch in key:
                c = codes[ch]
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = v
        room = len(codes) + 2
        base, check, value = [0] * room, [-1] * room, [-1] * room
        check[0] = -2  # the root's slot: nobody's child
        free, queue = 1, [(0, 0)]
        for node, slot in queue:  # the list grows while it is walked
            own = sorted(children[node])
            if not own:
                continue
            while check[free] != -1:
                free += 1
            b, tried = max(0, free - own[0]), 0
            while any(check[b + c] != -1 for c in own):
                b, tried = b + 1, tried + 1
                if b + room > len(check):
                    base, check, value = base + [0] * room, check + [-1] * room, value + [-1] * room
            base[slot] = b
            if tried > 64:  # what lies before is nearly full: later nodes start here
                free = b + own[0]
            for c in own:
                check[b + c] = slot
                value[b + c] = ends[children[node][c]]
                queue.append((children[node][c], b + c))
            if free + 2 * room > len(check):
                base, check, value = base + [0] * 4 * room, check + [-1] * 4 * room, value + [-1] * 4 * room
        return cls(codes, base, check, value)


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    trie: DoubleArray
    unknown_id: int
    lowest: float
    units: bool
    plain: list[bytes] = field(repr=False)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int], unknown_id: int) -> Vocabulary:
        """normal: whether a piece can be matched; byte_ids: 256 ids, or none without byte fallback."""
        keys = {p: i for i, p in enumerate(pieces) if normal[i] and p}
        bytes_of = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        plain = [bytes_of.get(i, p.replace(MARK, " ").encode() if normal[i] else b"") for i, p in enumerate(pieces)]
        units = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for i, p in enumerate(pieces) if normal[i])
        return cls(pieces, scores, byte_ids, DoubleArray.build(keys), unknown_id, min((s for s, n in zip(scores, normal) if n), default=0.0), units, plain)

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL, scores: str = "rank") -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        normal = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
        own = [m.get_score(i) for i in range(n)]
        byte_ids = [i for _, i in sorted((int(pieces[i][3:5], 16), i) for i in range(n) if m.is_byte(i))]
        if scores == "rank":
            order = sorted((i for i in range(n) if normal[i]), key=lambda i: (-own[i], i))
            harmonic = math.log(sum(1 / (r + 1) for r in range(len(order))))
            for r, i in enumerate(order):
                own[i] = -math.log(r + 1) - harmonic
        return cls.of(pieces, own, normal, byte_ids if len(byte_ids) == 256 else [], m.unk_id())

    def viterbi(self, text: str) -> list[int]:
        """The ids of a text whose spaces are markers already."""
        n = len(text)
        if not n:
            return []
        code = self.trie.codes.get
        data = [code(ch, 0) for ch in text]
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        unknown, nothing, root = self.lowest - UNKNOWN_PENALTY, -math.inf, self.trie.base[0]
        best, start, piece = [nothing] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, s, t, j = best[i], 0, root + data[i], i
            single = False
            while check[t] == s:
                s, j = t, j + 1
                if (v := value[s]) >= 0:
                    if j == i + 1:
                        single = True
                    if (total := here + scores[v]) > best[j]:
                        best[j], start[j], piece[j] = total, i, v
                if j == n:
                    break
                t = base[s] + data[j]
            if not single and here + unknown > best[i + 1]:
                best[i + 1], start[i + 1], piece[i + 1] = here + unknown, i, -1
        out, j = [], n
        while j > 0:
            i, v = start[j], piece[j]
            if v >= 0:
                out.append(v)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[i:j].encode()))
            else:
                out.append(self.unknown_id)
            j = i
        return out[::-1]


class Codec:
    """Encodes and decodes with a memo of at most memo_units units of up to 48 characters."""

    def __init__(self, vocabulary: Vocabulary, memo_units: int = 400_000):
        self.v, self.limit = vocabulary, memo_units
        self.kind = np.dtype("<u2" if len(vocabulary.pieces) <= 1 << 16 else "<i4")
        codec = self

        class Memo(dict):
            def __missing__(self, unit: str) -> bytes:
                ids = codec.pack(codec.v.viterbi(unit.replace(" ", MARK)))
                if len(unit) <= 48:
                    if len(self) >= codec.limit:
                        self.clear()
                    self[unit] = ids
                return ids

        self.memo = Memo()

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text as bytes of self.kind."""
        if not text:
            return b""
        if MARK in text:  # a literal marker isn't a space: its bytes keep it apart
            raw = self.pack([self.v.byte_ids[b] for b in MARK.encode()] if self.v.byte_ids else [self.v.unknown_id])
            parts = text.split(MARK)
            return raw.join(self._plain((" " if k == 0 else "") + p) for k, p in enumerate(parts))
        return self._plain(" " + text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.v.units:
            return self.pack(self.v.viterbi(text.replace(" ", MARK)))
        return b"".join(map(self.memo.__getitem__, UNITS.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), self.kind).tolist()

    def decode(self, ids: list[int]) -> str:
        """Exact for what encode gave, where there is byte fallback."""
        return b"".join(map(self.v.plain.__getitem__, ids)).decode("utf-8", "replace")[1:]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str = DEFAULT_MODEL, scores: str = "rank") -> Codec:
    """One for each process."""
    if (path, scores) not in _codecs:
        _codecs[path, scores] = Codec(Vocabulary.load(path, scores))
    return _codecs[path, scores]


def _lists(packed: list[bytes | None], kind: np.dtype) -> pa.Array:
    sizes = np.array([0 if p is None else len(p) // kind.itemsize for p in packed], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.frombuffer(b"".join(p for p in packed if p), kind).astype(np.int32)
    mask = pa.array([p is None for p in packed])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def _encode(path: str, scores: str, text_at: int, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, scores)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                texts = b.column(text_at).to_pylist()
                packed = [None if t is None else c.packed(t) for t in texts]
                ids = _lists(packed, c.kind)
                kept = [(b.schema.names[i], b.column(i)) for i in range(b.num_columns) if i != text_at]
                new = [("n_tokens", pa.array([None if p is None else len(p) // c.kind.itemsize for p in packed], pa.int32()))]
                if verify:
                    plain = c.v.plain
                    exact = [None if p is None else b"".join(map(plain.__getitem__, np.frombuffer(p, c.kind).tolist())).decode("utf-8", "replace")[1:] == t for p, t in zip(packed, texts)]
                    new.append(("decodes", pa.array(exact, pa.bool_())))
                new.append(("ids", ids))
                cols = kept + new
                yield pa.RecordBatch.from_arrays([x for _, x in cols], names=[n for n, _ in cols])

    return run


def _decode(path: str, scores: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, scores)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                texts = [None if x is None else c.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
                names = b.schema.names[:-1] + ["text"]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string())], names=names)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, scores: str = "rank", verify: bool = True) -> DataFrame:
    """id, n_tokens, decodes (whether decoding gives the text again; with verify), ids.

    A null text has null in all three; an empty one no ids. A literal U+2581 in a text is
    kept by its bytes. Other columns of docs are ignored; repeated rows are kept; an empty
    table gives no rows. model: a file that every executor can open.
    """
    ship(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    check = "decodes boolean, " if verify else ""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode(model, scores, 1, verify), f"id {key}, n_tokens int, {check}ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = DEFAULT_MODEL, scores: str = "rank") -> DataFrame:
    """id, text. Null ids have a null text."""
    ship(tokens.sparkSession)
    key = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(model, scores), f"id {key}, text string").withColumnRenamed("id", id_col)


def ids_digest(ids: list[int]) -> str:
    return hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, each decoded again and compared with its text."""
    return encode(table(spark, sf_dir, "documents"))
