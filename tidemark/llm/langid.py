"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from labelled texts; a text
is compressed with each of them and goes to the language whose dictionary gives the
smallest size. Texts are folded to lower-case letters with single spaces first, so digits,
marks and capitals say nothing, and long ones are compressed in pieces, so that the
dictionary keeps its say over the text's own history.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import ship, table

NOT_LETTERS = re.compile(r"[\W\d_]+")
#: characters of a piece that is compressed on its own
PIECE = 2048
#: texts of fewer characters are compressed at the level that finds the shortest matches
SHORT, SHORT_LEVEL = 256, 19


def folded(text: str | None) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", docs_per_label: int = 400, whole_chars: int = 4096) -> dict[str, bytes]:
    """A dictionary for each label: its sample of folded whole texts, nothing cut.

    The sample is bounded in rows: docs_per_label different texts for each label, those with
    the smallest hash of their text. Texts of more than whole_chars characters are only
    taken where a label has too few others, so a dictionary has docs_per_label *
    whole_chars characters at most unless longer texts are all there is. Null labels and
    texts teach nothing.
    """
    named = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), F.pmod(F.xxhash64(F.lit("sample"), text_col), F.lit(1 << 30)).alias("h"), F.col(text_col).alias("text"))
    named = named.withColumn("long", F.length("text") > whole_chars)
    counts = {(r["label"], r["long"]): (r["n"], r["texts"]) for r in named.groupBy("label", "long").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()}
    if not counts:
        return {}
    learned = {label: sum(n for (other, _), (n, _) in counts.items() if other == label) for label, _ in counts}
    # a hash below this keeps three times as many texts as are needed
    share = {key: int(min(1.0, (3 * docs_per_label + 100) / max(1, texts)) * (1 << 30)) for key, (_, texts) in counts.items() if not key[1] or counts.get((key[0], False), (0, 0))[1] < 2 * docs_per_label}
    below = F.lit(0)
    for (label, long), h in share.items():  # two for each language
        below = F.when((F.col("label") == label) & (F.col("long") == long), h).otherwise(below)
    few = named.where(F.col("h") < below).distinct()
    rank = Window.partitionBy("label").orderBy("long", "h", "text")
    picked = few.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= docs_per_label).select("label", "k", "text").collect()
    out: dict[str, bytes] = {}
    for label in sorted(learned, key=lambda x: (-learned[x], x)):
        out[label] = " ".join(folded(r["text"]) for r in sorted((r for r in picked if r["label"] == label), key=lambda r: -r["k"])).encode()
    return out


class Model:
    """dictionaries: those of languages that were learned from more texts come first; of
    languages with equal sizes the first is taken."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3, margin: float = 0.01):
        self.labels, self.margin = list(dictionaries), margin
        self.long = [self._compressor(d, level) for d in dictionaries.values()]
        self.short = [self._compressor(d, SHORT_LEVEL) for d in dictionaries.values()]

    @staticmethod
    def _compressor(data: bytes, level: int):
        import zstandard

        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, text: str) -> list[int]:
        t = folded(text)
        pieces = [t[i : i + PIECE].encode("utf-8", "replace") for i in range(0, len(t), PIECE)]
        return [sum(len(c(p)) for p in pieces) for c in (self.short if len(t) < SHORT else self.long)]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, score in 0 to 1, whether the margin was wide enough."""
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        least = sizes[best]
        score = 1 / sum(math.exp(-0.5 * min(s - least, 1000)) for s in sizes)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * least + 2)
        return self.labels[best], score, rest - least > max(1, self.margin * rest)


_models: dict[str, Model] = {}


def _predict(held, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:  # one for each process and call
            _models.clear()
            _models[name] = Model(held.value)
        m = _models[name]
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                label, score, wide = zip(*map(m.predict, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(wide, pa.bool_())], names=["id", "lang_pred", "score", "confident"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, confident for each row of docs.

    lang_pred is the language with the smallest size (ties: the one with more labelled texts), `und` with score
    0 for a text that is null or has no letter, or where no language was learned. Texts
    whose smallest two sizes are within one byte or 1 % are rejected: confident is false,
    lang_pred still the smallest. Nothing but the text is read, whole and of any length;
    repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # see train for their size
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_predict(held, uuid.uuid4().hex), f"id {kind}, lang_pred string, score double, confident boolean").withColumnRenamed("id", id_col)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    apart = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    dictionaries = train(docs.where(~apart(F.col("doc_id"))))
    out = identify(docs, dictionaries)
    return out.select("doc_id", apart(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "confident")
