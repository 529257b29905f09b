"""A training corpus from ``documents`` in five stages, each written and read again.

1. quality: what the ordinal classifier rejects goes.
2. near_duplicates: of each group of the n-gram Jaccard join one row stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: secrets are replaced by [SECRET]; no document goes.
5. tokens: the token ids of what is left, decoded again and compared with the text.

Every stage but the last gives the columns of its input, extra ones included, and handles
rows, not ids: repeated and null ids are rows of their own. An empty table gives an empty
one of the same columns.

No stage is expressible in SQL as a whole (the first and fourth are trained, the fifth
walks a trie), so ORACLE_SQL is None; the tests hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, quality, secrets, sentencepiece
from tidemark.llm._common import table, written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose probability of the best grade is at least one half (a tie stays). Null
    and empty texts are judged by the thresholds alone; whole texts of any length are read.
    Without labelled documents nothing is learned and every row stays."""
    return quality.select(docs, quality.train(docs, quality.graded(table(spark, sf_dir, "labels"))))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id, a row without one only
    where no row has one, and of rows with equal ids the first in the written order. Rows
    whose text is null or has no words are linked with nothing and stay."""
    number = next(n for n in ("_row", *(f"_row{k}" for k in range(len(docs.columns) + 1))) if n not in docs.columns)
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(number).alias("row")).alias("key")
    found = jaccard_join.jaccard_components(rows.select(key, "text"), id_col="key")
    go = written(found.where(F.col("key") != F.col("component_id")).select(F.col("key.row").alias(number)), "duplicates")
    return rows.join(go, number, "left_anti").select(docs.columns)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold less than 0.8 of every item's shingles (a tie goes). Null and empty
    texts hold nothing and stay, items that are null or without words are in no text; texts
    of any length are searched whole. Without items every row stays."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in whole texts of any length replaced and n_chars brought up to date; a
    score at the threshold is a secret. Null and empty texts stay as they are."""
    return secrets.redact(docs, secrets.train(docs))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, decodes, ids of every row, of whole texts; null for a null text, no ids
    for an empty one. Of paths with equal scores the one found first is taken."""
    return sentencepiece.encode(docs)


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("decontamination", _decontamination), ("secrets", _secrets), ("tokens", _tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over the whole table ``documents``; what the last one gives."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
