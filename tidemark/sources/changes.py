"""Change records as a source: a folder of JSON-lines logs named change.<number>.json.

A record is {"table", "type": INSERT | UPDATE | DELETE, "ts": milliseconds, "row": {...}};
updates carry the row after the change. A reader remembers the last file it has read and
gives what is new, with the newest record's time as the batch's timestamp. A file is
complete once it has its name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


PLACE = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("record", T.LongType(), False)])


def envelope(row: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("table", T.StringType()), T.StructField("type", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("row", row)])


def records(logs: DataFrame, table: str) -> DataFrame:
    """The changes of one table: its columns, type, _version (the file's number) and _seq, the
    record's place in its file, so that the last change in a batch wins whatever its time.

    Spark may cut a file into ranges and read them in any order; a place is the range's first
    byte and a number that grows with the records inside a range."""
    number = F.regexp_extract("_metadata.file_name", r"change\.(\d+)\.json$", 1).cast("long")
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("record")).alias("_seq")
    # the place is taken before any row is filtered out: a number within the range, not within the table's rows
    return logs.select("table", "row", "type", number.alias("_version"), place).where(F.col("table") == table).select("row.*", "type", "_version", "_seq")


class LogReader:
    """Reads the files after the last one it has read, in one call as one batch."""

    def __init__(self, spark: SparkSession, folder: str, table: str, row: T.StructType):
        self.spark, self.folder, self.table, self.row = spark, folder.rstrip("/"), table, row
        self.read_to = -1

    def files(self) -> list[tuple[int, str]]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        found = [str(s.getPath().toString()) for s in path.getFileSystem(conf).listStatus(path)]
        return sorted((int(m[1]), f) for f in found if (m := re.search(r"change\.(\d+)\.json$", f)))

    def pull(self) -> tuple[DataFrame, int | None]:
        """(changes since the last call, newest time among them or None)."""
        new = [(n, f) for n, f in self.files() if n > self.read_to]
        if not new:
            empty = T.StructType([*self.row.fields, T.StructField("type", T.StringType()), T.StructField("_version", T.LongType()), T.StructField("_seq", PLACE)])
            return self.spark.createDataFrame([], empty), None
        logs = self.spark.read.schema(envelope(self.row)).json([f for _, f in new])
        self.read_to = new[-1][0]
        return records(logs, self.table), logs.where(F.col("table") == self.table).agg(F.max("ts")).first()[0]
