"""Fresh tables kept by Structured Streaming, without a table format: merge on read.

``foreachBatch`` writes each micro-batch's last change of every key beside the base and
rewrites nothing else. Reading merges the base with the batches written whole so far.
Every few batches their files are compacted into one, which costs as much as the changed
keys. A batch that is replayed after a failure writes the same folder again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.delta import compact, fresh


class MergeTable:
    """<root>/base=<batch>: the table up to a batch; <root>/changes=<first>-<last>: the last
    change of each key in these batches. A folder counts once it has its _SUCCESS file, and of
    folders that overlap the one that reaches furthest.

    compact_every: batches after which the change files become one. Their records keep
    version and place, so a change may arrive after newer ones; ``rebase`` gives that up.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], compact_every: int = 8):
        self.spark, self.root, self.keys, self.compact_every = spark, root.rstrip("/"), keys, compact_every
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs, self.path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def create(self, stable: DataFrame) -> None:
        stable.write.mode("overwrite").parquet(f"{self.root}/base=-1")

    def _names(self) -> list[str]:
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        return [n for n in found if self.fs.exists(self.path(f"{self.root}/{n}/_SUCCESS"))]

    def base(self) -> int:
        return max(int(n[5:]) for n in self._names() if n.startswith("base="))

    def changes(self, upto: int | None = None) -> list[tuple[int, int]]:
        """(first, last) of the change folders to be read on top of the base, in order."""
        spans = [(int(m[1]), int(m[2])) for n in self._names() if (m := re.fullmatch(r"changes=(-?\d+)-(-?\d+)", n))]
        at, out = self.base(), []
        while ahead := [s for s in spans if s[0] > at and (upto is None or s[1] <= upto)]:
            first = min(s[0] for s in ahead)
            out.append(max(s for s in ahead if s[0] == first))
            at = out[-1][1]
        return out

    def versions(self) -> list[int]:
        """The batches the table can be read as of."""
        return [self.base(), *(last for _, last in self.changes())]

    def _read_changes(self, spans: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/changes={a}-{b}" for a, b in spans))

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or as of one of ``versions``."""
        stable, spans = self.spark.read.parquet(f"{self.root}/base={self.base()}"), self.changes(version)
        return fresh(stable, self._read_changes(spans), self.keys) if spans else stable

    def upsert(self, changes: DataFrame, batch: int) -> None:
        if batch <= self.base():
            return  # a replay of what the base holds already
        compact(changes, self.keys).write.mode("overwrite").parquet(f"{self.root}/changes={batch}-{batch}")
        if len(self.changes()) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """The change files as one; what it replaces goes the next time, as readers may still hold it."""
        spans = self.changes()
        if len(spans) > 1:
            self._clean()
            compact(self._read_changes(spans), self.keys).write.mode("overwrite").parquet(f"{self.root}/changes={spans[0][0]}-{spans[-1][1]}")

    def rebase(self) -> None:
        """Writes the table as a new base. No change older than the newest of its key may come
        afterwards, as the base holds no versions."""
        if spans := self.changes():
            self.read().write.mode("overwrite").parquet(f"{self.root}/base={spans[-1][1]}")

    def _clean(self) -> None:
        live = {f"base={self.base()}", *(f"changes={a}-{b}" for a, b in self.changes())}
        for n in self._names():
            if n not in live and re.match("base=|changes=", n):
                self.fs.delete(self.path(f"{self.root}/{n}"), True)


def stream_changes(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet change files (base columns, type, _version, _seq)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run(changes: DataFrame, table: MergeTable, checkpoint: str, trigger: dict | None = None):
    """Starts the stream; by default it takes what is there and stops (availableNow). With
    {"processingTime": "30 seconds"} it pulls periodically until it is stopped."""
    merge: Callable[[DataFrame, int], None] = table.upsert
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fresh_batches(df: DataFrame, rows: int = 100_000):
    """What a reader outside Spark pulls: lists of rows, one partition on the driver at a time."""
    held = []
    for r in df.toLocalIterator():
        held.append(r.asDict())
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window, for streams and batches alike."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
