"""Fresh reads: a stable base table merged with versioned change records.

A change record has the base columns, ``type`` (INSERT, UPDATE or DELETE; an update is the
row after it), ``_version`` (of its batch) and ``_seq`` (its place in the batch, of any type that has an order). For each
primary key the last change by version and place wins; if it is a DELETE the row is gone.
Versions may arrive in any order and more than once.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import latest

META = ("type", "_version", "_seq")


def conform(deltas: DataFrame, base: DataFrame) -> DataFrame:
    """Changes with the base table's columns, types (32-bit integers of logs widen) and order."""
    return deltas.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in base.schema.fields), *(F.col(m) for m in META))


def latest_changes(deltas: DataFrame, keys: list[str], version: int | None = None) -> DataFrame:
    """For each key its last change, up to a version."""
    return latest(deltas if version is None else deltas.where(F.col("_version") <= version), keys, "_version", "_seq")


def snapshot(stable: DataFrame, deltas: DataFrame, keys: list[str], version: int | None = None) -> DataFrame:
    """All rows as of a version: base and changes ranked together by key. One shuffle of
    both; ``fresh`` gives the same rows and shuffles less when there are few changes."""
    base = stable.withColumns({"type": F.lit("INSERT"), "_version": F.lit(-1).cast("long"), "_seq": F.lit(None).cast(deltas.schema["_seq"].dataType)})
    changes = conform(deltas if version is None else deltas.where(F.col("_version") <= version), stable)
    return latest(base.unionByName(changes), keys, "_version", "_seq").where("type <> 'DELETE'").drop(*META)


def fresh(stable: DataFrame, deltas: DataFrame, keys: list[str], version: int | None = None) -> DataFrame:
    """The same by visibility: base rows whose key has no change, and the last changes that
    aren't deletes. The base is only anti-joined by the changed keys, never ranked, and the
    changes are ranked once: any change of a key hides its base row."""
    changes = conform(deltas if version is None else deltas.where(F.col("_version") <= version), stable)
    return visible(stable, changes, keys).unionByName(latest_changes(changes, keys).where("type <> 'DELETE'").drop(*META))


def visible(stable: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The base rows that no change hides."""
    return stable.join(changes.select(*keys), keys, "left_anti").select(stable.columns)


def compact(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """One record a key: what later merges need of these deltas (deletes stay, they still
    hide base rows)."""
    return latest_changes(deltas, keys)


def keep_map(stable: DataFrame, deltas: DataFrame, keys: list[str], version: int | None = None) -> DataFrame:
    """Each base key with whether its base row is visible."""
    hidden = (deltas if version is None else deltas.where(F.col("_version") <= version)).select(*keys).distinct().withColumn("_hidden", F.lit(True))
    return stable.select(*keys).join(hidden, keys, "left").select(*keys, F.col("_hidden").isNull().alias("visible"))


class KeepMaps:
    """The keys that changes hide, kept in memory by version: reads of one version share them.

    At most `versions` are kept; the one used longest ago goes. ``close`` drops all."""

    def __init__(self, deltas: DataFrame, keys: list[str], versions: int = 4):
        self.deltas, self.keys, self.versions = deltas, keys, versions
        self.kept: OrderedDict[int | None, DataFrame] = OrderedDict()
        self.hits = self.misses = 0

    def hidden(self, version: int | None = None) -> DataFrame:
        if version in self.kept:
            self.hits += 1
            self.kept.move_to_end(version)
            return self.kept[version]
        self.misses += 1
        changes = self.deltas if version is None else self.deltas.where(F.col("_version") <= version)
        self.kept[version] = changes.select(*self.keys).distinct().persist()
        while len(self.kept) > self.versions:
            self.kept.popitem(last=False)[1].unpersist()
        return self.kept[version]

    def visible(self, stable: DataFrame, version: int | None = None) -> DataFrame:
        """The base rows that no change up to the version hides."""
        return visible(stable, self.hidden(version), self.keys)

    def fresh(self, stable: DataFrame, version: int | None = None) -> DataFrame:
        """As the function ``fresh``."""
        last = latest_changes(conform(self.deltas, stable), self.keys, version)
        return self.visible(stable, version).unionByName(last.where("type <> 'DELETE'").drop(*META))

    def close(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


def route(deltas: DataFrame, column: str, bounds: list[int]) -> DataFrame:
    """Adds the partition whose key range a change falls in; bounds: ascending upper bounds
    (exclusive), the last partition is open."""
    part = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        part = F.when(F.col(column) < bounds[k], k).otherwise(part)
    return deltas.withColumn("partition", part)
