"""Scan modes with a cache of columns. They choose where filters run and what comes from
memory, never the result.

PULL_UP reads the columns and filters afterwards: an observation of the rows read lies between
scan and filter, which Catalyst doesn't move filters through. PUSHDOWN_ONLY leaves the filter
to the scan. CACHING_ONLY takes every column from memory and stores those that aren't there.
HYBRID takes from memory what is there and reads the rest by a pushed-down scan of its own;
the two are joined by the table's key.

A segment is one column of a table. A replacement policy of bounded capacity decides which
segments are kept; a table's segments are persisted together with its key. Spark's storage
holds them (memory, then disk) and may recompute what an executor lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.cache_policy import LRU, Policy


class Mode(Enum):
    PULL_UP = "pullup"
    PUSHDOWN_ONLY = "pushdown-only"
    CACHING_ONLY = "caching-only"
    HYBRID = "hybrid"


@dataclass
class Split:
    """The columns a scan asks for: those in memory, those to be stored, those to be read."""

    hit: list[str] = field(default_factory=list)
    store: list[str] = field(default_factory=list)
    read: list[str] = field(default_factory=list)


class Scans:
    """Scans of one session with the columns it keeps. ``close`` drops them all; also a
    context manager.

    keys: the primary key's columns of each table that is to be cached: unique and without
    nulls, which is checked once before a table's first column is stored. A table without a
    key is only read from memory where all that is needed is there, as cached and read
    columns can't be put side by side.
    """

    def __init__(self, mode: Mode = Mode.PUSHDOWN_ONLY, keys: dict[str, tuple[str, ...]] | None = None, policy: Policy | None = None):
        self.mode, self.keys = mode, keys or {}
        self.policy = policy or LRU(8 << 30)
        self.kept: dict[str, DataFrame] = {}
        self.checked: set[str] = set()
        self.observed: list[Observation] = []

    def __enter__(self) -> Scans:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # ---- segments

    def columns_of(self, name: str) -> list[str]:
        return [c for t, _, c in self.policy.sizes if t == name]

    @staticmethod
    def size(df: DataFrame, columns: list[str]) -> int:
        """Bytes as the plan's statistics estimate them; nothing is run."""
        return int(df.select(columns)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    def _persist(self, name: str, df: DataFrame) -> None:
        """Makes the persisted table hold the policy's segments."""
        want = list(dict.fromkeys([*self.keys.get(name, ()), *sorted(self.columns_of(name))]))
        have = self.kept.get(name)
        if have is not None and set(have.columns) == set(want):
            return
        if have is not None:
            self.kept.pop(name).unpersist()
        if self.columns_of(name):
            self.kept[name] = df.select(want).persist(StorageLevel.MEMORY_AND_DISK)

    def keep(self, name: str, df: DataFrame, columns: list[str]) -> None:
        """Stores columns as far as the policy finds room."""
        if (key := self.keys.get(name)) and name not in self.checked:
            wrong = F.col("n") > 1
            for k in key:
                wrong = wrong | F.col(k).isNull()
            if df.groupBy(*key).agg(F.count("*").alias("n")).where(wrong).take(1):
                raise ValueError(f"{', '.join(key)} is no key of {name}")
            self.checked.add(name)
        for c in columns:
            if (name, 0, c) in self.policy.sizes or name in self.keys and c in self.keys[name]:
                continue
            for table, _, _ in self.policy.put((name, 0, c), self.size(df, [c])) or []:
                if table != name:
                    self._drop_gone(table)
        self._persist(name, df)

    def _drop_gone(self, name: str) -> None:
        """A table that lost a segment to another one's keeps its others."""
        held = self.kept[name]
        if not (left := self.columns_of(name)):
            self.kept.pop(name).unpersist()
        else:  # the smaller table is read from the larger one while that is dropped
            wanted = [c for c in held.columns if c in left or c in self.keys.get(name, ())]
            self.kept[name] = held.select(wanted).persist(StorageLevel.MEMORY_AND_DISK)
            self.kept[name].count()
            held.unpersist()

    def split(self, name: str, df: DataFrame, need: list[str]) -> Split:
        """Asks the policy for each column and sorts them."""
        key = self.keys.get(name, ())
        out = Split()
        for c in need:
            if c in key:
                continue
            if self.policy.get((name, 0, c)):
                out.hit.append(c)
            elif self.mode is Mode.CACHING_ONLY:
                out.store.append(c)
            else:
                out.read.append(c)
        return out

    # ---- scans

    def scan(self, name: str, df: DataFrame, columns: list[str], predicate: Column | None = None, predicate_columns: tuple[str, ...] = ()) -> DataFrame:
        need = list(dict.fromkeys([*columns, *predicate_columns]))
        if self.mode is Mode.PULL_UP:
            self.observed.append(Observation())
            out = df.select(need).observe(self.observed[-1], F.count(F.lit(1)).alias("rows"))
        elif self.mode is Mode.PUSHDOWN_ONLY:
            out = df.select(need)
        else:
            out = self._cached(name, df, need)
        if predicate is not None:
            out = out.where(predicate)
        return out.select(columns)

    def _cached(self, name: str, df: DataFrame, need: list[str]) -> DataFrame:
        parts = self.split(name, df, need)
        if parts.store:
            self.keep(name, df, parts.store)
            parts.hit = [c for c in [*parts.hit, *parts.store] if c in self.columns_of(name)]
            parts.read = [c for c in need if c not in parts.hit and c not in self.keys.get(name, ())]
        held = self.kept.get(name)
        if held is None or not parts.hit and parts.read:
            return df.select(need)  # nothing in memory is of use
        if not parts.read and set(need) <= set(held.columns):
            return held.select(need)
        if not self.keys.get(name):
            return df.select(need)  # cached and read columns can't be put side by side
        key = list(self.keys[name])
        there, rest = held.select(*key, *parts.hit), df.select(*(F.col(k).alias(f"_key_{k}") for k in key), *parts.read)
        return there.join(rest, [F.col(k) == F.col(f"_key_{k}") for k in key]).select(need)

    def metrics(self) -> dict[str, float]:
        """Requests for segments that were met, and what is kept."""
        asked = self.policy.hits + self.policy.misses
        return {"segment_hits": self.policy.hits, "segment_misses": self.policy.misses, "hit_rate": self.policy.hits / asked if asked else 0.0, "bytes_kept": self.policy.used, "bytes_allowed": self.policy.capacity}

    def close(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()
        for s in list(self.policy.sizes):
            del self.policy.sizes[s]
            self.policy.on_remove(s)
