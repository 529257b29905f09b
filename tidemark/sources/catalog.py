"""A catalog of declared tables: typed schemas, primary keys, statistics, zone maps.

The metadata of a schema is three JSON documents: the tables (format, delimiter, primary
key, partitions, typed fields), their statistics (row counts) and the partitions' zone
maps (min and max per column). Identifiers are case-insensitive and kept in lower case;
columns keep their declared order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "int32": T.IntegerType(), "int": T.IntegerType(), "int64": T.LongType(), "long": T.LongType(), "float64": T.DoubleType(), "double": T.DoubleType(),
    "utf8": T.StringType(), "string": T.StringType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.DateType(),
}
CHANGE_COLUMN = "type"


@dataclass(frozen=True)
class Partition:
    path: str
    zones: dict[str, tuple[Any, Any]] = field(default_factory=dict)


@dataclass(frozen=True)
class Table:
    name: str
    format: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    partitions: tuple[Partition, ...]
    delimiter: str = ","
    row_count: int | None = None
    #: options of the file system for this table's reads, see ``store_options``
    store: dict[str, str] = field(default_factory=dict)

    @property
    def delta_schema(self) -> T.StructType:
        """The base columns and the kind of change."""
        return T.StructType([*self.schema.fields, T.StructField(CHANGE_COLUMN, T.StringType())])

    def read(self, spark: SparkSession, columns: list[str] | None = None, partitions: list[Partition] | None = None) -> DataFrame:
        """A scan of some or all partitions; no partition left gives an empty table of the schema."""
        paths = [p.path for p in (self.partitions if partitions is None else partitions)]
        reader = spark.read.schema(self.schema).options(**self.store)
        if not paths:
            out = spark.createDataFrame([], self.schema)
        elif self.format == "csv":
            out = reader.options(sep=self.delimiter, header=True, enforceSchema=True).csv(paths)
        else:
            out = reader.parquet(*paths)
        return out.select(*existing(out, columns)) if columns else out


def existing(df: DataFrame, columns: list[str]) -> list[str]:
    """The listed columns that df has, in the list's order; others are passed over."""
    have = {c.lower(): c for c in df.columns}
    return [have[c.lower()] for c in columns if c.lower() in have]


def store_options(client: dict[str, Any]) -> dict[str, str]:
    """Hadoop's options for an object store, given as {"kind", "endpoint", "region",
    "connections"}. kind: s3 (the vendor's own endpoints unless one is given) or compatible
    (a store that speaks the same protocol at an endpoint of its own: buckets in the path, no
    TLS for http). Keys aren't taken from the catalog."""
    kind = client.get("kind", "s3").lower()
    if kind not in ("s3", "compatible"):
        raise ValueError(f"no store of kind {kind!r}")
    if kind == "compatible" and not client.get("endpoint"):
        raise ValueError("a compatible store needs its endpoint")
    out = {}
    if endpoint := client.get("endpoint"):
        out |= {"fs.s3a.endpoint": endpoint, "fs.s3a.connection.ssl.enabled": str(not endpoint.startswith("http://")).lower()}
    if kind == "compatible":
        out["fs.s3a.path.style.access"] = "true"
    if region := client.get("region"):
        out["fs.s3a.endpoint.region"] = region
    if n := client.get("connections"):
        out["fs.s3a.connection.maximum"] = str(int(n))
    return out


class Catalog:
    def __init__(self, tables: list[Table]):
        self.tables = {t.name.lower(): t for t in tables}

    @classmethod
    def from_json(cls, root: str, schema: str, stats: str = "{}", zones: str = "{}") -> Catalog:
        """schema's "client", also of a single table, says which object store holds the tables.
        root: the folder the tables lie in; partition k of n is <root>/<table>/<table>.<format>.<k>, a single one <root>/<table>.<format>."""
        counts = {t["name"].lower(): t.get("stats", {}).get("rowCount") for t in json.loads(stats).get("tables", [])}
        bounds = {t["name"].lower(): t.get("zones", {}) for t in json.loads(zones).get("tables", [])}
        out = []
        told = json.loads(schema)
        for t in told["tables"]:
            name, n = t["name"].lower(), t.get("numPartitions", 1)
            fields = []
            for f in t["fields"]:
                if f["type"].lower() not in TYPES:
                    raise ValueError(f"{name}.{f['name']}: no type {f['type']!r}")
                fields.append(T.StructField(f["name"].lower(), TYPES[f["type"].lower()]))
            form = t.get("format", "parquet").lower()
            paths = [f"{root}/{name}.{form}"] if n == 1 else [f"{root}/{name}/{name}.{form}.{k}" for k in range(n)]
            own = bounds.get(name, {})
            parts = tuple(Partition(p, {c.lower(): tuple(v[k]) for c, v in own.items()}) for k, p in enumerate(paths))
            out.append(Table(name, form, T.StructType(fields), tuple(c.lower() for c in t.get("primaryKeyNames", [])), parts, t.get("delimiter", ","), counts.get(name), store_options(told.get("client", {}) | t.get("client", {}))))
        return cls(out)

    def __getitem__(self, name: str) -> Table:
        return self.tables[name.lower()]

    def register(self, spark: SparkSession) -> None:
        for t in self.tables.values():
            t.read(spark).createOrReplaceTempView(t.name)
