"""Tables from folders of Parquet files, as DataFrames or temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = RELATIONAL) -> None:
    """Registers each table as a temp view. Column pruning and filters still reach the scan."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
