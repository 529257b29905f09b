"""Connected components of a link table by alternating large-star and small-star rounds.

Nothing is collected; each round's links are written to the shared folder, so a lost
executor costs that round's part only. A node with very many neighbours is only ever
reduced by min() and joined on, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import forget, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def _is_stars(e: DataFrame) -> bool:
    """Whether every link leads straight to its component's smallest node."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").take(1)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, label (the smallest node reached) for every node with a link to another one."""
    e = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while not _is_stars(e):
        new = written(_small_star(_large_star(e).where("u <> v")).where("u <> v").distinct(), "links")
        forget(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
