"""Connected components of links as rows, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.tables import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")
    return near.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """Node and root for every node of ``links`` (a, b); the root is the smallest node of the component.

    Each round is kept in the checkpoint folder.  Links stay rows throughout; the driver sees one
    count and one checksum a round.  Roots that are their own are not listed.
    """
    links = cut(links.where("a != b").distinct())
    seen = None
    while True:
        links = cut(_small_star(_large_star(links)))
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
