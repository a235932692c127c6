"""Connected components of a link table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): root is the smallest node reachable; nodes without links are absent.

    Alternating star rounds: every node links its larger neighbours to its
    smallest one, then its smaller neighbours and itself to the smallest. Minima
    are partial sums, so a node with many links is no hot task; links stay
    distributed, and only a count and a checksum per round reach the driver.
    """
    now = durable(_forward(links))
    seen = None
    while True:
        now = durable(_small(_large(now)))
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark


def _forward(links: DataFrame) -> DataFrame:
    """Every link once, from its larger to its smaller end."""
    return (links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
