"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseq.session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    around = _both_ways(links)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from the larger node to the smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def stars(links: DataFrame, most: int = 60) -> DataFrame:
    """``a, b``: every linked node that isn't the least of its component, with the least.

    ``links`` has two columns ``a`` and ``b`` of one orderable type. Each round is one table in the shared folder; only a
    count and a checksum come to the driver. Rounds grow with the logarithm of the links; the rare run that needs more than
    ``most`` raises.
    """
    ordered = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    links = cut_lineage(links.where("a <> b").select(*ordered).select("a", "b").distinct())
    before = None
    for _ in range(most):
        links = cut_lineage(_small_star(_large_star(links)).where("a <> b").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links
        before = state
    raise RuntimeError("components did not settle")
