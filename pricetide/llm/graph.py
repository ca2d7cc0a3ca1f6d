"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``edges(a, b)``; self-loops are allowed.

    Alternating star contraction: neighbours are linked to the least node of a neighbourhood until nothing changes,
    in rounds that grow with the logarithm of a component's size. A node with many neighbours is only ever reduced
    by a minimum, which combines before the shuffle. Every round is staged as a table in the shared folder.
    """
    links = stage(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    seen = _print(links)
    while True:
        # every node sends its larger neighbours to the least node it knows
        both = links.select(F.col("low").alias("n"), F.col("high").alias("m")).unionByName(
            links.select(F.col("high").alias("n"), F.col("low").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = both.where("m >= n").join(least, "n").select(F.col("least").alias("low"), F.col("m").alias("high")).distinct()
        # every node sends its smaller neighbours, and itself, to the least of them
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        links = stage(
            large.join(least, "high").select("least", F.explode(F.array("low", "high")).alias("m"))
            .select(F.col("least").alias("low"), F.col("m").alias("high")).distinct())
        now = _print(links)
        if now == seen:
            break
        seen = now
    return links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))


def _print(links: DataFrame) -> tuple:
    """Count and hash sum of the links: unchanged when the rounds have come to rest."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
