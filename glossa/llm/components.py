"""Connected components by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of ``links`` (a, b); root is the smallest node that can be reached.

    Each round only groups by node with map-side minima, so a hub costs no more than its rows, and
    the links of a round are written to the shared folder, which ends their lineage.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(links.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        begun = edges
        # Large star: every larger neighbour is linked to the smallest neighbour.
        hub = edges.transform(both).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        edges = edges.transform(both).where("b > a").join(hub, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = large = materialise(edges)
        # Small star: smaller neighbours and the node itself are linked to the smallest of them.
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        star = down.join(low, F.col("a") == F.col("n"))
        edges = materialise(star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        discard(begun, large)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
