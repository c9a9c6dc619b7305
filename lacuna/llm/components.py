"""Connected components of an edge table, as Spark joins and aggregates (large-star / small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; every node moves towards the least node it can reach."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = materialize(large.where(F.col("u") != F.col("v")).distinct(), "star")
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v"))
    )
    return materialize(small.distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges ``u``, ``v``; the root is the least node of its component.

    The number of rounds is logarithmic in the longest chain; each round is
    written to the shared folder, so lineage stays short. Self-edges are ignored.
    """
    current = materialize(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(current)
    while seen[0]:
        current = _stars(current)
        now = mark(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
