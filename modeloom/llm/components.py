"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm._io import discard, stage_table


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest node that it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: long) but the roots.

    The root is the smallest node reachable. Self-loops and repeated edges
    don't matter; no edges give no rows. Rounds go on until one changes nothing,
    about the square of the logarithm of the largest component's size. Each is
    written to the shared folder and the one before deleted; only a row count
    and a sum reach the driver.
    """
    now = stage_table(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges"
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        wide = stage_table(_large(now).distinct(), "cc-large")
        after = stage_table(_small(wide).distinct(), "cc-small")
        discard(now, wide)
        now = after
