"""Connected components of an edge table by alternating large-star and small-star steps.

Each step hangs neighbours onto the smallest node around; after a few rounds (they grow with the logarithm of
a component's size) every node hangs directly on its component's smallest. Each round is written
to the shared folder, so a lost executor costs one round at most. Nothing but two numbers per round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyrisk.llm.common import spread_lookup, write_out

# A node with more edges than this has them dealt out to several tasks.
EDGES_PER_TASK = 100_000


def _hang(edges: DataFrame, least: DataFrame) -> DataFrame:
    return spread_lookup(edges, least, "u", "__n", F.xxhash64("v"), EDGES_PER_TASK)


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count(F.lit(1)).alias("__n"))
    large = _hang(both.where("v > u"), around).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    large = write_out(large, "components-large")
    below = large.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("__n"))
    moved = _hang(large, below).where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return write_out(moved.unionByName(below.select("u", F.col("least").alias("v"))).distinct(), "components-small")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has an edge to another; root is the smallest node that can be reached. Null
    ends and loops are left out."""
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    current = write_out(current.distinct(), "components-edges")
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        current = _round(current)
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return leaves.unionByName(roots)
