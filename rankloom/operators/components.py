"""Connected components of a graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.plans.session import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: the neighbours of each node are hung onto the least node of its neighbourhood.

    ``edges`` has each edge once as (a, b) with a > b. The large star hangs the greater neighbours, the small star the
    smaller ones and the node itself. The least neighbour comes from a partial aggregate, never from a collected list.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("low", "node"))
    hung = both.join(least, "node")
    if large:
        out = hung.where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    else:
        out = hung.select(F.col("other").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long); the component is its least node.

    Loops and repeated edges do no harm, an empty graph gives no row. The lineage is cut after each round with a
    table in the shared folder. Rounds grow with the logarithm of the longest path; ``rounds`` only guards against
    a defect and raises instead of returning labels that are not settled.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        before, now = now, stored(_star(_star(now, True), False))
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            ends = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
        mark = seen
    raise RuntimeError("components did not settle")
