"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (u, v).  Large: a node's larger neighbours are
    tied to the least of its neighbours and itself.  Small: its smaller ones and
    itself are.  The least is a pre-aggregated minimum; the join on the centre
    has one row for each centre on its other side, so Spark's adaptive join cuts
    a large star's edges into several tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.where("v < u") if small else both
    least = near.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
    met = near.join(least, near["u"] == least["c"])
    if small:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    else:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node that
    it is joined to, and roots themselves are left out.  Each round is stored,
    so that a lost executor costs one round at most; the number of rounds grows
    as the logarithm of the longest path."""
    edges, before = cut(edges.where("u <> v").distinct()), None
    while True:
        n, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (n, mark)
        edges = cut(_star(_star(edges, small=False), small=True))
        released(edges.sparkSession)
