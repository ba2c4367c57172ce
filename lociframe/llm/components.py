"""Connected components by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import drop_durable, durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v.

    Large star: every neighbour above a node is linked to the smallest member
    of the node's neighbourhood.  Small star: the same for the neighbours
    below a node and the node itself.  The minimum is pre-aggregated on the
    map side; a node with very many links is a skewed join side, which
    adaptive execution splits.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node.

    ``edges`` has two long columns ``u`` and ``v``; direction, repeats, loops
    and nulls do not matter.  Each round is written to the shared folder, so
    the lineage stays short and an executor may be lost at any time.
    """
    e = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = durable(e, "edges")
    mark = None
    for _ in range(max_rounds):
        nxt = durable(_star(_star(e, True), False), "edges")
        drop_durable(e)
        e = nxt
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError("connected_components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
