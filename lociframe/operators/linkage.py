"""Average-linkage clustering of sparse similarities by rounds of reciprocal nearest neighbours.

Average linkage is reducible: two clusters that are each other's nearest
neighbours stay so whatever else merges, so all such pairs can merge in one
round and the tree is that of one merge at a time.  A round is a handful of
joins; only the number of edges left passes the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._shared import written
from .scan import ordered_scan

SMALL = 1000  # items that one task clusters faster than rounds of joins do
UNIT = 1 << 40  # similarities are summed as whole multiples of 1 / UNIT, so sums do not depend on order


def average_linkage(similar: DataFrame, items: DataFrame, max_rounds: int = 10_000, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(merges, leaves) of ``items`` (item) under ``similar`` (left, right, similarity in [0, 1]).

    ``similar`` may hold a pair either way or both; pairs it lacks have
    similarity 0, those of an item with itself count for its weight only.
    merges: (left_node, right_node, height, size) with height 1 - mean
    similarity; a node is named by the smallest number of its items, items
    being numbered in their order.  Equal means merge the pair of smaller
    numbers first; what shares no similarity is joined last, at height 1, in
    the order of numbers.  leaves: (item, number, weight, place), ``weight``
    the mean similarity to all items, ``place`` the order along the dendrogram
    when at each merge the side of smaller summed weight stands first.  Up to
    ``small`` items are clustered by one task, with the same result.
    """
    nodes = ordered_scan(items.select("item").distinct(), [F.col("item")], place="number")
    n = nodes.count()
    if not n:
        kind = dict(items.dtypes)["item"]
        return items.sparkSession.createDataFrame([], "left_node long, right_node long, height double, size long"), items.sparkSession.createDataFrame([], f"item {kind}, number long, weight double, place long")
    pairs = similar.select(F.least("left", "right").alias("l"), F.greatest("left", "right").alias("r"), F.col("similarity").cast("double").alias("s")).groupBy("l", "r").agg(F.max("s").alias("s"))
    of = lambda c, k: nodes.select(F.col("item").alias(c), F.col("number").alias(k))
    pairs = pairs.join(of("l", "a"), "l").join(of("r", "b"), "r")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(F.col("s") * UNIT).cast("decimal(38,0)").alias("s")), "linkage-pairs")
    both = pairs.select(F.col("a").alias("number"), "s").union(pairs.where("a < b").select("b", "s"))
    weight = both.groupBy("number").agg(F.sum("s").alias("w"))
    leaves = nodes.join(weight, "number", "left").select("item", "number", F.coalesce("w", F.lit(0)).cast("decimal(38,0)").alias("w"))
    leaves = written(leaves.withColumns({"node": F.col("number"), "place": F.lit(0).cast("long")}), "linkage-leaves")
    if n <= small and not pairs.isEmpty():
        got = written(pairs.groupBy(F.lit("all").alias("all")).applyInPandas(lambda pdf: _one_task(pdf, n), "is_leaf boolean, x long, y long, height double, size long"), "linkage-small")
        tree = got.where("not is_leaf").select(F.col("x").alias("left_node"), F.col("y").alias("right_node"), "height", "size")
        placed = leaves.join(got.where("is_leaf").select(F.col("x").alias("number"), F.col("y").alias("at")), "number")
        return tree, placed.select("item", "number", (F.col("w").cast("double") / UNIT / n).alias("weight"), F.col("at").alias("place"))
    state = leaves.select("node", F.lit(1).cast("long").alias("size"), F.col("w").alias("value"))
    edges = pairs.where("a < b and s > 0")
    done = []
    for _ in range(max_rounds):
        merges = written(_reciprocal(edges, state), "linkage-merges")
        if merges.isEmpty():
            break
        done.append(merges)
        into = merges.select(F.col("b").alias("old"), F.col("a").alias("new"))
        first = F.when(F.col("a_first"), F.col("a")).otherwise(F.col("b"))
        shift = merges.select(F.when(F.col("a_first"), F.col("b")).otherwise(F.col("a")).alias("node"), F.when(first == F.col("a"), F.col("size_a")).otherwise(F.col("size_b")).alias("by"))
        moved = leaves.join(shift, "node", "left").join(into, F.col("node") == F.col("old"), "left")
        leaves = written(moved.select("item", "number", "w", F.coalesce("new", "node").alias("node"), (F.col("place") + F.coalesce("by", F.lit(0))).alias("place")), "linkage-leaves")
        state = state.join(into, F.col("node") == F.col("old"), "left").groupBy(F.coalesce("new", "node").alias("node")).agg(F.sum("size").alias("size"), F.sum("value").cast("decimal(38,0)").alias("value"))
        state = written(state, "linkage-nodes")
        e = edges
        for end in ("a", "b"):
            e = e.join(into, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
        e = e.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").cast("decimal(38,0)").alias("s"))
        edges = written(e, "linkage-edges")
    tops, joined = _unlike(state)
    done.append(joined)
    tree = reduce(DataFrame.unionByName, [m.select(F.col("a").alias("left_node"), F.col("b").alias("right_node"), (1 - F.col("mean")).alias("height"), (F.col("size_a") + F.col("size_b")).alias("size")) for m in done])
    placed = leaves.join(tops, "node").select("item", "number", (F.col("w").cast("double") / UNIT / n).alias("weight"), (F.col("place") + F.col("begin")).alias("place"))
    return tree, placed


def _one_task(pairs: pd.DataFrame, n: int) -> pd.DataFrame:
    """Merges and leaves of a small matrix of whole-numbered sums, best pair first."""
    s = np.zeros((n, n), np.int64)
    a, b, v = pairs["a"].to_numpy(int) - 1, pairs["b"].to_numpy(int) - 1, pairs["s"].to_numpy().astype(np.int64)
    s[a, b] = s[b, a] = v
    value = [int(x) for x in s.sum(axis=1)]
    np.fill_diagonal(s, 0)
    size, leaves, rows = np.ones(n, np.int64), [[i] for i in range(n)], []
    upper = np.triu(np.ones((n, n), bool), 1)
    for _ in range(n - 1):
        mean = np.where(upper, s / UNIT / (size[:, None] * size[None, :]), -1.0)
        i, j = divmod(int(mean.argmax()), n)
        rows.append((False, i + 1, j + 1, 1 - mean[i, j], int(size[i] + size[j])))
        leaves[i] = leaves[i] + leaves[j] if value[i] <= value[j] else leaves[j] + leaves[i]
        value[i] += value[j]
        s[i] += s[j]
        s[:, i] += s[:, j]
        size[i] += size[j]
        upper[j] = upper[:, j] = False
    rows += [(True, k + 1, at, 0.0, 1) for at, k in enumerate(leaves[0])]
    return pd.DataFrame(rows, columns=["is_leaf", "x", "y", "height", "size"])


def _reciprocal(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs (a < b) of clusters that are each other's nearest, with their mean similarity, sizes and which stands first."""
    side = lambda k: state.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("value").alias(f"value_{k}"))
    d = edges.join(side("a"), "a").join(side("b"), "b")
    d = d.withColumn("mean", F.col("s").cast("double") / UNIT / (F.col("size_a") * F.col("size_b")))
    # one number for a pair, whichever end looks: so the best pair of all is always mutual
    rank = F.struct(F.col("mean"), -F.col("a"), -F.col("b"))
    ends = d.select(F.explode(F.array("a", "b")).alias("node"), F.struct("a", "b", "mean", "size_a", "size_b", "value_a", "value_b").alias("pair"), rank.alias("rank"))
    best = ends.groupBy("node").agg(F.max_by("pair", "rank").alias("pair"))
    mutual = best.groupBy("pair.a", "pair.b").agg(F.count(F.lit(1)).alias("n"), F.first("pair").alias("pair")).where("n = 2")
    return mutual.select("pair.*").withColumn("a_first", F.col("value_a") <= F.col("value_b"))


def _unlike(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, begin) of the clusters left and the merges at height 1 that join them one by one, by scans of their sizes and values."""
    d = ordered_scan(state, [F.col("node")], {"sizes": F.col("size"), "values": F.col("value").cast("double")}, place="k")
    before, earlier = F.col("sizes") - F.col("size"), F.col("values") - F.col("value").cast("double")
    d = d.withColumns({"before": before, "after": (F.col("k") == 1) | (earlier <= F.col("value").cast("double"))})  # stands behind those joined so far
    d = ordered_scan(d, [F.col("k")], {"ahead": F.when(~F.col("after"), F.col("size")).otherwise(0)}, place="k2")
    begin = F.when(F.col("after"), F.col("before")).otherwise(0) + F.col("ahead_total") - F.col("ahead")
    first = d.agg(F.min("node").alias("a"))
    joined = d.where("k > 1").crossJoin(F.broadcast(first))  # one row
    joined = joined.select("a", F.col("node").alias("b"), F.lit(0.0).alias("mean"), F.col("before").alias("size_a"), F.col("size").alias("size_b"))
    return d.select("node", begin.alias("begin")), joined
