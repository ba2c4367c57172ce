"""Communities of a weighted graph by the two-level map equation, as joins.

The description length of a random walk under a partition depends on each
module's visit rate and exit rate only, so the gain of any move of a node is
a formula over sums that a join brings together.  Every round applies the
best moves that touch no common module; modules that are settled become nodes
of a smaller graph, and single nodes are tried again in the end.  Only counts
and lengths pass the driver.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._shared import written

EPS = 1e-11
SMALL = 100_000  # links, both ways, that one task settles faster than rounds of joins do


def _plogp(x: Column) -> Column:
    return F.when(x > 1e-15, x * F.log2(F.when(x > 1e-15, x))).otherwise(0.0)


def _graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, p, leaves), links (a, b, w), both ways, without loops) with rates that sum to one."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w")).where("a != b and w > 0")
    e = e.groupBy("a", "b").agg(F.sum("w").alias("w"))
    total = e.agg(F.sum("w").alias("total"))
    e = e.crossJoin(F.broadcast(total)).select("a", "b", (F.col("w") / (2 * F.col("total"))).alias("w"))  # one row
    links = written(e.union(e.select("b", "a", "w")), "map-links")
    p = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("p"))
    return written(p.withColumn("away", F.col("p")), "map-nodes"), links


def _modules(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, module, w) links of nodes to modules, (module, pm, qm, size) rates of modules)."""
    own = nodes.select(F.col("node").alias("a"), F.col("module").alias("from"))
    to = links.join(nodes.select(F.col("node").alias("b"), "module"), "b").groupBy("a", "module").agg(F.sum("w").alias("w"))
    to = to.join(own, "a").select(F.col("a").alias("node"), "from", "module", "w")
    inside = to.where(F.col("from") == F.col("module")).groupBy("module").agg(F.sum("w").alias("inner"))
    m = nodes.groupBy("module").agg(F.sum("p").alias("pm"), F.sum("away").alias("out"), F.count(F.lit(1)).alias("size")).join(inside, "module", "left")
    return to, m.select("module", "pm", F.greatest(F.col("out") - F.coalesce("inner", F.lit(0.0)), F.lit(0.0)).alias("qm"), "size")


def description_length(modules: DataFrame) -> float:
    """Length of a step in bits, but for the nodes' own entropy, which no partition changes."""
    q = F.sum("qm")
    row = modules.agg((_plogp(q) - 2 * F.sum(_plogp(F.col("qm"))) + F.sum(_plogp(F.col("qm") + F.col("pm")))).alias("length")).first()
    return row["length"] if row["length"] is not None else 0.0


def _moves(nodes: DataFrame, to: DataFrame, modules: DataFrame) -> DataFrame:
    """(node, from, into, gain) of every move that shortens the description by itself."""
    m = lambda k: modules.select(F.col("module").alias(k), F.col("pm").alias(f"p_{k}"), F.col("qm").alias(f"q_{k}"), F.col("size").alias(f"n_{k}"))
    stay = to.where(F.col("from") == F.col("module")).select("node", F.col("w").alias("w_from"))
    go = to.where(F.col("from") != F.col("module")).select("node", F.col("module").alias("into"), F.col("w").alias("w_into"))
    alone = nodes.select("node", (-F.col("node") - 1).alias("into"), F.lit(0.0).alias("w_into"))
    d = go.unionByName(alone).join(nodes.select("node", F.col("module").alias("from"), "p", "away"), "node")
    d = d.where("from != into").join(stay, "node", "left").join(m("from"), "from").join(m("into"), "into", "left")
    d = d.where("n_from > 1 or n_into is not null").crossJoin(F.broadcast(modules.agg(F.sum("qm").alias("q"))))  # one row
    c = {k: F.coalesce(k, F.lit(0.0)) for k in ("w_from", "p_into", "q_into")}
    # rates of both modules after the move
    q1 = F.greatest(F.col("q_from") - F.col("away") + 2 * c["w_from"], F.lit(0.0))
    q2 = F.greatest(c["q_into"] + F.col("away") - 2 * F.col("w_into"), F.lit(0.0))
    p1, p2 = F.col("p_from") - F.col("p"), c["p_into"] + F.col("p")
    q = F.greatest(F.col("q") - F.col("q_from") - c["q_into"] + q1 + q2, F.lit(0.0))
    before = _plogp(F.col("q")) - 2 * (_plogp(F.col("q_from")) + _plogp(c["q_into"])) + _plogp(F.col("q_from") + F.col("p_from")) + _plogp(c["q_into"] + c["p_into"])
    after = _plogp(q) - 2 * (_plogp(q1) + _plogp(q2)) + _plogp(q1 + p1) + _plogp(q2 + p2)
    return d.select("node", "from", "into", (before - after).alias("gain")).where(F.col("gain") > EPS)


def _settle(nodes: DataFrame, links: DataFrame, length: float) -> tuple[DataFrame, float]:
    """Rounds of moves until none shortens the description."""
    while True:
        to, modules = _modules(nodes, links)
        moves = written(_moves(nodes, to, modules), "map-moves")
        order = F.struct(F.round("gain", 12), -F.col("node"), -F.col("into"))
        touch = moves.select("*", F.explode(F.array("from", "into")).alias("module"))
        best = touch.groupBy("module").agg(F.max_by(F.struct("node", "into"), order).alias("m"))
        chosen = best.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("m.*")
        one = moves.orderBy(F.desc(F.round("gain", 12)), "node", "into").limit(1).select("node", "into")
        for pick in (chosen, one):  # several moves share the rate of all exits only; if they do not add up, the best alone does
            moved = nodes.join(pick, "node", "left").select("node", "p", "away", F.coalesce("into", "module").alias("module"))
            moved = written(moved, "map-nodes")
            now = description_length(_modules(moved, links)[1])
            if now < length - EPS:
                break
        else:
            return nodes, length
        nodes, length = moved, now


class _Walk:
    """The same moves in one task: nodes with rates, links as dictionaries, one module label each."""

    def __init__(self, p: dict, away: dict, near: dict, module: dict):
        self.p, self.away, self.near, self.module = p, away, near, dict(module)
        self.pm: dict = {}
        self.qm: dict = {}
        self.size: dict = {}
        for n, m in self.module.items():
            self.pm[m] = self.pm.get(m, 0.0) + p[n]
            self.size[m] = self.size.get(m, 0) + 1
            cross = away[n] - sum(w for x, w in near[n].items() if self.module[x] == m)
            self.qm[m] = self.qm.get(m, 0.0) + max(0.0, cross)

    @staticmethod
    def h(x: float) -> float:
        return x * math.log2(x) if x > 1e-15 else 0.0

    def length(self) -> float:
        return self.h(sum(self.qm.values())) + sum(self.h(self.qm[m] + self.pm[m]) - 2 * self.h(self.qm[m]) for m in self.pm)

    def settle(self) -> bool:
        """Move single nodes, in order, until none shortens the description; did any?"""
        h, changed, moved = self.h, False, True
        while moved:
            moved = False
            for n in sorted(self.p):
                own, to = self.module[n], {}
                for x, w in self.near[n].items():
                    to[self.module[x]] = to.get(self.module[x], 0.0) + w
                inner, q = to.pop(own, 0.0), sum(self.qm.values())
                if self.size[own] > 1:
                    to[-n - 1] = 0.0
                best, pick = EPS, None
                q1, p1 = max(0.0, self.qm[own] - self.away[n] + 2 * inner), self.pm[own] - self.p[n]
                for m in sorted(to):
                    qb, pb = self.qm.get(m, 0.0), self.pm.get(m, 0.0)
                    q2, p2 = max(0.0, qb + self.away[n] - 2 * to[m]), pb + self.p[n]
                    now = max(0.0, q - self.qm[own] - qb + q1 + q2)
                    gain = h(q) - 2 * (h(self.qm[own]) + h(qb)) + h(self.qm[own] + self.pm[own]) + h(qb + pb) - h(now) + 2 * (h(q1) + h(q2)) - h(q1 + p1) - h(q2 + p2)
                    if gain > best:
                        best, pick = gain, (m, q2, p2)
                if pick:
                    m, q2, p2 = pick
                    self.qm[own], self.pm[own], self.qm[m], self.pm[m] = q1, p1, q2, p2
                    self.size[own], self.size[m] = self.size[own] - 1, self.size.get(m, 0) + 1
                    if not self.size[own]:
                        del self.size[own], self.qm[own], self.pm[own]
                    self.module[n], moved, changed = m, True, True
        return changed

    def above(self) -> _Walk:
        """Modules as nodes, each its own module."""
        near: dict = {m: {} for m in self.pm}
        for n, links in self.near.items():
            for x, w in links.items():
                a, b = self.module[n], self.module[x]
                if a != b:
                    near[a][b] = near[a].get(b, 0.0) + w
        return _Walk(self.pm, self.qm, near, {m: m for m in self.pm})


def _small(links: pd.DataFrame, cycles: int) -> pd.DataFrame:
    """(node, module, bits) of a graph that fits a task, by the moves of :func:`map_equation` one at a time."""
    near: dict = {}
    for a, b, w in zip(links["a"].tolist(), links["b"].tolist(), links["w"].tolist(), strict=True):
        near.setdefault(a, {})[b] = w
    p = {n: sum(x.values()) for n, x in near.items()}
    walk = _Walk(p, p, near, {n: n for n in p})
    for _ in range(cycles):
        changed, level = walk.settle(), walk
        while (up := level.above()).settle():
            walk, level, changed = _Walk(p, p, near, {n: up.module[m] for n, m in walk.module.items()}), up, True
        if not changed:
            break
    whole = _Walk(p, p, near, dict.fromkeys(p, 0))
    if whole.length() < walk.length() - EPS:
        walk = whole
    first: dict = {}
    for n in sorted(p):
        first.setdefault(walk.module[n], n)
    bits = walk.length() - sum(map(walk.h, p.values()))
    return pd.DataFrame({"node": sorted(p), "module": [first[walk.module[n]] for n in sorted(p)], "bits": bits})


def map_equation(edges: DataFrame, cycles: int = 8, small: int = SMALL) -> tuple[DataFrame, float]:
    """((node, module), description length in bits) of the undirected weighted ``edges`` (a, b, w).

    Nodes are whole numbers from 0; loops and edges without weight are left
    out, repeated edges add up; a graph without edges has no nodes.  A module
    is named by its smallest node.  The result is a partition that no move of
    a node or a module shortens, or all nodes in one module if that is shorter.
    Graphs of up to ``small`` links are settled by one task, in which moves
    follow each other; among equally short partitions the two may differ.
    """
    base, links = _graph(edges)
    n = links.count()
    if not n:
        return base.select("node", F.col("node").alias("module")), 0.0
    if n <= small:
        got = written(links.groupBy(F.lit("all").alias("all")).applyInPandas(lambda pdf: _small(pdf.sort_values(["a", "b"]), cycles), "node long, module long, bits double"), "map-small")
        return got.select("node", "module"), got.first()["bits"]
    nodes = base.withColumn("module", F.col("node"))
    length = description_length(_modules(nodes, links)[1])
    for _ in range(cycles):
        start = length
        nodes, length = _settle(nodes, links, length)
        level, level_links = nodes, links
        while True:  # modules become nodes
            to, modules = _modules(level, level_links)
            up = written(modules.select(F.col("module").alias("node"), F.col("pm").alias("p"), F.col("qm").alias("away"), F.col("module").alias("module")), "map-nodes")
            owner = level.select(F.col("node"), F.col("module").alias("top"))
            e = level_links.join(owner.select(F.col("node").alias("a"), F.col("top").alias("ta")), "a").join(owner.select(F.col("node").alias("b"), F.col("top").alias("tb")), "b")
            level_links = written(e.where("ta != tb").groupBy(F.col("ta").alias("a"), F.col("tb").alias("b")).agg(F.sum("w").alias("w")), "map-links")
            up, now = _settle(up, level_links, length)
            if now >= length - EPS:
                break
            length, level = now, up
            nodes = written(nodes.join(up.select(F.col("node").alias("module"), F.col("module").alias("top")), "module").select("node", "p", "away", F.col("top").alias("module")), "map-nodes")
        if length >= start - EPS:
            break
    whole = nodes.withColumn("module", F.lit(0).cast("long"))
    together = description_length(_modules(whole, links)[1])
    if together < length - EPS:
        nodes, length = whole, together
    name = nodes.groupBy("module").agg(F.min("node").alias("name"))
    entropy = base.agg(F.sum(_plogp(F.col("p")))).first()[0]
    return nodes.join(name, "module").select("node", F.col("name").alias("module")), length - entropy
