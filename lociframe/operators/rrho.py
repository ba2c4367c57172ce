"""Rank-rank hypergeometric overlap.

All pairs of prefixes of two ranked lists are counted at once: each item
falls into one bucket of the (rank1, rank2) grid and a two-dimensional
running sum gives every overlap, O(items + cells) instead of one scan of the
lists for each cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import _validate as check
from ..functions import kernels
from ..functions.columns import p_adjust
from ..functions.draws import spread, uniform
from .scan import average_ranks, ordered_scan


def shared_ranks(list1: DataFrame, list2: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """(item, value1, value2, rank1, rank2) of the items in both lists; nulls are left out, ranks are by descending value, ties by item."""
    one, two = (d.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(item).alias("item"), F.col(value).cast("double").alias(v)).dropDuplicates(["item"]) for d, v in ((list1, "value1"), (list2, "value2")))
    d = one.join(two, "item")
    for k in (1, 2):
        d = ordered_scan(d, [-F.col(f"value{k}"), F.col("item")], place=f"rank{k}")
    return d


@dataclass
class Rrho:
    """Ranks, the grid of cells and its parameters."""

    ranks: DataFrame
    cells: DataFrame
    n: int
    step: int
    log_base: float
    params: dict = field(default_factory=dict)

    def __repr__(self) -> str:
        g = self.n // self.step
        return f"Rrho({self.n} items, step {self.step}, {g} x {g} cells, log base {self.log_base:g})"


def default_step(n: int) -> int:
    return 1 if n <= 5000 else int(n / 100)


def overlap_counts(ranks: DataFrame, n: int, step: int, by: str | None = None, values: DataFrame | None = None) -> DataFrame:
    """([by,] i, j, overlap) for i, j = step, 2 step, .. <= n: items among the first i of list 1 and the first j of list 2.

    With ``by`` there is a grid for each of its ``values``, a table of that column alone.
    """
    g = n // step
    own = [by] if by else []
    bucket = lambda r: F.ceil(F.col(r) / step).cast("int")
    hits = ranks.select(*own, bucket("rank1").alias("a"), bucket("rank2").alias("b")).where((F.col("a") <= g) & (F.col("b") <= g)).groupBy(*own, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    axis = F.sequence(F.lit(1), F.lit(g))
    grid = (values if by else ranks.sparkSession.range(1).select()).withColumn("a", F.explode(axis)).withColumn("b", F.explode(axis))  # the cells are the result
    d = grid.join(hits, [*own, "a", "b"], "left").select(*own, "a", "b", F.coalesce("n", F.lit(0)).alias("n"))
    along = d.withColumn("n", F.sum("n").over(Window.partitionBy(*own, "a").orderBy("b")))
    both = along.withColumn("n", F.sum("n").over(Window.partitionBy(*own, "b").orderBy("a")))
    return both.select(*own, (F.col("a") * step).alias("i"), (F.col("b") * step).alias("j"), F.col("n").cast("long").alias("overlap"))


def metrics(cells: DataFrame, n: int, log_base: float) -> DataFrame:
    """``cells`` (i, j, overlap, ..) with sign, log_p and metric: each cell of the grid tabulates its distribution once for all its rows."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in cells.dtypes), "sign int, log_p double"])

    def run(key, pdf):
        log_p, sign = kernels.hypergeometric_tails(pdf["overlap"].to_numpy(), int(key[1]), int(key[0]), n)
        return pdf.assign(sign=sign.astype("int32"), log_p=log_p)

    d = cells.groupBy("i", "j").applyInPandas(run, schema)
    return d.withColumn("metric", F.col("sign") * F.abs("log_p") / float(np.log(log_base)))


def run_rrho(list1: DataFrame, list2: DataFrame, stepsize: int | None = None, log_base: float = 10.0, item: str = "item", value: str = "value") -> Rrho:
    """Signed hypergeometric overlap of every pair of prefixes.

    Cells have i, j, overlap, sign (+1 over-, -1 under-enriched; a tie is
    under), log_p (natural), pvalue, metric (sign |log_p| in ``log_base``) and
    the directions of both lists at the cell (up: value > 0).
    """
    ranks = shared_ranks(list1, list2, item, value)
    n = ranks.count()
    if n == 0:
        raise ValueError("the lists share no items")
    step = stepsize or default_step(n)
    check.number(step, "stepsize", 1, n)

    @F.pandas_udf("log_p double, sign int")
    def test(count: pd.Series, m: pd.Series, k: pd.Series) -> pd.DataFrame:
        lf = kernels.LogFactorial(n)
        p, s = kernels.hypergeometric_log_p(count.to_numpy(), m.to_numpy(), k.to_numpy(), n, lf)
        return pd.DataFrame({"log_p": p, "sign": s.astype("int32")})

    d = overlap_counts(ranks, n, step).withColumn("_t", test("overlap", F.col("j").cast("long"), F.col("i").cast("long")))
    d = d.select("i", "j", "overlap", F.col("_t.sign").alias("sign"), F.col("_t.log_p").alias("log_p"), F.exp("_t.log_p").alias("pvalue"), (F.col("_t.sign") * F.abs("_t.log_p") / float(np.log(log_base))).alias("metric"))
    side = lambda k: ranks.select(F.col(f"rank{k}").alias("ij"[k - 1]), F.when(F.col(f"value{k}") <= 0, "down").otherwise("up").alias(f"dir{k}"))
    d = d.join(side(1), "i").join(side(2), "j")
    return Rrho(ranks, d, n, step, log_base)


def sig_spot(r: Rrho) -> DataFrame:
    """Distinct (metric, pvalue, dir1, dir2) of the cells that reach the largest metric."""
    top = r.cells.agg(F.max("metric").alias("top"))
    return r.cells.join(F.broadcast(top), F.col("metric") == F.col("top")).select("metric", "pvalue", "dir1", "dir2").distinct()


def _quadrant(q: str) -> tuple[str, str]:
    a, _, b = q.partition("-")
    check.choice(a, ("up", "down"), "quadrant")
    check.choice(b, ("up", "down"), "quadrant")
    return a, b


def sig_cells(r: Rrho, quadrants=("up-up", "down-down", "up-down", "down-up")) -> DataFrame:
    """The cell of each quadrant with the strongest metric (largest where directions agree, smallest where they differ).

    Ties go to the larger overlap, then to the smaller j and i; a quadrant
    without a metric of the right sign has no row.
    """
    q = F.concat_ws("-", "dir1", "dir2")
    strength = F.when(F.col("dir1") == F.col("dir2"), F.col("metric")).otherwise(-F.col("metric"))
    d = r.cells.withColumn("quadrant", q).withColumn("_s", strength).where(F.col("quadrant").isin(*quadrants) & (F.col("_s") > 0))
    best = F.max_by(F.struct("i", "j", "overlap", "metric", "pvalue"), F.struct("_s", "overlap", -F.col("j"), -F.col("i"))).alias("b")
    return d.groupBy("quadrant").agg(best).select("quadrant", "b.*")


def sig_items(r: Rrho, quadrants=("up-up", "down-down", "up-down", "down-up")) -> DataFrame:
    """(quadrant, item, in_list1, in_list2, common): items on the significant side of each quadrant's cell."""
    cell = sig_cells(r, quadrants)
    d = r.ranks.crossJoin(F.broadcast(cell))  # at most four cells
    up1, up2 = F.split("quadrant", "-")[0] == "up", F.split("quadrant", "-")[1] == "up"
    in1 = F.when(up1, F.col("rank1") <= F.col("i")).otherwise(F.col("rank1") >= F.col("i"))
    in2 = F.when(up2, F.col("rank2") <= F.col("j")).otherwise(F.col("rank2") >= F.col("j"))
    return d.select("quadrant", "item", in1.alias("in_list1"), in2.alias("in_list2"), (in1 & in2).alias("common")).where("in_list1 or in_list2")


def correct_pvalues(r: Rrho, method: str = "BY") -> DataFrame:
    """Cells with pvalue_adj over all cells."""
    return p_adjust(r.cells, "pvalue", method, "pvalue_adj")


def _strongest(cells: DataFrame, quadrants, by: Sequence[str] = ()) -> DataFrame:
    """([by,] statistic): the largest |metric|, or the sum of the quadrants' largest metrics of their sign."""
    if quadrants == "all":
        return cells.groupBy(*by).agg(F.max(F.abs("metric")).alias("statistic"))
    sign = 1 if all(q in ("up-up", "down-down") for q in quadrants) else -1
    best = cells.where(F.concat_ws("-", "dir1", "dir2").isin(*quadrants)).groupBy(*by, "dir1", "dir2").agg(F.max(F.col("metric") * sign).alias("m"))
    return best.groupBy(*by).agg(F.sum("m").alias("statistic"))


def permuted_ranks(r: Rrho, perm: int, seed: int = 1, rows_per_task: int = 50_000) -> DataFrame:
    """(perm_id, rank1, rank2): list 1 against ``perm`` random orders of list 2.

    A permutation orders the items by the draws of (seed, permutation, item).
    Draws are uniform, so equal slices of [0, 1) hold about ``rows_per_task``
    items each; a slice is ordered by itself and starts where the counts of
    those below end.
    """
    slices = max(1, -(-r.n // rows_per_task))
    d = spread(r.ranks.select("item", F.col("rank1")), "item").withColumn("perm_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(perm - 1).cast("long"))))
    d = d.withColumn("u", uniform(seed, F.col("perm_id"), F.col("item"))).withColumn("slice", F.floor(F.col("u") * slices).cast("int"))
    place = F.row_number().over(Window.partitionBy("perm_id", "slice").orderBy("u", "item"))
    if slices == 1:
        return d.select("perm_id", "rank1", place.alias("rank2"))
    n = d.groupBy("perm_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("perm_id").orderBy("slice")
    before = n.select("perm_id", "slice", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    d = d.withColumn("place", place).join(before, ["perm_id", "slice"])
    return d.select("perm_id", "rank1", (F.col("place") + F.col("before")).alias("rank2"))


def permutation_pvalue(r: Rrho, perm: int = 200, quadrants=("up-up", "down-down"), seed: int = 1) -> dict:
    """{statistic, pvalue, permuted} of :func:`permutation_test`, the first two as numbers."""
    summary, permuted = permutation_test(r, perm, quadrants, seed)
    row = summary.first()
    return {"statistic": row["statistic"], "pvalue": row["pvalue"], "permuted": permuted}


def permutation_test(r: Rrho, perm: int = 200, quadrants=("up-up", "down-down"), seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((statistic, pvalue), (perm_id, statistic)): sum of the quadrants' maxima against ``perm`` random orders.

    Directions of a cell stay those of the lists at its ranks; p = 1 -
    min(ecdf(statistic) + 1 / perm, 1).  Both tables are lazy and nothing
    passes the driver.
    """
    if quadrants != "all":
        for q in quadrants:
            _quadrant(q)
    if quadrants != "all" and not (all(q in ("up-up", "down-down") for q in quadrants) or all(q in ("up-down", "down-up") for q in quadrants)):
        raise ValueError("quadrants must be all, or agree in direction, or differ in direction")
    ids = r.ranks.sparkSession.range(perm).select(F.col("id").alias("perm_id"))
    cells = metrics(overlap_counts(permuted_ranks(r, perm, seed), r.n, r.step, "perm_id", ids), r.n, r.log_base)
    permuted = _strongest(cells.join(r.cells.select("i", "j", "dir1", "dir2"), ["i", "j"]), quadrants, ["perm_id"])
    # a quadrant without cells adds nothing; without any, every statistic is 0
    permuted = ids.join(permuted, "perm_id", "left").select("perm_id", F.coalesce("statistic", F.lit(0.0)).alias("statistic"))
    actual = _strongest(r.cells, quadrants).select(F.coalesce("statistic", F.lit(0.0)).alias("actual"))
    below = permuted.crossJoin(F.broadcast(actual)).agg(F.first("actual").alias("statistic"), F.avg((F.col("statistic") <= F.col("actual") + 1e-9).cast("double")).alias("below"))  # one row
    return below.select("statistic", (1 - F.least(F.col("below") + 1 / perm, F.lit(1.0))).alias("pvalue")), permuted


def heatmap(r: Rrho) -> DataFrame:
    """Plot-ready cells: x along list 1, y along list 2 from the bottom, the metric, and where directions change."""
    return r.cells.select((F.col("i") / r.step).cast("int").alias("x"), (F.lit(r.n // r.step) + 1 - F.col("j") / r.step).cast("int").alias("y"), "metric", "dir1", "dir2")


def dots(r: Rrho, type: str = "normal") -> DataFrame:
    """(item, list1, list2): values, or average ranks from the smallest."""
    check.choice(type, ("normal", "rank"), "type")
    if type == "normal":
        return r.ranks.select("item", F.col("value1").alias("list1"), F.col("value2").alias("list2"))
    d = average_ranks(average_ranks(r.ranks, "value1", "list1"), "value2", "list2")
    return d.select("item", "list1", "list2")
