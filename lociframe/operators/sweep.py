"""Sorted sweep of points over ranges: one merge for each cell of a key, without bins to choose.

Keys with many points are cut at quantiles of their positions into cells of
about ``rows_per_cell`` points; a range is copied to the cells it touches and
nowhere else.  Inside a cell points and ranges are sorted together and each
point looks back to the last range that began: work grows with the rows, not
with points times ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import _validate as check

SAMPLE = 1 << 16  # rows that cuts are taken from
CUTS = 4096  # of a key, at most


def _bisect(cuts: Column, x: Column, ties_below: bool) -> Column:
    """How many of the sorted ``cuts`` are below ``x`` (or equal, with ``ties_below``)."""
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.call_function("div", a["lo"] + a["hi"], F.lit(2)).cast("int")
        at = F.get(cuts, mid)
        up = (a["lo"] < a["hi"]) & ((at <= x) if ties_below else (at < x))
        return F.struct(F.when(up, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(up | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(CUTS.bit_length())), start, halve)["lo"]


def cell_cuts(points: DataFrame, key: str, pos: str, rows_per_cell: int, seed: int = 1) -> DataFrame:
    """(key, cuts) of the keys that hold more than ``rows_per_cell`` points: quantiles of a bounded sample.

    Equal cuts are kept: they part the points of one crowded position.
    """
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = points.select(key, pos) if share == 1 else points.select(key, pos).sample(share, seed).limit(2 * SAMPLE)
    d = some.groupBy(key).agg(F.sort_array(F.collect_list(F.col(pos).cast("long"))).alias("_at"))
    cells = F.least(F.ceil(F.size("_at") / share / rows_per_cell), F.lit(CUTS)).cast("int")
    cut = lambda i: F.get("_at", F.floor(i * F.size("_at") / F.col("_cells")).cast("int"))
    d = d.withColumn("_cells", cells).where(F.col("_cells") > 1)
    d = d.select(key, F.transform(F.sequence(F.lit(1), F.col("_cells") - 1), cut).alias("_cuts"))
    kind = d.schema
    return points.sparkSession.createDataFrame(d.collect(), kind)  # at most twice SAMPLE numbers, so that both sides use the same


def sweep_join(points: DataFrame, ranges: DataFrame, keys: Sequence[tuple[str, str]], pos: str, start: str = "start", end: str = "end", how: str = "inner", rows_per_cell: int = 200_000) -> DataFrame:
    """Points with the range that holds them (start <= pos <= end), for ranges that are disjoint within each key.

    Columns are those of :func:`intervals.point_join`.  Null keys, positions
    or bounds match nothing.  A range is repeated for the cells it touches; a
    point stands in one cell.
    """
    check.columns(points, [a for a, _ in keys] + [pos], "points")
    check.columns(ranges, [b for _, b in keys] + [start, end], "ranges")
    check.choice(how, ("inner", "left"), "how")
    shared = {b for a, b in keys if a == b}
    ren = {c: (f"i_{c}" if c in ranges.columns and c not in shared else c) for c in points.columns}
    text = lambda names: F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in names]))
    whole = lambda names: F.when(F.lit(True) & ~F.greatest(*[F.col(f"`{c}`").isNull() for c in names], F.lit(False)), text(names))
    p = points.select(F.struct(*[F.col(f"`{c}`").alias(ren[c]) for c in points.columns]).alias("_p"), whole([a for a, _ in keys]).alias("_key"), F.col(f"`{pos}`").cast("long").alias("_at"))
    r = ranges.select(F.struct(*[F.col(f"`{c}`") for c in ranges.columns]).alias("_r"), whole([b for _, b in keys]).alias("_key"), F.col(f"`{start}`").cast("long").alias("_at"), F.col(f"`{end}`").cast("long").alias("_end")).where("_key is not null and _at <= _end")
    cuts = F.broadcast(cell_cuts(p.where("_key is not null and _at is not null"), "_key", "_at", rows_per_cell))
    low, high = lambda x: _bisect(F.col("_cuts"), x, False), lambda x: _bisect(F.col("_cuts"), x, True)
    p = p.join(cuts, "_key", "left").withColumns({"_lo": F.when(F.col("_cuts").isNotNull(), low(F.col("_at"))), "_hi": F.when(F.col("_cuts").isNotNull(), high(F.col("_at")))})
    # a position that is a cut belongs to the cells on both its sides; its points are dealt out by their content
    cell = F.col("_lo") + F.pmod(F.xxhash64("_p"), F.col("_hi") - F.col("_lo") + 1).cast("int")
    p = p.select("_key", F.coalesce(cell, F.lit(0)).alias("_cell"), "_at", F.lit(1).alias("_kind"), "_p")
    touched = F.when(F.col("_cuts").isNotNull(), F.sequence(low(F.col("_at")), high(F.col("_end")))).otherwise(F.array(F.lit(0)))
    r = r.join(cuts, "_key", "left").select("_key", F.explode(touched).alias("_cell"), "_at", F.lit(0).alias("_kind"), "_end", "_r")
    both = r.unionByName(p, allowMissingColumns=True)
    back = Window.partitionBy("_key", "_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("_last", F.last(F.when(F.col("_kind") == 0, F.struct("_end", "_r")), ignorenulls=True).over(back)).where("_kind = 1")
    holds = F.col("_key").isNotNull() & F.col("_at").isNotNull() & (F.col("_last._end") >= F.col("_at"))
    d = d.withColumn("_in", F.when(holds, F.col("_last._r")))
    if how == "inner":
        d = d.where("_in is not null")
    left = [F.col(f"_p.`{ren[c]}`") for c in points.columns]
    return d.select(*left, *[F.col(f"_in.`{c}`") for c in ranges.columns if c not in shared])
