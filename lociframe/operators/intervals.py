"""Interval algebra on closed, 1-based ranges: point and overlap joins, merging, overlap checks.

Joins are equi-joins on the chromosome (and other keys) and a bin of the
position, with the exact comparison as residual condition: Spark can shuffle,
broadcast or skew-split them like any hash join, and never falls back to a
nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import _validate as check
from .sweep import sweep_join

MANY = 256  # ranges of a key, beyond which every point would be compared with too many


def _on(left: str, right: str, keys: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in keys:
        cond = cond & (F.col(f"{left}.`{a}`") == F.col(f"{right}.`{b}`"))
    return cond


def bins(start: Column, end: Column, width: int) -> Column:
    """Numbers of the bins that [start, end] touches."""
    first, last = F.floor(start / width).cast("long"), F.floor(end / width).cast("long")
    return F.sequence(first, F.greatest(first, last))


def point_join(points: DataFrame, ranges: DataFrame, keys: Sequence[tuple[str, str]], pos: str, start: str = "start", end: str = "end", how: str = "left", bin_width: int | None = None) -> DataFrame:
    """Points with the ranges that hold them (start <= pos <= end) and equal keys.

    Every column of both sides is returned; a point column that clashes with
    one of ``ranges`` (keys aside) gets the prefix ``i_``.  ``bin_width`` adds
    an equi-key of position bins for ranges that are many for each key.
    """
    check.columns(points, [a for a, _ in keys] + [pos], "points")
    check.columns(ranges, [b for _, b in keys] + [start, end], "ranges")
    shared = {b for a, b in keys if a == b}
    left = points.select([F.col(c).alias(f"i_{c}" if c in ranges.columns and c not in shared else c) for c in points.columns])
    ren = {c: (f"i_{c}" if c in ranges.columns and c not in shared else c) for c in points.columns}
    keys = [(ren[a], b) for a, b in keys]
    p, r = left.alias("p"), ranges.alias("r")
    at = F.col(f"p.`{ren[pos]}`")
    cond = _on("p", "r", keys) & (F.col(f"r.`{start}`") <= at) & (F.col(f"r.`{end}`") >= at)
    if bin_width:
        p = left.withColumn("_bin", F.floor(F.col(f"`{ren[pos]}`") / bin_width).cast("long")).alias("p")
        r = ranges.withColumn("_bin", F.explode(bins(F.col(start), F.col(end), bin_width))).alias("r")
        cond = cond & (F.col("p._bin") == F.col("r._bin"))
    out = p.join(r, cond, how)
    return out.select(*[F.col(f"p.`{c}`") for c in left.columns], *[F.col(f"r.`{c}`") for c in ranges.columns if c not in shared])


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[tuple[str, str]], a_range: tuple[str, str], b_range: tuple[str, str], how: str = "inner", bin_width: int | None = None) -> DataFrame:
    """Pairs of ranges that share a position, with the columns ``hit_start`` and ``hit_end`` of what they share.

    Columns of both sides must not clash.  With ``bin_width`` a pair is made
    in the first bin both touch only, so that none repeats.
    """
    x, y = a.alias("a"), b.alias("b")
    s1, e1, s2, e2 = (F.col(f"a.`{a_range[0]}`"), F.col(f"a.`{a_range[1]}`"), F.col(f"b.`{b_range[0]}`"), F.col(f"b.`{b_range[1]}`"))
    cond = _on("a", "b", keys) & (s1 <= e2) & (e1 >= s2)
    if bin_width:
        x = a.withColumn("_bin", F.explode(bins(F.col(a_range[0]), F.col(a_range[1]), bin_width))).alias("a")
        y = b.withColumn("_bin", F.explode(bins(F.col(b_range[0]), F.col(b_range[1]), bin_width))).alias("b")
        cond = cond & (F.col("a._bin") == F.col("b._bin")) & (F.col("a._bin") == F.floor(F.greatest(s1, s2) / bin_width).cast("long"))
    out = x.join(y, cond, how)
    drop = {k for _, k in keys if k in a.columns}
    cols = [F.col(f"a.`{c}`") for c in a.columns]
    if how not in ("left_semi", "left_anti"):
        cols += [F.col(f"b.`{c}`") for c in b.columns if c not in drop]
        cols += [F.greatest(s1, s2).alias("hit_start"), F.least(e1, e2).alias("hit_end")]
    return out.select(cols)


def reduce_ranges(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merge overlapping and adjacent ranges of each group: gaps and islands over a running maximum."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def extend(df: DataFrame, by: int, start: str = "start", end: str = "end") -> DataFrame:
    return df.withColumns({start: F.col(start) - by, end: F.col(end) + by})


def overlaps_within(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows that overlap an earlier range of their group."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reach", F.max(end).over(w)).where(F.col("_reach") >= F.col(start)).drop("_reach")


def _crowding(ranges: DataFrame, keys: Sequence[str], start: str, end: str) -> tuple[bool, int]:
    """(do ranges of one key overlap, how many has a key at most), in one pass."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    got = ranges.withColumns({"_over": reach >= F.col(start), "_n": F.row_number().over(w)}).agg(F.max(F.coalesce("_over", F.lit(False))), F.max("_n")).first()
    return bool(got[0]), got[1] or 0


def identify_mut_cn(mut: DataFrame, cnv: DataFrame, on_patient=None, on_sample=None, on_chr="chr", mut_pos: str = "pos", start_field: str = "start", end_field: str = "end", nomatch: str | None = None, on_multi: str = "error", mut_id: str | None = None, bin_width: int | None = None, sweep: bool | None = None) -> DataFrame:
    """Each mutation with the copy-number segment that holds it.

    Keys are names or (mutation name, segment name) pairs.  Mutations without
    a segment are dropped, or kept with nulls if ``nomatch`` is "NA"
    (:func:`unmatched` counts them).  Several segments for one mutation fail
    the query (``on_multi`` "error"), give nulls ("null") or stay ("keep").
    Null keys or bounds in ``cnv`` match nothing.  ``mut_id`` names a unique
    column; else rows are numbered.

    Only where segments of one key overlap can a mutation have several: that
    is looked up once in ``cnv``, the small side, and without overlaps the
    join is all there is: a hash join on the keys, or where a key has more
    than ``MANY`` segments a sorted sweep (``sweep`` says which; default: by
    that count, read with the overlaps).
    """
    check.choice(on_multi, ("error", "null", "keep"), "on_multi")
    keys = [k for k in (check.key_pair(on_patient), check.key_pair(on_sample), check.key_pair(on_chr)) if k]
    how = "inner" if nomatch is None and on_multi != "null" else "left"
    group = [b for _, b in keys]
    bounded = cnv.select(*dict.fromkeys([*group, start_field, end_field])).dropna()
    overlapping, most = _crowding(bounded, group, start_field, end_field)
    if not overlapping and not bin_width and (most > MANY if sweep is None else sweep):
        return sweep_join(mut, cnv, keys, mut_pos, start_field, end_field, "inner" if nomatch is None else "left")
    if on_multi == "keep" or not overlapping:
        return point_join(mut, cnv, keys, mut_pos, start_field, end_field, "inner" if nomatch is None else "left", bin_width)
    row = mut_id or "_row"
    m = mut if mut_id else mut.withColumn("_row", F.monotonically_increasing_id())
    out = point_join(m, cnv.withColumn("_seg", F.lit(1)), keys, mut_pos, start_field, end_field, how, bin_width)
    n = F.count("_seg").over(Window.partitionBy(row))
    if on_multi == "error":
        out = out.withColumn("_n", n)
        out = out.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several segments hold mutation "), F.col(row).cast("string")))).otherwise(F.lit(True)).cast("boolean"))
    else:
        cnv_cols = [c for c in out.columns if c in cnv.columns and c not in {b for a, b in keys if a == b}]
        out = out.withColumn("_n", n).withColumns({c: F.when(F.col("_n") <= 1, F.col(c)) for c in [*cnv_cols, "_seg"]})
        out = out.dropDuplicates([row])
        if nomatch is None:
            out = out.where("_seg is not null")
    return out.drop("_seg", "_n", *([] if mut_id else ["_row"]))


def unmatched(mut: DataFrame, cnv: DataFrame, on_patient=None, on_sample=None, on_chr="chr", mut_pos: str = "pos", start_field: str = "start", end_field: str = "end", bin_width: int | None = None) -> DataFrame:
    """The mutations that no segment holds, with all their columns."""
    keys = [k for k in (check.key_pair(on_patient), check.key_pair(on_sample), check.key_pair(on_chr)) if k]
    p, r = mut.alias("p"), cnv.select(*dict.fromkeys([*[b for _, b in keys], start_field, end_field])).alias("r")
    at = F.col(f"p.`{mut_pos}`")
    cond = _on("p", "r", keys) & (F.col(f"r.`{start_field}`") <= at) & (F.col(f"r.`{end_field}`") >= at)
    if bin_width:
        p = mut.withColumn("_bin", F.floor(F.col(mut_pos) / bin_width).cast("long")).alias("p")
        r = cnv.withColumn("_bin", F.explode(bins(F.col(start_field), F.col(end_field), bin_width))).alias("r")
        cond = cond & (F.col("p._bin") == F.col("r._bin"))
    return p.join(r, cond, "left_anti").select(*mut.columns)
