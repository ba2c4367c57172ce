"""Scans over one global order without a task that holds it all.

A table is range-partitioned by its order, each partition gives its totals
(one row), and every row gets its place and running sums from its own
partition plus the totals of those before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._shared import written

ROWS = 100_000  # of a task
PARTS = 4096  # at most, so many totals pass the driver


def ordered_scan(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column] | None = None, previous: Sequence[str] = (), place: str = "place", rows_per_task: int = ROWS) -> DataFrame:
    """``df`` with ``place`` (from 1), running sums and the row before, all in ascending ``order``.

    For each name in ``sums`` there are ``name`` (running, the row's own share
    included) and ``name_total``.  For each column c in ``previous`` there is
    ``prev_c``, null in the first row; ``sums`` may use those columns.  The
    order must be total, or equal rows interchangeable.  Nulls of a sum count
    as nothing.  Up to ``rows_per_task`` rows are ordered by one task; more
    are range-partitioned into a written table, so that places do not depend
    on a second run of the input.  An empty table stays empty.
    """
    sums = dict(sums or {})
    n = df.count()
    parts = min(PARTS, -(-n // rows_per_task))
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    d = df.withColumns(keys)
    if parts > 1:
        d = written(d.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "scan")
    else:
        d = d.withColumn("_part", F.lit(0))
    w = Window.partitionBy("_part").orderBy(*keys)
    own = F.row_number().over(w)
    if previous:
        ends = d.groupBy("_part").agg(F.max_by(F.struct(*previous), F.struct(*keys)).alias("_last"))
        d = d.withColumns({f"prev_{c}": F.lag(c).over(w) for c in previous} | {"_own": own})
        if parts > 1:
            d = _carry_last(d, ends, previous)
    else:
        d = d.withColumn("_own", own)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    if parts > 1:
        d = _carry_sums(d, sums, run, place)
    else:
        every = Window.partitionBy("_part")
        d = d.withColumns({f"_v_{k}": v for k, v in sums.items()})
        d = d.withColumns({place: F.col("_own").cast("long")} | {k: F.coalesce(F.sum(f"_v_{k}").over(run), _zero(d, k)) for k in sums} | {f"{k}_total": F.coalesce(F.sum(f"_v_{k}").over(every), _zero(d, k)) for k in sums})
    return d.drop("_part", "_own", "_before", *keys, *[f"_v_{k}" for k in sums])


def _zero(d: DataFrame, name: str) -> Column:
    kind = d.schema[f"_v_{name}"].dataType.simpleString()
    return F.lit(0).cast("double" if kind in ("double", "float") else "long")


def _carry_last(d: DataFrame, ends: DataFrame, previous: Sequence[str]) -> DataFrame:
    """Give each partition's first row the last row of the partition before."""
    last = sorted(ends.collect(), key=lambda r: r["_part"])  # one row a partition
    carried = [(b["_part"], a["_last"]) for a, b in zip(last, last[1:], strict=False)]
    kind = ends.schema["_last"].dataType.simpleString()
    table = F.broadcast(d.sparkSession.createDataFrame(carried, f"_part int, _last {kind}"))
    d = d.join(table, "_part", "left")
    return d.withColumns({f"prev_{c}": F.when(F.col("_own") == 1, F.col(f"_last.{c}")).otherwise(F.col(f"prev_{c}")) for c in previous}).drop("_last")


def _carry_sums(d: DataFrame, sums: Mapping[str, Column], run, place: str) -> DataFrame:
    """Own running sums plus the totals of the partitions before."""
    d = d.withColumns({f"_v_{k}": v for k, v in sums.items()})
    totals = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(f"_v_{k}"), _zero(d, k)).alias(k) for k in sums])
    before: dict = {"_n": 0} | dict.fromkeys(sums, 0)
    rows = []
    for r in sorted(totals.collect(), key=lambda r: r["_part"]):  # one row a partition
        rows.append([r["_part"], *before.values()])
        before = {k: v + r[k] for k, v in before.items()}
    kinds = {k: totals.schema[k].dataType.simpleString() for k in before}
    table = d.sparkSession.createDataFrame([[p, *(float(v) if kinds[k] == "double" else v for k, v in zip(before, rest, strict=True))] for p, *rest in rows], ", ".join(["_part int", *[f"_b_{k} {t}" for k, t in kinds.items()]]))
    d = d.join(F.broadcast(table), "_part")
    out = {place: F.col("_own") + F.col("_b__n")} | {k: F.coalesce(F.sum(f"_v_{k}").over(run), _zero(d, k)) + F.col(f"_b_{k}") for k in sums} | {f"{k}_total": F.lit(before[k]).cast(kinds[k]) for k in sums}
    return d.withColumns(out).drop(*[f"_b_{k}" for k in before])


def average_ranks(df: DataFrame, column: str, out: str, descending: bool = False, rows_per_task: int = ROWS) -> DataFrame:
    """``df`` with the rank of ``column`` over the whole table, ties averaged: distinct values are scanned with their counts."""
    value = F.col(column)
    each = df.groupBy(value.alias("_value")).agg(F.count(F.lit(1)).alias("_c"))
    key = -F.col("_value") if descending else F.col("_value")
    each = ordered_scan(each, [key], {"_upto": F.col("_c")}, rows_per_task=rows_per_task)
    each = each.select("_value", (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(each, value == F.col("_value")).drop("_value")
