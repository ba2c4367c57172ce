"""Counts over a fixed domain, wide and long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_counts(df: DataFrame, level: str, levels: Sequence[str], group: str | None = None) -> DataFrame:
    """(level, group, n) for every level and every group of ``df``; zero counts stay, values outside ``levels`` are dropped."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(i, v) for i, v in enumerate(levels)], f"_order int, `{level}` string")
    key = [level, *([group] if group else [])]
    n = df.where(F.col(level).isin(*levels)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    base = df.select(group).distinct().crossJoin(F.broadcast(domain)) if group else domain
    return base.join(n, key, "left").select(*key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "_order")


def counts_matrix(df: DataFrame, level: str, levels: Sequence[str], group: str | None = None, groups: Sequence | None = None) -> DataFrame:
    """The same as a matrix: a row for each level in order, a column for each group."""
    d = dense_counts(df, level, levels, group)
    if group is None:
        return d.orderBy("_order").drop("_order")
    p = d.groupBy("_order", level).pivot(group, list(groups)) if groups else d.groupBy("_order", level).pivot(group)
    return p.agg(F.first("n")).orderBy("_order").drop("_order")
