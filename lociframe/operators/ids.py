"""Identifier mapping with one row kept for each new identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import _validate as check


def map_ids(features: DataFrame, db: DataFrame | dict[str, str], column: str | Sequence[str], keytype: str, decreasing: bool = True, mean: str | None = None, assay: DataFrame | None = None) -> DataFrame:
    """(keytype, column.., mean): features mapped through ``db``, one for each new identifier.

    ``db`` is a dictionary (one column) or a table keyed by ``keytype`` (its
    smallest value is taken if a key repeats).  Features that map to nothing
    or to an empty string go; of those that share the first new identifier
    the one with the largest (smallest) mean stays, ties by the old one.
    The mean is a column of ``features`` or comes from ``assay`` (keytype,
    sample, value).
    """
    names = [column] if isinstance(column, str) else list(column)
    check.columns(features, [keytype, mean], "features")
    if isinstance(db, dict):
        if len(names) != 1:
            raise ValueError("column must be one name if db is a dictionary")
        db = features.sparkSession.createDataFrame(list(db.items()), f"`{keytype}` string, `{names[0]}` string")
    check.columns(db, [keytype, *names], "db")
    d = features.select(keytype, *([F.col(mean).alias("mean")] if mean else []))
    if assay is not None:
        d = d.join(assay.groupBy(keytype).agg(F.avg("value").alias("mean")), keytype, "left")
    elif not mean:
        d = d.withColumn("mean", F.lit(None).cast("double"))
    lookup = db.groupBy(keytype).agg(*[F.min(c).alias(c) for c in names])
    d = d.join(lookup, keytype).where(F.col(names[0]).isNotNull() & (F.col(names[0]) != ""))
    order = F.col("mean").desc_nulls_last() if decreasing else F.col("mean").asc_nulls_last()
    w = Window.partitionBy(names[0]).orderBy(order, keytype)
    return d.withColumn("_i", F.row_number().over(w)).where("_i = 1").select(keytype, *names, "mean")


def map_assay(assay: DataFrame, features: DataFrame, db, column: str, keytype: str, decreasing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(assay, features) of an experiment with rows renamed to the new identifiers."""
    got = map_ids(features, db, column, keytype, decreasing, assay=assay)
    return assay.join(got.select(keytype, column), keytype).drop(keytype), features.join(got.drop("mean"), keytype)
