"""Binding predictions: a wide table with a two-line header to long form."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import _validate as check
from ..operators.scan import ordered_scan


def bind_level(rank, strong: float = 0.5, weak: float = 2.0):
    return F.when(rank < strong, "SB").when(rank < weak, "WB")


def sequence_runs(df: DataFrame, order: str, peptide: str, seq_id: str) -> DataFrame:
    """``df`` with identifiers: the number of the source sequence, from 1.

    A new one begins where the peptide is longer than the one before or the
    sequence id differs.  Rows are in the order of ``order``.
    """
    d = ordered_scan(df.withColumns({"_len": F.length(peptide), "_of": F.col(seq_id)}), [F.col(order)], {"_runs": _begins("_len", "_of")}, previous=("_len", "_of"))
    return d.withColumn("identifiers", (F.col("_runs") + 1).cast("int")).drop("_len", "_of", "prev__len", "prev__of", "place", "_runs", "_runs_total")


def _begins(length: str, of: str):
    return F.when((F.col(length) > F.col(f"prev_{length}")) | (F.col(of) != F.col(f"prev_{of}")), 1).otherwise(0).cast("long")


def long_predictions(df: DataFrame, hla: list[str], measures: list[str], ids: list[str], strong: float = 0.5, weak: float = 2.0) -> DataFrame:
    """(ids.., HLA, measures.., BindLevel) from columns named ``HLA::measure``."""
    rows = F.array(*[F.struct(F.lit(h).alias("HLA"), *[F.col(f"`{h}::{m}`").cast("double").alias(m) for m in measures]) for h in hla])
    d = df.select(*ids, F.explode(rows).alias("_r")).select(*ids, "_r.HLA", *[F.col(f"_r.`{m}`").alias(m) for m in measures])
    return d.withColumn("BindLevel", bind_level(F.col("EL_Rank"), strong, weak)) if "EL_Rank" in measures else d


def parse_netmhcpan(spark: SparkSession, path: str, ids: list[str] | None = None, rth: float = 0.5, rlt: float = 2.0) -> DataFrame:
    """Read a prediction table: line 1 the HLA types, line 2 the column names, then rows.

    Columns 1 to 3 are position, peptide and id; measures follow for each HLA
    type; the last two columns are averages.  ``ids`` names the source
    sequences in order.  Only the two header lines are read by the driver.
    """
    check.number(rth, "rth", 0)
    check.number(rlt, "rlt", rth)
    lines = spark.read.text(path, wholetext=False)
    head = [r.value.split("\t") for r in lines.limit(2).collect()]
    hla, names = [x for x in head[0] if x.strip()], head[1]
    width = (len(names) - 5) // max(1, len(hla))
    measures = names[3 : 3 + width]
    cols = [*names[:3], *[f"{h}::{m}" for h in hla for m in measures], *names[-2:]]
    numbered = lines.withColumn("_at", F.monotonically_increasing_id())
    first = {r._at for r in numbered.limit(2).collect()}
    body = numbered.where(~F.col("_at").isin(*first)).select("_at", F.split("value", "\t").alias("_v"))
    d = body.select("_at", *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)])
    d = sequence_runs(d, "_at", names[1], names[2])
    if ids:
        d = d.withColumn("identifiers", F.element_at(F.create_map(*chain.from_iterable((F.lit(i + 1), F.lit(x)) for i, x in enumerate(ids))), F.col("identifiers")))
    return long_predictions(d, hla, measures, [*names[:3], "identifiers"], rth, rlt)
