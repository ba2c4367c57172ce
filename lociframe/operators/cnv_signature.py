"""Copy-number signature classes: total copies x loss of heterozygosity x segment length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import _validate as check
from .reshape import counts_matrix, dense_counts


def cnv_classes() -> list[str]:
    """The 48 classes; copy class varies fastest."""
    long = ["0-100kb", "100kb-1Mb", "1Mb-10Mb", "10Mb-40Mb", ">40Mb"]
    kinds = {"homdel": (["0"], ["0-100kb", "100kb-1Mb", ">1Mb"]), "LOH": (["1", "2", "3-4", "5-8", "9+"], long), "het": (["2", "3-4", "5-8", "9+"], long)}
    return [f"{n}:{kind}:{size}" for kind, (copies, sizes) in kinds.items() for size in sizes for n in copies]


def cnv_class(start: Column, end: Column, major: Column, minor: Column) -> Column:
    """Class of a segment; null if a copy number is null."""
    mb, total = (end - start + 1) / 1e6, major + minor
    state = F.when(total == 0, "homdel").when(F.least(major, minor) == 0, "LOH").when(total.isNotNull(), "het")
    copies = F.when((total > -0.5) & (total <= 0.5), "0").when(total <= 1.5, "1").when(total <= 2.5, "2").when(total <= 4.5, "3-4").when(total <= 8.5, "5-8").when(total.isNotNull(), "9+")
    size = F.when(mb <= 0.1, "0-100kb").when(mb <= 1, "100kb-1Mb").when(state == "homdel", ">1Mb").when(mb <= 10, "1Mb-10Mb").when(mb <= 40, "10Mb-40Mb").otherwise(">40Mb")
    return F.concat_ws(":", F.when(copies.isNotNull() & state.isNotNull(), copies), state, size)


def cnv_signature(seg: DataFrame, sample_field: str | None = None, start_field: str = "startpos", end_field: str = "endpos", major_cn_field: str = "major_cn", minor_cn_field: str = "minor_cn", wide: bool = False) -> DataFrame:
    """Counts of each of the 48 classes for each sample: long (cnv_class, sample, n) or a matrix."""
    check.columns(seg, [sample_field, start_field, end_field, major_cn_field, minor_cn_field], "seg")
    keep = [sample_field] if sample_field else []
    d = seg.select(*keep, cnv_class(F.col(start_field), F.col(end_field), F.col(major_cn_field), F.col(minor_cn_field)).alias("cnv_class"))
    return counts_matrix(d, "cnv_class", cnv_classes(), sample_field) if wide else dense_counts(d, "cnv_class", cnv_classes(), sample_field).drop("_order")
