"""The row-local operators on streams: they are projections and stream-static joins, so they run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ccf import observed
from ..operators.cnv_signature import cnv_class
from ..operators.intervals import point_join
from ..operators.subclone import subclone_cn


def enrich_mutations(mutations: DataFrame, segments: DataFrame, sample: str = "sample", chrom: str = "chr", pos: str = "pos", start: str = "startpos", end: str = "endpos") -> DataFrame:
    """A stream of mutations joined with the (static) segments that hold them, with expVAF, obsVAF and mutCopyNum."""
    seg = subclone_cn(segments).withColumnsRenamed({"nAraw": "major_raw", "nBraw": "minor_raw"})
    d = point_join(mutations, seg, [(sample, sample), (chrom, chrom)], pos, start, end, "inner")
    return observed(d if "normal_cn" in d.columns else d.withColumn("normal_cn", F.lit(2)))


def windowed_vaf(mutations: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean allele fraction by sample in tumbling windows; rows later than ``late`` are left out."""
    d = mutations.withWatermark(time, late).where("alt_counts + ref_counts > 0")
    return d.groupBy(F.window(time, width), "sample").agg(F.avg(F.col("alt_counts") / (F.col("alt_counts") + F.col("ref_counts"))).alias("mean_vaf"), F.count(F.lit(1)).alias("n"))


def classify_segments(segments: DataFrame, start: str = "startpos", end: str = "endpos", major: str = "major_cn", minor: str = "minor_cn") -> DataFrame:
    """A stream of segments with their copy-number class."""
    return segments.withColumn("cnv_class", cnv_class(F.col(start), F.col(end), F.col(major), F.col(minor)))
