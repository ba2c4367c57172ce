"""Input of a purity caller: normalised segments and mutations, and one file for each sample.

The caller itself is an external program; ``run_absolute`` prepares its
input and hands each sample's folder to a function of the user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import _validate as check

SEG = ["Sample", "Chromosome", "Start", "End", "Num_Probes", "Segment_Mean"]
# fixed values: accepted names of each mutation column
MAF = {
    "Tumor_Sample_Barcode": ["Tumor_Sample_Barcode"],
    "Chromosome": ["Chromosome"],
    "Hugo_Symbol": ["Hugo_Symbol"],
    "dbSNP_Val_Status": ["dbSNP_Val_Status"],
    "Start_position": ["Start_Position", "Start_position"],
    "t_ref_count": ["t_ref_count", "i_t_ref_count"],
    "t_alt_count": ["t_alt_count", "i_t_alt_count"],
}


def _chromosomes(df: DataFrame) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.col("Chromosome").cast("string"), "^(?i)chr", ""), "(?i)X", "23")
    return df.withColumn("Chromosome", bare).where(F.col("Chromosome").isin(*map(str, range(1, 24))))


def normalize_segments(seg: DataFrame) -> DataFrame:
    """The six segment columns with chromosomes 1 to 23; a missing Sample column means one sample, null samples go."""
    d = seg if "Sample" in seg.columns else seg.withColumn("Sample", F.lit("SampleOne"))
    missing = [c for c in SEG if c not in d.columns]
    if missing:
        raise ValueError(f"seg: missing columns {missing}")
    return _chromosomes(d.where("Sample is not null").select(SEG))


def normalize_mutations(maf: DataFrame) -> DataFrame:
    """The seven mutation columns under their standard names (the first alias that is there wins)."""
    cols, missing = [], []
    for name, aliases in MAF.items():
        found = next((a for a in aliases if a in maf.columns), None)
        if found is None:
            missing.append(name)
        else:
            cols.append(F.col(found).alias(name))
    if missing:
        raise ValueError(f"maf: missing columns {missing}")
    return _chromosomes(maf.select(cols))


def disease_map(table: DataFrame, disease: str = "disease", code: str = "code") -> DataFrame:
    """(disease, code) of the purity caller's disease map from a table of the caller's; each disease must have one code.  None is shipped."""
    out = table.select(F.trim(F.col(disease).cast("string")).alias("disease"), F.col(code).cast("string").alias("code")).where("disease is not null and code is not null").distinct()
    check.determines(out, ["disease"], ["code"], "table")
    return out


def write_by_sample(df: DataFrame, path: str, sample: str) -> None:
    """Tab-separated files, one folder for each sample."""
    df.withColumn("_sample", F.col(sample)).repartition("_sample").write.partitionBy("_sample").option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def run_absolute(seg: DataFrame, maf: DataFrame | None, results_dir: str, caller: Callable[[str, str, str | None], None] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Normalise, write ``seg`` and ``maf`` under ``results_dir`` and call ``caller(sample, seg folder, maf folder)`` for each sample; a sample that fails with mutations is tried again without."""
    s = normalize_segments(seg)
    m = None
    if maf is not None:
        m = normalize_mutations(maf).join(s.select(F.col("Sample").alias("Tumor_Sample_Barcode")).distinct(), "Tumor_Sample_Barcode", "left_semi")
        if not m.take(1):
            raise ValueError("no samples in maf to proceed")
        write_by_sample(m, f"{results_dir}/maf", "Tumor_Sample_Barcode")
    write_by_sample(s, f"{results_dir}/seg", "Sample")
    if caller:
        with_maf = {r[0] for r in m.select("Tumor_Sample_Barcode").distinct().collect()} if m is not None else set()
        for (name,) in s.select("Sample").distinct().collect():  # an external program for each sample
            folder = "_sample=" + seg.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)  # as the writer names it
            at = f"{results_dir}/seg/{folder}"
            try:
                caller(name, at, f"{results_dir}/maf/{folder}" if name in with_maf else None)
            except Exception:
                if name not in with_maf:
                    raise
                caller(name, at, None)
    return s, m
