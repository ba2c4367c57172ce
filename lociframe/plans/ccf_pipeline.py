"""The whole path from mutations and segments to cancer-cell fractions, and PyClone input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import _validate as check
from ..functions.columns import bare_chr, normal_copies
from ..operators.ccf import bootstrap_ccf, phylo_ccf
from ..operators.intervals import identify_mut_cn
from ..operators.subclone import STATES, subclone_cn

OUT = ["minor_raw", "major_raw", "minor_cn", "major_cn", "normal_cn", "expVAF", "obsVAF", "Mt", "mut_multi", "mut_multi_lower", "mut_multi_higher", "mut_multi_btstr_lower", "mut_multi_btstr_higher", "CCF", "CCF_lower", "CCF_higher", "CCF_btstr_lower", "CCF_btstr_higher", "absCCF", "absCCF_lower", "absCCF_higher", "phyloCCF", "phyloCCF_lower", "phyloCCF_higher", "mutCopyNum", "no_chrs_bearing_mut", "whichFrac", "CPNChange"]


def run_ccf(mut: DataFrame, cnv: DataFrame, ccf_type: tuple[str, ...] = ("phyloCCF",), subclonal_cn_correction: bool = True, on_patient=None, on_sample="sample", on_chr="chr", mut_pos: str = "pos", start_field: str = "startpos", end_field: str = "endpos", normal_cn: int | str | None = 2, gender_field: str | None = None, contigs: list[str] | None = None, ref_field: str | None = None, alt_field: str | None = None, indel_field: str | None = None, min_vaf_to_explain: float | None = None, conipher: bool = False, nomatch: str | None = None, kept_cols: tuple[str, ...] = (), mut_id: str | None = None, validate: bool = True, **options) -> DataFrame:
    """Cancer-cell fractions of mutations.

    ``cnv`` needs nMajor, nMinor (and nAraw, nBraw if corrected for sub-clonal
    states); purity is in either table, one value in [0, 1] for each sample.
    ``normal_cn`` is a number, a column or None for 1 or 2 by ``gender_field``.
    """
    for t in ccf_type:
        check.choice(t, ("phyloCCF", "bootstrapCCF"), "ccf_type")
    seg = cnv.withColumnsRenamed({"nMajor": "major_cn", "nMinor": "minor_cn"})
    if subclonal_cn_correction:
        seg = subclone_cn(seg).withColumnsRenamed({"nAraw": "major_raw", "nBraw": "minor_raw"})
    else:
        seg = seg.withColumns({"major_raw": F.col("major_cn").cast("double"), "minor_raw": F.col("minor_cn").cast("double"), "fracA": F.lit(1.0), "fracB": F.lit(0.0), "fracC": F.lit(None).cast("double"), "fracD": F.lit(None).cast("double")})
        seg = seg.withColumns({f"{n}_{s}": (F.col(c).cast("double") if s in "AB" else F.lit(None).cast("double")) for n, c in (("nMaj", "major_cn"), ("nMin", "minor_cn")) for s in STATES})
    d = identify_mut_cn(mut, seg, on_patient, on_sample, on_chr, mut_pos, start_field, end_field, nomatch, mut_id=mut_id)
    sample = check.key_pair(on_sample)[1] if on_sample else None
    patient = check.key_pair(on_patient)[1] if on_patient else None
    of_cnv = lambda c: c in seg.columns
    # checks read the table that holds the column, the segments if both do, and never the join
    own = lambda c: [check.key_pair(k)[1 if of_cnv(c) else 0] for k in (on_patient, on_sample) if k]
    chrom = check.key_pair(on_chr)[1]
    check.columns(d, ["purity", "alt_counts", "ref_counts"], "mut or cnv")
    if validate:
        holder = cnv if of_cnv("purity") else mut
        check.empty(holder.where((F.col("purity") < 0) | (F.col("purity") > 1)).select("purity"), "purity must be in [0, 1]")
        check.determines(holder.where("purity is not null"), own("purity"), ["purity"])
    if contigs:
        d = d.where(bare_chr(F.col(chrom)).isin(*[c.removeprefix("chr") for c in contigs]))
    if normal_cn is None:
        if not gender_field:
            raise ValueError("gender_field is needed to define normal_cn")
        if validate:
            check.empty((cnv if of_cnv(gender_field) else mut).where(F.coalesce(~F.col(gender_field).isin("male", "female"), F.lit(True))).select(gender_field), "gender must be male or female")
        d = d.withColumn("normal_cn", normal_copies(gender_field, chrom))
    else:
        d = d.withColumn("normal_cn", F.col(normal_cn) if isinstance(normal_cn, str) else F.lit(normal_cn))
    if "phyloCCF" in ccf_type:
        d = phylo_ccf(d, patient, sample, chrom, mut_pos, ref_field, alt_field, indel_field, min_vaf_to_explain, conipher, **options)
    if "bootstrapCCF" in ccf_type:
        d = bootstrap_ccf(d)
    keep = [mut_id, patient, sample, "purity", start_field, end_field, chrom, mut_pos, "alt_counts", "ref_counts", ref_field, alt_field, *OUT, *kept_cols]
    return d.select([c for c in dict.fromkeys(keep) if c and c in d.columns])


def prepare_pyclone(mut: DataFrame, cnv: DataFrame, on_sample="sample", on_chr="chr", mut_pos: str = "pos", start_field: str = "startpos", end_field: str = "endpos", ref_field: str = "ref", major_cn: str = "nMajor", minor_cn: str = "nMinor", normal_cn: int = 2, purity_field: str = "purity", pyclone_vi: bool = False, error_rate: float | None = None, nomatch: str | None = None, mut_id: str | None = None) -> DataFrame:
    """Clustering input: mutation_id, sample_id, counts, copies, tumour_content and (for the VI variant) error_rate; segments without a major copy are dropped."""
    d = identify_mut_cn(mut, cnv, None, on_sample, on_chr, mut_pos, start_field, end_field, nomatch, mut_id=mut_id)
    sample, chrom = check.key_pair(on_sample)[1], check.key_pair(on_chr)[1]
    cols = [F.concat_ws(":", F.col(sample), F.col(chrom), F.col(mut_pos).cast("string"), F.col(ref_field)).alias("mutation_id"), F.col(sample).alias("sample_id"), F.col("ref_counts"), F.col("alt_counts").alias("var_counts" if not pyclone_vi else "alt_counts"), F.lit(normal_cn).alias("normal_cn"), F.col(minor_cn).alias("minor_cn"), F.col(major_cn).alias("major_cn"), F.col(purity_field).alias("tumour_content")]
    if pyclone_vi:
        cols.append(F.lit(error_rate if error_rate is not None else 0.001).alias("error_rate"))
    return d.where(F.col(major_cn) > 0).select(cols)
