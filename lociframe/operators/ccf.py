"""Cancer-cell fractions: phylogenetic, absolute and bootstrap.

Joins, medians and p-value correction are DataFrame operations; what is local
to a row and needs a normal tail, a likelihood grid or the search over
amplified states is one Arrow kernel, in numpy over whole batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import _validate as check
from .._shared import written
from ..functions import kernels, phylo
from ..functions.draws import spread, uniform
from ..functions.columns import expected_vaf, is_indel, mutation_copies, p_adjust, proportion_ci, trim

def _abs_ccf(alt: pd.Series, ref: pd.Series, total: pd.Series, purity: pd.Series, normal: pd.Series) -> pd.DataFrame:
    out = phylo.abs_ccf_rows(*(s.to_numpy(float) for s in (alt, ref, total, purity, normal)))
    return pd.DataFrame(out, columns=["lower", "est", "higher", "prob_subclonal", "prob_clonal"])


def abs_ccf(alt, ref, total_cn, purity, normal_cn) -> Column:
    """Struct (lower, est, higher, prob_subclonal, prob_clonal) over a grid of 100 fractions."""
    d = lambda x: F.col(x).cast("double") if isinstance(x, str) else x.cast("double")
    udf = F.pandas_udf(_abs_ccf, "lower double, est double, higher double, prob_subclonal double, prob_clonal double")
    return udf(d(alt), d(ref), d(total_cn), d(purity), d(normal_cn))


def _prop_udf(alternative: str):
    @F.pandas_udf("double")
    def run(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(kernels.prop_test_p(x, n, p, alternative), dtype=float)

    return run


def prop_test_p(x: Column, n: Column, p: Column, alternative: str = "two-sided") -> Column:
    """P-value of the one-sample proportion test; null where it is not defined."""
    v = _prop_udf(alternative)(x.cast("double"), n.cast("double"), p.cast("double"))
    return F.when(~F.isnan(v), v)


def observed(d: DataFrame) -> DataFrame:
    """expVAF, obsVAF and mutCopyNum from counts, purity and raw copies."""
    total = F.col("major_raw") + F.col("minor_raw")
    d = d.withColumns({"expVAF": expected_vaf(F.lit(1.0), "purity", total, "normal_cn"), "obsVAF": F.col("alt_counts") / F.nullif(F.col("alt_counts") + F.col("ref_counts"), F.lit(0))})
    return d.withColumn("mutCopyNum", mutation_copies("obsVAF", "purity", total, "normal_cn"))


def phylo_ccf(d: DataFrame, patient_field: str | None = None, sample_field: str | None = None, chr_field: str = "chr", pos_field: str = "pos", ref_field: str | None = None, alt_field: str | None = None, indel_field: str | None = None, min_vaf_to_explain: float | None = None, conipher: bool = False, ubiquity_vaf: float = 0.05, rescale_normal_cn: bool = True) -> DataFrame:
    """phyloCCF with bounds, absCCF with bounds, mutCopyNum, no_chrs_bearing_mut, whichFrac, CPNChange.

    Needs alt_counts, ref_counts, purity, major_raw, minor_raw, normal_cn and
    the sub-clonal states of :func:`subclone_cn`.  ``ubiquity_vaf`` is the
    allele fraction above which a mutation counts as present in a sample (5
    switches the indel correction off, as fractions never exceed 1);
    ``rescale_normal_cn`` False rescales explained mutations with two normal
    copies everywhere.
    """
    check.columns(d, ["alt_counts", "ref_counts", "purity", "major_raw", "minor_raw", "normal_cn", *[f"frac{s}" for s in "ABCD"]], "data")
    if conipher:  # the only step that looks beyond a row, before the one kernel of the others
        d = observed(d)
        d = d.withColumn("_p", prop_test_p(F.col("alt_counts"), F.col("alt_counts") + F.col("ref_counts"), trim(F.col("expVAF")), "less"))
        d = p_adjust(d, "_p", "BH", "_p")
    inputs = ["alt_counts", "ref_counts", "purity", "major_raw", "minor_raw", "normal_cn", *[f"frac{s}" for s in "ABCD"], *[f"nMaj_{s}" for s in "ABCD"], *[f"nMin_{s}" for s in "ABCD"]]

    @F.pandas_udf(", ".join([*(f"{c} double" for c in phylo.FIELDS), "whichFrac string", "CPNChange int"]))
    def run(*cols: pd.Series) -> pd.DataFrame:
        v = [c.to_numpy(float) for c in cols]
        states = [dict(zip("ABCD", v[k : k + 4], strict=True)) for k in (6, 10, 14)]
        got = phylo.phylo_rows(*v[:6], *states, v[18] if conipher else None, min_vaf_to_explain, conipher, rescale_normal_cn)
        return pd.DataFrame({c: got[c] for c in (*phylo.FIELDS, "whichFrac", "CPNChange")})

    d = d.withColumn("_r", run(*[F.col(c).cast("double") for c in (*inputs, *(["_p"] if conipher else []))]))
    known = lambda c: F.when(~F.isnan(F.col(f"_r.{c}")), F.col(f"_r.{c}"))
    d = d.withColumns({c: known(c) for c in phylo.FIELDS} | {c: F.col(f"_r.{c}") for c in ("whichFrac", "CPNChange")}).drop("_r", "_p")
    if indel_field or (ref_field and alt_field):
        d = correct_indels(d, patient_field, sample_field, chr_field, pos_field, ref_field, F.col(indel_field) if indel_field else is_indel(ref_field, alt_field), ubiquity_vaf)
    elif ref_field or alt_field:
        raise ValueError("both ref_field and alt_field are needed to correct indels")
    return d


def correct_indels(d: DataFrame, patient: str | None, sample: str | None, chrom: str, pos: str, ref: str | None, indel: Column, ubiquity_vaf: float) -> DataFrame:
    """Scale indels by median phyloCCF of substitutions over that of indels, over mutations present in every sample of a patient."""
    group = [x for x in (patient, sample) if x]
    who = [x for x in (patient,) if x]
    # read four times below: written once, so that neither the join nor the kernel runs again
    d = written(d.withColumn("_indel", F.coalesce(indel, F.lit(False))), "ccf")
    n = d.groupBy(*who).agg(F.count_distinct(sample).alias("_n") if sample else F.lit(1).cast("long").alias("_n"))
    key = [x for x in (patient, chrom, pos, ref) if x]
    seen = d.groupBy(*key).agg(F.sum((F.col("obsVAF") > ubiquity_vaf).cast("int")).alias("_seen"))
    seen = seen.join(n, who) if who else seen.crossJoin(n)  # one row
    ubiquitous = d.join(seen.where("_seen = _n").select(*key), key, "left_semi").where("phyloCCF is not null")
    factor = ubiquitous.groupBy(*group).agg((F.median(F.when(~F.col("_indel"), F.col("phyloCCF"))) / F.median(F.when(F.col("_indel"), F.col("phyloCCF")))).alias("_factor"))
    d = d.join(factor, group, "left") if group else d.crossJoin(factor)
    # without any ubiquitous mutation nothing is corrected
    scale = F.when(F.col("_indel"), F.coalesce("_factor", F.lit(1.0))).otherwise(1.0)
    return d.withColumns({c: F.col(c) * scale for c in ("phyloCCF", "mutCopyNum")}).drop("_indel", "_factor")


def mutation_types(d: DataFrame) -> DataFrame:
    """``d`` with Mt: the number of mutated copies whose Poisson likelihood of the observed reads is largest.

    Candidates are 1 to the major copy number, if the normal copies are 1 or 2
    and the total is at least 1; the smallest of equals wins.
    """
    total, depth = F.col("major_cn") + F.col("minor_cn"), F.col("alt_counts") + F.col("ref_counts")
    p = F.col("purity")
    k = F.bround(F.col("alt_counts") / F.nullif(depth, F.lit(0)) * depth).cast("double")
    top = F.least(F.col("major_cn"), total).cast("int")
    rate = lambda mt: F.when(mt * p == 0, 0.01).otherwise(mt * p / (total * p + F.col("normal_cn") * (1 - p))) * depth
    # log-likelihood without the term of k! that all share
    score = F.transform(F.sequence(F.lit(1), top), lambda mt: F.struct((k * F.log(rate(mt)) - rate(mt)).alias("l"), (-mt).alias("minus")))
    ok = (top >= 1) & F.col("normal_cn").isin(1, 2) & (depth > 0) & (p > 0)
    return d.withColumn("Mt", F.when(ok, (-F.array_max(score)["minus"]).cast("double")))


def bootstrap_ccf(d: DataFrame, times: int = 1000, seed: int = 1, analytic: bool = False) -> DataFrame:
    """mut_multi and CCF with test and bootstrap bounds.

    The bootstrap of Bernoulli reads is a binomial draw, by the inverse of its
    distribution function at the draw of (seed, alt_counts, ref_counts,
    replicate): mutations of equal counts have equal bootstrap distributions
    and share the draws, which are made once for each pair of counts.  Bounds
    are the normal ones, 2 t0 - mean(t*) -/+ 1.96 sd(t*).  ``analytic`` takes
    the exact moments instead.  Without reference reads the bounds of the
    proportion test hold.
    """
    d = mutation_types(d.withColumn("obsVAF", F.col("alt_counts") / F.nullif(F.col("alt_counts") + F.col("ref_counts"), F.lit(0))))
    total, alt, ref = F.col("major_cn") + F.col("minor_cn"), F.col("alt_counts"), F.col("ref_counts")
    copies = lambda v: mutation_copies(v, "purity", total, "normal_cn")
    lo, hi = proportion_ci(alt, alt + ref)
    d = d.withColumns({"mut_multi": copies(F.col("obsVAF")), "mut_multi_lower": copies(lo), "mut_multi_higher": copies(hi)})

    if analytic:
        half = 1.959963984540054 * F.sqrt(F.col("obsVAF") * (1 - F.col("obsVAF")) / (alt + ref))
        b_lo, b_hi = F.col("obsVAF") - half, F.col("obsVAF") + half
    else:

        @F.pandas_udf("lo double, hi double")
        def bounds(a: pd.Series, r: pd.Series, u: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([kernels.bootstrap_bounds(int(x), int(x + y), np.asarray(draws)) for x, y, draws in zip(a, r, u, strict=True)], columns=["lo", "hi"])

        pairs = d.select(alt.alias("_alt"), ref.alias("_ref")).where((alt + ref > 0) & (alt >= 0) & (ref >= 0)).distinct()
        u = F.transform(F.sequence(F.lit(1), F.lit(times)), lambda k: uniform(seed, F.col("_alt"), F.col("_ref"), k))
        pairs = spread(pairs, "_alt", "_ref").withColumn("_b", bounds(F.col("_alt").cast("double"), F.col("_ref").cast("double"), u))
        d = d.join(pairs, (alt == F.col("_alt")) & (ref == F.col("_ref")), "left").drop("_alt", "_ref")
        b_lo, b_hi = F.col("_b.lo"), F.col("_b.hi")
    none = ref == 0
    d = d.withColumns({"mut_multi_btstr_lower": F.when(none, F.col("mut_multi_lower")).otherwise(copies(b_lo)), "mut_multi_btstr_higher": F.when(none, F.col("mut_multi_higher")).otherwise(copies(b_hi))})
    return d.withColumns({f"CCF{s}": F.col(f"mut_multi{s}") / F.col("Mt") for s in ("", "_lower", "_higher", "_btstr_lower", "_btstr_higher")}).drop("_b")
