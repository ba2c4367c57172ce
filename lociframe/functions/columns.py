"""Column expressions: everything here stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def trim(x: Column, top: float = 1 - 2.0**-53) -> Column:
    """x capped at ``top``; null stays null."""
    return F.when(x > top, F.lit(top)).otherwise(x)


def expected_vaf(multiplicity, purity, total_cn, normal_cn) -> Column:
    """Allele fraction of a mutation on ``multiplicity`` copies in every tumour cell, at most 1."""
    p = c(purity)
    return trim(p * c(multiplicity) / (c(normal_cn) * (1 - p) + p * c(total_cn)), 1.0)


def mutation_copies(vaf, purity, total_cn, normal_cn) -> Column:
    """Mutated copies a tumour cell that give allele fraction ``vaf``."""
    p = c(purity)
    return c(vaf) / p * (p * c(total_cn) + c(normal_cn) * (1 - p))


def proportion_ci(x, n, p=None) -> tuple[Column, Column]:
    """95 % Wilson interval with continuity correction min(.5, |x - n p|); without p: p = .5."""
    x, n = c(x).cast("double"), c(n).cast("double")
    p = F.lit(0.5) if p is None else c(p)
    y = F.least(F.lit(0.5), F.abs(x - n * p)) / n
    a, est = Z95**2 / (2 * n), x / n

    def bound(e: Column, sign: int) -> Column:
        return (e + a + sign * Z95 * F.sqrt(e * (1 - e) / n + a / (2 * n))) / (1 + 2 * a)

    lo, hi = est - y, est + y
    return F.when(lo <= 0, F.lit(0.0)).otherwise(bound(lo, -1)), F.when(hi >= 1, F.lit(1.0)).otherwise(bound(hi, 1))


def normal_copies(gender, chrom, allosomes=("X", "Y")) -> Column:
    """1 on the sex chromosomes of males, 2 elsewhere."""
    return F.when((c(gender) == "male") & bare_chr(c(chrom)).isin(*allosomes), 1).otherwise(2)


def bare_chr(chrom: Column) -> Column:
    """Chromosome name without a chr prefix; M becomes MT."""
    bare = F.regexp_replace(chrom, "^(?i)chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def ucsc_chr(chrom: Column) -> Column:
    bare = bare_chr(chrom)
    return F.concat(F.lit("chr"), F.when(bare == "MT", "M").otherwise(bare))


def is_indel(ref, alt) -> Column:
    return F.coalesce(F.length(c(ref)), F.lit(0)) != F.coalesce(F.length(c(alt)), F.lit(0))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def average_rank(name: str, partition: list[str] | None = None, descending: bool = False) -> Column:
    """Rank of a column's value, from 1, with ties averaged."""
    part = partition or []
    order = F.col(name).desc() if descending else F.col(name).asc()
    return F.rank().over(Window.partitionBy(*part).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*part, name)) - 1) / 2.0


def weighted_median(df: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """(keys, values): the interpolated weighted median of each value over each group.

    Values are sorted, each stands at its running weight less half its own,
    and the median is read by linear interpolation at half the total weight,
    clamped to the end values.  Nulls, and rows of no positive weight, are
    left out; a group of nulls gives null.
    """
    out = None
    for v in values:
        ok = F.col(v).isNotNull() & (F.col(weight) > 0)
        some = df.select(*keys, F.when(ok, F.col(v).cast("double")).alias("_v"), F.when(ok, F.col(weight).cast("double")).alias("_w"))
        some = some.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"))  # equal values stand in one place
        total = F.sum("_w").over(Window.partitionBy(*keys))
        run = Window.partitionBy(*keys).orderBy("_v")
        at = some.where("_v is not null").withColumn("_half", total / 2).withColumn("_c", F.sum("_w").over(run) - F.col("_w") / 2)
        at = at.withColumn("_pc", F.lag("_c").over(run)).withColumn("_pv", F.lag("_v").over(run))
        pick = (
            F.max(F.when(F.col("_c") <= F.col("_half"), F.struct("_c", "_v"))).alias("_lo"),
            F.min(F.when(F.col("_c") >= F.col("_half"), F.struct("_c", "_v"))).alias("_hi"),
            F.first("_half").alias("_half"),
        )
        got = at.groupBy(*keys).agg(*pick)
        mid = F.col("_lo._v") + (F.col("_hi._v") - F.col("_lo._v")) * (F.col("_half") - F.col("_lo._c")) / (F.col("_hi._c") - F.col("_lo._c"))
        got = got.select(*keys, F.when(F.col("_lo").isNull(), F.col("_hi._v")).when(F.col("_hi").isNull(), F.col("_lo._v")).when(F.col("_hi._c") == F.col("_lo._c"), F.col("_lo._v")).otherwise(mid).alias(v))
        got = df.select(*keys).distinct().join(got, keys, "left") if keys else got
        out = got if out is None else out.join(got, keys) if keys else out.crossJoin(got)
    return out


def p_adjust(df: DataFrame, p: str, method: str = "BH", out: str = "p_adj", by: list[str] | None = None) -> DataFrame:
    """``df`` with adjusted p-values (BH = fdr, BY, holm, hochberg, hommel, bonferroni, none); null and NaN stay null and do not count.

    Ranks are taken over distinct values with their counts, in two steps:
    inside buckets of like values, and over the buckets' totals (some
    thousands of rows for each family), so no task ever holds a family.
    """
    if method == "hommel":
        return _hommel(df, p, out, by or [])
    if method not in ("BH", "fdr", "BY", "holm", "hochberg", "bonferroni", "none"):
        raise ValueError(f"unknown method {method!r}")
    value = F.col(p).cast("double")
    ok = value.isNotNull() & ~F.isnan(value)
    if method == "none":
        return df.withColumn(out, F.when(ok, F.least(F.lit(1.0), value)))
    family = F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)]) if by else F.lit(0)
    # buckets in descending order of p: equal steps of its logarithm
    bucket = F.when(value <= 0, 1_000_000).otherwise(F.least(F.lit(999_999), F.floor(-F.log(F.greatest(value, F.lit(1e-300))) * 64))).cast("int")
    each = df.where(ok).groupBy(family.alias("_f"), value.alias("_p"), bucket.alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    least = Window.partitionBy("_f").orderBy(F.desc("_b"))  # from the smallest p on
    totals = each.groupBy("_f", "_b").agg(F.sum("_c").alias("_t"))
    totals = totals.withColumns({"_before": F.sum("_t").over(least) - F.col("_t"), "_n": F.sum("_t").over(Window.partitionBy("_f"))}).drop("_t")
    inside = Window.partitionBy("_f", "_b").orderBy("_p")
    d = each.join(totals, ["_f", "_b"]).withColumn("_hi", F.col("_before") + F.sum("_c").over(inside))  # rank of the last of equal values
    n, hi, lo, pv = F.col("_n"), F.col("_hi"), F.col("_hi") - F.col("_c") + 1, F.col("_p")
    if method == "bonferroni":
        d = d.withColumn("_adj", n * pv)
    else:
        harmonic = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000.0)).cast("int")), F.lit(0.0), lambda t, i: t + 1 / i)
        tail = F.when(n > 1000, F.log(n / 1000) + 1 / (2 * n) - 1 / 2000.0 - 1 / (12 * n * n) + 1 / 12e6).otherwise(0.0)  # Euler-Maclaurin
        raw = {"holm": (n - lo + 1) * pv, "hochberg": (n - hi + 1) * pv, "BY": (harmonic + tail) * n / hi * pv}.get(method, n / hi * pv)
        up = method == "holm"  # the largest so far from below, else the smallest so far from above
        pick, run = (F.max, inside) if up else (F.min, Window.partitionBy("_f", "_b").orderBy(F.desc("_p")))
        d = d.withColumn("_raw", raw)
        ends = d.groupBy("_f", "_b").agg(pick("_raw").alias("_end"))
        side = (least if up else Window.partitionBy("_f").orderBy("_b")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_other", pick("_end").over(side)).drop("_end")
        d = d.withColumn("_own", pick("_raw").over(run)).join(ends, ["_f", "_b"])
        d = d.withColumn("_adj", (F.greatest if up else F.least)("_own", F.coalesce("_other", "_own")))
    d = d.select(F.col("_f").alias("_family"), F.col("_p").alias("_value"), F.least(F.lit(1.0), F.col("_adj")).alias("_adjusted"))
    x = df.withColumns({"_k": F.when(ok, value), "_fam": family})
    got = x.join(d, (F.col("_k") == F.col("_value")) & F.col("_fam").eqNullSafe(F.col("_family")), "left")
    return got.withColumn(out, F.col("_adjusted")).drop("_k", "_fam", "_family", "_value", "_adjusted")


def _hommel(df: DataFrame, p: str, out: str, by: list[str]) -> DataFrame:
    """Hommel's method by closed testing: one family a task, in numpy.

    A hypothesis falls at level a if every set of hypotheses that holds it
    fails Simes' test at a.  Of the sets of m others and it, the hardest to
    reject has the m largest p-values, or it and m - 1 of them; so the
    adjusted value is the maximum over m of the smaller of Simes' p of the m
    largest and m times the own p.
    """
    import numpy as np

    schema = df.schema.add(out, "double")

    def run(pdf):
        v = pdf[p].to_numpy(float)
        known = v[~np.isnan(v)]
        largest_first = np.sort(known)[::-1]
        adj = np.array(v)
        for m in range(1, len(known) + 1):
            top = largest_first[:m][::-1]
            simes = (m * top / np.arange(1, m + 1)).min()
            adj = np.maximum(adj, np.minimum(simes, m * v))
        return pdf.assign(**{out: np.minimum(adj, 1.0)})

    keyed = df.withColumn("_family", F.struct(*by) if by else F.lit(1)).groupBy("_family")
    return keyed.applyInPandas(lambda pdf: run(pdf.drop(columns="_family")), schema)
