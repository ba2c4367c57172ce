"""Chromosome arms: ranges from cytobands, per-arm segments, arm-level events, genome doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import _validate as check
from ..functions.columns import bare_chr, weighted_median
from ..functions.draws import spread, uniform
from .intervals import overlap_join, overlaps_within, reduce_ranges

ARMS = ("p", "q")


def get_cytoband(bands: DataFrame, add_arm: bool = True) -> DataFrame:
    """``bands`` (chr, start, end, name, gieStain) with a column arm: acen, p or q."""
    check.columns(bands, ["chr", "start", "end", "name", "gieStain"], "bands")
    if not add_arm:
        return bands
    return bands.withColumn("arm", F.when(F.col("gieStain") == "acen", "acen").otherwise(F.regexp_replace("name", r"^([pq])[0-9.]+$", "$1")))


def arm_ranges(bands: DataFrame, arm_field: str = "arm", arms: Sequence[str] | None = None, contigs: Sequence[str] | None = None) -> DataFrame:
    """(chr, arm, start, end): merged ranges of each arm, ordered by chromosome and p, acen, q."""
    check.columns(bands, ["chr", "start", "end", arm_field], "bands")
    d = bands.select(bare_chr(F.col("chr")).alias("chr"), F.col(arm_field).alias("arm"), "start", "end")
    if arms:
        d = d.where(F.col("arm").isin(*arms))
    if contigs:
        d = d.where(F.col("chr").isin(*[str(x).removeprefix("chr") for x in contigs]))
    order = F.coalesce(F.expr("try_cast(chr as int)"), F.when(F.col("chr") == "X", 23).when(F.col("chr") == "Y", 24).otherwise(25))
    return reduce_ranges(d, ["chr", "arm"]).orderBy(order, "chr", F.when(F.col("arm") == "p", 1).when(F.col("arm") == "acen", 2).otherwise(3), "start")


def summarize_arm(seg: DataFrame, bands: DataFrame, sample_field: str | None = None, other_fields: Sequence[str] = (), chr_field: str = "chr", start_field: str = "startpos", end_field: str = "endpos", group_fields: Sequence[str] = (), contigs: Sequence[str] | None = None, arm_field: str = "arm", arms: Sequence[str] = ARMS, filter_centromere: bool = True, check_overlap: bool = True) -> DataFrame:
    """The part of each segment in each arm; every group has every arm, with nulls where nothing is.

    Columns: sample and group fields, chr, arm, arm_start, arm_end, arm_width,
    seg_start, seg_end, width, other fields.  Segments of one sample must not
    overlap.  ``filter_centromere`` drops every segment that touches a band of
    stain acen as a whole.
    """
    group = [x for x in [sample_field, *group_fields] if x]
    check.columns(seg, [*group, *other_fields, chr_field, start_field, end_field], "seg")
    s = seg.select(*dict.fromkeys([*group, *other_fields]), bare_chr(F.col(chr_field)).alias("seg_chr"), F.col(start_field).alias("_s"), F.col(end_field).alias("_e"))
    if check_overlap:
        check.empty(overlaps_within(s, [*([sample_field] if sample_field else []), "seg_chr"], "_s", "_e"), "segments of a sample overlap")
    ranges = arm_ranges(bands, arm_field, arms, contigs)
    if filter_centromere:
        acen = bands.where(F.col("gieStain") == "acen").select(bare_chr(F.col("chr")).alias("acen_chr"), F.col("start").alias("_as"), F.col("end").alias("_ae"))
        s = overlap_join(s, F.broadcast(acen), [("seg_chr", "acen_chr")], ("_s", "_e"), ("_as", "_ae"), "left_anti")  # at most a few bands a chromosome
    arm = ranges.select("chr", "arm", F.col("start").alias("arm_start"), F.col("end").alias("arm_end"), (F.col("end") - F.col("start") + 1).alias("arm_width"))
    hit = overlap_join(s, F.broadcast(arm), [("seg_chr", "chr")], ("_s", "_e"), ("arm_start", "arm_end"))
    hit = hit.select(*group, "chr", "arm", F.col("hit_start").alias("seg_start"), F.col("hit_end").alias("seg_end"), (F.col("hit_end") - F.col("hit_start") + 1).alias("width"), *[f for f in other_fields if f not in group])
    if group:
        who = seg.select(*group).distinct()
        base = who.crossJoin(F.broadcast(arm))  # a constant number of arms for each group
    else:
        base = arm
    payload = ["seg_start", "seg_end", "width", *[f for f in other_fields if f not in group]]
    b, h = base.alias("b"), hit.alias("h")
    cond = (F.col("b.chr") == F.col("h.chr")) & (F.col("b.arm") == F.col("h.arm"))
    for g in group:
        cond = cond & F.col(f"b.`{g}`").eqNullSafe(F.col(f"h.`{g}`"))
    return b.join(h, cond, "left").select("b.*", *[F.col(f"h.`{c}`").alias(c) for c in payload])


def arm_cnv(seg: DataFrame, bands: DataFrame, sample_field: str | None = None, cnv_field: str = "cnv", cnv_mode: str = "rel", ploidy_field: str | None = None, threshold: float = 0.9, **options) -> DataFrame:
    """Arm-level copy-number state: one row (sample, chr, arm, arm_cnv).

    rel: 1 if altered segments (cnv not 0) cover more than ``threshold`` of
    the arm, else 0.  abs: sign of the rounded interpolated weighted median of
    cnv less the rounded ploidy; null where the arm has no segment.  Rounding
    is half-even.
    """
    check.choice(cnv_mode, ("rel", "abs"), "cnv_mode")
    check.number(threshold, "threshold", 0, 1)
    key = [x for x in (sample_field, "chr", "arm") if x]
    if cnv_mode == "rel":
        d = summarize_arm(seg, bands, sample_field, [cnv_field], **options)
        share = F.coalesce(F.sum(F.abs(F.signum(F.coalesce(F.col(cnv_field).cast("double"), F.lit(0.0)))) * F.col("width") / F.col("arm_width")), F.lit(0.0))
        return d.groupBy(*key).agg((share > threshold).cast("int").alias("arm_cnv"))
    if not ploidy_field:
        raise ValueError("ploidy_field is needed for absolute copy numbers")
    d = summarize_arm(seg, bands, sample_field, [cnv_field], group_fields=[ploidy_field], **options)
    med = weighted_median(d, [*key, ploidy_field], [cnv_field], "width")
    return med.select(*key, F.signum(F.bround(F.col(cnv_field)) - F.bround(F.col(ploidy_field).cast("double"))).cast("int").alias("arm_cnv"))


def wgd_fraction(seg: DataFrame, bands: DataFrame, sample_field: str | None = None, thresholds: Sequence[int] = (2, 3), major_cn_field: str = "major_cn", **options) -> DataFrame:
    """Share of the genome whose major copy number is at least each threshold."""
    d = summarize_arm(seg, bands, sample_field, [major_cn_field], filter_centromere=False, **options)
    key = [x for x in (sample_field, "chr", "arm") if x]
    sums = [F.sum(F.when(F.col(major_cn_field) >= t, F.col("width").cast("double")).otherwise(0.0)).alias(f"Genome_prop_above_{t}") for t in thresholds]
    by_arm = d.groupBy(*key, "arm_width").agg(*sums)
    return by_arm.groupBy(*([sample_field] if sample_field else [])).agg(*[(F.sum(f"Genome_prop_above_{t}") / F.sum("arm_width")).alias(f"Genome_prop_above_{t}") for t in thresholds])


def wgd_arms(seg: DataFrame, bands: DataFrame, sample_field: str, major_cn_field: str = "major_cn", minor_cn_field: str = "minor_cn", cnt_field: str | None = None, ploidy_field: str = "ploidy", **options) -> DataFrame:
    """Per-arm weighted medians and aberration counts that genome doubling is judged by.

    (sample, ploidy, chr, arm, arm_minor_ploidy, arm_total_ploidy,
    arm_major_ploidy, total_aber, A, B).
    """
    s = seg if cnt_field else seg.withColumn("_cnt", F.col(major_cn_field) + F.col(minor_cn_field))
    d = summarize_arm(s, bands, sample_field, [minor_cn_field, cnt_field or "_cnt"], group_fields=[ploidy_field], filter_centromere=False, **options).where("width is not null")
    m = weighted_median(d, [sample_field, ploidy_field, "chr", "arm"], [minor_cn_field, cnt_field or "_cnt"], "width")
    m = m.select(sample_field, F.col(ploidy_field).alias("ploidy"), "chr", "arm", F.col(minor_cn_field).alias("arm_minor_ploidy"), F.col(cnt_field or "_cnt").alias("arm_total_ploidy"))
    m = m.withColumn("arm_major_ploidy", F.col("arm_total_ploidy") - F.col("arm_minor_ploidy"))
    total = m.groupBy(sample_field).agg((F.coalesce(F.sum(F.abs(F.col("arm_minor_ploidy") - 1)), F.lit(0.0)) + F.coalesce(F.sum(F.abs(F.col("arm_major_ploidy") - 1)), F.lit(0.0))).alias("total_aber"))
    return m.join(total, sample_field).withColumns({"A": F.signum(F.col("arm_major_ploidy") - 1), "B": F.signum(F.col("arm_minor_ploidy") - 1)})


def wgd_state(p, ploidy):
    """GD or nGD by p-value and half-even rounded ploidy."""
    r = F.bround(ploidy)
    return F.when(((r >= 6) & (p <= 1)) | ((r == 5) & (p <= 0.5)) | ((r == 4) & (p <= 0.05)) | ((r <= 3) & (p <= 0.001)), "GD").otherwise("nGD")


def wgd_test(seg: DataFrame, bands: DataFrame, sample_field: str, perm_times: int = 10_000, seed: int = 1, **options) -> DataFrame:
    """(sample, ploidy, pvalue, total_aber, wgd_event, wGD): is the share of arms with two major copies larger than by chance?

    A permutation draws int(total_aber) events, uniformly over the arms'
    alleles that are aberrant (A or B not 0).  A drawn allele has 1 + sign *
    count copies, one not drawn keeps its sign: so an arm reaches two copies
    if any of its gained alleles is drawn.  Events are draws of (seed, sample,
    permutation, event); permutations of a sample run in parallel chunks.
    """
    arms = wgd_arms(seg, bands, sample_field, **options)
    listed = F.array_sort(F.collect_list(F.struct("chr", "arm", "A", "B")))  # at most some fifty arms
    d = arms.groupBy(sample_field, "ploidy").agg(F.first("total_aber").alias("total_aber"), F.avg((F.col("arm_major_ploidy") >= 2).cast("double")).alias("wgd_event"), listed.alias("arms"))
    side = lambda x: F.filter(F.transform("arms", lambda a, i: F.when(a[x] > 0, i).when(a[x] < 0, -1)), lambda k: k.isNotNull())
    d = d.withColumn("slots", F.concat(side("A"), side("B")))  # number of the arm, -1 for a loss
    chunk = 250
    each = spread(d.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-perm_times // chunk) - 1)))), sample_field, "chunk")
    slot = lambda perm, e: F.element_at("slots", F.floor(uniform(seed, F.col(sample_field), perm, e) * F.size("slots")).cast("int") + 1)
    events = F.sequence(F.lit(1), F.floor("total_aber").cast("int"))
    gained = lambda perm: F.size(F.array_distinct(F.filter(F.transform(events, lambda e: slot(perm, e)), lambda k: k >= 0)))
    reached = lambda perm: gained(perm) / F.size("arms") >= F.col("wgd_event")
    perms = F.sequence(F.col("chunk") * chunk + 1, F.least((F.col("chunk") + 1) * chunk, F.lit(perm_times)))
    drawn = (F.col("wgd_event") < 1) & (F.col("total_aber") >= 1) & (F.size("slots") > 0)
    each = each.withColumn("hits", F.when(drawn, F.size(F.filter(perms, reached))))
    p = F.when(F.first("total_aber") == 0, 1.0).when(F.first("wgd_event") == 1, 0.0).otherwise(F.coalesce(F.sum("hits"), F.lit(perm_times)) / perm_times)
    out = each.groupBy(sample_field, "ploidy").agg(p.alias("pvalue"), F.first("total_aber").alias("total_aber"), F.first("wgd_event").alias("wgd_event"))
    return out.withColumn("wGD", wgd_state(F.col("pvalue"), F.col("ploidy").cast("double")))
