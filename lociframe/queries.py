"""Registered queries over the star-schema tables and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from ._shared import fresh_path
from .functions.columns import p_adjust, proportion_ci
from .functions.draws import uniform_sql
from .operators import arm, ccf, decomposition, ids, intervals, nmf_consensus, rrho, snv, ssgsea
from .operators.cnv_signature import cnv_classes, cnv_signature
from .operators.subclone import subclone_cn
from .operators.sweep import sweep_join
from .plans.ccf_pipeline import prepare_pyclone, run_ccf
from .sources import absolute_io, fasta, netmhc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = A.duck(sql)
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


LOGC = lambda n, k: f"(LGAMMA({n} + 1E0) - LGAMMA({k} + 1E0) - LGAMMA({n} - ({k}) + 1E0))"
MUT, SEG, BAND = f"mut AS ({A.MUTATIONS})", f"seg AS ({A.SEGMENTS})", f"band AS ({A.CYTOBANDS})"
JOINED = "jm AS (SELECT mut.*, seg.startpos, seg.endpos, seg.nMajor, seg.nMinor, seg.nAraw, seg.nBraw, seg.purity FROM mut JOIN seg ON mut.sample = seg.sample AND mut.chr = seg.chr AND seg.startpos <= mut.pos AND seg.endpos >= mut.pos)"
ON = dict(on_sample="sample", start_field="startpos", end_field="endpos", mut_id="mut_id")


def mut_seg(s, d):
    return A.load(s, d, A.MUTATIONS), A.load(s, d, A.SEGMENTS)


# -- intervals and copy number ----------------------------------------------------


@query(f"WITH {MUT}, {SEG}, {JOINED} SELECT mut_id, sample, chr, pos, startpos, endpos, nMajor AS major, nMinor AS minor FROM jm")
def identify_mut_cn(s, d):
    return intervals.identify_mut_cn(*mut_seg(s, d), **ON).selectExpr("mut_id", "sample", "chr", "pos", "startpos", "endpos", "nMajor as major", "nMinor as minor")


@query(f"WITH {MUT}, {SEG} SELECT mut_id, seg.startpos AS startpos, seg.nMajor AS major FROM mut LEFT JOIN seg ON mut.sample = seg.sample AND mut.chr = seg.chr AND seg.startpos <= mut.pos AND seg.endpos >= mut.pos")
def identify_mut_cn_nomatch(s, d):
    return intervals.identify_mut_cn(*mut_seg(s, d), nomatch="NA", **ON).selectExpr("mut_id", "startpos", "nMajor as major")


@query(f"WITH {MUT}, {SEG}, {JOINED} SELECT mut_id, startpos FROM jm")
def identify_mut_cn_binned(s, d):
    return intervals.identify_mut_cn(*mut_seg(s, d), bin_width=100_000, **ON).select("mut_id", "startpos")


@query(f"WITH {MUT}, {SEG} SELECT mut_id, mut.sample AS sample, mut.chr AS chr, pos, seg.startpos AS startpos, seg.endpos AS endpos FROM mut LEFT JOIN seg ON mut.sample = seg.sample AND mut.chr = seg.chr AND seg.startpos <= mut.pos AND seg.endpos >= mut.pos")
def identify_mut_cn_swept(s, d):
    return sweep_join(*mut_seg(s, d), [("sample", "sample"), ("chr", "chr")], "pos", "startpos", "endpos", "left", rows_per_cell=2000).select("mut_id", "sample", "chr", "pos", "startpos", "endpos")


@query(f"WITH {MUT}, {SEG}, {JOINED} SELECT mut_id, ROUND(LEAST(purity / (2 * (1 - purity) + purity * (nAraw + nBraw)), 1.0), 6) AS exp_vaf, ROUND(CAST(alt_counts AS DOUBLE) / (alt_counts + ref_counts), 6) AS obs_vaf, ROUND(CAST(alt_counts AS DOUBLE) / (alt_counts + ref_counts) / purity * (purity * (nAraw + nBraw) + 2 * (1 - purity)), 6) AS mut_copies FROM jm")
def ccf_observed(s, d):
    j = intervals.identify_mut_cn(*mut_seg(s, d), **ON).withColumnsRenamed({"nAraw": "major_raw", "nBraw": "minor_raw"}).withColumn("normal_cn", F.lit(2))
    return rounded(ccf.observed(j).selectExpr("mut_id", "expVAF as exp_vaf", "obsVAF as obs_vaf", "mutCopyNum as mut_copies"), "exp_vaf", "obs_vaf", "mut_copies")


SUB = """sn AS (SELECT *, CASE WHEN x < 0.01 THEN 0.0 WHEN x > 0.99 THEN 1.0 ELSE x END AS j1, CASE WHEN 1 - x < 0.01 THEN 0.0 WHEN 1 - x > 0.99 THEN 1.0 ELSE 1 - x END AS j2,
 CASE WHEN y < 0.01 THEN 0.0 WHEN y > 0.99 THEN 1.0 ELSE y END AS n1, CASE WHEN 1 - y < 0.01 THEN 0.0 WHEN 1 - y > 0.99 THEN 1.0 ELSE 1 - y END AS n2
 FROM (SELECT *, CEIL(nAraw) - nAraw AS x, CEIL(nBraw) - nBraw AS y FROM seg) t),
 sk AS (SELECT *, (j1 = n1 OR j1 = n2 OR j1 IN (0, 1) OR n1 IN (0, 1)) AS two, GREATEST(j1, j2) AS ja, LEAST(j1, j2) AS jb, GREATEST(n1, n2) AS na, LEAST(n1, n2) AS nb FROM sn)"""


@query(
    f"""WITH {SEG}, {SUB} SELECT sample, chr, startpos,
 ROUND(CASE WHEN two THEN CASE WHEN na = 1 THEN ja WHEN ja = 1 THEN na ELSE ja END ELSE j1 * n1 END, 6) AS frac_a,
 ROUND(CASE WHEN two THEN CASE WHEN na = 1 THEN jb WHEN ja = 1 THEN nb ELSE jb END ELSE j1 - j1 * n1 END, 6) AS frac_b,
 ROUND(CASE WHEN NOT two THEN j2 * n2 END, 6) AS frac_c, ROUND(CASE WHEN NOT two THEN j2 - j2 * n2 END, 6) AS frac_d,
 CASE WHEN two AND ja <> j1 THEN CEIL(nAraw) ELSE FLOOR(nAraw) END AS maj_a, CASE WHEN NOT two THEN CEIL(nBraw) END AS min_c FROM sk"""
)
def subclone_states(s, d):
    x = subclone_cn(A.load(s, d, A.SEGMENTS)).selectExpr("sample", "chr", "startpos", "fracA as frac_a", "fracB as frac_b", "fracC as frac_c", "fracD as frac_d", "nMaj_A as maj_a", "nMin_C as min_c")
    return rounded(x, "frac_a", "frac_b", "frac_c", "frac_d")


Z = "1.959963984540054E0"
WILSON = f"""wi AS (SELECT mut_id, alt_counts + 0E0 AS x, alt_counts + ref_counts + 0E0 AS n FROM mut),
 wj AS (SELECT *, x / n AS e, LEAST(0.5E0, ABS(x - n * 0.5E0)) / n AS y, {Z} * {Z} / (2 * n) AS a FROM wi)"""


@query(
    f"""WITH {MUT}, {WILSON} SELECT mut_id,
 ROUND(CASE WHEN e - y <= 0 THEN 0.0 ELSE (e - y + a - {Z} * SQRT((e - y) * (1 - (e - y)) / n + a / (2 * n))) / (1 + 2 * a) END, 6) AS lower_vaf,
 ROUND(CASE WHEN e + y >= 1 THEN 1.0 ELSE (e + y + a + {Z} * SQRT((e + y) * (1 - (e + y)) / n + a / (2 * n))) / (1 + 2 * a) END, 6) AS upper_vaf FROM wj"""
)
def proportion_interval(s, d):
    m = A.load(s, d, A.MUTATIONS)
    lo, hi = proportion_ci("alt_counts", F.col("alt_counts") + F.col("ref_counts"))
    return rounded(m.select("mut_id", lo.alias("lower_vaf"), hi.alias("upper_vaf")), "lower_vaf", "upper_vaf")


def _joined(s, d):
    j = intervals.identify_mut_cn(*mut_seg(s, d), **ON)
    return j.withColumnsRenamed({"nMajor": "major_cn", "nMinor": "minor_cn"}).withColumn("normal_cn", F.lit(2))


MT = """mk AS (SELECT mut_id, k, CASE WHEN k * purity = 0 THEN 0.01 ELSE k * purity / ((nMajor + nMinor) * purity + 2 * (1 - purity)) END * (alt_counts + ref_counts) AS rate, alt_counts + 0E0 AS x
 FROM jm, UNNEST(RANGE(1, CAST(nMajor AS BIGINT) + 1)) AS u(k))"""


@query(f"WITH {MUT}, {SEG}, {JOINED}, {MT}, best AS (SELECT mut_id, ARG_MAX(k, x * LN(rate) - rate) AS mt FROM mk GROUP BY mut_id) SELECT jm.mut_id, CAST(best.mt AS DOUBLE) AS mt FROM jm LEFT JOIN best ON jm.mut_id = best.mut_id")
def mt_likelihood(s, d):
    return ccf.mutation_types(_joined(s, d)).selectExpr("mut_id", "Mt as mt")


@query(
    f"""WITH {MUT}, {SEG}, {JOINED}, {MT}, best AS (SELECT mut_id, ARG_MAX(k, x * LN(rate) - rate) AS mt FROM mk GROUP BY mut_id),
 v AS (SELECT jm.mut_id, mt, purity, ref_counts, nMajor + nMinor AS t, CAST(alt_counts AS DOUBLE) / (alt_counts + ref_counts) AS f, alt_counts + ref_counts AS n FROM jm LEFT JOIN best ON jm.mut_id = best.mut_id)
 SELECT mut_id, ROUND(f / purity * (purity * t + 2 * (1 - purity)) / mt, 6) AS ccf, ROUND((f - {Z} * SQRT(f * (1 - f) / n)) / purity * (purity * t + 2 * (1 - purity)) / mt, 6) AS ccf_low FROM v"""
)
def bootstrap_ccf_analytic(s, d):
    x = ccf.bootstrap_ccf(_joined(s, d), analytic=True).selectExpr("mut_id", "CCF as ccf", "CCF_btstr_lower as ccf_low")
    return rounded(x, "ccf", "ccf_low")


@query(
    f"""WITH {MUT}, {SEG}, {JOINED}, {MT}, best AS (SELECT mut_id, ARG_MAX(k, x * LN(rate) - rate) AS mt FROM mk GROUP BY mut_id),
 pc AS (SELECT DISTINCT alt_counts AS a, ref_counts AS r, alt_counts + ref_counts AS n FROM jm WHERE alt_counts + ref_counts > 0),
 pm AS (SELECT a, r, k, SUM(CASE WHEN a = 0 THEN CASE WHEN k = 0 THEN 1E0 ELSE 0E0 END WHEN r = 0 THEN 0E0 ELSE EXP({LOGC("n", "k")} + k * LN(a / CAST(n AS DOUBLE)) + (n - k) * LN(1 - a / CAST(n AS DOUBLE))) END) OVER (PARTITION BY a, r ORDER BY k) AS c FROM pc, UNNEST(RANGE(0, CAST(n AS BIGINT))) AS u(k)),
 dr AS (SELECT a, r, n, {uniform_sql(1, 'a', 'r', 'i')} AS u FROM pc, UNNEST(RANGE(1, 1001)) AS v(i)),
 dk AS (SELECT dr.a, dr.r, dr.n, COALESCE(pm.k + 1, 0) AS k FROM dr ASOF LEFT JOIN pm ON dr.a = pm.a AND dr.r = pm.r AND dr.u >= pm.c),
 bt AS (SELECT a, r, 2E0 * a / n - SUM(k) / 1000E0 / n AS mid, SQRT(GREATEST(0, SUM(k * k) - SUM(k) * SUM(k) / 1000E0) / 999) / n AS sd FROM dk GROUP BY a, r, n),
 wl AS (SELECT jm.mut_id, mt, purity, ref_counts, nMajor + nMinor AS t, alt_counts / CAST(alt_counts + ref_counts AS DOUBLE) AS f, mid - {Z} * sd AS lo, mid + {Z} * sd AS hi FROM jm LEFT JOIN best ON jm.mut_id = best.mut_id LEFT JOIN bt ON bt.a = alt_counts AND bt.r = ref_counts)
 SELECT mut_id, ROUND(f / purity * (purity * t + 2 * (1 - purity)) / mt, 6) AS ccf, ROUND(lo / purity * (purity * t + 2 * (1 - purity)) / mt, 6) AS ccf_low, ROUND(hi / purity * (purity * t + 2 * (1 - purity)) / mt, 6) AS ccf_high FROM wl"""
)
def bootstrap_ccf(s, d):
    x = ccf.bootstrap_ccf(_joined(s, d)).selectExpr("mut_id", "CCF as ccf", "CCF_btstr_lower as ccf_low", "CCF_btstr_higher as ccf_high")
    return rounded(x, "ccf", "ccf_low", "ccf_high")


ABS = """vf AS (SELECT mut_id, alt_counts AS a, ref_counts AS r, g, LEAST(purity * (g / 100E0) / (2 * (1 - purity) + purity * (nAraw + nBraw)), 1E0) AS f FROM jm, UNNEST(RANGE(1, 101)) AS u(g) WHERE alt_counts + ref_counts > 0),
 lk AS (SELECT mut_id, g, CASE WHEN f >= 1 AND r > 0 THEN 0E0 ELSE EXP(LGAMMA(a + r + 1E0) - LGAMMA(a + 1E0) - LGAMMA(r + 1E0) + CASE WHEN a > 0 THEN a * LN(f) ELSE 0 END + CASE WHEN r > 0 THEN r * LN(1 - f) ELSE 0 END) END AS x FROM vf),
 lx AS (SELECT mut_id, g, CASE WHEN g = 100 AND MIN(x) OVER (PARTITION BY mut_id) = 0 THEN 1E0 ELSE x END AS x FROM lk),
 sh AS (SELECT *, x / SUM(x) OVER (PARTITION BY mut_id) AS s, MAX(x) OVER (PARTITION BY mut_id) * (1 - 1E-9) AS top FROM lx),
 cu AS (SELECT *, SUM(s) OVER w AS c, ROW_NUMBER() OVER w AS k FROM sh WINDOW w AS (PARTITION BY mut_id ORDER BY s DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 th AS (SELECT mut_id, LEAST(99, SUM(CASE WHEN c < 0.95E0 THEN 1 ELSE 0 END)) + 1 AS k FROM cu GROUP BY mut_id),
 cut AS (SELECT cu.mut_id, cu.s * (1 - 1E-9) AS least FROM cu JOIN th ON cu.mut_id = th.mut_id AND cu.k = th.k)"""


@query(
    f"""WITH {MUT}, {SEG}, {JOINED}, {ABS} SELECT cu.mut_id, ROUND(MIN(CASE WHEN s >= least THEN g END) / 100E0, 6) AS lower, ROUND(MIN(CASE WHEN x >= top THEN g END) / 100E0, 6) AS est, ROUND(MAX(CASE WHEN s >= least THEN g END) / 100E0, 6) AS higher,
 ROUND(SUM(CASE WHEN g <= 90 THEN s ELSE 0 END), 6) AS prob_subclonal, ROUND(SUM(CASE WHEN g > 90 THEN s ELSE 0 END), 6) AS prob_clonal FROM cu JOIN cut ON cu.mut_id = cut.mut_id GROUP BY cu.mut_id"""
)
def abs_ccf(s, d):
    j = _joined(s, d).withColumn("a", ccf.abs_ccf("alt_counts", "ref_counts", F.col("nAraw") + F.col("nBraw"), "purity", "normal_cn"))
    return rounded(j.select("mut_id", "a.*"), "lower", "est", "higher", "prob_subclonal", "prob_clonal")


@query()
def phylo_ccf(s, d):
    return run_ccf(*mut_seg(s, d), ref_field="ref", alt_field="alt", mut_id="mut_id")


@query()
def phylo_ccf_conipher(s, d):
    return run_ccf(*mut_seg(s, d), ccf_type=("phyloCCF", "bootstrapCCF"), conipher=True, min_vaf_to_explain=0.05, normal_cn=None, gender_field="gender", mut_id="mut_id")


@query(f"WITH {MUT}, {SEG}, {JOINED} SELECT CONCAT_WS(':', sample, chr, CAST(pos AS STRING), ref) AS mutation_id, sample AS sample_id, ref_counts, alt_counts AS var_counts, 2 AS normal_cn, nMinor AS minor_cn, nMajor AS major_cn, purity AS tumour_content FROM jm WHERE nMajor > 0")
def pyclone_input(s, d):
    return prepare_pyclone(*mut_seg(s, d), mut_id="mut_id")


# -- arms --------------------------------------------------------------------------

ARM = """arm AS (SELECT * FROM (SELECT REPLACE(chr, 'chr', '') AS chr, CASE WHEN "gieStain" = 'acen' THEN 'acen' ELSE SUBSTRING(name, 1, 1) END AS arm, MIN(start) AS arm_start, MAX("end") AS arm_end FROM band GROUP BY 1, 2) t)"""
HIT = "hit AS (SELECT seg.*, arm.arm, GREATEST(startpos, arm_start) AS hs, LEAST(endpos, arm_end) AS he, arm_end - arm_start + 1 AS arm_width FROM seg JOIN arm ON seg.chr = arm.chr AND startpos <= arm_end AND endpos >= arm_start WHERE arm.arm <> 'acen')"
NOCEN = "hitc AS (SELECT * FROM hit WHERE NOT EXISTS (SELECT 1 FROM band WHERE \"gieStain\" = 'acen' AND REPLACE(band.chr, 'chr', '') = hit.chr AND hit.startpos <= band.\"end\" AND hit.endpos >= band.start))"


def seg_band(s, d):
    return A.load(s, d, A.SEGMENTS), arm.get_cytoband(A.load(s, d, A.CYTOBANDS))


@query(f"WITH {BAND}, {ARM} SELECT chr, arm, arm_start AS start_pos, arm_end AS end_pos FROM arm")
def arm_ranges(s, d):
    return arm.arm_ranges(seg_band(s, d)[1]).selectExpr("chr", "arm", "start as start_pos", "`end` as end_pos")


@query(f"WITH {SEG}, {BAND}, {ARM}, {HIT}, {NOCEN}, g AS (SELECT * FROM (SELECT DISTINCT sample FROM seg) s CROSS JOIN arm WHERE arm <> 'acen') SELECT g.sample, g.chr, g.arm, g.arm_end - g.arm_start + 1 AS arm_width, hs AS seg_start, he AS seg_end, he - hs + 1 AS width, nMajor AS major FROM g LEFT JOIN hitc ON g.sample = hitc.sample AND g.chr = hitc.chr AND g.arm = hitc.arm")
def summarize_arm(s, d):
    x = arm.summarize_arm(*seg_band(s, d), "sample", ["nMajor"])
    return x.selectExpr("sample", "chr", "arm", "arm_width", "seg_start", "seg_end", "width", "nMajor as major")


@query(f"WITH {SEG}, {BAND}, {ARM}, {HIT}, {NOCEN}, g AS (SELECT * FROM (SELECT DISTINCT sample FROM seg) s CROSS JOIN arm WHERE arm <> 'acen'), w AS (SELECT sample, chr, arm, SUM(CASE WHEN nMajor - 2 <> 0 THEN CAST(he - hs + 1 AS DOUBLE) / arm_width ELSE 0 END) AS share FROM hitc GROUP BY 1, 2, 3) SELECT g.sample, g.chr, g.arm, CASE WHEN COALESCE(share, 0) > 0.5 THEN 1 ELSE 0 END AS arm_cnv FROM g LEFT JOIN w ON g.sample = w.sample AND g.chr = w.chr AND g.arm = w.arm")
def arm_cnv_rel(s, d):
    seg, band = seg_band(s, d)
    return arm.arm_cnv(seg.withColumn("cnv", F.col("nMajor") - 2), band, "sample", threshold=0.5)


def _wmedian(src: str, value: str, keys: str) -> str:
    """Interpolated weighted median of integer values in SQL."""
    return f"""wv AS (SELECT {keys}, {value} + 0E0 AS v, SUM(he - hs + 1) + 0E0 AS w FROM {src} GROUP BY {keys}, {value}),
 wc AS (SELECT *, SUM(w) OVER (PARTITION BY {keys} ORDER BY v) - w / 2 AS c, SUM(w) OVER (PARTITION BY {keys}) / 2 AS h FROM wv),
 wb AS (SELECT {keys}, ANY_VALUE(h) AS h, MAX(CASE WHEN c <= h THEN c END) AS lc, MAX(CASE WHEN c <= h THEN v END) AS lv, MIN(CASE WHEN c >= h THEN c END) AS hc, MIN(CASE WHEN c >= h THEN v END) AS hv FROM wc GROUP BY {keys}),
 wm AS (SELECT {keys}, CASE WHEN lc IS NULL THEN hv WHEN hc IS NULL THEN lv WHEN hc = lc THEN lv ELSE lv + (hv - lv) * (h - lc) / (hc - lc) END AS med FROM wb)"""


@query(f"WITH {SEG}, {BAND}, {ARM}, {HIT}, {NOCEN}, {_wmedian('hitc', 'nMajor + nMinor', 'sample, ploidy, chr, arm')}, g AS (SELECT * FROM (SELECT DISTINCT sample, ploidy FROM seg) s CROSS JOIN arm WHERE arm <> 'acen') SELECT g.sample, g.chr, g.arm, CAST(SIGN(ROUND_EVEN(med, 0) - ROUND_EVEN(g.ploidy, 0)) AS INT) AS arm_cnv FROM g LEFT JOIN wm ON g.sample = wm.sample AND g.chr = wm.chr AND g.arm = wm.arm")
def arm_cnv_abs(s, d):
    seg, band = seg_band(s, d)
    return arm.arm_cnv(seg.withColumn("cnv", F.col("nMajor") + F.col("nMinor")), band, "sample", cnv_mode="abs", ploidy_field="ploidy")


@query(f"WITH {SEG}, {BAND}, {ARM}, {HIT}, t AS (SELECT SUM(arm_end - arm_start + 1) AS total FROM arm WHERE arm <> 'acen') SELECT sample, ROUND(SUM(CASE WHEN nMajor >= 2 THEN he - hs + 1 ELSE 0 END) / CAST(ANY_VALUE(total) AS DOUBLE), 6) AS above_2, ROUND(SUM(CASE WHEN nMajor >= 3 THEN he - hs + 1 ELSE 0 END) / CAST(ANY_VALUE(total) AS DOUBLE), 6) AS above_3 FROM hit CROSS JOIN t GROUP BY sample")
def wgd_fraction(s, d):
    x = arm.wgd_fraction(*seg_band(s, d), "sample", major_cn_field="nMajor")
    return rounded(x.selectExpr("sample", "Genome_prop_above_2 as above_2", "Genome_prop_above_3 as above_3"), "above_2", "above_3")


@query(f"WITH {SEG}, {BAND}, {ARM}, {HIT}, {_wmedian('hit', 'nMinor', 'sample, chr, arm')} SELECT sample, chr, arm, ROUND(med, 6) AS arm_minor_ploidy FROM wm")
def wgd_arm_ploidy(s, d):
    x = arm.wgd_arms(*seg_band(s, d), "sample", "nMajor", "nMinor")
    return rounded(x.select("sample", "chr", "arm", "arm_minor_ploidy"), "arm_minor_ploidy")


def _other(sql: str) -> str:
    """A weighted median's CTEs under other names."""
    return re.sub(r"\bw([vcbm])\b", r"x\1", sql)


@query(
    f"""WITH {SEG}, {BAND}, {ARM}, {HIT}, {_wmedian('hit', 'nMinor', 'sample, ploidy, chr, arm')}, {_other(_wmedian('hit', 'nMajor + nMinor', 'sample, ploidy, chr, arm'))},
 ar AS (SELECT wm.sample, wm.ploidy, wm.chr, wm.arm, wm.med AS mi, xm.med - wm.med AS ma FROM wm JOIN xm ON wm.sample = xm.sample AND wm.chr = xm.chr AND wm.arm = xm.arm),
 tt AS (SELECT sample, ploidy, SUM(ABS(mi - 1)) + SUM(ABS(ma - 1)) AS total, AVG(CASE WHEN ma >= 2 THEN 1E0 ELSE 0E0 END) AS event, COUNT(*) AS arms FROM ar GROUP BY sample, ploidy),
 sl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY side, chr, arm) - 1 AS k, COUNT(*) OVER (PARTITION BY sample) AS slots FROM (SELECT sample, 0 AS side, chr, arm, SIGN(ma - 1) AS s FROM ar UNION ALL SELECT sample, 1, chr, arm, SIGN(mi - 1) FROM ar) t WHERE s <> 0),
 dr AS (SELECT tt.sample, perm, CAST(FLOOR({uniform_sql(1, 'tt.sample', 'perm', 'ev')} * z.slots) AS BIGINT) AS k FROM tt JOIN (SELECT DISTINCT sample, slots FROM sl) z ON z.sample = tt.sample, UNNEST(RANGE(1, 10001)) AS a(perm), UNNEST(RANGE(1, CAST(FLOOR(total) AS BIGINT) + 1)) AS b(ev)),
 gn AS (SELECT dr.sample, perm, COUNT(DISTINCT chr || arm) FILTER (s > 0) AS n FROM dr JOIN sl ON dr.sample = sl.sample AND dr.k = sl.k GROUP BY dr.sample, perm),
 pv AS (SELECT tt.*, CASE WHEN total = 0 THEN 1E0 WHEN event = 1 THEN 0E0 ELSE (SELECT COUNT(*) FROM gn WHERE gn.sample = tt.sample AND CAST(n AS DOUBLE) / arms >= event) / 10000E0 END AS p, ROUND_EVEN(ploidy, 0) AS r FROM tt)
 SELECT sample, ploidy, ROUND(p, 6) AS pvalue, ROUND(total, 6) AS total_aber, ROUND(event, 6) AS wgd_event, CASE WHEN r >= 6 AND p <= 1 OR r = 5 AND p <= 0.5E0 OR r = 4 AND p <= 0.05E0 OR r <= 3 AND p <= 0.001E0 THEN 'GD' ELSE 'nGD' END AS wgd FROM pv"""
)
def wgd_test(s, d):
    x = arm.wgd_test(*seg_band(s, d), "sample", major_cn_field="nMajor", minor_cn_field="nMinor")
    return rounded(x.withColumnRenamed("wGD", "wgd"), "pvalue", "total_aber", "wgd_event")


@query(f"WITH {BAND}, o AS (SELECT *, MAX(\"end\") OVER (PARTITION BY chr ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM band WHERE \"gieStain\" <> 'gneg'), p AS (SELECT *, SUM(CASE WHEN r IS NULL OR start > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, \"end\") AS k FROM o) SELECT chr, MIN(start) AS start_pos, MAX(\"end\") AS end_pos FROM p GROUP BY chr, k")
def reduce_ranges(s, d):
    return intervals.reduce_ranges(A.load(s, d, A.CYTOBANDS).where("gieStain <> 'gneg'"), ["chr"]).selectExpr("chr", "start as start_pos", "`end` as end_pos")


# -- signatures ----------------------------------------------------------------------

CLASS = """cl AS (SELECT sample, CONCAT(CASE WHEN t = 0 THEN '0' WHEN t = 1 THEN '1' WHEN t = 2 THEN '2' WHEN t <= 4 THEN '3-4' WHEN t <= 8 THEN '5-8' ELSE '9+' END, ':', st, ':',
 CASE WHEN mb <= 0.1 THEN '0-100kb' WHEN mb <= 1 THEN '100kb-1Mb' WHEN st = 'homdel' THEN '>1Mb' WHEN mb <= 10 THEN '1Mb-10Mb' WHEN mb <= 40 THEN '10Mb-40Mb' ELSE '>40Mb' END) AS cnv_class
 FROM (SELECT sample, nMajor + nMinor AS t, CASE WHEN nMajor + nMinor = 0 THEN 'homdel' WHEN LEAST(nMajor, nMinor) = 0 THEN 'LOH' ELSE 'het' END AS st, (endpos * 30 - startpos + 1) / 1E6 AS mb FROM seg) q)"""
LEVELS = ", ".join(f"('{c}')" for c in cnv_classes())


@query(f"WITH {SEG}, {CLASS}, lv AS (SELECT * FROM (VALUES {LEVELS}) AS v(cnv_class)), n AS (SELECT sample, cnv_class, COUNT(*) AS n FROM cl GROUP BY 1, 2) SELECT lv.cnv_class, s.sample, COALESCE(n.n, 0) AS n FROM lv CROSS JOIN (SELECT DISTINCT sample FROM seg) s LEFT JOIN n ON n.sample = s.sample AND n.cnv_class = lv.cnv_class")
def cnv_signature_counts(s, d):
    seg = A.load(s, d, A.SEGMENTS).withColumn("stop", F.col("endpos") * 30)
    return cnv_signature(seg, "sample", "startpos", "stop", "nMajor", "nMinor").select("cnv_class", "sample", "n")


def genome(s, d):
    return snv.chunk_genome(A.load(s, d, A.SEQUENCES))


COMP = lambda x: f"TRANSLATE({x}, 'ACGT', 'TGCA')"
CTX = f"""sq AS ({A.SEQUENCES}), mu AS ({A.SNVS}),
 cx AS (SELECT mu.*, SUBSTRING(sq.seq, CAST(pos - 1 AS BIGINT), 3) AS c3, SUBSTRING(sq.seq, CAST(pos - 20 AS BIGINT), 41) AS c41, pos > 20 AND pos + 20 <= LENGTH(sq.seq) AS wide FROM mu JOIN sq ON mu.chr = sq.chr WHERE ref <> alt AND pos > 1 AND pos < LENGTH(sq.seq)),
 st AS (SELECT *, CASE WHEN ref IN ('A', 'G') THEN {COMP("REVERSE(c3)")} ELSE c3 END AS k3, CASE WHEN ref IN ('A', 'G') THEN CONCAT({COMP("ref")}, '>', {COMP("alt")}) ELSE CONCAT(ref, '>', alt) END AS sub FROM cx)"""
SNV_LEVELS = ", ".join(f"('{c}')" for c in snv.substitution_contexts())


SNV_SQL = f"WITH {CTX}, lv AS (SELECT * FROM (VALUES {SNV_LEVELS}) AS v(snv_class)), n AS (SELECT sample, CONCAT(SUBSTRING(k3, 1, 1), '[', sub, ']', SUBSTRING(k3, 3, 1)) AS snv_class, COUNT(*) AS n FROM st GROUP BY 1, 2) SELECT lv.snv_class, s.sample, COALESCE(n.n, 0) AS n FROM lv CROSS JOIN (SELECT DISTINCT sample FROM st) s LEFT JOIN n ON n.sample = s.sample AND n.snv_class = lv.snv_class"


@query(SNV_SQL)
def snv_signature_counts(s, d):
    return snv.snv_signature(A.load(s, d, A.SNVS), genome(s, d), "sample").select("snv_class", "sample", "n")


@query(f"WITH sq AS ({A.SEQUENCES}), k AS (SELECT SUBSTRING(seq, CAST(i AS BIGINT), 3) AS c FROM sq, UNNEST(RANGE(1, LENGTH(seq) - 1)) AS u(i) WHERE LENGTH(seq) >= 3), b AS (SELECT c FROM k UNION ALL SELECT {COMP('REVERSE(c)')} FROM k) SELECT c AS context, ROUND(1E9 / COUNT(*), 6) AS per_billion FROM b WHERE SUBSTRING(c, 2, 1) IN ('C', 'T') GROUP BY c")
def context_sizefactor(s, d):
    x = snv.context_sizefactor(snv.contexts(["T", "C"]), genome(s, d))
    return x.where("factor is not null").select("context", F.round(F.col("factor") * 1e9, 6).alias("per_billion"))


@query(SNV_SQL)
def fasta_signature_counts(s, d):
    path = fresh_path(s, "genome")
    fasta.write_fasta(A.load(s, d, A.SEQUENCES), path)
    return snv.snv_signature(A.load(s, d, A.SNVS), fasta.read_fasta(s, path), "sample").select("snv_class", "sample", "n")


def _both_strands(k: str) -> str:
    return f"SELECT c, COUNT(*) AS n FROM (SELECT c FROM {k} UNION ALL SELECT {COMP('REVERSE(c)')} FROM {k}) t WHERE SUBSTRING(c, 2, 1) IN ('C', 'T') GROUP BY c"


SIZES = f"""sq AS ({A.SEQUENCES}), rg AS ({A.REGIONS}),
 ro AS (SELECT *, MAX("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM rg),
 rp AS (SELECT *, SUM(CASE WHEN r IS NULL OR start > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM ro),
 me AS (SELECT chr, MIN(start) AS lo, MAX("end") AS hi FROM rp GROUP BY chr, island),
 kg AS (SELECT SUBSTRING(seq, CAST(i AS BIGINT), 3) AS c FROM sq, UNNEST(RANGE(1, LENGTH(seq) - 1)) AS u(i) WHERE LENGTH(seq) >= 3),
 ke AS (SELECT SUBSTRING(seq, CAST(i AS BIGINT), 3) AS c FROM me JOIN sq ON me.chr = sq.chr, UNNEST(RANGE(lo, hi - 1)) AS u(i) WHERE hi - lo >= 2),
 wg AS ({_both_strands('kg')}), we AS ({_both_strands('ke')})"""


def _sizefactor(s, d, method, scale):
    x = snv.context_sizefactor(snv.contexts(["T", "C"]), genome(s, d), A.load(s, d, A.REGIONS), method)
    return x.where("factor is not null").select("context", F.round(F.col("factor") * scale, 6).alias("factor"))


@query(f"WITH {SIZES} SELECT c AS context, ROUND(1E9 / n, 6) AS factor FROM we")
def sizefactor_exome(s, d):
    return _sizefactor(s, d, "exome", 1e9)


@query(f"WITH {SIZES} SELECT c AS context, ROUND(CAST(wg.n AS DOUBLE) / we.n, 6) AS factor FROM wg JOIN we USING (c)")
def sizefactor_exome2genome(s, d):
    return _sizefactor(s, d, "exome2genome", 1.0)


@query(f"WITH {SIZES} SELECT c AS context, ROUND(CAST(we.n AS DOUBLE) / wg.n, 6) AS factor FROM wg JOIN we USING (c)")
def sizefactor_genome2exome(s, d):
    return _sizefactor(s, d, "genome2exome", 1.0)


CNT = lambda m: f"(LENGTH(c41) - LENGTH(REPLACE(c41, '{m}', '')))"
CNT3 = lambda m: f"LEN(LIST_FILTER(RANGE(1, 40), lambda i: SUBSTRING(c41, CAST(i AS BIGINT), 3) = '{m}'))"


MOTIF = f"""bg AS (SELECT sample, c3 IN ('TCA', 'TCT', 'TGA', 'AGA') AS sig, {CNT('C')} + {CNT('G')} AS bn, {CNT3('TCA')} + {CNT3('TCT')} + {CNT3('TGA')} + {CNT3('AGA')} AS sn FROM st WHERE wide AND sub IN ('C>T', 'C>G'))"""


@query(
    f"""WITH {CTX}, {MOTIF}
 SELECT sample, CAST(SUM(CASE WHEN sig THEN 1 ELSE 0 END) AS BIGINT) AS signature_mut_freq, COUNT(*) AS background_mut_freq, CAST(SUM(sn) AS BIGINT) AS signature_context, CAST(SUM(bn) AS BIGINT) AS background_context,
 ROUND(CAST(SUM(CASE WHEN sig THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) / (CAST(SUM(sn) AS DOUBLE) / SUM(bn)), 6) AS enrichment FROM bg GROUP BY sample"""
)
def motif_enrichment(s, d):
    x = snv.motif_table(A.load(s, d, A.SNVS), genome(s, d))
    return rounded(x, "enrichment").select("sample", "signature_mut_freq", "background_mut_freq", "signature_context", "background_context", "enrichment")


@query(
    f"""WITH {CTX}, {MOTIF}, ct AS (SELECT sample, CAST(SUM(CASE WHEN sig THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(SUM(sn) AS BIGINT) AS b, CAST(COUNT(*) - SUM(CASE WHEN sig THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(SUM(bn) - SUM(sn) AS BIGINT) AS e FROM bg GROUP BY sample),
 xs AS (SELECT *, UNNEST(RANGE(a, LEAST(a + b, a + c) + 1)) AS x FROM ct),
 ls AS (SELECT sample, {LOGC("a + b", "x")} + {LOGC("c + e", "a + c - x")} - {LOGC("a + b + c + e", "a + c")} AS l FROM xs WHERE a + c - x <= c + e),
 mx AS (SELECT sample, MAX(l) AS m FROM ls GROUP BY sample)
 SELECT ls.sample, ROUND(EXP(LEAST(0E0, ANY_VALUE(m) + LN(SUM(EXP(l - m))))), 6) AS fisher_pvalue FROM ls JOIN mx ON ls.sample = mx.sample GROUP BY ls.sample"""
)
def motif_fisher_pvalue(s, d):
    return rounded(snv.motif_fisher(A.load(s, d, A.SNVS), genome(s, d)).select("sample", "fisher_pvalue"), "fisher_pvalue")


@query()
def motif_fisher(s, d):
    return snv.motif_fisher(A.load(s, d, A.SNVS), genome(s, d))


# -- ranks ------------------------------------------------------------------------------

RANKS = f"li AS ({A.LISTS}), rk AS (SELECT item, v1, v2, ROW_NUMBER() OVER (ORDER BY v1 DESC, item) AS r1, ROW_NUMBER() OVER (ORDER BY v2 DESC, item) AS r2 FROM li), nn AS (SELECT COUNT(*) AS n, CAST(FLOOR(COUNT(*) / 20) AS BIGINT) AS step FROM li)"
CELLS = "ce AS (SELECT a.k * step AS i, b.k * step AS j, n, (SELECT COUNT(*) FROM rk WHERE r1 <= a.k * step AND r2 <= b.k * step) AS overlap FROM nn, UNNEST(RANGE(1, n // step + 1)) AS a(k), UNNEST(RANGE(1, n // step + 1)) AS b(k))"
TAIL = f"""ta AS (SELECT i, j, n, overlap, overlap > CAST(j AS DOUBLE) / n * i AS over_, UNNEST(CASE WHEN overlap > CAST(j AS DOUBLE) / n * i THEN RANGE(overlap, LEAST(i, j) + 1) ELSE RANGE(GREATEST(0, i + j - n), overlap + 1) END) AS x FROM ce),
 tl AS (SELECT i, j, overlap, over_, {LOGC("j", "x")} + {LOGC("n - j", "i - x")} - {LOGC("n", "i")} AS l FROM ta WHERE x <= j AND i - x <= n - j),
 tm AS (SELECT i, j, MAX(l) AS m FROM tl GROUP BY i, j),
 tp AS (SELECT tl.i, tl.j, ANY_VALUE(overlap) AS overlap, ANY_VALUE(over_) AS over_, LEAST(0E0, ANY_VALUE(m) + LN(SUM(EXP(l - m)))) AS lp FROM tl JOIN tm ON tl.i = tm.i AND tl.j = tm.j GROUP BY tl.i, tl.j)"""


def lists(s, d):
    x = A.load(s, d, A.LISTS)
    return x.selectExpr("item", "v1 as value"), x.selectExpr("item", "v2 as value")


def overlap(s, d):
    a, b = lists(s, d)
    return rrho.run_rrho(a, b, stepsize=max(1, a.count() // 20))


@query(f"WITH {RANKS}, {CELLS} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, overlap FROM ce")
def rrho_counts(s, d):
    a, b = lists(s, d)
    r = rrho.shared_ranks(a, b)
    n = r.count()
    return rrho.overlap_counts(r, n, n // 20).selectExpr("cast(i as bigint) i", "cast(j as bigint) j", "overlap")


@query(f"WITH {RANKS}, {CELLS}, {TAIL} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, ROUND(CASE WHEN over_ THEN 1 ELSE -1 END * ABS(lp) / LN(10E0), 4) AS metric FROM tp")
def rrho_metric(s, d):
    return overlap(s, d).cells.selectExpr("cast(i as bigint) i", "cast(j as bigint) j", "round(metric, 4) as metric")


@query(f"WITH {RANKS}, {CELLS}, {TAIL}, ad AS (SELECT i, j, EXP(lp) AS p, ROW_NUMBER() OVER (ORDER BY EXP(lp), i, j) AS k, COUNT(*) OVER () AS m FROM tp) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, ROUND(LEAST(1, MIN(p * m / k * (SELECT SUM(1E0 / k) FROM ad)) OVER (ORDER BY p DESC)), 5) AS pvalue_adj FROM ad")
def rrho_padjust_by(s, d):
    return rrho.correct_pvalues(overlap(s, d), "BY").selectExpr("cast(i as bigint) i", "cast(j as bigint) j", "round(pvalue_adj, 5) as pvalue_adj")


@query(f"WITH {RANKS}, {CELLS}, {TAIL}, ms AS (SELECT ROUND(CASE WHEN over_ THEN 1 ELSE -1 END * ABS(lp) / LN(10E0), 4) AS metric, CASE WHEN a.v1 <= 0 THEN 'down' ELSE 'up' END AS dir1, CASE WHEN b.v2 <= 0 THEN 'down' ELSE 'up' END AS dir2 FROM tp JOIN rk a ON a.r1 = tp.i JOIN rk b ON b.r2 = tp.j) SELECT DISTINCT * FROM ms WHERE metric = (SELECT MAX(metric) FROM ms)")
def rrho_sig_spot(s, d):
    return rrho.sig_spot(overlap(s, d)).selectExpr("round(metric, 4) as metric", "dir1", "dir2")


@query(
    f"""WITH {RANKS}, {CELLS}, {TAIL}, ms AS (SELECT tp.i, tp.j, overlap, CASE WHEN over_ THEN 1 ELSE -1 END * ABS(lp) / LN(10E0) AS metric, CASE WHEN a.v1 <= 0 THEN 'down' ELSE 'up' END AS d1, CASE WHEN b.v2 <= 0 THEN 'down' ELSE 'up' END AS d2 FROM tp JOIN rk a ON a.r1 = tp.i JOIN rk b ON b.r2 = tp.j),
 qs AS (SELECT *, CONCAT(d1, '-', d2) AS quadrant, CASE WHEN d1 = d2 THEN metric ELSE -metric END AS s FROM ms),
 bc AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY quadrant ORDER BY s DESC, overlap DESC, j, i) AS k FROM qs WHERE s > 0) t WHERE k = 1),
 it AS (SELECT quadrant, item, CASE WHEN d1 = 'up' THEN r1 <= i ELSE r1 >= i END AS in_list1, CASE WHEN d2 = 'up' THEN r2 <= j ELSE r2 >= j END AS in_list2 FROM rk CROSS JOIN bc)
 SELECT quadrant, item, in_list1, in_list2, in_list1 AND in_list2 AS common FROM it WHERE in_list1 OR in_list2"""
)
def rrho_sig_items(s, d):
    return rrho.sig_items(overlap(s, d))


@query(f"WITH {RANKS} SELECT item, RANK() OVER (ORDER BY v1) + (COUNT(*) OVER (PARTITION BY v1) - 1) / 2E0 AS list1, RANK() OVER (ORDER BY v2) + (COUNT(*) OVER (PARTITION BY v2) - 1) / 2E0 AS list2 FROM li")
def rrho_dots(s, d):
    return rrho.dots(rrho.Rrho(rrho.shared_ranks(*lists(s, d)), None, 0, 1, 10.0), "rank")


@query(f"WITH {RANKS}, {CELLS}, {TAIL} SELECT CAST(i / step AS INT) AS x, CAST(nn.n // step + 1 - j / step AS INT) AS y, ROUND(CASE WHEN over_ THEN 1 ELSE -1 END * ABS(lp) / LN(10E0), 4) AS metric FROM tp CROSS JOIN nn")
def rrho_heatmap(s, d):
    return rrho.heatmap(overlap(s, d)).selectExpr("x", "y", "round(metric, 4) as metric")


PERMUTED = f"""pr AS (SELECT perm, r1, ROW_NUMBER() OVER (PARTITION BY perm ORDER BY u, item) AS r2 FROM (SELECT perm, item, r1, {uniform_sql(1, "perm", "item")} AS u FROM rk, RANGE(200) AS a(perm)) t),
 pc AS (SELECT perm, CEIL(r1 / CAST(step AS DOUBLE)) AS a, CEIL(r2 / CAST(step AS DOUBLE)) AS b, COUNT(*) AS c FROM pr CROSS JOIN nn GROUP BY 1, 2, 3),
 pe AS (SELECT p.perm, ce.i, ce.j, ce.n, COALESCE(pc.c, 0) AS c FROM ce CROSS JOIN RANGE(200) AS p(perm) CROSS JOIN (SELECT step FROM nn) s LEFT JOIN pc ON pc.perm = p.perm AND pc.a * s.step = ce.i AND pc.b * s.step = ce.j),
 pf AS (SELECT perm, i, j, n, SUM(c) OVER (PARTITION BY perm, i ORDER BY j) AS c FROM pe),
 pg AS (SELECT perm, i, j, n, CAST(SUM(c) OVER (PARTITION BY perm, j ORDER BY i) AS BIGINT) AS c FROM pf),
 hx AS (SELECT i, j, n, UNNEST(RANGE(GREATEST(0, i + j - n), LEAST(i, j) + 1)) AS x FROM ce),
 hl AS (SELECT i, j, x, {LOGC("j", "x")} + {LOGC("n - j", "i - x")} - {LOGC("n", "i")} AS l FROM hx),
 hm AS (SELECT *, MAX(l) OVER (PARTITION BY i, j) AS m FROM hl),
 hc AS (SELECT i, j, x, m, SUM(EXP(l - m)) OVER (PARTITION BY i, j ORDER BY x) AS lo, SUM(EXP(l - m)) OVER (PARTITION BY i, j ORDER BY x DESC) AS hi FROM hm),
 px AS (SELECT perm, pg.i, pg.j, CASE WHEN c > CAST(pg.j AS DOUBLE) / n * pg.i THEN 1 ELSE -1 END * ABS(LEAST(0E0, m + LN(CASE WHEN c > CAST(pg.j AS DOUBLE) / n * pg.i THEN hi ELSE lo END))) / LN(10E0) AS metric FROM pg JOIN hc ON hc.i = pg.i AND hc.j = pg.j AND hc.x = c),
 dr AS (SELECT tp.i, tp.j, CASE WHEN over_ THEN 1 ELSE -1 END * ABS(lp) / LN(10E0) AS metric, CASE WHEN a.v1 <= 0 THEN 'down' ELSE 'up' END AS d1, CASE WHEN b.v2 <= 0 THEN 'down' ELSE 'up' END AS d2 FROM tp JOIN rk a ON a.r1 = tp.i JOIN rk b ON b.r2 = tp.j),
 ps AS (SELECT perm, SUM(t) AS statistic FROM (SELECT perm, d1, MAX(px.metric) AS t FROM px JOIN dr ON px.i = dr.i AND px.j = dr.j WHERE d1 = d2 GROUP BY perm, d1) x GROUP BY perm),
 ac AS (SELECT SUM(t) AS actual FROM (SELECT d1, MAX(metric) AS t FROM dr WHERE d1 = d2 GROUP BY d1) x)"""


@query(f"WITH {RANKS}, {CELLS}, {TAIL}, {PERMUTED} SELECT perm AS perm_id, ROUND(statistic, 4) AS statistic FROM ps")
def rrho_permutation(s, d):
    return rounded(rrho.permutation_test(overlap(s, d))[1], "statistic", digits=4)


@query(f"WITH {RANKS}, {CELLS}, {TAIL}, {PERMUTED} SELECT ROUND(ANY_VALUE(actual), 4) AS statistic, ROUND(1 - LEAST(1, AVG(CASE WHEN statistic <= actual + 1E-9 THEN 1E0 ELSE 0E0 END) + 1 / 200E0), 6) AS pvalue FROM ps CROSS JOIN ac")
def rrho_permutation_pvalue(s, d):
    x = rrho.permutation_test(overlap(s, d))[0]
    return x.selectExpr("round(statistic, 4) as statistic", "round(pvalue, 6) as pvalue")


EX = f"ex AS ({A.EXPRESSION}), gs AS ({A.GENE_SETS})"
NORM = "nm AS (SELECT gene, sample, 10000 * FLOOR(RANK() OVER (PARTITION BY sample ORDER BY value) + (COUNT(*) OVER (PARTITION BY sample, value) - 1) / 2E0) / COUNT(*) OVER (PARTITION BY sample) AS value FROM ex)"


@query(f"WITH {EX}, {NORM} SELECT gene, sample, ROUND(value, 6) AS value FROM nm")
def ssgsea_rank_norm(s, d):
    return rounded(ssgsea.normalize(A.load(s, d, A.EXPRESSION), "rank"), "value")


@query(
    f"""WITH {EX}, {NORM}, ps AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS pos, COUNT(*) OVER (PARTITION BY sample) AS n FROM nm),
 mm AS (SELECT set, sample, SUM(POW(ABS(value), 0.75) * (n - pos + 1)) AS wb, SUM(POW(ABS(value), 0.75)) AS w, SUM(n - pos + 1) AS b, COUNT(*) AS k, ANY_VALUE(n) AS n FROM ps JOIN gs ON gene = item GROUP BY set, sample)
 SELECT set AS gene_set, sample, ROUND(wb / w - (n * (n + 1) / 2E0 - b) / (n - k), 4) AS es FROM mm"""
)
def ssgsea_es(s, d):
    x = ssgsea.run_ssgsea(A.load(s, d, A.EXPRESSION), A.load(s, d, A.GENE_SETS))
    return x.selectExpr("set as gene_set", "sample", "round(ES, 4) as es")


@query(
    f"""WITH {EX}, {NORM}, ps AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS pos, COUNT(*) OVER (PARTITION BY sample) AS n FROM nm),
 mm AS (SELECT set, sample, SUM(POW(ABS(value), 0.75) * (n - pos + 1)) AS wb, SUM(POW(ABS(value), 0.75)) AS w, SUM(n - pos + 1) AS b, COUNT(*) AS k, ANY_VALUE(n) AS n FROM ps JOIN gs ON gene = item GROUP BY set, sample),
 es AS (SELECT set, sample, wb / w - (n * (n + 1) / 2E0 - b) / (n - k) AS es FROM mm),
 kk AS (SELECT set, COUNT(DISTINCT item) AS k FROM gs WHERE item IN (SELECT gene FROM nm) GROUP BY set),
 bd AS (SELECT MAX(n) AS longest, MAX(n) - MIN(n) AS spare FROM ps),
 pl AS (SELECT perm, pos, ROW_NUMBER() OVER (PARTITION BY perm ORDER BY u, pos) AS i FROM (SELECT perm, pos, {uniform_sql(1, "perm", "pos")} AS u FROM bd, RANGE(1000) AS a(perm), UNNEST(RANGE(1, longest + 1)) AS b(pos)) t),
 f1 AS (SELECT * FROM pl WHERE i <= (SELECT MAX(k) FROM kk) + (SELECT spare FROM bd)),
 fj AS (SELECT sample, perm, i, POW(ABS(value), 0.75) AS w, n - ps.pos + 1 AS back, n FROM f1 JOIN ps ON ps.pos = f1.pos),
 fc AS (SELECT sample, perm, n, ROW_NUMBER() OVER v AS k, SUM(w * back) OVER v AS swb, SUM(w) OVER v AS sw, SUM(back) OVER v AS sb FROM fj WINDOW v AS (PARTITION BY sample, perm ORDER BY i)),
 nl AS (SELECT sample, k, swb / sw - (n * (n + 1) / 2E0 - sb) / (n - k) AS v FROM fc WHERE k IN (SELECT k FROM kk)),
 sd AS (SELECT es.set, es.sample, es, kk.k, AVG(v) FILTER ((v >= 0) = (es >= 0)) AS m, COUNT(*) FILTER (v >= 0) AS up, COUNT(*) FILTER (v < 0) AS down FROM es JOIN kk ON es.set = kk.set LEFT JOIN nl ON nl.sample = es.sample AND nl.k = kk.k GROUP BY ALL),
 ne AS (SELECT *, es / ABS(m) AS nes FROM sd)
 SELECT ne.set AS gene_set, ne.sample, ROUND(es, 4) AS es, ROUND(nes, 4) AS nes, ROUND((COUNT(*) FILTER (CASE WHEN nes >= 0 THEN v >= nes ELSE v <= nes END) + 1) / CAST(CASE WHEN nes >= 0 THEN up ELSE down END + 1 AS DOUBLE), 6) AS pvalue
 FROM ne LEFT JOIN nl ON nl.sample = ne.sample AND nl.k = ne.k GROUP BY ne.set, ne.sample, es, nes, up, down"""
)
def ssgsea_nes(s, d):
    x = ssgsea.run_ssgsea(A.load(s, d, A.EXPRESSION), A.load(s, d, A.GENE_SETS), perm=1000)
    return x.selectExpr("set as gene_set", "sample", "round(ES, 4) as es", "round(NES, 4) as nes", "round(pvalue, 6) as pvalue")


@query(f"WITH {RANKS}, gs AS ({A.GENE_SETS}), me AS (SELECT li.item, v1, CASE WHEN gs.item IS NULL THEN 0 ELSE 1 END AS m FROM li LEFT JOIN gs ON gs.item = li.item AND gs.set = 'Brand#11'), hs AS (SELECT *, CASE WHEN m = 1 THEN ABS(v1) ELSE 0 END AS h FROM me) SELECT item, m AS in_set, CAST(ROW_NUMBER() OVER w AS BIGINT) AS x, ROUND(SUM(h) OVER w / SUM(h) OVER () - CAST(SUM(1 - m) OVER w AS DOUBLE) / SUM(1 - m) OVER (), 6) AS running_score FROM hs WINDOW w AS (ORDER BY v1 DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def gsea_running_score(s, d):
    members = A.load(s, d, A.GENE_SETS).where("set = 'Brand#11'")
    x = ssgsea.running_score(lists(s, d)[0], members)
    return x.selectExpr("item", "position as in_set", "cast(x as bigint) as x", "round(running_score, 6) as running_score")


@query(f"WITH dx AS ({A.DENSE_EXPRESSION}), rr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY value, gene) AS r FROM dx), mr AS (SELECT r, AVG(value) AS m FROM rr GROUP BY r) SELECT gene, sample, ROUND(AVG(m) OVER (PARTITION BY sample, value), 6) AS value FROM rr JOIN mr ON rr.r = mr.r")
def quantile_norm(s, d):
    return rounded(decomposition.quantile_normalize(A.load(s, d, A.DENSE_EXPRESSION)), "value")


# -- decompositions ------------------------------------------------------------------------

SIG, TAR = f"sg AS ({A.SIGNATURES})", f"ta AS ({A.TARGETS})"


@query(f"WITH {SIG}, {TAR} SELECT signature, target, ROUND(SUM(sg.weight * ta.weight) / (SQRT((SELECT SUM(weight * weight) FROM sg x WHERE x.signature = sg.signature)) * SQRT((SELECT SUM(weight * weight) FROM ta y WHERE y.target = ta.target))), 6) AS cosine FROM sg JOIN ta ON sg.context = ta.context GROUP BY signature, target")
def cosine_similarity(s, d):
    return rounded(decomposition.cosine_similarity(A.load(s, d, A.SIGNATURES), A.load(s, d, A.TARGETS)), "cosine")


@query(
    f"""WITH {SIG}, {TAR}, a0 AS (SELECT signature, target, 1E0 / (SELECT COUNT(DISTINCT target) FROM ta) AS f FROM (SELECT DISTINCT signature FROM sg) s CROSS JOIN (SELECT DISTINCT target FROM ta) t),
 c1 AS (SELECT a0.signature, a0.target, ta.context, f * weight / SUM(f * weight) OVER (PARTITION BY signature, context) AS sh FROM a0 JOIN ta ON a0.target = ta.target),
 w1 AS (SELECT c1.signature, target, SUM(sh * weight) AS w FROM c1 JOIN sg ON sg.signature = c1.signature AND sg.context = c1.context GROUP BY 1, 2)
 SELECT signature, target, ROUND(w / SUM(w) OVER (PARTITION BY signature), 6) AS fraction FROM w1"""
)
def em_step(s, d):
    return rounded(decomposition.em_steps(A.load(s, d, A.SIGNATURES), A.load(s, d, A.TARGETS), 1), "fraction")


@query()
def signature_dissection(s, d):
    return decomposition.signature_dissection(A.load(s, d, A.SIGNATURES), A.load(s, d, A.TARGETS))


@query()
def cibersort(s, d):
    return decomposition.run_cibersort(A.load(s, d, A.DENSE_EXPRESSION), A.load(s, d, A.CELL_TYPES), perm=200)


HX = f"hc AS ({A.HDP_COUNTS}), he AS ({A.HDP_EXPOSURES}), hs AS ({A.HDP_SIGNATURES}), rc AS (SELECT sample, category, SUM(he.value * hs.value) AS value FROM he JOIN hs ON he.signature = hs.signature GROUP BY 1, 2)"


@query(f"WITH {HX} SELECT sample, category, ROUND(value, 6) AS value FROM rc")
def hdp_reconstruct(s, d):
    return rounded(decomposition.hdp_reconstruct(A.load(s, d, A.HDP_EXPOSURES), A.load(s, d, A.HDP_SIGNATURES)), "value")


@query(f"WITH {HX} SELECT hc.sample, CAST(SUM(n) AS BIGINT) AS n_mut, ROUND(SQRT(AVG((n - COALESCE(value, 0)) * (n - COALESCE(value, 0)))), 5) AS rmse, ROUND(SUM(n * COALESCE(value, 0)) / SQRT(SUM(n * n) * SUM(COALESCE(value, 0) * COALESCE(value, 0))), 5) AS cosine FROM hc LEFT JOIN rc ON hc.sample = rc.sample AND hc.category = rc.category GROUP BY hc.sample")
def hdp_fit(s, d):
    x = decomposition.hdp_fit(A.load(s, d, A.HDP_COUNTS), A.load(s, d, A.HDP_EXPOSURES), A.load(s, d, A.HDP_SIGNATURES))
    return rounded(x.select("sample", "n_mut", "rmse", "cosine"), "rmse", "cosine", digits=5)


@query(f"WITH {HX}, ac AS (SELECT sample, signature, value AS exposure, value >= 1 AS sig_active FROM he WHERE signature <> '0') SELECT sample, signature, exposure, sig_active, SUM(CASE WHEN sig_active THEN 1 ELSE 0 END) OVER (PARTITION BY signature) >= FLOOR(0.05E0 * (SELECT COUNT(DISTINCT sample) FROM he)) AS sig_cohort FROM ac")
def hdp_cohort_filter(s, d):
    return decomposition.hdp_significant(A.load(s, d, A.HDP_EXPOSURES), sig_active_cutoff=1).select("sample", "signature", "exposure", "sig_active", "sig_cohort")


@query(f"WITH hc AS ({A.HDP_COUNTS}) SELECT COUNT(DISTINCT sample) AS samples, COUNT(DISTINCT category) AS categories, CAST(SUM(n) AS BIGINT) AS mutations, CAST(0 AS BIGINT) AS signatures FROM hc")
def hdp_summary(s, d):
    return decomposition.Hdp(A.load(s, d, A.HDP_COUNTS)).validate().summary()


class _Shares:
    """A stand-in for a sampler: each chain draws a multinomial of every sample's counts."""

    schema = "sample string, category string, draw long"

    def __call__(self, counts, seed):
        import numpy as np

        rng = np.random.Generator(np.random.Philox(seed))
        out = counts[["sample", "category"]].copy()
        out["draw"] = rng.multinomial(int(counts["n"].sum()), counts["n"] / counts["n"].sum())
        return out


@query()
def hdp_chains(s, d):
    return decomposition.run_hdp(A.load(s, d, A.HDP_COUNTS), _Shares())


@query()
def sparcc(s, d):
    return decomposition.sparcc(A.load(s, d, A.HDP_COUNTS).selectExpr("sample", "category as taxon", "n"))


@query(f"WITH {EX}, me AS (SELECT gene, AVG(value) AS mean FROM ex GROUP BY gene), q AS (SELECT QUANTILE_CONT(mean, 0.25) AS q1, QUANTILE_CONT(mean, 0.5) AS q2, QUANTILE_CONT(mean, 0.75) AS q3 FROM me) SELECT gene, ROUND(mean, 6) AS mean, 1 + CASE WHEN mean > q1 THEN 1 ELSE 0 END + CASE WHEN mean > q2 THEN 1 ELSE 0 END + CASE WHEN mean > q3 THEN 1 ELSE 0 END AS bin FROM me CROSS JOIN q")
def gene_bins(s, d):
    return rounded(decomposition.mean_bins(A.load(s, d, A.EXPRESSION), 4), "mean")


CUTS25 = ", ".join(f"{i}E0 / 25" for i in range(1, 25))


@query(
    f"""WITH {EX}, me AS (SELECT gene, AVG(value) AS mean FROM ex GROUP BY gene), q AS (SELECT QUANTILE_CONT(mean, [{CUTS25}]) AS br FROM me),
 bi AS (SELECT gene, 1 + LEN(LIST_FILTER(br, lambda b: mean > b)) AS bin FROM me CROSS JOIN q),
 nd AS (SELECT bin, COUNT(*) AS k FROM bi WHERE gene IN (SELECT item FROM gs WHERE set = 'Brand#11') GROUP BY bin),
 dr AS (SELECT draw, gene, k, ROW_NUMBER() OVER (PARTITION BY draw, bi.bin ORDER BY MD5(CONCAT_WS('|', CAST(draw AS STRING), gene, '1')), gene) AS i FROM bi JOIN nd ON bi.bin = nd.bin, UNNEST(RANGE(0, 1000)) AS u(draw))
 SELECT CAST(draw AS INT) AS draw, gene FROM dr WHERE i <= k"""
)
def sample_sim(s, d):
    f = A.load(s, d, A.GENE_SETS).where("set = 'Brand#11'").selectExpr("item as gene")
    return decomposition.sample_sim(A.load(s, d, A.EXPRESSION), f)


@query()
def overdispersion(s, d):
    f = A.load(s, d, A.GENE_SETS).where("set = 'Brand#11'").selectExpr("item as gene")
    return decomposition.overdispersion(A.load(s, d, A.EXPRESSION), f)


# -- modules ---------------------------------------------------------------------------------

BA = f"""ba AS ({A.BASES}), nb AS (SELECT *, coef / AVG(coef) OVER (PARTITION BY study, rank_idx, factor_idx) AS sc FROM ba),
 rb AS (SELECT *, RANK() OVER (PARTITION BY study, rank_idx, gene ORDER BY sc DESC) + (COUNT(*) OVER (PARTITION BY study, rank_idx, gene, sc) - 1) / 2E0 AS rr, RANK() OVER (PARTITION BY study, rank_idx, factor_idx ORDER BY sc DESC) + (COUNT(*) OVER (PARTITION BY study, rank_idx, factor_idx, sc) - 1) / 2E0 AS rc FROM nb),
 lg AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY study, rank_idx, factor_idx ORDER BY rc, gene) AS place FROM rb WHERE rr <= 1) t WHERE rc = place)"""
TOP = """tp AS (SELECT *, CONCAT_WS('.', study, CAST(rank_idx AS STRING), CAST(factor_idx AS STRING)) AS program FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY study, rank_idx, factor_idx ORDER BY coef DESC, gene) AS i FROM ba) t WHERE i <= 12)"""


@query(f"WITH {BA} SELECT study, rank_idx, factor_idx, gene, CAST(place AS INT) AS place FROM lg")
def nmf_leading_genes(s, d):
    return nmf_consensus.leading_genes(A.load(s, d, A.BASES)).select("study", "rank_idx", "factor_idx", "gene", "place")


@query(f"WITH {BA}, {TOP}, pr AS (SELECT a.program AS l, b.program AS r, COUNT(*) AS n FROM tp a JOIN tp b ON a.gene = b.gene GROUP BY 1, 2), sz AS (SELECT program, COUNT(*) AS k FROM tp GROUP BY 1) SELECT l AS left_program, r AS right_program, ROUND(CAST(n AS DOUBLE) / (x.k + y.k - n), 6) AS jaccard FROM pr JOIN sz x ON x.program = l JOIN sz y ON y.program = r")
def module_jaccard(s, d):
    x = nmf_consensus.jaccard(nmf_consensus.top_programs(A.load(s, d, A.BASES), 12))
    return rounded(x.selectExpr("left as left_program", "right as right_program", "jaccard"), "jaccard")


@query(f"WITH {BA}, {TOP}, e AS (SELECT a.gene AS gene1, b.gene AS gene2, COUNT(*) AS weight FROM tp a JOIN tp b ON a.program = b.program AND a.gene < b.gene GROUP BY 1, 2 HAVING COUNT(*) >= 2), dg AS (SELECT g FROM (SELECT gene1 AS g FROM e UNION ALL SELECT gene2 FROM e) t GROUP BY g HAVING COUNT(*) >= 3) SELECT gene1, gene2, weight FROM e WHERE gene1 IN (SELECT g FROM dg) AND gene2 IN (SELECT g FROM dg)")
def nmf_co_occurrence(s, d):
    return nmf_consensus.co_occurrence(nmf_consensus.top_programs(A.load(s, d, A.BASES), 12))


@query()
def nmf_consensus_barkley(s, d):
    return nmf_consensus.nmf_consensus(A.load(s, d, A.BASES), "barkley", min_size=2, s_min_jaccard=1, v_min=1, s_min=1).to_df()


@query()
def program_order(s, d):
    return rounded(nmf_consensus.program_order(nmf_consensus.top_programs(A.load(s, d, A.BASES), 12)), "weight")


@query()
def nmf_consensus_gavish(s, d):
    return nmf_consensus.nmf_consensus(A.load(s, d, A.BASES), "gavish", module_size=12, min_intra_sim=0.1, min_intra_size=1, min_inter_sim=0.1, redundant_sim=0.9, founder_intersection=0.1, min_overlap_index=0.15).to_df()


# -- tables -----------------------------------------------------------------------------------


@query("WITH m AS (SELECT CAST(l_partkey AS STRING) AS gene, AVG(l_quantity) AS mean FROM lineitem GROUP BY l_partkey), j AS (SELECT gene, p_name AS symbol, mean FROM m JOIN part ON gene = CAST(p_partkey AS STRING) WHERE p_name <> '') SELECT symbol, gene, ROUND(mean, 6) AS mean FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY mean DESC, gene) AS i FROM j) t WHERE i = 1")
def map_ids(s, d):
    assay = A.load(s, d, "SELECT CAST(l_partkey AS STRING) AS gene, l_quantity AS value FROM {lineitem}")
    db = A.load(s, d, "SELECT CAST(p_partkey AS STRING) AS gene, p_name AS symbol FROM {part}")
    x = ids.map_ids(assay.select("gene").distinct(), db, "symbol", "gene", assay=assay)
    return rounded(x.select("symbol", "gene", "mean"), "mean")


@query(f"WITH t AS ({A.TURNS}), r AS (SELECT *, SUM(CASE WHEN LENGTH(peptide) > pl OR source <> ps THEN 1 ELSE 0 END) OVER (ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS k FROM (SELECT *, LAG(LENGTH(peptide)) OVER (ORDER BY turn_no) AS pl, LAG(source) OVER (ORDER BY turn_no) AS ps FROM t) q) SELECT turn_no, CAST(k AS INT) AS identifiers, h.hla, ROUND(CAST(size AS DOUBLE) / h.f, 6) AS el_rank, CASE WHEN size / h.f < 50 THEN 'SB' WHEN size / h.f < 100 THEN 'WB' END AS bind_level FROM r CROSS JOIN (VALUES ('A01', 4E0), ('B07', 8E0)) AS h(hla, f)")
def netmhc_long(s, d):
    t = A.load(s, d, A.TURNS).withColumns({"A01::EL_Rank": F.col("size") / 4.0, "B07::EL_Rank": F.col("size") / 8.0})
    x = netmhc.long_predictions(netmhc.sequence_runs(t, "turn_no", "peptide", "source"), ["A01", "B07"], ["EL_Rank"], ["turn_no", "identifiers"], 50, 100)
    return x.selectExpr("turn_no", "identifiers", "HLA as hla", "round(EL_Rank, 6) as el_rank", "BindLevel as bind_level")


@query(f"WITH {SEG} SELECT sample AS sample_name, CASE WHEN chr = '22' THEN '23' ELSE chr END AS chromosome, startpos AS start_pos, nAraw AS segment_mean FROM seg WHERE chr <> '21'")
def absolute_seg_normalize(s, d):
    seg = A.load(s, d, A.SEGMENTS)
    chrom = F.when(F.col("chr") == "22", "chrX").when(F.col("chr") == "21", "Y").otherwise(F.concat(F.lit("Chr"), "chr"))
    x = absolute_io.normalize_segments(seg.select(F.col("sample").alias("Sample"), chrom.alias("Chromosome"), F.col("startpos").alias("Start"), F.col("endpos").alias("End"), F.lit(10).alias("Num_Probes"), F.col("nAraw").alias("Segment_Mean")))
    return x.selectExpr("Sample as sample_name", "Chromosome as chromosome", "Start as start_pos", "Segment_Mean as segment_mean")


@query(f"WITH mu AS ({A.SNVS}) SELECT sample AS sample_name, chr AS chromosome, pos AS start_pos, alt AS gene FROM mu WHERE chr IN ({', '.join(repr(str(i)) for i in range(1, 24))})")
def absolute_maf_normalize(s, d):
    m = A.load(s, d, A.SNVS)
    chrom = F.when(F.col("chr") == "23", "chrX").otherwise(F.concat(F.lit("Chr"), "chr"))
    x = absolute_io.normalize_mutations(m.select(F.col("sample").alias("Tumor_Sample_Barcode"), chrom.alias("Chromosome"), F.col("alt").alias("Hugo_Symbol"), F.lit("").alias("dbSNP_Val_Status"), F.col("pos").alias("Start_Position"), F.lit(1).alias("i_t_ref_count"), F.lit(2).alias("t_alt_count")))
    return x.selectExpr("Tumor_Sample_Barcode as sample_name", "Chromosome as chromosome", "Start_position as start_pos", "Hugo_Symbol as gene")


@query(f"WITH {MUT}, {SEG}, {JOINED} SELECT mut_id, sample, chr FROM mut WHERE mut_id NOT IN (SELECT mut_id FROM jm)")
def unmatched_mutations(s, d):
    return intervals.unmatched(*mut_seg(s, d), on_sample="sample", start_field="startpos", end_field="endpos").select("mut_id", "sample", "chr")


P = "pp AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 101 + 1) / 102E0 / 8 AS p FROM supplier), pr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p, k) AS i, COUNT(*) OVER () AS n FROM pp)"


@query(f"WITH {P} SELECT k, ROUND(LEAST(1, MIN(p * n / i) OVER (ORDER BY p DESC)), 6) AS bh, ROUND(LEAST(1, MAX((n - i + 1) * p) OVER (ORDER BY p)), 6) AS holm, ROUND(LEAST(1, MIN((n - i + 1) * p) OVER (ORDER BY p DESC)), 6) AS hochberg, ROUND(LEAST(1, n * p), 6) AS bonferroni FROM pr")
def p_adjusted(s, d):
    x = A.load(s, d, "SELECT s_suppkey AS k, (s_suppkey * 37 % 101 + 1) / 102E0 / 8 AS p FROM {supplier}")
    for m in ("BH", "holm", "hochberg", "bonferroni"):
        x = p_adjust(x, "p", m, m.lower())
    return rounded(x.select("k", "bh", "holm", "hochberg", "bonferroni"), "bh", "holm", "hochberg", "bonferroni")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed allele fractions and mutated copies by sample: join, projection and aggregate."""
    j = intervals.identify_mut_cn(*mut_seg(spark, sf_dir), **ON).withColumnsRenamed({"nAraw": "major_raw", "nBraw": "minor_raw"}).withColumn("normal_cn", F.lit(2))
    return ccf.observed(j).groupBy("sample").agg(F.count(F.lit(1)).alias("mutations"), F.round(F.avg("obsVAF"), 6).alias("mean_vaf"), F.round(F.avg("mutCopyNum"), 6).alias("mean_copies"))
