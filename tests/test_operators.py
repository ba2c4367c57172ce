"""Small contract tests of the operators: hand-made inputs, nulls, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.functions.columns import p_adjust, proportion_ci, weighted_median
from lociframe.operators import arm, ccf, decomposition, ids, intervals, nmf_consensus, rrho, snv, ssgsea
from lociframe.operators.cnv_signature import cnv_classes, cnv_signature
from lociframe.operators.reshape import counts_matrix
from lociframe.operators.subclone import subclone_cn
from lociframe.plans.ccf_pipeline import prepare_pyclone, run_ccf
from lociframe.sources import absolute_io, netmhc, remote

SEG = "sample string, chr string, start long, end long, nMajor int, nMinor int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_point_join_matches_closed_ranges(spark):
    seg = spark.createDataFrame([("s", "1", 10, 20, 2, 1), ("s", "1", 21, 30, 3, 0), ("t", "1", 1, 99, 1, 1)], SEG)
    mut = spark.createDataFrame([(1, "s", "1", 10), (2, "s", "1", 20), (3, "s", "1", 21), (4, "s", "1", 31), (5, "s", "2", 15), (6, None, "1", 15)], "id long, sample string, chr string, pos long")
    got = intervals.identify_mut_cn(mut, seg, on_sample="sample", mut_id="id")
    assert rows(got.select("id", "nMajor")) == [(1, 2), (2, 2), (3, 3)]
    kept = intervals.identify_mut_cn(mut, seg, on_sample="sample", nomatch="NA", mut_id="id")
    assert kept.count() == 6 and kept.where("nMajor is null").count() == 3
    assert rows(intervals.identify_mut_cn(mut, seg, on_sample="sample", mut_id="id", bin_width=7).select("id")) == [(1,), (2,), (3,)]


def test_point_join_renames_clashes_and_refuses_doubles(spark):
    seg = spark.createDataFrame([("s", "1", 1, 9, 2, 1), ("s", "1", 5, 15, 3, 0)], SEG)
    mut = spark.createDataFrame([(1, "s", "1", 7, 77)], "id long, sample string, chr string, pos long, nMajor int")
    assert "i_nMajor" in intervals.identify_mut_cn(mut, seg, on_sample="sample", on_multi="keep").columns
    with pytest.raises(Exception, match="several segments"):
        intervals.identify_mut_cn(mut, seg, on_sample="sample", mut_id="id").collect()
    assert intervals.identify_mut_cn(mut, seg, on_sample="sample", on_multi="null", nomatch="NA", mut_id="id").select("nMajor").collect() == [(None,)]


def test_overlap_join_bins_give_each_pair_once(spark):
    a = spark.createDataFrame([("1", 1, 100), ("1", 150, 160)], "ca string, s long, e long")
    b = spark.createDataFrame([("1", 50, 155), ("2", 1, 9)], "cb string, bs long, be long")
    for width in (None, 10):
        got = intervals.overlap_join(a, b, [("ca", "cb")], ("s", "e"), ("bs", "be"), bin_width=width)
        assert rows(got.select("s", "hit_start", "hit_end")) == [(1, 50, 100), (150, 150, 155)]


def test_reduce_and_overlaps(spark):
    d = spark.createDataFrame([("1", 1, 5), ("1", 6, 9), ("1", 3, 4), ("1", 20, 30), ("2", 1, 2)], "chr string, start long, end long")
    assert rows(intervals.reduce_ranges(d, ["chr"])) == [("1", 1, 9), ("1", 20, 30), ("2", 1, 2)]
    assert rows(intervals.overlaps_within(d, ["chr"])) == [("1", 3, 4)]


BANDS = [("chr1", 1, 40, "p1", "gneg"), ("chr1", 41, 50, "p0", "acen"), ("chr1", 51, 100, "q1", "gneg")]


def bands(spark):
    return arm.get_cytoband(spark.createDataFrame(BANDS, "chr string, start long, end long, name string, gieStain string"))


def test_arm_events(spark):
    seg = spark.createDataFrame([("s", "1", 1, 30, 1), ("s", "1", 60, 100, -1), ("t", "chr1", 35, 60, 1)], "sample string, chr string, startpos long, endpos long, cnv int")
    got = {(r.sample, r.arm): r.arm_cnv for r in arm.arm_cnv(seg, bands(spark), "sample", threshold=0.7).collect()}
    assert got == {("s", "p"): 1, ("s", "q"): 1, ("t", "p"): 0, ("t", "q"): 0}  # t's segment touches the centromere and goes
    table = arm.summarize_arm(seg, bands(spark), "sample", ["cnv"])
    assert table.count() == 4 and table.where("width is null").count() == 2
    bad = seg.union(seg.limit(1))
    with pytest.raises(ValueError, match="overlap"):
        arm.summarize_arm(bad, bands(spark), "sample")


def test_weighted_median(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 1.0), ("b", 1.0, 1.0), ("b", 3.0, 1.0), ("c", None, 1.0), ("e", 7.0, 2.0), ("e", None, 5.0)], "k string, v double, w double")
    assert dict(rows(weighted_median(d, ["k"], ["v"], "w"))) == {"a": 2.0, "b": 2.0, "c": None, "e": 7.0}


def test_wgd_states_and_test(spark):
    seg = spark.createDataFrame([("s", "1", 1, 40, 2, 2, 4.0), ("s", "1", 51, 100, 2, 2, 4.0)], "sample string, chr string, startpos long, endpos long, major_cn int, minor_cn int, ploidy double")
    r = arm.wgd_test(seg, bands(spark), "sample", perm_times=100).collect()[0]
    assert (r.pvalue, r.total_aber, r.wgd_event, r.wGD) == (0.0, 4.0, 1.0, "GD")


def test_signature_classes(spark):
    assert len(cnv_classes()) == len(set(cnv_classes())) == 48
    seg = spark.createDataFrame([("s", 1, 100_000, 0, 0), ("s", 1, 100_001, 0, 0), ("s", 1, 50_000_000, 2, 0), ("s", 1, 5, None, 1), ("t", 1, 2_000_000, 5, 5)], "sample string, startpos long, endpos long, major_cn int, minor_cn int")
    got = {(r.sample, r.cnv_class): r.n for r in cnv_signature(seg, "sample").where("n > 0").collect()}
    assert got == {("s", "0:homdel:0-100kb"): 1, ("s", "0:homdel:100kb-1Mb"): 1, ("s", "2:LOH:>40Mb"): 1, ("t", "9+:het:1Mb-10Mb"): 1}
    assert cnv_signature(seg, "sample").count() == 96
    wide = counts_matrix(spark.createDataFrame([("x", "s"), ("q", "s")], "l string, g string"), "l", ["y", "x"], "g")
    assert [tuple(r) for r in wide.collect()] == [("y", 0), ("x", 1)]


def test_contexts_and_motifs(spark):
    assert len(set(snv.substitution_contexts())) == 96 and len(set(snv.substitution_contexts(standard=False))) == 192
    assert snv.substitution_contexts()[:5] == ["A[T>C]A", "C[T>C]A", "G[T>C]A", "T[T>C]A", "A[C>T]A"]
    seq = "AATCAGGTGAATTCACC"
    g = snv.chunk_genome(spark.createDataFrame([("1", seq)], "chr string, seq string"), width=5, margin=4)
    mut = spark.createDataFrame([("s", "1", 4, "C", "T"), ("s", "1", 9, "G", "A"), ("s", "1", 1, "A", "C"), ("s", "1", 5, "C", "T"), ("s", "1", 6, "G", "N")], "sample string, chr string, pos long, ref string, alt string")
    got = snv.snv_signature(mut, g, "sample", width=5).where("n > 0")
    assert rows(got) == [("T[C>T]A", "s", 2)]
    counts = dict(rows(snv.kmer_counts(g, 3, 5, ("+",))))
    assert counts == {seq[i : i + 3]: sum(seq[j : j + 3] == seq[i : i + 3] for j in range(len(seq) - 2)) for i in range(len(seq) - 2)}
    t = snv.motif_table(mut, g, bg_extension=3, width=5).collect()[0]
    window = [seq[0:7], seq[5:12]]
    assert t.signature_mut_freq == 2 and t.background_context == sum(w.count("C") + w.count("G") for w in window)
    assert snv.motif_fisher(mut, g, bg_extension=3, width=5).collect()[0].fisher_pvalue <= 1


def test_subclones(spark):
    d = subclone_cn(spark.createDataFrame([(2.0, 1.0), (1.3, 1.0), (1.3, 0.6)], "nAraw double, nBraw double")).collect()
    assert (d[0].fracA, d[0].fracB, d[0].nMaj_A, d[0].nMin_A, d[0].fracC) == (1.0, 0.0, 2.0, 1.0, None)
    assert d[1].fracA == pytest.approx(0.7) and (d[1].nMaj_A, d[1].nMaj_B) == (1.0, 2.0)
    assert sum((d[2].fracA, d[2].fracB, d[2].fracC, d[2].fracD)) == pytest.approx(1) and d[2].nMaj_C == 2.0


def test_proportion_interval(spark):
    lo, hi = proportion_ci("x", "n")
    got = spark.createDataFrame([(0, 10), (10, 10), (5, 10)], "x int, n int").select(lo, hi).collect()
    assert got[0][0] == 0 and got[1][1] == 1
    assert got[2] == pytest.approx((0.2365931, 0.7634069), abs=1e-6)


def ccf_tables(spark):
    cnv = spark.createDataFrame([("s", "1", 1, 1000, 1, 1, 1.0, 1.0, 0.8), ("s", "2", 1, 1000, 2, 1, 1.6, 1.0, 0.8)], "sample string, chr string, startpos long, endpos long, nMajor int, nMinor int, nAraw double, nBraw double, purity double")
    mut = spark.createDataFrame([(1, "s", "1", 5, "A", "C", 40, 60), (2, "s", "1", 6, "A", "CC", 10, 90), (3, "s", "2", 7, "A", "C", 60, 40), (4, "s", "2", 8, "A", "C", 0, 50), (5, "s", "3", 9, "A", "C", 1, 1)], "id long, sample string, chr string, pos long, ref string, alt string, alt_counts int, ref_counts int")
    return mut, cnv


def test_run_ccf(spark):
    mut, cnv = ccf_tables(spark)
    got = {r.id: r for r in run_ccf(mut, cnv, ("phyloCCF", "bootstrapCCF"), mut_id="id", ref_field="ref", alt_field="alt", ubiquity_vaf=5).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].phyloCCF == pytest.approx(1.0) and got[1].absCCF >= 0.9
    assert got[2].phyloCCF == pytest.approx(0.25) and got[2].absCCF == pytest.approx(0.25)
    assert got[3].no_chrs_bearing_mut > 1 and got[4].absCCF == 0 and got[4].no_chrs_bearing_mut == 0
    assert got[1].Mt == 1 and got[1].CCF_btstr_lower < got[1].CCF < got[1].CCF_btstr_higher
    indel = {r.id: r for r in run_ccf(mut, cnv, mut_id="id", ref_field="ref", alt_field="alt").collect()}
    assert indel[2].phyloCCF > got[2].phyloCCF  # scaled up to the substitutions' median
    with pytest.raises(ValueError, match="purity"):
        run_ccf(mut, cnv.withColumn("purity", F.lit(1.5)), mut_id="id")
    assert run_ccf(mut, cnv, conipher=True, mut_id="id").count() == 4
    assert run_ccf(mut.limit(0), cnv, mut_id="id").count() == 0


def test_pyclone_and_sex_chromosomes(spark):
    mut, cnv = ccf_tables(spark)
    p = prepare_pyclone(mut, cnv, mut_id="id").orderBy("mutation_id").collect()
    assert p[0].mutation_id == "s:1:5:A" and len(p) == 4
    male = run_ccf(mut, cnv.withColumns({"gender": F.lit("male"), "chr": F.when(F.col("chr") == "2", "X").otherwise(F.col("chr"))}), mut_id="id", normal_cn=None, gender_field="gender", kept_cols=("gender",))
    assert male.where("chr = 'X'").count() == 0 and set(r.normal_cn for r in male.collect()) == {2}


def test_mutation_types_brute(spark):
    d = spark.createDataFrame([(10, 30, 3, 1, 0.7, 2), (30, 10, 3, 1, 0.7, 2), (5, 5, 0, 0, 0.7, 2), (5, 5, 2, 0, 0.7, 3)], "alt_counts int, ref_counts int, major_cn int, minor_cn int, purity double, normal_cn int")
    assert [r.Mt for r in ccf.mutation_types(d).collect()] == [1.0, 3.0, None, None]


def test_p_adjust(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5), (5, None)], "i int, p double")
    want = {"BH": [0.04, 0.04, 0.04, 0.5], "bonferroni": [0.04, 0.08, 0.12, 1.0], "holm": [0.04, 0.06, 0.06, 0.5], "hochberg": [0.04, 0.06, 0.06, 0.5], "hommel": [0.04, 0.045, 0.06, 0.5], "BY": [0.04 * 25 / 12, 0.04 * 25 / 12, 0.04 * 25 / 12, 1.0]}
    for m, w in want.items():
        got = [r.p_adj for r in p_adjust(d, "p", m).orderBy("i").collect()]
        assert got[:4] == pytest.approx(w) and got[4] is None or got[4] != got[4], m
    tied = spark.createDataFrame([(1, 0.02), (2, 0.02), (3, 0.9)], "i int, p double")
    assert [r.p_adj for r in p_adjust(tied, "p", "BH").orderBy("i").collect()] == pytest.approx([0.03, 0.03, 0.9])


def ranked(spark, n=40):
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.standard_normal(n)
    b = a + rng.standard_normal(n) * 0.5
    make = lambda v: spark.createDataFrame([(f"g{i}", float(x)) for i, x in enumerate(v)], "item string, value double")
    return make(a), make(b), a, b


def test_rrho(spark):
    la, lb, a, b = ranked(spark)
    r = rrho.run_rrho(la, lb, stepsize=3)
    one, two = [f"g{i}" for i in (-a).argsort()], [f"g{i}" for i in (-b).argsort()]
    for c in r.cells.collect():
        assert c.overlap == len(set(one[: c.i]) & set(two[: c.j]))
        assert (c.sign == 1) == (c.overlap > c.i * c.j / 40)
    spot = rrho.sig_spot(r).collect()
    assert spot[0].metric == pytest.approx(max(c.metric for c in r.cells.collect()))
    items = rrho.sig_items(r, ("up-up",))
    cell = rrho.sig_cells(r, ("up-up",)).collect()[0]
    assert {x.item for x in items.where("common").collect()} == set(one[: cell.i]) & set(two[: cell.j])
    assert rrho.correct_pvalues(r).where("pvalue_adj < pvalue - 1e-12").count() == 0
    p = rrho.permutation_pvalue(r, perm=10)
    assert 0 <= p["pvalue"] <= 1 and p["permuted"].collect() == rrho.permutation_pvalue(r, perm=10)["permuted"].collect()
    assert rrho.dots(r, "rank").count() == 40 and "40 items" in repr(r)
    with pytest.raises(ValueError):
        rrho.run_rrho(la.limit(0), lb)


def test_ssgsea_closed_form(spark):
    e = spark.createDataFrame([(f"g{i}", "s", float(v)) for i, v in enumerate([5, 3, 9, 1, 7])], "gene string, sample string, value double")
    sets = spark.createDataFrame([("x", "g2"), ("x", "g4"), ("x", "absent"), ("y", "g3")], "set string, item string")
    got = {r.set: r.ES for r in ssgsea.run_ssgsea(e, sets, sample_norm_type="none", weight=1.0).collect()}
    # places from the end: 9 -> 5, 7 -> 4, 5 -> 3, 3 -> 2, 1 -> 1
    assert got["x"] == pytest.approx((9 * 5 + 7 * 4) / 16 - (15 - 9) / 3)
    assert got["y"] == pytest.approx(1 - (15 - 1) / 4)
    full = ssgsea.run_ssgsea(e, sets, perm=20).collect()
    assert all(0 < r.pvalue <= 1 for r in full)
    run = ssgsea.running_score(e.selectExpr("gene as item", "value"), sets.where("set = 'x'")).orderBy("x").collect()
    assert run[0].running_score == pytest.approx(9 / 16) and run[-1].running_score == pytest.approx(0)


def test_decompositions(spark):
    sig = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5), ("n", "a", 1.0), ("n", "b", 0.0)], "signature string, context string, weight double")
    tar = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 0.0), ("u", "a", 0.0), ("u", "b", 1.0)], "target string, context string, weight double")
    cos = {(r.signature, r.target): r.cosine for r in decomposition.cosine_similarity(sig, tar).collect()}
    assert cos["n", "t"] == pytest.approx(1) and cos["m", "u"] == pytest.approx(0.5**0.5)
    got = {(r.signature, r.target): r for r in decomposition.signature_dissection(sig, tar).collect()}
    assert got["n", "t"].fraction == 1 and got["m", "t"].fraction == pytest.approx(0.5, abs=1e-3) and got["m", "t"].final_cosine == pytest.approx(1)
    one = {(r.signature, r.target): r.fraction for r in decomposition.em_steps(sig, tar, 1).collect()}
    assert one["m", "t"] == pytest.approx(0.5)
    q = decomposition.quantile_normalize(spark.createDataFrame([("a", "s", 1.0), ("b", "s", 3.0), ("a", "t", 4.0), ("b", "t", 2.0)], "gene string, sample string, value double"))
    assert rows(q) == [("a", "s", 1.5), ("a", "t", 3.5), ("b", "s", 3.5), ("b", "t", 1.5)]


def test_cibersort_recovers_mixture(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    s = rng.gamma(2, 100, (40, 3))
    y = s @ np.array([0.6, 0.3, 0.1])
    sig = spark.createDataFrame([(f"g{i:02}", f"c{j}", float(s[i, j])) for i in range(40) for j in range(3)], "gene string, cell_type string, value double")
    mix = spark.createDataFrame([(f"g{i:02}", "m", float(y[i])) for i in range(40)], "gene string, sample string, value double")
    got = {r.cell_type: r for r in decomposition.run_cibersort(mix, sig, perm=5, quantile_norm=False).collect()}
    assert [got[c].weight for c in ("c0", "c1", "c2")] == pytest.approx([0.6, 0.3, 0.1], abs=0.06)
    assert got["c0"].correlation > 0.99 and got["c0"].pvalue <= 0.2


def test_hdp(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("b", "y", 2)], "sample string, category string, n long")
    ex = spark.createDataFrame([("a", "1", 0.9, 0.5), ("a", "2", 0.1, 0.0), ("b", "1", 0.05, 0.1), ("b", "2", 0.95, 0.3)], "sample string, signature string, value double, low double")
    sg = spark.createDataFrame([("1", "x", 1.0), ("2", "y", 1.0)], "signature string, category string, value double")
    assert rows(decomposition.hdp_reconstruct(ex, sg))[0] == ("a", "x", 0.9)
    fit = {r.sample: r for r in decomposition.hdp_fit(counts, ex, sg).collect()}
    assert fit["a"].n_mut == 4 and fit["a"].rmse == pytest.approx(((2.1**2 + 0.9**2) / 2) ** 0.5)
    keep = {(r.sample, r.signature): r for r in decomposition.hdp_significant(ex, counts, lower="low", cohort_threshold=2).collect()}
    assert keep["a", "2"].exposure == 0 and not keep["a", "1"].sig_cohort
    tree = spark.createDataFrame([("a", "p"), ("b", "p")], "child string, parent string")
    assert decomposition.Hdp(counts, tree).validate().summary().collect()[0].mutations == 8
    with pytest.raises(ValueError):
        decomposition.Hdp(counts, tree.union(spark.createDataFrame([("a", "q")], "child string, parent string"))).validate()


def test_sampling(spark):
    e = spark.createDataFrame([(f"g{i:02}", f"s{j}", float(i + j * (i % 3))) for i in range(30) for j in range(4)], "gene string, sample string, value double")
    f = spark.createDataFrame([(f"g{i:02}",) for i in (1, 5, 20)], "gene string")
    d = decomposition.sample_sim(e, f, size=5, nbin=3).collect()
    assert len(d) == 15 and len({(r.draw, r.gene) for r in d}) == 15
    o = decomposition.overdispersion(e, f, size=5, nbin=3).collect()[0]
    assert 0 <= o.dispersion <= 1 and 0 <= o.coordination <= 1


def test_sparcc(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.gamma(5, 20, (30, 5))
    base[:, 1] = base[:, 0] * rng.uniform(0.9, 1.1, 30)
    d = spark.createDataFrame([(f"s{i}", f"t{j}", int(base[i, j]) + 1) for i in range(30) for j in range(5)], "sample string, taxon string, n long")
    got = {(r.taxon1, r.taxon2): r for r in decomposition.sparcc(d, times=10, iterations=3).collect()}
    assert len(got) == 10 and got["t0", "t1"].cor == max(r.cor for r in got.values())


def test_consensus(spark):
    rows_ = []
    for study in ("a", "b", "c"):
        for rank in (1, 2):
            for fac in range(2):
                for g in range(12):
                    strong = g // 6 == fac
                    rows_.append((study, rank, fac, f"g{g:02}", 10.0 - g % 6 if strong else 0.01 * (g + 1)))
    b = spark.createDataFrame(rows_, "study string, rank_idx int, factor_idx int, gene string, coef double")
    for method, options in (("barkley", {"min_size": 3}), ("gavish", {"module_size": 6, "founder_intersection": 0.2})):
        m = nmf_consensus.nmf_consensus(b, method, **options)
        assert sorted(map(sorted, m.modules.values())) == [[f"g{g:02}" for g in range(6)], [f"g{g:02}" for g in range(6, 12)]], method
    assert "2 modules" in repr(m) and m.to_df().count() == 12


def test_map_ids(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 9.0), ("e", 5.0)], "id string, m double")
    got = ids.map_ids(f, {"a": "X", "b": "X", "c": "Y", "d": ""}, "sym", "id", mean="m")
    assert rows(got) == [("b", "X", 3.0), ("c", "Y", 2.0)]
    assert rows(ids.map_ids(f, {"a": "X", "b": "X"}, "sym", "id", decreasing=False, mean="m")) == [("a", "X", 1.0)]


def test_netmhc(spark, tmp_path):
    p = tmp_path / "out.xls"
    head = "\t\t\tHLA-A\t\tHLA-B\t\n" + "Pos\tPeptide\tID\tEL\tEL_Rank\tEL\tEL_Rank\tAve\tNB\n"
    p.write_text(head + "1\tAAAA\tq\t.1\t.4\t.2\t1.5\t.1\t1\n" + "2\tAAA\tq\t.1\t3\t.2\t.1\t.1\t1\n" + "1\tAAAAA\tr\t.1\t2\t.2\t.5\t.1\t1\n")
    got = netmhc.parse_netmhcpan(spark, str(p), ids=["one", "two"])
    assert rows(got.where("HLA = 'HLA-A'").select("identifiers", "Peptide", "BindLevel")) == [("one", "AAA", None), ("one", "AAAA", "SB"), ("two", "AAAAA", None)]
    assert got.count() == 6


def test_absolute_inputs(spark, tmp_path):
    seg = spark.createDataFrame([("s", "chr1", 1, 2, 3, 0.1), ("s", "chrX", 1, 2, 3, 0.2), (None, "1", 1, 2, 3, 0.3), ("t", "Y", 1, 2, 3, 0.4)], "Sample string, Chromosome string, Start long, End long, Num_Probes int, Segment_Mean double")
    maf = spark.createDataFrame([("s", "X", "G", "v", 5, 1, 2)], "Tumor_Sample_Barcode string, Chromosome string, Hugo_Symbol string, dbSNP_Val_Status string, Start_Position long, i_t_ref_count int, t_alt_count int")
    called = []
    absolute_io.run_absolute(seg, maf, str(tmp_path), lambda *a: called.append(a))
    assert rows(absolute_io.normalize_segments(seg).select("Sample", "Chromosome")) == [("s", "1"), ("s", "23")]
    assert [c[0] for c in called] == ["s"] and called[0][2]
    with pytest.raises(ValueError, match="t_ref_count"):
        absolute_io.normalize_mutations(maf.drop("i_t_ref_count"))


def test_remote_interfaces(spark):
    got = remote.keggdb(spark, [f"k{i}" for i in range(12)], lambda part: [{"id": x} | ({"genes": ["a", "b"]} if x == "k3" else {}) for x in part])
    assert got.count() == 12 and got.where("genes is not null").count() == 1
    tries = []

    def query(attributes):
        tries.append(attributes)
        if len(tries) == 1:
            raise OSError("busy")
        return spark.createDataFrame([(1, 2)], ["x", "y"])

    assert remote.get_bm(query, ["x", "a", "b"], split=["a", "b"]).count() == 2 and len(tries) == 3
    d = spark.createDataFrame([("2020-01-01",), ("2021-01-01",)], "date string")
    assert remote.snapshot(d, "2020-06-01").collect() == [("2020-01-01",)]


def test_streaming(spark, tmp_path):
    from lociframe.streaming import enrich

    mut, cnv = ccf_tables(spark)
    mut.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(mut.schema).parquet(str(tmp_path / "in"))
    q = enrich.enrich_mutations(stream, cnv).writeStream.format("memory").queryName("enriched").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("enriched").count() == 4
    timed = spark.createDataFrame([("2024-01-01 00:01:00", "s", 1, 3), ("2024-01-01 00:02:00", "s", 3, 1)], "t string, sample string, alt_counts int, ref_counts int").withColumn("ts", F.to_timestamp("t"))
    assert enrich.windowed_vaf(timed).collect()[0].mean_vaf == 0.5


def test_imports_without_optional_parts():
    import __spark_entry__ as e

    assert len(e.queries()) >= 50 and set(e.oracle_sql()) <= set(e.queries())


def test_integer_indices():
    from lociframe._validate import integer_indices

    names = ["a", "b", "b"]
    assert integer_indices(True, names) == [1, 2, 3] and integer_indices(False, names) == []
    assert integer_indices(["b", "a"], names) == [2, 1] and integer_indices([3, 1], names) == [3, 1] and integer_indices("a", names) == [1]
    for bad in (["c"], [0], [4], [None], [True, False], [["a"]], ["a", 1]):
        with pytest.raises(ValueError):
            integer_indices(bad, names)
    with pytest.raises(ValueError):
        integer_indices(True, names, bool_ok=False)


def test_disease_map(spark):
    from lociframe.sources.absolute_io import disease_map

    t = spark.createDataFrame([("x ", "A"), ("x", "A"), ("y", "B"), (None, "C")], "disease string, code string")
    assert sorted(map(tuple, disease_map(t).collect())) == [("x", "A"), ("y", "B")]
    with pytest.raises(ValueError):
        disease_map(t.union(spark.createDataFrame([("y", "C")], "disease string, code string")))


def test_unmatched_and_overlapping_segments(spark):
    from lociframe.operators import intervals

    mut = spark.createDataFrame([(1, "s", "1", 5), (2, "s", "1", 50), (3, "s", "2", 5), (4, None, "1", 5)], "mut_id int, sample string, chr string, pos int")
    seg = spark.createDataFrame([("s", "1", 1, 10), ("s", "1", 11, 20), ("s", "2", 1, None)], "sample string, chr string, start int, end int")
    for width in (None, 7):
        assert sorted(r.mut_id for r in intervals.unmatched(mut, seg, on_sample="sample", bin_width=width).collect()) == [2, 3, 4]
    assert [r.mut_id for r in intervals.identify_mut_cn(mut, seg, on_sample="sample").collect()] == [1]
    over = seg.union(spark.createDataFrame([("s", "1", 4, 6)], seg.schema))
    with pytest.raises(Exception, match="several segments"):
        intervals.identify_mut_cn(mut, over, on_sample="sample").collect()


@pytest.mark.parametrize("method", ["BH", "BY", "holm", "hochberg", "bonferroni", "hommel"])
def test_p_adjust_against_definitions(spark, method):
    import random

    from lociframe.functions.columns import p_adjust

    rng = random.Random(3)
    rows = [(k, "ab"[k % 2], rng.choice([0.0, 1.0, 1e-12, 0.02, 0.02, None, float("nan"), rng.random(), rng.random() ** 6])) for k in range(160)]
    got = {r.k: r.p_adj for r in p_adjust(spark.createDataFrame(rows, "k int, f string, p double").repartition(5), "p", method, by=["f"]).collect()}
    assert len(got) == len(rows)
    for f in "ab":
        own = sorted((p, k) for k, g, p in rows if g == f and p is not None and p == p)
        n, p = len(own), [x for x, _ in own]
        harmonic = sum(1 / i for i in range(1, n + 1))
        for i, (x, k) in enumerate(own, 1):
            if method == "hommel":  # closed testing: every set's Simes p, by its hardest member of each size
                want = max(min(min(m * y / j for j, y in enumerate(p[n - m :], 1)), m * x) for m in range(1, n + 1))
            else:
                want = {
                    "BH": lambda: min(n / j * p[j - 1] for j in range(i, n + 1)),
                    "BY": lambda: min(harmonic * n / j * p[j - 1] for j in range(i, n + 1)),
                    "holm": lambda: max((n - j + 1) * p[j - 1] for j in range(1, i + 1)),
                    "hochberg": lambda: min((n - j + 1) * p[j - 1] for j in range(i, n + 1)),
                    "bonferroni": lambda: n * x,
                }[method]()
            assert got[k] == pytest.approx(min(1.0, want), rel=1e-12, abs=1e-300), (f, i)
    assert all(got[k] is None or got[k] != got[k] for k, _, p in rows if p is None or p != p)


def test_hommel_against_closed_testing(spark):
    from itertools import combinations

    from lociframe.functions.columns import p_adjust

    p = [0.001, 0.012, 0.02, 0.021, 0.3, 0.8]
    got = [r.p_adj for r in p_adjust(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p", "hommel").orderBy("k").collect()]
    sets = [c for m in range(1, 7) for c in combinations(range(6), m)]
    simes = {c: min(len(c) * x / j for j, x in enumerate(sorted(p[i] for i in c), 1)) for c in sets}
    assert got == pytest.approx([max(v for c, v in simes.items() if i in c) for i in range(6)])


def test_snv_signature_with_size_factors(spark):
    from lociframe.operators import snv

    seq = "ACGTNACGTTACGATTACA" * 40
    g = snv.chunk_genome(spark.createDataFrame([("1", seq), ("2", "AC"), ("3", None)], "chr string, seq string"), width=50)
    want = {}
    rc = str.maketrans("ACGT", "TGCA")
    for i in range(len(seq) - 2):
        w = seq[i : i + 3]
        if "N" not in w:
            for x in (w, w.translate(rc)[::-1]):
                want[x] = want.get(x, 0) + 1
    assert {r.context: r.n for r in snv.kmer_counts(g, 3, width=50).collect()} == want
    at = [i + 1 for i in range(1, len(seq) - 1) if seq[i] == "C"][:30]
    mut = spark.createDataFrame([("s", "1", p, "C", "T") for p in at], "sample string, chr string, pos int, ref string, alt string")
    got = {r.snv_class: (r.n, r.value) for r in snv.snv_signature(mut, g, "sample", factors=snv.context_sizefactor(snv.contexts(["T", "C"]), g, width=50), width=50).collect()}
    wide = snv.chunk_genome(spark.createDataFrame([("1", seq)], "chr string, seq string"))
    assert {r.snv_class: (r.n, r.value) for r in snv.prepare_snv_signature(mut, wide, "sample", method="genome").collect()} == got
    assert sum(n for n, _ in got.values()) == len([p for p in at if "N" not in seq[p - 2 : p + 1]])
    for c, (n, v) in got.items():
        if n:
            assert v == pytest.approx(n / want[c[0] + c[2] + c[-1]])


def test_sampling_moves_only_what_it_may_take(spark):
    """Drawn again where the bound was too low, against plain Python; deviations from products as from whole draws."""
    import hashlib

    rng = random.Random(4)
    e = spark.createDataFrame([(f"g{i:03}", f"s{j}", i + rng.random() * 9) for i in range(120) for j in range(4) if j != 2 or i % 7], "gene string, sample string, value double")
    f = spark.createDataFrame([(f"g{i:03}",) for i in range(0, 120, 7)], "gene string")  # sample s2 lacks all of them
    bins = {r.gene: r.bin for r in decomposition.mean_bins(e, 3).collect()}
    mine = {r.gene for r in f.collect()}
    want = set()
    for draw in range(6):
        for b in set(bins.values()):
            of = sorted((hashlib.md5(f"{draw}|{g}|1".encode()).hexdigest(), g) for g in bins if bins[g] == b)
            want |= {(draw, g) for _, g in of[: sum(bins[g] == b for g in mine)]}
    for margin in (6.0, -5.0):
        assert {tuple(r) for r in decomposition.sample_sim(e, f, size=6, nbin=3, margin=margin).collect()} == want
    assert decomposition.overdispersion(e, f, size=20, nbin=3).collect() == decomposition.overdispersion(e, f, size=20, nbin=3, products=0).collect()
    own = f.withColumn("draw", F.lit(-1))
    got = decomposition._deviations(own, e, ["s0", "s1", "s2", "s3"], 1).first()
    whole = own.join(e, "gene").groupBy("draw").applyInPandas(decomposition._svd, "draw int, sd1 double, sd2 double").first()
    assert (got.sd1, got.sd2) == pytest.approx((whole.sd1, whole.sd2))


def test_svr_holds_no_kernel_matrix():
    import tracemalloc

    import numpy as np

    from lociframe.functions import kernels

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = x @ np.array([0.5, 0.3, 0.0]) + rng.normal(size=2000) * 0.05
    tracemalloc.start()
    w = kernels.nu_svr_linear(x, y, 0.5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w == pytest.approx([0.5, 0.3, 0.0], abs=0.02) and most < 4e6  # 2000 x 2000 numbers would take 32 MB


def test_svr_ends_at_the_optimum_of_many_rows():
    import numpy as np

    from lociframe.functions import kernels

    rng = np.random.default_rng(4)
    for n in (300, 20_000):
        x = rng.normal(size=(n, 3))
        y = x @ np.array([0.5, 0.3, 0.0]) + rng.normal(size=n)

        def loss(v, n=n, x=x, y=y):  # the regression as a minimum over weights and intercept: the largest nu n residuals count
            return v[:3] @ v[:3] / 2 + np.sort(np.abs(y - x @ v[:3] - v[3]))[-n // 2 :].sum()

        w = kernels.nu_svr_linear(x, y, 0.5)
        assert w == pytest.approx([0.5, 0.3, 0.0], abs=5 / n**0.5)
        near = np.median(y - x @ w) + np.linspace(-0.1, 0.1, 2001)
        best = min(near, key=lambda b: loss(np.append(w, b)))
        for away in rng.normal(size=(200, 4)) * 0.003:
            assert loss(np.append(w, best)) <= loss(np.append(w, best) + away) + n * 1e-7
    none = rng.integers(0, 3, (600, 3)).astype(float)  # ties without a relation: zero weights, not their rounding brought to a sum of 1
    w, _, r = decomposition._deconvolve((none - none.mean()) / none.std(), np.where(np.arange(600) % 100 == 0, 10.0, -0.1), False, "sig_score")
    assert not w.any() and np.isnan(r)


def test_cibersort_reads_its_inputs_once(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    s = rng.gamma(2, 100, (40, 3))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    sig = spark.createDataFrame([(f"g{i:02}", f"c{j}", float(s[i, j])) for i in range(40) for j in range(3)], "gene string, cell_type string, value double")
    mix = spark.createDataFrame([(f"g{i:02}", f"m{k}", float(s[i] @ np.roll([0.6, 0.3, 0.1], k))) for i in range(5, 40) for k in range(2)], "gene string, sample string, value double")
    run = lambda m: {(r.sample, r.cell_type): r for r in decomposition.run_cibersort(m, sig.mapInPandas(count, sig.schema), perm=20).collect()}
    got = run(mix.mapInPandas(count, mix.schema))
    assert seen.value == 120 + 70
    assert got == run(mix.repartition(3, "value"))  # the random mixtures do not depend on partitions
    assert got["m0", "c0"].weight > 0.5 and got["m1", "c1"].weight > 0.5
