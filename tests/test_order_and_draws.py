"""Ordered scans, sorted sweeps and the portable random stream against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import kernels
from lociframe.functions.draws import uniform
from lociframe.operators import arm, ccf, rrho, ssgsea
from lociframe.operators.scan import average_ranks, ordered_scan
from lociframe.operators.sweep import sweep_join
from lociframe.sources import netmhc


def draw(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52


def test_uniform_is_the_stated_digest(spark):
    d = spark.createDataFrame([(1, "é|x"), (-7, "")], "k long, t string")
    got = d.select("k", "t", uniform(5, F.col("t"), F.col("k")).alias("u")).collect()
    assert all(r.u == draw(5, r.t, r.k) for r in got)
    u = spark.range(20_000).select(uniform(1, F.col("id")).alias("u")).toPandas()["u"].to_numpy()
    counts = np.histogram(u, 20, (0, 1))[0]
    assert ((counts - 1000) ** 2 / 1000).sum() < 43.8  # chi-square, 19 degrees, 0.999


@pytest.mark.parametrize("rows_per_task", [10_000, 13])
def test_ordered_scan(spark, rows_per_task):
    rng = random.Random(1)
    rows = [(i, rng.choice([1.0, 2.0, 2.0, 5.5, -3.0]), rng.choice([None, 1, 2])) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, v double, w long").repartition(7)
    got = ordered_scan(d, [-F.col("v"), F.col("id")], {"run": F.col("w"), "rises": F.when(F.col("prev_id") < F.col("id"), 1)}, previous=("id", "w"), rows_per_task=rows_per_task).orderBy("place").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    total, rises = 0, 0
    for k, (r, (i, v, w)) in enumerate(zip(got, want, strict=True)):
        total += w or 0
        rises += k > 0 and want[k - 1][0] < i
        assert (r.place, r.id, r.run, r.rises) == (k + 1, i, total, rises)
        assert (r.prev_id, r.prev_w) == ((want[k - 1][0], want[k - 1][2]) if k else (None, None))
        assert r.run_total == sum(x[2] or 0 for x in rows)
    assert ordered_scan(d.limit(0), [F.col("id")], {"run": F.col("w")}).collect() == []
    ranks = {r.id: r.k for r in average_ranks(d, "v", "k", rows_per_task=2 if rows_per_task < 100 else 10).collect()}
    values = [v for _, v, _ in rows]
    assert all(ranks[i] == sum(x < v for x in values) + (values.count(v) + 1) / 2 for i, v, _ in rows)


def test_sequence_runs_over_partitions(spark, monkeypatch):
    import lociframe.operators.scan as scan

    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(1, 3), rng.choice("ab")) for i in range(120)]
    d = spark.createDataFrame(rows, "at long, peptide string, id string")
    run, want = 1, []
    for k, (i, p, s) in enumerate(rows):
        run += k > 0 and (len(p) > len(rows[k - 1][1]) or s != rows[k - 1][2])
        want.append((i, run))
    monkeypatch.setattr(scan, "ordered_scan", scan.ordered_scan)
    monkeypatch.setattr(netmhc, "ordered_scan", lambda *a, **k: scan.ordered_scan(*a, **k, rows_per_task=17))
    got = netmhc.sequence_runs(d, "at", "peptide", "id")
    assert got.columns == ["at", "peptide", "id", "identifiers"]
    assert [(r.at, r.identifiers) for r in got.orderBy("at").collect()] == want


@pytest.mark.parametrize("rows_per_cell", [1_000_000, 9])
def test_sweep_equals_nested_loops(spark, rows_per_cell):
    rng = random.Random(3)
    segs, at = [], 0
    for s in ("a", "b", "hot"):
        at = 0
        for _ in range(30):
            at += rng.randint(1, 9)
            end = at + rng.randint(0, 12)
            segs.append((s, at, end, f"{s}{at}"))
            at = end + 1
    segs += [(None, 1, 5, "n"), ("a", None, 5, "m"), ("a", 900, 10, "backwards")]
    points = [(i, rng.choice(["a", "b", "hot", "hot", "hot", "none"]), rng.choice([rng.randint(-3, 400), 77])) for i in range(300)]
    points += [(1000, None, 4), (1001, "a", None), (1002, "hot", 77), (1002, "hot", 77)]
    p = spark.createDataFrame(points, "id long, key string, pos long").withColumn("note", F.lit("p"))
    r = spark.createDataFrame(segs, "name string, start long, end long, note string")
    want = []
    for i, k, x in points:
        hit = [(s, e, n) for name, s, e, n in segs if k is not None and x is not None and s is not None and name == k and s <= x <= e]
        want.append((i, k, x, "p", *((k, *hit[0]) if hit else (None,) * 4)))
    for how in ("left", "inner"):
        got = sweep_join(p, r, [("key", "name")], "pos", "start", "end", how, rows_per_cell)
        assert got.columns == ["id", "key", "pos", "i_note", "name", "start", "end", "note"]
        expect = [w for w in want if how == "left" or w[4] is not None]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expect))


def test_wgd_permutations_by_hand(spark):
    bands = spark.createDataFrame([(f"chr{c}", a, b, n, st) for c in (1, 2, 3) for a, b, n, st in ((1, 50, "p1", "gneg"), (51, 60, "p11", "acen"), (61, 100, "q1", "gneg"))], "chr string, start long, end long, name string, gieStain string")
    seg = [("s", c, a, b, ma, mi, 2.0) for c, a, b, ma, mi in (("1", 1, 50, 3, 1), ("1", 61, 100, 1, 0), ("2", 1, 50, 2, 2), ("2", 61, 100, 1, 1), ("3", 1, 50, 4, 0), ("3", 61, 100, 2, 1))]
    d = spark.createDataFrame(seg, "sample string, chr string, startpos long, endpos long, major_cn int, minor_cn int, ploidy double")
    got = arm.wgd_test(d, arm.get_cytoband(bands), "sample", perm_times=600, seed=9).collect()[0]
    arms = sorted((c, "p" if a == 1 else "q", ma, mi) for _, c, a, _, ma, mi, _ in seg)
    total = sum(abs(ma - 1) + abs(mi - 1) for _, _, ma, mi in arms)
    event = sum(ma >= 2 for _, _, ma, _ in arms) / len(arms)
    slots = [(i, np.sign(ma - 1)) for i, (_, _, ma, _) in enumerate(arms)] + [(i, np.sign(mi - 1)) for i, (_, _, _, mi) in enumerate(arms)]
    slots = [x for x in slots if x[1]]
    hits = 0
    for perm in range(1, 601):
        drawn = [slots[math.floor(draw(9, "s", perm, e) * len(slots))] for e in range(1, total + 1)]
        hits += len({i for i, s in drawn if s > 0}) / len(arms) >= event
    assert (got.pvalue, got.total_aber, got.wgd_event) == (hits / 600, total, event) and 0 < hits < 600


def test_bootstrap_by_inversion(spark):
    rows = [(3, 9), (0, 5), (7, 0), (30, 31), (3, 9)]
    d = spark.createDataFrame([(i, a, r, 2, 1, 0.8, 2) for i, (a, r) in enumerate(rows)], "id int, alt_counts int, ref_counts int, major_cn int, minor_cn int, purity double, normal_cn int")
    got = {x.id: x for x in ccf.bootstrap_ccf(d, times=200, seed=4).collect()}
    for i, (a, r) in enumerate(rows):
        n = a + r
        if not r:
            continue
        ks = []
        for k in range(1, 201):
            u, c, j = draw(4, a, r, k), 0.0, 0
            while j < n and (c := c + math.comb(n, j) * (a / n) ** j * (1 - a / n) ** (n - j)) <= u:
                j += 1
            ks.append(j / n)
        mid, sd = 2 * a / n - np.mean(ks), np.std(ks, ddof=1)
        scale = (0.8 * 3 + 2 * 0.2) / 0.8
        assert got[i].mut_multi_btstr_lower == pytest.approx((mid - 1.959963984540054 * sd) * scale, abs=1e-9)
        assert got[i].mut_multi_btstr_higher == pytest.approx((mid + 1.959963984540054 * sd) * scale, abs=1e-9)


def test_hypergeometric_tables_equal_sums():
    n = 60
    for m, k in ((10, 20), (60, 5), (33, 33), (1, 59)):
        counts = np.arange(max(0, m + k - n), min(m, k) + 1)
        a, s = kernels.hypergeometric_tails(counts, m, k, n)
        b, t = kernels.hypergeometric_log_p(counts, np.full(len(counts), m), np.full(len(counts), k), n, kernels.LogFactorial(n))
        assert np.allclose(a, b, atol=1e-9) and (s == t).all()


@pytest.mark.parametrize("rows_per_task", [1000, 8])
def test_overlap_permutations_by_hand(spark, rows_per_task):
    rng = random.Random(6)
    rows = [(f"g{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(40)]
    d = spark.createDataFrame(rows, "item string, a double, b double")
    r = rrho.run_rrho(d.selectExpr("item", "a as value"), d.selectExpr("item", "b as value"), stepsize=7)
    ranks = {x.item: x.rank1 for x in r.ranks.collect()}
    got = {}
    for x in rrho.permuted_ranks(r, 5, 3, rows_per_task).collect():
        got.setdefault(x.perm_id, {})[x.rank1] = x.rank2
    for p in range(5):
        order = sorted(ranks, key=lambda i: (draw(3, p, i), i))
        assert got[p] == {ranks[i]: k + 1 for k, i in enumerate(order)}
    cells = {(c.i, c.j): c for c in r.cells.collect()}
    lf = kernels.LogFactorial(40)
    permuted = {x.perm_id: x.statistic for x in rrho.permutation_test(r, 5, seed=3)[1].collect()}
    for p in range(5):
        best = {}
        for (i, j), c in cells.items():
            n = sum(r1 <= i and r2 <= j for r1, r2 in got[p].items())
            lp, sign = kernels.hypergeometric_log_p(np.array([n]), np.array([j]), np.array([i]), 40, lf)
            if c.dir1 == c.dir2:
                best.setdefault(c.dir1, []).append(sign[0] * abs(lp[0]) / math.log(10))
        assert permuted[p] == pytest.approx(sum(map(max, best.values())))


def test_enrichment_permutations_by_hand(spark):
    rng = random.Random(8)
    expr = [(f"g{i}", s, rng.random() * 9) for s in ("x", "y") for i in range(30) if s == "x" or i % 7]
    sets = [("A", f"g{i}") for i in range(4)] + [("B", f"g{i}") for i in range(10, 19)]
    e, g = spark.createDataFrame(expr, "gene string, sample string, value double"), spark.createDataFrame(sets, "set string, item string")
    got = {(r.set, r.sample): r for r in ssgsea.run_ssgsea(e, g, perm=60, sample_norm_type="none", seed=2).collect()}
    for sample in ("x", "y"):
        ranked = sorted(((v, n) for n, s, v in expr if s == sample), key=lambda r: (-r[0], r[1]))
        n = len(ranked)

        def score(places, ranked=ranked, n=n):
            w = [abs(ranked[p - 1][0]) ** 0.75 for p in places]
            back = [n - p + 1 for p in places]
            return sum(a * b for a, b in zip(w, back, strict=True)) / sum(w) - (n * (n + 1) / 2 - sum(back)) / (n - len(places))

        for name, k in (("A", 4), ("B", 9)):
            null = [score([p for p in sorted(range(1, 31), key=lambda p: draw(2, q, p)) if p <= n][:k]) for q in range(60)]
            r = got[name, sample]
            side = [x for x in null if (x >= 0) == (r.ES >= 0)]
            assert r.NES == pytest.approx(r.ES / abs(np.mean(side)))
            beyond = sum(x >= r.NES for x in null) if r.NES >= 0 else sum(x <= r.NES for x in null)
            assert r.pvalue == pytest.approx((beyond + 1) / (len(side) + 1))


def test_null_scores_by_segments_and_windows(spark):
    """Sums between set sizes as by windows over whole orders; orders drawn again where the bound was too low; no literal of all places."""
    rng = random.Random(9)
    e = spark.createDataFrame([(f"g{i}", s, rng.random() * 9) for s, gap in (("x", 99), ("y", 5), ("z", 3)) for i in range(60) if i % gap], "gene string, sample string, value double")
    sizes = spark.createDataFrame([(3,), (8,), (20,), (45,)], "k long")
    one, two = ({(r.sample, r.k, r.perm_id): r.null for r in ssgsea.null_scores(e, sizes, 15, seed=3, sums=n).collect()} for n in (10**6, 0))
    assert one.keys() == two.keys() and ("z", 45, 0) not in one and all(one[k] == pytest.approx(two[k]) for k in one)
    places = sorted(range(1, 61), key=lambda p: draw(3, 4, p))[:25]
    for margin in (6.0, -4.0):
        first = ssgsea.first_places(e, 60, 25, 15, 3, margin)
        assert [r.pos for r in first.where("perm_id = 4").orderBy("i").collect()] == places and first.count() == 15 * 25
