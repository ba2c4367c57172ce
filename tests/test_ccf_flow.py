"""The whole flow of cancer-cell fractions, row by row in plain Python, against the distributed one."""

import math
import random
import statistics

import pytest

from lociframe.plans.ccf_pipeline import run_ccf

Z = 1.959963984540054
TOP = 1 - 2.0**-53


def prop_p(x, n, p, side):
    if n <= 0 or x > n or not 0 < p < 1:
        return None
    d = abs(x - n * p)
    stat = (d - min(0.5, d)) ** 2 / (n * p * (1 - p))
    if side == "two":
        return math.erfc(math.sqrt(stat / 2))
    z = math.copysign(math.sqrt(stat), x / n - p)
    return 0.5 * math.erfc((z if side == "greater" else -z) / math.sqrt(2))


def interval(x, n, p):
    y, a, e = min(0.5, abs(x - n * p)) / n, Z * Z / (2 * n), x / n
    bound = lambda v, s: (v + a + s * Z * math.sqrt(v * (1 - v) / n + a / (2 * n))) / (1 + 2 * a)
    return 0.0 if e - y <= 0 else bound(e - y, -1), 1.0 if e + y >= 1 else bound(e + y, 1)


def absolute(a, r, total, purity, normal):
    like = []
    for g in range(1, 101):
        f = min(purity * g / 100 / (normal * (1 - purity) + purity * total), 1.0)
        like.append(math.comb(a + r, a) * f**a * (1 - f) ** r)
    if min(like) == 0:
        like[-1] = 1.0
    share = [x / sum(like) for x in like]
    total_share, least = 0.0, None
    for x in sorted(share, reverse=True):
        total_share, least = total_share + x, x
        if total_share >= 0.95:
            break
    inside = [g for g in range(100) if share[g] >= least * (1 - 1e-9)]
    est = next(g for g in inside if like[g] >= max(like[i] for i in inside) * (1 - 1e-9))
    return (inside[0] + 1) / 100, (est + 1) / 100, (inside[-1] + 1) / 100, sum(share[:90])


def states(a, b):
    """[(fraction, major, minor)] of two or four sub-clonal states."""

    def parts(x):
        near = math.ceil(x) - x
        snap = lambda f: 0.0 if f < 0.01 else 1.0 if f > 0.99 else f
        return [(snap(near), math.floor(x)), (snap(1 - near), math.ceil(x))]

    j, n = parts(a), parts(b)
    if j[0][0] in (n[0][0], n[1][0], 0.0, 1.0) or n[0][0] in (0.0, 1.0):
        big = lambda p: p if p[0][0] >= p[1][0] else p[::-1]
        (ja, mja), (jb, mjb) = big(j)
        (na, mna), (nb, mnb) = big(n)
        fa, fb = (ja, jb) if na == 1 else (na, nb) if ja == 1 else (ja, jb)
        return [(fa, mja, mna), (fb, mja if ja == 1 else mjb, mna if na == 1 else mnb)]
    f = j[0][0] * n[0][0]
    g = j[1][0] * n[1][0]
    return [(f, j[0][1], n[0][1]), (j[0][0] - f, j[0][1], n[1][1]), (g, j[1][1], n[1][1]), (j[1][0] - g, j[1][1], n[0][1])]


def nearest(copies, kept):
    options = [1.0]
    for a, b, fa, fb in kept:
        options.append(fa if a > b else fb if a < b else None)
    far = [math.inf if f is None or f == 0 else abs(copies / f - 1) for f in options]
    return options[far.index(min(far))]


def amplified(copies, alt, pairs, conipher):
    best, off, tried = 1.0, copies - 1, [1.0]
    for a, b, fa, fb in pairs:
        (hi, fh), (lo, fl) = ((a, fa), (b, fb)) if a >= b else ((b, fb), (a, fa))
        for j in range(1, int(hi) + 1):
            end = min(j, int(lo))
            for k in range(j - 1, end + 1) if end >= j - 1 else range(j - 1, end - 1, -1):
                cn = j * fh + k * fl
                if cn and abs(copies / cn - 1) < off:
                    best, off = cn, abs(copies / cn - 1)
                    tried.append(cn)
    if conipher and copies / best < 1 and best > 1:
        p = prop_p(alt / 2, round(alt / (copies / best)), 0.5, "two")
        if p is not None and p < 0.05 and [c for c in tried if c != best]:
            return best, max(c for c in tried if c != best)
    return best, best


def flow(rows, conipher, min_vaf):
    """rows: dicts with alt, ref, purity, a, b, normal, sample, place, indel."""
    out = []
    for r in rows:
        total, n = r["a"] + r["b"], r["alt"] + r["ref"]
        m_of = lambda v, r=r, total=total: v / r["purity"] * (r["purity"] * total + r["normal"] * (1 - r["purity"]))
        expected = min(r["purity"] / (r["normal"] * (1 - r["purity"]) + r["purity"] * total), 1.0)
        seen = r["alt"] / n
        o = {"m": m_of(seen), "seen": seen, "expected": expected, "abs": absolute(r["alt"], r["ref"], total, r["purity"], r["normal"]), "m_of": m_of}
        o["less"] = prop_p(r["alt"], n, min(expected, TOP), "less")
        o["ci"] = interval(r["alt"], n, min(expected, TOP))
        out.append(o)
    known = sorted((o["less"], i) for i, o in enumerate(out) if o["less"] is not None)
    low = 1.0
    for k in range(len(known), 0, -1):
        low = min(low, known[k - 1][0] * len(known) / k)
        out[known[k - 1][1]]["adjusted"] = low
    for r, o in zip(rows, out, strict=True):
        m, s, n = o["m"], states(r["a"], r["b"]), r["alt"] + r["ref"]
        four = len(s) == 4
        sub = m > 0.01 and (min_vaf is None or o["seen"] >= min_vaf)
        sub = sub and (o.get("adjusted", 1) < 0.01 and o["abs"][2] < 1 if conipher else o["abs"][3] > 0.5)
        res = {"phylo": m, "lower": o["m_of"](o["ci"][0]), "higher": o["m_of"](o["ci"][1]), "bearing": 1.0, "expected": o["expected"], "which": None, "change": 0}
        if sub and s[0][0] == 1:
            res["which"] = "A,B"
        elif sub:
            f = [x[0] for x in s]
            if four:
                kept = [(s[0][1] + s[1][1], s[2][1] + s[3][1], f[0] + f[1], f[2] + f[3]), (s[0][2] + s[3][2], s[2][2] + s[1][2], f[0] + f[3], f[2] + f[1])]
            else:
                kept = [(s[0][1], s[1][1], f[0], f[1]), (s[0][2], s[1][2], f[0], f[1])]
            best = nearest(m, kept)
            prop = res["expected"] * best
            if best == 1 or (conipher and best >= 0.95):
                res["which"] = "A,B,C,D" if four else "A,B"
                p = None
            else:
                p = prop_p(r["alt"], n * r["purity"], prop / r["purity"], "less")
            lo, hi = interval(r["alt"], n, min(prop, TOP))
            if p is not None and p > 0.01 and (not conipher or o["m_of"](lo) / best <= 1):
                res |= {"phylo": m / best, "lower": o["m_of"](lo) / best, "higher": o["m_of"](hi) / best, "bearing": best, "expected": prop, "change": 1}
        p = prop_p(r["alt"], n, min(res["expected"], TOP), "greater")
        if p is not None and p <= 0.05 and m > 1:
            f = [x[0] for x in s]
            pairs = [(s[0][1], s[2][1], f[0] + f[1], f[2] + f[3]), (s[0][2], s[1][2], f[0] + f[3], f[2] + f[1])] if four else [(s[0][1], s[1][1], f[0], f[1])]
            res["bearing"], by = amplified(m, r["alt"], pairs, conipher)
            for c in ("phylo", "lower", "higher"):
                res[c] /= by
            res["expected"] *= by
            res["amplified"] = True
        res["abs"] = o["abs"][1]
        if r["alt"] == 0:
            res |= {"bearing": 0.0, "expected": 0.0, "abs": 0.0}
        res["m"] = m
        o["res"] = res
    return [o["res"] for o in out]


def table(seed):
    rng = random.Random(seed)
    segs, rows = [], []
    for s in range(4):
        purity = [0.35, 0.6, 0.8, 0.95][s]
        for c in range(12):
            a, b = rng.choice([(1.0, 1.0), (2.0, 1.0), (2.3, 1.0), (1.7, 0.4), (3.6, 1.5), (4.2, 0.0), (1.0, 0.6), (5.35, 2.2)])
            segs.append((f"S{s}", str(c), 1, 1000, math.ceil(a), math.floor(b), a, b, purity))
            for i in range(9):
                depth = rng.choice([12, 40, 150])
                alt = min(depth, max(0, int(rng.random() ** 1.5 * depth)))
                rows.append({"id": len(rows), "sample": f"S{s}", "chr": str(c), "pos": i + 1, "ref_base": "A", "alt_base": "CG" if i % 4 == 0 else "C", "alt": alt, "ref": depth - alt, "purity": purity, "a": a, "b": b, "normal": 2})
    return segs, rows


@pytest.mark.parametrize("conipher,min_vaf", [(False, None), (False, 0.1), (True, 0.05)])
def test_flow_equals_plain_python(spark, conipher, min_vaf):
    segs, rows = table(11)
    cnv = spark.createDataFrame(segs, "sample string, chr string, startpos long, endpos long, nMajor int, nMinor int, nAraw double, nBraw double, purity double")
    mut = spark.createDataFrame([tuple(r[k] for k in ("id", "sample", "chr", "pos", "ref_base", "alt_base", "alt", "ref")) for r in rows], "id long, sample string, chr string, pos long, ref string, alt string, alt_counts int, ref_counts int")
    want = flow(rows, conipher, min_vaf)
    options = dict(mut_id="id", conipher=conipher, min_vaf_to_explain=min_vaf)
    got = {r.id: r for r in run_ccf(mut, cnv, **options).collect()}
    assert len(got) == len(rows) == 432
    kinds = [0, 0, 0]
    for r, w in zip(rows, want, strict=True):
        g = got[r["id"]]
        for name, value in (("phyloCCF", w["phylo"]), ("phyloCCF_lower", w["lower"]), ("phyloCCF_higher", w["higher"]), ("mutCopyNum", w["m"]), ("no_chrs_bearing_mut", w["bearing"]), ("expVAF", w["expected"]), ("absCCF", w["abs"])):
            assert g[name] == pytest.approx(value, rel=1e-9, abs=1e-12), (name, r)
        assert (g.whichFrac, g.CPNChange) == (w["which"], w["change"])
        kinds = [kinds[0] + (w["which"] is not None), kinds[1] + w["change"], kinds[2] + ("amplified" in w)]
    assert min(kinds) > 0, kinds  # clonal losses, explained losses and amplifications all occur
    # indels: factors by sample over mutations seen in every sample
    fixed = {r.id: r for r in run_ccf(mut, cnv, ref_field="ref", alt_field="alt", **options).collect()}
    seen = {}
    for r in rows:
        seen.setdefault((r["chr"], r["pos"]), []).append(r["alt"] / (r["alt"] + r["ref"]) > 0.05)
    factor = {}
    for s in {r["sample"] for r in rows}:
        own = [(r["alt_base"] == "CG", w["phylo"]) for r, w in zip(rows, want, strict=True) if r["sample"] == s and sum(seen[r["chr"], r["pos"]]) == 4]
        both = [[v for k, v in own if k == kind] for kind in (False, True)]
        factor[s] = statistics.median(both[0]) / statistics.median(both[1]) if all(both) else 1.0
    assert any(f != 1 for f in factor.values())
    for r, w in zip(rows, want, strict=True):
        f = factor[r["sample"]] if r["alt_base"] == "CG" else 1.0
        assert fixed[r["id"]].phyloCCF == pytest.approx(w["phylo"] * f, rel=1e-9)
