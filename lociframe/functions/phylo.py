"""Phylogenetic cancer-cell fractions of many mutations at once, in numpy."""

from __future__ import annotations

import numpy as np

from . import kernels

GRID = np.linspace(0.01, 1.0, 100)
Z95 = 1.959963984540054
FIELDS = ["expVAF", "obsVAF", "mutCopyNum", "phyloCCF", "phyloCCF_lower", "phyloCCF_higher", "absCCF", "absCCF_lower", "absCCF_higher", "no_chrs_bearing_mut"]


def abs_ccf_rows(alt, ref, total, purity, normal) -> np.ndarray:
    """(lower, estimate, higher, P(subclonal), P(clonal)) of each row over the grid of fractions; NaN where undefined."""
    out = np.full((len(alt), 5), np.nan)
    base = normal * (1 - purity) + purity * total
    ok = np.flatnonzero(~np.isnan(alt + ref + total + purity + normal) & (alt + ref > 0) & (base != 0))
    for at in range(0, len(ok), 4096):  # rows x 100 candidates at a time
        k = ok[at : at + 4096]
        vaf = np.minimum(purity[k, None] * GRID[None, :] / base[k, None], 1.0)
        out[k] = kernels.highest_density_rows(kernels.binomial_pmf_rows(alt[k], (alt + ref)[k], vaf), GRID)
    return out


def wilson(x, n, p) -> tuple[np.ndarray, np.ndarray]:
    """95 % interval of x / n with continuity correction min(.5, |x - n p|)."""
    y, a, e = np.minimum(0.5, np.abs(x - n * p)) / n, Z95**2 / (2 * n), x / n
    lo, hi = e - y, e + y
    low = (lo + a - Z95 * np.sqrt(lo * (1 - lo) / n + a / (2 * n))) / (1 + 2 * a)
    high = (hi + a + Z95 * np.sqrt(hi * (1 - hi) / n + a / (2 * n))) / (1 + 2 * a)
    return np.where(lo <= 0, 0.0, low), np.where(hi >= 1, 1.0, high)


def best_loss(kept, copies: np.ndarray) -> np.ndarray:
    """Of 1 and the fractions that keep more copies of either allele, the one that brings copies / candidate nearest to 1.

    ``kept`` has (copies a, copies b, fraction a, fraction b) for each allele.
    """
    options = [np.ones_like(copies)]
    for a, b, fa, fb in kept:
        options.append(np.where(a > b, fa, np.where(a < b, fb, np.nan)))
    f = np.stack(options)
    far = np.abs(copies / np.where(f == 0, np.nan, f) - 1)
    return np.take_along_axis(f, np.where(np.isnan(far), np.inf, far).argmin(axis=0)[None], 0)[0]


def amplified_grid(high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate copies (j, k) of the more and the less copied state, in order: k runs from j - 1 to min(j, low), either way."""
    pairs = [(j, k) for j in range(1, high + 1) for k in _between(j - 1, min(j, low))]
    return np.array([j for j, _ in pairs], float), np.array([k for _, k in pairs], float)


def _between(a: int, b: int) -> range:
    return range(a, b + 1) if b >= a else range(a, b - 1, -1)


def best_amplified(copies: np.ndarray, alt: np.ndarray, pairs, check_excess: bool) -> tuple[np.ndarray, np.ndarray]:
    """(copies that bear the mutation, number to divide by) of each row.

    ``pairs`` has arrays (copies in state 1, in state 2, fraction 1, fraction
    2) of each allele split.  Over the grid of candidates j * f1 + k * f2 the
    one nearest to the mutation's copies wins, the first of equals, and 1 if
    none is strictly nearer.  With ``check_excess``, where the winner exceeds
    the mutation's copies significantly, the division is by the largest other
    number that was nearest for a while.
    """
    n = len(copies)
    shape = np.zeros((n, 2 * len(pairs)))
    known = []
    for i, p in enumerate(pairs):
        ok = ~np.isnan(np.stack(p)).any(axis=0)
        known.append(ok)
        shape[:, 2 * i] = np.where(ok, np.maximum(p[0], p[1]), -1)
        shape[:, 2 * i + 1] = np.where(ok, np.minimum(p[0], p[1]), -1)
    best, divide = np.ones(n), np.ones(n)
    kinds, own = np.unique(shape, axis=0, return_inverse=True)
    for kind in range(len(kinds)):
        at = np.flatnonzero(own.ravel() == kind)
        tried = [np.ones((len(at), 1))]
        for i, (a, b, fa, fb) in enumerate(pairs):
            high, low = int(kinds[kind, 2 * i]), int(kinds[kind, 2 * i + 1])
            if high < 1:
                continue
            j, k = amplified_grid(high, low)
            swap = a[at] < b[at]
            f_high, f_low = np.where(swap, fb[at], fa[at]), np.where(swap, fa[at], fb[at])
            tried.append(j[None, :] * f_high[:, None] + k[None, :] * f_low[:, None])
        cn = np.concatenate(tried, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.abs(copies[at, None] / np.where(cn == 0, np.nan, cn) - 1)
        off = np.where(np.isnan(off), np.inf, off)
        off[:, 0] = copies[at] - 1
        nearest = np.minimum.accumulate(off, axis=1)
        record = np.concatenate([np.ones((len(at), 1), bool), off[:, 1:] < nearest[:, :-1]], axis=1)
        last = off.shape[1] - 1 - record[:, ::-1].argmax(axis=1)
        best[at] = divide[at] = cn[np.arange(len(at)), last]
        if check_excess:
            other = np.where(record & (cn != best[at, None]), cn, -np.inf).max(axis=1)
            ratio = copies[at] / best[at]
            p = kernels.prop_test_p(alt[at] / 2, np.round(alt[at] / ratio), np.full(len(at), 0.5))
            with np.errstate(invalid="ignore"):
                use = (ratio < 1) & (best[at] > 1) & (p < 0.05) & np.isfinite(other)
            divide[at] = np.where(use, other, divide[at])
    return best, divide


def phylo_rows(alt, ref, purity, major, minor, normal, frac, maj, mnr, adjusted, min_vaf, conipher: bool, rescale: bool) -> dict[str, np.ndarray]:
    """All row-local steps: observed and expected fractions, loss and amplification of subclones.

    ``frac``, ``maj`` and ``mnr`` map the states A to D to arrays; NaN is null;
    ``adjusted`` holds the corrected p-values of the test below the expected
    fraction (for ``conipher``).
    """
    with np.errstate(all="ignore"):
        total, depth = major + minor, alt + ref
        copies_of = lambda v, n=normal: v / purity * (purity * total + n * (1 - purity))
        below_one = lambda v: np.minimum(v, kernels.ONE_BELOW)
        expected = np.minimum(purity / (normal * (1 - purity) + purity * total), 1.0)
        seen = np.where(depth != 0, alt / depth, np.nan)
        m = copies_of(seen)
        absolute = abs_ccf_rows(alt, ref, total, purity, normal)
        lo, hi = wilson(alt, depth, below_one(expected))
        out = {"obsVAF": seen, "mutCopyNum": m, "phyloCCF": m.copy(), "phyloCCF_lower": copies_of(lo), "phyloCCF_higher": copies_of(hi), "absCCF_lower": absolute[:, 0], "absCCF_higher": absolute[:, 2]}
        bearing, change = np.ones(len(alt)), np.zeros(len(alt), np.int32)

        sub = m > 0.01
        if min_vaf is not None:
            sub &= seen >= min_vaf
        sub &= (adjusted < 0.01) & (absolute[:, 2] < 1) if conipher else absolute[:, 3] > 0.5
        A, B, C, D = (frac[s] for s in "ABCD")
        J, N = maj, mnr
        two = best_loss([(J["A"], J["B"], A, B), (N["A"], N["B"], A, B)], m)
        four = best_loss([(J["A"] + J["B"], J["C"] + J["D"], A + B, C + D), (N["A"] + N["D"], N["C"] + N["B"], A + D, C + B)], m)
        is_four = ~np.isnan(C)
        best = np.where(sub & (A != 1) & ~np.isnan(A), np.where(is_four, four, two), np.nan)
        clonal = (best == 1) | ((best >= 0.95) if conipher else False)
        which = np.where(clonal & is_four, "A,B,C,D", np.where(clonal | (sub & (A == 1)), "A,B", None))
        prop = expected * best
        p = kernels.prop_test_p(alt, depth * purity, np.where(clonal, np.nan, prop / purity), "less")
        elo, ehi = wilson(alt, depth, below_one(prop))
        of = normal if rescale else np.full(len(alt), 2.0)
        explained = p > 0.01
        if conipher:
            explained &= copies_of(elo, of) / best <= 1
        for name, v in (("phyloCCF", m / best), ("phyloCCF_lower", copies_of(elo, of) / best), ("phyloCCF_higher", copies_of(ehi, of) / best)):
            out[name] = np.where(explained, v, out[name])
        bearing, expected, change = np.where(explained, best, bearing), np.where(explained, prop, expected), np.where(explained, 1, change)

        amp = (kernels.prop_test_p(alt, depth, below_one(expected), "greater") <= 0.05) & (m > 1)
        k = np.flatnonzero(amp)
        f = is_four[k]
        none = lambda v: np.where(f, v[k], np.nan)
        first = (J["A"][k], np.where(f, J["C"][k], J["B"][k]), np.where(f, (A + B)[k], A[k]), np.where(f, (C + D)[k], B[k]))
        second = (none(N["A"]), none(N["B"]), none(A + D), none(C + B))
        bears, by = best_amplified(m[k], alt[k], [first, second], conipher)
        for name in ("phyloCCF", "phyloCCF_lower", "phyloCCF_higher"):
            out[name][k] /= by
        expected[k] *= by
        bearing[k] = bears
        gone = alt == 0
        out |= {"expVAF": np.where(gone, 0.0, expected), "absCCF": np.where(gone, 0.0, absolute[:, 1]), "no_chrs_bearing_mut": np.where(gone, 0.0, bearing), "whichFrac": which, "CPNChange": change}
    return out
