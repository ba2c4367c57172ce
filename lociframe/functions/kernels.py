"""Numerical kernels in numpy, free of Spark: special functions, tests, intervals, solvers."""

from __future__ import annotations

import math

import numpy as np

TIE = 1e-9  # likelihoods that differ by less are equal but for rounding
ONE_BELOW = 1 - 2.0**-53  # the largest double that still counts as a proper fraction

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def erfc(x):
    return np.asarray(_erfc(np.asarray(x, float)), float)


def lgamma(x):
    return np.asarray(_lgamma(np.asarray(x, float)), float)


class LogFactorial:
    """log(k!) for k = 0..n as a table."""

    def __init__(self, n: int):
        self.table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1, dtype=float)))])

    def choose(self, n, k):
        return self.table[n] - self.table[k] - self.table[n - k]


def binomial_pmf(k: float, n: float, p: np.ndarray) -> np.ndarray:
    """Binomial probabilities in linear scale; p may hold 0 and 1."""
    p = np.clip(np.asarray(p, float), 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        out = np.exp(log + (k * np.log(p) if k else 0.0) + ((n - k) * np.log1p(-p) if n - k else 0.0))
    return out


def binomial_pmf_rows(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """:func:`binomial_pmf` of every row: k and n for each row of the matrix p."""
    p = np.clip(p, 0.0, 1.0)
    k, rest = np.asarray(k, float)[:, None], (np.asarray(n, float) - k)[:, None]
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        log = (lgamma(np.asarray(n, float) + 1) - lgamma(k[:, 0] + 1) - lgamma(rest[:, 0] + 1))[:, None]
        return np.exp(log + np.where(k != 0, k * np.log(p), 0.0) + np.where(rest != 0, rest * np.log1p(-p), 0.0))


def bootstrap_bounds(x: int, n: int, u: np.ndarray) -> tuple[float, float]:
    """Normal bootstrap bounds of a proportion x / n from uniform draws: binomial replicates by inversion."""
    below = np.cumsum(binomial_pmf_rows(np.arange(n), np.full(n, n), np.full((n, 1), x / n))[:, 0])  # P(X <= k), k < n
    k = np.searchsorted(below, u, side="right")
    s1, s2, times = int(k.sum()), int((k * k).sum()), len(u)
    mid, sd = 2 * x / n - s1 / times / n, math.sqrt(max(0.0, s2 - s1 * s1 / times) / (times - 1)) / n
    return mid - 1.959963984540054 * sd, mid + 1.959963984540054 * sd


def poisson_pmf(k, rate):
    k, rate = np.asarray(k, float), np.asarray(rate, float)
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        return np.where(rate > 0, np.exp(k * np.log(np.where(rate > 0, rate, 1)) - rate - lgamma(k + 1)), (k == 0).astype(float))


def prop_test_p(x, n, p, alternative: str = "two-sided"):
    """P-value of the one-sample proportion test with continuity correction; null (NaN) where x > n or p is no probability."""
    x, n, p = (np.asarray(v, float) for v in (x, n, p))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.abs(x - n * p)
        stat = (d - np.minimum(0.5, d)) ** 2 / (n * p * (1 - p))
        if alternative == "two-sided":
            out = erfc(np.sqrt(stat / 2))
        else:
            z = np.sign(x / n - p) * np.sqrt(stat)
            out = 0.5 * erfc(z / math.sqrt(2)) if alternative == "greater" else 0.5 * erfc(-z / math.sqrt(2))
        return np.where((n > 0) & (x >= 0) & (x <= n) & (p > 0) & (p < 1), out, np.nan)


def highest_density(pmf: np.ndarray, grid: np.ndarray, alpha: float = 0.05, clonal_from: int | None = None) -> tuple[float, float, float, float, float]:
    """(lower, estimate, upper, P(subclonal), P(clonal)) over a grid of candidates.

    If the smallest likelihood underflows to zero the last candidate counts as
    certain; the set is that of all candidates at least as likely as the one
    that completes 1 - alpha, and need not be contiguous.
    """
    x = pmf.copy()
    if not np.isfinite(x).all():
        return (np.nan,) * 5
    if x.min() == 0:
        x[-1] = 1.0
    share = x / x.sum()
    ordered = np.sort(share)[::-1]
    inside = share >= ordered[min(len(ordered) - 1, int((np.cumsum(ordered) < 1 - alpha).sum()))] * (1 - TIE)
    cut = clonal_from if clonal_from is not None else (len(grid) * 9) // 10
    chosen = grid[inside]
    return float(chosen[0]), float(chosen[np.argmax(x[inside] >= x[inside].max() * (1 - TIE))]), float(chosen[-1]), float(share[:cut].sum()), float(share[cut:].sum())


def highest_density_rows(pmf: np.ndarray, grid: np.ndarray, alpha: float = 0.05, clonal_from: int | None = None) -> np.ndarray:
    """:func:`highest_density` of every row of a matrix of likelihoods, as rows of five numbers."""
    x = pmf.copy()
    bad = ~np.isfinite(x).all(axis=1)
    x[bad] = 1.0
    x[x.min(axis=1) == 0, -1] = 1.0
    share = x / x.sum(axis=1, keepdims=True)
    ordered = np.sort(share, axis=1)[:, ::-1]
    last = np.minimum(len(grid) - 1, (np.cumsum(ordered, axis=1) < 1 - alpha).sum(axis=1))
    inside = share >= ordered[np.arange(len(x)), last][:, None] * (1 - TIE)
    cut = clonal_from if clonal_from is not None else (len(grid) * 9) // 10
    low, high = inside.argmax(axis=1), len(grid) - 1 - inside[:, ::-1].argmax(axis=1)
    best = (x >= np.where(inside, x, -np.inf).max(axis=1)[:, None] * (1 - TIE)).argmax(axis=1)
    out = np.stack([grid[low], grid[best], grid[high], share[:, :cut].sum(axis=1), share[:, cut:].sum(axis=1)], axis=1)
    out[bad] = np.nan
    return out


def hypergeometric_log_p(count, m, k, n: int, lf: LogFactorial):
    """(log probability, sign) of an overlap ``count`` of a set of m and one of k out of n.

    sign -1 and P(X <= count) if count <= m k / n, else +1 and P(X >= count);
    tails are summed in log space.
    """
    out = np.zeros(len(count))
    sign = np.where(count <= m / n * k, -1, 1)
    for i, (c, a, b) in enumerate(zip(count.tolist(), m.tolist(), k.tolist(), strict=True)):
        lo, hi = max(0, a + b - n), min(a, b)
        x = np.arange(lo, c + 1) if sign[i] < 0 else np.arange(c, hi + 1)
        if not len(x):
            out[i] = -np.inf
            continue
        log = lf.choose(a, x) + lf.choose(n - a, b - x) - lf.choose(n, b)
        top = log.max()
        out[i] = min(0.0, top + math.log(np.exp(log - top).sum()))
    return out, sign


def hypergeometric_tails(count: np.ndarray, m: int, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`hypergeometric_log_p` of many overlaps of one set of m and one of k out of n, from one table of its distribution."""
    lo, hi = max(0, m + k - n), min(m, k)
    x = np.arange(lo, hi + 1)
    term = lambda a, b: lgamma(a + 1.0) - lgamma(b + 1.0) - lgamma(a - b + 1.0)
    log = term(float(m), x) + term(float(n - m), k - x) - term(float(n), float(k))
    low, high = np.logaddexp.accumulate(log), np.logaddexp.accumulate(log[::-1])[::-1]
    sign = np.where(count <= m / n * k, -1, 1)
    at = np.clip(count - lo, 0, len(x) - 1)
    return np.minimum(0.0, np.where(sign < 0, low[at], high[at])), sign


def fisher_greater(a: int, b: int, c: int, d: int, level: float = 0.95) -> tuple[float, float, float, float]:
    """One-sided Fisher test of the table [[a, c], [b, d]]: (p, conditional odds ratio, lower bound, inf)."""
    m, n, k = a + b, c + d, a + c
    lo, hi = max(0, k - n), min(k, m)
    x = np.arange(lo, hi + 1)
    base = lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n + 1) - lgamma(k - x + 1) - lgamma(n - k + x + 1)

    def weights(log_or: float) -> np.ndarray:
        w = base + x * log_or
        w = np.exp(w - w.max())
        return w / w.sum()

    p = float(weights(0.0)[x >= a].sum())

    def solve(f, target: float) -> float:
        """Root of an increasing function of the log odds ratio."""
        left, right = -40.0, 40.0
        for _ in range(200):
            mid = (left + right) / 2
            if f(mid) < target:
                left = mid
            else:
                right = mid
        return math.exp((left + right) / 2)

    odds = 0.0 if a == lo else math.inf if a == hi else solve(lambda t: float((weights(t) * x).sum()), a)
    low = 0.0 if a == lo else solve(lambda t: float(weights(t)[x >= a].sum()), 1 - level)
    return min(1.0, p), odds, low, math.inf


def em_weights(signature: np.ndarray, parts: np.ndarray, start: np.ndarray, tol: float = 1e-5, max_iter: int = 1000) -> np.ndarray:
    """Mixture weights of ``parts`` (rows) that explain ``signature``; stops when the L1 change is below ``tol``."""
    alpha = start.copy()
    for _ in range(max_iter):
        mix = alpha @ parts
        with np.errstate(divide="ignore", invalid="ignore"):
            new = (np.where(mix > 0, signature / mix, 0.0)[None, :] * parts).sum(axis=1) * alpha
        new = new / new.sum() if new.sum() > 0 else alpha
        done = np.abs(new - alpha).sum() < tol
        alpha = new
        if done:
            break
    return alpha


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))


def nu_svr_linear(x: np.ndarray, y: np.ndarray, nu: float, c: float = 1.0, tol: float = 1e-4, max_iter: int = 20_000) -> np.ndarray:
    """Primal weights of a linear nu-support-vector regression.

    Dual: minimise 1/2 (a - a*)' K (a - a*) - y'(a - a*) with 0 <= a, a* <= c,
    sum(a - a*) = 0 and sum(a + a*) = c nu n: the usual scale, in which each
    multiplier is bounded by c.  Interior-point steps (predictor and
    corrector) solve one system of columns + 2 unknowns each, so a step takes
    time in proportion to the rows and their number hardly grows.  They end
    at a duality gap of 1e-8 tol a row, or where rounding stops them; a gap
    over tol is an error, never a result.
    """
    n, d = x.shape
    if n == 0 or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return np.zeros(n) @ x
    size = float(np.abs(y).max()) or 1.0
    v = np.column_stack([x, np.ones(n)])  # the last column is the intercept
    flip = np.array([[1.0], [-1.0]])
    z = np.full((2, n), c * nu / 2)  # a and a*: feasible
    w = np.zeros(d + 2)  # weights, intercept, half width of the tube
    grad = flip * -y
    s, t = np.maximum(grad, 0) + size, np.maximum(-grad, 0) + size  # multipliers of z >= 0 and z <= c
    system = np.empty((d + 2, d + 2))
    goal, gap, left, best, since = 1e-8 * tol * size * c * n, np.inf, w, np.inf, 0
    for _ in range(max_iter):
        u = c - z
        sz, tu = s * z, t * u
        gap = float(sz.sum() + tu.sum())
        wrong = grad - s + t
        miss = max(gap, float(np.abs(wrong).max()) * c * n)
        if miss < best:
            since = 0 if miss < 0.9 * best else since + 1
            best, left = miss, w
        else:
            since += 1
        if best <= goal or since >= 8:
            break
        over = np.array([*(v.T @ (z[0] - z[1])), z.sum() - c * nu * n])
        over[:d] -= w[:d]
        p = 1 / (s / z + t / u)
        both, apart = p[0] + p[1], p[0] - p[1]
        system[:-1, :-1] = v.T @ (v * both[:, None])
        system[:-1, -1] = system[-1, :-1] = apart @ v
        system[-1, -1] = both.sum()
        system[range(d), range(d)] += 1

        def step(near, far):
            r = near / z - far / u - wrong  # noqa: B023
            pr = p * r  # noqa: B023
            dw = np.linalg.solve(system, np.array([*(v.T @ (pr[0] - pr[1])), pr.sum()]) + over)  # noqa: B023
            dz = pr - p * (flip * (v @ dw[:-1]) + dw[-1])  # noqa: B023
            ds, dt = (near - s * dz) / z, (far + t * dz) / u  # noqa: B023
            most = max(float((-dz / z).max()), float((dz / u).max()), float((-ds / s).max()), float((-dt / t).max()))  # noqa: B023
            return dw, dz, ds, dt, 1 / most if most > 0 else np.inf

        try:
            _, dz, ds, dt, far = step(-sz, -tu)
            far = min(1.0, far)
            mean = gap / (4 * n)
            ahead = float(((s + far * ds) * (z + far * dz)).sum() + ((t + far * dt) * (u - far * dz)).sum()) / (4 * n)
            centre = (ahead / mean) ** 3 * mean
            dw, dz, ds, dt, far = step(centre - sz - ds * dz, centre - tu + dt * dz)
        except np.linalg.LinAlgError:
            break
        far = min(1.0, 0.995 * far)
        if not far > 0:
            break
        w, z, s, t = w + far * dw, z + far * dz, s + far * ds, t + far * dt
        grad = flip * (v @ w[:-1] - y) + w[-1]
    if not best <= tol * size * c * n:
        raise ArithmeticError(f"the nu-SVR of {n} rows ended at a duality gap of {best / n} a row")
    return left[:d]
