"""Hand-computed and published values of the numerical kernels."""

import itertools
import math

import numpy as np
import pytest

from lociframe.functions import kernels as k
from lociframe.functions import phylo


@pytest.mark.parametrize(
    ("table", "p", "odds", "low"),
    [((164, 1023, 314 - 164, 6537 - 1023), 1.097903e-47, 5.890841, 4.819058), ((141, 861, 267 - 141, 5503 - 861), 6.539577e-42, 6.030437, 4.846212)],
)
def test_fisher(table, p, odds, low):
    got = k.fisher_greater(*table)
    assert got[0] == pytest.approx(p, rel=1e-5)
    assert got[1] == pytest.approx(odds, rel=1e-4)
    assert got[2] == pytest.approx(low, rel=1e-4)
    assert got[3] == math.inf


def test_fisher_edges():
    assert k.fisher_greater(0, 5, 0, 5)[0] == 1.0
    assert k.fisher_greater(3, 0, 0, 3)[1] == math.inf


def test_prop_test():
    # (|10 - 5| - .5)^2 / (10 * .25) = 8.1 with x = 10, n = 10, p = .5
    assert float(k.prop_test_p(10, 10, 0.5)) == pytest.approx(math.erfc(math.sqrt(8.1 / 2)))
    assert float(k.prop_test_p(5, 10, 0.5)) == pytest.approx(1.0)
    assert float(k.prop_test_p(2, 10, 0.5, "less")) == pytest.approx(1 - float(k.prop_test_p(2, 10, 0.5, "greater")))
    assert math.isnan(float(k.prop_test_p(11, 10, 0.5))) and math.isnan(float(k.prop_test_p(1, 10, 1.0)))


def test_hypergeometric_against_enumeration():
    n, lf = 12, k.LogFactorial(12)
    for m, kk in itertools.product((3, 5, 8), (2, 6, 9)):
        pmf = {c: math.comb(m, c) * math.comb(n - m, kk - c) / math.comb(n, kk) for c in range(max(0, m + kk - n), min(m, kk) + 1)}
        for c in pmf:
            log_p, sign = k.hypergeometric_log_p(np.array([c]), np.array([m]), np.array([kk]), n, lf)
            tail = sum(v for x, v in pmf.items() if (x <= c if sign[0] < 0 else x >= c))
            assert sign[0] == (-1 if c <= m * kk / n else 1)
            assert math.exp(log_p[0]) == pytest.approx(tail)


def test_highest_density_underflow_and_mass():
    grid = np.linspace(0.01, 1, 100)
    lower, est, upper, sub, clo = k.highest_density(k.binomial_pmf(50, 100, grid / 2), grid)
    assert est == pytest.approx(1.0) and lower < est <= upper and sub + clo == pytest.approx(1)
    pmf = np.zeros(100)
    pmf[10] = 0.5
    assert k.highest_density(pmf, grid)[4] > 0.6  # the last candidate counts as certain


def test_binomial_edges():
    assert k.binomial_pmf(0, 5, np.array([0.0]))[0] == 1
    assert k.binomial_pmf(5, 5, np.array([1.0]))[0] == 1


def test_amplified_search_counts_down():
    j, k = phylo.amplified_grid(3, 0)
    assert list(zip(j, k, strict=True)) == [(1, 0), (2, 1), (2, 0), (3, 2), (3, 1), (3, 0)]
    one = lambda x: np.array([x], float)
    assert phylo.best_amplified(one(3.0), one(30), [(one(3), one(0), one(1.0), one(0.0))], False) == (3.0, 3.0)
    assert phylo.best_amplified(one(1.5), one(30), [(one(0), one(0), one(1.0), one(0.0))], False) == (1.0, 1.0)


def test_em_recovers_mixture():
    parts = np.array([[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]])
    w = k.em_weights(np.array([0.3, 0.7]) @ parts, parts, np.array([0.5, 0.5]), 1e-12, 5000)
    assert w == pytest.approx([0.3, 0.7], abs=1e-4)


def test_nu_svr_is_optimal_and_recovers_weights():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 3))
    true = np.array([0.6, 0.3, 0.1])
    w = k.nu_svr_linear(x, x @ true, 0.5, tol=1e-6)
    assert w == pytest.approx(true, abs=0.05)
