"""The map equation against its definition, enumeration and label propagation."""

import itertools
import math
import random

import pytest

from lociframe.operators.communities import map_equation
from lociframe.operators.nmf_consensus import label_propagation


def length(edges, label):
    """Bits of a step, from the definition."""
    total = 2 * sum(w for _, _, w in edges)
    strength: dict = {}
    leave: dict = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            strength[x] = strength.get(x, 0) + w / total
            if label[x] != label[y]:
                leave[label[x]] = leave.get(label[x], 0) + w / total
    h = lambda xs: -sum(x * math.log2(x) for x in xs if x > 0)
    q = sum(leave.values())
    out = h([x / q for x in leave.values()]) * q if q else 0
    for m in set(label.values()):
        rates = [leave.get(m, 0)] + [p for n, p in strength.items() if label[n] == m]
        s = sum(rates)
        out += s * h([r / s for r in rates])
    return out


def partitions(n):
    def grow(prefix, top):
        if len(prefix) == n:
            yield prefix
            return
        for k in range(top + 2):
            yield from grow([*prefix, k], max(top, k))

    yield from grow([], -1)


def found(spark, edges, small):
    d = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "a long, b long, w double")
    nodes, bits = map_equation(d, small=small)
    label = {r.node: r.module for r in nodes.collect()}
    assert bits == pytest.approx(length(edges, label), abs=1e-8)
    assert all(m == min(n for n in label if label[n] == m) for m in label.values())
    return label, bits


def small_graphs():
    clique = lambda xs, w=1: [(a, b, w) for a, b in itertools.combinations(xs, 2)]
    yield clique(range(4)) + clique(range(4, 8)) + [(3, 4, 1)]
    yield clique(range(3)) + clique(range(3, 6), 2) + [(2, 3, 0.5), (6, 0, 1), (6, 7, 3)]
    rng = random.Random(3)
    yield [(a, b, rng.randint(1, 5)) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.4]


@pytest.mark.parametrize("small,graphs", [(1000, 3), (0, 1)])
def test_exact_on_small_graphs(spark, small, graphs):
    for edges in itertools.islice(small_graphs(), graphs):
        nodes = sorted({x for a, b, _ in edges for x in (a, b)})
        best = min(length(edges, dict(zip(nodes, p, strict=True))) for p in partitions(len(nodes)))
        assert found(spark, edges, small)[1] == pytest.approx(best, abs=1e-8)


def test_no_longer_than_label_propagation(spark):
    rng = random.Random(8)
    edges = [(a, b, rng.randint(1, 3)) for a, b in itertools.combinations(range(18), 2) if rng.random() < (0.9 if a // 6 == b // 6 else 0.04)]
    label, bits = found(spark, edges, 1000)
    assert (label, pytest.approx(bits)) == found(spark, edges, 0)
    other = label_propagation([(f"{a:02d}", f"{b:02d}", w) for a, b, w in edges])
    assert bits <= length(edges, {int(k): v for k, v in other.items()}) + 1e-9
    assert all(label[n] == n // 6 * 6 for n in label)


def test_cases(spark):
    none = spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.0)], "a long, b long, w double")
    assert map_equation(none)[0].collect() == [] and map_equation(none.limit(0))[1] == 0
