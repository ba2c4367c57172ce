"""Average linkage against one merge at a time."""

import random

import pytest

from lociframe.operators.linkage import average_linkage


def one_by_one(n, sim):
    """({(a, b): (height, size)}, order): always the best pair of all, smaller numbers first; numbers from 1."""
    get = lambda a, b: sim.get((min(a, b), max(a, b)), 0.0)
    weight = {i: sum(get(i, j) for j in range(1, n + 1)) for i in range(1, n + 1)}
    own = {i: [i] for i in range(1, n + 1)}  # leaves in order
    merges = {}
    while len(own) > 1:
        mean = {(a, b): sum(get(x, y) for x in own[a] for y in own[b]) / len(own[a]) / len(own[b]) for a in own for b in own if a < b}
        a, b = min(mean, key=lambda p: (-round(mean[p], 11), p))
        merges[a, b] = (1 - mean[a, b], len(own[a]) + len(own[b]))
        left, right = (own[a], own[b]) if sum(weight[i] for i in own[a]) <= sum(weight[i] for i in own[b]) + 1e-11 else (own[b], own[a])
        own[a] = left + right
        del own[b]
    return merges, next(iter(own.values()))


@pytest.mark.parametrize("seed,share,small", [(2, 0.3, 0), (3, 0.08, 0), (2, 0.3, 100), (3, 0.08, 100), (1, 0.9, 100)])
def test_average_linkage(spark, seed, share, small):
    rng = random.Random(seed)
    n = 13
    sim = {(i, j): rng.random() for i in range(1, n + 1) for j in range(i, n + 1) if rng.random() < share or i == j}
    names = [f"p{i:02d}" for i in range(1, n + 1)]
    rows = [(names[a - 1], names[b - 1], s) if rng.random() < 0.5 else (names[b - 1], names[a - 1], s) for (a, b), s in sim.items()]
    rows += [(b, a, s) for a, b, s in rows[:5]]  # both ways
    similar = spark.createDataFrame(rows, "left string, right string, similarity double")
    merges, leaves = average_linkage(similar, spark.createDataFrame([(x,) for x in names], "item string"), small=small)
    want, order = one_by_one(n, sim)
    got = {(r.left_node, r.right_node): (r.height, r.size) for r in merges.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    leaf = sorted(leaves.collect(), key=lambda r: r.place)
    assert [r.place for r in leaf] == list(range(n)) and [r.number for r in leaf] == order
    assert all(r.weight == pytest.approx(sum(sim.get((min(r.number, j), max(r.number, j)), 0.0) for j in range(1, n + 1)) / n, abs=1e-9) for r in leaf)


def test_average_linkage_cases(spark):
    none = spark.createDataFrame([], "left string, right string, similarity double")
    assert [t.collect() for t in average_linkage(none, spark.createDataFrame([], "item string"))] == [[], []]
    merges, leaves = average_linkage(none, spark.createDataFrame([("b",), ("a",), ("a",)], "item string"))
    assert [tuple(r) for r in merges.collect()] == [(1, 2, 1.0, 2)]
    assert sorted((r.item, r.place) for r in leaves.collect()) == [("a", 0), ("b", 1)]
