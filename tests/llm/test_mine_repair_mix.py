"""Hard negatives, conversation repair and mixing against brute force and their stated cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import hardneg, mixing, repair

# -- repair ------------------------------------------------------------------------------


def cheapest(signature):
    """All edit sequences with up to three inserts in each gap, by definition."""
    best = None
    options = [["D"] if c == "-" else ["K", "R", "D"] for c in signature]
    gaps = range(4) if len(signature) < 3 else range(3)
    for letters in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(signature) + 1):
            roles, cost, audit = "", 0, ""
            ok = True
            for i in range(len(signature) + 1):
                for _ in range(inserts[i]):
                    roles += "?"
                    audit += "I"
                    cost += 3
                if i == len(signature):
                    break
                c, x = signature[i], letters[i]
                audit += x
                cost += {"K": 0, "R": 3, "D": 4}[x] + (3 if c.isupper() and x != "D" else 0)
                roles += {"K": c.lower(), "R": "?", "D": ""}[x]
            ok = any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in fillings(roles))
            if ok and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def fillings(roles):
    """Rerole and insert make user or assistant: at most one filling alternates, but try both starts."""
    for start in "ua":
        out, want = "", start
        for r in roles:
            if r == "?":
                out += want
            else:
                out += r
            if out[-1] in "ua":
                want = "a" if out[-1] == "u" else "u"
        yield out


def test_solve_equals_every_edit():
    rng = random.Random(5)
    seen = {"", "-", "s", "S", "x", "ss", "su", "au", "a--u", "sxA"} | {"".join(rng.choice("suaxSUAX--") for _ in range(rng.randint(1, 4))) for _ in range(60)}
    for sig in sorted(seen):
        (got,) = repair.solve(sig, True)
        assert got[2:] == cheapest(sig), sig


def test_chained_blocks_equal_the_whole():
    rng = random.Random(6)
    for _ in range(60):
        sig = "".join(rng.choice("suaxSUAX-uaua") for _ in range(rng.randint(4, 24)))
        n = rng.randint(1, 5)
        blocks = [sig[i : i + n] for i in range(0, len(sig), n)]
        assert repair.chain(repair.solve(b, False) for b in blocks) == repair.solve(sig, True)[0][2:], (sig, n)


def by_hand(rows):
    """{conv_id: (counts, repaired lines)} of undamaged rows, by plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        code, seen, counts = "", set(), [0, 0, 0, 0]
        for i, (_, role, text) in enumerate(own):
            trimmed = text.strip(" \t\n\x0b\x0c\r")
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not trimmed:
                counts[0] += 1
                c = "-"
            elif (role, text) in seen:
                counts[1] += 1
                c = "-"
            elif trimmed[-1] not in ".!?":
                counts[2] += 1
                c = c.upper()
            seen.add((role, text))
            code += c
            counts[3] += i > 0 and own[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = repair.solve(code, True)[0][2:]
        lines, i, last = [], 0, ""
        for x in audit:
            role, text = ("", "") if x == "I" else own[i][1:]
            i += x != "I"
            if x == "D":
                continue
            role = role if x == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        out[conv] = ((gaps, *counts, cost, audit), lines)
    return out


@pytest.mark.parametrize("block", [128, 2])
def test_repair_small_cases(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    long = "word " * 50_000 + "end."
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 1, "user", "Hi"), (1, 4, "assistant", long),
        (2, None, "user", "Late?"), (2, None, None, None), (2, None, "", "x."),
        (3, 5, "assistant", ""), (3, 5, "assistant", " \t\n"),
        (None, 1, "user", "No id."), (None, 2, "assistant", "Fine!  \n"),
        (4, -3, "user", "a."), (4, 7, "Übersetzer", "Grüße。"), (4, 7, "tool", "ok."), (4, 8, "user", "b?"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit("x"), "audit": F.lit(1), "dropped": F.lit(False)})
    want = by_hand(rows)
    got = {r.conv_id: r for r in repair.repair(turns.repartition(5)).collect()}
    assert got.keys() == want.keys()
    for c, (counts, lines) in want.items():
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == counts
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    again = repair.replay(turns, repair.audit(turns)).collect()
    for c, (_, lines) in want.items():
        own = sorted((r for r in again if r.conv_id == c), key=lambda r: r.place)
        assert [f"{r.role}:{r.text}" for r in own] == lines and [r.place for r in own] == list(range(len(lines)))


def test_repair_dropped_empty_and_invalid_text(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi.", True), (2, 0, "user", "Hi.", None)], "conv_id long, turn long, role string, text string, gone boolean")
    got = {r.conv_id: r for r in repair.repair(turns, "gone").collect()}
    assert got[1].audit == "" and got[1].repaired_sha256 == hashlib.sha256(b"").hexdigest() and got[1].cost == 0
    assert got[2].audit == "KI" and got[2].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()
    assert repair.repair(turns.limit(0), "gone").collect() == []
    bad = spark.sql("select 1L conv_id, 1L turn, 'user' role, cast(X'48FF2E' as string) text")
    assert repair.repair(bad).first().repaired_sha256 == hashlib.sha256(b"user:H\xff.\nassistant:").hexdigest()
    assert [r.text for r in repair.replay(bad, repair.audit(bad)).collect()] == ["H�.", ""]


def test_damage_marks(spark):
    import zlib

    turns = spark.createDataFrame([(c, t, "assistant", "A. B!") for c in range(30) for t in range(4)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {}
    for r in repair.damage(turns).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.dropped))
    for (c, t), rows in got.items():
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" ", " ") if c is None else ("assistant", "A. B!")
        one = ("user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text, k == 0)
        assert rows == [one] * (2 if k == 3 else 1)


# -- mixing ------------------------------------------------------------------------------


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, None: 90, "B": 0}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
    order = ["B", "a", "b", "c", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:  # by the definition, in rounds
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in order if s not in fixed)
        over = {s: 3 * sizes[s] for s in order if s not in fixed and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    for s in order:
        assert got[s].weight == weight[s] and got[s].target == pytest.approx(fixed.get(s, level * weight[s]))


def corpus(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([1, 3, 40, 200]), rng.choice(["hot"] * 6 + ["x", "y", "é", None])) for i in range(n)]
    rows += [(n, None, "x"), (n + 1, "", None), (None, "w w", "y"), (7, "w w w", "z"), (7, "w w w", "z"), (n + 2, " \t", "empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "shards": F.lit(1), "target": F.lit(0)})


def test_mix_meets_targets_and_agrees(spark):
    docs = corpus(spark)
    got = mixing.mix(docs, shard_words=500).toPandas()
    assert len(got) == docs.count()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["size"] * got["shards"].map(len)).all()
    sums = got.groupby("source", dropna=False).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums["own"]).all() and sums["target"].sum() == pytest.approx(got["size"].sum())
    assert ((sums["taken"] - sums["target"]).abs() <= 100).all()  # half the longest document
    again = mixing.mix(docs.repartition(11), shard_words=500).toPandas()
    key = ["doc_id", "size", "source", "taken"]
    same = lambda d: sorted(map(str, d[key].itertuples(index=False)))
    assert same(got) == same(again)


def test_mix_lays_out_every_take_once(spark):
    mixed = mixing.mix(corpus(spark), shard_words=500).persist()
    rows = mixing.lay_out(mixed).collect()
    want = sorted((str(r.doc_id), s) for r in mixed.collect() for s in r.shards)
    assert sorted((str(r.doc_id), r.shard) for r in rows) == want
    for s in {r.shard for r in rows}:
        assert sorted(r.place for r in rows if r.shard == s) == list(range(1, sum(r.shard == s for r in rows) + 1))
    mixed.unpersist()


def test_choose_comes_near():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 30, 700]) + rng.randrange(50) for _ in range(rng.randint(1, 12))]
        room = rng.random() * sum(sizes)
        whole = [k for k, v in mixing.choose(list(enumerate(sizes)), room).items() if v < 0]
        best = min(abs(room - sum(c)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n))
        off = abs(room - sum(sizes[k] for k in whole))
        assert off <= best + max(sizes) / 2 and off <= max(room, min(sizes))
        # no single block taken, given back or exchanged comes nearer
        for g in [*whole, None]:
            for t in [*(set(range(len(sizes))) - set(whole)), None]:
                now = sum(sizes[k] for k in whole) - (sizes[g] if g is not None else 0) + (sizes[t] if t is not None else 0)
                assert abs(room - now) >= off - 1e-9


def test_split_is_exact_and_hypergeometric():
    quota = np.array([700, 0, 250, 50])
    for shards in (1, 2, 7, 16):
        counts = mixing.split(quota, shards, (0,), 1)
        assert (counts.sum(axis=1) == quota).all() and counts.sum(axis=0).max() - counts.sum(axis=0).min() <= 1 + np.log2(shards)
    draws = np.array([mixing.split(quota, 2, (i,), 1)[:, 0] for i in range(2000)])
    assert np.allclose(draws.mean(axis=0), quota / 2, atol=1)
    assert draws[:, 0].var() == pytest.approx(700 * 300 / 1000**2 * 500 * 500 / 999, rel=0.15)


def test_mix_empty_and_wordless(spark):
    docs = corpus(spark)
    assert mixing.mix(docs.limit(0)).collect() == []
    none = mixing.mix(docs.select("doc_id", F.lit(None).cast("string").alias("text"), "source")).collect()
    assert len(none) == docs.count() and all(r.taken == 0 and r.target == 0 for r in none)


# -- hard negatives ----------------------------------------------------------------------


def mined(rows, is_anchor, positives=5, negatives=3):
    seen = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(x))) for x in v]
        if sum(x * x for x in q) < 2**62:
            seen[i] = min(seen.get(i, (str(label), q)), (str(label), q))
    out = []
    for a, (la, qa) in seen.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, lb == la) for i, (lb, q) in seen.items() if i != a and len(q) == len(qa))
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            hits = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a, pid, k + 1, n[1], -p, -n[0]) for k, n in enumerate(hits)]
    return sorted(out)


def run_mine(spark, rows, monkeypatch, **options):
    monkeypatch.setattr(hardneg, "PACK", 16)
    monkeypatch.setattr(hardneg, "TILE", 4)
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"q": F.lit(1), "block": F.lit(2), "bands": F.lit("x")})
    got = hardneg.mine(d.repartition(3), F.col("vec_id") % 5 == 0, block_rows=7, runs=3, **options)
    return sorted(tuple(r) for r in got.collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 12))
    rows = []
    for i in range(230):
        k = int(rng.integers(4))
        rows.append((i, k if rng.random() < 0.7 else int(rng.integers(4)), (centres[k] + rng.normal(size=12) * 0.6).tolist()))
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(40)]  # ties
    got = run_mine(spark, rows, monkeypatch)
    assert got == mined(rows, lambda i: i % 5 == 0) and len(got) > 100


def test_hard_negative_cases(spark, monkeypatch):
    big = 2.0**22
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.7, 0.4]), (3, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (4, 1, None),
        (6, 1, [float("nan"), 1.0]), (7, 1, [1.0, None]), (8, 2, [float("inf"), 0.0]), (9, 2, [1e300, 0.0]),
        (5, 1, [1.0]), (11, 1, [2.0]), (12, 2, [1.5]), (10, 3, []), (13, 3, []), (14, 4, []),
        (15, 5, [big, big]), (16, 5, [big, big - 1]), (17, 6, [big * 0.9, big * 0.9]), (2, 2, [0.7, 0.4]), (1, 9, [9.0, 9.0]),
        (20, 7, [-1.0, -1.0]), (21, 7, [1.0, 1.0]),
    ]
    assert run_mine(spark, rows, monkeypatch) == mined(rows, lambda i: i % 5 == 0)
    assert run_mine(spark, [r for r in rows if r[0] is None], monkeypatch) == []


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(4)
    q = rng.integers(-(2**20), 2**20, size=(60, 16)).astype(np.int32)
    axes = hardneg.rotation(q.astype(float))
    assert np.allclose(axes @ axes.T, np.eye(16))
    stages = hardneg.stages_of(16)
    a = hardneg.Rotated(q, axes, stages)
    exact = q.astype(object) @ q.astype(object).T

    def maybe(lower, upper, ai, ci):
        true = exact.astype(float) if ai is None else exact[ai, ci].astype(float)
        assert (lower <= true).all() and (true <= upper).all()
        return np.ones_like(lower, bool)

    ai, ci = hardneg.survivors(a, a, stages, maybe)
    assert len(ai) == 3600 and (hardneg.products(q, q, ai, ci) == exact[ai, ci].astype(np.int64)).all()
