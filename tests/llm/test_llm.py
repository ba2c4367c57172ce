"""Tests of the corpus operators: brute force, exact round trips, held-out accuracy, edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lociframe.llm import ann, bpe, chatformat, decontam, htmltext, simhash, tokencount, toxicity, urlrules, warc
from lociframe.llm._util import durable
from lociframe.llm.components import connected_components

DOCS = "doc_id long, text string"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}x" for _ in range(n)]


# -- SimHash ---------------------------------------------------------------------


def plain_fingerprint(text, size=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < size else [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, near):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = words(rng, rng.choice([2, 5, 40, 300]))
        out.append(" ".join(w))
        if k % 3 == 0:
            w = w[:]
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out + ["", None, "  \n", "ABC def", "abc DEF", out[0]]


def test_fingerprint_equals_definition():
    for t in [*near_copies(), "ÄB c d", "a\x0bb\x1cc d\u00a0e f"]:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)
    long = " ".join(words(random.Random(3), 3000))
    assert simhash.fingerprint(long.encode(), block=100) == plain_fingerprint(long)


def test_near_duplicates_against_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(i * 3, t, i) for i, t in enumerate(texts)], DOCS + ", component_id long").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i * 3: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp and all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == groups(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)


@pytest.mark.parametrize("crowd", [0, 2, 1000])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_crowded_or_not(spark, crowd, distance):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    comp = {r.node: r.component for r in connected_components(simhash.links(fps, distance, crowd)).collect()}
    want = groups(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
    assert {v: comp.get(v, v) for v in signed} == want


def test_near_duplicates_edges(spark):
    empty = simhash.near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (7, None)], DOCS)
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (7, 7)]


def test_deduplicate_keeps_smallest_of_similar(spark):
    rng = random.Random(9)
    base = words(rng, 200)
    near = base[:]
    near[17] = "other"
    far = words(rng, 200)
    docs = spark.createDataFrame([(5, " ".join(base), "x"), (3, " ".join(near), "x"), (9, " ".join(far), "x"), (9, " ".join(far), "x"), (None, "q", "x"), (11, "", "x"), (12, None, "x")], DOCS + ", lang string")
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 3, 9, 11]


def test_similar_groups_find_what_brute_force_finds(spark):
    rng = random.Random(11)
    docs, n = [], 0
    for _ in range(25):
        w = words(rng, 150, 5000)
        docs.append((n, " ".join(w)))
        for _ in range(rng.randrange(3)):
            v = w[:]
            v[rng.randrange(150)] = f"new{n}"
            n += 1
            docs.append((n, " ".join(v)))
        n += 1
    sets = {i: plain_shingles(t) for i, t in docs}
    want = groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(docs, DOCS)).collect()}
    wrong = [i for i in got if got[i] != want[i]]
    assert len(wrong) <= 1  # fingerprints far apart may be missed; nothing else is joined
    assert all(want[got[i]] == want[i] for i in got)


def plain_shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w)} if len(w) < size else set(zip(*(w[i:] for i in range(size)), strict=False))


def wide(text):
    return [x & (2**64 - 1) for x in simhash.wide_fingerprint(simhash._word_hashes(text.encode()))]


def by_rule(docs, similar, within=28):
    """Groups of texts whose fingerprints share a one-wildcard segment, lie within ``within`` bits and that are similar."""
    fps = {i: wide(t) for i, t in docs}

    def near(a, b):
        x = [p ^ q for p, q in zip(fps[a], fps[b], strict=True)]
        return sum(y.bit_count() for y in x) <= within and any(((y >> lo) & ((1 << hi - lo) - 1)).bit_count() <= 1 for y in x for lo, hi in simhash._CUTS) and similar(a, b)

    return groups([i for i, _ in docs], near)


def test_crowded_segments_lose_no_pair(spark):
    rng = random.Random(5)
    base = words(rng, 300, 5000)
    docs = [(0, " ".join(base))]
    for n in range(1, 401):  # similar to the base, hardly any to each other
        w = base[:]
        for at in rng.sample(range(300), 6):
            w[at] = f"new{n}x{at}"
        docs.append((n, " ".join(w)))
    sets = {i: plain_shingles(t) for i, t in docs}
    want = by_rule(docs, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    frame = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()}
    assert got == want
    fps = sorted({tuple(simhash.wide_fingerprint(simhash._word_hashes(t.encode()))) for _, t in docs})
    nodes = spark.createDataFrame([(k, *f) for k, f in enumerate(fps)], "node long, f0 long, f1 long")
    every, none = simhash.candidate_pairs(nodes, crowd=10**6)
    _, members = simhash.candidate_pairs(nodes)
    alone = spark.createDataFrame([], "node long, component long")
    uncrowded, _ = simhash.candidate_pairs(nodes)
    got = {tuple(r) for r in uncrowded.union(simhash.rest_pairs(simhash.open_members(members, alone), block=16)).collect()}
    assert none is None and got == {tuple(r) for r in every.collect()}  # blocks list every pair


@pytest.mark.parametrize("crowd,broadcast_rows", [(10**6, 10**6), (3, 10**6), (3, 0)])
def test_candidate_pairs_by_route_against_brute_force(spark, crowd, broadcast_rows):
    rng = random.Random(1)
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    fps = set()
    for size in [1, 2, 40] * 8:  # clusters of fingerprints up to nine flips from their base
        base = [rng.getrandbits(64) for _ in range(2)]
        for _ in range(size):
            f = base[:]
            for _ in range(rng.randrange(10)):
                f[rng.randrange(2)] ^= 1 << rng.randrange(64)
            fps.add(tuple(map(signed, f)))
    rows = [(n, *f) for n, f in enumerate(sorted(fps))]

    def near(a, b):
        x = [(p ^ q) & (2**64 - 1) for p, q in zip(a, b, strict=True)]
        return sum(y.bit_count() for y in x) <= 28 and any(((y >> lo) & ((1 << hi - lo) - 1)).bit_count() <= 1 for y in x for lo, hi in simhash._CUTS)

    want = {(u, v) for u, *a in rows for v, *b in rows[:u] if near(a, b)}
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    pairs, members = simhash.candidate_pairs(spark.createDataFrame(rows, "node long, f0 long, f1 long"), crowd=crowd, broadcast_rows=broadcast_rows)
    if members is not None:
        alone = spark.createDataFrame([], "node long, component long")
        pairs = pairs.union(simhash.rest_pairs(simhash.open_members(members, alone), block=16))
    assert (members is None) == (crowd > 3)
    assert {tuple(r) for r in pairs.collect()} == want
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


def test_similar_pairs_are_found_in_every_band(spark):
    rng = random.Random(21)
    docs, pairs, n = [], [], 0
    for _ in range(500):
        w = words(rng, 240, 4000)
        v = w[:]
        for at in sorted(rng.sample(range(240), rng.randrange(1, 6))):
            v[at] = f"new{n}x{at}"
        docs += [(n, " ".join(w)), (n + 1, " ".join(v))]
        a, b = plain_shingles(docs[-2][1]), plain_shingles(docs[-1][1])
        pairs.append((n, n + 1, len(a & b) / len(a | b)))
        n += 2
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(docs, DOCS)).collect()}
    for low in (0.8, 0.85, 0.9, 0.95):
        band = [(a, b) for a, b, j in pairs if low <= j < low + 0.05]
        assert len(band) > 50 and np.mean([got[a] == got[b] for a, b in band]) >= 0.9
    assert not any(got[a] == got[b] for a, b, j in pairs if j < 0.8)


def test_equal_fingerprints_are_compared(spark):
    rng = random.Random(3)
    line = words(rng, 5, 5000) * 60  # decides every bit
    docs = []
    for n in range(40):  # over 16 texts of one fingerprint
        own = [f"own{n}x{k}" for k in range(50)]
        docs.append((n, " ".join(line + own)))
        if n % 4 == 0:
            docs.append((100 + n, " ".join(line + own[:-1] + ["other"])))
    assert len({tuple(wide(t)) for _, t in docs}) == 1
    docs += [(None, docs[0][1]), (7, "a text of its own under an id that is taken")]
    got = simhash.similar_groups(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((i, i % 100) for i, _ in docs if i is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [0]
    # a text without an id links two others
    own = [f"own{k}" for k in range(50)]
    one = own[:20] + ["x"] + own[21:]
    two = one[:35] + ["y"] + one[36:]
    chain = [(1, " ".join(line + own)), (None, " ".join(line + one)), (2, " ".join(line + two))]
    sets = [plain_shingles(t) for _, t in chain]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(chain, DOCS)).collect()}
    assert got == {1: 1, None: 1, 2: 1}


def test_only_sets_of_texts_that_may_be_similar_are_written(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(n, " ".join(words(rng, 120, 4000))) for n in range(200)]
    near = docs[20][1].split()
    near[50] = "other"
    docs += [(300, " ".join(near)), (301, docs[20][1]), (None, " ".join(near)), (300, " ".join(near))]
    tables = []

    def written(df, name):
        out = durable(df, name)
        tables.append((name, out.count(), [t for _, t in df.dtypes if t.startswith("array")]))
        return out

    monkeypatch.setattr(simhash, "durable", written)
    got = simhash.similar_groups(spark.createDataFrame(docs, DOCS).repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == sorted([(n, n) for n in range(200) if n] + [(-1, 0), (-1, 20), (300, 20), (300, 20), (301, 20)])
    assert sum(n for _, n, arrays in tables if arrays) <= 4  # sets of two texts, a repeated row's twice at most
    monkeypatch.setattr(simhash, "shingle_sets", lambda docs, wanted, *_: wanted.selectExpr("row", "array(row) hashes").limit(1))
    with pytest.raises(RuntimeError, match="changed"):
        simhash.similar_groups(spark.createDataFrame(docs, DOCS))


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_sets_are_read_again_exactly(spark, broadcast_rows):
    rng = random.Random(4)
    docs = [(n, " ".join(words(rng, n))) for n in range(60)] + [(None, "q r s"), (70, None), (71, ""), (72, "A b C d E f")]
    frame = spark.createDataFrame(docs * 2, DOCS).repartition(3)  # every row twice
    sig = simhash.signatures(frame).groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"))
    wanted = durable(sig.where("doc_id is null or doc_id % 3 = 1 or doc_id >= 70").select(F.coalesce("doc_id", F.lit(-1)).alias("row"), "source", "digest", "size"), "wanted")
    got = simhash.shingle_sets(frame, wanted.drop("size"), broadcast_rows=broadcast_rows).collect()
    text = {-1 if i is None else i: t for i, t in docs}
    assert {r.row for r in got} == {i for i in text if i < 0 or i % 3 == 1 or i >= 70}
    size = {r.row: r["size"] for r in wanted.collect()}
    for r in got:
        assert r.hashes == simhash.shingle_hashes((text[r.row] or "").encode(), 5).view(np.int64).tolist() and len(r.hashes) == size[r.row]


@pytest.mark.parametrize("most", [1 << 29, 1 << 16])
def test_among_keeps_all_wanted_and_few_others(spark, most):
    rng = random.Random(6)
    every = [rng.randrange(-(2**63), 2**63) for _ in range(9000)] + [0, -1, 2**63 - 1, -(2**63)]
    want = set(every[::4] + every[-4:])
    rows = spark.createDataFrame([(n, h) for n, h in enumerate(every)] + [(-1, None)], "n long, h long")
    wanted = spark.createDataFrame([(h,) for h in sorted(want)], "h long")
    got = simhash.among(rows, wanted, most=most)
    assert got.columns == ["n", "h"] and "Exchange hashpartitioning(h" not in got._jdf.queryExecution().toString()
    kept = [r.h for r in got.collect()]
    assert want <= set(kept) and None not in kept and len(kept) <= len(want) + 0.06 * len(every)
    assert simhash.among(rows, wanted.limit(0)).count() == 0


# -- toxicity ----------------------------------------------------------------------


def toxic_corpus(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 4 == 0
        w = words(rng, rng.choice([8, 60]), 300)
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), "grumf" + rng.choice(["ling", "let", "ish", "er", "oid", "ard"]))
        out.append((" ".join(w), int(bad)))
    return out


def test_toxicity_generalises_to_unseen_forms():
    seen, new = toxic_corpus(1), toxic_corpus(2)
    m = toxicity.train([t for t, _ in seen], [y for _, y in seen])
    new = [(t.replace("grumflet", "grumfzzz"), y) for t, y in new]
    p = [m.margin(m.logits(toxicity.words_of(t))) > -0.85 for t, _ in new]
    assert np.mean([a == bool(y) for a, (_, y) in zip(p, new, strict=True)]) > 0.95


def test_toxicity_query_shape_and_edges(spark):
    data = toxic_corpus(1)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(data)] + [(9000, None, "x"), (9001, "", "x"), (9002, "z" * 5000, "x")], DOCS + ", toxicity string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(0, None), (77777, 1)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, m).collect()}
    assert len(got) == len(data) + 3 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, (_, y) in enumerate(data)]) > 0.95
    assert got[9000] == got[9001] < 0.3
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs.limit(0), none).count() == 0


def plain_margin(m, text):
    """The model's margin by its definition: vectors averaged step by step, then the linear softmax."""
    vectors = []
    for w in toxicity.words_of(text):
        ids, _ = toxicity.subwords([w], m.sizes, len(m.embeddings))
        vectors.append(np.mean([m.embeddings[i].astype(float) for i in ids], axis=0))
    if not vectors:
        return float(m.bias[1] - m.bias[0])
    k = min(m.window, len(vectors))
    windows = [np.mean(vectors[i : i + k], axis=0) for i in range(len(vectors) - k + 1)]
    own = [float(v @ m.softmax[:, 1] - v @ m.softmax[:, 0]) for v in windows]
    a = np.exp(m.sharp * (np.array(own) - max(own)))
    mean = (a[:, None] * np.array(windows)).sum(0) / a.sum()
    logits = mean @ m.softmax + m.bias
    return float(logits[1] - logits[0])


def test_toxicity_scores_against_plain(spark):
    data = toxic_corpus(1)
    m = toxicity.train([t for t, _ in data], [y for _, y in data], epochs=20)
    texts = [data[0][0], data[1][0], "", None, "grumfling", "a b", "x" * 200 + " grumfoid"]
    got = {r.doc_id: r.toxicity for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), DOCS), m).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-plain_margin(m, t))), abs=1e-5)


def test_toxicity_gradient_lowers_loss():
    data = toxic_corpus(1, 120)
    loss = []
    for epochs in (1, 10, 40):
        m = toxicity.train([t for t, _ in data], [y for _, y in data], epochs=epochs)
        p = [1 / (1 + np.exp(-m.margin(m.logits(toxicity.words_of(t))))) for t, _ in data]
        loss.append(-np.mean([np.log(max(q if y else 1 - q, 1e-9)) for q, (_, y) in zip(p, data, strict=True)]))
    assert loss[0] > loss[1] > loss[2]


def test_toxicity_sample_is_bounded_and_whole(spark):
    rows = [(i, ("w " * (5 if i % 7 else 4000)).strip()) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, F.lit(True), max_rows=20, max_chars=1000)
    whole = dict(rows)
    assert all(whole[i] == t for i, t in zip(got.doc_id, got.text, strict=True))
    assert all(0 < got[got.y == c].text.str.len().sum() <= 1000 and len(got[got.y == c]) > 10 for c in (0, 1))  # long ones are skipped
    only = toxicity.labelled_sample(docs.where("doc_id % 7 = 0"), labels, F.lit(True), max_rows=20, max_chars=1000)
    assert sorted(only.y) == [0, 1]  # the shortest of each class


# -- WARC --------------------------------------------------------------------------


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    rng = random.Random(4)
    html = [None, "", "short", "x" * 100, "é" * 60, "WARC/1.1\r\n\r\n" * 20, *["page " + " ".join(words(rng, 400)) for _ in range(12)]]
    html += [html[7], html[7], "x" * 100, "short"]
    pages = spark.createDataFrame([(i, f"http://a/{i}\n" if i % 2 else None, h, 1) for i, h in enumerate(html)] + [(None, "u", html[7], 1)], "page_id long, url string, html string, payload int").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.archive(pages, path, compression)
    back = warc.read(spark, path)
    got = {r.record_id: r for r in back.collect()}
    assert len(got) == len(html) + 1
    first = {}
    for i, h in enumerate(html):
        r, data = got[f"<urn:page:{i}>"], (h or "").encode()
        dup = len(data) >= 100 and data in first
        first.setdefault(data, i)
        assert r.record_type == ("revisit" if dup else "response")
        assert r.refers_to == (f"<urn:page:{first[data]}>" if dup else None)
        assert r.payload_digest == hashlib.sha256(data).hexdigest() and r.payload_length == len(data)
        assert (r.payload or b"") == (b"" if dup else data)
    assert got["<urn:page:null>"].record_type == "revisit"
    only = warc.read(spark, path, payloads="none").where("record_type = 'revisit'")
    assert only.count() == sum(r.record_type == "revisit" for r in got.values()) and only.where("payload is not null").count() == 0
    assert back.where(F.col("record_id").isin("<urn:page:2>", "<urn:page:3>")).count() == 2
    assert back.where("payload_length > 1000").count() == sum(r.payload_length > 1000 for r in got.values())


def test_warc_pushes_filters_and_skips(spark, tmp_path):
    r = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(r.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and r._holds({"warc-type": "response"}) and not r._holds({"warc-type": "revisit"})
    import io

    recs = [warc.build_record({"record_id": f"<r{i}>", "record_type": "response", "payload": b"z" * 50_000}, "d") for i in range(3)]

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.total += len(out)
            return out

    for pack, reader in ((lambda x: x, warc.plain_records), (warc.gzip_member, warc.gzip_records)):
        data = b"".join(map(pack, recs))
        Counting.total = 0
        assert [h["warc-record-id"] for h, p in reader(Counting(data), lambda h: True, lambda h: False, len(data)) if p is None] == ["<r0>", "<r1>", "<r2>"]
        assert Counting.total < 60_000
    import gzip

    plain = gzip.compress(recs[0]) + gzip.compress(recs[1])  # members that do not state their length
    assert [len(p) for _, p in warc.gzip_records(io.BytesIO(plain), lambda h: True, lambda h: True, len(plain))] == [50_000, 50_000]
    assert gzip.decompress(warc.gzip_member(recs[0])) == recs[0]


def test_warc_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


# -- URL rules -----------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.c", "", "block"), ("b.c", "/x", "allow"), ("a.b.c", "/", "allow"), ("a.com", "/a/b", "block"), ("b.a.com", "/a", "allow"), (None, "/", "block")]


def plain_judge(url):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for h, p, v in RULES:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h + p), len(h)) > best[0]):
            best = ((len(h + p), len(h)), h + p, v)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("limit", [1000, 2])
def test_urls_against_brute_force(spark, limit):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "xexample.com", "WWW.Example.COM", "q.net", "net", "b.c", "a.b.c", "z.a.b.c", "c", "", "com.", "a..com", "example.com:80", "b.a.com", "x.b.a.com", "a.com"]
    paths = ["", "/", "/en/", "/en", "/en/x?y=/es/", "/es/1#t", "/x", "?a", "#b", "/EN/", "/a/b", "/a/bc"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "nothing", "://", "a://b://com/"]
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(5)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(d, rules, max_rules=limit).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(urls)}
    assert urlrules.judge(d.limit(0), rules).count() == 0
    assert urlrules.judge(d, rules.limit(0)).where("rule is not null").count() == 0


# -- nearest neighbours -----------------------------------------------------------------


def vectors(n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    v = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim)) * 0.6
    v[5:300:3] = v[5]  # one very common vector
    return v


def test_neighbours_recall_and_exact_scores(spark):
    v = vectors()
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(20_000, None), (20_020, [0.0] * 16), (20_040, [float("nan")] + [1.0] * 15), (20_060, [None] + [1.0] * 15), (None, [1.0] * 16), (20_080, [1.0] * 3)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(d, F.col("vec_id") % 20 == 0, k=20, leaf_rows=32, shard_rows=200, block_queries=40, recall=0.95).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = ann.brute_force(rows, lambda i: i % 20 == 0) | {20_080: []}
    assert set(got) == {q for q in want if want[q]}
    want.pop(20_080)
    hit = np.mean([len({x[1] for x in got[q]} & set(want[q])) / 20 for q in want])
    assert hit >= 0.9
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and q not in [x[1] for x in found]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == pytest.approx(float(v[q] @ v[i]), abs=1e-12) for _, i, s in found)


def test_neighbours_at_registered_parameters(spark):
    """Many rows without clusters, columns of clashing names, equal vectors at the last rank."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((12_000, 24))
    v[7000:7060] = v[40] * 0.9
    rows = [(i, [float(x) for x in r], 1, 2, 3) for i, r in enumerate(v)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int, shard int, v int").repartition(4)
    out = ann.search(d, F.col("vec_id") % 20 == 0)
    visits, leaves, shards = out._lociframe_visits
    assert 1 < visits < leaves and shards > 1  # the tree decides what is scored
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = ann.brute_force([r[:2] for r in rows], lambda i: i % 20 == 0)
    assert np.mean([len({x for _, x in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    assert [i for _, i in sorted(got[40])][1:] == list(range(7000, 7019)) or [i for _, i in sorted(got[40])] == list(range(7000, 7020))


def test_neighbours_long_vectors_whose_products_cancel():
    rng = np.random.default_rng(6)
    big = np.array([1e8, -1e8, 0.0, 0.0])
    m = np.array([[1e8 + x, 1e8, *rng.standard_normal(2)] for x in rng.integers(-3, 3, 60) * 1e-3])
    q = np.array([[1.0, -1.0, 0.5, 0.25]]) * 1e4 + big * 0
    r, got, s = ann.top_pairs(np.array([999]), q, np.arange(60), m, 5)
    want = sorted(((-(q[0] * x).sum(), i) for i, x in enumerate(m)))[:5]
    assert got.tolist() == [i for _, i in want] and s.tolist() == [-x for x, _ in want]


@pytest.mark.parametrize("blocks", [3, 4096])
def test_neighbours_exact_when_all_is_visited(spark, blocks):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4)]) for i in range(300)] + [(1000 + i, [float(i), 1.0]) for i in range(30)]
    rows = [(i, v) for i, v in rows if any(v)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7, recall=1.0, leaf_rows=20, shard_rows=50, block_queries=blocks, calibrate=300, sample_rows=5000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = {}
    for i, v in rows:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))
            want[i] = [j for _, j in near[:7]]
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == want


def test_neighbours_few_and_none(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.search(d, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(d.limit(0), F.col("vec_id") == 0).count() == 0


# -- decontamination -----------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(8)
    items = [" ".join(words(rng, n, 5000)) for n in (40, 25, 12, 2)] + ["", None]
    w = items[0].split()
    edited = [x if i % 8 else "edit" for i, x in enumerate(w)]
    dropped = [x for i, x in enumerate(w) if i % 9]
    clean = [" ".join(words(rng, 300, 5000)) for _ in range(20)]
    texts = {0: f"{clean[0]} {items[0].upper()}, {clean[1]}", 1: f"{clean[2]} {' '.join(edited)}", 2: " ".join(dropped), 3: items[1], 4: f"{clean[3]} {' '.join(w[:10])} {clean[4]}", 5: "", 6: None, 7: f"some {items[3]} here", **{10 + i: c for i, c in enumerate(clean)}}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], DOCS + ", item_id string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, "a b c d")], "item_id long, text string")
    for size in (1 << 20, 200):
        got = {r.doc_id: r for r in decontam.mark(docs, bench, item_bytes=size).collect()}
        assert {i for i, r in got.items() if r.contaminated} == {0, 1, 2, 3, 7}
        assert got[0].item_id == got[1].item_id == 0 and got[3].item_id == 1 and got[0].overlap == 1.0
        assert got[5].overlap == got[6].overlap == 0
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert decontam.mark(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.mark(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("size", [32 << 20, 400])
def test_decontamination_lists_every_item(spark, size):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, 30, 5000))) for k in range(6)]
    edited = items[4][1].split()
    edited[15] = "edited"
    filler = lambda: " ".join(words(rng, 60, 5000))
    rows = [(1, f"{filler()} {items[0][1]} {filler()} {items[2][1]} {filler()} {' '.join(edited)}"), (2, items[5][1]), (3, filler()), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.mark(spark.createDataFrame(rows, DOCS), bench, item_bytes=size).collect()}
    assert [x.item_id for x in got[1]["items"]] == [0, 2, 4] and got[1].n_items == 3 and got[1].item_id == 0
    assert [x.overlap for x in got[1]["items"]][:2] == [1.0, 1.0] and 0.9 < got[1]["items"][2].overlap < 1
    assert [(x.item_id, x.overlap) for x in got[2]["items"]] == [(5, 1.0)]
    assert all(got[i]["items"] == [] and got[i].n_items == 0 and not got[i].contaminated for i in (3, 4))


def test_decontamination_finds_excerpts(spark):
    rng = random.Random(13)
    item = words(rng, 59, 5000)
    filler = words(rng, 60, 10**6)
    rows = [(n, " ".join(filler[:30] + item[9 : 9 + n] + filler[30:])) for n in (34, 20, 13, 11)]
    got = {r.doc_id: r for r in decontam.mark(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert all(got[n].overlap < 0.6 for n in got)
    assert [n for n in got if got[n].contaminated] == [34, 20, 13]
    assert [x.item_id for x in got[20]["items"]] == [7] and got[11]["items"] == []


def test_seeds_cover_every_window_however_frequent():
    h, _, _ = decontam.word_hashes(b" ".join(b"w%d" % i for i in range(30)))
    counts = {int(g): 10**6 for g in decontam.grams(h, 3)}
    s = decontam.Items([(0, h)], 3, 3, counts)
    gaps = np.diff(np.concatenate([[-1], np.sort(s.place), [28]]))
    assert gaps.max() <= 3


def test_word_hashes_and_alignment_against_plain():
    text = "naïve über-cool 42 x x naïve".encode()
    h, start, end = decontam.word_hashes(text)
    assert [text[a:b].decode() for a, b in zip(start, end, strict=True)] == ["naïve", "über", "cool", "42", "x", "x", "naïve"]
    assert h[0] == h[6] and h[4] == h[5] and len(set(h.tolist())) == 5
    rng = random.Random(2)
    for _ in range(30):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        best, prev = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, row[j] - 1))
            best, prev = max(best, *row), row
        assert decontam.align(np.array(a), np.array(b)) == best


# -- tokens ---------------------------------------------------------------------------------


def tokenizers():
    return pytest.importorskip("public_tokenizers")


def test_section_tokens(spark):
    p = tokenizers()
    enc, _ = tokencount.encoder(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    texts = ["one two\nthree\n\nfour é日本", "", None, "\n\n", "no end" * 300, "a\r\nb"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", section int")
    for rule in tokencount.RULES:
        got = tokencount.section_tokens(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, rule=rule).collect()
        for i, t in enumerate(texts):
            mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
            assert sum(r.n_tokens for r in mine) == len(enc.encode_ordinary(t or ""))
            assert "".join((t or "")[r.start_char : r.end_char] for r in mine) == (t or "")
    assert docs.limit(0).transform(lambda d: tokencount.section_tokens(d, p.path("byte_bpe_50k.tiktoken"), p.PATTERN)).count() == 0


def test_attribution_rules_against_bytes():
    rng = random.Random(3)
    for _ in range(50):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(12)])
        cut = sorted(rng.sample(range(int(ends[-1]) + 1), 6))
        lo, hi = np.array(cut[0::2]), np.array(cut[1::2])
        begins = np.concatenate([[0], ends[:-1]])
        at = lambda b: next((k for k in range(3) if lo[k] <= b < hi[k]), -1)  # noqa: B023, E731
        assert tokencount.attribute(ends, lo, hi, "start").tolist() == [at(b) for b in begins]
        assert tokencount.attribute(ends, lo, hi, "end").tolist() == [at(e - 1) for e in ends]
        for t, (b, e) in enumerate(zip(begins, ends, strict=True)):
            shares = [max(0, min(hi[k], e) - max(lo[k], b)) for k in range(3)]
            want = -1 if max(shares) == 0 else int(np.argmax(shares))
            assert tokencount.attribute(ends, lo, hi, "majority")[t] == want


def test_section_tokens_given_sections(spark):
    p = tokenizers()
    d = spark.createDataFrame([(1, "héllo wörld again", [(0, 5), (6, 11)]), (2, "abc", []), (3, "x", None)], DOCS + ", s array<struct<start:int,end:int>>")
    got = tokencount.section_tokens(d, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, "s").collect()
    one = {r.section: r for r in got if r.doc_id == 1}
    assert (one[0].start_char, one[0].end_char) == (0, 5) and one[-1].n_tokens >= 1
    bad = spark.createDataFrame([(1, "abc", [(0, 2), (1, 3)])], DOCS + ", s array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="overlap"):
        tokencount.section_tokens(bad, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, "s").collect()


def test_bpe_equals_library(spark):
    p = tokenizers()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(1)
    letters = "abcdeéß日 '-.,!0²³AΣİ\n\t👍ñ\u200b"
    texts = ["", None, "a<|endoftext|>b<|startoftext|>", "it's WE'LL", "x" * 500, "antidisestablishmentarianism " * 3, "ΑΣ ΣΟΦΟΣ", "\x1c\x85", "ا ب ת"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in bpe.encode(docs, p.path("word_bpe_49k.json"), keep_ids=True).collect()}
    for i, t in enumerate(texts):
        e = lib.encode(t or "", add_special_tokens=False)
        assert got[i].ids == e.ids, t
        assert got[i].decoded == lib.decode(e.ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest() and got[i].n_tokens == len(e.ids)
    one = bpe.load(p.path("word_bpe_49k.json"))
    assert one.decode(one.encode("Hello world")) == lib.decode(lib.encode("Hello world", add_special_tokens=False).ids, skip_special_tokens=False)
    long = "".join(rng.choice("abcdefghij") for _ in range(1 << 20))  # one word of a megabyte
    e = lib.encode(long[:200_000], add_special_tokens=False)
    assert one.encode(long[:200_000]) == e.ids
    assert sum(map(len, (lib.id_to_token(i).removesuffix("</w>") for i in one.encode(long)))) == 1 << 20
    one.encode(" ".join(t for t in texts if t))
    assert 0 < one.stats["merged"] < one.stats["words"]


# -- chats ------------------------------------------------------------------------------------


def test_markers():
    for line, role, rest in [("User: hi", 1, "hi"), ("ASSISTANT: yes", 2, "yes"), ("<|im_start|>system", 0, ""), ("### Human", 1, ""), ("**Bot**: ok", 2, "ok"), ("[me] a", 1, " a"), ("user friendly", None, "user friendly"), ("<|user|>x<|end|>", 1, "x")]:
        got = chatformat.marker_of(line)
        assert got[0] == role and got[1].strip() == rest.strip()


def chat_model():
    import pandas as pd

    rows = []
    for c in range(40):
        for t in range(6):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "why so?" if t % 2 == 0 else "because " * 40))
    return chatformat.count(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))


def test_chat_roles_marked_and_unmarked(spark):
    m = chat_model()
    rows = [(1, t, "why so?" if t % 2 == 0 else "because " * 40) for t in range(6)]
    rows += [(2, 0, "System: be nice\nUser: hi\nmore\nAssistant: hello\nyou")]
    rows += [(3, None, None), (None, 0, "x?"), (None, 0, "x?"), (4, 0, "")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("hidden")).repartition(3)
    got = sorted(chatformat.parse(d, m).collect(), key=lambda r: (r.conv_id or -1, r.turn or -1))
    one = [r.role for r in got if r.conv_id == 1]
    assert one == ["user", "assistant"] * 3
    two = next(r for r in got if r.conv_id == 2)
    assert two.rendered == "<|system|>\nbe nice\n<|end|>\n<|user|>\nhi\nmore\n<|end|>\n<|assistant|>\nhello\nyou\n<|end|>" and two.n_segments == 3
    assert len(got) == len(rows)
    assert chatformat.parse(d.limit(0), m).count() == 0


def test_long_conversation_equals_single_viterbi(spark):
    m = chat_model()
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["why?", "because " * rng.randrange(1, 60), "User: a", "b\nc\nAssistant: d"])) for c, n in ((0, 3), (1, 400), (2, 5)) for t in range(n)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)
    got = {(r.conv_id, r.turn): r for r in chatformat.parse(d, m).collect()}
    for c in (0, 1, 2):
        mine = [m.row(t) for i, _, t in rows if i == c]
        states, at = chatformat.viterbi(m, np.concatenate([e for e, _ in mine])), 0
        for t, (e, lines) in enumerate(mine):
            assert (got[c, t].role, got[c, t].n_segments, got[c, t].rendered) == chatformat.render(states[at : at + len(e)], lines)
            at += len(e)


def test_viterbi_is_the_best_path():
    import itertools

    m = chat_model()
    e = np.concatenate([m.row(t)[0] for t in ("why?", "because " * 30, "User: x")])
    score = lambda s: m.start[s[0]] + sum(m.change[a, b] for a, b in itertools.pairwise(s)) + sum(e[i, x] for i, x in enumerate(s))
    best = max(itertools.product(range(6), repeat=3), key=score)
    assert score(chatformat.viterbi(m, e)) == pytest.approx(score(best))


# -- HTML ---------------------------------------------------------------------------------------

GOOD = "This is the story of a man and his house that was on the hill and it is told by all of the people who were there with him at the time of the great storm in the north, and it has been told for years and years by them."


def test_html_containers_and_entities():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h2>Head &amp; line</h2></header><p>First <b>bo</b>ld&nbsp;&lt;tag&gt;\n  text<br>second line<p>a | b
    <aside>See also</aside><div id="comments"><p>{GOOD}</p></div><form>Name <input></form><p hidden>no</p><p>Last &am</article>
    <div class="ad">{GOOD}</div><footer>&copy; me</footer>"""
    assert htmltext.main_text(page) == "Head & line\n\nFirst bold <tag> text second line\n\na | b\n\nLast &am"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p title=it's>Hello</p><p>Don't go</p></article>", "Hello\n\nDon't go"),
        ("<article><p a==b c= >x<p d=>y</article>", "x\n\ny"),
        ("<article><p>foo <svg><path/></svg>bar <script>x</script>baz</p></article>", "foo bar baz"),
        ("<article><p>o<script>var t='</p>'</script>ne <canvas>no<p>no</p></canvas>two</p></article>", "one two"),
        ("<article><p>One.</p><form><button>Label</form><p>Two.</p></article>", "One.\n\nTwo."),
        ("<article><p>A <button>Label</p><p>Two.</p></article>", "A\n\nTwo."),
        ("<article><button>A<p>One.</p><button>B</button>tail</article>", "One.\n\ntail"),
        ("<head><title>T</title><body><article>x</article>", "x"),
        ("<article>a<br>b<br> <br/>c</article>", "a b\n\nc"),
        ("<article>x<!--> y --> z<!-- no", "x y --> z"),
        ("<article>x</article><script>never closed <p>no", "x"),
        ("<article>x <a href='", "x"),
        ("<article><p><a href=x>Only a link</a></p><ul><li><a href=y>menu</a></ul>end</article>", "Only a link\n\nend"),
    ],
)
def test_html_tags_as_browsers_read_them(page, want):
    assert htmltext.main_text(page) == want


def test_html_compound_classes_yield_and_whole_ones_do_not():
    good = f"<p>{GOOD}</p>"
    assert htmltext.main_text(f'<div class="content has-sidebar">{good}</div>') == GOOD
    assert htmltext.main_text(f'<div class="social-article">{good}</div>') == GOOD
    assert htmltext.main_text(f'<div class="promo-box">{good}</div>') == GOOD  # nothing else is left
    assert htmltext.main_text(f'<div class="promo-box">{good}</div><div>{good}</div>') == GOOD
    assert htmltext.main_text(f'<div class="ad">{good}</div>') == ""


def test_html_other_scripts():
    body = "これは日本語の文章です。とても長い文章なので本文として扱われます。" * 4
    assert htmltext.main_text(f"<div><a href=x>メニュー</a></div><div><p>{body}</p></div>") == body
    greek = "Αυτό είναι ένα κείμενο στα ελληνικά, που είναι αρκετά μεγάλο. " * 6
    assert htmltext.main_text(f"<ul><li><a href=x>μενού</a></li></ul><p>{greek}</p>") == greek.strip()


def test_html_against_pages_of_known_text():
    """Random pages put together from article paragraphs and everything that is not the article."""
    rng = random.Random(17)
    inline = [lambda t: (f"<b>{t}</b>", t), lambda t: (f"<a href=x>{t}</a> {t}", f"{t} {t}"), lambda t: (t + "<script>if (a<b) x('</p>')</script>", t), lambda t: (t + " &amp; &#x41;&eacute;", t + " & Aé"), lambda t: (f"{t}<!-- <p>no</p> -->", t), lambda t: (f"{t}<br>{t}", f"{t} {t}"), lambda t: (f"<em title=\"a>b\">{t}</em>", t)]
    noise = ["<nav><ul><li><a href=/>{t}</a></ul></nav>", "<div class=ad>{t}</div>", "<aside><p>{t}</p></aside>", "<footer>{t}</footer>", "<form><input value='x'><button>{t}</button></form>", "<section id=comments><p>{t}</p></section>", "<style>p {{ }}</style>", "<div hidden><p>{t}</p></div>", "<div class='cookie'>{t}<div>{t}</div></div>", "<noscript><p>{t}</p></noscript>"]
    for _ in range(150):
        parts, want = [], []
        for _ in range(rng.randrange(1, 8)):
            if rng.random() < 0.4:
                parts.append(rng.choice(noise).format(t=" ".join(words(rng, 8))))
            bits = [rng.choice(inline)(" ".join(words(rng, rng.randrange(1, 9)))) for _ in range(rng.randrange(1, 4))]
            tag = rng.choice(["p", "h2", "blockquote", "div"])
            parts.append(f"<{tag}>\n  {' '.join(a for a, _ in bits)}</{tag}>")
            want.append(" ".join(b for _, b in bits))
        around = [n.format(t=GOOD) for n in rng.sample(noise, 4)]
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{around[0]}{around[1]}<article>{''.join(parts)}</article>{around[2]}{around[3]}</body></html>"
        assert htmltext.main_text(page) == "\n\n".join(want)


def test_html_very_long_and_hostile_pages():
    body = "the text of a very long page. " * 40_000
    assert htmltext.main_text(f"<article>{body}</article>") == body.strip()
    for page in ('a<b x="' * 200_000, "<noscript>" * 50_000, "<!--" * 100_000, "<div>" * 20_000 + "x", "<a b='" * 50_000 + ">"):
        htmltext.main_text(page)


def test_html_words_of_other_attributes_are_not_evidence():
    page = """<body><article><h1 class="post-header">The title</h1><div style="overflow:hidden"><p title="the hidden cost">First of all
    see <a href="/hidden-valley">the valley</a> and <a href=/?id=comment-3>the reply</a> below.</p></div>
    <p data-class="comment" 'hidden'>Second.</p><div class="comment">No.</div><p hidden>Never.</p><p aria-hidden='true'>Nor this.</p></article></body>"""
    got = htmltext.main_text(page)
    assert "The title" in got and "see the valley and the reply below." in " ".join(got.split()) and "Second." in got
    assert not any(x in got for x in ("No.", "Never.", "Nor this."))


def test_html_context_without_containers():
    link = "<div><a href=x>Some link text that is long enough to be a menu of the site and of others</a></div>"
    page = f"{link}<div>Short</div>{link}<div>{GOOD}</div><div>Short one</div><div>{GOOD}</div><div>tail</div>{link}"
    assert htmltext.main_text(page) == f"{GOOD}\n\nShort one\n\n{GOOD}\n\ntail"


def test_html_query_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", f"<p>{GOOD}"), (3, "u", f"<p>{GOOD}"), (4, "u", "<" * 2000), (5, "u", "<a b='" + "x" * 5000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted(htmltext.extract(pages).collect(), key=lambda r: r.page_id)
    assert [r.text for r in got[:4]] == ["", "", GOOD, GOOD] and got[2].n_chars == len(GOOD)
    assert htmltext.extract(pages.limit(0)).count() == 0


# -- pipeline and contract -------------------------------------------------------------------------


def test_pipeline_small(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers()
    rng = random.Random(12)
    item = " ".join(words(rng, 40, 9000))
    rows = [(i, " ".join(words(rng, 80, 9000)), "en", "s", 1) for i in range(120)]
    rows = [(i, t + " grumfling grumfer" if i % 4 == 0 else t, *r) for i, t, *r in rows]
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[2][1].replace(rows[2][1].split()[9], "zzz"), "en", "s", 1), (202, f"{rows[3][1][::-1]} {item}", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS + ", lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [i for i in range(120) if i % 4]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_registered_names():
    from lociframe.llm.oracles import oracle_sql
    from lociframe.llm.queries import queries

    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


def test_simhash_variants_are_never_broadcast(spark):
    """Spark estimates exploded variants without their number: 64 a fingerprint would go through the driver."""
    rng = random.Random(5)
    values = sorted({rng.getrandbits(64) - 2**63 for _ in range(500)})
    fps = durable(spark.createDataFrame([(v,) for v in values], "fp long"), "test-fps")
    assert "BroadcastHashJoin" not in simhash.links(fps)._jdf.queryExecution().sparkPlan().toString()
    near = [v ^ (1 << i) for i, v in enumerate(values[:50])]
    same_half = [(7 << 32) | (rng.getrandbits(5) * 9) for _ in range(60)] + [(7 << 32) | (1 << i) for i in range(30)]
    every = sorted(set(values) | set(near) | set(same_half))
    fps = spark.createDataFrame([(v,) for v in every], "fp long")

    def groups(**kw):
        comp = connected_components(simhash.links(fps, crowd=16, **kw)).collect()
        return {r.node: r.component for r in comp}

    few, many = groups(), groups(broadcast_rows=0)  # the second joins what the first broadcasts
    assert few == many
    mask = 2**64 - 1
    links = {(a, b) for a in every for b in every if a < b and ((a ^ b) & mask).bit_count() <= 2}
    assert {x for p in links for x in p} == set(few) and all(few[a] == few[b] for a, b in links)
