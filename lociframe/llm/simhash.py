"""SimHash near-duplicate detection with deletion-variant signatures.

Fingerprints of 64 bits are cut into two segments.  If two fingerprints
differ in at most two bits, one segment differs in at most one, so deleting
the right bit of that segment makes the segments equal.  Every distinct
fingerprint is indexed under its 64 one-wildcard segment variants; an
equality join on the variant finds the candidates and the Hamming distance
of the pair is verified.  Only distinct fingerprints are indexed, so exact
copies cost nothing here.

Crowded variants.  If very many fingerprints share a segment, the pairs of a
bucket would grow with its square.  Fingerprints of such buckets take an
exact other way: two words are within two bits if and only if the closed
balls of radius one round them meet, so each is listed under the 65 members
of its ball and the (at most 65) fingerprints of one member are linked as a
star.  No pair is lost and none is listed quadratically.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import drop_durable, durable, small_batches, tidy, utf8, with_columns
from .components import connected_components

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, shingle: int = 3, block: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words of a UTF-8 text; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), block):
        h = np.fromiter(map(_hash, parts[at : at + block]), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(parts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bit pattern as a signed long; null text counts as empty."""

    def run(batches):
        for b in small_batches(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in utf8(b.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return with_columns(docs, doc_id="long", text="string").mapInArrow(tidy(run), "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(fp, key): the 64 one-wildcard variants; key = variant number * 2^32 + segment without that bit."""
    one = "shiftleft(cast(k as bigint), 32) | (shiftrightunsigned(fp, cast((k div 32) * 32 as int)) & 4294967295L & ~shiftleft(1L, cast(k % 32 as int)))"
    return fps.select("fp", F.explode(F.expr(f"transform(sequence(0, 63), k -> {one})")).alias("key"))


def _own_variant() -> Column:
    """The one variant under which a pair within two bits is listed (others would repeat it)."""
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    lo, hi = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    bit = lambda v: F.bit_count(F.greatest(v, F.lit(1)) - 1)
    return F.when(F.bit_count(lo) <= 1, bit(lo)).otherwise(32 + bit(hi))


def links(fps: DataFrame, max_distance: int = 2, crowd: int = 64, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Links (u, v) between distinct fingerprints at most ``max_distance`` bits apart.

    ``fps`` has a column ``fp`` of distinct longs.  Buckets of over about
    ``2 * crowd`` members give star links, others one link for each pair; both
    connect the same fingerprints.  The variants meet in a sort-merge join
    whatever Spark takes their size for; those of crowded segments are
    broadcast up to ``broadcast_rows``.
    """
    if not 1 <= max_distance <= 2:
        raise ValueError("max_distance must be 1 or 2")
    segments = fps.select(F.explode(F.expr("array(fp & 4294967295L, (1L << 32) | shiftrightunsigned(fp, 32))")).alias("segment"))
    crowded = durable(segments.groupBy("segment").count().where(F.col("count") > crowd).select("segment"), "crowded")
    keyed = variants(fps)
    many = bool(crowded.take(1))
    if many:
        # every variant of a crowded segment; those one bit off share them (32 a segment, which Spark's estimate of their size leaves out)
        held = F.broadcast if crowded.count() * 32 <= broadcast_rows else (lambda x: x.hint("merge"))
        hot = crowded.select(F.explode(F.expr("transform(sequence(0, 31), i -> shiftleft(shiftrightunsigned(segment, 32) * 32 + i, 32) | (segment & 4294967295L & ~shiftleft(1L, cast(i as int))))")).alias("key")).distinct()
        balls = keyed.join(held(hot), "key", "left_semi").select("fp").distinct()
        keyed = keyed.join(held(hot), "key", "left_anti")
    a, b = keyed.alias("a"), keyed.alias("b").hint("merge")  # estimated without the 64 rows of each fingerprint, so Spark would broadcast them
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near & (F.shiftrightunsigned(F.col("a.key"), 32) == _own_variant()))
    out = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if many:
        ball = "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))" if max_distance == 2 else "transform(sequence(0, 63), i -> fp & ~shiftleft(1L, i))"
        if max_distance == 1:  # within one bit: equal after deleting one bit, so the bit's place belongs to the key
            listed = balls.select("fp", F.posexplode(F.expr(ball)).alias("place", "centre"))
            stars = listed.groupBy("place", "centre").agg(F.collect_set("fp").alias("members"))
        else:
            listed = balls.select("fp", F.explode(F.expr(ball)).alias("centre"))
            stars = listed.groupBy("centre").agg(F.collect_set("fp").alias("members"))
        stars = stars.where("size(members) > 1").select(F.explode("members").alias("u"), F.array_min("members").alias("v")).where("u != v").distinct()
        out = out.union(stars)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id, n_copies).

    component_id is the smallest doc_id reachable over links of at most
    ``max_distance`` bits, itself included; n_copies counts the documents of
    the same fingerprint.  Documents without words have fingerprint zero and
    are linked like any other.  Rows with a null doc_id stay (their group's
    smallest non-null id, or null); repeated rows are kept and linked; texts
    are read as bytes, whole, whatever their length or encoding; an empty
    table gives an empty result; other columns are ignored.
    """
    by_doc = durable(fingerprints(docs, shingle), "fingerprints")
    fps = durable(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_copies")), "distinct-fp")
    comp = connected_components(links(fps.select("fp"), max_distance))
    of = fps.join(comp, fps.fp == comp.node, "left").select("fp", "first_doc", "n_copies", F.coalesce("component", "fp").alias("component"))
    of = durable(of, "fp-component")
    drop_durable(fps)
    least = of.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    label = of.join(least, "component").select("fp", "component_id", "n_copies")
    return by_doc.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


# -- groups by similarity --------------------------------------------------------

_CUTS = ((0, 21), (21, 42), (42, 64))  # bits of a word's three segments
_WORDS = 2  # fingerprint words of 64 bits
_SKETCH = 16  # longs of a sketch
_FP = [f"f{w}" for w in range(_WORDS)]
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

_SALT = np.arange(1, _WORDS + 1, dtype=np.uint64) * _M1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def _gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` words that begins at each word; fewer words: of the whole sequence."""
    if not len(h):
        return h
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = _mix(out) + h[k : len(h) - size + 1 + k] * _M1
    return _mix(out + np.uint64(size))


def shingle_hashes(text: bytes | None, size: int, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased; fewer words: the whole sequence; none: empty)."""
    return np.unique(_gram_hashes(_word_hashes(text, known), size))


def _word_hashes(text: bytes | None, known: dict | None = None) -> np.ndarray:
    words = (text or b"").lower().split()
    if known is None:
        return np.fromiter(map(_hash, words), np.uint64, len(words))
    for w in set(words).difference(known):
        known[w] = _hash(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def wide_fingerprint(h: np.ndarray, size: int = 2, block: int = 1 << 16) -> list[int]:
    """Fingerprint words of a text's word hashes: majority bits of its ``size``-word runs, repeats included; no words: zeros."""
    grams = _gram_hashes(h, size)
    if not len(grams):
        return [0] * _WORDS
    out = []
    for w in range(_WORDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(grams), block):
            x = _mix(grams[at : at + block] + _SALT[w])
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(grams), bitorder="little").view(np.int64)[0]))
    return out


def _sources(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source): source, a hash of both, names a row's text when it is read again."""
    return with_columns(docs, doc_id="long", text="string").withColumn("source", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def _digest(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set of hashes."""
    return int(_mix(np.array([_mix(s + _M1).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0])


def signatures(docs: DataFrame, shingle: int = 5, fingerprint_shingle: int = 2) -> DataFrame:
    """(doc_id, source, f0, f1, digest, size, w0, w1, ...) for every row.

    source: by which :func:`shingle_sets` finds the text again; f0, f1:
    fingerprint words; digest: a hash of the distinct hashes of the
    ``shingle``-word shingles, size their number; w0, ...: a bitmap of them.
    """

    def run(batches):
        known: dict[bytes, int] = {}
        for b in small_batches(batches, "text", 1 << 20):
            if len(known) > 100_000:
                known.clear()
            sizes, fps, digest, bits = [], [], [], []
            for t in utf8(b.column("text")):
                h = _word_hashes(t, known)
                s = np.unique(_gram_hashes(h, shingle))
                at = np.zeros(64 * _SKETCH, np.uint8)
                at[s % np.uint64(64 * _SKETCH)] = 1
                fps.append(wide_fingerprint(h, fingerprint_shingle))
                digest.append(_digest(s))
                bits.append(np.packbits(at).view(np.int64))
                sizes.append(len(s))
            f, w = np.array(fps, np.int64), np.stack(bits)
            cols = [b.column("doc_id"), b.column("source"), *(pa.array(f[:, k].copy()) for k in range(_WORDS)), pa.array(digest, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(w[:, k].copy()) for k in range(_SKETCH))]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "source", *_FP, "digest", "size", *(f"w{k}" for k in range(_SKETCH))]
    return _sources(docs).mapInArrow(tidy(run), ", ".join(f"{c} bigint" for c in names))


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(row, hashes): the sorted distinct shingle hashes of the texts that ``wanted`` (row, source, digest) names.

    The texts are read again and the others left where they lie, so that only
    the sets of wanted texts move, and only if ``wanted`` has over
    ``broadcast_rows`` rows.  A row that ``docs`` repeats may be given once by
    each task.
    """

    def run(batches):
        known: dict[bytes, int] = {}
        seen: set[tuple[int, int]] = set()
        for b in small_batches(batches, "text", 1 << 20):
            if len(known) > 100_000:
                known.clear()
            source, digest, sets = [], [], []
            for at, t in zip(b.column("source").to_pylist(), utf8(b.column("text")), strict=True):
                s = shingle_hashes(t, shingle, known)
                d = _digest(s)
                if (at, d) not in seen:
                    seen.add((at, d))
                    source.append(at)
                    digest.append(d)
                    sets.append(s.view(np.int64))
            if sets:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(digest, pa.int64()), lists], ["source", "digest", "hashes"])

    texts = among(_sources(docs), wanted.select("source")).select("source", "text")
    sets = texts.mapInArrow(tidy(run), "source bigint, digest bigint, hashes array<bigint>")
    return sets.join(F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted, ["source", "digest"]).select("row", "hashes")


def among(rows: DataFrame, wanted: DataFrame, bits: int = 32, most: int = 1 << 29) -> DataFrame:
    """Those of ``rows`` whose hash is in ``wanted``, whose one column, a long, ``rows`` has too; about one in ``bits`` of the others slips in.

    ``rows`` do not move: a bitmap of the wanted hashes, ``bits`` of them
    (a power of two) for each, is broadcast in parts of 4 KB; it has at most
    ``most`` bits (64 MB), beyond which more others slip in.
    """
    (name,) = wanted.columns
    n = min(most, max(1 << 15, bits << max(0, wanted.count() - 1).bit_length()))
    place = f"({name} & 32767L)"
    part = F.expr(f"shiftright({name} & {n - 1}L, 15)")
    maps = wanted.select(part.alias("_part"), F.expr(place).alias("_at")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = f"cast(conv(hex(substring(_bits, cast({place} div 8 as int) + 1, 1)), 16, 10) as int)"
    held = F.expr(f"shiftright({byte}, cast({name} & 7L as int)) & 1 = 1")
    return rows.join(F.broadcast(maps), (part == F.col("_part")) & held, "left_semi")


def _distance() -> Column:
    return F.expr(" + ".join(f"bit_count(a.{f} ^ b.{f})" for f in _FP))


def _segments(nodes: DataFrame) -> DataFrame:
    """``nodes`` with segment: three segments of each word; number of the first bit * 2^32 + bits."""
    one = (f"shiftleft({64 * w + a}L, 32) | (shiftrightunsigned({f}, {a}) & {(1 << (b - a)) - 1}L)" for w, f in enumerate(_FP) for a, b in _CUTS)
    return nodes.select(*nodes.columns, F.explode(F.expr(f"array({', '.join(one)})")).alias("segment"))


_PART = "if({p} < 14, 127L, 255L)"  # a segment's three parts begin at its bits 0, 7 and 14


def _routes(segments: DataFrame) -> DataFrame:
    """Rows of :func:`_segments` with route instead: the segment without one of its three parts; number of the part's first bit * 2^32 + the rest.

    All variants that delete a bit of that part agree in the rest, so the rows
    are dealt out by route (18 a node) and make their variants (128) in place.
    """
    one = f"shiftleft(shiftrightunsigned(segment, 32) + p, 32) | (segment & 4294967295L & ~shiftleft({_PART.format(p='p')}, p))"
    return segments.select(*segments.columns, F.explode(F.expr(f"transform(array(0, 7, 14), p -> {one})")).alias("route")).drop("segment")


def _variants_of(routes: DataFrame) -> DataFrame:
    """Rows of :func:`_routes` with key: their one-wildcard segment variants; number of the deleted bit * 2^32 + segment without that bit."""
    number = "shiftrightunsigned(route, 32)"
    word = f"case {' '.join(f'when {number} < {64 * w + 64} then {f}' for w, f in enumerate(_FP))} end"
    at = f"cast({number} & 63 as int)"
    begin = f"case when {at} < 21 then 0 when {at} < 42 then 21 else 42 end"
    mask = f"case when {at} < 42 then 2097151L else 4194303L end"
    of = routes.select(*routes.columns, F.expr(number).alias("_n"), F.expr(f"{at} - {begin}").alias("_p"), F.expr(f"shiftrightunsigned({word}, {begin}) & {mask}").alias("_s"), F.expr(f"if({at} = 56, 7, 6)").alias("_last"))
    one = "shiftleft(_n + i, 32) | (_s & ~shiftleft(1L, _p + i))"
    return of.select(*routes.columns, F.explode(F.expr(f"transform(sequence(0, _last), i -> {one})")).alias("key"))


@contextmanager
def _co_partitioned(spark: SparkSession) -> Iterator[None]:
    """In here a join on (route, key) does with rows that are dealt out by route."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _number(key: str) -> str:
    return f"shiftrightunsigned({key}, 32)"


def _segment_of(side: str) -> str:
    """SQL of the whole segment (deleted bit included) under which a row (f0, f1, key) is listed; its bits stay in place."""
    word = f"case {' '.join(f'when {_number(side + 'key')} < {64 * w + 64} then {side}{f}' for w, f in enumerate(_FP))} end"
    at = f"{_number(side + 'key')} & 63"
    return f"(({word}) & case when {at} < 21 then 2097151L when {at} < 42 then shiftleft(2097151L, 21) else shiftleft(4194303L, 42) end)"


def _first_variant(key: str) -> str:
    """Whether a variant is the first of its segment: there pairs of equal segments are listed, elsewhere not."""
    return f"({_number(key)} & 63) in (0, 21, 42)"


def _listed(within: int) -> Column:
    """Whether members a and b of a variant are a pair to be listed there (once for each segment)."""
    once = F.expr(f"{_first_variant('a.key')} or {_segment_of('a.')} != {_segment_of('b.')}")
    return (F.col("a.node") < F.col("b.node")) & (_distance() <= within) & once


def candidate_pairs(nodes: DataFrame, within: int = 28, crowd: int = 16, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (u, v) of nodes whose fingerprints share a variant of a segment and differ in at most ``within`` of their bits.

    ``nodes`` has the longs ``node`` (distinct) and the fingerprint words.  Of
    a crowded segment only the pairs with one hub are listed, the member whose
    segments are the most crowded; the second result holds all
    members (node, f0, f1, key) of such variants for :func:`open_members`, or
    None.  Crowded segments and their variants, longs, are broadcast up to
    ``broadcast_rows``, shuffled beyond.
    """
    spark = nodes.sparkSession
    nodes = nodes.select("node", *_FP)
    crowded = durable(_segments(nodes).groupBy("segment").count().where(F.col("count") > crowd), "crowded")
    n_crowded = crowded.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // 8192))  # about a million variants each
    dealt = lambda routes: _variants_of(routes.repartition(tasks, "route"))
    with _co_partitioned(spark):
        if not n_crowded:
            return durable(_within_variants(dealt(_routes(_segments(nodes))), within).distinct(), "pairs"), None
        number, bits = "shiftrightunsigned(segment, 32)", "(segment & 4294967295L)"
        width = f"case when {number} & 63 < 42 then 20 else 21 end"
        part = "least(i div 7, 2) * 7"
        route = f"shiftleft({number} + {part}, 32) | ({bits} & ~shiftleft({_PART.format(p=part)}, cast({part} as int)))"
        key = f"shiftleft({number} + i, 32) | ({bits} & ~shiftleft(1L, cast(i as int)))"
        hot = durable(crowded.select(F.inline(F.expr(f"transform(sequence(0, {width}), i -> struct({route} as route, {key} as key))"))).distinct(), "hot")
        few = hot.count() <= broadcast_rows
        held = F.broadcast if few else (lambda x: x.hint("merge"))
        company = _segments(nodes).join(held(crowded), "segment").groupBy("node").agg(F.sum("count").alias("company"))
        ranked = _routes(_segments(nodes.join(company, "node", "left").select("node", *_FP, F.coalesce("company", F.lit(0)).alias("company"))))
        every = durable((_variants_of(ranked) if few else dealt(ranked)).join(held(hot), ["route", "key"], "left_semi").select("key", "node", *_FP, "company"), "crowded-members")
        segment = F.expr(_segment_of(""))
        hubs = every.groupBy("key").agg(F.max(F.struct("company", "node", *_FP)).alias("hub"), F.min(segment).alias("low"), F.max(segment).alias("high"))
        hubs = hubs.where(F.expr(f"low != high or {_first_variant('key')}")).drop("low", "high")  # other variants list no pair
        members = durable(every.join(hubs, "key"), "crowded-listed")
        drop_durable(every)
        near = F.expr(" + ".join(f"bit_count({f} ^ hub.{f})" for f in _FP)) <= within
        stars = members.where(F.expr(_first_variant("key")) & (F.col("node") != F.col("hub.node")) & near).select(F.greatest("node", "hub.node").alias("u"), F.least("node", "hub.node").alias("v"))
        members = _same_path(members, members.drop("company", "hub"))
        # all variants of a crowded segment are hot: such rows need not travel; then the variants that others share with one
        open_routes = _routes(_segments(nodes).join(held(crowded), "segment", "left_anti"))
        keyed = dealt(open_routes).join(held(hot), ["route", "key"], "left_anti")
        pairs = durable(_within_variants(keyed, within).union(stars).distinct(), "pairs")
    drop_durable(crowded, hot)
    return pairs, members


def _within_variants(keyed: DataFrame, within: int) -> DataFrame:
    """Pairs (u, v) of the rows (node, f0, f1, route, key) of one key."""
    a, b = keyed.alias("a"), keyed.alias("b").hint("merge")  # estimated without the variants of each route, so Spark would broadcast them
    same = (F.col("a.route") == F.col("b.route")) & (F.col("a.key") == F.col("b.key"))
    return a.join(b, same & _listed(within)).select(F.col("b.node").alias("u"), F.col("a.node").alias("v"))


def _same_path(table: DataFrame, view: DataFrame) -> DataFrame:
    view._lociframe_path = getattr(table, "_lociframe_path", None)
    return view


def open_members(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (key, node, f0, f1, component, n) of the crowded variants that ``comp`` (node, component) has not joined to one; n counts a variant's members."""
    of = members.join(comp, "node", "left").select("key", "node", *_FP, F.coalesce("component", "node").alias("component"))
    of = durable(of, "crowded-component")
    of_key = of.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    out = durable(of.join(of_key.where("low != high").select("key", "n"), "key"), "crowded-open")
    drop_durable(of)
    return out


def rest_pairs(members: DataFrame, within: int = 28, block: int = 1024, possible: Column | None = None) -> DataFrame:
    """All pairs (u, v) of members of crowded variants in different components.

    Every member meets every other.  Variants of up to ``block`` members are
    joined with themselves; the members of larger ones are dealt into blocks
    of about that size and each pair of blocks is one join key, so that no
    task holds a whole variant.  ``possible`` is a further condition on the
    members a and b.
    """
    names = [c for c in members.columns if c != "n"]
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & _listed(within)
    near = near if possible is None else near & possible
    found = lambda x: x.select(F.col("b.node").alias("u"), F.col("a.node").alias("v"))
    small = members.where(F.col("n") <= block).select(names)
    pairs = found(small.alias("a").join(small.alias("b"), near))
    of = members.where(F.col("n") > block).select(*names, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own, every = F.expr("cast(pmod(xxhash64(node), blocks) as int)"), F.expr("explode(sequence(0, blocks - 1))")
    a = of.select(*names, own.alias("i"), every.alias("j")).alias("a")
    b = of.select(*names, every.alias("i"), own.alias("j")).alias("b")
    same = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return pairs.union(found(a.join(b, near & same))).distinct()


def _may_be_similar(similarity: float) -> Column:
    """False only for members a and b whose sketches prove a smaller similarity.

    Each bit that only one bitmap has stands for at least one shingle that only that text has.
    """
    lacks = lambda x, y: " + ".join(f"bit_count({x}.w{k} & ~{y}.w{k})" for k in range(_SKETCH))
    shared = F.expr(f"least(a.size - ({lacks('a', 'b')}), b.size - ({lacks('b', 'a')}))")
    return shared * (1 + similarity) >= similarity * (F.col("a.size") + F.col("b.size")) - 1e-6


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, fingerprint_shingle: int = 2, within: int = 28, crowd: int = 16, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, component_id): groups of texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``.

    Fingerprints of two 64-bit words, cut into six segments with one wildcard
    each, only propose pairs; the shingle sets of each proposed pair are
    compared exactly, those of equal fingerprint too (sets are compared by
    their 64-bit hashes).  Only texts of equal shingle sets are one node from
    the start.  All pairs within eleven bits of the 128 are proposed; farther
    ones with a probability that falls with the distance (README has measured
    recall).  Crowded variants are compared with their hub first; then all
    their pairs that are not yet in one group and that no sketch proves
    dissimilar.

    Texts are read in Python, those of proposed pairs that the sketches leave
    once more (``docs`` has to give the same rows again); what moves is ids,
    fingerprints and, of these texts only, hashes (their ids and pairs, longs,
    are broadcast up to ``broadcast_rows``, shuffled beyond).  component_id is
    the smallest doc_id of the group.  Null texts
    count as empty; empty texts are one group; rows with a null doc_id take
    part and keep the null; repeated rows are one node; bytes of any encoding
    and texts of any length are read whole; an empty table gives an empty one;
    other columns are ignored.
    """
    sig = durable(signatures(docs, shingle, fingerprint_shingle).withColumn("row", F.monotonically_increasing_id()), "signatures")  # numbered once
    nodes = durable(sig.groupBy(*_FP, "digest").agg(F.min("doc_id").alias("first_doc"), F.min("row").alias("node")), "nodes")

    def similar(pairs):
        """Those of the pairs whose shingle sets are similar: sketches first, sets of what they leave."""
        held = lambda x: F.broadcast(x) if x.count() <= broadcast_rows else x
        both_ends = lambda x: x.select(F.col("u").alias("row")).union(x.select("v")).distinct()
        wanted = durable(both_ends(pairs), "wanted")
        sketch = durable(sig.select("row", "source", "digest", "size", *(f"w{k}" for k in range(_SKETCH))).join(held(wanted), "row", "left_semi"), "sketches")
        one, two = sketch.alias("a"), sketch.alias("b")
        of = held(pairs).alias("p")
        possible = one.join(of, F.col("a.row") == F.col("p.u")).join(two, F.col("b.row") == F.col("p.v")).where(_may_be_similar(similarity)).select("p.u", "p.v")
        possible = durable(possible, "possible")
        drop_durable(wanted)
        wanted = durable(sketch.select("row", "source", "digest").join(both_ends(possible), "row", "left_semi"), "wanted")
        drop_durable(sketch)
        sets = durable(shingle_sets(docs, wanted, shingle, broadcast_rows), "sets")
        n, distinct = sets.agg(F.count("row"), F.count_distinct("row")).first()
        if distinct != wanted.count():
            raise RuntimeError("the documents' rows changed between two readings")
        if n > distinct:  # of repeated rows
            repeated, sets = sets, durable(sets.dropDuplicates(["row"]), "sets")
            drop_durable(repeated)
        one, two = sets.withColumnsRenamed({"row": "u", "hashes": "a"}), sets.withColumnsRenamed({"row": "v", "hashes": "b"})
        both = one.join(held(possible), "u").join(two, "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
        out = durable(both.where(F.col("shared") >= similarity * (F.size("a") + F.size("b") - F.col("shared")) - 1e-9).select("u", "v"), "near")
        drop_durable(wanted, possible, sets)
        return out

    pairs, members = candidate_pairs(nodes, within, crowd, broadcast_rows)
    near = similar(pairs)
    drop_durable(pairs)
    comp = durable(connected_components(near), "component")
    if members is not None:
        left = open_members(members, comp)
        sketch = sig.join(left.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("node"), "size", *(f"w{k}" for k in range(_SKETCH)))
        known = durable(left.join(sketch, "node"), "crowded-sketched")
        rest = durable(rest_pairs(known, within, possible=_may_be_similar(similarity)), "rest-pairs")
        drop_durable(left, members, known)
        if rest.take(1):
            more = similar(rest)
            drop_durable(comp)
            comp = durable(connected_components(near.union(more)), "component")
            drop_durable(more)
        drop_durable(rest)
    of = durable(nodes.join(comp, "node", "left").select(*_FP, "digest", "first_doc", F.coalesce("component", "node").alias("component")), "node-component")
    drop_durable(nodes, near, comp)
    least = of.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    out = durable(sig.select("doc_id", *_FP, "digest").join(of.join(least, "component").select(*_FP, "digest", "component_id"), [*_FP, "digest"]).select("doc_id", "component_id"), "groups")
    drop_durable(sig, of)
    return out


def deduplicate(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one document for each near-duplicate group: the one of smallest doc_id.

    Repeated rows of that doc_id are the same document given twice: one of
    them stays.  Rows without a doc_id cannot be told apart and all stay.
    Null, empty and very long texts as in :func:`similar_groups`; an empty
    table gives an empty one; all columns of ``docs`` are kept.  The ids to
    drop, longs, are broadcast up to ``broadcast_rows``, shuffled beyond.
    """
    group = similar_groups(docs, similarity, shingle)
    drop = durable(group.where("doc_id is not null and doc_id != component_id").select("doc_id").distinct(), "drop")
    kept = docs.join(F.broadcast(drop) if drop.count() <= broadcast_rows else drop, docs.doc_id == drop.doc_id, "left_anti")
    twice = durable(group.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    drop_durable(group)
    if not twice.take(1):
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(again)
