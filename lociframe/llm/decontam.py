"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The n-grams (words, hashed) of all test items are counted over the whole
   training corpus, in one pass that emits only counts of the items' own
   n-grams, aggregated before the shuffle.
2. Of each run of ``spread`` successive n-grams of an item the rarest in the
   corpus is a seed.  Every copied stretch of ``n + spread - 1`` words thus
   holds a seed, however frequent the item's words are; none is capped away.
3. A second pass finds seeds in the documents and aligns the item with the
   words around the seeds by Smith-Waterman; every item whose score over its
   perfect score reaches the threshold, or whose score is worth a stretch of
   13 matched words, is kept, and the best one besides.

Both passes are row-local, so a very common passage costs no skew.  The
items travel as a broadcast of checked size; more items than fit are handled
in slices of the item table, one after the other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import small_batches, strings, tidy, with_columns

MAX_ITEM_BYTES = 32 << 20  # of items broadcast at once
ITEMS = "array<struct<item_id: bigint, overlap: double>>"

# one class for each byte: 1 for bytes of words (ASCII letters and digits, all non-ASCII), 0 for others
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_WORD_RE = re.compile(rb"[0-9a-z\x80-\xff]+")
_P = np.uint64(0x100000001B3 | 0x5851F42D00000000)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18  # bytes hashed at once
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those of one block are kept."""
    if n <= _BLOCK and _powers:
        return _powers["p"][:n], _powers["i"][:n]
    out = {}
    for name, base in (("p", _P), ("i", _P_INV)):
        a = np.full(max(n, _BLOCK), base, np.uint64)
        a[0] = 1
        out[name] = np.multiply.accumulate(a)
    if n <= _BLOCK:
        _powers.update(out)
    return out["p"][:n], out["i"][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of lower-cased UTF-8 bytes, without a loop over words, a block of words at a time."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.zeros(len(raw) + 2, np.int8)
    kind[1:-1] = _WORD[raw]
    edge = np.diff(kind)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK, "right")))  # a longer word is a block of its own
        base = start[at]
        part = raw[base : end[to - 1]]
        p, inv = _power(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
        h[at:to] = (total[end[at:to] - base] - total[start[at:to] - base]) * inv[start[at:to] - base]
        at = to
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29)), start, end


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that begins at each word (fewer than n words: none)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * _MIX + h[k : len(h) - n + 1 + k]
    return out


def _batch_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the first word's place for each text (one more at the end)."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    h, start, _ = word_hashes(b" ".join(raw))
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return h, np.searchsorted(start, at)


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    """Best Smith-Waterman local score of two word-hash sequences (linear gaps), a row at a time."""
    if not len(a) or not len(b):
        return 0
    row, best = np.zeros(len(b) + 1, np.int64), 0
    slope = gap * np.arange(len(b) + 1)
    for x in a:
        cell = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == x, match, mismatch), row[1:] + gap, out=cell[1:])
        np.maximum(cell, 0, out=cell)
        row = np.maximum.accumulate(cell - slope) + slope  # gaps along b
        best = max(best, int(row.max()))
    return best


class Items:
    """Test items with their word hashes and seeds, searchable by seed hash."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], n: int, spread: int, counts: dict[int, int] | None = None):
        self.ids = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        seed, item, place = [], [], []
        for k, w in enumerate(self.words):
            g = grams(w, min(n, max(1, len(w))))
            if not len(w):
                continue
            if counts is None or len(g) <= 1:
                take = np.arange(len(g))
            else:
                c = np.array([counts.get(int(x), 0) for x in g])
                take = np.unique([at + int(np.argmin(c[at : at + spread])) for at in range(max(1, len(g) - spread + 1))])
            seed.append(g[take])
            item.append(np.full(len(take), k))
            place.append(take)
        cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        seed, item, place = cat(seed, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.distinct = np.unique(self.seed)
        self.sieve = np.zeros(1 << 20, bool)  # spares most n-grams the binary search
        self.sieve[(self.distinct >> np.uint64(44)).astype(np.int64)] = True
        self.n = n
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < n})

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, seed hash) of every n-gram of h that is a seed."""
        at, what = [], []
        for n in [self.n, *self.short]:
            g = grams(h, n)
            maybe = np.flatnonzero(self.sieve[(g >> np.uint64(44)).astype(np.int64)])
            if len(maybe) and len(self.distinct):
                k = np.minimum(np.searchsorted(self.distinct, g[maybe]), len(self.distinct) - 1)
                maybe = maybe[self.distinct[k] == g[maybe]]
                at.append(maybe)
                what.append(g[maybe])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(at), np.concatenate(what)

    def best(self, h: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> tuple[int | None, float, list[tuple[int, float, int]]]:
        """The item that aligns best with a document's words, its score, and all items' scores over their perfect ones and as such."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for p, s in zip(at.tolist(), seeds, strict=True):
            lo, hi = np.searchsorted(self.seed, s, "left"), np.searchsorted(self.seed, s, "right")
            for k in range(lo, hi):
                i, q = int(self.item[k]), int(self.place[k])
                size = len(self.words[i])
                slack = size // 4 + 2
                spans.setdefault(i, []).append((max(0, p - q - slack), min(len(h), p - q + size + slack)))
        found = []
        for i, parts in spans.items():
            best, w = 0, self.words[i]
            parts.sort()
            lo, hi = parts[0]
            for a, b in [*parts[1:], (None, None)]:
                if a is not None and a <= hi:
                    hi = max(hi, b)
                    continue
                if best < 2 * len(w):
                    best = max(best, align(w, h[lo:hi]) if hi - lo >= len(w) else align(h[lo:hi], w))
                lo, hi = a, b
            found.append((i, best / (2 * len(w)), best))
        if not found:
            return None, 0.0, []
        i, s, _ = min(found, key=lambda x: (-x[1], self.ids[x[0]]))
        return self.ids[i], s, [(self.ids[i], s, best) for i, s, best in found]


def _slices(benchmark: DataFrame, limit: int):
    """The items in slices of at most ``limit`` bytes, each a list of (item_id, word hashes)."""
    items = with_columns(benchmark, item_id="long", text="string").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // limit) or 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toPandas().sort_values(["item_id", "text"])
        out = [(int(i), word_hashes(t.lower().encode("utf-8", "surrogatepass"))[0]) for i, t in zip(rows["item_id"], rows["text"], strict=True)]
        yield [(i, w) for i, w in out if len(w)]


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 3, spread: int = 3, threshold: float = 0.6, stretch: int = 13, item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """``docs`` with (item_id, overlap, items, n_items, contaminated); columns of these names are replaced, others kept.

    items lists every item of overlap >= threshold, or of an alignment worth
    at least ``stretch`` matched words (an excerpt of a long item), as
    (item_id, overlap), best first; n_items is their number (ids, each once).  overlap is the best alignment score over the items' perfect scores (0 to
    1), item_id the item that reaches it (smallest id on ties; null if no
    seed of any item occurs) and contaminated whether items has any.
    Null and empty texts have overlap 0.  Items without words are ignored; an
    empty benchmark marks nothing.  Repeated rows each get their row; bytes
    that are no UTF-8 count as U+FFFD, texts of any length are read whole.
    """
    if "text" not in docs.columns:
        raise ValueError("missing columns: text")
    spark = docs.sparkSession
    out = docs.drop("item_id", "overlap", "items", "n_items", "contaminated").withColumn("text", F.col("text").cast("string"))
    texts = out.select("text")
    names = out.columns
    out = out.withColumn("item_id", F.lit(None).cast("long")).withColumn("overlap", F.lit(0.0)).withColumn("items", F.expr(f"cast(array() as {ITEMS})"))
    listed = pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64())]))
    for rows in _slices(benchmark, item_bytes):
        every = spark.sparkContext.broadcast(Items(rows, n, spread))

        def count(batches, every=every):
            items = every.value
            total: dict[int, int] = {}
            for b in small_batches(batches, "text"):
                h, _ = _batch_words(strings(b.column("text")))  # n-grams across two texts are counted too: only an order of rarity
                g, c = np.unique(items.hits(h)[1], return_counts=True)
                for x, k in zip(g.view(np.int64).tolist(), c.tolist(), strict=True):
                    total[x] = total.get(x, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

        # at most as many rows as the items have n-grams
        counted = texts.mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
        counts = dict(zip(counted["gram"].to_numpy(np.int64).view(np.uint64).tolist(), counted["n"].tolist(), strict=True))
        seeded = spark.sparkContext.broadcast(Items(rows, n, spread, counts))

        def find(batches, seeded=seeded):
            items = seeded.value
            for b in small_batches(batches, "text"):
                h, first = _batch_words(strings(b.column("text")))
                at, seeds = items.hits(h)
                order = np.argsort(at, kind="stable")
                at, seeds = at[order], seeds[order]
                cut = np.searchsorted(at, first)
                ids, scores, lists = (b.column(c).to_pylist() for c in ("item_id", "overlap", "items"))
                for d in np.flatnonzero(np.diff(cut)):
                    lo, hi = cut[d], cut[d + 1]
                    i, s, found = items.best(h[first[d] : first[d + 1]], at[lo:hi] - first[d], seeds[lo:hi])
                    if i is not None and (ids[d] is None or (-s, i) < (-scores[d], ids[d])):
                        ids[d], scores[d] = i, s
                    held = [(k, share) for k, share, score in found if share >= threshold or score >= 2 * stretch]
                    if held:
                        every = {x["item_id"]: x["overlap"] for x in lists[d]}
                        for k, share in held:
                            every[k] = max(share, every.get(k, 0.0))
                        lists[d] = [{"item_id": k, "overlap": v} for k, v in sorted(every.items(), key=lambda x: (-x[1], x[0]))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(lists, listed)], [*names, "item_id", "overlap", "items"])

        out = out.mapInArrow(tidy(find), out.schema)
    return out.withColumn("n_items", F.size("items")).withColumn("contaminated", F.col("n_items") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows, with its own columns."""
    return mark(docs, benchmark, **options).where(~F.col("contaminated")).select(docs.columns)
