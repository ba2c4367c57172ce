"""Hard-negative mining by exact integer inner products, pruned after an orthogonal PCA rotation.

Rows become integer vectors.  In tiles of anchors and candidates the products
of the leading rotated components are accumulated; what the other components
can add is bounded by the residual norms plus slack for rounding, and pairs
that cannot enter a list any more are discarded.  Survivors are scored by
integer products, so the rotation never decides a result.

Anchors (a stated part of the rows) meet all rows in blocks: candidates are
packed ``PACK`` to a row and dealt to ``runs``; a task streams the packs of
one run past one block of anchors and keeps each anchor's best, so an anchor
has at most ``runs`` partial lists, whatever the number of rows.  A first pass
finds positives, a second the negatives in each positive's band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import drop_durable, durable, tidy

PACK, BLOCK, RUNS, TILE = 1024, 8192, 64, 1024
PAIRS = 1 << 15  # scored at a time
SLACK = 64 * np.finfo(float).eps  # for each dimension and unit of both norms; products of rotated vectors err by less


def sound_rows(rows: DataFrame, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, q): integer vectors floor(scale * x) of the rows that take part, one row an id."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    d = d.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))
    size = F.aggregate("q", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    d = d.where(size < 2.0**62).withColumn("q", F.col("q").cast("array<int>"))
    return d.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of the second moments, largest first."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(axes[:, ::-1])


def _matrix(blob: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.int32).reshape(n, dim)


def _pack(limit: int) -> Callable:
    """Arrow kernel: rows (vec_id, label, q[, bands]) to packs of one vector length and at most ``limit`` rows."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            lists = b.column("q")
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            more = b.column("bands").to_pylist() if "bands" in b.schema.names else [None] * b.num_rows
            ids, labels = b.column("vec_id").to_pylist(), b.column("label").to_pylist()
            for i in range(b.num_rows):
                q = flat[ends[i] : ends[i + 1]]
                own = held.setdefault(len(q), [])
                own.append((ids[i], labels[i], q.astype(np.int32).tobytes(), more[i]))
                if len(own) >= limit:
                    yield packed(len(q), own)
                    held[len(q)] = []
        for dim, own in held.items():
            if own:
                yield packed(dim, own)

    def packed(dim: int, own: list) -> pa.RecordBatch:
        ids, labels, q, bands = zip(*own, strict=True)
        flat = [x for b in bands for x in (b or [])]
        cols = [pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([list(labels)], pa.list_(pa.string())), pa.array([b"".join(q)], pa.binary()), pa.array([flat], pa.list_(pa.int64())), pa.array([[len(b or []) for b in bands]], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, ["dim", "ids", "labels", "q", "bands", "n_bands"])

    return tidy(run)


PACKED = "dim int, ids binary, labels array<string>, q binary, bands array<bigint>, n_bands array<int>"


class Best:
    """The ``k`` first (larger score, then smaller id) of each slot, kept sorted."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(slots, -np.inf)  # what a score must reach to enter

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        s, v, m = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        by = np.lexsort((m, -v, s))
        s, v, m = s[by], v[by], m[by]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        keep = place < self.k
        self.slot, self.score, self.id = s[keep], v[keep], m[keep]
        last = place[keep] == self.k - 1
        self.least[self.slot[last]] = self.score[last].astype(float)


def products(a: np.ndarray, c: np.ndarray, ai: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs; norms under 2**31 keep them inside a long."""
    out = np.empty(len(ai), np.int64)
    for at in range(0, len(ai), PAIRS):
        s = slice(at, at + PAIRS)
        out[s] = np.einsum("ij,ij->i", a[ai[s]].astype(np.int64), c[ci[s]].astype(np.int64))
    return out


class Rotated:
    """Integer vectors, their rotated form and the norms of what follows each stage's components."""

    def __init__(self, q: np.ndarray, axes: np.ndarray, stages: list[int]):
        self.q, self.r = q, q.astype(float) @ axes
        square = (self.r**2)[:, ::-1].cumsum(axis=1)[:, ::-1]
        rest = np.concatenate([square, np.zeros((len(q), 1))], axis=1)
        self.rest = {m: np.sqrt(rest[:, m]) for m in stages}
        self.norm = np.sqrt(rest[:, 0])


def stages_of(dim: int) -> list[int]:
    """Numbers of leading components after which pairs are discarded."""
    return sorted({max(1, dim // 4), max(1, dim // 2), max(1, (3 * dim) // 4)} - {dim}) if dim > 1 else []


def survivors(a: Rotated, c: Rotated, stages: list[int], maybe: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, candidate) rows of the pairs whose bounds ``maybe`` lets through every stage.

    ``maybe(lower, upper, ai, ci)`` sees the whole tile first (ai, ci None), then pairs.
    """
    slack = SLACK * a.r.shape[1]
    if not stages:
        inf = np.full((len(a.q), len(c.q)), np.inf)
        return np.nonzero(maybe(-inf, inf, None, None))
    m = stages[0]
    part = a.r[:, :m] @ c.r[:, :m].T
    far = np.outer(a.rest[m], c.rest[m]) + slack * np.outer(a.norm, c.norm)
    ai, ci = np.nonzero(maybe(part - far, part + far, None, None))
    part = part[ai, ci]
    for upto in stages[1:]:
        if not len(ai):
            break
        keep = np.zeros(len(ai), bool)
        for at in range(0, len(ai), PAIRS):
            s = slice(at, at + PAIRS)
            x, y = ai[s], ci[s]
            part[s] += np.einsum("ij,ij->i", a.r[x, m:upto], c.r[y, m:upto])
            far = a.rest[upto][x] * c.rest[upto][y] + slack * a.norm[x] * c.norm[y]
            keep[s] = maybe(part[s] - far, part[s] + far, x, y)
        ai, ci, part, m = ai[keep], ci[keep], part[keep], upto
    return ai, ci


class Positives:
    """Best same-label rows of a tile's anchors."""

    def __init__(self, ids, labels, bands, k: int):
        self.ids, self.labels, self.k = ids, labels, k
        self.best = Best(len(ids), k)

    def tile(self, lo: int, a: Rotated, c: Rotated, stages, cid, clabel) -> None:
        own, lab = self.ids[lo : lo + len(a.q)], self.labels[lo : lo + len(a.q)]
        least = self.best.least[lo : lo + len(a.q)].copy()

        def maybe(lower, upper, ai, ci):
            if ai is not None:
                return upper >= least[ai]
            ok = (lab[:, None] == clabel[None, :]) & (own[:, None] != cid[None, :])
            if ok.shape[1] > self.k:  # the k-th best lower bound must be reached too
                np.maximum(least, np.partition(np.where(ok, lower, -np.inf), ok.shape[1] - self.k, axis=1)[:, -self.k], out=least)
            return ok & (upper >= least[:, None])

        ai, ci = survivors(a, c, stages, maybe)
        self.best.add(ai + lo, products(a.q, c.q, ai, ci), cid[ci])

    def results(self) -> Iterator[tuple[int, int, list]]:
        for i, (v, m) in _lists(self.best).items():
            yield int(self.ids[i]), 0, [(-int(x), int(y)) for x, y in zip(v, m, strict=True)]


class Negatives:
    """Best other-label rows in each band (lowest, highest score) of a tile's anchors."""

    def __init__(self, ids, labels, bands, k: int):
        self.ids, self.labels = ids, labels
        self.wide = max((len(b) // 2 for b in bands), default=0)
        self.low = np.full((len(ids), self.wide), np.inf)
        self.high = np.full((len(ids), self.wide), -np.inf)
        self.exact = np.zeros((2, len(ids), self.wide), np.int64)
        self.exact[0], self.exact[1] = 1, 0
        for i, b in enumerate(bands):
            n = len(b) // 2
            self.exact[0, i, :n], self.exact[1, i, :n] = b[0::2], b[1::2]
            # a double may round a long: one step outwards keeps every score of the band
            self.low[i, :n], self.high[i, :n] = np.nextafter(np.array(b[0::2], float), -np.inf), np.nextafter(np.array(b[1::2], float), np.inf)
        self.best = Best(len(ids) * self.wide, k)

    def tile(self, lo: int, a: Rotated, c: Rotated, stages, cid, clabel) -> None:
        n = len(a.q)
        lab = self.labels[lo : lo + n]
        low, high = self.low[lo : lo + n], self.high[lo : lo + n]
        least = np.maximum(low, self.best.least.reshape(-1, self.wide)[lo : lo + n])

        def maybe(lower, upper, ai, ci):
            if ai is not None:
                ok = np.zeros(len(ai), bool)
                for j in range(self.wide):
                    ok |= (upper >= least[ai, j]) & (lower <= high[ai, j])
                return ok
            ok = np.zeros(lower.shape, bool)
            for j in range(self.wide):
                ok |= (upper >= least[:, j, None]) & (lower <= high[:, j, None])
            return ok & (lab[:, None] != clabel[None, :])

        ai, ci = survivors(a, c, stages, maybe)
        score = products(a.q, c.q, ai, ci)
        for j in range(self.wide):
            hit = (score >= self.exact[0, ai + lo, j]) & (score <= self.exact[1, ai + lo, j])
            self.best.add((ai[hit] + lo) * self.wide + j, score[hit], cid[ci[hit]])

    def results(self) -> Iterator[tuple[int, int, list]]:
        for s, (v, m) in _lists(self.best).items():
            yield int(self.ids[s // self.wide]), s % self.wide, [(-int(x), int(y)) for x, y in zip(v, m, strict=True)]


def _lists(best: Best) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    own, first = np.unique(best.slot, return_index=True)
    ends = np.append(first, len(best.slot))
    return {int(s): (best.score[ends[i] : ends[i + 1]], best.id[ends[i] : ends[i + 1]]) for i, s in enumerate(own)}


FOUND = "anchor_id long, slot int, found array<struct<loss:bigint, vec_id:bigint>>"


def _search(kind: type, k: int, axes: dict[int, np.ndarray]) -> Callable:
    """Arrow kernel over streams in which each block's anchors are followed by its run's packs."""

    def pack_of(found: Iterator) -> pa.RecordBatch | None:
        got = list(found)
        if not got:
            return None
        ids, slots, lists = zip(*got, strict=True)
        structs = pa.array([[{"loss": x, "vec_id": y} for x, y in r] for r in lists], pa.list_(pa.struct([("loss", pa.int64()), ("vec_id", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(slots, pa.int32()), structs], ["anchor_id", "slot", "found"])

    def run(batches):
        task, tiles, code, at = None, [], {}, None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                dim, ids = row["dim"].as_py(), np.frombuffer(row["ids"].as_py(), np.int64)
                q = _matrix(row["q"].as_py(), dim, len(ids))
                turn, stages = axes.get(dim), stages_of(dim)
                turn = np.eye(dim) if turn is None else turn
                here = (row["block"].as_py(), row["run"].as_py())
                labels = row["labels"].as_py()
                if not row["is_pack"].as_py():
                    if task is not None and (out := pack_of(task.results())) is not None:
                        yield out
                    at, code = here, {}
                    own = np.array([code.setdefault(x, len(code)) for x in labels], np.int64)
                    cut = np.cumsum([0, *row["n_bands"].as_py()])
                    bands = row["bands"].as_py()
                    task = kind(ids, own, [bands[cut[j] : cut[j + 1]] for j in range(len(ids))], k)
                    tiles = [(lo, Rotated(q[lo : lo + TILE], turn, stages)) for lo in range(0, len(ids), TILE)]
                elif here == at:
                    c = Rotated(q, turn, stages)
                    lab = np.array([code.get(x, -1) for x in labels], np.int64)
                    for lo, a in tiles:
                        task.tile(lo, a, c, stages, ids, lab)
        if task is not None and (out := pack_of(task.results())) is not None:
            yield out

    return tidy(run)


def _blocks(anchors: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(packs of anchors with their block, table of blocks for each vector length): blocks are dealt by hash."""
    d = anchors.withColumn("dim", F.size("q"))
    per = d.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))  # as many rows as there are lengths
    d = d.join(F.broadcast(per), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pack = _pack(1 << 30)

    def whole(table: pa.Table) -> pa.Table:
        block = table.column("block")[0]
        out = pa.Table.from_batches(pack([table.combine_chunks().to_batches()[0]]))
        return out.append_column("block", pa.array([block.as_py()], pa.int32()))

    return d.groupBy("dim", "block").applyInArrow(whole, PACKED + ", block int"), per


def _meet(anchors: DataFrame, packs: DataFrame, kind: type, k: int, axes: dict[int, np.ndarray], runs: int, block_rows: int) -> DataFrame:
    """(anchor_id, slot, found): the ``k`` first of each slot over all packs of the anchors' vector length."""
    blocks, per = _blocks(anchors, block_rows)
    asks = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("is_pack", F.lit(False))
    sent = packs.join(F.broadcast(per), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_pack", F.lit(True))
    stream = asks.unionByName(sent.select(asks.columns)).repartition("dim", "block", "run").sortWithinPartitions("dim", "block", "run", "is_pack")
    each = stream.mapInArrow(_search(kind, k, axes), FOUND)
    return each.groupBy("anchor_id", "slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))  # at most ``runs`` lists


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", sample_rows: int = 4096, block_rows: int = BLOCK, runs: int = RUNS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where ``is_anchor`` (over vec_id) holds.  An anchor's
    positives are its first ``positives`` other rows of the same label; for
    each, the first ``negatives`` rows of other labels with low * positive <=
    100 * negative <= high * positive are returned.  First means the larger
    integer inner product of floor(scale * x), then the smaller id.

    Rows with a null id, label or vector or a null or non-finite component
    take no part, nor do vectors so long (2**31 after scaling) that products
    would not fit a long; rows that repeat an id count once, as the smallest
    (label, vector).  Vectors meet vectors of their own length only; empty
    vectors have products 0.  Labels are compared as text.  An anchor without
    positives, or a positive without negatives, has no row; an empty table
    gives an empty one; other columns are ignored.

    The rotation is fitted on ``sample_rows`` rows taken by hash of their ids
    and only decides how early pairs are discarded.
    """
    base = durable(sound_rows(rows, scale, id_col, label_col, vector_col), "hard-rows")
    picked = base.select("vec_id", "q").orderBy(F.xxhash64("vec_id")).limit(sample_rows).toPandas()["q"]
    axes = {int(d): rotation(np.stack(list(x)).astype(float)) for d, x in picked.groupby(picked.map(len)) if d}
    packs = durable(base.select("vec_id", "label", "q").mapInArrow(_pack(PACK), PACKED).withColumn("run", F.pmod(F.xxhash64("ids"), F.lit(runs)).cast("int")), "hard-packs")
    anchors = base.where(is_anchor)
    best = durable(_meet(anchors, packs, Positives, positives, axes, runs, block_rows).select("anchor_id", F.col("found").alias("positives")), "hard-positives")
    # bands of a positive score p: ceil(low p / 100) to floor(high p / 100), without overflow
    score = lambda x: -x["loss"]
    bands = F.flatten(F.transform("positives", lambda x: F.array(-_hundredths(-score(x), low), _hundredths(score(x), high))))
    asked = anchors.join(best, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", bands.alias("bands"))
    found = _meet(asked, packs, Negatives, negatives, axes, runs, block_rows)
    each = best.select("anchor_id", F.posexplode("positives").alias("slot", "p"))
    hits = each.join(found, ["anchor_id", "slot"]).select("anchor_id", "p", F.posexplode("found").alias("at", "n"))
    out = durable(hits.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), (-F.col("p.loss")).alias("positive_score"), (-F.col("n.loss")).alias("negative_score")), "hard-negatives")
    drop_durable(base, packs, best)
    return out


def _hundredths(p: Column, c: int) -> Column:
    """floor(c * p / 100) in whole numbers."""
    rest = F.pmod(p, F.lit(100))
    return F.call_function("div", p - rest, F.lit(100)) * c + F.call_function("div", rest * c, F.lit(100))
