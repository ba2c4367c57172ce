"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is indexed in a leaf.  A
query walks the tree through a priority queue, most promising node first,
and the number of leaves it visits is widened until a calibration on exact
answers reaches the wanted recall.  Only members of visited leaves are scored.

Leaves are packed into shards of bounded rows (a leaf with very many rows is
spread over several).  A member is sent to its shard once, or once for each
block of queries if very many ask there; a query is sent once to each shard
that holds a leaf it visits.  A shard returns one row for each of its queries
with at most ``k`` neighbours, re-scored exactly in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import drop_durable, durable, tidy


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres, ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


class Tree:
    """centres[i] and radius[i] of node i; children[i] (none: a leaf); leaf[i]: the leaf's number or -1."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.radius = [sample.mean(0)], [[]], [-1], [0.0]
        limit = max(1, len(sample) // max(1, leaves))
        todo, self.n_leaves = [(0, sample)], 0
        while todo:
            node, x = todo.pop()
            k = min(branch, -(-len(x) // limit))
            if k > 1:
                centres, own = _kmeans(x, k, rng)
                parts = [(centres[j], x[own == j]) for j in range(k) if (own == j).any()]
            if k <= 1 or len(parts) < 2:  # small, or all of one point
                self.leaf[node], self.n_leaves = self.n_leaves, self.n_leaves + 1
                continue
            for c, part in parts:
                self.centres.append(c)
                self.children.append([])
                self.leaf.append(-1)
                self.radius.append(float(np.sqrt(((part - c) ** 2).sum(1).mean())))
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, part))
        self.centres, self.radius, self.leaf = np.array(self.centres), np.array(self.radius), np.array(self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: nearest child at every level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            c = self.centres[kids]
            own = ((c**2).sum(1)[None, :] - 2 * x[rows] @ c.T).argmin(1)
            todo += [(int(kids[j]), rows[own == j]) for j in np.unique(own)]
        return out

    def visit(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first.

        A node's priority is the inner product with its centre plus what its
        spread may add; a popped node's children are queued, a popped leaf is
        visited.
        """
        out = []
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256]
            score = q @ self.centres.T + np.sqrt((q**2).sum(1))[:, None] * self.radius[None, :] * 0.5
            for row in score:
                heap, got = [(-row[0], 0)], []
                while heap and len(got) < most:
                    _, node = heapq.heappop(heap)
                    if not self.children[node]:
                        got.append(int(self.leaf[node]))
                        continue
                    for c in self.children[node]:
                        heapq.heappush(heap, (-row[c], c))
                out.append(got)
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _distinct_first(mid: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in order of id; of equal vectors only the k + 1 smallest ids, as no others can be among the k nearest."""
    order = np.argsort(mid, kind="stable")
    mid, m = mid[order], np.ascontiguousarray(m[order])
    if len(m) > k + 1:
        _, group = np.unique(m.view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel(), return_inverse=True)
        by = np.argsort(group, kind="stable")
        first = np.concatenate([[True], group[by][1:] != group[by][:-1]])
        nth = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        keep = np.sort(by[nth <= k])
        mid, m = mid[keep], m[keep]
    return mid, m


def _keep_best(r: np.ndarray, mid: np.ndarray, exact: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the scored pairs the k best of each of n queries: largest score, then smallest id."""
    by = np.lexsort((mid, -exact, r))
    r, mid, exact = r[by], mid[by], exact[by]
    first = np.searchsorted(r, np.arange(n))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], mid[keep], exact[keep]


def top_pairs(qid: np.ndarray, q: np.ndarray, mid: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, member id, score) of each query's k largest inner products, ties to the smaller id; a query's own id is left out.

    A matrix product screens; what may be among the k nearest by its error
    bound (which grows with the norms) is scored exactly.  Exact scores are
    sums over one row's products in a fixed order, so that equal vectors tie.
    """
    mid, m = _distinct_first(mid, m, k)
    out = []
    norm = np.sqrt((m**2).sum(1)).max() if len(m) else 0.0
    for at in range(0, len(q), 256):
        ids, part = qid[at : at + 256], q[at : at + 256]
        s = part @ m.T
        s[ids[:, None] == mid[None, :]] = -np.inf
        if s.shape[1] > k:
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            slack = 4e-16 * (m.shape[1] + 2) * np.sqrt((part**2).sum(1)) * norm  # twice the rounding error of either sum
            r, c = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        else:
            r, c = np.nonzero(s > -np.inf)
        exact = np.concatenate([(part[r[i : i + 50_000]] * m[c[i : i + 50_000]]).sum(1) for i in range(0, max(1, len(r)), 50_000)])
        r, best, exact = _keep_best(r, mid[c], exact, len(part), k)
        out.append((r + at, best, exact))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search_leaves(qid: np.ndarray, q: np.ndarray, asked: list[np.ndarray], mid: np.ndarray, m: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like :func:`top_pairs`, but query i meets only members of the leaves ``asked[i]``."""
    asks = np.concatenate(asked) if len(asked) else np.zeros(0, np.int64)
    who = np.repeat(np.arange(len(qid)), [len(x) for x in asked])
    by, order = np.argsort(asks, kind="stable"), np.argsort(leaf, kind="stable")
    asks, who, sorted_leaf = asks[by], who[by], leaf[order]
    found = []
    for one in np.unique(asks):
        rows = who[np.searchsorted(asks, one) : np.searchsorted(asks, one, "right")]
        own = order[np.searchsorted(sorted_leaf, one) : np.searchsorted(sorted_leaf, one, "right")]
        if len(own):
            r, best, exact = top_pairs(qid[rows], q[rows], mid[own], m[own], k)
            found.append((rows[r], best, exact))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _keep_best(*(np.concatenate(x) for x in zip(*found, strict=True)), len(qid), k)


def sound_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) without null ids and vectors that are null, zero or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def search(rows: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 50_000, leaf_rows: int = 128, shard_rows: int = 2048, block_queries: int = 4096, calibrate: int = 200) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row where ``is_query`` (over vec_id) holds.

    Nearness is the largest inner product in double precision, ties go to the
    smaller vec_id, a row is no neighbour of rows of its own id.  Null ids and
    vectors that are null, zero or hold null or non-finite components take no
    part; a vector meets only vectors of its own length (inner products of
    others do not exist): the tree serves the length most frequent in the
    sample, rows of other lengths are searched exactly.  Repeated rows are
    candidates each; with fewer candidates all are returned; an empty table
    gives an empty one; other columns, whatever their names, are ignored.

    The tree is fitted on at most ``sample_rows`` rows, taken by the hash of
    their ids, and has a leaf for every ``leaf_rows`` rows, up to an eighth of
    the sample.  ``calibrate`` rows are answered exactly to set the number of
    leaves visited.
    """
    spark = rows.sparkSession
    base = sound_vectors(rows, id_col, vector_col)
    n = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    step = -(-n // sample_rows)
    picked = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).limit(sample_rows).toPandas()
    if not len(picked):
        picked = base.limit(sample_rows).toPandas()
    dims = picked["v"].map(len)
    dim = int(dims.mode().iloc[0])
    picked = picked[dims == dim].sort_values("vec_id", kind="stable")
    every, base = base, base.where(F.size("v") == dim)
    sample = np.stack(picked["v"].to_numpy()).astype(np.float64)
    tree = Tree(sample, min(max(1, n // leaf_rows), max(1, len(sample) // 8)))
    shared = spark.sparkContext.broadcast(tree)

    def index(batches):
        for b in batches:
            leaf = shared.value.assign(_matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf.astype(np.int32))], ["vec_id", "v", "leaf"])

    indexed = durable(base.mapInArrow(tidy(index), "vec_id long, v array<double>, leaf int"), "ann-index")
    counts = dict(indexed.groupBy("leaf").count().collect())  # at most as many rows as the tree has leaves

    # calibration: exact neighbours of a few rows, and at which visit their leaf is met
    trial = picked.iloc[np.linspace(0, len(picked) - 1, min(calibrate, len(picked))).astype(int)].drop_duplicates("vec_id")
    trial_ids, trial_v = trial["vec_id"].to_numpy(np.int64), np.stack(trial["v"].to_numpy()).astype(np.float64)
    asked = spark.sparkContext.broadcast((trial_ids, trial_v))
    found_type = "query_id long, found array<struct<loss: double, vec_id: bigint, leaf: int>>"

    def packed(qid: np.ndarray, r: np.ndarray, loss: np.ndarray, mid: np.ndarray, leaf: np.ndarray) -> pa.RecordBatch:
        """One row for each query that has pairs; r must be sorted."""
        own, first = np.unique(r, return_index=True)
        ends = np.append(first, len(r)).astype(np.int32) if len(r) else np.zeros(1, np.int32)
        structs = pa.StructArray.from_arrays([pa.array(loss, pa.float64()), pa.array(mid, pa.int64()), pa.array(leaf, pa.int32())], ["loss", "vec_id", "leaf"])
        return pa.RecordBatch.from_arrays([pa.array(qid[own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], ["query_id", "found"])

    def best(found: DataFrame) -> DataFrame:
        """(query_id, found): the k nearest of all a query's rows, of each row at most k being read."""
        return found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))

    def exact(batches):
        ids, v = asked.value
        held = []  # of a task's batches so far
        for b in batches:
            mid, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            r, m, s = top_pairs(ids, v, mid, _matrix(b.column("v"), dim), k)
            at = np.argsort(mid, kind="stable")
            held.append((r, m, s, leaf[at][np.searchsorted(mid[at], m)]))
            r, m, s, leaf = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((m, -s, r))
            first = np.searchsorted(r[by], np.arange(len(ids)))
            by = by[np.arange(len(by)) - first[r[by]] < k]
            held = [(r[by], m[by], s[by], leaf[by])]
        for r, m, s, leaf in held:
            yield packed(ids, r, -s, m, leaf)

    truth = best(indexed.mapInArrow(exact, found_type)).collect()  # at most ``calibrate`` rows
    when = {int(i): {leaf: at for at, leaf in enumerate(order)} for i, order in zip(trial_ids, tree.visit(trial_v, tree.n_leaves), strict=True)}
    met = np.sort([when[t.query_id][x.leaf] for t in truth for x in t.found]) if truth else np.zeros(1, int)
    visits = int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]) + 1

    # shards: leaves packed up to shard_rows; a larger leaf is spread by id
    where, shard, room = {}, -1, 0
    for leaf in range(tree.n_leaves):
        c = counts.get(leaf, 0)
        if not c:
            where[leaf] = (0, 0)
        elif c > shard_rows:
            parts = -(-c // shard_rows)
            where[leaf], shard, room = (shard + 1, parts), shard + parts, 0
        else:
            if c > room:
                shard, room = shard + 1, shard_rows
            where[leaf], room = (shard, 1), room - c
    shards = shard + 1
    place = spark.sparkContext.broadcast(where)

    def ask(batches):
        for b in batches:
            v, w = _matrix(b.column("v"), dim), place.value
            rows_, to, leaves = [], [], []
            for i, visited in enumerate(shared.value.visit(v, visits)):
                by_shard: dict[int, list[int]] = {}
                for leaf in visited:
                    for s in range(w[leaf][0], w[leaf][0] + w[leaf][1]):
                        by_shard.setdefault(s, []).append(leaf)
                rows_ += [i] * len(by_shard)
                to += list(by_shard)
                leaves += list(by_shard.values())
            take = pa.array(rows_, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("v").take(take), pa.array(to, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["vec_id", "v", "shard", "leaves"])

    asks = durable(indexed.where(is_query).select("vec_id", "v").mapInArrow(tidy(ask), "vec_id long, v array<double>, shard int, leaves array<int>"), "ann-asks")
    blocks = {s: -(-c // block_queries) for s, c in asks.groupBy("shard").count().collect()}  # as many rows as there are shards at most
    dealt = spark.sparkContext.broadcast(blocks)

    def send(batches):
        for b in batches:
            mid, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            w, many = place.value, dealt.value
            at = np.array([w[x][0] + (i * 0x9E3779B1 >> 7) % w[x][1] for i, x in zip(mid.tolist(), leaf.tolist(), strict=True)], np.int64)
            copies = np.array([many.get(s, 0) for s in at.tolist()], np.int64)  # a shard nobody asks gets no members
            take = np.repeat(np.arange(len(mid)), copies)
            block = np.arange(len(take)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(take)) for c in ("vec_id", "v", "leaf")), pa.array(at[take], pa.int32()), pa.array(block, pa.int32())], ["vec_id", "v", "leaf", "shard", "block"])

    members = indexed.mapInArrow(tidy(send), "vec_id long, v array<double>, leaf int, shard int, block int")
    each = F.create_map(*(F.lit(x) for s, c in sorted(blocks.items()) if c > 1 for x in (s, c))) if any(c > 1 for c in blocks.values()) else None
    asks = asks.withColumn("block", F.lit(0) if each is None else F.pmod(F.xxhash64("vec_id"), F.coalesce(F.try_element_at(each, F.col("shard")), F.lit(1))).cast("int"))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([packed(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))])
        ids, lists = left.column("vec_id").to_numpy(), left.column("leaves").combine_chunks()
        ends = lists.offsets.to_numpy()
        asked_leaves = np.split(lists.values.to_numpy(), ends[1:-1])
        r, m, s = search_leaves(ids, _matrix(left.column("v"), dim), asked_leaves, right.column("vec_id").to_numpy(), _matrix(right.column("v"), dim), right.column("leaf").to_numpy(), k)
        return pa.Table.from_batches([packed(ids, r, -s, m, np.zeros(len(r), np.int32))])

    found = asks.groupBy("shard", "block").cogroup(members.groupBy("shard", "block")).applyInArrow(near, found_type)
    others = every.where(F.size("v") != dim)
    if others.take(1):
        found = found.unionByName(_other_lengths(others, is_query, k, found_type, packed))
    done = durable(best(found), "ann-found")
    drop_durable(indexed, asks)
    out = done.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.loss")).alias("score"))
    out._lociframe_visits = (visits, tree.n_leaves, shards)
    return out


def _other_lengths(others: DataFrame, is_query: Column, k: int, found_type: str, packed) -> DataFrame:
    """Exact search among vectors of lengths the tree does not serve: each length's blocks of rows meet its queries' blocks."""
    per = others.groupBy(F.size("v").alias("dim")).count().select("dim", F.ceil(F.col("count") / 4096).cast("int").alias("blocks"))
    of = others.withColumn("dim", F.size("v")).join(per, "dim")
    own, each = F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)"), F.expr("explode(sequence(0, blocks - 1))")
    left = of.where(is_query).select("dim", "vec_id", "v", own.alias("i"), each.alias("j"))
    right = of.select(F.col("dim").alias("its_dim"), F.col("vec_id").alias("its_id"), F.col("v").alias("its_v"), each.alias("its_i"), own.alias("its_j"))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            none = np.zeros(0, np.int64)
            return pa.Table.from_batches([packed(none, none, np.zeros(0), none, np.zeros(0, np.int32))])
        dim, ids = a.column("dim")[0].as_py(), a.column("vec_id").to_numpy()
        r, m, s = top_pairs(ids, _matrix(a.column("v"), dim), b.column("its_id").to_numpy(), _matrix(b.column("its_v"), dim), k)
        return pa.Table.from_batches([packed(ids, r, -s, m, np.zeros(len(r), np.int32))])

    return left.groupBy("dim", "i", "j").cogroup(right.groupBy("its_dim", "its_i", "its_j")).applyInArrow(near, found_type)


def brute_force(rows: list[tuple[int, list]], is_query, k: int = 20) -> dict[int, list[int]]:
    """Exact neighbours by the same measure, for tests."""
    ids, v = np.array([i for i, _ in rows], np.int64), np.array([x for _, x in rows], np.float64)
    at = np.array([is_query(i) for i in ids.tolist()], bool)
    q, m, _ = top_pairs(ids[at], v[at], ids, v, k)
    out: dict[int, list[int]] = {}
    for a, b in zip(ids[at][q].tolist(), m.tolist(), strict=True):
        out.setdefault(a, []).append(b)
    return out


__all__ = ["Tree", "brute_force", "search", "top_pairs"]
