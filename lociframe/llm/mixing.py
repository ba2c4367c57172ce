"""Mixing sources to target weights: exact block quotas, split over output shards by a hypergeometric tree.

1.  Weights share the total among sources; no source gives more than
    ``repeats`` times its size, the excess is shared again by weight.
2.  A source's documents fall into ``slots`` blocks by hash.  A mix takes whole
    passes over all blocks and, of one more pass, blocks in permuted order
    that fit what is left of the target; a last block is taken in part, by
    whole documents.  That gives each source a quota of block draws.
3.  A tree splits the vector of quotas over the shards: at each node the left
    half gets a multivariate hypergeometric sample, so shards are random and
    quotas exact.  A shard's draws are a run of the source's permuted blocks,
    disjoint from all others; inside a shard documents are ordered by hash.

Everything is seeded by hashes of values, so reruns and other partitionings
agree.  No task holds more than one source's blocks (``slots``), or one part
of the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scan import ordered_scan
from ._util import drop_durable, durable

SLOTS = 4096


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources ordered by code point, null last, get ``weights`` in turn.  Rounds
    fix the sources that their share would bring over ``repeats`` sizes, until
    none is; each round passes two numbers through the driver.
    """
    rank = ordered_scan(sizes, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], place="rank")
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    d = durable(rank.select("source", "source_size", given.cast("long").alias("weight")), "mix-sources")
    total = d.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    top = F.col("source_size") * repeats
    level, fixed = 0.0, -1
    while True:
        over = top < F.lit(level) * F.col("weight")
        held, count, free = d.agg(F.coalesce(F.sum(F.when(over, top)), F.lit(0)), F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if count == fixed or not free:
            break
        level, fixed = (total - held) / free, count
    return d.withColumn("target", F.least(top.cast("double"), F.lit(level) * F.col("weight")))


def choose(blocks: list[tuple[int, int]], room: float) -> dict[int, int]:
    """What a last pass takes to come near ``room`` words: blocks are (number, words) in permuted order.

    Maps block numbers to -1 (the whole block) or to the words that a block
    taken in part may hold.  Blocks that fit are taken in order; then a block
    is added, given back or exchanged for another as long as that comes
    nearer; at last the smallest left over is taken in part.
    """
    words_of = np.array([0, *(w for _, w in blocks)], np.int64)  # place 0: no block
    inside = np.zeros(len(words_of), bool)
    for i, w in enumerate(words_of[1:].tolist(), 1):
        if 0 < w <= room:
            inside[i], room = True, room - w
    while True:
        give = np.append(0, np.flatnonzero(inside))
        take = np.flatnonzero(~inside)
        take = take[np.argsort(words_of[take], kind="stable")]
        want = words_of[give] + room  # of the block taken in exchange
        near = np.searchsorted(words_of[take], want).clip(0, len(take) - 1)
        pairs = [(abs(room - float(words_of[take[k]] - words_of[g])), int(g), int(take[k])) for g, n in zip(give, near, strict=True) for k in {n, max(0, n - 1)}]
        off, g, t = min(pairs)
        if off >= abs(room):
            break
        inside[[i for i in (g,) if i]], inside[[i for i in (t,) if i]] = False, True
        room -= float(words_of[t] - words_of[g])
    taken = {blocks[i - 1][0]: -1 for i in np.flatnonzero(inside).tolist()}
    left = np.flatnonzero(~inside)[1:]
    left = left[words_of[left] > 0]
    if room >= 1 and len(left):
        taken[blocks[int(left[words_of[left].argmin()]) - 1][0]] = int(room)
    return taken


def split(quota: np.ndarray, shards: int, path: tuple[int, ...], seed: int) -> np.ndarray:
    """Counts (sources x shards) whose rows sum to ``quota``: halves of the shards share a node's draws by a multivariate hypergeometric sample."""
    if shards == 1:
        return quota[:, None]
    left = shards // 2
    total = int(quota.sum())
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *path])))
    share = total * left // shards
    part = rng.multivariate_hypergeometric(quota, share, method="marginals") if total else np.zeros_like(quota)
    return np.concatenate([split(part, left, (*path, 0), seed), split(quota - part, shards - left, (*path, 1), seed)], axis=1)


def _shards(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, draws), the tree in two levels of tasks so that none holds more than about sources x sqrt(shards) counts."""
    wide = int(np.ceil(np.sqrt(shards)))
    ends = np.linspace(0, shards, min(wide, shards) + 1).astype(int)
    spans = [(int(a), int(b - a)) for a, b in zip(ends, ends[1:], strict=False) if b > a]

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_key", kind="stable")
        # shards of a span act as one weight: the spans are shared as if split shard by shard
        counts = _spans(pdf["quota"].to_numpy(np.int64), spans, seed)
        out = [pd.DataFrame({"source_key": pdf["source_key"], "span": k, "quota": counts[:, k]}) for k in range(len(spans))]
        return pd.concat(out)

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_key", kind="stable")
        k = int(pdf["span"].iloc[0])
        first, n = spans[k]
        counts = split(pdf["quota"].to_numpy(np.int64), n, (1, k), seed)
        at, j = np.nonzero(counts)
        return pd.DataFrame({"source_key": pdf["source_key"].to_numpy()[at], "shard": first + j, "draws": counts[at, j]})

    first = quotas.groupBy(F.lit(0).alias("all")).applyInPandas(top, "source_key string, span int, quota long")
    return first.groupBy("span").applyInPandas(below, "source_key string, shard int, draws long")


def _spans(quota: np.ndarray, spans: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Like :func:`split` over spans of several shards each: a node's left half gets draws in proportion to its shards."""

    def node(q: np.ndarray, lo: int, hi: int, path: tuple[int, ...]) -> list[np.ndarray]:
        if hi - lo == 1:
            return [q]
        mid = (lo + hi) // 2
        n, left = sum(s for _, s in spans[lo:hi]), sum(s for _, s in spans[lo:mid])
        total = int(q.sum())
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 0, *path])))
        part = rng.multivariate_hypergeometric(q, total * left // n, method="marginals") if total else np.zeros_like(q)
        return node(part, lo, mid, (*path, 0)) + node(q - part, mid, hi, (*path, 1))

    return np.stack(node(quota, 0, len(spans), ()), axis=1)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, shard_words: int = 1 << 20, seed: int = 13, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(kept columns, source, size, source_size, target, taken, shards): every row of ``docs``.

    ``shards`` has an entry for each time the mix takes the document, the
    number of the output shard; ``taken`` is size times its length.  Null and
    empty texts have size 0; a null source is a source; repeated rows count
    each; without words all targets are 0; an empty table stays empty; other
    columns, whatever their names, are ignored unless named in ``kept``.
    """
    text, own = F.col("text").cast("string"), F.col("source").cast("string")
    # null and text never share a key
    key = F.when(own.isNull(), "n").otherwise(F.concat(F.lit("s"), own))
    d = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], own.alias("source"), key.alias("source_key"), words(text).alias("size"), F.xxhash64(F.lit(seed), *kept, text).alias("hash"))
    d = d.withColumn("slot", F.pmod("hash", F.lit(SLOTS)).cast("int"))
    blocks = durable(d.groupBy("source", "source_key", "slot").agg(F.sum("size").alias("words")), "mix-blocks")
    plan = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats)
    keyed = plan.withColumn("source_key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).drop("source")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["words"].sum()), float(pdf["target"].iloc[0])
        passes = min(repeats, int(target // size)) if size else 0
        out = []
        for k in range(passes):
            out += [(int(s), k, -1) for s in pdf.sort_values([f"order{k}", "slot"])["slot"]]
        if size and passes < repeats:
            last = pdf.sort_values([f"order{passes}", "slot"])
            more = choose([(int(s), int(w)) for s, w in zip(last["slot"], last["words"], strict=True)], target - passes * size)
            out += [(s, passes, limit) for s, limit in more.items()]
        return pd.DataFrame(out, columns=["slot", "pass", "limit"]).assign(at=range(len(out)), source_key=pdf["source_key"].iloc[0])

    each = blocks.join(keyed, "source_key").select("source_key", "slot", "words", "target", *[F.xxhash64(F.lit(seed), F.lit(k), "source_key", "slot").alias(f"order{k}") for k in range(repeats)])
    draws = durable(each.groupBy("source_key").applyInPandas(draw, "slot int, pass int, limit long, at long, source_key string"), "mix-draws")
    total = plan.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    quotas = draws.groupBy("source_key").agg(F.count(F.lit(1)).alias("quota"))
    leaves = _shards(quotas, max(1, int(-(-total // shard_words))), seed)
    upto = F.sum("draws").over(Window.partitionBy("source_key").orderBy("shard"))
    runs = leaves.withColumn("upto", upto).select("source_key", "shard", F.explode(F.sequence(F.col("upto") - F.col("draws"), F.col("upto") - 1)).alias("at"))
    take = draws.join(runs, ["source_key", "at"]).groupBy("source_key", "slot").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "limit"))).alias("takes"))  # a draw a pass at most
    of_slot = each.join(keyed.select("source_key", "source_size"), "source_key").select("source_key", "slot", "source_size", "target").join(take, ["source_key", "slot"], "left")
    d = d.join(of_slot, ["source_key", "slot"])
    # the block that is taken in part: whole documents in the order of their hash
    reach = F.sum("size").over(Window.partitionBy("source_key", "slot").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("reach", reach)
    whole = F.transform(F.filter("takes", lambda t: (t["limit"] < 0) | (F.col("reach") <= t["limit"])), lambda t: t["shard"])
    d = d.withColumn("shards", F.coalesce(whole, F.array().cast("array<int>")))
    return d.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def lay_out(mixed: DataFrame, kept: Sequence[str] = ("doc_id",), seed: int = 13) -> DataFrame:
    """(shard, place, kept columns): the mix itself, each shard's documents in random order.

    A shard is a bounded number of words, so its order is one small sort;
    rows that repeat in it stand in any order, being equal.
    """
    d = mixed.select(*kept, F.posexplode("shards").alias("pass", "shard"))
    by = F.xxhash64(F.lit(seed), "shard", "pass", *kept)
    return d.select("shard", F.row_number().over(Window.partitionBy("shard").orderBy(by, "pass")).alias("place"), *kept)
