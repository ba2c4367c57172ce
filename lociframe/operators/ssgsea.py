"""Single-sample enrichment: scores in closed form and permutations by windows and joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import _validate as check
from .._shared import written
from ..functions.columns import average_rank
from ..functions.draws import DIGITS, below, digits
from .scan import ordered_scan


def normalize(expr: DataFrame, how: str = "rank") -> DataFrame:
    """(gene, sample, value) with each sample's values as they are, ranked, log-ranked or logged."""
    check.choice(how, ("none", "rank", "log.rank", "log"), "how")
    v = F.col("value").cast("double")
    if how == "none":
        return expr.select("gene", "sample", v.alias("value"))
    if how == "log":
        return expr.select("gene", "sample", F.log(F.greatest(v, F.lit(1.0)) + F.exp(F.lit(1.0))).alias("value"))
    rank = 10000 * F.floor(average_rank("value", ["sample"])) / F.count(F.lit(1)).over(Window.partitionBy("sample"))
    return expr.select("gene", "sample", (rank if how == "rank" else F.log(rank + F.exp(F.lit(1.0)))).cast("double").alias("value"))


def sizes_within(gene_sets: DataFrame, expr: DataFrame, min_sz: int = 1, max_sz: int | None = None) -> DataFrame:
    """(set, item): members that the expression table has, of the sets whose size fits."""
    genes = expr.select(F.col("gene").alias("item")).distinct()
    d = gene_sets.select("set", "item").distinct().join(genes, "item", "left_semi")
    n = F.count(F.lit(1)).over(Window.partitionBy("set"))
    d = d.withColumn("_n", n).where(F.col("_n") >= min_sz)
    return (d.where(F.col("_n") <= max_sz) if max_sz else d).select("set", "item")


def ranked(expr: DataFrame) -> DataFrame:
    """Position of each gene in its sample by descending value (ties by gene) and the number of genes."""
    w = Window.partitionBy("sample")
    return expr.withColumn("pos", F.row_number().over(w.orderBy(F.desc("value"), "gene"))).withColumn("n", F.count(F.lit(1)).over(w))


def enrichment_scores(expr: DataFrame, gene_sets: DataFrame, weight: float = 0.75) -> DataFrame:
    """(set, sample, ES): weighted mean place of the members less the mean place of the others, counted from the end."""
    d = ranked(expr).join(gene_sets, F.col("gene") == F.col("item"))
    w, back = F.pow(F.abs(F.col("value")), F.lit(weight)), F.col("n") - F.col("pos") + 1
    g = d.groupBy("set", "sample").agg(F.sum(w * back).alias("wb"), F.sum(w).alias("w"), F.sum(back).cast("double").alias("b"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    es = F.col("wb") / F.nullif(F.col("w"), F.lit(0.0)) - (F.col("n") * (F.col("n") + 1) / 2 - F.col("b")) / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    return g.select("set", "sample", es.alias("ES"))


def run_ssgsea(expr: DataFrame, gene_sets: DataFrame, perm: int = 0, sample_norm_type: str = "rank", weight: float = 0.75, min_sz: int = 1, max_sz: int | None = None, pvalue_basis: str = "nes", seed: int = 1) -> DataFrame:
    """(set, sample, ES[, NES, pvalue]).

    With ``perm`` the members' places are redrawn; NES is the score over the
    mean of permuted scores of its sign.  The p-value compares permuted scores
    with NES ("nes") or with ES ("es").

    Permutation p orders the places of a list by the draws of (seed, p,
    place); a set of k members takes the first k places that its sample has.
    So one order serves all sets and samples, and a sample that lacks the last
    few places looks that much further: of each order only the first max(k) +
    (longest - shortest list) places are ever needed.
    """
    check.choice(pvalue_basis, ("nes", "es"), "pvalue_basis")
    e = normalize(expr, sample_norm_type)
    if perm > 0:
        e = written(e, "normalized")
    sets = sizes_within(gene_sets, e, min_sz, max_sz)
    es = enrichment_scores(e, sets, weight)
    if perm < 1:
        return es
    size = written(sets.groupBy("set").agg(F.count(F.lit(1)).alias("k")), "set-sizes")
    todo = written(es.join(size, "set"), "scores")
    null = null_scores(e, size.select("k").distinct(), perm, weight, seed)
    # three passes over (set, sample, permutation): the mean of each side, then the counts beyond
    both = todo.join(null, ["sample", "k"])
    up = F.col("null") >= 0
    side = both.groupBy("set", "sample").agg(F.avg(F.when(up == (F.col("ES") >= 0), F.col("null"))).alias("mean"), F.count(F.when(up, 1)).alias("n_up"), F.count(F.when(~up, 1)).alias("n_down"))
    scored = todo.join(side, ["set", "sample"], "left").withColumn("NES", F.col("ES") / F.nullif(F.abs("mean"), F.lit(0.0)))
    beyond = scored.join(null, ["sample", "k"]).groupBy("set", "sample").agg(F.count(F.when(F.when(F.col("NES") >= 0, F.col("null") >= _basis(pvalue_basis)).otherwise(F.col("null") <= _basis(pvalue_basis)), 1)).alias("n"))
    out = scored.join(beyond, ["set", "sample"], "left")
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.when(F.col("NES") >= 0, F.col("n_up")).otherwise(F.col("n_down")) + 1)
    return out.select("set", "sample", "ES", "NES", F.when(F.col("NES").isNotNull(), p).alias("pvalue"))


def _basis(name: str) -> Column:
    return F.col("NES" if name == "nes" else "ES")


SUMS = 2_000_000  # numbers (permutations x samples x set sizes) that a task may hold


def null_scores(expr: DataFrame, sizes: DataFrame, perm: int, weight: float = 0.75, seed: int = 1, sums: int = SUMS) -> DataFrame:
    """(sample, k, perm_id, null): scores of random sets of each size, from one order of places a permutation."""
    bounds = expr.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("longest"), F.min("n").alias("shortest")).crossJoin(sizes.agg(F.max("k").alias("k"))).first()  # one row
    if bounds["longest"] is None or bounds["k"] is None:
        return expr.select("sample", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("perm_id"), F.lit(0.0).alias("null")).limit(0)
    longest, most = bounds["longest"], min(bounds["longest"], bounds["k"] + bounds["longest"] - bounds["shortest"])
    first = first_places(expr, longest, most, perm, seed)
    w = F.pow(F.abs(F.col("value")), F.lit(weight))
    values = written(ranked(expr).select("sample", "pos", "n", w.alias("w")), "places")
    n_sizes = sizes.distinct().count()
    lengths = values.groupBy("sample").agg(F.max("n").alias("n")).limit(max(1, sums // (perm * n_sizes)) + 1).collect()  # so many samples at most
    if len(lengths) * perm * n_sizes <= sums:
        return written(_segment_sums(first, values, sizes, sorted(map(tuple, lengths), key=str), perm), "null")
    d = first.join(values.withColumn("back", (F.col("n") - F.col("pos") + 1).cast("double")), "pos")
    own = Window.partitionBy("sample", "perm_id").orderBy("i")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"k": F.row_number().over(own).cast("long"), "swb": F.sum(F.col("w") * F.col("back")).over(upto), "sw": F.sum("w").over(upto), "sb": F.sum("back").over(upto)})
    score = F.col("swb") / F.nullif(F.col("sw"), F.lit(0.0)) - (F.col("n") * (F.col("n") + 1) / 2 - F.col("sb")) / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    return written(d.join(F.broadcast(sizes), "k").select("sample", "k", "perm_id", score.alias("null")), "null")  # as many rows as there are set sizes


def first_places(expr: DataFrame, longest: int, most: int, perm: int, seed: int, margin: float = 6.0) -> DataFrame:
    """(perm_id, pos, i): the first ``most`` of the places 1 to ``longest`` in the order of each permutation.

    The places are made by ``range``, a literal sequence would be built on the
    driver.  The first ``most`` hardly ever lie above (most + ``margin`` *
    sqrt(most) + 16) / longest, so only lower draws move; a permutation that
    then lacks places is ordered whole.
    """
    spark = expr.sparkSession
    tasks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = spark.range(1, longest + 1, numPartitions=tasks).select(F.col("id").alias("pos"))
    perms = spark.range(perm).select(F.col("id").alias("perm_id"))

    def first(perms, top):
        d = places.crossJoin(F.broadcast(perms))  # a row for each permutation
        h = digits(seed, F.col("perm_id"), F.col("pos"))
        d = d.where(h <= top).select("perm_id", "pos", F.conv(h, 16, 10).cast("long").alias("u"))
        order = Window.partitionBy("perm_id").orderBy("u", "pos")
        return d.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).select("perm_id", "pos", "i")

    out = written(first(perms, below((most + margin * math.sqrt(most) + 16) / longest)), "first-places")
    short = written(perms.join(out.groupBy("perm_id").count(), "perm_id", "left").where(F.coalesce("count", F.lit(0)) < most).select("perm_id"), "short-orders")
    if not short.take(1):
        return out
    return written(out.join(F.broadcast(short), "perm_id", "left_anti").unionByName(first(short, "g" * DIGITS)), "first-places")


def _segment_sums(first: DataFrame, values: DataFrame, sizes: DataFrame, lengths: list, perm: int) -> DataFrame:
    """(sample, k, perm_id, null) from sums over the places between one size and the next, added up where the places lie.

    Where a sample's first k places end in an order follows from the few
    places that some sample lacks; these cuts (permutations x lengths x sizes)
    go to every task.
    """
    spark = first.sparkSession
    ks = np.array(sorted(r[0] for r in sizes.distinct().collect()))
    names, n_of = [r[0] for r in lengths], np.array([r[1] for r in lengths])
    ns, which = np.unique(n_of, return_inverse=True)
    s, nk = len(names), len(ks)

    def cut(key, pdf):
        pdf = pdf.sort_values("i")
        i, pos = pdf["i"].to_numpy(), pdf["pos"].to_numpy()
        rows = []
        for n in ns:
            late = i[pos > n]
            rows.append(ks + np.searchsorted(late - np.arange(1, len(late) + 1), ks, "left"))
        return pd.DataFrame({"perm_id": [key[0]], "cut": [np.concatenate(rows)]})

    cuts = np.tile(np.tile(ks, len(ns)), (perm, 1))
    for r in first.where(F.col("pos") > int(ns[0])).groupBy("perm_id").applyInPandas(cut, "perm_id long, cut array<long>").toLocalIterator():
        cuts[r["perm_id"]] = r["cut"]
    far = int(cuts.max()) + 1 + int(n_of.max())
    flat = (cuts.reshape(perm, len(ns), nk).transpose(1, 0, 2) + np.arange(perm)[None, :, None] * far).reshape(len(ns), -1)  # ascending for each length
    shared = spark.sparkContext.broadcast(flat)

    def add(rows, total):
        at, i, pos, w = (np.concatenate(c) for c in zip(*rows, strict=True))
        for c in range(s):
            has = pos <= n_of[c]
            k = np.searchsorted(shared.value[which[c]], at[has] * far + i[has], "left") - at[has] * nk
            here = k < nk
            slot, x, back = (at[has] * nk + k)[here], w[has, c][here], (n_of[c] - pos[has] + 1.0)[here]
            for j, v in enumerate((x * back, x, back)):
                total[c, j] += np.bincount(slot, v, perm * nk)

    def run(batches):
        total, rows, held = np.zeros((s, 3, perm * nk)), [], 0
        for b in batches:
            if b.num_rows:
                w = b.column("w").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, s)
                rows.append((b.column("perm_id").to_numpy(), b.column("i").to_numpy().astype(np.int64), b.column("pos").to_numpy(), w))
                held += b.num_rows
            if held > max(20_000, 2_000_000 // s):
                add(rows, total)
                rows, held = [], 0
        if rows:
            add(rows, total)
        each = total.reshape(s, 3, perm, nk).transpose(2, 0, 1, 3).reshape(perm, -1)
        for p in range(0, perm, 100):
            part = each[p : p + 100]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p, p + len(part))), lists], ["perm_id", "sums"])

    def solve(key, pdf):
        swb, sw, sb = np.cumsum(np.sum(pdf["sums"].to_list(), axis=0).reshape(s, 3, nk), axis=2).transpose(1, 0, 2)
        n = n_of[:, None].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(sw == 0, np.nan, swb / sw) - np.where(n == ks, np.nan, (n * (n + 1) / 2 - sb) / (n - ks))
        a, b = np.nonzero(ks[None, :] <= n)  # a sample has no more places than its length
        return pd.DataFrame({"number": a, "k": ks[b], "perm_id": key[0], "null": pd.array(score[a, b], dtype="Float64")})

    cells = values.withColumn("sample", F.col("sample").cast("string")).groupBy("pos").pivot("sample", [str(x) for x in names]).agg(F.first("w"))
    wide = cells.select("pos", F.array(*[F.col("`" + c.replace("`", "``") + "`") for c in cells.columns[1:]]).alias("w"))
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # each gives sums of every permutation
    met = first.repartition(tasks, "pos").join(wide.repartition(tasks, "pos").hint("shuffle_hash"), "pos").select("perm_id", "i", "pos", "w")
    parts = met.mapInArrow(run, "perm_id long, sums array<double>")
    null = parts.groupBy("perm_id").applyInPandas(solve, "number long, k long, perm_id long, null double")
    table = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"number long, sample {dict(values.dtypes)['sample']}")
    return null.join(F.broadcast(table), "number").select("sample", "k", "perm_id", F.when(~F.isnan("null"), F.col("null")).alias("null"))


def running_score(values: DataFrame, members: DataFrame, exponent: float = 1.0) -> DataFrame:
    """Plot-ready running enrichment of one ranked list: (item, value, x, position, running_score, colour).

    ``values`` is (item, value), ``members`` has item.  colour: 1 to 10 for the
    bar under the curve, by the share of members still to come.
    """
    d = values.join(members.select("item").distinct().withColumn("_m", F.lit(1)), "item", "left").withColumn("position", F.coalesce("_m", F.lit(0)))
    hit = F.when(F.col("position") == 1, F.pow(F.abs("value"), F.lit(exponent))).otherwise(0.0)
    miss = F.when(F.col("position") == 0, 1.0).otherwise(0.0)
    d = ordered_scan(d, [-F.col("value"), F.col("item")], {"_hit": hit, "_miss": miss, "_in": F.col("position").cast("long")}, place="x")
    score = F.try_divide(F.col("_hit"), F.col("_hit_total")) - F.try_divide(F.col("_miss"), F.col("_miss_total"))
    left = F.col("_in_total") - F.col("_in") + F.col("position")
    colour = F.width_bucket(left.cast("double"), F.lit(1.0), F.greatest(F.col("_in_total").cast("double"), F.lit(2.0)), F.lit(8))
    return d.select("item", "value", F.col("x").cast("int").alias("x"), "position", score.alias("running_score"), (F.when(left == F.col("_in_total"), 9).otherwise(colour) + 1).cast("int").alias("colour"))
