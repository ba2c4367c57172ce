"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is a bag of character n-grams (with marks at both ends); the bag's
embeddings are averaged, the words of each window of ``window`` successive
words are averaged, and the windows of a text are averaged once more, weighed
by attention (a softmax of ``sharp`` times their own score).  A linear softmax
over that one mean vector gives the two class scores.  The weights let an
insult in a very long text stand out, yet every window, word and n-gram counts,
for class 1 or against it.  Embeddings and softmax are trained jointly in
numpy; an unseen misspelling or inflection shares most n-gram vectors with
words that were seen.

As all averages are linear, a word's margin (the difference of the two class
scores of its own mean vector) is enough for scoring: window and text means of
vectors and of margins are the same thing.

Training reads a bounded sample of labelled rows (``max_rows`` and
``max_chars`` for each class, in the order of the ids' hashes); scoring reads
every document whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import small_batches, strings, tidy, with_columns

LONGEST = 40  # longer "words" (text without white space) are cut into overlapping pieces


def words_of(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    if words and max(map(len, words)) > LONGEST:
        words = [p for w in words for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)])]
    return words


def subwords(words: list[str], sizes: tuple[int, ...], buckets: int, chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(flat bucket ids, start of each word) for any number of words, in chunks that bound the working memory."""
    parts = [_subwords(words[at : at + chunk], sizes, buckets) for at in range(0, len(words), chunk)]
    counts = np.concatenate([np.diff(p) for _, p in parts]) if parts else np.zeros(0, np.int64)
    ids = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int32)
    return ids, np.concatenate([[0], np.cumsum(counts)])


def _subwords(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat bucket ids, start of each word): hashed n-grams of ``<word>``, and the whole word, computed for all words at once."""
    marked = [f"<{w}>" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(lens), lens)
    owner = np.repeat(np.arange(len(words)), lens)
    here = np.arange(len(code))
    ids, who = [], []
    k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def put(h, n, at):
        h = (h ^ (h >> np.uint64(29))) * k2 + np.uint64(n)
        ids.append(((h ^ (h >> np.uint64(32))) * k1 >> np.uint64(40)) % np.uint64(buckets))
        who.append(owner[at])

    h, top = code * k1, max(sizes)
    for n in range(2, top + 1):
        if n > len(code):
            break
        h = (h[: len(code) - n + 1] ^ (h[: len(code) - n + 1] >> np.uint64(31))) * k2 + code[n - 1 :] * k1
        if n in sizes:
            at = np.flatnonzero(here[: len(h)] + n <= end[: len(h)])
            put(h[at], n, at)
    # the whole word: sum of its codes' position-dependent hashes
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = (here - np.repeat(starts, lens)).astype(np.uint64)
    mixed = (code + place * k1) * k2
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(27)), starts) if len(words) else np.zeros(0, np.uint64)
    put(whole, 99, starts)
    ids, who = np.concatenate(ids), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    counts = np.bincount(who, minlength=len(words))
    return ids[order].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def window_means(z: np.ndarray, window: int) -> np.ndarray:
    """Mean over every run of ``window`` values (over all, if there are fewer)."""
    w = min(window, len(z))
    if w <= 1:
        return z
    c = np.concatenate([[0.0], np.cumsum(z)])
    return (c[w:] - c[:-w]) / w


@dataclass
class ToxicityModel:
    """Trained parameters; ``logits`` gives the margin of class 1 for each word of a list."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    sizes: tuple[int, ...]
    window: int
    sharp: float

    def logits(self, words: list[str]) -> np.ndarray:
        """Margin of each word: its n-grams' mean vector times the difference of the two class weights."""
        if not words:
            return np.zeros(0)
        ids, ptr = subwords(words, self.sizes, len(self.embeddings))
        gram = self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])
        return np.add.reduceat(gram[ids].astype(float), ptr[:-1]) / np.diff(ptr)

    def margin(self, values: np.ndarray) -> float:
        """Margin of a text from its words' margins in order: bias plus the attention-weighted mean of its windows."""
        bias = float(self.bias[1] - self.bias[0])
        if not len(values):
            return bias
        z = window_means(values, self.window)
        a = np.exp(self.sharp * (z - z.max()))
        return bias + float((a * z).sum() / a.sum())


def train(texts: list[str | None], labels: list[int], sizes=(3, 4, 5), buckets: int = 1 << 17, dim: int = 8, window: int = 3, sharp: float = 8.0, epochs: int = 50, rate: float = 0.08, decay: float = 3e-4, floor: float = 1e-2, least: int = 4, positive: float = 0.25, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax together by full-batch Adam.

    In the first third of the epochs the attention sharpens slowly from
    nearly flat, so that evidence common to many texts is found before any one
    text's words are learnt by heart.  N-grams in fewer than ``least`` texts
    are left out; ``positive`` is the weight of class 1 as a whole.  With one
    class only, or no words at all, the score is that class's share.
    """
    index: dict[str, int] = {}
    each = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    lens = np.array(list(map(len, each)), np.int64)
    flat = np.concatenate(each) if each else np.zeros(0, np.int32)
    del each
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((buckets, dim)) * 0.05).astype(np.float32)
    soft = (rng.standard_normal((dim, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    y = np.array(labels, np.float32)
    has = lens > 0
    if not has.any() or len(set(labels)) < 2:
        rate_1 = float(y.mean()) if len(y) else 0.0
        bias[1] = np.log(max(rate_1, 1e-6) / max(1 - rate_1, 1e-6))
        return ToxicityModel(emb * 0, soft, bias, tuple(sizes), window, sharp)
    ids, ptr = subwords(list(index), tuple(sizes), buckets)
    n_sub = np.diff(ptr)
    by_word = np.repeat(np.arange(len(index), dtype=np.int32), n_sub)
    doc_of = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    in_docs = np.bincount(np.unique(flat.astype(np.int64) * len(lens) + doc_of) // len(lens), minlength=len(index))
    del doc_of
    seen = np.bincount(ids, weights=in_docs[by_word], minlength=buckets)
    keep = seen[ids] >= least
    used = np.flatnonzero(np.bincount(ids[keep], minlength=buckets))
    place = np.zeros(buckets, np.int32)
    place[used] = np.arange(len(used))
    local, by_word = place[ids[keep]], by_word[keep]
    del ids, keep
    e = emb[used]
    weight = np.where(y == 1, positive / max(1, y.sum()), (1 - positive) / max(1, (1 - y).sum()))[has]
    y_has = y[has]
    # windows: from each word to the one ``width - 1`` places on, inside its text
    first_word = np.concatenate([[0], np.cumsum(lens)[:-1]])[has]
    n_words = lens[has]
    width = np.minimum(window, n_words)
    n_win = n_words - width + 1
    first = np.concatenate([[0], np.cumsum(n_win)[:-1]])
    at = np.repeat(np.arange(len(n_win), dtype=np.int32), n_win)
    begin = (np.arange(len(at)) - first[at] + first_word[at]).astype(np.int32)
    wide = width[at].astype(np.int32)
    params, state = [e, soft, bias], [[np.zeros_like(p), np.zeros_like(p)] for p in (e, soft, bias)]
    warm = max(1, epochs // 3)
    for step in range(1, epochs + 1):
        diff = soft[:, 1] - soft[:, 0]
        gram = e @ diff  # the average over a bag and the softmax commute: one number for each n-gram is enough
        z_word = np.bincount(by_word, weights=gram[local], minlength=len(index)) / n_sub
        total = np.concatenate([[0.0], np.cumsum(z_word[flat])])
        z = (total[begin + wide] - total[begin]) / wide
        now = sharp * min(1.0, 16 ** (step / warm - 1))
        top = np.maximum.reduceat(z, first)
        a = np.exp(now * (z - top[at]))
        a /= np.add.reduceat(a, first)[at]
        pooled = np.add.reduceat(a * z, first)
        p = 1 / (1 + np.exp(-np.clip(pooled + bias[1] - bias[0], -30, 30)))
        g_doc = (p - y_has) * weight
        g = a * (1 + now * (z - pooled[at])) * g_doc[at] / wide  # through the weights, too
        back = np.bincount(begin, weights=g, minlength=len(flat) + 1) - np.bincount(begin + wide, weights=g, minlength=len(flat) + 1)
        g_word = np.bincount(flat, weights=np.cumsum(back)[:-1], minlength=len(index)) / n_sub
        g_gram = np.bincount(local, weights=g_word[by_word], minlength=len(used))
        g_diff = g_gram @ e
        gb = float(g_doc.sum())
        grads = [g_gram[:, None] * diff[None, :] + decay * e, np.stack([-g_diff, g_diff], axis=1) + decay * soft, np.array([-gb, gb])]
        for q, gr, s in zip(params, grads, state, strict=True):
            gr = gr.astype(np.float32) * 1e3  # Adam does not mind the scale; its epsilon does
            s[0] += 0.1 * (gr - s[0])
            s[1] += 0.01 * (gr * gr - s[1])
            q -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + floor)
    emb *= 0  # n-grams never seen in training say nothing
    emb[used] = e
    return ToxicityModel(emb, soft, bias, tuple(sizes), window, sharp)


def labelled_sample(docs: DataFrame, labels: DataFrame, rule: Column, max_rows: int = 2500, max_chars: int = 4_000_000, label: str = "toxic") -> pd.DataFrame:
    """(doc_id, y, text): labelled texts for which ``rule`` (over doc_id) holds, bounded for each class.

    Of each class at most ``max_rows`` ids are looked at, in the order of
    their hashes, so the sample does not depend on partitioning; of these,
    texts are taken whole, those that would exceed ``max_chars`` characters in
    all being skipped (the shortest is always taken).  Only lengths reach the
    driver before that choice.
    """
    marked = with_columns(labels, doc_id="long", **{label: "int"}).where(rule & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max(label).alias("y"))  # a document marked twice
    parts = [marked.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.y, k) for k, r in enumerate(parts[0].union(parts[1]).collect())], "doc_id long, y int, nth int")
    texts = with_columns(docs, doc_id="long", text="string")
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "nth").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).collect()  # at most 2 * max_rows ids
    take = []
    for c in (0, 1):
        own, used = sorted((r.nth, r.n, r.doc_id) for r in sizes if r.y == c), 0
        for _, n, i in own:
            if used + n <= max_chars:
                take.append((i, c))
                used += n
        if own and not any(y == c for _, y in take):
            take.append((min((n, nth, i) for nth, n, i in own)[2], c))
    picked = texts.join(F.broadcast(spark.createDataFrame(take, "doc_id long, y int")), "doc_id").select("doc_id", "y", F.col("text").cast("binary").alias("text"))
    out = picked.toPandas()
    out["text"] = [None if t is None else bytes(t).decode("utf-8", "replace") for t in out["text"]]
    return out.drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"], kind="stable", na_position="first")


def fit(docs: DataFrame, labels: DataFrame, rule: Column, max_rows: int = 2500, max_chars: int = 4_000_000, **options) -> ToxicityModel:
    sample = labelled_sample(docs, labels, rule, max_rows, max_chars)
    return train(list(sample["text"]), list(sample["y"]), **options)


def score(docs: DataFrame, model: ToxicityModel, memo: int = 100_000) -> DataFrame:
    """``docs`` with a column toxicity (0 to 1); a column of that name is replaced, others are kept.

    Null and empty texts get the bias's score.  Rows are scored one by one, so
    repeated rows and equal texts have equal scores; an empty table gives an
    empty one; bytes that are no UTF-8 count as U+FFFD; texts of any length
    are read whole.  Each word's margin is computed once and remembered (at
    most ``memo`` words a task); nothing is shuffled.  The model is broadcast;
    its size is fixed by its buckets and dimensions.
    """
    if "text" not in docs.columns:
        raise ValueError("missing columns: text")
    docs = docs.drop("toxicity").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        m, known = shared.value, {}
        for b in small_batches(batches, "text", 1 << 20):
            texts = [words_of(t) for t in strings(b.column("text"))]
            new = set().union(*texts).difference(known)
            if len(known) + len(new) > memo:
                known.clear()
                new = set().union(*texts)
            new = list(new)
            known.update(zip(new, m.logits(new).tolist(), strict=True))
            get = known.__getitem__
            z = np.array([m.margin(np.fromiter(map(get, t), float, len(t))) for t in texts])
            out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(out)], [*names, "toxicity"])

    from pyspark.sql import types as T

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))
