"""Substitution contexts on chunked reference sequences: signatures, size factors, motif enrichment.

A genome is a table of chunks (chr, chunk_start, seq), 1-based.  Positions
find their chunk by an equi-join on (chr, chunk number); chunks overlap their
neighbours by ``margin`` bases so that a context never crosses an edge.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import _validate as check
from ..functions.columns import reverse_complement
from .reshape import dense_counts

BASES = "ACGT"
# fixed values: the six pyrimidine substitutions, in the order of the classes
STANDARD = ("T>C", "C>T", "T>A", "T>G", "C>A", "C>G")


def complement_sub(sub: str) -> str:
    return sub.translate(str.maketrans("ACGT", "TGCA"))


def standard_sub(ref: Column, alt: Column) -> Column:
    """ref>alt with a pyrimidine reference."""
    swap = ref.isin("A", "G")
    comp = lambda x: F.translate(x, "ACGT", "TGCA")
    return F.when(swap, F.concat(comp(ref), F.lit(">"), comp(alt))).otherwise(F.concat(ref, F.lit(">"), alt))


def contexts(middle: list[str], extension: int = 1) -> list[str]:
    """All contexts round ``middle``; the first position varies fastest."""
    parts = [list(BASES)] * extension + [middle] + [list(BASES)] * extension
    return ["".join(reversed(p)) for p in product(*reversed(parts))]


def substitution_contexts(extension: int = 1, standard: bool = True) -> list[str]:
    subs = list(STANDARD) if standard else [s for t in STANDARD for s in (complement_sub(t), t)]
    return contexts([f"[{s}]" for s in subs], extension)


def chunk_genome(seq: DataFrame, width: int = 10_000, margin: int = 25) -> DataFrame:
    """(chr, chunk, chunk_start, seq, length) from (chr, seq): chunks of ``width`` bases with ``margin`` more at either end.

    A sequence is cut in one pass; the chunks, not the sequence, travel on.
    """

    def run(batches):
        for b in batches:
            for chrom, text in zip(b.column("chr").to_pylist(), b.column("seq").to_pylist(), strict=True):
                n = len(text)
                firsts = [max(0, at - margin) for at in range(0, n, width)]
                for at in range(0, len(firsts), 1000):
                    part = range(at, min(at + 1000, len(firsts)))
                    cut = [text[firsts[k] : (k + 1) * width + margin] for k in part]
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(cut), pa.string()), pa.array(part, pa.int64()), pa.array([firsts[k] + 1 for k in part], pa.int64()), pa.array(cut, pa.string()), pa.array([n] * len(cut), pa.int64())], names)

    names = ["chr", "chunk", "chunk_start", "seq", "length"]
    return seq.select(F.col("chr").cast("string").alias("chr"), "seq").where(F.length("seq") > 0).mapInArrow(run, "chr string, chunk long, chunk_start long, seq string, length long")


def with_context(mut: DataFrame, genome: DataFrame, extension: int = 1, background: int | None = None, width: int = 10_000, chr_field: str = "chr", pos_field: str = "pos", ref_field: str = "ref", alt_field: str = "alt") -> DataFrame:
    """Single-base substitutions with their reference context (and background window).

    Rows whose alleles are not single bases, that lie outside the sequence,
    whose context (or window) leaves it or whose reference base differs from
    the genome are dropped.
    """
    check.columns(mut, [chr_field, pos_field, ref_field, alt_field], "mut")
    reach = max(extension, background or 0)
    ok = F.col(ref_field).isin(*BASES) & F.col(alt_field).isin(*BASES) & (F.col(ref_field) != F.col(alt_field))
    m = mut.where(ok).withColumn("_chunk", F.floor((F.col(pos_field) - 1) / width).cast("long"))
    g = genome.select(F.col("chr").alias("_chr"), F.col("chunk").alias("_chunk_no"), F.col("chunk_start").alias("_from"), F.col("seq").alias("_seq"), F.col("length").alias("_length"))
    d = m.join(g, (F.col(chr_field) == F.col("_chr")) & (F.col("_chunk") == F.col("_chunk_no")))
    at = (F.col(pos_field) - F.col("_from") + 1).cast("int")
    d = d.where((F.col(pos_field) - reach >= 1) & (F.col(pos_field) + reach <= F.col("_length")) & (F.substring(F.col("_seq"), at, F.lit(1)) == F.col(ref_field)))
    cut = lambda k: F.substring(F.col("_seq"), at - k, F.lit(2 * k + 1))
    d = d.withColumn("context", cut(extension))
    if background is not None:
        d = d.withColumn("background", cut(background))
    return d.drop("_chunk", "_chr", "_chunk_no", "_from", "_seq", "_length")


def snv_class(context: Column, ref: Column, alt: Column, extension: int = 1) -> Column:
    """5'[R>A]3' with a pyrimidine reference; purine contexts are reverse-complemented."""
    c = F.when(ref.isin("A", "G"), reverse_complement(context)).otherwise(context)
    return F.concat(F.substring(c, 1, extension), F.lit("["), standard_sub(ref, alt), F.lit("]"), F.substring(c, extension + 2, extension))


def snv_signature(mut: DataFrame, genome: DataFrame, sample_field: str | None = None, extension: int = 1, factors: DataFrame | None = None, **fields) -> DataFrame:
    """(snv_class, sample, n[, value]) for every class; value = n times the size factor of the class's context."""
    d = with_context(mut, genome, extension, **fields)
    ref, alt = F.col(fields.get("ref_field", "ref")), F.col(fields.get("alt_field", "alt"))
    d = d.select(*([sample_field] if sample_field else []), snv_class(F.col("context"), ref, alt, extension).alias("snv_class"))
    out = dense_counts(d, "snv_class", substitution_contexts(extension), sample_field).drop("_order")
    if factors is not None:
        f = factors.select(F.col("context").alias("_context"), "factor")
        plain = F.regexp_replace("snv_class", r"\[([ACGT])>[ACGT]\]", "$1")
        out = out.join(F.broadcast(f), plain == F.col("_context"), "left").withColumn("value", F.col("n") * F.col("factor")).drop("_context", "factor")
    return out


def prepare_snv_signature(mut: DataFrame, genome: DataFrame, sample_field: str | None = None, extension: int = 1, method: str | None = None, contigs: list[str] | None = None, exome: DataFrame | None = None, **fields) -> DataFrame:
    """:func:`snv_signature` with the size factors of ``method`` (genome, exome, exome2genome, genome2exome; None: counts only), computed here."""
    if method is None:
        return snv_signature(mut, genome, sample_field, extension, **fields)
    middle = contexts(["T", "C"], extension)
    return snv_signature(mut, genome, sample_field, extension, context_sizefactor(middle, genome, exome, method, contigs), **fields)


def _chunk_kmers(k: int, width: int):
    """Arrow kernel: (context, n, inside) of the k-mers that start in each chunk's own part, added up by batch.

    ``inside`` counts those that lie wholly in a clip (from, to) of their
    chunk.  The bytes of many chunks are counted as one array.
    """

    def run(batches):
        code = np.full(256, -1, np.int64)
        code[list(BASES.encode())] = range(4)
        rows = max(1, (1 << 22) // (2 * width))  # so that arrays stay at some megabytes
        for whole in batches:
            total: dict[int, list[int]] = {}
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                seq = b.column("seq").cast(pa.large_string())
                if pc.sum(pc.binary_length(seq)).as_py() != pc.sum(pc.utf8_length(seq)).as_py():
                    seq = pc.replace_substring_regex(seq, "[^\x00-\x7f]", "N")
                size = pc.binary_length(seq).to_numpy(zero_copy_only=False)
                x = code[np.frombuffer("".join(seq.to_pylist()).encode("ascii"), np.uint8)]
                m = len(x) - k + 1
                if m < 1:
                    continue
                start, length, own = b.column("chunk_start").to_numpy(), b.column("length").to_numpy(), b.column("chunk").to_numpy() * width + 1
                base = np.cumsum(size) - size - start  # adds to a position to give a place in x
                end = np.minimum(own + width, length - k + 2)
                if np.any(np.maximum(end, own) + k - 2 > np.maximum(start + size - 1, own + k - 2)):
                    raise ValueError(f"the chunks' margin is too small for {k} bases")
                opened = _marked(base + own, base + end, m)
                clips = b.column("clips")
                parent, clip = pc.list_parent_indices(clips).to_numpy(), pc.list_flatten(clips)
                first = np.maximum(clip.field("lo").to_numpy(), own[parent])
                last = np.minimum(np.minimum(clip.field("hi").to_numpy(), length[parent]) - k + 2, own[parent] + width)
                inside = _marked(base[parent] + first, base[parent] + last, m) & opened
                word = sum(x[i : m + i] << 2 * (k - 1 - i) for i in range(k))
                good = np.logical_and.reduce([x[i : m + i] >= 0 for i in range(k)]) & opened
                words, which = np.unique(word[good], return_inverse=True)
                n, among = np.bincount(which, minlength=len(words)), np.bincount(which, inside[good], len(words))
                for w, c, i in zip(words.tolist(), n.tolist(), among.astype(np.int64).tolist(), strict=True):
                    had = total.setdefault(w, [0, 0])
                    had[0], had[1] = had[0] + c, had[1] + i
            names = ["".join(BASES[w >> 2 * (k - 1 - i) & 3] for i in range(k)) for w in total]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c for c, _ in total.values()], pa.int64()), pa.array([i for _, i in total.values()], pa.int64())], ["context", "n", "inside"])

    return run


def _marked(first: np.ndarray, end: np.ndarray, m: int) -> np.ndarray:
    """Which of ``m`` places lie in one of the stretches [first, end)."""
    real = end > first
    steps = np.zeros(m + 1, np.int64)
    np.add.at(steps, np.minimum(first[real], m), 1)
    np.add.at(steps, np.minimum(end[real], m), -1)
    return np.cumsum(steps[:m]) > 0


CLIPS = "array<struct<lo: bigint, hi: bigint>>"


def region_clips(regions: DataFrame, k: int, width: int) -> DataFrame:
    """(chr, chunk, clips): the merged regions that hold a k-mer starting in each chunk's own part.

    Merged regions neither touch nor overlap, so a chunk has at most width / 2
    of them, each cut to the k-mers of that chunk.  Rows with a null or with
    no base are left out.
    """
    from .intervals import reduce_ranges

    r = regions.where(F.col("start").isNotNull()).select(F.col("chr").cast("string").alias("chr"), F.greatest(F.col("start").cast("long"), F.lit(1)).alias("lo"), F.col("end").cast("long").alias("hi"))
    r = r.where("chr is not null and lo <= hi")
    r = reduce_ranges(r, ["chr"], "lo", "hi").where(F.col("hi") - F.col("lo") + 1 >= k)
    number = lambda c: F.floor((c - 1) / width).cast("long")
    r = r.withColumn("chunk", F.explode(F.sequence(number(F.col("lo")), number(F.col("hi") - k + 1))))
    cut = F.struct(F.greatest("lo", F.col("chunk") * width + 1).alias("lo"), F.least("hi", (F.col("chunk") + 1) * width + k - 1).alias("hi"))
    return r.groupBy("chr", "chunk").agg(F.collect_list(cut).cast(CLIPS).alias("clips"))


def _counted(genome: DataFrame, k: int, width: int, strands: tuple[str, ...], regions: DataFrame | None, how: str) -> DataFrame:
    """(context, n, inside) over the strands; ``how`` left counts all chunks, inner those that regions meet.

    Each chunk is read once and meets its clips by (chr, chunk).
    """
    columns = ["chunk", "chunk_start", "seq", "length"]
    if regions is None:
        d = genome.select(*columns, F.array().cast(CLIPS).alias("clips"))
    else:
        c = region_clips(regions, k, width).withColumnsRenamed({"chr": "_chr", "chunk": "_chunk"})
        d = genome.join(c, (F.col("chr") == F.col("_chr")) & (F.col("chunk") == F.col("_chunk")), how)
        d = d.select(*columns, F.coalesce("clips", F.array().cast(CLIPS)).alias("clips"))
    n = d.mapInArrow(_chunk_kmers(k, width), "context string, n long, inside long")
    n = n.groupBy("context").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    context = F.col("context")
    both = F.array(*[context if s == "+" else reverse_complement(context) for s in strands])
    return n.select(F.explode(both).alias("context"), "n", "inside").groupBy("context").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))


def kmer_counts(genome: DataFrame, k: int, width: int = 10_000, strands: tuple[str, ...] = ("+", "-"), regions: DataFrame | None = None) -> DataFrame:
    """(context, n): k-mers that start in each chunk's own part, over the strands; ``regions`` (chr, start, end) counts only k-mers inside (merged) regions.

    The chunks' margin must hold k - 1 bases.
    """
    if regions is None:
        return _counted(genome, k, width, strands, None, "left").select("context", "n")
    return _counted(genome, k, width, strands, regions, "inner").where("inside > 0").select("context", F.col("inside").alias("n"))


def context_sizefactor(contexts_: list[str], genome: DataFrame | None = None, exome: DataFrame | None = None, method: str = "genome", contigs: list[str] | None = None, width: int = 10_000, strands: tuple[str, ...] = ("+", "-")) -> DataFrame:
    """(context, factor): 1 / genome counts, 1 / exome counts, or their ratio, both from one pass.  Contexts without a count have a null factor."""
    check.choice(method, ("genome", "exome", "exome2genome", "genome2exome"), "method")
    g = genome.where(F.col("chr").isin(*contigs)) if contigs else genome
    counts = _counted(g, len(contexts_[0]), width, strands, None if method == "genome" else exome, "inner" if method == "exome" else "left")
    counts = counts.select("context", F.col("n").alias("wgs"), F.expr("nullif(inside, 0)").alias("wes"))
    out = genome.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(contexts_)], "context string").join(counts, "context", "left")
    value = {"genome": "1.0 / wgs", "exome": "1.0 / wes", "exome2genome": "wgs / wes", "genome2exome": "wes / wgs"}[method]
    return out.select("context", F.expr(f"cast({value} as double)").alias("factor"))


def motif_table(mut: DataFrame, genome: DataFrame, motifs: tuple[str, ...] = ("TCA", "TCT"), background_snv: tuple[str, ...] | None = ("C>T", "C>G"), drop_other: bool = True, bg_extension: int = 20, sample_field: str = "sample", **fields) -> DataFrame:
    """Per-sample counts behind a motif's enrichment and the enrichment itself.

    Motifs count on both strands; background contexts count the motifs'
    middle bases in the window of ``bg_extension`` bases round each mutation.
    """
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    both = list(dict.fromkeys([*motifs, *map(rc, motifs)]))
    middle = sorted({m[1] for m in both})
    subs = background_snv or [f"{r}>{a}" for r in middle for a in BASES if a != r]
    kinds = sorted({s if s[0] in "CT" else complement_sub(s) for s in subs})
    if {m[1] for m in both} != {x for s in kinds for x in (s[0], complement_sub(s)[0])}:
        raise ValueError("the motifs' middle bases and the background substitutions do not fit")
    d = with_context(mut, genome, 1, bg_extension, **fields)
    ref, alt = F.col(fields.get("ref_field", "ref")), F.col(fields.get("alt_field", "alt"))
    bg = F.col("background")
    count = lambda s: F.size(F.regexp_extract_all(bg, F.lit(f"(?=({s}))"), 1))
    is_bg = standard_sub(ref, alt).isin(*kinds)
    d = d.select(F.col(sample_field).alias("sample"), is_bg.alias("is_bg"), (is_bg & F.col("context").isin(*both)).alias("is_sig"), sum((count(b) for b in middle[1:]), count(middle[0])).alias("bg_n"), sum((count(m) for m in both[1:]), count(both[0])).alias("sig_n"))
    if drop_other:
        d = d.where("is_bg")
    total = lambda c: F.sum(F.col(c).cast("long"))
    out = d.groupBy("sample").agg(total("is_sig").alias("signature_mut_freq"), total("is_bg").alias("background_mut_freq"), total("sig_n").alias("signature_context"), total("bg_n").alias("background_context"), F.count(F.lit(1)).alias("n_mutations"))
    out = out.withColumn("non_signature_mut_freq", F.col("n_mutations") - F.col("signature_mut_freq"))
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    rate = ratio("signature_context", "background_context")
    return out.withColumn("enrichment", F.when(rate != 0, ratio("signature_mut_freq", "background_mut_freq") / rate))


def motif_fisher(*args, **kwargs) -> DataFrame:
    """:func:`motif_table` with a one-sided Fisher test for each sample (p, odds ratio and its bounds)."""
    d = motif_table(*args, **kwargs)

    @F.pandas_udf("fisher_pvalue double, odds double, ci_low double, ci_up double")
    def fisher(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.DataFrame:
        from ..functions.kernels import fisher_greater

        return pd.DataFrame([fisher_greater(*map(int, x)) for x in zip(a, b, c, e, strict=True)], columns=["fisher_pvalue", "odds", "ci_low", "ci_up"])

    test = fisher("signature_mut_freq", "signature_context", F.col("background_mut_freq") - F.col("signature_mut_freq"), F.col("background_context") - F.col("signature_context"))
    return d.withColumn("_t", test).select(*d.columns, F.col("_t.fisher_pvalue").alias("fisher_pvalue"), F.col("_t.odds").alias("or"), F.col("_t.ci_low").alias("ci_low"), F.col("_t.ci_up").alias("ci_up"))
