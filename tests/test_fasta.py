"""FASTA source against plain slicing, clipped k-mer counts against plain counting."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringStartsWith

from lociframe.operators import snv
from lociframe.sources import fasta

random.seed(11)
SEQS = {f"c{i}": "".join(random.choices("ACGTNacgt", k=n)) for i, n in enumerate([1, 2, 59, 60, 61, 400, 2500, 7])}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def genome(spark, seqs=SEQS):
    return spark.createDataFrame(list(seqs.items()), "chr string, seq string")


@pytest.mark.parametrize("line,range_bytes", [(60, 1 << 20), (7, 100), (1000, 333)])
def test_round_trip(spark, tmp_path, line, range_bytes):
    extra = genome(spark).withColumn("length", F.lit("x")).unionByName(spark.createDataFrame([(None, "ACGT", "y"), ("none", None, "y"), ("empty", "", "y")], "chr string, seq string, length string"))
    path = f"file://{tmp_path}/genome"
    fasta.write_fasta(extra.repartition(3), path, line=line, file_bytes=500)
    got = fasta.read_fasta(spark, path, 100, 9, range_bytes=range_bytes)
    want = snv.chunk_genome(genome(spark).withColumn("seq", F.upper("seq")), 100, 9)
    assert rows(got) == rows(want)
    plain = fasta.read_fasta(spark, path, 10_000, 0, upper="false")
    assert {(r.chr, r.seq) for r in plain.collect()} == set(SEQS.items())
    fasta.write_fasta(genome(spark, {"only": "ACGT"}), path, mode="overwrite")
    assert rows(fasta.read_fasta(spark, path)) == [("only", 0, 1, "ACGT", 4)]


def test_index_of_files_from_elsewhere(spark, tmp_path):
    def lines(text, n, end):
        return end.join(text[i : i + n] for i in range(0, len(text), n))

    (tmp_path / "a.fa").write_bytes("".join(f">{c} some words\n{lines(t, 50, chr(10))}\n" for c, t in SEQS.items()).encode())
    (tmp_path / "b.fasta").write_bytes((">crlf\r\n" + lines("ACGT" * 40, 60, "\r\n") + "\r\n>nothing\r\n>open\r\nACG").encode())
    with pytest.raises(Exception, match="index_fasta"):
        fasta.read_fasta(spark, f"file://{tmp_path}").count()
    assert fasta.index_fasta(spark, f"file://{tmp_path}") == 2 and fasta.index_fasta(spark, f"file://{tmp_path}") == 0
    got = {r.chr: r.seq for r in fasta.read_fasta(spark, f"file://{tmp_path}", 5000, 0, range_bytes=64).collect()}
    assert got == {c: t.upper() for c, t in SEQS.items()} | {"crlf": "ACGT" * 40, "open": "ACG"}
    assert fasta.read_fasta(spark, f"file://{tmp_path}/a.fa").select("chr").distinct().count() == len(SEQS)


@pytest.mark.parametrize("text", [">a\nACGT\nAC\nACGT\n", ">a\nACGT\nACGTA\n", ">a\nACG\nACGTACG", "ACGT\n>a\nAC\n", ">a\nACGT\n\nACGT\n"])
def test_uneven_files_are_refused(text):
    import io

    with pytest.raises(ValueError):
        list(fasta.index_lines(io.BytesIO(text.encode())))


def test_predicates_leave_out_ranges_and_chunks(spark, tmp_path):
    path = f"file://{tmp_path}/genome"
    fasta.write_fasta(genome(spark).coalesce(1), path)
    reader = fasta.PruningReader({"path": path, "width": "100", "margin": "9", "range_bytes": "200"})
    everything = len(reader.partitions())
    left = list(reader.pushFilters([EqualTo(("chr",), "c6"), GreaterThanOrEqual(("chunk",), 20), StringStartsWith(("seq",), "A")]))
    assert left == [StringStartsWith(("seq",), "A")]
    few = reader.partitions()
    assert 0 < len(few) <= 4 < everything
    read = [c for p in few for b in reader.read(p) for c in zip(b.column("chr").to_pylist(), b.column("chunk").to_pylist(), strict=True)]
    assert sorted(read) == [("c6", k) for k in range(20, 25)]
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    want = rows(fasta.read_fasta(spark, path, 100, 9).where("chr in ('c5', 'c6') and chunk > 1 and length < 2000"))
    spark.conf.set(key, "true")
    try:
        d = fasta.read_fasta(spark, path, 100, 9).where("chr in ('c5', 'c6') and chunk > 1 and length < 2000")
        assert rows(d) == want and {r[0] for r in want} == {"c5"}
        assert rows(fasta.read_fasta(spark, path).where("chr = 'no such'")) == []
    finally:
        spark.conf.set(key, before)


def test_names_and_letters_are_checked(spark, tmp_path):
    for chrom, seq in [("a b", "ACGT"), ("a", "AC\nGT"), ("a", "ACé")]:
        with pytest.raises(Exception, match="a sequence needs"):
            fasta.write_fasta(genome(spark, {chrom: seq}), f"file://{tmp_path}/bad")
    assert rows(fasta.read_fasta(spark, f"file://{tmp_path}/bad")) == []


REGIONS = [("c6", 90, 115), ("c6", 116, 130), ("c6", 100, 120), ("c6", 300, 300), ("c6", 1999, 5000), ("c5", -5, 3), ("c5", 9, 7), ("c4", 1, 61), ("zz", 1, 9), (None, 1, 9), ("c5", None, 9), ("c5", 9, None)]


@pytest.mark.parametrize("k,width", [(1, 50), (3, 50), (3, 10_000), (5, 64)])
def test_clipped_kmers(spark, tmp_path, k, width):
    seqs = {c: t.upper() for c, t in SEQS.items()}
    covered = {c: [False] * len(t) for c, t in seqs.items()}
    for c, lo, hi in REGIONS:
        if c in seqs and lo is not None and hi is not None:
            for i in range(max(1, lo), min(hi, len(seqs[c])) + 1):
                covered[c][i - 1] = True
    comp = str.maketrans("ACGT", "TGCA")
    n, inside = {}, {}
    for c, t in seqs.items():
        for i in range(len(t) - k + 1):
            w = t[i : i + k]
            if "N" not in w:
                for x in (w, w.translate(comp)[::-1]):
                    n[x] = n.get(x, 0) + 1
                    if all(covered[c][i : i + k]):
                        inside[x] = inside.get(x, 0) + 1
    path = f"file://{tmp_path}/genome"
    fasta.write_fasta(genome(spark), path)
    g = fasta.read_fasta(spark, path, width, 9)
    r = spark.createDataFrame(REGIONS, "chr string, start int, end int").withColumn("clips", F.lit(1))
    assert dict(rows(snv.kmer_counts(g, k, width))) == n
    assert dict(rows(snv.kmer_counts(g, k, width, regions=r))) == inside
    words = sorted(n)
    for method, value in {"genome": lambda x: 1 / n[x], "exome": lambda x: 1 / inside[x], "exome2genome": lambda x: n[x] / inside[x], "genome2exome": lambda x: inside[x] / n[x]}.items():
        got = dict(rows(snv.context_sizefactor(words, g, r, method, width=width)))
        want = {x: value(x) if method == "genome" or x in inside else None for x in words}
        assert got == {x: v if v is None else pytest.approx(v) for x, v in want.items()}
    assert rows(snv.kmer_counts(g, k, width, regions=r.limit(0))) == []


def test_margin_must_hold_the_kmer(spark):
    with pytest.raises(Exception, match="margin"):
        snv.kmer_counts(snv.chunk_genome(genome(spark), 50, 1), 3, 50).collect()
    odd = spark.createDataFrame([("a", "ACéGTT"), ("b", "")], "chr string, seq string")
    assert dict(rows(snv.kmer_counts(snv.chunk_genome(odd), 2, strands=("+",)))) == {"AC": 1, "GT": 1, "TT": 1}
