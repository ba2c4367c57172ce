"""The registered queries of this package: thin wrappers over its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chatformat, decontam, hardneg, htmltext, mixing, repair, simhash, tokencount, toxicity, urlrules, warc
from ._util import use_small_arrow_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_small_arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    """The remainder that is kept from training: crc32(doc_id as text) mod 4 = 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.mark(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "overlap", "contaminated", "items", "n_items")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), word_bpe_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    back = warc.read(spark, path, payloads="response")
    response = F.col("record_type") == "response"
    return back.select(
        warc.page_of("record_id").alias("page_id"),
        F.when(response, F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2(F.coalesce("payload", F.lit(b"")), 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


# fixed values: the rules of the query
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_chatformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chatformat.parse(turns, chatformat.fit(turns))


def op10_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hardneg.mine(moved, F.col("vec_id") % 50 == 0)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")), dropped="dropped")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [k for k in globals() if k.startswith("op") and k[2].isdigit()]
    return {k: globals()[k] for k in sorted(named, key=lambda k: int(k[2:].split("_")[0]))}
