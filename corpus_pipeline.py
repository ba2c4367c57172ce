"""A corpus pipeline: toxicity filter, near-dedup, decontamination, tokens.

``run`` applies STAGES to ``documents``; each stage's result is written as
Parquet to the shared folder and read again as the next stage's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import bpe, decontam, simhash, toxicity
from lociframe.llm._util import drop_durable, durable
from lociframe.llm.queries import held_out, table, word_bpe_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go.

    Null and empty texts get the score of no evidence; repeated rows score
    alike; without labels no document goes; an empty table stays empty;
    clashing columns are kept.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model).where(F.col("toxicity") < 0.3).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of smallest doc_id.

    Null and empty texts are one group; of repeated rows of one doc_id one
    stays; rows without a doc_id all stay; an empty table stays empty.
    """
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go.

    Null and empty texts stay, as does everything without a benchmark;
    repeated rows go or stay together.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; null and empty texts have no tokens."""
    return bpe.encode(docs, word_bpe_path())


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("tokens", count_tokens)]

# None of the stages' models and alignments can be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_durable(docs)  # of the stage before
        docs = after
    return docs
