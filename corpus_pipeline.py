"""The corpus pipeline: documents in, clean, distinct, mixed and tokenised documents out.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept.  All but the last return the
columns of `docs`; the last returns the ids of every document.  Null texts count as empty in every stage, repeated rows are
copies, an empty table gives an empty table, and other columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triledger.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from triledger.llm.queries import POWER, table, topic
from triledger.llm.tables import plain_reads, saved


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model predicts toxic; it learns from `labels` and these documents."""
    plain_reads(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    plain_reads(spark)
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8, directly or through others) the row with the smallest doc_id."""
    plain_reads(spark)
    return ngram_join.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities, whose expected tokens have tempered shares of sources, languages and topics."""
    plain_reads(spark)
    return mixing.sampled(docs, topic(), power=POWER)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether decoding them gives the text's bytes again."""
    plain_reads(spark)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text", sha.alias("sha")), keep=("doc_id", "lang", "source", "sha")))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.sha2("bytes", 256) == F.col("sha")).alias("restored"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("byte_bpe", encoded)]
# SQL expresses neither the learned lexicon nor the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
