"""A corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; between stages the documents are written as Parquet and read again. All
stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, decontamination, pieces, secrets, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The model learns from the labelled rows of its input that op2 doesn't hold out."""
    model = toxicity.train(spark, docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=("doc_id", "lang", "source", "n_chars", "text")).where("score < 0.5").select("doc_id", "text", "lang", "source", "n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: that of smallest id."""
    return simhash.representatives(docs.select("doc_id", "text", "lang", "source", "n_chars"), shingle=5, similarity=(4, 5))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", "text", "lang", "source", "n_chars")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    masked = secrets.masked(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as ids, with what decoding them gives back."""
    vocabulary = pieces.load()
    encoded = pieces.encode(docs, vocabulary, keep=("doc_id", "text", "lang", "source"))
    decoded = pieces.decode(encoded, vocabulary, keep=("doc_id", "text", "lang", "source"))
    return decoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: The stages' models can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
