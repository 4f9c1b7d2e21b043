"""The registered queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import audio, common, decontamination, language_model, pieces, quality, secrets, simhash, suffix_dedup, token_counts, toxicity


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = toxicity.train(spark, documents, common.table(spark, sf_dir, "labels"), modulus=5)
    scored = toxicity.score(documents, model)
    return scored.select(
        "doc_id",
        F.coalesce(common.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "mean_difference",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(common.table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(common.table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(common.crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))
    model = language_model.train(documents.where(~F.col("held_out")))
    return language_model.score(documents, model, keep=("doc_id", "held_out"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = quality.train(spark, documents, common.table(spark, sf_dir, "labels"), modulus=4, held=2)
    scored = quality.score(documents, model)
    return scored.select(
        "doc_id",
        F.coalesce(common.crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "good_ratio",
        "bad_ratio",
    )


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.stored(common.table(spark, sf_dir, "documents"))
    found = audio.analysed(media, keep=("doc_id", "n_bytes"))
    number = lambda x: F.format_string("%.3f", x)
    spans = F.transform("segments", lambda x: F.concat(number(x["start_s"]), F.lit("-"), number(x["end_s"])))
    feature = F.concat(F.lit("mel="), F.array_join(F.transform("mel_mean", lambda x: number(x.cast("double"))), ","), F.lit(";loud="), F.array_join(spans, ","), F.lit(";tensors="), F.sha2("features", 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load()
    encoded = pieces.encode(common.table(spark, sf_dir, "documents"), vocabulary, keep=("doc_id", "text"))
    decoded = pieces.decode(encoded, vocabulary, keep=("doc_id", "text"))
    return decoded.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(common.table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda x: x["rule"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["rule"] < secrets.BASE)
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(secrets.label(base), 256).alias("base_sha256"), secrets.label(F.col("spans")).alias("spans")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "common", "answer", "start", "end")


QUERIES = {
    "op5_decontamination": op5_decontamination,
    "op4_secrets": op4_secrets,
    "op3_sentencepiece": op3_sentencepiece,
    "op8_audio": op8_audio,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op9_lm_score": op9_lm_score,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op4_secrets": secrets.oracle(),
}
