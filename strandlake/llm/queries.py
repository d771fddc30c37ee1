"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, hard_negatives, license_scan, line_dedup, mixing, near_dup, quality_rules, rule_ensemble, tokens, url_filter

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def tokenizer_path() -> str:
    """The vocabulary file of the token operators."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digest(chat.format_conversations(turns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_read_back(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(_table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.match_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, RULES)).drop("alias_of")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.length_histogram(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_quality_rules, op3_source_mixing, op4_token_files, op5_line_dedup, op6_decontamination, op7_quality_classifier, op8_url_filters, op9_token_counts, op10_near_dedup, op11_source_divergence, op12_hard_negatives, op13_license_scan)}
