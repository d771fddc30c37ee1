"""A corpus pipeline over ``documents``: five stages of strandlake.llm, each written as Parquet before the next.

Defined cases: a null text is scored, compared and encoded as an empty one; null and empty texts are copies of each other,
of which one stays; documents without an id are documents of their own, and repeated rows copies; a null source is a
source, mixed after all others; a document that the mix takes more than once comes as often in the token files, with a
``start`` of its own each time; further columns, whatever their names, reach the last stage; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontaminate, mixing, near_dup, rule_ensemble, tokens
from strandlake.llm.common import new_path
from strandlake.llm.queries import tokenizer_path

#: The stages train models and encode with an external vocabulary; tests compare them with brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; a row per document, read back from them."""
    return tokens.encode_and_read_back(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing sources", mixture), ("token output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.select("doc_id", "n_tokens", "ids_crc32", "start")
