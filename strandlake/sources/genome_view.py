"""A deterministic collection over the ``documents`` table: samples are sources, contigs are documents.

``sample_ord`` ranks samples by their smallest document, ``contig_ord`` counts documents inside a sample; sample 0 is the
reference.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import iupac_view
from .shipping import ship

K, SEGMENT_SIZE, MIN_MATCH = 17, 100, 15
_UPPER = bytes.maketrans(b"acgt", b"ACGT")
_OTHERS = bytes(x for x in range(256) if x not in b"ACGTacgt")


def _dna_letters(text: pa.Array) -> pa.Array:
    """``dna_view`` of a batch. Few letters of a text stay, and a regular expression is slow where nearly all is cut."""
    kept = [None if x is None else x.translate(_UPPER, _OTHERS) for x in text.cast(pa.binary()).to_pylist()]
    return pa.array(kept, pa.binary()).cast(pa.string())


def contigs_of(spark: SparkSession, sf_dir: str, view: str = "dna") -> DataFrame:
    """``sample_ord, sample, contig_ord, contig, contig_full, seq``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    firsts = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    ords = firsts.select(F.col("source").alias("sample"), (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("sample_ord"))
    # ordinals come from ids alone, so texts do not pass the window
    places = docs.select("source", "doc_id").select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("int").alias("contig_ord"))
    ship(spark)
    seq = F.arrow_udf(_dna_letters, "string")(F.col("text")) if view == "dna" else iupac_view(F.col("text"))
    named = docs.select(
        "doc_id",
        F.col("source").alias("sample"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("contig"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" "), "lang").alias("contig_full"),
        seq.alias("seq"),
    )
    return named.join(ords, "sample").join(places, "doc_id").select("sample_ord", "sample", "contig_ord", "contig", "contig_full", "seq")
