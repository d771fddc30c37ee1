"""Catalog queries over a contigs table (``sample_ord, sample, contig_ord, contig, contig_full, seq``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalised_range, slice_range

MISSING, AMBIGUOUS = -1, -2


def samples(contigs: DataFrame) -> DataFrame:
    """Distinct ``sample_ord, sample``."""
    return contigs.select("sample_ord", "sample").distinct()


def list_samples(contigs: DataFrame, by_name: bool = True) -> DataFrame:
    """``position, sample`` in code point or in ingestion order. One row per sample passes the window."""
    order = Window.orderBy("sample" if by_name else "sample_ord")
    return samples(contigs).select((F.row_number().over(order) - 1).cast("long").alias("position"), "sample")


def reference_sample(contigs: DataFrame) -> DataFrame:
    return samples(contigs).where("sample_ord = 0").select("sample")


def list_contigs(contigs: DataFrame) -> DataFrame:
    return contigs.select("sample", "contig_ord", "contig_full")


def count_samples(contigs: DataFrame) -> DataFrame:
    return contigs.agg(F.countDistinct("sample").alias("n_samples"))


def count_contigs(contigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every wanted ``sample`` its number of contigs, or -1."""
    per = contigs.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(per, "sample", "left").select("sample", F.coalesce("n", F.lit(MISSING)).cast("long").alias("n_contigs"))


def contig_lengths(contigs: DataFrame) -> DataFrame:
    return contigs.select("sample", "contig", F.char_length("seq").cast("long").alias("length"))


def lengths_from_segments(segments: DataFrame, k: int) -> DataFrame:
    """Contig lengths from segments: neighbours overlap by k letters. Contigs without letters have no segments."""
    per = segments.groupBy("sample_ord", "contig_ord").agg(F.sum("raw_length").alias("total"), F.count(F.lit(1)).alias("n_segments"))
    return per.select("sample_ord", "contig_ord", (F.col("total") - (F.col("n_segments") - 1) * k).cast("long").alias("length"), "n_segments")


def samples_for(contigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``contig, sample`` for every occurrence of the wanted short names."""
    return contigs.join(wanted.select("contig").distinct(), "contig").select("contig", "sample")


def exists(contigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ``sample, contig`` pairs that exist; names are compared as given."""
    return wanted.join(contigs.select("sample", "contig").distinct(), ["sample", "contig"], "left_semi")


def resolve(contigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every wanted contig short name without a sample: ``status`` 0 and its sample, -1 if missing, -2 if ambiguous."""
    per = contigs.join(wanted.select("contig").distinct(), "contig").groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("only"))
    joined = wanted.select("contig").distinct().join(per, "contig", "left")
    status = F.when(F.col("n").isNull(), MISSING).when(F.col("n") > 1, AMBIGUOUS).otherwise(0)
    return joined.select("contig", status.cast("int").alias("status"), F.when(F.col("n") == 1, F.col("only")).alias("sample"))


def first_match(contigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (with ``sample, contig``) with the first contig in order that has the short name."""
    first = contigs.select("sample", "contig", "contig_ord", "contig_full", "sample_ord").join(wanted.select("sample", "contig").distinct(), ["sample", "contig"], "left_semi")
    first = first.groupBy("sample", "contig").agg(F.min(F.struct("contig_ord", "contig_full", "sample_ord")).alias("c"))
    return wanted.join(first.select("sample", "contig", "c.*"), ["sample", "contig"])


def get_ranges(contigs: DataFrame, queries: DataFrame) -> DataFrame:
    """Sub-sequences for ``query_ord, sample, contig, from, to`` rows: ``query_ord, header, seq``, missing ones left out."""
    found = first_match(contigs, queries)
    asked = found.withColumn("r", normalised_range(F.col("from"), F.col("to")))
    joined = asked.join(contigs.select("sample_ord", "contig_ord", "seq"), ["sample_ord", "contig_ord"])
    whole = (F.col("from") < 0) & (F.col("to") < 0)
    header = F.when(whole, F.col("contig_full")).otherwise(F.concat("contig_full", F.lit(":"), F.col("from").cast("string"), F.lit("-"), F.col("to").cast("string")))
    return joined.select("query_ord", header.alias("header"), slice_range(F.col("seq"), F.col("r.from"), F.col("r.to")).alias("seq"))


def get_samples(contigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contigs of the wanted samples in argument order: ``argument, contig_ord, contig_full, seq``; repeats allowed."""
    return wanted.select("argument", "sample").join(contigs, "sample").select("argument", "contig_ord", "contig_full", "seq")


def get_collection(contigs: DataFrame, skip_reference: bool = False) -> DataFrame:
    out = contigs.where("sample_ord > 0") if skip_reference else contigs
    return out.select("sample_ord", "contig_ord", "contig_full", "seq")


def info(contigs: DataFrame, **parameters: int) -> DataFrame:
    """One row: counts, reference and parameters."""
    counted = contigs.agg(F.countDistinct("sample").alias("n_samples"), F.count(F.lit(1)).alias("n_contigs"), F.coalesce(F.sum(F.char_length("seq")), F.lit(0)).cast("long").alias("n_letters"), F.max(F.when(F.col("sample_ord") == 0, F.col("sample"))).alias("reference"))
    return counted.select("*", *[F.lit(v).cast("long").alias(k) for k, v in parameters.items()])
