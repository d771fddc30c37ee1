"""FASTA read in parts: a contig is rows of bounded length, never one string.

Lines are read by many tasks, each some blocks of bytes of a file. A task knows the lines of its block, but not which
contig the first of them belongs to, nor where in it they stand. One row per block says how many contigs begin in it,
the last of their headers, and how many letters come after it; running sums over these rows give every block the number
of contigs before it, the header that goes on into it, and the letters of that contig so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalise_symbols, sample_name, short_name
from .fasta import is_gzip, list_files, plain_uri, same_form, uri_path
from .shipping import ship

PART = 1 << 19
_ROWS = "file string, block long, record long, at long, header string, part string"


def _cut(size: int):
    """Lines of blocks in order, as parts of at most ``size`` letters. ``record`` counts the headers in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROWS.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        here, record, at, held, out = (None, None), 0, 0, "", []

        def flush() -> None:
            nonlocal at, held
            if held:
                out.append((*here, record, at, None, held))
                at, held = at + len(held), ""

        for batch in batches:
            for file, block, header, letters in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "header", "letters")), strict=True):
                if (file, block) != here:
                    flush()
                    here, record, at = (file, block), 0, 0
                if header is not None:
                    flush()
                    record, at = record + 1, 0
                    out.append((*here, record, 0, header, ""))
                    continue
                held += letters
                while len(held) >= size:
                    out.append((*here, record, at, None, held[:size]))
                    at, held = at + size, held[size:]
            if sum(len(x[-1]) for x in out) >= size or len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)
                out.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    return run


def read_parts(spark: SparkSession, paths: str | list[str], size: int = PART, concatenated: bool = False) -> DataFrame:
    """``file_ord, sample, file, contig_ord, contig, contig_full, offset, part``: contigs in parts of at most ``size`` letters,
    at least one (maybe empty) for each. A header is a line that starts with ``>``; lines before the first one, and records
    with an empty header, are left out. Gzip files are told by their name here and are read by one task each, in parts."""
    found = list_files(spark, [paths] if isinstance(paths, str) else list(paths))
    for _, _, uri in found:
        if is_gzip(spark, uri) != uri.endswith(".gz"):
            raise ValueError(f"{uri}: whether it is gzip does not agree with its name")
    ship(spark)
    lines = spark.read.text([uri_path(uri) for _, _, uri in found])
    header = F.when(F.col("value").startswith(">"), F.substring("value", 2, 1 << 30))
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), header.alias("header"), F.when(header.isNull(), normalise_symbols(F.col("value"))).otherwise("").alias("letters"))
    parts = rows.mapInArrow(_cut(size), _ROWS).withColumn("file", same_form(F.col("file")))

    # one row per block of a file
    order = Window.partitionBy("file").orderBy("block")
    heads = F.col("header").isNotNull()
    last = F.max(F.struct("record", F.coalesce(F.col("header"), F.lit("")).alias("header")))
    blocks = parts.groupBy("file", "block", "record").agg(F.max("header").alias("header"), F.sum(F.char_length("part")).alias("n"))
    blocks = blocks.groupBy("file", "block").agg(F.count_if(heads).alias("n_heads"), F.count_if(heads & (F.col("header") != "")).alias("n_real"), last.alias("last"), F.max_by("n", "record").alias("tail"))
    run = blocks.withColumn("run", F.sum((F.col("n_heads") > 0).cast("long")).over(order))
    run = run.withColumn("so_far", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
    known = F.when(F.col("n_heads") > 0, F.col("last.header"))
    carried = run.select(
        F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n_real").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("so_far").over(order).alias("letters_before"), F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("open_header"),
    )

    # headers of a block in order; those without text begin no contig
    own = parts.where(heads).select(F.col("file").alias("hf"), F.col("block").alias("hb"), F.col("record").alias("hr"), F.col("header").alias("own_header"))
    own = own.withColumn("real", F.sum((F.col("own_header") != "").cast("long")).over(Window.partitionBy("hf", "hb").orderBy("hr")))
    joined = parts.join(carried, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    joined = joined.join(own, (F.col("file") == F.col("hf")) & (F.col("block") == F.col("hb")) & (F.col("record") == F.col("hr")), "left")
    first = F.col("record") == 0
    full = F.when(first, F.col("open_header")).otherwise(F.col("own_header"))
    number = F.col("before") + F.coalesce("real", F.lit(0)) - 1
    offset = F.col("at") + F.when(first, F.coalesce("letters_before", F.lit(0))).otherwise(0)
    placed = joined.select("file", number.cast("int").alias("contig_ord"), full.alias("contig_full"), offset.alias("offset"), "part", heads.alias("begins")).where("contig_full <> '' and (begins or part <> '')")

    named = spark.createDataFrame([(i, given, plain_uri(uri)) for i, given, uri in found], "file_ord int, given string, f2 string")  # one row per input file
    # a path of several files numbers its contigs over all of them
    sizes = placed.groupBy("file").agg((F.max("contig_ord") + 1).alias("n")).join(named, F.col("file") == F.col("f2"))
    earlier = Window.partitionBy("file_ord").orderBy("f2").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file_ord", "given", "f2", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    out = placed.join(F.broadcast(bases), F.col("file") == F.col("f2"))
    sample = short_name(F.col("contig_full")) if concatenated else sample_name(F.col("given"))
    return out.select("file_ord", sample.alias("sample"), "file", (F.col("contig_ord") + F.col("base")).cast("int").alias("contig_ord"), short_name(F.col("contig_full")).alias("contig"), "contig_full", "offset", "part")
