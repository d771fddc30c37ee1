"""FASTA text: source and sinks."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fasta_record, normalise_symbols, sample_name, short_name
from ..functions.packing import symbol_codes
from .parts import end_names, join_parts, remove, write_parts
from .shipping import ship

_GZIP = b"\x1f\x8b"
def records_of(text_rows: DataFrame, value: str = "value") -> DataFrame:
    """``header, body`` from raw records: text between one ``>`` at a line start and the next."""
    raw = F.regexp_replace(F.col(value), "^\\s*>", "")
    header = F.regexp_extract(raw, "^[^\\r\\n]*", 0)
    body = F.substring(raw, F.char_length(header) + 1, F.char_length(raw))
    return text_rows.select("*", header.alias("header"), body.alias("body")).where((F.col("header") != "") & (F.trim(raw) != ""))


def list_files(spark: SparkSession, paths: list[str]) -> list[tuple[int, str, str]]:
    """(ordinal of the path, path, uri of a file) of every file under the paths, repeated paths once; a missing one is an
    error. One entry per input file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for i, given in enumerate(dict.fromkeys(paths)):
        path = jvm.org.apache.hadoop.fs.Path(given)
        fs = path.getFileSystem(conf)
        found = fs.globStatus(path)
        if not found:
            raise FileNotFoundError(given)
        for status in found:
            inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += [(i, given, x.getPath().toUri().toString()) for x in inside if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return out


def is_gzip(spark: SparkSession, uri: str) -> bool:
    """By a file's first two bytes."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return (stream.read(), stream.read()) == tuple(_GZIP)
    finally:
        stream.close()


def strict_records(data: bytes) -> list[bytes]:
    """Records where any ``>`` begins the next one and an empty header or body ends the file, as established readers that
    scan byte by byte have it."""
    out, at = [], 0
    while at < len(data):
        ends = [x for x in (data.find(b"\n", at), data.find(b"\r", at)) if x >= 0]
        head_end = min(ends, default=len(data))
        body_end = data.find(b">", head_end)
        body_end = len(data) if body_end < 0 else body_end
        if head_end - at <= 1 or body_end == head_end:
            break
        out.append(data[at + 1 : body_end])
        at = body_end
    return out


def _whole(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = gzip.decompress(content) if content[:2] == _GZIP else content
                records = strict_records(data) if strict else data.split(b"\n>")
                text = [r.decode("utf-8", "replace") for r in records]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(text), pa.string()), pa.array(range(len(text)), pa.int64()), pa.array(text, pa.string())], ["file", "at", "value"])

    return run


def read_fasta(spark: SparkSession, paths: str | list[str], concatenated: bool = False, strict: bool = False) -> DataFrame:
    """Contigs of FASTA files: ``file_ord, sample, file, contig_ord, contig, contig_full, seq``; ``file_ord`` is the place of
    the path among those given, so files of one name in different folders stay apart.

    Files are split at record starts by the text reader, so a large file is read by many tasks. Whether a file is gzip is
    found from its first bytes; one whose name says otherwise is read whole by one task, as are all files with ``strict``
    (see :func:`strict_records`). ``concatenated``: every contig is a sample of its own, named by its short name.
    """
    found = list_files(spark, [paths] if isinstance(paths, str) else list(paths))
    odd = {uri for _, _, uri in found if strict or is_gzip(spark, uri) != uri.endswith(".gz")}
    plain = [uri for _, _, uri in found if uri not in odd]
    parts = []
    if plain:
        rows = spark.read.option("lineSep", "\n>").text([uri_path(u) for u in plain])
        at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        parts.append(rows.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value"))
    if odd:
        ship(spark)
        whole = spark.read.format("binaryFile").load([uri_path(u) for u in sorted(odd)]).select(F.col("_metadata.file_path").alias("path"), "content")
        rows = whole.mapInArrow(_whole(strict), "file string, at long, value string")
        parts.append(rows.select("file", F.struct(F.lit(0).cast("long").alias("block"), F.col("at").alias("row")).alias("at"), "value"))
    if not parts:
        parts = [spark.createDataFrame([], "file string, at struct<block:bigint,row:bigint>, value string")]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if strict:  # a record is as it is: no ``>`` at its start to take off
        every = every.withColumn("value", F.concat(F.lit(">"), "value"))
    # one row per input file
    named = spark.createDataFrame([(i, given, plain_uri(uri)) for i, given, uri in found], "file_ord int, given string, f2 string")
    records = records_of(every.withColumn("file", same_form(F.col("file"))))
    joined = records.join(F.broadcast(named), F.col("file") == F.col("f2"))
    sample = short_name(F.col("header")) if concatenated else sample_name(F.col("given"))
    rows = joined.select("file_ord", sample.alias("sample"), "file", "at", short_name(F.col("header")).alias("contig"), F.col("header").alias("contig_full"), normalise_symbols(F.col("body")).alias("seq"))
    order = Window.partitionBy("file_ord").orderBy("file", "at")
    return rows.select("file_ord", "sample", "file", (F.row_number().over(order) - 1).cast("int").alias("contig_ord"), "contig", "contig_full", "seq")


def uri_path(uri: str) -> str:
    from urllib.parse import unquote

    return unquote(uri)


def plain_uri(uri: str) -> str:
    """A uri without the empty authority that some of Spark's names have, decoded."""
    return uri_path(uri).replace("file:///", "file:/")


def same_form(c):
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")


def with_codes(contigs: DataFrame) -> DataFrame:
    """Contigs with the numbers of their symbols, ``codes``, for readers that want no letters."""
    return contigs.withColumn("codes", symbol_codes(F.col("seq")))


def _unpacked_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(gzip.decompress(x)) for x in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "size"])


def file_sizes(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes without compression) of every input path. Plain files are not read."""
    found = list_files(spark, [paths] if isinstance(paths, str) else list(paths))
    packed = [uri for _, _, uri in found if is_gzip(spark, uri)]
    sizes: dict[str, int] = {}
    if packed:
        ship(spark)
        rows = spark.read.format("binaryFile").load([uri_path(u) for u in packed]).select(F.col("_metadata.file_path").alias("path"), "content")
        sizes = {plain_uri(r["path"]): r["size"] for r in rows.mapInArrow(_unpacked_size, "path string, size long").collect()}  # one per file
    out: dict[str, int] = {}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for _, given, uri in found:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        out[given] = out.get(given, 0) + (sizes[plain_uri(uri)] if uri in packed else path.getFileSystem(conf).getFileStatus(path).getLen())
    return list(out.items())


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """Names in a text file, separated by white space, without repeats."""
    words = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\\s+")).alias("w")).where("w <> ''")
    return list(dict.fromkeys(r["w"] for r in words.collect()))  # a command line's worth of names


def _record(contigs: DataFrame, width: int):
    """A contig as FASTA text with a line break at its end."""
    return fasta_record(F.col("contig_full"), F.col("seq"), width).alias("value")


def write_fasta(contigs: DataFrame, path: str, width: int = 80, gzip_level: int = 0) -> None:
    """Contigs as FASTA text in one folder; order inside files and from file to file is that of the collection. A width of
    0 leaves sequences on one line."""
    rows = contigs.repartitionByRange("sample_ord", "contig_ord").sortWithinPartitions("sample_ord", "contig_ord")
    write_parts(rows.select(_record(contigs, width)), path, gzip_level)
    if gzip_level > 0:
        end_names(contigs.sparkSession, path, ".gz")


def write_samples(contigs: DataFrame, path: str, width: int = 80, gzip_level: int = 0) -> None:
    """One file per sample, ``<sample>.fa`` or ``<sample>.fa.gz``. Samples are cut into ranges of contigs, so a large one is
    written by many tasks, and the parts of each are joined in order. Samples are numbered while they are written, so
    any name does."""
    spark = contigs.sparkSession
    rows = contigs.repartitionByRange("sample_ord", "contig_ord").sortWithinPartitions("sample_ord", "contig_ord")
    staged = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    write_parts(rows.select("sample_ord", _record(contigs, width)), staged, gzip_level, by="sample_ord")
    names = {r["sample_ord"]: r["sample"] for r in contigs.select("sample_ord", "sample").distinct().collect()}  # one row per file
    end = ".fa.gz" if gzip_level > 0 else ".fa"
    join_parts(spark, {f"{path.rstrip('/')}/{sample}{end}": f"{staged}/sample_ord={ordinal}" for ordinal, sample in names.items()})
    remove(spark, staged)


def write_file(rows: DataFrame, order: list[str], path: str, gzip_level: int = 0) -> None:
    """``value`` texts of ``rows`` as one file, in order: sorted and written by many tasks, whose parts are joined."""
    spark = rows.sparkSession
    staged = f"{path}._staging-{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    write_parts(ordered.select("value"), staged, gzip_level)
    join_parts(spark, {path: staged})
    remove(spark, staged)


def stream_lines(contigs: DataFrame, width: int = 80, order: tuple[str, ...] = ("sample_ord", "contig_ord"), header: str = "contig_full") -> Iterator[str]:
    """Records one at a time in order, one partition in memory: for standard output."""
    text = fasta_record(F.col(header), F.col("seq"), width)
    for row in contigs.orderBy(*order).select(text.alias("value")).toLocalIterator(prefetchPartitions=True):
        yield row["value"]
