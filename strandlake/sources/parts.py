"""Ordered parts of files: written by many tasks, joined to whole files.

Parts are written by Spark's text writer, so that a task that is run again leaves one part. With gzip every value is a
member of its own. The writer ends each value by a separator: for gzip that is the empty member, which adds nothing to
what a file unpacks to, and for text it is the line break that a value ends with.

Parts of one file are joined in the order of tasks, and of the files of one task. One part is renamed. More are joined by
the file system where it can do that; in a mounted folder every task copies one part to its place, which is the sum of
the sizes before it; else the driver copies them one after the other, a buffer at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

BUFFER = 4 << 20


def member(value: bytes, level: int) -> bytes:
    """A gzip member without name and time."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(value) + packer.flush()


#: The empty member, the same in every file: header, an empty block, checksum and size.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)


def _members(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([member((x or "").encode(), level) for x in batch.column("value").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], batch.schema.names)

    return run


def write_parts(rows: DataFrame, path: str, gzip_level: int = 0, by: str | None = None) -> None:
    """``value`` texts that end with a line break, in the order of the partitions; ``by``: a column with a folder for each
    value, which comes first. Empty texts leave a line break only without gzip."""
    if gzip_level > 0:
        ship(rows.sparkSession)
        packed = rows.mapInArrow(_members(min(9, gzip_level)), ", ".join(f"{n} {'binary' if n == 'value' else t}" for n, t in rows.dtypes))
        writer = packed.withColumn("value", F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1"))
    else:
        writer = rows.withColumn("value", F.regexp_replace("value", "\n\\z", "")).write
    (writer.partitionBy(by) if by else writer).mode("overwrite").text(path)


def _at(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, name: str) -> None:
    fs, path = _at(spark, name)
    fs.delete(path, True)


def end_names(spark: SparkSession, folder: str, end: str) -> None:
    """Parts by a name that says what they are, for readers that go by names."""
    fs, path = _at(spark, folder)
    for x in fs.listStatus(path):
        if x.getPath().getName().startswith("part-"):
            fs.rename(x.getPath(), x.getPath().suffix(end))


def _copied(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies each part to its place; to do it again changes nothing."""
    for batch in rows:
        for source, target, at in zip(*(batch.column(c).to_pylist() for c in ("source", "target", "at")), strict=True):
            with open(source, "rb") as f, open(target, "r+b") as out:
                out.seek(at)
                while data := f.read(BUFFER):
                    out.write(data)
        yield batch.select(["at"])


def join_parts(spark: SparkSession, files: dict[str, str]) -> None:
    """For every target path, the parts in a folder as one file. A target that is there is replaced at the end."""
    copies: list[tuple[str, str, int]] = []
    finished = []
    for name, folder in files.items():
        fs, where = _at(spark, folder)
        _, target = _at(spark, name)
        listed = [x for x in fs.listStatus(where) if x.getPath().getName().startswith("part-")] if fs.exists(where) else []
        # names hold the task and the file of the task, in digits of fixed width
        parts = sorted((x for x in listed if x.getLen() > 0), key=lambda x: x.getPath().getName())
        fs.mkdirs(target.getParent())
        draft = target.suffix("._joined")
        finished.append((fs, draft, target))
        if len(parts) == 1:
            fs.rename(parts[0].getPath(), draft)
            continue
        uri = fs.makeQualified(draft).toUri().toString()
        if uri.startswith("file:"):
            open(_local(uri), "wb").close()  # without a file of checksums, as tasks write to it directly
            at = 0
            for part in parts:
                copies.append((_local(part.getPath().toUri().toString()), _local(uri), at))
                at += part.getLen()
        else:
            fs.create(draft, True).close()
            _concatenated(spark, fs, draft, [x.getPath() for x in parts])
    if copies:
        ship(spark)
        tasks = spark.createDataFrame(copies, "source string, target string, at long").repartition(min(len(copies), 4 * spark.sparkContext.defaultParallelism))
        tasks.mapInArrow(_copied, "at long").agg(F.count(F.lit(1))).collect()
    for fs, draft, target in finished:
        fs.delete(target, False)
        fs.rename(draft, target)


def _concatenated(spark: SparkSession, fs, draft, parts: list) -> None:
    if not parts:
        return
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        sources = gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
        for i, part in enumerate(parts):
            sources[i] = part
        fs.concat(draft, sources)
        return
    except Exception as e:
        if "UnsupportedOperation" not in str(e) and "Not implemented" not in str(e):
            raise
    out = fs.create(draft, True)
    for part in parts:
        source = fs.open(part)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, BUFFER, False)
        source.close()
    out.close()


def _local(uri: str) -> str:
    return unquote(urlparse(uri).path)
