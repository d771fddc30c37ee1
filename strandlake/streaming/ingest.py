"""A file stream of contigs that is appended to a collection batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.archive import Collection
from ..sources.parts import remove

SCHEMA = "sample string, contig_ord int, contig string, contig_full string, seq string"
CLOSES = "closes boolean"


def contig_stream(spark: SparkSession, folder: str, files_per_batch: int = 16, closing: bool = False) -> DataFrame:
    """A stream of contigs from Parquet files that arrive in a folder; with ``closing`` they say in ``closes`` whether a row
    is the last of its sample."""
    return spark.readStream.schema(f"{SCHEMA}, {CLOSES}" if closing else SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, **parameters: int) -> StreamingQuery:
    """Appends every micro-batch; the first creates the collection. A sample must arrive within one batch, unless the stream
    has a column ``closes``: then samples stay open over batches, and over restarts, until a row with it arrives.

    A batch that is run again finds its contigs already there and is skipped, so each is ingested once; a stored sample that
    brings contigs which are not there is an error.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        contigs = _numbered(batch)
        if contigs.isEmpty():
            return
        try:
            there = Collection(spark, path)
        except FileNotFoundError:  # no collection yet
            Collection.create(contigs, path, command=f"stream batch {number}", **parameters)
            return
        stored = there.contigs().select("sample", "contig_ord", "contig_full")
        late = contigs.join(there.table("samples").select("sample"), "sample", "left_semi").join(stored, ["sample", "contig_ord", "contig_full"], "left_anti").select("sample", "contig_full").first()
        if late:
            raise ValueError(f"sample {late['sample']} is stored without contig {late['contig_full']}: a sample must arrive within one batch")
        new = contigs.join(there.table("samples").select("sample"), "sample", "left_anti").select(*contigs.columns)
        if not new.isEmpty():
            there.append(new, command=f"stream batch {number}")

    writer = stream.writeStream.foreachBatch(_closing(path, checkpoint, parameters) if "closes" in stream.columns else ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def _numbered(rows: DataFrame) -> DataFrame:
    """Contigs with ``sample_ord`` in the order of names."""
    order = Window.orderBy("sample")  # samples of one batch
    names = rows.select("sample").distinct().select("sample", (F.row_number().over(order) - 1).cast("int").alias("sample_ord"))
    return rows.join(names, "sample").select("sample_ord", "sample", "contig_ord", "contig", "contig_full", "seq")


def _closing(path: str, checkpoint: str, parameters: dict):
    """Keeps the contigs of open samples beside the collection, one folder per micro-batch, and ingests a sample whole when
    it is closed. A folder is written anew if its batch is run again, and the commit holds the number of the batch, so each
    sample is ingested once. A row that closes a sample may be without a contig (a null ``contig_ord``)."""
    kept = f"{path.rstrip('/')}/_open"

    def run(batch: DataFrame, number: int) -> None:
        spark, marker = batch.sparkSession, f"{checkpoint} {number}"
        try:
            there = Collection(spark, path)
        except FileNotFoundError:
            there = None
        if there is not None:
            if there.has_marker(marker):
                return
            late = batch.join(there.table("samples"), "sample", "left_semi").first()
            if late:
                raise ValueError(f"sample {late['sample']} was closed before contig {late['contig_full']} arrived")
        batch.write.mode("overwrite").parquet(f"{kept}/number={number}")
        closed = batch.where("closes").select("sample").distinct()
        if closed.isEmpty():
            return
        held = spark.read.schema(f"{SCHEMA}, {CLOSES}, number long").option("basePath", kept).parquet(kept).where(F.col("number") <= number)
        whole = held.join(closed, "sample", "left_semi").where("contig_ord is not null")
        if there is None:
            there = Collection.create(_numbered(whole), path, command=f"stream batch {number}", marker=marker, **parameters)
        else:
            there = there.append(_numbered(whole), command=f"stream batch {number}", marker=marker)
        _forget(spark, kept, there, held)

    return run


def _forget(spark: SparkSession, kept: str, there: Collection, held: DataFrame) -> None:
    """Delete the folders whose samples are all in the collection."""
    left = held.join(there.table("samples"), "sample", "left_anti").select("number").distinct()
    done = held.select("number").distinct().join(left, "number", "left_anti").collect()  # one per micro-batch
    for row in done:
        remove(spark, f"{kept}/number={row['number']}")
