"""What the training-data operators share: word rules, tables in the shared folder, joins on hot keys, whole rows, workers
that hold little between tasks."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship

__all__ = ["SPACE", "SPACE_BYTES", "count_words", "join_counted", "lean", "materialize", "new_path", "packed", "position", "remove", "running", "shared_dir", "ship", "shuffled", "unpacked", "words_of"]

#: Java pattern of the white space that ends a word, and the same characters as bytes.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_BYTES = b" \t\n\x0b\f\r"
#: A key of more rows than this, and of more than a share 1 / MOST_HOT of all, is hot; so there are at most MOST_HOT.
HOT_ROWS, MOST_HOT = 1000, 20_000


#: What operators keep in a worker from task to task, each in a dict of its own.
CACHES: list[dict] = []


def _empty_caches(but: str) -> None:
    """Empty the caches that hold no ``but``."""
    for cache in CACHES:
        if but not in cache:
            cache.clear()


def _give_back() -> None:
    """Return free memory to the system. Arrow and the C library keep it, so a worker that waits for its next task would
    hold on to the most that it ever took, beside all others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim:
        trim(0)


def lean(run: Callable, cached: str = "") -> Callable:
    """``run``, a function over batches, a table or two tables, for workers that are small between tasks: they begin
    without what other operators cached (all that holds no ``cached``) and give free memory back at the end."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _empty_caches(cached)
        yield from run(batches)
        _give_back()

    def tablewise(table: pa.Table) -> pa.Table:
        _empty_caches(cached)
        out = run(table)
        _give_back()
        return out

    def of_two(left: pa.Table, right: pa.Table) -> pa.Table:
        _empty_caches(cached)
        out = run(left, right)
        _give_back()
        return out

    given = list(inspect.signature(run).parameters)
    return of_two if len(given) == 2 else batchwise if given == ["batches"] else tablewise


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary one, as in tests;
    on a cluster it is an error, because executors do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def remove(table: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` for joins with a table that grows as it does: rows of both are shuffled and merged. Spark would send a side
    whose files are small to all tasks through the driver, where it may take very many times its compressed size."""
    return table.hint("merge")


def join_counted(large: DataFrame, small: DataFrame, keys: list[str], total: int, count: str) -> DataFrame:
    """Inner join of two tables of which the small one has one row per key and says in ``count`` how many rows of the
    large one have it; ``total`` is the number of those rows. Both are read more than once, so they should be stored.

    Hot keys are at most ``MOST_HOT``, as they hold more than that share of all rows each: they are sent to all tasks,
    so that no task gets all rows of one. Other keys are shuffled.
    """
    least = max(HOT_ROWS, -(-total // MOST_HOT))
    hot, cold = small.where(F.col(count) > least), small.where(F.col(count) <= least)
    if hot.isEmpty():
        return large.join(shuffled(small), keys)
    if cold.isEmpty():
        return large.join(F.broadcast(hot), keys)
    rest = large.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(shuffled(cold), keys)
    return large.join(F.broadcast(hot), keys).unionByName(rest)


def running(rows: DataFrame, order: list[Column], sums: list[str], label: str) -> DataFrame:
    """``rows`` in a total order with ``rank`` (from 0) and, for each column of ``sums``, its sum over the rows before as
    ``before_NAME``. Ranges of rows are sorted and summed by many tasks; one row per range passes a window of its own."""
    placed = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), label)
    inside = Window.partitionBy("range").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    ranges = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    bases = ranges.select("range", F.coalesce(F.sum("n").over(before), none).alias("base"), *[F.coalesce(F.sum(f"all_{c}").over(before), none).alias(f"base_{c}") for c in sums])
    each = placed.select("*", (F.row_number().over(inside) - 1).alias("at"), *[F.coalesce(F.sum(c).over(earlier), none).alias(f"in_{c}") for c in sums])
    joined = each.join(F.broadcast(bases), "range")  # no more ranges than shuffle partitions
    return joined.select(*rows.columns, (F.col("at") + F.col("base")).alias("rank"), *[(F.col(f"in_{c}") + F.col(f"base_{c}")).alias(f"before_{c}") for c in sums])


def position(names: list[str], name: str) -> int:
    """Of a column by its exact name, or else by the only one that is equal but for case."""
    if name in names:
        return names.index(name)
    found = [i for i, x in enumerate(names) if x.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"no column {name!r} among {names}")
    return found[0]


def packed(documents: DataFrame, **wanted: str) -> DataFrame:
    """All columns of ``documents`` in one struct ``row``, and beside it those of ``wanted`` under names of their own.
    No name of a column can clash with one that an operator makes, whatever dots, quotes or case it has."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(F.struct(*plain.columns).alias("row"), *[F.col(f"c{position(names, v)}").alias(k) for k, v in wanted.items()])


def unpacked(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The columns of ``documents`` from the struct that :func:`packed` made."""
    return rows.select(*[F.col(f"row.c{i}") for i in range(len(documents.columns))]).toDF(*documents.columns)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+")
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, as a long, without keeping them."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+")
    size = F.size(parts)
    # only the first and the last part can be empty
    empty_first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    empty_last = F.when((size > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (size - empty_first - empty_last).cast("long")
