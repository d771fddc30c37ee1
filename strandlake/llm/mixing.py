"""Mixing sources to target weights with hash-threshold histograms; DataFrame operations only.

Each source's target is split into whole repeats of the source and a rest. The rest is taken as all documents whose hash
lies below a threshold: sizes are summed by (source, hash bucket), the bucket in which the running sum crosses the
budget is refined by the next bits of the hash, and after the last level one hash value decides. No document is sorted;
only pre-aggregated buckets, at most 2**BITS per source and level, and sources pass through windows. Thresholds are nested: a smaller
budget takes a subset.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; documents of one id share
one hash and are taken or left together, as are repeated rows; a source without words has target 0 and none of its documents is taken; no document, empty ones included, is taken more than ``most`` times;
an empty table gives an empty result. Columns other than the named ones are ignored by :func:`mix` and kept by
:func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, join_counted, materialize, packed, running, unpacked

#: Bits per level; four levels use the whole 48-bit hash.
BITS, LEVELS = 12, 4


def hash48(doc_id: Column) -> Column:
    """First 12 hex digits of the md5 of an id, as a long: the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, key, n_docs, source_size, target`` from ``source, key, size`` rows.

    Water filling in closed form: with sources ordered by the level at which they hit ``most`` times their size, the
    sources at their limit are a prefix of that order. Ranks and running sums are taken over ranges of sources, so there
    may be as many sources as there are sites.
    """
    per = sizes.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running(per, by_name, [], "mix-sources").withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    full = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    run = running(full, [F.col("level").asc(), *by_name], ["cap", "weight"], "mix-levels")
    whole = run.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    budget = float(whole["size"]) * share
    # the first source in this order that stays below its limit sets the level of all later ones
    common = (F.lit(budget) - F.col("before_cap")) / (F.lit(float(whole["weight"])) - F.col("before_weight"))
    found = run.where(common <= F.col("level")).agg(F.min(F.struct("rank", common.alias("common"))).alias("f")).first()["f"]
    free = F.lit(False) if found is None else F.col("weight") * F.lit(found["common"]) < F.col("cap")
    target = F.col("cap") if found is None else F.when(free, F.col("weight") * F.lit(found["common"])).otherwise(F.col("cap"))
    return run.select("source", "key", "n_docs", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``key, n_docs, source_size, target, repeats, cut``: documents with hash48 < cut are taken once more than ``repeats``."""
    size, target = F.col("source_size"), F.col("target")
    repeats = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    state = goals.select("key", "n_docs", "source_size", "target", repeats.alias("repeats"), (target - repeats * size).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    total = goals.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        here = sized.select("key", "size", F.shiftright("hash", shift).alias("bucket"))
        if level:  # only the boundary bucket of each source is refined
            edge = state.select("key", "n_docs", F.col("prefix").alias("p2"))
            here = join_counted(here, edge, ["key"], total, "n_docs").where(F.shiftright("bucket", BITS) == F.col("p2")).select("key", "size", "bucket")
        histogram = here.groupBy("key", "bucket").agg(F.sum("size").alias("in_bucket"))
        running_sum = Window.partitionBy("key").orderBy("bucket")
        summed = histogram.select("key", "bucket", "in_bucket", F.sum("in_bucket").over(running_sum).alias("upto"))
        crossing = (
            summed.join(state.select("key", "rest"), "key")
            .where(F.col("upto") > F.col("rest"))
            .groupBy("key", "rest")
            .agg(F.min(F.struct("bucket", "in_bucket", "upto")).alias("b"))
            .select("key", F.col("b.bucket").alias("bucket"), (F.col("rest") - (F.col("b.upto") - F.col("b.in_bucket"))).alias("left"), F.col("b.in_bucket").alias("within"))
        )
        joined = state.join(crossing, "key", "left")
        state = materialize(
            joined.select(
                "key", "n_docs", "source_size", "target", "repeats",
                F.coalesce("left", F.lit(0.0)).alias("rest"),
                F.coalesce("bucket", (F.col("prefix") + 1) * (1 << BITS)).alias("prefix"),
                F.coalesce("within", F.lit(0)).alias("inside"),
            ),
            "mix-state",
        )
    # the hash value at the boundary is taken if that comes nearer to the target; where repeats make up the whole target,
    # as in sources at their limit or without words, no document is taken once more, be it empty
    more = (size > 0) & (target > F.col("repeats") * size)
    cut = F.when(more, F.col("prefix") + F.when(2 * F.col("rest") > F.col("inside"), 1).otherwise(0)).otherwise(0)
    return materialize(state.select("key", "n_docs", "source_size", "target", "repeats", cut.alias("cut")), "mix-cuts")


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    doc: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``; ``copies`` says how often the mix holds it."""
    rows = packed(documents, doc_id=doc, text=text, source=source)
    sized = materialize(rows.select("doc_id", *_sized()), "mix-sizes")
    cuts, total = _cuts(sized, weights, share, most)
    joined = join_counted(sized, cuts, ["key"], total, "n_docs")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"), _copies().cast("long").alias("copies"))


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _sized() -> tuple[Column, ...]:
    return F.col("source").cast("string").alias("source"), _key(F.col("source")).alias("key"), count_words(F.col("text")).alias("size"), hash48(F.col("doc_id")).alias("hash")


def _cuts(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """One row per source, and the number of documents."""
    cuts = thresholds(sized, materialize(targets(sized, weights, share, most), "mix-targets"))
    return cuts, cuts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]


def _copies() -> Column:
    return F.col("repeats") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)


def apply_mix(documents: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, all columns: a filter and a repeat. Texts are shuffled only where
    sources are so many that their table is not sent to all tasks."""
    rows = packed(documents, doc_id=doc, text=text, source=source)
    cuts, total = _cuts(materialize(rows.select(*_sized()), "mix-sizes"), weights, share, most)
    marked = rows.select("row", _key(F.col("source")).alias("key"), hash48(F.col("doc_id")).alias("hash"))
    joined = join_counted(marked, cuts.select("key", "n_docs", "repeats", "cut"), ["key"], total, "n_docs")
    return unpacked(joined.select("row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))), documents)
