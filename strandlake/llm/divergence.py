"""Divergence of sources: how far the words of a language's sources differ from each other and from the language.

Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, lower-cased in A-Z, are counted by (lang, source). Those in at least ``least``
documents of their language are kept. A kept term's column of counts is a sparse vector over the sources of its language;
most columns come more than once, so terms are grouped by identical vectors and every pair of sources is evaluated once per
distinct vector, times the number of terms that have it. Original terms are ranked at the end.

With N the sum of a group's counts over the V kept terms, a count c has the share ``p = 1 + floor(10^9 (c + 5) / (N + 5 V))``.
All arithmetic is in integers.

* Counting: arrays of a batch's words give one row per (lang, source, term), summed by Spark in the map side and again
  by (lang, source, term), so no term meets more rows in a task than its language has sources.
* Pairs: sources are numbered in their language and dealt in blocks of ``BLOCK``, vectors in slices of ``SLICE``. A task
  holds two blocks of one slice as dense matrices and returns a sum per pair of sources, never a row per vector and pair.
  Terms that neither block has are not sent: their share of a sum is a product.
* Ranks: Spark keeps the first of every group in the map side before it ranks them. The result itself has a row for
  every two sources of a language.

Defined cases: a null text, lang or source is an empty string; repeated rows are documents of their own; a language without kept
terms gives pairs of value 0 and no terms; a lang of one source has no pairs; ties go to the item that is smaller by bytes; an
empty table gives no rows; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize, packed, ship
from .hashing import span_hashes

UNIT, SMOOTH = 1_000_000_000, 5
#: Bytes of text that are counted together; sources of a block and vectors of a slice.
RUN_BYTES, BLOCK, SLICE = 4 << 20, 128, 4096

#: A-Z become a-z, other letters and bytes over 127 stay, all else becomes a space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``RUN_BYTES`` of text, at least one row each."""
    ends = np.cumsum(np.array([len(t.as_buffer()) for t in batch.column("text")], np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows ``lang, source, term, n, df`` of some documents."""
    texts = [t.as_buffer() for t in batch.column("text")]
    sizes = np.array([len(t) for t in texts], np.int64)
    folded = _FOLD[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]  # with a space after every text
    edge = np.flatnonzero(np.diff(folded != 32, prepend=False))
    first, last = edge[::2], edge[1::2]
    hashes, marks = span_hashes(folded, first, last)
    code, at, term = np.unique(hashes, return_index=True, return_inverse=True)
    if (marks[at][term] != marks).any():  # different words of one hash
        code, at, term = np.unique(np.stack([hashes, marks], 1), axis=0, return_index=True, return_inverse=True)
        term = term.ravel()
    n_terms = max(1, len(code))
    doc = np.searchsorted(np.cumsum(sizes + 1), first, "right")
    groups: dict[tuple, int] = {}
    group = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
    inside, times = np.unique(doc * n_terms + term, return_counts=True)
    pairs, which = np.unique(group[inside // n_terms] * n_terms + inside % n_terms, return_inverse=True)
    n = np.bincount(which, times, len(pairs)).astype(np.int64)
    df = np.bincount(which, minlength=len(pairs)).astype(np.int64)
    raw = folded.tobytes()
    names = pa.array([raw[a:b].decode() for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)], pa.string())
    own = list(groups)
    column = lambda i: pa.array([x[i] for x in own], pa.string()).take(pa.array(pairs // n_terms))
    return pa.RecordBatch.from_arrays([column(0), column(1), names.take(pa.array(pairs % n_terms)), pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in _runs(batch):
            yield _counted(run)


def kept_terms(documents: DataFrame, least: int = 30) -> DataFrame:
    """``lang, term, vector, code``: the kept terms with their counts by source and a name for the vector of counts.
    ``documents``: ``lang, source, text`` without nulls."""
    ship(documents.sparkSession)
    counted = documents.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, "lang string, source string, term string, n long, df long")
    by_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return by_term.where(F.col("df") >= least).select("lang", "term", "vector", F.sha2(F.to_json("vector"), 256).alias("code"))


def share(count: Column, whole: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (whole + 5 kept))`` of longs, exactly; null where nothing is kept."""
    above = (count + SMOOTH).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", above, (whole + kept * SMOOTH).cast("decimal(20,0)")))


def _blocks(table: pa.Table) -> pa.Table:
    """Sums over one slice of vectors for the sources of two blocks: ``a, b, total`` and in ``seen`` how many terms they
    are over. Rows without terms (``m`` of 0) name the sources of the blocks."""
    lang, one, two = (table.column(c)[0].as_py() for c in ("lang", "block_a", "block_b"))
    of_block, source, p, m = (table.column(c).to_numpy() for c in ("of_block", "source_at", "p", "m"))
    real = m > 0
    vectors, row = np.unique(table.column("vector_id").to_numpy()[real], return_inverse=True)
    many = np.zeros(len(vectors), np.int64)
    many[row] = m[real]
    sides = []
    for block in (one, two):
        named = ~real & (of_block == block)
        order = np.argsort(source[named])
        sources, own = source[named][order], of_block[real] == block
        dense = np.repeat(p[named][order][None, :], len(vectors), 0)
        dense[row[own], np.searchsorted(sources, source[real][own])] = p[real][own]
        sides.append((sources, dense))
    (left, p), (right, q) = sides
    sums = np.array([(np.abs(q - p[:, i : i + 1]) * many[:, None]).sum(0) for i in range(len(left))], np.int64).ravel()
    n = len(sums)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": np.repeat(left, len(right)), "b": np.tile(right, len(left)), "total": sums, "seen": np.full(n, many.sum())})


def _pair_sums(entries: DataFrame, groups: DataFrame, slices: int) -> DataFrame:
    """``lang, a, b, total, seen`` by numbers of sources, from ``lang, vector_id, source_at, p, m, n_blocks`` rows."""
    real = entries.select("lang", "vector_id", F.pmod("vector_id", F.lit(slices)).alias("slice"), "source_at", "p", "m", "n_blocks")
    zero = F.lit(0).cast("long")
    names = groups.where("v > 0").select("lang", zero.alias("vector_id"), F.explode(F.sequence(zero, F.lit(slices - 1).cast("long"))).alias("slice"), "source_at", F.col("p0").alias("p"), zero.alias("m"), "n_blocks")
    placed = real.unionByName(names).withColumn("of_block", F.floor(F.col("source_at") / BLOCK))
    # every row goes to every pair of blocks that holds its own
    dealt = placed.select("*", F.explode(F.sequence(zero, F.col("n_blocks") - 1)).alias("other"))
    dealt = dealt.select("lang", "slice", F.least("of_block", "other").alias("block_a"), F.greatest("of_block", "other").alias("block_b"), "vector_id", "source_at", "p", "m", "of_block")
    summed = dealt.groupBy("lang", "block_a", "block_b", "slice").applyInArrow(_blocks, "lang string, a long, b long, total long, seen long")
    sums = summed.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    # two blocks come in one order only
    other = sums.where(F.floor(F.col("a") / BLOCK) < F.floor(F.col("b") / BLOCK)).select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "total", "seen")
    return sums.unionByName(other)


def audit(documents: DataFrame, least: int = 30, ranks: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: for every group its ``pair`` rows, the other sources of its language
    by the sum of differences of shares, and its ``term`` rows, the first ``ranks`` terms that it has more of than its language."""
    named = packed(documents, text=text, lang=lang, source=source)
    plain = named.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = materialize(kept_terms(plain, least), "divergence-terms")
    zero = F.lit(0).cast("long")
    whole = F.aggregate("vector", zero, lambda s, e: s + e["n"])
    vectors = terms.groupBy("lang", "code").agg(F.count(F.lit(1)).alias("m"), F.first("vector").alias("vector"))
    numbered = vectors.select("lang", "code", F.monotonically_increasing_id().alias("vector_id"), "m", "vector")
    listed = materialize(numbered, "divergence-vectors").select("lang", "code", "vector_id", "m", whole.alias("whole"), F.explode("vector").alias("e"))
    entries = materialize(listed.select("lang", "code", "vector_id", "m", "whole", "e.source", "e.n"), "divergence-entries")

    in_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(whole).alias("lang_n"))
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("group_n"), F.count(F.lit(1)).alias("n_entries"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = plain.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs")).join(sums, ["lang", "source"], "left").join(in_lang, "lang", "left")
    groups = groups.select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("group_n", "n_entries", "v", "lang_n")],
        (F.row_number().over(by_name) - 1).cast("long").alias("source_at"),
        F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / BLOCK).alias("n_blocks"),
    )
    groups = materialize(groups.withColumn("p0", share(zero, F.col("group_n"), F.col("v"))), "divergence-groups")

    n_entries = groups.agg(F.coalesce(F.sum("n_entries"), zero)).first()[0]
    n_vectors = entries.select("vector_id").distinct().count()
    valued = join_counted(entries, groups.where("n_entries > 0"), ["lang", "source"], n_entries, "n_entries")
    valued = valued.withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
    sums = _pair_sums(valued, groups, max(1, -(-n_vectors // SLICE)))
    return _pairs(groups, sums).unionByName(_first_terms(valued, terms, ranks))


def _pairs(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """The ``pair`` rows: every two sources of a language."""
    side = lambda c: groups.select("lang", F.col("source_at").alias(c), F.col("source").alias(f"source_{c}"), F.col("p0").alias(f"p0_{c}"), *(["v"] if c == "a" else []))
    # terms that neither of their blocks has were not sent
    both = side("a").join(side("b"), "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    unseen = (F.col("v") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("p0_a") - F.col("p0_b"))
    value = F.coalesce("total", F.lit(0)) + F.coalesce(unseen, F.lit(0))
    rows = both.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.cast("long").alias("value"))
    return rows.withColumn("rank", F.row_number().over(_best("lang", "source")).cast("int"))


def _best(*by: str):
    return Window.partitionBy(*by).orderBy(F.desc("value"), "item")


def _first_terms(valued: DataFrame, terms: DataFrame, ranks: int) -> DataFrame:
    """The ``term`` rows. A vector's terms have one value, so only its first terms by name can be among the first of a group."""
    q = share(F.col("whole"), F.col("lang_n"), F.col("v"))
    above = valued.where(F.col("n") > 0).select("lang", "source", "code", (F.col("p") - q).alias("value")).where("value > 0")
    named = terms.select("lang", "code", F.col("term").alias("item")).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "code").orderBy("item"))).where(F.col("nth") <= ranks)
    rows = above.join(named.drop("nth"), ["lang", "code"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    return rows.withColumn("rank", F.row_number().over(_best("lang", "source"))).where(F.col("rank") <= ranks).withColumn("rank", F.col("rank").cast("int"))
