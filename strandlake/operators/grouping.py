"""Grouping of keyed segments: ids, ordinals, partners of splitters, and votes of sampled k-mers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kmer_value
from ..functions.packing import near_in_group
from ..sources.shipping import ship

RAW_GROUPS = 16
ARRIVAL = ("sample_ord", "contig_ord", "place")


def key_sizes(keyed: DataFrame) -> DataFrame:
    """``key1, key2, n_segments`` of segments with both ends."""
    return keyed.where("key1 is not null").groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n_segments"))


def first_seen(keyed: DataFrame) -> DataFrame:
    """``key1, key2`` with ``first``: the struct (sample_ord, contig_ord, place) of the first arrival."""
    return keyed.where("key1 is not null").groupBy("key1", "key2").agg(F.min(F.struct(*ARRIVAL)).alias("first"))


def numbered(keys: DataFrame, order: list[str], base: int = 0, name: str = "group_id") -> DataFrame:
    """Consecutive ids in the order of the given columns, without a window over all rows.

    Rows are numbered inside each value of the first column (a sample); one row per value passes the window of offsets.
    """
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.groupBy(F.col(order[0]).alias("__first")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:]))
    joined = keys.withColumn(name, inside - 1).join(offsets, F.col(order[0]) == F.col("__first"))
    return joined.withColumn(name, (F.col(name) + F.col("__base") + base).cast("long")).drop("__first", "__base")


def in_group_ordinals(members: DataFrame, group: tuple[str, ...] = ("key1", "key2")) -> DataFrame:
    """Adds ``in_group``: 0 for the first arrival of a group (its reference), then 1, 2, ..."""
    order = Window.partitionBy(*group).orderBy(*ARRIVAL)
    return members.withColumn("in_group", (F.row_number().over(order) - 1).cast("long"))


def raw_round_robin(keyed: DataFrame) -> DataFrame:
    """Segments without any terminal k-mer, dealt over the raw groups inside a sample: ``raw_group``.

    Of n such segments in order, the last ceil(n / 16) stay in group 0; the others go to 1, 2, ..., 15, 1, 2, ...
    """
    none = keyed.where("front is null and back is null")
    of_sample = Window.partitionBy("sample_ord")
    j = F.row_number().over(of_sample.orderBy("contig_ord", "place")) - 1
    n = F.count(F.lit(1)).over(of_sample)
    dealt = none.select(*ARRIVAL, j.alias("j"), n.alias("n"))
    keep = F.ceil(F.col("n") / RAW_GROUPS)
    return dealt.select(*ARRIVAL, F.when(F.col("j") >= F.col("n") - keep, 0).otherwise(F.col("j") % (RAW_GROUPS - 1) + 1).cast("int").alias("raw_group"))


def partners(keyed: DataFrame) -> DataFrame:
    """``ck, partners``: for every splitter, the sorted distinct k-mers at the other end of its groups."""
    keys = keyed.where("key1 is not null").select("key1", "key2").distinct()
    ends = keys.select(F.col("key1").alias("ck"), F.col("key2").alias("other")).union(keys.select(F.col("key2").alias("ck"), F.col("key1").alias("other")))
    return ends.groupBy("ck").agg(F.array_sort(F.collect_set("other")).alias("partners"))


def middle_candidates(pairs: DataFrame, partner_lists: DataFrame) -> DataFrame:
    """For pairs ``front, back`` of splitters, the smallest partner of both: ``front, back, middle``; pairs without one
    are left out."""
    a = partner_lists.select(F.col("ck").alias("front"), F.col("partners").alias("p1"))
    b = partner_lists.select(F.col("ck").alias("back"), F.col("partners").alias("p2"))
    joined = pairs.join(a, "front").join(b, "back")
    return joined.select("front", "back", F.array_min(F.array_intersect("p1", "p2")).alias("middle")).where("middle is not null")


def triangles(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """For pairs of splitters, the third ones that groups of earlier rounds join to both: ``key1, key2, round, middle``, the
    pair's end ``ck`` with fewer groups and the other one ``far``, and the rounds ``near`` and ``away`` of the two groups.

    ``pairs``: ``key1, key2, round``; ``groups`` the same, each key once. The groups of the end that has fewer are walked and
    the third side is looked up, so a splitter of very many groups is never listed for each of them."""
    one = groups.select(F.col("key1").alias("ck"), F.col("key2").alias("middle"), F.col("round").alias("near"))
    ends = one.unionByName(groups.where("key1 <> key2").select(F.col("key2").alias("ck"), F.col("key1").alias("middle"), F.col("round").alias("near")))
    sizes = ends.groupBy("ck").agg(F.count(F.lit(1)).alias("n"))
    a, b = (sizes.select(F.col("ck").alias(f"key{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    fewer = F.col("n1") <= F.col("n2")
    asked = pairs.where("key1 <> key2").select("key1", "key2", "round").join(a, "key1").join(b, "key2")
    asked = asked.select("key1", "key2", "round", F.when(fewer, F.col("key1")).otherwise(F.col("key2")).alias("ck"), F.when(fewer, F.col("key2")).otherwise(F.col("key1")).alias("far"))
    walked = asked.join(ends, "ck").where("near < round").withColumns({"g1": F.least("far", "middle"), "g2": F.greatest("far", "middle")})
    third = groups.select(F.col("key1").alias("g1"), F.col("key2").alias("g2"), F.col("round").alias("away"))
    return walked.join(third, ["g1", "g2"]).where("away < round").select("key1", "key2", "round", "middle", "ck", "far", "near", "away")


def opened_in_rounds(firsts: DataFrame, settled: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``firsts`` (new pairs ``key1, key2`` with the ``round`` in which each comes first) whose pair opens a group:
    all but those that two groups of earlier rounds, or of ``settled``, bridge in that round.

    Whether a pair opens depends on earlier rounds only, so it is found by steps and not round by round: a step decides the
    pairs all of whose bridges are decided, and carries on no others. There are as many steps as the longest chain of pairs
    of which each waits for the one before. ``keep`` stores a table and reads it back; the rounds of ``firsts`` are 0 or more.
    """
    every = settled.select("key1", "key2", F.lit(-1).alias("round")).unionByName(firsts.select("key1", "key2", F.col("round").cast("int").alias("round")))
    leg = lambda c, i: (F.least(c, "middle").alias(f"a{i}"), F.greatest(c, "middle").alias(f"b{i}"))
    waiting = keep(triangles(firsts, every).select("key1", "key2", *leg("ck", 1), *leg("far", 2), ((F.col("near") < 0) & (F.col("away") < 0)).alias("holds")), "bridges")
    step, shut = 0, []
    while not waiting.isEmpty():
        shut.append(waiting.where("holds").select("key1", "key2").distinct())
        left = waiting.join(shut[-1], ["key1", "key2"], "left_anti")
        known = shut[-1].withColumn("shut", F.lit(True)).unionByName(left.select("key1", "key2").distinct().withColumn("shut", F.lit(False)))
        s1, s2 = (known.select(F.col("key1").alias(f"a{i}"), F.col("key2").alias(f"b{i}"), F.col("shut").alias(f"s{i}")) for i in (1, 2))
        live = left.join(s1, ["a1", "b1"], "left").join(s2, ["a2", "b2"], "left").where("not coalesce(s1, false) and not coalesce(s2, false)")
        waiting = keep(live.select("key1", "key2", "a1", "b1", "a2", "b2", (F.col("s1").isNull() & F.col("s2").isNull()).alias("holds")), f"bridges{step}")
        step += 1
    return reduce(lambda df, pairs: df.join(pairs, ["key1", "key2"], "left_anti"), shut, firsts)


#: Width of the buckets of places by which k-mers find the segments around them.
BUCKET = 1 << 12


def inside(found: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """k-mers (``sample_ord, contig_ord, end``) joined with the segments (``start, last``) that hold them whole; by
    buckets of places, so a contig of many segments is no single key."""
    bucket = F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("last") / BUCKET)))
    placed = spans.withColumn("bucket", bucket)
    joined = found.withColumn("bucket", F.floor(F.col("end") / BUCKET)).join(placed, ["sample_ord", "contig_ord", "bucket"])
    return joined.where((F.col("end") <= F.col("last")) & (F.col("end") - k + 1 >= F.col("start"))).drop("bucket")


def _spans(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("sample_ord", "contig_ord", "start", (F.col("start") + F.col("raw_length") - 1).alias("last"), *columns)


def mapped_kmers(sampled: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """``ck, key1, key2, forward``: sampled k-mers (with ``ck, forward``) wherever they lie inside keyed segments:
    ``forward`` says whether the k-mer is canonical in the direction of the group."""
    found = inside(sampled, _spans(keyed.where("key1 is not null"), "key1", "key2", "is_rev_comp"), k)
    return found.select("ck", "key1", "key2", (F.col("forward") != F.col("is_rev_comp")).alias("forward"))


def fallback_map(sampled: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """:func:`mapped_kmers`, one row per k-mer, key and direction."""
    return mapped_kmers(sampled, keyed, k).distinct()


#: Rows that a cell of :func:`fallback_votes` holds, rows that pass it at a time, and pairs of rows that it counts at a time.
HELD, PASSED, COUNTED = 1 << 21, 1 << 16, 1 << 20
_VOTES = "sample_ord int, contig_ord int, place int, key1 string, key2 string, is_rev_comp boolean, votes long"
_VOTES_NAMES = [x.split()[0] for x in _VOTES.split(", ")]


def _letters(values: np.ndarray, k: int) -> pa.Array:
    """k-mers as strings, from left-aligned numbers."""
    shifts = np.array([62 - 2 * i for i in range(k)], np.uint64)
    text = np.frombuffer(b"ACGT", np.uint8)[((values.view(np.uint64)[:, None] >> shifts) & np.uint64(3)).astype(np.int64)]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(values), [None, pa.py_buffer(np.ascontiguousarray(text))]).cast(pa.binary()).cast(pa.string())


def _sum_votes(k: int, least: int, most: int | None):
    """Votes inside cells. A cell's held rows come first; the others follow in the order of their segments or keys and pass by.
    With ``most``, keys are held and segments pass, as the best keys of a segment are chosen. Without, segments are held and
    keys pass: then the rows of a key follow one another and are stored in few bytes, however many keys there are."""

    def letters(keys: np.ndarray) -> list[pa.Array]:
        return [_letters(np.ascontiguousarray(keys[:, i]), k) for i in (0, 1)]

    def one(held: tuple, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ck, number, bits, heads, texts = held
        low = np.searchsorted(ck, rows["ck"], "left")
        n = np.searchsorted(ck, rows["ck"], "right") - low
        new = np.append(True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]))
        starts = np.flatnonzero(new)
        upto = np.append(0, np.cumsum(n))
        first = 0
        while first < len(starts):
            # whole segments or keys, at least one: a segment and key are in one cell only
            begin = starts[first]
            last = max(first + 1, int(np.searchsorted(upto[starts], upto[begin] + COUNTED)))
            end = starts[last] if last < len(starts) else len(rows)
            some = slice(begin, end)
            total = int(upto[end] - upto[begin])
            if total:
                m = n[some]
                at = np.repeat(low[some] - (upto[begin:end] - upto[begin]), m) + np.arange(total)
                group = np.repeat(np.cumsum(new[some]) - 1, m)
                here, there = np.repeat(rows["bits"][some], m), bits[at]
                pair = (group * len(heads) + number[at]) * 2
                # bit 0: read forward, bit 1: read backward; a k-mer counts once for a direction
                alike, turned = (here & there) != 0, (((here & 1) & (there >> 1)) | ((here >> 1) & (there & 1))) != 0
                value, votes = np.unique(np.concatenate([pair[alike], pair[turned] + 1]), return_counts=True)
                passing, in_held, rc = value // (2 * len(heads)), value // 2 % len(heads), value % 2 == 1
                keep = votes >= least
                passed = np.stack([rows["a"][starts[first:last]], rows["b"][starts[first:last]]], axis=1)
                if most is not None:
                    k1, k2 = heads[in_held, 0].view(np.uint64), heads[in_held, 1].view(np.uint64)
                    order = np.lexsort((rc, ~np.where(rc, k1, k2), ~np.where(rc, k2, k1), -votes, passing))
                    order = order[keep[order]]
                    first_of = np.append(True, passing[order][1:] != passing[order][:-1]) if len(order) else np.zeros(0, bool)
                    since = np.arange(len(order)) - np.maximum.accumulate(np.where(first_of, np.arange(len(order)), 0))
                    chosen = order[since < most]
                    segments, segment, key, text = passed, passing, in_held, texts
                else:
                    chosen = np.flatnonzero(keep)
                    segments, segment, key, text = heads, in_held, passing, letters(passed)
                for x in range(0, len(chosen), 1 << 16):
                    part = chosen[x : x + (1 << 16)]
                    a, b = segments[segment[part]].T
                    named = [pa.DictionaryArray.from_arrays(pa.array(key[part].astype(np.int32)), t).cast(pa.string()) for t in text]
                    columns = [pa.array((a >> 32).astype(np.int32)), pa.array((a & 0xFFFFFFFF).astype(np.int32)), pa.array(b.astype(np.int32)), *named, pa.array(rc[part]), pa.array(votes[part])]
                    yield pa.RecordBatch.from_arrays(columns, _VOTES_NAMES)
            first = last

    def indexed(rows: np.ndarray) -> tuple:
        """A cell's held rows in the order of k-mers, with the numbers of their keys or segments, which come in order."""
        new = np.append(True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]))
        heads = np.stack([rows["a"][new], rows["b"][new]], axis=1)
        order = np.argsort(rows["ck"], kind="stable")
        return rows["ck"][order], (np.cumsum(new) - 1)[order], rows["bits"][order], heads, None if most is None else letters(heads)

    kind = np.dtype([("a", np.int64), ("b", np.int64), ("ck", np.int64), ("bits", np.int8)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, first, waiting, n, enough = None, None, [], [], 0, PASSED
        for batch in batches:
            cells, passes = batch.column("cell").to_numpy(), batch.column("passes").to_numpy(zero_copy_only=False)
            rows = np.empty(batch.num_rows, kind)
            for name in kind.names:
                rows[name] = batch.column(name).to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (passes[1:] != passes[:-1])) + 1
            for some in np.split(np.arange(len(rows)), edges):
                if cells[some[0]] != cell:
                    if held and n:
                        yield from one(held, np.concatenate(waiting))
                    cell, held, first, waiting, n, enough = cells[some[0]], None, [], [], 0, PASSED
                if not passes[some[0]]:
                    first.append(rows[some])
                    continue
                if first:
                    held, first = indexed(np.concatenate(first)), []
                if not held:
                    continue
                waiting.append(rows[some])
                n += len(some)
                if n >= enough:  # all but the last segment or key, which may go on
                    every = np.concatenate(waiting)
                    other = np.flatnonzero((every["a"] != every["a"][-1]) | (every["b"] != every["b"][-1]))
                    if len(other):
                        yield from one(held, every[: other[-1] + 1])
                        every = every[other[-1] + 1 :]
                    waiting, n = [every], len(every)
                    enough = max(PASSED, 2 * n)  # a key of very many rows is not put together anew for each batch
        if held and n:
            yield from one(held, np.concatenate(waiting))

    return run


def fallback_votes(sampled: DataFrame, unkeyed: DataFrame, mapped: DataFrame, k: int, keep: Callable[[DataFrame, str], DataFrame], least: int = 1, most: int | None = None) -> DataFrame:
    """For segments without a key, the number of distinct sampled k-mers they share with each key and direction:
    ``key1, key2, is_rev_comp, votes``. ``mapped``: as :func:`mapped_kmers` gives them, repeated or not. ``least``: votes that are given at all; ``most``: of a segment, at least so many of
    the best in the order of :func:`best_candidates` are given, and not all others. ``keep`` stores a table and reads it back.

    Pairs of segments and keys that share a k-mer may be very many more than either, so none is shuffled: segments and
    keys are cut into blocks, each pair of blocks is a cell of one task, and the votes of a segment for a key are all there.
    A cell holds its part of the map or of the segments, and the others pass by.
    """
    spark = sampled.sparkSession
    ship(spark)
    bits = lambda c: F.max(F.when(F.col(c), 1).otherwise(2)).bitwiseOR(F.min(F.when(F.col(c), 1).otherwise(2))).cast("tinyint").alias("bits")
    segment = (F.shiftleft(F.col("sample_ord").cast("long"), 32) + F.col("contig_ord")).alias("a"), F.col("place").cast("long").alias("b")
    own = keep(inside(sampled, _spans(unkeyed, "place"), k).select(*segment, "ck", "forward").groupBy("a", "b", "ck").agg(bits("forward")), "votes-own")
    key = kmer_value(F.col("key1"), k).alias("a"), kmer_value(F.col("key2"), k).alias("b")
    # k-mers that no segment has give no votes
    asked = mapped.select(*key, "ck", "forward").join(own.select("ck").distinct(), "ck", "left_semi")
    given = keep(asked.groupBy("a", "b", "ck").agg(bits("forward")), "votes-map")
    n_own, n_given = own.count(), given.count()
    (held, n_held), (passing, n_passing) = ((own, n_own), (given, n_given)) if most is None else ((given, n_given), (own, n_own))
    least_cells = 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n_held // HELD), min(least_cells, round((least_cells * n_held / max(1, n_passing)) ** 0.5)))
    parts = max(1, -(-least_cells // blocks))
    block, part = (F.pmod(F.xxhash64("a", "b"), F.lit(x)) for x in (blocks, parts))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = held.select("*", block.alias("block"), every(parts).alias("part"), F.lit(False).alias("passes"))
    right = passing.select("*", every(blocks).alias("block"), part.alias("part"), F.lit(True).alias("passes"))
    dealt = left.unionByName(right).select((F.col("block") * parts + F.col("part")).alias("cell"), "passes", "a", "b", "ck", "bits")
    placed = dealt.repartitionByRange(blocks * parts, "cell").sortWithinPartitions("cell", "passes", "a", "b")
    return placed.mapInArrow(_sum_votes(k, least, most), _VOTES)


def best_candidates(votes: DataFrame, least: int = 1, most: int = 10) -> DataFrame:
    """Per segment the ``most`` candidates of highest (votes, key as the segment reads it), of at least ``least`` votes and
    half the best. A key of two equal k-mers reads alike in both directions; with as many votes, the forward one goes first."""
    first = F.when(F.col("is_rev_comp"), F.col("key2")).otherwise(F.col("key1"))
    second = F.when(F.col("is_rev_comp"), F.col("key1")).otherwise(F.col("key2"))
    order = Window.partitionBy(*ARRIVAL).orderBy(F.desc("votes"), first.desc(), second.desc(), "is_rev_comp")
    enough = votes.where(F.col("votes") >= least)
    ranked = enough.select("*", F.row_number().over(order).alias("rank"), F.max("votes").over(Window.partitionBy(*ARRIVAL)).alias("best"))
    return ranked.where((F.col("rank") <= most) & (F.col("votes") * 2 >= F.col("best"))).drop("best").withColumn("rank", F.col("rank").cast("long"))


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 inside every group, in the order of the columns. Rows are numbered inside a group and the
    first of these columns (a sample); one row for each of those passes the window of a group's offsets."""
    before = Window.partitionBy("__group").orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col(group).alias("__group"), F.col(order[0]).alias("__first")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__group", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    each = F.row_number().over(Window.partitionBy(group, order[0]).orderBy(*order[1:])) - 1
    joined = rows.withColumn(name, each).join(offsets, (F.col(group) == F.col("__group")) & (F.col(order[0]) == F.col("__first")))
    return joined.withColumn(name, (F.col(name) + F.col("__base")).cast("long")).drop("__group", "__first", "__base")


def split_place(cost1: list[int], cost2: list[int], k: int) -> tuple[int, int]:
    """(least cost, place) of coding everything up to a place with the first costs and everything from it with the second:
    the first best place, moved to an end if it is too near to it."""
    left, right = np.cumsum(cost1), np.cumsum(cost2[::-1])[::-1]
    both = left + right
    at, n = int(np.argmin(both)), len(both)
    return int(both[at]), 0 if at < k + 1 else n if at + k + 1 > n else at


def best_split(costs: DataFrame, k: int) -> DataFrame:
    """``id, cost, split`` from ``id, cost1, cost2`` arrays by :func:`split_place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_place(a, b, k) for a, b in zip(batch.column("cost1").to_pylist(), batch.column("cost2").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]], ["id", "cost", "split"])

    ship(costs.sparkSession)
    return costs.select("id", "cost1", "cost2").mapInArrow(run, f"id {costs.schema['id'].dataType.simpleString()}, cost long, split long")


def shared_ids(members: DataFrame) -> DataFrame:
    """``ARRIVAL, key1, key2, in_group_id`` of members with their letters ``body``: 0 for those equal to the first arrival,
    and one number for all equal others, in the order of their first arrivals."""
    keyed = members.select(*ARRIVAL, "key1", "key2", "body", F.concat_ws("-", "key1", "key2").alias("g"))
    head = keyed.groupBy("g").agg(F.min(F.struct(*ARRIVAL, "body")).alias("h")).select("g", F.col("h.body").alias("first"))
    others = keyed.join(head, "g").where("body <> first").groupBy("g", "body").agg(F.min(F.struct(*ARRIVAL)).alias("f")).select("g", "body", "f.*")
    ids = numbered_within(others, "g", list(ARRIVAL), "n").select("g", "body", (F.col("n") + 1).alias("n"))
    return keyed.join(ids, ["g", "body"], "left").select(*ARRIVAL, "key1", "key2", F.coalesce("n", F.lit(0)).cast("long").alias("in_group_id"))


def candidate_order(one_sided: DataFrame, references: DataFrame) -> DataFrame:
    """Groups that a segment with one terminal k-mer may join, nearest in length first: ``ARRIVAL, key1, key2, rank``. Of
    equally near ones the shorter goes first, then the smaller key. ``references``: ``key1, key2, ref_length``."""
    ends = references.select("*", F.explode(F.array_distinct(F.array("key1", "key2"))).alias("own"))
    asked = one_sided.select(*ARRIVAL, "raw_length", F.coalesce("front", "back").alias("own"))
    order = Window.partitionBy(*ARRIVAL).orderBy(F.abs(F.col("raw_length") - F.col("ref_length")), "ref_length", "key1", "key2")
    return asked.join(ends, "own").select(*ARRIVAL, "key1", "key2", F.row_number().over(order).cast("long").alias("rank"))


def near_ids(placed: DataFrame, group: tuple[str, ...] = ("key1", "key2")) -> DataFrame:
    """Adds ``code``: each in-group id relative to the largest id that its group has shown before."""
    before = Window.partitionBy(*group).orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, -1)
    largest = F.max(F.when(F.col("in_group_id") > 0, F.col("in_group_id"))).over(before)
    return placed.withColumn("code", near_in_group(F.col("in_group_id"), largest))


def for_range(found: DataFrame, low: int, high: int) -> DataFrame:
    """Segments that hold any of the positions ``low`` to ``high`` of their contig; the filter reaches the scan."""
    return found.where((F.col("start") <= high) & (F.col("start") + F.col("raw_length") > low))
