"""A collection on disk: Parquet tables that grow by batches.

    samples    sample_ord, sample
    contigs    sample_ord, sample, contig_ord, contig, contig_full, length, n_segments
    segments   sample_ord, contig_ord, place, start, raw_length, group_id, in_group_id, is_rev_comp
    groups     group_id, key1, key2, ref_seq            one row per group, stored by the batch that created it
    deltas     group_id, in_group_id, pack, delta       code against the group's reference; letters in raw groups
    splitters  ck
    fallback   ck, key1, key2, forward                  sampled k-mers of the reference, where a batch made them
    _log       one file per commit: parameters, commands, names of batches

Every table is partitioned by ``batch``, whose name no two writers share; a batch counts once a commit lists it (see
``commits``). Contigs and segments lie in blocks of ``SAMPLES_PER_BLOCK`` samples, groups and deltas in blocks of
``GROUPS_PER_BLOCK`` ids, sorted inside: a query first finds its segments, in the blocks of its samples, and then reads
only the blocks and row groups that hold their groups.

``create`` and ``append`` take samples in rounds, one each (or ``pack_cardinality`` of them, where contigs are samples of
their own): a segment sees groups of earlier rounds and batches only, so a call and a call per sample give the same groups.
There is no loop over samples: what a round opens depends on keys alone, and is found in a few steps (``grouping``). The contigs of a call are stored once and read from there. ``append`` starts from the
latest commit and is repeated if another writer commits first, so nothing is lost; a collection that is replaced has an id
of its own, and handles on the old one can't add to it.

Segments with two terminal k-mers belong to the group of their ordered pair. *Settled* groups are those of earlier batches,
in a new collection those of the reference sample; *known* ones are the settled and those that earlier rounds opened.

* Where a pair is not known, but both k-mers end known groups that share a third one, the segment is coded against both
  groups and goes to one of them, or is cut in two that overlap by k letters, wherever that is cheapest.
* With ``fallback``, segments that still have no known group go to one of the reference's with which they share most of its
  sampled k-mers.
* Segments with one terminal k-mer take the group ending in it that codes them cheapest, if it saves enough; else they
  open a one-sided group. Segments without any go to sixteen raw groups.

Equal codes of a group are stored once. A member equal to its group's reference has in-group id 0 and stores nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import base64_name, contig_query, normalised_range, reverse_complement, short_name
from ..sources.shipping import ship
from . import catalog, grouping, kmers, segmentation
from .codec import Coder, decode_rows, encode_rows, windows_and_runs
from .commits import Log

SAVING, LAYOUT = 16, 3
#: Width of the blocks of the tables. Ids of groups that a query looks up by value; of more, whole tables are joined. How often an
#: append is begun anew when other writers commit first.
SAMPLES_PER_BLOCK, GROUPS_PER_BLOCK, MOST_IDS, TRIES = 64, 4096, 10_000, 20
TABLES = {
    "samples": "sample_ord int, sample string",
    "contigs": "sample_ord int, sample string, contig_ord int, contig string, contig_full string, length long, n_segments int",
    "segments": "sample_ord int, contig_ord int, place int, start long, raw_length long, group_id long, in_group_id long, is_rev_comp boolean",
    "groups": "group_id long, key1 string, key2 string, ref_seq string",
    "deltas": "group_id long, in_group_id long, pack long, delta string",
    "splitters": "ck string",
    "fallback": "ck long, key1 string, key2 string, forward boolean",
}
#: How the tables with blocks are cut: width of a block of the first column; columns by which rows are sorted in it.
BLOCKS = {
    "contigs": ("sample_ord", SAMPLES_PER_BLOCK, ("sample_ord", "contig_ord")),
    "segments": ("sample_ord", SAMPLES_PER_BLOCK, ("sample_ord", "contig_ord", "place")),
    "groups": ("group_id", GROUPS_PER_BLOCK, ("group_id",)),
    "deltas": ("group_id", GROUPS_PER_BLOCK, ("group_id", "in_group_id")),
}
#: Rows of one value of the first column that a task writes: of a larger group or sample, many tasks do.
ROWS_TOGETHER = 1 << 14
NAMES = ("sample_ord", "sample", "contig_ord", "contig", "contig_full")
# Fixed values: (default, least, most) of every parameter; values outside are moved to the nearest bound.
PARAMETERS = {"k": (31, 17, 32), "min_match": (20, 15, 32), "segment_size": (60_000, 100, 1_000_000), "pack_cardinality": (50, 1, 1_000_000_000), "fallback": (0.0, 0.0, 0.05)}
# Votes that a fallback candidate needs, by terminal k-mers that the segment has; segments of collections
# with at most so large segments take the candidate of most votes without coding; and the share of their letters that a
# fallback candidate has to save in adaptive mode.
VOTES, SHORT, ADAPTIVE_LIMIT = {0: 1, 1: 5, 2: 2}, 10_000, 0.2
#: Candidates of a segment that are looked at.
MOST_CANDIDATES = 10


def clamp(name: str, value: float | None) -> float:
    default, least, most = PARAMETERS[name]
    return default if value is None else min(max(value, least), most)


def _costs(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, coder = None, None
        for batch in batches:
            costs = []
            for ref, body in zip(batch.column("ref_seq").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if ref != last:
                    last, coder = ref, Coder(ref, min_match)
                costs.append(coder.cost(body, len(body)))  # no candidate may cost more than the letters
            keep = [n for n in batch.schema.names if n not in ("ref_seq", "body")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(costs, pa.int64())], [*keep, "cost"])

    return run


_BEST = "sample_ord int, contig_ord int, place int, raw_length long, cost long, key1 string, key2 string, is_rev_comp boolean"
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
#: Letters of a cell's segments whose windows are kept, about 32 bytes each.
WINDOWS_HELD = 1 << 20


def _nearest_first(min_match: int):
    """For the segments and the groups of a cell, every segment's best group: ``arrival, raw_length, cost, key1, key2,
    is_rev_comp``.

    Groups are visited in the order of how near their length is to that of the segments, each is indexed once, and what a
    segment has found so far bounds what another group may cost."""

    def one(asked: list[dict], groups: list[dict]) -> Iterator[tuple]:
        middle = sorted(r["raw_length"] for r in asked)[len(asked) // 2]
        best = [(r["bound"], r["b1"], r["b2"], r["b_rc"]) if r["b1"] is not None else (len(r["seq"]), None, None, None) for r in asked]
        turned: dict[int, str] = {}
        # windows of a text are the same for every group, and are kept where they are not many
        windows: dict[tuple[int, bool], tuple] = {}
        held = sum(r["raw_length"] for r in asked) <= WINDOWS_HELD
        for g in sorted(groups, key=lambda g: (abs(len(g["ref_seq"]) - middle), len(g["ref_seq"]), g["key1"], g["key2"])):
            coder = None
            for i, r in enumerate(asked):
                if g["first_sample"] >= r["sample_ord"]:
                    continue
                coder = coder or Coder(g["ref_seq"], min_match)
                forward = r["at_front"] == (g["own"] == g["key1"])  # in a group's direction its smaller k-mer comes first
                if not forward and i not in turned:
                    turned[i] = r["seq"].translate(_COMPLEMENT)[::-1]
                text = r["seq"] if forward else turned[i]
                if text != g["ref_seq"] and best[i][0] == 0:
                    continue  # only an equal reference costs nothing
                if held and coder.index is None and text != g["ref_seq"] and (i, forward) not in windows:
                    windows[i, forward] = windows_and_runs(text, coder.key)
                cost = coder.cost(text, best[i][0], windows.get((i, forward)))
                found = (cost, g["key1"], g["key2"], not forward)
                if cost < best[i][0] or (cost == best[i][0] and (best[i][1] is None or found < best[i])):
                    best[i] = found
        for r, b in zip(asked, best, strict=True):
            if b[1] is not None:
                yield r["sample_ord"], r["contig_ord"], r["place"], r["raw_length"], *b

    def run(asked: pa.Table, groups: pa.Table) -> pa.Table:
        cells: dict[tuple, tuple[list, list]] = {}
        # most groups' splitters end no segment, and some segments' end no group
        both = pc.is_in(groups["own"], asked["own"]), pc.is_in(asked["own"], groups["own"])
        for side, table in enumerate((asked.filter(both[1]), groups.filter(both[0]))):
            for r in table.to_pylist():
                cells.setdefault((r["own"], r["part"], r["chunk"]), ([], []))[side].append(r)
        rows = [x for a, g in cells.values() if a and g for x in one(a, g)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        return pa.table([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], [x.split()[0] for x in _BEST.split(", ")])

    return run


def _in_other_chunks(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Segments with what they have found, once for each chunk that they have not met."""
    arrival = list(grouping.ARRIVAL)
    known = best.select(*arrival, F.col("cost").alias("bound"), F.col("key1").alias("b1"), F.col("key2").alias("b2"), F.col("is_rev_comp").alias("b_rc"))
    others = rows.where("n_chunks > 1").join(known, arrival, "left")
    each = others.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks").cast("long") - 1))).where("other <> chunk")
    return each.withColumn("chunk", F.col("other")).drop("other")


#: Letters of segments, and of groups, that a task compares at a time.
SIDE = 16 << 20


def cheapest_groups(one_sided: DataFrame, groups: DataFrame, min_match: int, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """For segments with one terminal k-mer, the known group that codes them cheapest: arrival columns, ``key1, key2,
    is_rev_comp, cost``. Ties go to the smaller key, then to the segment's own direction. A group must be of an earlier
    sample, and must save ``SAVING`` letters (or any, for shorter segments).

    A hot splitter's groups are cut into chunks by length, its segments into parts, each of about ``SIDE`` letters, so no task
    has all of it, and no row is made for a segment and a group; the others are put together in cells. Segments meet the chunk nearest in length first;
    what they find there bounds the search in the others. ``keep`` stores what is read twice.
    """
    spark = one_sided.sparkSession
    ship(spark)
    arrival = list(grouping.ARRIVAL)
    ends = groups.where("key1 is not null and key2 is not null").select("*", F.explode(F.array_distinct(F.array("key1", "key2"))).alias("own"))
    asked = one_sided.select(*arrival, "raw_length", F.coalesce("front", "back").alias("own"), F.col("front").isNotNull().alias("at_front"), "seq")
    # one pass over numbers: splitters whose segments or groups are too many letters for a cell, and the letters of all others
    sides = asked.select("own", F.col("raw_length").alias("a"), F.lit(0).cast("long").alias("g")).unionByName(ends.select("own", F.lit(0).cast("long").alias("a"), F.char_length("ref_seq").cast("long").alias("g")))
    sides = keep(sides.groupBy("own").agg(F.sum("a").alias("a"), F.sum("g").alias("g")).where("a > 0 and g > 0"), "sides")
    hot = sides.where((F.col("a") > SIDE) | (F.col("g") > SIDE)).select("own")
    small = sides.where((F.col("a") <= SIDE) & (F.col("g") <= SIDE)).agg(F.sum("a"), F.sum("g")).first()
    few = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(small[0] or 0, small[1] or 0) // SIDE))
    plain = [F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("chunk")]
    any_hot = not hot.isEmpty()
    cold = lambda df: df.join(hot, "own", "left_anti") if any_hot else df
    best = _met(cold(asked).select("*", *plain, *_nothing()), cold(ends).select("own", "key1", "key2", "first_sample", "ref_seq", *plain), few, min_match)
    if any_hot:
        best = best.unionByName(_of_hot(asked.join(hot, "own", "left_semi"), ends.join(hot, "own", "left_semi"), min_match, keep))
    bound = F.when(F.col("raw_length") < SAVING, F.col("raw_length")).otherwise(F.col("raw_length") - SAVING)
    return best.where(F.col("cost") <= bound).select(*arrival, "key1", "key2", "is_rev_comp", "cost")


def _nothing() -> list:
    """Columns of a segment that has not found a group yet."""
    return [F.lit(None).cast(t).alias(n) for n, t in (("bound", "long"), ("b1", "string"), ("b2", "string"), ("b_rc", "boolean"))]


def _met(rows: DataFrame, groups: DataFrame, cells: int, min_match: int) -> DataFrame:
    """Segments and groups of equal splitter, part and chunk meet, many of these in a cell."""
    cell = F.pmod(F.xxhash64("own", "part", "chunk"), F.lit(cells)).alias("cell")
    return rows.select("*", cell).groupBy("cell").cogroup(groups.select("*", cell).groupBy("cell")).applyInArrow(_nearest_first(min_match), _BEST)


def _of_hot(asked: DataFrame, ends: DataFrame, min_match: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The cheapest groups of segments, chunk by chunk and part by part."""
    arrival = list(grouping.ARRIVAL)
    # numbers only, without letters: one row per group and end
    by_length = Window.partitionBy("own").orderBy("n", "key1", "key2")
    sized = ends.select("own", "key1", "key2", F.char_length("ref_seq").cast("long").alias("n"))
    placed = sized.withColumn("chunk", F.floor((F.sum("n").over(by_length) - F.col("n")) / SIDE))
    middles = placed.groupBy("own", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high")).groupBy("own").agg(F.sort_array(F.collect_list(F.struct("chunk", "low", "high"))).alias("chunks"))
    parts = asked.groupBy("own").agg(F.ceil(F.sum("raw_length") / SIDE).alias("n_parts")).join(middles, "own")
    away = lambda c: F.greatest(c["low"] - F.col("raw_length"), F.col("raw_length") - c["high"], F.lit(0))
    first = F.array_min(F.transform("chunks", lambda c: F.struct(away(c).alias("away"), c["chunk"].alias("chunk"))))["chunk"]
    rows = asked.join(parts, "own").withColumn("part", F.pmod(F.xxhash64(*arrival), F.col("n_parts"))).withColumn("chunk", first)
    rows = rows.select(*arrival, "raw_length", "own", "at_front", "seq", "part", "chunk", F.size("chunks").alias("n_chunks"))
    lettered = ends.join(placed.select("own", "key1", "key2", "chunk"), ["own", "key1", "key2"]).join(parts.select("own", "n_parts"), "own")
    lettered = lettered.select("own", "key1", "key2", "first_sample", "ref_seq", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("part"))
    sizes = placed.join(parts, "own").agg(F.sum(F.col("n") * F.col("n_parts")).alias("letters"), F.max("chunk").alias("chunk")).first()
    letters = max(asked.agg(F.sum("raw_length")).first()[0] or 0, sizes["letters"] or 0)
    cells = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-letters // SIDE))
    met = lambda x, y: _met(x, y, cells, min_match)
    best = met(rows.select("*", *_nothing()), lettered)
    if sizes["chunk"]:  # segments of splitters with more groups than one chunk have others to meet
        best = keep(best, "nearest")
        best = best.unionByName(met(_in_other_chunks(rows, best), lettered.join(middles.where(F.size("chunks") > 1).select("own"), "own", "left_semi")))
        best = best.groupBy(*arrival, "raw_length").agg(F.min(F.struct("cost", "key1", "key2", "is_rev_comp")).alias("b")).select(*arrival, "raw_length", "b.*")
    return best


class Collection:
    """An archive opened for reading and appending."""

    def __init__(self, spark: SparkSession, path: str, prefetch: bool = False):
        """The collection as the last commit has it. ``prefetch``: keep what is read of groups and codes in the executors'
        memory until :meth:`close`."""
        self.spark, self.path = spark, path.rstrip("/")
        self._kept: dict[str, DataFrame] | None = {} if prefetch else None
        self.number, self.state = Log(spark, self.path).latest()
        if self.state is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        self.k, self.min_match, self.segment_size, self.pack_cardinality, self.fallback, self.concatenated = (self.state["parameters"][n] for n in (*PARAMETERS, "concatenated"))
        self.batches = [x["batch"] for x in self.state["batches"]]

    # building

    @classmethod
    def create(
        cls,
        contigs: DataFrame,
        path: str,
        k: int | None = None,
        segment_size: int | None = None,
        min_match: int | None = None,
        pack_cardinality: int | None = None,
        adaptive: bool = False,
        command: str = "create",
        fallback: float | None = None,
        concatenated: bool = False,
        overwrite: bool = False,
        marker: str | None = None,
    ) -> Collection:
        """``contigs``: ``sample_ord, sample, contig_ord, contig, contig_full, seq``, or with ``offset, part`` instead of the
        letters contigs in parts; sample 0 is the reference.
        ``fallback``: share of k-mers that are sampled. ``concatenated``: contigs that are samples of their own are never
        cut in two for a missing k-mer between them. A collection that is there already is an error, or with ``overwrite``
        replaced once the new one is complete; readers that have it open go on reading it. ``marker``: see :meth:`append`."""
        spark, path = contigs.sparkSession, path.rstrip("/")
        given = {"k": k, "min_match": min_match, "segment_size": segment_size, "pack_cardinality": pack_cardinality, "fallback": fallback}
        values = {name: clamp(name, value) for name, value in given.items()} | {"concatenated": concatenated}
        log = Log(spark, path)
        number, there = log.latest()
        if there and not overwrite:
            raise FileExistsError(f"there is a collection at {path}")
        batch = _batch_name(0)
        stored = _stage(contigs.select(*NAMES, *_letters(contigs)), path, batch, "contigs")
        _named_once(stored)
        reference = stored.where("sample_ord = 0")
        tasks = kmers.tasks_for(spark, _n_letters(reference))
        _write(segmentation.select_splitters(reference, values["k"], values["segment_size"], tasks), path, "splitters", batch)
        _ingest(spark, stored, path, batch, values, adaptive)
        state = {"collection": uuid.uuid4().hex, "parameters": values, "batches": [_entry(batch, command, values["fallback"], marker)]}
        done = log.commit(number + 1, state)
        _clean(log, path, batch, done)
        if not done:
            raise FileExistsError(f"another writer has made a collection at {path}")
        return cls(spark, path)

    def append(self, contigs: DataFrame, adaptive: bool = False, command: str = "append", fallback: float | None = None, marker: str | None = None) -> Collection:
        """Adds samples to the latest state; ``sample_ord`` goes on after the last. A sample name that is already there is an
        error. ``fallback`` is that of the collection if not given. ``marker``: a name that is committed with the batch."""
        log = Log(self.spark, self.path)
        for _ in range(TRIES):
            latest = Collection(self.spark, self.path)
            if latest.state["collection"] != self.state["collection"]:
                raise ValueError(f"the collection at {self.path} was replaced")
            batch = _batch_name(len(latest.batches))
            try:
                values = latest._add(contigs, batch, adaptive, fallback)
                state = {**latest.state, "batches": [*latest.state["batches"], _entry(batch, command, values["fallback"], marker)]}
                done = log.commit(latest.number + 1, state)
            except BaseException:
                _clean(log, self.path, batch, False)
                raise
            _clean(log, self.path, batch, done)
            if done:
                return Collection(self.spark, self.path)
        raise RuntimeError(f"other writers committed first, {TRIES} times")

    def _add(self, contigs: DataFrame, batch: str, adaptive: bool, fallback: float | None) -> dict:
        """Write a batch, which no commit lists yet."""
        clash = contigs.select("sample").distinct().join(self.table("samples"), "sample", "left_semi").limit(1).collect()
        if clash:
            raise ValueError(f"sample {clash[0]['sample']!r} is already in the collection")
        base = self.table("samples").agg(F.coalesce(F.max("sample_ord"), F.lit(-1))).first()[0] + 1
        least = contigs.agg(F.min("sample_ord")).first()[0]
        moved = contigs.withColumn("sample_ord", (F.col("sample_ord") - F.lit(least or 0) + base).cast("int"))
        values = {n: getattr(self, n) for n in (*PARAMETERS, "concatenated")}
        values["fallback"] = self.fallback if fallback is None else clamp("fallback", fallback)
        stored = _stage(moved.select(*NAMES, *_letters(moved)), self.path, batch, "contigs")
        _named_once(stored)
        _ingest(self.spark, stored, self.path, batch, values, adaptive, self)
        return values

    # reading

    def table(self, name: str) -> DataFrame:
        """A table's committed batches."""
        if not self._keeps(name):
            return self._rows(name).drop("block")
        if name not in self._kept:
            self._kept[name] = self._rows(name).drop("block").persist()
        return self._kept[name]

    def _keeps(self, name: str) -> bool:
        return self._kept is not None and name in ("groups", "deltas")

    def _rows(self, name: str) -> DataFrame:
        """The same from disk, with ``block`` where the table has blocks; predicates on it choose folders."""
        return _read(self.spark, self.path, name, self.batches)

    def _of(self, name: str, ids: list[int] | None) -> DataFrame:
        """Rows of a table with these values in its first column, read from their blocks only, unless the table is kept in
        memory; all rows if ``ids`` is None."""
        column, width, _ = BLOCKS[name]
        if ids is None:
            return self.table(name)
        if self._keeps(name):
            return self.table(name).where(F.col(column).isin(ids))
        return self._rows(name).where(F.col("block").isin(sorted({i // width for i in ids})) & F.col(column).isin(ids)).drop("block")

    def close(self) -> None:
        for df in (self._kept or {}).values():
            df.unpersist()
        if self._kept:
            self._kept.clear()

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def contigs(self) -> DataFrame:
        return self.table("contigs")

    def decoded(self, segments: DataFrame, ids: list[int] | None = None) -> DataFrame:
        """Segments with their letters ``seq``, in the contig's own direction. ``ids``: the groups that they belong to, if
        these are few."""
        groups = self._of("groups", ids).select("group_id", "ref_seq")
        codes = self._of("deltas", ids).select("group_id", "in_group_id", F.col("delta").alias("body"))
        joined = segments.join(codes, ["group_id", "in_group_id"], "left").join(groups, "group_id", "left").withColumn("body", F.coalesce("body", F.lit("")))
        columns = [c for c in joined.columns if c not in ("ref_seq", "body")]
        plain = decode_rows(joined.select(*columns, "ref_seq", "body"), self.min_match)
        return plain.withColumn("seq", F.when(F.col("is_rev_comp"), reverse_complement(F.col("body"))).otherwise(F.col("body"))).drop("body")

    def _ids(self, segments: DataFrame) -> list[int] | None:
        """The groups of some segments, or None if they are more than ``MOST_IDS``."""
        found = segments.select("group_id").distinct().limit(MOST_IDS + 1).collect()
        return None if len(found) > MOST_IDS else sorted(r["group_id"] for r in found)

    def contigs_with_sequences(self, wanted: DataFrame | None = None, low: int | None = None, high: int | None = None, samples: list[int] | None = None, skip_reference: bool = False) -> DataFrame:
        """Whole contigs, or letters ``low`` to ``high`` of each (counted from 0, both included) by decoding only the
        segments that hold them. ``wanted``: ``sample_ord, contig_ord`` rows to keep; ``samples``: their numbers."""
        found, names = self._of("segments", samples), self._of("contigs", samples)
        if skip_reference:
            found, names = (x.where("sample_ord > 0") for x in (found, names))
        if wanted is not None:
            keys = wanted.select("sample_ord", "contig_ord").distinct()
            found, names = (x.join(keys, ["sample_ord", "contig_ord"], "left_semi") for x in (found, names))
        found = found.withColumn("low", F.lit(low or 0).cast("long")).withColumn("high", F.lit((1 << 62) if high is None else high).cast("long"))
        text = self._assembled(found, ["sample_ord", "contig_ord"])
        return names.join(text, ["sample_ord", "contig_ord"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))

    def _pieces(self, spans: DataFrame, by: list[str], few: bool = False) -> DataFrame:
        """``by, begin, t``: the letters that each segment gives to the range ``low`` to ``high`` wanted of its contig.

        Of the k letters that two neighbours share, the earlier gives them; segments outside the range are not decoded.
        ``few``: look their groups up by id.
        """
        inside = spans.where("start <= high and start + raw_length > low")
        parts = self.decoded(inside, self._ids(inside) if few else None)
        begin = F.greatest(F.col("low"), F.col("start") + F.when(F.col("place") > 0, F.lit(self.k)).otherwise(F.lit(0)))
        end = F.least(F.col("high"), F.col("start") + F.col("raw_length") - 1)
        pieces = parts.select(*by, begin.alias("begin"), end.alias("end"), "start", "seq").where("begin <= end")
        cut = F.substring("seq", (F.col("begin") - F.col("start") + 1).cast("int"), (F.col("end") - F.col("begin") + 1).cast("int"))
        return pieces.select(*by, "begin", cut.alias("t"))

    def _assembled(self, spans: DataFrame, by: list[str], few: bool = False) -> DataFrame:
        """``by, seq``: the pieces of every contig, put together."""
        listed = self._pieces(spans, by, few).select(*by, F.struct("begin", "t").alias("p")).groupBy(*by).agg(F.sort_array(F.collect_list("p")).alias("p"))
        return listed.select(*by, F.array_join(F.col("p.t"), "").alias("seq"))

    def get_collection(self, skip_reference: bool = False) -> DataFrame:
        return catalog.get_collection(self.contigs_with_sequences(skip_reference=skip_reference), skip_reference)

    def get_samples(self, names: list[str]) -> DataFrame:
        """Contigs of the named samples in argument order; a name that is missing is an error."""
        asked = self.spark.createDataFrame(list(enumerate(names)), "argument int, sample string")
        missing = asked.join(self.table("samples"), "sample", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(missing[0]["sample"])
        known = [r["sample_ord"] for r in self.table("samples").where(F.col("sample").isin(names)).collect()]  # no more than names
        return catalog.get_samples(self.contigs_with_sequences(samples=known), asked)

    def get_contigs(self, queries: list[str]) -> DataFrame:
        """``query_ord, header, status, seq`` for ``contig[@sample][:from-to]`` strings. Malformed queries are left out;
        status is 0, or -1 for a missing and -2 for an ambiguous contig. Each query decodes only its own segments."""
        found = self.resolved(queries)
        spans = self._asked(found.where("status = 0").select("query_ord", "sample_ord", "contig_ord", "low", "high"))
        joined = self._assembled(spans, ["query_ord"], few=True)
        return found.join(joined, "query_ord", "left").select("query_ord", "header", "status", F.when(F.col("status") == 0, F.coalesce("seq", F.lit(""))).alias("seq"))

    def _asked(self, wanted: DataFrame) -> DataFrame:
        """Segments of ``sample_ord, contig_ord`` rows, from the blocks of these samples if they are few."""
        found = [r["sample_ord"] for r in wanted.select("sample_ord").distinct().limit(MOST_IDS + 1).collect()]
        return self._of("segments", None if len(found) > MOST_IDS else found).join(wanted, ["sample_ord", "contig_ord"])

    def stream_records(self, wanted: DataFrame, width: int = 80) -> Iterator[str]:
        """FASTA text of ``place, header, sample_ord, contig_ord, low, high`` rows in order of ``place``, a segment at a
        time: neither a contig nor a partition of whole contigs is ever put together. A line goes on over segments."""
        spans = self._asked(wanted.select("place", "sample_ord", "contig_ord", "low", "high").withColumnRenamed("place", "nth"))
        pieces = self._pieces(spans, ["nth"], few=True).select("nth", "begin", F.lit(None).cast("string").alias("header"), "t")
        heads = wanted.select(F.col("place").alias("nth"), F.lit(-1).cast("long").alias("begin"), "header", F.lit("").alias("t"))
        left, open_line = "", False
        for row in heads.unionByName(pieces).orderBy("nth", "begin").toLocalIterator(prefetchPartitions=True):
            if row["header"] is not None:
                yield f"{left}\n>{row['header']}\n" if left or open_line else f">{row['header']}\n"
                left, open_line = "", False
                continue
            if width > 0:
                left += row["t"]
                full = len(left) - len(left) % width
                if full:
                    yield "".join(f"{left[i : i + width]}\n" for i in range(0, full, width))
                    left = left[full:]
            else:
                yield row["t"]
                open_line = open_line or bool(row["t"])
        if left or open_line:
            yield f"{left}\n"

    def resolved(self, queries: list[str]) -> DataFrame:
        """``query_ord, header, status, sample_ord, contig_ord, low, high`` of contig queries; malformed ones are left out."""
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_ord int, query string").withColumn("q", contig_query(F.col("query"))).where("q.ok")
        parsed = asked.select("query_ord", F.col("q.contig").alias("contig"), F.col("q.sample").alias("asked_sample"), F.col("q.from").alias("from"), F.col("q.to").alias("to"))
        every = self.contigs()
        if len(queries) <= MOST_IDS:  # the names reach the scan
            every = every.where(F.col("contig").isin([r[0] for r in parsed.select(short_name(F.col("contig"))).distinct().collect()]))
        named = every.select("sample", F.col("contig").alias("c"), "contig_full", "sample_ord", "contig_ord")
        fits = parsed.join(named, (short_name(F.col("contig")) == F.col("c")) & ((F.col("asked_sample") == "") | (F.col("asked_sample") == F.col("sample"))), "left")
        order = Window.partitionBy("query_ord").orderBy("sample_ord", "contig_ord")
        ranked = fits.select("*", F.row_number().over(order).alias("rank"), F.count("c").over(Window.partitionBy("query_ord")).alias("n")).where("rank = 1")
        status = F.when(F.col("n") == 0, catalog.MISSING).when((F.col("asked_sample") == "") & (F.col("n") > 1), catalog.AMBIGUOUS).otherwise(0)
        open_ended = (F.col("from") < 0) & (F.col("to") < 0)
        header = F.when(open_ended, F.col("contig_full")).otherwise(F.concat("contig_full", F.lit(":"), F.col("from").cast("string"), F.lit("-"), F.col("to").cast("string")))
        rows = ranked.withColumn("r", normalised_range(F.col("from"), F.col("to"))).select("query_ord", header.alias("header"), status.alias("status"), "sample_ord", "contig_ord", F.col("r.from").alias("low"), F.col("r.to").alias("high"))
        return self.spark.createDataFrame(rows.collect(), rows.schema)  # a row per query of the caller

    # answers for one caller

    def has_marker(self, marker: str) -> bool:
        """Whether a batch was committed with this name."""
        return any(x["marker"] == marker for x in self.state["batches"])

    def n_samples(self) -> int:
        return self.table("samples").count()

    def n_contigs(self, sample: str) -> int:
        """Number of contigs, or -1 for an unknown sample."""
        n = self.contigs().where(F.col("sample") == sample).count()
        return n or (0 if self.table("samples").where(F.col("sample") == sample).count() else catalog.MISSING)

    def list_samples(self, by_name: bool = True) -> list[str]:
        return [r["sample"] for r in self.table("samples").orderBy("sample" if by_name else "sample_ord").collect()]

    def reference_sample(self) -> str | None:
        return next(iter(self.list_samples(False)), None)

    def list_contigs(self, sample: str) -> list[str]:
        return [r["contig_full"] for r in self.contigs().where(F.col("sample") == sample).orderBy("contig_ord").collect()]

    def contig_length(self, sample: str, name: str) -> int:
        """Length, -1 if there is no such contig, -2 if the name alone is ambiguous."""
        rows = self.contigs().where(F.col("contig") == name.split()[0] if name.split() else F.lit(False))
        rows = (rows.where(F.col("sample") == sample) if sample else rows).orderBy("sample_ord", "contig_ord").limit(2).collect()
        if not rows:
            return catalog.MISSING
        return catalog.AMBIGUOUS if len(rows) > 1 and not sample else rows[0]["length"]

    def contig_sequence(self, sample: str, name: str, low: int = -1, high: int = -1) -> str:
        """Letters ``low`` to ``high``; an error gives an empty string."""
        where = f"{name}@{sample}" if sample else name
        rows = self.get_contigs([where if low < 0 and high < 0 else f"{where}:{low}-{high}"]).collect()
        return rows[0]["seq"] or "" if rows else ""

    def info(self) -> DataFrame:
        counts = self.contigs().agg(F.count(F.lit(1)).alias("n_contigs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_letters"))
        samples = self.table("samples").agg(F.count(F.lit(1)).alias("n_samples"), F.min_by("sample", "sample_ord").alias("reference"))
        shown = {n: self.state["parameters"][n] for n in (*PARAMETERS, "concatenated")} | {"commands": "\n".join(f"{x['at']} {x['command']}" for x in self.state["batches"])}
        own = self.spark.createDataFrame([shown], "commands string, k int, min_match int, segment_size int, pack_cardinality int, fallback double, concatenated boolean")
        return counts.crossJoin(samples).crossJoin(own)  # single rows

    def file_info(self) -> dict[str, str]:
        """What made the collection, and in which version of its layout."""
        return {"producer": "strandlake", "layout": str(LAYOUT), "format": "parquet", "batches": str(len(self.batches))}

    def sizes(self) -> DataFrame:
        """One row: letters in references, in codes and in raw groups, and numbers of groups by kind."""
        raw = F.col("group_id") < grouping.RAW_GROUPS
        codes = self.table("deltas").agg(F.coalesce(F.sum(F.when(raw, F.char_length("delta"))), F.lit(0)).alias("raw_size"), F.coalesce(F.sum(F.when(~raw, F.char_length("delta"))), F.lit(0)).alias("delta_size"))
        members = self.table("deltas").where(~raw).groupBy("group_id").agg(F.max("in_group_id").alias("last"))
        refs = self.table("groups").join(members, "group_id", "left").agg(
            F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.char_length("ref_seq")), F.lit(0)).alias("ref_size"),
            F.count_if(F.col("key2").isNull()).alias("one_sided"), F.count_if(F.coalesce("last", F.lit(0)) == 0).alias("reference_only"),
        )
        return codes.crossJoin(refs)  # single rows

    def stream_sizes(self) -> DataFrame:
        """``stream, n_parts, size``: of every group's references (``x...r``) and codes (``x...d``), by established name."""
        name = lambda end: F.concat(F.lit("x"), base64_name(F.col("group_id")), F.lit(end))
        refs = self.table("groups").select(name("r").alias("stream"), F.lit(1).cast("long").alias("n_parts"), F.char_length("ref_seq").cast("long").alias("size"))
        codes = self.table("deltas").groupBy("group_id").agg(F.countDistinct("pack").alias("n_parts"), F.sum(F.char_length("delta")).cast("long").alias("size"))
        return refs.unionByName(codes.select(name("d").alias("stream"), "n_parts", "size"))

    def key_map(self) -> DataFrame:
        """``key1, key2, group_id`` in the order of keys."""
        return self.table("groups").select("key1", "key2", "group_id").orderBy("key1", "key2")


def _write(df: DataFrame, path: str, table: str, batch: str) -> None:
    """Write a batch of a table, in its blocks. Rows are dealt by block and, of one id, by runs of a second column, so that
    no task has all of a large group or sample."""
    where = f"{path}/{table}/batch={batch}"
    if table not in BLOCKS:
        df.write.mode("overwrite").parquet(where)
        return
    column, width, order = BLOCKS[table]
    placed = df.withColumn("block", F.floor(F.col(column) / width).cast("long"))
    run = [F.floor(F.col(order[1]) / ROWS_TOGETHER)] if len(order) > 1 else []
    if table in ("contigs", "segments"):
        run = [F.col(column), *run]
    sorted_ = placed.repartition("block", *run).sortWithinPartitions("block", *order)
    sorted_.write.mode("overwrite").option("parquet.bloom.filter.enabled#contig", "true").partitionBy("block").parquet(where)


def _read(spark: SparkSession, path: str, table: str, batches: list[str]) -> DataFrame:
    """Batches of a table, with ``block`` if it has blocks."""
    paths = [f"{path}/{table}/batch={b}" for b in batches]
    if table not in BLOCKS:
        return spark.read.schema(TABLES[table]).parquet(*paths)
    return spark.read.schema(f"{TABLES[table]}, block long, batch string").option("basePath", f"{path}/{table}").parquet(*paths).drop("batch")


def _batch_name(nth: int) -> str:
    return f"b{nth:06d}-{uuid.uuid4().hex}"


def _entry(batch: str, command: str, fallback: float, marker: str | None = None) -> dict:
    return {"batch": batch, "command": command, "at": datetime.now(UTC).strftime("%a %b %e %H:%M:%S %Y"), "fallback": fallback, "marker": marker}


def _clean(log: Log, path: str, batch: str, done: bool) -> None:
    """Delete the steps of a batch, and its data where it was not committed."""
    log.remove(f"{path}/_staging/{batch}")
    for table in [] if done else TABLES:
        log.remove(f"{path}/{table}/batch={batch}")


def _stage(df: DataFrame, path: str, batch: str, name: str) -> DataFrame:
    """Store a step of a batch beside the tables and read it back."""
    where = f"{path}/_staging/{batch}/{name}"
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _letters(contigs: DataFrame) -> tuple[str, ...]:
    return ("offset", "part") if "part" in contigs.columns else ("seq",)


def _n_letters(contigs: DataFrame) -> int:
    """Letters of stored contigs."""
    return contigs.agg(F.sum(F.char_length(_letters(contigs)[-1]))).first()[0] or 0


def _named_once(contigs: DataFrame) -> None:
    """A sample that was registered is closed: no other may have its name."""
    twice = contigs.select("sample", "sample_ord").distinct().groupBy("sample").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"sample {twice[0]['sample']!r} comes twice")


def _stored(c: str = "seq"):
    return F.when(F.col("is_rev_comp"), reverse_complement(F.col(c))).otherwise(F.col(c))


def _through_middle(min_match: int, k: int):
    """For segments between groups of ``front, middle`` and ``middle, back``: the parts that go to each."""

    def one(seq: str, turned: str, front: str, back: str, middle: str, ref1: str, ref2: str) -> list[tuple]:
        rc = front > back  # the pair is looked at with its smaller k-mer first
        first, last = (back, front) if rc else (front, back)
        here, other = (turned, seq) if rc else (seq, turned)
        left, right = Coder(ref1, min_match), Coder(ref2, min_match)
        cost1 = left.costs(here) if first < middle else left.costs(other, at_start=False)[::-1]
        cost2 = right.costs(here, at_start=False) if middle < last else right.costs(other)[::-1]
        _, at = grouping.split_place(cost1, cost2, k)
        n = len(seq)
        if at == 0:
            return [(0, 0, n, *sorted((middle, last)), rc if middle < last else not rc)]
        if at == n:
            return [(0, 0, n, *sorted((first, middle)), rc if first < middle else not rc)]
        cut = (n - at if rc else at) - k // 2
        return [(0, 0, cut + k, *sorted((front, middle)), not front < middle), (1, cut, n - cut, *sorted((middle, back)), not middle < back)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [(*(r[c] for c in grouping.ARRIVAL), r["start"] + x[1], *x) for r in rows for x in one(r["seq"], r["turned"], r["front"], r["back"], r["middle"], r["ref1"], r["ref2"])]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], _PARTS_NAMES)

    return run


_PARTS = "sample_ord int, contig_ord int, place int, start long, part int, inside long, raw_length long, key1 string, key2 string, is_rev_comp boolean"
_PARTS_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def through_middle(unsettled: DataFrame, settled: DataFrame, k: int, min_match: int) -> DataFrame:
    """Segments whose pair of k-mers is no settled group, but is bridged by two that share a k-mer: their parts (``part``,
    ``start`` in the contig, ``inside`` the segment, ``raw_length``) with ``key1, key2, is_rev_comp``. Where both have a
    ``round``, a segment sees only groups of earlier ones."""
    ship(unsettled.sparkSession)
    if "round" not in unsettled.columns:
        unsettled, settled = unsettled.withColumn("round", F.lit(0)), settled.withColumn("round", F.lit(-1))
    first, last = F.least("front", "back"), F.greatest("front", "back")
    asked = unsettled.where("front <> back").withColumns({"a": first, "b": last})
    pairs = asked.select(F.col("a").alias("key1"), F.col("b").alias("key2"), "round").distinct()
    middles = grouping.triangles(pairs, settled).groupBy(F.col("key1").alias("a"), F.col("key2").alias("b"), "round").agg(F.min("middle").alias("middle"))
    bridged = asked.join(middles, ["a", "b", "round"]).select(*grouping.ARRIVAL, "start", "front", "back", "middle", "seq", reverse_complement(F.col("seq")).alias("turned"), "a", "b")
    group = lambda n: settled.select(F.col("key1").alias(f"g{n}"), F.col("key2").alias(f"h{n}"), F.col("ref_seq").alias(f"ref{n}"))
    on = lambda n, c: (F.least(c, "middle") == F.col(f"g{n}")) & (F.greatest(c, "middle") == F.col(f"h{n}"))
    both = bridged.join(group(1), on(1, "a")).join(group(2), on(2, "b"))
    return both.select(*grouping.ARRIVAL, "start", "front", "back", "middle", "seq", "turned", "ref1", "ref2").mapInArrow(_through_middle(min_match, k), _PARTS)


def _at_ends(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups of which a splitter is also one of these pairs."""
    ends = pairs.select(F.explode(F.array("key1", "key2")).alias("ck")).distinct()
    one, two = (ends.select(F.col("ck").alias(f"key{i}"), F.lit(True).alias(f"at{i}")) for i in (1, 2))
    return groups.join(one, "key1", "left").join(two, "key2", "left").where("at1 or at2").select(*groups.columns)


def by_votes(segments: DataFrame, sampled: DataFrame, mapped: DataFrame, settled: DataFrame, values: dict, least: int, adaptive: bool, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``key1, key2, is_rev_comp`` of settled groups for segments (with ``seq``) by the sampled k-mers that they share."""
    votes = grouping.fallback_votes(sampled, segments, mapped, values["k"], keep, least, MOST_CANDIDATES)
    ranked = grouping.best_candidates(votes, least, MOST_CANDIDATES).select(*grouping.ARRIVAL, "key1", "key2", "is_rev_comp", "rank")
    if values["segment_size"] <= SHORT:
        return ranked.where("rank = 1").drop("rank")
    bodies = ranked.join(segments.select(*grouping.ARRIVAL, "raw_length", "seq"), list(grouping.ARRIVAL)).join(settled.select("key1", "key2", "ref_seq"), ["key1", "key2"])
    asked = bodies.select(*grouping.ARRIVAL, "raw_length", "key1", "key2", "is_rev_comp", "rank", "ref_seq", _stored().alias("body"))
    priced = asked.sortWithinPartitions("key1", "key2").mapInArrow(_costs(values["min_match"]), "sample_ord int, contig_ord int, place int, raw_length long, key1 string, key2 string, is_rev_comp boolean, rank long, cost long")
    limit = F.col("raw_length") * ADAPTIVE_LIMIT if adaptive else F.col("raw_length")
    good = priced.where((F.col("cost") > 0) & (F.col("cost") < limit))
    return good.groupBy(*grouping.ARRIVAL).agg(F.min(F.struct("cost", "rank", "key1", "key2", "is_rev_comp")).alias("b")).select(*grouping.ARRIVAL, "b.key1", "b.key2", "b.is_rev_comp")


def _ingest(spark: SparkSession, contigs: DataFrame, path: str, batch: str, values: dict, adaptive: bool, known: Collection | None = None) -> None:
    k, arrival = values["k"], list(grouping.ARRIVAL)
    stage = lambda df, name: _stage(df, path, batch, name)
    batches = [*(known.batches if known else []), batch]
    reference = contigs.where("sample_ord = 0") if known is None else known.contigs_with_sequences(samples=[0])
    if adaptive:
        before = _read(spark, path, "splitters", known.batches if known else [batch])
        letters = _n_letters(contigs) + (0 if known is None else known.contigs().where("sample_ord = 0").agg(F.sum("length")).first()[0] or 0)
        new = segmentation.adaptive_splitters(contigs, before, reference, k, values["segment_size"], kmers.tasks_for(spark, letters))
        new = new.union(before) if known is None else new  # a new collection has one set
        _write(stage(new.distinct(), "splitters").sortWithinPartitions("ck"), path, "splitters", batch)
    elif known is not None:
        _write(spark.range(0).select(F.lit("").alias("ck")), path, "splitters", batch)
    splitters = _read(spark, path, "splitters", batches)
    found = segmentation.with_sequences(segmentation.segments(contigs, splitters, k), contigs)
    keyed = stage(segmentation.with_keys(found, k), "keyed")
    both = keyed.where("key1 is not null")

    if known is None:
        heads = grouping.first_seen(both.where("sample_ord = 0")).select("key1", "key2", "first.*")
        settled = stage(heads.join(both.where("sample_ord = 0").select(*arrival, _stored().alias("ref_seq")), arrival).select("key1", "key2", "ref_seq"), "settled")
        old = touched = None
    else:
        old = known.table("groups")
        settled = old.where("key2 is not null").select("key1", "key2", "ref_seq")
        touched = stage(_touched(known, keyed), "touched")
    columns = [*arrival, "part", "start", "raw_length", "key1", "key2", "is_rev_comp"]
    near = settled if touched is None else touched.where("key2 is not null").select("key1", "key2", "ref_seq")
    # the round of a segment, and the last sample of a round
    together = values["pack_cardinality"] if values["concatenated"] else 1
    base = contigs.agg(F.coalesce(F.min("sample_ord"), F.lit(0))).first()[0] if known is not None else 0
    round_, last = F.floor((F.col("sample_ord") - base) / together).cast("int"), lambda c: ((c + 1) * together + base - 1).cast("int")
    own = both.withColumn("part", F.lit(0)).select(*columns)
    unsettled = both.join(settled.select("key1", "key2"), ["key1", "key2"], "left_anti").withColumn("round", round_)
    vote = None
    if values["fallback"] > 0:
        mapped = None if known is None else _stored_map(known, values["fallback"])
        if mapped is None:
            rows = both.where("sample_ord = 0") if known is None else segmentation.with_keys(segmentation.with_sequences(segmentation.segments(reference, splitters, k), reference), k)
            once = kmers.sampled_codes(reference, k, values["fallback"])
            once = once.join(once.groupBy("ck").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("ck"), "ck", "left_semi")
            found = grouping.fallback_map(once, rows, k).join(settled.select("key1", "key2"), ["key1", "key2"], "left_semi")
            _write(found.select("ck", "key1", "key2", "forward"), path, "fallback", batch)
            mapped = _read(spark, path, "fallback", [batch])
        sampled = stage(kmers.sampled_codes(contigs, k, values["fallback"]), "sampled")
        vote = lambda segments, ends, name: stage(by_votes(segments, sampled, mapped, settled, values, VOTES[ends], adaptive, lambda df, of: stage(df, f"{name}-{of}")), name)

        def revised(rows: DataFrame, chosen: DataFrame) -> DataFrame:
            """``rows`` with the group that was chosen for some."""
            c = chosen.select(*arrival, F.col("key1").alias("c1"), F.col("key2").alias("c2"), F.col("is_rev_comp").alias("c_rc"))
            joined = rows.join(c, arrival, "left")
            keys = {"key1": F.coalesce("c1", "key1"), "key2": F.when(F.col("c1").isNotNull(), F.col("c2")).otherwise(F.col("key2")), "is_rev_comp": F.coalesce("c_rc", "is_rev_comp")}
            return joined.withColumns(keys).select(*columns)

    voted = None if vote is None else vote(unsettled, 2, "voted2")
    # pairs that open a group: by the first of their segments that no vote sends elsewhere, unless it is bridged
    free = unsettled if voted is None else unsettled.join(voted.select(*arrival), arrival, "left_anti")
    firsts = stage(free.groupBy("key1", "key2").agg(F.min("round").alias("round"), F.min(F.struct(*arrival)).alias("f")).select("key1", "key2", "round", "f.*"), "firsts")
    opened = firsts if values["concatenated"] else grouping.opened_in_rounds(firsts, near, stage)
    opened = stage(opened.join(both.select(*arrival, _stored().alias("ref_seq")), arrival), "opened")
    unsettled = unsettled.join(opened.select("key1", "key2", F.col("round").alias("opened")), ["key1", "key2"], "left")
    if voted is not None:
        own = revised(own, voted.join(unsettled.where("opened is null or round <= opened").select(*arrival), arrival, "left_semi"))
    if not values["concatenated"]:
        groups = near.withColumn("round", F.lit(-1)).unionByName(opened.select("key1", "key2", "ref_seq", "round"))
        if voted is None:
            # few pairs stay shut, and only their segments, and groups at their ends, can make parts
            shut = stage(firsts.select("key1", "key2").join(opened.select("key1", "key2"), ["key1", "key2"], "left_anti"), "shut")
            lacking = both.join(shut, ["key1", "key2"], "left_semi").withColumn("round", round_)
            groups = stage(_at_ends(groups, shut), "around")
        else:
            lacking = unsettled.where("opened is null")
        parts = stage(through_middle(lacking, groups, k, values["min_match"]), "parts")
        if not parts.isEmpty():
            # segments with parts become their parts
            replaced = [c for c in columns if c not in arrival]
            joined = own.join(parts.select(*arrival, "inside", *[F.col(c).alias(f"p_{c}") for c in replaced]), arrival, "left")
            either = lambda c: F.when(F.col("inside").isNull(), F.col(c)).otherwise(F.col(f"p_{c}")).alias(c)
            own = joined.select(*arrival, *[either(c) for c in replaced])

    seen = last(F.lit(0)) if known is None else F.lit(-1)  # those of the reference sample are of the first round
    candidates = near.select("key1", "key2", seen.alias("first_sample"), "ref_seq").unionByName(opened.select("key1", "key2", last(F.col("round")).alias("first_sample"), "ref_seq"))
    single = keyed.where("(front is null) <> (back is null)")
    chosen = cheapest_groups(single, candidates, values["min_match"], stage).select(*arrival, F.col("key1").alias("c1"), F.col("key2").alias("c2"), F.col("is_rev_comp").alias("c_rc"))
    end = F.coalesce("front", "back")
    alone = single.join(chosen, arrival, "left").select(
        *arrival, F.lit(0).alias("part"), "start", "raw_length", "seq", F.coalesce("c1", end).alias("key1"), F.col("c2").alias("key2"),
        F.coalesce("c_rc", F.col("front").isNull()).alias("is_rev_comp"),
    )
    none = keyed.where("front is null and back is null")
    if vote is not None:
        alone = stage(alone, "alone")
        alone = revised(alone, vote(alone.where("key2 is null"), 1, "voted1"))
        found = vote(none, 0, "voted0")
        none_voted = none.join(found.select(*arrival, F.col("key1").alias("c1"), F.col("key2").alias("c2"), F.col("is_rev_comp").alias("c_rc")), arrival)
        own = own.unionByName(none_voted.select(*arrival, F.lit(0).alias("part"), "start", "raw_length", F.col("c1").alias("key1"), F.col("c2").alias("key2"), F.col("c_rc").alias("is_rev_comp")))
        none = none.join(found.select(*arrival), arrival, "left_anti")
    raw = none.select(*arrival, F.lit(0).alias("part"), "start", "raw_length", F.lit(None).cast("string").alias("key1"), F.lit(None).cast("string").alias("key2"), F.lit(False).alias("is_rev_comp"))
    # parts of a segment that was cut in two are segments of their own
    every = own.select(*columns).unionByName(alone.select(*columns)).unionByName(raw)
    again = F.row_number().over(Window.partitionBy("sample_ord", "contig_ord").orderBy("place", "part")) - 1
    every = every.withColumn("place", again.cast("int")).select(*arrival, "start", "raw_length", "key1", "key2", "is_rev_comp")
    # letters come last, from the contigs, so no step before carries them
    every = segmentation.with_sequences(every, contigs).select(*every.columns, _stored().alias("body"))
    every = stage(every, "members")
    members, raw = every.where("key1 is not null"), every.where("key1 is null")

    fresh = members.groupBy("key1", "key2").agg(F.min(F.struct(*arrival)).alias("f")).select("key1", "key2", "f.*")
    base = grouping.RAW_GROUPS
    same = lambda a, b: (F.col("key1") == F.col(a)) & F.col("key2").eqNullSafe(F.col(b))
    if old is not None:
        fresh = fresh.join(old.select(F.col("key1").alias("o1"), F.col("key2").alias("o2")), same("o1", "o2"), "left_anti")
        base = max(base, (known.table("groups").agg(F.max("group_id")).first()[0] or 0) + 1)
    numbered = grouping.numbered(fresh, arrival, base).select("group_id", "key1", "key2", *arrival)
    bodies = members.select(*arrival, F.col("body").alias("ref_seq"))
    _write(numbered.join(bodies, arrival).select("group_id", "key1", "key2", "ref_seq"), path, "groups", batch)

    groups = _read(spark, path, "groups", [batch]).drop("block")
    if old is not None:
        own_keys = members.select(F.col("key1").alias("o1"), F.col("key2").alias("o2")).distinct()
        ids = old.select("group_id", "key1", "key2").join(own_keys, same("o1", "o2"), "left_semi").select("group_id")
        groups = groups.unionByName(_with_letters(known, ids))
    used = None if known is None else known.table("deltas").groupBy("group_id").agg(F.max("in_group_id").alias("used"))
    keys = [*arrival, "start", "raw_length", "is_rev_comp", "group_id"]
    g = groups.select("group_id", F.col("key1").alias("g1"), F.col("key2").alias("g2"), "ref_seq")
    # most members are their group's reference, whose code is empty: of these no letters are sent to be coded
    other = F.col("body") != F.col("ref_seq")
    placed = members.join(g, same("g1", "g2")).select(*keys, F.when(other, F.col("ref_seq")).alias("ref_seq"), F.when(other, F.col("body")).otherwise("").alias("body"))
    coded = stage(encode_rows(placed.sortWithinPartitions("group_id"), values["min_match"]), "coded")
    # equal codes of a group are one; ids follow their first arrival
    codes = coded.where("body <> ''").groupBy("group_id", "body").agg(F.min(F.struct(*arrival)).alias("f")).select("group_id", "body", "f.*")
    codes = grouping.numbered_within(codes, "group_id", arrival, "n")
    dealt = grouping.raw_round_robin(raw.withColumns({"front": F.lit(None), "back": F.lit(None)})).select(*arrival, F.col("raw_group").cast("long").alias("group_id"))
    raw = raw.join(dealt, arrival)
    raw_ids = grouping.numbered_within(raw.select("group_id", *arrival), "group_id", arrival, "n")
    if used is None:
        codes, raw_ids = (x.withColumn("used", F.lit(0).cast("long")) for x in (codes, raw_ids))
    else:
        codes, raw_ids = (x.join(used, "group_id", "left").withColumn("used", F.coalesce("used", F.lit(0))) for x in (codes, raw_ids))
    # id 0 is the reference, and in raw groups a dummy
    codes = codes.select("group_id", "body", (F.col("n") + F.col("used") + 1).alias("in_group_id"))
    raw = raw.join(raw_ids.select(*arrival, (F.col("n") + F.col("used") + 1).alias("in_group_id")), arrival)
    pack = F.floor((F.col("in_group_id") - 1) / values["pack_cardinality"]).alias("pack")
    stored = codes.unionByName(raw.select("group_id", "body", "in_group_id")).select("group_id", "in_group_id", pack, F.col("body").alias("delta"))
    _write(stored, path, "deltas", batch)
    mine = _read(spark, path, "deltas", [batch]).where(F.col("group_id") >= grouping.RAW_GROUPS).select("group_id", F.col("delta").alias("body"), "in_group_id")
    ids = coded.join(mine, ["group_id", "body"], "left").select(*keys, F.coalesce("in_group_id", F.lit(0)).cast("long").alias("in_group_id"))
    every = ids.unionByName(raw.select(*keys, "in_group_id"))
    _write(every.select(*arrival, "start", "raw_length", "group_id", "in_group_id", "is_rev_comp"), path, "segments", batch)
    every = _read(spark, path, "segments", [batch])
    lengths = catalog.lengths_from_segments(every, k)
    names = contigs.select(*NAMES)
    named = (names.distinct() if "part" in contigs.columns else names).join(lengths, ["sample_ord", "contig_ord"], "left")
    _write(named.select("sample_ord", "sample", "contig_ord", "contig", "contig_full", F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce("n_segments", F.lit(0)).cast("int").alias("n_segments")), path, "contigs", batch)
    _write(contigs.select("sample_ord", "sample").distinct(), path, "samples", batch)


def _touched(known: Collection, keyed: DataFrame) -> DataFrame:
    """Groups with a splitter of a batch's segments at one end: what these segments may join, or are compared with."""
    ends = keyed.select(F.explode(F.array_compact(F.array("front", "back"))).alias("ck")).distinct()
    keys = known.table("groups").select("group_id", F.explode(F.array_compact(F.array("key1", "key2"))).alias("ck"))
    return _with_letters(known, keys.join(ends, "ck", "left_semi").select("group_id").distinct())


def _with_letters(known: Collection, ids: DataFrame) -> DataFrame:
    """Groups of these ids; letters are read only from blocks that hold any."""
    blocks = [r[0] for r in ids.select(F.floor(F.col("group_id") / GROUPS_PER_BLOCK)).distinct().collect()]  # one per block of ids
    return known._rows("groups").where(F.col("block").isin(blocks)).join(ids, "group_id", "left_semi").select("group_id", "key1", "key2", "ref_seq")


def _stored_map(known: Collection, fallback: float) -> DataFrame | None:
    """The map of sampled k-mers that an earlier batch made, with this share of them."""
    made = [x["batch"] for x in known.state["batches"] if x["fallback"] == fallback]
    return _read(known.spark, known.path, "fallback", made[:1]) if made else None
