"""Splitters, segments, and the terminal k-mers that key a segment.

Candidates for splitters are nearly all windows of a reference. Their places are kept as one bit each, in rows of at most
2**19 places, and the greedy choice runs over the bits of one contig: 30 MB for a chromosome of 2.5 * 10**8 letters. Cuts of a
contig are far fewer, about its length over the segment size, and are chosen from a sorted list, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..sources.shipping import ship
from .kmers import aligned, counted_kmers, single_places, windows_of

#: Places in a row of bits.
ROW = 1 << 19


def greedy(places: np.ndarray, gap: int) -> list[int]:
    """Of sorted places: the first, then always the first that is at least ``gap`` after the last taken."""
    taken, at = [], 0
    while at < len(places):
        taken.append(int(places[at]))
        at += int(np.searchsorted(places[at:], taken[-1] + gap))
    return taken


def with_tail(taken: list[int], places: np.ndarray, k: int) -> list[int]:
    """Adds the last place if it lies at least k after the last taken."""
    return [*taken, int(places[-1])] if taken and places[-1] >= taken[-1] + k else taken


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for offsets in batch.column("ends"):
            places = offsets.values.to_numpy() % ROW
            bits = np.zeros(int(places.max()) + 1, dtype=bool)  # of a short contig no whole row
            bits[places] = True
            out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("sample_ord"), batch.column("contig_ord"), batch.column("part"), pa.array(out, pa.binary())], ["sample_ord", "contig_ord", "part", "bits"])


def _spaced(segment_size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for rows in batch.column("rows"):
                taken, low, last = [], 0, -1
                # row by row: a row's bits are places only while it is looked at
                for row in rows.values.to_pylist():
                    places = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8))) + row["part"] * ROW
                    last = int(places[-1])
                    at = int(np.searchsorted(places, low))
                    while at < len(places):
                        taken.append(int(places[at]))
                        low = taken[-1] + segment_size
                        at += int(np.searchsorted(places[at:], low))
                chosen.append(with_tail(taken, np.array([last]), k))
            yield pa.RecordBatch.from_arrays([batch.column("sample_ord"), batch.column("contig_ord"), pa.array(chosen, pa.list_(pa.int64()))], ["sample_ord", "contig_ord", "ends"])

    return run


def _chosen(candidates: DataFrame, contigs: DataFrame, k: int, segment_size: int, tasks: int | None = None) -> DataFrame:
    """Distinct ``ck`` of the windows of ``contigs`` chosen among ``sample_ord, contig_ord, end``, or among lists of ends
    (``part, ends``), one for each part."""
    ship(contigs.sparkSession)
    if "ends" in candidates.columns:
        listed = candidates
    else:
        placed = candidates.withColumn("part", F.floor(F.col("end") / ROW))
        if tasks:
            placed = placed.repartition(tasks, "sample_ord", "contig_ord", "part")
        listed = placed.groupBy("sample_ord", "contig_ord", "part").agg(F.collect_list("end").alias("ends"))
    rows = listed.mapInArrow(_bits, "sample_ord int, contig_ord int, part long, bits binary")
    whole = rows.groupBy("sample_ord", "contig_ord").agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("rows"))
    taken = whole.mapInArrow(_spaced(segment_size, k), "sample_ord int, contig_ord int, ends array<long>")
    if "part" in contigs.columns:
        spans = taken.select("sample_ord", "contig_ord", F.explode("ends").alias("end")).select("sample_ord", "contig_ord", (F.col("end") - k + 1).alias("start"), F.lit(k).cast("long").alias("raw_length"))
        return with_sequences(spans, contigs).select(canonical(F.col("seq")).alias("ck")).distinct()
    found = contigs.select("sample_ord", "contig_ord", F.col("seq").cast("binary").alias("whole")).join(taken, ["sample_ord", "contig_ord"])
    cut = F.transform("ends", lambda e: F.substring(F.col("whole"), (e - k + 2).cast("int"), F.lit(k)).cast("string"))
    return found.select(F.explode(cut).alias("kmer")).select(canonical(F.col("kmer")).alias("ck")).distinct()


def select_splitters(reference: DataFrame, k: int, segment_size: int, tasks: int | None = None) -> DataFrame:
    """Distinct ``ck`` of the k-mers that cut the reference: singletons, spaced by the segment size, with a tail. ``tasks``: how
    many count k-mers (``kmers.tasks_for``), where the caller knows how long the reference is."""
    return _chosen(single_places(reference, k, ROW, tasks), reference, k, segment_size, tasks)


def _greedy_cuts(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [greedy(x.values.to_numpy(), gap) if x.is_valid else [] for x in batch.column("ends")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("sample_ord", "contig_ord", "n")], pa.array(ends, pa.list_(pa.int64()))], ["sample_ord", "contig_ord", "n", "ends"])

    return run


def lengths(contigs: DataFrame) -> DataFrame:
    """``sample_ord, contig_ord, n``."""
    if "part" in contigs.columns:
        return contigs.groupBy("sample_ord", "contig_ord").agg(F.max(F.col("offset") + F.char_length("part")).alias("n"))
    return contigs.select("sample_ord", "contig_ord", F.char_length("seq").cast("long").alias("n"))


def cuts(contigs: DataFrame, splitters: DataFrame, k: int) -> DataFrame:
    """``sample_ord, contig_ord, n, ends``: where each contig is cut; ``ends`` is empty without any splitter."""
    hits = windows_of(contigs, splitters, k)
    listed = hits.groupBy("sample_ord", "contig_ord").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    sizes = lengths(contigs)
    joined = sizes.join(listed, ["sample_ord", "contig_ord"], "left").select("sample_ord", "contig_ord", "n", "ends")
    return joined.mapInArrow(_greedy_cuts(k), "sample_ord int, contig_ord int, n long, ends array<long>")


def segments(contigs: DataFrame, splitters: DataFrame, k: int) -> DataFrame:
    """``sample_ord, contig_ord, place, start, raw_length, has_front, has_back``; neighbours overlap by k letters."""
    found = cuts(contigs, splitters, k).where("n > 0")
    m = F.size("ends")
    one = lambda i: F.struct(
        i.cast("int").alias("place"),
        F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("ends", i - 1) + 1 - k).alias("start"),
        F.when(i == m, F.col("n") - 1).otherwise(F.get("ends", i)).alias("last"),
        (i > 0).alias("has_front"),
        (i < m).alias("has_back"),
    )
    listed = found.select("sample_ord", "contig_ord", F.explode(F.transform(F.sequence(F.lit(0), m), one)).alias("s"))
    return listed.select("sample_ord", "contig_ord", "s.place", "s.start", (F.col("s.last") - F.col("s.start") + 1).cast("long").alias("raw_length"), "s.has_front", "s.has_back")


def with_sequences(found: DataFrame, contigs: DataFrame) -> DataFrame:
    """Segments with their letters ``seq``. The contigs are joined once, with all their segments; of contigs in parts, each
    segment meets the pieces that hold it."""
    if "part" in contigs.columns:
        return _from_parts(found, contigs)
    joined = found.join(contigs.select("sample_ord", "contig_ord", F.col("seq").cast("binary").alias("whole")), ["sample_ord", "contig_ord"])
    return joined.withColumn("seq", F.substring("whole", (F.col("start") + 1).cast("int"), F.col("raw_length").cast("int")).cast("string")).drop("whole")


def _from_parts(found: DataFrame, parts: DataFrame) -> DataFrame:
    held = aligned(parts, 0, ROW).withColumnRenamed("offset", "low").withColumn("nth", F.floor(F.col("low") / ROW))
    last = F.col("start") + F.col("raw_length")
    spans = found.withColumn("nth", F.explode(F.sequence(F.floor(F.col("start") / ROW), F.floor((last - 1) / ROW))))
    joined = spans.join(held, ["sample_ord", "contig_ord", "nth"])
    begin, end = F.greatest(F.col("start"), F.col("low")), F.least(last, F.col("low") + ROW)
    cut = F.substring("piece", (begin - F.col("low") + 1).cast("int"), (end - begin).cast("int")).cast("string")
    pieces = joined.select(*found.columns, F.struct("low", cut.alias("t")).alias("p"))
    return pieces.groupBy(*found.columns).agg(F.sort_array(F.collect_list("p")).alias("p")).select(*found.columns, F.array_join(F.col("p.t"), "").alias("seq"))


def with_keys(found: DataFrame, k: int) -> DataFrame:
    """Adds ``front, back`` (canonical terminal k-mers or null), the ordered ``key1, key2`` of segments with both, and
    ``is_rev_comp``: whether such a segment is stored reversed."""
    front = F.when(F.col("has_front"), canonical(F.substring("seq", F.lit(1), F.lit(k))))
    back = F.when(F.col("has_back"), canonical(F.substring("seq", (F.col("raw_length") - k + 1).cast("int"), F.lit(k))))
    keyed = found.withColumn("front", front).withColumn("back", back)
    both = F.col("front").isNotNull() & F.col("back").isNotNull()
    return keyed.select(
        "*",
        F.when(both, F.least("front", "back")).alias("key1"),
        F.when(both, F.greatest("front", "back")).alias("key2"),
        F.when(both, ~(F.col("front") < F.col("back"))).otherwise(F.lit(False)).alias("is_rev_comp"),
    )


def uncut(contigs: DataFrame, splitters: DataFrame, k: int) -> DataFrame:
    """Contigs in which no splitter occurs."""
    none = cuts(contigs, splitters, k).where(F.size("ends") == 0).select("sample_ord", "contig_ord")
    return contigs.join(none, ["sample_ord", "contig_ord"], "left_semi")


def adaptive_splitters(contigs: DataFrame, splitters: DataFrame, reference: DataFrame, k: int, segment_size: int, tasks: int | None = None) -> DataFrame:
    """New splitters from long contigs that no splitter cuts: k-mers single in their own contig and not in the reference.
    ``tasks``: how many count and join k-mers (``kmers.tasks_for``), where the caller knows how many letters there are."""
    long_ones = uncut(contigs, splitters, k).join(lengths(contigs).where(F.col("n") >= segment_size).select("sample_ord", "contig_ord"), ["sample_ord", "contig_ord"], "left_semi")
    own = counted_kmers(long_ones, k, tasks, by_piece=True).groupBy("sample_ord", "contig_ord", "ck").agg(F.sum("n").alias("n"), F.min("end").alias("end")).where("n = 1")
    known = counted_kmers(reference, k, tasks).select("ck")
    new = own.join(known if tasks else known.distinct(), "ck", "left_anti").select("sample_ord", "contig_ord", "end")
    return _chosen(new, long_ones, k, segment_size, tasks)
