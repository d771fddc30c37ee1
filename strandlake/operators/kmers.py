"""k-mer windows, their spectrum, and set operations over them.

Contigs are cut into overlapping pieces first, so a chromosome of 10**8 bases is many rows of bounded size rather than one
array, and pieces of one contig are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import is_sampled, kmer_value, reverse_complement, with_fmix64
from ..functions.sequences import BASES, COMPLEMENTS, SAMPLE_MASK
from ..sources.shipping import ship
from .codec import finalised, window_codes

PIECE = 1 << 19
#: Letters whose windows a task makes, counts or joins, where the number of tasks is chosen.
TASK = 1 << 21
_COMPLEMENT = bytes.maketrans(BASES.encode(), COMPLEMENTS.encode())


def pieces(contigs: DataFrame, k: int, size: int = PIECE) -> DataFrame:
    """``contigs`` with ``piece`` (part of the sequence, as bytes) and ``offset``; neighbours overlap by k - 1 letters.

    Parts of bytes are taken in the time of their own length; a part of a string is sought from the string's start.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("seq") - k, F.lit(0)), F.lit(size))
    cut = contigs.withColumn("offset", F.explode(starts))
    return cut.withColumn("piece", F.substring(F.col("seq").cast("binary"), F.col("offset") + 1, F.lit(size + k - 1))).drop("seq")


def aligned(parts: DataFrame, overlap: int, size: int = PIECE) -> DataFrame:
    """``sample_ord, contig_ord, offset, piece``, as :func:`pieces` gives them with an overlap of k - 1, from contigs that are
    read in parts (``offset, part``): letters go to the pieces that hold them, and a piece is put together from them."""
    end = F.col("offset") + F.char_length("part")
    first = F.floor(F.greatest(F.col("offset") - overlap, F.lit(0)) / size)
    placed = parts.where("part <> ''").select("sample_ord", "contig_ord", "offset", "part", end.alias("end"), F.explode(F.sequence(first, F.floor((end - 1) / size))).alias("nth"))
    low = F.greatest(F.col("offset"), F.col("nth") * size)
    high = F.least(F.col("end"), (F.col("nth") + 1) * size + overlap)
    cut = placed.where(low < high).select("sample_ord", "contig_ord", "nth", low.alias("low"), F.substring(F.col("part").cast("binary"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).cast("string").alias("t"))
    whole = cut.groupBy("sample_ord", "contig_ord", "nth").agg(F.sort_array(F.collect_list(F.struct("low", "t"))).alias("p"))
    return whole.select("sample_ord", "contig_ord", (F.col("nth") * size).alias("offset"), F.array_join(F.col("p.t"), "").cast("binary").alias("piece"))


def canonical_kmers(contigs: DataFrame, k: int) -> DataFrame:
    """Every full window of k valid letters: ``sample_ord, contig_ord, end`` (0-based place of its last letter), ``kmer``
    and its canonical form ``ck``, as strings cut from the bytes of a piece and of its complement."""
    return _spread(contigs, k).mapInArrow(_strings(k), "sample_ord int, contig_ord int, end long, kmer string, ck string")


def kmers(contigs: DataFrame, k: int) -> DataFrame:
    """``sample_ord, contig_ord, end``, ``kmer`` of every valid window."""
    return canonical_kmers(contigs, k).drop("ck")


def spectrum(found: DataFrame) -> DataFrame:
    """``ck, n``: how often each canonical k-mer occurs."""
    return found.groupBy("ck").agg(F.count(F.lit(1)).alias("n"))


def singletons(found: DataFrame) -> DataFrame:
    return spectrum(found).where("n = 1").select("ck")


def duplicates(found: DataFrame) -> DataFrame:
    return spectrum(found).where("n > 1").select("ck")


def ranked(found: DataFrame) -> DataFrame:
    """``ck, rank``: distinct k-mers and their places in ascending order, from 0. Ranges are sorted by many tasks and
    numbered inside; one row per range passes the window of offsets."""
    ordered = found.select("ck").distinct().repartitionByRange("ck").sortWithinPartitions("ck")
    placed = ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    firsts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ck").alias("least"))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    bases = firsts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(bases, "part").select("ck", (F.col("base") + inside).alias("rank"))


def minus(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct k-mers that the reference does not have."""
    return found.select("ck").distinct().join(reference.select("ck").distinct(), "ck", "left_anti")


def shared(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct k-mers that the reference has too."""
    return found.select("ck").distinct().join(reference.select("ck").distinct(), "ck", "left_semi")


def without_palindromes(found: DataFrame) -> DataFrame:
    return found.where(F.col("kmer") != reverse_complement(F.col("kmer")))


def sampled(found: DataFrame, k: int, fraction: float) -> DataFrame:
    """Rows whose canonical k-mer belongs to the sampled share."""
    mixed = with_fmix64(found.withColumn("__value", kmer_value(F.col("ck"), k)), "__value", "__mixed")
    # one-row explode: a filter is not pushed below it, so the steps of the hash stay columns of their own
    held = mixed.select(*found.columns, F.explode(F.array("__mixed")).alias("__held"))
    return held.where(is_sampled(F.col("__held"), fraction)).drop("__held")


# the same windows as numbers, made in Arrow batches

CODES = "sample_ord int, contig_ord int, end long, ck long, forward boolean"
#: Splitters that are sent to all tasks, eight bytes each; of more of them, a filter is sent.
MOST_SENT = 1 << 22
#: The filter: bits for each splitter, at most so many in all (64 MB), and words of 64 bits that one task makes.
FILTER_BITS, MOST_BITS, FILTER_SLICE = 12, 1 << 29, 1 << 16


def _canonical(piece: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the valid windows of a piece: their first letter's place, and the two-bit values of the window and of its
    reverse complement, left-aligned in 64 bits; the smaller one is the canonical form."""
    codes, valid = window_codes(np.frombuffer(piece, np.uint8), k)
    other, _ = window_codes(np.frombuffer(piece[::-1].translate(_COMPLEMENT), np.uint8), k)
    at, shift = np.flatnonzero(valid), np.uint64(64 - 2 * k)
    return at, codes[at] << shift, other[::-1][at] << shift


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, list[np.ndarray]]]:
    """The pieces of a batch in runs of about ``PIECE`` letters: the letters with a blank between pieces, where each piece
    starts, and its sample, contig and offset. Most pieces are short, so windows are made for many of them at once."""
    held = [batch.column(c).to_numpy() for c in ("sample_ord", "contig_ord", "offset")]
    parts = [p or b"" for p in batch.column("piece").to_pylist()]
    first = size = 0
    for i, part in enumerate(parts):
        size += len(part) + 1
        if size >= PIECE or i + 1 == len(parts):
            some = parts[first : i + 1]
            starts = np.cumsum([0, *(len(p) + 1 for p in some[:-1])])
            yield b" ".join(some), starts, [c[first : i + 1] for c in held]
            first, size = i + 1, 0


def _batch(starts: np.ndarray, held: list[np.ndarray], at: np.ndarray, k: int, **more: pa.Array) -> pa.RecordBatch:
    """Windows that begin ``at`` places of a run."""
    row = np.searchsorted(starts, at, "right") - 1
    sample, contig, offset = (c[row] for c in held)
    columns = [pa.array(sample.astype(np.int32)), pa.array(contig.astype(np.int32)), pa.array((at - starts[row] + offset + (k - 1)).astype(np.int64)), *more.values()]
    return pa.RecordBatch.from_arrays(columns, ["sample_ord", "contig_ord", "end", *more])


def _windows(k: int, keep=None, palindromes: bool = True):
    """``keep``: of canonical values, which to give; all without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters, starts, held in _runs(batch):
                at, own, turned = _canonical(letters, k)
                ck = np.minimum(own, turned)
                given = np.ones(len(ck), dtype=bool) if keep is None else keep(ck)
                if not palindromes:
                    given &= own != turned
                if given.any():
                    yield _batch(starts, held, at[given], k, ck=pa.array(ck[given].view(np.int64)), forward=pa.array((own <= turned)[given]))

    return run


def _strings(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters, starts, held in _runs(batch):
                at, own, turned = _canonical(letters, k)
                here, there = np.frombuffer(letters, np.uint8), np.frombuffer(letters.translate(_COMPLEMENT), np.uint8)
                # some windows at a time: each takes k bytes twice
                for some in np.split(np.arange(len(at)), range(1 << 16, len(at), 1 << 16)):
                    if not len(some):
                        continue
                    place = at[some][:, None] + np.arange(k)
                    kmer, other = here[place], there[place][:, ::-1]
                    ck = np.where((own <= turned)[some][:, None], kmer, other)
                    text = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(some), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()).cast(pa.string()) for x in (kmer, ck)]
                    yield _batch(starts, held, at[some], k, kmer=text[0], ck=text[1])

    return run


def tasks_for(spark: SparkSession, letters: int | None) -> int:
    """Tasks for the windows of so many letters. Nearly all windows are keys of their own, so with a fixed number of tasks what
    each holds of them would grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(letters or 0) // TASK))


def _spread(contigs: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    ship(contigs.sparkSession)
    if "part" in contigs.columns:
        return aligned(contigs, k - 1)
    n = tasks or tasks_for(contigs.sparkSession, None)
    return pieces(contigs.select("sample_ord", "contig_ord", "seq"), k).repartition(n, "sample_ord", "contig_ord", "offset")


def coded_kmers(contigs: DataFrame, k: int) -> DataFrame:
    """``sample_ord, contig_ord, end, ck, forward`` of every valid window, ``ck`` as a left-aligned number."""
    return _spread(contigs, k).mapInArrow(_windows(k), CODES)


def _counted(k: int, by_piece: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters, starts, held in _runs(batch):
                at, own, turned = _canonical(letters, k)
                if not len(at):
                    continue
                ck = np.minimum(own, turned)
                row = np.searchsorted(starts, at, "right") if by_piece else np.zeros(len(at), np.int64)
                order = np.lexsort((ck, row)) if by_piece else np.argsort(ck, kind="stable")
                ck, row = ck[order], row[order]
                first = np.flatnonzero(np.append(True, (ck[1:] != ck[:-1]) | (row[1:] != row[:-1])))
                n = np.diff(np.append(first, len(ck)))
                yield _batch(starts, held, at[order[first]], k, ck=pa.array(ck[first].view(np.int64)), n=pa.array(n.astype(np.int64)))

    return run


def counted_kmers(contigs: DataFrame, k: int, tasks: int | None = None, by_piece: bool = False) -> DataFrame:
    """``sample_ord, contig_ord, end, ck, n``: canonical k-mers of every run of short pieces, or ``by_piece`` of every piece, each
    once, with how often it occurs there and one place. So a very frequent one is few rows wherever it is dealt. With ``tasks``,
    which :func:`tasks_for` gives, as many make the rows, and as many get them, dealt by ``ck``."""
    found = _spread(contigs, k, tasks).mapInArrow(_counted(k, by_piece), "sample_ord int, contig_ord int, end long, ck long, n long")
    return found.repartition(tasks, "ck") if tasks else found


_PLACED = np.dtype([("ck", np.uint64), ("end", np.int64), ("sample_ord", np.int32), ("contig_ord", np.int32)])


def _dealt_windows(k: int, shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters, starts, held in _runs(batch):
                at, own, turned = _canonical(letters, k)
                ck = np.minimum(own, turned)
                share = (finalised(ck) % np.uint64(shares)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                at, ck, share = at[order], ck[order], share[order]
                row = np.searchsorted(starts, at, "right") - 1
                out = np.empty(len(at), _PLACED)
                out["ck"], out["end"] = ck, at - starts[row] + held[2][row] + (k - 1)
                out["sample_ord"], out["contig_ord"] = held[0][row], held[1][row]
                edges = np.flatnonzero(np.diff(share, prepend=-1))
                parts = [part.tobytes() for part in np.split(out, edges[1:])] if len(edges) else []
                yield pa.RecordBatch.from_arrays([pa.array(share[edges]), pa.array(parts, pa.binary())], ["share", "windows"])

    return run


#: A place without its k-mer, and odd factors that deal parts of contigs.
_ENDS = np.dtype([("end", np.int64), ("sample_ord", np.int32), ("contig_ord", np.int32)])
_MIXED = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _only_once(row: int, shares: int):
    """Of a share of windows, the places of those that come once, dealt by the part of a contig where they are."""

    def run(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x.as_buffer(), _PLACED) for x in table.column("windows")])
        order = np.argsort(found["ck"])
        ck = found["ck"][order]
        other = np.append(True, ck[1:] != ck[:-1])
        found = found[order[other & np.append(other[1:], True)]]
        held = (found["sample_ord"], found["contig_ord"], found["end"] // row)
        with np.errstate(over="ignore"):
            mixed = sum((x.astype(np.uint64) * m for x, m in zip(held, _MIXED, strict=True)), np.zeros(len(found), np.uint64))
        bucket = (finalised(mixed) % np.uint64(shares)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out = np.empty(len(found), _ENDS)
        for name in _ENDS.names:
            out[name] = found[name][order]
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        parts = [part.tobytes() for part in np.split(out, edges[1:])] if len(edges) else []
        return pa.table([pa.array(bucket[order][edges], pa.int64()), pa.array(parts, pa.binary())], ["bucket", "places"])

    return run


def _listed(row: int):
    def run(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x.as_buffer(), _ENDS) for x in table.column("places")])
        found = found[np.lexsort((found["end"], found["contig_ord"], found["sample_ord"]))]
        part = found["end"] // row
        new = np.ones(len(found), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (found["contig_ord"][1:] != found["contig_ord"][:-1]) | (found["sample_ord"][1:] != found["sample_ord"][:-1])
        first = np.flatnonzero(new)
        ends = pa.ListArray.from_arrays(pa.array(np.append(first, len(found)).astype(np.int32)), pa.array(np.ascontiguousarray(found["end"])))
        heads = [pa.array(np.ascontiguousarray(x[first])) for x in (found["sample_ord"], found["contig_ord"], part)]
        return pa.table([*heads, ends], ["sample_ord", "contig_ord", "part", "ends"])

    return run


def single_places(contigs: DataFrame, k: int, row: int, tasks: int | None = None) -> DataFrame:
    """``sample_ord, contig_ord, part, ends``: where canonical k-mers that come once in all contigs end, one sorted list for each
    ``row`` places of a contig. Windows are dealt by k-mer into shares of about ``TASK`` letters, and the places that stay by part
    into as many, each time in a few rows of bytes, as a row for every window or short list costs far more than to count it."""
    shares = tasks or tasks_for(contigs.sparkSession, None)
    dealt = _spread(contigs, k, tasks).mapInArrow(_dealt_windows(k, shares), "share long, windows binary")
    dealt = dealt.repartition(tasks, "share") if tasks else dealt
    once = dealt.groupBy("share").applyInArrow(_only_once(row, shares), "bucket long, places binary")
    once = once.repartition(tasks, "bucket") if tasks else once
    return once.groupBy("bucket").applyInArrow(_listed(row), "sample_ord int, contig_ord int, part long, ends array<long>")


def sampled_codes(contigs: DataFrame, k: int, fraction: float) -> DataFrame:
    """Only windows whose canonical k-mer belongs to the sampled share and is not its own reverse complement."""
    bound = min(int(float((1 << 64) - 1) * fraction), (1 << 64) - 1)
    keep = lambda ck: (finalised(ck) ^ np.uint64(SAMPLE_MASK)) < np.uint64(bound)
    return _spread(contigs, k).mapInArrow(_windows(k, keep, palindromes=False), CODES)


def _filter_places(ck: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each value, its word in a filter and the four bits that it sets there."""
    mixed = finalised(ck)
    bits = np.zeros(len(ck), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << ((mixed >> np.uint64(shift)) & np.uint64(63))
    return ((mixed >> np.uint64(24)) % np.uint64(words)).astype(np.int64), bits


def _filter_slice(words: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        word, bits = _filter_places(table.column("ck").to_numpy().view(np.uint64), words)
        out = np.zeros(min(FILTER_SLICE, words - number * FILTER_SLICE), np.uint64)
        np.bitwise_or.at(out, word - number * FILTER_SLICE, bits)
        return pa.table({"slice": pa.array([number], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    return run


def _dealt_to_slices(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, _ = _filter_places(batch.column("ck").to_numpy().view(np.uint64), words)
            yield pa.RecordBatch.from_arrays([pa.array(word // FILTER_SLICE), batch.column("ck")], ["slice", "ck"])

    return run


def membership_filter(values: DataFrame, n: int) -> np.ndarray:
    """A blocked Bloom filter over ``n`` numbers ``ck``: each sets four bits of one word. Slices of it are made by many tasks;
    the whole has ``MOST_BITS`` bits at most, however many numbers there are."""
    words = max(1, min(MOST_BITS, n * FILTER_BITS) // 64)
    ship(values.sparkSession)
    dealt = values.select("ck").mapInArrow(_dealt_to_slices(words), "slice long, ck long")
    out = np.zeros(words, np.uint64)
    for row in dealt.groupBy("slice").applyInArrow(_filter_slice(words), "slice long, bits binary").toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint64)
        out[row["slice"] * FILTER_SLICE :][: len(part)] = part
    return out


def maybe_windows_of(contigs: DataFrame, values: DataFrame, n: int, k: int) -> DataFrame:
    """Windows whose canonical value passes the filter of ``ck`` numbers: all that are among them, and few others."""
    sent = contigs.sparkSession.sparkContext.broadcast(membership_filter(values, n))

    def keep(ck: np.ndarray) -> np.ndarray:
        word, bits = _filter_places(ck, len(sent.value))
        return sent.value[word] & bits == bits

    return _spread(contigs, k).mapInArrow(_windows(k, keep), CODES)


#: Factor and bits of the table that shows which values are not wanted: 16 cells a value, of a byte each, at most so many.
_SPREAD, MOST_CELLS = np.uint64(0x9E3779B97F4A7C15), 1 << 24


def _among(wanted: Callable[[], np.ndarray]):
    """Which values are among the sorted ones that ``wanted`` gives. Most are not, and of these a table shows nearly all; only
    the others are sought. The table is made once by every task."""
    cells: list[np.ndarray] = []

    def cell(values: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (values * _SPREAD) >> np.uint64(64 - n)

    def keep(ck: np.ndarray) -> np.ndarray:
        there = wanted()
        bits = min(16 * len(there), MOST_CELLS).bit_length()
        if not cells:
            cells.append(np.zeros(1 << bits, dtype=bool))
            cells[0][cell(there, bits)] = True
        given = cells[0][cell(ck, bits)]
        at = np.flatnonzero(given)
        given[at] = there[np.minimum(np.searchsorted(there, ck[at]), len(there) - 1)] == ck[at]
        return given

    return keep


def windows_of(contigs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Windows whose canonical k-mer is among ``ck`` strings of ``wanted``: sorted numbers are sent to all tasks if there
    are at most ``MOST_SENT`` of them; else windows that pass a filter are joined with the wanted k-mers."""
    values = wanted.select(kmer_value(F.col("ck"), k).alias("ck")).distinct()
    known = np.sort(values.limit(MOST_SENT + 1).toArrow().column("ck").to_numpy().view(np.uint64))  # what makes them runs once
    if len(known) > MOST_SENT:
        return maybe_windows_of(contigs, values, values.count(), k).join(values, "ck", "left_semi").select(*[x.split()[0] for x in CODES.split(", ")])
    if not len(known):
        return coded_kmers(contigs.limit(0), k)
    sent = contigs.sparkSession.sparkContext.broadcast(known)
    return _spread(contigs, k).mapInArrow(_windows(k, _among(lambda: sent.value)), CODES)
