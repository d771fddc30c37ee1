"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A shingle is five words in a row (a shorter text is one shingle). Its weight is its count in the text times
``1 + ln(N / df)``, its inverse document frequency, scaled so that a shingle of one document weighs 1. Document
frequencies are exact for every shingle and are found in two steps:

1. Documents are held in blocks. The cells of a block's shingles (leading bits of their hashes, about forty times as many
   cells as shingles) are dealt to buckets, and each block gets back one bit per cell: whether another document has it. A
   shingle alone in its cell is in one document only.
2. Of the others, whole hashes and counts are dealt and summed, and each block gets back the frequencies that it needs.

What a text has in common with another is no more than the weight of its shared shingles; texts where that is too small a
share of the whole are not sampled, as they cannot be similar enough to any other.

Each text gets ``BANDS * ROWS`` weighted samples; texts that share a band are candidates. In a bucket, members are
compared with one centre, not with each other; the texts of buckets that this leaves with several components are joined
across components by an exact prefix filter on their shingles, so no candidate link is lost. Each comparison computes
the weighted Jaccard similarity of the two whole texts. Equal texts are one node throughout.

At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8**4)**15 = 0.9996.

Defined cases: null and empty texts are equal to each other, and other texts without words are alike only if they are
equal; ids name rows but do not join them: rows of one id, or of none, with different texts are documents of their own;
a null id counts as the smallest, and its class gets a number under ``OTHER_CLASSES``, as does every class but one of those that
have one smallest id; an empty table gives no rows. Columns that are not named are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_BYTES, join_counted, lean, materialize, packed, remove, ship, unpacked
from .components import connected_components
from .hashing import mix64, span_hashes

SHINGLE, BANDS, ROWS = 5, 15, 4
#: Centres per bucket in the rounds before the last.
CENTRES = (1,)
NULL_ID = -(1 << 63)
#: Classes that can't be named by an id of their own are numbered downwards from here.
OTHER_CLASSES = -(1 << 62)
_PART_BYTES, _BLOCK_DOCS, _BLOCK_BYTES, _BUCKET_BYTES = 1 << 20, 1 << 13, 1 << 22, 1 << 23


def _tables():
    """Fixed by seeds, so that every worker draws alike: odd multipliers, quantiles of Gamma(2, 1) and their logarithms."""
    rng = np.random.Generator(np.random.PCG64(20240301))
    multipliers = rng.integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1)
    # quantiles by bisection on the distribution function 1 - (1 + x) * exp(-x)
    q = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        above = 1 - (1 + mid) * np.exp(-mid) > q
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    gamma = ((low + high) / 2).astype(np.float32)
    return multipliers, gamma, np.log(gamma)


_MULTIPLIER, _GAMMA, _LOG_GAMMA = _tables()
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def shingles_of(texts: list[bytes]) -> list[np.ndarray]:
    """For every text, the 64-bit hashes of its shingles in order, repeats included."""
    if not texts:
        return []
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, last = edge[::2], edge[1::2]  # a word begins where white space ends
    word = span_hashes(data, first, last)[0]
    with np.errstate(over="ignore"):
        n = len(word) - SHINGLE + 1
        code = np.zeros(max(0, n), dtype=np.uint64)
        for j in range(SHINGLE):
            code += word[j : j + len(code)] * _MULTIPLIER[4000 + j]
        code = mix64(code, 2)
    bounds = np.searchsorted(first, np.concatenate([[0], ends]))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(code[a : b - SHINGLE + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                short = np.sum(word[a:b] * _MULTIPLIER[4000 : 4000 + b - a], dtype=np.uint64, keepdims=True)
            out.append(mix64(short, 3 + b - a))
        else:
            out.append(code[:0])
    return out


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about a megabyte."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _PART_BYTES:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


class Weights:
    """Weights of shingles from the table of those in several documents: sorted hashes and their weights, at most 1."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n_docs: int):
        self.hashes, first = np.unique(hashes, return_index=True)
        self.weights = idf(df[first], n_docs)

    def weigh(self, found: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF weights of distinct hashes with these counts, and which of them several documents have."""
        if not len(self.hashes) or not len(found):
            return tf.astype(np.float64), np.zeros(len(found), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        known = self.hashes[at] == found
        return tf * np.where(known, self.weights[at], 1.0), known


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequency, as a share of that of a shingle in one document."""
    return (1 + np.log(n_docs / df)) / (1 + np.log(n_docs))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (hashes, weights); of two without words, 0."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either else 0.0


def signature(hashes: np.ndarray, weights: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """``samples`` consistent weighted samples, each a 64-bit code of the chosen shingle and its level.

    For a shingle of weight w: r, c ~ Gamma(2, 1), b ~ U(0, 1), t = floor(ln w / r + b), ln y = r (t - b), and the
    shingle with the least ln c - ln y - r is chosen. r, c and b come from the bits of the hash times a random odd number.
    """
    best = np.full(samples, np.inf, dtype=np.float32)
    chosen, level = np.zeros(samples, dtype=np.uint64), np.zeros(samples, dtype=np.int64)
    multiplier, every = _MULTIPLIER[:samples, None], np.arange(samples)
    for at in range(0, len(hashes), 2048):
        part, log_w = hashes[at : at + 2048], np.log(weights[at : at + 2048]).astype(np.float32)
        with np.errstate(over="ignore"):
            bits = (part[None, :] * multiplier).view(np.uint16).reshape(samples, len(part), 4)
        r, cost = _GAMMA[bits[:, :, 3]], _LOG_GAMMA[bits[:, :, 2]]
        b = bits[:, :, 1] * np.float32(1 / (1 << 16))
        if log_w.any():
            t = np.floor(log_w / r + b)
            cost = cost - r * (t - b + np.float32(1))
        else:
            t = None  # ln w = 0: the level is 0
            cost = cost + r * (b - np.float32(1))
        least = np.argmin(cost, axis=1)
        value = cost[every, least]
        better = value < best
        best[better], chosen[better] = value[better], part[least[better]]
        level[better] = 0 if t is None else t[every, least][better].astype(np.int64)
    with np.errstate(over="ignore"):
        return mix64(chosen ^ mix64(level.view(np.uint64), 11), 12)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j], 20 + j)
    return key.view(np.int64)


BLOCKS = "block long, size long, n_docs long, keys binary, lengths binary, ids binary, id_sizes binary, texts binary"
KEY = 16


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in blocks, a row each: their distinct texts, compressed together, and the ids of each."""
    first, done = TaskContext.get().partitionId() << 20, 0
    texts: dict[bytes, tuple[bytes, list[int]]] = {}
    size = docs = 0

    def row() -> pa.RecordBatch:
        held = list(texts.values())
        lengths, sizes = (np.array(x, dtype="<i8").tobytes() for x in ([len(t) for t, _ in held], [len(i) for _, i in held]))
        ids = np.concatenate([np.sort(np.array(i, dtype="<i8")) for _, i in held]).tobytes()
        values = [first + done, size, docs, b"".join(texts), lengths, ids, sizes, pa.compress(b"".join([t for t, _ in held]), codec="zstd", asbytes=True)]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

    for batch in batches:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()]
        for doc, key, text in zip(*columns, strict=True):
            if key not in texts:
                texts[key] = (text or b"", [])
                size += len(texts[key][0])
            texts[key][1].append(doc)
            docs += 1
            if docs >= _BLOCK_DOCS or size >= _BLOCK_BYTES:
                yield row()
                done, size, docs, texts = done + 1, 0, 0, {}
    if docs:
        yield row()


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _counted_shingles(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every distinct text of a block, its distinct shingles, sorted, and their counts."""
    whole = pa.decompress(row["texts"], decompressed_size=row["size"], codec="zstd", asbytes=True)
    ends = np.cumsum(_longs(row["lengths"])).tolist()
    for texts in _parts([whole[a:b] for a, b in zip([0, *ends], ends)]):
        for codes in shingles_of(texts):
            yield np.unique(codes, return_counts=True)


def _packed(values: np.ndarray) -> bytes:
    """Sorted words as the first one and the steps to the others, in as few bytes as the largest step takes, the high
    bytes of all first."""
    steps = np.diff(values)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(steps) or int(steps.max()) >> (8 * w) == 0)
    return bytes([width]) + values[:1].astype("<u8").tobytes() + steps.astype(f">u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=9).reshape(width, -1).T).view(f">u{width}").ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 1), steps.astype(np.uint64)]), dtype=np.uint64)


def _cut(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted hashes dealt by ranges to fewer than 2**32 buckets."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return list(zip(bucket[cut].tolist(), cut, [*cut, len(hashes)][1:], strict=True))


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _cells(shift: int, block_shingles: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct cells of a block, as hashes whose last ``shift`` bits are 0, and its shingles."""
    held = list(block_shingles)
    found = np.unique(np.concatenate([np.zeros(0, np.uint64), *[f for f, _ in held]]) >> np.uint64(shift))
    return found << np.uint64(shift), held


DEALT = "bucket long, block long, cells binary"


def _deal(buckets: int, shift: int):
    """Cells of a block's shingles, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells, _ = _cells(shift, _counted_shingles(row))
                yield _rows(DEALT, [(bucket, row["block"], _packed(cells[a:b] >> np.uint64(shift))) for bucket, a, b in _cut(cells, buckets)])

    return run


SHARED = "block long, bucket long, shared binary"


def _share(table: pa.Table) -> pa.Table:
    """For every block with cells in this bucket, a bit per cell: whether another block has it too."""
    parts = [_unpacked(x) for x in table.column("cells").to_pylist()]
    _, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    several = np.split(count[place] > 1, np.cumsum([len(p) for p in parts])[:-1])
    bucket = table.column("bucket")[0].as_py()
    rows = [(block, bucket, np.packbits(bits).tobytes()) for block, bits in zip(table.column("block").to_pylist(), several, strict=True)]
    return pa.Table.from_batches([_rows(SHARED, rows)])


#: Distinct texts of blocks (``place`` names one; ``h, tf`` only where it may be similar to another), and between them
#: rows with a ``bucket``: what a block adds to frequencies, and a bit for those that it wants to know.
TEXTS = "block long, place long, key binary, ids array<long>, h array<long>, tf array<int>, bucket long, hashes binary, n binary, wanted binary"


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _split(buckets: int, shift: int, n_docs: int, threshold: float):
    """Texts of a block, with their shingles if those in shared cells could make up for the others, and its frequencies."""
    highest = idf(np.array([2]), n_docs)[0]  # of shingles that are not alone

    def run(blocks: pa.Table, shared: pa.Table) -> pa.Table:
        out = []
        bits = dict(zip(shared.column("bucket").to_pylist(), shared.column("shared").to_pylist(), strict=True))
        for row in blocks.to_pylist():
            cells, held = _cells(shift, _counted_shingles(row))
            sizes = _longs(row["id_sizes"])
            several = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a).astype(bool) for bucket, a, b in _cut(cells, buckets)]])
            every = np.concatenate([np.zeros(0, np.uint64), *[f for f, _ in held]])
            found, place = np.unique(every, return_inverse=True)
            n = np.bincount(place, np.repeat(sizes, [len(f) for f, _ in held]), len(found)).astype("<i4")
            # a cell of several shingles of this block, or of one in several of its documents, counts as shared too
            cell = np.searchsorted(cells, found >> np.uint64(shift) << np.uint64(shift))
            several |= np.bincount(cell, n, len(cells)) > 1
            open_ = several[cell]
            wanted = np.zeros(len(found), dtype=bool)
            none = np.zeros(0, np.int64), np.zeros(0, np.int32)
            vectors, at = [], 0
            for f, tf in held:
                here = place[at : at + len(f)]
                at += len(f)
                common = highest * tf[open_[here]].sum()
                able = len(f) and common >= threshold * (1 - 1e-9) * (tf[~open_[here]].sum() + common)
                if able:
                    wanted[here] = True
                vectors.append((f.view(np.int64), tf.astype(np.int32)) if able else none)
            count = len(sizes)
            ids = np.split(_longs(row["ids"]), np.cumsum(sizes)[:-1])
            keys = [row["keys"][KEY * i : KEY * (i + 1)] for i in range(count)]
            empty = [pa.nulls(count, kind) for kind in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
            texts = [pa.array([row["block"]] * count, pa.int64()), pa.array((row["block"] << 13) + np.arange(count)), pa.array(keys, pa.binary())]
            texts += [_lists(ids, pa.int64()), _lists([h for h, _ in vectors], pa.int64()), _lists([t for _, t in vectors], pa.int32())]
            out.append(pa.RecordBatch.from_arrays([*texts, *empty], [x.split()[0] for x in TEXTS.split(", ")]))
            sent, amount, needs = found[open_], n[open_], (wanted & open_)[open_]
            parts = [(bucket, _packed(sent[a:b]), amount[a:b].tobytes(), np.packbits(needs[a:b]).tobytes()) for bucket, a, b in _cut(sent, buckets)]
            m = len(parts)
            empty = [pa.nulls(m, kind) for kind in (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))]
            given = [pa.array([p[i] for p in parts], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            out.append(pa.RecordBatch.from_arrays([pa.array([row["block"]] * m, pa.int64()), *empty, *given], [x.split()[0] for x in TEXTS.split(", ")]))
        return pa.Table.from_batches(out)

    return run


FREQUENCIES = "block long, hashes binary, df binary"


def _count(table: pa.Table) -> pa.Table:
    """Of a bucket, what every block gets back: the shingles it wants to know, with their number of documents."""
    parts = [_unpacked(x) for x in table.column("hashes").to_pylist()]
    n = np.concatenate([np.frombuffer(x, "<i4") for x in table.column("n").to_pylist()])
    _, place = np.unique(np.concatenate(parts), return_inverse=True)
    df = np.bincount(place, n).astype("<i8")[place]
    rows, at = [], 0
    for block, part, wanted in zip(table.column("block").to_pylist(), parts, table.column("wanted").to_pylist(), strict=True):
        keep = np.unpackbits(np.frombuffer(wanted, np.uint8), count=len(part)).astype(bool)
        if keep.any():
            rows.append((block, _packed(part[keep]), df[at : at + len(part)][keep].tobytes()))
        at += len(part)
    return pa.Table.from_batches([_rows(FREQUENCIES, rows)])


SIGNED = "place long, total double, bands array<long>, h array<long>, w array<double>"


def _sign(n_docs: int, threshold: float):
    """Bands and weighted shingles of the texts of a block that can be similar to another text."""

    def run(texts: pa.Table, given: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.zeros(0, np.uint64), *map(_unpacked, given.column("hashes").to_pylist())])
        weights = Weights(hashes, np.frombuffer(b"".join(given.column("df").to_pylist()), "<i8"), n_docs)
        places, totals, keys, vectors = [], [], [], []
        for place, h, tf in zip(*(texts.column(c).to_pylist() for c in ("place", "h", "tf")), strict=True):
            found = np.array(h, dtype=np.int64).view(np.uint64)
            w, known = weights.weigh(found, np.array(tf))
            total = float(w.sum())
            if w[known].sum() >= threshold * (1 - 1e-9) * total:
                places.append(place)
                totals.append(total)
                keys.append(bands(signature(found, w)))
                vectors.append((found.view(np.int64), w))
        columns = [pa.array(places, pa.int64()), pa.array(totals, pa.float64()), _lists(keys, pa.int64())]
        return pa.table([*columns, _lists([h for h, _ in vectors], pa.int64()), _lists([w for _, w in vectors], pa.float64())], ["place", "total", "bands", "h", "w"])

    return run


def signed_texts(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """From ``doc_id, key, text``: ``place, key, ids`` of the distinct texts of every block; ``place, total, bands, h, w``
    of those that can be similar to another; and the number of documents."""
    spark = docs.sparkSession
    blocks = materialize(docs.mapInArrow(lean(_block), BLOCKS), "nd-blocks")
    size, n_docs = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    buckets = min(1 << 31, max(8, -(-size // _BUCKET_BYTES)))
    shift = max(0, 64 - (int(size).bit_length() + 3))  # a shingle takes five bytes or more
    dealt = blocks.select("block", "size", "lengths", "texts").mapInArrow(lean(_deal(buckets, shift)), DEALT)
    shared = materialize(dealt.groupBy("bucket").applyInArrow(lean(_share), SHARED), "nd-shared")
    _release(spark)
    split = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lean(_split(buckets, shift, max(2, n_docs), threshold)), TEXTS)
    split = materialize(split, "nd-texts")
    remove(blocks)
    remove(shared)
    _release(spark)
    given = split.where("bucket is not null").select("bucket", "block", "hashes", "n", "wanted")
    given = given.groupBy("bucket").applyInArrow(lean(_count), FREQUENCIES)
    able = split.where(F.size("h") > 0).select("block", "place", "h", "tf")
    signed = materialize(able.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(lean(_sign(max(1, n_docs), threshold)), SIGNED), "nd-signed")
    texts = split.where("place is not null").select("place", "key", "ids")
    return texts, signed, n_docs


def _vectors(batch: pa.RecordBatch, side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    h, w = batch.column(f"h_{side}"), batch.column(f"w_{side}")
    ends, hashes, weights = h.offsets.to_numpy(), h.values.to_numpy(), w.values.to_numpy()
    begin = w.offsets.to_numpy()
    for i in range(len(h)):
        yield hashes[ends[i] : ends[i + 1]].view(np.uint64), weights[begin[i] : begin[i + 1]]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.array([similarity(a, b) >= threshold for a, b in zip(_vectors(batch, "a"), _vectors(batch, "b"), strict=True)], dtype=bool)
            yield batch.select(["a", "b"]).filter(pa.array(hit))

    return run


def _with_centres(here: DataFrame, centres: int, step: int, threshold: float) -> DataFrame:
    """``x, y``: members of open buckets with up to ``centres`` centres of another component; linear in the members."""
    part = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(centres)) if centres > 1 else F.lit(0)
    chosen = here.groupBy("bucket", part.alias("part")).agg(F.min(F.struct((-F.col("reach")).alias("rank"), "node", "component", "total")).alias("c"), F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("bucket")  # at most ``centres`` rows
    chosen = chosen.select("bucket", F.sum("n").over(per).alias("n_here"), F.col("c.node").alias("y"), F.col("c.component").alias("other"), F.col("c.total").alias("size"))
    chosen = materialize(chosen, "nd-centres")
    # texts whose total weights differ by more can't be similar enough
    near = F.least("total", "size") >= F.lit(threshold * (1 - 1e-9)) * F.greatest("total", "size")
    joined = join_counted(here, chosen, ["bucket"], here.count(), "n_here")
    return joined.where((F.col("component") != F.col("other")) & near).select(F.col("node").alias("x"), "y")


def _across(here: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """``x, y``: texts of open buckets in different components that can still be similar enough, by a prefix filter.

    Shingles are ordered by how many of these texts hold them, rarest first. A pair's common weight has to be
    threshold / (1 + threshold) of the sum of its totals, and cannot be more than what either text holds from their first
    common shingle on. So a shingle is looked up only where that rest is large enough, and a pair is made only where the
    smaller rest is. Of the texts with a shingle, one side leaves out the largest component: no pair lies inside it.
    """
    nodes = here.select(F.col("node").alias("d"), "component", "total").distinct()
    shingles = bodies.join(nodes.select("d"), F.col("place") == F.col("d"), "left_semi").select(F.col("place").alias("n"), F.inline(F.arrays_zip("h", "w")))
    shingles = materialize(shingles, "nd-shingles")
    common = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(F.col("h").alias("k"), "df")
    held = shingles.join(common, F.col("h") == F.col("k")).join(nodes, F.col("n") == F.col("d")).select("n", "component", "total", "h", "df", "w")
    after = Window.partitionBy("n").orderBy(F.desc("df"), F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)
    limit = threshold * (1 - 1e-9)
    rest = held.withColumn("rest", F.sum("w").over(after)).where(F.col("rest") >= F.lit(limit) * F.col("total"))
    rows = materialize(rest.select("n", "component", "total", "h", "rest"), "nd-prefixes")
    largest = rows.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.max(F.struct("n", "component")).alias("l"), F.count(F.lit(1)).alias("parts"))
    largest = largest.where("parts > 1").select(F.col("h").alias("k"), F.col("l.component").alias("main"))
    left = rows.join(largest, F.col("h") == F.col("k")).where(F.col("component") != F.col("main")).drop("k", "main")
    right = rows.select(F.col("h").alias("k"), F.col("n").alias("y"), F.col("component").alias("other"), F.col("total").alias("size"), F.col("rest").alias("able"))
    enough = F.least("rest", "able") >= F.lit(limit / (1 + threshold)) * (F.col("total") + F.col("size"))
    return left.join(right, (F.col("h") == F.col("k")) & (F.col("component") != F.col("other")) & enough).select(F.col("n").alias("x"), "y")


def _release(spark: SparkSession) -> None:
    """Shuffle files of what is written stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _documents(documents: DataFrame, doc: str, text: str, **more: str) -> DataFrame:
    """Rows in a struct, with ``doc_id, text`` without nulls and the MD5 of the text as ``key``."""
    rows = packed(documents, doc_id=doc, text=text)
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select("row", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.unhex(F.md5(whole.cast("binary"))).alias("key"), whole.alias("text"))


def _links(signed: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified ``a, b`` links between texts, and ``node, component`` of those with any."""
    signed = materialize(signed.join(nodes.select(F.col("node").alias("place")), "place", "left_semi"), "nd-vectors")
    keyed = signed.select(F.col("place").alias("node"), "total", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("size")).where("least < most").select("bucket", "size")
    shared = materialize(shared, "nd-shared-bands")
    inside = join_counted(keyed, shared, ["bucket"], BANDS * signed.count(), "size").select("bucket", "node", "total", "size")
    inside = materialize(inside.distinct(), "nd-inside")
    # a text that differs from others in few places shares many large buckets, and makes a good centre
    reach = inside.groupBy("node").agg(F.sum("size").alias("reach"))
    buckets = materialize(inside.drop("size").join(reach, "node"), "nd-buckets")
    bodies = signed.select("place", "h", "w")

    links = tested = named = None
    labelled = buckets.withColumn("component", F.col("node"))
    for step in range(len(CENTRES) + 1):
        spread = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(F.col("bucket").alias("k"))
        here = materialize(labelled.join(spread, F.col("bucket") == F.col("k"), "left_semi"), "nd-open")
        pairs = _with_centres(here, CENTRES[step], step, threshold) if step < len(CENTRES) else _across(here, bodies, threshold)
        pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "nd-pairs")
        if pairs.isEmpty():
            continue
        left = pairs.join(bodies.select(F.col("place").alias("a"), F.col("h").alias("h_a"), F.col("w").alias("w_a")), "a")
        both = left.join(bodies.select(F.col("place").alias("b"), F.col("h").alias("h_b"), F.col("w").alias("w_b")), "b").select("a", "h_a", "w_a", "b", "h_b", "w_b")
        new = materialize(both.mapInArrow(lean(_verify(threshold)), "a long, b long"), "nd-links")
        links = new if links is None else links.union(new)
        tested = pairs if tested is None else tested.union(pairs)
        named = materialize(connected_components(links), "nd-components")
        joined = buckets.join(named.withColumnRenamed("component", "c"), "node", "left")
        labelled = joined.select("bucket", "node", "total", "reach", F.coalesce("c", "node").alias("component"))
    return links, named


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """``key, ids`` of the distinct texts of every block, and one row per text: ``key, rows`` (of the first table),
    ``least`` (its smallest id), ``copies`` (documents of that id and text), ``class_id, n_links, first`` (whether it is
    the one to keep of its class); and the number of documents."""
    texts, signed, n_docs = signed_texts(docs, threshold)
    # equal texts are one node, named by the first place
    least = F.get("ids", F.lit(0))
    copies = F.size(F.filter("ids", lambda x: x == F.get("ids", F.lit(0)))).cast("long")
    parts = texts.select("key", "place", least.alias("id"), copies.alias("copies")).groupBy("key", "id").agg(F.min("place").alias("place"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    nodes = parts.groupBy("key").agg(F.min("place").alias("node"), F.min("id").alias("least"), F.min_by("copies", "id").alias("copies"), F.sum("rows").alias("rows"))
    nodes = materialize(nodes, "nd-nodes")
    links, named = _links(signed, nodes, threshold)
    columns = ["key", "rows", "least", "copies"]
    single = [F.col("least").alias("class_id"), F.col("node").alias("kept"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first")]
    if links is None:
        return texts, _told_apart(materialize(nodes.select(*columns, *single), "nd-given"), n_docs), n_docs
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = materialize(named.join(ends, "node").join(nodes, "node"), "nd-linked")
    of_class = linked.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("class_id"), F.min(F.struct("least", "node")).alias("f"))
    of_class = materialize(of_class.select("component", "size", "class_id", F.col("f.node").alias("kept")), "nd-classes")
    in_class = join_counted(linked, of_class, ["component"], n_docs, "size").select(*columns, "class_id", "kept", "n_links", (F.col("node") == F.col("kept")).alias("first"))
    alone = nodes.join(named.select("node"), "node", "left_anti").select(*columns, *single)
    return texts, _told_apart(materialize(in_class.unionByName(alone), "nd-given"), n_docs), n_docs


def _told_apart(given: DataFrame, n_docs: int) -> DataFrame:
    """``given`` with a ``class_id`` of its own for every class. Where several classes have one smallest id, as documents
    may share an id, one of them keeps it; the others, and those whose smallest id is null, get one from ``OTHER_CLASSES`` down."""
    numbered = F.lit(OTHER_CLASSES) - F.col("kept")
    shared = given.where(F.col("first") & (F.col("class_id") != NULL_ID)).groupBy("class_id").agg(F.min("kept").alias("owner"), F.count(F.lit(1)).alias("n_classes")).where("n_classes > 1")
    shared = materialize(shared.select("class_id", "owner"), "nd-shared-ids")
    plain = given.withColumn("class_id", F.when(F.col("class_id") == NULL_ID, numbered).otherwise(F.col("class_id")))
    if shared.isEmpty():
        return plain.drop("kept")
    sizes = plain.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_texts")).join(shared, "class_id", "left")
    joined = join_counted(plain, materialize(sizes, "nd-class-sizes"), ["class_id"], n_docs, "n_texts")
    own = F.col("owner").isNull() | (F.col("owner") == F.col("kept"))
    return materialize(joined.withColumn("class_id", F.when(own, F.col("class_id")).otherwise(numbered)).drop("owner", "n_texts", "kept"), "nd-told-apart")


def near_duplicates(documents: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (the smallest id of its class, or a number under ``OTHER_CLASSES`` where
    another class has that id too or it is null), ``n_links`` (verified links of its text)."""
    ship(documents.sparkSession)
    texts, given, n_docs = _classes(_documents(documents, doc, text).drop("row"), threshold)
    joined = join_counted(texts, given.select("key", "rows", "class_id", "n_links"), ["key"], n_docs, "rows")
    return joined.select(F.explode("ids").alias("doc_id"), "class_id", "n_links").select(_shown("doc_id"), "class_id", "n_links")


def _shown(c: str):
    """A null id comes back as null."""
    return F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)


def keep_one(documents: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, with one row of each class: one of the smallest id with its text (of several such rows,
    any one)."""
    ship(documents.sparkSession)
    rows = _documents(documents, doc, text)
    _, given, n_docs = _classes(rows.drop("row"), threshold)
    kept = given.where("first").select(F.col("least").alias("doc_id"), "key", "copies")
    rows = rows.drop("text")
    once = rows.join(kept.where("copies = 1"), ["doc_id", "key"], "left_semi").select("row")
    if kept.where("copies > 1").isEmpty():
        return unpacked(once, documents)
    repeated = join_counted(rows, kept.where("copies > 1"), ["doc_id", "key"], n_docs, "copies").dropDuplicates(["doc_id", "key"])
    return unpacked(once.unionByName(repeated.select("row")), documents)
