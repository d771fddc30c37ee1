"""Line dedup: documents probe a sharded minimal perfect hash over the hashes of repeated lines.

1. Documents are held in blocks of a few megabytes, a compressed row each; a row of the input is named by its block and
   its place there, so rows without an id, or of one id, are no hot key.
2. Every document gives the hashes of its distinct line keys; they are counted per hash with map-side combining.
3. Hashes held by two documents or more are dealt into shards of bounded size. A shard is one row: a minimal perfect hash
   and, by its index, arrays of 64-bit fingerprints, document counts and smallest document ids.
4. The documents' hashes (no texts) are sent to the shards and looked up in the arrays. A shard that gets many probes,
   because one line is in very many documents, is copied and its probes are dealt over the copies.
5. What each block loses goes back to it, and the lines are dropped from the whole texts. Blocks move once, compressed.

The index of a large corpus is larger than a task's memory, so probes go to the shards and not shards to all documents.

A line's key is the line without white space at both ends and with A-Z lower-cased. Keys shorter than ``min_chars`` code
points never count. Identity is a 128-bit hash: 64 bits choose shard and slot, the other 64 are the fingerprint.

Defined cases: a null or empty text is one empty line; a null id counts as the smallest document; rows that repeat an id
are one document, so a line repeated within it stays; an empty table gives an empty result. Columns that are not named
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import SPACE_BYTES, materialize, ship
from .perfect_hash import PerfectHash

SHARD_KEYS, GROUP_PROBES = 1 << 17, 1 << 19
BLOCK_DOCS, BLOCK_BYTES = 1 << 13, 1 << 22
NULL_ID = -(1 << 63)
BLOCKS = "block long, size long, ids binary, lengths binary, texts binary"
#: ``place`` is a document's block times 2**13 and its number there.
PROBES = "place long, doc_id long, fingerprint long, slot long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Key of a UTF-8 line, or None if it is too short to count."""
    key = line.strip(SPACE_BYTES)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()  # of bytes: A-Z only


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, done, size = TaskContext.get().partitionId() << 20, 0, 0
    ids: list[int] = []
    texts: list[bytes] = []

    def row() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], dtype="<i8").tobytes()
        values = [first + done, size, np.array(ids, dtype="<i8").tobytes(), lengths, pa.compress(b"".join(texts), codec="zstd", asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(values)], [x.split()[0] for x in BLOCKS.split(", ")])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            ids.append(NULL_ID if doc is None else doc)
            texts.append(text or b"")
            size += len(texts[-1])
            if len(texts) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                yield row()
                done, size, ids, texts = done + 1, 0, [], []
    if texts:
        yield row()


def _documents(row: dict) -> Iterator[tuple[int, int, bytes]]:
    """(place, id, text) of the documents of a block."""
    whole = pa.decompress(row["texts"], decompressed_size=row["size"], codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(row["lengths"], "<i8")).tolist()
    ids = np.frombuffer(row["ids"], "<i8").tolist()
    for i, (doc, a, b) in enumerate(zip(ids, [0, *ends], ends)):
        yield (row["block"] << 13) + i, doc, whole[a:b]


def _probes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for row in batch.to_pylist():
                places, ids, sizes, hashes = [], [], [], []
                for place, doc, text in _documents(row):
                    keys = {line_key(x, min_chars) for x in text.split(b"\n")}
                    keys.discard(None)
                    places.append(place)
                    ids.append(doc)
                    sizes.append(len(keys))
                    hashes += map(digest, keys)
                pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                each = [pa.array(np.repeat(np.array(x, dtype=np.int64), sizes)) for x in (places, ids)]
                yield pa.RecordBatch.from_arrays([*each, pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["place", "doc_id", "fingerprint", "slot"])

    return run


def _build(key: tuple, table: pa.Table) -> pa.Table:
    slots = table.column("slot").to_numpy().view(np.uint64)
    prints = table.column("fingerprint").to_numpy()
    mph = PerfectHash.build(_distinct(slots, prints))
    order = np.argsort(mph.lookup(_distinct(slots, prints)))
    arrays = {
        "fingerprints": prints[order].astype("<i8").tobytes(),
        "counts": np.minimum(table.column("n_docs").to_numpy()[order], (1 << 32) - 1).astype("<u4").tobytes(),
        "keepers": table.column("keeper").to_numpy()[order].astype("<i8").tobytes(),
    }
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "mph": pa.array([mph.to_bytes()], pa.binary()), **{k: pa.array([v], pa.binary()) for k, v in arrays.items()}})


def _distinct(slots: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """What is hashed perfectly: both halves of the 128 bits, folded."""
    with np.errstate(over="ignore"):
        return slots * np.uint64(0x9E3779B97F4A7C15) + prints.view(np.uint64)


def _probe(key: tuple, probes: pa.Table, index: pa.Table) -> pa.Table:
    if not index.num_rows or not probes.num_rows:
        return probes.slice(0, 0).select(["place", "fingerprint"])
    row = {name: index.column(name)[0].as_py() for name in ("mph", "fingerprints", "counts", "keepers")}
    prints = np.frombuffer(row["fingerprints"], "<i8")
    counts, keepers = np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["keepers"], "<i8")
    ids, mine = probes.column("doc_id").to_numpy(), probes.column("fingerprint").to_numpy()
    at = PerfectHash.from_bytes(row["mph"]).lookup(_distinct(probes.column("slot").to_numpy().view(np.uint64), mine))
    hit = (at >= 0) & (prints[at] == mine) & (counts[at] >= 2) & (keepers[at] != ids)
    return pa.table({"place": pa.array(probes.column("place").to_numpy()[hit]), "fingerprint": pa.array(mine[hit])})


def _drop(min_chars: int):
    """A row per document of a block from what the block loses: pairs of place and fingerprint."""

    def kept(text: bytes, gone: set[int]) -> tuple[int, int, bytes]:
        lines = text.split(b"\n")
        if not gone:
            return len(lines), 0, text
        stay = []
        for line in lines:
            key = line_key(line, min_chars)
            if key is None or int.from_bytes(xxhash.xxh3_128_digest(key)[:8], "little", signed=True) not in gone:
                stay.append(line)
        return len(lines), len(lines) - len(stay), b"\n".join(stay)

    def run(blocks: pa.Table, lost: pa.Table) -> pa.Table:
        gone: dict[int, set[int]] = {}
        for place, mark in zip(lost.column("place").to_pylist(), lost.column("fingerprint").to_pylist(), strict=True):
            gone.setdefault(place, set()).add(mark)
        out = []
        for row in blocks.to_pylist():
            for place, doc, text in _documents(row):
                out.append((None if doc == NULL_ID else doc, *kept(text, gone.get(place, set()))))
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def build_index(probes: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame | None, DataFrame | None, int]:
    """``(index, shards, n_shards)``; the first is one row per shard, the second has each shard's number of probes that
    hit. None where no line repeats."""
    seen = Observation()
    counted = probes.observe(seen, F.count(F.lit(1)).alias("n")).groupBy("fingerprint", "slot")
    repeated = counted.agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_docs"))
    repeated = materialize(repeated.where("keeper < last").drop("last"), "line-counts")
    n = repeated.count()
    if not n:
        return None, None, 0
    n_shards = -(-n // shard_keys)
    keyed = repeated.withColumn("shard", F.pmod("slot", F.lit(n_shards)))
    index = keyed.groupBy("shard").applyInArrow(_build, "shard long, mph binary, fingerprints binary, counts binary, keepers binary")
    load = seen.get["n"] // n_shards  # probes that hit nothing are spread evenly
    shards = keyed.groupBy("shard").agg((F.floor((F.sum("n_docs") + F.lit(load)) / GROUP_PROBES) + 1).cast("long").alias("copies"))
    return materialize(index, "line-index"), materialize(shards, "line-shards"), n_shards


def dedup_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept`` (the text that is left)."""
    ship(documents.sparkSession)
    docs = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = materialize(docs.mapInArrow(_block, BLOCKS), "line-blocks")
    probes = blocks.mapInArrow(_probes(min_chars), PROBES)
    index, shards, n_shards = build_index(probes)
    if index is None:
        lost = documents.sparkSession.createDataFrame([], "block long, place long, fingerprint long")
    else:
        dealt = probes.withColumn("shard", F.pmod("slot", F.lit(n_shards))).join(shards, "shard")
        dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("place"), F.col("copies"))).drop("copies")
        copied = index.join(shards, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
        hits = dealt.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(_probe, "place long, fingerprint long")
        lost = hits.select(F.shiftright("place", 13).alias("block"), "place", "fingerprint")
    out = blocks.groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(_drop(min_chars), "doc_id long, n_lines long, n_dropped long, kept binary")
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def reference_digest(rows: list[tuple[int, str | None]], min_chars: int = 10) -> dict[int, tuple[int, int, str]]:
    """The same result by brute force over a few rows of distinct ids; for tests."""
    holders: dict[bytes, set[int]] = {}
    for i, text in rows:
        for line in (text or "").encode().split(b"\n"):
            if (key := line_key(line, min_chars)) is not None:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x in lines if (k := line_key(x, min_chars)) is None or len(holders[k]) < 2 or min(holders[k]) == i]
        out[i] = len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()
    return out
