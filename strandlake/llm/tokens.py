"""Encoding with a public tokenizer, token files with a seek table, and token counts.

A token file is a zstd file of independent frames, each with a content checksum and each holding the ids of whole
documents as little-endian unsigned integers. Then comes a skippable frame with the documents' ids, frames and places,
and at the very end the seek table of the public zstd seekable format: for every frame its compressed size,
decompressed size and the low 32 bits of the XXH64 of its content. A reader decompresses only frames that it needs.

Files are written by Spark's own committer, so a task that is run again leaves one file, on any file system Spark
reaches: a file is one value of the text writer, whose line separator is the last four bytes that every such file has.

Defined cases: a null text is empty and gives only the end id; documents of one id come in the order of a hash of their
texts, the same in every run; a null id comes first; an empty table gives no documents. Columns that are not named are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHES, lean, materialize, new_path, ship
from .hashing import span_hashes

#: What a worker keeps: parts (about 36 bytes each), the latest of them, and pieces.
PARTS, LATEST, PIECES = 1_000_000, 50_000, 100_000
JOINED_WORDS, RUN_CHARS, FRAME_BYTES, SHARD_TEXT_BYTES = 500, 3 << 19, 1 << 20, 32 << 20
NULL_ID = -(1 << 63)

# Magic numbers of the public zstd seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
TAIL = struct.pack("<I", SEEKABLE)

_encoders: dict[str, Encoder] = {}
CACHES.append(_encoders)


class Encoder:
    """``encode`` gives each text's ids as little-endian 32-bit words.

    A byte-level BPE codes each piece that its splitter makes on its own, so pieces are encoded once and kept. Texts are
    first cut at spaces, which never joins or parts pieces except in runs of white space; a part that is new is split by
    the tokenizer's own pattern, and only pieces that are new go to the tokenizer. Texts with runs of white space where
    a cut could matter, and all texts of tokenizers of other kinds, are encoded whole. Strings of special tokens inside
    a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spec.get("normalizer")
        self.by_piece = bool(plain and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding"))
        self.known: _Known = _Known()
        self.pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """In runs of about ``RUN_CHARS`` characters, so that few pieces are held at a time."""
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= RUN_CHARS or i == len(texts) - 1:
                yield from self._run(texts[start : i + 1])
                start, size = i + 1, 0

    def _run(self, texts: list[str]) -> list[bytes]:
        cut = [i for i, text in enumerate(texts) if _cuttable(text)] if self.by_piece else []
        rest = sorted(set(range(len(texts))).difference(cut))
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        if not cut:
            return out
        split = [texts[i].partition(" ") for i in cut]
        heads = self.whole([head for head, _, _ in split])
        # all other parts of the run at once; a text without a space has none
        tails = [tail.encode() for _, space, tail in split if space]
        data = np.frombuffer(b" ".join(tails), np.uint8)
        at = np.flatnonzero(data == 32)
        first, last = np.concatenate([[0], at + 1]), np.concatenate([at, [len(data)]])
        spans, marks = span_hashes(data, first, last)
        hashes, where, which = np.unique(spans, return_index=True, return_inverse=True)
        if (marks[where][which] != marks).any():  # different parts of one hash
            return self.whole(texts)
        known = self.known
        new = known.missing(hashes, marks[where])
        raw = data.tobytes()
        texts_of_new = [raw[a:b].decode() for a, b in zip(first[where[new]].tolist(), last[where[new]].tolist(), strict=True)]
        known.add(hashes[new], marks[where[new]], self._parts(texts_of_new))
        flat, begin, sizes = known.codes(hashes)
        each = sizes[which]
        upto = np.cumsum(each)
        ids = flat[np.repeat(begin[which] - (upto - each), each) + np.arange(upto[-1])].tobytes()
        ends = iter(upto[np.cumsum([t.count(b" ") + 1 for t in tails]) - 1].tolist() if tails else [])
        done = 0
        for i, head, (_, space, _) in zip(cut, heads, split, strict=True):
            if space:
                end = next(ends)
                out[i] = head + ids[4 * done : 4 * end]
                done = end
            else:
                out[i] = head
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Codes of distinct parts, each with the space before it."""
        pieces = self.pieces
        if len(pieces) > PIECES:
            pieces.clear()
        split = list(map(_split_part, parts))
        wanted = {p for x in split for p in x}.difference(pieces)
        words = [p for p in wanted if p[0] == " " and p[1:].isalpha()]
        others = list(wanted.difference(words))
        pieces.update(zip(words, self._words(words), strict=True))
        pieces.update(zip(others, self.whole(others), strict=True))
        get = pieces.__getitem__
        return [b"".join(map(get, x)) if len(x) > 1 else get(x[0]) for x in split]

    def _words(self, words: list[str]) -> list[bytes]:
        """Codes of words with a space before each, many to a text: every id that starts with a space starts a word."""
        out: list[bytes] = []
        texts = ["".join(words[i : i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        for k, code in enumerate(self.whole(texts)):
            ids = np.frombuffer(code, "<u4")
            start = np.flatnonzero(self.spaced[ids]) * 4
            group = words[k * JOINED_WORDS : (k + 1) * JOINED_WORDS]
            if len(start) == len(group):
                out += [code[a:b] for a, b in zip(start.tolist(), [*start[1:].tolist(), len(code)], strict=True)]
            else:
                out += self.whole(group)
        return out


def _split_part(part: str) -> list[str]:
    """Pieces of a part with the space before it; words with and without a mark at their end the short way."""
    if part.isalpha():
        return [" " + part]
    if part[:-1].isalpha() and part[-1] in ".,;:!?":
        return [" " + part[:-1], part[-1]]
    return _PIECE.findall(" " + part)


class _Parts:
    """Codes of parts by hash and mark, in flat arrays in the order of hashes."""

    def __init__(self, hashes: np.ndarray, marks: np.ndarray, sizes: np.ndarray, ids: np.ndarray, begin: np.ndarray | None = None):
        self.hashes, self.marks, self.sizes, self.ids = hashes, marks, sizes.astype(np.int32), ids
        self.begin = (np.cumsum(sizes) - sizes if begin is None else begin).astype(np.int32)

    @classmethod
    def none(cls) -> _Parts:
        zero = np.zeros(0, np.uint64)
        return cls(zero, zero, np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is."""
        if not len(self):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return at, self.hashes[at] == hashes

    def joined(self, other: _Parts) -> _Parts:
        order = np.argsort(hashes := np.concatenate([self.hashes, other.hashes]), kind="stable")
        both = lambda a, b: np.concatenate([a, b])[order]
        begin = both(self.begin, other.begin + len(self.ids))
        return _Parts(hashes[order], both(self.marks, other.marks), both(self.sizes, other.sizes), np.concatenate([self.ids, other.ids]), begin)


class _Known:
    """What an encoder keeps of the parts that it has seen: many in one table, the latest in a small one, so that what is new
    is not sorted in among all others each time. Emptied when it holds too many."""

    def __init__(self):
        self.tables = [_Parts.none(), _Parts.none()]
        self.looked_up: tuple = (None, None)

    def missing(self, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Places of those of the sorted hashes that are not there; all of them if one is there for another part."""
        if sum(map(len, self.tables)) > PARTS:
            self.__init__()
        there = np.zeros(len(hashes), bool)
        for table in self.tables:
            at, hit = table.find(hashes)
            if table is self.tables[0]:
                self.looked_up = (table, (at, hit))
            if (table.marks[at[hit]] != marks[hit]).any():
                self.__init__()
                return np.arange(len(hashes))
            there |= hit
        return np.flatnonzero(~there)

    def add(self, hashes: np.ndarray, marks: np.ndarray, codes: list[bytes]) -> None:
        sizes = np.array([len(c) // 4 for c in codes], dtype=np.int64)
        many, few = self.tables
        few = few.joined(_Parts(hashes, marks, sizes, np.frombuffer(b"".join(codes), "<u4")))
        if len(few) > max(LATEST, len(many) // 4):
            many, few = many.joined(few), _Parts.none()
        self.tables = [many, few]

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids, begin, sizes``: where the codes of the hashes last asked for, all there by now, stand in the ids."""
        many, few = self.tables
        at, hit = self.looked_up[1] if self.looked_up[0] is many else many.find(hashes)
        other, _ = few.find(hashes)
        begin, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begin[hit], sizes[hit] = many.begin[at[hit]], many.sizes[at[hit]]
        # the ids of the small table stand after those that are taken from the large one
        taken = np.repeat(begin[hit] - (np.cumsum(sizes[hit]) - sizes[hit]), sizes[hit]) + np.arange(sizes[hit].sum())
        begin[hit] = np.cumsum(sizes[hit]) - sizes[hit]
        begin[~hit], sizes[~hit] = few.begin[other[~hit]] + len(taken), few.sizes[other[~hit]]
        return np.concatenate([many.ids[taken], few.ids]), begin, sizes


_PAIRS = ("  ", "\n ", "\t ", "\r ", "\v ", "\f ", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u202f", "\u205f", "\u3000")


def _cuttable(text: str) -> bool:
    """Whether cutting at spaces is safe: quick where no space follows white space, else by pattern."""
    if not any(x in text for x in _PAIRS) and (text.isascii() or not _WIDE.search(text)):
        return True
    return not _JOINED.search(text)


#: White space of the general punctuation block.
_WIDE = re.compile("[\u2000-\u200a\u2028\u2029]")

#: A space between two other white space characters, or between one and the end: there the splitter may join spaces.
_JOINED = re.compile(r"\s (?:\s|\Z)|[\x1c-\x1f\x85]")

# Fixed value: the splitting pattern of byte-level tokenizers.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that few texts are held as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Packer:
    """Builds one token file. Ids are compressed as soon as they fill a frame, so it holds one frame of ids, and of all other
    documents only compressed frames and 32 bytes each."""

    def __init__(self, end_id: int, width: int):
        """``width``: bytes per id, 2 or 4."""
        self.width, self.end = width, np.array([end_id], dtype="<u4").tobytes()
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.index, self.buffer, self.held, self.size = array("q"), [], 0, 0

    def _flush(self) -> None:
        raw = np.frombuffer(b"".join(self.buffer), "<u4").astype(f"<u{self.width}").tobytes()
        self.frames.append(self.packer.compress(raw))
        self.table.append((len(self.frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.buffer, self.held = [], 0

    def add(self, doc: int, ids: bytes) -> None:
        """A document's 32-bit tokens; documents come in order."""
        size = len(ids) // 4 + 1
        if self.held and (self.held + size) * self.width > FRAME_BYTES:
            self._flush()
        self.index.extend((doc, len(self.frames), self.held, size))
        self.buffer += (ids, self.end)
        self.held += size
        self.size += size * self.width

    def finish(self) -> bytes:
        if self.buffer:
            self._flush()
        entries = np.frombuffer(self.index, "<i8").reshape(-1, 4)
        body = struct.pack("<II", self.width, len(entries)) + zstandard.ZstdCompressor(level=3).compress(entries.T.tobytes())
        self.frames.append(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.table.append((len(self.frames[-1]), 0, 0))
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IB", len(self.table), 0x80) + TAIL
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE_SEEK, len(seek)), seek])


def pack_shard(documents: Iterator[tuple[int, bytes]], end_id: int, width: int) -> bytes:
    """One token file of ids and their 32-bit tokens, in order."""
    packer = Packer(end_id, width)
    for doc, ids in documents:
        packer.add(doc, ids)
    return packer.finish()


class TokenFile:
    """Random access to one token file held as bytes or any buffer that can be sliced."""

    def __init__(self, data):
        self.data = data
        size = len(data)
        n, flags, magic = struct.unpack("<IBI", data[size - 9 : size])
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        self.table = np.frombuffer(data[size - 9 - 12 * n : size - 9], "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = data[int(self.starts[n - 1]) : int(self.starts[n])]
        self.width, count = struct.unpack("<II", index[8:16])
        #: Per document: id, frame, place in the frame, number of ids.
        self.documents = np.frombuffer(zstandard.ZstdDecompressor().decompress(index[16:]), "<i8").reshape(4, count).T

    def frame(self, k: int) -> np.ndarray:
        """The ids of one frame; a wrong checksum is an error."""
        raw = zstandard.ZstdDecompressor().decompress(self.data[int(self.starts[k]) : int(self.starts[k + 1])], max_output_size=int(self.table[k, 1]))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def read(self, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Documents in file order, or only those of the wanted ids; no other frames are decompressed."""
        last, ids = -1, None
        for doc, k, at, size in self.documents.tolist():
            if wanted is None or doc in wanted:
                if k != last:
                    last, ids = k, self.frame(k)
                yield doc, ids[at : at + size]


def _pack(tokenizer: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        packer = Packer(end_id, width)

        def shard() -> pa.RecordBatch:
            value = memoryview(packer.finish())
            return pa.RecordBatch.from_arrays([pa.array([value[: -len(TAIL)]], pa.binary())], ["value"])

        for batch in _slices(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(_texts(batch)), strict=True):
                packer.add(doc, ids)
                if packer.size >= shard_bytes:
                    yield shard()
                    packer = Packer(end_id, width)
        if packer.size:
            yield shard()

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc: str = "doc_id", text: str = "text", shard_text_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Encode every document, append ``end_id``, and write token files under ``path`` in ascending order of ids.

    Ranges are cut by id and, inside one id, by a hash of the text, so one id of very many rows is dealt over tasks. A
    task whose range is larger than expected writes several files of at most ``shard_text_bytes`` of ids and one document.
    """
    ship(documents.sparkSession)
    docs = documents.select(F.coalesce(F.col(doc).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    keyed = docs.withColumn("mark", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(max(1, -(-total // shard_text_bytes)), "doc_id", "mark").sortWithinPartitions("doc_id", "mark").drop("mark")
    packed = ordered.mapInArrow(lean(_pack(tokenizer, end_id, shard_text_bytes), tokenizer), "value binary")
    values = packed.select(F.col("value").cast("string"))
    values.write.option("encoding", "ISO-8859-1").option("lineSep", TAIL.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


#: Spark names a file by its task, in five digits or more, and counts the files of one task.
_PART = re.compile(r"part-(\d+)-[^/]*?-c(\d+)[^/]*$")


def shard_of(path: str) -> tuple[int, int]:
    """(task, file of the task) of a token file: their order is that of the ids inside."""
    found = _PART.search(path)
    if not found:
        raise ValueError(f"not a token file: {path}")
    return int(found[1]), int(found[2])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            task, part = shard_of(path)
            file = TokenFile(memoryview(content.as_buffer()))
            sizes = file.documents[:, 3]
            crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in file.read()]
            ids = file.documents[:, 0]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task)), pa.array(np.full(n, part)), pa.array(ids, mask=ids == NULL_ID), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes.copy()), pa.array(crc, pa.int64())],
                ["task", "part", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    each = materialize(files.mapInArrow(lean(_digest), "task long, part long, doc_id long, inside long, n_tokens long, ids_crc32 long"), "token-digest")
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = each.groupBy("task", "part").agg(F.sum("n_tokens").alias("n"))
    bases = materialize(sizes.select("task", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-bases")
    return each.join(bases, ["task", "part"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(documents: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(documents, path, tokenizer, end_id)
    return read_digest(spark, path)


def _lengths(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in _slices(batches):
            sizes = [len(x) // 4 for x in encoder.encode(_texts(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["length"])

    return run


def length_histogram(documents: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Exact ``length, n_docs``: how many documents encode to that many tokens."""
    ship(documents.sparkSession)
    lengths = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(_lengths(tokenizer), tokenizer), "length long")
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L of the histogram, taken as a context limit: documents and tokens in all, documents longer than
    L, tokens that stay when every document is cut at L, tokens lost, and the share of documents of at most L tokens.

    The histogram has one row per distinct length, whatever the number of documents, so one window over it is small.
    """
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    size = F.col("length") * F.col("n_docs")
    docs_over = F.coalesce(F.sum("n_docs").over(longer), F.lit(0))
    tokens_over = F.coalesce(F.sum(size).over(longer), F.lit(0))
    out = histogram.select(
        "length", "n_docs", size.alias("tokens"), docs_over.alias("docs_longer"), tokens_over.alias("tokens_longer"),
        F.sum("n_docs").over(whole).alias("total_docs"), F.sum(size).over(whole).alias("total_tokens"),
    )
    lost = F.col("tokens_longer") - F.col("docs_longer") * F.col("length")
    return out.select(
        "length", "n_docs", "tokens", "docs_longer", "total_docs", "total_tokens",
        (F.col("total_tokens") - lost).alias("truncated_tokens"), lost.alias("tokens_lost"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("share_within"),
    )


def total_at(counts: DataFrame, limit: int) -> DataFrame:
    """Totals for any context limit from :func:`suffix_sums`: the row of the largest length of at most ``limit`` answers,
    as no document ends between the two; a limit under the smallest length cuts every document."""
    within = F.col("length") <= limit
    docs_over = F.sum(F.when(~within, F.col("n_docs")).otherwise(0))
    kept = F.sum(F.when(within, F.col("tokens")).otherwise(0)) + docs_over * limit
    return counts.agg(F.lit(limit).cast("long").alias("context"), docs_over.alias("docs_longer"), kept.alias("truncated_tokens"))


def quantile(counts: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents does not exceed."""
    return counts.where(F.col("share_within") >= q).agg(F.min("length").alias("length"))
