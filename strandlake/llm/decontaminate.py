"""Benchmark decontamination by a prefix-filtered set join.

Every item gives windows of ``window`` consecutive words (an item of fewer words is one window). A window is a set of
shingles of ``shingle`` words. For exact containment a document must hold all of a window's shingles, so its rarest
shingle alone is the necessary prefix: shingles are ordered by the number of documents that hold them, counted over all
documents, and only prefix shingles are looked up. The place of the shingle in the window then gives a candidate span;
spans that start before the text or end after it fall to the positional and length bounds, and the rest are verified
word by word.

The items are read in blocks of at most ``block_words`` words. A block is a set of flat arrays of about 60 bytes a word,
sent to all tasks: 60 MB at most by default, whatever the size of the benchmark or of one item. Further blocks are
further passes over the documents. All words, shingles and candidates of a run of documents are handled as arrays.

Defined cases: null and empty texts have no words and are never hit; items without words match nothing; repeated items
and items of one id count once; a null item id is written as an empty string; of equally rare shingles of a window the
one of the smallest code is looked up; documents are matched row by row, so repeated rows and ids get a row each; all
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, lean, packed, ship, unpacked
from .hashing import mix64, span_hashes

#: A-Z become a-z; every other ASCII byte that is no digit or letter becomes a space; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
#: Words of a block of items: its arrays take about 60 bytes a word. Bytes of texts that are looked at together.
BLOCK_WORDS, RUN_BYTES = 1_000_000, 1 << 22


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z."""
    return text.translate(FOLD).split()


def _word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of folded texts, and where each word begins and ends; white space is at the end of every text."""
    array = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[array], prepend=True))
    return array, edge[::2], edge[1::2]


def _codes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code for every k words in a row, from their hashes."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += mix64(hashes[j : j + n], 40 + j)
    return mix64(out, 60 + k)


class Words:
    """Words of several texts, by hash and mark, with the place of every text's first word and the end of its last."""

    def __init__(self, texts: list[bytes]):
        folded = [t.translate(FOLD) for t in texts]
        data, first, last = _word_spans(b" ".join(folded) + b" ")
        self.hashes, self.marks = span_hashes(data, first, last)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(first, np.concatenate([[0], ends]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))


class Windows:
    """Distinct windows of a block of items, their shingles, and which items have them; flat arrays throughout.

    Of a word this holds its hash and mark (see :func:`span_hashes`), of a window its place, length and items, and of a
    shingle its code: about 60 bytes for each word of the items.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        words_, self.shingle = Words([t for _, t in items]), shingle
        self.hashes, self.marks = words_.hashes, words_.marks
        names = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(names)}
        self.names = names
        size = np.diff(words_.bounds)
        count = np.where(size >= window, size - window + 1, np.minimum(size, 1))
        of = np.repeat(np.arange(len(items)), count)
        start = words_.bounds[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size[of], window)
        item = np.array([number[i] for i, _ in items], dtype=np.int64)[of] if len(items) else of
        # equal windows are one: by length and the codes of all their words, made from hashes and from marks
        code = np.zeros((len(of), 2), dtype=np.uint64)
        for n in np.unique(length).tolist():
            at = length == n
            code[at, 0], code[at, 1] = _codes(self.hashes, n)[start[at]], _codes(self.marks, n)[start[at]]
        _, first, same = np.unique(code, axis=0, return_index=True, return_inverse=True)
        self.start, self.length = start[first], length[first]
        pairs = np.unique(same.ravel() * np.int64(max(1, len(names))) + item)
        self.item = pairs % max(1, len(names))
        self.item_at = np.searchsorted(pairs // max(1, len(names)), np.arange(len(first) + 1))
        #: By shingle length: the sorted codes, and once ordered the windows to look up at each.
        self.codes = {k: np.unique(self._of_windows(k)) for k in np.unique(np.minimum(self.length, shingle)).tolist()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _members(self, k: int) -> np.ndarray:
        return np.flatnonzero(np.minimum(self.length, self.shingle) == k)

    def _of_windows(self, k: int) -> np.ndarray:
        codes = _codes(self.hashes, k)
        mine = self._members(k)
        return np.concatenate([np.zeros(0, np.uint64), *[codes[self.start[at][:, None] + np.arange(n - k + 1)].ravel() for n, at in self._by_length(mine)]])

    def _by_length(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for n in np.unique(self.length[which]).tolist():
            yield n, which[self.length[which] == n]

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle (of equally rare ones that of the smallest code, then the first).
        ``counts``: by shingle length, how many documents have each code."""
        for k, codes in self.codes.items():
            every, windows, places, offsets = _codes(self.hashes, k), [], [], []
            for n, at in self._by_length(self._members(k)):
                place = np.searchsorted(codes, every[self.start[at][:, None] + np.arange(n - k + 1)])
                rare = counts[k][place]
                best = np.where(rare == rare.min(axis=1, keepdims=True), place, len(codes)).argmin(axis=1)
                windows.append(at)
                places.append(place[np.arange(len(at)), best])
                offsets.append(best)
            window, place, offset = (np.concatenate(x) for x in (windows, places, offsets))
            sort = np.argsort(place, kind="stable")
            used, begin = np.unique(place[sort], return_index=True)
            self.prefix[k] = codes[used], np.append(begin, len(sort)), window[sort], offset[sort]

    def match(self, given: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are inside an occurrence of a window; and (text, item) pairs of items whose windows occur."""
        edges = np.zeros(len(given.hashes) + 1, dtype=np.int64)
        found = []
        for k, (codes, begin, window, offset) in self.prefix.items():
            position, place = looked_up(_codes(given.hashes, k), codes)
            several = begin[place + 1] - begin[place]
            upto = np.cumsum(several)
            entry = np.repeat(begin[place] - (upto - several), several) + np.arange(upto[-1] if len(upto) else 0)
            position, w = np.repeat(position, several), window[entry]
            # positional and length bounds: the window lies inside the text of its shingle
            start, text = position - offset[entry], given.text[position]
            inside = (start >= given.bounds[text]) & (start + self.length[w] <= given.bounds[text + 1])
            start, w, text = start[inside], w[inside], text[inside]
            for j in range(int(self.length[w].max()) if len(w) else 0):
                # word by word, over the windows that have one more
                more = np.flatnonzero(self.length[w] > j)
                a, b = start[more] + j, self.start[w[more]] + j
                wrong = more[(given.hashes[a] != self.hashes[b]) | (given.marks[a] != self.marks[b])]
                if len(wrong):
                    start, w, text = np.delete(start, wrong), np.delete(w, wrong), np.delete(text, wrong)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + self.length[w], -1)
            pair = np.unique(text * np.int64(len(self.start)) + w)
            text, w = pair // len(self.start), pair % len(self.start)
            several = self.item_at[w + 1] - self.item_at[w]
            upto = np.cumsum(several)
            at = np.repeat(self.item_at[w] - (upto - several), several) + np.arange(upto[-1] if len(upto) else 0)
            found.append(np.repeat(text, several) * np.int64(len(self.names)) + self.item[at])
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return np.cumsum(edges)[:-1] > 0, pairs // max(1, len(self.names)), pairs % max(1, len(self.names))


def looked_up(given: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of those of ``given`` that are among the sorted ``codes``, and their places there."""
    none = np.zeros(0, dtype=np.int64)
    if not len(codes) or not len(given):
        return none, none
    # most are not there, which their leading bits show
    bits = max(8, min(22, len(codes).bit_length() + 4))
    there = np.zeros(1 << bits, dtype=bool)
    there[codes >> np.uint64(64 - bits)] = True
    position = np.flatnonzero(there[given >> np.uint64(64 - bits)])
    place = np.minimum(np.searchsorted(codes, given[position]), len(codes) - 1)
    hit = codes[place] == given[position]
    return position[hit], place[hit]


def _runs(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in runs of about four megabytes, each with the row of its first."""
    held, size, at = [], 0, 0
    for i, text in enumerate(batch.column(name).cast(pa.large_binary())):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= RUN_BYTES:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def _count(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = sent.value
        totals = {k: np.zeros(len(c), dtype=np.int64) for k, c in block.codes.items()}
        for batch in batches:
            for _, texts in _runs(batch):
                given = Words(texts)
                for k, codes in block.codes.items():
                    position, place = looked_up(_codes(given.hashes, k), codes)
                    inside = position + k <= given.bounds[given.text[position] + 1]
                    once = np.unique(given.text[position[inside]] * np.int64(len(codes)) + place[inside])
                    totals[k] += np.bincount(once % len(codes), minlength=len(codes))
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["k", "place", "n"])

    return run


def _match(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = sent.value
        for batch in batches:
            for at, texts in _runs(batch):
                rows = batch.slice(at, len(texts))
                given = Words(texts)
                hit, text, item = block.match(given)
                cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
                hits, found = [], []
                for i, (before, items) in enumerate(zip(rows.column("hits").to_pylist(), rows.column("items").to_pylist(), strict=True)):
                    mine = hit[given.bounds[i] : given.bounds[i + 1]]
                    if before:
                        mine[np.array(before)] = True
                    hits.append(np.flatnonzero(mine))
                    more = [block.names[x] for x in item[cut[i] : cut[i + 1]].tolist()]
                    found.append(sorted(set(more).union(items)) if items else more)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text"), pa.array(np.diff(given.bounds), pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                    ["doc_id", "text", "n_words", "hits", "items"],
                )

    return run


def _blocks(benchmark: DataFrame, block_words: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items of at most ``block_words`` words together; one of more words is cut into pieces that share their windows."""
    block, size = [], 0
    for item, text in benchmark.toLocalIterator():
        name, given = "" if item is None else item, words((text or "").encode())
        step = max(1, block_words - window + 1)
        cuts = [0] if len(given) <= block_words else range(0, len(given) - window + 1, step)
        for at in cuts:
            part = given[at : at + max(block_words, window)]
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            block.append((name, b" ".join(part)))
            size += len(part)
    if block:
        yield block


def _by_code(windows: Windows, counted: DataFrame) -> dict[int, np.ndarray]:
    """Document frequencies of the codes of a block; at most as many rows come as it has codes."""
    out = {k: np.zeros(len(c), dtype=np.int64) for k, c in windows.codes.items()}
    rows = counted.toPandas()
    for k, part in rows.groupby("k"):
        out[k][part["place"].to_numpy()] = part["n"].to_numpy()
    return out


def match_items(
    documents: DataFrame,
    benchmark: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, hits`` (positions of hit words), ``items`` (sorted as strings)."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<long>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    schema = out.schema
    wanted = benchmark.select(F.col(item).cast("string"), F.col(item_text).cast("string"))
    blocks = 0
    for block in _blocks(wanted, block_words, window):
        blocks += 1
        windows = Windows(block, window, shingle)
        sent = spark.sparkContext.broadcast(windows)
        counted = docs.select("text").mapInArrow(lean(_count(sent)), "k long, place long, n long").groupBy("k", "place").agg(F.sum("n").alias("n"))
        windows.order(_by_code(windows, counted))
        out = out.mapInArrow(lean(_match(spark.sparkContext.broadcast(windows))), schema)
    if not blocks:  # the words still have to be counted
        out = out.mapInArrow(lean(_match(spark.sparkContext.broadcast(Windows([], window, shingle)))), schema)
    return out.select("doc_id", "n_words", "hits", "items", "text")


def digest(matched: DataFrame) -> DataFrame:
    n_hit = F.size("hits").cast("long")
    return matched.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def reference_digest(documents: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = 10) -> dict[int, tuple]:
    """The same result by comparing every window with every place; for tests."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, text in documents:
        w = split(text)
        hit, found = set(), set()
        for i, t in items:
            v = split(t)
            for a in range(max(1, len(v) - window + 1) if v else 0):
                part = v[a : a + window]
                for b in range(len(w) - len(part) + 1):
                    if w[b : b + len(part)] == part:
                        hit.update(range(b, b + len(part)))
                        found.add("" if i is None else str(i))
        joined = ",".join(sorted(found))
        out[d] = len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, all columns, in which no window of any item occurs. Nothing is joined: rows pass in one struct."""
    matched = match_items(packed(documents, body=text), benchmark, doc="row", text="body", **options)
    return unpacked(matched.where(F.size("hits") == 0).select(F.col("doc_id").alias("row")), documents)
