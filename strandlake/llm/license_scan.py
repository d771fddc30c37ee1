"""Fuzzy search for short license notices: exact seeds find candidates, bounded-error patterns verify them.

Texts become words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, with one space between. A notice of L
characters may have ``min(MOST_EDITS, L // LETTERS_PER_EDIT)`` edits (characters that are inserted, deleted or changed). It
is split into one piece more than it may have edits, so an occurrence holds at least one piece unchanged: all pieces of all
notices, and the exact base phrases, are looked for in one pass of an Aho-Corasick automaton. Each piece that is found
gives a window in which the ``regex`` library looks for the notice, between whole words, with that many errors, and reports
the best span. No occurrence is missed, and only windows around seeds are ever matched with errors.

Defined cases: null and empty texts have no words and no matches; repeated rows and ids get a row each; of matches of one
label that overlap, the one of the smallest share of edits stays, then the first; all columns of the documents are kept,
whatever their names. One text is searched by one task, in time that grows with its length and its number of seeds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, position, ship
from .decontaminate import words

MOST_EDITS, LETTERS_PER_EDIT = 4, 12

# The base phrases, which are looked for exactly, with their labels.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

#: Notices that are looked for with errors; short ones have none.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "apache license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("boost", "boost software license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "creative commons attribution"),
    ("cc-by", "this work is licensed under cc by 4 0"),
    ("cc0", "cc0 1 0 universal"),
    ("cc0", "creative commons zero"),
    ("epl", "eclipse public license"),
    ("gpl", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "mit licence"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
)

MATCH = "label string, base boolean, first_word long, n_words long, edits int, score double"
_FIELDS = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])


def edits_of(notice: str) -> int:
    """How many edits a notice may have."""
    return min(MOST_EDITS, len(notice) // LETTERS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """``(offset, piece)``: one piece more than the notice may have edits, nearly of one length."""
    n = edits_of(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds base phrases and notices in texts."""

    def __init__(self, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]):
        self.base, self.notices = base, notices
        wanted: dict[str, list[tuple[int, int]]] = {}
        for i, (_, phrase) in enumerate(base):
            wanted.setdefault(f" {phrase} ", []).append((-1, i))
        for i, (_, notice) in enumerate(notices):
            for offset, piece in pieces(notice):
                wanted.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for seed, found in wanted.items():
            self.seeds.add_word(seed, (len(seed), found))
        if wanted:
            self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?b) (?:{regex.escape(notice, literal_spaces=True)}){{e<={edits_of(notice)}}} ") for _, notice in notices]

    def find(self, text: str) -> tuple[int, list[tuple]]:
        """Number of words, and matches ``(label, base, first word, number of words, edits, score)`` by place."""
        found = words(text.encode())
        line = f" {b' '.join(found).decode()} "
        if not found or not len(self.seeds):
            return len(found), []
        exact, windows = [], set()
        for last, (size, of) in self.seeds.iter(line):
            start = last + 1 - size
            for notice, x in of:
                if notice < 0:
                    exact.append((start, x))
                else:
                    windows.add((start - x, notice))
        spans = {(p, p + len(self.base[x][1]) + 2, self.base[x][0], True, 0, 1.0) for p, x in exact}
        spans.update(self._verified(line, windows))
        return len(found), list(_placed(line, sorted(spans)))

    def _verified(self, line: str, windows: set[tuple[int, int]]) -> Iterator[tuple]:
        """Spans of notices, with the space at either side; ``windows``: where a notice would start, and which."""
        spans: dict[tuple[int, int, str], float] = {}
        for at, n in sorted(windows):
            label, notice = self.notices[n]
            k = edits_of(notice)
            begin = max(0, at - k - 1)
            hit = self.patterns[n].search(line[begin : at + len(notice) + k + 1])
            if hit:
                key = (begin + hit.start(), begin + hit.end(), label)
                edits = sum(hit.fuzzy_counts)
                spans[key] = min(spans.get(key, (9.0, 0)), (edits / len(notice), edits))
        ends: dict[str, list[tuple[int, int]]] = {}
        for (start, end, label), (share, edits) in sorted(spans.items(), key=lambda x: (x[1], x[0])):
            taken = ends.setdefault(label, [])
            if not _overlaps(taken, start, end - 1):  # two notices may share the space between them
                yield start, end, label, False, edits, 1.0 - share


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span meets one of the sorted disjoint spans; it is added if not."""
    at = bisect_left(taken, (start, end))
    if (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > start):
        return True
    taken.insert(at, (start, end))
    return False


def _placed(line: str, spans: list[tuple]) -> Iterator[tuple]:
    """Spans by words instead of characters; they come by place, so the line is counted once."""
    upto = n = 0
    for start, end, label, base, edits, score in spans:
        n += line.count(" ", upto, start)
        upto = start
        yield label, base, n, line.count(" ", start, end) - 1, edits, score


@cache
def scanner(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(base, notices)


def _scan(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(base, notices).find
        for batch in batches:
            sizes, lists = [], []
            for text in batch.column("text"):
                n, found = find(text.as_py() or "")
                sizes.append(n)
                lists.append([dict(zip(_FIELDS.names, x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(_FIELDS))], ["row", "n_words", "matches"])

    return run


def scan(documents: DataFrame, text: str = "text", base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """All columns of ``documents``, then ``license_words``, the number of words, and ``license_matches``: per match its
    label, whether it is a base phrase, its first word (from 0) and number of words, its edits, and the share of its
    letters that are not edited as score."""
    ship(documents.sparkSession)
    rows = packed(documents, text=text).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_scan(base, notices), f"row {kind}, n_words long, matches array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>")
    own = [F.col(f"row.c{i}") for i in range(len(documents.columns))]
    return found.select(*own, "n_words", "matches").toDF(*documents.columns, "license_words", "license_matches")


def _labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def digest(scanned: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document of :func:`scan`: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    at = position(scanned.columns[:-2], doc)
    plain = scanned.toDF(*[f"c{i}" for i in range(len(scanned.columns) - 2)], "n_words", "matches")
    every = F.col("matches")
    base = F.filter(every, lambda m: m["base"])
    first = F.transform(base, lambda m: m["first_word"])
    return plain.select(
        F.col(f"c{at}").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), _labels(base).alias("base_labels"), _labels(every).alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
