"""Coding of a sequence against a reference, as text tokens, in Arrow batches.

A token is a letter (``A`` plus the symbol's number, or ``!`` where it equals the reference on the way to a match at the
predicted place), a run of four letters N or more (character 30, its length less 4, character 4), or a match (``D,L.``: D
places after the predicted one, L letters more than the least match; ``D.`` where it runs to both ends). The predicted
place is where the last match ended, moved on by every letter but not by runs. An empty code is the reference itself.

A reference is indexed at every fourth place by keys of ``min_match - 3`` letters, in a table that is at most 0.7 full
and where a key is put, and looked for, in 64 slots at most; so of a key that is very frequent only the first places are
known. Here the same places are kept, without a table unless 64 neighbouring slots would be full. A match is the longest
candidate of more than ``min_match`` letters, with the letters before it that are still pending.

All places of a text that may begin a match are found first; only those are visited one by one. References of at most
``INDEXED`` letters are indexed by the letters of their keys, in a dictionary, as numpy's calls cost more than such texts do;
longer ones, and what is looked up in them, go through numpy. Rows that share a reference should be neighbours.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packing import pack_array, unpack_array
from ..functions.sequences import FMIX1, FMIX2, SYMBOLS

# Fixed values of the format.
MIN_RUN, STEP, SLOTS, FULL = 4, 4, 64, 0.7
RUN_START, RUN_END, BLANK = "\x1e", "\x04", "_"
_TOKEN = re.compile(r"([A-P_!]+)|(-?\d+)(?:,(\d+))?\.|\x1e(-?\d+)\x04")
_CODED = "".join(chr(65 + i) for i in range(len(SYMBOLS))) + BLANK
_TO_CODE, _TO_LETTER = str.maketrans(SYMBOLS + " ", _CODED), str.maketrans(_CODED, SYMBOLS + " ")
_BASE = np.full(256, 4, dtype=np.uint8)
_BASE[[ord(x) for x in "ACGT"]] = range(4)
_RUN = re.compile("N{%d,}" % MIN_RUN)
#: Letters of a reference that is indexed by letters: about 50 bytes of index each.
INDEXED = 1 << 12
#: Letters of a text in which each key of an index is sought; of a longer one, each window is looked up.
SHORT = 1 << 9


def letters_of(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("latin-1", "replace"), np.uint8)


def window_codes(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits a letter of every window of ``k`` letters, and whether it has only A, C, G and T."""
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    base = _BASE[letters]
    # windows of 1, 2, 4, ... letters; those of k are put together from the sizes that add up to k
    power, size, out, done = (base & 3).astype(np.uint64), 1, None, 0
    while True:
        if k & size:
            m = len(letters) - done - size + 1
            out = power[:m] if out is None else (out[:m] << np.uint64(2 * size)) | power[done : done + m]
            done += size
        if done == k:
            break
        power = (power[:-size] << np.uint64(2 * size)) | power[size:]
        size *= 2
    bad = np.flatnonzero(base > 3)
    if not len(bad):
        return out, np.ones(n, dtype=bool)
    upto = np.zeros(len(letters) + 1, dtype=np.int64)
    np.cumsum(base > 3, out=upto[1:])
    return out, upto[k:] == upto[:n]


def finalised(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for factor in (FMIX1, FMIX2):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))


def _put(slots: np.ndarray, size: int) -> np.ndarray:
    """Which of the entries find a free slot, of ``SLOTS`` tried, when put into a table one after another: all of fewer than
    ``SLOTS``, as a table is never full."""
    n = len(slots)
    if n >= SLOTS:
        # where the slots end up without a limit: the filled ones do not depend on the order of entries
        filled = np.maximum.accumulate(np.sort(slots) - np.arange(n)) + np.arange(n)
        begin = np.flatnonzero(np.diff(filled, prepend=filled[0] - 2) != 1)
        if filled[-1] >= size or np.diff(np.append(begin, n)).max() >= SLOTS:
            taken, kept = bytearray(size), np.zeros(n, dtype=bool)
            for i, slot in enumerate(slots.tolist()):
                at = next((x for j in range(SLOTS) if not taken[x := (slot + j) & (size - 1)]), None)
                if at is not None:
                    taken[at] = kept[i] = 1
            return kept
    return np.ones(n, dtype=bool)


@dataclass
class Match:
    """Letters ``at`` to ``at + size`` of a text are those of the reference from ``place`` on; ``back`` of them were
    pending, and ``predicted`` is the place where the first was expected."""

    at: int
    place: int
    size: int
    predicted: int
    back: int


#: Codes of a text's windows, the places of the valid ones, and its runs of N.
Windows = tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]


def windows_and_runs(text: str, key: int) -> Windows:
    codes, valid = window_codes(letters_of(text), key)
    return codes, np.flatnonzero(valid), [m.span() for m in _RUN.finditer(text)]


class Coder:
    """Codes texts against one reference."""

    def __init__(self, reference: str, min_match: int = 20):
        self.reference, self.min_match = reference, min_match
        self.key = key = max(1, min_match - STEP + 1)
        self.index: dict[str, list[int]] | None = None
        n = max(0, len(reference) - key + STEP) // STEP
        if n < SLOTS and not reference.strip("ACGT"):
            self._by_letters(range(0, n * STEP, STEP))
            return
        codes, valid = window_codes(letters_of(reference), self.key)
        places = np.flatnonzero(valid[::STEP]) * STEP
        codes = codes[places]
        if len(places) >= SLOTS:
            size = max(8, 2 << max(0, int(len(places) / FULL).bit_length() - 1))
            kept = _put((finalised(codes) & np.uint64(size - 1)).astype(np.int64), size)
            codes, places = codes[kept], places[kept]
        order = np.argsort(codes, kind="stable")
        self.codes, self.places = codes[order], places[order]
        if len(reference) <= INDEXED:
            self._by_letters(np.sort(places).tolist())

    def _by_letters(self, places: Sequence[int]) -> None:
        self.index = {}
        for place in places:
            self.index.setdefault(self.reference[place : place + self.key], []).append(place)

    def _starts(self, text: str) -> list[int]:
        """Places of a text where a key of the index begins, in order."""
        if len(text) > SHORT:
            return [i for i in range(len(text) - self.key + 1) if text[i : i + self.key] in self.index]
        starts = []
        for letters in self.index:
            at = text.find(letters)
            while at >= 0:
                starts.append(at)
                at = text.find(letters, at + 1)
        starts.sort()
        return starts

    def _known(self, code: np.uint64) -> list[int]:
        first, last = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
        return self.places[first:last].tolist()

    def _best(self, text: str, at: int, places: list[int], pending: int) -> tuple[int, int, int]:
        """(letters forward, letters back, place of the first forward letter) of the longest match from ``at`` with one of
        these places of its key."""
        ref, best, found = self.reference, self.min_match, (0, 0, 0)
        for place in places:
            size, back = common_prefix(ref, place, text, at), 0
            while back < pending and back < place and ref[place - back - 1] == text[at - back - 1]:
                back += 1
            if size + back > best:
                best, found = size + back, (size, back, place)
        return found

    def walk(self, text: str, returned: bool = True, windows: Windows | None = None) -> Iterator[tuple[int, int] | int | Match]:
        """Steps of coding: a range of letters, the length of a run of N, or a match. With ``returned`` a match gives the
        letters that it takes back; without, as many letters after it are skipped, as quick estimates have it. ``windows``:
        those of the text, where the caller has them."""
        n, key, index = len(text), self.key, self.index
        if index is not None:
            starts = self._starts(text)
            runs = [m.span() for m in _RUN.finditer(text)] if "N" in text else []
        else:
            codes, known, runs = windows or windows_and_runs(text, key)
            at = np.minimum(np.searchsorted(self.codes, codes[known]), max(0, len(self.codes) - 1))
            starts = known[self.codes[at] == codes[known]] if len(self.codes) else known[:0]
        i = predicted = pending = seen = run = 0
        while i + key < n:
            seen = bisect_left(starts, i, seen)
            while run < len(runs) and runs[run][1] - max(i, runs[run][0]) < MIN_RUN:
                run += 1
            hit = int(starts[seen]) if seen < len(starts) else n
            stop = max(i, runs[run][0]) if run < len(runs) else n
            go = min(hit, stop)
            if go + key >= n:
                break
            if go > i:
                yield i, go
                predicted, pending, i = predicted + go - i, pending + go - i, go
            if stop == go:
                yield runs[run][1] - go
                i, pending = runs[run][1], 0
                continue
            places = self._known(codes[i]) if index is None else index[text[i : i + key]]
            size, back, place = self._best(text, i, places, pending)
            if size:
                yield Match(i - back, place - back, size + back, predicted - back, back)
                more = 0 if returned else back
                i, predicted, pending = i + size + more, place + size + more, 0
            else:
                yield i, i + 1
                i, predicted, pending = i + 1, predicted + 1, pending + 1
        if i != n:
            yield i, n

    def _to_ends(self, text: str, m: Match) -> bool:
        return m.at + m.size == len(text) and m.place + m.size == len(self.reference)

    def encode(self, text: str, first_form: bool = False) -> str:
        """``first_form``: the format's older form, without ``!``, open ends and empty codes; it is read in the same way."""
        if text == self.reference and not first_form:
            return ""
        out: list[str] = []
        size, pending = 0, ""
        for step in self.walk(text):
            if isinstance(step, tuple):
                pending += text[slice(*step)].translate(_TO_CODE)
                continue
            if isinstance(step, int):
                token = f"{RUN_START}{step - MIN_RUN}{RUN_END}"
            else:
                pending = pending[: len(pending) - step.back]
                if step.place == step.predicted and not first_form:
                    pending = self._same(pending, step.place, size)
                token = f"{step.place - step.predicted}." if self._to_ends(text, step) and not first_form else f"{step.place - step.predicted},{step.size - self.min_match}."
            out += (pending, token)
            size, pending = size + len(pending) + len(token), ""
        return "".join(out) + pending or f"{RUN_START}{-MIN_RUN}{RUN_END}"

    def _same(self, pending: str, place: int, size: int) -> str:
        """Pending letters before a match at the predicted place, with ``!`` for those of the reference: from the last
        one back to a blank, but neither the first of the code nor that of the reference."""
        n = min(len(pending), size + len(pending) - 1, place - 1)
        n = min(n, len(pending) - 1 - pending.rfind(BLANK))
        if n <= 0:
            return pending
        expected = self.reference[place - n : place].translate(_TO_CODE)
        return pending[: len(pending) - n] + "".join("!" if a == b else a for a, b in zip(pending[len(pending) - n :], expected, strict=True))

    def cost(self, text: str, bound: int | None = None, windows: Windows | None = None) -> int:
        """Quick estimate of the code's size; above ``bound``, any value above it. ``windows``: see :meth:`walk`."""
        if text == self.reference:
            return 0
        total = 0
        for step in self.walk(text, returned=False, windows=windows):
            if isinstance(step, tuple):
                total += step[1] - step[0]
            elif isinstance(step, int):
                total += 2 + len(str(step))
            else:
                end = step.at + step.back + step.size == len(text) and step.place + step.back + step.size == len(self.reference)
                total += len(str(step.place - step.predicted)) + 1 + (0 if end else 1 + len(str(step.size - self.min_match)))
            if bound is not None and total > bound:
                break
        return total

    def costs(self, text: str, at_start: bool = True) -> list[int]:
        """Cost of every letter: that of a run or match falls on its first (or last) letter, and is 0 for the others."""
        out: list[int] = []
        for step in self.walk(text):
            if isinstance(step, tuple):
                out += [1] * (step[1] - step[0])
                continue
            if isinstance(step, int):
                size, cost = step, 2 + len(str(step - MIN_RUN))
            else:
                del out[len(out) - step.back :]
                size, cost = step.size, len(str(step.place - step.predicted)) + len(str(step.size - self.min_match)) + 2
            rest = [0] * (size - 1)
            out += [cost, *rest] if at_start else [*rest, cost]
        return out


def common_prefix(a: str, i: int, b: str, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:], by comparing doubling slices."""
    most, size = min(len(a) - i, len(b) - j), 0
    step = 32
    while size < most:
        n = min(step, most - size)
        if a[i + size : i + size + n] == b[j + size : j + size + n]:
            size += n
            step *= 2
            continue
        return size + len(os.path.commonprefix((a[i + size : i + size + n], b[j + size : j + size + n])))
    return size


def decode(reference: str, code: str, min_match: int) -> str:
    if not code:
        return reference
    out, predicted = [], 0
    for letters, move, more, run in _TOKEN.findall(code):
        if letters:
            if "!" in letters:
                out.append("".join(reference[predicted + i] if x == "!" else x.translate(_TO_LETTER) for i, x in enumerate(letters)))
            else:
                out.append(letters.translate(_TO_LETTER))
            predicted += len(letters)
        elif move:
            start = predicted + int(move)
            end = start + int(more) + min_match if more else len(reference)
            out.append(reference[start:end])
            predicted = end
        else:
            out.append("N" * (int(run) + MIN_RUN))
    return "".join(out)


def _each(kind: str, min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, coder = None, None
        for batch in batches:
            done = []
            for ref, body in zip(batch.column("ref_seq").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if body is None or ref is None:
                    done.append(body)
                elif kind == "decode":
                    done.append(decode(ref, body, min_match))
                elif body == ref and kind == "encode":
                    done.append("")  # without the index, which most references never need
                else:
                    if ref != last:
                        last, coder = ref, Coder(ref, min_match)
                    done.append(coder.encode(body, kind == "first form"))
            keep = [n for n in batch.schema.names if n not in ("ref_seq", "body")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(done, pa.string())], [*keep, "body"])

    return run


def _applied(df: DataFrame, kind: str, min_match: int) -> DataFrame:
    from ..sources.shipping import ship

    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("ref_seq", "body"))
    return df.mapInArrow(_each(kind, min_match), f"{schema}, body string")


def encode_rows(df: DataFrame, min_match: int, first_form: bool = False) -> DataFrame:
    """Rows with ``ref_seq`` and ``body`` (letters): ``body`` becomes its code; null references leave it as it is."""
    return _applied(df, "first form" if first_form else "encode", min_match)


def decode_rows(df: DataFrame, min_match: int) -> DataFrame:
    """Inverse of :func:`encode_rows`."""
    return _applied(df, "decode", min_match)


#: Numbers of the symbols; letters without one are 30.
_SYMBOL = np.full(256, 30, dtype=np.int64)
_SYMBOL[[ord(x) for x in SYMBOLS]] = range(len(SYMBOLS))
_TEXT = [str(i) for i in range(256)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths, texts, same = [], [], []
        for seq in batch.column("seq").to_pylist():
            if seq is None:
                width, text, equal = 4, None, None
            else:
                codes = _SYMBOL[letters_of(seq)]
                width, data = pack_array(codes)
                text, equal = ",".join([_TEXT[x] for x in data.tolist()]), bool(np.array_equal(unpack_array(data), codes))
            widths.append(width)
            texts.append(text)
            same.append(equal)
        keep = [n for n in batch.schema.names if n != "seq"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(widths, pa.int32()), pa.array(texts, pa.string()), pa.array(same, pa.bool_())], [*keep, "width", "bytes", "same"])


def pack_rows(df: DataFrame) -> DataFrame:
    """Rows with ``seq`` (letters): instead of it ``width``, its packed symbols as ``bytes`` (numbers joined by commas), and
    ``same``: whether they are unpacked to the same symbols. A null sequence has the least width and no bytes."""
    from ..sources.shipping import ship

    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "seq")
    return df.mapInArrow(_packed, f"{schema}, width int, bytes string, same boolean")


def token_statistics(codes: DataFrame) -> DataFrame:
    """Sizes and counts of tokens per row of ``body`` codes, with built-in expressions."""
    count = lambda pattern: F.regexp_count("body", F.lit(pattern))
    return codes.select(
        *[c for c in codes.columns if c != "body"],
        F.char_length("body").cast("long").alias("size"),
        count(r"\.").cast("long").alias("matches"),
        count("!").cast("long").alias("same"),
        count(RUN_START).cast("long").alias("runs"),
    )
