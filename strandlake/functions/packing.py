"""Integer and symbol encodings of established genome archives, as built-in expressions, and for long sequences as numpy.
Bytes are arrays of ints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# First number of each length of the prefix code, and the first byte's prefix.
PREFIX_STARTS = (0, 1 << 7, (1 << 7) + (1 << 14), (1 << 7) + (1 << 14) + (1 << 21), (1 << 7) + (1 << 14) + (1 << 21) + (1 << 28))
PREFIXES = (0x00, 0x80, 0xC0, 0xE0, 0xF0)
# Multipliers of the 32-bit finaliser.
FMIX32 = (0x85EBCA6B, 0xC2B2AE35)
# Fixed values: (symbols below, symbols to a byte) of the packing of small symbols; others take a byte each.
WIDTHS = ((4, 4), (6, 3), (16, 2))
ZSTD_PLAIN, ZSTD_TUPLES = 0, 1


def _byte(x: Column, place: int) -> Column:
    return F.shiftright(x, 8 * place).bitwiseAND(F.lit(255).cast("long")).cast("int")


def prefix_varint(x: Column) -> Column:
    """A number of 32 bits in one to five bytes; leading ones of the first byte tell how many follow."""
    number = x.cast("long")
    out = None
    for n in reversed(range(5)):
        rest = number - F.lit(PREFIX_STARTS[n]).cast("long")
        places = range(n, -1, -1) if n < 4 else range(3, -1, -1)
        parts = [_byte(rest, p) for p in places]
        parts = [F.lit(PREFIXES[4]), *parts] if n == 4 else [parts[0] + PREFIXES[n], *parts[1:]]
        encoded = F.array(*parts)
        out = encoded if out is None else F.when(number < F.lit(PREFIX_STARTS[n + 1]).cast("long"), encoded).otherwise(out)
    return out


def from_prefix_varint(data: Column) -> Column:
    """Inverse of :func:`prefix_varint` for one number."""
    first = F.get(data, 0)
    whole = F.aggregate(data, F.lit(0).cast("long"), lambda a, b: a * 256 + b)
    out = F.aggregate(F.slice(data, 2, 4), F.lit(0).cast("long"), lambda a, b: a * 256 + b) + F.lit(PREFIX_STARTS[4]).cast("long")
    for n in (3, 2, 1, 0):
        out = F.when(first < PREFIXES[n + 1], whole - F.lit(PREFIXES[n] << (8 * n)).cast("long") + PREFIX_STARTS[n]).otherwise(out)
    return out


def sized_varint(x: Column) -> Column:
    """How many bytes a number takes, then those bytes, the highest first; 0 takes none."""
    number = x.cast("long")
    parts = F.filter(F.array(*[F.when(F.shiftright(number, 8 * i) > 0, _byte(number, i)) for i in range(7, -1, -1)]), lambda b: b.isNotNull())
    return F.concat(F.array(F.size(parts)), parts)


def from_sized_varint(data: Column) -> Column:
    return F.aggregate(F.slice(data, F.lit(2), F.get(data, 0)), F.lit(0).cast("long"), lambda a, b: a * 256 + b)


def zigzag_decode(x: Column) -> Column:
    """Inverse of zigzag: 0, 1, 2, 3, ... become 0, -1, 1, -2, ..."""
    return F.when(x % 2 == 1, -F.floor((x + 1) / 2)).otherwise(F.floor(x / 2)).cast("long")


def zigzag_near(x: Column, expected: Column) -> Column:
    """A number as its distance from an expected one where that is smaller: below it odd, up to twice it even, else as it is."""
    return F.when(x < expected, 2 * (expected - x) - 1).when(x < 2 * expected, 2 * (x - expected)).otherwise(x).cast("long")


def zigzag_near_decode(x: Column, expected: Column) -> Column:
    return F.when(x >= 2 * expected, x).when(x % 2 == 1, F.floor((2 * expected - x) / 2)).otherwise(F.floor((x + 2 * expected) / 2)).cast("long")


def fmix32(x: Column) -> Column:
    """The 32-bit finaliser of MurmurHash3 of the low 32 bits of a number, as a long without sign."""
    low = F.lit((1 << 32) - 1).cast("long")
    shifted = lambda h, n: h.bitwiseXOR(F.shiftright(h, n))

    def times(h: Column, by: int) -> Column:
        """A product modulo 2**32, in two parts that do not overflow."""
        high = F.shiftleft((h * F.lit(by >> 16).cast("long")).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
        return (h * F.lit(by & 0xFFFF).cast("long") + high).bitwiseAND(low)

    step = lambda start, *fs: F.aggregate(F.array(*[F.lit(i) for i in range(len(fs))]), start, lambda h, i: F.coalesce(*[F.when(i == k, f(h)) for k, f in enumerate(fs)]))
    return step(x.cast("long").bitwiseAND(low), lambda h: shifted(h, 16), lambda h: times(h, FMIX32[0]), lambda h: shifted(h, 13), lambda h: times(h, FMIX32[1]), lambda h: shifted(h, 16))


def pack_width(symbols: Column) -> Column:
    """How many of these symbols go to a byte: by the largest one."""
    most = F.coalesce(F.array_max(symbols), F.lit(0))
    out = F.lit(1)
    for below, n in reversed(WIDTHS):
        out = F.when(most < below, n).otherwise(out)
    return out


def pack_symbols(symbols: Column) -> Column:
    """Small symbols, two to four to a byte, the first one highest; then a byte for the rest, and last a marker: how many
    go to a byte (times 16) and how many are in the rest. Large symbols stay, with a marker."""

    def packed(base: int, n: int) -> Column:
        size = F.size(symbols)
        value = lambda part: F.aggregate(part, F.lit(0), lambda a, s: a * base + s)
        starts = F.sequence(F.lit(0), F.floor(size / n).cast("int"))
        return F.concat(F.transform(starts, lambda i: value(F.slice(symbols, i * n + 1, n))), F.array(F.lit(n * 16) + size % n))

    out = F.concat(symbols, F.array(F.lit(16)))
    width = pack_width(symbols)
    for base, n in WIDTHS:
        out = F.when(width == n, packed(base, n)).otherwise(out)
    return out


def unpack_symbols(data: Column) -> Column:
    """Inverse of :func:`pack_symbols`."""
    marker = F.element_at(data, -1)
    n, rest = F.floor(marker / 16).cast("int"), marker % 16
    bytes_ = F.slice(data, F.lit(1), F.size(data) - 1)

    def spread(base: int, width: int) -> Column:
        digits = lambda b, count: F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.when(j <= count, F.floor(b / F.pow(F.lit(float(base)), (count - j).cast("double"))).cast("int") % base))
        last = F.size(bytes_) - 1
        return F.array_compact(F.flatten(F.transform(bytes_, lambda b, i: digits(b, F.when(i == last, rest).otherwise(F.lit(width))))))

    out = bytes_
    for base, width in WIDTHS:
        out = F.when(n == width, spread(base, width)).otherwise(out)
    return out


def symbol_codes(s: Column) -> Column:
    """Numbers of the symbols of a sequence; letters without one are 30."""
    from .sequences import SYMBOLS

    letters = F.filter(F.split(s, ""), lambda c: c != "")
    at = lambda c: F.instr(F.lit(SYMBOLS), c)
    return F.transform(letters, lambda c: F.when(at(c) > 0, at(c) - 1).otherwise(30))


# the same packing of whole arrays, for Arrow batches: as expressions it takes several steps a letter


def pack_array(symbols: np.ndarray) -> tuple[int, np.ndarray]:
    """:func:`pack_width` and :func:`pack_symbols` of an array."""
    most, size = int(symbols.max(initial=0)), len(symbols)
    base, n = next(((base, n) for base, n in WIDTHS if most < base), (0, 1))
    if n == 1:
        return n, np.append(symbols, 16)
    weights = base ** np.arange(n - 1, -1, -1)
    full, rest = symbols[: size - size % n].reshape(-1, n) @ weights, symbols[size - size % n :]
    return n, np.concatenate([full, [rest @ weights[n - len(rest) :], n * 16 + size % n]])


def unpack_array(data: np.ndarray) -> np.ndarray:
    """Inverse of :func:`pack_array`: :func:`unpack_symbols` of an array."""
    (n, rest), held = divmod(int(data[-1]), 16), data[:-1]
    base = next((base for base, width in WIDTHS if width == n), 0)
    if not base:
        return held
    digits = held[:, None] // base ** np.arange(n - 1, -1, -1) % base
    return np.concatenate([digits[:-1].ravel(), digits[-1, n - rest :]])


def complement_letter(c: Column) -> Column:
    """Complement of A, C, G, T, and N for every other letter."""
    return F.when(F.instr(F.lit("ACGT"), c) > 0, F.translate(c, "ACGT", "TGCA")).otherwise(F.lit("N"))


def n_bits(x: Column) -> Column:
    """How many binary digits a number has; 0 has none."""
    return F.when(x > 0, F.char_length(F.bin(x))).otherwise(0)


def n_bytes(x: Column) -> Column:
    """How many bytes a number takes, one at least."""
    return F.greatest(F.lit(1), F.ceil(n_bits(x) / 8).cast("int"))


def is_power_of_two(x: Column) -> Column:
    """Whether at most one binary digit is set."""
    return F.bit_count(x) <= 1


def near_in_group(ids: Column, largest_before: Column) -> Column:
    """Code of an in-group id after the largest id above 0 that its group has shown so far (null: none yet)."""
    expected = largest_before + 1
    return F.when(largest_before.isNull(), ids).when(ids == 0, F.lit(0)).when(ids == expected, F.lit(1)).otherwise(zigzag_near(ids, expected) + 1).cast("long")


# names of contigs as steps from the name before

_SAME, _MOST = -127, 100


def name_step(before: str | None, name: str) -> list[int]:
    """A name as signed bytes relative to the one before: of words split at spaces, -127 for an equal one, -n for n equal
    letters in one of equal length (100 at most at once), letters as they are otherwise. Names of another number of words,
    and the first name, are their own bytes."""
    words, others = name.encode().split(b" "), (before or "").encode().split(b" ")
    if before is None or len(words) != len(others):
        return [b - 256 if b > 127 else b for b in name.encode()]
    out: list[int] = []
    for i, (word, other) in enumerate(zip(words, others, strict=True)):
        out += [32] if i else []
        if word == other:
            out.append(_SAME)
        elif len(word) != len(other):
            out += word
        else:
            equal = 0
            for a, b in zip(word, other, strict=True):
                if a == b and equal < _MOST:
                    equal += 1
                elif a == b:
                    out.append(-equal)
                    equal = 1
                else:
                    out += [-equal, a] if equal else [a]
                    equal = 0
            out += [-equal] if equal else []
    return out


def name_after(before: str | None, step: list[int]) -> str:
    """Inverse of :func:`name_step` for names of ASCII letters."""
    words: list[list[int]] = [[]]
    for x in step:
        if x == 32:
            words.append([])
        else:
            words[-1].append(x)
    others = (before or "").encode().split(b" ")
    if before is None or len(words) != len(others):
        return bytes(x & 255 for x in step).decode()
    out = []
    for word, other in zip(words, others, strict=True):
        if word == [_SAME]:
            out.append(other)
            continue
        text, at = b"", 0
        for x in word:
            text, at = (text + bytes([x]), at + 1) if x >= 0 else (text + other[at : at - x], at - x)
        out.append(text)
    return b" ".join(out).decode()
