"""Expressions over sequences held as strings of letters.

Sequences are upper-case strings. Over A, C, G, T the string order of k-mers equals the order of the usual two-bit codes,
so canonical k-mers are a ``least`` of two strings and need no unsigned arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sixteen symbols with a code, in code order, and the letters without one, which print as a space.
SYMBOLS = "ACGTNRYSWKMBDHVU"
UNCODED = "EFIJLOPQXZ"
BASES, COMPLEMENTS = "ACGT", "TGCA"

# Multipliers of the 64-bit finaliser, and the mask of the sampling filter.
FMIX1, FMIX2, SAMPLE_MASK = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD73F8BF11046C40E


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def dna_view(text: Column) -> Column:
    """Only the letters A, C, G and T of a text, upper-cased."""
    return F.translate(F.regexp_replace(text, "[^ACGTacgt]+", ""), "acgt", "ACGT")  # few letters stay: runs go first


def normalise_symbols(raw: Column) -> Column:
    """Letters as they come back from storage: upper case, letters without a code as a space, all else dropped."""
    letters = F.regexp_replace(raw, "[^A-Za-z]+", "")
    upper = SYMBOLS + UNCODED
    return F.translate(letters, upper + upper.lower(), (SYMBOLS + " " * len(UNCODED)) * 2)


def iupac_view(text: Column) -> Column:
    """The sequence view with ambiguity letters of a text."""
    return normalise_symbols(text)


def complement(s: Column) -> Column:
    """Complement of A, C, G, T; other letters stay as they are."""
    return F.translate(s, BASES, COMPLEMENTS)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_forward(kmer: Column) -> Column:
    """Whether a k-mer is not greater than its reverse complement."""
    return kmer <= reverse_complement(kmer)


def is_valid_kmer(kmer: Column) -> Column:
    return kmer.rlike("^[ACGT]+$")


def dna_code(letter: Column) -> Column:
    """0 to 3 for A, C, G, T and 4 for anything else."""
    at = F.instr(F.lit(BASES), letter)
    return F.when((F.char_length(letter) == 1) & (at > 0), at - 1).otherwise(4)


def kmer_value(kmer: Column, k: int) -> Column:
    """Two bits a base, left-aligned in 64 bits, as a signed long."""
    packed = F.conv(F.translate(kmer, BASES, "0123"), 4, -10).cast("long")
    return F.shiftleft(packed, 64 - 2 * k) if k < 32 else packed


def _with_product(df: DataFrame, column: str, by: int) -> DataFrame:
    """Replaces a long column by its product with a constant modulo 2**64: sums of 16-bit limbs, so nothing overflows.

    The steps are columns of their own, which Spark computes once each in generated code.
    """
    mask = F.lit(0xFFFF).cast("long")
    limb = lambda i: F.shiftrightunsigned(column, 16 * i).bitwiseAND(mask)
    factor = [F.lit((by >> (16 * i)) & 0xFFFF).cast("long") for i in range(4)]
    out = df
    for n in range(4):
        total = limb(0) * factor[n]
        for i in range(1, n + 1):
            total = total + limb(i) * factor[n - i]
        out = out.withColumn(f"__sum{n}", total + F.shiftrightunsigned(f"__sum{n - 1}", 16) if n else total)
    whole = F.col("__sum0").bitwiseAND(mask)
    for n in range(1, 4):
        whole = whole.bitwiseOR(F.shiftleft(F.col(f"__sum{n}").bitwiseAND(mask), 16 * n))
    return out.withColumn(column, whole).drop(*[f"__sum{n}" for n in range(4)])


def with_fmix64(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the 64-bit finaliser of MurmurHash3 of a long column."""
    shifted = lambda: F.col(out).bitwiseXOR(F.shiftrightunsigned(out, 33))
    df = df.withColumn(out, F.col(value)).withColumn(out, shifted())
    df = _with_product(df, out, FMIX1).withColumn(out, shifted())
    return _with_product(df, out, FMIX2).withColumn(out, shifted())


def is_sampled(mixed: Column, fraction: float) -> Column:
    """Whether a finalised value belongs to the sampled share: (value xor mask) < fraction * 2**64, unsigned."""
    bound = int(float((1 << 64) - 1) * fraction)
    if bound <= 0:
        return F.lit(False)
    if bound >= 1 << 64:
        return F.lit(True)
    # signed comparison of values with flipped top bits is unsigned
    return mixed.bitwiseXOR(F.lit(_signed(SAMPLE_MASK ^ (1 << 63))).cast("long")) < F.lit(_signed(bound ^ (1 << 63))).cast("long")


def wrap(s: Column, width: int = 80) -> Column:
    """Lines of a fixed width, each with its line end; an empty sequence has none. A width of 0: one line."""
    if width <= 0:
        return F.when(s != "", F.concat(s, F.lit("\n"))).otherwise(s)
    return F.regexp_replace(s, f"(.{{1,{int(width)}}})", "$1\n")


def fasta_record(header: Column, s: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), wrap(s, width))


def n_runs(s: Column, least: int = 4) -> Column:
    """Lengths of the runs of N of at least ``least`` letters."""
    return F.transform(F.regexp_extract_all(s, F.lit(f"(N{{{int(least)},}})"), F.lit(1)), lambda r: F.char_length(r))


def base_sum(s: Column) -> Column:
    """Sum of the letters' byte values."""
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(F.transform(letters, F.ascii), F.lit(0).cast("long"), lambda a, x: a + x)


def self_similarity(s: Column, low: int = 4, high: int = 31) -> Column:
    """Largest share, over the lags, of A, C, G, T that equal the letter one lag before; 0 without any."""
    letters = F.filter(F.split(s, ""), lambda c: c != "")

    def largest(x: Column) -> Column:
        n = F.size(x)
        total = F.size(F.filter(x, lambda c: c.isin(*BASES)))
        same = lambda a, b: (a == b) & a.isin(*BASES)
        equal = lambda lag: F.size(F.filter(F.zip_with(F.slice(x, lag + 1, n - lag), F.slice(x, 1, n - lag), same), lambda e: e))
        shares = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda lag: F.when(n > lag, equal(lag) / total).otherwise(0.0))
        return F.when(total > 0, F.array_max(shares)).otherwise(0.0)

    return F.element_at(F.transform(F.array(letters), largest), 1)


def zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


# Digits of stream names, in the order of their values.
DIGITS64 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_#"


def _digits(n: Column, bits: int) -> Column:
    """Digits of ``bits`` bits of a number of 32 bits or less, the lowest first."""
    base = 1 << bits
    places = F.sequence(F.lit(0), F.lit(31 // bits))
    needed = F.filter(places, lambda i: (i == 0) | (F.floor(n / F.pow(F.lit(float(base)), i.cast("double"))) > 0))
    digit = lambda i: F.pmod(F.floor(n / F.pow(F.lit(float(base)), i.cast("double"))), F.lit(base))
    return F.array_join(F.transform(needed, lambda i: F.substring(F.lit(DIGITS64), (digit(i) + 1).cast("int"), F.lit(1))), "")


def base64_name(n: Column) -> Column:
    """A number in base 64, the lowest digit first."""
    return _digits(n, 6)


def hex_name(n: Column) -> Column:
    """A number in upper-case hexadecimal digits, the lowest first."""
    return _digits(n, 4)
