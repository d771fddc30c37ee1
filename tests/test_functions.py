import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake import functions as fn
from strandlake.functions import packing

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("c1", (True, "c1", "", -1, -1)),
        ("c1@s1", (True, "c1", "s1", -1, -1)),
        ("c1:5-9", (True, "c1", "", 5, 9)),
        ("c1@s1:5-9", (True, "c1", "s1", 5, 9)),
        ("a@b@s1", (True, "a@b", "s1", -1, -1)),
        ("c1:x-y", (True, "c1", "", 0, 0)),
        ("HLA:1-2-3", (True, "HLA", "", 1, 3)),
        ("", (False, "", "", -1, -1)),
    ],
)
def test_contig_query(spark, query, want):
    assert tuple(one(spark, fn.contig_query(F.lit(query)))) == want


@pytest.mark.parametrize(("path", "want"), [("d/x.fna.gz", "x"), ("x.fa", "x"), ("x.v1.fa", "x.v1"), ("x.txt", "x"), ("x.fa.fasta", "x"), ("a/b.c/y", "y"), (".fa", ".fa")])
def test_sample_name(spark, path, want):
    assert one(spark, fn.sample_name(F.lit(path))) == want


def test_symbols(spark):
    assert one(spark, fn.normalise_symbols(F.lit("acgtnRYswKMbdHVu"))) == "ACGTNRYSWKMBDHVU"
    assert one(spark, fn.normalise_symbols(F.lit("aE1-*. \nxé"))) == "A  "
    assert one(spark, fn.reverse_complement(F.lit("ACGTN"))) == "NACGT"
    assert one(spark, fn.reverse_complement(F.lit("AR"))) == "RT"


@pytest.mark.parametrize(
    ("low", "high", "want"),
    [(8, 12, "ACTGA"), (-1, -1, "CTGAGCTGACTGA"), (9, 3, "CTGAGCTGACTGA"), (10, 99, "TGA"), (50, 60, ""), (-5, 1, "CT"), (3, -1, "AGCTGACTGA"), (12, 12, "A"), (13, 20, "")],
)
def test_ranges(spark, low, high, want):
    r = fn.normalised_range(F.lit(low).cast("long"), F.lit(high).cast("long"))
    assert one(spark, fn.slice_range(F.lit("CTGAGCTGACTGA"), r["from"], r["to"])) == want


@pytest.mark.parametrize("k", [17, 31, 32])
def test_kmer_values_and_hash(spark, k):
    r = random.Random(k)
    kmers = ["".join(r.choice("ACGT") for _ in range(k)) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in kmers], "kmer string").withColumn("v", fn.kmer_value(F.col("kmer"), k))
    rows = fn.with_fmix64(df, "v", "h").select("kmer", "v", "h", fn.is_sampled(F.col("h"), 0.3).alias("s"), fn.canonical(F.col("kmer")).alias("c")).collect()
    mask = (1 << 64) - 1
    for row in rows:
        value = 0
        for c in row["kmer"]:
            value = value << 2 | "ACGT".index(c)
        value <<= 64 - 2 * k
        h = value
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h ^= h >> 33
            h = h * by & mask
        h ^= h >> 33
        assert row["v"] & mask == value and row["h"] & mask == h
        assert row["s"] == ((h ^ 0xD73F8BF11046C40E) < int(float(mask) * 0.3))
        assert row["c"] == min(row["kmer"], row["kmer"].translate(COMPLEMENT)[::-1])


def test_sampling_bounds(spark):
    df = fn.with_fmix64(spark.range(50), "id", "h")
    assert df.where(fn.is_sampled(F.col("h"), 0.0)).count() == 0
    assert df.where(fn.is_sampled(F.col("h"), 1.0)).count() == 50


def test_text_output(spark):
    assert one(spark, fn.wrap(F.lit("ACGTACGT"), 4)) == "ACGT\nACGT\n"
    assert one(spark, fn.wrap(F.lit("ACGTA"), 4)) == "ACGT\nA\n"
    assert one(spark, fn.fasta_record(F.lit("x y"), F.lit(""), 4)) == ">x y\n"


def test_small_functions(spark):
    assert one(spark, fn.n_runs(F.lit("ANNNNCNNNGNNNNNN"))) == [4, 6]
    assert one(spark, fn.base_sum(F.lit("ACGT"))) == 65 + 67 + 71 + 84
    assert one(spark, fn.self_similarity(F.lit("ACGTG" * 20))) == pytest.approx(0.95)
    assert one(spark, fn.self_similarity(F.lit(""))) == 0
    assert [one(spark, fn.zigzag(F.lit(x))) for x in (0, -1, 1, -2, 2)] == [0, 1, 2, 3, 4]
    assert [one(spark, fn.dna_code(F.lit(x))) for x in "ACGTNR"] == [0, 1, 2, 3, 4, 4]
    assert one(spark, fn.short_name(F.lit("chr1\tx y"))) == "chr1"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 _é", max_size=40), st.text(alphabet="ab1 _é", max_size=40))
def test_names_as_steps(before, name):
    step = packing.name_step(before, name)
    assert packing.name_after(before, step) == name and packing.name_after(None, packing.name_step(None, name)) == name
    assert all(-128 <= x < 256 for x in step)


def test_steps_of_names():
    assert packing.name_step("chr1 of s1", "chr2 of s1") == [-3, ord("2"), 32, -127, 32, -127]
    assert packing.name_step("x" * 250, "x" * 249 + "y") == [-100, -100, -49, ord("y")]
    assert packing.name_step("chr9", "chr10") == list(b"chr10")


def test_numbers_of_every_size(spark):
    edges = sorted({max(0, x + e) for x in (0, 128, 16512, 2113664, 270549120, 1 << 8, 1 << 16, 1 << 24, (1 << 32) - 2) for e in (-1, 0, 1)})
    df = spark.createDataFrame([(x,) for x in edges], "n long")
    rows = df.select("n", packing.from_prefix_varint(packing.prefix_varint(F.col("n"))), packing.from_sized_varint(packing.sized_varint(F.col("n"))), F.size(packing.prefix_varint(F.col("n")))).collect()
    for n, a, b, size in rows:
        assert a == b == n and size == 1 + sum(n >= x for x in packing.PREFIX_STARTS[1:])
    for expected in (0, 1, 7, 1000):
        e = F.lit(expected).cast("long")
        assert all(r[0] == r[1] for r in df.select("n", packing.zigzag_near_decode(packing.zigzag_near(F.col("n"), e), e)).collect())
