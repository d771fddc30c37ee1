"""Contigs that are read in parts: the same collection as from whole ones."""

import gzip
import random

import pytest

from strandlake.operators import kmers, segmentation
from strandlake.operators.archive import Collection
from strandlake.sources import pieces
from strandlake.sources.fasta import read_fasta

from .test_segmentation import COMPLEMENT, K, SIZE


def bases(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def fasta(records, width):
    return "".join(f">{n}\n" + "".join(f"{s[i : i + width]}\n" for i in range(0, len(s), width)) for n, s in records)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    r = random.Random(31)
    top = tmp_path_factory.mktemp("fa")
    ref = [("c0 first", bases(r, 6000)), ("c1", ""), ("c2 x > y", bases(r, 900) + "nnN-*E" + bases(r, 300).lower()), ("c3", bases(r, 40))]
    other = [("c0", ref[0][1][:3000] + "A" + ref[0][1][3001:]), ("c9", ref[2][1][:900].translate(COMPLEMENT)[::-1])]
    (top / "ref.fa").write_text(fasta(ref, 60))
    (top / "b.fa").write_bytes(fasta(other, 61).replace("\n", "\r\n").encode())
    with gzip.open(top / "z.fa.gz", "wt") as f:
        f.write("lost\n" + fasta(ref[:1], 6000) + ">\nACGT\n>end\n")
    return [str(top / n) for n in ("ref.fa", "b.fa", "z.fa.gz")]


def joined(parts):
    """Contigs put together from parts, whose offsets have to follow each other."""
    out = {}
    for x in sorted(parts.collect(), key=lambda x: (x["file_ord"], x["contig_ord"], x["offset"], len(x["part"]))):
        key = (x["file_ord"], x["sample"], x["contig_ord"], x["contig"], x["contig_full"])
        assert len(out.setdefault(key, "")) == x["offset"]
        out[key] += x["part"]
    return out


@pytest.mark.parametrize(("block", "size"), [(1 << 27, 1 << 19), (700, 97), (300, 50)])
def test_parts_make_the_same_contigs(spark, files, block, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = pieces.read_parts(spark, files[:2], size)
        got = joined(parts)
        want = {(x["file_ord"], x["sample"], x["contig_ord"], x["contig"], x["contig_full"]): x["seq"] for x in read_fasta(spark, files[:2]).collect()}
        assert got == want and max(len(x["part"]) for x in parts.collect()) <= size
        if block < 1000:  # one contig is cut by several tasks
            assert spark.read.text(files[0]).rdd.getNumPartitions() > 5
        packed = joined(pieces.read_parts(spark, files[2], size))
        assert {k[-1]: v for k, v in packed.items()} == {"c0 first": want[(0, "ref", 0, "c0", "c0 first")], "end": ""} and [k[2] for k in packed] == [0, 1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_collection_from_parts(spark, files, tmp_path, monkeypatch):
    """Splitters, cuts, segments and the stored collection, with pieces far smaller than the contigs."""
    monkeypatch.setattr(kmers, "PIECE", 256)
    monkeypatch.setattr(kmers.aligned, "__defaults__", (256,))
    monkeypatch.setattr(segmentation, "ROW", 512)
    whole = read_fasta(spark, files[:2]).withColumnRenamed("file_ord", "sample_ord")
    parts = pieces.read_parts(spark, files[:2], 97).withColumnRenamed("file_ord", "sample_ord")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    known = segmentation.select_splitters(whole.where("sample_ord = 0"), K, SIZE)
    assert rows(known) == rows(segmentation.select_splitters(parts.where("sample_ord = 0"), K, SIZE))
    assert rows(kmers.coded_kmers(whole, K)) == rows(kmers.coded_kmers(parts, K))
    found = segmentation.segments(whole, known, K)
    assert rows(found) == rows(segmentation.segments(parts, known, K))
    assert rows(segmentation.with_sequences(found, whole)) == rows(segmentation.with_sequences(found, parts))
    made = Collection.create(parts.where("sample_ord = 0"), f"file://{tmp_path}/c", K, SIZE, 15, adaptive=True)
    made = made.append(parts.where("sample_ord = 1"))
    got = rows(made.contigs_with_sequences().select("sample", "contig_ord", "contig_full", "seq"))
    assert got == rows(whole.select("sample", "contig_ord", "contig_full", "seq"))
