import gzip
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from strandlake.operators.archive import Collection, clamp
from strandlake.operators.codec import Coder
from strandlake.operators.commits import Log
from strandlake.functions import fasta_record
from strandlake.sources.fasta import file_sizes, read_fasta, read_file_list, stream_lines, with_codes, write_fasta, write_file, write_samples
from strandlake.streaming import append_stream, contig_stream

from .test_segmentation import COMPLEMENT, K, SCHEMA, SIZE, collection, segments, splitters, windows

TOY = {
    "ref": [("chr1", "AGCTAGCTAGCTAGCT"), ("chr2", "TAAAAAAAAAAATTT"), ("chr3", "TGGGGGGGGGGTTT"), ("seq", "TGTGTGTGTG")],
    "a": [("chr1a", "CTGAGCTGACTGA"), ("chr3a", "AGTTTAGCT")],
    "b": [("chr1", "AAAAAAAAA"), ("g h i 21", "GGGAGGG"), ("c", "CCCCCCCCC"), ("t", "TTTTTTT")],
    "c": [("1", "TGTGTGTGTGTG"), ("2", "ACACACACA"), ("3", "TTTTCCCGGGAAAAAA")],
}


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    rows = [(i, s, j, n.split()[0], n, q) for i, (s, contigs) in enumerate(TOY.items()) for j, (n, q) in enumerate(contigs)]
    return Collection.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path_factory.mktemp('toy')}/c")


def test_catalog_of_the_toy_collection(toy):
    assert toy.list_samples() == ["a", "b", "c", "ref"] and toy.list_samples(False) == ["ref", "a", "b", "c"]
    assert toy.reference_sample() == "ref" and toy.n_samples() == 4
    assert [toy.n_contigs(s) for s in ("ref", "a", "b", "c", "zzz")] == [4, 2, 4, 3, -1]
    assert toy.contig_length("b", "g") == toy.contig_length("b", "g h i 21") == 7
    assert toy.contig_length("", "chr1") == -2 and toy.contig_length("", "nope") == -1
    assert toy.list_contigs("b") == ["chr1", "g h i 21", "c", "t"]
    info = toy.info().first()
    assert (info["n_samples"], info["n_contigs"], info["reference"], info["k"], info["min_match"], info["segment_size"]) == (4, 13, "ref", 31, 20, 60_000)
    assert info["commands"].endswith("create")


def test_ranges_of_the_toy_collection(toy):
    get = lambda *a: toy.contig_sequence(*a)
    assert get("a", "chr1a", 8, 12) == "ACTGA"
    assert get("a", "chr1a") == get("a", "chr1a", 9, 3) == "CTGAGCTGACTGA"
    assert get("a", "chr1a", 10, 99) == "TGA" and get("a", "chr1a", 50, 60) == ""
    assert get("", "nope") == "" and get("", "chr1") == ""
    rows = {r["query_ord"]: r for r in toy.get_contigs(["chr3a@a:0-3", "", "chr1", "nope", "seq"]).collect()}
    assert (rows[0]["header"], rows[0]["seq"]) == ("chr3a:0-3", "AGTT")
    assert {i: r["status"] for i, r in rows.items()} == {0: 0, 2: -2, 3: -1, 4: 0}
    assert rows[4]["seq"] == "TGTGTGTGTG"


def test_raw_groups_of_the_toy_collection(toy):
    got = {(r["sample_ord"], r["contig_ord"]): (r["group_id"], r["in_group_id"]) for r in toy.table("segments").collect()}
    groups = {0: [1, 2, 3, 0], 1: [1, 0], 2: [2, 3, 1, 0], 3: [1, 2, 0]}
    in_order = [(s, c) for s in TOY_ORDER for c in range(len(TOY[s[1]]))]
    by_ord = {(i, c): got[(i, c)][0] for (i, _), c in in_order}
    # contigs of b are dealt in file order here
    assert [by_ord[(0, c)] for c in range(4)] == groups[0] and [by_ord[(1, c)] for c in range(2)] == groups[1] and [by_ord[(3, c)] for c in range(3)] == groups[3]
    assert min(i for _, i in got.values()) == 1


TOY_ORDER = list(enumerate(TOY))


def test_samples_in_argument_order(toy):
    rows = toy.get_samples(["c", "a", "c"]).orderBy("argument", "contig_ord").collect()
    assert [r["contig_full"] for r in rows] == ["1", "2", "3", "chr1a", "chr3a", "1", "2", "3"]
    with pytest.raises(KeyError):
        toy.get_samples(["a", "zzz"])


def rows_of(df):
    return sorted((r["sample_ord"], r["contig_ord"], r["seq"]) for r in df.collect())


@pytest.mark.parametrize("adaptive", [False, True])
def test_round_trip_append_and_ranges(spark, tmp_path, adaptive):
    rows = collection(11, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    made = Collection.create(df.where("sample_ord < 3"), f"file://{tmp_path}/c", K, SIZE, 15, adaptive=adaptive)
    made = made.append(df.where("sample_ord >= 3"), adaptive=adaptive)
    assert rows_of(made.get_collection()) == sorted((r[0], r[2], r[-1]) for r in rows)
    groups = made.table("segments").where("group_id >= 16").groupBy("group_id").count()
    assert groups.where("count > 1").count() > 5  # keyed groups are shared between samples and batches
    assert made.table("groups").groupBy("key1", "key2").count().where("count > 1").count() == 0
    assert made.table("deltas").groupBy("group_id", "in_group_id").count().where("count > 1").count() == 0
    stored = spark.read.parquet(f"{made.path}/deltas").where("group_id >= 16")
    assert stored.groupBy("batch", "group_id", "delta").count().where("count > 1").count() == 0  # equal codes of a batch are one
    for low, high in ((0, 0), (95, 130), (350, 353), (1490, 5000)):
        got = {(r["sample_ord"], r["contig_ord"]): r["seq"] for r in made.contigs_with_sequences(low=low, high=high).collect()}
        assert got == {(r[0], r[2]): r[-1][low : high + 1] for r in rows}
    queries = [f"c0@s{s}:{low}-{low + 140}" for s in range(5) for low in (0, 101, 777)]
    got = {r["query_ord"]: r["seq"] for r in made.get_contigs(queries).collect()}
    seqs = {(r[1], r[3]): r[-1] for r in rows}
    assert got == {i: seqs[(f"s{i // 3}", "c0")][(low := (0, 101, 777)[i % 3]) : low + 141] for i in range(15)}
    sizes = made.sizes().first()
    assert sizes["delta_size"] < sizes["ref_size"]
    with pytest.raises(ValueError, match="already"):
        made.append(df.where("sample_ord = 1"))


def test_a_failed_batch_is_not_seen(spark, tmp_path):
    rows = collection(12, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    path = f"file://{tmp_path}/c"
    made = Collection.create(df.where("sample_ord < 2"), path, K, SIZE, 15)
    df.where("sample_ord = 2").select("sample_ord", "sample").distinct().write.parquet(f"{path}/samples/batch=1")  # no commit follows
    assert Collection(spark, path).n_samples() == 2
    again = made.append(df.where("sample_ord = 2"))
    assert rows_of(again.get_collection()) == sorted((r[0], r[2], r[-1]) for r in rows)


def test_an_empty_collection_can_grow(spark, tmp_path):
    df = spark.createDataFrame(collection(14, 2), SCHEMA)
    made = Collection.create(df.limit(0), f"file://{tmp_path}/c", K, SIZE, 15)
    assert made.n_samples() == 0 and made.reference_sample() is None and made.get_collection().collect() == []
    assert rows_of(made.append(df).get_collection()) == rows_of(df)


def test_parameters_are_clamped():
    assert clamp("k", None) == 31 and clamp("k", 5) == 17 and clamp("k", 99) == 32 and clamp("segment_size", 1) == 100


def test_fasta_files(spark, tmp_path):
    (tmp_path / "x.v1.fa").write_text(">c1 first\nACGT\nAC\n>c2\tsecond > one\r\nnnRy\r\n\n>c3\n\n")
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(">c1\nTTTT\n")
    found = read_fasta(spark, [str(tmp_path / "x.v1.fa"), str(tmp_path / "y.fa.gz"), str(tmp_path / "y.fa.gz")])
    got = sorted((r["sample"], r["contig_ord"], r["contig"], r["contig_full"], r["seq"]) for r in found.collect())
    assert got == [("x.v1", 0, "c1", "c1 first", "ACGTAC"), ("x.v1", 1, "c2", "c2\tsecond > one", "NNRY"), ("x.v1", 2, "c3", "c3", ""), ("y", 0, "c1", "c1", "TTTT")]
    assert {r["sample"] for r in read_fasta(spark, str(tmp_path / "x.v1.fa"), concatenated=True).collect()} == {"c1", "c2", "c3"}
    (tmp_path / "list").write_text("a.fa b.fa\n a.fa\n")
    assert read_file_list(spark, str(tmp_path / "list")) == ["a.fa", "b.fa"]


def test_writing_fasta(toy, spark, tmp_path):
    contigs = toy.contigs_with_sequences()
    lines = "".join(stream_lines(contigs, 10))
    assert lines.startswith(">chr1\nAGCTAGCTAG\nCTAGCT\n>chr2\n")
    write_fasta(contigs, f"file://{tmp_path}/all", 10)
    assert sorted("".join(p.read_text() for p in sorted((tmp_path / "all").glob("part*"))).splitlines()) == sorted(lines.splitlines())
    write_samples(contigs, f"file://{tmp_path}/by", 10, gzip_level=9)
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.suffix == ".gz") == [f"{s}.fa.gz" for s in ("a", "b", "c", "ref")]
    assert not (tmp_path / "by/_staging").exists()
    back = read_fasta(spark, f"{tmp_path}/by/b.fa.gz")
    assert [(r["sample"], r["contig_full"], r["seq"]) for r in back.orderBy("contig_ord").collect()] == [("b", *x) for x in TOY["b"]]
    rows = contigs.select("sample_ord", "contig_ord", fasta_record(F.col("contig_full"), F.col("seq"), 0).alias("value"))
    write_file(rows, ["sample_ord", "contig_ord"], f"file://{tmp_path}/one.fa")
    assert (tmp_path / "one.fa").read_text() == "".join(f">{n}\n{q}\n" for x in TOY.values() for n, q in x)


def test_files_by_content_and_strict_reading(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(gzip.compress(b">c1 first\nACGT\n>c2\nGG\n"))
    (tmp_path / "y.fa.gz").write_bytes(b">d\nTTTT\n")
    got = sorted((r["file_ord"], r["sample"], r["contig_ord"], r["contig_full"], r["seq"]) for r in read_fasta(spark, [str(tmp_path / "x.fa"), str(tmp_path / "y.fa.gz")]).collect())
    assert got == [(0, "x", 0, "c1 first", "ACGT"), (0, "x", 1, "c2", "GG"), (1, "y", 0, "d", "TTTT")]
    assert file_sizes(spark, [str(tmp_path / "x.fa"), str(tmp_path / "y.fa.gz")]) == [(str(tmp_path / "x.fa"), 22), (str(tmp_path / "y.fa.gz"), 8)]
    coded = {r["contig_full"]: r["codes"] for r in with_codes(read_fasta(spark, str(tmp_path / "x.fa"))).collect()}
    assert coded == {"c1 first": [0, 1, 2, 3], "c2": [2, 2]}
    (tmp_path / "z.fa").write_text(">a\nAC>GT\nAA\n>b\nCC\n>\nTT\n>c\nGG\n")
    strict = [(r["contig_full"], r["seq"]) for r in read_fasta(spark, str(tmp_path / "z.fa"), strict=True).orderBy("contig_ord").collect()]
    assert strict == [("a", "AC"), ("GT", "AA"), ("b", "CC")]
    loose = [(r["contig_full"], r["seq"]) for r in read_fasta(spark, str(tmp_path / "z.fa")).orderBy("contig_ord").collect()]
    assert loose[0] == ("a", "ACGTAA") and loose[-1] == ("c", "GG")
    with pytest.raises(FileNotFoundError):
        read_fasta(spark, str(tmp_path / "none.fa"))


def test_prefetched_collections_and_streamed_segments(toy, spark):
    with Collection(spark, toy.path, prefetch=True) as c:
        assert rows_of(c.get_collection()) == rows_of(toy.get_collection())
        assert c.table("groups").storageLevel.useMemory
    whole = toy.contigs().select(F.struct("sample_ord", "contig_ord").alias("place"), F.col("contig_full").alias("header"), "sample_ord", "contig_ord", F.lit(0).cast("long").alias("low"), F.lit(1 << 40).cast("long").alias("high"))
    for width in (7, 0):
        assert "".join(toy.stream_records(whole, width)) == "".join(stream_lines(toy.contigs_with_sequences(), width))


def test_streamed_ingestion(spark, tmp_path):
    rows = collection(13, 4)
    folder = tmp_path / "in"
    columns = ["sample", "contig_ord", "contig", "contig_full", "seq"]
    df = spark.createDataFrame(rows, SCHEMA)
    df.where("sample_ord < 2").select(*columns).coalesce(1).write.parquet(f"file://{folder}")
    path, log = f"file://{tmp_path}/c", f"file://{tmp_path}/log"
    append_stream(contig_stream(spark, str(folder)), path, log, k=K, segment_size=SIZE, min_match=15).awaitTermination()
    df.where("sample_ord >= 2").select(*columns).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    append_stream(contig_stream(spark, str(folder)), path, log).awaitTermination()
    made = Collection(spark, path)
    assert made.list_samples() == ["s0", "s1", "s2", "s3"] and len(made.batches) == 2
    got = {(r["sample"], r["contig_full"], r["seq"]) for r in made.contigs_with_sequences().collect()}
    assert got == {(r[1], r[4], r[5]) for r in rows}


def test_a_sample_over_two_batches_is_an_error(spark, tmp_path):
    folder, path, log = tmp_path / "in", f"file://{tmp_path}/c", f"file://{tmp_path}/log"
    df = spark.createDataFrame([r for r in collection(13, 2) if r[0] == 0], SCHEMA).select("sample", "contig_ord", "contig", "contig_full", "seq")
    df.where("contig_ord = 0").coalesce(1).write.parquet(f"file://{folder}")
    append_stream(contig_stream(spark, str(folder)), path, log, k=K, segment_size=SIZE, min_match=15).awaitTermination()
    df.where("contig_ord > 0").coalesce(1).write.mode("append").parquet(f"file://{folder}")
    with pytest.raises(Exception, match="must arrive within one batch"):
        append_stream(contig_stream(spark, str(folder)), path, log).awaitTermination()


def bases(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def bridge(seed, spark, tmp_path, concatenated=False):
    """A reference of one contig and a sample in which one inner splitter is changed."""
    r = random.Random(seed)
    ref = bases(r, 900)
    cuts = sorted(e for e, c in windows(ref).items() if c in splitters([ref]))
    taken = [cuts[0]]
    for e in cuts:
        if e >= taken[-1] + K:
            taken.append(e)
    e = taken[3]
    at = e - K // 2
    other = ref[:at] + {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[at]] + ref[at + 1 :]
    rows = [(0, "s0", 0, "c", "c", ref), (1, "s1", 0, "c", "c", other), (2, "s2", 0, "c", "c", other.translate(COMPLEMENT)[::-1])]
    made = Collection.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/c{seed}{concatenated}", K, SIZE, 15, concatenated=concatenated)
    assert rows_of(made.get_collection()) == [(s, c, q) for s, _, c, _, _, q in rows]
    return made, len(taken)


def test_a_missing_splitter_in_the_middle_is_bridged(spark, tmp_path):
    made, n = bridge(1, spark, tmp_path)
    segments = made.table("segments")
    assert segments.groupBy("sample_ord").count().where(f"count = {n + 1}").count() == 3  # the long segment is cut in two
    assert made.table("groups").where("key2 is not null").count() == n - 1  # no further group is opened
    groups = {s: [r["group_id"] for r in segments.where(f"sample_ord = {s}").orderBy("place").collect()] for s in range(3)}
    assert groups[1][1:-1] == groups[0][1:-1] == groups[2][1:-1][::-1]
    lengths = [r["raw_length"] for r in segments.where("sample_ord = 1").collect()]
    assert sum(lengths) - (len(lengths) - 1) * K == 900
    apart, _ = bridge(1, spark, tmp_path, concatenated=True)
    assert apart.table("groups").where("key2 is not null").count() == n and apart.table("segments").where("sample_ord = 1").count() == n


@pytest.mark.parametrize("size", [SIZE, 20_000])
def test_fallback_finds_groups_of_segments_without_splitters(spark, tmp_path, size):
    r = random.Random(4)
    n = 8 * size
    ref = bases(r, n)
    part = ref[size * 3 + K : size * 4 - 2 * K] if size > SIZE else ref
    known = splitters([ref]) if size == SIZE else None
    if size == SIZE:  # an inner part of a segment holds no splitter
        first, length = segments(ref, known)[3]
        part = ref[first + 3 : first + length - 3]
    rows = [(0, "s0", 0, "c", "c", ref), (1, "s1", 0, "d", "d", part), (2, "s2", 0, "d", "d", part.translate(COMPLEMENT)[::-1])]
    df = spark.createDataFrame(rows, SCHEMA)
    for fallback in (0.0, 0.05):
        made = Collection.create(df, f"file://{tmp_path}/f{size}{fallback}", K, size, 15, fallback=fallback)
        assert rows_of(made.get_collection()) == [(s, c, q) for s, _, c, _, _, q in rows]
        found = {r["sample_ord"]: r for r in made.table("segments").where("sample_ord > 0").collect()}
        if size == SIZE:
            assert {x["group_id"] >= 16 for x in found.values()} == {fallback > 0}
            if fallback:
                assert found[1]["group_id"] == found[2]["group_id"] and found[1]["is_rev_comp"] != found[2]["is_rev_comp"]
                again = made.append(spark.createDataFrame([(0, "s3", 0, "d", "d", part)], SCHEMA))
                more = again.table("segments").where("sample_ord = 3").first()
                # equal codes share an id inside a batch
                assert more["group_id"] == found[1]["group_id"] and found[1]["in_group_id"] == found[2]["in_group_id"]
                assert again.contig_sequence("s3", "d") == part


def test_equal_members_are_stored_once(spark, tmp_path):
    r = random.Random(6)
    ref = bases(r, 700)
    other = ref[:350] + ("A" if ref[350] != "A" else "C") + ref[351:]
    rows = [(i, f"s{i}", 0, "c", "c", ref if i in (0, 3) else other) for i in range(6)]
    made = Collection.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/c", K, SIZE, 15)
    same = made.table("segments").where("group_id >= 16")
    assert same.where("sample_ord = 3 and in_group_id <> 0").count() == 0
    assert made.table("deltas").where("group_id >= 16").count() <= 2
    assert rows_of(made.get_collection()) == [(s, c, q) for s, _, c, _, _, q in rows]
    streams = {x["stream"]: x for x in made.stream_sizes().collect()}
    assert all(x[0] == "x" and x[-1] in "rd" for x in streams) and sum(x["size"] for n, x in streams.items() if n.endswith("r")) == made.sizes().first()["ref_size"]
    keys = [(x["key1"], x["key2"] or "") for x in made.key_map().collect()]
    assert keys == sorted(keys)


def test_splitters_of_a_failed_batch_do_not_count(spark, tmp_path):
    df = spark.createDataFrame(collection(15, 3), SCHEMA)
    made = Collection.create(df.where("sample_ord < 2"), f"file://{tmp_path}/c", K, SIZE, 15)
    wanted = made.append(df.where("sample_ord = 2")).table("segments").where("sample_ord = 2").count()
    again = Collection.create(df.where("sample_ord < 2"), f"file://{tmp_path}/d", K, SIZE, 15)
    windows = spark.createDataFrame([(r[-1][i : i + K],) for r in collection(15, 3) if r[0] == 2 and len(r[-1]) > 500 for i in range(0, 400, 20)], "ck string")
    windows.write.parquet(f"{again.path}/splitters/batch=2")  # a batch that was never committed
    assert again.append(df.where("sample_ord = 2")).table("segments").where("sample_ord = 2").count() == wanted


def test_a_sample_of_two_numbers_is_refused(spark, tmp_path):
    rows = [(0, "s", 0, "c", "c", "ACGT"), (1, "s", 0, "d", "d", "ACGT")]
    with pytest.raises(ValueError, match="twice"):
        Collection.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/c")


def test_create_over_a_collection(spark, tmp_path):
    """Neither mixes with what was there: it is refused, or replaces it whole."""
    df = spark.createDataFrame(collection(16, 4), SCHEMA)
    path = f"file://{tmp_path}/c"
    old = Collection.create(df.where("sample_ord < 2"), path, K, SIZE, 15).append(df.where("sample_ord = 2"))
    other = df.where("sample_ord = 3").withColumn("sample_ord", F.lit(0))
    with pytest.raises(FileExistsError):
        Collection.create(other, path, K, SIZE, 15)
    assert Collection(spark, path).list_samples() == ["s0", "s1", "s2"]
    new = Collection.create(other, path, K, SIZE, 15, overwrite=True)
    assert new.list_samples() == ["s3"] and rows_of(new.get_collection()) == rows_of(other)
    assert old.list_samples() == ["s0", "s1", "s2"] and rows_of(old.get_collection()) == rows_of(df.where("sample_ord < 3"))
    with pytest.raises(ValueError, match="replaced"):
        old.append(df.where("sample_ord = 3"))


def test_two_handles_append(spark, tmp_path):
    """A handle that has not seen the other's batch adds to it; a batch that another one overtakes is made anew."""
    df = spark.createDataFrame(collection(17, 5), SCHEMA)
    one = Collection.create(df.where("sample_ord < 2"), f"file://{tmp_path}/c", K, SIZE, 15)
    two = Collection(spark, one.path)
    one.append(df.where("sample_ord = 2"))
    got = two.append(df.where("sample_ord = 3"))
    assert got.list_samples(False) == ["s0", "s1", "s2", "s3"] and rows_of(got.get_collection()) == rows_of(df.where("sample_ord < 4"))
    with pytest.raises(ValueError, match="already"):
        two.append(df.where("sample_ord = 2"))


def test_a_batch_that_is_overtaken_is_made_anew(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(collection(17, 4), SCHEMA)
    made = Collection.create(df.where("sample_ord < 2"), f"file://{tmp_path}/c", K, SIZE, 15)
    add, tried = Collection._add, []

    def overtaken(self, *a):
        values = add(self, *a)
        tried.append(self.number)
        if len(tried) == 1:  # another writer commits between the data of this one and its commit
            made.append(df.where("sample_ord = 2"))
        return values

    monkeypatch.setattr(Collection, "_add", overtaken)
    got = made.append(df.where("sample_ord = 3"))
    assert tried == [0, 0, 1] and got.list_samples(False) == ["s0", "s1", "s2", "s3"] and rows_of(got.get_collection()) == rows_of(df)
    folders = {p.name for p in (tmp_path / "c/segments").iterdir() if p.is_dir()}
    assert folders == {f"batch={b}" for b in got.batches} and not list((tmp_path / "c/_staging").iterdir())


def test_a_commit_is_made_once(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/c d")
    assert log.latest() == (-1, None)
    assert log.commit(0, {"a": 1}) and not log.commit(0, {"a": 2}) and log.commit(1, {"a": "é"})
    assert log.read(0) == {"a": 1} and log.latest() == (1, {"a": "é"}) and log.numbers() == [0, 1]


def files_read(spark, df):
    """Files and rows that each scan of an executed plan has read, by table."""
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, out = plan.collectLeaves(), {}
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        found = leaf.relation().location().rootPaths().mkString() if "FileSourceScan" in leaf.getClass().getName() else ""
        for table in ("groups", "deltas", "segments"):
            if f"/{table}/" in found:
                out[table] = tuple(out.get(table, (0, 0))[j] + leaf.metrics().get(m).get().value() for j, m in enumerate(("numFiles", "numOutputRows")))
    return out


def test_a_contig_reads_only_its_blocks(spark, tmp_path, monkeypatch):
    """Of over a thousand groups, a range of one contig reads the files and rows that hold its own."""
    from strandlake.operators import archive

    for name, width in (("groups", 32), ("deltas", 32), ("segments", 4), ("contigs", 4)):
        monkeypatch.setitem(archive.BLOCKS, name, (archive.BLOCKS[name][0], width, archive.BLOCKS[name][2]))
    monkeypatch.setattr(archive, "GROUPS_PER_BLOCK", 32)
    r = random.Random(8)
    rows = [(0, "s0", i, f"c{i}", f"c{i}", bases(r, 1500)) for i in range(100)]
    rows += [(1 + i, f"s{1 + i}", 0, "c7", "c7", rows[7][-1][:700] + "A" + rows[7][-1][701:]) for i in range(8)]
    made = Collection.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/c", K, SIZE, 15)
    assert made.table("groups").count() > 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spans = made._asked(made.resolved(["c7@s5:650-800"]).select("query_ord", "sample_ord", "contig_ord", "low", "high"))
        read = files_read(spark, made._assembled(spans, ["query_ord"], few=True))
        every = {t: len(list((tmp_path / f"c/{t}").rglob("*.parquet"))) for t in read}
        own = made._ids(spans.where("start <= high and start + raw_length > low"))
        assert 0 < len(own) < 6
        assert read["groups"][0] <= len(own) and every["groups"] > 30 and read["groups"][1] < 64 * len(own)
        assert read["deltas"][0] <= 8 and read["segments"][0] < every["segments"]
        assert made.contig_sequence("s5", "c7", 650, 800) == rows[-1][-1][650:801]
        # an append of one short sample reads letters of the blocks of its groups only
        touched = archive._touched(made, spark.createDataFrame([(k["key1"], k["key2"]) for k in made.table("groups").where("group_id = 500").collect()], "front string, back string"))
        assert files_read(spark, touched)["groups"][0] < every["groups"] + 10
        assert touched.where("group_id = 500").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sinks_keep_every_record(spark, tmp_path):
    """Parts of several tasks and files make one file in order; gzip has a member for each record."""
    r = random.Random(9)
    rows = [(s, f"s {s}", c, f"c{c}", f"c{c} x", bases(r, 30 + c)) for s in range(3) for c in range(7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    text = lambda of: "".join(f">{x[4]}\n{x[5]}\n" for x in of)
    for most in ("0", "1", "2"):
        spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
        try:
            for level in (0, 6):
                end = ".gz" if level else ""
                read = lambda p: gzip.decompress(p.read_bytes()).decode() if p.suffix == ".gz" else p.read_text()
                value = df.select("sample_ord", "contig_ord", fasta_record(F.col("contig_full"), F.col("seq"), 0).alias("value"))
                one = tmp_path / f"one{most}.fa{end}"
                write_file(value, ["sample_ord", "contig_ord"], f"file://{one}", level)
                assert read(one) == text(rows)
                assert subprocess.run(["gzip", "-t", str(one)]).returncode == 0 if level else True
                if level:
                    assert one.read_bytes().count(b"\x1f\x8b\x08\x00") >= 2 * len(rows)  # each and the empty ones between
                write_samples(df, f"file://{tmp_path}/by{most}", 0, level)
                for s in range(3):
                    assert read(tmp_path / f"by{most}/s {s}.fa{end}") == text([x for x in rows if x[0] == s])
                write_fasta(df, f"file://{tmp_path}/all{most}{end}", 0, level)
                assert "".join(read(p) for p in sorted((tmp_path / f"all{most}{end}").glob("part-*"))) == text(rows)
        finally:
            spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert not [p for p in tmp_path.rglob("*") if "_staging" in p.name or "_joined" in p.name]
    back = spark.read.text(f"file://{tmp_path}/one2.fa").count()
    assert back == 2 * len(rows)
    write_file(df.where("sample_ord > 9").select("sample_ord", F.lit("x").alias("value")), ["sample_ord"], f"file://{tmp_path}/none.fa")
    assert (tmp_path / "none.fa").read_text() == ""


def plainly_cheapest(single, groups, min_match):
    """Every group of a splitter tried for every segment."""
    out = {}
    for s in single:
        own, tried = s["front"] or s["back"], []
        for g in groups:
            if own in (g["key1"], g["key2"]) and g["first_sample"] < s["sample_ord"]:
                forward = (s["front"] is not None) == (own == g["key1"])
                body = s["seq"] if forward else s["seq"].translate(COMPLEMENT)[::-1]
                tried.append((Coder(g["ref_seq"], min_match).cost(body), g["key1"], g["key2"], not forward))
        n = len(s["seq"])
        if tried and min(tried)[0] <= (n if n < 16 else n - 16):
            out[(s["sample_ord"], s["contig_ord"], s["place"])] = min(tried)
    return out


@pytest.mark.parametrize("side", [1 << 24, 600, 60])
def test_cheapest_groups_against_all_candidates(spark, monkeypatch, side):
    """Splitters of many groups and segments, cut in chunks and parts of every size."""
    from strandlake.operators import archive

    monkeypatch.setattr(archive, "SIDE", side)
    r = random.Random(10)
    known = [bases(r, r.randrange(60, 200)) for _ in range(12)]
    ends = [bases(r, K) for _ in range(14)]
    groups = [(*sorted((ends[i % 2], ends[2 + i])), r.randrange(2), t) for i, t in enumerate(known)]

    def changed():
        t = r.choice(known)
        at = r.randrange(len(t))
        t = t[:at] + bases(r, r.randrange(3)) + t[at + r.randrange(3) :]
        return t.translate(COMPLEMENT)[::-1] if r.random() < 0.5 else t

    single = [(s, c, 0, *((ends[r.randrange(3)], None) if r.random() < 0.5 else (None, ends[r.randrange(3)])), t, len(t)) for s in range(1, 4) for c in range(8) for t in [changed()]]
    left = spark.createDataFrame(single, "sample_ord int, contig_ord int, place int, front string, back string, seq string, raw_length long")
    right = spark.createDataFrame(groups, "key1 string, key2 string, first_sample int, ref_seq string")
    got = {(x["sample_ord"], x["contig_ord"], x["place"]): (x["cost"], x["key1"], x["key2"], x["is_rev_comp"]) for x in archive.cheapest_groups(left, right, 15).collect()}
    want = plainly_cheapest([x.asDict() for x in left.collect()], [x.asDict() for x in right.collect()], 15)
    assert want and got == want


def test_cheapest_groups_over_the_given_tables(spark):
    """The registered query against all candidates, over its own data."""
    from strandlake.operators.grouping import ARRIVAL
    from strandlake.plans import codec_queries
    from strandlake.plans.segment_queries import keyed_of
    from strandlake.sources.genome_view import MIN_MATCH

    from .conftest import SMALL

    single = [x.asDict() for x in keyed_of(spark, SMALL).where("(front is null) <> (back is null)").collect()]
    refs = codec_queries.with_references(spark, SMALL).groupBy("key1", "key2").agg(F.min("sample_ord").alias("first_sample"), F.first("ref_seq").alias("ref_seq"))
    got = {tuple(x[c] for c in ARRIVAL): (x["cost"], x["key1"], x["key2"], x["is_rev_comp"]) for x in codec_queries.best_group_one_splitter(spark, SMALL).collect()}
    assert got == plainly_cheapest(single, [x.asDict() for x in refs.collect()], MIN_MATCH)


def test_samples_stay_open_over_batches_and_restarts(spark, tmp_path):
    """A sample over three micro-batches, with a restart between them, is ingested once and whole; so are others beside it."""
    rows = collection(18, 3)
    columns = ["sample", "contig_ord", "contig", "contig_full", "seq"]
    folder, path, log = tmp_path / "in", f"file://{tmp_path}/c", f"file://{tmp_path}/log"
    last = {s: max(r[2] for r in rows if r[0] == s) for s in range(3)}

    def put(some, more=()):
        df = spark.createDataFrame([(*r[1:], r[2] == last[r[0]] and r[0] != 2) for r in some] + list(more), "sample string, contig_ord int, contig string, contig_full string, seq string, closes boolean")
        df.select(*columns, "closes").coalesce(1).write.mode("append").parquet(f"file://{folder}")

    def run():
        append_stream(contig_stream(spark, str(folder), 1, closing=True), path, log, k=K, segment_size=SIZE, min_match=15).awaitTermination()

    own = [[r for r in rows if r[0] == s] for s in range(3)]
    put(own[0] + own[1][:1])
    put(own[1][1:2] + own[2][:2])
    run()
    assert Collection(spark, path).list_samples() == ["s0"]
    put(own[1][2:] + own[2][2:])
    run()
    run()
    assert Collection(spark, path).list_samples() == ["s0", "s1"]
    put([], [("s2", None, None, None, None, True)])
    run()
    made = Collection(spark, path)
    assert len(made.batches) == 3 and {(r["sample"], r["contig_full"], r["seq"]) for r in made.contigs_with_sequences().collect()} == {(r[1], r[4], r[5]) for r in rows}
    assert not list((tmp_path / "c/_open").glob("number=*"))
    put(own[1][:1])
    with pytest.raises(Exception, match="was closed before"):
        run()


def test_bridged_segments_over_the_given_tables(spark):
    """The registered query against every place of every segment, with costs letter by letter."""
    from strandlake.plans import codec_queries
    from strandlake.sources.genome_view import K, MIN_MATCH

    from .conftest import SMALL

    left, right = codec_queries.bridged(spark, SMALL)
    refs = {(g["key1"], g["key2"]): g["ref_seq"] for g in right.collect()}
    other = {}
    for a, b in refs:
        other.setdefault(a, set()).add(b)
        other.setdefault(b, set()).add(a)
    turn = lambda t: t.translate(COMPLEMENT)[::-1]
    want = []
    for s in left.collect():
        shared = other.get(s["front"], set()) & other.get(s["back"], set())
        if not shared or s["front"] == s["back"]:
            continue
        middle, rc = min(shared), s["front"] > s["back"]
        first, last = sorted((s["front"], s["back"]))
        here, n = (turn(s["seq"]) if rc else s["seq"]), len(s["seq"])
        one, two = (Coder(refs[tuple(sorted(x))], MIN_MATCH) for x in ((first, middle), (middle, last)))
        # a letter's cost falls on the first letter of a match on the left, and on the last one on the right
        left_costs = one.costs(here) if first < middle else one.costs(turn(here), at_start=False)[::-1]
        right_costs = two.costs(here, at_start=False) if middle < last else two.costs(turn(here))[::-1]
        sums = [sum(left_costs[: i + 1]) + sum(right_costs[i:]) for i in range(n)]
        at = sums.index(min(sums))
        at = 0 if at < K + 1 else n if at + K + 1 > n else at
        place = (s["sample_ord"], s["contig_ord"], s["place"])
        if at in (0, n):
            a, b = (middle, last) if at == 0 else (first, middle)
            want.append((*place, s["start"], 0, 0, n, min(a, b), max(a, b), rc == (a < b)))
        else:
            cut = (n - at if rc else at) - K // 2
            want.append((*place, s["start"], 0, 0, cut + K, *sorted((s["front"], middle)), s["front"] > middle))
            want.append((*place, s["start"] + cut, 1, cut, n - cut, *sorted((middle, s["back"])), middle > s["back"]))
    assert sorted(map(tuple, codec_queries.bridged_splits(spark, SMALL).collect())) == sorted(want)


def test_steps_of_a_batch_read_what_they_need(spark, tmp_path, monkeypatch):
    """Bridging gets only segments of pairs that stay shut and groups at their ends; an append stores the groups that it
    touches, and letters are joined once places are known."""
    from strandlake.operators import archive

    seen, stored = [], {}
    real, stage = archive.through_middle, archive._stage

    def middle(lacking, groups, *a):
        seen.append(({(x[0], x[1]) for x in lacking.select("key1", "key2").collect()}, {(x[0], x[1]) for x in groups.select("key1", "key2").collect()}))
        return real(lacking, groups, *a)

    def kept(df, path, batch, name):
        stored.setdefault(name, []).append(df.inputFiles())
        return stage(df, path, batch, name)

    monkeypatch.setattr(archive, "through_middle", middle)
    monkeypatch.setattr(archive, "_stage", kept)
    made, n = bridge(3, spark, tmp_path)
    ((pairs, groups),) = seen
    ends = {e for p in pairs for e in p}
    assert len(pairs) == 1 and 2 <= len(groups) < n - 1 and all(ends & set(g) for g in groups)
    more = made.get_collection().where("sample_ord = 1").select(F.lit(0).alias("sample_ord"), F.lit("s3").alias("sample"), "contig_ord", F.lit("c").alias("contig"), "contig_full", "seq")
    made.append(more)
    assert len(stored["touched"]) == 1
    # groups that one-sided segments are compared with are read from there, not from the collection
    assert stored["sides"][1] and not [f for f in stored["sides"][1] if "/groups/" in f]
