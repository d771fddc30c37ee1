import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.operators import grouping, kmers, segmentation

COMPLEMENT = str.maketrans("ACGT", "TGCA")
K, SIZE = 17, 100
SCHEMA = "sample_ord int, sample string, contig_ord int, contig string, contig_full string, seq string"


def canonical(s):
    return min(s, s.translate(COMPLEMENT)[::-1])


def windows(seq, k=K):
    return {i + k - 1: canonical(seq[i : i + k]) for i in range(len(seq) - k + 1) if set(seq[i : i + k]) <= set("ACGT")}


def splitters(reference):
    count = Counter(c for s in reference for c in windows(s).values())
    out = set()
    for s in reference:
        w = windows(s)
        candidates = [e for e in sorted(w) if count[w[e]] == 1]
        taken = []
        for e in candidates:
            if not taken or e >= taken[-1] + SIZE:
                taken.append(e)
        if taken and candidates[-1] >= taken[-1] + K:
            taken.append(candidates[-1])
        out |= {w[e] for e in taken}
    return out


def segments(seq, known):
    w, taken = windows(seq), []
    for e in sorted(w):
        if w[e] in known and (not taken or e >= taken[-1] + K):
            taken.append(e)
    starts = [0, *[e + 1 - K for e in taken]]
    ends = [*taken, len(seq) - 1]
    return [(a, b - a + 1) for a, b in zip(starts, ends, strict=True)] if seq else []


def collection(seed, n=4):
    r = random.Random(seed)
    base = ["".join(r.choice("ACGT") for _ in range(m)) for m in (1500, 700, 30, 5)]
    base[1] = base[1][:200] + "N" * 50 + base[1][200:]
    rows = []
    for s in range(n):
        for c, seq in enumerate(base):
            letters = list(seq)
            for i in range(len(letters)):
                if s and r.random() < 0.01:
                    letters[i] = r.choice("ACGTNR")
            seq = "".join(letters)
            if s == 2 and c == 0:
                seq = seq.translate(COMPLEMENT)[::-1]
            if s == 3 and c == 1:
                seq = seq[:300] + seq[340:]
            rows.append((s, f"s{s}", c, f"c{c}", f"c{c} of s{s}", seq))
    rows.append((n - 1, f"s{n - 1}", 9, "empty", "empty", ""))
    rows.append((n - 1, f"s{n - 1}", 10, "alone", "alone", "".join(r.choice("ACGT") for _ in range(400))))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splitters_and_segments(spark, seed):
    rows = collection(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    found = segmentation.select_splitters(df.where("sample_ord = 0"), K, SIZE)
    known = {r["ck"] for r in found.collect()}
    assert known == splitters([r[-1] for r in rows if r[0] == 0])
    got = {}
    for r in segmentation.segments(df, found, K).collect():
        got.setdefault((r["sample_ord"], r["contig_ord"]), []).append((r["place"], r["start"], r["raw_length"]))
    want = {(r[0], r[2]): [(i, a, n) for i, (a, n) in enumerate(segments(r[-1], known))] for r in rows if r[-1]}
    assert {k: sorted(v) for k, v in got.items()} == want
    for (s, c), parts in want.items():
        seq = next(r[-1] for r in rows if (r[0], r[2]) == (s, c))
        assert len(seq) == sum(n for *_, n in parts) - (len(parts) - 1) * K


def test_pieces_do_not_change_kmers(spark, monkeypatch):
    rows = collection(5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, kmers.canonical_kmers(df, K).collect()))
    cut = kmers.pieces
    monkeypatch.setattr(kmers, "pieces", lambda c, k: cut(c, k, 64))
    assert sorted(map(tuple, kmers.canonical_kmers(df, K).collect())) == want
    assert len(want) == sum(len(windows(r[-1])) for r in rows)


def test_numbering_is_consecutive_and_ordered(spark):
    r = random.Random(0)
    rows = list({(r.randrange(50), r.randrange(20), r.randrange(5)) for _ in range(500)})
    df = spark.createDataFrame(rows, "sample_ord int, contig_ord int, place int")
    got = grouping.numbered(df, list(grouping.ARRIVAL), 16).collect()
    assert [tuple(x)[:3] for x in sorted(got, key=lambda x: x["group_id"])] == sorted(rows)
    assert sorted(x["group_id"] for x in got) == list(range(16, 16 + len(rows)))


def test_best_split(spark):
    r = random.Random(1)
    rows = [(i, [r.randrange(5) for _ in range(60)], [r.randrange(5) for _ in range(60)]) for i in range(30)]
    got = {x["id"]: (x["cost"], x["split"]) for x in grouping.best_split(spark.createDataFrame(rows, "id int, cost1 array<bigint>, cost2 array<bigint>"), K).collect()}
    for i, a, b in rows:
        sums = [sum(a[: j + 1]) + sum(b[j:]) for j in range(60)]
        at = sums.index(min(sums))
        at = 0 if at < K + 1 else 60 if at + K + 1 > 60 else at
        assert got[i] == (min(sums), at)


def test_partners_and_middle(spark):
    keyed = spark.createDataFrame([("A", "B"), ("B", "C"), ("B", "B"), (None, None)], "key1 string, key2 string")
    lists = grouping.partners(keyed)
    assert {r["ck"]: r["partners"] for r in lists.collect()} == {"A": ["B"], "B": ["A", "B", "C"], "C": ["B"]}
    pairs = spark.createDataFrame([("A", "C"), ("A", "B"), ("A", "Z")], "front string, back string")
    assert sorted(map(tuple, grouping.middle_candidates(pairs, lists).select("front", "back", "middle").collect())) == [("A", "B", "B"), ("A", "C", "B")]


def test_fallback_candidates(spark):
    rows = [(0, 0, 0, f"k{i:02d}", "z", False, v) for i, v in enumerate([9, 8, 8, 7, 6, 5, 5, 5, 5, 5, 5, 5, 4, 1])]
    votes = spark.createDataFrame(rows, "sample_ord int, contig_ord int, place int, key1 string, key2 string, is_rev_comp boolean, votes long")
    got = grouping.best_candidates(votes, least=2).orderBy("rank").collect()
    assert [r["votes"] for r in got] == [9, 8, 8, 7, 6, 5, 5, 5, 5, 5]
    assert got[1]["key1"] == "k02" and F is not None


def test_equal_candidates_of_both_directions_have_a_fixed_order(spark):
    """A key of two equal k-mers with as many votes in both directions: the SQL's order leaves open which goes first."""
    rows = [(0, c, 0, k, k, rc, 3) for c in range(30) for k in ("a", "b", "d") for rc in (True, False)] + [(0, c, 0, "c", "c", True, 4) for c in range(30)]
    for n in (1, 7):
        votes = spark.createDataFrame(rows[::n] + [x for i, x in enumerate(rows) if i % n], "sample_ord int, contig_ord int, place int, key1 string, key2 string, is_rev_comp boolean, votes long").repartition(n)
        got = grouping.best_candidates(votes, most=4).collect()
        want = {("c", True, 1), ("d", False, 2), ("d", True, 3), ("b", False, 4)}
        assert len(got) == 120 and {(r["key1"], r["is_rev_comp"], r["rank"]) for r in got} == want


def test_many_wanted_kmers_pass_a_filter(spark, monkeypatch):
    """Above the number that is sent, only windows that pass the filter are joined; the result is the same."""
    df = spark.createDataFrame(collection(21, 3), SCHEMA)
    r = random.Random(22)
    some = [c for row in collection(21, 1) for c in list(windows(row[-1]).values())[::9]]
    wanted = spark.createDataFrame([(canonical("".join(r.choice("ACGT") for _ in range(K))),) for _ in range(3000)] + [(c,) for c in some], "ck string")
    rows = lambda found: sorted(map(tuple, found.collect()))
    want = rows(kmers.windows_of(df, wanted, K))
    monkeypatch.setattr(kmers, "MOST_SENT", 10)
    monkeypatch.setattr(kmers, "FILTER_SLICE", 64)
    assert want and rows(kmers.windows_of(df, wanted, K)) == want
    values = wanted.select(kmers.kmer_value(F.col("ck"), K).alias("ck")).distinct()
    passed = rows(kmers.maybe_windows_of(df, values, values.count(), K))
    assert set(want) <= set(passed) and len(passed) < 1.1 * len(want) + 20
    full = rows(kmers.coded_kmers(df, K))
    assert len(full) > 5 * len(passed)
    monkeypatch.setattr(kmers, "MOST_BITS", 64)  # a filter that is far too small lets more through, and the join decides
    assert rows(kmers.windows_of(df, wanted, K)) == want


def test_votes_are_counted_in_cells(spark, tmp_path, monkeypatch):
    """Of any number of blocks, also with both directions of a k-mer in a segment and in a group; pairs are not shuffled."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("ACGT") for _ in range(5))
    words = [word() for _ in range(6)]
    keys = sorted({tuple(sorted((r.choice(words), r.choice(words)))) for _ in range(12)})
    mapped = sorted({(ck, *r.choice(keys), r.random() < 0.5) for ck in range(20) for _ in range(9)})
    own = [(r.randrange(2), r.randrange(3), r.randrange(600), r.randrange(20), r.random() < 0.5) for _ in range(900)]
    spans = [(s, c, p, 100 * p, 100) for s in range(2) for c in range(3) for p in range(6)]
    want = {}
    for s, c, end, ck, here in own:
        for x, k1, k2, forward in mapped:
            if x == ck and end % 100 >= 4:
                want.setdefault((s, c, end // 100, k1, k2, here != forward), set()).add(ck)
    want = {(*at, len(cks)) for at, cks in want.items()}
    sampled = spark.createDataFrame(own, "sample_ord int, contig_ord int, end long, ck long, forward boolean")
    segments = spark.createDataFrame(spans, "sample_ord int, contig_ord int, place int, start long, raw_length long")
    groups = spark.createDataFrame(mapped, "ck long, key1 string, key2 string, forward boolean")
    for held, counted in ((1 << 21, 1 << 21), (20, 7)):
        monkeypatch.setattr(grouping, "HELD", held)
        monkeypatch.setattr(grouping, "COUNTED", counted)
        keep = lambda df, name: _kept(df, f"{tmp_path}/{held}-{name}")
        votes = grouping.fallback_votes(sampled, segments, groups, 5, keep)
        assert votes.count() == len(want) and {tuple(x) for x in votes.collect()} == want
        assert "SortMergeJoin" not in (plan := votes._jdf.queryExecution().executedPlan().toString()) and "HashAggregate" not in plan
        few = grouping.fallback_votes(sampled, segments, groups, 5, lambda df, name: keep(df, f"few-{name}"), 2, 3)
        best = lambda rows: {tuple(x) for x in grouping.best_candidates(rows, 2, 3).collect()}
        assert best(few) == best(votes) and len(best(few)) > len(spans)


def test_votes_of_a_key_follow_one_another(spark, tmp_path, monkeypatch):
    """A key's rows are stored in few bytes, however many keys there are: they are not scattered over the rows of segments."""
    r = random.Random(8)
    names = sorted({"".join(r.choice("ACGT") for _ in range(5)) for _ in range(60)})
    mapped = [(ck, *sorted(r.sample(names, 2)), r.random() < 0.5) for ck in range(40) for _ in range(6)]
    own = [(0, c, r.randrange(4, 100), r.randrange(40), r.random() < 0.5) for c in range(80) for _ in range(10)]
    sampled = spark.createDataFrame(own, "sample_ord int, contig_ord int, end long, ck long, forward boolean")
    segments = spark.createDataFrame([(0, c, 0, 0, 100) for c in range(80)], "sample_ord int, contig_ord int, place int, start long, raw_length long")
    groups = spark.createDataFrame(mapped + mapped[:99], "ck long, key1 string, key2 string, forward boolean")  # repeated rows count once
    want = {}
    for s, c, _, ck, here in own:
        for x, k1, k2, forward in mapped:
            if x == ck:
                want.setdefault((s, c, 0, k1, k2, here != forward), set()).add(ck)
    for passed, counted in ((1 << 16, 1 << 21), (50, 7)):
        monkeypatch.setattr(grouping, "PASSED", passed)
        monkeypatch.setattr(grouping, "COUNTED", counted)
        votes = grouping.fallback_votes(sampled, segments, groups, 5, lambda df, name: _kept(df, f"{tmp_path}/{passed}-{name}"))
        rows = votes.select("*", F.spark_partition_id().alias("at")).collect()
        assert sorted(tuple(x)[:-1] for x in rows) == sorted((*at, len(cks)) for at, cks in want.items())
        keys = [(x["at"], x["key1"], x["key2"]) for x in rows]
        runs = 1 + sum(x != y for x, y in zip(keys, keys[1:]))
        assert runs <= 2 * len(set(keys)) < len(rows) / 2


def test_votes_read_the_texts_once_and_store_letters_once(spark, monkeypatch):
    from strandlake.plans import segment_queries

    from .conftest import SMALL

    stored, made = {}, []
    stored_in, contigs_of = segment_queries.stored_in, segment_queries.contigs_of

    def noted(where):
        keep = stored_in(where)
        return lambda df, name: stored.setdefault(name, df.columns) and keep(df, name)

    monkeypatch.setattr(segment_queries, "stored_in", noted)
    monkeypatch.setattr(segment_queries, "contigs_of", lambda *a: made.append(a) or contigs_of(*a))
    assert segment_queries.fallback_votes(spark, SMALL).count()
    assert len(made) == 1 and [name for name, columns in stored.items() if "seq" in columns] == ["contigs"]


def _kept(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_tasks_of_kmers_grow_with_the_letters(spark, monkeypatch):
    """No task counts or joins more k-mers for a larger input: their number follows the letters, and the result is the same."""
    df = spark.createDataFrame(collection(31, 4), SCHEMA)
    known = spark.createDataFrame([("A" * K,)], "ck string")
    reference = df.where("sample_ord = 0")
    rows = lambda found: sorted(map(tuple, found.collect()))
    want = rows(segmentation.select_splitters(reference, K, SIZE)), rows(segmentation.adaptive_splitters(df, known, reference, K, SIZE))
    assert want[0] and want[1]
    monkeypatch.setattr(kmers, "TASK", 500)
    letters = df.agg(F.sum(F.char_length("seq"))).first()[0]
    tasks = kmers.tasks_for(spark, letters)
    assert tasks == -(-letters // 500) > 4 and kmers.tasks_for(spark, 10) == 4
    split, new = segmentation.select_splitters(reference, K, SIZE, tasks), segmentation.adaptive_splitters(df, known, reference, K, SIZE, tasks)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ck#" in plan and f", {tasks})" in plan
    assert (rows(split), rows(new)) == want


def test_frequent_kmers_are_few_rows(spark):
    rows = [(s, f"s{s}", c, f"c{c}", f"c{c}", "A" * 400 + q) for s, _, c, _, _, q in collection(33, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    many = kmers.coded_kmers(df, K).where("ck = 0").count()
    for by_piece, most in ((False, 4), (True, len(rows))):
        found = kmers.counted_kmers(df, K, by_piece=by_piece)
        assert found.where("ck = 0").count() <= most < many and found.where("ck = 0").agg(F.sum("n")).first()[0] == many
        assert found.agg(F.sum("n")).first()[0] == kmers.coded_kmers(df, K).count()


def test_adaptive_splitters_deal_kmers_by_letters(spark, monkeypatch):
    from strandlake.plans import segment_queries

    from .conftest import SMALL

    monkeypatch.setattr(kmers, "TASK", 3000)
    df = segment_queries.adaptive_splitters(spark, SMALL)
    assert not [f for f in df.inputFiles() if "documents" in f]  # contigs are made once
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_windows_are_counted_without_a_row_each(spark, monkeypatch):
    """Splitters from lists of places: k-mers are dealt in rows of bytes, and those that come once are the same."""
    df = spark.createDataFrame(collection(37, 2), SCHEMA).where("sample_ord = 0")
    counts, places = {}, {}
    for r in kmers.coded_kmers(df, K).collect():
        counts[r["ck"]] = counts.get(r["ck"], 0) + 1
        places[r["ck"]] = r["contig_ord"], r["end"]
    for tasks in (None, 5):
        found = kmers.single_places(df, K, 100, tasks)
        assert sorted((r["contig_ord"], e) for r in found.collect() for e in r["ends"] if e // 100 == r["part"]) == sorted(places[ck] for ck, n in counts.items() if n == 1)
    dealt = []
    monkeypatch.setattr(kmers, "counted_kmers", lambda *a, **k: dealt.append(a))
    monkeypatch.setattr(segmentation, "counted_kmers", lambda *a, **k: dealt.append(a))
    assert segmentation.select_splitters(df, K, SIZE).count() and not dealt


@pytest.mark.parametrize("tasks", [None, 5])
def test_places_of_a_part_are_one_list(spark, tasks):
    """Single k-mers of a part of a contig are found by many tasks and come in one sorted list."""
    df = spark.createDataFrame(collection(37, 2), SCHEMA).where("sample_ord = 0")
    found = kmers.single_places(df, K, 100, tasks).collect()
    parts = [(r["sample_ord"], r["contig_ord"], r["part"]) for r in found]
    assert len(parts) > 5 and len(parts) == len(set(parts))
    assert all(r["ends"] == sorted(set(r["ends"])) and {e // 100 for e in r["ends"]} == {r["part"]} for r in found)
