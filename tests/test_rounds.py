"""Rounds of samples: what a segment sees, and which groups a round opens."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from strandlake.operators import grouping
from strandlake.operators.archive import Collection

from .test_segmentation import COMPLEMENT, K, SCHEMA, SIZE, splitters, windows


def kept(spark, folder, names):
    """Stores a table and reads it back; ``names`` gets what was stored."""

    def keep(df, name):
        names.append(name)
        path = f"file://{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def simulated(firsts, settled):
    """Round after round, literally: pairs that open a group."""
    known, opened = set(settled), set()
    for now in sorted({r for _, _, r in firsts}):
        partners = {}
        for a, b in known:
            partners.setdefault(a, set()).add(b)
            partners.setdefault(b, set()).add(a)
        new = {(a, b) for a, b, r in firsts if r == now and (a == b or not partners.get(a, set()) & partners.get(b, set()))}
        known |= new
        opened |= new
    return opened


@pytest.mark.parametrize("seed", range(4))
def test_opened_pairs_against_a_literal_simulation(spark, tmp_path, seed):
    r = random.Random(seed)
    names = [f"{i:02d}" for i in range(12 + 10 * seed)]
    pairs = {tuple(sorted((r.choice(names), r.choice(names)))) for _ in range(60 + 60 * seed)}
    pairs = sorted(pairs)
    r.shuffle(pairs)
    settled, firsts = pairs[: 4 * seed], [(*p, r.randrange(4 + 5 * seed)) for p in pairs[4 * seed :]]
    rows = spark.createDataFrame([(*x, "extra") for x in firsts], "key1 string, key2 string, round int, more string")
    got = grouping.opened_in_rounds(rows, spark.createDataFrame(settled, "key1 string, key2 string"), kept(spark, tmp_path, []))
    assert got.columns == rows.columns
    want = simulated(firsts, settled)
    assert {(x["key1"], x["key2"]) for x in got.collect()} == want and len(want) < len(firsts)


def test_a_thousand_rounds_take_few_steps(spark, tmp_path):
    r = random.Random(9)
    pairs = {tuple(sorted(r.sample([f"{i:03d}" for i in range(150)], 2))) for _ in range(1500)}
    firsts = [(*p, r.randrange(1000)) for p in sorted(pairs)]
    names = []
    got = grouping.opened_in_rounds(spark.createDataFrame(firsts, "key1 string, key2 string, round int"), spark.createDataFrame([], "key1 string, key2 string"), kept(spark, tmp_path, names))
    assert {(x["key1"], x["key2"]) for x in got.collect()} == simulated(firsts, [])
    assert len(names) < 20


def test_no_pairs(spark, tmp_path):
    none = spark.createDataFrame([], "key1 string, key2 string, round int")
    assert grouping.opened_in_rounds(none, none.drop("round"), kept(spark, tmp_path, [])).count() == 0


def rearranged(seed, n_samples):
    """A reference, and samples of its pieces in other orders and directions, with letters changed."""
    r = random.Random(seed)
    ref = "".join(r.choice("ACGT") for _ in range(1600))
    cuts = sorted(e for e, c in windows(ref).items() if c in splitters([ref]))
    pieces = [ref[max(0, a - K + 1) : b + 1] for a, b in zip(cuts, cuts[1:], strict=False) if b - a > K]
    rows = [(0, "s0", 0, "c", "c", ref)]
    for s in range(1, n_samples):
        taken = [r.choice(pieces) for _ in range(5)]
        taken = [p if r.random() < 0.7 else p.translate(COMPLEMENT)[::-1] for p in taken]
        text = list("".join(taken))
        for _ in range(6):
            text[r.randrange(len(text))] = r.choice("ACGT")
        rows += [(s, f"s{s}", 0, "c", "c", "".join(text)), (s, f"s{s}", 1, "d", "d", "".join(r.choice(pieces)[: r.randrange(60, 200)]))]
    return rows


def shape(made):
    groups = sorted(map(tuple, made.table("groups").select("group_id", "key1", F.coalesce("key2", F.lit("")), "ref_seq").collect()))
    return groups, sorted(map(tuple, made.table("segments").select("sample_ord", "contig_ord", "place", "start", "raw_length", "group_id", "is_rev_comp").collect()))


@pytest.mark.parametrize(("seed", "fallback"), [(1, None), (2, 0.05)])
def test_a_call_gives_the_groups_of_a_call_per_sample(spark, tmp_path, seed, fallback):
    rows = rearranged(seed, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    once = Collection.create(df, f"file://{tmp_path}/once", K, SIZE, 15, fallback=fallback)
    each = Collection.create(df.where("sample_ord = 0"), f"file://{tmp_path}/each", K, SIZE, 15, fallback=fallback)
    for s in range(1, 6):
        each = each.append(df.where(F.col("sample_ord") == s))
    assert shape(once) == shape(each)
    assert sorted((x["sample_ord"], x["contig_ord"], x["seq"]) for x in once.get_collection().collect()) == sorted((x[0], x[2], x[-1]) for x in rows)


def test_rounds_of_concatenated_contigs(spark, tmp_path):
    rows = [(i, f"t{i}", 0, f"t{i}", f"t{i}", x[-1]) for i, x in enumerate(rearranged(3, 4))]
    df = spark.createDataFrame(rows, SCHEMA)
    once = Collection.create(df, f"file://{tmp_path}/once", K, SIZE, 15, pack_cardinality=3, concatenated=True)
    each = Collection.create(df.where("sample_ord < 3"), f"file://{tmp_path}/each", K, SIZE, 15, pack_cardinality=3, concatenated=True)
    each = each.append(df.where("sample_ord between 3 and 5")).append(df.where("sample_ord > 5"))
    assert shape(once) == shape(each)
