import random

import numpy as np
import pytest

from strandlake.llm import decontaminate as op

from .conftest import prose

ITEMS = [(1, prose(50, 25)), (2, "One TWO, three!"), (2, "one two three"), (3, None), (4, "..."), (5, prose(51, 10)), (None, "alpha beta gamma delta epsilon"), (10, prose(50, 25))]
DOCS = [
    (1, "intro " + prose(50, 25) + " end"),
    (2, " ".join(prose(50, 25).split()[3:13]).upper()),
    (3, " ".join(prose(50, 25).split()[3:12])),
    (4, "start one-two...three one two"),
    (5, None),
    (6, ""),
    (7, "alpha beta gamma delta epsilon alpha beta gamma delta epsilon"),
    (8, prose(51, 10) + " " + prose(51, 10)),
    (8, prose(60, 5)),
    (9, "naïve ÉCLAIR one two three é"),
    (10, prose(70, 5000) + " " + prose(51, 10) + " " + prose(71, 5000)),
]


@pytest.mark.parametrize("block", [1_000_000, 8])
def test_against_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in op.digest(op.match_items(docs, items, block_words=block)).collect()]
    want = [(d, *op.reference_digest([(d, t)], ITEMS)[d]) for d, t in DOCS]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_are_those_of_the_pattern():
    import re

    text = "A-Z, a_b c'd É…x\x00y\x7fz 1.5 ~tilde{} naïve"
    assert [w.decode() for w in op.words(text.encode())] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_empty_tables(spark, nothing, documents, awkward):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert op.match_items(nothing, items).collect() == []
    rows = op.digest(op.match_items(documents, none)).collect()
    assert len(rows) == len(awkward) and not any(r["contaminated"] for r in rows) and max(r["n_words"] for r in rows) == 30_000


def test_dropping_keeps_all_columns(clashing, spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = op.drop_contaminated(clashing, items)
    assert out.columns == clashing.columns
    assert {r["doc_id"] for r in clashing.collect()} - {r["doc_id"] for r in out.collect()} == {8, 9}


@pytest.mark.parametrize("seed", range(4))
def test_random_passages_against_brute_force(spark, seed):
    """Few distinct words, so shingles are frequent, tie in rarity, and occur in many windows and items."""
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(f"i{i}", some(r.choice([1, 2, 4, 5, 9, 10, 11, 14]))) for i in range(12)] + [("i3", some(12)), (None, some(10))]
    docs = [(i, some(r.choice([0, 3, 9, 10, 40, 120]))) for i in range(40)]
    want = op.reference_digest(docs, items)
    for block in (1_000_000, 12):
        df = op.digest(op.match_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_words=block))
        assert {r["doc_id"]: tuple(r)[1:] for r in df.collect()} == want


def test_the_rarest_shingle_is_looked_up():
    item = b"a b c d e f g h i j k"
    block = op.Windows([("x", item)], 10, 5)
    assert len(block.start) == 2 and len(block.codes[5]) == 7
    given = op._codes(block.hashes, 5)
    counts = np.array([5] * 7)
    counts[np.searchsorted(block.codes[5], given[3])] = 1  # d e f g h, in both windows
    block.order({5: counts})
    codes, begin, window, offset = block.prefix[5]
    assert codes.tolist() == [given[3]] and begin.tolist() == [0, 2]
    assert {(block.start[w], o) for w, o in zip(window.tolist(), offset.tolist(), strict=True)} == {(0, 3), (1, 2)}


def test_what_is_sent_is_bounded():
    import pickle

    r = random.Random(1)
    items = [(str(i), " ".join(str(r.randrange(10**6)) for _ in range(200)).encode()) for i in range(500)]
    block = op.Windows(items, 10, 5)
    block.order({k: np.zeros(len(c), dtype=np.int64) for k, c in block.codes.items()})
    assert len(pickle.dumps(block)) < 80 * 100_000


def test_blocks_hold_no_more_words_than_asked(spark):
    items = [("a", "w " * 95), ("b", "-".join("xyz") * 20), ("c", None), ("d", "one"), ("e", "v " * 10)]
    df = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    blocks = list(op._blocks(df, 30, 10))
    sizes = [sum(len(op.words(t)) for _, t in b) for b in blocks]
    assert max(sizes) <= 30 and {i for b in blocks for i, _ in b} == {"a", "b", "c", "d", "e"}
    assert sum(max(0, len(op.words(t)) - 9) for b in blocks for i, t in b if i == "a") == 95 - 9  # every window once


def test_very_long_words_are_told_apart(spark):
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
    docs = [(1, f"x {a} y"), (2, f"x {b} y")]
    got = op.digest(op.match_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", a)], "item_id string, text string")))
    assert {r["doc_id"]: r["n_hit"] for r in got.collect()} == {1: 1, 2: 0}
