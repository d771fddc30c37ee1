import collections
import math
import random
import re

import numpy as np
import pytest

from strandlake.llm import near_dup as op
from strandlake.llm.components import connected_components

from .conftest import prose


def links_by_tfidf(rows, idf=True):
    """Pairs of rows whose TF-IDF vectors, with shingles, counts and weights made here, have a similarity of 0.8."""
    words = {i: re.findall("[^\\x20\\x09-\\x0D]+", t or "") for i, t in rows}
    bags = {i: collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)) if w) for i, w in words.items()}
    df = collections.Counter(s for bag in bags.values() for s in bag)
    vectors = {i: {s: n * (1 + math.log(len(rows) / df[s]) if idf else 1) for s, n in bag.items()} for i, bag in bags.items()}
    like = lambda x, y: sum(min(x[s], y[s]) for s in x.keys() & y.keys()) / sum(max(x.get(s, 0), y.get(s, 0)) for s in x.keys() | y.keys())
    return {(a, b): like(vectors[a], vectors[b]) for a in vectors for b in vectors if b < a and vectors[a] and vectors[b] and like(vectors[a], vectors[b]) >= 0.8}


def brute(rows):
    """(id, class id) of every row by comparing all pairs of texts; nothing here comes from the operator."""
    numbered = [(n, t or "") for n, (_, t) in enumerate(rows)]
    links = set(links_by_tfidf(numbered)) | {(a, b) for a, x in numbered for b, y in numbered if b < a and x == y}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    least = {}
    for n, (i, _) in enumerate(rows):
        at = least.setdefault(find(n), [])
        at.append((i is not None, i or 0, i))
    return sorted(((i, min(least[find(n)])[2]) for n, (i, _) in enumerate(rows)), key=str)


def run(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in op.near_duplicates(df).collect()), key=str)


def test_awkward_documents(documents, clashing, nothing, awkward):
    want = brute([(d, t) for d, t, _, _ in awkward])
    assert run(documents) == want and run(clashing) == want
    assert run(nothing) == []


def family(seed, n, copies):
    r = random.Random(seed)
    out = []
    for f in range(n):
        words = prose(seed * 100 + f, 150).split()
        for c in range(copies):
            w = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_near_copies(spark, seed):
    texts = family(seed, 6, 12) + [prose(900 + i, 60) for i in range(40)]
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_common_passages_do_not_join_documents(spark):
    passage = prose(7, 60)
    rows = [(i, passage + " " + prose(300 + i, 60)) for i in range(40)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows) == sorted(((i, i) for i in range(40)), key=str)


def test_samples_collide_as_often_as_weights_agree():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = rng.integers(1, 4, 400).astype(float), rng.integers(1, 4, 400).astype(float)
    a[:60], b[60:120] = 0, 0
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x = op.signature(h[a > 0], a[a > 0], 3000)
    y = op.signature(h[b > 0], b[b > 0], 3000)
    assert abs((x == y).mean() - true) < 0.04


def test_texts_that_differ_only_in_the_order_of_letters_of_long_words(spark):
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
    rows = [(1, " ".join([a] * 30)), (2, " ".join([b] * 30)), (3, " ".join([a] * 29 + ["x"]))]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_of_each_class_stays(clashing, awkward):
    out = op.keep_one(clashing)
    assert out.columns == clashing.columns
    classes = brute([(d, t) for d, t, _, _ in awkward])
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted({c for _, c in classes}, key=str)


def test_different_texts_of_one_id_or_none_stay(spark):
    texts = [prose(40 + i, 50) for i in range(4)]
    near = texts[0].replace(texts[0].split()[49], "changed", 1)
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (9, texts[0]), (9, near)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `a.b` string").repartition(3)
    assert run(df) == brute(rows)
    out = op.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])], key=str)


def test_hot_texts_and_classes_are_spread(spark, monkeypatch):
    """Joins on keys of many rows go the way of hot keys."""
    from strandlake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "MOST_HOT", 10)
    monkeypatch.setattr(op, "_BLOCK_DOCS", 2)
    base = prose(5, 120).split()
    texts = [" ".join(base)] * 20 + [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(0, 110, 5)] + [prose(100 + i, 40) for i in range(10)]
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == brute(rows)
    assert sorted(r["doc_id"] for r in op.keep_one(df).collect()) == sorted({c for _, c in brute(rows)})


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_every_document_frequency_weighs(spark):
    common, pair, ends = prose(71, 100), prose(72, 100), [prose(73, 13), prose(74, 13)]
    # five texts that plain counts join: what they share is in five documents of eighty, below a tenth
    texts = [f"{common} {prose(800 + i, 10)}" for i in range(5)]
    # two that plain counts part: what they share is in two documents, what they do not in seven
    texts += [f"{pair} {e}" for e in ends] + [f"{e} {prose(820 + 10 * k + i, 80)}" for k, e in enumerate(ends) for i in range(6)]
    rows = list(enumerate(texts + [prose(900 + i, 60) for i in range(61)]))
    want = links_by_tfidf(rows)
    assert set(want) == {(6, 5)} and set(links_by_tfidf(rows, idf=False)) == {(a, b) for a in range(5) for b in range(a)}
    got = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got if r["doc_id"] != r["class_id"]} == set(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_frequencies_cross_blocks(spark, monkeypatch, seed):
    """Small blocks and many buckets, so that shingles meet across both."""
    monkeypatch.setattr(op, "_BLOCK_DOCS", 2)
    monkeypatch.setattr(op, "_BUCKET_BYTES", 300)
    rows = list(enumerate(family(seed, 4, 9) + [prose(950 + i, 40) for i in range(12)]))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_packed_words_come_back():
    rng = np.random.default_rng(2)
    for n, high in ((1, 1 << 40), (5, 10), (900, 1 << 14), (900, 1 << 31), (900, (1 << 64) - 1)):
        x = np.unique(rng.integers(0, high, n, dtype=np.uint64))
        assert (op._unpacked(op._packed(x)) == x).all()


def test_a_table_without_words(spark):
    assert run(spark.createDataFrame([(1, ""), (2, None), (3, " ")], "doc_id long, text string")) == [(1, 1), (2, 1), (3, 3)]


def test_classes_of_one_id_are_told_apart(spark):
    """Documents of one id, or of none, in classes without a common text."""
    one, two, three, four = (prose(s, 80) for s in (90, 91, 92, 93))
    near = lambda t: t.replace(t.split()[40], "changed", 1)
    rows = [(1, one), (1, two), (5, near(one)), (7, near(two)), (None, three), (None, four), (8, near(three)), (9, four), (1, prose(94, 60)), (20, prose(95, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(i) for i, _ in rows)
    groups = collections.defaultdict(list)
    for r in got:
        assert r["class_id"] is not None
        groups[r["class_id"]].append(r["doc_id"])
    want = [[1, 5], [1, 7], [None, 8], [None, 9], [1], [20]]
    assert sorted(map(str, (sorted(g, key=str) for g in groups.values()))) == sorted(map(str, (sorted(g, key=str) for g in want)))
    assert 1 in groups and groups[20] == [20]
    assert op.keep_one(df).count() == len(want)
