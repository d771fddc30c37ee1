import math
import random
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, scale=256.0, positives=5, negatives=10):
    ok = [(i, [math.floor(scale * x) for x in np.array(v, np.float32).astype(float)] if v else [], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, label in dict.fromkeys((i, tuple(v), label) for i, v, label in ok if i % every == 0):
        scored = [(-dot(v, w), j, other) for j, w, other in ok]
        for s, j, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:positives]:
            window = sorted(x for x in scored if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s)
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(window[:negatives])]
    return out


def made(seed, n, size=6, spread=1.0, labels=3):
    r = random.Random(seed)
    return [(i, [r.gauss(0.2, 0.4) * r.uniform(1, spread) for _ in range(size)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("spread", "strip", "buckets", "anchors"), [(1, 8192, 256, 4096), (8, 16, 256, 4), (8, 7, 3, 5)])
def test_against_brute_force(spark, monkeypatch, spread, strip, buckets, anchors):
    for name, value in (("STRIP", strip), ("BUCKETS", buckets), ("ANCHORS", anchors), ("PIECE", 5)):
        monkeypatch.setattr(op, name, value)
    rows = made(3, 400, spread=spread)
    rows += [(1000, [0.0] * 6, 0), (1001, [0.0] * 6, 1), (1002, [0.0] * 6, 0), (1007, [0.5] * 6, 1), (1100, [1.0, None] + [0.0] * 4, 1), (1200, None, 1), (1300, [float("nan")] * 6, 0), (1400, [float("inf")] * 6, 0), (1500, [0.3] * 6, None), (None, [0.3] * 6, 1), (1600, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in op.hard_negatives(df, every=20).collect()]
    assert got and Counter(got) == Counter(brute(rows, 20))


def test_equal_vectors_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "STRIP", 16)
    rows = [(i, [0.5, 0.5], i % 2) for i in range(60)] + [(200 + i, [0.25, 0.25], 1) for i in range(30)] + [(0, [0.5, 0.5], 0)] * 2
    got = [tuple(r) for r in op.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_buckets_are_pruned(spark, monkeypatch):
    """Of rows whose norms fall far below what a window can take, none is sent."""
    for name, value in (("STRIP", 10), ("BUCKETS", 100)):
        monkeypatch.setattr(op, name, value)
    rows = [(i, [4.0 - i / 100, 1.0], i % 2) for i in range(100)] + [(1000 + i, [0.01, 0.01], i % 2) for i in range(300)]
    sent = []
    grouped = op.Candidates.against

    def watched(self, anchors, first, k, same):
        sent.append((first, [r["last"] for r in anchors.select("last").collect()], len(self.tops)))
        return grouped(self, anchors, first, k, same)

    monkeypatch.setattr(op.Candidates, "against", watched)
    got = [tuple(r) for r in op.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=50).where("anchor_id < 1000").collect()]
    assert Counter(got) == Counter(x for x in brute(rows, 50) if x[0] < 1000)
    later = [last for first, lasts, _ in sent if first for last in lasts]
    assert later and min(later) < 15 and sent[0][2] == 40


def test_products_stay_exact():
    big = np.array([[2.0**40, 3.0], [2.0**31 + 1, 1.0]])
    assert op.products(big, big, float(2**80)).tolist() == [[op.MOST, 2**40 * (2**31 + 1) + 3 if 2**40 * (2**31 + 1) + 3 < op.MOST else op.MOST], [op.MOST, (2**31 + 1) ** 2 + 1]]
    small = np.arange(6.0).reshape(3, 2)
    assert (op.products(small, small, 100.0) == (small @ small.T)).all()


def test_other_columns_and_no_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(made(5, 60), SCHEMA)
    more = df.withColumns({n: F.lit(n) for n in ("id", "norm", "body", "slots", "anchor", "strip", "row", "rank", "a.b")})
    assert sorted(map(tuple, op.hard_negatives(more, every=10).collect())) == sorted(brute([tuple(r) for r in df.collect()], 10))
    assert op.hard_negatives(df.limit(0)).collect() == []
