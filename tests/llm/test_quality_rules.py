import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import quality_rules as q


def base(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
    return (*out, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_counts(documents, awkward):
    got = sorted((tuple(r) for r in q.apply_rules(documents).select("doc_id", *q.BASE, "base_failed").collect()), key=str)
    assert got == sorted(((d, *base(t)) for d, t, _, _ in awkward), key=str)


def test_repeats(spark):
    texts = ["a b c " * 30, "x " * 60, " ".join(map(str, range(60))) + " 0 1 2", "a b", "a b c a b c", "a a a a"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in q.measure(df).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def test_clashing_columns_and_nothing(clashing, nothing, awkward):
    assert q.apply_rules(clashing).count() == len(awkward)
    assert q.apply_rules(nothing).collect() == []


def test_distance(spark):
    rng = np.random.default_rng(0)
    rows = [([int(x) for x in rng.integers(0, 9, 6)], [int(x) for x in rng.integers(0, 9, 6)]) for _ in range(20)] + [([0] * 6, [1] * 6), ([1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0])]
    got = spark.createDataFrame(rows, "p array<long>, q array<long>").select(q.js_distance(F.col("p"), F.col("q")).alias("d")).collect()
    for (p, r), d in zip(rows, got, strict=True):
        if not sum(p) or not sum(r):
            assert d["d"] is None
            continue
        a, b = np.array(p) / sum(p), np.array(r) / sum(r)
        kl = lambda x, m: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
        assert math.isclose(d["d"], math.sqrt(max(0, (kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2)), abs_tol=1e-9)


def test_junk_goes_and_prose_stays(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = q.apply_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] > 0.98 and share[0] < 0.6
