import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import rule_ensemble as op

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = op.classify(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93


def test_columns_and_numpy_agree(documents):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(op.FEATURES)))
    model = op.fit(x, ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float))
    assert model.rules
    rows = op.statistics(documents.select("text")).select("stats.*", model.score(F.col("stats")).alias("s")).collect()
    features = np.array([[r[f] for f in op.FEATURES] for r in rows])
    assert np.allclose([r["s"] for r in rows], 1 / (1 + np.exp(-np.clip(model.margin(features), -30, 30))))
    inside = 1 / (1 + np.exp(-model.margin(x)))
    assert np.mean((inside >= 0.5) == ((x[:, 0] > 0.5) & (x[:, 3] < 0.7))) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    turned = labels.withColumn("quality", F.when(op.in_training(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    assert op.train(docs, labels) == op.train(docs, turned)


def test_without_usable_labels(documents, clashing, nothing, spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        assert {r["score"] for r in op.classify(documents, labels).collect()} == {0.5}
    assert all(r["score"] > 0.9 for r in op.classify(clashing, one).collect())
    assert op.classify(nothing, one).collect() == []
    out = op.keep_good(clashing, one)
    assert out.columns == clashing.columns and out.count() == len(awkward)
    assert {tuple(r[4:]) for r in out.collect()} == {tuple(r[4:]) for r in clashing.collect()}  # users' values stay


def by_hand(text):
    """The statistics of a text, counted letter by letter."""
    t = text or ""
    n = len(t)
    kinds = {"lower": str.islower, "upper": str.isupper, "digit": str.isdigit}
    share = lambda test: sum(map(test, t)) / n if n else 0.0
    ascii_only = lambda test: lambda c: c < "\x80" and test(c)
    out = {k: share(ascii_only(v)) for k, v in kinds.items()}
    white = " \t\n\x0b\f\r"
    out |= {k: share(lambda c, v=v: c in v) for k, v in {"space": white, "symbol": "#*$%&<>", "bar": "|", "exclaim": "!", "stop": ".,;:?"}.items()}
    out["other"] = share(lambda c: c > "\x7f")
    words = re.findall(f"[^{white}]+", t)
    full = [x for x in t.split("\n") if x.strip(white)]
    out["word_chars"] = sum(map(len, words)) / len(words) if words else 0.0
    out["line_words"] = len(words) / len(full) if full else 0.0
    out["repeated_lines"] = (len(full) - len(set(full))) / len(full) if full else 0.0
    out["size"] = np.log1p(len(words))
    return [out[f] for f in op.FEATURES]


def test_statistics_against_counts_by_hand(documents, spark, awkward):
    texts = [t for _, t, _, _ in awkward] + ["a\n\na\n a", "A!B|c #1.", "\u2028x\u00a0y\x85z"] + ["word, Word 12 é! " * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in op.statistics(df).select("i", "stats.*").collect():
        assert np.allclose(list(r)[1:], by_hand(texts[r["i"]])), r["i"]


def first_split(x, y, cuts, least):
    """The best split of a tree's root, trying every threshold of every statistic on its own."""
    g, h = 0.5 - y, np.full(len(y), 0.25)
    best, place = 1e-6, None
    for f, at in enumerate(cuts):
        for c in at:
            low = x[:, f] <= c
            if least <= low.sum() <= len(y) - least:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best + 1e-12:
                    best, place = gain, (f, float(c))
    return place


def test_tree_and_lasso_against_plain_versions():
    rng = np.random.default_rng(4)
    x = rng.random((300, 6))
    x[:, 5] = x[:, 2]  # equal gains: the first statistic wins
    y = ((x[:, 2] > 0.4) & (x[:, 1] < 0.8)).astype(float)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(6)]
    rules, _ = op._tree(x, cuts, 0.5 - y, np.full(300, 0.25), 1, 5)
    assert {(r.terms[0][0], r.terms[0][2]) for r in rules} == {first_split(x, y, cuts, 5)} and rules[0].terms[0][0] == 2
    # the lasso's optimum: the gradient of every weight is at most the penalty, and equals it where the weight is not 0
    z, penalty = rng.random((300, 8)), 0.02
    b, w = op._lasso(z, y, penalty, 5000)
    r = 1 / (1 + np.exp(-(z @ w + b))) - y
    grad = z.T @ r / len(y)
    assert abs(r.mean()) < 1e-5 and (np.abs(grad) <= penalty + 1e-5).all()
    assert np.allclose(grad[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5) and (w == 0).any()


def test_ids_that_repeat_and_the_bound_on_rows(spark):
    rows = [(i // 3, f"text {i} " + "Word, " * (i % 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert op.train(docs, labels, max_rows=40) == op.train(docs.repartition(2), labels.repartition(3), max_rows=40)
