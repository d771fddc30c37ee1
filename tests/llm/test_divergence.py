import random
import re
from collections import Counter, defaultdict

import pytest

from strandlake.llm import divergence as op

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least, ranks=50):
    """Rows of the audit from whole dense tables of counts."""
    docs = [((lang or ""), (source or ""), Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, bag in own for t in bag)
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, bag in own:
            counts[source].update({t: bag[t] for t in kept if bag[t]})
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in p:
            parts = {"pair": {o: sum(abs(p[s][t] - p[o][t]) for t in kept) for o in p if o != s}, "term": {t: p[s][t] - q[t] for t in kept if counts[s][t] and p[s][t] > q[t]}}
            for part, values in parts.items():
                ranked = sorted(values, key=lambda x: (-values[x], x.encode()))
                out += [(lang, s, part, x, values[x], i + 1) for i, x in enumerate(ranked) if part == "pair" or i < ranks]
    return out


def made(seed, n, sources, words, langs=("en", "de", None)):
    r = random.Random(seed)
    text = lambda: " ".join(r.choice(("", "X", "é")) + r.choice(words) + r.choice((".", "", "-x", "7y")) for _ in range(r.randrange(30)))
    return [(i, text(), r.choice(langs), r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("least", [1, 4, 1000])
def test_against_brute_force(spark, least):
    rows = made(1, 120, ["a", "b", "c", None, ""], [f"w{chr(97 + i)}" for i in range(20)])
    rows += [(1, "one", "fr", "alone"), (2, None, "en", "silent"), (3, "", None, "silent"), rows[0], rows[0]]
    got = [tuple(r) for r in op.audit(spark.createDataFrame(rows, SCHEMA), least).collect()]
    assert Counter(got) == Counter(brute(rows, least))


def test_blocks_and_slices(spark, monkeypatch):
    """Sources over several blocks, vectors over several slices, and terms of one vector."""
    monkeypatch.setattr(op, "BLOCK", 3)
    monkeypatch.setattr(op, "SLICE", 7)
    rows = made(2, 200, [f"s{i}" for i in range(10)], [f"w{chr(97 + i)}" for i in range(26)], ("en",))
    rows += [(1000 + i, " ".join(f"same{chr(97 + j)}" for j in range(20)), "en", "s3") for i in range(3)]
    got = [tuple(r) for r in op.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), 2, 15).collect()]
    assert Counter(got) == Counter(brute(rows, 2, 15))


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    counts = [(0, 10, 3), (3 * 10**12, 9 * 10**15, 10**9), (123456789012345, 123456789012346, 7), (1, 2, 0)]
    df = spark.createDataFrame(counts, "c long, n long, v long")
    got = [r[0] for r in df.select(op.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) if v else None for c, n, v in counts]


def test_awkward_tables(clashing, nothing, awkward):
    assert Counter(map(tuple, op.audit(clashing, 1).collect())) == Counter(brute(awkward, 1))
    assert op.audit(nothing).collect() == []
