import hashlib
import random
import re
from collections import defaultdict

from strandlake.llm import mixing


def expected(rows, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _, _ in rows]
    per = defaultdict(int)
    for (_, _, _, s), n in zip(rows, size, strict=True):
        per[s] += n
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(per.values())
    while True:  # share by weight, stop what is above, share again
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * per[s] + 1e-9]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * per[s]
            left -= target[s]
            open_.discard(s)
        if not open_:
            break
    return size, per, target


def test_targets_and_sizes(documents, awkward):
    size, per, target = expected(awkward)
    got = mixing.mix(documents).join(documents.select("doc_id", "source").distinct(), "doc_id").collect()
    for r in got:
        assert r["source_size"] == per[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(mixing.mix(documents).collect()) == len(awkward)


def test_taken_is_the_prefix_by_hash(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), "en", f"s{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    size, per, target = expected(rows)
    for s in per:
        mine = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16), i) for i, _, _, x in rows if x == s)
        repeats = int(target[s] // per[s])
        rest, upto, want = target[s] - repeats * per[s], 0, {}
        for _, i in mine:
            more = upto + size[i] <= rest or (upto <= rest and 2 * (rest - upto) > size[i])
            want[i] = size[i] * (repeats + more)
            upto += size[i]
        assert {i: got[i]["taken"] for _, i in mine} == want
        assert abs(sum(want.values()) - target[s]) <= max(size[i] for _, i in mine)


def test_nested(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sets = [{r["doc_id"] for r in mixing.mix(df, share=x).where("taken > 0").collect()} for x in (0.2, 0.5, 0.9)]
    assert sets[0] < sets[1] < sets[2]


def test_apply_and_rerun(clashing, nothing, awkward):
    taken = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(clashing).collect()}
    out = mixing.apply_mix(clashing)
    assert out.columns == clashing.columns
    got = out.groupBy("doc_id").count().collect()
    times = {d: sum(1 for x in awkward if x[0] == d) for d, *_ in awkward}
    assert {r["doc_id"]: r["count"] for r in got} == {d: n * times[d] for (d, _), n in taken.items() if n}
    assert sorted(map(str, mixing.mix(clashing).collect())) == sorted(map(str, mixing.mix(clashing).collect()))
    assert mixing.mix(nothing).collect() == [] and mixing.apply_mix(nothing).collect() == []


def test_many_sources_of_every_size(spark, monkeypatch):
    """More sources than are sent to all tasks, hot ones among them, ties in level, and one without words."""
    from strandlake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "MOST_HOT", 6)
    r = random.Random(3)
    rows = [(i, "w " * r.choice([1, 3, 8]), "en", f"s{r.randrange(60):02d}") for i in range(500)]
    rows += [(1000 + i, "w w", "en", "hot") for i in range(300)] + [(2000 + i, "w", "en", None) for i in range(40)] + [(3000, None, "en", "none"), (3001, "", "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    size, per, target = expected(rows)
    of = {i: s for i, _, _, s in rows}
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == per[of[r["doc_id"]]] and abs(r["target"] - target[of[r["doc_id"]]]) < 1e-6
        taken[of[r["doc_id"]]] += r["taken"]
    for s in per:
        assert abs(taken[s] - target[s]) <= max(n for n, row in zip(size, rows, strict=True) if row[3] == s)
    copies = defaultdict(int)
    for r in mixing.apply_mix(df).collect():
        copies[r["doc_id"]] += 1
    assert copies == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from strandlake.llm.common import running

    values = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, n long").repartition(3)
    got = {r["v"]: (r["rank"], r["before_n"]) for r in running(df, [F.col("v").asc()], ["n"], "t").collect()}
    upto = 0
    for i, v in enumerate(sorted(values)):
        assert got[v] == (i, upto)
        upto += v % 7


def test_no_text_comes_more_often_than_the_limit(spark):
    """Sources at their limit, empty texts in them, and sources without words, counted in what apply_mix emits."""
    rows = [(i, "w w", "en", "a") for i in range(4)] + [(10 + i, "", "en", "a") for i in range(40)]
    rows += [(100 + i, "w " * 30, "en", "b") for i in range(20)] + [(200 + i, None, "en", "c") for i in range(20)] + [(300 + i, " \n", "en", None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    _, per, target = expected(rows)
    assert target["a"] == 2 * per["a"] and per["c"] == 0
    copies = defaultdict(int)
    for r in mixing.apply_mix(df).collect():
        copies[r["doc_id"]] += 1
    assert all(n <= 2 for n in copies.values())
    assert {i: n for i, n in copies.items() if i < 100} == {i: 2 for i, _, _, s in rows if s == "a"}
    assert not any(i >= 200 for i in copies)
