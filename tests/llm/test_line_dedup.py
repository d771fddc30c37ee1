import numpy as np
import pytest

from strandlake.llm import line_dedup as op
from strandlake.llm.perfect_hash import PerfectHash


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    keys = np.unique(keys)
    mph = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(mph.lookup(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).lookup(keys[:5]).tolist() == [-1] * 5


def merged(rows):
    """Rows of one id are one document: brute force over lines held by ids."""
    holders = {}
    for i, text in rows:
        for line in (text or "").encode().split(b"\n"):
            if (key := op.line_key(line, 10)) is not None:
                holders.setdefault(key, set()).add(i if i is not None else op.NULL_ID)
    out = []
    for i, text in rows:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x in lines if (k := op.line_key(x, 10)) is None or len(holders[k]) < 2 or min(holders[k]) == (i if i is not None else op.NULL_ID)]
        out.append((i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [(1 << 17, 1 << 19), (2, 5)])
def test_against_brute_force(documents, awkward, monkeypatch, limits):
    monkeypatch.setattr(op, "GROUP_PROBES", limits[1])
    monkeypatch.setattr(op, "SHARD_KEYS", limits[0])
    got = sorted((tuple(r) for r in op.dedup_lines(documents).collect()), key=str)
    assert got == merged([(d, t) for d, t, _, _ in awkward])


def test_hot_line_and_case(spark):
    rows = [(i, f"The COMMON line of all\n\tthe common LINE of all \nown line number {i}\nshort") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in op.dedup_lines(df).collect()}
    assert got == {i: (4, 2 if i else 0) for i, _ in rows}
    assert {r["doc_id"]: tuple(r)[1:] for r in op.digest(op.dedup_lines(df)).collect()} == op.reference_digest(rows)


def test_nothing_to_drop_and_nothing(spark, nothing, clashing, awkward):
    df = spark.createDataFrame([(1, "a line that is alone"), (2, "another line that is alone")], "doc_id long, text string")
    assert {tuple(r)[:3] for r in op.dedup_lines(df).collect()} == {(1, 1, 0), (2, 1, 0)}
    assert op.dedup_lines(nothing).collect() == []
    assert op.dedup_lines(clashing).count() == len(awkward)


def test_many_rows_without_id_and_all_lines_lost(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_DOCS", 3)
    rows = [(None if i % 2 else i, f"a line that all documents hold\nand a second line of that kind\nline of number {i // 4}") for i in range(40)]
    rows += [(100, "a line that all documents hold\nAND A SECOND line of that kind"), (101, "a line that all documents hold")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in op.dedup_lines(df).collect()), key=str)
    assert got == merged(rows) and (100, 2, 2, "") in got and (101, 1, 1, "") in got
