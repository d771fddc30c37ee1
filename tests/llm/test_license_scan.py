import random
import re

import pytest

from strandlake.llm import license_scan as op

from .conftest import prose


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(text, notices):
    """Per label, whether any run of whole words is within the edits of one of its notices; and places of base phrases."""
    found = words(text)
    labels, places = {}, []
    for label, notice in notices:
        k, n = op.edits_of(notice), len(notice.split())
        for i in range(len(found)):
            for j in range(i + 1, min(len(found), i + n + k) + 1):
                span = " ".join(found[i:j])
                if abs(len(span) - len(notice)) <= k and (d := distance(span, notice)) <= k:
                    labels[label] = max(labels.get(label, 0), 1 - d / len(notice))
    for label, phrase in op.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(p)] == p]
    return len(found), labels, sorted(places)


def spoiled(r, notice):
    """A notice with one edit more than it may have at most, of all kinds and at all places."""
    out = list(notice)
    for _ in range(r.randrange(op.edits_of(notice) + 2)):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[at] = r.choice("abcxyz q")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, r.choice("abcxyz q"))
    return "".join(out)


def test_notices_with_errors_against_brute_force():
    r = random.Random(4)
    notices = tuple(n for n in op.NOTICES if len(n[1]) < 50)
    scanner = op.Scanner(op.BASE, notices)
    hits = 0
    for _ in range(250):
        parts = [spoiled(r, r.choice(notices)[1]) if r.random() < 0.6 else r.choice(["emit license", "word", "License", "cc by", "gnu GENERAL public  license"]) for _ in range(r.randrange(4))]
        text = " and ".join(parts)
        n, labels, places = brute(text, notices)
        got_n, found = scanner.find(text)
        assert got_n == n
        assert [(m[2], m[0]) for m in found if m[1]] == places
        best = {}
        for label, base, _, _, _, score in found:
            if not base:
                best[label] = max(best.get(label, 0), score)
        assert best == pytest.approx(labels), text
        hits += len(labels)
    assert hits > 100


def test_pieces_cover_a_notice():
    for _, notice in op.NOTICES:
        cut = op.pieces(notice)
        assert "".join(p for _, p in cut) == notice and len(cut) == op.edits_of(notice) + 1
        assert all(notice[at : at + len(p)] == p for at, p in cut)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the MIT License.", [("mit", True, 3, 2, 0), ("mit", False, 0, 5, 0)]),
        ("x GNU Genral Public Licence y", [("gpl", False, 1, 4, 2)]),
        ("limit license, permit-license", []),
        ("cc by cc by", [("cc-by", True, 0, 2, 0), ("cc-by", True, 2, 2, 0)]),
        ("", []),
    ],
)
def test_spans(text, want):
    n, found = op.scanner(op.BASE, op.NOTICES).find(text)
    assert sorted(m[:5] for m in found) == sorted(want)


def test_very_many_seeds_in_one_text():
    text = "s reserved public licens gnu general " * 20_000 + "mozila public license"
    n, found = op.scanner(op.BASE, op.NOTICES).find(text)
    assert n == 120_003 and ("mpl", False, 120_000, 3, 1) in [m[:5] for m in found]


def test_scan_and_digest(spark, clashing, nothing, awkward):
    out = op.scan(clashing)
    assert out.columns == [*clashing.columns, "license_words", "license_matches"]
    rows = op.digest(out).collect()
    assert len(rows) == len(awkward)
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in rows) == sorted((d or 0, len(words(t))) for d, t, *_ in awkward)
    assert op.digest(op.scan(nothing)).collect() == []
    docs = spark.createDataFrame([(1, "MIT license. " + prose(9, 200) + " Apache license, mit LICENSE"), (2, None), (3, "gnu afero general public license")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in op.digest(op.scan(docs)).collect()}
    assert got[1] == (206, 3, 0, 204, "apache,mit", "apache,mit", 1.0)
    assert got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[3] == (5, 0, None, None, "", "agpl", 1 - 1 / 33)


def test_clean_prose_has_no_labels(spark):
    docs = spark.createDataFrame([(i, prose(i, 400)) for i in range(20)], "doc_id long, text string")
    assert {r["labels"] for r in op.digest(op.scan(docs)).collect()} == {""}
