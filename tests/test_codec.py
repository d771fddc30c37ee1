import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import packing
from strandlake.operators import codec, kmers
from strandlake.plans import packing_queries

from .conftest import SMALL


def mutate(r, s):
    out = list(s)
    for _ in range(r.randrange(6)):
        i = r.randrange(len(out) + 1)
        kind = r.randrange(5)
        if kind == 0 and i < len(out):
            out[i] = r.choice("ACGTNR")
        elif kind == 1:
            out[i:i] = [r.choice("ACGT") for _ in range(r.randrange(1, 50))]
        elif kind == 2:
            del out[i : i + r.randrange(1, 50)]
        elif kind == 3:
            out[i:i] = "N" * r.choice([3, 4, 500])
    return "".join(out)


def plain_code(ref, text, least):
    """The code by trying every indexed place at every letter; for references without very frequent keys."""
    key, coded = least - 3, dict(zip("ACGTNRYSWKMBDHVU ", "ABCDEFGHIJKLMNOP_", strict=True))
    if ref == text:
        return ""
    out, i, expected, pending = [], 0, 0, 0
    while i < len(text):
        best = (least, 0, 0, 0)
        if i + key < len(text):
            window = text[i : i + key]
            if set(window) <= set("ACGT"):
                for p in range(0, len(ref) - key + 1, 4):
                    if ref[p : p + key] == window:
                        f = next((j for j in range(len(text) - i) if p + j >= len(ref) or ref[p + j] != text[i + j]), len(text) - i)
                        b = next((j for j in range(min(pending, p)) if ref[p - j - 1] != text[i - j - 1]), min(pending, p))
                        if f + b > best[0]:
                            best = (f + b, f, b, p)
            elif text[i : i + 4] == "NNNN":
                n = len(text[i:]) - len(text[i:].lstrip("N"))
                out.append(f"\x1e{n - 4}\x04")
                i, pending = i + n, 0
                continue
        size, f, b, p = best
        if not f:
            out.append(coded[text[i]])
            i, expected, pending = i + 1, expected + 1, pending + 1
            continue
        del out[len(out) - b :]
        start, place, guess = i - b, p - b, expected - b
        code = "".join(out)
        if place == guess:
            marks, j = list(code), 1
            while j < len(code) and j < place and "A" <= code[-j] <= "Z":
                if code[-j] == coded[ref[place - j]]:
                    marks[-j] = "!"
                j += 1
            code = "".join(marks)
        whole = start + size == len(text) and place + size == len(ref)
        out = [*code, f"{place - guess}." if whole else f"{place - guess},{size - least}."]
        i, expected, pending = start + size, place + size, 0
    return "".join(out)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 400), st.sampled_from([15, 20, 32]))
def test_round_trip(seed, n, least):
    r = random.Random(seed)
    reference = "".join(r.choice("ACGT") for _ in range(n))
    coder = codec.Coder(reference, least)
    for text in (reference, mutate(r, reference), "".join(r.choice("ACGT NR") for _ in range(r.randrange(200))), "", "N" * 7):
        code = coder.encode(text)
        assert codec.decode(reference, code, least) == text
        costs, ends = coder.costs(text), coder.costs(text, at_start=False)
        assert len(costs) == len(ends) == len(text) and sum(costs) == sum(ends)
        assert code == plain_code(reference, text, least) or text == ""
        assert coder.cost(text, 3) > 3 or coder.cost(text, 3) == coder.cost(text)


def test_near_copies_are_short():
    r = random.Random(1)
    reference = "".join(r.choice("ACGT") for _ in range(5000))
    text = list(reference)
    for i in range(50, 5000, 100):
        text[i] = "A" if text[i] != "A" else "C"
    coder = codec.Coder(reference, 20)
    assert coder.encode(reference) == ""
    assert len(coder.encode("".join(text))) < 600 and coder.cost("".join(text)) < 700 and coder.cost(reference) == 0


def test_tokens_as_the_format_says():
    r = random.Random(3)
    ref = "".join(r.choice("ACGT") for _ in range(400))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    coder = codec.Coder(ref, 20)
    assert coder.encode(ref[4:]) == "4."  # to both ends
    assert coder.encode(ref[4:204]) == "4,180."
    assert coder.encode(ref[:200] + "NNNNNN" + ref[200:]) == "0,180.\x1e2\x040."
    changed = ref[:100] + other[ref[100]] + ref[101:]
    assert coder.encode(changed) == f"0,80.{'ABCD'['ACGT'.index(other[ref[100]])]}0."
    two = changed[:103] + other[ref[103]] + changed[104:]
    a, b = ("ABCD"["ACGT".index(other[ref[i]])] for i in (100, 103))
    assert coder.encode(two) == f"0,80.{a}!!{b}0."
    assert coder.encode("R " + ref[:3]) == "F_" + ref[:3].translate(str.maketrans("ACGT", "ABCD"))


def test_a_key_is_known_at_no_more_places_than_slots():
    """A reference of one repeated key: only the entries that find a slot are candidates."""
    coder = codec.Coder("A" * 2000, 20)
    assert len(coder.places) == codec.SLOTS and coder.places.max() == 4 * (codec.SLOTS - 1)
    assert codec.decode("A" * 2000, coder.encode("A" * 1500 + "C"), 20) == "A" * 1500 + "C"
    assert coder.encode("A" * 1500 + "C") == "0,1480.B"


def test_rows(spark):
    rows = [(1, "ACGTACGTACGTACGTACGT", "ACGTACGTACGTACGTACGA"), (2, None, "ACNN"), (3, "ACGT", "ACGT")]
    df = spark.createDataFrame(rows, "i int, ref_seq string, body string")
    coded = {r["i"]: r["body"] for r in codec.encode_rows(df, 15).collect()}
    assert coded[2] == "ACNN" and coded[3] == "" and coded[1] == "0,4.A"
    back = spark.createDataFrame([(i, ref, coded[i]) for i, ref, _ in rows], "i int, ref_seq string, body string")
    assert {r["i"]: r["body"] for r in codec.decode_rows(back, 15).collect()} == {i: t for i, _, t in rows}


def test_rows_that_are_their_reference_need_no_index(monkeypatch):
    made = []
    monkeypatch.setattr(codec, "Coder", lambda *a, real=codec.Coder: made.append(a) or real(*a))
    refs = ["ACGT" * 20 + c * 9 for c in "ACGT"]
    batch = pa.RecordBatch.from_pydict({"ref_seq": [*refs, refs[0]], "body": [*refs, refs[1]]})
    (out,) = codec._each("encode", 20)(iter([batch]))
    assert out.column("body").to_pylist()[:4] == [""] * 4 and len(made) == 1
    assert codec.decode(refs[0], out.column("body")[4].as_py(), 20) == refs[1]


def test_windows_of_short_pieces_are_made_together():
    texts = [b"ACGTTGCAAC", None, b"", b"ACNGTACGTA", b"GGGGG"]
    rows = {"sample_ord": pa.array([0, 0, 1, 1, 2], pa.int32()), "contig_ord": pa.array(range(5), pa.int32()), "offset": pa.array([0, 0, 0, 7, 3]), "piece": texts}
    batch = pa.RecordBatch.from_pydict(rows)
    turn = lambda s: s[::-1].translate(bytes.maketrans(b"ACGT", b"TGCA"))
    want = [(s, i, o + e, min(w, turn(w)).decode()) for s, i, o, t in zip(*(batch.column(c).to_pylist() for c in rows), strict=True) for e in range(3, len(t or b"")) if b"N" not in (w := t[e - 3 : e + 1])]
    for made in (kmers._windows(4), kmers._strings(4)):
        (out,) = made(iter([batch]))  # one batch, not one for each piece
        assert [tuple(r[c] for c in ("sample_ord", "contig_ord", "end")) for r in out.to_pylist()] == [w[:3] for w in want]
    assert out.column("ck").to_pylist() == [w[3] for w in want]


def test_packing_of_arrays_is_that_of_expressions(spark):
    texts = ["", "A", "ACGT", "ACGTA", "ACGNN", "ACGNNTN", "ACUVR", "ACU", "AC GT", "é\U0001f600A", None]
    rows = {r["i"]: r for r in codec.pack_rows(spark.createDataFrame(list(enumerate(texts)), "i int, seq string")).collect()}
    codes = spark.createDataFrame(list(enumerate(texts)), "i int, seq string").withColumn("codes", packing.symbol_codes(F.col("seq")))
    for r in codes.select("i", packing.pack_width(F.col("codes")).alias("width"), packing.pack_symbols(F.col("codes")).alias("p")).collect():
        got = rows[r["i"]]
        assert (got["width"], got["bytes"]) == (r["width"], None if r["p"] is None else ",".join(map(str, r["p"])))
        assert got["same"] is (None if r["p"] is None else True)


def test_packing_takes_no_expression_per_letter(spark):
    plan = packing_queries.packed_symbols(spark, SMALL)._jdf.queryExecution().executedPlan().toString().lower()
    assert "lambda" not in plan and "mapinarrow" in plan


def test_short_references_are_indexed_by_letters(monkeypatch):
    """The index by letters gives what numpy's gives, and needs none of its calls."""
    r = random.Random(9)
    refs = ["".join(r.choice(x) for _ in range(n)) for x in ("ACGT", "AC") for n in (5, 12, 100, 263)]
    texts = [[ref, ref[3:60] + ref[70:], mutate(r, ref), "ACGT" * 200] for ref in refs]
    given = lambda: [(c.encode(t), c.cost(t), c.costs(t)) for ref, some in zip(refs, texts, strict=True) for c in [codec.Coder(ref, 15)] for t in some]
    monkeypatch.setattr(codec.Coder, "_by_letters", lambda self, places: None)
    monkeypatch.setattr(codec, "SLOTS", 0)
    monkeypatch.setattr(codec, "_put", lambda slots, size: slots >= 0)
    want = given()
    monkeypatch.undo()
    monkeypatch.setattr(codec, "window_codes", None)
    assert given() == want


def test_wanted_values_are_sought_only_where_a_table_has_them(monkeypatch):
    values = kmers.np.random.default_rng(4).integers(0, 1 << 63, 20_000).astype(kmers.np.uint64)
    sought, real = [], kmers.np.searchsorted
    monkeypatch.setattr(kmers.np, "searchsorted", lambda a, v, *more: sought.append(len(v)) or real(a, v, *more))
    for n in (1, 7, 500):
        wanted = kmers.np.sort(values[:n])
        assert kmers._among(lambda w=wanted: w)(values).tolist() == kmers.np.isin(values, wanted).tolist()
        assert sought.pop() < len(values) // 4
