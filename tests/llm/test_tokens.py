import random
import zlib

import numpy as np
import pytest

from strandlake.llm import tokens
from strandlake.llm.common import new_path
from strandlake.llm.hashing import span_hashes
from strandlake.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokenizer_path())


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoding_by_pieces_equals_whole_texts(encoder, awkward):
    r = random.Random(5)
    letters = list("abcXYZ019.,;'’-_ \n\t\r\x0b\x0c\u00a0\u2003\u3000éß中😀") + ["'s", "'re", "  ", " \n ", "\x1c", "\x85", "<|endoftext|>", "²"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(1500)] + [t or "" for _, t, _, _ in awkward]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(encoder, text)


def test_documents_come_back_in_order(documents, awkward, encoder):
    got = sorted(tokens.encode_and_read_back(documents, tokenizer_path()).collect(), key=lambda r: r["start"])
    want, start = [], 0
    for d, t, _, _ in sorted(awkward, key=lambda x: (x[0] is not None, x[0] or 0)):  # rows of one id are equal
        ids = [*plain(encoder, t), 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_nothing(nothing):
    assert tokens.encode_and_read_back(nothing, tokenizer_path()).collect() == []
    assert tokens.suffix_sums(tokens.length_histogram(nothing, tokenizer_path())).collect() == []


def test_a_reader_decompresses_only_what_it_needs(monkeypatch):
    docs = [(i, np.arange(i, i + 1000, dtype="<u4").tobytes()) for i in range(2000)]
    file = tokens.TokenFile(tokens.pack_shard(iter(docs), 0, 2))
    assert len(file.table) > 3
    opened = []
    frame = tokens.TokenFile.frame
    monkeypatch.setattr(tokens.TokenFile, "frame", lambda self, k: opened.append(k) or frame(self, k))
    got = dict(file.read({7, 1999}))
    assert got[7].tolist() == [*range(7, 1007), 0] and got[1999].tolist() == [*range(1999, 2999), 0]
    assert len(opened) == 2


def test_files_are_plain_zstd_and_damage_is_noticed():
    import io

    import zstandard

    data = tokens.pack_shard(iter([(1, np.array([5, 6], "<u4").tobytes()), (2, b"")]), 0, 4)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u4").tolist() == [5, 6, 0, 0]
    broken = bytearray(data)
    broken[-9 - 24 + 8] ^= 1  # the first frame's checksum in the seek table
    with pytest.raises(ValueError, match="frame 0 is damaged"):
        list(tokens.TokenFile(bytes(broken)).read())


def test_length_histogram_answers_every_limit(documents, awkward, encoder):
    lengths = [len(plain(encoder, t)) for _, t, _, _ in awkward]
    counts = tokens.suffix_sums(tokens.length_histogram(documents, tokenizer_path())).cache()
    for r in counts.collect():
        n = r["length"]
        assert r["n_docs"] == lengths.count(n) and r["docs_longer"] == sum(x > n for x in lengths)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["total_tokens"] == sum(lengths)
        assert r["tokens_lost"] == sum(max(0, x - n) for x in lengths)
    for limit in (1, 17, 256, 10**6):
        row = tokens.total_at(counts, limit).first()
        assert (row["docs_longer"], row["truncated_tokens"]) == (sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
    for q in (0.1, 0.5, 1.0):
        assert tokens.quantile(counts, q).first()[0] == min(x for x in lengths if sum(y <= x for y in lengths) >= q * len(lengths))


def thue_morse(n):
    """Two words of n letters (a power of two) that sums of letters times powers modulo 2**64 cannot tell apart."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [8, 16, 64, 128, 1024, 2048, 4096])
def test_words_that_differ_only_in_order_are_told_apart(encoder, n):
    a, b = thue_morse(n)
    texts = [f"x {a} y", f"x {b} y", f"x {b}{a}, y", f"x {a}{b}, y"]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(encoder, text)


def test_hashes_and_marks_tell_all_short_spans_apart():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000, dtype=np.uint8)
    first = rng.integers(0, 3900, 20_000)
    last = first + rng.integers(0, 90, 20_000)
    hashes, marks = span_hashes(data, first, last)
    spans = [data[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    assert len(set(spans)) == len(set(hashes.tolist())) and len(set(zip(spans, hashes.tolist(), marks.tolist()))) == len(set(spans))


def test_one_hash_for_different_parts_is_noticed(monkeypatch):
    """With a hash of two values only, the marks decide, inside a run and against what is kept."""
    real = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda *a: (real(*a)[0] & np.uint64(1), real(*a)[1]))
    encoder = tokens.Encoder(tokenizer_path())
    for texts in (["x river y", "x stone y", "garden morning"], ["x lake"], ["x hill"], ["x lake", "x hill"]):
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain(encoder, text)


def test_files_are_ordered_by_all_digits_of_their_task():
    name = "file:/x/part-{}-0b1c-4d2e-c{}.txt"
    found = [tokens.shard_of(name.format(a, b)) for a, b in (("00007", "000"), ("99999", "000"), ("100000", "000"), ("100000", "001"), ("1234567", "1000"))]
    assert found == [(7, 0), (99999, 0), (100000, 0), (100000, 1), (1234567, 1000)] == sorted(found)
    with pytest.raises(ValueError, match="not a token file"):
        tokens.shard_of("file:/x/_SUCCESS")


def test_one_id_of_many_rows_fills_several_files(spark, encoder):
    """All null ids: cut by the hash of the text, and a task writes a file as soon as it holds enough."""
    rows = [(None if i % 3 else 5, f"text number {i} " + "word " * (i % 50)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = new_path(spark, "tokens")
    tokens.write_tokens(docs, path, tokenizer_path(), shard_text_bytes=2000)
    files = sorted(tokens.shard_of(r[0]) for r in spark.read.format("binaryFile").load(path).select("path").collect())
    assert len({a for a, _ in files}) > 10
    got = sorted(tokens.read_digest(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 200 + [5] * 100
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got][:-1]]).tolist()
    want = sorted((d is not None, zlib.crc32(np.array([*plain(encoder, t), 0], "<u4").tobytes())) for d, t in rows)
    assert sorted((r["doc_id"] is not None, r["ids_crc32"]) for r in got) == want


def test_a_task_of_many_texts_writes_several_files(spark, encoder):
    docs = spark.createDataFrame([(1, "word " * 400)] * 40, "doc_id long, text string").coalesce(1)
    path = new_path(spark, "tokens")
    tokens.write_tokens(docs, path, tokenizer_path(), shard_text_bytes=1 << 12)
    assert spark.read.format("binaryFile").load(path).count() > 1
    got = sorted(r["start"] for r in tokens.read_digest(spark, path).collect())
    n = len(plain(encoder, "word " * 400)) + 1
    assert got == [n * i for i in range(40)]
