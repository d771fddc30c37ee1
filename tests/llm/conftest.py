import random

import pytest

WORDS = "river stone light morning garden window silver branch yellow winter market letter orange candle forest bridge mountain paper music travel".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, near copies and odd letters."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (2, base, "en", "b"),
        (3, near, "en", "a"),
        (4, "", "en", None),
        (5, None, None, "a"),
        (6, None, "de", None),
        (7, prose(2, 30_000), "fr", "c"),
        (8, "one two three", "en", "a"),
        (9, "one two three", None, "a"),
        (10, " \t\n\x0b\f\r ", "en", "b"),
        (11, "é" * 40 + " \u3000x\n" + prose(3, 80), "es", "c"),
        (12, "a  b   c\n  d \n\n e ", "en", "c"),
        (13, "<|endoftext|> </s> [INST] \\ \\\\ | ### $$$", "en", "a"),
        (14, "same line of text here\nsame line of text here\nother line of this text", "en", "a"),
        (15, "  SAME line of text HERE \nother line of that text", "en", "b"),
        (None, prose(4, 60), "en", "a"),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def documents(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


@pytest.fixture
def clashing(spark, awkward):
    """The same with further columns whose names the operators might use inside."""
    df = spark.createDataFrame(awkward, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("size", "hash", "node", "node_id", "bucket", "w", "t", "words", "lines", "hits", "items", "copies", "target", "shard", "value", "h", "n", "score", "k", "row", "id", "key", "stats", "rest", "hash", "s2", "cut", "repeats", "held", "body", "c0", "c1",
                 "__t", "__n", "__words", "__score", "__hash", "__s2", "__cut", "__copy", "__id", "__row", "Score", "a.b", "x`y", "two words"):
        df = df.withColumn(name, F.lit(name)) if name.lower() not in {c.lower() for c in df.columns} else df
    return df


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
