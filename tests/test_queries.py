from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake import plans

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", plans.QUERIES)
def test_against_its_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name not in plans.ORACLES:
        assert rows
        return
    found = duck.sql(plans.ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, rows)) == Counter(tuple(r[i] for i in at) for r in found.fetchall())
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = dict(zip(found.columns, map(str, found.types), strict=True))
    assert {c: kinds[t] for c, t in df.dtypes} == types


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_segmentation_reads_two_columns(spark):
    plan = plans.QUERIES["segments_for_range"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "ReadSchema" in plan


@pytest.mark.parametrize("name", ["best_group_one_splitter", "bridged_splits", "candidate_order", "reference_packing"])
def test_segments_are_made_once(spark, name):
    """Queries that read segments more than once store them: their own plans don't go back to the documents."""
    assert not [f for f in plans.QUERIES[name](spark, SMALL).inputFiles() if "documents" in f]


@pytest.mark.parametrize("name", ["append_two_handles", "append_equals_create"])
def test_appending_queries_read_the_texts_once(spark, monkeypatch, name):
    from strandlake.plans import codec_queries

    class Seen(Exception):
        pass

    def create(contigs, *a, **k):
        raise Seen(contigs.inputFiles())

    monkeypatch.setattr(codec_queries.Collection, "create", create)
    with pytest.raises(Seen) as seen:
        plans.QUERIES[name](spark, SMALL)
    assert seen.value.args[0] and not [f for f in seen.value.args[0] if "documents" in f]


def test_letters_of_the_genome_view(spark):
    from strandlake.functions import dna_view
    from strandlake.sources.genome_view import _dna_letters
    from pyspark.sql import functions as F

    texts = [None, "", "xyz", "ACGTacgt", "Tag é中\n\x00 gattaca!", "ＡＣＧＴ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all(r[0] == r[1] for r in df.select(dna_view(F.col("text")), F.arrow_udf(_dna_letters, "string")(F.col("text"))).collect())
