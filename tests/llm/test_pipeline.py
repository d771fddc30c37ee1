import zlib

import numpy as np
import pytest

import corpus_pipeline
from strandlake.llm import decontaminate, mixing, rule_ensemble, tokens
from strandlake.llm.queries import QUERIES, tokenizer_path

from .test_near_dup import brute

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], D).cache())
    return out


def test_stages_in_order_keep_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_each_stage_against_brute_force(spark, stages):
    rows = [{r["doc_id"]: r for r in df.collect()} for df in stages[:-1]]
    labels = spark.read.parquet(f"{D}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in rule_ensemble.classify(stages[0], labels).collect()}
    assert set(rows[1]) == {d for d, s in score.items() if s >= 0.5}
    classes = brute([(d, r["text"]) for d, r in rows[1].items()])
    assert set(rows[2]) == {c for _, c in classes}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    hit = decontaminate.reference_digest([(d, r["text"]) for d, r in rows[2].items()], items)
    assert set(rows[3]) == {d for d in rows[2] if not hit[d][-1]}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()}
    assert {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()} == {d: n for d, n in copies.items() if n}
    encoder = tokens.Encoder.of(tokenizer_path())
    start = 0
    for r in sorted(stages[5].collect(), key=lambda r: r["start"]):
        ids = [*encoder.tokenizer.encode(rows[4][r["doc_id"]]["text"], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, D)
    assert sorted(r["start"] for r in got.collect()) == sorted(r["start"] for r in stages[-1].collect())


@pytest.mark.parametrize("name", QUERIES)
def test_registered_queries_run(spark, name):
    assert QUERIES[name](spark, D).count() > 0


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("tables"))


def given(spark, folder, docs):
    """A folder of tables with these documents; labels for some, items that one document holds."""
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    items = [("i1", "ONE two-three"), ("i2", None), (None, "")]
    spark.createDataFrame(items, "item_id string, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return folder


def test_awkward_documents_and_clashing_names_pass_all_stages(spark, clashing, awkward, folder):
    where = given(spark, folder, clashing)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where).cache()
        assert docs.columns == clashing.columns
    left = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert left <= {(d, t) for d, t, _, _ in awkward} and not {8, 9} & {d for d, _ in left}
    got = corpus_pipeline.run(spark, where).collect()
    assert len(got) == docs.count() and [r["start"] for r in sorted(got, key=lambda r: r["start"])][0] == 0


def test_no_documents_pass_all_stages(spark, nothing, folder):
    assert corpus_pipeline.run(spark, given(spark, folder, nothing)).collect() == []
