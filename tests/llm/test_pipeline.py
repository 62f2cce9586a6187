"""The pipeline stage by stage, and the queries on the small tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SMALL)
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns, name
    assert len(corpus_pipeline.STAGES) == 5
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > counts[4] == counts[5] > 0


def test_stages_take_odd_documents(spark, documents):
    for name, function in corpus_pipeline.STAGES:
        found = function(spark, documents, SMALL)
        assert found.count() <= documents.count(), name
        assert function(spark, documents.limit(0), SMALL).count() == 0, name


def test_run_gives_each_document_one_place(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert {r.shard for r in rows} <= set(range(24))


@pytest.mark.parametrize("n", range(1, 11))
def test_queries_are_registered_and_cover_their_table(spark, n):
    names = [q for q in entry.queries() if q.startswith(f"op{n}_")]
    assert len(names) == 1
    got = entry.queries()[names[0]](spark, SMALL)
    if n == 7:
        turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
        assert got.count() == turns.select("conv_id").distinct().count() + 1
    elif n != 9:
        assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
