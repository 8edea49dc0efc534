"""Every query over the small tables, and the pipeline."""

import duckdb
import pytest

import check
import corpus_pipeline
from __spark_entry__ import queries
from pairforge.llm.common import table
from pairforge.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_there_is_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL)
    rows = got.collect()
    assert rows
    if name in ORACLE:
        duck = duckdb.connect()
        for t in check.TABLES:
            duck.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
        want = duck.execute(ORACLE[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert check.rows(got.columns, rows) == check.rows(columns, want.fetchall())


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.durable(stage(spark, docs, SMALL), "stage")
        assert out.schema.names == docs.schema.names, name
        assert out.count() <= left
        docs, left = out, out.count()
    assert 0 < left < 200
    pieces = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}


@pytest.fixture
def tables(spark, documents):
    """A folder of small tables with odd rows in every one."""
    from pairforge.runtime import fresh_path

    folder = fresh_path(spark, "tables")
    passage = " ".join(f"item{i}" for i in range(30))
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (3, text.upper()), (4, passage + " and more"), (5, None), (6, ""), (7, "x" * 90_000)]
    rows += [(None, "of no id"), (8, "mail me at a@b.cd"), (9, text + " " + text)]
    spark.createDataFrame([(1, passage), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_pipeline_on_odd_rows(spark, tables):
    docs = table(spark, tables, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, tables), "stage")
    got = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == {1, 5, 6, 7, 8, None}  # 9 has nearly the shingles of 1
    assert got[8] == "mail me at <EMAIL>" and got[7] == "x" * 90_000 and got[None] == "of no id"
    assert docs.count() == 6
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert {p.doc_id for p in pieces} == set(got)


def test_pipeline_on_empty_tables(spark, tables):
    docs = table(spark, tables, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, tables), "stage")
    assert docs.count() == 0
