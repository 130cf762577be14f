"""The queries and the pipeline over the smallest tables."""

from __future__ import annotations

import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from tidewatch.llm import quality, toxicity
from tidewatch.llm.common import table
from tidewatch.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not present")


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q[:q.index("_") + 1] for q in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    assert check.difference(QUERIES[name](spark, SF_DIR).toPandas(), con.execute(ORACLES[name]).df()) is None


def test_stages_keep_columns(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, module, label, least):
    where = "/root/testdata/sf0.1"
    docs, labels = table(spark, where, "documents"), table(spark, where, "labels")
    rows = module.score_documents(docs, module.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows[label]).mean() >= least
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)
