"""Queries of the text operators agree with their SQL, and the pipeline keeps what it should."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import compare, database

from snapdrift.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    got, want, diff = compare(spark, con, QUERIES[name], ORACLE[name], FOLDER)
    assert not diff
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_a_row_for_each(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert QUERIES[name](spark, FOLDER).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from test_llm_brute import near_components

    from snapdrift.llm import toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = toxicity.clean(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    groups = near_components([(r["doc_id"], r["text"]) for r in left], 5)
    one = [r for r in left if groups[r["doc_id"]][1] == r["doc_id"]]
    want = [r for r in one if not any(x in " ".join(r["text"].lower().split()) for x in items)]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in want)
    assert all(r["exact"] for r in got)
