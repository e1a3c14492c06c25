"""Queries that SQL can express against DuckDB, and the pipeline's stages against plain versions."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from sluice.llm import queries
from tests.llm.common import shingles
from tests.llm.test_dedup import brute_components

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF_DIR):
        duck.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF_DIR}/{f}'")
    got, want = queries.QUERIES[name](spark, SF_DIR), duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert ours == theirs and ours


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= set(driver.queries())


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of what it decides, on its own input."""
    docs = queries.table(spark, SF_DIR, "documents")
    items = [shingles(r["text"], 5, False) for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert sorted(out.columns) == sorted(docs.columns)
        docs = out
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept[name] = after
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, SF_DIR, "labels").collect()}
            right = [(d in after) == bool(q) for d, q in labels.items() if d in before]
            assert sum(right) >= 0.95 * len(right)
        if name == "jaccard_join":
            want = brute_components(sorted(before.items()), 5, 80, 100)
            assert set(after) == {d for d, n, c in want if n == 0 or d == c}
        if name == "decontamination":
            leaks = {d for d, t in before.items() for s in items if s and len(s & shingles(t, 5, False)) >= 0.8 * len(s)}
            assert set(after) == set(before) - leaks
        if name == "mixing":
            assert set(after) <= set(before) and after
    assert len(kept["substring_dedup"]) <= len(kept["jaccard_join"])
