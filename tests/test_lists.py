"""Inverted lists: recall at the default, exactness with all lists, conditions, hot lists."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import lists
from quillspark.operators.search import dense_search

DATA = os.environ.get("TEST_LISTS_DIR", "/root/testdata/sf0.1")


def pairs(frame):
    return {(r["query_id"], r["chunk_id"], r["rank"]) for r in frame.collect()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    queries = rows.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    index = lists.list_index(rows, lists=64)
    assert index.probes < 64
    assert index.rows.count() == rows.count() and index.sizes.count() > 32
    exact = pairs(dense_search(queries, rows.withColumn("vector", F.col("vector").cast("array<double>")), 10))
    want = {p[:2] for p in exact}
    assert len(want & {p[:2] for p in pairs(lists.list_search(queries, index, 10))}) / len(want) >= 0.9
    assert pairs(lists.list_search(queries, index, 10, probes=64)) == exact
    few = {p[:2] for p in pairs(dense_search(queries, rows.filter("label = 3").withColumn("vector", F.col("vector").cast("array<double>")), 10))}
    got = {p[:2] for p in pairs(lists.list_search(queries, index, 10, probes=64, where=F.col("label") == 3))}
    assert got == few


def test_hot_list_and_many_queries_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lists, "GROUP_ROWS", 50)
    monkeypatch.setattr(lists, "GROUP_QUERIES", 7)
    rng = random.Random(1)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 else [rng.random() for _ in range(3)], i % 2) for i in range(700)] + [(-1, None, 0)]
    frame = spark.createDataFrame(rows, "chunk_id int, vector array<double>, side int").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", [1.0, rng.random() / 9, 0.0]) for i in range(40)] + [("none", None)], "query_id string, vector array<double>")
    index = lists.list_index(frame, lists=8)
    assert index.sizes.agg(F.max("deals")).first()[0] > 5
    assert pairs(lists.list_search(queries, index, 9, probes=8)) == pairs(dense_search(queries.filter("vector is not null"), frame.filter("vector is not null"), 9))
    assert lists.list_search(queries.limit(0), index, 9).count() == 0
    assert lists.list_search(queries, lists.list_index(frame.limit(0)), 9).count() == 0


def test_only_probed_lists_are_read(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.05, 8) + np.eye(8)[i % 8]) for i in range(4000)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "chunk_id int, vector array<double>")
    index = lists.list_index(frame, lists=8)
    queries = frame.filter("chunk_id = 5").withColumnRenamed("chunk_id", "query_id")
    found = lists.list_search(queries, index, 3, probes=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(list" in plan or "EqualTo(list" in plan
    assert found.filter("rank = 1").first()["chunk_id"] == 5
