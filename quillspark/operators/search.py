"""Filters, dense search for a batch of queries, rank fusion with the sparse one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.operators.sparse import SparseIndex, sparse_index, sparse_search, top_k


def conjunction(video_id: str | None = None, section: str | None = None, has_ingredients: bool | None = None) -> Column | None:
    """All conditions that are given; empty texts are none, False is one."""
    parts = []
    if video_id:
        parts.append(F.col("video_id") == video_id)
    if section:
        parts.append(F.col("section") == section)
    if has_ingredients is not None:
        parts.append(F.col("has_ingredients") == has_ingredients)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def intents(query: Column, patterns) -> Column:
    """Titles of all intents whose pattern the query matches, in order, each once."""
    found = F.array(*(F.when(F.regexp_like(query, F.lit("(?iuU)" + p)), F.lit(title)) for p, title in patterns))
    return F.array_distinct(F.array_compact(found))


def matches_intents(titles: Column, wanted: Column) -> Column:
    """Any wanted title is among the row's titles; no wish matches all."""
    return (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(titles, wanted), F.lit(False))


#: Queries multiplied with the index at a time, all that is sent to every task; and rows of the index at a time.
QUERY_BLOCK, ROW_BLOCK = 1024, 2048


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids, vectors = [], []
    for row in queries.select("query_id", "vector").toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == QUERY_BLOCK:
            yield ids, np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, np.float64)


def dense_search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Exact cosine search: (query_id, vector) against (chunk_id, vector), as query_id, chunk_id, score, rank.

    Queries go in blocks of QUERY_BLOCK; every task keeps its own k best of each query, so what is shuffled is k rows a
    query and task, whatever the size of the index."""
    kinds = dict(index.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    arrow = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(index.schema["chunk_id"].dataType), pa.float64()
    out = None
    for ids, vectors in _blocks(queries):
        sent = index.sparkSession.sparkContext.broadcast((ids, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, unit = sent.value
            names, scores = np.empty((len(ids), 0), object), np.empty((len(ids), 0))
            for batch in batches:
                for at in range(0, batch.num_rows, ROW_BLOCK):
                    part = batch.slice(at, ROW_BLOCK)
                    rows = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
                    named, new = np.array(part.column(0).to_pylist(), object)[None, :], np.round(unit @ rows.T, 9)
                    picked = _best(np.broadcast_to(named, new.shape), new, k)
                    names = np.concatenate([names, np.take_along_axis(np.broadcast_to(named, new.shape), picked, 1)], 1)
                    scores = np.concatenate([scores, np.take_along_axis(new, picked, 1)], 1)
                    picked = _best(names, scores, k)
                    names, scores = np.take_along_axis(names, picked, 1), np.take_along_axis(scores, picked, 1)
            if names.size:
                best = [(qid, n, s) for q, qid in enumerate(ids) for n, s in zip(names[q], scores[q].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*best, strict=True), arrow, strict=True)], ["query_id", "chunk_id", "score"])

        found = index.select("chunk_id", "vector").mapInArrow(run, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = index.sparkSession.createDataFrame([], f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
    return top_k(out, k)


def _best(names: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, by score and then name; ties at the edge are looked at whole."""
    k = min(k, scores.shape[1])
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = []
    for q in range(len(scores)):
        near = np.flatnonzero(scores[q] >= edge[q])
        out.append(sorted(near.tolist(), key=lambda j: (-scores[q, j], names[q, j]))[:k])
    return np.array(out)


def fused(ranked: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, rank)."""
    out = ranked[0].select("query_id", "chunk_id", "rank")
    for r in ranked[1:]:
        out = out.unionByName(r.select("query_id", "chunk_id", "rank"))
    scored = out.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"))
    return top_k(scored, k)


def search(query_vectors: DataFrame, query_terms: DataFrame, index: DataFrame, postings: DataFrame | SparseIndex, k: int, mode: str = "hybrid", overfetch: int = 5, constant: int = 60) -> DataFrame:
    """dense, sparse, or (any other mode) both fused; each branch of the fusion gives k * overfetch."""
    if mode == "dense":
        return dense_search(query_vectors, index, k)
    if mode == "sparse":
        return sparse_search(query_terms, postings, k)
    return fused([dense_search(query_vectors, index, k * overfetch), sparse_search(query_terms, postings, k * overfetch)], k, constant)


def point_lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of the wanted (video_id, chunk_index) pairs."""
    return chunks.join(wanted.select("video_id", "chunk_index").distinct(), ["video_id", "chunk_index"], "left_semi")
