"""Dense search by inverted lists: every vector stands in the list of its nearest centroid; a query reads the lists near to it.

Centroids are fitted on at most `sample` vectors, those of least hash of chunk_id, on the driver; every vector is then assigned in its own
task and stored in order of lists. How many lists a search probes follows from the recall within the sample. A search multiplies, list by
list, the vectors with the queries that probe it; long lists and many
queries are dealt over groups of bounded size, so neither a hot list nor a large batch meets in one task, and only probed lists are
read. Conditions stand before the cut. With all lists probed the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.operators.sparse import top_k
from quillspark.session import materialize

#: Vectors and queries that meet in one group.
GROUP_ROWS, GROUP_QUERIES = 20_000, 1_024


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))


def probes_for(x: np.ndarray, centers: np.ndarray, recall: float, k: int = 10, asked: int = 500) -> int:
    """How many lists must be probed so that, within the sample, `recall` of the k nearest of some of its vectors are found."""
    if len(x) < 2:
        return 1
    queries = np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)
    near = x[queries] @ x.T
    near[np.arange(len(queries)), queries] = -2.0
    neighbours = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[queries] @ centers.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order
    needed = np.take_along_axis(place, (x @ centers.T).argmax(1)[neighbours], axis=1)
    return int(np.quantile(needed, recall, method="higher")) + 1


def fit_centroids(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 10, recall: float = 0.95) -> tuple[np.ndarray, int]:
    """Spherical k-means on a bounded sample of (chunk_id, vector), as many centroids as there are different vectors at most; and how many
    lists to probe for the wanted recall."""
    chosen = vectors.filter("vector IS NOT NULL").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toArrow()
    x = _unit(_matrix(chosen.column(0).combine_chunks())) if chosen.num_rows else np.zeros((0, 0))
    centers = np.unique(x.round(9), axis=0)
    if len(centers) > lists:
        # Each next centroid is the vector that is furthest from those chosen so far, among a spread of candidates.
        step = x[:: max(1, len(x) // (8 * lists))]
        picked, near = [0], step @ step[0]
        while len(picked) < min(lists, len(step)):
            picked.append(int(near.argmin()))
            near = np.maximum(near, step @ step[picked[-1]])
        centers = step[picked]
    for _ in range(rounds if len(centers) else 0):
        nearest = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        used = np.bincount(nearest, minlength=len(centers)) > 0
        centers = np.where(used[:, None], _unit(sums), centers)
    return centers, probes_for(x, centers, recall)


@dataclass(frozen=True)
class ListIndex:
    centroids: np.ndarray
    #: the vectors' rows with `list`, in order of lists
    rows: DataFrame
    #: list, n, deals (groups that its vectors are dealt over)
    sizes: DataFrame
    #: lists that a search probes unless it says otherwise
    probes: int


def _ranked_lists(frame: DataFrame, key: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """key, list: the `probes` lists nearest to each vector."""
    sent = frame.sparkSession.sparkContext.broadcast(centroids)
    kind = frame.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _unit(_matrix(batch.column(1))) @ centers.T
            nearest = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(score)), nearest.shape[1]))), pa.array(nearest.ravel().astype(np.int32))], [key, "list"])

    return frame.select(key, "vector").filter("vector IS NOT NULL").mapInArrow(run, f"`{key}` {kind.simpleString()}, list int")


def list_index(vectors: DataFrame, lists: int = 256, sample: int = 20_000, rounds: int = 10, recall: float = 0.95) -> ListIndex:
    """Index (chunk_id, vector, and whatever else conditions name). chunk_ids are unique; rows without a vector are in no list."""
    centroids, probes = fit_centroids(vectors, lists, sample, rounds, recall)
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("vector") if at is None else at
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((_unit(_matrix(batch.column(at))) @ sent.value.T).argmax(1).astype(np.int32))], [*batch.schema.names, "list"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    rows = vectors.filter("vector IS NOT NULL").mapInArrow(nearest, f"{kinds}, list int").repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id")
    rows = materialize(rows, "lists")
    sizes = rows.groupBy("list").agg(F.count("*").alias("n")).withColumn("deals", F.ceil(F.col("n") / GROUP_ROWS).cast("int"))
    return ListIndex(centroids, rows, materialize(sizes, "sizes"), probes)


def list_search(queries: DataFrame, index: ListIndex, k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """The k nearest by cosine of (query_id, vector) among the vectors in the `probes` nearest lists that meet a condition.

    As query_id, chunk_id, score, rank; ties go by chunk_id."""
    if not len(index.centroids):
        return top_k(queries.select("query_id", F.lit(None).cast(index.rows.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(0.0).alias("score")).limit(0), k)
    queries = queries.select("query_id", "vector").filter("vector IS NOT NULL")
    wanted = materialize(_ranked_lists(queries, "query_id", index.centroids, probes or index.probes), "probes")
    read = [r[0] for r in wanted.select("list").distinct().collect()]  # no more than there are centroids
    rows = index.rows.filter(F.col("list").isin(read)) if len(read) < len(index.centroids) else index.rows
    rows = rows if where is None else rows.filter(where)
    held = wanted.groupBy("list").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("askers")).join(index.sizes.select("list", "deals"), "list")
    held = materialize(held, "held")  # a row a list
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    ours = rows.join(held, "list").select("list", F.pmod(F.xxhash64("chunk_id"), F.col("deals")).cast("int").alias("deal"), spread(F.col("askers")).alias("asker"), "chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    theirs = wanted.join(held, "list").select("list", spread(F.col("deals")).alias("deal"), F.pmod(F.xxhash64("query_id"), F.col("askers")).cast("int").alias("asker"), "query_id")
    theirs = theirs.join(queries.withColumn("vector", F.col("vector").cast("array<double>")), "query_id")
    types = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(index.rows.schema["chunk_id"].dataType), pa.float64()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            names = left.column("chunk_id").combine_chunks().to_pylist()
            x = _unit(_matrix(left.column("vector").combine_chunks()))
            asked = right.column("query_id").to_pylist()
            score = np.round(_unit(_matrix(right.column("vector").combine_chunks())) @ x.T, 9)
            few = min(k, len(names))
            edge = -np.partition(-score, few - 1, axis=1)[:, few - 1]
            for q, query_id in enumerate(asked):
                near = np.flatnonzero(score[q] >= edge[q])
                found += [(query_id, names[j], float(score[q, j])) for j in sorted(near.tolist(), key=lambda j: (-score[q, j], names[j]))[:few]]
        columns = list(zip(*found, strict=True)) or [[]] * 3
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["query_id", "chunk_id", "score"])

    keys = ["list", "deal", "asker"]
    out = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(meet, f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {index.rows.schema['chunk_id'].dataType.simpleString()}, score double")
    return top_k(out, k)
