"""Incremental ingest: new cues become chunks batch by batch; a batch that comes twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.collection import Collection


def session_gaps(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after a pause, for streams: key, start, end, n."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_batches(path: str, make_rows: Callable[[DataFrame], DataFrame], key: str = "chunk_id", bucket_by: str | None = None, cluster_by: tuple[str, ...] = (), n_buckets: int = 64, keep: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows of a batch replace rows of the same key in a collection, which the first batch makes.

    A batch's number is its version: one that comes twice, or again after a crash, leaves what it left before. A batch without rows writes
    none. `keep`: how many versions stay."""

    def run(batch: DataFrame, number: int) -> None:
        rows = make_rows(batch)
        if rows.isEmpty():
            return
        table = Collection(batch.sparkSession, path)
        table.ensure(rows.schema, key, bucket_by, cluster_by, n_buckets)
        table.upsert(rows, number)
        if keep:
            table.vacuum(keep)

    return run


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches under `path`."""
    return [v for v in Collection(spark, path).versions() if v >= 0]


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last batch."""
    return Collection(spark, path).read()
