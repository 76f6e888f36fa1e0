"""Sinks: tables in Parquet, JSON for interchange, idempotent upserts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAILED = ("no_transcript", "error", "rate_limited")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_table(rows: DataFrame, path: str, export_json: str | None = None) -> None:
    """Parquet, and JSON lines (not escaped) if a path for them is given."""
    rows.write.mode("overwrite").parquet(path)
    if export_json:
        rows.sparkSession.read.parquet(path).write.mode("overwrite").option("ignoreNullFields", False).json(export_json)


def ensure_collection(spark: SparkSession, path: str, schema: str, recreate: bool = False) -> None:
    """An empty table if there is none, or anyway with `recreate`. Statistics in files stand for payload indexes."""
    if recreate or not exists(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """The manifest of a run, and its failures."""
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    manifest.filter(F.col("status").isin(*FAILED)).write.mode("overwrite").json(f"{folder}/failures")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upserted(existing: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """`existing` with the rows of `new`, which win; of repeated new keys the last by `order` wins."""
    fresh = last_of_each(new, key, order).drop(order) if order else new.dropDuplicates([key])
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def not_yet(rows: DataFrame, existing: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows whose key isn't there yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def dump_report(path: str, summary: dict) -> None:
    """A run's summary (a few numbers) as indented JSON; folders are made."""
    from pathlib import Path

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(summary, ensure_ascii=False, indent=2), encoding="utf-8")
