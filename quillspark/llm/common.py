"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import shared_dir, ship

#: `[\x20\x09-\x0D]`, the white space of every contract.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def text_version(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder. What is written there goes by `discard`, or with the driver's JVM by `leave`."""
    return f"{shared_dir(spark)}/quill-{tag}-{uuid.uuid4().hex}"


def leave(spark: SparkSession, path: str) -> None:
    """Remove `path`, which must exist by now, when the driver's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    leave(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by `materialize` that nothing reads any more, and let Spark drop the shuffle files of what is out of use."""
    gc.collect()
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(df.scratch)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        jvm.System.gc()


@contextmanager
def bucketed(df: DataFrame, tag: str, buckets: int, key: str, partition_by: str) -> Iterator[DataFrame]:
    """A table in the shared folder, bucketed by `key`, so that it can be grouped by it again and again without a shuffle."""
    spark = df.sparkSession
    path, name = scratch_path(spark, tag), f"quill_{tag}_{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(partition_by).bucketBy(min(buckets, 100_000), key).option("path", path).saveAsTable(name)
        leave(spark, path)
        out = spark.table(name)
        out.scratch = path
        yield out
        discard(out)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def trim() -> None:
    """Give a worker's free memory back to the system at the end of a task; workers are kept, and share a machine with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the plan's size, without a job. It follows file sizes; where it knows nothing, partitions count."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 54 else df.rdd.getNumPartitions() * (32 << 20)


def text_slices(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows holding about `limit` characters (one row at least), to bound a Python worker's memory."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 16
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def doc_slices(batches: Iterable[pa.RecordBatch], limit: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """(doc ids, texts) in runs of about `limit` characters; a null text is empty. Columns: doc_id, text."""
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        sizes = column.nbytes
        step = max(1, min(len(ids), len(ids) * limit // max(1, sizes)))
        for at in range(0, len(ids), step):
            texts = [t or "" for t in column.slice(at, step).to_pylist()]
            for a, b in text_slices(texts, limit):
                yield ids[at + a : at + b], texts[a:b]
