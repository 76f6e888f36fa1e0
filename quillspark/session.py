"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application; they may start in any folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillspark-code-")) / "quillspark_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path(root.name) / file.relative_to(root))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode, where it may be unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.sparkContext.setCheckpointDir(found)
        leave(spark, found)
    return found.rstrip("/")


def leave(spark: SparkSession, path: str) -> None:
    """Remove `path`, which must exist by now, when the driver's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quill-{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    leave(spark, path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a small intermediate table to the shared folder and read it again, so that plans stay flat and tasks restart from it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    leave(spark, path)
    return spark.read.schema(df.schema).parquet(path)
