"""A table that is upserted into: rows in hash buckets, versions named by small manifests.

Under `path`, `data/ID/bucket=N` holds Parquet files that never change, `manifests/N.json` names the folder of each bucket as of version
N. An upsert writes the buckets that its rows fall into and then puts the next manifest in place by one rename; until then nothing is
different, so a crash anywhere leaves the version before it whole. A batch whose number is not above the newest version is in already
and changes nothing. There is one writer at a time. `vacuum` removes old versions and what crashed writes left.

Rows lie in buckets by `bucket_by` and in order of `cluster_by` within files; both are asked for when the table is made. A lookup reads
only the buckets of its keys, and in them, by statistics and Bloom filters, few row groups.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.session import materialize
from quillspark.sources.sinks import last_of_each


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    key: str
    bucket_by: str
    cluster_by: tuple[str, ...]
    n_buckets: int
    #: columns with Bloom filters
    indexed: tuple[str, ...]
    #: bucket to folder, for buckets that have rows
    folders: dict[str, str]


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @cached_property
    def _at(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    @cached_property
    def _files(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._at(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._files.listStatus(where)] if self._files.exists(where) else []

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """Of a version, or of the newest; None if the table is not there."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return None
        stream = self._files.open(self._at(f"{self.path}/manifests/{version}.json"))
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(**{**found, "cluster_by": tuple(found["cluster_by"]), "indexed": tuple(found["indexed"])})

    def _commit(self, manifest: Manifest) -> None:
        draft, target = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{manifest.version}.json")
        out = self._files.create(draft)
        try:
            out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        finally:
            out.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            raise RuntimeError(f"version {manifest.version} of {self.path} was written by another")

    def ensure(self, schema: str | StructType, key: str = "chunk_id", bucket_by: str | None = None, cluster_by: tuple[str, ...] = (), n_buckets: int = 64, recreate: bool = False) -> bool:
        """Make the table if it is not there, or anew and empty; whether it was made. `bucket_by` must follow from the key."""
        if self.versions():
            if not recreate:
                return False
            self._files.rename(self._at(f"{self.path}/manifests"), self._at(f"{self.path}/.dropped-{uuid.uuid4().hex}"))
            self.vacuum()
        kind = self.spark.createDataFrame([], schema).schema
        self._commit(Manifest(-1, kind.json(), key, bucket_by or key, tuple(cluster_by), n_buckets, (), {}))
        return True

    # Reading

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table as of a version (the newest), or some of its buckets."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(self.path)
        schema = StructType.fromJson(json.loads(m.schema))
        folders = [f"{self.path}/{f}" for b, f in sorted(m.folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, m: Manifest, value: Column) -> Column:
        kind = StructType.fromJson(json.loads(m.schema))[m.bucket_by].dataType
        return F.pmod(F.xxhash64(value.cast(kind)), F.lit(m.n_buckets)).cast("int")

    def lookup(self, wanted: DataFrame, on: list[str]) -> DataFrame:
        """Rows that agree with a row of `wanted` in `on`, which holds the column of the buckets; only their buckets are read."""
        m = self.manifest()
        buckets = {r[0] for r in wanted.select(self.bucket(m, F.col(m.bucket_by)).alias("b")).distinct().collect()}  # no more than there are buckets
        return self.read(m.version, buckets).join(wanted.select(*on).distinct(), on, "left_semi")

    def where(self, value, condition: Column | None = None) -> DataFrame:
        """Rows whose bucket column has this value, and that meet a condition: one bucket is read."""
        m = self.manifest()
        b = self.spark.range(1).select(self.bucket(m, F.lit(value))).first()[0]
        rows = self.read(m.version, {b}).filter(F.col(m.bucket_by) == F.lit(value))
        return rows if condition is None else rows.filter(condition)

    # Writing

    def _write(self, rows: DataFrame, m: Manifest) -> dict[str, str]:
        """Rows (with `bucket`) to a new folder; folders of the buckets that got some."""
        made = f"data/{uuid.uuid4().hex}"
        order = [*dict.fromkeys(["bucket", *m.cluster_by, m.key])]
        writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket")  # a large bucket is several files
        for c in m.indexed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.path}/{made}")
        return {n.split("=", 1)[1]: f"{made}/{n}" for n in self._names(made) if n.startswith("bucket=")}

    def upsert(self, rows: DataFrame, batch: int | None = None, order: str | None = None) -> int:
        """Rows replace those of the same key, the last by `order` of repeated ones; the version that holds them.

        Only buckets that the rows fall into are read and written. Rows without a key are left out.
        Columns that the table has not are left out, those that the rows have not are null."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(self.path)
        if batch is not None and batch <= m.version:
            return m.version
        schema = StructType.fromJson(json.loads(m.schema))
        rows = rows.filter(F.col(m.key).isNotNull())
        fresh = last_of_each(rows, m.key, order) if order else rows.dropDuplicates([m.key])
        fresh = fresh.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        fresh = materialize(fresh.withColumn("bucket", self.bucket(m, F.col(m.bucket_by))), "fresh")
        touched = {r[0] for r in fresh.select("bucket").distinct().collect()}
        if not touched:
            return m.version
        held = self.read(m.version, touched).withColumn("bucket", self.bucket(m, F.col(m.bucket_by)))
        made = self._write(held.join(fresh.select(m.key), m.key, "left_anti").unionByName(fresh), m)
        version = m.version + 1 if batch is None else batch
        self._commit(replace(m, version=version, folders={**m.folders, **made}))
        return version

    def ensure_indexes(self, columns: list[str]) -> dict[str, str]:
        """Bloom filters on these columns, in one rewrite for those that have none yet: column to added, there, or missing."""
        m = self.manifest()
        names = set(StructType.fromJson(json.loads(m.schema)).names)
        said = {c: "missing" if c not in names else "there" if c in m.indexed else "added" for c in columns}
        new = tuple(c for c in dict.fromkeys(columns) if said[c] == "added")
        if new:
            m = replace(m, version=m.version + 1, indexed=(*m.indexed, *new))
            rows = self.read(m.version - 1) if m.folders else None
            folders = self._write(rows.withColumn("bucket", self.bucket(m, F.col(m.bucket_by))), m) if rows is not None else {}
            self._commit(replace(m, folders=folders))
        return said

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the newest `keep` versions, and data that none of these names: the folders that went."""
        kept = self.versions()[-keep:]
        for name in self._names(""):
            if name.startswith(".dropped-"):
                self._files.delete(self._at(f"{self.path}/{name}"), True)
        for version in self.versions():
            if version not in kept:
                self._files.delete(self._at(f"{self.path}/manifests/{version}.json"), False)
        for name in self._names("manifests"):
            if name.startswith(".") and not name.endswith(".crc"):
                self._files.delete(self._at(f"{self.path}/manifests/{name}"), False)
        used = {f for v in kept for f in self.manifest(v).folders.values()}
        gone = []
        for name in self._names("data"):
            buckets = [f"data/{name}/{b}" for b in self._names(f"data/{name}") if b.startswith("bucket=")]
            unused = [b for b in buckets if b not in used]
            if len(unused) == len(buckets):
                unused = [f"data/{name}"]
            for folder in unused:
                self._files.delete(self._at(f"{self.path}/{folder}"), True)
            gone += unused
        return gone
