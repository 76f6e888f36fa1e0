"""Upserts into buckets: what is written, what a crash leaves, what a lookup reads."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.models import HashEmbedder
from quillspark.plans import jobs
from quillspark.sources.collection import Collection

KIND = "chunk_id string, video_id string, chunk_index int, text string"


def rows_of(spark, numbers, text="t"):
    return spark.createDataFrame([(f"v{n // 10}::{n % 10}", f"v{n // 10}", n % 10, f"{text}{n}") for n in numbers], KIND)


def made(spark, path, **more):
    table = Collection(spark, f"file://{path}")
    table.ensure(KIND, "chunk_id", "video_id", ("video_id", "chunk_index"), **more)
    return table


def texts(frame):
    return {r["chunk_id"]: r["text"] for r in frame.collect()}


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    table = made(spark, tmp_path / "t", n_buckets=32)
    table.upsert(rows_of(spark, range(3000)))
    first = size(tmp_path)
    table.upsert(rows_of(spark, [5, 6], "new"))
    assert size(tmp_path) - first < first / 10
    want = {f"v{n // 10}::{n % 10}": f"{'new' if n in (5, 6) else 't'}{n}" for n in range(3000)}
    assert texts(table.read()) == want
    assert texts(table.read(0)) == {k: v.replace("new", "t") for k, v in want.items()}
    before = table.versions()
    table.upsert(rows_of(spark, []))
    assert table.versions() == before


def test_random_upserts_like_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    table, want = made(spark, tmp_path / "t", n_buckets=4), {}
    for batch in (0, 1, 1, 4, 3):
        numbers = rng.sample(range(60), 12)
        if batch > max(table.versions()):
            want |= {f"v{n // 10}::{n % 10}": f"b{batch}_{n}" for n in numbers}
        table.upsert(rows_of(spark, numbers, f"b{batch}_"), batch)
        assert texts(table.read()) == want
    twice = rows_of(spark, [1, 1], "x").withColumn("n", F.monotonically_increasing_id()).withColumn("text", F.concat("text", F.col("n").cast("string")))
    table.upsert(twice.unionByName(twice.limit(1).withColumn("chunk_id", F.lit(None).cast("string"))), order="n")
    last = twice.orderBy(F.desc("n")).first()["text"]
    assert texts(table.read()) == {**want, "v0::1": last}


@pytest.mark.parametrize("step", ["_write", "_commit", "rename"])
def test_a_crash_leaves_a_whole_version(spark, tmp_path, monkeypatch, step):
    table = made(spark, tmp_path / "t", n_buckets=4)
    table.upsert(rows_of(spark, range(40)), 0)
    before = texts(table.read())

    class Crash(Exception):
        pass

    def broken(*_):
        raise Crash

    with monkeypatch.context() as m:
        if step == "rename":

            class Files:
                def __init__(self, files):
                    self.files = files

                def __getattr__(self, name):
                    return broken if name == "rename" else getattr(self.files, name)

            m.setitem(table.__dict__, "_files", Files(table._files))
        elif step == "_commit":
            m.setattr(Collection, "_commit", broken)
        else:
            write = Collection._write
            m.setattr(Collection, "_write", lambda *a: (write(*a), broken()))
        with pytest.raises(Crash):
            table.upsert(rows_of(spark, range(30, 50), "new"), 1)
    again = Collection(spark, table.path)
    assert texts(again.read()) == before and again.versions()[-1] == 0
    again.upsert(rows_of(spark, range(30, 50), "new"), 1)
    want = {**before, **texts(rows_of(spark, range(30, 50), "new"))}
    assert texts(again.read()) == want
    gone = again.vacuum(keep=1)
    assert gone and texts(again.read()) == want and again.versions() == [1]
    assert [f.name for f in (tmp_path / "t" / "manifests").iterdir() if not f.name.endswith(".crc")] == ["1.json"]
    assert again.vacuum(keep=1) == []


def test_a_lookup_reads_few_files(spark, tmp_path):
    table = made(spark, tmp_path / "t", n_buckets=32)
    table.upsert(rows_of(spark, range(3000)))
    everything = len(table.read().inputFiles())
    wanted = spark.createDataFrame([("v7", 3), ("v7", 99), ("v250", 0)], "video_id string, chunk_index int")
    found = table.lookup(wanted, ["video_id", "chunk_index"])
    assert texts(found) == {"v7::3": "t73", "v250::0": "t2500"}
    assert len(found.inputFiles()) <= everything / 8
    one = table.where("v7", F.col("chunk_index") < 2)
    assert texts(one) == {"v7::0": "t70", "v7::1": "t71"} and len(one.inputFiles()) <= everything / 16
    assert table.ensure_indexes(["video_id", "nothing", "chunk_index"]) == {"video_id": "added", "nothing": "missing", "chunk_index": "added"}
    assert table.ensure_indexes(["video_id"]) == {"video_id": "there"}
    assert texts(table.read()) == texts(table.read(0)) and table.manifest().indexed == ("video_id", "chunk_index")
    table.upsert(rows_of(spark, [3], "late"))
    assert texts(table.where("v0"))["v0::3"] == "late3"


def test_ensure_and_recreate(spark, tmp_path):
    table = Collection(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.ensure(KIND) and not table.ensure(KIND) and table.read().count() == 0
    table.upsert(rows_of(spark, range(5)), 7)
    assert table.ensure(KIND, recreate=True) and table.read().count() == 0
    table.upsert(rows_of(spark, range(2)).drop("text").withColumn("more", F.lit(1)), 0)
    assert texts(table.read()) == {"v0::0": None, "v0::1": None}


def test_only_what_is_new_is_embedded(spark, tmp_path):
    log = str(tmp_path / "log")

    class Counting(HashEmbedder):
        def encode(self, texts):
            with open(log, "a") as f:
                f.write("x" * len(texts))
            return super().encode(texts)

    chunks = rows_of(spark, range(20)).withColumn("title", F.lit("T"))
    table = Collection(spark, f"file://{tmp_path}/t")
    for rows, calls in ((chunks, 20), (chunks, 20), (chunks.withColumn("text", F.when(F.col("chunk_index") == 3, "other words").otherwise(F.col("text"))), 22)):
        jobs.update_index(table, rows, Counting, n_buckets=4)
        assert len(open(log).read()) == calls
    vectors, postings = jobs.index_tables(table)
    want_vectors, want_postings = jobs.build_index(rows, HashEmbedder)
    assert sorted(map(str, vectors.collect())) == sorted(map(str, want_vectors.collect()))
    assert sorted(map(str, postings.collect())) == sorted(map(str, want_postings.collect()))
