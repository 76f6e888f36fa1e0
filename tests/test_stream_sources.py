"""Blocks on streams, and subtitle folders as a data source, against their batch versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.config import CleanConfig
from quillspark.operators import timeline
from quillspark.sources import readers

CUES = "video_id string, cue_idx int, text string, start double, duration double, last boolean"


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_stream_blocks_like_one_batch(spark, tmp_path, cuts):
    from quillspark.streaming.blocks import stream_blocks

    rng = random.Random(cuts)
    rows, at = [], 0.0
    for i in range(120):
        at += rng.choice([1.0, 2.0, 9.0 if rng.random() < 0.2 else 1.0])
        rows.append((f"v{i % 2}", i // 2, "x" * rng.randint(0, 90) + rng.choice(["", "."]), at, 0.5, False))
    whole = timeline.cue_blocks(spark.createDataFrame(rows, CUES).drop("last"), CleanConfig(), clean=False)
    bounds = sorted(rng.sample(range(1, 120), cuts - 1)) if cuts > 1 else []
    ends = [(v, None, None, None, None, True) for v in ("v0", "v1")]
    parts = [rows[a:b] for a, b in zip([0, *bounds], [*bounds, 120])]
    parts[-1] = parts[-1] + ends if cuts != 3 else parts[-1]
    parts += [ends] if cuts == 3 else []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(CUES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_blocks(stream, CleanConfig(), clean=False).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for part in parts:
            spark.createDataFrame(part, CUES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.columns == whole.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_a_silent_video_ends_by_its_watermark(spark, tmp_path):
    from quillspark.streaming.blocks import stream_blocks

    kind = "video_id string, cue_idx int, text string, start double, duration double, last boolean, at timestamp"
    row = lambda v, i, text, second: (v, i, text, float(second), 1.0, False, second)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_blocks(stream, CleanConfig(), clean=False, at="at", late="1 second", idle=30.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for rows in ([row("a", 0, "one", 0), row("a", 1, "two.", 1)], [row("b", 0, "late", 100)], [row("b", 1, "later", 101)]):
            spark.createDataFrame([(*r[:-1], r[-1]) for r in rows], kind.replace("timestamp", "int")).withColumn("at", F.timestamp_seconds(F.col("at") + 1_000_000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query.processAllAvailable()
    finally:
        query.stop()
    assert [(r["video_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", "One two.")]


def folder(path):
    path.mkdir()
    events = [{"tStartMs": 1500, "dDurationMs": 700, "segs": [{"utf8": " a "}, {"utf8": "b"}, {}]}, {"segs": [{"utf8": "no start"}]}, {"tStartMs": 0}, {"tStartMs": 3000, "segs": [{"utf8": "\n"}]}, {"tStartMs": 4000, "segs": [{"utf8": "é"}]}]
    vtt = "WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02,500 align:start\n<c>Hello</c> there\n\nagain <b>x</b>\n2\n00:01:00.000 --> 00:01:01.000\n\n01:00:00.250 --> 01:00:01.000\nlate"
    for i in range(30):
        if i % 2:
            (path / f"v{i}.ru.json3").write_text(json.dumps({"events": events}))
            (path / f"v{i}.ru.vtt").write_text(vtt)
        else:
            (path / f"v{i}.en.vtt").write_text(vtt.replace("Hello", "Other"))
            (path / f"v{i}.ru.vtt").write_text(vtt.replace("late", f"late {i}"))
    (path / "bad.ru.json3").write_text("{")
    (path / "manifest.json").write_text("[]")


def test_subtitle_source(spark, tmp_path):
    from quillspark.sources.datasource import register

    register(spark)
    folder(tmp_path / "subs")
    read = lambda: spark.read.format("subtitles").option("partitionBytes", 1000).load(f"file://{tmp_path}/subs")
    found = read()
    files = [(p.name.split(".")[0], str(p), p.read_text()) for p in (tmp_path / "subs").iterdir() if p.name != "bad.ru.json3"]
    want = readers.subtitle_cues(spark.createDataFrame(files, "video_id string, path string, content string"), ["ru"])
    got = found.filter("error IS NULL").select("video_id", "cue_idx", "text", "start", "duration")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() == 60
    bad = found.filter("error IS NOT NULL").collect()
    assert [(r["video_id"], r["text"]) for r in bad] == [("bad", None)]
    assert found.rdd.getNumPartitions() > 3
    one = read().filter(F.col("video_id") == "v3")
    assert one.rdd.getNumPartitions() == 1 and {r["video_id"] for r in one.collect()} == {"v3"}
    two = read().filter(F.col("video_id").isin("v3", "v4") & (F.col("start") < 2))
    assert {(r["video_id"], r["text"]) for r in two.collect()} == {("v3", "a b"), ("v4", "Hello there again x")}
    assert read().filter(F.col("video_id") == "none").count() == 0
    # A bad file elsewhere is not opened.
    assert read().filter(F.col("video_id") == "v5").filter("error IS NOT NULL").count() == 0
