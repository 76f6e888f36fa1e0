"""Readers: labelled queries, chunks, transcripts, subtitles. All parse natively; bad rows are data, not failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip
from quillspark.schemas import CHUNKS, GOLDEN, TRANSCRIPT


def load_golden(spark: SparkSession, path: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """Labelled queries from JSON lines; blank lines are skipped, bad JSON fails. No kinds: all."""
    rows = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = rows.select(F.from_json("value", GOLDEN, {"mode": "FAILFAST"}).alias("g")).select("g.*")
    checked = parsed.select(
        F.when(F.col("id").isNull() | F.col("query").isNull(), F.raise_error(F.lit("a labelled query needs id and query")).cast("string")).otherwise(F.col("id")).alias("id"),
        "query",
        F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"),
        F.coalesce("kind", F.lit("exact")).alias("kind"),
        F.coalesce("expect_found", F.lit(True)).alias("expect_found"),
        F.coalesce("note", F.lit("")).alias("note"),
    )
    return checked.filter(F.col("kind").isin(*kinds)) if kinds else checked


def load_chunks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Chunks from JSON lines. limit: the first rows in file order; 0 gives none, None all."""
    if limit is not None and limit < 0:
        raise ValueError("limit is negative")
    rows = spark.read.schema(CHUNKS).json(path)
    if limit is None:
        return rows
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")).orderBy("_file", "_block", "_row").limit(limit).drop("_file", "_block", "_row")


def load_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document a file; manifests and invalid documents are left out. `file` keeps the order of names."""
    rows = spark.read.schema(TRANSCRIPT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    name = F.col("_metadata.file_name")
    rows = rows.select("*", name.alias("file")).filter(~F.col("file").isin("manifest.json", "failures.json"))
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("meta.video_id").isNotNull()).drop("_corrupt_record")


EVENTS = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"


def json3_cues(files: DataFrame) -> DataFrame:
    """(video_id, content) of JSON subtitles to cues. Events without pieces or start, and blank texts, go."""
    events = files.select("video_id", F.posexplode(F.from_json("content", EVENTS)["events"]).alias("pos", "e"))
    text = strip(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    rows = events.filter("size(e.segs) > 0 and e.tStartMs is not null").select("video_id", "pos", text.alias("text"), (F.col("e.tStartMs") / 1000.0).alias("start"), (F.coalesce("e.dDurationMs", F.lit(0.0)) / 1000.0).alias("duration"))
    w = Window.partitionBy("video_id").orderBy("pos")
    return rows.filter("text != ''").select("video_id", (F.row_number().over(w) - 1).cast("int").alias("cue_idx"), "text", "start", "duration")


VTT_TIMES = r"(\d{2}):(\d{2}):(\d{2}[.,]\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2}[.,]\d{3})"


def vtt_cues(files: DataFrame) -> DataFrame:
    """(video_id, content) of WebVTT to cues. A time line opens a block; tags, numbers and headers go, lines join by spaces."""
    lines = files.select("video_id", F.posexplode(F.split("content", r"\r\n|\n|\r", -1)).alias("pos", "line"))
    timed = F.regexp_like("line", F.lit(VTT_TIMES))
    w = Window.partitionBy("video_id").orderBy("pos")
    rows = lines.withColumns({"timed": timed, "bare": strip(F.col("line"))}).withColumn("block", F.count_if("timed").over(w))
    part = lambda i: F.regexp_extract("line", VTT_TIMES, i)
    at = lambda i: part(i).cast("int") * 3600 + part(i + 1).cast("int") * 60 + F.replace(part(i + 2), F.lit(","), F.lit(".")).cast("double")
    said = ~F.col("timed") & (F.col("bare") != "") & ~F.contains("line", F.lit("-->")) & ~F.regexp_like("bare", F.lit(r"(?U)^\d+$")) & (F.col("bare") != "WEBVTT")
    plain = F.struct("pos", strip(F.regexp_replace("line", "<[^>]+>", "")).alias("t"))
    blocks = rows.filter("block > 0").groupBy("video_id", "block").agg(
        F.max(F.when(F.col("timed"), at(1))).alias("start"), F.max(F.when(F.col("timed"), at(4))).alias("end"), F.array_sort(F.collect_list(F.when(said, plain))).alias("parts")
    )
    rows = blocks.select("video_id", "block", strip(F.array_join(F.transform("parts", lambda p: p["t"]), " ")).alias("text"), "start", (F.col("end") - F.col("start")).alias("duration")).filter("text != ''")
    order = Window.partitionBy("video_id").orderBy("block")
    return rows.select("video_id", (F.row_number().over(order) - 1).cast("int").alias("cue_idx"), "text", "start", "duration")


FORMATS = ("json3", "srv3", "vtt")


def preferred_subtitles(files: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Of each video's subtitle files (video_id, path, content) the best by format, then language, then name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rank = lambda values, test: F.coalesce(*(F.when(test(v), i) for i, v in enumerate(values)), F.lit(99))
    fmt = rank(FORMATS, lambda v: F.endswith(name, F.lit("." + v)))
    lang = rank(languages, lambda v: F.contains(name, F.lit(v)))
    rows = files.withColumns({"fmt": fmt, "lang_rank": lang}).filter(F.col("fmt") < 99)
    best = F.min_by(F.struct("path", "content", "fmt"), F.struct("fmt", "lang_rank", "path"))
    return rows.groupBy("video_id").agg(best.alias("b")).select("video_id", "b.path", "b.content", F.get(F.array(*(F.lit(f) for f in FORMATS)), F.col("b.fmt")).alias("format"))


def subtitle_cues(files: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Cues of each video's best subtitle file."""
    best = preferred_subtitles(files, languages)
    return json3_cues(best.filter("format != 'vtt'")).unionByName(vtt_cues(best.filter("format = 'vtt'")))


def largest_file(files: DataFrame) -> DataFrame:
    """Of each video's files (video_id, path, length) the largest."""
    return files.groupBy("video_id").agg(F.max_by("path", F.struct("length", "path")).alias("path"))
