"""The store of transcripts: one row a video, with its metadata, raw cues, segments, removed windows and how they were made.

A run's rows go into a collection in one version, so a reader sees a run whole or not at all; a video is read from its bucket alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import CleanConfig
from quillspark.operators.timeline import clean_transcript
from quillspark.schemas import SEGMENT, SPAN, VIDEOS
from quillspark.session import materialize
from quillspark.sources.collection import Collection
from quillspark.sources.connectors import cues_of

RAW = "struct<text:string,start:double,duration:double>"
STORED = (
    f"video_id string, meta struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in VIDEOS.split(', '))}>, skipped boolean, language string, is_generated boolean, source string, punctuation_backend string, "
    f"raw_cues_count int, removed_ad_spans array<{SPAN}>, segments array<{SEGMENT}>, raw_cues array<{RAW}>"
)


def transcript_rows(videos: DataFrame, fetched: DataFrame, config: CleanConfig = CleanConfig(), labeller=None, backend: str = "none") -> DataFrame:
    """Rows of the store for videos (the columns of VIDEOS; those that are missing are null) that were fetched or passed over.

    `fetched`: video_id, status, language, is_generated, source, cues. Videos with other statuses have no row."""
    spark = videos.sparkSession
    kinds = dict(c.split() for c in VIDEOS.split(", "))
    meta = F.struct(*((F.col(c) if c in videos.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))
    known = videos.select("video_id", meta.alias("meta"))
    got = fetched.filter("status = 'ok'")
    segments, removed = clean_transcript(cues_of(got), config, labeller)
    listed = lambda rows, order, *names: F.transform(F.array_sort(F.collect_list(F.struct(order, *names))), lambda x: F.struct(*(x[n].alias(n) for n in names)))
    segments = segments.groupBy("video_id").agg(listed(segments, "seg_idx", "text", "start", "end", "timecode", "url").alias("segments"))
    removed = removed.withColumn("at", F.col("start")).groupBy("video_id").agg(listed(removed, "at", "start", "end").alias("removed_ad_spans"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    rows = known.join(got.select("video_id", "language", "is_generated", "source", F.col("cues").alias("raw_cues")), "video_id").join(segments, "video_id", "left").join(removed, "video_id", "left")
    done = rows.select("video_id", "meta", F.lit(False).alias("skipped"), "language", "is_generated", "source", F.lit(backend).alias("punctuation_backend"), F.size("raw_cues").alias("raw_cues_count"), empty("removed_ad_spans", SPAN), empty("segments", SEGMENT), "raw_cues")
    passed = known.join(fetched.filter("status = 'skip_non_recipe'").select("video_id"), "video_id", "left_semi").withColumn("skipped", F.lit(True))
    none = spark.createDataFrame([], STORED)
    return none.unionByName(done).unionByName(passed, allowMissingColumns=True)


def run_manifest(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """What became of each video of a run, in order: status, error, reason, and counts of what was stored of it."""
    about = stored.select("video_id", F.col("meta.is_recipe").alias("is_recipe"), F.col("meta.skip_reason").alias("reason"), F.size("segments").alias("segments"), F.col("raw_cues_count").alias("raw_cues"), F.size("removed_ad_spans").alias("ad_spans_removed"), F.col("source"), F.col("punctuation_backend").alias("punct"))
    rows = fetched.select("run_no", "video_id", "status", "error").join(about, "video_id", "left")
    only = lambda c, *statuses: F.when(F.col("status").isin(*statuses), F.col(c)).alias(c)
    return rows.select("run_no", "video_id", "status", "error", only("reason", "skip_non_recipe"), *(only(c, "ok") for c in ("is_recipe", "segments", "raw_cues", "ad_spans_removed", "source", "punct")))


class TranscriptStore:
    def __init__(self, spark: SparkSession, path: str):
        self.table = Collection(spark, path)

    def commit(self, rows: DataFrame, run: int | None = None, n_buckets: int = 64) -> int:
        """Put a run's rows in; the version."""
        self.table.ensure(STORED, "video_id", "video_id", ("video_id",), n_buckets)
        return self.table.upsert(rows, run)

    def existing(self) -> DataFrame:
        """video_id of transcripts that are there; videos that were passed over are not among them."""
        if not self.table.versions():
            return self.table.spark.createDataFrame([], "video_id string")
        return self.table.read().filter("NOT skipped").select("video_id")

    def transcript(self, video_id: str) -> dict | None:
        found = self.table.where(video_id).first()
        return found.asDict(True) if found else None

    def segments(self) -> DataFrame:
        """video_id, seg_idx, text, start, end, timecode, url of all transcripts."""
        return self.table.read().select("video_id", F.posexplode("segments").alias("seg_idx", "s")).select("video_id", "seg_idx", "s.*")

    def export_json(self, folder: str) -> None:
        """JSON lines of raw cues, transcripts and passed-over videos; texts are not escaped."""
        rows = materialize(self.table.read(), "export")
        write = lambda part, name: part.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")
        write(rows.filter("NOT skipped").select("video_id", "language", F.col("raw_cues").alias("cues")), "raw")
        write(rows.filter("NOT skipped").select("meta", "language", "is_generated", "source", "punctuation_backend", "raw_cues_count", "removed_ad_spans", "segments"), "processed")
        write(rows.filter("skipped").select("meta.*"), "skipped")
