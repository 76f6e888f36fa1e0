"""Connectors to remote transcripts: protocols, fallbacks and retries. A failure is a row with a status.

The network clients are given by the caller; nothing here opens a connection by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TranscriptError(RuntimeError):
    """No transcript could be had."""


class RateLimited(TranscriptError):
    """The source refuses for now."""


@dataclass(frozen=True)
class ProxySetting:
    """kind: `rotating` (with user and password) or `plain` (with a url for both protocols). A client's factory makes its own object of it."""

    kind: str
    url: str | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)


@dataclass(frozen=True)
class NetworkOptions:
    """A cookies file is used before a browser's cookies."""

    proxy: str | None = None
    cookies_file: str | None = None
    cookies_browser: str | None = None
    language: str | None = None
    #: user and password of a rotating residential proxy, used for transcripts before the plain one
    rotating_proxy: tuple[str, str] | None = None

    def transcript_proxy(self) -> ProxySetting | None:
        """What a transcript client connects through."""
        if self.rotating_proxy and all(self.rotating_proxy):
            return ProxySetting("rotating", user=self.rotating_proxy[0], password=self.rotating_proxy[1])
        return ProxySetting("plain", url=self.proxy) if self.proxy else None

    def options(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.proxy:
            out["proxy"] = self.proxy
        if self.cookies_file:
            out["cookiefile"] = self.cookies_file
        elif self.cookies_browser:
            out["cookiesfrombrowser"] = (self.cookies_browser,)
        if self.language:
            out["extractor_args"] = {"youtube": {"lang": [self.language]}}
        return out


@dataclass
class Transcript:
    cues: list[tuple[str, float, float]]
    language: str
    generated: bool
    source: str = ""


class Fetcher(Protocol):
    def __call__(self, video_id: str) -> Transcript: ...


def choose_track(tracks: DataFrame, languages: Sequence[str] = ("ru", "ru-RU")) -> DataFrame:
    """Of each video's tracks (video_id, track_id, generated, and where known language, translatable, listed) one: a manual track in
    a wanted language (the first of them that is there), else a generated one, else the first listed that can be translated.

    Tracks without a language count as wanted. Videos with no such track have no row."""
    has = set(tracks.columns)
    language = F.col("language") if "language" in has else F.lit(None).cast("string")
    wanted = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in languages)), language), F.lit(1))
    translatable = F.coalesce("translatable", F.lit(False)) if "translatable" in has else F.lit(False)
    listed = F.col("listed") if "listed" in has else F.col("track_id")
    rank = F.when(wanted > 0, F.col("generated").cast("int")).when(translatable, 2)
    order = F.struct(rank.alias("rank"), F.when(rank < 2, wanted).alias("wanted"), listed.alias("listed"), F.col("track_id").alias("id"))
    chosen = tracks.filter(rank.isNotNull()).groupBy("video_id").agg(F.min_by(F.struct("track_id", "generated", (rank == 2).alias("translated")), order).alias("t"))
    return chosen.select("video_id", "t.*")


def with_retries(fetch: Fetcher, retries: int = 3, wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Fetcher:
    """Ask again while the source refuses, each time after a longer pause; at least once."""

    def run(video_id: str) -> Transcript:
        attempts = max(1, retries)
        for attempt in range(1, attempts + 1):
            try:
                return fetch(video_id)
            except RateLimited:
                if attempt == attempts:
                    raise
                sleep(wait * attempt)
        raise AssertionError

    return run


def checked(fetch: Fetcher, name: str) -> Fetcher:
    """Blank cues go; a transcript without cues is an error."""

    def run(video_id: str) -> Transcript:
        found = fetch(video_id)
        cues = [c for c in found.cues if c[0] and c[0].strip()]
        if not cues:
            raise TranscriptError(f"{video_id}: empty transcript")
        return Transcript(cues, found.language, found.generated, name)

    return run


def dispatch(source: str, fetchers: dict[str, Fetcher]) -> Fetcher:
    """`auto` tries the API, then the downloader unless the API refused; `asr` is speech recognition; all else the downloader."""
    asr, api, download = (checked(fetchers[n], n) if n in fetchers else None for n in ("asr", "ytapi", "ytdlp"))

    def auto(video_id: str) -> Transcript:
        try:
            return api(video_id)
        except RateLimited:
            raise
        except TranscriptError:
            return download(video_id)

    chosen = {"asr": asr, "ytapi": api, "auto": auto}.get(source, download)
    if chosen is None:
        raise ValueError(f"no fetcher for {source}")
    return chosen


@dataclass
class Breaker:
    """Stops a run after `limit` refusals in a row. What was skipped neither counts nor resets."""

    limit: int
    refused: int = 0

    def saw(self, status: str) -> bool:
        if status == "rate_limited":
            self.refused += 1
        elif status != "skip_exists":
            self.refused = 0
        return self.limit > 0 and self.refused >= self.limit


FETCHED = "video_id string, status string, error string, language string, is_generated boolean, source string, cues array<struct<text:string,start:double,duration:double>>"


@dataclass(frozen=True)
class FetchOptions:
    pause: float = 0.0
    breaker: int = 0
    sleep: Callable[[float], None] = field(default=time.sleep)


def fetch_transcripts(videos: DataFrame, make: Callable[[], Fetcher], options: FetchOptions = FetchOptions()) -> DataFrame:
    """video_id, status (ok, no_transcript, rate_limited, error, aborted), and cues.

    Politeness is kept by one task: the number of partitions is one, as the source counts requests, not executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, breaker, stopped = make(), Breaker(options.breaker), False
        for frame in frames:
            rows = []
            for video_id in frame["video_id"]:
                if stopped:
                    rows.append((video_id, "aborted", None, None, None, None, []))
                    continue
                try:
                    t = fetch(video_id)
                    rows.append((video_id, "ok", None, t.language, t.generated, t.source, [{"text": a, "start": float(b), "duration": float(c)} for a, b, c in t.cues]))
                except RateLimited as error:
                    rows.append((video_id, "rate_limited", str(error)[:200], None, None, None, []))
                except TranscriptError as error:
                    rows.append((video_id, "no_transcript", str(error)[:200], None, None, None, []))
                except Exception as error:  # noqa: BLE001  recorded as data
                    rows.append((video_id, "error", str(error)[:200], None, None, None, []))
                stopped = breaker.saw(rows[-1][1])
                if options.pause and not stopped:
                    options.sleep(options.pause)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in ("video_id", "status", "error", "language", "is_generated", "source", "cues")])

    return videos.select("video_id").coalesce(1).mapInPandas(run, FETCHED)


def cues_of(fetched: DataFrame) -> DataFrame:
    return fetched.filter("status = 'ok'").select("video_id", F.posexplode("cues").alias("cue_idx", "c")).select("video_id", "cue_idx", "c.*")


def speech_cues(segments: DataFrame) -> DataFrame:
    """Recognised speech (video_id, seg_no, text, start, end) cut into sentence cues; blank segments go."""
    from pyspark.sql import Window

    from quillspark.functions.text import strip
    from quillspark.operators.timeline import spread_sentences

    rows = segments.withColumn("text", strip(F.coalesce("text", F.lit("")))).filter("text != ''")
    cut = spread_sentences(rows, ["video_id", "seg_no"])
    w = Window.partitionBy("video_id").orderBy("seg_no", "pos")
    return cut.select("video_id", (F.row_number().over(w) - 1).cast("int").alias("cue_idx"), "text", "start", "duration")


class SpeechModel(Protocol):
    def transcribe(self, path: str) -> list[tuple[str, float, float]]:
        """(text, start, end) of each segment."""


def transcribe_audio(files: DataFrame, make: Callable[[], SpeechModel]) -> DataFrame:
    """Recognised segments of (video_id, path); the model is made once a worker. For speech_cues."""
    from quillspark.operators.models import per_worker

    get = per_worker(make)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        for frame in frames:
            rows = [(v, i, t, float(a), float(b)) for v, p in zip(frame["video_id"], frame["path"], strict=True) for i, (t, a, b) in enumerate(model.transcribe(p))]
            yield pd.DataFrame(rows, columns=["video_id", "seg_no", "text", "start", "end"])

    return files.select("video_id", "path").mapInPandas(run, "video_id string, seg_no int, text string, start double, end double")


def asr_fetcher(download: Callable[[str, str], list[str]], transcribe: Callable[[str], list[tuple[str, float, float]]], language: str, keep: str | None = None) -> Fetcher:
    """A fetcher by speech recognition. `download` puts files for a video into a folder and lists them; the largest is heard.

    The folder goes afterwards unless `keep` names one."""

    def run(video_id: str) -> Transcript:
        import os
        import shutil
        import tempfile

        folder = keep or tempfile.mkdtemp(prefix="audio-")
        try:
            files = download(video_id, folder)
            if not files:
                raise TranscriptError(f"{video_id}: no audio")
            found = transcribe(max(files, key=os.path.getsize))
            return Transcript([(t.strip(), a, max(b - a, 0.0)) for t, a, b in found if t and t.strip()], language, True, "asr")
        finally:
            if not keep:
                shutil.rmtree(folder, ignore_errors=True)

    return run


def playlist_entries(raw: DataFrame) -> DataFrame:
    """Entries with an id; a missing title is empty."""
    return raw.filter("video_id is not null and video_id != ''").withColumn("title", F.coalesce("title", F.lit("")))


def video_metadata(videos: DataFrame, metadata: DataFrame) -> DataFrame:
    """Full metadata where there is some (video_id, title, channel, uploader, upload_date, duration, description), else what is known."""
    m = metadata.select("video_id", *(F.col(c).alias(f"m_{c}") for c in ("title", "channel", "uploader", "upload_date", "duration", "description")))
    out = videos.join(m, "video_id", "left")
    some: Callable[[str], Column] = lambda c: F.nullif(F.col(c), F.lit(""))
    return out.select(
        "video_id", F.coalesce(some("m_title"), F.col("title")).alias("title"), F.coalesce(some("m_channel"), F.col("m_uploader")).alias("channel"),
        F.col("m_upload_date").alias("upload_date"), F.col("m_duration").cast("int").alias("duration"), F.col("m_description").alias("description"),
    )


__all__: Sequence[str] = ["Breaker", "FetchOptions", "NetworkOptions", "RateLimited", "Transcript", "TranscriptError", "choose_track", "cues_of", "dispatch", "fetch_transcripts", "largest_file", "playlist_entries", "speech_cues", "video_metadata", "with_retries"]

from quillspark.sources.readers import largest_file  # noqa: E402
