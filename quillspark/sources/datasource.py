"""Subtitle folders as a data source: spark.read.format("subtitles").load(folder).

A row a cue: video_id (the file's name up to its first full stop), cue_idx, text, start, duration, path, error. Files are dealt to
partitions in ranges of about `partitionBytes`; conditions on video_id are pushed to the list of files, so others are not opened. A file
that cannot be read is one row with its error and no cue. Of several files of a video the best is taken, by format, then by `languages`
(separated by commas), then by name.

Options: partitionBytes (8 MiB), languages ("ru").
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quillspark.sources.readers import FORMATS, VTT_TIMES

SCHEMA = "video_id string, cue_idx int, text string, start double, duration double, path string, error string"
_TIMED = re.compile(VTT_TIMES)


def json3_file(content: str) -> list[tuple[str, float, float]]:
    """(text, start, duration) of JSON subtitles."""
    out = []
    for event in json.loads(content).get("events") or []:
        if event.get("segs") and event.get("tStartMs") is not None:
            text = "".join(s.get("utf8") or "" for s in event["segs"]).strip()
            if text:
                out.append((text, event["tStartMs"] / 1000.0, (event.get("dDurationMs") or 0.0) / 1000.0))
    return out


def vtt_file(content: str) -> list[tuple[str, float, float]]:
    """(text, start, duration) of WebVTT: a time line opens a cue."""
    cues: list[tuple[list[str], float, float]] = []
    for line in re.split(r"\r\n|\n|\r", content):
        bare = line.strip()
        if found := _TIMED.search(line):
            at = lambda i: int(found[i]) * 3600 + int(found[i + 1]) * 60 + float(found[i + 2].replace(",", "."))  # noqa: B023, E731
            cues.append(([], at(1), at(4)))
        elif cues and bare and "-->" not in line and not re.fullmatch(r"\d+", bare) and bare != "WEBVTT":
            cues[-1][0].append(re.sub(r"<[^>]+>", "", line).strip())
    rows = [(" ".join(parts).strip(), start, end - start) for parts, start, end in cues]
    return [r for r in rows if r[0]]


@dataclass
class FileRange(InputPartition):
    #: (video_id, path within the file system)
    files: tuple[tuple[str, str], ...]


class SubtitleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.bytes = int(options.get("partitionbytes", 8 << 20))
        self.languages = tuple(options.get("languages", "ru").split(","))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("video_id",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("video_id",):
                self._only(set(f.value))
            else:
                yield f

    def _only(self, videos: set[Any]) -> None:
        self.wanted = videos if self.wanted is None else self.wanted & videos

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def partitions(self) -> list[FileRange]:
        from pyarrow import fs

        system, folder = self._system()
        best: dict[str, tuple] = {}
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            kind = info.base_name.rsplit(".", 1)[-1]
            video = info.base_name.split(".", 1)[0]
            if info.type != fs.FileType.File or kind not in FORMATS or (self.wanted is not None and video not in self.wanted):
                continue
            language = next((i for i, name in enumerate(self.languages) if name in info.base_name), 99)
            rank = (FORMATS.index(kind), language, info.path, info.size or 0)
            if video not in best or rank < best[video]:
                best[video] = rank
        out, held, size = [], [], 0
        for video in sorted(best):
            held.append((video, best[video][2]))
            size += best[video][3]
            if size >= self.bytes:
                out.append(FileRange(tuple(held)))
                held, size = [], 0
        return [*out, FileRange(tuple(held))] if held or not out else out

    def read(self, partition: FileRange) -> Iterator[tuple]:
        system, _ = self._system()
        for video, path in partition.files:
            try:
                with system.open_input_stream(path) as stream:
                    content = stream.read().decode("utf-8")
                cues = vtt_file(content) if path.endswith(".vtt") else json3_file(content)
            except Exception as error:  # noqa: BLE001  a bad file is data
                yield video, None, None, None, None, path, repr(error)[:200]
                continue
            for i, (text, start, duration) in enumerate(cues):
                yield video, i, text, float(start), float(duration), path, None


class SubtitleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SubtitleReader:  # noqa: ARG002
        return SubtitleReader(dict(self.options))


def register(spark) -> None:
    """Make the format known to a session, and let conditions be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SubtitleSource)
