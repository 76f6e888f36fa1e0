"""Blocks of cues on a stream: each video's open block and its rule's state are kept between micro-batches.

The rule is the one of batches (`timeline.block_rule`), pauses, sizes and sentence ends alike, so micro-batches of any cut give the rows
that one batch would, as long as a video's cues come in order of cue_idx. A video ends with a row that says so (`last`), or, where
cues have an event time, when the watermark is `idle` past its last one; then its open block is given out and its state goes. State is
one open block a video.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillspark.config import CleanConfig
from quillspark.functions.text import clean_line, ends_sentence, resegmented
from quillspark.operators.ordered import Rule
from quillspark.operators.timeline import block_rule, segments_of

OUT = "video_id string, range_no int, text string, start double, end double"
STATE = "base bigint, ranges int, rule string, held string"
_COLUMNS = ["video_id", "range_no", "text", "start", "end"]


def _step(rule: Rule, idle_ms: int | None) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        base, ranges, kept, held = (0, 0, None, [])
        if state.exists:
            base, ranges, rule_state, held_rows = state.get
            kept, held = json.loads(rule_state), json.loads(held_rows)
        last = state.hasTimedOut
        rows: list[tuple] = []
        seen = 0
        if not last:
            for frame in frames:
                if idle_ms is not None and len(frame):
                    seen = max(seen, int(frame["at"].max().timestamp() * 1000))
                rows += list(zip(frame["cue_idx"].tolist(), frame["text"].tolist(), frame["start"].tolist(), frame["end"].tolist(), frame["may_end"].tolist(), frame["last"].tolist(), strict=True))
            rows.sort(key=lambda r: (bool(r[5]), r[0]))  # the end stands behind all cues
            last = any(r[5] for r in rows)
        new = [[t, a, b, bool(m)] for _, t, a, b, m, end, in rows if not end and t]
        found, kept = rule.part([[len(r[0]) for r in new], [r[1] for r in new], [r[2] for r in new], [r[3] for r in new]], base, kept, last)
        first = base - len(held)
        held += [r[:3] for r in new]
        out = []
        for a, b in found:
            part = held[a - first : b - first + 1]
            out.append((key[0], ranges, " ".join(r[0] for r in part), part[0][1], part[-1][2]))
            ranges += 1
        upto = found[-1][1] + 1 - first if found else 0
        if last:
            state.remove()
        else:
            state.update((base + len(new), ranges, json.dumps(kept), json.dumps(held[upto:])))
            if idle_ms is not None:
                state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def stream_blocks(cues: DataFrame, config: CleanConfig = CleanConfig(), clean: bool = True, at: str | None = None, late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """As timeline.cue_blocks for a stream of (video_id, cue_idx, text, start, duration, last): append mode.

    A row whose `last` is true ends its video; its other columns don't count. `at` names a column of event times, whose watermark is `late`
    behind; `idle`: seconds by which it must be past a video's last cue to end it."""
    line = clean_line(F.col("text"), config.lexicon) if clean else F.col("text")
    last = F.coalesce("last", F.lit(False))
    timed = [F.col(at).alias("at")] if at else []
    cues = cues.withWatermark(at, late) if at else cues
    rows = cues.select("video_id", "cue_idx", F.coalesce(line, F.lit("")).alias("text"), "start", (F.col("start") + F.col("duration")).alias("end"), last.alias("last"), *timed)
    rows = rows.filter("last OR text != ''").withColumn("may_end", ends_sentence(F.col("text")))
    rule = block_rule(config.block_target, config.block_max, config.gap_seconds)
    timeout = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout
    found = rows.groupBy("video_id").applyInPandasWithState(_step(rule, int(idle * 1000) if at else None), OUT, STATE, "append", timeout)
    return segments_of(found, resegmented(F.col("text")))
