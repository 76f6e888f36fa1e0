"""Timed cues: advertisement windows, blocks, punctuation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import CleanConfig, one_of
from quillspark.functions.text import SENTENCE_BREAK, clean_line, deep_link, ends_sentence, norm_word, resegmented, strip, tidy_sentence, timecode, words
from quillspark.operators.ordered import Rule, cut_ranges, numbered, running
from quillspark.operators.ranges import members
from quillspark.session import materialize


def merged_windows(hits: DataFrame, key: str, at: str, before: float, after: float) -> DataFrame:
    """Windows around hits, joined where they touch: key, start, end. Gaps and islands over a running maximum."""
    spans = hits.select(key, (F.col(at) - before).alias("start"), (F.col(at) + after).alias("end"))
    rows = running(numbered(spans, [key], ["start", "end"]), [key], "reach", F.col("end"), "max", current=False)
    new = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)
    islands = running(rows.withColumn("new", new), [key], "island", F.col("new"), "sum")
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def outside_windows(rows: DataFrame, windows: DataFrame, key: str, at: str) -> DataFrame:
    """Rows whose time is in no window, both ends included; rows without key or time are in none, and pass at once.

    A sweep: windows and rows of a key in order of time, each row held against the furthest end so far."""
    there = F.col(key).isNotNull() & F.col(at).isNotNull()
    opened = windows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col("start").alias("t"), F.lit(0).alias("kind"), F.col("end").alias("reach"))
    placed = rows.filter(there).select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("kind"), F.struct("*").alias("row"))
    swept = opened.unionByName(placed, allowMissingColumns=True).withColumn("tie", F.xxhash64("reach", "row"))
    swept = running(numbered(swept, ["k"], ["t", "kind", "tie"]), ["k"], "furthest", F.col("reach"), "max")
    return swept.filter(F.col("kind") == 1).filter(~F.coalesce(F.col("furthest") >= F.col("t"), F.lit(False))).select("row.*").unionByName(rows.filter(~there))


def strip_ads(cues: DataFrame, config: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """Cues outside advertisement windows, and the windows (to one decimal)."""
    hits = cues.filter(F.regexp_like("text", F.lit(one_of(config.lexicon.ad_markers))))
    windows = merged_windows(hits, "video_id", "start", config.ad_before, config.ad_after)
    kept = outside_windows(cues, windows, "video_id", "start")
    return kept, windows.select("video_id", F.round("start", 1).alias("start"), F.round("end", 1).alias("end"))


def block_rule(target: int, most: int, gap: float) -> Rule:
    """A block ends before a pause or once it is full, and after a place that may end it once it is long enough."""

    def part(columns: list[list], base: int, state: list | None, last: bool) -> tuple[list[tuple[int, int]], list]:
        sizes, starts, ends, may_end = columns
        first, size, before = state or (base, 0, None)
        found = []
        for i in range(len(sizes)):
            place = base + i
            if place > first and before is not None and (starts[i] - before >= gap or size >= most):
                found.append((first, place - 1))
                first, size = place, 0
            size += sizes[i] + 1
            before = ends[i]
            if size >= target and may_end[i]:
                found.append((first, place))
                first, size = place + 1, 0
        if last and first < base + len(sizes):
            found.append((first, base + len(sizes) - 1))
        return found, [first, size, before]

    return Rule(part)


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of each range in order, joined by spaces, with the range's times."""
    within = members(found).join(rows, ["video_id", "place"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return within.groupBy("video_id", "range_no").agg(F.array_join(parts, " ").alias("text"), F.min_by("start", "place").alias("start"), F.max_by("end", "place").alias("end"))


def segments_of(blocks: DataFrame, text) -> DataFrame:
    """Blocks (video_id, range_no, text, start, end) as segments with `text` for their text; empty ones go."""
    out = blocks.select("video_id", F.col("range_no").alias("seg_idx"), text.alias("text"), "start", "end").filter("text != ''")
    return out.select("video_id", "seg_idx", "text", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), timecode(F.col("start")).alias("timecode"), deep_link(F.col("video_id"), F.col("start")).alias("url"))


def cue_blocks(cues: DataFrame, config: CleanConfig = CleanConfig(), clean: bool = True) -> DataFrame:
    """Cleaned cues merged into blocks: video_id, seg_idx, text, start, end, timecode, url."""
    line = clean_line(F.col("text"), config.lexicon) if clean else F.col("text")
    rows = cues.select("video_id", "cue_idx", line.alias("text"), "start", (F.col("start") + F.col("duration")).alias("end")).filter("text != ''")
    rows = materialize(rows, "cues")  # they are counted, cut and joined
    rows = numbered(rows, ["video_id"], ["cue_idx"]).withColumns({"size": F.length("text"), "may_end": ends_sentence(F.col("text"))})
    found = cut_ranges(rows, ["video_id"], ["size", "start", "end", "may_end"], block_rule(config.block_target, config.block_max, config.gap_seconds))
    return segments_of(_joined(rows, found), resegmented(F.col("text")))


def sentence_blocks(sentences: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """As cue_blocks for whole sentences (video_id, sent_idx, text, start, end), each of which may end a block."""
    rows = numbered(sentences.filter("text != ''"), ["video_id"], ["sent_idx"]).withColumns({"size": F.length("text"), "may_end": F.lit(True)})
    found = cut_ranges(rows, ["video_id"], ["size", "start", "end", "may_end"], block_rule(config.block_target, config.block_max, config.gap_seconds))
    return segments_of(_joined(rows, found), F.trim("text"))


def sentence_rule(most: int) -> Rule:
    """A sentence ends at a final mark, or at a comma once it is long."""

    def part(columns: list[list], base: int, state: list | None, last: bool) -> tuple[list[tuple[int, int]], list]:
        sizes, final, comma = columns
        first, size = state or (base, 0)
        found = []
        for i in range(len(sizes)):
            size += sizes[i] + 1
            if final[i] or (size >= most and comma[i]):
                found.append((first, base + i))
                first, size = base + i + 1, 0
        if last and first < base + len(sizes):
            found.append((first, base + len(sizes) - 1))
        return found, [first, size]

    return Rule(part)


def assemble_sentences(tokens: DataFrame, most: int = 400) -> DataFrame:
    """Words with times (video_id, word_idx, text, start, end) to sentences: video_id, sent_idx, text, start, end."""
    rows = numbered(tokens.filter("text != ''"), ["video_id"], ["word_idx"])
    end = F.rtrim("text")
    rows = rows.withColumns({"size": F.length("text"), "final": F.regexp_like(end, F.lit("[.?!…]$")), "comma": F.endswith(end, F.lit(","))})
    found = cut_ranges(rows, ["video_id"], ["size", "final", "comma"], sentence_rule(most))
    out = _joined(rows, found).select("video_id", F.col("range_no").alias("sent_idx"), tidy_sentence(F.col("text")).alias("text"), F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))
    return out.filter("text != ''")


def cue_words(cues: DataFrame, config: CleanConfig = CleanConfig(), clean: bool = True) -> DataFrame:
    """Words of cues with their cue's times: video_id, word_idx, text, start, end."""
    line = clean_line(F.col("text"), config.lexicon) if clean else F.col("text")
    rows = cues.select("video_id", "cue_idx", F.posexplode(words(line)).alias("pos", "text"), "start", (F.col("start") + F.col("duration")).alias("end"))
    return numbered(rows, ["video_id"], ["cue_idx", "pos"]).select("video_id", F.col("place").alias("word_idx"), "text", "start", "end")


def label_windows(tokens: DataFrame, size: int = 150, stride: int = 110) -> DataFrame:
    """Overlapping runs of words: a row for each (window, word) with how central the word is there."""
    counts = tokens.groupBy(F.col("video_id").alias("counted")).agg(F.count("*").alias("n"))
    rows = tokens.join(counts, F.col("video_id").eqNullSafe(F.col("counted"))).drop("counted")
    first = F.greatest(F.lit(0), F.ceil((F.col("word_idx") - size + 1) / stride)).cast("int")
    last = F.floor(F.col("word_idx") / stride).cast("int")
    rows = rows.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    start = F.col("window") * stride
    half = (F.least(start + size, F.col("n")) - start) / 2
    central = 1.0 - F.abs((F.col("word_idx") - start) - half) / F.greatest(half, F.lit(1.0))
    return rows.withColumns({"position": F.col("word_idx") - start, "centrality": central}).drop("n")


def spread_sentences(rows: DataFrame, keys: list[str], pattern: str = SENTENCE_BREAK) -> DataFrame:
    """X6 for texts of any length: keys, pos, text, start, duration of each sentence of (text, start, end).

    As sentence_cues, by exploding and a running sum. `keys` name a row."""
    parts = F.filter(F.transform(F.split("text", pattern, -1), strip), lambda p: p != "")
    span = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    cut = F.when(F.size(parts) < 2, F.array("text")).otherwise(parts)
    rows = rows.select(*keys, F.col("start").alias("begin"), span.alias("span"), F.posexplode(cut).alias("pos", "text"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(F.length("text")).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_char = F.col("span") / F.greatest(F.sum(F.length("text")).over(whole), F.lit(1))
    alone = F.count("*").over(whole) == 1
    return rows.select(*keys, "pos", "text", (F.col("begin") + before * per_char).alias("start"), F.when(alone, F.col("span")).otherwise(F.length("text") * per_char).alias("duration"))


def best_labels(labelled: DataFrame) -> DataFrame:
    """Of each word the label from the window where it is most central; the earlier window wins a tie."""
    return labelled.groupBy("video_id", "word_idx").agg(F.max_by("label", F.struct("centrality", (-F.col("window")).alias("w"))).alias("label"))


def align_restored(pairs: DataFrame) -> DataFrame:
    """(video_id, original array, restored array) to `aligned`: restored words where they match, one word may be passed over.

    Two pointers over a video's words, in linear time; only their normal forms go through Python, and places come back."""
    norms = lambda c: F.transform(c, norm_word).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks = []
            for original, restored in zip(batch.column("original").to_pylist(), batch.column("restored").to_pylist(), strict=True):
                j, n, picked = 0, len(restored or ()), []
                for want in original or ():
                    here = j < n and want is not None and restored[j] == want
                    following = not here and j + 1 < n and want is not None and restored[j + 1] == want
                    picked.append(j if here else j + 1 if following else -1)
                    j += 1 if here else 2 if following else int(j < n)
                picks.append(picked)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(picks, pa.list_(pa.int32()))], ["row", "picks"])

    kind = pairs.select(F.struct("video_id", "original", "restored").alias("row")).schema["row"].dataType.simpleString()
    found = pairs.select(F.struct("video_id", "original", "restored").alias("row"), norms("original"), norms("restored")).mapInArrow(run, f"row {kind}, picks array<int>")
    chosen = F.zip_with("row.original", "picks", lambda word, i: F.when(i >= 0, F.get(F.col("row.restored"), i)).otherwise(word))
    return found.select("row.video_id", F.when(F.col("row.original").isNotNull() & F.col("row.restored").isNotNull(), chosen).alias("aligned"))


def restore_in_windows(tokens: DataFrame, restore: Callable[[str], str], size: int = 400) -> DataFrame:
    """Fixed runs of words through a text restorer; a run that fails keeps its words. video_id, original, restored."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"])
    runs = tokens.groupBy("video_id", F.floor(F.col("word_idx") / size).alias("run")).agg(whole.alias("original"))

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part in frame["original"]:
                text = " ".join(part)
                try:
                    out.append(re.split(r"\s+", restore(text).strip()) if text else [])
                except Exception:  # noqa: BLE001  any failure of the model
                    out.append(list(part))
            yield frame.assign(restored=out)

    made = runs.mapInPandas(apply, "video_id string, run bigint, original array<string>, restored array<string>")
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", c))), lambda x: x[c]))
    return made.groupBy("video_id").agg(flat("original").alias("original"), flat("restored").alias("restored"))


def clean_transcript(cues: DataFrame, config: CleanConfig = CleanConfig(), labeller: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments and removed windows. `labeller`: adds `label` to the rows of label_windows; without it cues are merged as they are."""
    kept, removed = strip_ads(cues, config)
    if labeller is None:
        return cue_blocks(kept, config), removed
    from quillspark.functions.text import decode_label

    tokens = cue_words(kept, config)
    labels = best_labels(labeller(label_windows(tokens)))
    decoded = tokens.join(labels, ["video_id", "word_idx"], "left").withColumn("text", decode_label(F.col("text"), F.coalesce("label", F.lit("LOWER_O")))).drop("label")
    return sentence_blocks(assemble_sentences(decoded), config), removed
