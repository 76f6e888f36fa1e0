"""Sections and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import ChunkConfig, Lexicon, RUSSIAN, one_of
from quillspark.functions.text import deep_link, marker_scores, starts_step, timecode, token_count
from quillspark.operators.models import TokenCounter, counted_tokens
from quillspark.operators.ordered import WHOLE, Rule, cut_ranges, numbered
from quillspark.operators.ranges import members
from quillspark.session import materialize


def section(text: Column, position: Column, lexicon: Lexicon = RUSSIAN) -> Column:
    """Section of a text at a relative position: intro and outro at the edges, else by marks."""
    low = F.lower(text)
    ingredients, steps = marker_scores(low, lexicon)
    said = lambda marks, bounded=False: F.regexp_like(low, F.lit(one_of(marks, bounded)))
    return (
        F.when((position <= 0.12) & said(lexicon.intro_markers), "intro")
        .when((position >= 0.82) & said(lexicon.outro_markers), "outro")
        .when((ingredients >= 2) & (ingredients > steps), "ingredients")
        .when((steps >= 2) & (steps >= ingredients), "steps")
        .when((steps == 1) & (ingredients == 0) & said(lexicon.sequence_markers, True), "steps")
        .otherwise("other")
    )


def smoothed(label: str, key: list[str], order: list[str]) -> Column:
    """A lone `other` between two equal content labels takes their label."""
    w = Window.partitionBy(*key).orderBy(*order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    return F.when((F.col(label) == "other") & (before == after) & before.isin("ingredients", "steps"), before).otherwise(F.col(label))


def labelled(segments: DataFrame, lexicon: Lexicon = RUSSIAN) -> DataFrame:
    """segments with `label`, and `place`, `part` and `n` within the video."""
    rows = numbered(segments, ["video_id"], ["seg_idx"], total="n")
    rows = rows.withColumn("label", section(F.col("text"), F.col("place") / F.col("n"), lexicon))
    whole = rows.filter(F.col("part") == WHOLE).withColumn("label", smoothed("label", ["video_id"], ["place"]))
    split = rows.filter(F.col("part") != WHOLE)
    # A split video's neighbours meet by place, for no task holds them all.
    beside = lambda step, name: split.filter(F.col("label").isin("ingredients", "steps")).select(F.col("video_id").alias(f"{name}_id"), (F.col("place") + step).alias(f"{name}_place"), F.col("label").alias(name))
    meets = lambda name: F.col("video_id").eqNullSafe(F.col(f"{name}_id")) & (F.col("place") == F.col(f"{name}_place"))
    split = split.join(beside(1, "earlier"), meets("earlier"), "left").join(beside(-1, "later"), meets("later"), "left")
    split = split.withColumn("label", F.when((F.col("label") == "other") & (F.col("earlier") == F.col("later")), F.col("earlier")).otherwise(F.col("label")))
    return whole.unionByName(split.select(*whole.columns))


def dominant(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The most frequent label of each group, `other` only if there is nothing else; `mixed` if several are."""
    counts = labels.groupBy(*keys, label).agg(F.count("*").alias("n"))
    rank = F.when(F.col(label) == "other", 0).otherwise(F.col("n"))
    tops = counts.withColumn("rank", rank).groupBy(*keys).agg(F.max("rank").alias("top"), F.collect_list(F.struct("rank", label)).alias("all"))
    winners = F.filter("all", lambda x: x["rank"] == F.col("top"))
    return tops.select(*keys, F.when(F.size(winners) == 1, F.get(winners, F.lit(0))[label]).otherwise("mixed").alias("section"))


def dominant_of(labels: Column) -> Column:
    """As `dominant`, of an array of labels."""
    rank = lambda x: F.when(x == "other", 0).otherwise(F.size(F.filter(labels, lambda y: y == x)))
    counts = F.transform(F.array_distinct(labels), lambda x: F.struct(rank(x).alias("rank"), x.alias("label")))
    best = F.aggregate(counts, F.lit(-1), lambda top, x: F.greatest(top, x["rank"]))
    winners = F.transform(F.filter(F.transform(counts, lambda x: F.struct(x["rank"], x["label"], best.alias("top"))), lambda x: x["rank"] == x["top"]), lambda x: x["label"])
    return F.when(F.size(winners) == 1, F.get(winners, F.lit(0))).otherwise("mixed")


def chunk_rule(config: ChunkConfig) -> Rule:
    """Chunks as ranges of segments; a chunk may begin with one or two segments that ended the one before."""

    def part(columns: list[list], base: int, state: list | None, last: bool) -> tuple[list[tuple[int, int]], list]:
        tokens, labels, opens = columns
        # The open range and its size, the last two segments' sizes, the last label, and the range before, which a short last one is added to.
        first, here, one, two, label, held = state or (base, 0, 0, 0, None, None)
        found = []
        for i in range(len(tokens)):
            place = base + i
            if place > first:
                changed = labels[i] != label
                listing = not changed and not opens[i] and labels[i] == "ingredients"
                if here >= config.max or (here >= config.target and not listing):
                    if held:
                        found.append(tuple(held))
                    held = [first, place - 1]
                    if changed or config.overlap <= 0:
                        first, here = place, 0
                    elif one >= config.overlap or first > place - 2:
                        first, here = place - 1, one
                    else:
                        first, here = place - 2, one + two
            here += tokens[i]
            one, two, label = tokens[i], one, labels[i]
        end = base + len(tokens) - 1
        if last and end >= 0:
            if held and here < config.min:
                first, held = held[0], None
            if held:
                found.append(tuple(held))
            found.append((first, end))
        return found, [first, here, one, two, label, held]

    return Rule(part)


def _tokens(text: Column, config: ChunkConfig, counter: Callable[[], TokenCounter] | None) -> Column:
    return token_count(text, config.chars_per_token) if counter is None else counted_tokens(text, counter)


def chunk_ranges(rows: DataFrame, config: ChunkConfig = ChunkConfig(), counter: Callable[[], TokenCounter] | None = None) -> DataFrame:
    """video_id, range_no, first, last from labelled segments."""
    counted = rows.withColumns({"tokens": _tokens(F.col("text"), config, counter), "opens": starts_step(F.col("text"), config.lexicon)})
    return cut_ranges(counted, ["video_id"], ["tokens", "label", "opens"], chunk_rule(config))


def chunks(segments: DataFrame, videos: DataFrame, config: ChunkConfig = ChunkConfig(), counter: Callable[[], TokenCounter] | None = None) -> DataFrame:
    """The chunk table from segments and videos (video_id, title, playlist_ids, playlist_titles). Without a counter tokens are estimated."""
    rows = materialize(labelled(segments, config.lexicon).drop("n"), "segments")
    spans = materialize(chunk_ranges(rows, config, counter), "ranges")
    sizes = spans.groupBy("video_id").agg(F.count("*").cast("int").alias("n_chunks"))
    found = members(spans.join(sizes, "video_id")).join(rows, ["video_id", "place"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    merged = found.groupBy("video_id", "range_no", "n_chunks").agg(
        F.trim(F.array_join(parts, " ")).alias("text"),
        F.min_by("start", "place").alias("start"),
        F.max_by("end", "place").alias("end"),
        F.collect_list("label").alias("labels"),
        F.bool_or(F.col("label") == "ingredients").alias("has_ingredients"),
        F.bool_or(F.col("label") == "steps").alias("has_steps"),
    )
    # All that needs the text stands before the join, so that texts nobody asks for are not shuffled for it.
    merged = merged.withColumns({"section": dominant_of(F.col("labels")), "char_len": F.length("text"), "token_len": _tokens(F.col("text"), config, counter)}).drop("labels")
    out = merged.join(videos.select("video_id", "title", "playlist_ids", "playlist_titles"), "video_id")
    number = F.col("range_no").cast("int")
    return out.select(
        F.concat("video_id", F.lit("::"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))).alias("chunk_id"),
        "video_id", "title", deep_link(F.col("video_id"), F.col("start")).alias("url"), timecode(F.col("start")).alias("timecode"),
        F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), number.alias("chunk_index"), "n_chunks", "section", "has_ingredients", "has_steps",
        "char_len", "token_len", "playlist_ids", "playlist_titles", "text",
    )


def manifest(chunk_table: DataFrame) -> DataFrame:
    """Per video: chunks, least, mean (rounded half to even) and most tokens, distinct sections."""
    return chunk_table.groupBy("video_id").agg(
        F.count("*").alias("n_chunks"), F.min("token_len").alias("min_tokens"), F.bround(F.avg("token_len")).cast("int").alias("avg_tokens"),
        F.max("token_len").alias("max_tokens"), F.array_sort(F.collect_set("section")).alias("sections"),
    )
