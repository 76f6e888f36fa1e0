"""From ranked candidates to a context, for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import RetrievalConfig
from quillspark.functions.text import stitched, token_count, truncated, words
from quillspark.operators.models import Reranker, rerank_scores
from quillspark.operators.ranges import members, ranges
from quillspark.operators.search import top_k
from quillspark.session import materialize

#: A payload without a field reads as this.
DEFAULTS = {"video_id": "", "title": "", "url": "", "timecode": "", "start": 0.0, "end": 0.0, "chunk_index": 0, "n_chunks": 0, "section": "other", "text": ""}


def payload(rows: DataFrame) -> DataFrame:
    """Every field that retrieval reads, with defaults for what is null or missing."""
    have = set(rows.columns)
    kinds = {str: "string", float: "double", int: "int"}
    return rows.withColumns({c: F.coalesce(F.col(c).cast(kinds[type(d)]), F.lit(d)) if c in have else F.lit(d) for c, d in DEFAULTS.items()})


def reranked(candidates: DataFrame, top: int, make: Callable[[], Reranker] | None) -> DataFrame:
    """The first `top` candidates of each query take the model's score and order; the rest score 0 and stay behind."""
    if make is None:
        return candidates.withColumn("cand_rank", F.col("rank"))
    head = rerank_scores(candidates.filter(F.col("rank") <= top), make).withColumn("score", F.col("rerank")).drop("rerank")
    tail = candidates.filter(F.col("rank") > top).withColumn("score", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy((F.col("rank") > top), F.desc("score"), "rank")
    return head.unionByName(tail).withColumn("cand_rank", F.row_number().over(w))


def position_weight(config: RetrievalConfig) -> Column:
    """Weight of a chunk by its section and by standing first or last in its video."""
    weight = F.lit(1.0)
    for name, w in config.section_weights.items():
        weight = F.when(F.col("section") == name, w).otherwise(weight)
    last = (F.col("n_chunks") != 0) & (F.col("chunk_index") >= F.col("n_chunks") - 1)
    return weight * F.when(F.col("chunk_index") == 0, config.first_weight).when(last, config.last_weight).otherwise(1.0)


def weighted(candidates: DataFrame, config: RetrievalConfig) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_rank")
    rows = candidates.withColumn("score", F.col("score") * position_weight(config))
    return rows.withColumn("new_rank", F.row_number().over(w)).withColumn("cand_rank", F.col("new_rank")).drop("new_rank")


def top_videos(candidates: DataFrame, videos: int, per_video: int) -> DataFrame:
    """The best chunks of the best videos, with video_rank and video_score; ties by order of candidates."""
    own = Window.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "cand_rank")
    best = candidates.groupBy("query_id", "video_id").agg(F.max("score").alias("video_score"), F.min("cand_rank").alias("first_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("video_score"), "first_rank")
    best = best.withColumn("video_rank", F.row_number().over(w)).filter(F.col("video_rank") <= videos).drop("first_rank")
    rows = candidates.withColumn("in_video", F.row_number().over(own)).filter(F.col("in_video") <= per_video).drop("in_video")
    return rows.join(best, ["query_id", "video_id"])


def with_neighbors(chosen: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """Chunks beside the chosen ones join them with score 0, by an equi-join on (video, index)."""
    if radius <= 0:
        return chosen
    steps = F.array(*(F.lit(d) for d in range(-radius, radius + 1) if d))
    keys = ["query_id", "video_id", "chunk_index"]
    wanted = chosen.select("query_id", "video_id", "video_rank", "video_score", "chunk_index", F.explode(steps).alias("step")).withColumn("chunk_index", F.col("chunk_index") + F.col("step")).drop("step").filter("chunk_index >= 0").distinct()
    wanted = wanted.join(chosen.select(*keys), keys, "left_anti")
    more = wanted.join(chunks.drop("query_id", "score", "video_rank", "video_score"), ["video_id", "chunk_index"]).withColumn("score", F.lit(0.0))
    return chosen.unionByName(more, allowMissingColumns=True)


def passage_rule(most: int) -> Callable:
    """Runs of neighbouring chunks of at most `most` words together; a single chunk may have more."""

    def rule(columns: list[list]) -> Iterator[tuple[int, int]]:
        index, sizes = columns
        first, size = 0, 0
        for i in range(len(index)):
            if i > first and (index[i] != index[i - 1] + 1 or size + sizes[i] > most):
                yield first, i - 1
                first, size = i, 0
            size += sizes[i]
        if len(index):
            yield first, len(index) - 1

    return rule


def merged_passages(chosen: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Neighbouring chunks of a video stitched into passages: one row a passage."""
    keys = ["query_id", "video_id"]
    w = Window.partitionBy(*keys).orderBy("chunk_index", "chunk_id")
    rows = chosen.withColumns({"place": (F.row_number().over(w) - 1).cast("int"), "n_words": F.size(words(F.col("text")))})
    # A video's title is that of its first chunk.
    rows = rows.withColumn("video_title", F.first("title").over(w))
    within = members(ranges(rows, keys, ["place"], ["chunk_index", "n_words"], passage_rule(config.passage_words))).join(rows, [*keys, "place"])
    ordered = F.array_sort(F.collect_list(F.struct("place", "text", "chunk_id")))
    out = within.groupBy(*keys, "range_no").agg(
        F.first("video_rank").alias("video_rank"), F.max("video_score").alias("video_score"), F.first("video_title").alias("video_title"),
        *(F.min_by(c, "place").alias(c) for c in ("title", "url", "timecode", "start")), F.max_by("end", "place").alias("end"),
        F.max("score").alias("score"), ordered.alias("parts"),
    )
    texts = F.transform("parts", lambda p: p["text"])
    joined = F.aggregate(F.slice(texts, F.lit(2), F.size(texts) - 1), F.get(texts, F.lit(0)), lambda a, b: stitched(a, b, config.overlap_words))
    return out.select(*keys, "video_rank", "video_score", "video_title", "range_no", "title", "url", "timecode", "start", "end", joined.alias("text"), F.transform("parts", lambda p: p["chunk_id"]).alias("chunk_ids"), "score")


def within_budget(items: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """Rows taken by `pick` order while their costs fit; the first always does, and one that doesn't fit is passed over.

    A fold over each key's few (pick, cost) pairs; prefix sums would choose otherwise."""
    folded = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pick", "cost"))).alias("all"))

    def step(got, x):
        take = (F.size(got["picked"]) == 0) | (got["used"] + x["cost"] <= budget)
        return F.struct(F.when(take, got["used"] + x["cost"]).otherwise(got["used"]).alias("used"), F.when(take, F.concat(got["picked"], F.array(x["pick"]))).otherwise(got["picked"]).alias("picked"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("picked"))
    chosen = folded.select(key, F.explode(F.aggregate("all", start, step, lambda got: got["picked"])).alias("pick"))
    return items.join(chosen, [key, "pick"])


def contexts(passages: DataFrame, config: RetrievalConfig) -> DataFrame:
    """query_id, context and citations: passages chosen by score within the token budget, shown by video and time."""
    text = truncated(F.col("text"), config.passage_words)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_rank", "start", "range_no")
    rows = passages.withColumns({"shown": text, "cost": (token_count(text, config.chars_per_token) + config.block_cost).cast("bigint"), "pick": F.row_number().over(by_score).cast("int")})
    shown = Window.partitionBy("query_id").orderBy("video_rank", "start", "pick")
    rows = within_budget(rows, config.token_budget).withColumn("n", F.row_number().over(shown).cast("int"))
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("timecode"), F.lit(")\n"), F.col("shown"))
    all_ = F.array_sort(F.collect_list(F.struct("n", block.alias("block"), "video_id", "title", "url", "timecode")))
    out = rows.groupBy("query_id").agg(all_.alias("all"))
    cited = F.transform("all", lambda x: F.struct(x["n"].alias("n"), x["video_id"].alias("video_id"), x["title"].alias("title"), x["url"].alias("url"), x["timecode"].alias("timecode")))
    return out.select("query_id", F.array_join(F.transform("all", lambda x: x["block"]), "\n\n").alias("context"), cited.alias("citations"))


def retrieve(
    candidates: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig(), make_reranker: Callable[[], Reranker] | None = None,
    section_weights: bool = True, matched: DataFrame | None = None, filtered: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (query_id, query, chunk_id, score, rank) the passages, the contexts, and counters of each query.

    The search's score stays as `retriever_score`. `section_weights`: whether sections and places weigh. `matched` (query_id, intents) and
    `filtered` tell the counters what stood before the search."""
    rows = payload(candidates.filter(F.col("rank") <= config.pool).join(chunks.drop("score", "rank", "query"), "chunk_id")).withColumn("retriever_score", F.col("score"))
    # Each table below is read several times; at most `pool` rows a query are kept.
    ranked = reranked(rows, config.rerank_top, make_reranker)
    ranked = materialize(weighted(ranked, config) if section_weights else ranked, "ranked")
    chosen = materialize(top_videos(ranked, config.top_videos, config.per_video), "chosen")
    passages = materialize(merged_passages(materialize(with_neighbors(chosen, payload(chunks), config.neighbor_radius), "filled"), config), "passages")
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("candidates")).join(passages.groupBy("query_id").agg(F.count("*").alias("passages")), "query_id", "left")
    none = F.array().cast("array<string>")
    counts = counts.join(matched.select("query_id", "intents"), "query_id", "left") if matched is not None else counts.withColumn("intents", none)
    counters = counts.withColumns({
        "pool": F.lit(config.pool), "neighbor_radius": F.lit(config.neighbor_radius), "used_reranker": F.lit(make_reranker is not None), "mode": F.lit(config.mode),
        "intent_filter": F.coalesce("intents", none), "filtered": F.lit(filtered) | (F.size(F.coalesce("intents", none)) > 0),
    }).drop("intents")
    return passages, contexts(passages, config), counters


__all__ = ["contexts", "merged_passages", "payload", "position_weight", "reranked", "retrieve", "top_k", "top_videos", "weighted", "with_neighbors", "within_budget"]
