"""Batch jobs: from playlists to transcripts, chunks and an index, and the evaluation of retrieval and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.config import ChunkConfig, CleanConfig, RetrievalConfig, one_of
from quillspark.functions.text import passage_text
from quillspark.operators import evaluate
from quillspark.operators.answer import answers
from quillspark.operators.chunking import chunks
from quillspark.operators.models import ChatClient, Embedder, Reranker, TokenCounter, embed
from quillspark.operators.retrieve import retrieve
from quillspark.operators.search import search
from quillspark.operators.timeline import clean_transcript
from quillspark.session import materialize
from quillspark.sources.collection import Collection
from quillspark.sources.sinks import not_yet


def collect_videos(entries: DataFrame, limit: int | None = None, url: str = "https://www.youtube.com/watch?v=") -> DataFrame:
    """Unique videos of ordered playlist entries (playlist_no, pos, playlist_id, playlist_title, video_id, title).

    The first title wins; playlists are listed as met, repeats included. A limit of 0 or None is no limit."""
    rows = entries
    if limit:
        w = Window.partitionBy("playlist_no").orderBy("pos")
        rows = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    order = F.struct("playlist_no", "pos")
    met = F.array_sort(F.collect_list(F.struct("playlist_no", "pos", "playlist_id", "playlist_title")))
    out = rows.groupBy("video_id").agg(F.min_by("title", order).alias("title"), met.alias("met"))
    return out.select("video_id", "title", F.concat(F.lit(url), F.col("video_id")).alias("url"), F.transform("met", lambda x: x["playlist_id"]).alias("playlist_ids"), F.transform("met", lambda x: x["playlist_title"]).alias("playlist_titles"))


def classify_recipes(videos: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """is_recipe and skip_reason, by the first marker in title or description."""
    pattern = one_of(config.lexicon.skip_markers)
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    found = F.regexp_extract(hay, pattern, 0)
    return videos.withColumns({"is_recipe": found == "", "skip_reason": F.when(found != "", F.concat(F.lit("delivery_marker:'"), found, F.lit("'")))})


def statuses(videos: DataFrame, existing: DataFrame, fetched: DataFrame, drop_non_recipe: bool = False, overwrite: bool = False) -> DataFrame:
    """The manifest of a run: one status a video, in the order in which a video can end."""
    known = existing.select("video_id").distinct().withColumn("there", F.lit(True))
    rows = videos.join(known, "video_id", "left").join(fetched.select("video_id", F.col("status").alias("fetch_status"), "error"), "video_id", "left")
    status = F.when(F.coalesce("there", F.lit(False)) & F.lit(not overwrite), "skip_exists").when(~F.col("is_recipe") & F.lit(drop_non_recipe), "skip_non_recipe").otherwise(F.coalesce("fetch_status", F.lit("error")))
    return rows.select("video_id", "title", status.alias("status"), "error", "skip_reason")


def punctuation_backend(requested: str, source: str, available: dict[str, Callable]) -> str:
    """Which restorer to use: `auto` takes the first that can be made (labels, then text), none for recognised speech, which has marks."""
    if requested != "auto":
        return requested if requested in available else "none"
    if source == "asr":
        return "none"
    for name in ("rupunct", "silero"):
        if name in available:
            try:
                available[name]()
            except Exception:  # noqa: BLE001  a model that cannot be made is passed over
                continue
            return name
    return "none"


def run_counters(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "rate_limited").alias("rate_limited"), F.count("*").alias("total"))


#: Places of a run that one task puts in order.
BLOCK = 100_000


def abort_point(manifest: DataFrame, limit: int) -> DataFrame:
    """After the fact: the first place (`run_no`) where `limit` refusals stood in a row, skipped videos apart."""
    rows = manifest.filter("status != 'skip_exists'").select("run_no", (F.col("status") == "rate_limited").alias("refused"), F.floor(F.col("run_no") / BLOCK).alias("block"))
    # An island is known by the videos let through before it: those of earlier blocks, and those of its own.
    passed = rows.groupBy("block").agg(F.count_if(~F.col("refused")).alias("passed"))
    earlier = passed.select("block", (F.sum("passed").over(Window.orderBy("block")) - F.col("passed")).alias("earlier"))
    own = F.count_if(~F.col("refused")).over(Window.partitionBy("block").orderBy("run_no"))
    islands = rows.withColumn("own", own).filter("refused").join(earlier, "block").withColumn("island", F.col("earlier") + F.col("own"))
    inside = islands.withColumn("n", F.row_number().over(Window.partitionBy("island").orderBy("run_no")))
    return inside.filter(F.col("n") == limit).agg(F.min("run_no").alias("run_no"))


def build_chunks(cues: DataFrame, videos: DataFrame, clean: CleanConfig = CleanConfig(), cut: ChunkConfig = ChunkConfig(), labeller: Callable | None = None, include_non_recipe: bool = False, existing: DataFrame | None = None, counter: Callable[[], TokenCounter] | None = None) -> DataFrame:
    """Chunks of recipe videos; chunks that are there already are kept and not made again."""
    wanted = videos if include_non_recipe or "is_recipe" not in videos.columns else videos.filter(F.coalesce("is_recipe", F.lit(True)))
    if existing is not None:
        wanted = not_yet(wanted, existing)
    segments, _ = clean_transcript(cues.join(wanted.select("video_id"), "video_id", "left_semi"), clean, labeller)
    made = chunks(segments, wanted, cut, counter)
    return made if existing is None else existing.unionByName(made)


def build_index(chunk_table: DataFrame, make: Callable[[], Embedder]) -> tuple[DataFrame, DataFrame]:
    """Vectors (chunk_id, vector) and postings (chunk_id, term, weight) of chunks."""
    texts = chunk_table.select("chunk_id", passage_text(F.col("title"), F.coalesce("text", F.lit(""))).alias("text"))
    made = embed(texts, "chunk_id", "text", make)
    return made.select("chunk_id", F.col("dense").alias("vector")), made.select("chunk_id", F.explode("sparse").alias("term", "weight"))


def chunk_run_manifest(videos: DataFrame, existing: DataFrame | None, made: DataFrame, include_non_recipe: bool = False, overwrite: bool = False) -> DataFrame:
    """A row a video of a chunking run: status (skip_non_recipe, skip_exists, ok), chunks, least, mean and most tokens, sections.

    `existing` and `made`: chunks that were there, and those of this run. Videos without chunks have 0 everywhere."""
    from quillspark.operators.chunking import manifest

    there = (existing if existing is not None and not overwrite else made.limit(0)).groupBy("video_id").agg(F.count("*").alias("held"))
    dropped = ~F.coalesce("is_recipe", F.lit(True)) if "is_recipe" in videos.columns and not include_non_recipe else F.lit(False)
    rows = videos.select("video_id", dropped.alias("dropped")).join(there, "video_id", "left").join(manifest(made), "video_id", "left")
    status = F.when(F.col("dropped"), "skip_non_recipe").when(F.col("held").isNotNull(), "skip_exists").otherwise("ok")
    ok = lambda c: F.when(F.col("status") == "ok", c)
    out = rows.withColumn("status", status)
    counts = F.when(F.col("status") == "skip_exists", F.col("held")).when(F.col("status") == "ok", F.coalesce("n_chunks", F.lit(0)))
    return out.select("video_id", "status", counts.alias("chunks"), *(ok(F.coalesce(c, F.lit(0))).alias(n) for c, n in (("min_tokens", "tok_min"), ("avg_tokens", "tok_avg"), ("max_tokens", "tok_max"))), ok(F.coalesce("sections", F.array().cast("array<string>"))).alias("sections"))


#: What a chunk's row in a collection has beside the chunk's own columns.
INDEX_COLUMNS = "digest string, dense array<double>, sparse map<int,double>"


def update_index(table: Collection, chunk_table: DataFrame, make: Callable[[], Embedder], batch: int | None = None, n_buckets: int = 64) -> int:
    """Bring a collection up to date with chunks: those that are new or say something new are embedded and put in; the version then.

    Videos' rows share a bucket and stand in order of chunks; the collection is made if it is not there."""
    kind = chunk_table.sparkSession.createDataFrame([], INDEX_COLUMNS).schema
    table.ensure(StructType([*chunk_table.schema.fields, *kind.fields]), "chunk_id", "video_id", ("video_id", "chunk_index"), n_buckets)
    text = passage_text(F.col("title"), F.coalesce("text", F.lit("")))
    rows = chunk_table.withColumns({"_text": text, "digest": F.sha2(text, 256)})
    fresh = materialize(rows.join(table.read().select("chunk_id", "digest"), ["chunk_id", "digest"], "left_anti"), "fresh")
    made = embed(fresh.select("chunk_id", F.col("_text").alias("text")), "chunk_id", "text", make).select("chunk_id", "dense", "sparse")
    return table.upsert(fresh.drop("_text").join(made, "chunk_id"), batch)


def index_tables(table: Collection) -> tuple[DataFrame, DataFrame]:
    """Vectors and postings of a collection's newest version."""
    rows = table.read()
    return rows.select("chunk_id", F.col("dense").alias("vector")), rows.select("chunk_id", F.explode("sparse").alias("term", "weight"))


def search_queries(queries: DataFrame, vectors: DataFrame, postings: DataFrame, make: Callable[[], Embedder], config: RetrievalConfig) -> DataFrame:
    """Candidates of (query_id, query): query_id, query, chunk_id, score, rank."""
    made = materialize(embed(queries, "query_id", "query", make), "queries")
    dense, terms = made.select("query_id", F.col("dense").alias("vector")), made.select("query_id", F.explode("sparse").alias("term", "weight"))
    found = search(dense, terms, vectors, postings, config.pool, config.mode, config.search_overfetch, config.rrf_constant)
    return materialize(found.join(queries, "query_id"), "candidates")


def evaluate_retrieval(golden: DataFrame, chunk_table: DataFrame, vectors: DataFrame, postings: DataFrame, make: Callable[[], Embedder], config: RetrievalConfig = RetrievalConfig(), rank_k: int = 10, reranker: Callable[[], Reranker] | None = None) -> DataFrame:
    """One row a labelled query: rank, first three videos and top score from a wide pass, context scores and score from a pass as in production."""
    from dataclasses import replace

    queries = golden.select(F.col("id").alias("query_id"), "query")
    wide = replace(config, top_videos=rank_k)
    passages, _, _ = retrieve(search_queries(queries, vectors, postings, make, wide), chunk_table, wide, reranker)
    videos = passages.select("query_id", "video_id", "video_rank", "video_score").distinct()
    ranked = evaluate.ranks(videos.drop("video_score"), golden)
    first = F.transform(F.array_sort(F.collect_list(F.struct("video_rank", "video_id"))), lambda v: v["video_id"])
    wide_tops = videos.filter("video_rank <= 3").groupBy(F.col("query_id").alias("id")).agg(first.alias("top"), F.round(F.max_by("video_score", -F.col("video_rank")), 4).alias("top_score"))
    prod, _, _ = retrieve(search_queries(queries, vectors, postings, make, config), chunk_table, config, reranker)
    top = prod.groupBy(F.col("query_id").alias("id")).agg(F.round(F.max("video_score"), 4).alias("prod_score"))
    out = ranked.join(evaluate.context_scores(prod, golden), "id", "left").join(top, "id", "left")
    out = out.join(wide_tops, "id", "left")
    return out.withColumns({"prod_score": F.coalesce("prod_score", F.lit(0.0)), "top_score": F.coalesce("top_score", F.lit(0.0)), "top": F.coalesce("top", F.array().cast("array<string>"))})


def evaluate_answers(golden: DataFrame, passages: DataFrame, contexts: DataFrame, make: Callable[[], ChatClient], floor: float = 0.005) -> DataFrame:
    """One row a labelled query with its answer; a failed call is a row with an error."""
    found = answers(golden.select(F.col("id").alias("query_id"), "query"), passages, contexts, make, floor).withColumnRenamed("query_id", "id").drop("query")
    return golden.join(found, "id")
