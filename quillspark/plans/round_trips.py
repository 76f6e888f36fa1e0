"""Registered queries of readers, sinks, runs and models: driver tables written in an operator's format and read back, or put through stand-ins."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.answer import answers
from quillspark.operators.models import HashEmbedder, OverlapReranker, embed, rerank_scores
from quillspark.plans import jobs
from quillspark.plans.queries import STRIP, TURNS, WORD_LIST, query, read, turns
from quillspark.session import materialize, scratch
from quillspark.sources import readers, sinks
from quillspark.sources.connectors import RateLimited, Transcript, TranscriptError
from quillspark.sources.fetching import FetchRun, RunOptions
from quillspark.sources.transcripts import TranscriptStore, run_manifest, transcript_rows


@query("""SELECT 'q' || item_id AS id, sha256(text) AS digest, CASE WHEN length(text) % 2 = 0 THEN 'exact' ELSE 'paraphrase' END AS kind, CASE WHEN contains(text, 'a') THEN 'd' || length(text) END AS relevant, NOT contains(text, 'q') AS expect_found
FROM benchmark WHERE length(text) % 3 <> 0""")
def golden_lines(spark, d):
    """Benchmark items as JSON lines of labelled queries, with gaps and a kind that is left out"""
    rows = read(spark, d, "benchmark")
    even = F.length("text") % 2 == 0
    kind = F.when(F.length("text") % 3 == 0, "other").when(~even, "paraphrase")  # no kind: exact
    relevant = F.when(F.contains("text", F.lit("a")), F.array(F.concat(F.lit("d"), F.length("text").cast("string"))))
    line = F.to_json(F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("query"), kind.alias("kind"), relevant.alias("relevant"), F.when(F.contains("text", F.lit("q")), F.lit(False)).alias("expect_found")))
    path = scratch(spark, "golden") + "/lines"
    rows.select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(path)
    found = readers.load_golden(spark, path, ["exact", "paraphrase"])
    return found.select("id", F.sha2("query", 256).alias("digest"), "kind", F.get("relevant", F.lit(0)).alias("relevant"), "expect_found")


@query(f"WITH {TURNS} SELECT chunk_id, chunk_index, n_chunks, section, start, sha256(text) AS digest FROM turns")
def chunk_lines(spark, d):
    """Conversations as chunks, written as a table with JSON lines beside it, which are read back"""
    path = scratch(spark, "chunks")
    sinks.write_table(turns(spark, d).drop("conv_id"), f"{path}/table", f"{path}/lines")
    return readers.load_chunks(spark, f"{path}/lines").select("chunk_id", "chunk_index", "n_chunks", "section", "start", F.sha2("text", 256).alias("digest"))


VIDEOS = """firsts AS (SELECT conv_id, conv_id || '|' || left(text, 40) AS video_id, left(text, 40) AS t FROM conversations WHERE turn = 0),
videos AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS run_no, CASE WHEN regexp_matches(t, '^[D-Z][a-m]') THEN 'rate_limited' WHEN contains(t, ', ') THEN 'no_transcript' WHEN contains(t, 'ion') THEN 'error' ELSE 'ok' END AS would,
  CASE WHEN contains(t, 'er') AND contains(t, ' a') THEN 'skip_exists' END AS known FROM firsts),
said AS (SELECT *, coalesce(known, would) AS status FROM videos)"""


def _videos(spark, d):
    rows = read(spark, d, "conversations").filter("turn = 0").select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit("|"), F.substring("text", 1, 40)).alias("video_id"), F.substring("text", 1, 40).alias("t"))
    from quillspark.sources.fetching import in_order

    return in_order(rows, "conv_id")


def _fetcher():
    def fetch(video_id: str) -> Transcript:
        text = video_id.split("|", 1)[1]
        if re.match("[D-Z][a-m]", text):
            raise RateLimited("429")
        if ", " in text:
            raise TranscriptError("none")
        if "ion" in text:
            raise KeyError(text)
        return Transcript([(w, float(i), 1.0) for i, w in enumerate(text.split())], "ru", False, "ytapi")

    return fetch


@query(f"""WITH {VIDEOS},
asked AS (SELECT *, row_number() OVER (ORDER BY run_no) AS i FROM said WHERE status <> 'skip_exists'),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY status = 'rate_limited' ORDER BY i) AS island FROM asked),
refused AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY i) AS n FROM runs WHERE status = 'rate_limited'),
stop AS (SELECT coalesce(min(run_no), 1000000000) AS at FROM refused WHERE n = 4)
SELECT run_no, video_id, status, CASE WHEN status = 'ok' THEN len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) ELSE 0 END AS n_cues FROM said, stop WHERE run_no <= stop.at""")
def fetch_queue(spark, d):
    """Conversations as videos, whose first words tell a stand-in what becomes of them, in batches, up to the fourth refusal in a row"""
    videos = _videos(spark, d)
    existing = videos.filter(F.contains("t", F.lit("er")) & F.contains("t", F.lit(" a"))).select("video_id")
    run = FetchRun(spark, scratch(spark, "run"))
    run.go(videos, _fetcher, RunOptions(batch=200, breaker=4), existing)
    return run.fetched().select("run_no", "video_id", "status", F.size("cues").alias("n_cues"))


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n, min(CASE WHEN turn = 0 THEN text END) AS t, sum(CASE WHEN {STRIP.format('text')} <> '' THEN 1 ELSE 0 END) AS filled FROM conversations GROUP BY conv_id),
s AS (SELECT *, CASE WHEN contains(t, 'delivery') OR n = 4 THEN 'skip_non_recipe' WHEN n < 3 THEN 'no_transcript' ELSE 'ok' END AS status FROM c)
SELECT CAST(conv_id AS VARCHAR) AS video_id, status, CASE WHEN status = 'ok' THEN CAST(n AS INTEGER) END AS raw_cues, CASE WHEN status = 'skip_non_recipe' THEN 'four turns' END AS reason, CASE WHEN status = 'ok' THEN 'asr' END AS source FROM s""")
def transcript_runs(spark, d):
    """Conversations as fetched transcripts through the store, in two runs; what the store and its JSON tell of each"""
    rows = read(spark, d, "conversations")
    text = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"), (x["turn"] * 5.0).alias("start"), F.lit(5.0).alias("duration")))
    made = materialize(rows.groupBy("conv_id").agg(text.alias("cues"), F.count("*").alias("n")).withColumn("video_id", F.col("conv_id").cast("string")), "fetched")
    status = F.when(F.col("n") == 4, "skip_non_recipe").when(F.col("n") < 3, "no_transcript").otherwise("ok")
    fetched = made.select(F.col("conv_id").alias("run_no"), "video_id", status.alias("status"), F.lit(None).cast("string").alias("error"), F.lit("ru").alias("language"), F.lit(True).alias("is_generated"), F.lit("asr").alias("source"), "cues")
    videos = made.select("video_id", F.lit("t").alias("title"), (F.col("n") != 4).alias("is_recipe"), F.when(F.col("n") == 4, "four turns").alias("skip_reason"))
    store = TranscriptStore(spark, scratch(spark, "store"))
    for number, part in enumerate((F.col("run_no") % 2 == 0, F.col("run_no") % 2 == 1)):
        store.commit(transcript_rows(videos, fetched.filter(part)), number, n_buckets=8)
    folder = scratch(spark, "json")
    store.export_json(folder)
    raw = spark.read.json(f"{folder}/raw").select("video_id", F.size("cues").alias("raw_cues"))
    listed = run_manifest(fetched, store.table.read()).drop("raw_cues").join(raw, "video_id", "left")
    return listed.select("video_id", "status", "raw_cues", "reason", "source")


@query(f"""WITH w AS (SELECT item_id, lower(w) AS w FROM (SELECT item_id, unnest({WORD_LIST}) AS w FROM benchmark))
SELECT item_id AS chunk_id, sum(n)::DOUBLE AS total, max(n)::DOUBLE AS top FROM (SELECT item_id, w, count(*) AS n FROM w GROUP BY ALL) GROUP BY item_id""")
def embed_texts(spark, d):
    """Benchmark items through the stand-in embedder: the sum and the greatest of their sparse weights"""
    rows = read(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    _, postings = jobs.build_index(rows.withColumn("title", F.lit("")), HashEmbedder)
    return postings.groupBy("chunk_id").agg(F.sum("weight").alias("total"), F.max("weight").alias("top"))


@query("""WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(left(text, 60)), '\\s+'), lambda x: x <> '')) AS words FROM benchmark),
t AS (SELECT conv_id, turn, text, conv_id % 5 AS item FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(q.words, list_distinct(list_filter(string_split_regex(lower(t.text), '\\s+'), lambda x: x <> '')))) / len(q.words)::DOUBLE, 9) AS score
FROM t JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS item FROM q) q USING (item)""")
def rerank_texts(spark, d):
    """Turns scored by the stand-in reranker against the first five benchmark items"""
    from pyspark.sql import Window

    items = read(spark, d, "benchmark").select(F.substring("text", 1, 60).alias("query"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("item")).filter("item < 5")
    rows = read(spark, d, "conversations").withColumn("item", F.col("conv_id") % 5).join(items, "item")
    return rerank_scores(rows.select("conv_id", "turn", "query", "text"), OverlapReranker).select("conv_id", "turn", F.round("rerank", 9).alias("score"))


class EchoClient:
    """Stand-in for a chat model: finds what the context says word for word; its first reply to some questions is no JSON."""

    model = "echo"

    def chat(self, messages: list[dict], **options) -> str:
        asked, context = messages[1]["content"].removeprefix("Question: ").split("\n\nFragments:\n", 1)
        if len(asked) % 2 and len(messages) == 2:
            return "no JSON"
        context = context.rsplit("\n\nReply with", 1)[0]
        if len(asked) % 7 == 0:
            raise OSError("lost")
        return "```json\n" + json.dumps({"found": asked in context, "dish": asked, "ingredients": asked.split(), "source_n": 2}) + "\n```"


@query(rf"""WITH t AS (SELECT conv_id, {STRIP.format('left(text, 24)')} AS query, text FROM conversations WHERE turn = 0),
c AS (SELECT conv_id, text AS context FROM conversations WHERE turn = 1),
a AS (SELECT t.conv_id, t.query, c.context, length(t.query) % 7 = 0 AS lost, contains(c.context, left(t.query, 3)) AS near, conv_id % 10 <> 3 AS passed FROM t JOIN c USING (conv_id))
SELECT CAST(conv_id AS VARCHAR) AS query_id, passed AND NOT lost AND contains(context, left(query, 3)) AS found, CASE WHEN passed AND NOT lost THEN left(query, 3) END AS dish,
  CASE WHEN passed AND NOT lost THEN 'b' || conv_id END AS source, CASE WHEN passed AND lost THEN 'lost' END AS error FROM (SELECT * REPLACE (length(left(query, 3)) % 7 = 0 AS lost) FROM a)""")
def model_answers(spark, d):
    """Three letters of each conversation's question looked for in its first answer by a stand-in model; one in ten is stopped by the gate"""
    rows = read(spark, d, "conversations")
    text = X.strip(F.substring("text", 1, 24))
    queries = rows.filter("turn = 0").select(F.col("conv_id").cast("string").alias("query_id"), F.substring(text, 1, 3).alias("query"))
    source = lambda n, name: F.struct(F.lit(n).alias("n"), F.concat(F.lit(name), F.col("conv_id").cast("string")).alias("video_id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("00:00").alias("timecode"))
    contexts = rows.filter("turn = 1").select(F.col("conv_id").cast("string").alias("query_id"), F.col("text").alias("context"), F.array(source(1, "a"), source(2, "b")).alias("citations"))
    passages = contexts.select("query_id", F.when(F.col("query_id").cast("bigint") % 10 == 3, 0.001).otherwise(0.4).alias("video_score"))
    found = answers(queries.join(contexts.select("query_id"), "query_id", "left_semi"), passages, contexts, EchoClient)
    return found.select("query_id", "found", "dish", F.col("source.video_id").alias("source"), "error")
