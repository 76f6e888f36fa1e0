"""Answers: gate, prompt, model call, validation, attribution."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.jsontext import lenient_json, recipe
from quillspark.operators.models import ChatClient, FormatRefused, per_worker

SYSTEM = (
    "You answer questions from numbered fragments of video transcripts. Use only what the fragments say. "
    "Reply with one JSON object: found (boolean), dish, ingredients (list), steps (list), source_n (the number of the main fragment), notes. "
    "If the fragments hold no answer, found is false."
)
USER = "Question: {query}\n\nFragments:\n{context}\n\nReply with the JSON object."
AGAIN = "Your reply was not valid JSON. Reply with the JSON object alone, without any other text."


def messages(query: str, context: str) -> list[dict]:
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": USER.format(query=query, context=context)}]


def passes_gate(passages: DataFrame, floor: float) -> DataFrame:
    """Queries whose best video scores `floor` or more."""
    return passages.groupBy("query_id").agg(F.max("video_score").alias("top_score")).filter(F.col("top_score") >= floor)


def _parsed(text: str) -> bool:
    """Whether the reply holds a JSON object: whole, in a code fence, or from its first brace to its last."""
    bare = re.sub(r"^```(?i:json)?|```$", "", (text or "").strip()).strip()
    for part in (bare, bare[bare.find("{") : bare.rfind("}") + 1]):
        try:
            if isinstance(json.loads(part), dict):
                return True
        except ValueError:
            continue
    return False


def call_model(rows: DataFrame, make: Callable[[], ChatClient], **options) -> DataFrame:
    """Add `reply`, `error` and `model` to (query_id, query, context): one call, and one stricter call if no JSON came.

    A backend that refuses the format (FormatRefused) is asked again without it; a failure is a row, not an end."""

    get = per_worker(make)

    def ask(client: ChatClient, talk: list[dict]) -> str:
        try:
            return client.chat(talk, json_mode=True, **options)
        except FormatRefused:
            return client.chat(talk, **options)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = get()
        for frame in frames:
            replies, errors = [], []
            for query, context in zip(frame["query"], frame["context"], strict=True):
                talk = messages(query, context)
                try:
                    reply = ask(client, talk)
                    if not _parsed(reply):
                        reply = ask(client, [*talk, {"role": "assistant", "content": (reply or "")[:2000]}, {"role": "user", "content": AGAIN}])
                    replies.append(reply)
                    errors.append(None if _parsed(reply) else "no JSON in the reply")
                except Exception as error:  # noqa: BLE001  recorded as data
                    replies.append(None)
                    errors.append(str(error)[:200])
            yield frame.assign(reply=replies, error=errors, model=client.model)

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, reply string, error string, model string")


def primary_source(sources: Column, n: Column, found: Column) -> Column:
    """The cited source; for an answer that cites none that is there, the first."""
    cited = F.get(F.filter(sources, lambda s: s["n"] == n), F.lit(0))
    return F.coalesce(cited, F.when(found, F.get(sources, F.lit(0))))


def other_sources(sources: Column, source: Column) -> Column:
    return F.filter(sources, lambda s: F.coalesce(s["n"] != source["n"], F.lit(True)))


def answers(queries: DataFrame, passages: DataFrame, contexts: DataFrame, make: Callable[[], ChatClient], floor: float = 0.005) -> DataFrame:
    """query_id, query, found, dish, ingredients, steps, notes, source, sources, error. The gate stands before the model call."""
    base = queries.join(contexts, "query_id", "left")
    ready = base.filter("citations is not null").join(passes_gate(passages, floor).select("query_id"), "query_id", "left_semi")
    told = call_model(ready.select("query_id", "query", "context"), make).select("query_id", "reply", "error", "model")
    rows = base.join(told, "query_id", "left").withColumn("r", recipe(lenient_json(F.col("reply"))))
    found = F.coalesce("r.found", F.lit(False))
    none = F.array().cast("array<string>")
    return rows.select(
        "query_id", "query", found.alias("found"), "r.dish", F.coalesce("r.ingredients", none).alias("ingredients"), F.coalesce("r.steps", none).alias("steps"),
        "r.notes", primary_source(F.col("citations"), F.col("r.source_n"), found).alias("source"), F.col("citations").alias("sources"), "error", "model",
    )
