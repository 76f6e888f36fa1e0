"""A thin service over the plans: checked requests in, plain values out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import RetrievalConfig
from quillspark.operators.answer import answers, other_sources
from quillspark.operators.models import ChatClient, Embedder, Reranker
from quillspark.operators.retrieve import retrieve
from quillspark.operators.search import intents, matches_intents, search
from quillspark.operators.sparse import SparseIndex
from quillspark.plans.jobs import search_queries


class BadRequest(ValueError):
    pass


def _between(name: str, value: float | None, low: float, high: float) -> None:
    if value is not None and not low <= value <= high:
        raise BadRequest(f"{name} must be between {low} and {high}")


def check_request(query: str, k: int = 5, mode: str = "hybrid", top_videos: int = 2, per_video: int = 6, temperature: float | None = None) -> None:
    _between("the query's length", len(query), 2, 500)
    _between("k", k, 1, 20)
    _between("top_videos", top_videos, 1, 8)
    _between("per_video", per_video, 1, 12)
    _between("temperature", temperature, 0.0, 1.5)
    if mode not in ("hybrid", "dense", "sparse"):
        raise BadRequest(f"no mode {mode!r}")


@dataclass
class Service:
    chunks: DataFrame
    vectors: DataFrame
    #: an index, made once, serves searches over all chunks
    postings: DataFrame | SparseIndex
    embedder: Callable[[], Embedder]
    reranker: Callable[[], Reranker] | None = None
    client: Callable[[], ChatClient] | None = None
    config: RetrievalConfig = RetrievalConfig()

    def _query(self, query: str) -> DataFrame:
        return self.chunks.sparkSession.createDataFrame([("q", query)], "query_id string, query string")

    @property
    def _plain(self) -> DataFrame:
        return self.postings.postings if isinstance(self.postings, SparseIndex) else self.postings

    def _scope(self, query: DataFrame, patterns) -> tuple[DataFrame, DataFrame | SparseIndex]:
        """Vectors and postings of chunks that the query's intents allow."""
        if not patterns:
            return self.vectors, self.postings
        wanted = query.select(intents(F.col("query"), patterns)).first()[0]
        if not wanted:
            return self.vectors, self.postings
        ids = self.chunks.filter(matches_intents(F.col("playlist_titles"), F.array(*map(F.lit, wanted)))).select("chunk_id")
        return self.vectors.join(ids, "chunk_id", "left_semi"), self._plain.join(ids, "chunk_id", "left_semi")

    def search(self, query: str, k: int = 5, mode: str = "hybrid", condition=None) -> list[dict[str, Any]]:
        """title, url, timecode, section, score and text of the k best chunks."""
        check_request(query, k=k, mode=mode)
        ids = self.chunks if condition is None else self.chunks.filter(condition)
        vectors, postings = self.vectors, self.postings
        if condition is not None:
            vectors, postings = (x.join(ids.select("chunk_id"), "chunk_id", "left_semi") for x in (vectors, self._plain))
        from quillspark.operators.models import embed

        made = embed(self._query(query), "query_id", "query", self.embedder)
        found = search(made.select("query_id", F.col("dense").alias("vector")), made.select("query_id", F.explode("sparse").alias("term", "weight")), vectors, postings, k, mode, self.config.search_overfetch, self.config.rrf_constant)
        rows = found.join(self.chunks, "chunk_id").orderBy("rank").select("title", "url", "timecode", "section", "score", "text")
        return [r.asDict() for r in rows.collect()]  # at most k

    def retrieved(self, asked: DataFrame, vectors: DataFrame, postings: DataFrame | SparseIndex, config: RetrievalConfig, rerank: bool = True, section_weights: bool = True, matched: DataFrame | None = None):
        return retrieve(search_queries(asked, vectors, postings, self.embedder, config), self.chunks, config, self.reranker if rerank else None, section_weights, matched)

    def retrieve(self, query: str, top_videos: int | None = None, per_video: int | None = None, budget: int | None = None, mode: str = "hybrid", rerank: bool = True, patterns=(), section_weights: bool = True) -> dict[str, Any]:
        """The context and citations of one query, its passages, and the counters."""
        config = self._config(top_videos, per_video, budget, mode)
        check_request(query, top_videos=config.top_videos, per_video=config.per_video, mode=mode)
        asked = self._query(query)
        vectors, postings = self._scope(asked, patterns)
        matched = asked.select("query_id", intents(F.col("query"), patterns).alias("intents")) if patterns else None
        passages, contexts, counters = self.retrieved(asked, vectors, postings, config, rerank, section_weights, matched)
        told, debug = contexts.first(), counters.drop("query_id").first()
        shown = passages.orderBy("video_rank", "start").select("video_id", "title", "url", "timecode", "start", "end", "score", "text").collect()  # a few videos' passages
        return {
            "query": query, "context": told["context"] if told else "", "citations": [c.asDict() for c in told["citations"]] if told else [],
            "passages": [r.asDict() for r in shown], "debug": debug.asDict() if debug else {},
        }

    def _config(self, top_videos: int | None, per_video: int | None, budget: int | None, mode: str) -> RetrievalConfig:
        c = self.config
        return replace(c, top_videos=top_videos or c.top_videos, per_video=per_video or c.per_video, token_budget=budget or c.token_budget, mode=mode)

    def ask(self, query: str, top_videos: int | None = None, per_video: int | None = None, patterns=(), temperature: float | None = None, budget: int | None = None, mode: str = "hybrid", rerank: bool = True) -> dict[str, Any]:
        """The answer with its sources; `other` are the sources beside the main one."""
        config = self._config(top_videos, per_video, budget, mode)
        check_request(query, top_videos=config.top_videos, per_video=config.per_video, temperature=temperature, mode=mode)
        if self.client is None:
            raise BadRequest("no model is set")
        asked = self._query(query)
        vectors, postings = self._scope(asked, patterns)
        passages, contexts, _ = self.retrieved(asked, vectors, postings, config, rerank)
        row = answers(asked, passages, contexts, self.client, config.min_score).withColumn("other", other_sources(F.col("sources"), F.col("source"))).first()
        return row.asDict(recursive=True)

    def health(self) -> dict[str, Any]:
        """status (ok, or degraded), the index's rows, whether the model answers and its name; what went wrong as `error`."""
        out: dict[str, Any] = {"status": "degraded", "index": None, "model": False, "model_name": None, "reranker": self.reranker is not None}
        try:
            out["index"] = self.vectors.count()
        except Exception as error:  # noqa: BLE001  a probe tells what is wrong
            out["error"] = str(error)[:200]
        try:
            if self.client is not None:
                client = self.client()
                out["model_name"] = client.model
                out["model"] = bool(client.health()) if hasattr(client, "health") else True
        except Exception as error:  # noqa: BLE001
            out.setdefault("error", str(error)[:200])
        if out["index"] and out["model"]:
            out["status"] = "ok"
        return out
