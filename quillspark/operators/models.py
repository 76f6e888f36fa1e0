"""Models behind small protocols, with deterministic stand-ins. A model is made once per Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import words


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
        """Dense vector and sparse weights of each text."""


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class TokenCounter(Protocol):
    def count(self, text: str) -> int:
        """Tokens of a text, special ones apart."""


class FormatRefused(Exception):
    """A backend cannot answer in the wanted format."""


class ChatClient(Protocol):
    model: str

    def chat(self, messages: list[dict], **options: Any) -> str: ...


_MADE: dict[str, Any] = {}


def per_worker(make: Callable[[], Any]) -> Callable[[], Any]:
    """`make`, called once per Python worker for each factory; told apart by what is sent to the workers, closures included."""
    key = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def get() -> Any:
        from quillspark.operators.models import _MADE  # the worker's own

        if key not in _MADE:
            _MADE[key] = make()
        return _MADE[key]

    return get


def embed(rows: DataFrame, key: str, text: str, make: Callable[[], Embedder]) -> DataFrame:
    """key, dense, sparse through a model; weights that aren't positive are left out. The key travels with its row."""

    get = per_worker(make)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        for frame in frames:
            found = model.encode(frame[text].fillna("").tolist())
            yield pd.DataFrame({key: frame[key], "dense": [list(map(float, d)) for d, _ in found], "sparse": [{int(t): float(w) for t, w in s.items() if w > 0} for _, s in found]})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, dense array<double>, sparse map<int,double>")


def counted_tokens(text: Column, make: Callable[[], TokenCounter]) -> Column:
    """How many tokens a model's own tokenizer makes of a text; a null text has none."""
    get = per_worker(make)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        counter = get()
        return texts.fillna("").map(counter.count).astype("int32")

    return count(text)


class TokenizerFile:
    """A counter by a tokenizer's file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def term_weights(rows: DataFrame, key: str, text: Column, space: int = 1 << 20) -> DataFrame:
    """Postings without a model: key, term (hash of a lower-case word), weight (its count)."""
    term = F.explode(words(F.lower(text)))
    return rows.select(key, term.alias("word")).groupBy(key, F.pmod(F.xxhash64("word"), F.lit(space)).cast("int").alias("term")).agg(F.count("*").cast("double").alias("weight"))


class HashEmbedder:
    """Stand-in: hashed word counts, normalised."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
        import zlib

        out = []
        for text in texts:
            dense, sparse = np.zeros(self.size), {}
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                dense[h % self.size] += 1.0
                sparse[h % (1 << 20)] = sparse.get(h % (1 << 20), 0.0) + 1.0
            norm = np.linalg.norm(dense)
            out.append(((dense / norm if norm else dense).tolist(), sparse))
        return out


class OverlapReranker:
    """Stand-in: share of the query's words that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(t.lower().split())) / max(1, len(wanted)) for t in texts]


def rerank_scores(rows: DataFrame, make: Callable[[], Reranker]) -> DataFrame:
    """Add `rerank` to (query, text) rows; a query's rows of a batch are scored together."""

    get = per_worker(make)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        for frame in frames:
            scores = pd.Series(0.0, index=frame.index)
            for query, part in frame.groupby("query"):
                scores[part.index] = list(map(float, model.score(query, part["text"].fillna("").tolist())))
            yield frame.assign(rerank=scores)

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, rerank double")
