"""Token ids by the tokenizers library, with every distinct chunk of text encoded once per worker.

A byte-pair tokenizer never merges across its pre-tokens, so the ids of a text are those of its chunks if every cut
between chunks is also a cut between pre-tokens. Two layouts are recognised from the tokenizer's own file:

* white space is dropped and no pre-token crosses it: chunks are the runs between white space;
* byte-level with the usual pattern: a chunk is one optional space and a run of other characters, or white space.

Any other tokenizer, any text with the string of an added token, and any with the separators U+001C to U+001F (white space for Python alone), is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from quillspark.llm.common import trim

_ODD = re.compile("[\x1c-\x1f]")
#: What a cut at each single space or line end would get wrong.
_UNEVEN = re.compile(r"\s\s|[^\S \n]|\0")
_BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def _layout(spec: dict) -> str:
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "byte"
    parts = pre.get("pretokenizers") or []
    if len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
        pattern = parts[0]["pattern"].get("Regex", "")
        second = parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
        if second and r"[^\s" in pattern and r"\s+" not in pattern.replace(r"[^\s\p{L}\p{N}]+", ""):
            return "space"
    return "whole"


class _Places(dict):
    """Chunk to its row in the encoder's tables; an unknown chunk gets the next row and waits to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = place = len(self)
        self.waiting.append(chunk)
        return place


class ChunkEncoder:
    """Encode texts into one flat id array and its offsets. `remember`: chunks held before the memory starts anew."""

    def __init__(self, path: str, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        added = [t["content"] for t in spec.get("added_tokens") or () if t["content"]]
        #: Texts with an added token's string are encoded whole, as only the tokenizer cuts there.
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.layout = _layout(spec)
        self.remember = remember if self.layout != "whole" else 0  # whole texts seldom come again
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)

    def rest(self) -> None:
        """At the end of a task: let go of what was remembered."""
        self._forget()
        trim()

    def _chunks(self, text: str) -> list[str]:
        if self.layout == "whole" or _ODD.search(text) or self.added and self.added.search(text):
            return [text]
        if self.layout == "space":
            return text.split()
        if _UNEVEN.search(text):
            return _BYTE_LEVEL.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _learn(self) -> None:
        waiting = self.places.waiting
        found = [e.ids for e in self.tokenizer.encode_batch_fast(waiting, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        n, end = len(self.places), self.n_ids + len(flat)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.ids[self.n_ids : end] = flat
        self.size[n - len(found) : n] = sizes
        self.start[n - len(found) : n] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids = end
        waiting.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids and int64 offsets (one more than texts)."""
        if len(self.places) > self.remember or self.n_ids > 32 * self.remember:
            self._forget()
        place = self.places.__getitem__
        rows = []
        for text in texts:
            chunks = self._chunks(text)
            rows.append(np.fromiter(map(place, chunks), np.int64, len(chunks)))
        if self.places.waiting:
            self._learn()
        counts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = self.ids[np.repeat(self.start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return flat, ends[counts]


def vocabulary_size(path: str) -> int:
    """One more than the largest id, added tokens included."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


@lru_cache(maxsize=2)
def encoder(path: str, remember: int = 500_000) -> ChunkEncoder:
    """One encoder per worker process and file."""
    return ChunkEncoder(path, remember)
