r"""Operator 10: benchmark passages in training documents, by a distributed positional inverted index.

The index is split by documents: a shard is a run of documents that one task read, and a row of the index is one term's
postings in one shard (their places among the shard's words, delta-coded). `build_index` stores every term's postings in
the shared folder, whatever is to be searched.

`search` takes the test items in blocks of bounded size. In each shard the windows of all items are matched together:
every different window, whichever items have it, starts from the postings of its rarest term there, and a start survives only if each further term's
postings hold its own offset. With `slop` over zero it finds proximity matches as well, where each next term follows
within `slop` further words: every place that can be reached is kept, not the nearest alone. Postings are dealt out by
shard, so a word or passage that a third of all documents hold is dealt like any other.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lowered. Defined results: null or empty texts have no words and
match nothing; items without words have no window; rows that repeat a doc_id or item_id are judged row by row (an
item_id counts once); an empty table of documents or items gives no matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import doc_slices, materialize, text_version, trim

#: Bytes that end a word become spaces; A-Z become a-z; bytes over 0x7F belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


INDEX = "shard bigint, term binary, n bigint, postings binary, doc_ids binary, null_ids binary, versions binary, starts binary"
NAMES = [f.split()[0] for f in INDEX.split(", ")]


def _binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in `data`."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4")), pa.py_buffer(data)])


def build_index(docs: DataFrame, chars: int = 16_000_000) -> DataFrame:
    """One row per shard and term with its postings, and one row per shard (term null) with its documents.

    `starts`: for each document, its first place and the place after its last word; a gap of one place parts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), 0
        for keys, texts in doc_slices(batches, chars):
            ids, versions = ([k[name] for k in keys] for name in ("doc_id", "version"))
            known = _Terms()
            tokens, spans, at = [], np.zeros((len(ids), 2), np.int64), 0
            for i, text in enumerate(texts):
                found = words(text)
                tokens.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                spans[i] = at, at + len(found)
                at += len(found) + 1
            flat = np.concatenate(tokens)
            place = np.arange(len(flat)) + np.repeat(np.arange(len(ids)), spans[:, 1] - spans[:, 0])
            order = np.argsort(flat, kind="stable")
            place, counts = place[order], np.bincount(flat, minlength=len(known))
            steps = np.diff(place, prepend=0)
            heads = np.cumsum(counts) - counts
            steps[heads] = place[heads]
            names = list(known)
            shard, n = number << 24 | made, len(names)
            made += 1
            texts_end = np.cumsum(np.fromiter(map(len, names), np.int64, n))
            nothing, one = pa.nulls(n, pa.binary()), pa.nulls(1, pa.binary())
            nulls = np.array([d is None for d in ids])
            alone = (np.array([d or 0 for d in ids], "<i8").tobytes(), nulls.tobytes(), np.array(versions, "<i8").tobytes(), spans.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), one, pa.array([len(ids)], pa.int64()), one, *(pa.array([x], pa.binary()) for x in alone)], NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), _binaries(b"".join(names), texts_end), pa.array(counts), _binaries(steps.astype("<u4").tobytes(), 4 * np.cumsum(counts)), *[nothing] * 4], NAMES)
        trim()

    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), text_version(text).alias("version"))
    return materialize(docs.select(key, text).mapInArrow(run, INDEX), "postings")


class _Terms(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class Block:
    """Test items as one run of term numbers, and their different windows of `size` words (or all of a shorter item)."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        terms = _Terms()
        found = [np.fromiter(map(terms.__getitem__, w), np.int32, len(w)) for w in (words(text) for _, text in items)]
        self.terms, self.item_ids = list(terms), [i for i, _ in items]
        self.run = np.concatenate([*found, np.empty(0, np.int32)])
        length = np.array([len(x) for x in found], np.int64)
        start = np.cumsum(length) - length
        #: (words in a window, first places of the windows, ends of their items, items one after the other)
        self.kinds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(length, size)):
            if n:
                mine = np.flatnonzero((length >= size) if n == size else (length == n))
                counts = length[mine] - n + 1
                item = np.repeat(mine, counts)
                first = np.repeat(start[mine], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.run, n)[first])
                _, kept, number = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * int(n)))).ravel(), return_index=True, return_inverse=True)
                pair = np.unique(number.reshape(-1).astype(np.int64) * len(items) + item)
                self.kinds.append((int(n), first[kept], np.cumsum(np.bincount(pair // len(items), minlength=len(kept))), pair % len(items)))

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows as rows of term numbers, ends of their items, items), of equal length each time."""
        for n, first, ends, items in self.kinds:
            for at in range(0, len(first), 200_000):
                upto = ends[at : at + 200_000]
                before = ends[at - 1] if at else 0
                yield self.run[first[at : at + 200_000, None] + np.arange(n)], upto - before, items[before : upto[-1]]


def items_of(doc: np.ndarray, window: np.ndarray, ends: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) for all items of the windows found in documents."""
    counts = np.diff(ends, prepend=0)[window]
    place = np.repeat(ends[window] - np.cumsum(counts), counts) + np.arange(counts.sum())
    return np.repeat(doc, counts), items[place]


class Shard:
    """Postings of one shard: `places` by term, and the term at each place."""

    def __init__(self, term: np.ndarray, postings: list[bytes], spans: np.ndarray, n_terms: int):
        counts = np.array([len(x) // 4 for x in postings], np.int64)
        steps = np.frombuffer(b"".join(postings), "<u4").astype(np.int64)
        total, heads = np.cumsum(steps), np.cumsum(counts) - counts
        self.places = total - np.repeat(total[heads] - steps[heads], counts)
        self.first, self.counts = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        self.first[term], self.counts[term] = heads, counts
        self.spans, self.begins = spans, spans[:, 0]
        self.at = np.full((int(spans[-1, 1]) if len(spans) else 0) + 1, -1, np.int32)
        self.at[self.places] = np.repeat(term, counts).astype(np.int32)

    def candidates(self, windows: np.ndarray, numbers: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, their numbers, places of the rarest term, which of the window's terms that is), one row a posting."""
        n = self.counts[windows]
        there = np.flatnonzero((n > 0).all(axis=1))
        windows, numbers, n = windows[there], numbers[there], n[there]
        rarest = n.argmin(axis=1)
        each = n[np.arange(len(n)), rarest]
        begin = self.first[windows[np.arange(len(n)), rarest]]
        total = np.cumsum(each)
        a = 0
        while a < len(each):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            row = np.repeat(np.arange(a, b), each[a:b])
            within = np.arange(len(row)) - np.repeat(np.cumsum(each[a:b]) - each[a:b], each[a:b])
            yield windows[row], numbers[row], self.places[begin[row] + within], rarest[row]
            a = b

    def phrases(self, windows: np.ndarray, numbers: np.ndarray, place: np.ndarray, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, window) where the window's terms stand one after the other."""
        size = windows.shape[1]
        start = place - rarest
        good = np.flatnonzero((start >= 0) & (start + size < len(self.at) + 1))
        for k in range(size):
            good = good[self.at[start[good] + k] == windows[good, k]]
        return start[good], start[good] + size, numbers[good]

    def nearby(self, windows: np.ndarray, numbers: np.ndarray, place: np.ndarray, rarest: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, window) where each next term follows with at most `slop` words between: from the rarest term, the nearest ends on either side."""
        doc = self.spans[np.searchsorted(self.begins, place, "right") - 1]
        size = windows.shape[1]
        width = (size - 1) * (slop + 1) + 1
        found = [place.copy(), place.copy()]
        alive = np.ones(len(place), bool)
        for side, way in ((0, -1), (1, 1)):
            spot = place[:, None] + way * np.arange(width)
            term = np.where((spot >= doc[:, :1]) & (spot < doc[:, 1:]), self.at[np.clip(spot, 0, len(self.at) - 1)], -1)
            reach = np.zeros((len(place), width), bool)
            reach[:, 0] = True
            for step in range(1, size):
                wanted = rarest + way * step
                on = (wanted >= 0) & (wanted < size)
                summed = np.cumsum(np.pad(reach, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
                low = np.maximum(np.arange(width) - slop - 1, 0)
                near = summed[:, np.arange(width)] - summed[:, low] > 0
                following = near & (term == windows[np.arange(len(place)), np.clip(wanted, 0, size - 1)][:, None])
                reach = np.where(on[:, None], following, reach)
            alive &= reach.any(axis=1)
            found[side] = place + way * reach.argmax(axis=1)
        return found[0][alive], found[1][alive] + 1, numbers[alive]


RESULT = "doc_id bigint, version bigint, shard bigint, doc_no bigint, n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<bigint>"


def search(index: DataFrame, items: list[tuple[object, str | None]], size: int = 13, slop: int = 0) -> DataFrame:
    """For each document: merged spans of words inside matches (end exclusive) and the items that match. `items`: one bounded block."""
    spark = index.sparkSession
    block = Block(items, size)
    chosen = spark.createDataFrame([(None, None), *((t, i) for i, t in enumerate(block.terms))], "wanted binary, id int")
    block.terms, n_terms = [], len(block.terms)
    sent = spark.sparkContext.broadcast(block)
    rows = index.join(F.broadcast(chosen), F.col("term").eqNullSafe(F.col("wanted"))).drop("term", "wanted")

    def run(rows: pa.Table) -> pa.Table:
        block, number = sent.value, rows.column("id").to_numpy(zero_copy_only=False)
        head = int(np.flatnonzero(np.isnan(number.astype(np.float64)))[0])
        ids, nulls, versions, spans = (np.frombuffer(rows.column(c)[head].as_py(), kind) for c, kind in (("doc_ids", "<i8"), ("null_ids", bool), ("versions", "<i8"), ("starts", "<i8")))
        spans = spans.reshape(-1, 2)
        terms = rows.filter(rows.column("id").is_valid())
        shard = Shard(terms.column("id").to_numpy().astype(np.int64), terms.column("postings").to_pylist(), spans, n_terms)
        depth = np.zeros(len(shard.at) + 1, np.int64)
        owned: list[np.ndarray] = []
        for windows, upto, items in block.windows():
            for found in shard.candidates(windows, np.arange(len(windows)), 1_000_000 if not slop else 50_000):
                start, end, window = shard.nearby(*found, slop) if slop else shard.phrases(*found)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                met = np.unique((np.searchsorted(shard.begins, start, "right") - 1) * len(windows) + window)
                doc, item = items_of(met // len(windows), met % len(windows), upto, items)
                owned.append(np.unique(doc * len(block.item_ids) + item))
        inside = np.cumsum(depth) > 0
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        of = np.searchsorted(shard.begins, starts, "right") - 1
        per_doc = np.bincount(of, minlength=len(ids))
        pair = np.unique(np.concatenate([*owned, np.empty(0, np.int64)])).astype(np.int64)
        doc, item = pair // max(1, len(block.item_ids)), pair % max(1, len(block.item_ids))
        kinds = sorted({x for x in block.item_ids}, key=lambda x: (x is None, x))
        rank = {x: i for i, x in enumerate(kinds)}
        named = np.unique(doc * max(1, len(kinds)) + np.array([rank[x] for x in block.item_ids], np.int64)[item])
        doc, item = named // max(1, len(kinds)), named % max(1, len(kinds))
        lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
        span = pa.StructArray.from_arrays([pa.array(starts - shard.begins[of]), pa.array(ends - shard.begins[of])], ["start", "end"])
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=nulls),
                "version": pa.array(versions, pa.int64()),
                "shard": pa.array(np.full(len(ids), rows.column("shard")[0].as_py())),
                "doc_no": pa.array(np.arange(len(ids))),
                "n_words": pa.array(spans[:, 1] - spans[:, 0]),
                "n_hit": pa.array(np.bincount(of, ends - starts, len(ids)).astype(np.int64)),
                "spans": lists(per_doc, span),
                "item_ids": lists(np.bincount(doc, minlength=len(ids)), pa.array([kinds[i] for i in item], pa.int64())),
            }
        )

    return rows.groupBy("shard").applyInArrow(run, RESULT)


def item_blocks(items: DataFrame, chars: int = 2_000_000) -> Iterator[list[tuple[object, str | None]]]:
    """The test items, streamed to the driver in blocks of about `chars` characters."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, slop: int = 0, chars: int = 2_000_000) -> DataFrame:
    """doc_id, version (hash of the text), n_words, n_hit (words inside a match), item_ids and spans of every document, over all items."""
    index = build_index(docs)
    blocks = item_blocks(items, chars)
    found, later = search(index, next(blocks, []), size, slop), []
    for block in blocks:
        later.append(materialize(search(index, block, size, slop).filter("n_hit > 0"), "matches"))
    if later:
        for part in later:
            found = found.unionByName(part)
        spans = F.array_sort(F.flatten(F.collect_list("spans")))
        found = found.groupBy("shard", "doc_no").agg(*(F.max(c).alias(c) for c in ("doc_id", "version", "n_words")), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
        nothing = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("hit"))
        step = lambda got, span: F.struct(
            F.greatest(got["end"], span["end"]).alias("end"), (got["hit"] + F.greatest(F.lit(0), span["end"] - F.greatest(got["end"], span["start"]))).alias("hit")
        )
        found = found.withColumn("n_hit", F.aggregate("spans", nothing, step, lambda got: got["hit"]))
    return found.select("doc_id", "version", "n_words", "n_hit", "item_ids", "spans")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A word was hit, and hits are a twentieth of the words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """The rows of `docs` that are not contaminated; rows that repeat a doc_id are judged row by row."""
    bad = contamination(docs, items, size).filter(is_contaminated()).select(F.col("doc_id").alias("bad_doc"), F.col("version").alias("bad_version")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc"), text_version(F.col("text").cast("string")).alias("version"))
    return rows.join(bad, F.col("doc").eqNullSafe(F.col("bad_doc")) & (F.col("version") == F.col("bad_version")), "left_anti").select("row.*")
