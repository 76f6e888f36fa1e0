r"""Operator 7: language-model scores by a hierarchical Pitman-Yor model.

Each context (the whole word before, or the start of a document) is a restaurant; all share the unigram restaurant as
their parent, whose own parent is uniform over the known words and one for all others. Seatings are sampled by Gibbs
(`seating.py`), discounts and strengths of both levels are drawn anew after each exchange, and predictive probabilities
are averaged over the sweeps after burn-in.

How it is spread: a shard is a run of documents in one task. Words get dense numbers by frequency (a word is its 64-bit
hash). A shard counts its distinct (context, word) pairs once and sends them to buckets dealt by context; a context of
more than `most` customers is dealt by word as well, so the pairs of a bucket stay bounded and their number follows the
input. Buckets are written once as a table bucketed by their number, which the rounds read without a shuffle. In each
round a bucket sweeps its own restaurants SWEEPS times given its words' parent probabilities, then sends its tables by
word (and by split context) to be added up and seated in the root; root counts come back to the buckets that hold the
words. Only totals and the likelihoods on the grid of parameters reach the driver. Draws are seeded by bucket and round,
so a lost task replays the same seats. Answers go back to shards, one row a bucket and shard.

Tokens: words `[^\x20\x09-\x0D]+` with A-Z lowered, then one end. Documents whose crc32(doc_id as text) mod 5 is not 1
are learnt. Defined results: null or empty texts hold the end alone; a null doc_id is the empty text; repeated rows
are learnt and scored each; with nothing learnt every word has probability one; an empty table gives an empty result;
other columns are ignored. A token's log10 probability is rounded to 24 bits before documents add theirs up.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bucketed, discard, doc_slices, input_bytes, materialize, trim
from quillspark.llm.seating import DISCOUNTS, STRENGTHS, Restaurants, draw_parameters, first_tables, restaurants_likelihood, tables_likelihood

#: Rounds of SWEEPS sweeps between exchanges; the seats of the first BURN_IN rounds are not used.
ROUNDS, BURN_IN, SWEEPS = 5, 1, 3
#: Context number of the start of a document; the word of number i is context i + 1.
START = 0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def squeeze(values: np.ndarray) -> bytes:
    """Compressed byte planes of an array; its kind and length go in front."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    head = values.dtype.str.encode().ljust(4) + len(values).to_bytes(8, "little")
    return head + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def small(values: np.ndarray) -> bytes:
    """Counts or places, compressed in the smallest kind that holds them all."""
    return squeeze(values.astype(np.min_scalar_type(int(values.max(initial=0)))))


def steps(values: np.ndarray) -> bytes:
    """Ascending numbers."""
    return small(np.diff(values, prepend=0))


def expand(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:4].decode().strip()), int.from_bytes(data[4:12], "little")
    planes = pa.decompress(data[12:], n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def numbers(data: bytes) -> np.ndarray:
    return expand(data).astype(np.int64)


def climbed(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data))


def mix(values: np.ndarray) -> np.ndarray:
    """Well-spread unsigned numbers."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


# Shards and words


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


SHARDS = "shard bigint, n_learnt bigint, doc_ids binary, nulls binary, sizes binary, tokens binary, hashes array<bigint>, counts array<bigint>"


def shard_row(ids: list, texts: list[str], shard: int) -> tuple:
    """Tokens as places in the shard's words, which stand by falling frequency: hashes and learnt counts."""
    from xxhash import xxh64_intdigest

    local = _Local({b"": 0})  # the end
    tokens = []
    for text in texts:
        found = text.encode().lower().split()
        tokens.append(np.append(np.fromiter(map(local.__getitem__, found), np.int32, len(found)), np.int32(0)))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = np.concatenate(tokens)
    hashes = np.fromiter(map(xxh64_intdigest, local), np.uint64, len(local)).view(np.int64)
    order = np.argsort(-np.bincount(flat, minlength=len(local)), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    learnt = np.array([not held_out(d) for d in ids])
    counts = np.bincount(flat[np.repeat(learnt, sizes)], minlength=len(local))
    return (shard, int(learnt.sum()), np.array([d or 0 for d in ids], "<i8").tobytes(), np.array([d is None for d in ids]).tobytes(), small(sizes), small(rank[flat]), hashes[order], counts[order])


def shards(docs: DataFrame, chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), 0
        for ids, texts in doc_slices(batches, chars):
            yield from _rows(SHARDS, [shard_row(ids, texts, number << 24 | made)]).to_batches()
            made += 1
        trim()

    return materialize(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SHARDS), "shards")


def vocabulary(found: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """hash and id (dense, the most frequent word first) of the learnt words; and the counts that occur, falling, with the ends of
    their ids. Different counts are at most the root of twice the learnt tokens, so that table is small at any size."""
    totals = found.select(F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("counts").alias("n")))).groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 0")
    ranked = materialize(totals.repartitionByRange(F.desc("n"), "hash").sortWithinPartitions(F.desc("n"), "hash").withColumn("at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("at", 33)
    starts, at = [], 0
    for row in ranked.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        starts.append((row["part"], at))
        at += row["count"]
    first = F.broadcast(ranked.sparkSession.createDataFrame(starts, "part bigint, first bigint"))
    within = F.col("at") - F.shiftleft(part, 33)
    tallies = sorted(map(tuple, ranked.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    out = materialize(ranked.join(first, part == first.part).select("hash", (F.col("first") + within).alias("id")), "vocabulary")
    discard(ranked)
    counts, each = (np.array(x, np.int64) for x in (zip(*tallies, strict=True) if tallies else ((), ())))
    return out, counts, np.cumsum(each)


@dataclass(frozen=True)
class Sizes:
    """Known to every task: learnt tokens, words and documents; buckets; the customers of a context that is dealt by word."""

    tokens: int
    words: int
    documents: int
    buckets: int
    most: int

    @property
    def unknown(self) -> int:
        """Number of every word that was never learnt."""
        return self.words

    def deal(self, context: np.ndarray, word: np.ndarray, customers: np.ndarray) -> np.ndarray:
        ways = 1 + np.maximum(customers - 1, 0) // self.most
        way = np.where(context == self.unknown + 1, mix(word), mix(word) % ways.astype(np.uint64))  # nobody sits in an unknown context
        return (mix(mix(context) ^ way) % np.uint64(self.buckets)).astype(np.int64)


PAIRS = "kind string, shard bigint, bucket bigint, a binary, b binary, c binary, d binary, e binary, f binary"


def shard_pairs(row: dict, pos: np.ndarray, ids: np.ndarray, totals: np.ndarray, sizes: Sizes) -> list[tuple]:
    """One `doc` row (ids, nulls, sizes, each token's pair, base scores, known tokens) and a `req` row for each bucket with
    distinct pairs: contexts, pairs of each, words, learnt counts, and the customers of contexts dealt by word."""
    n_words = len(row["hashes"])
    number, total = np.full(n_words, sizes.unknown, np.int64), np.zeros(n_words, np.int64)
    number[pos], total[pos] = ids, totals
    per_doc, tokens = numbers(row["sizes"]), expand(row["tokens"])
    starts = np.cumsum(per_doc) - per_doc
    base = np.log10((total + 0.5) / (sizes.tokens + 0.5 * (sizes.words + 1)))
    sums = np.add.reduceat(base[tokens], starts), np.add.reduceat((total > 0).astype(np.int64)[tokens], starts)
    word = number[tokens]
    context = np.empty_like(word)
    context[1:] = word[:-1] + 1
    context[starts] = START
    pairs, place = np.unique(context * (sizes.words + 2) + word, return_inverse=True)
    doc_ids, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], bool)
    learnt = np.repeat([not held_out(None if null else int(d)) for d, null in zip(doc_ids, nulls, strict=True)], per_doc)
    counts = np.bincount(place[learnt], minlength=len(pairs))
    context, word = pairs // (sizes.words + 2), pairs % (sizes.words + 2)
    by_number = np.argsort(number, kind="stable")
    at = by_number[np.searchsorted(number[by_number], np.maximum(context - 1, 0)).clip(max=n_words - 1)]
    customers = np.where(context == START, sizes.documents, total[at])
    bucket = sizes.deal(context, word, customers)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    bucket, context, word, counts, customers = (x[order] for x in (bucket, context, word, counts, customers))
    rows = [("doc", row["shard"], -1, row["doc_ids"], row["nulls"], row["sizes"], small(rank[place]), sums[0].astype("<f8").tobytes(), small(sums[1]))]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(edges, np.r_[edges[1:], len(bucket)], strict=True):
        own, head, each = np.unique(context[a:b], return_index=True, return_counts=True)
        whole = customers[a:b][head]
        rows.append(("req", row["shard"], int(bucket[a]), steps(own), small(each), small(word[a:b]), small(counts[a:b]), small(np.where(whole > sizes.most, whole, 0)), None))
    return rows


# Buckets

PACKS = "kind string, bucket bigint, shard bigint, contexts binary, per_context binary, whole binary, split binary, words binary, word binary, counts binary, request binary, size bigint"


def merge_bucket(rows: pa.Table, sizes: Sizes) -> pa.Table:
    """A `model` row with all shards' pairs of one bucket; for each shard an `ask` row, the steps between its pairs among them."""
    shard, *data = (rows.column(c).to_pylist() for c in ("shard", "a", "b", "c", "d", "e"))
    keys, counts, whole = [], [], []
    for a, b, c, d, e in zip(*data, strict=True):
        context = climbed(a)
        keys.append(np.repeat(context, numbers(b)) * (sizes.words + 2) + numbers(c))
        counts.append(numbers(d))
        large = numbers(e)
        whole.append(np.stack([context[large > 0], large[large > 0]]))
    del data
    ends = np.cumsum([len(k) for k in keys])[:-1]
    pairs, asked = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(asked, np.concatenate(counts), len(pairs)).astype(np.int64)
    del keys, counts
    bucket = rows.column("bucket")[0].as_py()
    asks = [("ask", bucket, s, *[None] * 7, steps(x), len(x)) for s, x in zip(shard, np.split(asked, ends), strict=True)]
    contexts, context, per_context = np.unique(pairs // (sizes.words + 2), return_inverse=True, return_counts=True)
    words, word = np.unique(pairs % (sizes.words + 2), return_inverse=True)
    customers, split = np.bincount(context, count, len(contexts)).astype(np.int64), np.zeros(len(contexts), bool)
    large = np.concatenate(whole, axis=1)
    at = np.searchsorted(contexts, large[0])
    customers[at], split[at] = large[1], True
    model = ("model", bucket, -1, steps(contexts), small(per_context), small(customers), squeeze(split.view(np.uint8)), steps(words), small(word), small(count), None, int((words < sizes.words).sum() + split.sum()))
    return _rows(PACKS, [model, *asks])


@dataclass(frozen=True)
class State:
    """Of the whole model in one round: parameters of contexts and root, the root's customers and tables."""

    discount: float = 0.5
    strength: float = 1.0
    root_discount: float = 0.5
    root_strength: float = 1.0
    customers: int = 0
    tables: int = 0


class Bucket:
    def __init__(self, row: dict, sizes: Sizes):
        self.contexts, self.words = climbed(row["contexts"]), climbed(row["words"])
        self.context = np.repeat(np.arange(len(self.contexts)), numbers(row["per_context"]))
        self.whole, self.split = numbers(row["whole"]), expand(row["split"]).astype(bool)
        self.word, self.counts = numbers(row["word"]), numbers(row["counts"])
        self.learnt = np.flatnonzero(self.counts)
        self.many = self.counts[self.learnt] > 1
        self.known, self.sizes = self.words < sizes.words, sizes
        #: What is sent up: words by their number, and beyond them the split contexts.
        self.sent = np.concatenate([self.words[self.known], sizes.words + 2 + self.contexts[self.split]])

    def parts(self, n: int) -> list[np.ndarray]:
        part = self.sent % n
        order = np.argsort(part, kind="stable")
        return np.split(order, np.cumsum(np.bincount(part, minlength=n))[:-1])

    def tables(self, seats: bytes | None) -> np.ndarray:
        """Tables of the learnt pairs; `seats` holds those of pairs with more than one customer."""
        out = first_tables(self.counts[self.learnt])
        if seats is not None:
            out[self.many] = numbers(seats)
        return out

    def take(self, boxes: list[tuple[int, bytes, bytes]], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables in the root by word; tables of split contexts by context. From (part, a, b)."""
        up = np.zeros((2, len(self.sent)), np.int64)
        places = self.parts(parts)
        for part, a, b in boxes:
            up[0][places[part]], up[1][places[part]] = numbers(a), numbers(b)
        n = int(self.known.sum())
        root = np.zeros((2, len(self.words)), np.int64)
        root[:, self.known] = up[:, :n]
        shared = np.zeros(len(self.contexts), np.int64)
        shared[self.split] = up[0, n:]
        return root, shared

    def parent(self, root: np.ndarray, state: State) -> np.ndarray:
        base = (state.root_strength + state.root_discount * state.tables) / (self.sizes.words + 1)
        return (root[0] - state.root_discount * root[1] + base) / (state.root_strength + state.customers)

    def predictive(self, tables: np.ndarray, shared: np.ndarray, parent: np.ndarray, state: State) -> np.ndarray:
        opened = np.where(self.split, shared, np.bincount(self.context[self.learnt], tables, len(self.contexts)))
        own = self.counts.astype(np.float64)
        own[self.learnt] -= state.discount * tables
        return (own + ((state.strength + state.discount * opened)[self.context]) * parent[self.word]) / (state.strength + self.whole)[self.context]


BOX = "kind string, bucket bigint, part bigint, a binary, b binary, c binary, grid array<double>"
GRID = len(DISCOUNTS) * len(STRENGTHS)


def visit(sizes: Sizes, state: State, number: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One round in one bucket. Out: `word` rows (numbers, tables, what the root had), `seats` by sweep, and one `stat`."""

    def run(model: pa.Table, inbox: pa.Table) -> pa.Table:
        bucket = Bucket(model.to_pylist()[0], sizes)
        mail = inbox.to_pylist()
        key = model.column("bucket")[0].as_py()
        tables = bucket.tables(next((x["a"] for x in mail if x["kind"] == "seats"), None))
        root, shared = bucket.take([(x["part"], x["a"], x["b"]) for x in mail if x["kind"] == "word"], parts)
        context, rows = bucket.context[bucket.learnt], []
        own = np.bincount(context, tables, len(bucket.contexts)).astype(np.int64)
        if number:
            house = Restaurants(context, bucket.counts[bucket.learnt], tables, len(bucket.contexts), np.where(bucket.split, shared - own, 0))
            log_parent, rng = np.log(bucket.parent(root, state))[bucket.word[bucket.learnt]], np.random.default_rng([key, number])
            for i in range(SWEEPS):
                house.sweep(log_parent, state.strength, state.discount, rng)
                rows.append(("seats", key, i, small(tables[bucket.many]), None, None, None))
            own = np.bincount(context, tables, len(bucket.contexts)).astype(np.int64)
        by_word = np.bincount(bucket.word[bucket.learnt], tables, len(bucket.words)).astype(np.int64)
        up = np.concatenate([by_word[bucket.known], own[bucket.split]])
        echo = np.concatenate([root[1][bucket.known], bucket.whole[bucket.split]])
        rows += [("word", key, p, steps(bucket.sent[at]), small(up[at]), small(echo[at]), None) for p, at in enumerate(bucket.parts(parts)) if len(at)]
        grid = tables_likelihood(bucket.counts[bucket.learnt], tables)[:, None] + restaurants_likelihood(bucket.whole[~bucket.split], own[~bucket.split])
        return _rows(BOX, [*rows, ("stat", key, -1, None, None, None, grid.ravel())])

    return run


def seat_root(sizes: Sizes, state: State, number: int) -> Callable[[pa.Table], pa.Table]:
    """Add up the tables of some words from all buckets and seat them in the root; answer each bucket. Last, one `stat`: the
    contexts' grid, the root's, its customers and tables."""

    def run(rows: pa.Table) -> pa.Table:
        buckets, a, b, c = (rows.column(n).to_pylist() for n in ("bucket", "a", "b", "c"))
        sent = [climbed(x) for x in a]
        ends = np.cumsum([len(x) for x in sent])[:-1]
        every, at = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(at, np.concatenate([expand(x) for x in b]), len(every)).astype(np.int64)
        echo = np.zeros(len(every), np.int64)
        np.maximum.at(echo, at, np.concatenate([numbers(x) for x in c]))
        n = int(np.searchsorted(every, sizes.words))  # beyond them are contexts, whose tables are only added up
        part = rows.column("part")[0].as_py()
        tables = np.where(echo[:n] > 0, np.clip(echo[:n], 1, total[:n]), first_tables(total[:n]))
        house = Restaurants(np.zeros(n, np.int64), total[:n], tables, 1, np.array([max(0, state.tables - int(echo[:n].sum()))]))
        house.sweep(np.full(n, -np.log(sizes.words + 1)), state.root_strength, state.root_discount, np.random.default_rng([part, number, 1]))
        out = np.concatenate([tables, np.zeros(len(every) - n, np.int64)])
        answers = [("word", k, part, small(total[x]), small(out[x]), None, None) for k, x in zip(buckets, np.split(at, ends), strict=True)]
        grid = np.concatenate([restaurants_likelihood(echo[n:], total[n:]).ravel(), tables_likelihood(total[:n], tables), [total[:n].sum(), tables.sum()]])
        return _rows(BOX, [*answers, ("stat", -1, part, None, None, None, grid)])

    return run


def _grid(box: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for row in box.filter("kind = 'stat'").select(F.posexplode("grid").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[row["at"]] = row["x"]
    return out


def train(models: DataFrame, sizes: Sizes, rounds: int = ROUNDS, burn_in: int = BURN_IN) -> tuple[list[tuple[int, State]], DataFrame, int]:
    """The rounds whose seats count with their states; their seats and root counts by `level`; and the number of parts."""
    entries = models.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, entries // 250_000)
    inbox = models.sparkSession.createDataFrame([], BOX)
    models = models.groupBy("bucket")
    state, kept, boxes, old = State(), [], [], []
    for number in range(rounds + 1):
        outbox = materialize(models.cogroup(inbox.groupBy("bucket")).applyInArrow(visit(sizes, state, number, parts), BOX), "outbox")
        root = materialize(outbox.filter("kind = 'word'").groupBy("part").applyInArrow(seat_root(sizes, state, number), BOX), "root")
        grid, own = _grid(root, GRID + len(DISCOUNTS) + 2), _grid(outbox, GRID)
        seated = replace(state, customers=int(grid[-2]), tables=int(grid[-1]))
        discard(*old)
        old = [] if number > burn_in else [outbox, root]
        seats, words = outbox.filter("kind = 'seats'"), root.filter("kind = 'word'")
        if number > burn_in:
            kept.append((number, seated))
            boxes.append(seats.unionByName(words).withColumn("level", F.lit(number)))
        inbox = seats.filter(F.col("part") == SWEEPS - 1).unionByName(words)
        rng = np.random.default_rng([number, 2])
        d, s = draw_parameters((own + grid[:GRID]).reshape(len(DISCOUNTS), len(STRENGTHS)), rng)
        d0, s0 = draw_parameters(grid[GRID:-2, None] + restaurants_likelihood(np.array([seated.customers]), np.array([seated.tables])), rng)
        state = replace(seated, discount=d, strength=s, root_discount=d0, root_strength=s0)
    out = boxes[0]
    for box in boxes[1:]:
        out = out.unionByName(box)
    return kept, out, parts


def answer(packs: DataFrame, levels: DataFrame, sizes: Sizes, kept: list[tuple[int, State]], parts: int) -> DataFrame:
    """For each shard and bucket: log10 probability of each requested pair in its order."""

    def run(packed: pa.Table, mail: pa.Table) -> pa.Table:
        rows, mail = packed.to_pylist(), mail.to_pylist()
        bucket = Bucket(next(r for r in rows if r["kind"] == "model"), sizes)
        total, n = np.zeros(len(bucket.counts)), 0
        for level, state in kept:
            own = [x for x in mail if x["level"] == level]
            root, shared = bucket.take([(x["part"], x["a"], x["b"]) for x in own if x["kind"] == "word"], parts)
            parent = bucket.parent(root, state)
            for x in own:
                if x["kind"] == "seats":
                    total += bucket.predictive(bucket.tables(x["a"]), shared, parent, state)
                    n += 1
        score = np.log10(total / n).astype(np.float32)
        return _rows("shard bigint, bucket bigint, scores binary", [(r["shard"], r["bucket"], squeeze(score[climbed(r["request"])])) for r in rows if r["kind"] == "ask"])

    return packs.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(run, "shard bigint, bucket bigint, scores binary")


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, buckets: int | None = None, chars: int = 16_000_000, most: int = 250_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the whole text)."""
    buckets = buckets or max(16, -(-input_bytes(docs) // (12 << 20)))
    found = shards(docs, chars)
    words, counts, ends = vocabulary(found)
    sent = docs.sparkSession.sparkContext.broadcast((counts, ends))
    sizes = Sizes(int((counts * np.diff(ends, prepend=0)).sum()), int(ends[-1]) if len(ends) else 0, found.agg(F.coalesce(F.sum("n_learnt"), F.lit(0))).first()[0], buckets, most)

    def pairs(shard: pa.Table, known: pa.Table) -> pa.Table:
        (counts, ends), packed = sent.value, known.column("at").to_numpy()
        pos, ids = packed >> 40, packed & ((1 << 40) - 1)
        return _rows(PAIRS, shard_pairs(shard.to_pylist()[0], pos, ids, counts[np.searchsorted(ends, ids, "right")], sizes))

    # A word's place in its shard and its number in one value: this is the widest exchange, a row for each word of each shard.
    at = F.shiftleft(F.col("pos").cast("bigint"), 40) + F.col("id")
    known = found.select("shard", F.posexplode("hashes").alias("pos", "hash")).join(words, "hash").select(F.col("shard").alias("of"), at.alias("at"))
    rows = materialize(found.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(pairs, PAIRS), "pairs", partition_by="kind")
    discard(found, words)
    requests = rows.filter("kind = 'req'").select("shard", "bucket", "a", "b", "c", "d", "e")
    with bucketed(requests.groupBy("bucket").applyInArrow(lambda t: merge_bucket(t, sizes), PACKS), "packs", buckets, "bucket", "kind") as packs:
        kept, levels, parts = train(packs.filter("kind = 'model'"), sizes)
        answers = materialize(answer(packs, levels, sizes, kept, parts), "answers")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        logs = np.concatenate([expand(x) for x in right.sort_by("bucket").column("scores").to_pylist()]).astype(np.float64)
        out = []
        for a, b, c, d, e, f in zip(*(left.column(n).to_pylist() for n in "abcdef"), strict=True):
            ids, nulls, per_doc = np.frombuffer(a, "<i8"), np.frombuffer(b, bool), numbers(c)
            total = np.add.reduceat(logs[expand(d)], np.cumsum(per_doc) - per_doc)
            held = [held_out(None if n else int(i)) for i, n in zip(ids, nulls, strict=True)]
            columns = [pa.array(ids, mask=nulls), pa.array(held), pa.array(per_doc), pa.array(numbers(f)), pa.array(np.full(len(ids), sizes.tokens)), pa.array(np.frombuffer(e, "<f8")), pa.array(total)]
            out.append(pa.table(columns, names=[f.split()[0] for f in RESULT.split(", ")]))
        return pa.concat_tables(out)

    texts = rows.filter("kind = 'doc'").select("shard", *"abcdef")
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(score, RESULT)
