"""Operator 13: compression of vectors to codes, with the nearest codebook entry found by a vector-approximation file.

A vector of finite components becomes integers floor(scale * x) and is cut into equal consecutive parts, each with a codebook of its
own. A codebook starts as that part of the first vectors and is refined by rounds: every part goes to its nearest entry, every entry
moves to the floor of its parts' mean, unused entries stay. All arithmetic is on integers, so results do not depend on how rows are
dealt.

The nearest entry of a part is found by filtering: the coordinates of the entries are quantised to 2^bits cells a dimension, once a
round; a query's lookup table holds the least and the greatest squared distance to each cell, the sums over dimensions bound the
distance to every entry from below and above, and only entries whose lower bound does not exceed the least upper bound are refined
with the distance itself.

What moves: the codebooks (parts x entries rows, a bound by parameter) to the tasks, their sums and counts back, map-side combined
first; never a vector. Rounds read the table again, so a lost executor costs its own tasks.

Defined results: a vector that is null or holds a null or non-finite component is dropped, and so is one whose length is not that of
the least kept vec_id; lengths that the parts do not divide give parts that differ by one. Null vec_ids come last. Rows that repeat a
vec_id are coded each, and start codebooks in order of their components. With fewer vectors than entries the codebook is as small; no
vectors give an empty result. Components of any finite size are exact: beyond 2^20 the work goes on in Python integers, and errors
stop at the largest long. All other columns of the input pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

#: Integers below this in size are worked on in 64 bits: squared distances and their sums stay below 2^53.
SMALL = 1 << 20
LARGEST = (1 << 63) - 1
#: Digits of sums of larger integers, each summed by itself.
LIMB, LIMBS = 40, 5
#: Vectors that a task works on at a time.
ROWS = 1024


def kept_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.filter(F.col(column).isNotNull() & F.coalesce(F.forall(column, finite), F.lit(False)))


def cuts(length: int, parts: int) -> list[int]:
    """Where parts begin, and the end."""
    return [i * length // parts for i in range(parts + 1)]


class CellFile:
    """Entries of one codebook, approximated by cells."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries, cells = entries, 1 << bits
        low, high = entries.min(0), entries.max(0)
        width = (high - low) // cells + 1
        cell = ((entries - low) // width).astype(np.int64)
        self.floor = low[:, None] + width[:, None] * np.arange(cells)
        self.ceiling = self.floor + width[:, None] - 1
        # Which cell an entry is in, as a 0/1 matrix (dimension and cell by entry): summing a table over it is one product.
        n, d = entries.shape
        self.member = np.zeros((d * cells, n), np.float64 if entries.dtype == np.int64 else object)
        self.member[(np.arange(d) * cells + cell).ravel(), np.repeat(np.arange(n), d)] = 1

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Entries that may be nearest, as a matrix query by entry."""
        q = queries[:, :, None]
        below, above = self.floor - q, q - self.ceiling
        near = np.maximum(np.maximum(below, above), 0) ** 2
        far = np.maximum(np.abs(below), np.abs(above)) ** 2
        table = lambda t: t.reshape(len(queries), -1).astype(self.member.dtype) @ self.member
        return table(near) <= table(far).min(1)[:, None]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query, the lowest index at ties, and its squared distance."""
        if not self.entries.shape[1]:
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), self.entries.dtype)
        q, e = np.nonzero(self.candidates(queries))
        gap = queries[q] - self.entries[e]
        distance = (gap * gap).sum(1)
        order = np.lexsort((e, distance.astype(object), q)) if distance.dtype == object else np.lexsort((e, distance, q))
        first = order[np.unique(q[order], return_index=True)[1]]
        return e[first], distance[first]


def _blocks(batch: pa.RecordBatch, column: int, length: int, scale: int, small: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers) of runs of rows."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.column(column).slice(at, ROWS)
        x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), length)
        if small:
            yield at, np.floor(x * scale).astype(np.int64)
        else:
            yield at, np.array([[int(v * scale // 1) if abs(v) < 1e290 else int(v) * scale for v in row] for row in x.tolist()], object).reshape(len(part), length)


def _digits(value: int, small: bool) -> list[int]:
    if small:
        return [value]
    return [(value >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [value >> (LIMB * (LIMBS - 1))]


def _sums(kept: DataFrame, books: list[np.ndarray], length: int, scale: int, bits: int, small: bool) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sum of the vectors' parts at each used entry: (part, entry) to (count, sums)."""
    at, widest = cuts(length, len(books)), max((b.shape[1] for b in books), default=0)
    limbs = 1 if small else LIMBS
    names = [f"s{i}" for i in range(widest * limbs)]
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b, bits) for b in sent.value]
        counts = [np.zeros(len(b), np.int64) for b in sent.value]
        sums = [np.zeros(b.shape, b.dtype) for b in sent.value]
        for batch in batches:
            for _, x in _blocks(batch, 0, length, scale, small):
                for p, file in enumerate(files):
                    mine = x[:, at[p] : at[p + 1]]
                    chosen, _ = file.nearest(mine)
                    np.add.at(counts[p], chosen, 1)
                    np.add.at(sums[p], chosen, mine)
        rows = []
        for p, count in enumerate(counts):
            for e in np.flatnonzero(count).tolist():
                digits = [d for v in sums[p][e].tolist() for d in _digits(v, small)]
                rows.append([p, e, int(count[e]), *digits, *[0] * (len(names) - len(digits))])
        if rows:
            types = [pa.int32(), pa.int32(), *[pa.int64()] * (1 + len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "entry", "n", *names])

    found = kept.select("embedding").mapInArrow(run, ", ".join(["part int", "entry int", *(f"{c} bigint" for c in ["n", *names])]))
    rows = found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *names])).collect()  # parts x entries at most
    out = {}
    for r in rows:
        digits, width = list(r)[3:], books[r[0]].shape[1]
        out[r[0], r[1]] = r[2], [sum(digits[i * limbs + j] << (LIMB * j) for j in range(limbs)) for i in range(width)]
    sent.unpersist()
    return out


def fit_codebooks(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, bits: int = 4) -> tuple[list[np.ndarray], int, bool]:
    """Codebooks of each part, the vectors' length, and whether 64 bits hold the integers. `kept`: vec_id, embedding."""
    first = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    length = len(first[0]["embedding"]) if first else 0
    fit = kept.filter(F.size("embedding") == length)
    widest = fit.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
    small = widest * scale < SMALL
    same = fit.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
    chosen = [r["embedding"] for r in (first if all(len(r["embedding"]) == length for r in first) else same.collect())]
    start = pa.RecordBatch.from_arrays([pa.array(chosen, pa.list_(pa.float64()))], ["embedding"])
    whole = np.concatenate([x for _, x in _blocks(start, 0, length, scale, small)]) if chosen else np.zeros((0, length), np.int64)
    at = cuts(length, parts)
    books = [whole[:, at[p] : at[p + 1]].copy() for p in range(parts)]
    for _ in range(rounds if chosen else 0):
        for (p, e), (n, total) in _sums(fit, books, length, scale, bits, small).items():
            books[p][e] = [v // n for v in total]
    return books, length, small


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, bits: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code: entry of each part, error), and the codebooks. `vectors`: vec_id, embedding, label."""
    kept = kept_vectors(vectors).select("vec_id", "embedding", "label")
    books, length, small = fit_codebooks(kept, parts, entries, rounds, scale, bits)
    at, kinds = cuts(length, parts), dict(kept.dtypes)
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b, bits) for b in sent.value]
        for batch in batches:
            for first, x in _blocks(batch, 2, length, scale, small):
                found = [file.nearest(x[:, at[p] : at[p + 1]]) for p, file in enumerate(files)]
                error = sum(d for _, d in found)
                codes = np.stack([c for c, _ in found], 1).astype(np.int32)
                columns = [batch.column(i).slice(first, len(x)) for i in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array([min(int(v), LARGEST) for v in error], pa.int64())], ["vec_id", "label", "code", "error"])

    fit = kept.filter(F.size("embedding") == length).select("vec_id", "label", "embedding")
    coded = fit.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error bigint")
    return (coded if books and len(books[0]) else coded.limit(0)), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add `label_error`, the error summed over equal labels, nulls together."""
    coded = materialize(coded, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("bigint")
    totals = materialize(coded.groupBy(F.col("label").alias("total_label")).agg(total.alias("label_error")), "totals")  # by itself, so that a hot label's rows can be split
    return coded.join(totals, F.col("label").eqNullSafe(F.col("total_label"))).drop("total_label")
