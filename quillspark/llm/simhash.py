r"""Operator 5: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits just when the balls of radius r around them meet. Every distinct
fingerprint stands for all 2081 variants within 2 bits; variants meet in buckets, a bucket being the value of k chosen
bits. A variant's bucket differs from its fingerprint's in the chosen bits that were flipped, so all variants of a
fingerprint lie in 1 + k + k(k - 1) / 2 buckets: the fingerprint is sent once to each, and the bucket rebuilds its
variants there. The shuffle carries fingerprints, not variants. In a bucket, equal variants are found by sorting,
colliding pairs are verified, and a spanning forest of the links leaves the bucket, never all pairs of a group. Texts
with equal fingerprints are merged before; components join the rest.

The number of buckets follows the number of distinct fingerprints. Buckets are counted before they are gathered: one that
is over its bound is dealt by further bits, on which even fingerprints within a few bits of one another part (of 2^f finer
buckets each reaches 1 + f + f(f - 1) / 2). A bucket works through its variants in slices of bounded size.

Defined results: null or empty texts have fingerprint zero, like any other; a null doc_id gets a fingerprint, and never
names a component unless it has no other member (then component_id is null); repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import doc_slices, materialize, text_version, trim
from quillspark.llm.components import components

SEED = 42


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of each run of `width` words, A-Z lowered; words are runs of bytes outside [\\x20\\x09-\\x0D]."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # both work on ASCII alone, for bytes
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -width] + 1]).tolist()
    return list(map(xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends[width - 1 :].tolist())), repeat(SEED)))


def simhashes(texts: list[str], width: int) -> np.ndarray:
    """Fingerprints: a bit is 1 if it is set in over half of a text's shingle hashes."""
    hashes = [shingle_hashes(t, width) for t in texts]
    sizes = np.fromiter(map(len, hashes), np.int64, len(texts))
    flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(sizes.sum()))
    counts = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    step = 1 << 17
    for at in range(0, len(flat), step):
        bits = np.unpackbits(flat[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + step]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return ((2 * counts > sizes[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, version (hash of the text) and fp (the fingerprint's 64 bits as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in doc_slices(batches, 1_500_000):
            ids, versions = ([k[name] for k in keys] for name in ("doc_id", "version"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(simhashes(texts, width).view(np.int64))], ["doc_id", "version", "fp"])
        trim()

    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), text_version(text).alias("version"))
    return docs.select(key, text).mapInArrow(run, "doc_id bigint, version bigint, fp bigint")


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks of at most `radius` bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)


def projected(x: np.ndarray, positions: list[int]) -> np.ndarray:
    """The bits of x at `positions`, as a number."""
    out = np.zeros(x.shape, np.int64)
    for j, p in enumerate(positions):
        out |= ((x >> np.uint64(p)) & np.uint64(1)).astype(np.int64) << j
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def bucket_links(fps: np.ndarray, bucket: int, bits: int, positions: list[int], radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least linked fingerprint) that meet in one bucket; `most` variants are held at a time.

    The bucket is a value of the first `bits` of `positions`; more of them cut it into slices."""
    fps = np.unique(fps)
    if len(fps) < 2:
        return fps[:0], fps[:0]
    masks = ball(radius)
    finer = 0
    while (len(fps) * len(masks)) >> finer > most and finer < 20 and bits + finer < len(positions):
        finer += 1
    of_mask, of_fp = (projected(x, positions[: bits + finer]) for x in (masks, fps))
    order = np.argsort(of_mask, kind="stable")
    classes, first = np.unique(of_mask[order], return_index=True)
    groups = dict(zip(classes.tolist(), np.split(order, first[1:]), strict=True))
    by_hash = np.argsort(of_fp, kind="stable")
    values, at = np.unique(of_fp[by_hash], return_index=True)
    members = list(zip(values.tolist(), np.split(by_hash, at[1:]), strict=True))
    label = np.arange(len(fps))
    for part in range(1 << finer):
        target = bucket | part << bits
        variants, owners = [], []
        for value, rows in members:
            if (found := groups.get(value ^ target)) is not None:
                variants.append((fps[rows][:, None] ^ masks[found][None, :]).ravel())
                owners.append(np.repeat(rows, len(found)))
        if not variants:
            continue
        v, o = np.concatenate(variants), np.concatenate(owners)
        by = np.argsort(v)
        v, o = v[by], o[by]
        same = v[1:] == v[:-1]
        head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(v)), 0))[1:][same]
        a, b = o[head], o[1:][same]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius
        label = forest(len(fps), np.concatenate([a[near], np.arange(len(fps))]), np.concatenate([b[near], label]))
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


def near_links(distinct: DataFrame, count: int, distance: int = 4, bucket_rows: int = 250_000, most: int = 8_000_000) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of `fp` within `distance` bits. `count`: rows of `distinct`.

    The number of buckets is the least power of two that gives about `bucket_rows` fingerprints each. Bits that are set
    in nearest to half of all fingerprints come first, so that buckets are even."""
    radius = -(-distance // 2)
    if distance % 2:
        raise ValueError("the distance must be even")
    masks = ball(radius)
    ones = distinct.agg(*(F.sum(F.shiftright("fp", j).bitwiseAND(F.lit(1))) for j in range(64))).first()
    positions = sorted(range(64), key=lambda j: (abs(2 * (ones[j] or 0) - count), j))
    bits = 6
    while bits < 40 and count * len(np.unique(projected(masks, positions[:bits]))) > bucket_rows << bits:
        bits += 1
    reach = np.unique(projected(masks, positions[:bits]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                buckets = (projected(part.view(np.uint64), positions[:bits])[:, None] ^ reach[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.repeat(part, len(reach)))], ["bucket", "fp"])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deal rows of large buckets again: to the values of `finer` more bits that their variants in the bucket have."""
        coarse = projected(masks, positions[:bits])
        for batch in batches:
            bucket, fps, more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            flips = projected(fps.view(np.uint64), positions[:bits]) ^ bucket
            for f, flip in {*zip(more.tolist(), flips.tolist(), strict=True)}:
                mine = np.flatnonzero((more == f) & (flips == flip))
                further = positions[bits : bits + f]
                ways = np.unique(projected(masks[coarse == flip], further))
                part = (projected(fps[mine].view(np.uint64), further)[:, None] ^ ways[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket[mine], len(ways)) | part << bits), pa.array(np.repeat(fps[mine], len(ways))), pa.array(np.full(len(part), f, np.int32))], ["bucket", "fp", "finer"])

    def meet(rows: pa.Table) -> pa.Table:
        bucket, more = rows.column("bucket")[0].as_py(), rows.column("finer")[0].as_py()
        fps = rows.column("fp").to_numpy().view(np.uint64)
        u, v = bucket_links(fps, bucket, bits + more, positions, radius, most)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    dealt = distinct.select("fp").mapInArrow(spread, "bucket bigint, fp bigint")
    over = F.ceil(F.log2(F.col("n") / F.lit(bucket_rows))).cast("int") + 6
    large = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * bucket_rows).select("bucket", F.least(over, F.lit(min(20, 60 - bits))).alias("finer")), "large")
    if large.isEmpty():
        dealt = dealt.withColumn("finer", F.lit(0))
    else:
        known = dealt.join(large, "bucket", "left").select("bucket", "fp", F.coalesce("finer", F.lit(0)).alias("finer"))
        dealt = known.filter("finer = 0").unionByName(known.filter("finer > 0").mapInArrow(finer, "bucket bigint, fp bigint, finer int"))
    return dealt.groupBy("bucket", "finer").applyInArrow(meet, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, version, fp, root (a fingerprint that names the component) and component_id (the smallest doc_id in it)."""
    found = materialize(fingerprints(docs, width), "simhash")
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = components(near_links(distinct, distinct.count(), distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("named_fp"), "root", "component_id")
    return found.join(named, found.fp == named.named_fp).select("doc_id", "version", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row with the smallest doc_id (then text hash) stays."""
    return first_of_each(docs, near_duplicates(docs, width, distance))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` that come first in their component. `found`: doc_id, version, root."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "version")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("kept_doc"), F.col("k.version").alias("kept_version"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc"), text_version(F.col("text").cast("string")).alias("version"))
    kept = rows.join(first, F.col("doc").eqNullSafe(F.col("kept_doc")) & (F.col("version") == F.col("kept_version")), "left_semi")
    return kept.dropDuplicates(["doc", "version"]).select("row.*")
