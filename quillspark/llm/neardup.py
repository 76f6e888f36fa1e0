r"""Near copies for the pipeline: texts whose sets of shingles have a Jaccard similarity of `similarity` or more.

Texts with equal sets are merged by the set's hash. Sets that share one of BANDS keys (each of ROWS minhashes) are
candidates: at similarity 0.8 all but 1 of 300,000 pairs are. Every link is verified on the whole sets. First each set is
held against the least one of its buckets, which joins most copies by a linear number of pairs. Buckets that still hold
several components are searched by prefixes of rare shingles, which lose no pair, in tasks of bounded size (a bucket over
BLOCK shingles is cut into blocks, and each pair of blocks is a task); of the links found there only those that join two
components leave the task.

Defined results: null or empty texts have the empty set, and are copies of one another; a null doc_id never names a
component unless it has no other member; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import doc_slices, materialize, text_version, trim
from quillspark.llm.components import components
from quillspark.llm.simhash import SEED, first_of_each, near_duplicates, shingle_hashes

BANDS, ROWS = 32, 5
#: Shingles of one block of a bucket.
BLOCK = 1_500_000


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def set_id(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for factor in factors[band * ROWS : (band + 1) * ROWS]:
            key = (key ^ np.minimum.reduceat(flat * factor, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in doc_slices(batches, 1_500_000):
            sets = [shingle_set(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["doc_id"] for r in rows], pa.int64()),
                    pa.array([r["version"] for r in rows], pa.int64()),
                    pa.array(list(map(set_id, sets)), pa.int64()),
                    pa.array(list(band_keys(sets)), pa.list_(pa.int64())),
                ],
                ["doc_id", "version", "sid", "keys"],
            )
        trim()

    text = F.col("text").cast("string")
    row = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), text_version(text).alias("version"))
    return docs.select(row, text).mapInArrow(run, "doc_id bigint, version bigint, sid bigint, keys array<bigint>")


def _shingles(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """sid and shingles of the texts of these rows (doc_id, version)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in doc_slices(batches, 1_500_000):
            sets = [shingle_set(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(set_id, sets)), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sid", "shingles"])
        trim()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), text_version(text).alias("of"), text.alias("text"))
    rows = rows.join(wanted, F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("version")), "left_semi")
    return materialize(rows.select("of", "text").mapInArrow(run, "sid bigint, shingles array<bigint>").dropDuplicates(["sid"]), "shingles")


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    one, other = (shingles.select(F.col("sid").alias(n), F.col("shingles").alias(f"s{n}")) for n in "uv")
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(one, "u").join(other, "v").filter(both >= F.lit(similarity) * (F.size("su") + F.size("sv") - both)).select("u", "v")


def linked(sids: np.ndarray, roots: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different roots, and of different blocks where there are two: enough to join all components that meet.

    Sets meet where one's rarest shingles (rare in this bucket) are among the other's: with shingles in any one order, a pair of the wanted
    similarity shares one within the first n - ceil(2s / (1 + s) * n) + 1 of the smaller set and the first n - ceil(s * n) + 1 of the larger.
    Texts of one template differ in their rarest shingles and do not meet. Sets of one root are passed over by places, not one by one."""
    codes = np.unique(shingles, return_inverse=True)[1].reshape(-1)
    counts = np.bincount(codes)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(sids)), sizes)
    ranks = rank[codes]
    ranks = ranks[np.lexsort((ranks, owner))]
    heads = np.cumsum(sizes) - sizes
    order = np.lexsort((sids, sizes))
    turn = np.empty(len(sids), np.int64)
    turn[order] = np.arange(len(sids))
    rest = lambda share: sizes - np.ceil(share * sizes - 1e-9).astype(np.int64) + 1
    listed, asked = rest(2 * similarity / (1 + similarity)), rest(similarity)
    inside = np.arange(len(ranks)) - heads[owner] < listed[owner]
    root = np.unique(roots, return_inverse=True)[1].reshape(-1).astype(np.int64)
    n_roots = int(root.max()) + 1
    key = ranks[inside] * n_roots + root[owner[inside]]
    by_key = np.argsort(key, kind="stable")
    key, who = key[by_key], owner[inside][by_key]
    across, label, said, out = blocks.min() != blocks.max(), roots.copy(), np.zeros(len(counts), bool), []
    for i in order:
        own = ranks[heads[i] : heads[i] + asked[i]] * n_roots
        ours = own + root[i]
        starts = np.concatenate([np.searchsorted(key, own), np.searchsorted(key, ours, "right")])
        n = np.concatenate([np.searchsorted(key, ours), np.searchsorted(key, own + n_roots)]) - starts
        if not n.any():
            continue
        near = np.unique(who[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        near = near[(turn[near] < turn[i]) & (sizes[near] >= similarity * sizes[i] - 1e-9) & (label[near] != label[i])]
        if across:
            near = near[blocks[near] != blocks[i]]
        if not len(near):
            continue
        mine = ranks[heads[i] : heads[i] + sizes[i]]
        said[mine] = True
        for j in near:
            if label[j] != label[i]:
                both = np.count_nonzero(said[ranks[heads[j] : heads[j] + sizes[j]]])
                if both >= similarity * (sizes[i] + sizes[j] - both):
                    out.append((int(sids[i]), int(sids[j])))
                    label[label == label[j]] = label[i]
        said[mine] = False
    return out


def _apart(rooted: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) within the buckets of `rooted` (key, sid, root) whose ends have different roots."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sids, roots, blocks = (rows.column(c).to_numpy() for c in ("sid", "root", "block"))
        lists = rows.column("shingles").combine_chunks()
        found = linked(sids, roots, blocks, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), similarity)
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    members = rooted.join(shingles, "sid").filter(F.size("shingles") > 0)
    parts = rooted.join(shingles.select("sid", F.size("shingles").alias("n")), "sid").groupBy("key").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("parts"))
    cut = members.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    met = cut.select("key", "sid", "root", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return met.groupBy("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).applyInArrow(run, "u bigint, v bigint").distinct()


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, version, sid (of the shingle set) and root (a set that names the component)."""
    found = materialize(_signed(docs, width), "minhash")
    texts = found.groupBy("sid").agg(F.min(F.struct("version", "doc_id")).alias("one"), F.first("keys").alias("keys"))
    keyed = texts.select("sid", "one", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("sid").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    keyed = materialize(keyed.join(shared, "key"), "bands")
    shingles = _shingles(docs, keyed.select("one.*").distinct(), width)
    stars = keyed.filter("sid != least").select(F.col("sid").alias("u"), F.col("least").alias("v")).distinct()
    edges = materialize(_verified(stars, shingles, similarity), "links")
    rooted = keyed.join(components(edges), F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    rooted = materialize(rooted.join(mixed, "key"), "apart")
    roots = components(edges.unionByName(_apart(rooted, shingles, similarity)))
    return found.join(roots, found.sid == roots.node, "left").select("doc_id", "version", "sid", F.coalesce("root", "sid").alias("root"))


def with_fingerprints(found: DataFrame, docs: DataFrame, width: int, distance: int) -> DataFrame:
    """`found` (from near_copies) with the components of SimHash joined in: a text is linked by either, and links of both make one component."""
    found = materialize(found.select("doc_id", "version", "root"), "near")
    alike = near_duplicates(docs, width, distance).select("version", F.col("root").alias("alike")).distinct()
    pairs = materialize(found.select("version", "root").distinct().join(alike, "version").select("root", "alike").distinct(), "alike")
    least = pairs.groupBy("alike").agg(F.min("root").alias("v"))
    roots = components(pairs.join(least, "alike").select(F.col("root").alias("u"), "v")).withColumnRenamed("root", "top")
    return found.join(roots, found.root == roots.node, "left").select("doc_id", "version", F.coalesce("top", "root").alias("root"))


def one_of_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, simhash_width: int = 4, distance: int | None = None) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row with the smallest doc_id (then text hash) stays.

    With `distance`, texts whose SimHash fingerprints (of `simhash_width` words) differ in at most so many bits are copies too."""
    found = near_copies(docs, width, similarity)
    return first_of_each(docs, found if distance is None else with_fingerprints(found, docs, simhash_width, distance))
