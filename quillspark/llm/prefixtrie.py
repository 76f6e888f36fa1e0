"""Operator 11: the trie of conversation prefixes, built level by level.

Turns are numbered within their conversation by one global sort, whose partitions may split a conversation; a turn is then known by a
SHA-256 of role and text, and only hashes and sizes move on. Conversations of one whole sequence of turns are folded into the least
conv_id of them, with a count. At each depth the live sequences are grouped by (parent node, next turn); a node takes the least
conv_id of its members. A sequence that is alone in its node leaves: below it there is one chain of nodes, which is written out from
its turns at once. So there are as many levels as the deepest turn that two different sequences share, however long conversations are.
Levels are then rolled up from the deepest to the root by joins of children to parents.

Groups are aggregated map-side; the sequences of a level meet their groups by an equi-join of two stored tables, whose hot turns
adaptive execution can split. Every level is a table in the shared folder. The ids of a sequence's conversations are joined to texts in
blocks of a few thousand, and one stream a sequence puts them through SHA-256, in order and in bounded memory.

Defined results: null roles and texts are empty; turns with equal numbers go by role and text; rows that repeat a turn count as often as
they stand; rows without conv_id are left out; without conversations the result is empty (no root without members); extra columns pass
by. A node is known by (conv_id, depth).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import leave, materialize, scratch_path

#: Conversations whose ids are joined to one text at a time.
ID_BLOCK = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key, bytes (of the text), through (bytes up to here): turns in order, for conversations of any length."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text(F.col("role")).alias("role"), text(F.col("text")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", key.alias("key"), F.octet_length("text").cast("bigint").alias("bytes"), F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places and running bytes of each conversation, as far as this partition holds it."""
        held, place, total = None, 0, 0
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.r_[ids[0] != held, ids[1:] != ids[:-1]])
            through = np.cumsum(sizes)
            base = np.zeros(len(ids), np.int64)  # first row of the conversation in this batch, and bytes before it
            base[starts] = starts
            base = np.maximum.accumulate(base)
            pos, through = np.arange(len(ids)) - base, through - np.where(base > 0, through[base - 1], 0)
            head = len(ids) if not len(starts) else starts[0]
            pos[:head] += place
            through[:head] += total
            held, place, total = ids[-1], int(pos[-1]) + 1, int(through[-1])
            columns = [batch.column(0), pa.array(pos), batch.column(1), batch.column(2), pa.array(through), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "pos", "key", "bytes", "through", "part"])

    placed = materialize(rows.mapInArrow(number, "conv_id bigint, pos bigint, key binary, bytes bigint, through bigint, part int"), "placed")
    # A conversation over several partitions is numbered anew in each: what stood in earlier ones is added. One row a partition at most.
    spans = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    split = materialize(spans.join(spans.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1"), "conv_id", "left_semi"), "split")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    split = split.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size"))
    found = placed.join(split, ["conv_id", "part"], "left")
    before = lambda c: F.coalesce(c, F.lit(0))
    return found.select("conv_id", (F.col("pos") + before(F.col("n"))).alias("pos"), "key", "bytes", (F.col("through") + before(F.col("size"))).alias("through"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are rebuilt: each takes its first h = crc32(conv_id) % most turns from conversation conv_id - conv_id % group.

    Turns: conv_id, depth (from 1), key, bytes, below (bytes from this turn on). And conversations: conv_id, len."""
    turns = materialize(turns, "turns")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    head = F.array_sort(F.collect_list(F.struct("pos", "key", "bytes")))
    heads = turns.filter(F.col("pos") < most - 1).groupBy("conv_id").agg(head.alias("head"))
    convs = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % most, "base": F.col("conv_id") - F.col("conv_id") % group})
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,key:binary,bytes:bigint>>")), 1, F.col("h").cast("int"))
    info = convs.select("conv_id", "n", "total", "h", taken.alias("taken")).withColumn("lent", F.size("taken").cast("bigint"))
    skipped = turns.filter(F.col("pos") < most - 1).join(info.select("conv_id", "h"), "conv_id").filter("pos < h").groupBy("conv_id").agg(F.sum("bytes").alias("skipped"))
    info = materialize(info.join(skipped, "conv_id", "left").withColumn("rest", F.col("total") - F.coalesce("skipped", F.lit(0))), "info")
    mine = turns.join(info.select("conv_id", "h", "lent", "total"), "conv_id").filter("pos >= h")
    mine = mine.select("conv_id", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("depth"), "key", "bytes", (F.col("total") - F.col("through") + F.col("bytes")).alias("below"))
    lent = info.select("conv_id", "taken", "rest", F.posexplode("taken").alias("i", "turn"))
    later = F.aggregate(F.slice("taken", F.col("i") + 1, F.size("taken")), F.col("rest"), lambda s, t: s + t["bytes"])
    lent = lent.select("conv_id", (F.col("i") + 1).cast("bigint").alias("depth"), "turn.key", "turn.bytes", later.alias("below"))
    lengths = info.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    return mine.unionByName(lent), lengths


def sequences(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, rep (the least conv_id of the same sequence of turns), len."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "key"))
    marks = turns.groupBy("conv_id").agg(mark(1).alias("a"), mark(2).alias("b"))
    marked = materialize(lengths.join(marks, "conv_id", "left").fillna(0, ["a", "b"]), "marked")
    reps = materialize(marked.groupBy("a", "b", "len").agg(F.min("conv_id").alias("rep")), "reps")  # by itself, so that a hot sequence's rows can be split
    return marked.join(reps, ["a", "b", "len"]).select("conv_id", "rep", "len")


def id_digests(members: DataFrame) -> DataFrame:
    """rep, ends_sha256: SHA-256 of the ascending, comma-joined decimal conv_ids of each rep."""
    block = F.floor(F.col("conv_id") / ID_BLOCK).alias("block")
    texts = members.groupBy("rep", block).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            done = []
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rep == held:
                    state.update(b",")
                else:
                    if state:
                        done.append((held, state.hexdigest()))
                    held, state = rep, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["rep", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([state.hexdigest()])], ["rep", "ends_sha256"])

    return texts.repartition("rep").sortWithinPartitions("rep", "block").select("rep", "ids").mapInArrow(digest, "rep bigint, ends_sha256 string")


def _append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth, key, bytes, below; lengths: conv_id, len of every conversation, those without turns too."""
    spark = turns.sparkSession
    turns = materialize(turns, "rebuilt")
    members = materialize(sequences(turns, lengths), "members")
    reps = materialize(members.groupBy(F.col("rep").alias("conv_id"), "len").agg(F.count("*").alias("weight")), "weights")
    steps = turns.join(reps, "conv_id").repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id")  # so that a level's files and pages can be picked
    steps = materialize(steps, "steps")

    # Down: `live` are sequences in nodes that several share. A node of one sequence already knows all that is below it.
    alone = F.col("n_seqs") == 1
    top = reps.agg(F.min("conv_id"), F.count("*"), F.sum("weight"), F.min("len")).first()
    whole = steps.filter("depth = 1").agg(F.min("below")).first()[0] or 0  # of the one sequence, if there is one
    kinds = "depth int, node bigint, parent bigint, n_seqs bigint, n_convs bigint, bytes bigint, len bigint, below bigint"
    nodes = spark.createDataFrame([(0, top[0], None, top[1], top[2], 0, top[3], whole)] if top[1] else [], kinds)
    live = reps.filter("len > 0").select("conv_id", F.lit(top[0]).cast("bigint").alias("parent"))
    lodged = scratch_path(spark, "lodged")  # sequences that end at a node of others' name
    _append(reps.filter(F.col("len") == 0).select("conv_id", F.lit(top[0]).cast("bigint").alias("node")), lodged)
    levels, depth = [], 0
    while True:
        levels.append(nodes)
        if nodes.filter(~alone).isEmpty():
            break
        depth += 1
        step = materialize(steps.filter(F.col("depth") == depth).drop("depth").join(live, "conv_id"), "step")
        nodes = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_seqs"), F.sum("weight").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("len").alias("len"), F.min("below").alias("below"))
        nodes = materialize(nodes.withColumn("depth", F.lit(depth)), "nodes")
        inside = step.join(nodes.filter(~alone).select("parent", "key", "node"), ["parent", "key"])
        _append(inside.filter(F.col("len") == depth).select("conv_id", "node"), lodged)
        live = inside.filter(F.col("len") > depth).select("conv_id", F.col("node").alias("parent"))
    leave(spark, lodged)

    # Up: what is below a node, its own turn included.
    rolled, below = scratch_path(spark, "rolled"), None
    for level in reversed(levels):
        if below is None:
            level = level.withColumns({c: F.lit(None).cast("bigint") for c in ("children", "leaves", "saved")})
        else:
            children = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            level = level.join(children, "node", "left")
        spare = F.col("n_convs") - 1
        goes_on = (F.col("len") > F.col("depth")).cast("bigint")
        below = materialize(level.select(
            "node", F.col("depth").cast("bigint").alias("depth"), "parent", "n_seqs", "n_convs", "len",
            F.when(alone, goes_on).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.when(alone, 1).otherwise(F.coalesce("leaves", F.lit(1))).alias("n_leaves"),
            F.when(alone, spare * F.col("below")).otherwise(spare * F.col("bytes") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        ), "level")
        _append(below, rolled)
    leave(spark, rolled)
    shared = spark.read.schema(below.schema).parquet(rolled)

    # Chains below the nodes of one sequence.
    lone = shared.filter(alone & (F.col("len") > F.col("depth"))).select(F.col("node").alias("conv_id"), F.col("depth").alias("top"))
    chains = steps.join(lone, "conv_id").filter("depth > top").select(
        F.col("conv_id").alias("node"), "depth", F.col("conv_id").alias("parent"), F.col("weight").alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), ((F.col("weight") - 1) * F.col("below")).alias("saved_tokens"),
    )
    nodes = shared.drop("n_seqs", "len").unionByName(chains)

    # A sequence ends at the node of its own name, or at the one where it is lodged.
    ends = id_digests(members.select("conv_id", "rep")).join(reps.withColumnRenamed("conv_id", "rep"), "rep")
    ends = ends.join(spark.read.schema("conv_id bigint, node bigint").parquet(lodged).withColumnRenamed("conv_id", "rep"), "rep", "left")
    ends = ends.select(F.coalesce("node", "rep").alias("node"), F.col("len").alias("depth"), "ends_sha256")
    nodes = nodes.join(ends, ["node", "depth"], "left")
    nothing = F.sha2(F.lit(""), 256)
    return nodes.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
