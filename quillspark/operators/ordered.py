"""Rows of a key in order, for keys of any size.

A key with more than MOST_ROWS rows is dealt over parts, runs of its order that one sort by ranges makes; all others stay whole. What an
earlier part knows of a later one is a few numbers: how many rows stand before it, a running sum or maximum, the state in which a greedy
rule leaves it. So windows run within (key, part), and only those numbers meet over all parts of a key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ranges import ranges
from quillspark.session import materialize

#: Rows of a key that one task takes; keys with more are dealt over parts of about this size.
MOST_ROWS = 1_000_000
WHOLE = -1


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"_hot_{k}"]) for k in keys))


def numbered(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None, total: str | None = None) -> DataFrame:
    """Add `place` (int, from 0 in `order` within a key) and `part` (WHOLE for keys that are not split), and a key's rows as `total`.

    Ties should be told apart by `order`. `rows` are gone through twice: first to count keys."""
    most = most or MOST_ROWS
    counts = rows.groupBy(*(F.col(k).alias(f"_hot_{k}") for k in keys)).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = materialize(counts, "hot")  # no more rows than the table has times `most`
    n_hot = hot.agg(F.sum("n")).first()[0]
    added = {"place": (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"), "part": F.lit(WHOLE)}
    if total:
        added[total] = F.count("*").over(Window.partitionBy(*keys))
    if not n_hot:
        return rows.withColumns(added)
    cool = rows.join(hot, _same(rows, hot, keys), "left_anti").withColumns(added)
    spread = rows.join(hot, _same(rows, hot, keys), "left_semi").repartitionByRange(-(-n_hot // most) + 1, *keys, *order).sortWithinPartitions(*keys, *order)
    spread = materialize(spread.withColumns({"part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "spread")
    spans = spread.groupBy(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.col("part").alias("_hot_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*(f"_hot_{k}" for k in keys)).orderBy("_hot_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = materialize(spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "spans")
    found = spread.join(spans, _same(spread, spans, keys) & (spread["part"] == spans["_hot_part"]))
    found = found.withColumn("place", (F.col("_row") - F.col("_first") + F.col("_before")).cast("int"))
    if total:
        sizes = hot.select(*(F.col(f"_hot_{k}").alias(f"_sized_{k}") for k in keys), F.col("n").alias(total))
        found = found.join(sizes, reduce(lambda a, b: a & b, (F.col(f"_hot_{k}").eqNullSafe(F.col(f"_sized_{k}")) for k in keys)))
    return cool.unionByName(found.select(*cool.columns))


def running(rows: DataFrame, keys: list[str], name: str, value: Column, how: str, current: bool = True) -> DataFrame:
    """Add the running sum or max (`how`) of `value` over a key's rows up to here, this one included or not. `rows` come from `numbered`."""
    fold = {"sum": F.sum, "max": F.max}[how]
    w = Window.partitionBy(*keys, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    local = rows.withColumn(name, fold(value).over(w))
    if rows.filter(F.col("part") != WHOLE).isEmpty():
        return local
    names = [f"_hot_{k}" for k in keys]
    parts = rows.filter(F.col("part") != WHOLE).groupBy(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.col("part").alias("_hot_part")).agg(fold(value).alias("_own"))
    earlier = Window.partitionBy(*names).orderBy("_hot_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(parts.withColumn("_carried", fold("_own").over(earlier)).drop("_own"), "carried")  # a row a part
    joined = local.join(carried, _same(local, carried, keys) & (local["part"] == carried["_hot_part"]), "left")
    both = F.greatest(name, "_carried") if how == "max" else F.when(F.col(name).isNull() & F.col("_carried").isNull(), None).otherwise(F.coalesce(name, F.lit(0)) + F.coalesce("_carried", F.lit(0)))
    return joined.withColumn(name, both).drop(*names, "_hot_part", "_carried")


class Rule:
    """A greedy rule over one key's rows in order, which can stop anywhere and go on from its state.

    `part(columns, base, state, last)` gives the ranges that end among these rows and the state after them: a list of numbers and texts. The
    rows' places begin at `base`; `state` is None at the start of a key, or for a guess; `last` says that the key ends here."""

    def __init__(self, part: Callable[[list[list], int, list | None, bool], tuple[list[tuple[int, int]], list]]):
        self.part = part

    def __call__(self, columns: list[list]) -> list[tuple[int, int]]:
        return self.part(columns, 0, None, True)[0]


def cut_ranges(rows: DataFrame, keys: list[str], inputs: list[str], rule: Rule) -> DataFrame:
    """keys, range_no, first, last of each range that `rule` cuts. `rows` come from `numbered`.

    Parts of a split key all start at once from no state; then those whose state before them turns out otherwise go again, until none is
    left. A rule that falls into step after a few cuts takes two passes over the numbers of split keys; none gives other cuts than one pass
    in order. The driver holds a state a part."""
    found = ranges(rows.filter(F.col("part") == WHOLE), keys, ["place"], inputs, rule)
    split = rows.filter(F.col("part") != WHOLE).select(*keys, "part", "place", *inputs)
    names = [f"_hot_{k}" for k in keys]
    parts = split.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("part").alias("_hot_part")).agg(F.count("*").alias("n")).orderBy("_hot_part").collect()
    if not parts:
        return found
    split = materialize(split, "split")
    kinds = ", ".join([*(f"`{n}` {split.schema[k].dataType.simpleString()}" for k, n in zip(keys, names, strict=True)), "_hot_part int, _entry string, _last boolean, _before int"])
    of_key: dict[tuple, list[int]] = {}
    for r in parts:
        of_key.setdefault(tuple(r)[:-2], []).append(r["_hot_part"])

    def go(wanted: list[tuple], emit: bool) -> DataFrame:
        """The rule over some parts, (key, part, state before, last, ranges before): their ranges, or their states after and counts."""
        sent = split.sparkSession.createDataFrame([(*k, p, e, last, n) for k, p, e, last, n in wanted], kinds)
        picked = split.join(F.broadcast(sent), _same(split, sent, keys) & (split["part"] == sent["_hot_part"]))  # a row a part
        picked = picked.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "place").select(*keys, "part", "place", "_entry", "_last", "_before", *inputs)
        return picked.mapInArrow(_runner(len(keys), len(inputs), rule, emit), ", ".join([*(f"`{k}` {split.schema[k].dataType.simpleString()}" for k in keys), "part int, range_no int, first int, last int, state string"]))

    entry: dict[tuple, str | None] = {(k, p): None for k, ps in of_key.items() for p in ps}
    after: dict[tuple, tuple[str, int]] = {}
    again = [(k, p) for k, ps in of_key.items() for p in ps[:-1]]
    while again:
        for r in go([(k, p, entry[k, p], False, 0) for k, p in again], emit=False).collect():
            after[tuple(r)[: len(keys)], r["part"]] = r["state"], r["range_no"]
        again = []
        for k, ps in of_key.items():
            for p, following in zip(ps, ps[1:]):
                if entry[k, following] != after[k, p][0]:
                    entry[k, following] = after[k, p][0]
                    if following != ps[-1]:
                        again.append((k, following))
    wanted = []
    for k, ps in of_key.items():
        before = 0
        for p in ps:
            wanted.append((k, p, entry[k, p], p == ps[-1], before))
            before += after.get((k, p), ("", 0))[1]
    return found.unionByName(go(wanted, emit=True).drop("part", "state"))


def _runner(n_keys: int, n_inputs: int, rule: Rule, emit: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, about, numbers, types, names = None, None, [], None, None

        def result() -> pa.RecordBatch:
            base, entry, last, before = about
            found, state = rule.part(numbers, base, None if entry is None else json.loads(entry), last)
            rows = [(before + i, a, b, None) for i, (a, b) in enumerate(found)] if emit else [(len(found), 0, 0, json.dumps(state))]
            columns = [pa.array([k] * len(rows), t) for k, t in zip(held, types, strict=True)]
            columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, [*names, "range_no", "first", "last", "state"])

        for batch in batches:
            types, names = [batch.schema.field(i).type for i in range(n_keys + 1)], batch.schema.names[: n_keys + 1]
            columns = [c.to_pylist() for c in batch.columns]
            keyed, start = list(zip(*columns[: n_keys + 1], strict=True)), 0
            for i, key in enumerate(keyed):
                if key != held:
                    if held is not None:
                        for own, new in zip(numbers, columns[n_keys + 5 :], strict=True):
                            own += new[start:i]
                        yield result()
                    held, numbers, start = key, [[] for _ in range(n_inputs)], i
                    about = tuple(columns[n_keys + j][i] for j in range(1, 5))
            for own, new in zip(numbers, columns[n_keys + 5 :], strict=True):
                own += new[start:]
        if held is not None:
            yield result()

    return run
