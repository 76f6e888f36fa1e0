"""Ordered greedy rules as ranges.

Some rules cut a sequence where the size of what was gathered since the last cut says so; no window function can. Here
a rule sees the numbers of one key in order and gives (first, last) places of its ranges. Only those numbers pass
through Python, in Arrow batches from sorted partitions; texts never do. A range is joined back by exploding its places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = Callable[[list[list]], Iterable[tuple[int, int]]]


def ranges(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], rule: Rule) -> DataFrame:
    """keys, range_no, first, last: places count from 0 in `order` within a key."""
    kinds = dict(rows.dtypes)
    fields = [f"`{k}` {kinds[k]}" for k in keys] + ["range_no int", "first int", "last int"]
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, held, numbers = None, None, [[] for _ in inputs]

        def result() -> pa.RecordBatch:
            found = list(rule(numbers))
            columns = [pa.array([k] * len(found), t) for k, t in zip(held, types, strict=True)]
            columns += [pa.array(list(range(len(found))), pa.int32()), *(pa.array([f[i] for f in found], pa.int32()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, [*keys, "range_no", "first", "last"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n_keys)]
            named = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            values = [batch.column(n_keys + i).to_pylist() for i in range(len(inputs))]
            start = 0
            for i, key in enumerate(named):
                if key != held:
                    if held is not None:
                        for own, new in zip(numbers, values, strict=True):
                            own += new[start:i]
                        yield result()
                    held, numbers, start = key, [[] for _ in inputs], i
            for own, new in zip(numbers, values, strict=True):
                own += new[start:]
        if held is not None:
            yield result()

    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.select(*keys, *inputs).mapInArrow(run, ", ".join(fields))


def members(found: DataFrame) -> DataFrame:
    """A row for each place of each range: the range's columns and `place`."""
    return found.select("*", F.explode(F.sequence("first", "last")).alias("place"))
