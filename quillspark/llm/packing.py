"""Operator 1: best-fit packing by bin completion.

`pack_lengths` packs the pieces of one group: best-fit decreasing gives the first incumbent; if it is above the bound, a
depth-first search completes one bin at a time around the largest piece left, tries only undominated fillings (fullest
first), and prunes a branch once its waste, or the bound of what is left, can no longer beat the incumbent. On its way
down it also completes what is left by best fit, which gives further incumbents. Without a budget of nodes every
undominated filling is enumerated and the result is optimal; with one, FILLINGS of them are tried at each node.
`pack_group` gives large groups a budget for every WINDOW pieces.

`pack` spreads any number of pieces over groups of bounded size, packs each, and packs what lies in poorly filled
sequences again over as many groups as these pieces need; it ends when they no longer get fewer, so no group outgrows
its bound however badly the pieces fit.

Defined results: null or empty texts hold the end id alone; rows that repeat a doc_id are packed each on its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import doc_slices, materialize, trim

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; sizes in descending order."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # distinct room, ascending
    by_room: dict[int, list[int]] = {}
    for size in sizes:
        at = bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([size])
            b, room = len(bins) - 1, capacity - size
        else:
            old = rooms[at]
            b = by_room[old].pop()
            if not by_room[old]:
                del by_room[old], rooms[at]
            bins[b].append(size)
            room = old - size
        if room:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)
    return bins


class _Rest:
    """The pieces not yet placed, as counts of distinct sizes; takes and puts back in place."""

    def __init__(self, sizes: list[int]):
        self.sizes = sorted(set(sizes))
        self.counts = {s: 0 for s in self.sizes}
        for s in sizes:
            self.counts[s] += 1
        self.total, self.left = sum(sizes), len(sizes)

    def move(self, pieces: list[int], by: int) -> None:
        for s in pieces:
            self.counts[s] += by
            self.total += by * s
        self.left += by * len(pieces)

    def below(self, limit: int, at: int | None = None) -> Iterator[int]:
        """Distinct sizes still there, of at most `limit`, largest first."""
        i = bisect_right(self.sizes, limit, 0, at) - 1
        while i >= 0:
            if self.counts[self.sizes[i]]:
                yield self.sizes[i]
            i -= 1

    def largest(self) -> int:
        return next(self.below(self.sizes[-1]))


#: Budget of one search where one is wanted: nodes beyond one descent; fillings kept and pieces tried at each.
NODES, FILLINGS, TRIES = 500, 24, 200


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for each least size, the larger pieces' own bins and the volume that does not fit in them."""
    sizes = np.sort(np.asarray(sizes, np.int64))
    if not len(sizes):
        return 0
    whole = np.r_[0, np.cumsum(sizes)]
    half = np.searchsorted(sizes, capacity // 2, "right")
    least = np.r_[0, np.unique(sizes[:half])]
    low, high = np.searchsorted(sizes, least), np.searchsorted(sizes, capacity - least, "right")
    high = np.maximum(high, half)
    alone, middle = len(sizes) - high, high - half
    over = (whole[half] - whole[low]) - (middle * capacity - (whole[high] - whole[half]))
    return int((alone + middle + np.maximum(0, -(-over // capacity))).max())


def _fillings(rest: _Rest, room: int, most: int | None, tries: int | None) -> list[list[int]]:
    """Undominated ways to fill `room`, fullest first.

    A filling is dominated if a piece outside it fits besides, or could take the place of a smaller piece inside, or of
    two pieces inside. `most` and `tries` bound the fillings kept and the pieces tried; the first is always kept."""
    found: list[tuple[int, list[int]]] = []
    tried = 0

    def grow(limit: int, left: int, chosen: list[int]) -> bool:
        nonlocal tried
        extended = False
        for s in list(rest.below(min(limit, left))) if most is None else list(islice(rest.below(min(limit, left)), most)):
            tried += 1
            if found and (tries is not None and tried > tries or most is not None and len(found) >= most):
                return True
            extended = True
            rest.move([s], -1)
            full = grow(s, left - s, [*chosen, s])
            rest.move([s], 1)
            if full:
                return True
        if not extended:
            found.append((left, chosen))
            return left == 0  # nothing is fuller
        return False

    grow(room, room, [])
    kept = []
    for left, chosen in sorted(found, key=lambda x: (x[0], len(x[1]))):
        rest.move(chosen, -1)
        swaps = {*chosen, *(a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :])} if left else ()
        better = next(rest.below(left), None) is not None or any(next(rest.below(s + left), 0) > s for s in swaps)
        rest.move(chosen, 1)
        if not better:
            kept.append(chosen)
    return kept or [min(found)[1]]


def pack_lengths(lengths: list[int], capacity: int, nodes: int | None = None) -> list[list[int]]:
    """Sequences as lists of positions in `lengths`. `nodes`: completions of sequences tried, beyond one descent, before
    the search ends with its incumbent; None searches until that is known to be the best."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sizes = [lengths[i] for i in order]
    if sizes and (sizes[0] > capacity or sizes[-1] <= 0):
        raise ValueError("a piece must have between 1 and `capacity` ids")
    best = _best_fit(sizes, capacity)
    bound = lower_bound(np.array(sizes, np.int64), capacity)
    budget, limits = (None, (None, None)) if nodes is None else (len(best) + nodes, (FILLINGS, TRIES))
    rest = _Rest(sizes)
    whole = rest.total
    done: list[list[int]] = []
    # A frame: fillings still to try for the sequence around the largest piece left, and the waste before it.
    frames: list[tuple[int, list[list[int]], int]] = []
    waste, tried = 0, len(sizes)
    opening = len(best) > bound
    while opening or frames:
        if len(best) <= bound or budget is not None and budget <= 0:
            break
        if opening and rest.left:
            if budget is not None:
                budget -= 1
            if rest.left <= tried - max(1, tried // 16) or rest.left > tried + tried // 16:  # a sixteenth on: complete by best fit
                tried = rest.left
                left = _best_fit([s for s in rest.below(capacity) for _ in range(rest.counts[s])], capacity)
                if len(done) + len(left) < len(best):
                    best = [list(b) for b in done] + left
                    continue
            big = rest.largest()
            rest.move([big], -1)
            frames.append((big, _fillings(rest, capacity - big, *limits)[::-1], waste))
        elif opening and len(done) < len(best):
            best = [list(b) for b in done]
        big, options, waste = frames[-1]
        if len(done) == len(frames):  # take back what was tried last
            rest.move(done.pop()[1:], 1)
        opening = False
        while options:
            filling = options.pop()
            more = waste + capacity - big - sum(filling)
            # A better packing wastes no more than this, and needs room for what is left.
            if more <= (len(best) - 1) * capacity - whole and len(frames) + -(-(rest.total - sum(filling)) // capacity) < len(best):
                rest.move(filling, -1)
                done.append([big, *filling])
                waste, opening = more, True
                break
        if not opening:
            rest.move([big], 1)
            frames.pop()
    return [[order[j] for j in b] for b in _positions(best, sizes)]


#: Pieces that one search with a budget looks at together.
WINDOW = 100


def pack_group(lengths: list[int], capacity: int, nodes: int | None = NODES, window: int = WINDOW) -> list[list[int]]:
    """As pack_lengths, for a group of any size: a budget of nodes for each `window` pieces; without one, one exact search.

    If best fit is above the bound, the pieces are dealt by size over windows, each of which is searched. Sequences that came out less full
    than the average are dealt and searched again, as long as they get fewer."""
    if nodes is None or len(lengths) <= window:
        return pack_lengths(lengths, capacity, nodes)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best = [[order[j] for j in b] for b in _positions(_best_fit([lengths[i] for i in order], capacity), [lengths[i] for i in order])]
    bound = lower_bound(np.array(lengths, np.int64), capacity)
    if len(best) <= bound:
        return best
    kept: list[list[int]] = []
    loose, turn = order, 0
    found: list[list[int]] | None = None
    while loose:
        n = -(-len(loose) // window)
        packed = []
        for w in range(n):
            mine = loose[(w + turn) % n :: n]
            packed += [[mine[j] for j in b] for b in pack_lengths([lengths[i] for i in mine], capacity, nodes)]
        if found is not None and len(packed) >= len(found):
            kept += found
            break
        if n == 1 or len(kept) + len(packed) <= bound:
            kept += packed
            break
        rooms = [capacity - sum(lengths[i] for i in b) for b in packed]
        mean = sum(rooms) / len(rooms)
        kept += [b for b, room in zip(packed, rooms, strict=True) if room <= mean]
        found = [b for b, room in zip(packed, rooms, strict=True) if room > mean]
        loose = sorted((i for b in found for i in b), key=lambda i: (-lengths[i], i))
        turn += 1
    return kept if len(kept) < len(best) else best


def _positions(bins: list[list[int]], sizes: list[int]) -> list[list[int]]:
    """Bins of sizes as bins of positions in `sizes`."""
    by_size: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        by_size.setdefault(sizes[i], []).append(i)
    return [[by_size[s].pop() for s in b] for b in bins]


#: Chunks of text that a worker keeps the ids of, from one task to the next (about 200 MB).
REMEMBER = 1_000_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Each whole text as token ids and the end id; only documents over `capacity` ids are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.encoding import encoder

        encode = encoder(tokenizer, REMEMBER).encode
        for ids, texts in doc_slices(batches):
            flat, at = encode(texts)
            rows: list[tuple] = []
            for i, doc_id in enumerate(ids):
                whole = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for k in range(0, len(whole), capacity):
                    part = whole[k : k + capacity]
                    rows.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int, group_rows: int = 25_000, nodes: int | None = NODES) -> DataFrame:
    """Add sequence_id and offset to rows that have `length`. One task packs about `group_rows` pieces at a time.

    `nodes`: the budget of each search (see pack_group); None gives each group its best packing, however long that takes."""
    fields = [f for f in pieces.schema.fields if f.name not in ("group", "sequence_id", "offset", "room")]
    kept = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["group bigint", "sequence_id bigint", "offset bigint", "room bigint"])

    def level(step: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values([c for c in ("doc_id", "piece") if c in rows.columns] or ["length"], kind="stable").reset_index(drop=True)
            sequence, offset, room = (np.zeros(len(rows), np.int64) for _ in range(3))
            lengths = rows["length"].astype("int64").tolist()
            base = (step << 56) | (int(rows["group"].iloc[0]) << 28)
            for number, members in enumerate(pack_group(lengths, capacity, nodes)):
                at = 0
                for i in members:
                    sequence[i], offset[i] = base | number, at
                    at += lengths[i]
                room[members] = capacity - at
            return rows.assign(sequence_id=sequence, offset=offset, room=room)[[*kept, "group", "sequence_id", "offset", "room"]]

        return run

    rest, done, step, groups = pieces.select(*kept), None, 0, max(1, -(-pieces.count() // group_rows))
    while True:
        spread = F.pmod(F.xxhash64(F.lit(step), *(F.col(c) for c in kept)), F.lit(groups)).cast("bigint")
        packed = rest.withColumn("group", spread).repartition(groups, "group").groupBy("group").applyInPandas(level(step), schema)
        if groups > 1:
            packed = materialize(packed, "packed")
        loose = F.col("room") * 8 > capacity
        fewer = max(1, -(-packed.filter(loose).count() // group_rows)) if groups > 1 else groups
        if fewer == groups:  # one group, or pieces that do not fit together better than this
            return (packed if done is None else done.unionByName(packed)).select(*kept, "sequence_id", "offset")
        full = packed.filter(~loose)
        done = full if done is None else done.unionByName(full)
        rest, groups, step = packed.filter(loose).select(*kept), fewer, step + 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, nodes: int | None = NODES) -> DataFrame:
    """Token pieces of doc_id, text with their sequence and place. The pieces (no texts, no ids) are kept in the shared folder."""
    return pack(materialize(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, nodes=nodes)
