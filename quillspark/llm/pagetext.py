"""Operator 12: main texts of web pages by a minimum cut.

A page becomes blocks of text (`pageblocks`). What a page says of its own parts (article, nav, footer, names of classes) and a
classifier of a block's shape (element, words, links, end) give each block the cost of being called content or boilerplate; these are
capacities to the two terminals. Neighbouring blocks, and blocks and elements along the page's tree, are joined by edges that cost what
parting them costs. The minimum cut (`mincut`) keeps the blocks on the content's side.

The classifier (naive Bayes) is fitted here, on the blocks of marked elements in at most `fit_pages` pages, those of least hash of
(page_id, url) (rows that share both count as one); its counts are aggregated by Spark and are a few dozen rows. Every page is then
cut by itself, where it is read: no text is shuffled, and a lost executor costs its own tasks.

Defined results: a null or empty html has an empty text; markup may be cut off or wrong anywhere; pages of any length take linear time
in parsing, and what the flow needs for blocks that are not placed at once; repeated rows give the same text each; an empty table gives
an empty result. `keep` names the columns that are passed on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_slices, trim
from quillspark.llm.mincut import min_cut
from quillspark.llm.pageblocks import APART, ARTICLE, ASIDE, MAIN, PLAIN, Block, blocks

#: What a mark says for content, in log odds; and an unmarked block of a page that has an article or a main part.
MARKS = {ARTICLE: 9.0, MAIN: 3.0, PLAIN: 0.0, ASIDE: -6.0, APART: -14.0}
ELSEWHERE = -7.0
#: The classifier's say, at most; costs of parting neighbours, a block and its element, an element and the one around it.
SHAPE, NEXT, INSIDE, AROUND = 5.0, 0.6, 0.8, 0.4
#: Log odds become integers of this many to one.
UNIT = 1000
#: What the classifier starts from: (content, boilerplate) blocks that it is taken to have seen.
BEFORE = {
    ("links", 0): (20, 8), ("links", 1): (6, 4), ("links", 2): (2, 6), ("links", 3): (1, 20), ("words", 0): (2, 16), ("words", 1): (3, 10), ("words", 2): (5, 6), ("words", 3): (8, 4), ("words", 4): (20, 2),
    ("end", 0): (8, 24), ("end", 1): (24, 8), ("tag", "p"): (20, 4), ("tag", "h"): (6, 3), ("tag", "li"): (4, 14), ("tag", "cell"): (3, 5), ("tag", "other"): (6, 12), ("sign", 0): (30, 20), ("sign", 1): (1, 10),
}
_TAGS = {"p": "p", "li": "li", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "blockquote": "p", "pre": "p", **{f"h{i}": "h" for i in range(1, 7)}}
_ENDS = tuple(".?!…:;。！？\"'»”’)")
_SIGNS = frozenset("©|»›←→·•")


def shape(block: Block) -> tuple:
    """The classifier's features of a block."""
    words = next(i for i, most in enumerate((2, 5, 10, 20, math.inf)) if block.words <= most)
    links = 0 if block.linked < 0.02 else next(i for i, most in enumerate((1 / 3, 2 / 3, 1), 1) if block.linked <= most)
    edge = block.text[:1] + block.text[-1:]
    return ("tag", _TAGS.get(block.tag, "other")), ("words", words), ("links", links), ("end", int(block.text.endswith(_ENDS))), ("sign", int(not _SIGNS.isdisjoint(edge)))


def _weights(counts: dict[tuple, tuple[float, float]]) -> dict[tuple, float]:
    """Log odds of content for each feature's value."""
    seen = {f: (counts.get(f, (0, 0))[0] + a, counts.get(f, (0, 0))[1] + b) for f, (a, b) in BEFORE.items()}
    whole: dict[str, list[float]] = {}
    for (kind, _), (a, b) in seen.items():
        sums = whole.setdefault(kind, [0.0, 0.0])
        sums[0] += a
        sums[1] += b
    return {f: math.log(a / whole[f[0]][0]) - math.log(b / whole[f[0]][1]) for f, (a, b) in seen.items()}


def fit_shapes(pages: DataFrame, fit_pages: int = 2000) -> dict[tuple, float]:
    """Weights of the classifier from the blocks of marked elements of at most `fit_pages` pages (page_id, url, html)."""
    by = F.xxhash64("page_id", "url")
    last = pages.select(by.alias("mark")).distinct().orderBy("mark").limit(fit_pages).agg(F.max("mark")).first()[0]
    if last is None:
        return _weights({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for block in blocks(page or "")[0]:
                    if block.mark in (ARTICLE, ASIDE, APART):
                        seen.update((*f, block.mark == ARTICLE) for f in shape(block))
        rows = [(kind, str(value), content, n) for (kind, value, content), n in seen.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], ["kind", "value", "content", "n"])

    one_each = pages.filter(by <= last).groupBy("page_id", "url").agg(F.first("html").alias("html")).select("html")
    found = one_each.mapInArrow(count, "kind string, value string, content boolean, n bigint").groupBy("kind", "value").agg(F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("content"), 0).otherwise(F.col("n"))).alias("b"))
    named = {(kind, str(value)): (kind, value) for kind, value in BEFORE}
    return _weights({named[r["kind"], r["value"]]: (r["a"], r["b"]) for r in found.collect()})


def main_blocks(page: str, weights: dict[tuple, float]) -> list[str]:
    """Texts of the blocks on the content's side of the page's minimum cut, in order."""
    found, parents = blocks(page)
    if not found:
        return []
    led = any(b.mark in (ARTICLE, MAIN) for b in found)
    costs = []
    for b in found:
        say = MARKS[b.mark] if b.mark != PLAIN or not led else ELSEWHERE
        costs.append(round(UNIT * (say + max(-SHAPE, min(SHAPE, sum(weights[f] for f in shape(b)))))))
    n, unit = len(found), lambda x: round(UNIT * x)
    edges = [(i, i + 1, unit(NEXT)) for i in range(n - 1)]
    edges += [(i, n + b.element, unit(INSIDE)) for i, b in enumerate(found)]
    edges += [(n + i, n + up, unit(AROUND)) for i, up in enumerate(parents) if up >= 0]
    side = min_cut(costs + [0] * len(parents), edges)
    return [b.text for b, kept in zip(found, side, strict=False) if kept]


def extract(pages: DataFrame, weights: dict[tuple, float], keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` of every row of pages (html), with text, n_chars (code points) and n_blocks."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column(len(keep))
            for a, b in text_slices([None] * len(htmls) if htmls.nbytes < 4_000_000 else htmls.to_pylist()):
                texts = [main_blocks(page or "", weights) for page in htmls.slice(a, b - a).to_pylist()]
                joined = ["\n".join(t) for t in texts]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(joined, pa.string()), pa.array([len(t) for t in joined], pa.int64()), pa.array([len(t) for t in texts], pa.int32())], [*keep, "text", "n_chars", "n_blocks"])
        trim()

    return pages.select(*keep, "html").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string, n_chars bigint, n_blocks int"]))
