"""Every stage of the pipeline on its own input against plain Python: which rows stay, with which texts."""

import random

import pytest

from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, root bigint"
LINE = "This line is a licence line that very many documents of this table share."


def plain_shingles(text, width=5):
    words = brute.WORD.findall(brute.low(text))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def one_of_each(rows):
    """doc_ids that stay: the least of each group linked at 0.8."""
    sets = {d: plain_shingles(t) for d, t in rows}
    near = lambda a, b: sets[a] == sets[b] or (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    left, kept = sorted(sets), set()
    while left:
        group, todo = {left[0]}, [left[0]]
        while todo:
            d = todo.pop()
            more = {o for o in left if o not in group and near(d, o)}
            group |= more
            todo += more
        kept.add(min(group))
        left = [d for d in left if d not in group]
    return kept


@pytest.fixture(scope="module")
def table():
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, text(rng.randint(25, 120))) for i in range(40)]
    rows += [(50 + i, rows[i][1] if i % 2 else rows[i][1] + " " + word()) for i in range(10)]
    rows += [(70 + i, f"{text(40)}\n{LINE}\n{text(30)}") for i in range(8)]
    rows += [(90 + i, f"{text(20)} {passage} {text(i * 300)}") for i in range(6)]
    rows += [(100, None), (101, ""), (102, "two words"), (103, text(6000)), (104, "again and again " * 30), (105, "\n \t")]
    return [(d, t, "en", f"s{d % 2}", len(t or ""), "r", 1) for d, t in rows], [(1, passage), (2, text(20)), (3, None), (4, "a b")]


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages(spark, table, tmp_path):
    import corpus_pipeline
    from quillspark.llm.quality import quality_verdicts

    rows, items = table
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    put = lambda name, frame: stages[name](spark, frame, str(tmp_path))
    plain = {r[0]: r[1] for r in rows}

    good = {r["doc_id"] for r in quality_verdicts(docs).filter("kept").collect()}  # held against numpy elsewhere
    assert texts(put("quality_rules", docs)) == {d: t for d, t in plain.items() if d in good} and len(good) > 45
    assert not good & {d for d, t in plain.items() if brute.quality_base(t)[-1]}

    cut = texts(put("line_dedup", docs))
    assert {d: brute.sha(t or "") for d, t in cut.items()} == {d: s for d, _, _, s in brute.line_dedup(list(plain.items()))}
    assert sum(LINE in (t or "") for t in cut.values()) == 1

    assert set(texts(put("simhash_dedup", docs))) == one_of_each(list(plain.items()))

    flagged = {r[0] for r in brute.contamination(list(plain.items()), items) if r[-1]}
    assert set(texts(put("decontamination", docs))) == set(plain) - flagged and 90 in flagged and 95 not in flagged

    pieces = put("packing", docs).toPandas()
    assert set(pieces.doc_id) == set(plain)
    for _, one in pieces.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *one.length.cumsum().tolist()[:-1]] and one.length.sum() <= 4096
    whole = pieces.sort_values("piece").groupby("doc_id")
    assert (whole.start.apply(lambda s: s.tolist()) == whole.length.apply(lambda n: [0, *n.cumsum().tolist()[:-1]])).all()


def test_stages_pass_columns_and_empty_tables(spark, table, tmp_path):
    import corpus_pipeline

    rows, _ = table
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame(rows, SCHEMA).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
