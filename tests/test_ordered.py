"""Keys split over parts, and search by impact, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.config import ChunkConfig, CleanConfig
from quillspark.operators import chunking, ordered, sparse, timeline


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(ordered, "MOST_ROWS", 150)


def test_numbered_and_running(spark, small_parts):
    rng = random.Random(1)
    rows = [(k, rng.random(), rng.randint(0, 9)) for k in ["hot"] * 1000 + [None] * 400 + ["a"] * 100 + ["b"] * 3]
    got = ordered.numbered(spark.createDataFrame(rows, "k string, t double, x int").repartition(7), ["k"], ["t"])
    assert {r["k"]: r["n"] for r in got.groupBy("k").agg(F.count_distinct("part").alias("n")).collect()}["hot"] > 3
    got = ordered.running(ordered.running(got, ["k"], "total", F.col("x"), "sum"), ["k"], "best", F.col("x"), "max", current=False).collect()
    for key in ("hot", None, "a", "b"):
        total, best = 0, None
        for place, (r, want) in enumerate(zip(sorted((r for r in got if r["k"] == key), key=lambda r: r["place"]), sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), strict=True)):
            assert (r["place"], r["t"], r["best"]) == (place, want[1], best)
            total += want[2]
            best = max(best or 0, want[2])
            assert r["total"] == total


def test_windows_of_a_hot_key(spark, small_parts):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, *[float(rng.randint(0, 3000)) for _ in range(9)]])) for i in range(3000)]
    hits = [(rng.choice(["hot", "cold", None]), float(rng.randint(0, 3000))) for _ in range(400)]
    windows = timeline.merged_windows(spark.createDataFrame(hits, "k string, at double"), "k", "at", 2.0, 3.0)
    got = {r["i"] for r in timeline.outside_windows(spark.createDataFrame(rows, "i int, k string, at double"), windows, "k", "at").collect()}
    assert got == {i for i, k, at in rows if k is None or at is None or not any(h == k and t - 2 <= at <= t + 3 for h, t in hits)}
    spans = {}
    for k, t in sorted(hits, key=lambda h: (h[0] or "", h[1])):
        own = spans.setdefault(k, [])
        if own and t - 2 <= own[-1][1]:
            own[-1][1] = max(own[-1][1], t + 3)
        else:
            own.append([t - 2, t + 3])
    assert sorted(map(tuple, windows.select("k", "start", "end").collect()), key=repr) == sorted(((k, *s) for k, own in spans.items() for s in own), key=repr)


@pytest.mark.parametrize("pauses", [0, 0.01])
def test_blocks_of_a_hot_key_are_those_of_one_pass(spark, small_parts, monkeypatch, pauses):
    """Without pauses a rule falls into step late or never; its cuts are still those of one pass."""
    rng = random.Random(3)
    rows, at = [], 0.0
    for i in range(1500):
        at += 1.0 + (9.0 if rng.random() < pauses else 0)
        rows.append(("hot", i, "x" * rng.randint(1, 60) + rng.choice(["", "", "."]), at, 1.0))
    rows += [("cold", i, "y" * 50 + ".", i * 2.0, 1.0) for i in range(40)]
    cues = spark.createDataFrame(rows, "video_id string, cue_idx int, text string, start double, duration double").repartition(5)
    split = sorted(map(tuple, timeline.cue_blocks(cues, CleanConfig(), clean=False).collect()))
    monkeypatch.setattr(ordered, "MOST_ROWS", 10**6)
    assert split == sorted(map(tuple, timeline.cue_blocks(cues, CleanConfig(), clean=False).collect())) and len(split) > 40


def test_rule_that_never_falls_into_step(spark, small_parts):
    """Blocks of exactly seven rows: every part's state follows from all before it."""

    def part(columns, base, state, last):
        n, found = (state or [0])[0], []
        for i in range(len(columns[0])):
            n += 1
            if n == 7:
                found.append((base + i - 6, base + i))
                n = 0
        if last and n:
            end = base + len(columns[0]) - 1
            found.append((end - n + 1, end))
        return found, [n]

    rows = ordered.numbered(spark.createDataFrame([("k", None if i % 2 else "z", i) for i in range(2001)], "a string, b string, x int"), ["a", "b"], ["x"])
    got = sorted(map(tuple, ordered.cut_ranges(rows, ["a", "b"], ["x"], ordered.Rule(part)).collect()), key=repr)
    want = [("k", b, i // 7, i, min(i + 6, n - 1)) for b, n in ((None, 1000), ("z", 1001)) for i in range(0, n, 7)]
    assert got == sorted(want, key=repr)


def test_chunks_of_a_hot_key_are_those_of_one_pass(spark, small_parts, monkeypatch):
    rng = random.Random(4)
    texts = ["соль и перец 100 грамм", "режем и варим", "как дела", "потом жарим лук", "мука 200 грамм и 3 яйца"]
    rows = [("hot", i, " ".join(rng.choices(texts, k=rng.randint(1, 6))), i * 3.0, i * 3.0 + 3) for i in range(1200)] + [("cold", i, texts[i % 5], i * 3.0, i * 3.0 + 3) for i in range(30)]
    segments = spark.createDataFrame(rows, "video_id string, seg_idx int, text string, start double, end double").repartition(5)
    videos = spark.createDataFrame([("hot", "t", ["p"], ["q"]), ("cold", "u", ["p"], ["q"])], "video_id string, title string, playlist_ids array<string>, playlist_titles array<string>")
    config = ChunkConfig(target=60, max=90, min=30, overlap=15)
    split = sorted(map(str, chunking.chunks(segments, videos, config).collect()))
    monkeypatch.setattr(ordered, "MOST_ROWS", 10**6)
    assert split == sorted(map(str, chunking.chunks(segments, videos, config).collect())) and len(split) > 100


def plain_search(queries, postings, k):
    out = set()
    for q in {q for q, _, _ in queries}:
        mine = {}
        for a, t, w in queries:
            if a == q:
                mine[t] = mine.get(t, 0) + w
        scores = {}
        for c, t, w in postings:
            if t in mine:
                scores[c] = scores.get(c, 0) + w * mine[t]
        out |= {(q, c, r) for r, (c, _) in enumerate(sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k], 1)}
    return out


@pytest.mark.parametrize("negative", [False, True])
def test_sparse_search(spark, monkeypatch, negative):
    rng = random.Random(5)
    weight = lambda: float(rng.randint(-6 if negative else 1, 9))
    postings = [(c, f"t{t}", weight()) for c in range(600) for t in {min(49, int(rng.expovariate(0.12))) for _ in range(8)}]
    queries = [(q, f"t{t}", weight()) for q in range(25) for t in rng.sample(range(52), rng.randint(1, 5))] + [(3, "t1", 2.0), (3, "t1", 1.0), (99, "none", 1.0)]
    monkeypatch.setattr(sparse, "WORTH", 1)
    index = sparse.sparse_index(spark.createDataFrame([*postings], "chunk_id int, term string, weight double").repartition(6), block=8)
    asked = spark.createDataFrame(queries, "query_id int, term string, weight double")
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in sparse.sparse_search(asked, index, 5).collect()} == plain_search(queries, postings, 5)
    assert sparse.sparse_search(asked.limit(0), index, 5).count() == 0
    assert negative or sparse.reading_plan(asked, index, 5).filter("pruned").count()


@pytest.mark.parametrize("negative", [False, True])
def test_queries_are_multiplied_in_blocks(spark, monkeypatch, negative):
    """Many long queries of frequent terms, in several blocks, parts and slices: no pair of a query and a chunk is shuffled."""
    for name, value in {"SENT": 300, "FEW_TERMS": 3, "QUERY_BLOCK": 7, "ROW_BLOCK": 16, "HELD": 100, "MATCHES": 50, "DENSE_MOST": 4}.items():
        monkeypatch.setattr(sparse, name, value)
    rng = random.Random(8)
    weight = lambda: float(rng.randint(-6 if negative else 1, 9))
    postings = [(f"c{c}", f"t{t}", weight()) for c in range(300) for t in {min(49, int(rng.expovariate(0.1))) for _ in range(12)}] + [("c7", "t0", 2.0), ("c7", "t49", 3.0)]
    queries = [(q, f"t{t}", weight()) for q in range(60) for t in rng.sample(range(52), 20)] + [(3, "t1", 2.0), (99, "none", 1.0)]
    asked = spark.createDataFrame(queries, "query_id int, term string, weight double")
    rows = spark.createDataFrame(postings, "chunk_id string, term string, weight double").repartition(6)
    for source in (rows, sparse.sparse_index(rows, block=8, asked=asked)):
        found = sparse.sparse_search(asked, source, 5)
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in found.collect()} == plain_search(queries, postings, 5)
    odd = rows.unionByName(spark.createDataFrame([("c1", None, 9.0), ("c1", "t1", None)], rows.schema))
    assert {tuple(r) for r in sparse.sparse_search(asked, odd, 5).collect()} == {tuple(r) for r in found.collect()}


def test_asked_index_has_the_postings_of_its_terms_alone(spark):
    rows = spark.createDataFrame([(c, t, 1.0) for c in range(50) for t in ("a", "b", "c")], "chunk_id int, term string, weight double")
    index = sparse.sparse_index(rows, asked=spark.createDataFrame([(1, "b"), (2, "b"), (2, "none"), (2, None)], "query_id int, term string"))
    assert index.postings.groupBy("term").count().collect() == [("b", 50)]


def test_frequent_terms_are_hardly_read(spark, small_parts):
    """A rare and a frequent term: of the frequent one's postings few are read, and no task joins them all."""
    frequent = [(c, "the", 1.0 + (c % 97) / 100) for c in range(4000)]
    rare = [(c, "rare", 5.0 + c % 7) for c in range(0, 4000, 100)]
    index = sparse.sparse_index(spark.createDataFrame(frequent + rare, "chunk_id int, term string, weight double"), block=16)
    asked = spark.createDataFrame([(1, "the", 0.5), (1, "rare", 2.0)], "query_id int, term string, weight double")
    plan = sparse.reading_plan(asked, index, 10)
    assert {r["term"]: (r["essential"], r["pruned"]) for r in plan.collect()} == {"the": (False, True), "rare": (True, True)}
    assert plan.first()["n_read"] <= 40
    got = {(r["query_id"], r["chunk_id"], r["rank"]) for r in sparse.sparse_search(asked, index, 10).collect()}
    assert got == plain_search([(1, "the", 0.5), (1, "rare", 2.0)], frequent + rare, 10)
    assert index.blocks.filter("term = 'the'").select("deal").distinct().count() == sparse.DEAL
    alone = spark.createDataFrame([(2, "the", 1.0)], "query_id int, term string, weight double")
    assert sparse.reading_plan(alone, index, 10).first()["n_read"] < 200
