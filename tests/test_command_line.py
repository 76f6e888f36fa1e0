"""The command line from end to end, and what the service tells of itself."""

import json

from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.config import RetrievalConfig
from quillspark.operators.models import HashEmbedder, OverlapReranker, TokenizerFile, counted_tokens
from quillspark.plans import jobs
from quillspark.plans.facade import Service
from quillspark.sources.connectors import NetworkOptions
from tests.stubs import Client, Silent


def test_from_fetching_to_evaluation(spark, tmp_path, capsys):
    at = lambda name: f"{tmp_path}/{name}"
    videos = spark.createDataFrame([("v1", "Плов", ["p"], ["Готовим"], None), ("v2", "Суп", ["p"], ["Готовим"], None), ("none", "x", ["p"], ["q"], None), ("ad", "обзор доставки", ["p"], ["q"], None)], "video_id string, title string, playlist_ids array<string>, playlist_titles array<string>, description string")
    videos.write.parquet(at("videos"))
    assert main(["fetch", "--videos", at("videos"), "--fetcher", "tests.stubs:fetcher", "--out", at("fetched")]) == 0
    listed = {r["video_id"]: r for r in spark.read.json(at("fetched/manifest-0/manifest")).collect()}
    assert (listed["v1"]["status"], listed["v1"]["raw_cues"], listed["none"]["status"]) == ("ok", 1, "no_transcript")
    assert main(["fetch", "--videos", at("videos"), "--fetcher", "tests.stubs:fetcher", "--out", at("fetched")]) == 0
    again = {r["video_id"]: r["status"] for r in spark.read.json(at("fetched/manifest-1/manifest")).collect()}
    assert (again["v1"], again["none"]) == ("skip_exists", "no_transcript")

    cues = [(v, i, f"{t} номер {i} готовим вместе на кухне.", i * 5.0, 4.0) for v, t in (("v1", "варим плов с рисом"), ("v2", "режем лук для супа")) for i in range(40)]
    spark.createDataFrame(cues, "video_id string, cue_idx int, text string, start double, duration double").write.parquet(at("cues"))
    chunk = ["chunk", "--cues", at("cues"), "--videos", at("videos"), "--out", at("chunks"), "--target", "100", "--max", "150", "--min", "20", "--overlap", "10"]
    assert main(chunk) == 0
    status = lambda: {r["video_id"]: (r["status"], r["chunks"]) for r in spark.read.parquet(at("chunks-manifest")).collect()}
    n = spark.read.parquet(at("chunks")).filter("video_id = 'v1'").count()
    assert n > 1 and status()["v1"] == ("ok", n) and status()["none"] == ("ok", 0)
    before = sorted(map(str, spark.read.parquet(at("chunks")).collect()))
    assert main(chunk) == 0 and status()["v1"] == ("skip_exists", n) and sorted(map(str, spark.read.parquet(at("chunks")).collect())) == before
    assert main([*chunk, "--overwrite", "--target", "400", "--max", "500"]) == 0 and status()["v1"][0] == "ok" and status()["v1"][1] < n

    index = ["index", "--chunks", at("chunks"), "--out", at("index"), "--collection", at("collection")]
    assert main(index) == 0
    common = ["--chunks", at("chunks"), "--index", at("index")]
    capsys.readouterr()
    assert main(["retrieve", *common, "--query", "плов с рисом", "--mode", "sparse", "--top-videos", "1", "--budget", "900", "--intent-filter", "--no-rerank"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["passages"] and {p["video_id"] for p in told["passages"]} == {"v1"} and told["debug"]["used_reranker"] is False and told["debug"]["mode"] == "sparse"
    assert main(["ask", *common, "--query", "плов", "--client", "tests.stubs:Client", "--per-video", "2"]) == 0
    answer = json.loads(capsys.readouterr().out)
    assert answer["found"] and answer["source"]["n"] == 1

    (tmp_path / "golden.jsonl").write_text("\n".join(json.dumps(g, ensure_ascii=False) for g in ({"id": "a", "query": "плов с рисом", "relevant": ["v1"]}, {"id": "b", "query": "космос", "relevant": [], "expect_found": True, "kind": "negative"})))
    evaluate = ["eval", *common, "--golden", at("golden.jsonl"), "--out", at("report.json"), "--mode", "both"]
    assert main([*evaluate, "--client", "tests.stubs:Client"]) == 0
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["retrieval"]["summary"]["n"] == 1 and report["retrieval"]["missed"] == []
    assert report["answer"]["summary"]["n"] == 2 and [m["id"] for m in report["answer"]["mismatches"]] == ["b"]
    assert main([*evaluate, "--client", "tests.stubs:Silent"]) == 2


def service(spark, client=Client):
    chunk_table = spark.createDataFrame(
        [(f"v{v}::00{i}", f"v{v}", f"title {v}", "u", "00:00", float(i), float(i + 1), i, 3, "steps", ["Супы" if v else "Другое"], f"{t} часть {i}") for v, t in enumerate(("рис и плов", "суп с луком")) for i in range(3)],
        "chunk_id string, video_id string, title string, url string, timecode string, start double, end double, chunk_index int, n_chunks int, section string, playlist_titles array<string>, text string",
    )
    vectors, postings = jobs.build_index(chunk_table, HashEmbedder)
    return Service(chunk_table, vectors, postings, HashEmbedder, OverlapReranker, client)


def test_health(spark):
    good = service(spark).health()
    assert (good["status"], good["index"], good["model"], good["model_name"]) == ("ok", 6, True, "stub")
    bad = service(spark, Silent).health()
    assert (bad["status"], bad["model"]) == ("degraded", False) and "refused" in bad["error"]
    assert service(spark, None).health()["status"] == "degraded"


def test_counters_and_evaluation_rows(spark):
    s = service(spark)
    told = s.retrieve("суп с луком", patterns=(("суп", "Супы"),), mode="sparse")
    assert told["debug"]["intent_filter"] == ["Супы"] and told["debug"]["filtered"] and told["debug"]["candidates"] == 3 and told["debug"]["used_reranker"]
    plain = s.retrieve("часть 0", section_weights=False, mode="sparse", rerank=False)
    assert plain["debug"]["intent_filter"] == [] and not plain["debug"]["filtered"]
    weighted = s.retrieve("часть 0", mode="sparse", rerank=False)
    assert max(p["score"] for p in plain["passages"]) > max(p["score"] for p in weighted["passages"])
    golden = spark.createDataFrame([("a", "суп с луком", ["v1"], "exact"), ("b", "совсем", [], "negative")], "id string, query string, relevant array<string>, kind string")
    rows = {r["id"]: r for r in jobs.evaluate_retrieval(golden, s.chunks, s.vectors, s.postings, HashEmbedder, RetrievalConfig(mode="sparse")).collect()}
    assert rows["a"]["rank"] == 1 and rows["a"]["top"][0] == "v1" and rows["a"]["top_score"] > 0
    assert (rows["b"]["top"], rows["b"]["top_score"]) == ([], 0.0)


def test_chunk_run_manifest(spark):
    videos = spark.createDataFrame([("a", True), ("b", False), ("c", None), ("d", True)], "video_id string, is_recipe boolean")
    made = spark.createDataFrame([("a", 5, "x"), ("a", 8, "y")], "video_id string, token_len int, section string")
    held = spark.createDataFrame([("d", 1, "x")], "video_id string, token_len int, section string")
    got = {r[0]: tuple(r)[1:] for r in jobs.chunk_run_manifest(videos, held, made).collect()}
    assert got == {"a": ("ok", 2, 5, 6, 8, ["x", "y"]), "b": ("skip_non_recipe", None, None, None, None, None), "c": ("ok", 0, 0, 0, 0, []), "d": ("skip_exists", 1, None, None, None, None)}


def test_proxies():
    assert NetworkOptions().transcript_proxy() is None
    plain = NetworkOptions(proxy="http://p:1").transcript_proxy()
    assert (plain.kind, plain.url) == ("plain", "http://p:1")
    rotating = NetworkOptions(proxy="http://p:1", rotating_proxy=("u", "s3cret")).transcript_proxy()
    assert (rotating.kind, rotating.user, rotating.password) == ("rotating", "u", "s3cret") and "s3cret" not in repr(rotating)
    assert NetworkOptions(proxy="http://p:1", rotating_proxy=("u", "")).transcript_proxy().kind == "plain"


def test_tokens_of_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["hello there world", "", None, "ещё раз " * 50]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", counted_tokens(F.col("text"), lambda: TokenizerFile(path)).alias("n")).collect()
    assert [r["n"] for r in got] == [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
