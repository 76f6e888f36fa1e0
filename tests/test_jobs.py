"""Sources, sinks, jobs, answers, the service, and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.config import ChunkConfig, RetrievalConfig
from quillspark.operators.answer import answers, call_model, messages
from quillspark.operators.models import HashEmbedder, OverlapReranker
from quillspark.plans import jobs
from quillspark.plans.facade import BadRequest, Service, check_request
from quillspark.session import materialize
from quillspark.sources import connectors, readers, sinks


class Talk:
    """A model that answers from its prompt; some questions make it fail or stray."""

    model = "stand-in"

    def chat(self, messages, **options):
        asked = messages[1]["content"]
        if "broken" in asked:
            raise RuntimeError("down")
        if "stray" in asked and len(messages) == 2:
            return "no idea"
        return "```json\n" + json.dumps({"found": True, "dish": "d", "ingredients": ["2 eggs"], "steps": ["mix"], "source_n": "[1]"}) + "\n```"


def test_golden_and_chunks(spark, tmp_path):
    path = tmp_path / "golden.jsonl"
    path.write_text('{"id": "a", "query": "q", "relevant": ["v"], "kind": "x"}\n\n{"id": "b", "query": "r"}\n')
    assert [r["kind"] for r in readers.load_golden(spark, str(path)).orderBy("id").collect()] == ["x", "exact"]
    assert readers.load_golden(spark, str(path), ["x"]).count() == 1 and readers.load_golden(spark, str(path), []).count() == 2
    path.write_text("{bad\n")
    with pytest.raises(Exception):
        readers.load_golden(spark, str(path)).collect()
    path = tmp_path / "chunks.jsonl"
    path.write_text("".join(json.dumps({"chunk_id": f"v::{i:03d}"}) + "\n" for i in range(5)))
    assert [readers.load_chunks(spark, str(path), n).count() for n in (None, 0, 3)] == [5, 0, 3]
    assert [r["chunk_id"] for r in readers.load_chunks(spark, str(path), 2).collect()] == ["v::000", "v::001"]


def test_transcripts(spark, tmp_path):
    for name, text in {"a.json": json.dumps({"meta": {"video_id": "a"}, "segments": []}), "b.json": "{oops", "manifest.json": "[]", "c.json": '{"meta": 3}'}.items():
        (tmp_path / name).write_text(text)
    assert [r["file"] for r in readers.load_transcripts(spark, str(tmp_path)).collect()] == ["a.json"]


def test_subtitles(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02,500\n<c>one</c>\ntwo\n\n2\n00:00:03.000 --> 00:00:04.000\n<i></i>\n\n00:00:05.000 --> 00:00:06.000\nlast"
    js = json.dumps({"events": [{"tStartMs": 1500, "segs": [{"utf8": "a"}, {"x": 1}, {"utf8": "b"}]}, {"segs": [{"utf8": "no start"}]}, {"tStartMs": 1}, {"tStartMs": 2000, "dDurationMs": 500, "segs": [{"utf8": "\n"}]}]})
    files = spark.createDataFrame([("v", "v.en.vtt", vtt), ("w", "w.ru.vtt", "x"), ("w", "w.en.json3", js), ("w", "w.ru.json3", js), ("z", "z.txt", "")], "video_id string, path string, content string")
    assert sorted((r["video_id"], r["path"]) for r in readers.preferred_subtitles(files, ["ru", "en"]).collect()) == [("v", "v.en.vtt"), ("w", "w.ru.json3")]
    got = sorted(map(tuple, readers.subtitle_cues(files, ["ru", "en"]).collect()))
    assert got == [("v", 0, "one two", 1.0, 1.5), ("v", 1, "last", 5.0, 1.0), ("w", 0, "ab", 1.5, 0.0)]


def test_connectors(spark):
    calls, pauses = [], []

    def api(video_id):
        calls.append(video_id)
        if video_id == "limited":
            raise connectors.RateLimited("slow down")
        if video_id == "none":
            raise connectors.TranscriptError("none")
        return connectors.Transcript([(" ", 0, 1), ("x", 1.0, 2.0)], "ru", False)

    other = lambda video_id: connectors.Transcript([("y", 0.0, 1.0)], "en", True)
    auto = connectors.dispatch("auto", {"ytapi": api, "ytdlp": other})
    assert auto("ok").cues == [("x", 1.0, 2.0)] and auto("none").source == "ytdlp"
    with pytest.raises(connectors.RateLimited):
        auto("limited")
    assert connectors.dispatch("odd", {"ytdlp": other})("a").source == "ytdlp"
    with pytest.raises(connectors.RateLimited):
        connectors.with_retries(api, -1, 30, pauses.append)("limited")
    with pytest.raises(connectors.RateLimited):
        connectors.with_retries(api, 3, 30, pauses.append)("limited")
    assert pauses == [30, 60]
    breaker = connectors.Breaker(2)
    assert [breaker.saw(s) for s in ("rate_limited", "skip_exists", "ok", "rate_limited", "skip_exists", "rate_limited")] == [False] * 5 + [True]
    assert connectors.NetworkOptions("p", "f", "b", "ru").options() == {"proxy": "p", "cookiefile": "f", "extractor_args": {"youtube": {"lang": ["ru"]}}}


def make_fetcher():
    def fetch(video_id):
        if video_id.startswith("r"):
            raise connectors.RateLimited("slow")
        if video_id == "n":
            raise connectors.TranscriptError("none")
        return connectors.Transcript([("one", 0.0, 1.0), ("two", 1.0, 1.0)], "ru", True, "ytapi")

    return fetch


def test_fetch(spark):
    videos = spark.createDataFrame([(v,) for v in ["a", "n", "r1", "r2", "z"]], "video_id string").coalesce(1)
    fetched = connectors.fetch_transcripts(videos, make_fetcher, connectors.FetchOptions(breaker=2))
    assert [r["status"] for r in fetched.collect()] == ["ok", "no_transcript", "rate_limited", "rate_limited", "aborted"]
    assert [tuple(r) for r in connectors.cues_of(fetched).collect()] == [("a", 0, "one", 0.0, 1.0), ("a", 1, "two", 1.0, 1.0)]
    speech = spark.createDataFrame([("v", 0, " Раз. Два ", 0.0, 9.0), ("v", 1, "  ", 9.0, 10.0)], "video_id string, seg_no int, text string, start double, end double")
    assert [r["text"] for r in connectors.speech_cues(speech).collect()] == ["Раз.", "Два"]


def test_abort_point(spark, monkeypatch):
    rows = [(i, s) for i, s in enumerate(["rate_limited", "ok", "rate_limited", "skip_exists", "rate_limited", "rate_limited"])]
    assert jobs.abort_point(spark.createDataFrame(rows, "run_no int, status string"), 2).first()[0] == 4
    rng = random.Random(5)
    for share in (0.2, 0.6, 1.0):
        statuses = [rng.choices(["rate_limited", "ok", "skip_exists"], [share, (1 - share) / 2, (1 - share) / 2])[0] for _ in range(200)]
        in_a_row, want = 0, None
        for i, status in enumerate(statuses):
            in_a_row = in_a_row if status == "skip_exists" else in_a_row + 1 if status == "rate_limited" else 0
            want = i if want is None and in_a_row == 6 else want
        monkeypatch.setattr(jobs, "BLOCK", 7)
        assert jobs.abort_point(spark.createDataFrame(list(enumerate(statuses)), "run_no int, status string"), 6).first()[0] == want


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    sinks.ensure_collection(spark, path, "chunk_id string, text string")
    assert spark.read.parquet(path).count() == 0
    rows = spark.createDataFrame([("a", "1"), ("б", "2")], "chunk_id string, text string")
    sinks.write_table(rows, path, f"file://{tmp_path}/j")
    sinks.ensure_collection(spark, path, "chunk_id string, text string")
    assert spark.read.parquet(path).count() == 2 and "б" in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*.json"))
    sinks.ensure_collection(spark, path, "chunk_id string, text string", recreate=True)
    assert spark.read.parquet(path).count() == 0
    sinks.write_manifest(spark.createDataFrame([("a", "ok"), ("b", "error")], "video_id string, status string"), f"file://{tmp_path}/m")
    assert spark.read.json(f"file://{tmp_path}/m/failures").count() == 1
    sinks.dump_report(f"{tmp_path}/x/y/r.json", {"ж": 1})
    assert json.loads((tmp_path / "x/y/r.json").read_text()) == {"ж": 1}


def test_collect_and_classify(spark):
    entries = spark.createDataFrame([(0, 0, "p", "P", "a", "first"), (0, 1, "p", "P", "b", "B"), (1, 0, "q", "Q", "a", "second"), (1, 1, "q", "Q", "a", "third")], "playlist_no int, pos int, playlist_id string, playlist_title string, video_id string, title string")
    got = {r["video_id"]: (r["title"], r["playlist_ids"]) for r in jobs.collect_videos(entries, 0).collect()}
    assert got == {"a": ("first", ["p", "q", "q"]), "b": ("B", ["p"])}
    assert jobs.collect_videos(entries, 1).count() == 1
    videos = spark.createDataFrame([("a", "Обзор доставки", None), ("b", "Борщ", "вкусно")], "video_id string, title string, description string")
    got = {r["video_id"]: (r["is_recipe"], r["skip_reason"]) for r in jobs.classify_recipes(videos).collect()}
    assert got == {"a": (False, "delivery_marker:'Обзор доставки'"), "b": (True, None)}


@pytest.fixture(scope="module")
def built(spark):
    cues = [(v, i, f"{word} номер {i} затем добавим соль и перец, потом перемешаем.", i * 4.0, 4.0) for v, word in (("a", "борщ"), ("b", "плов")) for i in range(60)]
    cues = spark.createDataFrame(cues, "video_id string, cue_idx int, text string, start double, duration double")
    videos = spark.createDataFrame([(v, t, ["p"], [p], True) for v, t, p in (("a", "Борщ", "Супы"), ("b", "Плов", "Мясо"))] + [("c", "x", [], [], False)], "video_id string, title string, playlist_ids array<string>, playlist_titles array<string>, is_recipe boolean")
    chunk_table = jobs.build_chunks(cues, videos, cut=ChunkConfig(target=150, max=200, min=40, overlap=20))
    chunk_table = materialize(chunk_table, "chunks")
    vectors, postings = (materialize(x, "index") for x in jobs.build_index(chunk_table, HashEmbedder))
    return cues, videos, chunk_table, vectors, postings


def test_build_is_resumable(built):
    cues, videos, chunk_table, _, _ = built
    assert {r[0] for r in chunk_table.select("video_id").distinct().collect()} == {"a", "b"}
    again = jobs.build_chunks(cues, videos, cut=ChunkConfig(target=150, max=200, min=40, overlap=20), existing=chunk_table.filter("video_id = 'a'"))
    assert sorted(map(str, again.collect())) == sorted(map(str, chunk_table.collect()))


def test_service(built):
    _, _, chunk_table, vectors, postings = built
    service = Service(chunk_table, vectors, postings, HashEmbedder, OverlapReranker, Talk)
    found = service.search("плов", k=3, mode="sparse")
    assert len(found) == 3 and found[0]["title"] == "Плов" and set(found[0]) == {"title", "url", "timecode", "section", "score", "text"}
    assert {r["title"] for r in service.search("плов", k=3, condition=F.col("video_id") == "a")} == {"Борщ"}
    told = service.ask("плов номер", patterns=(("плов", "Мясо"),))
    assert told["found"] and told["source"]["title"] == "Плов" and told["steps"] == ["mix"] and all(o["n"] != 1 for o in told["other"])
    assert service.health()["index"] == vectors.count()
    for bad in (dict(query="x"), dict(query="xx", k=21), dict(query="xx", mode="odd"), dict(query="xx", top_videos=9), dict(query="xx", per_video=0), dict(query="xx", temperature=2)):
        with pytest.raises(BadRequest):
            check_request(**bad)


def test_evaluation(spark, built):
    from quillspark.operators import evaluate

    _, _, chunk_table, vectors, postings = built
    golden = spark.createDataFrame([("1", "плов", ["b"], "exact", True, ""), ("2", "борщ", ["a"], "exact", True, ""), ("3", "zzz qqq", [], "negative", False, "")], "id string, query string, relevant array<string>, kind string, expect_found boolean, note string")
    rows = jobs.evaluate_retrieval(golden, chunk_table, vectors, postings, HashEmbedder, RetrievalConfig(mode="sparse"), reranker=OverlapReranker)
    summary = evaluate.retrieval_summary(rows).first()
    assert summary["n"] == 2 and summary["mrr"] == 1.0 and summary["hit_1"] == 1.0


def test_answers(spark):
    cite = [(1, "v", "t", "u", "0"), (2, "w", "t", "u", "1")]
    kinds = "query_id string, context string, citations array<struct<n:int,video_id:string,title:string,url:string,timecode:string>>"
    queries = spark.createDataFrame([(q, q) for q in ("good", "stray", "broken", "weak", "alone")], "query_id string, query string")
    contexts = spark.createDataFrame([(q, "c {x}", cite) for q in ("good", "stray", "broken", "weak")], kinds)
    passages = spark.createDataFrame([(q, 0.004 if q == "weak" else 0.005) for q in ("good", "stray", "broken", "weak")], "query_id string, video_score double")
    got = {r["query_id"]: r for r in answers(queries, passages, contexts, Talk).collect()}
    assert {q: r["found"] for q, r in got.items()} == {"good": True, "stray": True, "broken": False, "weak": False, "alone": False}
    assert got["good"]["source"]["video_id"] == "v" and got["broken"]["error"] == "down" and got["weak"]["error"] is None and got["weak"]["sources"]
    assert "{x}" in messages("q {context}", "c {x}")[1]["content"]
    assert call_model(spark.createDataFrame([("a", "stray", "c")], "query_id string, query string, context string"), Talk).first()["error"] is None


def test_streams(spark, tmp_path):
    from quillspark.sources.collection import Collection
    from quillspark.streaming.ingest import newest, session_gaps, upsert_batches, versions

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10"), (1, "2024-01-01 01:00:00")], "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = session_gaps(stream, "k", "ts", "30 seconds", "1 minute").writeStream.format("memory").queryName("gaps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.table("gaps").collect()] == [2]
    put = upsert_batches(f"file://{tmp_path}/t", lambda b: b)
    for number, batch in enumerate([[("a", 1), ("b", 1)], [("b", 2)], [("b", 2)]]):
        put(spark.createDataFrame(batch, "chunk_id string, x int"), number)
    assert sorted(map(tuple, Collection(spark, f"file://{tmp_path}/t").read(2).collect())) == [("a", 1), ("b", 2)]
    # A number is left out, a batch comes again, a batch is empty: nothing is lost.
    for number, batch in ((4, [("c", 3)]), (4, [("c", 3)]), (5, [])):
        put(spark.createDataFrame(batch, "chunk_id string, x int"), number)
    assert versions(spark, f"file://{tmp_path}/t") == [0, 1, 2, 4]
    assert sorted(map(tuple, newest(spark, f"file://{tmp_path}/t").collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_models_of_one_function_are_kept_apart(spark):
    from quillspark.operators.models import rerank_scores

    class Fixed:
        def __init__(self, value):
            self.value = value

        def score(self, query, texts):
            return [self.value] * len(texts)

    rows = spark.createDataFrame([("q", "t")], "query string, text string")
    assert [rerank_scores(rows, lambda v=v: Fixed(v)).first()["rerank"] for v in (1.0, 2.0)] == [1.0, 2.0]


def test_json_is_asked_for_again(spark):
    from quillspark.operators.answer import call_model
    from quillspark.operators.models import FormatRefused

    class Talk:
        model = "m"

        def __init__(self):
            self.asked = 0

        def chat(self, talk, json_mode=False):
            if json_mode and "plain" in talk[1]["content"]:
                raise FormatRefused
            if "bug" in talk[1]["content"]:
                raise TypeError("a fault of the client")
            self.asked += 1
            return "{oops" if self.asked == 1 else '```json\n{"found": true}\n```'

    rows = spark.createDataFrame([("a", "first", "c"), ("b", "plain", "c"), ("c", "bug", "c")], "query_id string, query string, context string").coalesce(1)
    got = {r["query_id"]: (r["reply"], r["error"]) for r in call_model(rows, Talk).collect()}
    assert got["a"] == ('```json\n{"found": true}\n```', None) and got["b"][1] is None and got["c"] == (None, "a fault of the client")


def test_track_choice(spark):
    tracks = [("v", "a", False, "en", True, 0), ("v", "b", True, "ru", True, 1), ("w", "c", False, "en", False, 0), ("w", "e", True, "de", True, 2), ("w", "d", False, "fr", True, 1), ("x", "f", False, "en", False, 0), ("y", "g", True, "ru", False, 0), ("y", "h", False, "ru", False, 1)]
    frame = spark.createDataFrame(tracks, "video_id string, track_id string, generated boolean, language string, translatable boolean, listed int")
    assert {r["video_id"]: (r["track_id"], r["translated"]) for r in connectors.choose_track(frame).collect()} == {"v": ("b", False), "w": ("d", True), "y": ("h", False)}


def make_speech():
    class Model:
        def transcribe(self, path):
            return [(f"Из {path}. Второе.", 0.0, 4.0), (" ", 4.0, 5.0)]

    return Model()


def test_speech(spark, tmp_path):
    files = spark.createDataFrame([("v", "a.wav")], "video_id string, path string")
    assert [r["text"] for r in connectors.speech_cues(connectors.transcribe_audio(files, make_speech)).collect()] == ["Из a.wav.", "Второе."]
    kept = []

    def download(video_id, folder):
        import os

        kept.append(folder)
        for name, size in (("a", 3), ("b", 9)):
            with open(f"{folder}/{name}", "wb") as f:
                f.write(bytes(size))
        return [f"{folder}/{n}" for n in sorted(os.listdir(folder))]

    fetch = connectors.asr_fetcher(download, lambda p: [(p[-1], 1.0, 0.5)], "ru")
    assert fetch("v").cues == [("b", 1.0, 0.0)]
    import os

    assert not os.path.exists(kept[0])
    connectors.asr_fetcher(download, lambda p: [("x", 0, 1)], "ru", str(tmp_path))("v")
    assert os.path.exists(tmp_path / "b")


def test_punctuation_backend():
    def broken():
        raise RuntimeError

    assert jobs.punctuation_backend("auto", "ytdlp", {"rupunct": broken, "silero": lambda: 1}) == "silero"
    assert jobs.punctuation_backend("auto", "asr", {"silero": lambda: 1}) == "none"
    assert jobs.punctuation_backend("silero", "asr", {"silero": lambda: 1}) == "silero"


def test_command_line(spark, built, tmp_path, capsys):
    from quillspark.__main__ import main

    _, _, chunk_table, _, _ = built
    chunk_table.write.parquet(f"{tmp_path}/chunks")
    assert main(["index", "--chunks", f"{tmp_path}/chunks", "--out", f"{tmp_path}/index"]) == 0
    capsys.readouterr()
    assert main(["search", "--chunks", f"{tmp_path}/chunks", "--index", f"{tmp_path}/index", "--query", "плов", "-k", "2"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert main(["search", "--chunks", f"{tmp_path}/chunks", "--index", f"{tmp_path}/index", "--query", "п"]) == 2
