"""Command line: python -m quillspark COMMAND. Tables are Parquet; see README."""

from __future__ import annotations

import argparse
import importlib
import json
import sys


def _named(name: str | None):
    """An object given as module:name."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(f"--{o}", required=True)
        return p

    def models(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
        p.add_argument("--embedder", default="quillspark.operators.models:HashEmbedder")
        p.add_argument("--reranker")
        p.add_argument("--no-rerank", action="store_true")
        return p

    command("playlists", "entries", "out").add_argument("--limit", type=int)
    p = command("fetch", "videos", "fetcher", "out")
    p.add_argument("--breaker", type=int, default=5)
    p.add_argument("--pause", type=float, default=0.0)
    p.add_argument("--pause-every", type=int, default=0)
    p.add_argument("--long-pause", type=float, default=300.0)
    p.add_argument("--batch", type=int, default=25)
    p.add_argument("--drop-non-recipe", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p = command("chunk", "cues", "videos", "out")
    p.add_argument("--include-non-recipe", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--tokenizer")
    p.add_argument("--json")
    for name in ("target", "max", "min", "overlap"):
        p.add_argument(f"--{name}", type=int)
    p = command("index", "chunks", "out")
    p.add_argument("--embedder", default="quillspark.operators.models:HashEmbedder")
    p.add_argument("--collection", help="bring this collection up to date and write the tables from it")
    for name in ("search", "retrieve", "ask"):
        p = models(command(name, "chunks", "index", "query"))
        p.add_argument("--client")
        p.add_argument("-k", type=int, default=5)
        p.add_argument("--mode", default="hybrid")
        p.add_argument("--intent-filter", action="store_true")
        for option in ("top-videos", "per-video", "budget"):
            p.add_argument(f"--{option}", type=int)
    p = models(command("eval", "golden", "chunks", "index", "out"))
    p.add_argument("--mode", choices=("retrieval", "answer", "both"), default="retrieval")
    p.add_argument("--client")
    p.add_argument("--budget", type=int)
    p.add_argument("--rank-k", type=int, default=10)
    p.add_argument("--kinds", nargs="*")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from quillspark.operators import evaluate
    from quillspark.plans import jobs
    from quillspark.plans.facade import BadRequest, Service
    from quillspark.session import materialize, ship
    from quillspark.sources import readers, sinks

    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    read = spark.read.parquet
    match args.command:
        case "playlists":
            sinks.write_table(jobs.classify_recipes(jobs.collect_videos(read(args.entries), args.limit)), args.out)
        case "fetch":
            from quillspark.plans.jobs import classify_recipes
            from quillspark.sources.fetching import FetchRun, RunOptions, in_order
            from quillspark.sources.transcripts import TranscriptStore, run_manifest, transcript_rows

            videos = in_order(read(args.videos), "video_id")
            videos = classify_recipes(videos if "description" in videos.columns else videos.selectExpr("*", "CAST(NULL AS STRING) AS description"))
            store = TranscriptStore(spark, f"{args.out}/store")
            number = max(store.table.versions(), default=-1) + 1
            run = FetchRun(spark, f"{args.out}/runs/{number}")
            options = RunOptions(args.batch, args.pause, args.pause_every, args.long_pause, args.breaker)
            stopped = run.go(videos, _named(args.fetcher), options, None if args.overwrite else store.existing(), videos.filter("NOT is_recipe") if args.drop_non_recipe else None)
            store.commit(transcript_rows(videos, run.fetched()), number)
            sinks.write_manifest(run_manifest(run.fetched(), store.table.read()), f"{args.out}/manifest-{number}")
            return 3 if stopped else 0
        case "chunk":
            from dataclasses import replace

            from quillspark.config import ChunkConfig
            from quillspark.operators.models import TokenizerFile

            given = {n: getattr(args, n) for n in ("target", "max", "min", "overlap") if getattr(args, n) is not None}
            counter = (lambda path=args.tokenizer: TokenizerFile(path)) if args.tokenizer else None
            existing = read(args.out) if sinks.exists(spark, args.out) and not args.overwrite else None
            existing = materialize(existing, "existing") if existing is not None else None
            videos = read(args.videos)
            made = materialize(jobs.build_chunks(read(args.cues), videos, cut=replace(ChunkConfig(), **given), include_non_recipe=args.include_non_recipe, existing=existing, counter=counter), "chunks")
            sinks.write_table(made, args.out, args.json)
            new = made if existing is None else sinks.not_yet(made, existing, "chunk_id")
            sinks.write_table(jobs.chunk_run_manifest(videos, existing, new, args.include_non_recipe), f"{args.out}-manifest")
        case "index":
            chunk_table = read(args.chunks)
            if args.collection:
                from quillspark.sources.collection import Collection

                table = Collection(spark, args.collection)
                jobs.update_index(table, chunk_table, _named(args.embedder))
                vectors, postings = jobs.index_tables(table)
            else:
                vectors, postings = jobs.build_index(chunk_table, _named(args.embedder))
            sinks.write_table(vectors, f"{args.out}/dense")
            sinks.write_table(postings, f"{args.out}/postings")
        case "search" | "retrieve" | "ask":
            from quillspark.config import RUSSIAN

            service = Service(read(args.chunks), read(f"{args.index}/dense"), read(f"{args.index}/postings"), _named(args.embedder), _named(args.reranker), _named(args.client))
            wide = {"top_videos": args.top_videos, "per_video": args.per_video, "budget": args.budget, "mode": args.mode, "rerank": not args.no_rerank, "patterns": RUSSIAN.intents if args.intent_filter else ()}
            try:
                match args.command:
                    case "search":
                        found = service.search(args.query, args.k, args.mode)
                    case "retrieve":
                        found = service.retrieve(args.query, **wide)
                    case _:
                        found = service.ask(args.query, **wide)
            except BadRequest as error:
                print(error, file=sys.stderr)
                return 2
            print(json.dumps(found, ensure_ascii=False, indent=2, default=str))
        case "eval":
            from dataclasses import replace

            from quillspark.config import RetrievalConfig

            golden = readers.load_golden(spark, args.golden, args.kinds)
            if golden.isEmpty():
                print("no labelled queries", file=sys.stderr)
                return 1
            tables = read(args.chunks), read(f"{args.index}/dense"), read(f"{args.index}/postings")
            config = replace(RetrievalConfig(), token_budget=args.budget or RetrievalConfig().token_budget)
            reranker = None if args.no_rerank else _named(args.reranker)
            report: dict = {"golden": args.golden, "rank_k": args.rank_k}
            if args.mode in ("retrieval", "both"):
                rows = materialize(jobs.evaluate_retrieval(golden, *tables, _named(args.embedder), config, args.rank_k, reranker), "evaluated")
                kinds = {r["kind"]: r.asDict() for r in evaluate.by_kind(rows).collect()}
                report["retrieval"] = {"summary": evaluate.retrieval_summary(rows).first().asDict(), "by_kind": kinds, "missed": [r.asDict() for r in evaluate.missed(rows).select("id", "query").orderBy("id").collect()]}
            if args.mode in ("answer", "both"):
                service = Service(*tables, _named(args.embedder), reranker, _named(args.client), config)
                if not service.health()["model"]:
                    print("the model does not answer", file=sys.stderr)
                    return 2
                from pyspark.sql import functions as F

                asked = golden.select(F.col("id").alias("query_id"), "query")
                passages, contexts, _ = service.retrieved(asked, service.vectors, service.postings, config)
                rows = materialize(jobs.evaluate_answers(golden, passages, contexts, service.client, config.min_score), "answered")
                wrong = evaluate.found_mismatches(rows).select("id", "query", "found", "expect_found").orderBy("id")
                report["answer"] = {"summary": evaluate.answer_summary(rows).first().asDict(), "mismatches": [r.asDict() for r in wrong.collect()]}
            sinks.dump_report(args.out, report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
