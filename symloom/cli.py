"""Command line: ``python -m symloom.cli [--base DIR] COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from symloom.engine import Engine
from symloom.extract.rules import LanguageError
from symloom.operators.fulltext import QueryError
from symloom.plans.index import IndexNotFound


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symloom")
    p.add_argument("--base", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    sub.add_parser("index").add_argument("--incremental", action="store_true")
    for name, limit in (("search", 20), ("semantic-search", 10), ("find", 20)):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("--limit", type=int, default=limit)
    for name in ("callers", "callees"):
        sub.add_parser(name).add_argument("name")
    n = sub.add_parser("neighborhood")
    n.add_argument("name")
    n.add_argument("--depth", type=int, default=2)
    n.add_argument("--cap", type=int, default=50)
    sub.add_parser("status")
    sub.add_parser("languages")
    sub.add_parser("add-language").add_argument("toml")
    w = sub.add_parser("watch")
    w.add_argument("--every", default="2 seconds")
    return p


def run(engine: Engine, args: argparse.Namespace, out=sys.stdout) -> int:
    say = lambda text: print(text, file=out)
    started = time.time()
    match args.command:
        case "init":
            say("initialised" if engine.init() else "already initialised")
        case "index":
            done = engine.index(args.incremental)
            say(f"{done} in {time.time() - started:.1f} s" if done else f"indexed in {time.time() - started:.1f} s")
        case "search" | "semantic-search":
            for r in (engine.search if args.command == "search" else engine.semantic_search)(args.query, args.limit).toLocalIterator():
                say(f"{r.name} ({r.kind}, {r.lang}) - {r.file} [score: {r.score:.3f}]")
        case "find":
            for r in engine.find(args.query, limit=args.limit).toLocalIterator():
                say(f"{r.name} ({r.kind}, {r.lang}) {r.file}:{r.start_line} {r.signature or ''}".rstrip())
        case "callers" | "callees":
            for r in (engine.callers if args.command == "callers" else engine.callees)(args.name).toLocalIterator():
                say(f"{r.name} ({r.kind}) {r.file} [{r.edge_kind}]")
        case "neighborhood":
            say(engine.neighborhood(engine.resolve(args.name), args.depth, args.cap)[1])
        case "status":
            for key, value in engine.status().items():
                say(f"{key}: {value}")
        case "languages":
            say("\n".join(engine.languages()))
        case "add-language":
            say(f"added {engine.add_language(args.toml)}")
        case "watch":
            engine.watch(args.every, errors=[]).awaitTermination()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("symloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(Engine(spark, args.base), args)
    except (IndexNotFound, KeyError, QueryError, LanguageError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
