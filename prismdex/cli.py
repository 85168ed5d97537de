"""Command line: index, search, stats, files, duplicates, summary, evaluate, calibrate, report."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prismdex.operators.evaluation import dataset_summary
from prismdex.operators.retrieval import Filters
from prismdex.plans import runners
from prismdex.plans.engine import Engine
from prismdex.settings import Settings
from prismdex.sources.documents import markdown_table
from prismdex.sources.listing import listing


def _list(text: str | None) -> tuple[str, ...] | None:
    found = tuple(x.strip().lower() for x in (text or "").split(",") if x.strip())
    return found or None


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="prismdex")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("--retry-failed", action="store_true")
    one.add_argument("--force", action="store_true")
    one.add_argument("--reanalyse", action="store_true")
    one = sub.add_parser("search")
    one.add_argument("query")
    one.add_argument("-n", type=int, default=24)
    one.add_argument("--offset", type=int, default=0)
    for name in ("types", "ext", "folder"):
        one.add_argument(f"--{name}")
    for name in ("min-size-mb", "max-size-mb", "after", "before"):
        one.add_argument(f"--{name}", type=float)
    for name in ("stats", "files", "duplicates", "summary"):
        sub.add_parser(name)
    sub.add_parser("thumbnails").add_argument("folder")
    for name, files in (("evaluate", ("queries", "manifest")), ("calibrate", ("queries",)), ("report", ("cases",))):
        one = sub.add_parser(name)
        for file in files:
            one.add_argument(file)
        one.add_argument("-k", type=int, default=10)
    args, settings = parser.parse_args(argv), Settings.from_env()
    spark = SparkSession.builder.appName("prismdex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, settings.index_dir, settings)
    if args.command == "index":
        out = engine.index(retry_failed=args.retry_failed, force=args.force, reanalyse=args.reanalyse)
    elif args.command == "search":
        size = lambda mb: None if mb is None else mb * 1024**2
        out = engine.search(args.query, Filters(_list(args.types), _list(args.ext), size(args.min_size_mb), size(args.max_size_mb), args.folder, args.after, args.before), args.n, args.offset)
    elif args.command == "evaluate":
        for rows in runners.evaluate(engine, args.queries, args.manifest, args.k):
            print(markdown_table(rows))
        return 0
    elif args.command == "calibrate":
        print(markdown_table(runners.calibrate(engine, args.queries)))
        return 0
    elif args.command == "report":
        print(runners.report(engine, args.cases, args.k))
        return 0
    elif args.command == "thumbnails":
        engine.export_thumbnails(args.folder)
        return 0
    elif args.command == "summary":
        rows = listing(spark, settings.media_dir).withColumn("folder", F.substring("folder", len(settings.media_dir.rstrip("/")) + 2, 1 << 20))
        print(markdown_table(dataset_summary(rows).orderBy("section", "name")))
        return 0
    else:
        out = getattr(engine, args.command)()
    json.dump(out, sys.stdout, indent=1, default=str, ensure_ascii=False)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
