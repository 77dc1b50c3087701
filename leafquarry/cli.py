"""Command line: sweep, ocr, cost, find, sql, read, doc get, doc list."""

from __future__ import annotations

import argparse
import importlib
import os
import signal
import sys
import threading
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import arguments, paths
from .operators import enrich, search, sweep
from .operators.catalog import Catalog, with_ids
from .sources import config, files
from .sources.ocr_http import ANNOTATION, HttpOcr
from .sql import register
from .state import Change, Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafquarry")
    p.add_argument("--config", default="~/.leafquarry/config.yaml")
    p.add_argument("--database")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sweep")
    s.add_argument("paths", nargs="*")
    s.add_argument("--redo", action="store_true")
    s.add_argument("-j", type=int, help="tasks that read files; by default four for each core")
    s.add_argument("--exclude", action="append", default=[])
    s = sub.add_parser("cost")
    s.add_argument("--redo", action="store_true")
    s = sub.add_parser("ocr")
    s.add_argument("--redo", action="store_true")
    s.add_argument("-j", type=int, default=4)
    s.add_argument("--provider", default="", help="module:function that makes a provider; by default one over HTTP")
    s.add_argument("--url", help="where the HTTP provider posts files; by default $LEAFQUARRY_OCR_URL")
    s.add_argument("--model", help="its model; by default $LEAFQUARRY_OCR_MODEL")
    s = sub.add_parser("find")
    s.add_argument("query", nargs="*")
    s.add_argument("-v", action="store_true")
    s.add_argument("--json", action="store_true")
    s.add_argument("--limit", type=int, default=50)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--mode", default="and")
    s.add_argument("--fts", default="")
    s.add_argument("--trigram", action="store_true")
    s = sub.add_parser("read")
    s.add_argument("--path", required=True)
    s.add_argument("--page", type=int)
    s.add_argument("--context", type=int, default=0)
    s.add_argument("--start", type=int)
    s.add_argument("--end", type=int)
    s.add_argument("--json", action="store_true")
    s = sub.add_parser("sql")
    s.add_argument("statement", help="over documents, contents, pages and find(words, mode)")
    d = sub.add_parser("doc").add_subparsers(dest="action", required=True)
    s = d.add_parser("get")
    s.add_argument("--path", required=True)
    s.add_argument("--json", action="store_true")
    s = d.add_parser("list")
    s.add_argument("--after")
    s.add_argument("--before")
    s.add_argument("--limit", type=int, default=50)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--json", action="store_true")
    return p


def run_sweep(store: Store, args, cfg: config.Config, ask=input) -> list[str]:
    if args.j is not None:
        arguments.concurrency(args.j)
    wanted = args.paths or list(cfg.paths)
    if not wanted:
        raise ValueError("no paths to sweep")
    paths.check_excludes(args.exclude)
    found, roots, out = paths.resolve(wanted)
    if args.redo:
        n = store.load().documents.count()
        if ask(f"Delete all {n} documents first? [y/N] ").strip().lower() != "y":
            return ["Nothing was changed."]
    rows = store.write("scan", files.scan(store.spark, found))
    excluded = rows.where(paths.matches_any(F.col("path"), args.exclude)).count()
    scan = store.write("measured", files.measured(rows, excludes=args.exclude, workers=args.j))  # read once, however often the commit is tried

    def change(catalog: Catalog) -> Change | None:
        current = catalog.reset() if args.redo else catalog
        decided = store.write("decided", sweep.decide(current, scan, roots))  # counting and applying see the same rows
        return store.replaced(catalog, sweep.apply(current, decided, store.ids))

    store.commit(change)
    decided = store.spark.read.parquet(store.work("decided"))
    counts = sweep.counters(decided, excluded).first().asDict()
    out += [f"warning: {r.path}: {r.error}" for r in decided.where("action = 'failed'").toLocalIterator()]
    store.forget("scan", "measured", "decided")
    return [*out, ", ".join(f"{v} {k}" for k, v in counts.items())]


def run_ocr(store: Store, args, stop: threading.Event, tell=print) -> list[str]:
    """Runs the provider over what is pending; an interrupt ends it at once, with what has been read by then stored."""
    arguments.concurrency(args.j)
    begin, make = time.time(), provider(args)
    jobs = store.write("jobs", enrich.jobs(store.load(), args.redo))
    jobs = store.write("numbered", with_ids(jobs, ["content_id"], F.lit(0)).withColumnRenamed("id", "n"))
    try:
        results = enrich.in_waves(jobs, store.work("results"), make, store.stored, tell, stop, args.j)
        done = enrich.progress(results, jobs.count(), time.time() - begin).first()
    finally:
        store.forget("jobs", "numbered", "results")
    return [f"{done.succeeded} succeeded, {done.failed} failed, {done.skipped} skipped" + ", stopped" * stop.is_set()]


def provider(args):
    """What makes the provider: the function that was named, or OCR over HTTP with the key of $LEAFQUARRY_OCR_KEY."""
    module, _, name = args.provider.partition(":")
    if name:
        return getattr(importlib.import_module(module), name)
    url, model, key = args.url or os.environ.get("LEAFQUARRY_OCR_URL"), args.model or os.environ.get("LEAFQUARRY_OCR_MODEL"), os.environ.get("LEAFQUARRY_OCR_KEY")
    if not (url and model and key):
        raise ValueError("give --provider, or a URL, a model and the key in $LEAFQUARRY_OCR_KEY")
    return lambda: HttpOcr(url, key, model, ANNOTATION)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask=input) -> int:
    args = parser().parse_args(argv)
    needs_config = args.database is None or (args.command == "sweep" and not args.paths)
    try:
        cfg = config.load(args.config) if needs_config else config.Config()
        spark = spark or SparkSession.builder.appName("leafquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        store = Store(spark, config.database_path(args.database, cfg))
        for line in command(store, args, cfg, ask):
            print(line)
    except (ValueError, LookupError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def command(store: Store, args, cfg: config.Config, ask=input):
    if args.command == "sweep":
        return run_sweep(store, args, cfg, ask)
    catalog = store.load()
    if args.command == "cost":
        return [sinks.cost_text(catalog.cost(args.redo), args.redo)]
    if args.command == "ocr":
        stop = threading.Event()
        if threading.current_thread() is threading.main_thread():
            before = signal.signal(signal.SIGINT, lambda *_: stop.set())
            try:
                return run_ocr(store, args, stop)
            finally:
                signal.signal(signal.SIGINT, before)
        return run_ocr(store, args, stop)
    if args.command == "find":
        if not args.query and not args.fts:
            raise ValueError("a query or --fts is needed")
        found = search.find(catalog.dealt.pages if catalog.dealt else catalog.pages, catalog.documents, catalog.contents, search.Options(" ".join(args.query), args.fts, args.mode, args.limit, args.offset, True, args.trigram), indexes=store.indexes())
        return sinks.found_json(found) if args.json else sinks.found_text(found, args.v, sys.stdout.isatty())
    if args.command == "sql":
        register(store)
        return (r[0] for r in store.spark.sql(args.statement).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator())
    if args.command == "read":
        pages = store.at_path(args.path).read(args.path, arguments.page_range(args.page, args.context, args.start, args.end))
        return [sinks.pages_json(args.path, pages)] if args.json else sinks.pages_text(args.path, pages)
    if args.action == "get":
        doc = store.at_path(args.path).by_path(args.path)
        if not doc.take(1):
            raise LookupError(f"no document {args.path}")
        return sinks.document_json(doc) if args.json else sinks.document_text(doc)
    arguments.window(args.limit, args.offset)
    docs = catalog.list(arguments.time_bound(args.after), arguments.time_bound(args.before), args.limit, args.offset)
    return sinks.document_json(docs) if args.json else sinks.documents_text(docs)


if __name__ == "__main__":
    sys.exit(main())
