"""Commands over a store of index tables: index, search, status, runs. Results are JSON lines; exit codes 0 (done), 1 (failed), 2 (wrong use).

    python -m noteforge.cli index --store DIR --notes PATH (--all | --note ID | --folder ID) [--folders PATH] [--tags PATH] [--force]
    python -m noteforge.cli search --store DIR QUERY [--limit N] [--retrievers bm25,tfidf]
    python -m noteforge.cli status --store DIR
    python -m noteforge.cli runs --store DIR [--id ID] [--pipeline P] [--status S] [--limit N] [--offset N]
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.operators import indexing as ix
from noteforge.operators import inverted as iv
from noteforge.operators import retrieval as rt
from noteforge.operators import runs as rn
from noteforge.operators.providers import StubProvider, create_provider
from noteforge.sources import store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="noteforge")
    sub = p.add_subparsers(dest="command", required=True)
    each = {name: sub.add_parser(name) for name in ("index", "search", "status", "runs")}
    for c in each.values():
        c.add_argument("--store", required=True)
    each["index"].add_argument("--notes", required=True)
    scope = each["index"].add_mutually_exclusive_group(required=True)
    scope.add_argument("--all", action="store_true")
    scope.add_argument("--note")
    scope.add_argument("--folder")
    each["index"].add_argument("--folders")
    each["index"].add_argument("--tags")
    each["index"].add_argument("--force", action="store_true")
    each["index"].add_argument("--provider", default="stub")
    each["search"].add_argument("query")
    each["search"].add_argument("--limit", default="10")
    each["search"].add_argument("--retrievers")
    for name in ("id", "pipeline", "status"):
        each["runs"].add_argument(f"--{name}")
    each["runs"].add_argument("--limit", type=int, default=20)
    each["runs"].add_argument("--offset", type=int, default=0)
    return p


def _tables(spark: SparkSession, folder: str) -> ix.Tables:
    held = store.load(spark, folder)
    empty = ix.empty_tables(spark)
    return ix.Tables(**{f.name: held.get(f.name, getattr(empty, f.name)) for f in fields(ix.Tables)})


def index(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    notes = spark.read.parquet(args.notes)
    folders = spark.read.parquet(args.folders) if args.folders else None
    tags = spark.read.parquet(args.tags) if args.tags else spark.createDataFrame([], "note_id string, tag_id string, title string")
    tables = _tables(spark, args.store)
    made: dict[str, ix.Tables] = {}

    def work(scope: dict, progress, cancelled) -> tuple[dict, list[str]]:
        chosen = ix.resolve_scope(notes, folders, note=args.note, folder=args.folder, everything=args.all)
        run = ix.index_notes(tables, chosen, notes, tags, F.localtimestamp(), everything=args.all, force=args.force, provider=create_provider(args.provider))
        made["tables"] = run.tables
        progress(run.processed, run.processed + run.skipped)
        return {"processed": run.processed, "skipped": run.skipped, "chunks": run.chunks}, [run.error] if run.error else []

    runner = rn.Runner({"structural": work})
    run = runner.runs[runner.enqueue("structural", {"note": args.note, "folder": args.folder, "all": args.all}, "cli")]
    runner.work()
    log = runner.log(spark)
    old = store.load(spark, args.store).get("runs")
    new = {f.name: getattr(made["tables"], f.name) for f in fields(ix.Tables)} if made else {}
    store.save(spark, args.store, {**new, "runs": log if old is None else old.unionByName(log)})
    if made:
        iv.sync(spark, _inverted(args.store), _tables(spark, args.store).chunks)
    if run.status != "success":
        raise RuntimeError("; ".join(run.errors))
    return [{"id": run.id, "status": run.status, **run.counts}]


def _inverted(folder: str) -> str:
    """Where the inverted index of a store lies."""
    return f"{folder.rstrip('/')}/inverted"


def search(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    limit = rt.check_query(args.query, args.limit)
    t = _tables(spark, args.store)
    vector = [float(x) for x in StubProvider().embeddings([args.query])[0]]
    asked = spark.createDataFrame([(0, args.query, vector)], "query_id long, query string, vector array<float>")
    corpus = rt.Corpus(t.chunks, t.snapshot.select("note_id", "title"), t.vectors, t.nodes, t.edges, iv.load(spark, _inverted(args.store)))
    wanted = [r.strip() for r in args.retrievers.split(",")] if args.retrievers else None
    if wanted and (unknown := set(wanted) - set(rt.RETRIEVERS)):
        raise ValueError(f"unknown retrievers: {', '.join(sorted(unknown))}")
    hits = rt.retrieve(asked, corpus, requested=wanted, limit=limit).withColumnRenamed("rank", "place")
    return _rows(rt.search_rows(rt.with_texts(hits, corpus)).orderBy("place").drop("query_id"))


def status(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    t, runs = _tables(spark, args.store), store.load(spark, args.store).get("runs")
    counts = {f.name: getattr(t, f.name).count() for f in fields(ix.Tables)}
    states = {r[0]: r[1] for r in t.state.groupBy("structural_status").count().collect()}
    return [{"version": store.current(spark, args.store), "tables": counts, "states": states, "last_run": None if runs is None else next(iter(_rows(rn.last_run(runs))), None)}]


def runs(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    log = store.load(spark, args.store).get("runs")
    if log is None:
        return []
    if args.id is not None:
        found = _rows(rn.run_by_id(log, args.id))
        if not found:
            raise LookupError(f"no run {args.id}")
        return found
    return _rows(rn.history(log, args.pipeline, args.status, args.limit, args.offset))


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # a page of results


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("noteforge").getOrCreate()
    try:
        for row in {"index": index, "search": search, "status": status, "runs": runs}[args.command](spark, args):
            print(json.dumps(row, default=str, ensure_ascii=False))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(str(e)[:1000], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    began = time.time()
    code = main()
    print(f"{time.time() - began:.1f} s", file=sys.stderr)
    sys.exit(code)
