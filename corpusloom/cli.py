"""Command line: search a corpus, answer JSON requests from standard input, run a batch file, bring a corpus up to date.

    python -m corpusloom.cli --data DIR --query "words to look for" [--top-k 8] [--set bm25.k1=1.2] [--config FILE]
    echo '{"query": "words"}' | python -m corpusloom.cli --data DIR --json
    python -m corpusloom.cli --data DIR --batch FILE
    python -m corpusloom.cli --corpus OUT --ingest FOLDER [--bibliography FILE] [--pattern '*.txt']
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import api, ingest
from corpusloom.plans import search as P
from corpusloom.plans.config import adapted, load, surroundings
from corpusloom.sources import files as X
from corpusloom.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    where = p.add_mutually_exclusive_group(required=True)
    where.add_argument("--data", help="folder of chunk.parquet and docmeta.parquet")
    where.add_argument("--corpus", help="folder of an ingested corpus")
    p.add_argument("--config")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a setting by its dotted name, value in JSON or as text")
    p.add_argument("--top-k", type=int)
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--query")
    what.add_argument("--json", action="store_true", help="one request from standard input")
    what.add_argument("--batch", metavar="FILE")
    what.add_argument("--ingest", metavar="FOLDER")
    p.add_argument("--bibliography", metavar="FILE")
    p.add_argument("--pattern", default="*.pdf", help="files of --ingest; plain text is read unless an extractor is injected")
    return p


def settings(args: argparse.Namespace) -> dict[str, Any]:
    over: dict[str, Any] = {"rerank.final_top_k": args.top_k, "citations.bibliography_index_path": args.bibliography}
    for item in args.set:
        key, _, value = item.partition("=")
        try:
            over[key] = json.loads(value)
        except ValueError:
            over[key] = value
    return adapted(load(args.config, over), surroundings())


def corpus_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.data:
        return P.chunk_corpus(spark, args.data)
    rows = Store(spark, args.corpus).read()
    if rows is None:
        raise FileNotFoundError(args.corpus)
    return rows


def run_ingest(spark: SparkSession, args: argparse.Namespace, cfg: dict[str, Any]) -> dict[str, Any]:
    """The folder's files against the manifest of the last time; new and changed ones are read."""
    found = X.files(spark, args.ingest, args.pattern)
    # the manifest compares .pdf names only, as the library's files are called; other patterns are filed under such a name
    named = lambda c: F.when(F.lower(c).endswith(".pdf"), c).otherwise(F.concat(c, F.lit(".pdf")))
    listing = found.select(named(F.col("path")).alias("path"), "size", F.unix_millis("mtime").cast("double").alias("mtime"))

    def read(todo: DataFrame) -> DataFrame:
        wanted = found.join(todo.select(F.col("path").alias("_p")), named(F.col("path")) == F.col("_p"), "left_semi")
        return X.pages(wanted).select(F.substring_index(named(F.col("path")), "/", -1).alias("source"), "page", "text")

    biblio = X.bibliography(spark, cfg["citations"]["bibliography_index_path"] or "/nonexistent")
    return ingest.build_corpus(spark, args.corpus, listing, read, biblio, [F.col("pos").desc()], cfg)


def main(argv: list[str] | None = None, stdin: IO[str] | None = None, stdout: IO[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0 for an answer, 1 for an error in the answer."""
    args, out = parser().parse_args(argv), stdout or sys.stdout
    cfg = settings(args)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    say = lambda x: print(json.dumps(x, indent=2 if cfg["output"]["pretty_json"] and not args.json else None, default=str), file=out)
    try:
        if args.ingest:
            if not args.corpus:
                raise ValueError("--ingest needs --corpus")
            reply: dict[str, Any] = {"success": True, **run_ingest(spark, args, cfg)}
        elif args.batch:
            rows = api.batch(*X.batch_queries(spark, args.batch), corpus_of(spark, args), cfg).orderBy("query_id", "rank").collect()
            per: dict[str, dict[str, Any]] = {}
            for r in rows:
                entry = per.setdefault(r["query_id"], {"query_id": r["query_id"], "success": r["error"] is None, "results": [], "error": r["error"]})
                if r["error"] is None:
                    entry["results"].append({k: v for k, v in r.asDict().items() if k not in ("query_id", "error")})
            reply = {"success": True, "batch_results": list(per.values()), "total_queries": len(per), "successful_queries": sum(x["success"] for x in per.values())}
        else:
            try:
                request = json.loads((stdin or sys.stdin).read()) if args.json else {"query": args.query}
            except ValueError as e:
                request = None
                reply = {"success": False, "error": f"Invalid JSON input: {e}"}
            if request is not None:
                reply = api.answer(request, corpus_of(spark, args), cfg)
    except Exception as e:
        reply = {"success": False, "error": str(e)}
    say(reply)
    return 0 if reply["success"] else 1


if __name__ == "__main__":
    sys.exit(main())
