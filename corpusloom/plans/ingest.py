"""Ingest: pages in, a searchable corpus with metadata out; the whole of it or what changed since the last time."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import index as I
from corpusloom.operators import metadata as M
from corpusloom.plans.config import chunking_hash, defaults
from corpusloom.runtime import materialise
from corpusloom.sources import files as X
from corpusloom.sources.store import Store

ORDER = ("source", "page", "chunk_ord")


def documents_of(pages: DataFrame) -> DataFrame:
    """(source, sniffed_doi): one row per file, the doi looked for in its first two pages."""
    first = pages.where(F.col("page") <= 2).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("_p"))  # two pages a file
    sniffed = first.select("source", T.find_doi(F.array_join(F.transform("_p", lambda x: x["text"]), " ")).alias("sniffed_doi"))
    return pages.select("source").distinct().join(sniffed, "source", "left")


def ingest(pages: DataFrame, biblio: DataFrame, order: list, cfg: dict[str, Any] | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Chunks (chunk_id, doc_id, source, page, chunk_ord, text, and the metadata fields) of pages (source, page, text).

    Clean, mark what can't be read, look for a doi, describe each file by bibliography and services, drop files without author
    or year if so set, cut readable pages, keep the first of equal chunks, give citekeys. biblio and order: the bibliography
    and which of its rows counts for a key. doc_id and chunk_id are hashes of the file and of the place in it: they stay
    the same when other files are added. Null texts and files without readable pages give no chunk."""
    cfg = cfg or defaults()
    i, c = cfg["indexing"], cfg["citations"]
    # the engine whose results are matched doesn't read the setting of the share of readable characters
    least = i["min_readable_ratio"] if cfg.get("mode") == "intended" else 0.7
    clean = T.cleaned_pages(pages.select("source", "page", "text"), least) if i["text_quality_check"] or cfg.get("mode") != "intended" else T.clean_text(pages.select("source", "page", "text"), "text")
    clean = materialise(clean, "clean")
    about = M.described(documents_of(clean), biblio, order, cache, c["prefer_bibliography"])
    about = materialise(M.with_citekeys(about.withColumn("doc_id", F.xxhash64("source")), "source"), "documents")
    if c["drop_unknown"]:
        about = M.known_only(about)
    # whole files are dropped before their pages are cut
    kept = clean.join(about.select("source"), "source", "left_semi")
    cut = T.chunks_of_pages(kept, i["page_split"], i["window_chars"], i["overlap_chars"], min_readable=least)
    cut = cut.withColumn("chunk_id", F.xxhash64("source", "page", "chunk_ord"))
    single = M.deduplicate(cut, ORDER)
    return single.join(about.drop("sniffed_doi"), "source").select("chunk_id", "doc_id", "source", "page", "chunk_ord", "text", "matched", *M.FIELDS)


def decide(cached: dict[str, Any] | None, diff: DataFrame, chunking: str) -> str:
    """'reuse' if nothing changed, 'rebuild' if there is no corpus or chunks are cut otherwise now, else 'update'."""
    if not cached or cached.get("chunking_config_hash") != chunking:
        return "rebuild"
    return "reuse" if diff.where(F.col("change") != "unchanged").isEmpty() else "update"


def build_corpus(spark: SparkSession, out: str, manifest: DataFrame, read_pages: Callable[[DataFrame], DataFrame], biblio: DataFrame, order: list, cfg: dict[str, Any] | None = None, cache: DataFrame | None = None) -> dict[str, Any]:
    """Brings the corpus below out up to date with manifest (path, size, mtime) and returns the diagnostics. read_pages gives
    (source, page, text) of files (path): only new and changed ones are read. Removed files' chunks go. The manifest, the
    progress and the diagnostics lie beside the corpus."""
    cfg = cfg or defaults()
    store = Store(spark, out)
    log = store.log()
    chunking = chunking_hash(cfg["indexing"])
    before = spark.read.parquet(log["meta"]["manifest"]) if log["meta"].get("manifest") else X.empty(spark, "path string, size long, mtime double, text_hash string")
    diff = materialise(M.manifest_diff(before, manifest), "diff")
    counts = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
    what = decide(log["meta"], diff, chunking)
    report: dict[str, Any] = {"action": what, **{f"{k}_files": counts.get(k, 0) for k in ("new", "changed", "removed", "unchanged")}}

    def progress(phase: str, done: int, total: int) -> None:
        store.write_text(f"{out}/progress.json", json.dumps({"phase": phase, "current": done, "total": total, "percent": round(100 * done / total, 1) if total else 0}))

    if what == "reuse":
        return report
    files = diff if what == "rebuild" else diff.where("change != 'unchanged'")
    touched = files.select(M.base_name(F.col("path")).alias("source"))
    if what == "rebuild" and (old := store.read()) is not None:
        touched = touched.unionByName(old.select("source")).distinct()
    todo = files.where("change != 'removed'").select("path")
    progress("ingest", 0, counts.get("new", 0) + counts.get("changed", 0))
    chunks = materialise(ingest(read_pages(todo), biblio, order, cfg, cache), "chunks")
    seen = chunks.groupBy("source").agg(F.first("matched").alias("m")).groupBy("m").agg(F.count("*").alias("n")).collect()
    report |= {"matched_files": sum(r["n"] for r in seen if r["m"] != "none"), "chunks": chunks.count()}
    # one hash per file, of its chunks' hashes in order
    place = f"{out}/manifest-{log['commit'] + 1}"
    hashed = file_hashes(chunks, ORDER).withColumnRenamed("sha256", "_hash")
    kept = manifest.select("path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), M.base_name(F.col("path")).alias("source")).join(hashed, "source", "left")
    kept.join(before.select("path", F.col("text_hash").alias("_old")), "path", "left").select("path", "size", "mtime", F.coalesce("_hash", "_old").alias("text_hash")).write.mode("overwrite").parquet(place)
    store.commit(chunks, touched, meta={"chunking_config_hash": chunking, "manifest": place})
    progress("done", report["chunks"], report["chunks"])
    store.write_text(f"{out}/diagnostics.json", json.dumps(report, sort_keys=True))
    return report


def file_hashes(chunks: DataFrame, order: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(source, sha256) of each file over its chunks and their places: a sum of the chunks' hashes, so it is combined before the
    shuffle and no file is gathered. Null texts don't count."""
    own = F.sha2(F.concat_ws("/", *[F.col(c).cast("string") for c in order], F.sha2("text", 256)), 256)
    number = F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(38,0)")
    per = chunks.where(F.col("text").isNotNull()).groupBy("source").agg(F.sum(number).alias("_sum"), F.count("*").alias("_n"))
    return per.select("source", F.sha2(F.concat(F.col("_sum").cast("string"), F.lit(":"), F.col("_n").cast("string")), 256).alias("sha256"))


def build_index(spark: SparkSession, out: str, cfg: dict[str, Any] | None = None) -> I.Index:
    """The index of the corpus below out: loaded where it was saved for the newest commit and the same tokens, else built anew."""
    cfg = cfg or defaults()
    store = Store(spark, out)
    n, pattern = store.log()["commit"], cfg["bm25"]["token_pattern"]
    path = f"{out}/index-{n}-{chunking_hash({'pattern': pattern})[:12]}"
    if X.exists(spark, f"{path}/stats/_SUCCESS"):
        return I.Index.load(spark, path)
    rows = store.read()
    if rows is None:
        rows = X.empty(spark, "chunk_id long, text string")
    I.build(rows.select("chunk_id", "text"), pattern).save(path)
    return I.Index.load(spark, path)
