"""The JSON surface: single requests, batches, summaries; everything here handles a few rows or settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scoring import Query
from corpusloom.operators import index as I
from corpusloom.operators import ranking as R
from corpusloom.plans import search as P
from corpusloom.plans.config import defaults, merge
from corpusloom.runtime import scratch

TYPES = ("query", "summary", "collections", "config")


def validate(request: Any) -> str | None:
    """What is wrong with a request, None if nothing."""
    if not isinstance(request, dict):
        return "Input must be a JSON object"
    kind = request.get("type", "query")
    if kind not in TYPES:
        return f"Unknown request type: {kind}"
    if kind == "query" and not isinstance(request.get("query"), str):
        return "Missing required field: query"
    if kind == "query" and not request["query"].strip():
        return "Query cannot be empty"
    if kind == "summary" and not (isinstance(request.get("query"), str) and isinstance(request.get("chunks"), list)):
        return "Summary requests need query and chunks"
    if request.get("config") is not None and not isinstance(request["config"], dict):
        return "Config must be an object"
    return None


def result_rows(found: DataFrame, cfg: dict[str, Any]) -> list[dict[str, Any]]:
    """The at most final_top_k rows of one query as they are shown."""
    cols = [F.col("text"), F.col("citation"), F.struct("file", "page", "doi", "title", "citekey").alias("source")]
    cols += [F.col("pandoc")] * cfg["citations"]["include_pandoc_cite"] + [R.python_round3("score").alias("score")] * cfg["output"]["include_scores"]
    return [json.loads(r["j"]) for r in found.orderBy("rank").select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("j")).collect()]


class Memo:
    """Replies of an injected model by everything they depend on, so that an equal question is asked once."""

    def __init__(self, ask: Callable[[str], str], **about: Any) -> None:
        self.ask, self.about, self.known = ask, json.dumps(about, sort_keys=True), {}

    def __call__(self, prompt: str) -> str:
        key = (self.about, prompt)
        if key not in self.known:
            self.known[key] = self.ask(prompt)
        return self.known[key]


def answer(request: dict[str, Any], corpus: DataFrame, base: dict[str, Any] | None = None, index: I.Index | None = None, listing: DataFrame | None = None, llm: Callable[[str], str] | None = None, vectors: DataFrame | None = None, encode: Callable[[str], list[float]] | None = None) -> dict[str, Any]:
    """The response envelope {success, query, results, count, confidence, …} or {success: false, error}; never raises. llm: an
    injected model; vectors (chunk_id, embedding) and encode: what the semantic run needs. Tables written for one answer are
    deleted at its end."""
    wrong = validate(request)
    if wrong:
        return {"success": False, "error": wrong}
    try:
        cfg = merge(base or defaults(), request.get("config"))
        kind = request.get("type", "query")
        if kind == "config":
            return {"success": True, "config": cfg}
        if kind == "collections":
            rows = [r.asDict() for r in listing.orderBy("id").collect()] if listing is not None else []
            return {"success": True, "collections": rows, "count": len(rows)}
        if kind == "summary":
            return {"success": True, "query": request["query"], "summary": summarise(request["query"], request["chunks"], llm, cfg["llm"]["summary"]["max_tokens"])}
        return found(request["query"], corpus, cfg, index, llm, vectors, encode)
    except Exception as e:
        return {"success": False, "query": request.get("query"), "error": str(e)}


def found(text: str, corpus: DataFrame, cfg: dict[str, Any], index: I.Index | None = None, llm: Callable[[str], str] | None = None, vectors: DataFrame | None = None, encode: Callable[[str], list[float]] | None = None) -> dict[str, Any]:
    """One query's answer: hypothetical answers widen the BM25 query and rank runs of their own, the semantic run takes part if
    it is set and there are vectors, and a summary is made of the first rows if it is set."""
    spark, language = corpus.sparkSession, cfg["llm"]
    passages = hypothetical(text, llm, language["n"]) if language["enabled"] and llm is not None else []
    wide = " ".join([text, *passages]) if language["use_for_bm25"] else text
    pair = None
    if cfg["rerank"]["semantic"]["enabled"] and vectors is not None and encode is not None:
        asked = " ".join([text, *passages]) if language.get("use_for_semantic") else text
        pair = (vectors, spark.createDataFrame([("0", [float(x) for x in encode(asked)])], "query_id string, embedding array<double>"))
    summary, wanted = language["summary"], cfg["rerank"]["final_top_k"]
    depth = max(wanted, summary["top_k"]) if summary["enabled"] and llm is not None else wanted
    with scratch():
        rows, sure = P.search_with_confidence(corpus, [Query("0", wide)], merge(cfg, {"rerank": {"final_top_k": depth}}), index, pair, {"0": passages})
        shown = result_rows(rows, cfg)
        level = [r.asDict() for r in sure.drop("query_id").collect()]
    out = {"success": True, "query": text, "results": shown[:wanted], "count": len(shown[:wanted]), "confidence": level[0] if level else {}}
    if summary["enabled"] and llm is not None:
        out["summary"] = summarise(text, [r["text"] for r in shown[: summary["top_k"]]], llm, summary["max_tokens"])
    return out


def hypothetical(query: str, llm: Callable[[str], str], n: int) -> list[str]:
    """Up to n hypothetical answers of an injected model; its failures end them."""
    answers = []
    for k in range(n):
        try:
            answers.append(llm(f"Write passage {k + 1} that answers: {query}"))
        except Exception:
            break
    return [a for a in answers if a]


def expanded(query: str, llm: Callable[[str], str], n: int) -> str:
    """The query with its hypothetical answers appended."""
    return " ".join([query, *hypothetical(query, llm, n)])


def summarise(query: str, chunks: list[str], llm: Callable[[str], str] | None, max_tokens: int = 10_000) -> str | None:
    """A summary of whole chunks, as many as fit into max_tokens (a token counted as four characters); None without a model."""
    if llm is None or not chunks:
        return None
    kept, room = [], 4 * max_tokens
    for c in map(str, chunks):
        room -= len(c)
        if kept and room < 0:
            break
        kept.append(c)
    return " ".join(llm(f"Summarise for {query}: " + "\n".join(kept)).split())


def batch(queries: DataFrame, errors: DataFrame, corpus: DataFrame, base: dict[str, Any] | None = None) -> DataFrame:
    """Results of typed queries, one plan for all queries of equal settings: search()'s columns and `error` for invalid ones."""
    out = None
    index = I.build(corpus)
    groups: dict[str, list[Query]] = {}
    for r in queries.orderBy("query_id").collect():  # as many as were typed
        groups.setdefault(r["config"], []).append(Query(r["query_id"], r["query"]))
    for config, qs in groups.items():
        found = P.search(corpus, qs, merge(base or defaults(), json.loads(config)), index).withColumn("error", F.lit(None).cast("string"))
        out = found if out is None else out.unionByName(found)
    bad = errors.select("query_id", "error")
    return bad if out is None else out.unionByName(bad, allowMissingColumns=True)
