"""The search: BM25 and bonuses, candidate pool, ranked runs, fusion, diversity, citations; one plan for all queries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions.scoring import Query
from corpusloom.functions.text import snippet
from corpusloom.operators import index as I
from corpusloom.operators import ranking as R
from corpusloom.operators.metadata import author_date_citation, pandoc_citation
from corpusloom.operators.vectors import nearest
from corpusloom.plans.config import defaults
from corpusloom.runtime import materialise, spread, table


def chunk_corpus(spark, d: str) -> DataFrame:
    """Chunks that have text with their paper's metadata."""
    meta = table(spark, d, "docmeta").select("doc_id", "title", "authors", "year", "doi", "start_page", "citekey")
    chunk = spread(table(spark, d, "chunk")).where(F.col("text").isNotNull() & (F.col("text") != "")).select("chunk_id", "doc_id", "source", "page", "chunk_ord", "text")
    return chunk.join(meta, "doc_id", "left")


def baseline(corpus: DataFrame, queries: list[Query], scores: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """(query_id, chunk_id, bm25, score) of every chunk and query, in this order of additions: BM25, proximity, n-grams, patterns,
    metadata, gibberish factor, quotation. The text is read once where it lies; only numbers meet the BM25 scores."""
    text, ws = F.col("text"), F.col("_words")
    own = corpus.select("chunk_id", "text", "title").withColumn("_flat", S.flat(text)).withColumn("_words", F.when(F.col("_flat") == "", S.strings([])).otherwise(F.split("_flat", " ")))
    p, n = cfg["bonuses"]["proximity"], cfg["bonuses"]["ngram"]
    zero = F.lit(0.0)

    def of(q: Query) -> Column:
        near = F.lit(float(p["weight"])) * S.proximity_bonus(ws, S.strings(q.tokens), p["window"]) if p["enabled"] and p["weight"] > 0 and p["window"] > 0 else zero
        grams = F.lit(float(n["weight"])) * S.ngram_bonus(F.col("_flat"), q.grams) if n["enabled"] and n["weight"] > 0 else zero
        return F.struct(near.alias("near"), grams.alias("grams"), (2.0 * S.fuzzy_match_bonus(F.col("_flat"), q.quote)).alias("quote"))

    # what doesn't depend on the query is computed once per chunk, before chunks are paired with queries; the pairs stay in
    # their task, and nothing but numbers leaves it
    own = own.withColumns({"_pattern": S.pattern_bonus(text), "_meta": S.metadata_bonus(text, F.col("title")), "_penalty": S.gibberish_penalty(text, F.col("_flat"))})
    dense = I.for_every_query(own, queries).select("query_id", "chunk_id", "_pattern", "_meta", "_penalty", R._per_query(queries, of).alias("_q")).select("query_id", "chunk_id", "_pattern", "_meta", "_penalty", "_q.*")
    joined = dense.join(scores, ["query_id", "chunk_id"], "left").withColumn("bm25", F.coalesce("bm25", zero))
    s = F.col("bm25") + F.col("near") + F.col("grams") + F.col("_pattern") + F.col("_meta")
    s = F.when(F.col("_penalty") < 1, s * F.col("_penalty")).otherwise(s)
    return joined.select("query_id", "chunk_id", "bm25", (s + F.col("quote")).alias("score"))


def pool_with_text(corpus: DataFrame, pool: DataFrame) -> DataFrame:
    """The pool's few rows (pool_size a query) with their chunks: the pool goes to the corpus if its size, known by then, allows."""
    return corpus.join(pool, "chunk_id")


def pool_of(scored: DataFrame, size: int) -> DataFrame:
    return I.top(scored, "score", size).withColumnRenamed("rank", "pool_rank")


def semantic_run(pool: DataFrame, vectors: DataFrame, query_vectors: DataFrame, topn: int, weight: float = 0.7) -> DataFrame:
    """The first topn of the pool by weight * BM25 scaled to 0..1 + (1 - weight) * cosine. vectors: (chunk_id, embedding);
    query_vectors: (query_id, embedding). A chunk or query without a vector has cosine 0."""
    head = pool.where(F.col("pool_rank") <= topn).select("query_id", "chunk_id", "pool_rank", "bm25")
    met = head.join(vectors.select("chunk_id", F.col("embedding").alias("_v")), "chunk_id", "left").join(query_vectors.select("query_id", F.col("embedding").alias("_q")), "query_id", "left")
    cos = F.when(F.col("_v").isNotNull() & F.col("_q").isNotNull(), S.cosine(F.col("_v"), F.col("_q"))).otherwise(0.0)
    scored = met.select("query_id", "chunk_id", "pool_rank", (weight * R.minmax("bm25") + (1 - weight) * cos).alias("_semantic"))
    return R.run_of(scored, 4, [F.desc("_semantic"), F.col("pool_rank")])


def passage_queries(queries: list[Query], passages: dict[str, list[str]], most: int = 3) -> list[list[Query]]:
    """Of each query with more than one hypothetical answer the first few: the query with one answer appended, a run each."""
    runs = []
    for k in range(most):
        grown = [Query(q.query_id, f"{q.text} {ps[k]}") for q in queries if len(ps := passages.get(q.query_id, [])) > 1 and k < len(ps)]
        if grown:
            runs.append(grown)
    return runs


def build_runs(pool: DataFrame, queries: list[Query], cfg: dict[str, Any], extra: list[tuple[int, DataFrame]] = (), vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Baseline, further BM25 scores of the pool (run_id, scores), heuristic, semantic, robust query. vectors: of chunks and of
    queries; without them the semantic run is the head of the baseline. A run of some queries only ranks these."""
    runs = R.run_of(pool, 1, [F.col("pool_rank")])
    for run_id, scores in extra:
        asked = scores.select("query_id").distinct()
        scored = pool.join(asked, "query_id", "left_semi").join(scores.withColumnRenamed("bm25", "_other"), ["query_id", "chunk_id"], "left")
        runs = runs.unionByName(R.run_of(scored, run_id, [F.desc(F.coalesce("_other", F.lit(0.0))), F.col("pool_rank")]))
    h, s = cfg["rerank"]["heuristic"], cfg["rerank"]["semantic"]
    if h["enabled"]:
        runs = runs.unionByName(R.heuristic_run(pool, queries, h["topn"], 3, alpha=h["alpha"], beta=h["beta"], gamma=h["gamma"]))
    if vectors is not None:
        runs = runs.unionByName(semantic_run(pool, *vectors, s["topn"]))
    elif s["enabled"]:  # without an encoder this run is the head of the baseline
        runs = runs.unionByName(R.run_of(pool, 4, [F.col("pool_rank")], s["topn"]))
    if cfg["fusion"]["robust_query"]["enabled"]:
        changed = [q.query_id for q in queries if S.robustify(q.text) != q.text.strip().lower()]
        if changed:
            runs = runs.unionByName(R.run_of(pool.where(F.col("query_id").isin(changed)), 5, [F.desc("bm25"), F.col("pool_rank")]))
    return runs


def search(corpus: DataFrame, queries: list[Query], cfg: dict[str, Any] | None = None, index: I.Index | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, passages: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, doc_id, score, file, page, doi, title, citekey, citation, pandoc, text), at most final_top_k
    rows a query. Queries without a usable word rank by the bonuses alone; an empty corpus or no query gives no row."""
    return search_with_confidence(corpus, queries, cfg, index, vectors, passages)[0]


def search_with_confidence(corpus: DataFrame, queries: list[Query], cfg: dict[str, Any] | None = None, index: I.Index | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, passages: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(search's rows, (query_id, level, score, spread, stability)). vectors: (chunk_id, embedding) and (query_id, embedding)
    tables for the semantic run; with rerank.semantic.ann the pool is first cut to the nearest of these. passages: hypothetical
    answers by query; more than one gives a run each."""
    cfg = cfg or defaults()
    spark = corpus.sparkSession
    index = index or I.build(corpus, cfg["bm25"]["token_pattern"])
    asked, queries = bool(queries), queries or [Query("", "")]
    k1, b, k = cfg["bm25"]["k1"], cfg["bm25"]["b"], cfg["rerank"]["final_top_k"]
    terms = I.query_terms(spark, queries)
    extra: list[tuple[int, DataFrame]] = []
    if cfg["prf"]["enabled"]:
        grown = I.rm3_terms(index, corpus, queries, cfg["prf"]["fb_docs"], cfg["prf"]["fb_terms"], k1, b).select("query_id", "term", F.lit(1).cast("long").alias("qtf"))
        terms = terms.unionByName(grown)
        extra = [(2, I.bm25(index, terms, k1, b))]
    for n, grown_queries in enumerate(passage_queries(queries, passages or {})):
        extra.append((10 + n, I.bm25(index, I.query_terms(spark, grown_queries), k1, b)))
    # the corpus is scored once; every run reads the few hundred rows of the pool
    top = materialise(pool_of(baseline(corpus, queries, I.bm25(index, terms, k1, b), cfg), cfg["bm25"]["pool_size"]), "top")
    pool = materialise(pool_with_text(corpus, top), "pool")
    ann = cfg["rerank"]["semantic"]["ann"]
    if vectors is not None and ann["enabled"]:
        near = nearest(vectors[1], vectors[0].withColumnRenamed("chunk_id", "vec_id"), ann["topn"]).select("query_id", F.col("vec_id").alias("chunk_id"))
        vectors = (vectors[0].join(near.select("chunk_id").distinct(), "chunk_id", "left_semi"), vectors[1])
    runs = build_runs(pool, queries, cfg, extra, vectors)
    rrf = cfg["fusion"]["rrf"]
    fused = R.rrf_fuse(runs, rrf["C"], rrf["cap"]) if rrf["enabled"] else pool.select("query_id", "chunk_id", F.col("pool_rank").alias("fused_pos"))
    candidates = pool.join(fused, ["query_id", "chunk_id"])
    v = cfg["diversity"]
    if v["enabled"]:
        chosen = R.diversity_select(candidates, "doc_id", "score", "fused_pos", v["per_doc_penalty"], v["max_per_doc"], k)
        chosen = chosen.where(F.col("selected_rank") <= 20) if v["mmr"]["enabled"] else chosen
    else:
        chosen = candidates.where(F.col("fused_pos") <= k)
    return presented(chosen, cfg).where(F.lit(asked)), R.confidence(pool, runs, k).where(F.lit(asked))


def presented(chosen: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    c = cfg["citations"]
    pandoc = pandoc_citation(F.col("citekey"), F.col("page"), F.col("start_page"))
    dated = author_date_citation(F.col("authors"), F.col("year"), F.col("page"), F.col("start_page"))
    citation = F.coalesce(pandoc, dated) if c["pandoc_as_primary"] and c["include_pandoc_cite"] else dated
    shown = F.round("score", 6) if cfg["output"]["include_scores"] else F.lit(0.0)
    rows = chosen.select("query_id", "chunk_id", "doc_id", shown.alias("score"), F.col("source").alias("file"), F.col("page").cast("long").alias("page"), "doi", "title", "citekey", citation.alias("citation"), pandoc.alias("pandoc"), snippet(F.col("text"), cfg["output"]["max_snippet_chars"]).alias("text"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*R.final_order(), "chunk_id")).cast("long")
    return rows.withColumn("rank", rank)
