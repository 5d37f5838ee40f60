"""The engine's operators as named queries over the test tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.functions.scoring import Query
from corpusloom.operators import enrichment as E
from corpusloom.operators import index as I
from corpusloom.operators import metadata as M
from corpusloom.operators import ranking as R
from corpusloom.operators.vectors import nearest
from corpusloom.plans import ingest as N
from corpusloom.plans import search as P
from corpusloom.plans.config import defaults
from corpusloom.runtime import materialise, spread
from corpusloom.runtime import table as stored
from corpusloom.sources import files as X

QUERIES_TYPED = [Query("q1", "thermal membrane of the synthetic estuary"), Query("q2", "archival lattice & porous kiln?"), Query("q3", "zzzz unseen")]
QUOTE = Query("q4", "Earlier work revealed the resilient loom")
NOW = "2024-01-01 00:00:00"


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    """The tables of long texts over all cores, the others as they are stored."""
    df = stored(s, d, name)
    return spread(df) if name in ("chunk", "documents") else df


def _chunk(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "chunk").where(F.col("text").isNotNull() & (F.col("text") != ""))


def _rounded(c, name: str, n: int = 6):
    return F.round(c, n).alias(name)


def tokenize_terms(s, d):
    t = T.tokenize(F.col("text"))
    return _table(s, d, "chunk").select("chunk_id", F.size(t).cast("long").alias("n_terms"), F.array_join(t, " ").alias("terms"))


def rerank_tokens(s, d):
    t = T.rerank_tokens(F.col("text"))
    return _table(s, d, "chunk").select("chunk_id", F.array_join(t, " ").alias("tokens"))


def term_freq(s, d):
    return I.term_frequencies(_chunk(s, d))


def doc_freq_idf(s, d):
    return I.build(_chunk(s, d)).terms.select("term", "df", _rounded("idf", "idf"))


def bm25_topk(s, d):
    return _bm25(s, d, QUERIES_TYPED[:1]).drop("query_id")


def bm25_batch_topk(s, d):
    return _bm25(s, d, QUERIES_TYPED)


def _bm25(s, d, queries):
    c = _chunk(s, d)
    scores = I.bm25(I.build(c), I.query_terms(s, queries))
    dense = I.for_every_query(c.select("chunk_id"), queries).join(scores, ["query_id", "chunk_id"], "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 6))
    return I.top(dense, "bm25", 10).select("query_id", "rank", "chunk_id", "bm25")


def proximity_bonus(s, d):
    return _chunk(s, d).select("chunk_id", _rounded(S.proximity_bonus(T.words(F.col("text")), S.strings(QUERIES_TYPED[0].tokens), 30), "bonus"))


def ngram_bonus(s, d):
    return _chunk(s, d).select("chunk_id", _rounded(S.ngram_bonus(S.flat(F.col("text")), Query("", "percent of the roughly metres wide sites").grams), "bonus"))


def pattern_bonus(s, d):
    return _chunk(s, d).select("chunk_id", _rounded(S.pattern_bonus(F.col("text")), "bonus"))


def metadata_bonus(s, d):
    return P.chunk_corpus(s, d).select("chunk_id", _rounded(S.metadata_bonus(F.col("text"), F.col("title")), "bonus"))


def gibberish_penalty(s, d):
    return _chunk(s, d).select("chunk_id", _rounded(S.gibberish_penalty(F.col("text"), S.flat(F.col("text")), 0.02), "factor"))


def fuzzy_match(s, d):
    return _chunk(s, d).select("chunk_id", _rounded(S.fuzzy_match_bonus(S.flat(F.col("text")), QUOTE.quote), "bonus"))


def _pool(s, d, queries=None):
    queries = queries or [*QUERIES_TYPED, QUOTE]
    c = P.chunk_corpus(s, d)
    scored = P.baseline(c, queries, I.bm25(I.build(c), I.query_terms(s, queries)), defaults())
    top = materialise(P.pool_of(scored.withColumn("score", F.round("score", 6)), 200), "top")
    return materialise(P.pool_with_text(c, top), "pool"), queries


def baseline_pool(s, d):
    return _pool(s, d)[0].select("query_id", F.col("pool_rank").alias("rank"), "chunk_id", "score")


def heuristic_run(s, d):
    pool, q = _pool(s, d)
    return R.heuristic_run(pool, q, 150).select("query_id", "rank", "chunk_id")


def robust_run(s, d):
    pool, q = _pool(s, d)
    changed = [x.query_id for x in q if S.robustify(x.text) != x.text.strip().lower()]
    part = pool.where(F.col("query_id").isin(changed)).withColumn("bm25", F.round("bm25", 6))
    return R.run_of(part, 5, [F.desc("bm25"), F.col("pool_rank")]).select("query_id", "rank", "chunk_id")


def rm3_terms(s, d):
    c = _chunk(s, d).select("chunk_id", "text")
    return I.rm3_terms(I.build(c), c, QUERIES_TYPED[:2])


def _runs(s, d):
    pool, q = _pool(s, d)
    return pool, P.build_runs(pool.withColumn("bm25", F.round("bm25", 6)), q, defaults())


def rrf_fusion(s, d):
    _, runs = _runs(s, d)
    return R.rrf_fuse(runs, 75, 200).select("query_id", "chunk_id", _rounded("rrf", "rrf"))


def _selected(s, d):
    pool, runs = _runs(s, d)
    fused = R.rrf_fuse(runs, 75, 200).select("query_id", "chunk_id", "fused_pos")
    return R.diversity_select(pool.join(fused, ["query_id", "chunk_id"]), "doc_id")


def diversity_select(s, d):
    return _selected(s, d).select("query_id", F.col("selected_rank").alias("rank"), "chunk_id", "doc_id", _rounded("adjusted", "adjusted"))


def diversity_onepass(s, d):
    pool, _ = _pool(s, d)
    return R.diversity_onepass(pool, "source").select("query_id", F.col("selected_rank").alias("rank"), "chunk_id", _rounded("adjusted", "adjusted"))


def mmr_select(s, d):
    pool, q = _pool(s, d)
    tokens = F.array_distinct(T.rerank_tokens(F.col("text")))
    own = R._per_query(q, lambda x: S.strings(x.rerank))
    return R.mmr_select(pool.withColumn("tokens", tokens), own)


def confidence(s, d):
    pool, runs = _runs(s, d)
    return R.confidence(pool, runs)


def flagship_search(s, d):
    c = P.chunk_corpus(s, d)
    return P.search(c, [*QUERIES_TYPED, QUOTE]).select("query_id", "rank", "chunk_id", "score", "file", "page", "doi", "title", "citation", "pandoc", "text")


def snippet(s, d):
    return _table(s, d, "chunk").select("chunk_id", T.snippet(F.col("text"), 120).alias("snippet"))


def dedup_chunks(s, d):
    return M.deduplicate(_table(s, d, "chunk").select("chunk_id", "text")).select("chunk_id")


def text_hash(s, d):
    return _table(s, d, "chunk").select("chunk_id", T.text_hash(F.col("text")).alias("sha256"))


def quality_filter(s, d):
    return _table(s, d, "chunk").where(T.quality_good(F.col("text"))).select("chunk_id")


def clean_text(s, d):
    return T.clean_text(_table(s, d, "chunk").select("chunk_id", "text"), "text")


def sentence_split(s, d):
    return _chunk(s, d).select("chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("chunk_id", F.col("pos").cast("long").alias("pos"), "sentence")


def sliding_chunks(s, d):
    pages = _table(s, d, "documents").select("doc_id", "source", "page", "text")
    return T.chunks_of_pages(pages).select("doc_id", "page", F.col("chunk_ord").cast("long").alias("chunk_ord"), "text")


def doi_extract(s, d):
    return _chunk(s, d).select("chunk_id", T.find_doi(F.col("text")).alias("doi"))


def citation_strings(s, d):
    c = P.chunk_corpus(s, d)
    a = (F.col("page"), F.col("start_page"))
    return c.select("chunk_id", M.author_date_citation(F.col("authors"), F.col("year"), *a).alias("citation"), M.pandoc_citation(F.col("citekey"), *a).alias("pandoc"))


def citekeys(s, d):
    files = _table(s, d, "docmeta").groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    return M.unique_citekeys(files, "first_doc")


def _order():
    """The export has no row numbers; its last row is stood for by the greatest year, citekey, title and doi."""
    return [F.col(c).desc_nulls_last() for c in ("year", "citekey", "title", "doi", "pdf_file")]


def biblio_by_file(s, d):
    b = M.biblio_by_file(_table(s, d, "biblio"), _order())
    return b.select("key", "citekey", "title", F.col("year").cast("string").alias("year"), "doi")


def biblio_by_doi(s, d):
    b = M.biblio_by_doi(_table(s, d, "biblio"), _order())
    return b.select("key", "citekey", "title", F.col("year").cast("string").alias("year"), "pdf_file")


def biblio_authors(s, d):
    b = M.biblio_by_file(_table(s, d, "biblio"), _order())
    return b.select("key", F.array_join(M.names(F.col("authors")), "; ").alias("authors"))


def _docs(s, d):
    return _table(s, d, "docmeta").select("doc_id", "source", F.col("doi").alias("sniffed_doi"))


def biblio_enrich(s, d):
    b = _table(s, d, "biblio")
    out = M.enrich(_docs(s, d), M.biblio_by_file(b, _order()), M.biblio_by_doi(b, _order()))
    return out.select("doc_id", "matched", "biblio_citekey", F.col("biblio_year").cast("string").alias("biblio_year"), "biblio_doi")


def biblio_fill(s, d):
    docs = _table(s, d, "docmeta").select("doc_id", "source", "title", "year", "doi", "citekey")
    return M.fill_blanks(docs, M.biblio_by_file(_table(s, d, "biblio"), _order())).select("doc_id", "title", F.col("year").cast("string").alias("year"), "doi", "citekey")


def doi_collection(s, d):
    """The doi is looked for in the texts of a paper's first two pages."""
    rows = P.chunk_corpus(s, d).withColumn("_n", F.dense_rank().over(Window.partitionBy("doc_id", "source").orderBy("page"))).where("_n <= 2")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "chunk_id", "text"))), lambda x: x["text"]), " ")
    return M.collected_doi(rows.groupBy("doc_id", "source").agg(text.alias("text")), M.biblio_by_file(_table(s, d, "biblio"), _order()))


def doi_cache_upsert(s, d):
    c = M.latest_replies(_table(s, d, "doi_cache"))
    return c.select("doi", F.col("crossref").isNotNull().alias("has_crossref"), F.col("openalex").isNotNull().alias("has_openalex"), F.col("unpaywall").isNotNull().alias("has_unpaywall"), F.unix_micros("updated_at").alias("updated_us"))


def doi_cache_fresh(s, d):
    c = M.latest_replies(_table(s, d, "doi_cache"))
    return c.select("doi", M.fresh(F.col("updated_at"), F.lit(NOW).cast("timestamp"), 200 * 86_400).alias("fresh"))


def metadata_merge(s, d):
    m = M.merged_metadata(M.latest_replies(_table(s, d, "doi_cache")))
    return m.select("doi", "title", F.col("year").cast("string").alias("year"), "venue", "oa_url")


def _stand_in(doi: str) -> tuple[int, str | None]:
    return 200, json.dumps({"message": {"title": [f"Work {doi}"], "issued": {"date-parts": [[2020]]}}})


def enriched_meta(s, d):
    """Every paper's doi asked for: fresh replies from the cache, the others from a stand-in of the first service."""
    now = F.lit(NOW).cast("timestamp")
    found, _ = E.enriched(_table(s, d, "docmeta").select("doi"), _table(s, d, "doi_cache"), {"crossref": _stand_in}, now, 200 * 86_400)
    return found.select("doi", F.startswith(F.coalesce("title", F.lit("")), F.concat(F.lit("Work "), F.col("doi"))).alias("fetched"))


def citekey_propagation(s, d):
    return M.propagated_citekey(_table(s, d, "docmeta").select("doc_id", "source", "citekey"), "doc_id").select("doc_id", "citekey")


def drop_unknown(s, d):
    return M.known_only(_table(s, d, "docmeta")).select("doc_id")


def _scans(s, d):
    m = _table(s, d, "manifest")
    cut = m.agg((F.min(F.unix_micros("scanned_at")) + (F.max(F.unix_micros("scanned_at")) - F.min(F.unix_micros("scanned_at"))) / 2).cast("long").alias("c")).first()["c"]
    return M.latest_scan(m, F.timestamp_micros(F.lit(cut))), M.latest_scan(m, F.timestamp_micros(F.lit(2**52)))


def manifest_diff(s, d):
    return M.manifest_diff(*_scans(s, d))


def incremental_merge(s, d):
    """The older half of the scans against the younger: files seen in both, in the second alone or no more. The chunks of the
    first half's files are cached; new and changed files are read again."""
    m = _table(s, d, "manifest")
    at = F.unix_micros("scanned_at")
    cut = m.agg((F.min(at) + (F.max(at) - F.min(at)) / 2).cast("long").alias("c")).first()["c"]
    first, second = M.latest_scan(m.where(at <= cut), F.timestamp_micros(F.lit(2**52))), M.latest_scan(m.where(at > cut), F.timestamp_micros(F.lit(2**52)))
    chunks, diff = _table(s, d, "chunk").select("chunk_id", "source"), M.manifest_diff(first, second)
    cached = M.filter_by_files(chunks, diff.where("change != 'new'")).withColumn("origin", F.lit("cached"))
    new = M.filter_by_files(chunks, diff.where("change in ('new', 'changed')")).withColumn("origin", F.lit("read"))
    return M.merge_corpus(cached, new, diff).select("chunk_id", "source", "origin")


def ingest_documents(s, d):
    """Each file as the ingest describes it: doi of its first pages, bibliography, services, citekey; known ones only."""
    pages = _table(s, d, "chunk").select("source", "page", F.coalesce("text", F.lit("")).alias("text"))
    about = M.with_citekeys(M.described(N.documents_of(pages), _table(s, d, "biblio"), _order(), _table(s, d, "doi_cache")), "source")
    return M.known_only(about).select("source", "matched", "title", F.array_join("authors", "; ").alias("authors"), F.col("year").cast("string").alias("year"), "doi", "citekey", "venue", "oa_url")


def ingest_corpus(s, d):
    """The whole ingest in one call, a chunk of the table as a page's text."""
    pages = _table(s, d, "chunk").select("source", F.col("chunk_id").alias("page"), "text")
    return N.ingest(pages, _table(s, d, "biblio"), _order(), defaults(), _table(s, d, "doi_cache")).select("source", "page", F.col("chunk_ord").cast("long").alias("chunk_ord"), "citekey", "text")


def collections(s, d):
    found = _table(s, d, "manifest").where(F.lower("path").endswith(".pdf")).select("path").distinct()
    return X.collections(found, "/nowhere").select("id", "name", "folder", "files")


def file_text_hash(s, d):
    return N.file_hashes(_table(s, d, "chunk"))


def corpus_diagnostics(s, d):
    c = _table(s, d, "chunk")
    return c.agg(F.count("*").alias("chunks"), F.count_if(F.col("text").isNull()).alias("no_text"), F.countDistinct("source").alias("files"), F.count_if(F.length("text") < 20).alias("stubs"), F.sum(F.length("text")).alias("characters"))


def api_json_parse(s, d):
    """The replies of the cache as the service sends them, read back."""
    c = _table(s, d, "doi_cache").where(F.col("crossref").isNotNull() & F.col("doi").isNotNull())
    dates = F.when(F.col("crossref.year").isNotNull(), F.struct(F.array(F.array("crossref.year")).alias("date-parts")))
    pages = F.concat(F.col("crossref.start_page").cast("string"), F.lit("-999"))
    sent = F.to_json(F.struct(F.struct(F.when(F.col("crossref.title").isNotNull(), F.array("crossref.title")).alias("title"), dates.alias("issued"), pages.alias("page")).alias("message")))
    r = X.crossref_record(sent)
    return c.select("doi", r["title"].alias("title"), r["year"].cast("string").alias("year"), r["start_page"].cast("string").alias("start_page"))


def final_sort(s, d):
    """The pool's rows in the order results are shown in."""
    pool, _ = _pool(s, d)
    rows = pool.withColumn("file", F.col("source"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(*R.final_order(), "chunk_id")).cast("long")
    return rows.withColumn("rank", order).select("query_id", "chunk_id", "rank")


def semantic_run(s, d):
    """Chunks that have a vector of their number, and one vector for each query."""
    pool, q = _pool(s, d)
    e = _table(s, d, "embeddings")
    asked = e.where(F.col("vec_id").between(1, len(q))).select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), "embedding")
    return P.semantic_run(pool.withColumn("bm25", F.round("bm25", 6)), e.withColumnRenamed("vec_id", "chunk_id"), asked, 80).select("query_id", "rank", "chunk_id")


PASSAGES = {"q1": ["the membrane of an estuary is thermal", "synthetic membranes were measured in the estuary"], "q2": ["one answer only"]}


def multi_passage_run(s, d):
    """A run for each hypothetical answer of the queries that have more than one."""
    pool, q = _pool(s, d)
    c = _chunk(s, d)
    index = I.build(c)
    extra = [(10 + n, I.bm25(index, I.query_terms(s, qs)).withColumn("bm25", F.round("bm25", 6))) for n, qs in enumerate(P.passage_queries(q, PASSAGES))]
    return P.build_runs(pool, q, defaults(), extra).where("run_id >= 10").select("query_id", "run_id", "rank", "chunk_id")


def vector_topk(s, d):
    e = _table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(q, e, 10).select("query_id", "rank", "vec_id", _rounded("score", "score", 5))


def tfidf_cosine(s, d):
    docs = _table(s, d, "docmeta").where(F.col("title").isNotNull()).select(F.col("doc_id").alias("chunk_id"), F.col("title").alias("text"))
    v = materialise(I.tfidf_vectors(docs), "tfidf")
    return I.sparse_cosine(v, 1).select("chunk_id", _rounded("cosine", "cosine"))


def normalised_vectors(s, d):
    n = S.normalised(F.transform("embedding", lambda x: x * F.lit(3.0)))
    return _table(s, d, "embeddings").select("vec_id", _rounded(F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x), "norm", 4))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
