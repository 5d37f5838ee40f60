"""Index, ranking, metadata, sources, streaming and the search itself."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.scoring import Query
from corpusloom.operators import index as I
from corpusloom.operators import metadata as M
from corpusloom.operators import ranking as R
from corpusloom.operators.components import connected_components
from corpusloom.operators.vectors import nearest
from corpusloom.plans import api, config
from corpusloom.plans import search as P
from corpusloom.sources import files as X

CORPUS = "chunk_id long, doc_id long, source string, page int, chunk_ord int, text string, title string, authors array<string>, year int, doi string, start_page int, citekey string"


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["Machine learning is a field of artificial intelligence research.", "Deep learning uses neural networks with many layers.", "Natural language processing handles human language.", "Computer vision handles images and video.", "", "machine learning machine learning"]
    rows = [(i, i % 3, f"f{i % 3}.pdf", 1 + i, 0, t, f"T{i}", ["Smith, Anna", "Roe, Bo"][: i % 3], 2000 + i if i else None, None, 10 if i == 1 else None, "key" if i == 1 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CORPUS)


def test_bm25_formula(spark, corpus):
    q = [Query("a", "learning machine")]
    got = {r.chunk_id: r.bm25 for r in I.bm25(I.build(corpus), I.query_terms(spark, q), 1.4, 0.75).collect()}
    from corpusloom.functions.scoring import query_tokens

    docs = {r.chunk_id: query_tokens(r.text) for r in corpus.collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    for i, d in docs.items():
        want = sum((idf[t] if idf[t] >= 0 else floor) * d.count(t) * 2.4 / (d.count(t) + 1.4 * (0.25 + 0.75 * len(d) / avg)) for t in ("learning", "machine") if t in d)
        assert got.get(i, 0.0) == pytest.approx(want)


def test_search(spark, corpus, tmp_path):
    rows = P.search(corpus, [Query("a", "machine learning"), Query("b", "?!"), Query("c", "")]).collect()
    a = [r for r in rows if r.query_id == "a"]
    assert a[0].chunk_id in (0, 5) and [r.rank for r in a] == list(range(1, len(a) + 1))
    assert max(sum(r.doc_id == d for r in a) for d in range(3)) <= 2
    assert {r.query_id for r in rows} == {"a", "b", "c"}
    assert P.search(corpus.limit(0), [Query("a", "x")]).count() == 0
    cited = {r.chunk_id: (r.citation, r.pandoc) for r in rows}
    assert all(c == "[@key, p. 11]" for i, (c, _) in cited.items() if i == 1)
    prf = config.merge(config.defaults(), {"prf": {"enabled": True}, "rerank": {"final_top_k": 2}})
    assert len(P.search(corpus, [Query("a", "machine learning")], prf).collect()) == 2
    ix = I.build(corpus)
    ix.save(str(tmp_path / "ix"))
    again = P.search(corpus, [Query("a", "machine learning")], index=I.Index.load(spark, str(tmp_path / "ix"))).collect()
    assert [(r.chunk_id, r.score) for r in again] == [(r.chunk_id, r.score) for r in a]


def runs(spark, lists):
    return spark.createDataFrame([("q", k, c, r) for k, xs in enumerate(lists) for r, c in enumerate(xs, 1)], "query_id string, run_id long, chunk_id long, rank long")


def test_rrf(spark):
    got = R.rrf_fuse(runs(spark, [[0, 1, 2], [1, 0, 2], [2, 1, 0]]), 10, 3).orderBy("fused_pos")
    assert [r.chunk_id for r in got.collect()] == [1, 0, 2]


def greedy(cands, penalty, most, k):
    left, used, out = list(cands), {}, []
    while left and len(out) < k:
        best = max(left, key=lambda c: (c[2] - penalty * used.get(c[1], 0), -c[3]))
        out.append(best[0])
        used[best[1]] = used.get(best[1], 0) + 1
        left = [c for c in left if c[0] != best[0] and used.get(c[1], 0) < max(most, 1)]
    return out


def test_diversity_closed_form(spark):
    rng = random.Random(4)
    for penalty, most, k in ((0.3, 2, 8), (0.5, 1, 3), (0.0, 3, 5)):
        rows, want = [], {}
        for q in range(40):
            cands = [(i, rng.randrange(5), rng.choice([0.5, 1.0, 1.3, rng.random()]), i + 1) for i in range(20)]
            rows += [(f"{q}", *c) for c in cands]
            want[f"{q}"] = greedy(cands, penalty, most, k)
        df = spark.createDataFrame(rows, "query_id string, chunk_id long, doc long, score double, fused_pos long")
        got = R.diversity_select(df, "doc", penalty=penalty, max_per_doc=most, k=k).collect()
        for q, w in want.items():
            assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.selected_rank)] == w


def test_onepass_mmr(spark):
    df = spark.createDataFrame([("q", i, 0, s, i + 1) for i, s in enumerate([0.9, 0.85, 0.8])], "query_id string, chunk_id long, doc long, score double, pool_rank long")
    assert R.diversity_onepass(df, "doc", max_per_doc=1).count() == 1
    assert R.mmr_pick({"a"}, [], [], 0.7, 5) == [] and R.mmr_pick({"a"}, [{"a"}], [1.0], 0.7, 1) == [0]
    assert R.mmr_pick({"a", "b"}, [{"a"}, {"a"}, {"b"}], [1.0, 0.9, 0.1], 0.5, 2) == [0, 2]


@pytest.mark.parametrize("scores,lists,k,level,stability", [([10, 5, 2, 1, 1, 1, 1], [[0, 1, 2], [0, 1, 2]], 3, "high", 1.0), ([1.0] * 10, [[0, 1], [2, 3]], 2, "low", 0.0), ([5, 4, 1, 1, 1], [[0, 1, 2], [0, 1, 3]], 3, "medium", 0.5)])
def test_confidence(spark, scores, lists, k, level, stability):
    pool = spark.createDataFrame([("q", i + 1, float(s)) for i, s in enumerate(scores)], "query_id string, pool_rank long, score double")
    r = R.confidence(pool, runs(spark, lists), k).first()
    assert (r.level, r.stability) == (level, stability)


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(200, 200 + k) for k in range(1, 30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, None), (9, 9)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in list(parent)}
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    assert {r.node: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_vectors(spark):
    rng = random.Random(2)
    v = [(i, [rng.random() for _ in range(4)]) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = nearest(df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), df, 3, block=2).collect()
    for q in (0, 20, 40):
        dot = sorted(((-sum(a * b for a, b in zip(v[q][1], x[1])), x[0]) for x in v if x[1]))[:3]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in dot]


def test_citations(spark):
    df = spark.createDataFrame([(["Smith, A"], 2020, 3, None), (["Smith, A", "Roe, B"], None, 3, 10), ([], None, 3, None), (None, 2020, 0, None)], "a array<string>, y int, p int, s int")
    got = [r[0] for r in df.select(M.author_date_citation(F.col("a"), F.col("y"), F.col("p"), F.col("s"))).collect()]
    assert got == ["(Smith, 2020, p. 3)", "(Smith et al., n.d., p. 12)", "(Unknown, n.d., p. 3)", "(Unknown, 2020)"]


def test_citekeys(spark):
    df = spark.createDataFrame([("smith_a.pdf", 1), ("smith_b.pdf", 2), ("smith_c.pdf", 3), ("roe.pdf", 4)], "source string, o long")
    assert {r.source: r.citekey for r in M.unique_citekeys(df, "o").collect()} == {"smith_a.pdf": "smith", "smith_b.pdf": "smith-a", "smith_c.pdf": "smith-b", "roe.pdf": "roe"}


def test_manifest_and_dedup(spark):
    s = "path string, size long, mtime long"
    a = spark.createDataFrame([("a/x.pdf", 1, 1), ("a/y.pdf", 1, 1), ("a/z.pdf", 1, 1), ("__meta__", 1, 1)], s)
    b = spark.createDataFrame([("a/x.pdf", 1, 1), ("a/y.pdf", 2, 1), ("a/w.pdf", 1, 1), ("n.txt", 1, 1)], s)
    diff = M.manifest_diff(a, b)
    assert {r.path: r.change for r in diff.collect()} == {"a/x.pdf": "unchanged", "a/y.pdf": "changed", "a/z.pdf": "removed", "a/w.pdf": "new"}
    cached = spark.createDataFrame([(1, "x.pdf"), (2, "y.pdf"), (3, "z.pdf")], "chunk_id long, source string")
    new = spark.createDataFrame([(4, "y.pdf")], "chunk_id long, source string")
    assert sorted(r.chunk_id for r in M.merge_corpus(cached, new, diff).collect()) == [1, 4]
    d = spark.createDataFrame([(1, "Hello World"), (2, "hello world!"), (3, "Unique"), (4, None), (5, "...")], "chunk_id long, text string")
    assert sorted(r.chunk_id for r in M.deduplicate(d).collect()) == [1, 3]


def test_services(spark):
    payload = json.dumps({"message": {"title": ["A"], "issued": {"date-parts": [[2001]]}, "published-print": {"date-parts": [[1999, 2]]}, "page": "12-15", "author": [{"family": "Roe", "given": "B"}, {"given": "C"}, {}]}})
    r = spark.createDataFrame([(payload,)], "p string").select(X.crossref_record(F.col("p")).alias("r")).first().r
    assert (r.title, r.year, r.start_page, r.authors) == ("A", 1999, 12, ["Roe, B", "C"])
    payload = json.dumps({"concepts": [{"display_name": "x", "level": 3, "score": 0.2}, {"display_name": "y", "level": 1, "score": 0.9}], "primary_location": {"source": {"display_name": "V"}, "pdf_url": "u"}})
    r = spark.createDataFrame([(payload,)], "p string").select(X.openalex_record(F.col("p")).alias("r")).first().r
    assert (r.venue, r.concepts, r.oa_url) == ("V", ["y"], "u")
    tried = spark.createDataFrame([("a",), ("b",), ("a",)], "doi string")
    got = {r.doi: r.payload for r in X.fetch(tried, "doi", lambda k: (200, k * 2) if k == "a" else (503, None), wait=lambda s: None).collect()}
    assert got == {"a": "aa", "b": None}


def test_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first page of text\fsecond page")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "two.txt").write_text("x")
    found = X.files(spark, str(tmp_path), "*.txt")
    assert [(r.page, r.text) for r in X.pages(found).orderBy("page").collect()] == [(1, "first page of text"), (2, "second page")]
    assert X.pages(found, lambda b: 1 / 0).count() == 0
    assert X.html_pages(b"<p>Hi</p><script>x</script><p>there</p>") == ["Hi\nthere"]
    (tmp_path / "m.json").write_text(json.dumps({"a.pdf": {"size": 1, "mtime": 2.5}, "__meta__": {}, "b.txt": {}}))
    assert [tuple(r) for r in X.manifest(spark, str(tmp_path / "m.json")).collect()] == [("a.pdf", 1, 2.5, None)]
    assert X.manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "b.json").write_text(json.dumps([{"pdfFile": "Example.pdf", "doi": "10.1234/ABC", "year": 2000}, {"pdfFile": "Example.pdf", "year": 2001}, {"citekey": "x"}]))
    bib = X.bibliography(spark, str(tmp_path / "b.json"))
    assert [(r.key, r.year) for r in M.biblio_by_file(bib, [F.desc("pos")]).collect()] == [("example.pdf", 2001)]
    assert [r.key for r in M.biblio_by_doi(bib, [F.desc("pos")]).collect()] == ["10.1234/abc"]
    (tmp_path / "q.json").write_text(json.dumps({"queries": ["one", {"query": "two", "config": {"rerank": {"final_top_k": 1}}}, 7]}))
    good, bad = X.batch_queries(spark, str(tmp_path / "q.json"))
    assert (good.count(), bad.count()) == (2, 1)


def test_api(spark, corpus, tmp_path):
    cfg = config.defaults()
    out = api.answer({"query": "machine learning"}, corpus, cfg)
    assert out["success"] and out["count"] == len(out["results"]) and {"text", "citation", "source", "pandoc", "score"} == set(out["results"][0])
    assert cfg == config.defaults()
    assert not api.answer({"query": " "}, corpus)["success"] and not api.answer([], corpus)["success"]
    assert api.answer({"type": "summary", "query": "q", "chunks": ["a"]}, corpus, llm=lambda p: " two  words ")["summary"] == "two words"
    good = spark.createDataFrame([("0", "machine learning", "{}"), ("1", "vision", '{"rerank": {"final_top_k": 1}}')], "query_id string, query string, config string")
    bad = spark.createDataFrame([("2", "Invalid query format")], "query_id string, error string")
    got = api.batch(good, bad, corpus).collect()
    assert sum(r.query_id == "1" for r in got) == 1 and sum(r.error is not None for r in got) == 1


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"bm25": {"k1": 2.0}}')
    cfg = config.load(str(tmp_path / "c.json"), {"bm25.b": 0.5, "prf.enabled": None}, {"RAG_RERANK_FINAL_TOP_K": "3", "RAG_PRF_ENABLED": "yes"})
    assert (cfg["bm25"]["k1"], cfg["bm25"]["b"], cfg["rerank"]["final_top_k"], cfg["prf"]["enabled"]) == (2.0, 0.5, 3, True)
    assert config.chunking_hash(None) == config.chunking_hash({}) != config.chunking_hash({"a": 1})


def test_stream(spark, tmp_path):
    from corpusloom.streaming import corpus as live

    schema = live.PAGE
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        live.keep_current(live.page_stream(spark, src), out, str(tmp_path / "ck")).awaitTermination()
        return {(r.source, r.text) for r in live.current(spark, out).collect()}

    assert len(arrive([("a", 1, "The first page is readable text.", 1), ("b", 1, "Another page of readable words.", 1)])) == 2
    after = arrive([("a", 1, "The first page was changed since.", 2)])
    assert after == {("a", "The first page was changed since."), ("b", "Another page of readable words.")}


def test_plan_shape(spark, corpus):
    ix = I.build(corpus)
    plan = I.bm25(ix, I.query_terms(spark, [Query("a", "machine")]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan
