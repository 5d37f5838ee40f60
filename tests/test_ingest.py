"""Ingest in one call, incremental builds, the store, enrichment, command line and the further runs of a search."""

import io
import json

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.functions.scoring import Query
from corpusloom.operators import enrichment as E
from corpusloom.plans import api, ingest
from corpusloom.plans import search as P
from corpusloom.plans.config import adapted, defaults, merge, surroundings
from corpusloom.runtime import shared_dir
from corpusloom.sources import files as X
from corpusloom.sources.store import Store

BIBLIO = "pdf_file string, citekey string, title string, authors array<struct<family:string,given:string>>, year int, doi string, pages struct<start:int,end:int>, pos long"
def order():
    return [F.col("pos").desc()]

TEXT = "The estuary was measured by gauges of several kinds during two winters. "


@pytest.fixture()
def biblio(spark):
    rows = [("x/A.pdf", "roe2001", "On weirs", [("Roe", "Ann")], 2001, "10.1234/weir", (10, 20), 0), (None, "doe1999", "On kilns", [("Doe", None)], 1999, "10.5555/kiln", None, 1)]
    return spark.createDataFrame(rows, BIBLIO)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "source string, page int, text string")


def test_ingest(spark, biblio):
    rows = [("a.pdf", 1, TEXT), ("a.pdf", 2, TEXT + "A hy-\nphenated word."), ("b.pdf", 1, "See 10.5555/KILN. " + TEXT * 20), ("b.pdf", 2, TEXT.upper()), ("c.pdf", 1, TEXT + "nobody knows this file"), ("a.pdf", 3, None), ("a.pdf", 4, ""), ("a.pdf", 5, "\u0001\u0002" * 20)]
    got = ingest.ingest(pages_of(spark, rows), biblio, order()).collect()
    assert {r.source for r in got} == {"a.pdf", "b.pdf"}  # c has no author
    assert {(r.source, r.citekey, r.matched, r.year) for r in got} == {("a.pdf", "roe2001", "file", 2001), ("b.pdf", "doe1999", "doi", 1999)}
    assert {r.doi for r in got} == {"10.1234/weir", "10.5555/KILN"} and any("hyphenated" in r.text for r in got)
    assert not any(r.source == "b.pdf" and r.page == 2 for r in got)  # equal but for case: the first is kept
    every = ingest.ingest(pages_of(spark, rows), biblio, order(), merge(defaults(), {"citations": {"drop_unknown": False}})).collect()
    assert {r.citekey for r in every if r.source == "c.pdf"} == {"c"}
    cache = spark.createDataFrame([("10.5555/kiln", ("Other", ["X, Y"], 1900, 3), ("Venue", "House", ["clay"], "u1"), ("u2", True), None)], "doi string, crossref struct<title:string,authors:array<string>,year:int,start_page:int>, openalex struct<venue:string,publisher:string,concepts:array<string>,oa_url:string>, unpaywall struct<oa_url:string,is_oa:boolean>, updated_at timestamp")
    b = next(r for r in ingest.ingest(pages_of(spark, rows), biblio, order(), cache=cache).collect() if r.source == "b.pdf")
    assert (b.title, b.year, b.start_page, b.venue, b.oa_url) == ("On kilns", 1999, 3, "Venue", "u2")
    assert ingest.ingest(pages_of(spark, []), biblio.limit(0), order()).count() == 0


def test_build_corpus(spark, biblio, tmp_path):
    out, asked = str(tmp_path / "corpus"), []
    texts = {"a.pdf": TEXT + "one", "b.pdf": "10.5555/kiln " + TEXT + "two"}

    def read(todo):
        names = sorted(r.path for r in todo.collect())
        asked.append(names)
        return pages_of(spark, [(n, 1, texts[n]) for n in names])

    def scan(rows):
        return spark.createDataFrame(rows, "path string, size long, mtime double")

    first = ingest.build_corpus(spark, out, scan([("a.pdf", 1, 1.0), ("b.pdf", 1, 1.0)]), read, biblio, order())
    assert first["action"] == "rebuild" and first["chunks"] == 2
    assert ingest.build_corpus(spark, out, scan([("a.pdf", 1, 1.0), ("b.pdf", 1, 1.0)]), read, biblio, order())["action"] == "reuse"
    texts |= {"a.pdf": TEXT + "changed"}
    third = ingest.build_corpus(spark, out, scan([("a.pdf", 2, 2.0)]), read, biblio, order())
    assert (third["action"], third["changed_files"], third["removed_files"]) == ("update", 1, 1)
    rows = Store(spark, out).read().collect()
    assert [(r.source, "changed" in r.text) for r in rows] == [("a.pdf", True)] and asked == [["a.pdf", "b.pdf"], ["a.pdf"]]
    cut = merge(defaults(), {"indexing": {"page_split": "sentence"}})
    assert ingest.build_corpus(spark, out, scan([("a.pdf", 2, 2.0)]), read, biblio, order(), cut)["action"] == "rebuild"
    index = ingest.build_index(spark, out)
    assert index.n == Store(spark, out).read().count() and ingest.build_index(spark, out).n == index.n
    hashes = spark.read.parquet(Store(spark, out).log()["meta"]["manifest"]).collect()
    assert [(r.path, len(r.text_hash)) for r in hashes] == [("a.pdf", 64)]
    assert json.load(open(f"{out}/diagnostics.json"))["action"] == "rebuild"


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4)
    df = lambda rows: spark.createDataFrame(rows, "source string, v int")
    assert s.read() is None
    s.commit(df([("a", 1), ("b", 1)]), df([("a", 0), ("b", 0)]), 0)
    s.commit(df([("a", 2)]), df([("a", 0)]), 1)
    s.commit(df([("a", 9)]), df([("a", 0)]), 1)  # run again: nothing
    assert {tuple(r)[:2] for r in s.read().select("source", "v").collect()} == {("a", 2), ("b", 1)}
    s.commit(df([]), df([("b", 0), ("a", 0)]), 2)
    assert s.read() is None or s.read().count() == 0


def test_enrichment(spark):
    types = "doi string, crossref struct<title:string,authors:array<string>,year:int,start_page:int>, openalex struct<venue:string,publisher:string,concepts:array<string>,oa_url:string>, unpaywall struct<oa_url:string,is_oa:boolean>, updated_at timestamp"
    cache = spark.sql("select '10.1/fresh' as doi, named_struct('title', 'Kept', 'authors', array('A'), 'year', 2000, 'start_page', 1) as crossref, null as openalex, null as unpaywall, timestamp'2024-01-01' as updated_at union all select '10.1/old', named_struct('title', 'Stale', 'authors', array('A'), 'year', 2000, 'start_page', 1), null, null, timestamp'2020-01-01'")
    cache = cache.select(*[F.col(c.split(" ", 1)[0]).cast(c.split(" ", 1)[1]) for c in types.split(", ")])

    def crossref(doi):
        return (200, json.dumps({"message": {"title": [f"T {doi}"]}})) if "old" in doi or "new" in doi else (404, None)

    asked = spark.createDataFrame([("10.1/FRESH",), ("10.1/old",), ("10.1/new",), ("10.1/none",), (None,), (" ",), ("10.1/new",)], "doi string")
    found, kept = E.enriched(asked, cache, {"crossref": crossref}, F.lit("2024-01-02").cast("timestamp"), 604_800, wait=lambda s: None)
    assert {(r.doi, r.title) for r in found.collect()} == {("10.1/fresh", "Kept"), ("10.1/old", "T 10.1/old"), ("10.1/new", "T 10.1/new")}
    assert kept.count() == 3


def test_pages_fall_back(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"x")
    found = X.files(spark, str(tmp_path))
    bad, good = "\u0001\u0002" * 30, "a page that can be read quite well"
    assert [r.text for r in X.pages(found, lambda b: [bad, good], lambda b: [good, bad]).orderBy("page").collect()] == [good, good]
    assert X.pages(found, lambda b: [bad], lambda b: [bad]).first().text.startswith("[TEXT_QUALITY_WARNING] ")
    assert X.pages(found, lambda b: [bad], lambda b: 1 / 0).first().text == bad


@pytest.fixture()
def small(spark):
    rows = [(k, k // 2, f"f{k // 2}.pdf", 1, t, "T", ["Roe, Ann"], 2001, None, None, None) for k, t in enumerate(["the kiln of clay was fired", "membranes of the estuary are thin", "a lattice of clay and glass", "weirs in the river hold water", "clay and kiln and clay"])]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, source string, page int, text string, title string, authors array<string>, year int, doi string, start_page int, citekey string")


def test_runs_with_vectors_and_passages(spark, small):
    pool = spark.createDataFrame([("a", k, k + 1, float(5 - k)) for k in range(5)], "query_id string, chunk_id long, pool_rank long, bm25 double")
    v = spark.createDataFrame([(k, [1.0, 0.0] if k == 4 else [0.0, 1.0]) for k in range(4, 5)] + [(0, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, embedding array<double>")
    order = [r.chunk_id for r in P.semantic_run(pool, v, q, 5, weight=0.1).orderBy("rank").collect()]
    assert order[0] == 4 and len(order) == 5
    assert [[x.text for x in run] for run in P.passage_queries([Query("a", "kiln"), Query("b", "x")], {"a": ["one", "two"], "b": ["three"]})] == [["kiln one"], ["kiln two"]]
    rows, sure = P.search_with_confidence(small, [Query("a", "clay kiln")], passages={"a": ["fired clay", "glass"]}, vectors=(v, q))
    assert rows.count() > 0 and sure.first().level in ("low", "medium", "high")
    assert P.search(small, []).count() == 0


def test_answers(spark, small):
    calls = []
    memo = api.Memo(lambda p: calls.append(p) or f"about {len(calls)}", model="m")
    assert memo("x") == memo("x") and len(calls) == 1
    got = api.answer({"query": "clay kiln", "config": {"llm": {"enabled": True, "n": 2, "summary": {"enabled": True, "top_k": 2}}}}, small, llm=memo)
    assert got["success"] and got["count"] == len(got["results"]) and got["confidence"]["level"] and got["summary"].startswith("about")
    assert api.summarise("q", ["x" * 100, "y" * 100], lambda p: p, max_tokens=30).count("y") == 0  # whole chunks within the bound


def test_command_line(spark, biblio, tmp_path):
    lib, out = tmp_path / "lib", str(tmp_path / "corpus")
    lib.mkdir()
    (lib / "a.txt").write_text(TEXT + "kilns and weirs\fsecond page of the text, long enough to be kept here")
    (tmp_path / "b.json").write_text(json.dumps([{"pdfFile": "a.txt.pdf", "citekey": "roe", "title": "W", "authors": [{"family": "Roe", "given": "A"}], "year": 2001}]))

    def call(*argv, stdin=""):
        said = io.StringIO()
        code = cli.main(list(argv), io.StringIO(stdin), said, spark)
        return code, json.loads(said.getvalue())

    code, made = call("--corpus", out, "--ingest", str(lib), "--pattern", "*.txt", "--bibliography", str(tmp_path / "b.json"))
    assert code == 0 and made["chunks"] == 2, made
    code, got = call("--corpus", out, "--query", "kilns", "--top-k", "1", "--set", "bm25.k1=1.2")
    assert code == 0 and got["count"] == 1 and "[@roe" in got["results"][0]["citation"]
    assert call("--corpus", out, "--json", stdin='{"query": "weirs"}')[1]["success"]
    assert call("--corpus", out, "--json", stdin="no json")[0] == 1 and call("--corpus", out, "--json", stdin='{"query": ""}')[0] == 1
    (tmp_path / "batch.json").write_text(json.dumps({"queries": ["kilns", {"no": "query"}]}))
    code, got = call("--corpus", out, "--batch", str(tmp_path / "batch.json"))
    assert code == 0 and (got["total_queries"], got["successful_queries"]) == (2, 1)


def test_surroundings_and_folder(spark):
    assert surroundings({"CODESPACES": "true"}) == "codespace" and surroundings({"CI": "1"}) == "ci"
    assert adapted(defaults(), "ci")["performance"]["api_semaphore_size"] == 2 and defaults()["performance"]["api_semaphore_size"] == 5

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        shared_dir(Cluster())
