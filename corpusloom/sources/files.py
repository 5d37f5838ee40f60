"""Files as tables: discovery, pages, bibliography, manifests, reply caches, batch queries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.constants import QUALITY_WARNING
from corpusloom.functions.text import readable

META = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("year", T.IntegerType()), T.StructField("doi", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("start_page", T.IntegerType()), T.StructField("end_page", T.IntegerType()), T.StructField("citekey", T.StringType()),
    T.StructField("venue", T.StringType()), T.StructField("publisher", T.StringType()), T.StructField("concepts", T.ArrayType(T.StringType())), T.StructField("oa_url", T.StringType()),
])
CHUNK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("meta", META)])
BIBLIO = "pdfFile string, citekey string, title string, authors array<struct<family:string,given:string>>, year int, doi string, pages struct<start:int,end:int>"
MANIFEST = "path string, size long, mtime double, text_hash string"


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, size, mtime, content) of matching files, the folder itself only unless recursive."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select(F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def pages(found: DataFrame, *extract: Callable[[bytes], list[str]], min_readable: float = 0.7) -> DataFrame:
    """(path, page from 1, text) by extractors of a file's bytes, run where the file is read. A page that the first one can't
    make readable is taken from the next that can; where none can, its text gets the quality warning, unless one of them
    failed on the file. A file the first extractor fails on, or that is empty, has no page. The default reads text files,
    form feeds between pages."""
    first, *others = extract or (plain_text_pages,)

    def of(content: bytes) -> list[str]:
        texts = first(content)
        bad = [k for k, t in enumerate(texts) if t.strip() and not readable(t, min_readable)]
        failed = False
        for other in others:
            if not bad:
                break
            try:
                again = other(content)
            except Exception:
                failed = True
                break
            for k in list(bad):
                if k < len(again) and readable(again[k], min_readable):
                    texts[k] = again[k]
                    bad.remove(k)
        if others and not failed:
            for k in bad:
                texts[k] = QUALITY_WARNING + texts[k]
        return texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    texts = of(content) if content else []
                except Exception:
                    texts = []
                rows += [(path, k, t) for k, t in enumerate(texts, 1)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["path", "page", "text"])

    return found.select("path", "content").mapInArrow(run, "path string, page int, text string")


def plain_text_pages(content: bytes) -> list[str]:
    return content.decode("utf-8", "replace").split("\f")


def html_pages(content: bytes) -> list[str]:
    """The text of an HTML file as one page."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0
            self.out.append("\n" if tag in ("p", "div", "br", "li", "h1", "h2", "h3", "tr") else "")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    r = Reader()
    r.feed(content.decode("utf-8", "replace"))
    return ["".join(r.out).strip()]


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of references with their position `pos`; a missing or broken file is an empty table."""
    schema = T._parse_datatype_string(BIBLIO)
    if not exists(spark, path):
        return empty(spark, T.StructType([*schema.fields, T.StructField("pos", T.LongType())])).select(F.col("pdfFile").alias("pdf_file"), *[f.name for f in schema.fields[1:]], "pos")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).json(path)
    kept = rows.withColumn("pos", F.monotonically_increasing_id()).where(F.col("_corrupt_record").isNull())
    return kept.select(F.col("pdfFile").alias("pdf_file"), *[f.name for f in schema.fields[1:]], "pos")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime, text_hash) of a manifest in the old form {"files": [...]} or the new {path: {...}}; keys that start
    with __ and names other than .pdf are left out; missing or broken is empty. A manifest is one small JSON document."""
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path).collect())
        read = json.loads(text)
    except Exception:
        return empty(spark, MANIFEST)
    entries = [(f["path"], f) for f in read["files"]] if isinstance(read.get("files"), list) else list(read.items())
    rows = [(p, int(f["size"]) if f.get("size") is not None else None, float(f["mtime"]) if f.get("mtime") is not None else None, f.get("text_hash")) for p, f in entries if isinstance(f, dict) and not p.startswith("__") and p.lower().endswith(".pdf")]
    return spark.createDataFrame(rows, MANIFEST)


def reply_cache(spark: SparkSession, path: str) -> DataFrame:
    """(doi, crossref, openalex, unpaywall, updated_at) of a reply cache in parquet, or of the older JSON document {doi: {...}};
    missing is empty."""
    schema = f"crossref struct<title:string,authors:array<string>,year:int,start_page:int>, openalex struct<venue:string,publisher:string,concepts:array<string>,oa_url:string>, unpaywall struct<oa_url:string,is_oa:boolean>, updated_at timestamp"
    if not exists(spark, path):
        return empty(spark, f"doi string, {schema}")
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("doi", "_reply"))
    return entries.select(F.lower("doi").alias("doi"), F.from_json("_reply", schema).alias("r")).select("doi", "r.*")


def cached_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a parquet corpus or of the older gzipped JSON lines; missing is empty."""
    if not exists(spark, path):
        return empty(spark, CHUNK)
    return spark.read.schema(CHUNK).json(path) if ".jsonl" in path else spark.read.parquet(path)


def batch_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries (query_id, query, config JSON), errors (query_id, error)) of {"queries": [text or {"query", "config"}]}."""
    read = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
    good, bad = [], []
    for k, q in enumerate(read.get("queries", [])):
        if isinstance(q, str):
            good.append((f"{k}", q, "{}"))
        elif isinstance(q, dict) and isinstance(q.get("query"), str):
            good.append((f"{k}", q["query"], json.dumps(q.get("config") or {}, sort_keys=True)))
        else:
            bad.append((f"{k}", "Invalid query format"))
    return spark.createDataFrame(good, "query_id string, query string, config string"), spark.createDataFrame(bad, "query_id string, error string")


def collections(found: DataFrame, root: str) -> DataFrame:
    """(id, name, folder, files): the root and its folders that hold files, hidden ones left out."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    last = F.regexp_extract(folder, "([^/]*)$", 1)
    own = F.lit(root.rstrip("/"))
    seen = found.withColumn("folder", folder).where(~F.startswith(last, F.lit(".")))
    name = F.when(F.endswith(F.col("folder"), own), F.lit("All documents")).otherwise(F.initcap(F.replace(last, F.lit("_"), F.lit(" "))))
    return seen.groupBy("folder", last.alias("id"), name.alias("name")).agg(F.count("*").alias("files")).select("id", "name", "folder", "files")


# -- payloads of citation services -------------------------------------------------------------------------------------

_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = f"message struct<title:array<string>,`published-print`:{_DATE},online:{_DATE},`published-online`:{_DATE},issued:{_DATE},page:string,author:array<struct<family:string,given:string>>>"
OPENALEX = "host_venue struct<display_name:string,publisher:string>, concepts array<struct<display_name:string,level:int,score:double>>, open_access struct<oa_url:string>, primary_location struct<source:struct<display_name:string>,pdf_url:string>"
UNPAYWALL = "is_oa boolean, best_oa_location struct<url_for_pdf:string>"


def crossref_record(payload: Column) -> Column:
    """struct(title, authors, year, start_page); the year is that of print, else online, else issue."""
    m = F.from_json(payload, CROSSREF)["message"]
    year = F.coalesce(*[F.get(F.get(m[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "online", "issued")])
    names = F.filter(F.transform(F.coalesce(m["author"], F.array()), lambda a: F.concat_ws(", ", F.nullif(a["family"], F.lit("")), F.nullif(a["given"], F.lit("")))), lambda x: x != "")
    return F.struct(F.get(m["title"], F.lit(0)).alias("title"), names.alias("authors"), year.alias("year"), F.nullif(F.regexp_extract(F.coalesce(m["page"], F.lit("")), r"^\s*(\d+)", 1), F.lit("")).cast("int").alias("start_page"))


def openalex_record(payload: Column) -> Column:
    """struct(venue, publisher, concepts, oa_url); concepts of level 2 at most and score 0.3 at least."""
    p = F.from_json(payload, OPENALEX)
    concepts = F.transform(F.filter(F.coalesce(p["concepts"], F.array()), lambda c: (c["level"] <= 2) & (c["score"] >= 0.3) & c["display_name"].isNotNull()), lambda c: c["display_name"])
    return F.struct(F.coalesce(p["host_venue"]["display_name"], p["primary_location"]["source"]["display_name"]).alias("venue"), p["host_venue"]["publisher"].alias("publisher"), concepts.alias("concepts"), F.coalesce(p["open_access"]["oa_url"], p["primary_location"]["pdf_url"]).alias("oa_url"))


def unpaywall_record(payload: Column) -> Column:
    p = F.from_json(payload, UNPAYWALL)
    return F.struct(p["best_oa_location"]["url_for_pdf"].alias("oa_url"), F.coalesce(p["is_oa"], F.lit(False)).alias("is_oa"))


def fetch(keys: DataFrame, key: str, get: Callable[[str], tuple[int, str | None]], at_once: int = 5, tries: int = 3, wait: Callable[[float], None] | None = None) -> DataFrame:
    """(key, payload) from an injected fetcher returning (status, body); at_once tasks bound the requests under way. 429, 5xx and
    exceptions are tried again after 1, 2, … seconds; other failures give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        pause = wait or time.sleep
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                body = None
                for n in range(tries):
                    try:
                        status, text = get(k)
                    except Exception:
                        status, text = 599, None
                    if status == 200:
                        body = text
                    if status != 429 and status < 500:
                        break
                    if n + 1 < tries:
                        pause(2.0**n)
                out.append(body)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], [key, "payload"])

    return keys.select(key).distinct().repartition(at_once).mapInArrow(run, f"`{key}` string, payload string")
