"""Bibliography, citation services, citations, citekeys and corpus maintenance as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import dedup_key, fallback_citekey, find_doi


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def last_by(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The last row of each key; rows without a key are left out."""
    keyed = df.withColumn("key", key).where(F.col("key").isNotNull() & (F.col("key") != ""))
    w = Window.partitionBy("key").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def biblio_by_file(biblio: DataFrame, order: list[Column]) -> DataFrame:
    """Keyed by the lower-cased base name of the file; of several rows the last one (first in `order`) counts."""
    return last_by(biblio, F.lower(base_name(F.col("pdf_file"))), order)


def biblio_by_doi(biblio: DataFrame, order: list[Column]) -> DataFrame:
    return last_by(biblio, F.lower("doi"), order)


def names(authors: Column) -> Column:
    """'Family, Given' of structs; parts that are missing are left out."""
    full = F.transform(authors, lambda a: F.concat_ws(", ", F.nullif(F.trim(a["family"]), F.lit("")), F.nullif(F.trim(a["given"]), F.lit(""))))
    return F.filter(full, lambda x: x != "")


def enrich(docs: DataFrame, by_file: DataFrame, by_doi: DataFrame) -> DataFrame:
    """docs (source, sniffed_doi, …) with the bibliography's record by file name, else by doi: matched ('file', 'doi' or
    'none'), biblio_title, biblio_year, biblio_citekey, biblio_doi. A match by doi keeps the spelling that was sniffed."""
    cols = ["title", "year", "citekey", "doi"]
    f = by_file.select(F.col("key").alias("_fk"), F.struct(*cols).alias("_f"))
    d = by_doi.select(F.col("key").alias("_dk"), F.struct(*cols).alias("_d"))
    both = docs.join(f, F.lower(base_name(F.col("source"))) == F.col("_fk"), "left").join(d, F.lower("sniffed_doi") == F.col("_dk"), "left")
    pick = lambda c: F.when(F.col("_fk").isNotNull(), F.col(f"_f.{c}")).when(F.col("_dk").isNotNull(), F.col(f"_d.{c}") if c != "doi" else F.col("sniffed_doi"))
    matched = F.when(F.col("_fk").isNotNull(), "file").when(F.col("_dk").isNotNull(), "doi").otherwise("none")
    return both.select(*docs.columns, matched.alias("matched"), *[pick(c).alias(f"biblio_{c}") for c in cols])


FIELDS = ("title", "authors", "year", "doi", "start_page", "end_page", "citekey", "venue", "publisher", "concepts", "oa_url")


def described(docs: DataFrame, biblio: DataFrame, order: list[Column], cache: DataFrame | None = None, prefer_bibliography: bool = True) -> DataFrame:
    """docs (source, sniffed_doi, …) with all of FIELDS and `matched`: the bibliography's record by file name, else by doi, as a
    whole (a match by doi keeps the spelling that was sniffed), then what the services know where that has blanks, and the
    services' extras. Without prefer_bibliography the services alone speak."""
    own = ["title", "authors", "year", "doi", "citekey", "pages"]
    f = biblio_by_file(biblio, order).select(F.col("key").alias("_fk"), F.struct(*own).alias("_f"))
    d = biblio_by_doi(biblio, order).select(F.col("key").alias("_dk"), F.struct(*own).alias("_d"))
    use = F.lit(prefer_bibliography)
    both = docs.join(f, (F.lower(base_name(F.col("source"))) == F.col("_fk")) & use, "left").join(d, (F.lower("sniffed_doi") == F.col("_dk")) & use, "left")
    pick = lambda c: F.when(F.col("_fk").isNotNull(), F.col(f"_f.{c}")).when(F.col("_dk").isNotNull(), F.col(f"_d.{c}"))
    doi = F.nullif(F.when(F.col("_fk").isNotNull(), F.coalesce(F.nullif(F.col("_f.doi"), F.lit("")), "sniffed_doi")).otherwise(F.col("sniffed_doi")), F.lit(""))
    matched = F.when(F.col("_fk").isNotNull(), "file").when(F.col("_dk").isNotNull(), "doi").otherwise("none")
    base = both.select(*docs.columns, matched.alias("matched"), F.nullif(pick("title"), F.lit("")).alias("title"), names(pick("authors")).alias("authors"), pick("year").alias("year"), doi.alias("doi"), pick("pages")["start"].alias("start_page"), pick("pages")["end"].alias("end_page"), F.nullif(pick("citekey"), F.lit("")).alias("citekey"))
    extras = "venue string, publisher string, concepts array<string>, oa_url string"
    if cache is None:
        return base.select("*", *[F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split(" ", 1)[0]) for x in extras.split(", ")])
    known = latest_replies(cache).select(F.col("doi").alias("_key"), F.col("crossref").alias("_c"), F.col("openalex").alias("_o"), F.nullif(F.col("unpaywall.oa_url"), F.lit("")).alias("_u"))
    joined = base.join(known, F.lower("doi") == F.col("_key"), "left")
    filled = {"title": F.coalesce("title", F.col("_c.title")), "authors": F.when(F.coalesce(F.size("authors"), F.lit(0)) > 0, F.col("authors")).otherwise(F.col("_c.authors")), "year": F.coalesce("year", F.col("_c.year")), "start_page": F.coalesce("start_page", F.col("_c.start_page"))}
    extra = {"venue": F.col("_o.venue"), "publisher": F.col("_o.publisher"), "concepts": F.col("_o.concepts"), "oa_url": F.coalesce("_u", F.nullif(F.col("_o.oa_url"), F.lit("")))}
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in base.columns], *[x.alias(c) for c, x in extra.items()])


def with_citekeys(docs: DataFrame, order: str) -> DataFrame:
    """docs with a citekey each: their own, or one made of the file name, told apart from others of the same name."""
    made = unique_citekeys(docs.where(F.nullif("citekey", F.lit("")).isNull()), order).withColumnRenamed("citekey", "_made")
    return docs.join(made, "source", "left").withColumn("citekey", F.coalesce(F.nullif("citekey", F.lit("")), "_made")).drop("_made")


def fill_blanks(docs: DataFrame, by_file: DataFrame) -> DataFrame:
    """title, year, doi and citekey filled from the bibliography where docs has none."""
    b = by_file.select(F.col("key").alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("title", "year", "doi", "citekey")])
    joined = docs.join(b, F.lower(base_name(F.col("source"))) == F.col("_k"), "left")
    own = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) if c != "year" else F.coalesce(c, f"_{c}") for c in ("title", "year", "doi", "citekey")}
    return joined.select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns])


def _told(service: str) -> Column:
    """A reply as one string, by which replies of the same time are told apart."""
    text = {"crossref": ["title", "authors", "year", "start_page"], "openalex": ["venue", "publisher", "concepts", "oa_url"], "unpaywall": ["oa_url", "is_oa"]}[service]
    return F.concat_ws("|", *[F.coalesce(F.array_join(f"{service}.{f}", ";") if f in ("authors", "concepts") else F.col(f"{service}.{f}").cast("string"), F.lit("")) for f in text])


def latest_replies(replies: DataFrame) -> DataFrame:
    """One row per doi: of each service the latest reply that isn't null (upsert), and the latest time. Whole duplicate rows and
    the order of arrival don't matter; ties by what the reply says."""
    pick = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp")), _told(c)))).alias(c)
    return replies.where(F.col("doi").isNotNull()).groupBy(F.lower("doi").alias("doi")).agg(pick("crossref"), pick("openalex"), pick("unpaywall"), F.max("updated_at").alias("updated_at"))


def merged_metadata(cache: DataFrame) -> DataFrame:
    """Title, year and page of one service, venue, publisher and concepts of the second; the third's open-access address wins."""
    return cache.select("doi", F.col("crossref.title").alias("title"), F.col("crossref.year").alias("year"), F.col("crossref.start_page").alias("start_page"), F.col("openalex.venue").alias("venue"), F.col("openalex.publisher").alias("publisher"), F.coalesce(F.nullif(F.col("unpaywall.oa_url"), F.lit("")), F.col("openalex.oa_url")).alias("oa_url"))


def fresh(updated_at: Column, now: Column, seconds: int) -> Column:
    """Younger than that many seconds; null is not fresh."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(updated_at) < F.lit(seconds * 1_000_000), F.lit(False))


def author_date_citation(authors: Column, year: Column, page: Column, start_page: Column) -> Column:
    first = F.trim(F.split(F.get(authors, F.lit(0)), ",")[0])
    n = F.coalesce(F.size(authors), F.lit(0))
    who = F.when(n < 1, "Unknown").when(n == 1, first).otherwise(F.concat(first, F.lit(" et al.")))
    at = F.when(F.coalesce(start_page, F.lit(0)) != 0, start_page + page - 1).otherwise(page)
    when = F.coalesce(year.cast("string"), F.lit("n.d."))
    cited = F.concat(F.lit("("), who, F.lit(", "), when)
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(cited, F.lit(", p. "), at.cast("string"), F.lit(")"))).otherwise(F.concat(cited, F.lit(")")))


def pandoc_citation(citekey: Column, page: Column, start_page: Column) -> Column:
    at = F.when(F.coalesce(start_page, F.lit(0)) != 0, start_page + page - 1).otherwise(page)
    key = F.nullif(citekey, F.lit(""))
    return F.when(key.isNotNull(), F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("[@"), key, F.lit(", p. "), at.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[@"), key, F.lit("]"))))


def unique_citekeys(sources: DataFrame, order: str) -> DataFrame:
    """(source, citekey) by file name: the second file of one key gets -a, the third -b, after -z come -z1, -z2, …"""
    keyed = sources.select("source", order).withColumn("base", fallback_citekey(F.col("source")))
    n = F.row_number().over(Window.partitionBy("base").orderBy(order))
    suffix = F.when(F.col("n") == 1, "").when(F.col("n") <= 27, F.concat(F.lit("-"), F.char(F.col("n") + 95))).otherwise(F.concat(F.lit("-z"), (F.col("n") - 27).cast("string")))
    return keyed.withColumn("n", n).select("source", F.concat("base", suffix).alias("citekey"))


def propagated_citekey(docs: DataFrame, order: str) -> DataFrame:
    """citekey of every row, blanks filled with the first one of the same source."""
    w = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.nullif(F.col("citekey"), F.lit(""))
    return docs.withColumn("citekey", F.coalesce(own, F.first(own, ignorenulls=True).over(w)))


def known_only(docs: DataFrame) -> DataFrame:
    """Documents with an author and a year."""
    return docs.where((F.coalesce(F.size("authors"), F.lit(0)) > 0) & F.col("year").isNotNull())


def deduplicate(chunks: DataFrame, order: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The first chunk, in `order`, of each text that is equal but for case, punctuation and space; texts without any word go."""
    keyed = chunks.withColumn("_key", dedup_key(F.col("text"))).where(F.col("_key").isNotNull())
    first = keyed.groupBy("_key").agg(F.min(F.struct(*order, F.col("chunk_id").alias("_chunk"))).alias("_first")).select(F.col("_first._chunk").alias("chunk_id"))
    return keyed.drop("_key").join(first, "chunk_id", "left_semi")


def collected_doi(docs: DataFrame, by_file: DataFrame) -> DataFrame:
    """(doc_id, doi) to ask the services for: the bibliography's, else the one found in the text; duplicates stay."""
    b = by_file.select(F.col("key").alias("_k"), F.col("doi").alias("_doi"))
    both = docs.join(b, F.lower(base_name(F.col("source"))) == F.col("_k"), "left")
    return both.select("doc_id", F.coalesce(F.nullif(F.col("_doi"), F.lit("")), find_doi(F.col("text"))).alias("doi")).where(F.col("doi").isNotNull())


def latest_scan(manifest: DataFrame, upto: Column) -> DataFrame:
    """(path, size, mtime) as the last scan until then saw it."""
    seen = manifest.where(F.col("scanned_at") <= upto)
    return seen.groupBy("path").agg(F.max_by(F.struct("size", "mtime"), F.struct("scanned_at", "mtime", "size")).alias("s")).select("path", "s.size", "s.mtime")


def manifest_diff(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): new, changed, removed or unchanged, by size and time; only .pdf, no names that start with __."""
    ok = lambda d: d.where(F.lower("path").endswith(".pdf") & ~F.startswith(F.col("path"), F.lit("__")))
    a, b = ok(cached).select("path", F.struct("size", "mtime").alias("_a")), ok(current).select("path", F.struct("size", "mtime").alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("unchanged")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def merge_corpus(cached: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """Cached chunks of unchanged files, then the new chunks; diff: (path, change)."""
    stale = diff.where(F.col("change") != "unchanged").select(base_name(F.col("path")).alias("source")).distinct()
    return cached.join(stale, "source", "left_anti").unionByName(new)


def filter_by_files(corpus: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose source is one of the files' base names."""
    return corpus.join(files.select(base_name(F.col("path")).alias("source")).distinct(), "source", "left_semi")
