"""Text cleaning, quality tests, tokenizers and chunkers as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import constants as C


def tokenize(text: Column, pattern: str = C.TOKEN) -> Column:
    """Lower-cased matches of the pattern without stop words; null gives an empty array."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), F.lower)
    return F.filter(words, lambda t: ~t.isin(*dict.fromkeys(C.STOP)))  # a hash set


def rerank_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(C.RERANK_TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), C.SPACE, " "))


def words(text: Column) -> Column:
    t = collapse(F.lower(text))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def snippet(text: Column, maxlen: int = 900) -> Column:
    t = F.regexp_replace(strip(text), "\n", " ")
    return F.when(F.length(t) > maxlen, F.concat(F.substring(t, 1, maxlen - 3), F.lit("..."))).otherwise(t)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{C.SPACE}|{C.SPACE}$", "")


def quality_good(text: Column, min_readable: float = 0.7) -> Column:
    """Whether a page's text is readable: long enough, few control characters, mostly printable, no more than three runs of
    five equal characters, at least five different letters or blanks. Null and '' are not."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    control = n - F.length(F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    unprintable = n - F.length(F.regexp_replace(t, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\t-\r\x1c-\x1f\x{85}]]", ""))
    runs = F.regexp_count(t, F.lit(r"([^\p{Z}\t-\r\x1c-\x1f\x{85}])\1{4,}"))
    different = F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z ]"), F.lit(0))))
    return (F.length(strip(t)) >= 10) & (control <= 0.05 * n) & ((n - unprintable) >= min_readable * n) & (runs <= 3) & (different >= 5)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def _joined(text: Column) -> Column:
    t = F.regexp_replace(text, "­", "")
    t = F.regexp_replace(t, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    return F.regexp_replace(t, "\n", " ")


def clean_text(df: DataFrame, text_col: str) -> DataFrame:
    """df with text_col cleaned: control characters and soft hyphens out, words joined over line ends, one line, NFKC, white
    space collapsed. Only texts with other than ASCII characters go through Python."""
    joined = df.withColumn(text_col, _joined(without_controls(F.col(text_col))))
    plain = F.coalesce(~F.col(text_col).rlike(r"[^\x00-\x7F]"), F.lit(True))
    both = joined.where(plain).unionByName(joined.where(~plain).withColumn(text_col, _nfkc(text_col)))
    return both.withColumn(text_col, F.when(F.col(text_col).isNotNull(), collapse(F.col(text_col))))


def find_doi(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), C.DOI, 0), r"[\]).,;]+$", ""), F.lit(""))


def sentences(text: Column) -> Column:
    """Sentences of more than ten characters; full stops of abbreviations end none."""
    protected = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(C.ABBREVIATIONS)})\.", "$1~DOT~")
    parts = F.split(F.regexp_replace(protected, rf"([.!?]+){C.SPACE}", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit("~DOT~"), F.lit(".")))), lambda s: F.length(s) > 10)


def sliding_windows(text: Column, window: int = 600, overlap: int = 80) -> Column:
    """Windows of whole sentences of at most `window` characters, each carrying back whole sentences of `overlap` characters;
    one sentence longer than the window is cut at words instead. A text that fits is its own window. One fold step a unit."""
    t = F.coalesce(text, F.lit(""))
    s = sentences(t)
    units = F.when((F.size(s) == 1) & (F.length(s[0]) > window), words_as_typed(s[0])).otherwise(s)
    empty = F.array().cast("array<string>")

    def length(cur: Column) -> Column:
        return F.length(F.array_join(cur, " "))

    def fits(cur: Column, u: Column) -> Column:
        return (F.size(cur) == 0) | (length(cur) + F.length(u) + 1 <= window)

    def carried(cur: Column) -> Column:
        # the shortest suffix of whole units whose joined length reaches the overlap
        sizes = F.transform(F.sequence(F.lit(1), F.size(cur)), lambda k: F.when(length(F.slice(cur, -k, k)) >= overlap, k))
        return F.slice(cur, -F.coalesce(F.array_min(sizes), F.size(cur)), F.coalesce(F.array_min(sizes), F.size(cur)))

    def step(acc: Column, u: Column) -> Column:
        cur = acc["cur"]
        back = carried(cur)
        fresh = F.when(length(back) + F.length(u) + 1 <= window, F.concat(back, F.array(u))).otherwise(F.array(u))
        return F.when(fits(cur, u), F.struct(acc["done"].alias("done"), F.concat(cur, F.array(u)).alias("cur"))).otherwise(F.struct(F.concat(acc["done"], F.array(F.array_join(cur, " "))).alias("done"), fresh.alias("cur")))

    folded = F.aggregate(units, F.struct(empty.alias("done"), empty.alias("cur")), step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"]))
    return F.when(F.length(t) <= window, F.array(t)).otherwise(F.filter(folded, lambda w: F.length(strip(w)) > 20))


def words_as_typed(text: Column) -> Column:
    return F.split(collapse(text), " ")


def chunk_pieces(text: Column, mode: str = "sliding", window: int = 600, overlap: int = 80) -> Column:
    """Pieces of a page by mode: 'sentence', 'sliding', anything else the whole page."""
    if mode == "sentence":
        return sentences(text)
    return sliding_windows(text, window, overlap) if mode == "sliding" else F.array(text)


def readable(text: str, min_readable: float = 0.7) -> bool:
    """quality_good for one text: extractors are tried in turn until a page is readable."""
    t = text or ""
    if len(t.strip()) < 10 or sum(ord(c) < 32 and c not in "\t\n\r" for c in t) > 0.05 * len(t):
        return False
    shown = sum(c.isprintable() or c.isspace() for c in t)
    return shown >= min_readable * len(t) and len(re.findall(r"(\S)\1{4,}", t)) <= 3 and len(set(t.lower()) & set("abcdefghijklmnopqrstuvwxyz ")) >= 5


def cleaned_pages(pages: DataFrame, min_readable: float = 0.7) -> DataFrame:
    """pages with their text cleaned; unreadable text is marked by a prefix, empty and null text stays empty."""
    done = clean_text(pages, "text").withColumn("text", F.coalesce("text", F.lit("")))
    bad = (F.col("text") != "") & ~quality_good(F.col("text"), min_readable)
    return done.withColumn("text", F.when(bad, F.concat(F.lit(C.QUALITY_WARNING), "text")).otherwise(F.col("text")))


def chunks_of_pages(pages: DataFrame, mode: str = "sliding", window: int = 600, overlap: int = 80, title: Column | None = None, min_readable: float = 0.7) -> DataFrame:
    """(all columns of pages but text, chunk_ord, text): readable, unflagged pages cut into pieces, filtered before the cut."""
    ok = pages.where(F.col("text").isNotNull() & (F.col("text") != "") & ~F.startswith(F.col("text"), F.lit(C.QUALITY_WARNING)) & quality_good(F.col("text"), min_readable))
    out = ok.select(*[c for c in pages.columns if c != "text"], F.posexplode(chunk_pieces(F.col("text"), mode, window, overlap)).alias("chunk_ord", "text"))
    return out.withColumn("text", F.concat_ws(" | ", title, "text")) if title is not None else out


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def dedup_key(text: Column) -> Column:
    """md5 of the lower-cased text without anything but letters, digits and _; null where nothing is left."""
    k = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")
    return F.when(k != "", F.md5(k))


def fallback_citekey(file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"(?<=[^.])\.[^.]*$", "")
    return F.lower(F.substring(F.split(stem, "[ ,_]")[0], 1, 15))
