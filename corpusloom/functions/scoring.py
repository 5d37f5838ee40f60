"""Scores of a text for a query as column expressions; the query's side comes from the driver or from a column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import constants as C
from corpusloom.functions.text import collapse, rerank_tokens


def query_tokens(query: str, pattern: str = C.TOKEN) -> list[str]:
    return [t for t in (w.lower() for w in re.findall(pattern, query)) if t not in set(C.STOP)]


def robustify(query: str) -> str:
    return " ".join(re.sub(r"[^A-Za-z0-9\s]", " ", query.lower()).split())


@dataclass
class Query:
    """What is known of a query before any text is read."""

    query_id: str
    text: str
    tokens: list[str] = field(init=False)
    rerank: list[str] = field(init=False)
    grams: list[str] = field(init=False)
    quote: str = field(init=False)

    def __post_init__(self) -> None:
        self.tokens = query_tokens(self.text)
        self.rerank = re.findall(C.RERANK_TOKEN, self.text.lower())
        t = self.tokens
        self.grams = [g for n in (2, 3) for k in range(len(t) - n + 1) if len(g := " ".join(t[k : k + n])) >= 5]
        self.quote = " ".join(self.text.lower().split()) if len(self.text) >= 20 else ""


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _closest(hits: Column) -> Column:
    """Least gap between neighbouring hits (w, i) of different words; null if there is none."""
    pairs = F.transform(F.slice(hits, 2, F.greatest(F.size(hits) - 1, F.lit(0))), lambda h, k: F.when(h["w"] != F.get(hits, k)["w"], h["i"] - F.get(hits, k)["i"]))
    return F.array_min(pairs)


def flat(text: Column) -> Column:
    """The text as phrases are looked up in it: lower case, white space collapsed."""
    return collapse(F.lower(text))


def proximity_bonus(ws: Column, tokens: Column, window: int = 30) -> Column:
    """ws: the text's words. 1 - d / window for the closest two different query tokens d blank-separated words apart, 0 beyond the window. Only
    neighbouring hits can be closest."""
    hits = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(tokens, h["w"]))
    gap = _closest(hits)
    # most texts hold fewer than two of the tokens and need no walk through their words
    return F.when(F.size(F.array_intersect(tokens, ws)) < 2, 0.0).when(gap.isNull() | (gap > window), 0.0).otherwise(1.0 - gap / F.lit(float(window)))


def ngram_bonus(t: Column, grams: list[str], max_hits: int = 6) -> Column:
    """t: the flat text. Share of max_hits of the query's bigrams and trigrams that it contains."""
    hits = sum((F.contains(t, F.lit(g)).cast("int") for g in grams), F.lit(0))
    return F.least(hits, F.lit(max_hits)) / F.lit(float(max_hits))


def pattern_bonus(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(t, F.lit(p)).cast("int") for p in C.ANSWER_PATTERNS), F.lit(0)) * F.lit(0.05)


def metadata_bonus(text: Column, title: Column) -> Column:
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    start = F.substring(t, 1, 60)
    section = F.lit(False)
    for s in C.SECTIONS:
        section = section | F.contains(start, F.lit(s))
    own = F.trim(F.lower(title))
    named = F.when(title.isNull() | (title == ""), 0.0).when(F.contains(t, own), F.when(F.length(t) < F.length(own) + 20, 0.2).otherwise(0.05)).otherwise(0.0)
    return F.when(F.contains(F.substring(t, 1, 50), F.lit("abstract")), 0.15).otherwise(0.0) + F.when(section, 0.1).otherwise(0.0) + F.coalesce(named, F.lit(0.0))


def _chars(text: Column, pattern: str, keep=None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.aggregate(F.filter(found, keep) if keep else found, F.lit(0), lambda n, x: n + F.length(x))


def gibberish_penalty(text: Column, t_flat: Column, threshold: float = 0.2) -> Column:
    """t_flat: the flat text. 1 up to the threshold's share of line numbers, doi, mixed tokens, punctuation clusters and digit words (counted as
    often as they are in several of these classes), falling to 0 at one half. Texts under 20 characters have 1."""
    t = F.coalesce(text, F.lit(""))
    edge, back = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    bad = _chars(t, rf"{edge}[0-9]{{3,5}}{back}") + _chars(t, r"doi:[^\p{Z}\t-\r]+|10\.[0-9]{4,}/[^\p{Z}\t-\r]+")
    bad = bad + _chars(t, rf"{edge}[0-9]+[a-zA-Z]+[0-9]*{back}|{edge}[a-zA-Z]+[0-9]+[a-zA-Z]*{back}", lambda x: F.length(x) > 3)
    bad = bad + _chars(t, r"[^\p{L}\p{N}_\p{Z}\t-\r]{2,}")
    digits = F.filter(F.regexp_extract_all(t_flat, F.lit("[^ ]*[0-9][^ ]*"), F.lit(0)), lambda w: (F.length(w) > 2) & ((F.length(w) - F.length(F.regexp_replace(w, "[0-9]", ""))) / F.length(w) > 0.5))
    bad = bad + F.aggregate(digits, F.lit(0), lambda n, x: n + F.length(x))
    ratio = bad / F.length(t)
    span = 0.5 - threshold
    return F.when(F.length(t) < 20, 1.0).when(ratio <= threshold, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(ratio - threshold, F.lit(span)) / F.lit(span)))


def longest_common(text: Column, quote: str) -> Column:
    """Length of the longest part of quote that the text contains: while reading the quote, the part that ends here can
    outgrow the longest so far by one character only."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(quote))), F.lit(0), lambda n, j: F.when((n < j) & F.contains(text, F.substr(F.lit(quote), j - n, n + 1)), n + 1).otherwise(n))


def fuzzy_match_bonus(t: Column, quote: str, min_length: int = 20) -> Column:
    """t: the flat text. 0 without a common part of min_length characters, else 0.5 plus its length in hundreds, 1 at most. The exact length is
    looked for only in texts that hold some part of min_length."""
    if len(quote) < min_length:
        return F.lit(0.0)
    gate = F.lit(False)
    for k in range(len(quote) - min_length + 1):
        gate = gate | F.contains(t, F.lit(quote[k : k + min_length]))
    return F.when(gate, F.least(F.lit(1.0), F.least(F.lit(0.5), longest_common(t, quote) / F.lit(100.0)) + 0.5)).otherwise(0.0)


#: Weight of every term where document frequencies are left out and 100,000 documents are assumed.
IDF_EVEN = log(99_999.5 / 1.5)


def heuristic_score(text: Column, query: list[str], alpha: float = 0.6, beta: float = 0.3, gamma: float = 0.1, window: int = 24) -> Column:
    """alpha * coverage + beta * proximity + gamma * phrases over rerank tokens (no stop words)."""
    d = rerank_tokens(text)
    distinct = list(dict.fromkeys(query))
    found = F.size(F.array_intersect(strings(distinct), d))
    coverage = found * F.lit(IDF_EVEN) / F.lit(IDF_EVEN * len(distinct) + 1e-9)
    hits = F.filter(F.transform(d, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(strings(distinct), h["w"]))
    twice = [w for w in distinct if query.count(w) > 1]
    span = F.least(F.when(F.arrays_overlap(d, strings(twice)), 1) if twice else F.lit(None).cast("int"), _closest(hits) + 1)
    proximity = F.coalesce(F.greatest(F.lit(0.0), (F.lit(window) - span) / F.lit(float(window))), F.lit(0.0))
    joined = F.array_join(d, " ")
    phrases = sum((F.contains(joined, F.lit(f"{a} {b}")).cast("int") for a, b in zip(query, query[1:])), F.lit(0))
    return alpha * coverage + beta * proximity + gamma * F.least(F.lit(1.0), phrases * F.lit(0.15))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def normalised(v: Column) -> Column:
    """L2-normalised; the zero vector stays zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + F.lit(1e-9))
