"""Citation metadata of DOIs: fresh replies from the cache, the others fetched, the cache brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.metadata import fresh, latest_replies, merged_metadata
from corpusloom.runtime import materialise
from corpusloom.sources import files as X

Fetcher = Callable[[str], tuple[int, str | None]]
READERS = {"crossref": X.crossref_record, "openalex": X.openalex_record, "unpaywall": X.unpaywall_record}


def stale(dois: DataFrame, cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """(doi) asked for that the cache has no fresh reply for; blank ones are left out, each stands once."""
    asked = dois.select(F.lower(F.trim("doi")).alias("doi")).where(F.col("doi") != "").distinct()
    kept = latest_replies(cache).where(fresh(F.col("updated_at"), now, seconds)).select("doi")
    return asked.join(kept, "doi", "left_anti")


def updated_cache(dois: DataFrame, cache: DataFrame, services: dict[str, Fetcher], now: Column, seconds: int = 604_800, at_once: int = 5, tries: int = 3, wait: Callable[[float], None] | None = None) -> DataFrame:
    """The reply cache (doi, crossref, openalex, unpaywall, updated_at) after asking the services for what isn't fresh. A service
    that fails leaves its older reply; a doi that no service knows is not written."""
    old = latest_replies(cache).select("doi", "crossref", "openalex", "unpaywall", "updated_at")
    wanted = materialise(stale(dois, cache, now, seconds), "stale")
    found = wanted
    for name, get in services.items():
        replies = materialise(X.fetch(wanted, "doi", get, at_once, tries, wait), f"replies_{name}")
        found = found.join(replies.select("doi", F.when(F.col("payload").isNotNull(), READERS[name](F.col("payload"))).alias(name)), "doi", "left")
    types = dict(old.dtypes)
    cols = [(F.col(n).cast(types[n]) if n in services else F.lit(None).cast(types[n])).alias(n) for n in READERS]
    new = found.select("doi", *cols, now.cast("timestamp").alias("updated_at")).where(F.coalesce(*[F.col(n).isNotNull().cast("int") for n in READERS]).isNotNull() & F.greatest(*[F.col(n).isNotNull() for n in READERS]))
    return latest_replies(old.unionByName(new))


def enriched(dois: DataFrame, cache: DataFrame, services: dict[str, Fetcher], now: Column, seconds: int = 604_800, **how) -> tuple[DataFrame, DataFrame]:
    """(metadata (doi, title, …) of the asked doi, the cache to keep). With the first service alone this is the older lookup."""
    kept = materialise(updated_cache(dois, cache, services, now, seconds, **how), "replies")
    asked = dois.select(F.lower(F.trim("doi")).alias("doi")).where(F.col("doi") != "").distinct()
    return merged_metadata(kept.join(asked, "doi", "left_semi")), kept
