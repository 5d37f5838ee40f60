"""Ranked runs, their fusion, diversity, confidence and final order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.functions.scoring import Query, heuristic_score


def _per_query(q: list[Query], of) -> Column:
    """A column that differs by query, chosen among the typed queries."""
    out = F.lit(None)
    for x in reversed(q):
        out = F.when(F.col("query_id") == x.query_id, of(x)).otherwise(out)
    return out


def run_of(pool: DataFrame, run_id: int, order: list[Column], first: int | None = None) -> DataFrame:
    """(query_id, run_id, chunk_id, rank) of the pool, or of its first rows by pool_rank, in another order."""
    part = pool.where(F.col("pool_rank") <= first) if first else pool
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")
    return part.select("query_id", F.lit(run_id).cast("long").alias("run_id"), "chunk_id", rank.alias("rank"))


def heuristic_run(pool: DataFrame, queries: list[Query], topn: int = 150, run_id: int = 3, **weights: float) -> DataFrame:
    """The first topn of the pool by coverage, proximity and phrases; an empty query leaves them in order."""
    scored = pool.withColumn("h", _per_query(queries, lambda q: heuristic_score(F.col("text"), q.rerank, **weights) if q.rerank else F.lit(0.0)))
    return run_of(scored, run_id, [F.desc("h"), F.col("pool_rank")], topn)


def rrf_fuse(runs: DataFrame, c: float = 60, cap: int = 200) -> DataFrame:
    """(query_id, chunk_id, rrf, fused_pos): sum of 1 / (c + rank) over the runs' first cap places, added in the order of the
    runs; ties by where a chunk comes first."""
    per = runs.where(F.col("rank") <= cap).groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("run_id", "rank"))).alias("p"))  # at most one place per run
    scored = per.select("query_id", "chunk_id", F.aggregate("p", F.lit(0.0), lambda s, x: s + 1.0 / (F.lit(float(c)) + x["rank"])).alias("rrf"), F.col("p")[0].alias("at"))
    return scored.withColumn("fused_pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "at")).cast("long")).drop("at")


def diversity_select(candidates: DataFrame, doc: str, score: str = "score", pos: str = "fused_pos", penalty: float = 0.3, max_per_doc: int = 2, k: int = 8) -> DataFrame:
    """Greedy selection by score minus penalty per chunk already taken from the document, ties by pos, at most max_per_doc of
    one document: in closed form, since only the order within the document decides how often it was taken before."""
    window = max(5 * k, 200)
    near = candidates.where(F.col(pos) <= window)
    n = F.row_number().over(Window.partitionBy("query_id", doc).orderBy(F.desc(score), pos))
    capped = near.withColumn("_n", n).where(F.col("_n") <= max(max_per_doc, 1)).withColumn("adjusted", F.col(score) - penalty * (F.col("_n") - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("adjusted"), pos)).cast("long")
    return capped.withColumn("selected_rank", rank).where(F.col("selected_rank") <= k).drop("_n")


def diversity_onepass(candidates: DataFrame, doc: str, score: str = "score", pos: str = "pool_rank", penalty: float = 0.3, max_per_doc: int = 2) -> DataFrame:
    """One pass in the given order: the n-th chunk of a document loses n - 1 penalties, those beyond the cap go, then a stable sort."""
    n = F.row_number().over(Window.partitionBy("query_id", doc).orderBy(pos))
    kept = candidates.withColumn("_n", n).where(F.col("_n") <= max_per_doc).withColumn("adjusted", F.col(score) - penalty * (F.col("_n") - 1)).drop("_n")
    return kept.withColumn("selected_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("adjusted"), pos)).cast("long"))


def mmr_pick(query: set, docs: list[set], scores: list[float], lam: float, k: int) -> list[int]:
    """Places in order of selection: first the best score, then the best lam * overlap with the query - (1 - lam) * greatest
    overlap with what was taken; no more than k candidates stay as they are."""
    if len(docs) <= k:
        return list(range(len(docs)))

    def jac(a: set, b: set) -> float:
        return len(a & b) / (len(a | b) + 1e-9)

    taken = [max(range(len(docs)), key=lambda i: (scores[i], -i))]
    worst = [jac(d, docs[taken[0]]) for d in docs]
    while len(taken) < k:
        rest = [i for i in range(len(docs)) if i not in taken]
        best = max(rest, key=lambda i: (lam * jac(query, docs[i]) - (1 - lam) * worst[i], -i))
        taken.append(best)
        worst = [max(w, jac(d, docs[best])) for w, d in zip(worst, docs)]
    return taken


def mmr_select(candidates: DataFrame, query_tokens: Column, lam: float = 0.7, k: int = 10, most: int = 1_000) -> DataFrame:
    """(query_id, chunk_id, mmr_rank). candidates: (query_id, chunk_id, pool_rank, score, tokens); the first `most` of a query,
    the size of a candidate pool, are chosen from in one group."""
    rows = candidates.where(F.col("pool_rank") <= most).select("query_id", "chunk_id", "pool_rank", "score", "tokens", query_tokens.alias("qt"))
    ids = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pool_rank").reset_index(drop=True)
        order = mmr_pick(set(g["qt"][0]), [set(t) for t in g["tokens"]], list(g["score"]), lam, k)
        return pd.DataFrame({"query_id": g["query_id"][0], "chunk_id": g["chunk_id"].iloc[order].to_numpy(), "mmr_rank": range(1, len(order) + 1)})

    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {ids['query_id']}, chunk_id {ids['chunk_id']}, mmr_rank long")


def confidence(pool: DataFrame, runs: DataFrame, top_k: int = 8) -> DataFrame:
    """(query_id, level, score, spread, stability). pool: (query_id, pool_rank, score); spread is how far the best score stands
    off the one in the middle, stability the share of all runs' first top_k that every run has."""
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    middle = pool.join(F.broadcast(sizes.select("query_id", F.floor(F.col("n") / 2).alias("m"))), "query_id").where(F.col("pool_rank") == F.col("m") + 1).select("query_id", F.col("score").alias("mid"))
    spread = sizes.join(middle, "query_id").select("query_id", F.when(F.col("best") > 0, (F.col("best") - F.col("mid")) / (F.col("best") + 1e-6)).otherwise(0.0).alias("spread"))
    n_runs = runs.groupBy("query_id").agg(F.countDistinct("run_id").alias("n_runs"))
    seen = runs.where(F.col("rank") <= top_k).groupBy("query_id", "chunk_id").agg(F.countDistinct("run_id").alias("c"))
    common = seen.join(F.broadcast(n_runs), "query_id").groupBy("query_id", "n_runs").agg(F.count_if(F.col("c") == F.col("n_runs")).alias("i"), F.count("*").alias("u"))
    stable = common.select("query_id", F.when(F.col("n_runs") < 2, 0.5).otherwise(F.col("i") / F.col("u")).alias("stability"))
    score = 0.5 * F.least(F.lit(1.0), 2 * F.col("spread")) + 0.5 * F.coalesce("stability", F.lit(0.5))
    both = spread.join(stable, "query_id", "left").withColumn("s", score)
    level = F.when(F.col("s") > 0.75, "high").when(F.col("s") > 0.4, "medium").otherwise("low")
    return both.select("query_id", level.alias("level"), F.round("s", 3).alias("score"), F.round("spread", 3).alias("spread"), F.round(F.coalesce("stability", F.lit(0.5)), 3).alias("stability"))


def minmax(score: str) -> Column:
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0)


def final_order(score: str = "score", page: str = "page", file: str = "file", doi: str = "doi") -> list[Column]:
    return [F.desc(score), F.col(page), F.col(file), F.coalesce(F.col(doi), F.lit("")).asc()]


@F.pandas_udf(DoubleType())
def python_round3(s: pd.Series) -> pd.Series:
    """Rounds the binary value to three places, as presented scores are; only for the few rows that are shown."""
    return s.map(lambda x: None if pd.isna(x) else round(x, 3))

