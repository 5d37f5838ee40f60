"""Lexical index: postings, chunk lengths, term statistics, and BM25 over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import constants as C
from corpusloom.functions.scoring import Query
from corpusloom.functions.text import tokenize
from corpusloom.runtime import materialise


@dataclass
class Index:
    """postings(term, chunk_id, tf, dl), terms(term, df, idf), and three numbers of the whole corpus."""

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    avg_idf: float

    def save(self, path: str) -> None:
        """Postings sorted by term, so that a query reads only the row groups of its terms."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(self.n, self.avgdl, self.avg_idf)], "n long, avgdl double, avg_idf double").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        s = spark.read.parquet(f"{path}/stats").first()
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), s["n"], s["avgdl"], s["avg_idf"])


def term_frequencies(corpus: DataFrame, pattern: str = C.TOKEN) -> DataFrame:
    """(chunk_id, term, tf): combined per task before the shuffle."""
    tokens = corpus.select("chunk_id", F.explode(tokenize(F.col("text"), pattern)).alias("term"))
    return tokens.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def build(corpus: DataFrame, pattern: str = C.TOKEN) -> Index:
    """Index of all chunks; chunks without a term count in n and in the average length. Postings and terms are written once
    and read by every query; only three numbers reach the driver."""
    tokens = corpus.select("chunk_id", tokenize(F.col("text"), pattern).alias("t")).withColumn("dl", F.size("t").cast("long"))
    postings = materialise(tokens.select("chunk_id", "dl", F.explode_outer("t").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("term").alias("tf")), "postings")
    size = postings.agg(F.countDistinct("chunk_id").alias("n"), F.sum("tf").alias("words")).first()
    n = size["n"] or 0
    counted = postings.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))
    terms = materialise(counted.select("term", "df", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), "terms")
    return Index(postings.where(F.col("term").isNotNull()), terms, n, (size["words"] or 0) / max(1, n), terms.agg(F.avg("idf")).first()[0] or 0.0)


def query_terms(spark: SparkSession, queries: list[Query]) -> DataFrame:
    """(query_id, term, qtf); as many rows as the queries typed have words."""
    rows = [(q.query_id, t, q.tokens.count(t)) for q in queries for t in dict.fromkeys(q.tokens)]
    return spark.createDataFrame(rows, "query_id string, term string, qtf long")


def bm25(index: Index, terms: DataFrame, k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, bm25) of chunks with any of the terms. A negative idf counts a quarter of the average idf; a term
    asked for twice counts twice. The queries' few terms are broadcast to the postings, not the postings shuffled."""
    idf = F.when(F.col("idf") < 0, F.lit(0.25 * index.avg_idf)).otherwise(F.col("idf"))
    weighted = index.terms.join(F.broadcast(terms), "term").select("term", "query_id", (idf * F.col("qtf")).alias("w"))
    hit = index.postings.join(F.broadcast(weighted), "term")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl or 1.0)))
    return hit.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def for_every_query(corpus: DataFrame, queries: list[Query]) -> DataFrame:
    """Each chunk once per typed query: scores are dense, chunks without a match are ranked too."""
    return corpus.withColumn("query_id", F.explode(F.array(*[F.lit(q.query_id) for q in queries])))


def top(scored: DataFrame, score: str, k: int) -> DataFrame:
    """First k per query by score, ties by chunk_id, with their rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rm3_terms(index: Index, corpus: DataFrame, queries: list[Query], fb_docs: int = 6, fb_terms: int = 10, k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """(query_id, term, tf, rank): feedback terms of the first fb_docs chunks by BM25, of three characters at least, the most
    frequent fb_terms of them without the query's own; ties by where a term comes first."""
    spark = corpus.sparkSession
    scores = bm25(index, query_terms(spark, queries), k1, b)
    dense = for_every_query(corpus.select("chunk_id"), queries).join(scores, ["query_id", "chunk_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    first = top(dense, "bm25", max(1, fb_docs)).select("query_id", "chunk_id", "rank")  # a few chunks per query
    words = corpus.join(F.broadcast(first), "chunk_id").select("query_id", "rank", F.posexplode(tokenize(F.col("text"))).alias("pos", "term")).where(F.length("term") >= 3)
    counted = words.groupBy("query_id", "term").agg(F.count("*").alias("tf"), F.min(F.struct("rank", "pos")).alias("at"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tf"), "at")).cast("long")).where(F.col("rank") <= fb_terms)
    own = query_terms(spark, queries).select("query_id", "term")
    return ranked.join(F.broadcast(own), ["query_id", "term"], "left_anti").select("query_id", "term", "tf", "rank")


def tfidf_vectors(texts: DataFrame) -> DataFrame:
    """(chunk_id, term, weight): tf / length * ln(N / df) over word tokens."""
    tokens = texts.select("chunk_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("t")).withColumn("n", F.size("t"))
    tf = tokens.select("chunk_id", "n", F.explode("t").alias("term")).groupBy("chunk_id", "term", "n").agg(F.count("*").alias("c"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = texts.count()
    return tf.join(df, "term").select("chunk_id", "term", (F.col("c") / F.col("n") * F.log(F.lit(total) / F.col("df"))).alias("weight"))


def sparse_cosine(vectors: DataFrame, query_id: int) -> DataFrame:
    """(chunk_id, cosine) of every chunk with a term to the vector of one chunk; 0 beside a zero vector."""
    q = vectors.where(F.col("chunk_id") == query_id).select("term", F.col("weight").alias("q"))
    qn = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q")))).first()[0] or 0.0
    per = vectors.join(F.broadcast(q), "term", "left").groupBy("chunk_id").agg(F.sum(F.col("weight") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    norm = F.col("n") * F.lit(qn)
    return per.select("chunk_id", F.when(norm > 0, F.col("dot") / norm).otherwise(0.0).alias("cosine"))
