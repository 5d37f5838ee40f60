"""P2: how distinctive a term is for its chunk, by a parsimonious language model.

Each chunk is a mixture ``(1 - mu) * P(t|collection) + mu * P(t|chunk)``; expectation-maximisation moves
the mass of common vocabulary to the collection model, what converges is the chunk's own term model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

_WORD = re.compile("[a-z]+")
_UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
#: As many of the most frequent terms go to the workers as one table (about 150 bytes a term); the others, if there are more,
#: are rare and are joined.
BROADCAST_TERMS = 600_000


def term_counts(text: str | None, min_len: int) -> Counter:
    """Runs of ASCII letters, lower-cased, of at least min_len letters. None and '' have no terms."""
    return Counter(w for w in _WORD.findall(text.translate(_UPPER)) if len(w) >= min_len) if text else Counter()


def em_weights(tf: np.ndarray, background: np.ndarray, start: np.ndarray, mu: float, steps: int) -> np.ndarray:
    """P(t|chunk) of many chunks at once; start: where each chunk begins in tf. Nothing is pruned."""
    lengths = np.diff(np.append(start, len(tf)))
    own = tf / np.repeat(np.add.reduceat(tf, start), lengths)
    for _ in range(steps):
        e = tf * (mu * own) / ((1 - mu) * background + mu * own)
        total = np.add.reduceat(e, start)
        own = e / np.repeat(np.where(total > 0, total, 1.0), lengths)
    return own


def term_statistics(chunks: DataFrame, text_col: str = "text", min_len: int = 4) -> DataFrame:
    """(term, df, cf): chunks that have the term, its occurrences. Counts are combined per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf = Counter(), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                c = term_counts(text, min_len)
                df.update(c.keys())
                cf.update(c)
            if len(df) > 500_000:
                yield out(df, cf)
                df, cf = Counter(), Counter()
        yield out(df, cf)

    def out(df: Counter, cf: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([cf[t] for t in df], pa.int64())], ["term", "df", "cf"])

    part = chunks.select(F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(count, "term string, df long, cf long")
    return part.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def score_terms(
    chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", *, min_len: int = 4, mu: float = 0.1, steps: int = 12,
    min_tf: int = 1, min_df: int = 1, max_df: int | None = None, broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """Rows (id, term, tf, df, weight, lift, rank): weight is the converged P(term|chunk), lift its logarithm over the
    collection's P(term), rank the place by weight within the chunk (ties by term). min_tf, min_df, max_df only choose
    which rows are returned; the model always sees every term of every chunk.

    Null and empty texts, or texts without a term, give no row. Repeated rows are separate chunks and count in df.
    Empty input gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stats = materialise(term_statistics(rows, "_text", min_len), "terms")
    n_terms, total = stats.agg(F.count("*"), F.sum("cf")).first()
    schema = "_id long, term string, tf long, df long, weight double, lift double, rank int"
    total = float(total or 1)
    keep = lambda tf, df: (tf >= min_tf) & (df >= min_df) & ((df <= max_df) if max_df else True)

    def emit(ids, start, terms, tf, df, cf) -> pa.RecordBatch:
        tf, df, cf = np.asarray(tf, float), np.asarray(df), np.asarray(cf, float)
        w = em_weights(tf, cf / total, start, mu, steps)
        chunk = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(tf))))
        terms = np.asarray(terms, object)
        sel = np.flatnonzero(keep(tf, df))
        order = np.lexsort((-w, chunk))
        rank = np.empty(len(w), np.int32)
        rank[order] = np.arange(len(w)) - start[chunk[order]] + 1
        return pa.record_batch(
            [pa.array(np.asarray(ids)[chunk[sel]], pa.int64()), pa.array(terms[sel], pa.string()), pa.array(tf[sel].astype(np.int64)), pa.array(df[sel].astype(np.int64)), pa.array(w[sel]), pa.array(np.log(np.maximum(w[sel], 1e-300) * total / cf[sel])), pa.array(rank[sel])],
            ["_id", "term", "tf", "df", "weight", "lift", "rank"],
        )

    if n_terms <= broadcast_terms:
        vocabulary = stats.toPandas()
        known = spark.sparkContext.broadcast(({t: k for k, t in enumerate(vocabulary["term"])}, vocabulary["df"].to_numpy(np.int64), vocabulary["cf"].to_numpy(np.int64)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, all_df, all_cf = known.value
            for b in batches:
                ids, start, terms, tf, at = [], [], [], [], []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if c := term_counts(text, min_len):
                        ids.append(i)
                        start.append(len(terms))
                        own = sorted(c)
                        terms += own
                        tf += [c[t] for t in own]
                        at += [index[t] for t in own]
                if ids:
                    yield emit(ids, np.asarray(start), terms, tf, all_df[at], all_cf[at])

        scored = rows.where(F.col("_text").isNotNull()).mapInArrow(score, schema)
    else:
        # the vocabulary is too large for the workers' memory: postings meet its most frequent terms, of which none is
        # shuffled, and are joined with the rare ones; then they come back by chunk
        lower = F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        numbered = rows.withColumn("_row", F.monotonically_increasing_id())
        postings = numbered.select("_id", "_row", F.explode(F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0))).alias("term")).where(F.length("term") >= min_len).groupBy("_id", "_row", "term").agg(F.count("*").alias("tf"))
        head = materialise(stats.orderBy(F.desc("df"), "term").limit(broadcast_terms), "head")
        met = materialise(postings.join(F.broadcast(head), "term", "left"), "postings")  # at most broadcast_terms rows
        rare = met.where(F.col("df").isNull()).drop("df", "cf").join(stats, "term")
        by_chunk = met.where(F.col("df").isNotNull()).select("_id", "_row", "term", "tf", "df", "cf").unionByName(rare.select("_id", "_row", "term", "tf", "df", "cf")).groupBy("_id", "_row").agg(F.array_sort(F.collect_list(F.struct("term", "tf", "df", "cf"))).alias("t"))

        def score_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = b.column(1)
                if len(t):
                    v, start = t.flatten(), np.asarray(t.offsets)[:-1] - t.offsets[0].as_py()
                    yield emit(b.column(0).to_pylist(), start, *(v.field(k).to_pylist() for k in range(4)))

        scored = by_chunk.select("_id", "t").mapInArrow(score_joined, schema)
    return scored.withColumnRenamed("_id", id_col)
