"""Exact nearest neighbours by inner product, for a stated set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

#: Query vectors that travel to the tasks at once: 1,024 of 64 doubles are half a megabyte.
BLOCK = 1_024


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, rank, score) for queries (query_id, embedding) against rows (vec_id, embedding), the query itself
    included. Query vectors go out in blocks of bounded size, one at a time; a task keeps k rows per query, so what is shuffled
    grows with neither the rows nor the width of the vectors. Null vectors are left out; ties by vec_id."""
    spark = queries.sparkSession
    numbered = queries.where(F.col("embedding").isNotNull())
    out = None
    n_blocks = max(1, -(-numbered.count() // block))
    for b in range(n_blocks):
        part = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast((part["query_id"].to_numpy(), np.array(part["embedding"].tolist(), dtype=float)))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            vec = score = None  # the k best of this task so far, a row for each query
            for g in batches:
                if not len(g) or not len(ids):
                    continue
                s = q @ np.array(g["embedding"].tolist(), dtype=float).T
                v = np.broadcast_to(g["vec_id"].to_numpy(), s.shape)
                if vec is not None:
                    v, s = np.concatenate([vec, v], 1), np.concatenate([score, s], 1)
                order = np.lexsort((v, -s), axis=1)[:, :k]
                vec, score = np.take_along_axis(v, order, 1), np.take_along_axis(s, order, 1)
            if vec is not None:
                yield pd.DataFrame({"query_id": np.repeat(ids, vec.shape[1]), "vec_id": vec.ravel(), "score": score.ravel()})

        near = rows.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").mapInPandas(search, f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(rows.dtypes)['vec_id']}, score double")
        if n_blocks > 1:  # one block is out at a time
            near = materialise(near, "near")
            sent.destroy()
        out = near if out is None else out.unionByName(near)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
