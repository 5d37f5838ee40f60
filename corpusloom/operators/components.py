"""Connected components of a link table, without gathering links or components on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

#: Tasks among which a hub's links are split.
SALT = 8


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): component is the least node that links lead to. Alternates large-star and small-star steps
    (Kiveris et al. 2014) until the links no longer change, O(log n) rounds; raises if they still do after max_rounds.

    Links with a null end or both ends equal are left out; nodes without any link don't appear. A step is a groupBy for each
    node's least neighbour, combined before the shuffle, and a join of the links with it; a hub's links are dealt to SALT
    tasks for the join, so none gets them all.
    """
    edges = materialise(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v").distinct(), "cc")
    last, salts = None, F.array(*[F.lit(k) for k in range(SALT)])

    def with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
        salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
        return salted.join(least.withColumn("_salt", F.explode(salts)), ["u", "_salt"])

    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components are not finished after {max_rounds} rounds")
    leaf = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return leaf.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(leaf.select("node"), "node", "left_anti"))
