"""Corpus kept current by a stream of pages: an extension, the batch engine polls and compares manifests instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import chunks_of_pages, text_hash
from corpusloom.sources.store import Store

PAGE = "source string, page int, text string, version long"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGE).parquet(folder)


def newest(pages: DataFrame) -> DataFrame:
    """Pages of each source's newest version."""
    top = pages.groupBy("source").agg(F.max("version").alias("version"))
    return pages.join(top, ["source", "version"], "left_semi")


def apply_batch(spark: SparkSession, out: str, pages: DataFrame, batch_id: int, buckets: int = 256, **cut) -> None:
    """One micro-batch: chunks of the changed sources replace their older ones. Only the buckets that hold changed sources are
    read and written; a commit is a log file of its own, so a batch that is run again changes nothing and one that is lost
    half-way leaves the corpus before it."""
    store = Store(spark, out, buckets)
    top = pages.groupBy("source").agg(F.max("version").alias("version"))
    old = store.read()
    if old is not None:
        seen = old.join(top.select("source"), "source", "left_semi").groupBy("source").agg(F.max("version").alias("_seen"))
        top = top.join(seen, "source", "left").where(F.col("_seen").isNull() | (F.col("_seen") < F.col("version"))).select("source", "version")
    fresh = newest(pages).join(top, ["source", "version"], "left_semi").select("source", "page", "version", "text")
    new = chunks_of_pages(fresh, **cut).withColumn("text_hash", text_hash(F.col("text"))).dropDuplicates(["source", "page", "chunk_ord"])
    store.commit(new, top, batch_id)


def keep_current(stream: DataFrame, out: str, checkpoint: str, **cut):
    """The running query; every trigger folds the arrived pages into the corpus below out."""
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(lambda df, n: apply_batch(spark, out, df, n, **cut)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The corpus as the newest commit left it; raises where there is none."""
    rows = Store(spark, out).read()
    if rows is None:
        raise FileNotFoundError(out)
    return rows
