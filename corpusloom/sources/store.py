"""A corpus on disk in buckets of sources: versions are written beside each other, a log file for each commit names the
current one of every bucket. Readers see a whole corpus at any time; a commit that is lost half-way leaves the one before."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Rows belong to a `source`; a commit rewrites only the buckets that hold changed sources."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> dict:
        """The newest commit: {"commit", "batch", "buckets": {bucket: folder}}; an empty one where there is none."""
        folder = self._path(f"{self.path}/_log")
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        done = [n for n in names if n.endswith(".json")]
        if not done:
            return {"commit": -1, "batch": -1, "meta": {}, "buckets": {}}
        return json.loads(self._read(f"{self.path}/_log/{done[-1]}"))

    def read(self) -> DataFrame | None:
        """The current rows, None where nothing was committed or nothing is left."""
        folders = sorted(set(self.log()["buckets"].values()))
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in folders]) if folders else None

    def _read(self, path: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(path).collect())  # one small document

    def write_text(self, path: str, text: str) -> None:
        """Written under another name and renamed, so that a reader never sees half of it."""
        part = self._path(f"{path}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        final = self._path(path)
        if self._fs.exists(final):
            self._fs.delete(final, False)
        self._fs.rename(part, final)

    def commit(self, new: DataFrame, touched: DataFrame, batch: int | None = None, meta: dict | None = None) -> int:
        """Replaces all rows of the touched sources (source) by the new rows of these; sources without a new row are removed.
        A batch that was committed before changes nothing, so it may be run again."""
        log = self.log()
        if batch is not None and log["batch"] >= batch:
            return log["commit"]
        n = log["commit"] + 1
        bucket = F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int")
        keys = [r["b"] for r in touched.select(bucket.alias("b")).distinct().collect()]  # at most as many as buckets
        old = [log["buckets"][str(k)] for k in keys if str(k) in log["buckets"]]
        rows = new
        if old:
            kept = self.spark.read.parquet(*[f"{self.path}/{x}" for x in old]).join(touched.select("source").distinct(), "source", "left_anti")
            rows = kept.unionByName(new, allowMissingColumns=True)
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v{n}")
        made = {x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/v{n}")) if x.isDirectory()}
        now = {b: f for b, f in log["buckets"].items() if int(b) not in keys}
        now |= {str(k): f"v{n}/_bucket={k}" for k in keys if f"_bucket={k}" in made}
        record = {"commit": n, "batch": batch if batch is not None else log["batch"], "meta": log["meta"] | (meta or {}), "buckets": now}
        self.write_text(f"{self.path}/_log/{n:012d}.json", json.dumps(record))
        return n
