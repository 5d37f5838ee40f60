"""Session helpers: shared checkpoint folder, materialised intermediate tables, table loading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run
    on this machine (tests). A cluster without the setting is an error: its executors would write to disks of their own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    own = os.path.join(tempfile.gettempdir(), f"corpusloom-{os.getuid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as parquet below the shared folder and read it back: lineage is cut, the copy survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(since: int = 0) -> None:
    """Deletes the intermediate tables written after the first `since`; none of their readers may be used again."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables written inside are deleted at its end: for services that answer many requests."""
    since = len(_written)
    try:
        yield
    finally:
        release(since)


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer partitions than half of them, as a table of one small file does; a table of many
    files stays where it is. For plans that spend long on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
