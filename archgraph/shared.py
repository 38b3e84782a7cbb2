"""Tables written to the folder that driver and executors share, where a plan would otherwise compute them again."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without it gets a temporary folder, a cluster without it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="archgraph-"))
    return base.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: its plan ends there, and a lost executor costs its tasks alone."""
    path = f"{shared_dir(df.sparkSession)}/archgraph/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`settle` that nothing reads any more."""
    delete(df.sparkSession, df._scratch)


def tasks_for(spark: SparkSession, path: str, per_task: int) -> int:
    """How many tasks give each about ``per_task`` bytes of the files at ``path``, at least one for each core; a task's share then stays as the files grow."""
    fs, p = path_of(spark, path)
    return max(spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(p).getLength() // per_task))


def deal(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` over so many tasks by a hash of ``keys``; without a number as Spark deals it, whose own number of partitions stays as tables grow."""
    return df if tasks is None else df.repartition(tasks, *keys)


def path_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = path_of(spark, path)
    fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing refers to any more, which else stay until the driver happens to collect its garbage.

    The first round drops what Python held, the second what the JVM held for it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
