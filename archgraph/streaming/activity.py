"""Streaming forms of the activity log and of the changed set. Extensions: the inventory has no streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_activity(spark: SparkSession, path: str, schema) -> DataFrame:
    """The append-only log as a stream of its Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def daily(activity: DataFrame, lateness: str = "1 day") -> DataFrame:
    """E5 as a stream: rows and cost of each day, closed when ``lateness`` has passed."""
    w = activity.withWatermark("recorded_at", lateness).groupBy(F.window("recorded_at", "1 day"))
    return w.agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("cost", 4).alias("cost"))


def incremental(changes: DataFrame, apply, checkpoint: str):
    """H29 as a stream: ``apply(batch, id)`` for each micro-batch of changed files, once."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def changed_files(files: DataFrame, groups: int = 1 << 14) -> DataFrame:
    """G3, G4, H29 as a stream: (path, change, batch) of files(path, content_hash, batch), a null hash saying that the file is gone.

    The state of a path is its last hash. A path first seen is added, another hash is modified, the
    same one unchanged, and a mark for a known path removed, after which it is unknown again; a mark
    for an unknown one says nothing. Of several rows of a path in one micro-batch those of the
    largest ``batch`` number decide, and of these the largest hash. Rows without a path are dropped.
    State and offsets are in the query's checkpoint, so a restart goes on where it ended.

    A call of Python costs milliseconds whatever it is given, so paths are kept by hash in at most
    ``groups`` groups and a call takes all rows of one. A micro-batch rewrites the state of the
    groups that it has rows of, so take more for many millions of paths; a checkpoint holds on to its number.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple] = {}
        for part in rows:
            for path, h, b in zip(part["path"], part["content_hash"], part["batch"], strict=True):
                row = (b, h is not None, h or "")
                if path not in last or row > last[path]:
                    last[path] = row
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for path, (batch, there, new) in last.items():
            old = known.get(path)
            if there:
                out.append((path, "added" if old is None else "modified" if old != new else "unchanged", batch))
                known[path] = new
            elif old is not None:
                out.append((path, "removed", batch))
                del known[path]
        if known:
            state.update((list(known), list(known.values())))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["path", "change", "batch"])

    keyed = files.filter("path is not null").withColumn("slot", F.pmod(F.xxhash64("path"), F.lit(groups))).groupBy("slot")
    return keyed.applyInPandasWithState(step, "path string, change string, batch long", "paths array<string>, hashes array<string>", "append", "NoTimeout")
