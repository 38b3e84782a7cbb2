"""What the operators share: the shared scratch folder, settled tables and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The class of characters that separate words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}
#: Paths handed out by :func:`scratch` and not deleted since.
PATHS: list[str] = []
#: What :func:`kept` holds in this process.
_KEPT: dict = {}
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned() -> Iterator[list[str]]:
    """The list of the paths that :func:`scratch` hands out to this thread until the block ends; other runs have lists of their own."""
    paths: list[str] = []
    token = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(token)


def kept(key: Hashable, make: Callable):
    """What ``make()`` gave, which stays in this process until another key is asked for.

    Spark's Python workers serve one operator after another; only the tables of the one at work are held.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Give the system back what this process has freed; the C library, where it can be asked to, else holds it for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets one temporary folder per
    application. A cluster without it is refused, since a machine-local folder would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="archgraph-")
        base = _LOCAL[app]
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, not yet there."""
    path = f"{shared_dir(spark)}/archgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    PATHS.append(path)
    if (owner := _OWNER.get()) is not None:
        owner.append(path)
    return path


def settle(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there.

    A lost executor then costs only the tasks that ran on it, and nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`settle` that nothing reads any more."""
    delete(df.sparkSession, getattr(df, "_scratch", None))


def delete(spark: SparkSession, path: str | None) -> None:
    if path:
        if path in PATHS:
            PATHS.remove(path)
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing refers to any more.

    It acts on the driver's garbage collection, which may be long in coming while jobs run on. The
    first round drops what Python held, the second what the JVM held for it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node of ``edges(u, v)``; component_id is the smallest node reachable.

    Large-star and small-star steps alternate until the edges form stars. Each step is one
    aggregate with partial sums and one equi join of written tables, so that a hub with a third
    of the edges is pre-aggregated on the map side and its join side can be split by AQE. The
    number of steps grows with the logarithm of the longest path. Self-loops and repeats are
    allowed; nodes may be longs or strings. An empty input gives an empty result.
    """
    both = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u"))
    cur = settle(both.select("u", "v").distinct(), "cc")
    loops = cur.filter("u = v").select("u", "v")
    state = None
    while True:
        sym = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid = settle(large.filter("u <> v").distinct(), "cc-large")
        # small star: u and its smaller neighbours go to the least of them
        low2 = settle(mid.groupBy("u").agg(F.min("v").alias("m")), "cc-low2")
        small = mid.join(low2, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        new = settle(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "cc")
        for t in (low, mid, low2):
            forget(t)
        now = _digest(new)
        if now == state:
            break
        if state is not None:
            forget(cur)
        cur, state = new, now
    stars = new.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    roots = new.select(F.col("v").alias("node"), F.col("v").alias("component_id"))
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component_id")).join(stars.unionByName(roots).select("node"), "node", "left_anti")
    return stars.unionByName(roots.distinct()).unionByName(alone)


def segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, columns) of each run of equal values in the first ``keys`` columns of sorted batches.

    The columns must be numbers without nulls. One run is held at a time, so its size must be bounded.
    """
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        n = len(cols[0])
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield tuple(c[i] for c in cols[:keys]), [c[i:j] for c in cols[keys:]]
        held = [c[starts[-1] :] for c in cols]
    if held is not None and len(held[0]):
        yield tuple(c[0] for c in held[:keys]), [c for c in held[keys:]]


def in_cells(rows: DataFrame, keys: list[str], values: list[str], side: int = 2048) -> DataFrame:
    """Deal ``rows(keys.., home, values..)`` into cells of a bounded number of rows, sorted by key and cell.

    Rows with ``home`` = 1 meet all rows with ``home`` = 0 of their key. A key with more than
    ``side`` rows of either kind becomes a grid: homes are dealt over its lines and visitors over
    its columns by a hash, and each is sent to every cell of its line or column, so that each
    home still meets each visitor in one cell. The hot keys are broadcast: callers use keys from a
    code or block of fixed width, which bounds their number whatever the input.
    """
    many = rows.groupBy(*keys).agg(F.sum("home").alias("h"), F.sum(1 - F.col("home")).alias("v")).filter(F.greatest("h", "v") > side)
    hot = many.select(*keys, F.ceil(F.col("h") / side).cast("int").alias("p"), F.ceil(F.col("v") / side).cast("int").alias("q"))
    d = rows.join(F.broadcast(hot), keys, "left").withColumns({"p": F.coalesce("p", F.lit(1)), "q": F.coalesce("q", F.lit(1))})
    mine = F.pmod(F.xxhash64(*values), F.when(F.col("home") == 1, F.col("p")).otherwise(F.col("q"))).cast("int")
    line = F.when(F.col("home") == 1, F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: mine * F.col("q") + j)).otherwise(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: i * F.col("q") + mine))
    dealt = d.select(*keys, F.explode(line.cast("array<bigint>")).alias("cell"), F.col("home").cast("long").alias("home"), *values)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys, "cell").sortWithinPartitions(*keys, "cell")


def spanning_labels(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between rows and columns (bool matrix) the least column of each row's and column's component.

    A row without links gets the number of columns; a column without links stays itself.
    """
    n = near.shape[1]
    label, none = np.arange(n, dtype=np.int32), np.int32(n)
    while True:  # the least label travels along links until it stays
        of_row = np.where(near, label, none).min(1, initial=none)
        new = np.minimum(label, np.where(near, of_row[:, None], none).min(0, initial=none))
        if (new == label).all():
            return of_row, label
        label = new
