"""Block proposals by directory clustering."""

from __future__ import annotations

import re
from itertools import chain, count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.functions.paths import dir_with_slash
from archgraph.shared import settle

# Folder names that say nothing, and such that say something only as the last one.
EMPTY_NAMES = {"src", "source", "packages"}
WEAK_NAMES = {"app", "lib", "apps"}


def common_folder(low: Column, high: Column) -> Column:
    """The deepest folder that holds two folders; of the least and the largest one, all between."""
    a, b = F.split(low, "/"), F.split(high, "/")
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(differs == 0, low).when(differs == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), differs.cast("int") - 1), "/"), F.lit("/")))


def folder_rollup(files: DataFrame, min_files: int) -> DataFrame:
    """(service, folder, parent, n): the folders of files(service, path) with ``min_files`` files or more below the service's common folder, and that folder itself, with null as parent."""
    folders = files.select("service", "path").distinct().groupBy("service", dir_with_slash(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))
    root = folders.groupBy("service").agg(F.min("dir").alias("low"), F.max("dir").alias("high"), F.sum("n").alias("n")).select("service", common_folder(F.col("low"), F.col("high")).alias("root"), "n")
    parts = F.split("dir", "/")
    upto = lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(upto(i).alias("folder"), upto(i - 1).alias("parent")))
    levels = folders.filter("dir <> ''").select("service", F.explode(up).alias("f"), "n").groupBy("service", "f.folder", "f.parent").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_files)
    below = levels.join(root.select("service", "root"), "service").filter(F.startswith("folder", "root") & (F.col("folder") != F.col("root"))).drop("root")
    return below.unionByName(root.select("service", F.col("root").alias("folder"), F.lit(None).cast("string").alias("parent"), "n"))


def cluster(files: DataFrame, max_blocks: int = 12, min_files: int = 3) -> DataFrame:
    """(service, prefix, n_files, place): prefixes that cover all files(service, path) of each service, in the order in which they are found.

    The prefix with most files splits into its children of ``min_files`` files or more, as long as
    all of them fit ``max_blocks``; a tie goes to the prefix found first, and a parent stays only
    while files are left in it. A child has no more files than its parent, so the splits come in
    the order of the files below a folder, then of the same of its ancestors, then of names: a
    running sum over the folders in that order says where a service's splits end, and no loop is
    needed. Of all services together; a window sees ``max_blocks`` folders of a service at most,
    since each split but one into a single child that takes all files adds a prefix.
    """
    nodes = settle(folder_rollup(files, min_files), "folders")
    split = nodes.filter("parent is not null").groupBy("service", F.col("parent").alias("folder")).agg(F.count("*").alias("k"), F.sum("n").alias("taken"))
    # of each folder that can split, its files and those of all above, nearest first
    depth = F.size(F.split("folder", "/"))
    above = split.select("service", "folder", F.explode(F.transform(F.sequence(F.lit(0), depth - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("folder", "/"), F.lit(1), i), "/"), F.lit("/"))))).alias("above")).distinct()
    sizes = above.join(nodes.select("service", F.col("folder").alias("above"), F.col("n").alias("m")), ["service", "above"])
    order = sizes.groupBy("service", "folder").agg(F.sort_array(F.collect_list(F.struct((-F.length("above")).alias("l"), (-F.col("m")).alias("m")))).alias("o")).select("service", "folder", F.struct(F.col("o.m").alias("sizes"), F.col("folder").alias("name")).alias("key"))
    split = settle(split.join(nodes.select("service", "folder", "n"), ["service", "folder"]).join(order, ["service", "folder"]).withColumn("left", F.col("n") - F.col("taken")), "splits")
    counted = split.filter("not (k = 1 and left = 0)")
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("service").orderBy("key"))).filter(F.col("r") <= max_blocks)
    w = Window.partitionBy("service").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = first.withColumn("after", 1 + F.sum(F.col("k") - F.when(F.col("left") == 0, 1).otherwise(0)).over(w))
    before = F.col("after") - F.col("k") + F.when(F.col("left") == 0, 1).otherwise(0)
    ends = held.groupBy("service").agg(F.min(F.when(before + F.col("k") > max_blocks, F.col("key"))).alias("stop"), F.min(F.when(F.col("after") >= max_blocks, F.col("key"))).alias("last"))
    done = split.join(ends, "service", "left").filter((F.col("stop").isNull() | (F.col("key") < F.col("stop"))) & (F.col("last").isNull() | (F.col("key") <= F.col("last"))) & F.lit(max_blocks > 1))
    done = done.select("service", F.col("folder").alias("parent"), F.col("key").alias("found"), "left")
    found = nodes.join(done.select("service", "parent", "found"), ["service", "parent"], "left").filter("parent is null or found is not null")
    own = found.join(done.select("service", F.col("parent").alias("folder"), "left"), ["service", "folder"], "left").withColumn("n_files", F.coalesce("left", "n")).filter("n_files > 0")
    place = F.row_number().over(Window.partitionBy("service").orderBy(F.col("parent").isNotNull(), "found", "folder"))  # max_blocks rows at most
    return own.select("service", F.col("folder").alias("prefix"), "n_files", place.alias("place"))


def kebab(text: str) -> str:
    """Words, also those that only a capital begins, in lower case with hyphens."""
    return "-".join(re.findall("[a-z0-9]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", "-", text).lower()))


def block_ids(prefixes: list[str], service: str) -> dict[str, str]:
    """An id of each prefix from its last two telling names; repeats get a number."""
    ids: dict[str, str] = {}
    for prefix in prefixes:
        *above, last = list(filter(None, prefix.split("/"))) or [""]
        telling = [x for x in above if x.lower() not in EMPTY_NAMES | WEAK_NAMES] + [x for x in [last] if x.lower() not in EMPTY_NAMES]
        plain = "-".join(x for x in map(kebab, telling[-2:]) if x) or kebab(service) or "root"
        taken = set(ids.values())
        ids[prefix] = next(x for x in chain([plain], (f"{plain}-{i}" for i in count(2))) if x not in taken)
    return ids


def title_case(block_id: Column) -> Column:
    """The name of an id: its words with a capital each."""
    return F.array_join(F.transform(F.split(block_id, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def propose_services(symbols: DataFrame, max_blocks: int = 12, min_files: int = 3) -> DataFrame:
    """(service, block_id, name, prefix, n_files, confidence) of symbols(service, file_path), each service by itself.

    Confidence is high from three times ``min_files`` files on, medium from ``min_files``. Ids are
    unique within a service. Rows without a service or a file are left out.
    """
    files = symbols.filter("file_path is not null and service is not null").select("service", F.col("file_path").alias("path"))

    def named(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("place")
        ids = block_ids(some["prefix"].tolist(), some["service"].iloc[0])
        return pd.DataFrame({"service": some["service"], "block_id": some["prefix"].map(ids), "prefix": some["prefix"], "n_files": some["n_files"]})

    # a group is a service's blocks, max_blocks at most
    blocks = cluster(files, max_blocks, min_files).groupBy("service").applyInPandas(named, "service string, block_id string, prefix string, n_files long")
    sure = F.when(F.col("n_files") >= 3 * min_files, "high").when(F.col("n_files") >= min_files, "medium").otherwise("low")
    return blocks.select("service", "block_id", title_case(F.col("block_id")).alias("name"), "prefix", "n_files", sure.alias("confidence"))


def propose(symbols: DataFrame, service: str = "main", max_blocks: int = 12, min_files: int = 3) -> DataFrame:
    """(block_id, prefix, n_files, confidence) of :func:`propose_services` with all symbols taken for one service."""
    one = symbols.select(F.lit(service).alias("service"), "file_path")
    return propose_services(one, max_blocks, min_files).select("block_id", "prefix", "n_files", "confidence")
