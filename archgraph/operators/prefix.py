"""Prefix joins.

Written as equi-joins: the lengths of the prefixes are few, so each path is cut to each length and
joined by equality. The result is that of a ``startswith`` join (string prefixes, not segments, an
empty prefix included), but it plans as a hash or merge join whatever the size of either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folded(c: Column, fold: bool) -> Column:
    return F.lower(c) if fold else c


def prefix_pairs(items: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix", fold: bool = False) -> DataFrame:
    """Each row of ``items`` with each row of ``prefixes`` whose prefix its path starts with. Null paths and prefixes match nothing.

    ``fold`` ignores ASCII case. Columns of both sides are kept, so their names must differ.
    """
    lengths = prefixes.select(F.length(prefix).alias("_n")).filter("_n is not null").groupBy().agg(F.collect_set("_n").alias("_lengths"))
    cut = items.crossJoin(F.broadcast(lengths))  # one row: the lengths that occur
    cut = cut.select("*", F.explode(F.filter("_lengths", lambda n: n <= F.length(path))).alias("_n"))
    cut = cut.withColumn("_key", _folded(F.expr(f"substring({path}, 1, _n)"), fold)).drop("_lengths")
    p = prefixes.withColumn("_pkey", _folded(F.col(prefix), fold)).withColumn("_pn", F.length(prefix))
    return cut.join(p, (F.col("_key") == F.col("_pkey")) & (F.col("_n") == F.col("_pn"))).drop("_n", "_key", "_pkey", "_pn")


def longest_prefix_join(items: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix", owner: str = "block_id", keep_unmatched: bool = False) -> DataFrame:
    """Each distinct path with the owner of its longest prefix, the smallest owner on a tie."""
    paths = items.select(path).filter(F.col(path).isNotNull()).distinct()
    longest = F.min(F.struct(-F.length(prefix), owner))  # an aggregate with a map side, where a window would sort all pairs
    best = prefix_pairs(paths, prefixes.select(owner, prefix), path, prefix).groupBy(path).agg(longest.alias("_best")).select(path, F.col(f"_best.{owner}").alias(owner))
    return paths.join(best, path, "left") if keep_unmatched else best


def without_prefix(items: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix", fold: bool = False) -> DataFrame:
    """The rows of ``items`` whose path starts with none of the prefixes."""
    hit = prefix_pairs(items.select(path).distinct(), prefixes.select(prefix).distinct(), path, prefix, fold).select(path).distinct()
    return items.join(hit, path, "left_anti")


def unused_prefixes(prefixes: DataFrame, items: DataFrame, path: str = "path", prefix: str = "prefix", fold: bool = False) -> DataFrame:
    """The rows of ``prefixes`` that no path starts with."""
    used = prefix_pairs(items.select(path).distinct(), prefixes.select(prefix).distinct(), path, prefix, fold).select(prefix).distinct()
    return prefixes.join(used, prefix, "left_anti")


def within_prefixes(items: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix", fold: bool = False) -> DataFrame:
    """The rows of ``items`` whose path starts with one of the prefixes at least."""
    hit = prefix_pairs(items.select(path).distinct(), prefixes.select(prefix).distinct(), path, prefix, fold).select(path).distinct()
    return items.join(hit, path, "left_semi")


def first_prefix_join(items: DataFrame, prefixes: DataFrame, order: str = "ord", path: str = "path", prefix: str = "prefix", owner: str = "block_id") -> DataFrame:
    """D3: each distinct path with the owner of the first prefix, by ``order``, that it starts with, however long; the smallest owner on a tie.

    For blocks in the order in which they are declared. Where that order is not meant,
    :func:`longest_prefix_join` gives a result that does not depend on it.
    """
    paths = items.select(path).filter(F.col(path).isNotNull()).distinct()
    pairs = prefix_pairs(paths, prefixes.select(owner, prefix, order), path, prefix)
    return pairs.groupBy(path).agg(F.min(F.struct(order, owner)).alias("_first")).select(path, F.col(f"_first.{owner}").alias(owner))
