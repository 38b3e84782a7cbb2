"""Stored layouts that searches and joins read less of: sorted symbols with postings (C2-C5) and buckets by symbol."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.operators.containment import GRAM, _grams
from archgraph.shared import shared_dir


def build_search_index(symbols: DataFrame, path: str, files: int | None = None) -> None:
    """Write symbols with ``name_low`` and ``path_low``, sorted by path, to ``path``/rows, and (gram, id) of names, sorted by gram, to ``path``/grams.

    Sorting lets Parquet skip files and row groups outside a range; ties of a path or gram are cut
    by id, so that no file holds all of a hot one.
    """
    n = files or int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = symbols.withColumns({"name_low": F.lower("name"), "path_low": F.lower("file_path")})
    low.repartitionByRange(n, "path_low", "id").sortWithinPartitions("path_low", "id").write.parquet(f"{path}/rows")
    grams = low.select("id", F.explode(_grams(F.col("name_low"), F.lit(GRAM))).alias("gram"))
    grams.repartitionByRange(n, "gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/grams")


def find_symbols(spark: SparkSession, path: str, query: str | None = None, file_path: str | None = None, service: str | None = None, kind: str | None = None, is_exported: bool | None = None) -> DataFrame:
    """C2-C5 over a built index: symbols whose name contains ``query`` and whose file starts with ``file_path``, ignoring case, and that have the other values given.

    A file prefix is a range of the stored lower-case path. A query of three characters and more
    is looked up by the one of its grams with the fewest postings, shorter ones are tried on the
    stored lower-case names. All symbols that fit, in no order.
    """
    rows = spark.read.parquet(f"{path}/rows")
    for name, value in (("service", service), ("kind", kind), ("is_exported", is_exported)):
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    if file_path:
        low = file_path.lower()
        rows = rows.filter((F.col("path_low") >= low) & (F.col("path_low") < low + chr(0x10FFFF)))
    if query:
        low = query.lower()
        rows = rows.filter(F.contains("name_low", F.lit(low)))
        if len(low) >= GRAM:
            postings = spark.read.parquet(f"{path}/grams")
            own = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
            held = {r["gram"]: r["count"] for r in postings.filter(F.col("gram").isin(*own)).groupBy("gram").count().collect()}  # a row for each gram of the query
            rarest = min(own, key=lambda g: (held.get(g, 0), g))
            rows = rows.join(postings.filter(F.col("gram") == rarest).select("id"), "id", "left_semi")
    return rows.drop("name_low", "path_low")


class GraphTables:
    """Symbols bucketed and sorted by id, edges by source and again by target, so that joins on ids shuffle no symbols."""

    def __init__(self, symbols: DataFrame, edges: DataFrame, buckets: int | None = None) -> None:
        self.spark = spark = symbols.sparkSession
        # as many buckets as shuffles have partitions, so that the other side of a join is dealt to them
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        mark = uuid.uuid4().hex
        self.names = {}
        for table, df, key in (("symbols", symbols, "id"), ("by_source", edges, "source"), ("by_target", None, "target")):
            df = self.by_source if df is None else df  # edges are worked out once
            name = self.names[table] = f"archgraph_{table}_{mark}"
            df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/archgraph/{name}").saveAsTable(name)

    @property
    def symbols(self) -> DataFrame:
        return self.spark.table(self.names["symbols"])

    @property
    def by_source(self) -> DataFrame:
        return self.spark.table(self.names["by_source"])

    @property
    def by_target(self) -> DataFrame:
        return self.spark.table(self.names["by_target"])

    def neighbours(self, symbol_id: str | Column) -> DataFrame:
        """(direction, id, name, kind) of the neighbours of one symbol; of each order of the edges one bucket is read."""
        into = self.by_target.filter(F.col("target") == symbol_id).select(F.lit("caller").alias("direction"), F.col("source").alias("id"), F.col("kind").alias("edge"))
        out = self.by_source.filter(F.col("source") == symbol_id).select(F.lit("callee").alias("direction"), F.col("target").alias("id"), F.col("kind").alias("edge"))
        return into.unionByName(out).join(self.symbols.select("id", "name"), "id")

    def in_degree(self) -> DataFrame:
        """E19 without a shuffle."""
        return self.by_target.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))

    def drop(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
