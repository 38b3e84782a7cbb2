"""The symbol graph: edges, traversal, degrees, components and boundaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.functions.paths import directory
from archgraph.operators.prefix import longest_prefix_join, prefix_pairs
from archgraph.shared import deal, settle, shared_dir


def edge_endpoints(edges: DataFrame, symbols: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each edge with name and file of both ends, joined in ``tasks`` tasks; edges with an unknown end are left out."""
    symbols = deal(symbols, tasks, "id").hint("merge")  # grows with the project
    s = symbols.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("file_path").alias("source_file"), F.col("service").alias("source_service"))
    t = symbols.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("file_path").alias("target_file"), F.col("service").alias("target_service"))
    return edges.join(s, "source").join(t, "target")


def block_of_symbol(symbols: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(id, file_path, block_id) of the symbols in a block, by D2 over distinct files."""
    owner = longest_prefix_join(symbols.select(F.col("file_path").alias("path")), prefixes).withColumnRenamed("path", "file_path")
    return symbols.select("id", "file_path").join(owner, "file_path")


def block_edges(edges: DataFrame, symbols: DataFrame, prefixes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges with files and blocks of both ends, joined in ``tasks`` tasks, only where both have a block."""
    b = deal(block_of_symbol(symbols, prefixes), tasks, "id").hint("merge")
    s = b.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"), F.col("block_id").alias("source_block"))
    t = b.select(F.col("id").alias("target"), F.col("file_path").alias("target_file"), F.col("block_id").alias("target_block"))
    return edges.join(s, "source").join(t, "target")


def callers(edges: DataFrame, symbols: DataFrame, symbol_id: str | Column) -> DataFrame:
    """(direction, id, name, kind) of the neighbours of one symbol; its id may be a scalar subquery."""
    s = symbols.select("id", "name")
    into = edges.filter(F.col("target") == symbol_id).select(F.lit("caller").alias("direction"), F.col("source").alias("id"), F.col("kind").alias("edge"))
    out = edges.filter(F.col("source") == symbol_id).select(F.lit("callee").alias("direction"), F.col("target").alias("id"), F.col("kind").alias("edge"))
    return into.unionByName(out).join(s, "id")


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, n) by target."""
    return edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))


def coupling(edges: DataFrame, symbols: DataFrame, above: int = 20, tasks: int | None = None) -> DataFrame:
    """Files with more than ``above`` distinct targets; edges are joined, and repeats of a file's targets go, in ``tasks`` tasks."""
    f = deal(symbols.select(F.col("id").alias("source"), "file_path"), tasks, "source").hint("merge")
    pairs = deal(edges.join(f, "source").select("file_path", "target"), tasks, "file_path", "target").distinct()
    return pairs.groupBy("file_path").agg(F.count("target").alias("targets")).filter(F.col("targets") > above)


def complexity(symbols: DataFrame, above: int = 30) -> DataFrame:
    """Files with more than ``above`` symbols."""
    return symbols.groupBy("file_path").agg(F.count("*").alias("n_symbols")).filter(F.col("n_symbols") > above)


def direction_counts(edges: DataFrame) -> DataFrame:
    """(block_id, internal, outbound, inbound) of :func:`block_edges`."""
    out = edges.groupBy(F.col("source_block").alias("block_id")).agg(F.count_if(F.col("source_block") == F.col("target_block")).alias("internal"), F.count_if(F.col("source_block") != F.col("target_block")).alias("outbound"))
    into = edges.filter("source_block <> target_block").groupBy(F.col("target_block").alias("block_id")).agg(F.count("*").alias("inbound"))
    return out.join(into, "block_id", "full").select("block_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("internal", "outbound", "inbound")))


def derived_interfaces(edges: DataFrame) -> DataFrame:
    """(block_id, interfaces): the blocks that a block depends on, sorted."""
    return edges.filter("source_block <> target_block").groupBy(F.col("source_block").alias("block_id")).agg(F.sort_array(F.collect_set("target_block")).alias("interfaces"))


def top_symbols(edges: DataFrame, symbols: DataFrame, prefixes: DataFrame, n: int = 5) -> DataFrame:
    """the ``n`` exported symbols of each block with the most incoming edges, none without."""
    s = block_of_symbol(symbols.filter("is_exported"), prefixes).join(symbols.select("id", "name"), "id").join(in_degree(edges), "id")
    w = Window.partitionBy("block_id").orderBy(F.col("n").desc(), "name", "id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("block_id", "rank", "id", "n")


def cross_block_exports(edges: DataFrame, symbols: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Exported symbols used from other blocks, with those blocks sorted."""
    e = block_edges(edges, symbols, prefixes).filter("source_block <> target_block")
    e = e.join(symbols.filter("is_exported").select(F.col("id").alias("target")), "target", "left_semi")
    return e.groupBy(F.col("target").alias("id"), F.col("target_block").alias("block_id")).agg(F.sort_array(F.collect_set("source_block")).alias("consumers"))


def module_steps(edges: DataFrame, symbols: DataFrame, direction: str = "dependencies") -> DataFrame:
    """(a, b) of edges between different files, each pair once; ``direction`` is dependencies, dependents or both."""
    e = edge_endpoints(edges, symbols).select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).filter("a <> b").distinct()
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return {"dependencies": e, "dependents": back, "both": e.unionByName(back).distinct()}[direction]


def traverse_all(edges: DataFrame, symbols: DataFrame, starts: DataFrame, depth: int = 3, direction: str = "dependencies") -> DataFrame:
    """H9: (start, file, depth) for every start of ``starts(start, prefix)``: files reached from those under its prefixes, at their least depth.

    A step goes from a file along an edge to another file and on from all files of its directory.
    Breadth first, so a file reached at the last depth on one path is still expanded on a shorter
    one. All starts move together. Each of at most five steps is one join and one anti-join over
    written tables, so plans stay of one size whatever the depth and nothing runs twice. Case of
    prefixes is ignored; null starts and prefixes reach nothing.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1 to 5")
    spark = edges.sparkSession
    e = settle(module_steps(edges, symbols, direction), "steps")
    steps = settle(e.select(directory(F.col("a")).alias("dir"), "b").distinct(), "directory-steps")
    root = f"{shared_dir(spark)}/archgraph/{spark.sparkContext.applicationId}/reached-{uuid.uuid4().hex}"
    begun = prefix_pairs(e.select("a").distinct(), starts.filter("start is not null").select("start", "prefix"), path="a", fold=True).select("start", "a").distinct()
    kind = starts.schema["start"].dataType.simpleString()
    begun.join(e, "a").select("start", F.col("b").alias("file")).distinct().write.parquet(f"{root}/depth=1")
    seen = lambda: spark.read.schema(f"start {kind}, file string, depth int").option("basePath", root).parquet(root)
    for d in range(2, depth + 1):
        reached = seen()
        dirs = reached.filter(F.col("depth") == d - 1).select("start", directory(F.col("file")).alias("dir")).distinct()
        new = dirs.join(steps, "dir").select("start", F.col("b").alias("file")).distinct().join(reached.select("start", "file"), ["start", "file"], "left_anti")
        new.write.parquet(f"{root}/depth={d}")
    return seen()


def traverse(edges: DataFrame, symbols: DataFrame, prefix: str, depth: int = 3, direction: str = "dependencies") -> DataFrame:
    """H9: (file, depth) of :func:`traverse_all` from one prefix."""
    starts = edges.sparkSession.createDataFrame([("one", prefix)], "start string, prefix string")
    return traverse_all(edges, symbols, starts, depth, direction).select("file", "depth")


def component_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Render edges with both ends among the components."""
    ids = components.select("id")
    return edges.filter("kind = 'renders'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def boundaries(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Render edges over the client boundary; an end without a component row is on the server."""
    c = components.select("id", "is_client")
    s, t = c.toDF("source", "source_client"), c.toDF("target", "target_client")
    e = edges.filter("kind = 'renders'").join(s, "source", "left").join(t, "target", "left").filter(F.col("source_client").isNotNull() | F.col("target_client").isNotNull())
    e = e.select("source", "target", F.coalesce("source_client", F.lit(False)).alias("from_client"), F.coalesce("target_client", F.lit(False)).alias("to_client"))
    return e.filter("from_client <> to_client").select("source", "target", F.when(F.col("to_client"), "valid").otherwise("violation").alias("verdict"))


def component_graph(edges: DataFrame, components: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, file_path, name, is_client, children, parents): every component with the sorted names that it renders and that render it."""
    e = component_edges(edges, components)
    name = symbols.select("id", "name")
    kids = e.join(name.toDF("target", "n"), "target").groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("n")).alias("children"))
    up = e.join(name.toDF("source", "n"), "source").groupBy(F.col("target").alias("id")).agg(F.sort_array(F.collect_set("n")).alias("parents"))
    none = F.array().cast("array<string>")
    return components.select("id", "file_path", "is_client").join(name, "id").join(kids, "id", "left").join(up, "id", "left").select("id", "file_path", "name", "is_client", F.coalesce("children", none).alias("children"), F.coalesce("parents", none).alias("parents"))


def file_symbols(symbols: DataFrame, prefix: str) -> DataFrame:
    """(file_path, symbols): the sorted symbols of each file under ``prefix``, ignoring case; shown where no edges are known."""
    s = symbols.filter(F.lower("file_path").startswith(prefix.lower()))
    return s.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("name", "kind", "is_exported"))).alias("symbols"))


def server_imports(edges: DataFrame, symbols: DataFrame, components: DataFrame, changed: DataFrame) -> DataFrame:
    """(file, imports): changed files(path) with a client component, and the files of server actions that they import from.

    ``components`` needs is_client and is_server_action.
    """
    clients = components.filter("is_client").join(symbols.select("id", F.col("file_path").alias("file")), "id").select("file").join(changed.select(F.col("path").alias("file")), "file", "left_semi").distinct()
    actions = components.filter("is_server_action").select(F.col("id").alias("target"))
    e = edges.filter("kind = 'imports'").join(actions, "target", "left_semi")
    s, t = symbols.select(F.col("id").alias("source"), F.col("file_path").alias("file")), symbols.select(F.col("id").alias("target"), F.col("file_path").alias("imports"))
    return e.join(s, "source").join(clients, "file", "left_semi").join(t, "target").select("file", "imports").distinct()


def select_components(components: DataFrame, prefix: str | None = None, client_only: bool = False, with_state: bool = False) -> DataFrame:
    """components(file_path, is_client, has_state) under a prefix, ignoring case, in the client, with state; all that is asked for."""
    if prefix is not None:
        components = components.filter(F.lower("file_path").startswith(prefix.lower()))
    if client_only:
        components = components.filter("is_client")
    return components.filter("has_state") if with_state else components


def dashboard(symbols: DataFrame, edges: DataFrame, activity: DataFrame) -> DataFrame:
    """One row: symbols, files, services, edges and the time of the last activity."""
    s = symbols.agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"), F.countDistinct("service").alias("services"))
    return s.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(activity.agg(F.max("recorded_at").alias("last_at")))  # one row each
