"""Changed sets, snapshots and name resolution."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.operators.prefix import within_prefixes
from archgraph.shared import settle


def search(symbols: DataFrame, query: str | None = None, service: str | None = None, kind: str | None = None, file_path: str | None = None, is_exported: bool | None = None, prefixes: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Symbols by the filters that are given, by name then id; at most 200. Substring and prefix ignore case."""
    tests = []
    if query is not None:
        tests.append(F.lower("name").contains(query.lower()))
    if service is not None:
        tests.append(F.col("service") == service)
    if kind is not None:
        tests.append(F.col("kind") == kind)
    if file_path is not None:
        tests.append(F.lower("file_path").startswith(file_path.lower()))
    if is_exported is not None:
        tests.append(F.col("is_exported") == is_exported)
    out = symbols.filter(reduce(and_, tests)) if tests else symbols
    if prefixes is not None:
        out = within_prefixes(out, prefixes, path="file_path", fold=True)
    return out.orderBy("name", "id").limit(min(limit, 200))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of files(path, content_hash): added, modified, removed or unchanged."""
    o, n = old.select("path", F.col("content_hash").alias("old_hash")), new.select("path", F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return o.join(n, "path", "full").select("path", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The rows of both by key, those of ``new`` winning, of several the last by ``order``."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("_r = 1").drop("_r")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Set semantics on the keys, what is there stays."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def delete_scope(symbols: DataFrame, edges: DataFrame, files: DataFrame, components: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Symbols, edges and, if given, components without the symbols of ``files(file_path, service, language)``, of edges at either end."""
    gone = symbols.join(files, ["file_path", "service", "language"], "left_semi").select("id").hint("merge")  # grows with the project
    kept = edges.join(gone.withColumnRenamed("id", "source").hint("merge"), "source", "left_anti").join(gone.withColumnRenamed("id", "target").hint("merge"), "target", "left_anti")
    rest = (components.join(gone, "id", "left_anti"),) if components is not None else ()
    return symbols.join(gone, "id", "left_anti"), kept, *rest


def prune_services(symbols: DataFrame, keep: list[str]) -> DataFrame:
    """Symbols of the kept services; none at all when nothing is kept."""
    return symbols.filter(F.col("service").isin(*keep)) if keep else symbols.limit(0)


def merge_changes(committed: DataFrame, uncommitted: DataFrame) -> DataFrame:
    """(path, status) with an uncommitted status before a committed one."""
    both = committed.select("path", "status", F.lit(1).alias("_p")).unionByName(uncommitted.select("path", "status", F.lit(0).alias("_p")))
    return both.groupBy("path").agg(F.min(F.struct("_p", "status")).alias("s")).select("path", F.col("s.status").alias("status"))


def keep_statuses(old: DataFrame, new: DataFrame, default: str) -> DataFrame:
    """The new rows with their old status where that is not the default."""
    o = old.select("id", F.col("status").alias("_old"))
    return new.join(o, "id", "left").withColumn("status", F.coalesce(F.when(F.col("_old") != default, F.col("_old")), "status")).drop("_old")


def refresh(old: DataFrame, new: DataFrame, blocks: DataFrame, default: str = "todo") -> DataFrame:
    """tasks(id, status, completed_at, block_id) read anew, with what the old ones had got to.

    An old status other than ``default`` comes back with its completed_at. Tasks whose block is no
    more lose the reference and have ``orphaned``; what the documents no longer hold goes.
    """
    o = old.filter(F.col("status") != default).select("id", F.col("status").alias("_status"), F.col("completed_at").alias("_at"))
    known = blocks.select(F.col("id").alias("block_id"), F.lit(True).alias("_known")).distinct()
    j = new.join(o, "id", "left").join(known, "block_id", "left")
    lost = F.col("block_id").isNotNull() & F.col("_known").isNull()
    values = {"status": F.coalesce("_status", "status"), "completed_at": F.when(F.col("_status").isNotNull(), F.col("_at")).otherwise(F.col("completed_at")), "block_id": F.when(~lost, F.col("block_id"))}
    return j.select(*(values.get(c, F.col(c)).alias(c) for c in new.columns), lost.alias("orphaned"))


def ranked(df: DataFrame, *order: Column | str, limit: int = 200, offset: int = 0) -> DataFrame:
    """a page of at most ``limit`` rows after ``offset`` in the order given, with their ``rank`` from 1 on.

    Both bound what the ranking window sees, so it may be of one task.
    """
    page = df.orderBy(*order).limit(offset + limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > offset)


#: References to one name from which on they are salted.
HOT = 10_000
_TIERS = (("scope", ["name", "file_path", "scope"]), ("file", ["name", "file_path"]), ("any", ["name"]))


def resolve_tiers(refs: DataFrame, symbols: DataFrame, salt: int = 8) -> DataFrame:
    """(ref_id, name, file_path, scope, tier, n): by which tier each reference (ref_id, name, scope, file_path) resolves, and to how many symbols.

    Those in its own declaring scope if there are any, else those in its file, else all of the
    name. A set of candidates is one row, its key and size, so that a name with a third of the
    symbols is one row here too and references keep their number. References to names of which
    there are over HOT are salted, so that those to one are dealt to ``salt`` tasks; only the
    candidate sets of these few names, which are broadcast, are repeated. Joins sort, whatever the
    inputs' sizes are taken for. Unresolved ones are left out; a null scope is
    the top level, a null name resolves to nothing.
    """
    top = F.coalesce("scope", F.lit(""))
    hot = refs.groupBy(F.col("name").alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select("_hot")
    marked = lambda df: df.join(F.broadcast(hot), F.col("name") == F.col("_hot"), "left")
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    salted = lambda df: marked(df).withColumn("_salt", F.explode(salts)).drop("_hot").hint("merge")
    s = symbols.select("name", "file_path", top.alias("scope"))
    own = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("ref_id"), F.lit(salt)).cast("int")).otherwise(0)
    out = marked(refs.select("ref_id", "name", "file_path", top.alias("scope"))).withColumn("_salt", own).drop("_hot")
    for tier, keys in _TIERS:
        out = out.join(salted(s.groupBy(*keys).agg(F.count("*").alias(f"_{tier}"))), [*keys, "_salt"], "left")
    n = F.coalesce(*(f"_{t}" for t, _ in _TIERS))
    tier = F.coalesce(*(F.when(F.col(f"_{t}").isNotNull(), t) for t, _ in _TIERS))
    return out.filter(n.isNotNull()).select("ref_id", "name", "file_path", "scope", tier.alias("tier"), n.alias("n"))


def expand_resolved(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, id) of references of :func:`resolve_tiers`, one row for each candidate; filter ``resolved`` first."""
    s = symbols.select("id", "name", "file_path", F.coalesce("scope", F.lit("")).alias("scope"))
    parts = [resolved.filter(F.col("tier") == tier).join(s.select("id", *keys).hint("merge"), keys).select("ref_id", "id") for tier, keys in _TIERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, id): candidates of each reference (ref_id, name, scope, file_path) by bare name, as :func:`resolve_tiers` says."""
    return expand_resolved(settle(resolve_tiers(refs, symbols), "resolved"), symbols)


def sensitive_files(files: DataFrame) -> DataFrame:
    """Changed files(path) that look like secrets."""
    # fixed values: the five patterns
    patterns = [r"\.env", r"secrets?\.", r"credentials", r"\.pem$", r"\.key$"]
    return files.filter(F.col("path").rlike("|".join(patterns)))


def file_class(path: Column) -> Column:
    """C20: test, code or other by the ending; a test is no code file."""
    return F.when(path.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$"), "test").when(path.rlike(r"\.(ts|tsx|js|jsx)$"), "code").otherwise("other")


def run_totals(runs: DataFrame) -> DataFrame:
    """The sums of all number columns over the runs, 0 without any."""
    return runs.agg(*[F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name) for f in runs.schema if f.dataType.typeName() in ("long", "integer", "double")])


def decisions_for(decisions: DataFrame, block: str | None = None, file: str | None = None) -> DataFrame:
    """decisions(decision_id, blocks, files) of a block, or with an affected file that contains ``file`` ignoring case; each once."""
    hit = F.lit(False)
    if block is not None:
        hit = hit | F.array_contains("blocks", block)
    if file is not None:
        hit = hit | F.exists("files", lambda f: F.lower(f).contains(file.lower()))
    return decisions.filter(hit).dropDuplicates(["decision_id"])
