"""Indexing of all services and the sync job."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.operators import delivery, review
from archgraph.plans.state import ProjectState, apply_index
from archgraph.sources import edges, extract, git


class Index(NamedTuple):
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    warnings: list[str]


def index_services(spark: SparkSession, services: Iterable[tuple[str, str, str]], known: DataFrame | None = None) -> Index:
    """Files, symbols and edges of services (name, folder, language) in one; ids are told apart by the service's paths.

    A folder that can't be read is a warning and its service has no rows. Edges are resolved
    within a service. With ``known``, files(service, path, content_hash) that stayed as they were
    are left out of the index: their old rows stay, see :func:`archgraph.operators.changes.delete_scope`.
    """
    found, warnings = [], []
    for name, folder, language in services:
        try:
            files = extract.scan(spark, folder, language, name)
            if known is not None:
                files = files.join(known.select("service", "path", "content_hash"), ["service", "path", "content_hash"], "left_anti")
            syms = extract.symbols(files, language).withColumn("service", F.lit(name))
            found.append((files, syms, edges.edges(edges.references(files, language), syms).withColumn("service", F.lit(name))))
        except (AnalysisException, KeyError) as e:
            warnings.append(f"{name}: {str(e).splitlines()[0]}")
    if not found:
        empty = lambda schema: spark.createDataFrame([], schema)
        return Index(empty("path string, content string, content_hash string, language string, service string"), empty(extract.SYMBOL + ", service string"), empty("source string, target string, kind string, service string"), warnings)
    return Index(*(reduce(DataFrame.unionByName, frames) for frames in zip(*found, strict=True)), warnings)


def store(index: Index, state: ProjectState, removed: DataFrame | None = None, components: DataFrame | None = None) -> int:
    """Bring an index, of all files or of those that changed, into the stored state; returns its version.

    ``removed(path, service, language)`` are files that are no more, ``components(id, service,
    language, ..)`` those of the indexed files. One commit, see :func:`archgraph.plans.state.apply_index`.
    """
    of = lambda df: df.select(F.col("path").alias("file_path"), "service", "language")
    files = of(index.files) if removed is None else of(index.files).unionByName(of(removed))
    edges_ = index.edges.join(index.symbols.select(F.col("id").alias("source"), "language"), "source")
    none = index.symbols.select("id", "service", "language").limit(0)
    return apply_index(state, files.distinct(), index.symbols, edges_, none if components is None else components)


class Synced(NamedTuple):
    counts: DataFrame
    findings: DataFrame
    inferred: DataFrame
    tasks: DataFrame
    scenarios: DataFrame
    changed: DataFrame
    commit: str | None
    warnings: list[str]


def sync(
    index: Index,
    root: str,
    detect: Callable[[Index], DataFrame],
    phases: DataFrame,
    tasks: DataFrame,
    prefixes: DataFrame,
    refs: DataFrame,
    task_scenarios: DataFrame,
    scenarios: DataFrame,
    results: DataFrame | None,
    meta: dict[str, str],
    now: Column,
) -> Synced:
    """What an index leads to: findings, inferred and applied states of tasks, verified scenarios, changed files and the new sync point.

    ``detect`` gives the findings of an index, ``results`` (scenario_id, outcome) are those of the
    test runs, none without. Only tasks of the phase in progress are inferred. The caller writes
    the frames and then ``commit`` under last_sync_commit, so that a job that dies is run again from the old point.
    """
    spark = index.files.sparkSession
    warnings = list(index.warnings)
    here = phases.filter("status = 'in-progress'").agg(F.min(F.struct("phase_number", "id")).alias("p")).select(F.col("p.id").alias("phase_id"))
    active = tasks.join(here, "phase_id", "left_semi").select(*tasks.columns)
    inferred = delivery.infer(active, prefixes, index.symbols.select(F.col("file_path").alias("path")), refs, task_scenarios, scenarios)
    checked = scenarios if results is None else review.verified(scenarios, results)
    commit = git.head(root)
    if commit is None:
        warnings.append("no git repository: no changed files and no new sync point")
    changed = git.scope_to(git.changed_files(spark, root, git.resolve_ref("last-sync", meta)), git.project_prefix(root))
    counts = index.files.agg(F.count("*").alias("files")).crossJoin(index.symbols.agg(F.count("*").alias("symbols"))).crossJoin(index.edges.agg(F.count("*").alias("edges")))  # one row each
    return Synced(counts, detect(index), inferred, delivery.apply_inferred(tasks, inferred, now), checked, changed, commit, warnings)
