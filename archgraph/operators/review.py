"""Reviews over changed files, roles and test results."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions.paths import app_route, dir_with_slash, directory, under_prefix
from archgraph.operators.changes import file_class, sensitive_files
from archgraph.operators.delivery import in_focus
from archgraph.operators.graph import block_edges, complexity, coupling, cross_block_exports, server_imports
from archgraph.operators.prefix import longest_prefix_join, prefix_pairs, unused_prefixes, without_prefix


class Project(NamedTuple):
    """The frames that the reviews read.

    symbols, edges, prefixes(block_id, prefix), interfaces(block_id, target), blocks(id), components(id,
    is_client, is_server_action), routes(route_path, kind, has_auth), scenarios, links(scenario_id,
    prefix), scenario_blocks(scenario_id, block_id), phases, tasks and findings; changed is (path,
    status), status being added, modified or deleted.
    """

    symbols: DataFrame
    edges: DataFrame
    prefixes: DataFrame
    interfaces: DataFrame
    blocks: DataFrame
    components: DataFrame
    routes: DataFrame
    scenarios: DataFrame
    links: DataFrame
    scenario_blocks: DataFrame
    phases: DataFrame
    tasks: DataFrame
    findings: DataFrame
    changed: DataFrame


_BETWEEN = ("imports", "calls", "renders")


def _rows(df: DataFrame, *values: str | Column) -> DataFrame:
    """Distinct (dimension, severity, kind, subject)."""
    cols = [F.lit(v) if isinstance(v, str) else v for v in values]
    return df.select(*[c.cast("string").alias(n) for c, n in zip(cols, ("dimension", "severity", "kind", "subject"), strict=True)]).distinct()


def undeclared_use(p: Project, files: DataFrame | None = None) -> DataFrame:
    """(source_file, source_block, target_block) of imports, calls and renders into a block that the source's block does not declare; of files(source_file) only, if given."""
    e = block_edges(p.edges.filter(F.col("kind").isin(*_BETWEEN)), p.symbols, p.prefixes).filter("source_block <> target_block")
    if files is not None:
        e = e.join(files, "source_file", "left_semi")
    pairs = e.select("source_file", "source_block", "target_block").distinct()
    declared = p.interfaces.select(F.col("block_id").alias("source_block"), F.col("target").alias("target_block"))
    return pairs.join(declared, ["source_block", "target_block"], "left_anti")


def at_risk(p: Project, paths: DataFrame) -> DataFrame:
    """Must- and should-have scenarios with linked code, or a linked block, that one of paths(path) is in."""
    by_code = prefix_pairs(paths, p.links.select("scenario_id", "prefix")).select(F.col("scenario_id").alias("id"))
    by_block = prefix_pairs(paths, p.prefixes.join(p.scenario_blocks, "block_id").select("scenario_id", "prefix")).select(F.col("scenario_id").alias("id"))
    return p.scenarios.filter("priority in ('must', 'should')").join(by_code.unionByName(by_block), "id", "left_semi")


def practice_review(p: Project, many_symbols: int = 30, many_targets: int = 20) -> DataFrame:
    """(dimension, severity, kind, subject) of what the changed files call for, in five dimensions; deleted files count for documents alone.

    Null where a project has nothing to say: without prefixes no file is unmapped.
    """
    paths = p.changed.filter("status <> 'deleted'").select("path").distinct()
    in_change = paths.select(F.col("path").alias("file_path"))
    classed = paths.select("path", file_class(F.col("path")).alias("c"))
    code = classed.filter("c = 'code' or c = 'test'").select(F.col("path").alias("file_path"))
    mapped = p.prefixes.select(F.lit(1)).limit(1)
    unmapped = without_prefix(paths, p.prefixes).join(F.broadcast(mapped), how="left_semi")
    route_files = paths.filter(F.col("path").rlike(r"/route\.(ts|tsx|js|jsx)$")).withColumn("route_path", app_route(F.col("path")))
    bare = p.routes.filter("kind = 'api-route' and not has_auth").select("route_path").distinct()
    untested = classed.agg(F.count_if(F.col("c") == "code").alias("n"), F.count_if(F.col("c") == "test").alias("t")).filter("n > 0 and t = 0")
    risk = at_risk(p, paths)
    drift = p.findings.filter("severity in ('error', 'warning')").groupBy("severity").agg(F.count("*").alias("n"))
    documents = p.changed.filter(F.contains("path", F.lit("/arc42/"))).agg(F.countDistinct("path").alias("n")).filter("n > 0")
    client = server_imports(p.edges, p.symbols, p.components, paths)
    parts = [
        _rows(unmapped, "architecture", "warning", "unmapped file", F.col("path")),
        _rows(undeclared_use(p, paths.select(F.col("path").alias("source_file"))), "architecture", "error", "undeclared interface", F.concat_ws(" -> ", "source_file", "target_block")),
        _rows(route_files.join(bare, "route_path", "left_semi"), "security", "warning", "route without auth", F.col("route_path")),
        _rows(sensitive_files(paths), "security", "error", "sensitive file", F.col("path")),
        _rows(client, "security", "warning", "server import", F.concat_ws(" -> ", "file", "imports")),
        _rows(untested, "testing", "info", "code without tests", F.col("n")),
        _rows(risk, "testing", F.when(F.col("status") == "passing", "warning").otherwise("error"), "scenario at risk", F.col("id")),
        _rows(drift, "documentation", F.col("severity"), "drift", F.col("n")),
        _rows(documents, "documentation", "info", "documents changed", F.col("n")),
        _rows(complexity(p.symbols, many_symbols).join(code, "file_path", "left_semi"), "complexity", "warning", "many symbols", F.col("file_path")),
        _rows(coupling(p.edges, p.symbols, many_targets).join(in_change.join(code, "file_path", "left_semi"), "file_path", "left_semi"), "complexity", "warning", "many targets", F.col("file_path")),
    ]
    return reduce(DataFrame.unionByName, parts)


def guidance(p: Project, path: str, decisions: DataFrame, category: str | None = None, nearby: int = 20) -> DataFrame:
    """(kind, subject) of what applies to one file.

    Its block, or that it has none; the block's interfaces and open tasks; names of the first
    ``nearby`` symbols, by kind and name, below its folder; scenarios of the action's category or
    must-have ones; decisions(decision_id, prefix, block_id) whose file holds it or is held by it
    or whose block it is in; findings of the file or its block.
    """
    one = p.prefixes.sparkSession.createDataFrame([(path,)], "path string")
    say = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("subject"))
    block = longest_prefix_join(one, p.prefixes).select("block_id")
    near = p.symbols.filter(F.col("file_path").startswith(path[: path.rfind("/") + 1])).orderBy("kind", "name", "id").limit(nearby)
    s = p.scenarios.filter(F.col("priority") == "must") if category is None else p.scenarios.filter(F.col("category") == category)
    by_file = decisions.filter(F.lit(path).contains(F.col("prefix")) | F.col("prefix").contains(path)).select("decision_id")
    by_block = decisions.join(block, "block_id", "left_semi").select("decision_id")
    found = p.findings.filter(F.col("affected_file") == path).select("kind").unionByName(p.findings.join(block.select(F.col("block_id").alias("affected_block")), "affected_block", "left_semi").filter(~F.col("affected_file").eqNullSafe(F.lit(path))).select("kind"))
    return reduce(DataFrame.unionByName, [
        say(block, "block", "block_id"),
        say(without_prefix(one, p.prefixes), "unmapped", "path"),
        say(p.interfaces.join(block, "block_id", "left_semi"), "interface", "target"),
        say(near, "nearby", "name"),
        say(s, "scenario", "id"),
        say(p.tasks.filter("status in ('todo', 'in-progress')").join(block, "block_id", "left_semi"), "task", "id"),
        say(by_file.unionByName(by_block).distinct(), "decision", "decision_id"),
        say(found, "finding", "kind"),
    ])


ROLES = ("security-reviewer", "quality-guardian", "architect", "phase-manager", "code-reviewer")


def role_check(p: Project, role: str, focus: list[str] | None = None) -> DataFrame:
    """(section, subject, value) of the check of a role: one of ROLES, or any other with the categories of its focus.

    Counts are rows whose subject says of what. Findings are counted by severity in all but the
    code reviewer's.
    """

    def say(section: str, df: DataFrame, subject: str | Column, value: str | Column) -> DataFrame:
        col = lambda c: F.col(c) if isinstance(c, str) else c
        return df.select(F.lit(section).alias("section"), col(subject).cast("string").alias("subject"), col(value).cast("string").alias("value"))

    def counted(section: str, **frames: DataFrame) -> list[DataFrame]:
        return [say(section, df.agg(F.count("*").alias("n")), F.lit(name.replace("_", " ")), "n") for name, df in frames.items()]

    drift = say("drift", p.findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "n")
    scenarios = lambda s: say("scenarios", s, "id", "status")
    changed = say("changed files", p.changed.distinct(), "path", "status")
    if role == "security-reviewer":
        ends = p.edges.filter(F.col("kind").isin(*_BETWEEN)).join(p.components.select(F.col("id").alias("source"), F.col("is_client").alias("a")), "source").join(p.components.select(F.col("id").alias("target"), F.col("is_client").alias("b")), "target").filter("a <> b")
        parts = [scenarios(in_focus(p.scenarios, ["security"])), drift, *counted("boundaries", client_components=p.components.filter("is_client"), server_actions=p.components.filter("is_server_action"), edges_across=ends), say("routes without auth", p.routes.filter("kind = 'api-route' and not has_auth"), "route_path", "kind"), changed]
    elif role == "quality-guardian":
        per = p.scenarios.groupBy("verification", "status").agg(F.count("*").alias("n"))
        parts = [scenarios(p.scenarios), drift, say("verification", per, F.concat_ws(" / ", "verification", "status"), "n")]
    elif role == "architect":
        pairs = undeclared_use(p).select("source_block", "target_block").distinct()
        parts = [say("blocks", p.blocks, "id", F.lit(None)), drift, say("undeclared interfaces", pairs, "source_block", "target_block")]
    elif role == "phase-manager":
        here = p.phases.filter("status = 'in-progress'").agg(F.min(F.struct("phase_number", "id")).alias("p")).filter("p is not null").select(F.col("p.id").alias("phase_id"))
        tasks = p.tasks.join(here, "phase_id", "left_semi")
        must = p.scenarios.filter("priority = 'must'")
        gate = must.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failing").alias("f")).filter("n > 0")
        blocked = must.filter("status <> 'passing'").join(F.broadcast(gate.filter("f > 0").select(F.lit(1))), how="left_semi")
        parts = [say("phase", here, "phase_id", F.lit("in-progress")), say("tasks", tasks, "id", "status"), say("progress", tasks.groupBy("status").agg(F.count("*").alias("n")), "status", "n"), drift, say("gate", gate, F.lit("must-have scenarios"), F.when(F.col("f") == 0, "ready").otherwise("blocked")), say("gate", blocked, "id", "status"), changed]
    elif role == "code-reviewer":
        paths = p.changed.filter("status <> 'deleted'").select("path").distinct()
        parts = [changed, say("affected blocks", longest_prefix_join(paths, p.prefixes), "path", "block_id"), say("unmapped files", without_prefix(paths, p.prefixes), "path", F.lit(None))]
    else:
        parts = [scenarios(in_focus(p.scenarios, focus) if focus else p.scenarios), drift]
    return reduce(DataFrame.unionByName, parts)


def document_proposals(p: Project) -> DataFrame:
    """(kind, subject, detail) of what the documents should say after the change.

    Folders with new files under no prefix and how many, exported symbols of added or modified files
    with the blocks that use them, prefixes that deleted files were under and no symbol is any
    more, ignoring ASCII case, and how many route files came or changed.
    """
    kept = p.changed.filter("status <> 'deleted'").select("path").distinct()
    touched = p.changed.filter("status in ('added', 'modified')").select(F.col("path").alias("file_path")).distinct()
    say = lambda df, kind, subject, detail: df.select(F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), F.col(detail).cast("string").alias("detail"))
    folders = without_prefix(kept, p.prefixes).groupBy(dir_with_slash(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))
    used = cross_block_exports(p.edges, p.symbols, p.prefixes).join(p.symbols.join(touched, "file_path", "left_semi").select("id"), "id", "left_semi")
    under = prefix_pairs(p.changed.filter("status = 'deleted'").select("path").distinct(), p.prefixes).select("block_id", "prefix").distinct()
    emptied = unused_prefixes(under, p.symbols.select(F.col("file_path").alias("path")), fold=True)
    pages = touched.filter(F.contains("file_path", F.lit("/app/")) & F.col("file_path").rlike(r"/(page|layout|route)\.(ts|tsx|js|jsx)$")).agg(F.count("*").alias("n")).filter("n > 0").withColumn("what", F.lit("route files"))
    return reduce(DataFrame.unionByName, [say(folders, "unmapped folder", "dir", "n"), say(used.withColumn("by", F.array_join("consumers", ",")), "interface", "id", "by"), say(emptied, "emptied prefix", "prefix", "block_id"), say(pages, "runtime view", "what", "n")])


def role_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenarios of a release check: must-have ones that don't pass, by priority and category."""
    return scenarios.filter("priority = 'must' and status <> 'passing'").select("id", "category", "status").orderBy("category", "id")


def unmapped_folders(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(dir, n_files) of folders with files under no prefix."""
    return without_prefix(files, prefixes).groupBy(directory(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"))


def verified(scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """Scenarios with the status of their runs, results(scenario_id, outcome): passing if all passed, failing if one did not; missing runs change nothing."""
    r = results.filter("outcome <> 'missing'").groupBy("scenario_id").agg(F.bool_and(F.col("outcome") == "passed").alias("ok"))
    s = scenarios.join(r, scenarios["id"] == r["scenario_id"], "left").drop("scenario_id")
    return s.withColumn("status", F.when(F.col("ok"), "passing").when(~F.col("ok"), "failing").otherwise(F.col("status"))).drop("ok")


def saving(files: DataFrame, prefix: str, answer_tokens: int) -> DataFrame:
    """(baseline, saved_percent) of an answer against reading files(path, tokens) under a prefix, on a segment boundary; null for no baseline."""
    base = F.coalesce(F.sum("tokens"), F.lit(0))
    return files.filter(under_prefix(F.col("path"), F.lit(prefix))).agg(base.alias("baseline"), F.when(base > 0, F.round((base - answer_tokens) / base * 100, 1)).alias("saved_percent"))


def block_savings(files: DataFrame, prefixes: DataFrame, answers: DataFrame) -> DataFrame:
    """(block_id, files, baseline, saved_percent) of each block of answers(block_id, tokens) against reading its files(path, tokens).

    A file belongs to the block of the longest prefix that holds it on a segment boundary, of the
    least block on a tie. Blocks without files have baseline 0 and no percentage; one of several
    answers of a block is the smallest.
    """
    bare = F.regexp_replace(F.regexp_replace("prefix", r"/?\*+$", ""), "/$", "")
    p = prefixes.select("block_id", bare.alias("bare"))
    held = prefix_pairs(files.select("path").distinct(), p, prefix="bare").filter(under_prefix(F.col("path"), F.col("bare")))
    own = held.groupBy("path").agg(F.min(F.struct(-F.length("bare"), "block_id")).alias("b")).select("path", F.col("b.block_id").alias("block_id"))
    read = files.join(own, "path").groupBy("block_id").agg(F.count("*").alias("files"), F.sum("tokens").alias("read"))
    asked = answers.groupBy("block_id").agg(F.min("tokens").alias("answer"))
    base = F.coalesce("read", F.lit(0))
    return asked.join(read, "block_id", "left").select("block_id", F.coalesce("files", F.lit(0)).alias("files"), base.alias("baseline"), F.when(base > 0, F.round((base - F.col("answer")) / base * 100, 1)).alias("saved_percent"))
