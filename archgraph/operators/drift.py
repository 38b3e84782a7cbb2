"""Drift detectors H1-H6 and what is done with their findings.

Every detector returns (kind, severity, affected_block, affected_file, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.operators.containment import contained_pairs
from archgraph.operators.graph import block_edges
from archgraph.operators.prefix import unused_prefixes, without_prefix
from archgraph.shared import settle

SEVERITIES = ("info", "warning", "error")
#: Edge kinds that need a declared interface.
VIOLATING = ("imports", "calls", "renders")


def _finding(kind: str, severity: str, block: Column | None = None, file: Column | None = None, detail: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), (none if block is None else block).alias("affected_block"), (none if file is None else file).alias("affected_file"), (none if detail is None else detail).alias("detail")]


def undocumented(symbols: DataFrame, prefixes: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """H1: files with symbols under no block prefix nor ignored prefix; silent without any prefix. Case counts."""
    files = symbols.select(F.col("file_path").alias("path")).distinct()
    out = without_prefix(files, prefixes).join(prefixes.limit(1).select(F.lit(1)), how="left_semi")
    if ignored is not None:
        out = without_prefix(out, ignored)
    return out.select(*_finding("undocumented_module", "warning", file=F.col("path")))


def missing(symbols: DataFrame, prefixes: DataFrame) -> DataFrame:
    """H2: block prefixes without symbols; ASCII case is ignored."""
    files = symbols.select(F.col("file_path").alias("path")).distinct()
    return unused_prefixes(prefixes, files, fold=True).select(*_finding("missing_module", "warning", F.col("block_id"), F.col("prefix")))


def dependency_violations(symbols: DataFrame, edges: DataFrame, prefixes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """H3, F2: block pairs with an edge that no interface declares, each with its least source file."""
    e = block_edges(edges.filter(F.col("kind").isin(*VIOLATING)), symbols, prefixes).filter("source_block <> target_block")
    pairs = e.groupBy("source_block", "target_block").agg(F.min("source_file").alias("file"))  # first, so that the edges shrink before the anti-join
    declared = interfaces.select(F.col("block_id").alias("source_block"), F.col("target").alias("target_block"))
    bad = pairs.join(declared, ["source_block", "target_block"], "left_anti")
    return bad.select(*_finding("dependency_violation", "error", F.col("source_block"), F.col("file"), F.col("target_block")))


def unlinked_tests(symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """H4: linked test paths of scenarios, tests(scenario_id, prefix), that no file starts with. Case counts."""
    files = symbols.select(F.col("file_path").alias("path")).distinct()
    return unused_prefixes(tests, files).select(*_finding("unlinked_test", "warning", file=F.col("prefix"), detail=F.col("scenario_id")))


def stale_decisions(symbols: DataFrame, decision_files: DataFrame) -> DataFrame:
    """H5: files of decisions(decision_id, status, prefix) not superseded that no symbol's file starts with, ignoring case."""
    files = symbols.select(F.col("file_path").alias("path")).distinct()
    live = decision_files.filter("status <> 'superseded'")
    return unused_prefixes(live, files, fold=True).select(*_finding("stale_adr", "info", file=F.col("prefix"), detail=F.col("decision_id")))


# fixed values: packages that need no decision
TRIVIAL_PACKAGES = [
    "react", "react-dom", "next", "vite", "@vitejs/plugin-react",
    "express", "fastify", "hono", "koa",
    "typescript", "eslint", "prettier", "vitest", "jest",
    "@types/node", "@types/react", "@types/react-dom",
    "tsup", "tsx", "ts-node", "nodemon",
    "@eslint/js", "typescript-eslint",
    "esbuild", "rollup", "webpack", "postcss", "tailwindcss", "autoprefixer",
    "microsoft.net.test.sdk", "xunit", "xunit.runner.visualstudio",
    "nunit", "nunit3testadapter", "coverlet.collector",
    "microsoft.aspnetcore.openapi", "swashbuckle.aspnetcore",
]


def unmentioned_packages(packages: DataFrame, decisions: DataFrame, trivial: list[str] = ()) -> DataFrame:
    """Runtime packages(name, source) whose name, or first part of over 3 letters, no live decision text contains.

    ``TRIVIAL_PACKAGES`` and those of ``trivial`` are passed over, and so is an empty name. Names
    meet texts through :func:`contained_pairs`.
    """
    names = packages.filter(F.col("source").isin("npm", "nuget")).select("name").distinct().withColumn("low", F.lower("name"))
    names = names.filter(~F.col("low").isin(*TRIVIAL_PACKAGES, *trivial) & (F.col("low") != ""))
    base = F.regexp_extract("low", r"^[^./]*", 0)
    said = names.select("name", F.explode(F.array("low", F.when(F.length(base) > 3, base))).alias("said")).filter("said is not null")
    texts = decisions.filter("status <> 'superseded'").select(F.lower("text").alias("text")).distinct().withColumn("text_id", F.xxhash64("text"))
    hit = said.join(contained_pairs(texts, said, name="said").select("said").distinct(), "said").select("name")
    return names.join(hit, "name", "left_anti").select(*_finding("new_dependency", "info", detail=F.col("name")))


def union(*findings: DataFrame) -> DataFrame:
    """G1: all findings, repeats kept."""
    return reduce(DataFrame.unionByName, findings)


def prefix_hits(files: DataFrame, prefixes: DataFrame, ignored: DataFrame | None = None, tests: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """What all prefix tests of the detectors say, by one join and one aggregate.

    The prefix sets become one tagged table with two kinds of keys, as they are and in lower case;
    each file is cut to the lengths that occur and joined once. Rows are of two sides. A file
    (path) has ``covered`` and ``ignored``, whether a prefix holds it, ``block_id``, the owner of
    the longest one, and ``any_prefix``, whether there is any block prefix. A prefix (tag, prefix,
    owner) has ``hit``, whether a file starts with it, and ``rows``, how often it is declared.
    """
    none = F.lit(None).cast("string")
    sets = [("block", False, prefixes, F.col("block_id")), ("module", True, prefixes, F.col("block_id"))]
    sets += [("ignored", False, ignored, none)] if ignored is not None else []
    sets += [("test", False, tests, F.col("scenario_id"))] if tests is not None else []
    sets += [("decision", True, decisions.filter("status <> 'superseded'"), F.col("decision_id"))] if decisions is not None else []
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(tag).alias("tag"), F.lit(fold).alias("fold"), F.col("prefix"), owner.cast("string").alias("owner")) for tag, fold, df, owner in sets]).filter("prefix is not null")
    tagged = tagged.groupBy("tag", "fold", "prefix", "owner").agg(F.count("*").alias("rows"))
    keyed = tagged.withColumns({"key": F.when(F.col("fold"), F.lower("prefix")).otherwise(F.col("prefix")), "n": F.length("prefix")})
    # the few (fold, length) that occur, and whether there is a block prefix; length 0 keeps every file
    cuts = keyed.agg(F.struct(F.array_union(F.collect_set(F.struct("fold", "n")), F.array(F.struct(F.lit(False).alias("fold"), F.lit(0).alias("n")))).alias("cuts"), F.coalesce(F.bool_or(F.col("tag") == "block"), F.lit(False)).alias("any_prefix"))).scalar()
    cut = files.select("path").filter("path is not null").distinct().withColumn("k", cuts)
    cut = cut.select("path", "k.any_prefix", F.explode(F.filter("k.cuts", lambda c: c["n"] <= F.length("path"))).alias("c")).select("path", "any_prefix", F.col("c.fold").alias("fold"), F.col("c.n").alias("n"))
    cut = cut.withColumn("key", F.when(F.col("fold"), F.expr("lower(substring(path, 1, n))")).otherwise(F.expr("substring(path, 1, n)")))
    met = cut.join(keyed, ["fold", "n", "key"], "left")
    side = lambda path, tag, prefix, owner, *rest: F.struct(*(c.alias(x) for x, c in zip(("path", "tag", "prefix", "owner", "any_prefix", "covered", "ignored", "best", "hit", "rows"), (path, tag, prefix, owner, *rest), strict=True)))
    held = F.coalesce(F.col("tag") == "block", F.lit(False))
    best = F.when(held, F.struct((-F.col("n")).alias("n"), F.col("owner").alias("owner")))
    of_file = side(F.col("path"), none, none, none, F.col("any_prefix"), held, F.coalesce(F.col("tag") == "ignored", F.lit(False)), best, F.lit(False), F.lit(0).cast("long"))
    no_best = F.lit(None).cast("struct<n:int,owner:string>")
    of_prefix = side(none, F.col("tag"), F.col("prefix"), F.col("owner"), F.lit(False), F.lit(False), F.lit(False), no_best, F.lit(True), F.lit(0).cast("long"))
    bare = side(none, F.col("tag"), F.col("prefix"), F.col("owner"), F.lit(False), F.lit(False), F.lit(False), no_best, F.lit(False), F.col("rows"))
    told = met.select(F.explode(F.when(F.col("tag").isNull(), F.array(of_file)).otherwise(F.array(of_file, of_prefix))).alias("s")).select("s.*").unionByName(tagged.select(bare.alias("s")).select("s.*"))
    out = told.groupBy("path", "tag", "prefix", "owner").agg(*(F.bool_or(c).alias(c) for c in ("any_prefix", "covered", "ignored", "hit")), F.min("best").alias("best"), F.sum("rows").alias("rows"))
    return out.select("path", "tag", "prefix", "owner", "any_prefix", "covered", "ignored", "hit", "rows", F.col("best.owner").alias("block_id"))


def prefix_findings(hits: DataFrame) -> DataFrame:
    """H1, H2, H4, H5 of :func:`prefix_hits`, in one pass."""
    stray = F.col("path").isNotNull() & F.col("any_prefix") & ~F.col("covered") & ~F.col("ignored")
    lost = F.col("path").isNull() & ~F.col("hit")
    none = F.lit(None).cast("string")
    found = lambda kind, severity, block=none, file=none, detail=none: F.struct(*_finding(kind, severity, block, file, detail))
    what = F.when(stray, found("undocumented_module", "warning", file=F.col("path")))
    what = what.when(lost & (F.col("tag") == "module"), found("missing_module", "warning", F.col("owner"), F.col("prefix")))
    what = what.when(lost & (F.col("tag") == "test"), found("unlinked_test", "warning", file=F.col("prefix"), detail=F.col("owner")))
    what = what.when(lost & (F.col("tag") == "decision"), found("stale_adr", "info", file=F.col("prefix"), detail=F.col("owner")))
    rows = F.when(F.col("path").isNotNull(), F.lit(1)).otherwise(F.col("rows")).cast("int")
    return hits.select(what.alias("f"), rows.alias("n")).filter("f is not null").select(F.explode(F.array_repeat("f", F.col("n"))).alias("f")).select("f.*")


def undeclared_pairs(owned: DataFrame, edges: DataFrame, interfaces: DataFrame) -> DataFrame:
    """H3 over owned(id, file_path, block_id): edges lose their target symbol before the anti-join, in two aggregates with a map side."""
    s = owned.select(F.col("id").alias("source"), F.col("file_path").alias("file"), F.col("block_id").alias("source_block"))
    out = edges.filter(F.col("kind").isin(*VIOLATING)).join(s, "source").groupBy("target", "source_block").agg(F.min("file").alias("file"))
    t = owned.select(F.col("id").alias("target"), F.col("block_id").alias("target_block"))
    pairs = out.join(t, "target").filter("source_block <> target_block").groupBy("source_block", "target_block").agg(F.min("file").alias("file"))
    declared = interfaces.select(F.col("block_id").alias("source_block"), F.col("target").alias("target_block"))
    bad = pairs.join(declared, ["source_block", "target_block"], "left_anti")
    return bad.select(*_finding("dependency_violation", "error", F.col("source_block"), F.col("file"), F.col("target_block")))


def contract_findings(problems: DataFrame, calls: DataFrame) -> DataFrame:
    """H7 as findings: problems(call_id, problem) of calls(call_id, file_path)."""
    return problems.join(calls.select("call_id", "file_path"), "call_id").select(*_finding("contract_violation", "warning", file=F.col("file_path"), detail=F.concat_ws(": ", "call_id", "problem")))


def detect(symbols: DataFrame, edges: DataFrame, prefixes: DataFrame, interfaces: DataFrame, *, ignored: DataFrame | None = None, tests: DataFrame | None = None, decisions: DataFrame | None = None, packages: DataFrame | None = None, trivial: list[str] = (), contracts: DataFrame | None = None) -> DataFrame:
    """G1: the findings of all detectors whose tables are given, repeats kept.

    Symbols are read once, to a narrow written table of ids and files; all prefix tests are one
    join (:func:`prefix_hits`), whose rows also tell the owners that H3 needs. ``contracts`` are
    findings of :func:`contract_findings`. The rows are those of :func:`union` over the single
    detectors.
    """
    narrow = settle(symbols.select("id", "file_path"), "symbol-files")
    hits = settle(prefix_hits(narrow.select(F.col("file_path").alias("path")), prefixes, ignored, tests, decisions), "prefix-hits")
    owners = hits.filter("block_id is not null").select(F.col("path").alias("file_path"), "block_id")
    owned = settle(narrow.join(owners, "file_path"), "owned")
    parts = [prefix_findings(hits), undeclared_pairs(owned, edges, interfaces)]
    if packages is not None and decisions is not None:
        parts.append(unmentioned_packages(packages, decisions, trivial))
    return union(*parts, *([contracts] if contracts is not None else []))


def in_scope(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """The findings on changed(path), whole rows; those without a file are left to the full run."""
    return findings.join(changed.select(F.col("path").alias("affected_file")).distinct(), "affected_file", "left_semi")


def replace_unresolved(log: DataFrame, new: DataFrame) -> DataFrame:
    """Resolved entries of the log stay, unresolved ones give way to the new findings."""
    return log.filter("resolution is not null").unionByName(new.withColumn("resolution", F.lit(None).cast("string")), allowMissingColumns=True)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or a higher one."""
    return findings.filter(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(severity) :]))


def severity_counts(findings: DataFrame) -> DataFrame:
    """A row for each severity, 0 where there is none."""
    every = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def scope_counts(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """(kept, other_files, non_file) of findings against changed(path)."""
    c = changed.select(F.col("path").alias("affected_file")).distinct().withColumn("hit", F.lit(True))
    f = findings.join(c, "affected_file", "left")
    return f.agg(F.count_if("hit").alias("kept"), F.count_if(F.col("hit").isNull() & F.col("affected_file").isNotNull()).alias("other_files"), F.count_if(F.col("affected_file").isNull()).alias("non_file"))


# fixed values: prefixes of files that belong to the framework, by project type
_NEXT = [".next/", "next.config", "src/app/layout.", "src/app/page.", "src/app/not-found.", "src/app/loading.", "src/app/error.", "src/app/global-error.", "src/middleware.", "app/layout.", "app/page.", "app/not-found.", "app/loading.", "app/error.", "app/global-error.", "middleware."]
_DOTNET = ["Program.", "Startup.", "bin/", "obj/", "Properties/", "Migrations/", "wwwroot/"]
FRAMEWORK_FILES = {
    "nextjs-app-router": _NEXT,
    "react-vite": ["src/main.", "src/App.", "vite.config"],
    "api-service": ["src/index.", "src/app.", "src/server."],
    "angular-app": [".angular/", "src/environments/", "src/main.ts", "src/index.html", "src/styles.", "angular.json"],
    "dotnet-webapi": _DOTNET,
    "fullstack-nextjs-dotnet": ["frontend/" + p for p in _NEXT] + ["api/" + p for p in _DOTNET],
    "unity-game": ["Library/", "Temp/", "Logs/", "UserSettings/", "Packages/", "ProjectSettings/", "Assets/Plugins/", "obj/", "bin/"],
}


def ignored_prefixes(spark: SparkSession, project_type: str | None = None, own: list[str] = ()) -> DataFrame:
    """(prefix) of the files that :func:`undocumented` passes over: those of the project type, and the user's own."""
    rows = sorted({*FRAMEWORK_FILES.get(project_type, []), *own})
    return spark.createDataFrame([(p,) for p in rows], "prefix string")
