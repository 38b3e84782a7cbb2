"""Operators whose plans were remade for scale: their rows, and what their plans must not hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from archgraph.functions import paths
from archgraph.operators import containment, drift, graph, propose, review


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> int:
    return len(re.findall(r"Scan (?:parquet|ExistingRDD)", df._jdf.queryExecution().optimizedPlan().toString() + plan(df)))


# containment


def test_contained_pairs_against_all_pairs(spark):
    r = random.Random(1)
    word = lambda k: "".join(r.choice("abÄ.") for _ in range(k))
    texts = [(i, word(r.randrange(40))) for i in range(60)] + [(100, None), (101, ""), (102, "a\nb" * 5)]
    names = [(word(k),) for k in (1, 2, 3, 4, 5, 7) for _ in range(12)] + [("",), (None,), ("a\nb",), ("ab",), ("ab",), ("zzz",), ("abz",)]
    got = containment.contained_pairs(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name string"))
    want = {(i, n) for i, t in texts for (n,) in names if t is not None and n and n in t}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_containment_takes_no_nested_loop(spark):
    texts = spark.range(1000).selectExpr("id as text_id", "concat('text ', id, ' of many') as text")
    names = spark.range(1000).selectExpr("concat('text ', id) as name")
    got = containment.contained_pairs(texts, names)
    assert not re.search("NestedLoopJoin|CartesianProduct", plan(got))
    assert got.count() == sum(str(t).startswith(str(n)) for t in range(1000) for n in range(1000))


def test_containment_of_empty_tables_and_long_texts(spark):
    no_text, no_name = spark.createDataFrame([], "text_id long, text string"), spark.createDataFrame([], "name string")
    one = spark.createDataFrame([(1, "x" * 300_000 + "needle" + "y" * 300_000)], "text_id long, text string")
    needle = spark.createDataFrame([("needle",), ("xxxy",), ("xy",)], "name string")
    assert containment.contained_pairs(no_text, needle).collect() == [] == containment.contained_pairs(one, no_name).collect()
    assert [r["name"] for r in containment.contained_pairs(one, needle).collect()] == ["needle"]


def test_packages_pass_if_trivial_or_said(spark):
    packages = spark.createDataFrame([("React", "npm"), ("Left.Pad", "npm"), ("zod", "npm"), ("orm/x", "nuget"), ("log", "npm-dev"), ("", "npm"), ("dapper.core", "nuget")], "name string, source string")
    decisions = spark.createDataFrame([("a", "accepted", "We chose LEFT over right, and Zod"), ("b", "superseded", "dapper"), ("c", "accepted", None)], "decision_id string, status string, text string")
    assert sorted(r["detail"] for r in drift.unmentioned_packages(packages, decisions).collect()) == ["dapper.core", "orm/x"]


def test_decisions_of_paths_and_relevant_ones(spark):
    paths = spark.createDataFrame([("Src/a.ts",), ("src/b.ts",), ("src",), (None,)], "path string")
    decisions = spark.createDataFrame([("d1", ["SRC/A.TS.bak", "x"]), ("d2", ["src/b"]), ("d3", [])], "decision_id string, files array<string>")
    assert sorted(map(tuple, containment.decisions_of_paths(paths, decisions).collect())) == [("Src/a.ts", "d1"), ("src", "d1"), ("src", "d2")]
    placed = spark.createDataFrame([("d1", "src/b", None), ("d2", "old/src/b.ts", None), ("d3", "else", "blk"), ("d4", None, None)], "decision_id string, prefix string, block_id string")
    owners = spark.createDataFrame([("Src/a.ts", "blk")], "path string, block_id string")
    got = sorted(map(tuple, containment.relevant_decisions(paths, placed, owners).collect()))
    assert got == [("Src/a.ts", "d3"), ("src", "d1"), ("src", "d2"), ("src/b.ts", "d1"), ("src/b.ts", "d2")]


# detectors


@pytest.fixture(scope="module")
def project(spark):
    r = random.Random(2)
    files = [f"{r.choice(['App', 'lib', 'src/x', 'test'])}/{r.choice(['a', 'B', 'c/d'])}/f{i}.ts" for i in range(60)]
    symbols = spark.createDataFrame([(f"{f}::s{i}", f) for i, f in enumerate(r.choices(files, k=150))] + [("n", None)], "id string, file_path string")
    ids = [row["id"] for row in symbols.collect()]
    edges = spark.createDataFrame([(r.choice(ids), r.choice(ids), r.choice(["imports", "calls", "extends"])) for _ in range(300)] + [("gone", ids[0], "calls")], "source string, target string, kind string")
    prefixes = spark.createDataFrame([("app", "App/"), ("app", "app/"), ("lib", "lib/a"), ("lib2", "lib/a"), ("deep", "lib/a/f1"), ("none", "zzz/"), ("none", "zzz/"), ("n", None)], "block_id string, prefix string")
    interfaces = spark.createDataFrame([("app", "lib")], "block_id string, target string")
    ignored = spark.createDataFrame([("test/",)], "prefix string")
    tests = spark.createDataFrame([("q1", "test/a"), ("q2", "Test/a"), ("q2", "Test/a")], "scenario_id string, prefix string")
    decisions = spark.createDataFrame([("d1", "accepted", "APP/b", "x"), ("d2", "accepted", "none", "y"), ("d3", "superseded", "gone", "z")], "decision_id string, status string, prefix string, text string")
    return symbols, edges, prefixes, interfaces, ignored, tests, decisions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fused_detectors_equal_the_single_ones(spark, project):
    symbols, edges, prefixes, interfaces, ignored, tests, decisions = project
    packages = spark.createDataFrame([("y.lib", "npm"), ("other", "npm")], "name string, source string")
    known = prefixes.filter("prefix is not null")
    files = symbols.filter("file_path is not null")
    single = drift.union(
        drift.undocumented(files, known, ignored), drift.missing(files, known), drift.dependency_violations(files, edges, known, interfaces), drift.unlinked_tests(files, tests), drift.stale_decisions(files, decisions), drift.unmentioned_packages(packages, decisions))
    fused = drift.detect(symbols, edges, prefixes, interfaces, ignored=ignored, tests=tests, decisions=decisions, packages=packages)
    assert rows(fused) == rows(single) and len(rows(fused)) > 10
    assert {r["kind"] for r in fused.collect()} == {"undocumented_module", "missing_module", "dependency_violation", "unlinked_test", "stale_adr", "new_dependency"}


def test_without_prefixes_nothing_is_undocumented(spark, project):
    symbols, edges, prefixes, interfaces, *_ = project
    assert rows(drift.detect(symbols, edges, prefixes.limit(0), interfaces)) == []
    assert rows(drift.detect(symbols.limit(0), edges, prefixes, interfaces)) == rows(drift.missing(symbols.limit(0).fillna(""), prefixes.filter("prefix is not null")))


def test_prefix_tests_are_one_join(spark, project):
    symbols, _, prefixes, _, ignored, tests, decisions = project
    hits = drift.prefix_hits(symbols.select(F.col("file_path").alias("path")), prefixes, ignored, tests, decisions)
    joins = [x for x in re.findall(r"\w*Join\b", plan(hits).split("Initial Plan")[0]) if x != "BroadcastNestedLoopJoin"]
    assert len(joins) == 1


def test_scoped_findings_keep_whole_rows(spark):
    f = spark.createDataFrame([("k", "info", None, "a.ts", "x"), ("k", "info", "b", None, "y"), ("k", "info", None, "c.ts", None)], "kind string, severity string, affected_block string, affected_file string, detail string")
    changed = spark.createDataFrame([("a.ts",), ("a.ts",), ("z.ts",)], "path string")
    assert [r["detail"] for r in drift.in_scope(f, changed).collect()] == ["x"]


# traversal


def walk(edges, files, prefix, depth, both=False):
    step = {(files[a], files[b]) for a, b in edges if a in files and b in files and files[a] != files[b]}
    step |= {(b, a) for a, b in step} if both else set()
    dir_of = lambda f: f.rsplit("/", 1)[0]
    seen = {b: 1 for a, b in step if a.lower().startswith(prefix.lower())}
    front = set(seen)
    for d in range(2, depth + 1):
        dirs = {dir_of(f) for f in front}
        front = {b for a, b in step if dir_of(a) in dirs} - set(seen)
        seen |= dict.fromkeys(front, d)
    return seen


@pytest.mark.parametrize(("depth", "direction"), [(1, "dependencies"), (3, "dependencies"), (5, "both")])
def test_traversal_of_many_starts(spark, depth, direction):
    r = random.Random(depth)
    files = {f"s{i}": f"d{i % 15}/f{i % 40}.ts" for i in range(80)} | {"lone": "top.ts"}
    edges = [(r.choice(list(files)), r.choice(list(files))) for _ in range(70)] + [("s1", "unknown")]
    e = spark.createDataFrame([(a, b, "calls") for a, b in edges], "source string, target string, kind string")
    s = spark.createDataFrame([(k, k, f, "x") for k, f in files.items()], "id string, name string, file_path string, service string")
    starts = [("one", "D1/"), ("two", "d3/f3.ts"), ("two", "d4"), ("all", ""), ("none", "zz"), (None, "d1"), ("null", None)]
    got = graph.traverse_all(e, s, spark.createDataFrame(starts, "start string, prefix string"), depth, direction)
    want = {}
    for start, prefix in starts:
        if start is not None and prefix is not None:
            for f, d in walk(edges, files, prefix, depth, direction == "both").items():
                want[start, f] = min(d, want.get((start, f), 9))
    assert {(x["start"], x["file"]): x["depth"] for x in got.collect()} == want
    assert got.count() == len(want)


def test_traversal_plan_does_not_grow_with_depth(spark, project):
    symbols, edges, *_ = project
    s = symbols.withColumns({"name": F.col("id"), "service": F.lit("x")})
    assert scans(graph.traverse(edges, s, "App", 5)) == scans(graph.traverse(edges, s, "App", 2)) <= 2
    with pytest.raises(ValueError):
        graph.traverse(edges, s, "App", 6)


# proposals


def greedy(files, most, least):
    """Prefixes with their own files, one split after another."""
    dirs = [f[: f.rfind("/") + 1] for f in set(files)]
    if not dirs:
        return []
    root = dirs[0]
    while not all(d.startswith(root) for d in dirs):
        root = root[: root.rstrip("/").rfind("/") + 1]
    held, done = {root: len(dirs)}, set()
    while len(held) < most:
        best = None
        for p, own in held.items():
            kids = {}
            for d in dirs:
                if p not in done and d.startswith(p) and d != p:
                    k = d[: d.index("/", len(p)) + 1]
                    kids[k] = kids.get(k, 0) + 1
            kids = {k: n for k, n in sorted(kids.items()) if n >= least}
            if kids and (best is None or own > best[1]):
                best = p, own, kids
        if best is None or len(held) + len(best[2]) > most:
            break
        p, own, kids = best
        done.add(p)
        held |= kids
        held[p] -= sum(kids.values())
        if not held[p]:
            del held[p]
    return list(held.items())


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_the_greedy_splits(spark, seed):
    r = random.Random(seed)
    rows = []
    for service in ("one", "two", "flat", "chain"):
        for i in range(160):
            depth = {"flat": 0, "chain": 5}.get(service, r.randrange(6))
            parts = ["src", "deep", "er"][: r.choice([0, 3])] if service == "two" else []
            parts += ["x"] * depth if service == "chain" and i % 3 else [r.choice(["a", "b", "a-b", "c"][: r.choice([1, 2, 4])]) for _ in range(depth)]
            rows.append((service, "/".join([*parts, f"f{i}"])))
    files = spark.createDataFrame(rows + rows[:9], "service string, path string")
    for most, least in ((1, 3), (2, 1), (5, 3), (12, 3), (40, 2)):
        got = {}
        for x in propose.cluster(files, most, least).orderBy("service", "place").collect():
            got.setdefault(x["service"], []).append((x["prefix"], x["n_files"]))
        assert got == {s: greedy([p for t, p in rows if t == s], most, least) for s in ("one", "two", "flat", "chain")}, (most, least)


def test_clusters_of_nothing_and_ids_by_service(spark):
    assert propose.cluster(spark.createDataFrame([], "service string, path string")).collect() == []
    rows = [(s, f"packages/{d}/src/lib/f{i}.ts") for s in ("One", None) for d in ("coreApi", "x/coreApi") for i in range(9)] + [("One", None)]
    got = propose.propose_services(spark.createDataFrame(rows, "service string, file_path string")).collect()
    assert sorted((x["service"], x["block_id"], x["name"], x["confidence"]) for x in got) == sorted((s, i, n, "high") for s in ("One",) for i, n in (("core-api-lib", "Core Api Lib"), ("core-api-lib-2", "Core Api Lib 2")))


def test_number_of_jobs_does_not_grow_with_the_blocks(spark):
    files = spark.range(4000).selectExpr("'s' as service", "concat('d', id % 40, '/e', id % 7, '/f', id) as path")
    sc = spark.sparkContext

    def jobs(most):
        sc.setJobGroup(f"cluster{most}", "")
        n = propose.cluster(files, most).count()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return n, len(sc.statusTracker().getJobIdsForGroup(f"cluster{most}"))

    (n, few), (m, more) = jobs(41), jobs(280)
    assert n == 40 and m > 200 and more <= few + 2


def test_names_and_paths(spark):
    texts = spark.createDataFrame([("coreApi",), ("HTTPServer v2",), ("--",), ("",), (None,)], "t string")
    assert [x[0] for x in texts.select(paths.kebab(F.col("t"))).collect()] == ["core-api", "httpserver-v2", "", "", None]
    got = spark.createDataFrame([("a/../b//./c",), ("../x",), ("a/../../x",), ("/root/x/../y",), ("/root/../x",), ("/rooted/x",), ("C:\\x",), ("a\\b",), ("",), (None,)], "p string").select(paths.within(F.col("p"), "/root/"))
    assert [x[0] for x in got.collect()] == ["b/c", None, None, "y", None, None, None, "a/b", "", None]


def test_a_block_is_measured_by_its_own_files(spark):
    files = spark.createDataFrame([("src/routes/a", 10), ("src/routes2/b", 20), ("src/c", 40), ("top", 80)], "path string, tokens long")
    prefixes = spark.createDataFrame([("all", ""), ("src", "src/**"), ("routes", "src/routes/"), ("routes", "src/routes"), ("none", "lib"), ("n", None)], "block_id string, prefix string")
    answers = spark.createDataFrame([("all", 8), ("src", 30), ("routes", 20), ("routes", 5), ("none", 1)], "block_id string, tokens long")
    assert rows(review.block_savings(files, prefixes, answers)) == [("all", 1, 80, 90.0), ("none", 0, 0, None), ("routes", 1, 10, 50.0), ("src", 2, 60, 50.0)]
