"""Git sources, services, the sync job, changes of plans, records, reports and reviews on small rows."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from archgraph.functions import tokens
from archgraph.operators import delivery, drift, prefix, records, report, review, telemetry
from archgraph.plans import sync
from archgraph.sources import documents, extract, git


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "app").mkdir()
    for name, text in (("app/a.py", "def f(): return 1\n"), ("app/b.py", "x"), ("top.py", "t"), ("app/c.py", "c")):
        (tmp_path / name).write_text(text)
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "app/b.py").write_text("y")
    (tmp_path / "app/d.py").write_text("d")
    run("add", ".")
    run("commit", "-qm", "two")
    (tmp_path / "app/d.py").unlink()
    (tmp_path / "app/b.py").write_text("z")
    (tmp_path / "top.py").write_text("u")
    return tmp_path


def test_git_changes(spark, repo):
    assert values(git.changed_files(spark, str(repo), "HEAD~1")) == [("app/b.py", "modified"), ("app/d.py", "deleted"), ("top.py", "modified")]
    assert values(git.changed_files(spark, str(repo), "HEAD~9")) == [("app/b.py", "modified"), ("app/d.py", "deleted"), ("top.py", "modified")]
    assert values(git.scope_to(git.changed_files(spark, str(repo), "HEAD~1"), "app")) == [("b.py", "modified"), ("d.py", "deleted")]
    assert git.project_prefix(str(repo / "app")) == "app" and git.project_prefix(str(repo)) == ""
    assert [git.resolve_ref(x, {"last_sync_commit": "abc"}) for x in ("last-commit", "last-sync", "last-phase", "v1")] == ["HEAD~1", "abc", "HEAD~5", "v1"]
    assert git.resolve_ref("last-session") == "HEAD~1"


def test_no_git(spark, tmp_path):
    assert git.head(str(tmp_path)) is None and git.changed_files(spark, str(tmp_path), "HEAD").count() == 0


def test_services_and_sync(spark, repo, tmp_path):
    index = sync.index_services(spark, [("py", str(repo / "app"), "python"), ("gone", str(tmp_path / "nowhere"), "go"), ("odd", str(repo), "cobol")])
    assert values(index.symbols, "service", "id") == [("py", "a.py::f#function")] and [w.split(":")[0] for w in index.warnings] == ["gone", "odd"]
    assert sync.index_services(spark, [("py", str(repo / "app"), "python")], index.files).files.count() == 0
    assert sync.index_services(spark, []).edges.count() == 0
    phases = spark.createDataFrame([("p1", 1, "in-progress")], "id string, phase_number int, status string")
    tasks = spark.createDataFrame([("t1", "p1", "todo", "b", None), ("t2", "p9", "todo", "b", None)], "id string, phase_id string, status string, block_id string, completed_at string")
    prefixes = spark.createDataFrame([("b", "a.")], "block_id string, prefix string")
    none = lambda schema: spark.createDataFrame([], schema)
    s = spark.createDataFrame([("S-1", "failing")], "id string, status string")
    out = sync.sync(index, str(repo), lambda i: drift.undocumented(i.symbols, prefixes), phases, tasks, prefixes, none("task_id string, path string"), none("task_id string, scenario_id string"), s, spark.createDataFrame([("S-1", "passed")], "scenario_id string, outcome string"), {}, F.lit("now"))
    assert values(out.counts, "files", "symbols", "edges") == [(3, 1, 0)]
    assert values(out.tasks, "id", "status") == [("t1", "in-progress"), ("t2", "todo")] and values(out.scenarios, "id", "status") == [("S-1", "passing")]
    assert out.findings.count() == 0 and len(out.commit) == 40 and out.changed.count() == 3 and len(out.warnings) == 2


def test_an_index_is_stored_and_changed_files_replace_theirs(spark, tmp_path):
    from archgraph.plans.state import ProjectState

    code = tmp_path / "code"
    code.mkdir()
    (code / "a.py").write_text("def f():\n    return g()\n\n\ndef g():\n    return 1\n")
    (code / "b.py").write_text("def h():\n    return 2\n")
    state = ProjectState(spark, f"file://{tmp_path}/state")
    first = sync.index_services(spark, [("py", str(code), "python")])
    assert sync.store(first, state) == 1
    known = spark.createDataFrame(first.files.select("service", "path", "content_hash", "language").collect())
    assert values(state.read("symbols"), "id") == [("a.py::f#function",), ("a.py::g#function",), ("b.py::h#function",)]
    assert values(state.read("edges"), "source", "target") == [("a.py::f#function", "a.py::g#function")]
    (code / "a.py").write_text("def f():\n    return 3\n")
    (code / "b.py").unlink()
    later = sync.index_services(spark, [("py", str(code), "python")], known)
    gone = known.join(sync.index_services(spark, [("py", str(code), "python")]).files.select("path"), "path", "left_anti")
    assert sync.store(later, state, gone) == 2
    assert values(state.read("symbols"), "id") == [("a.py::f#function",)] and state.read("edges").count() == 0


def test_tsconfig(spark, tmp_path):
    for name in ("src/a.ts", "src/deep/b.tsx", "src/a.test.ts", "lib/c.ts", "lib/skip/d.ts", "other/e.ts", "src/x.d.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("export const a = 1;")
    assert extract.tsconfig_scan(spark, str(tmp_path)).count() == 6
    (tmp_path / "tsconfig.json").write_text('{ // main\n "include": ["src"], "exclude": ["src/**/*.test.ts"], "references": [{"path": "./lib"}], }')
    (tmp_path / "lib" / "tsconfig.json").write_text(json.dumps({"files": ["c.ts"]}))
    assert values(extract.tsconfig_scan(spark, str(tmp_path)), "path") == [("lib/c.ts",), ("src/a.ts",), ("src/deep/b.tsx",)]


def test_analysis_import(spark, tmp_path):
    said = {"symbols": [{"id": "a::B#class", "name": "B", "qualifiedName": "N.B", "kind": "class", "filePath": "a.cs", "startLine": 1, "endLine": 3, "isExported": True}], "dependencies": [{"sourceSymbolId": "x", "targetSymbolId": "y", "kind": "calls"}], "routes": [{"routePath": "/a", "httpMethods": ["GET"], "hasAuth": True, "responseType": "Task<ActionResult<ADto>>"}, {"routePath": "/b", "httpMethods": ["PUT"]}], "removedFiles": ["old.cs"]}
    (tmp_path / "out.json").write_text(json.dumps(said) + "\n")
    out = documents.roslyn(spark, str(tmp_path / "out.json"))
    assert values(out.symbols, "qualified_name", "file_path", "language") == [("N.B", "a.cs", "csharp")] and values(out.edges) == [("x", "y", "calls")]
    assert values(out.routes, "route_path", "response_type") == [("/a", "ADto"), ("/b", None)] and values(out.removed) == [("old.cs",)] and out.changed.count() == 0


def test_changes_of_a_plan(spark):
    phases = spark.createDataFrame([("p0", "Zero", 0, "complete", None), ("p1", "One", 1, "planned", None)], "id string, name string, phase_number int, status string, description string")
    tasks = spark.createDataFrame([("t0", "p1", "a", "done", None, [], [], None, "then")], "id string, phase_id string, title string, status string, block_id string, scenarios array<string>, criteria array<string>, created_at string, completed_at string")
    blocks = spark.createDataFrame([("b",)], "id string")
    new, task_id = records.create_task(tasks, phases, blocks, "p1", "Set up: the Database!", F.lit("now"), "b", criteria=["it works"])
    assert task_id == "task-1.2-set-up-the-database" and values(new.filter("status = 'todo'"), "id", "block_id", "created_at") == [(task_id, "b", "now")]
    for phase, block in (("p9", "b"), ("p1", "c")):
        with pytest.raises(records.Refused):
            records.create_task(tasks, phases, blocks, phase, "x", F.lit("now"), block)
    assert values(records.update_task(new, task_id, "done", F.lit("now")), "id", "completed_at") == [("t0", "then"), (task_id, "now")]
    assert records.update_task(tasks, "t0", "todo", F.lit("now")).first()["completed_at"] is None
    left, unknown = records.delete_tasks(new, ["t0", "t7"])
    assert left.count() == 1 and unknown == ["t7"] and records.delete_tasks(new, [])[0].count() == 2
    more, phase_id = records.create_phase(phases, "Launch it")
    assert phase_id == "phase-2-launch-it" and values(more.filter("phase_number = 2"), "status") == [("planned",)] and records.create_phase(phases.limit(0), "!")[1] == "phase-0-unnamed"
    with pytest.raises(records.Refused):
        records.create_phase(phases, "x", 1)
    with pytest.raises(records.Refused):
        records.delete_phase(phases, tasks, "p0")
    p, t = records.delete_phase(phases, tasks, "p1")
    assert p.count() == 1 and t.count() == 0
    s = spark.createDataFrame([("S", "untested", "manual", None, [])], "id string, status string, verification string, last_checked string, linked_tests array<string>")
    assert records.update_scenario(s, "S", "passing", F.lit("now"), ["t.py"]).first()[1:] == ("passing", "semi-automatic", "now", ["t.py"])
    assert records.update_scenario(s, "S", "failing", F.lit("now")).first()["verification"] == "manual"


def test_record_never_fails(spark):
    a = spark.createDataFrame([], "id string, tool_name string, drift_count long, recorded_at timestamp, task_id string")
    now = F.lit("2024-01-01").cast("timestamp")
    assert telemetry.record(a, False, "x", now).count() == 0
    r = telemetry.record(a, True, "x", now, drift_count="many", nonsense=1, task_id="t").first()
    assert (r["tool_name"], r["drift_count"], r["task_id"], r["recorded_at"].year) == ("x", None, "t", 2024) and len(r["id"]) == 36


def test_reports(spark):
    f = spark.createDataFrame([("k", "error", None), ("k", "error", "b")], "kind string, severity string, affected_block string")
    assert values(report.drift_summary(f)) == [("block", "(unassigned)", 1), ("block", "b", 1), ("kind", "k", 2), ("severity", "error", 2), ("severity", "info", 0), ("severity", "warning", 0), ("total", "all", 2)]
    assert values(report.drift_summary(f.limit(0))) == [("severity", "error", 0), ("severity", "info", 0), ("severity", "warning", 0), ("total", "all", 0)]


def test_filters(spark):
    p = spark.createDataFrame([("a", "planned"), ("b", "complete")], "id string, status string")
    assert [delivery.select_phases(p, *a).count() for a in ((), ("b",), (None, "complete"), (None, None, True))] == [1, 1, 1, 2]
    s = spark.createDataFrame([("x", "manual"), ("y", "automatic"), ("z", "automatic")], "id string, verification string")
    t = spark.createDataFrame([("x",), ("y",)], "scenario_id string")
    assert values(delivery.testable(s, t), "id") == [("y",)] and values(delivery.testable(s, t, ["x", "z"]), "id") == [("x",)]
    files = spark.createDataFrame([("a/b/c",), (None,), ("z",)], "path string")
    pre = spark.createDataFrame([("deep", "a/b", 2), ("wide", "a/", 1)], "block_id string, prefix string, ord int")
    assert values(prefix.first_prefix_join(files, pre)) == [("a/b/c", "wide")]
    assert values(drift.ignored_prefixes(spark, "api-service", ["x/"])) == [("src/app.",), ("src/index.",), ("src/server.",), ("x/",)] and drift.ignored_prefixes(spark).count() == 0


def _project(spark, **over):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    frames = {
        "symbols": f([("r", "GET", "src/app/api/x/route.ts", "function", True), ("c", "Box", "src/app/box.tsx", "component", True), ("s", "save", "act/save.ts", "function", True)], "id string, name string, file_path string, kind string, is_exported boolean"),
        "edges": f([("c", "s", "imports")], "source string, target string, kind string"),
        "prefixes": f([("web", "src/"), ("act", "act/"), ("old", "old/")], "block_id string, prefix string"),
        "interfaces": f([], "block_id string, target string"),
        "blocks": f([("web",), ("act",)], "id string"),
        "components": f([("c", True, False), ("s", False, True)], "id string, is_client boolean, is_server_action boolean"),
        "routes": f([("/api/x", "api-route", False)], "route_path string, kind string, has_auth boolean"),
        "scenarios": f([("S", "must", "passing", "security", "manual")], "id string, priority string, status string, category string, verification string"),
        "links": f([], "scenario_id string, prefix string"),
        "scenario_blocks": f([("S", "web")], "scenario_id string, block_id string"),
        "phases": f([], "id string, phase_number int, status string"),
        "tasks": f([], "id string, phase_id string, status string, block_id string"),
        "findings": f([("k", "error", None, None)], "kind string, severity string, affected_block string, affected_file string"),
        "changed": f([("src/app/api/x/route.ts", "added"), ("src/app/box.tsx", "modified"), ("conf/.env", "added"), ("old/z.ts", "deleted"), ("docs/arc42/05.yaml", "modified")], "path string, status string"),
    }
    return review.Project(**(frames | over))


def test_practice_review(spark):
    got = values(review.practice_review(_project(spark)))
    assert got == sorted([
        ("architecture", "warning", "unmapped file", "conf/.env"), ("architecture", "warning", "unmapped file", "docs/arc42/05.yaml"), ("architecture", "error", "undeclared interface", "src/app/box.tsx -> act"),
        ("security", "warning", "route without auth", "/api/x"), ("security", "error", "sensitive file", "conf/.env"), ("security", "warning", "server import", "src/app/box.tsx -> act/save.ts"),
        ("testing", "info", "code without tests", "2"), ("testing", "warning", "scenario at risk", "S"), ("documentation", "error", "drift", "1"), ("documentation", "info", "documents changed", "1"),
    ])
    p = _project(spark)
    assert values(review.practice_review(p._replace(changed=p.changed.limit(0))), "kind") == [("drift",)]


def test_proposals_and_roles(spark):
    p = _project(spark)
    assert values(review.document_proposals(p)) == [("emptied prefix", "old/", "old"), ("runtime view", "route files", "1"), ("unmapped folder", "conf/", "1"), ("unmapped folder", "docs/arc42/", "1")]
    assert values(review.role_check(p, "phase-manager").filter("section = 'gate'"), "subject", "value") == [("must-have scenarios", "ready")]
    assert values(review.role_check(p, "architect").filter("section like 'und%'"), "subject", "value") == [("web", "act")]
    for role in (*review.ROLES, "own"):
        assert review.role_check(p, role).columns == ["section", "subject", "value"]
    assert values(review.role_check(p, "own", ["speed"]).filter("section = 'scenarios'"), "subject") == [("S",)]


def test_token_count(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tokens.token_count(F.col("t"), public.path("byte_bpe_50k.json"))).collect()]
    assert got[0] >= 3 and got[1:] == [0, None]


def test_symbols_and_edges_come_from_many_tasks_and_one_parse(spark):
    from archgraph.plans import queries
    from archgraph.plans.model import Model
    from archgraph.sources import edges, extract

    m = Model(spark, "/root/testdata/sf0.001")
    assert queries._files(m, "go").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = edges.edges(edges.references(f := queries._files(m, "go"), "go"), extract.symbols(f, "go"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "BroadcastHashJoin" not in plan
    assert got.count() == 4 * m.part.count()


def test_rows_of_a_batch_come_out_in_parts(spark, monkeypatch):
    from archgraph.sources import extract

    monkeypatch.setattr(extract, "FILES", 3)
    files = spark.createDataFrame([(f"{i}", "x" if i % 4 else None) for i in range(10)], "path string, content string").coalesce(1)
    got = extract.each(files, lambda p, c: [(p, c)] * 2, "a string, b string")
    assert sorted(r["a"] for r in got.collect()) == sorted(2 * [str(i) for i in range(10) if i % 4])
