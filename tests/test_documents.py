"""Loaders, sinks and proposals."""

import pytest
from pyspark.sql import functions as F

from archgraph.operators import propose, review
from archgraph.sources import declared, documents, sinks


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content string")


def test_blocks_and_scenarios(spark):
    got = declared.blocks(files(spark, "blocks:\n- {id: core-lib, name: Core, level: 1, code_paths: ['src/lib/**'], extra: {a: 1}}\n- {id: Bad Id}\n- {id: 7}\n- {id: deep, level: 4}\n- {name: none}", "", None, "a: [b", "blocks: {}\n", "- 1", "blocks: [1]"))
    assert [tuple(r) for r in got.rows.collect()] == [("f0", "core-lib", "Core", 1, None, None, ["src/lib/**"], [], "main")]
    assert sorted(map(tuple, got.rejected.collect()), key=str) == sorted([("f0", "Bad Id", "bad block id"), ("f0", "7", "bad block id"), ("f0", "deep", "bad level"), ("f0", None, "bad block id"), ("f3", None, "not readable"), ("f5", None, "no mapping"), ("f6", None, "no list of blocks")], key=str)
    assert declared.scenarios(files(spark, "scenarios:\n- {id: SEC-01, category: my-own, priority: must}\n")).rows.first()["category"] == "my-own"
    assert declared.blocks(files(spark)).rows.count() == declared.blocks(files(spark)).rejected.count() == 0


def test_a_bad_task_file_is_a_warning_and_a_bad_phase_file_raises(spark):
    got = declared.tasks(files(spark, "phase_id: p1\ntasks:\n- {id: t1, title: T, building_block: b}\n", "tasks: 3\n", "a: [b"))
    assert [(r["id"], r["phase_id"], r["status"], r["block_id"], r["scenarios"]) for r in got.rows.collect()] == [("t1", "p1", "todo", "b", [])]
    assert {r["path"] for r in got.rejected.collect()} == {"f1", "f2"}
    assert declared.phases(files(spark, "phases:\n- {id: p1, name: P, phase_number: 1}\n")).first()["status"] == "planned"
    with pytest.raises(declared.Rejected):
        declared.phases(files(spark, "phases: x"))


def test_decisions_roles_and_front_matter(spark):
    long = "x " * 200_000
    texts = ["---\nid: 001-use-spark\ntitle: Use it\ndate: 2024-01-02\naffected_files: [a.py]\n---\n\nBecause.\n---\nAnd so on.\n", "---\r\nid: 002-long\r\n---\r\n" + long, "no fields", "---\nid: [\n---\n", "---\n---\nbody", None]
    got = declared.decisions(files(spark, *texts))
    assert sorted((r["decision_id"], r["text"], r["date"], r["affected_files"]) for r in got.rows.collect()) == [("001-use-spark", "Because.\n---\nAnd so on.", "2024-01-02", ["a.py"]), ("002-long", long.strip(), "", [])]
    assert sorted(r["path"] for r in got.rejected.collect()) == ["f2", "f3", "f4", "f5"]
    m = files(spark, *texts[2:]).select(declared.front_matter(F.col("content")).alias("m")).select("m.*")
    assert [tuple(r) for r in m.collect()] == [(None, "no fields"), ("id: [", ""), ("", "body"), (None, None)]
    role = declared.roles(files(spark, "---\nrole_id: security-reviewer\nfocus: [security]\n---\nLook closely.\n")).rows.first()
    assert (role["role_id"], role["focus"], role["instructions"]) == ("security-reviewer", ["security"], "Look closely.")


def test_files_are_read_by_tasks(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.yaml").write_text("blocks:\n- {id: one}\n")
    (tmp_path / "a" / "b" / "y.yaml").write_text("blocks:\n- {id: two}\n")
    (tmp_path / "a" / "b" / "y.md").write_text("blocks:\n- {id: three}\n")
    got = declared.blocks(declared.read_files(spark, str(tmp_path), glob="*.yaml")).rows.collect()
    assert sorted((r["id"], r["path"].rsplit("/", 1)[1]) for r in got) == [("one", "x.yaml"), ("two", "y.yaml")]


def test_proposals_read_back_and_statuses_are_written(spark):
    p = spark.createDataFrame([("a.yaml", "b-two", 'say: "hi"\n- x', ["p/*"]), ("a.yaml", "a-one", None, []), ("c.yaml", "c", "é", None)], "path string, id string, name string, code_paths array<string>")
    back = declared.blocks(declared.blocks_files(p)).rows.select("path", "id", "name", "code_paths").collect()
    assert sorted(map(tuple, back)) == [("a.yaml", "a-one", None, []), ("a.yaml", "b-two", 'say: "hi"\n- x', ["p/*"]), ("c.yaml", "c", "é", [])]
    f = files(spark, "note: é\ntasks:\n- {id: t1, status: todo}\n- {id: t2, status: done}\n", "# kept\ntasks:\n- {id: t3}\n", "a: [b", "tasks:\n- {id: t4}\n")
    changes = spark.createDataFrame([("t1", "done"), ("t1", "blocked"), ("t2", "done"), ("t4", "done"), ("zz", "done"), (None, "x")], "id string, status string")
    out = {r["path"]: r for r in declared.with_statuses(f, changes, "tasks").collect()}
    assert {k: r["changed"] for k, r in out.items()} == {"f0": 1, "f1": 0, "f2": 0, "f3": 1}
    assert out["f1"]["content"].startswith("# kept") and out["f2"]["content"] == "a: [b" and "note: é" in out["f0"]["content"]
    got = declared.tasks(spark.createDataFrame([(k, r["content"]) for k, r in out.items()], "path string, content string")).rows
    assert {r["id"]: r["status"] for r in got.collect()} == {"t1": "done", "t2": "done", "t3": "todo", "t4": "done"}


def test_packages(spark):
    files = spark.createDataFrame([("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}'), ("x/y.csproj", '<PackageReference Include="Z.Q" Version="3" />'), ("bad/package.json", "{")], "path string, content string")
    got = sorted((r["name"], r["version"], r["source"]) for r in documents.packages(files).collect())
    assert got == [("Z.Q", "3", "nuget"), ("a", "1", "npm"), ("b", "2", "npm-dev")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 3), ('say "hi", <all>', 6), (None, None), ("low", -1)], "name string, n int")
    lines = [r["value"] for r in sinks.html_lines("R & D", {"S": df.orderBy("n"), "none": df.limit(0), "text": df.select("name")}).collect()]
    page = "".join(lines)
    assert "&lt;all&gt;" in page and "width:50px" in page and "width:100px" in page and "width:0px" in page and "R &amp; D" in page
    assert page.index("low") < page.index("a|b") < page.index("say ") and page.count("</table>") == 3 and page.endswith("</body></html>")
    sinks.export(df, f"{tmp_path}/out", "csv")
    assert spark.read.csv(f"{tmp_path}/out", header=True, escape='"').count() == 4


def test_clusters_split_whole_or_not_at_all(spark):
    folders = {"src/": 1, "src/components/": 3, "src/lib/": 3, "src/hooks/": 3, "src/rare/": 1}

    def clusters(counts, most=12):
        files = spark.createDataFrame([("s", f"{d}f{i}") for d, n in counts.items() for i in range(n)], "service string, path string")
        return [x["prefix"] for x in propose.cluster(files, most).orderBy("place").collect()]

    assert set(clusters(folders)) == {"src/", "src/components/", "src/lib/", "src/hooks/"}
    assert clusters(folders, 3) == ["src/"]
    assert clusters({"a/x/": 3, "a/y/": 3}) == ["a/x/", "a/y/"]
    assert clusters({}) == []
    assert propose.block_ids(["src/lib/", "packages/core/src/lib/", "src/"], "My App") == {"src/lib/": "lib", "packages/core/src/lib/": "core-lib", "src/": "my-app"}


def test_a_proposal_covers_every_file(spark):
    s = spark.createDataFrame([(f"src/{d}/f{i}.ts",) for d in "abc" for i in range(4)] + [("src/main.ts",)], "file_path string")
    p = propose.propose(s)
    assert sum(r["n_files"] for r in p.collect()) == 13


def test_missing_runs_leave_the_status(spark):
    s = spark.createDataFrame([("A", "untested"), ("B", "passing"), ("C", "passing")], "id string, status string")
    r = spark.createDataFrame([("A", "passed"), ("B", "missing"), ("C", "passed"), ("C", "error")], "scenario_id string, outcome string")
    assert {x["id"]: x["status"] for x in review.verified(s, r).collect()} == {"A": "passing", "B": "passing", "C": "failing"}


def test_markdown_lines_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"a|b\n{i}") for i in range(50)], "id int, `x y` string").repartition(4).sortWithinPartitions("id")
    lines = [r["value"] for r in sinks.markdown_lines(df).collect()]
    assert lines[:2] == ["| id | x y |", "|---|---|"] and sorted(lines[2:]) == sorted(f"| {i} | " + ("" if i % 5 == 0 else f"a\\|b {i}") + " |" for i in range(50))
    sinks.export(df, f"{tmp_path}/md", "markdown")
    assert spark.read.text(f"{tmp_path}/md").count() == 52
    assert [r["value"] for r in sinks.markdown_lines(df.limit(0)).collect()] == ["| id | x y |", "|---|---|"]


def test_each_file_is_read_once_for_rows_and_quarantine(spark, monkeypatch):
    monkeypatch.setattr(declared, "FILES", 2)
    texts = ["phase_id: p\ntasks:\n- id: a\n- id: 7\n- {}\n", "tasks: none", "tasks: [", "", None, "- x", "tasks: []"]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string").coalesce(1)
    got = declared.tasks(files)
    assert [(r["path"], r["id"], r["phase_id"]) for r in got.rows.collect()] == [("f0", "a", "p")]
    want = [("f0", "7", "bad any id"), ("f0", None, "bad any id"), ("f1", None, "no list of tasks"), ("f2", None, "not readable"), ("f5", None, "no mapping")]
    assert sorted(map(tuple, got.rejected.collect()), key=str) == sorted(want, key=str)
    assert got.rejected._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
