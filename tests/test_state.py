"""Stored state, the stream of changes and the tiers of names."""

import random

import pytest
from pyspark.sql import functions as F

from archgraph import shared
from archgraph.operators import changes
from archgraph.plans import queries, state
from archgraph.streaming import activity

SYMBOL = "id string, file_path string, service string, language string, kind string"
EDGE = "source string, target string, kind string, service string, language string"
PART = "id string, service string, language string"


def index(spark, files):
    """Symbols, edges and components of files {(service, language, path): [(name, targets)]}."""
    symbols, edges, parts = [], [], []
    for (service, language, path), held in files.items():
        for name, targets in held:
            symbols.append((name, path, service, language, "k"))
            edges += [(name, t, "calls", service, language) for t in targets]
            parts += [(name, service, language)] if name.endswith("c") else []
    return spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(edges, EDGE), spark.createDataFrame(parts, PART)


def named(spark, keys):
    return spark.createDataFrame([(p, s, lang) for s, lang, p in keys], "file_path string, service string, language string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


FILES = {
    ("a", "ts", "f1"): [("a1", ["b1", "a2c"]), ("a2c", [])],
    ("a", "ts", "f2"): [("a3", ["a1"])],
    ("a", "py", "g"): [("p1c", ["a2c"])],
    ("b/x =1", "ts", "h"): [("b1", ["a2c", "p1c"])],
    (None, "ts", "n"): [("n1", ["b1"])],
}


def test_upsert_equals_a_full_rebuild_and_survives_a_lost_job(spark, tmp_path, monkeypatch):
    s = state.ProjectState(spark, f"file://{tmp_path}/state")
    assert s.read("symbols") is None and s.version() == 0
    state.apply_index(s, named(spark, FILES), *index(spark, FILES))
    before = {t: rows(s.read(t)) for t in ("symbols", "edges", "components")}
    assert [rows(x) for x in index(spark, FILES)] == list(before.values())
    # a2c goes, a1 changes, a4c comes; f2 is removed
    changed = {("a", "ts", "f1"): [("a1", ["a4c", "p1c"]), ("a4c", ["b1"])]}
    touched = named(spark, [("a", "ts", "f1"), ("a", "ts", "f2")])
    point = state.ProjectState._point

    def dies(self, *args):
        raise RuntimeError("lost")

    monkeypatch.setattr(state.ProjectState, "_point", dies)
    with pytest.raises(RuntimeError):
        state.apply_index(s, touched, *index(spark, changed))
    assert {t: rows(s.read(t)) for t in before} == before
    monkeypatch.setattr(state.ProjectState, "_point", point)
    kept_version = s.manifest()["tables"]["symbols"]["scopes"]["service=a/language=py"]
    for _ in range(2):  # a repetition changes nothing
        state.apply_index(s, touched, *index(spark, changed))
        now = {k: v for k, v in FILES.items() if k[2] not in ("f1", "f2")} | changed
        known = {n for held in now.values() for n, _ in held}
        want = index(spark, {k: [(n, [t for t in ts if t in known]) for n, ts in held] for k, held in now.items()})
        assert [rows(s.read(t)) for t in before] == [rows(x) for x in want]
    assert s.manifest()["tables"]["symbols"]["scopes"]["service=a/language=py"] == kept_version  # not written again
    s.vacuum()
    assert [rows(s.read(t)) for t in before] == [rows(x) for x in want]


def test_delete_cascades_over_scopes(spark, tmp_path):
    s = state.ProjectState(spark, f"file://{tmp_path}/state")
    state.apply_index(s, named(spark, FILES), *index(spark, FILES))
    state.delete_files(s, named(spark, [("b/x =1", "ts", "h"), ("a", "py", "g")]))
    assert {r[0] for r in rows(s.read("symbols"))} == {"a1", "a2c", "a3", "n1"}
    assert {r[:2] for r in rows(s.read("edges"))} == {("a1", "a2c"), ("a3", "a1")}
    assert {r[0] for r in rows(s.read("components"))} == {"a2c"}


def test_repeated_rows_and_two_writers(spark, tmp_path):
    s = state.ProjectState(spark, f"file://{tmp_path}/state")
    sy, e, c = index(spark, FILES)
    state.apply_index(s, named(spark, FILES), sy.union(sy), e.union(e), c.union(c))
    assert [rows(s.read(t)) for t in ("symbols", "edges", "components")] == [rows(sy), rows(e), rows(c)]
    with pytest.raises(RuntimeError):
        s._point(1, s.manifest())  # another job was first


def test_changed_files_as_a_stream_with_restarts(spark, tmp_path):
    schema = "path string, content_hash string, batch long"
    r, shown, want = random.Random(1), {}, []
    for n in range(4):
        new = {f"f{i}": f"h{r.randrange(3)}" for i in range(20) if r.random() < 0.7}
        put = [(p, h, n) for p, h in new.items()] + [(p, None, n) for p in shown if p not in new] + [("never", None, n), (None, "h", n)]
        spark.createDataFrame(put + put[:2], schema).write.mode("append").parquet(f"{tmp_path}/in")
        want += [(p, "added" if p not in shown else "removed" if p not in new else "unchanged" if new[p] == shown[p] else "modified", n) for p in sorted({*new, *shown})]
        shown = new
        q = activity.changed_files(activity.read_activity(spark, f"{tmp_path}/in", schema)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == sorted(want, key=repr)


def test_streamed_paths_share_calls(spark, tmp_path):
    schema = "path string, content_hash string, batch long"
    got = {}
    for groups in (1, 7, 1 << 14):
        at = f"{tmp_path}/{groups}"
        for n, hashes in ((1, {f"f{i}": "a" for i in range(60)}), (2, {f"f{i}": "b" if i % 3 else None for i in range(10, 70)}), (3, {f"f{i}": None for i in range(70)}), (4, {"f9": "a"})):
            spark.createDataFrame([(p, h, n) for p, h in hashes.items()], schema).write.mode("append").parquet(f"{at}/in")
            stream = activity.changed_files(activity.read_activity(spark, f"{at}/in", schema), groups)
            q = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start(f"{at}/out")
            q.awaitTermination()
            # as many keys in the state as there are groups at most, none without a path left
            keys = q.lastProgress["stateOperators"][0]["numRowsTotal"]
            assert keys <= groups and (keys == 0) == (n == 3)
        got[groups] = rows(spark.read.parquet(f"{at}/out"))
    first = [(f"f{i}", "added", 1) for i in range(60)]
    second = [(f"f{i}", "removed" if i % 3 == 0 else "modified", 2) for i in range(10, 60)] + [(f"f{i}", "added", 2) for i in range(60, 70) if i % 3]
    third = [(f"f{i}", "removed", 3) for i in range(70) if i < 10 or i % 3]
    assert got[1] == got[7] == got[1 << 14] == sorted([*first, *second, *third, ("f9", "added", 4)], key=repr)


def test_a_name_with_a_third_of_the_symbols_stays_one_candidate_set(spark):
    symbols = spark.range(3000).selectExpr("concat('s', id) as id", "if(id % 3 = 0, 'get', concat('f', id)) as name", "concat('p', id % 50) as file_path", "if(id % 7 = 0, 'C', null) as scope")
    refs = spark.range(2000).selectExpr("id as ref_id", "if(id % 2 = 0, 'get', concat('f', id)) as name", "concat('q', id) as file_path", "cast(null as string) as scope")
    tiers = changes.resolve_tiers(refs, symbols)
    assert tiers.count() == 1000 + sum(1 for i in range(1, 2000, 2) if i % 3)
    assert {r["n"] for r in tiers.filter("name = 'get'").collect()} == {1000}
    some = changes.expand_resolved(tiers.filter("ref_id in (0, 1)"), symbols)
    assert some.count() == 1001
    salts = tiers.filter("name = 'get'").select(F.pmod(F.xxhash64("ref_id"), F.lit(8))).distinct().count()
    assert salts == 8


def test_tiers_of_nulls_and_repeats(spark):
    symbols = spark.createDataFrame([("1", "x", "f", None), ("2", "x", "f", "C"), ("3", "x", "g", None), ("4", None, "f", None)], "id string, name string, file_path string, scope string")
    refs = spark.createDataFrame([(1, "x", "f", "C"), (2, "x", "f", None), (3, "x", "f", "D"), (4, "x", "z", None), (5, None, "f", None), (6, "y", "f", None)], "ref_id int, name string, file_path string, scope string")
    got = {r["ref_id"]: (r["tier"], r["n"]) for r in changes.resolve_tiers(refs, symbols).collect()}
    assert got == {1: ("scope", 1), 2: ("scope", 1), 3: ("file", 2), 4: ("any", 3)}
    assert rows(changes.resolve_names(refs, symbols)) == [(1, "2"), (2, "1"), (3, "1"), (3, "2"), (4, "1"), (4, "2"), (4, "3")]


def test_refresh_keeps_states_and_clears_lost_blocks(spark):
    t = "id string, status string, completed_at string, block_id string, title string"
    old = spark.createDataFrame([("1", "done", "d1", "a", "x"), ("2", "todo", None, "a", "x"), ("gone", "done", "d", "a", "x"), ("3", "blocked", None, "b", "x")], t)
    new = spark.createDataFrame([("1", "todo", None, "z", "y"), ("2", "in-progress", "c", "a", "y"), ("3", "todo", "c", None, "y"), ("4", "todo", None, "b", "y")], t)
    blocks = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert rows(changes.refresh(old, new, blocks)) == [("1", "done", "d1", None, "y", True), ("2", "in-progress", "c", "a", "y", False), ("3", "blocked", None, None, "y", False), ("4", "todo", None, "b", "y", False)]
    assert rows(changes.refresh(old.limit(0), new.limit(0), blocks)) == []


def test_ranked_pages(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id int, k int")
    got = changes.ranked(df, F.col("k").desc(), "id", limit=4, offset=5).orderBy("rank").collect()
    assert [(r["rank"], r["k"], r["id"]) for r in got] == [(6, 2, 17), (7, 1, 1), (8, 1, 4), (9, 1, 7)]
    assert changes.ranked(df, "id", limit=5, offset=20).collect() == []


def test_contract_fields_compare_each_pair_of_types_by_itself(spark):
    from archgraph.operators import routes

    hits = spark.createDataFrame([("c1", "s", "Out", "A"), ("c2", "s", "Out", "B"), ("c3", "s", "Unknown", "A"), ("c4", "s", "Out", "A"), ("c4", "t", "Other", "A")], "call_id string, service string, dto string, expected string")
    used = spark.createDataFrame([("A", "id", "string", False), ("B", "Name", "string", False), ("B", "extra", "number", True)], "dto string, field string, type string, optional boolean")
    given = spark.createDataFrame([("Out", "id", "int"), ("Out", "name", "Guid")], "dto string, field string, type string")
    assert rows(routes.contract_fields(hits, used, given)) == [("c1", "Out", "id", "type"), ("c2", "Out", "Name", "casing")]


def test_only_hot_names_are_salted(spark, monkeypatch):
    monkeypatch.setattr(changes, "HOT", 100)
    symbols = spark.range(300).selectExpr("cast(id as string) as id", "if(id % 3 = 0, 'get', concat('f', id)) as name", "'p' as file_path", "cast(null as string) as scope")
    refs = spark.range(400).selectExpr("id as ref_id", "if(id % 2 = 0, 'get', concat('f', id)) as name", "'q' as file_path", "cast(null as string) as scope")
    tiers = changes.resolve_tiers(refs, symbols)
    assert {(r["name"], r["n"]) for r in tiers.collect()} == {("get", 100)} | {(f"f{i}", 1) for i in range(1, 300, 2) if i % 3}
    assert tiers.count() == 200 + sum(1 for i in range(1, 300, 2) if i % 3)
    assert "SortMergeJoin" in changes.resolve_tiers(refs, symbols)._jdf.queryExecution().executedPlan().toString()


def test_no_id_is_broadcast_when_a_scope_goes(spark):
    symbols = spark.createDataFrame([(f"s{i}", f"f{i % 3}", "svc", "go") for i in range(9)], "id string, file_path string, service string, language string")
    edges = spark.createDataFrame([(f"s{i}", f"s{(i + 1) % 9}", "calls") for i in range(9)], "source string, target string, kind string")
    kept, e = changes.delete_scope(symbols, edges, symbols.filter("file_path = 'f1'").select("file_path", "service", "language").distinct())
    assert "BroadcastHashJoin [id" not in (plan := kept._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin [id" in plan
    assert e._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2
    assert rows(e.select("source", "target", "kind")) == [("s2", "s3", "calls"), ("s5", "s6", "calls"), ("s8", "s0", "calls")]


def test_one_shuffle_of_edges_and_one_version_stand_on_disk(spark, tmp_path, monkeypatch):
    plans, commit = [], state.ProjectState.commit
    monkeypatch.setattr(state.ProjectState, "commit", lambda self, tables, *a: (plans.append(tables["edges"]._jdf.queryExecution().sparkPlan().toString()), commit(self, tables, *a))[1])
    monkeypatch.setattr(queries, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = queries.QUERIES["g6_state_components"](spark, "/root/testdata/sf0.001")
    assert plans[1].count("SortMergeJoin") == 1  # of the second index; each join before it was written
    versions = [p.parent.name for p in tmp_path.rglob("language=*")]  # service=..
    held = {(p.parts[-4], p.parts[-2], p.parts[-1]) for p in tmp_path.rglob("language=*")}
    assert versions and len(held) == len(versions)
    assert not [p for p in tmp_path.rglob("*.parquet") if "/state-" not in str(p)]
    assert out.count() > 0
