"""Operators on small rows with the expected results written out."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archgraph.functions import paths, types
from archgraph.operators import changes, delivery, drift, graph, prefix, routes, telemetry
from archgraph.sources import extract


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(
    ("route", "url", "fits"),
    [("/api/Users", "/api/users", True), ("/api/users/:id", "/api/users/42", True), ("/api/users/{id}", "/api/users/42?x=1", True), ("/api/users/<id>", "/api/users/42", True), ("/api/users/[id]", "/api/users/42", True),
     ("/api/users/{id}", "/api/users/:param", True), ("/api/users", "/api/users/42", False), ("/api/users/:id", "/api/users", False), ("/api/*path", "/api/a/b/c", True), ("/api/[...slug]", "/api", True), ("/api/{**slug}", "/api/a", True), ("/api/*path", "/other/a", False), ("/", "/", True)],
)
def test_route_patterns(spark, route, url, fits):
    r = spark.createDataFrame([(route,)], "route_path string")
    c = spark.createDataFrame([(url,)], "url string")
    assert routes.route_match_join(r, c).count() == int(fits)


@pytest.mark.parametrize(
    ("text", "name"),
    [("Task<ActionResult<List<UserDto>>>", "UserDto"), ("Promise<Bookmark[]>", "Bookmark"), ("IEnumerable<Api.Models.Order>", "Order"), ("UserDto?", "UserDto"), ("Promise<UserDto | null>", "UserDto"), ("{ id: string }", None), ("() => void", None), ("Task<int>", None), ("IActionResult", None), ("", None), (None, None), ("Paged<UserDto>", "Paged"), ("UserDto | ErrorDto", None)],
)
def test_type_names(text, name):
    assert types.type_name(text) == name


@pytest.mark.parametrize(("text", "category"), [("Guid", "string"), ("decimal", "number"), ("DateTime", "date"), ("string[]", "array<string>"), ("List<int>", "array<number>"), ("int?", "number"), ("long", "bigint"), ("TimeSpan", None), ("Thing[]", "array<?>"), ("string | null", "string"), (None, None)])
def test_type_categories(text, category):
    assert types.type_category(text) == category


def test_type_columns(spark):
    df = spark.createDataFrame([("Task<Foo>", "int"), (None, None)], "a string, b string")
    assert sorted(map(str, df.select(types.unwrapped(F.col("a")), types.category(F.col("b"))).collect())) == sorted(["Row(run(a)='Foo', run(b)='number')", "Row(run(a)=None, run(b)=None)"])


def test_longest_prefix_is_a_string_prefix_and_ties_go_to_the_least_block(spark):
    files = spark.createDataFrame([("src/lib/a",), ("src/lib2/b",), ("x",), (None,)], "path string")
    p = spark.createDataFrame([("b", "src/lib"), ("a", "src/lib"), ("c", "src/"), ("d", "")], "block_id string, prefix string")
    assert values(prefix.longest_prefix_join(files, p), "path", "block_id") == [("src/lib/a", "a"), ("src/lib2/b", "a"), ("x", "d")]
    assert values(prefix.unused_prefixes(p, files), "prefix") == []
    assert prefix.without_prefix(files.filter("path is not null"), p.filter("prefix = 'SRC/'")).count() == 3
    assert prefix.longest_prefix_join(files, p.limit(0)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab/", max_size=5), min_size=1, max_size=8), st.lists(st.text("ab/", max_size=3), min_size=1, max_size=5))
def test_prefix_join_equals_startswith(spark, files, prefixes):
    f = spark.createDataFrame([(x,) for x in sorted(set(files))], "path string")
    p = spark.createDataFrame([(x,) for x in sorted(set(prefixes))], "prefix string")
    assert values(prefix.prefix_pairs(f, p), "path", "prefix") == sorted((a, b) for a in set(files) for b in set(prefixes) if a.startswith(b))


def test_log_replacement_keeps_what_is_resolved(spark):
    log = spark.createDataFrame([("a", "fixed"), ("b", None)], "kind string, resolution string")
    new = spark.createDataFrame([("c",)], "kind string")
    assert values(drift.replace_unresolved(log, new), "kind") == [("a",), ("c",)]


def test_changes_and_precedence(spark):
    f = lambda *rows: spark.createDataFrame(rows, "path string, content_hash string")
    assert values(changes.changed_files(f(("a", "1"), ("b", "1"), ("c", "1")), f(("a", "1"), ("b", "2"), ("d", "1"))), "path", "change") == [("a", "unchanged"), ("b", "modified"), ("c", "removed"), ("d", "added")]
    s = lambda *rows: spark.createDataFrame(rows, "path string, status string")
    assert values(changes.merge_changes(s(("a", "added"), ("b", "added")), s(("a", "deleted"))), "path", "status") == [("a", "deleted"), ("b", "added")]


def test_names_resolve_to_the_nearest_tier(spark):
    syms = spark.createDataFrame([("1", "f", "A", "x.py"), ("2", "f", None, "x.py"), ("3", "f", None, "y.py")], "id string, name string, scope string, file_path string")
    refs = spark.createDataFrame([("own", "f", "A", "x.py"), ("file", "f", "B", "x.py"), ("all", "f", None, "z.py"), ("none", "g", None, "x.py")], "ref_id string, name string, scope string, file_path string")
    assert values(changes.resolve_names(refs, syms), "ref_id", "id") == [("all", "1"), ("all", "2"), ("all", "3"), ("file", "1"), ("file", "2"), ("own", "1")]


def test_totals_of_nothing_and_grouped_nulls(spark):
    schema = "id long, tool_name string, model string, task_id string, phase_id string, total_tokens long, cost_usd double, duration_ms long, recorded_at timestamp"
    none = spark.createDataFrame([], schema)
    assert telemetry.totals(none).first()[:3] == (0, 0, 0.0)
    one = spark.createDataFrame([(1, "t", None, None, None, None, 1.0, 10, None)], schema)
    assert telemetry.grouped(one, "model").first()[:3] == ("(none)", 1, None)


def test_pass_rate(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "status string")
    assert delivery.pass_rate(s("passing", "failing", "untested")).first()[0] == 50.0
    assert delivery.pass_rate(s("untested")).first()[0] is None


def test_traversal_takes_the_least_depth(spark):
    sym = spark.createDataFrame([(x, x, f"{x}/f", "s") for x in "abcd"], "id string, name string, file_path string, service string")
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("a", "c", "calls")], "source string, target string, kind string")
    assert values(graph.traverse(e, sym, "a/", 2), "file", "depth") == [("b/f", 1), ("c/f", 1), ("d/f", 2)]
    assert values(graph.traverse(e, sym, "d/", 1, "dependents"), "file") == [("c/f",)]


def test_path_functions(spark):
    df = spark.createDataFrame([("src/lib/**", "/a/b?c#d", "app/(auth)/users/[id]/page.tsx", "app/docs/[[...slug]]/page.tsx")], "p string, u string, r string, s string")
    r = df.select(paths.normalize_path(F.col("p")), paths.strip_query(F.col("u")), paths.app_route(F.col("r")), paths.app_route(F.col("s")), paths.slug(F.lit("Hello, World!"))).first()
    assert tuple(r) == ("src/lib/", "/a/b", "/users/:id", "/docs/*slug?", "hello-world")


def test_python_extraction(spark):
    src = 'MAX = 3\nclass A(Base):\n    """Doc."""\n    async def run(self, x: Foo) -> int:\n        return helper(x)\n\n@app.get("/u/{id}")\ndef _get(id, user=Depends(get_current_user)): pass\n\n@bp.route("/f", methods=["POST", "put"])\ndef f(): pass\n'
    files = spark.createDataFrame([("m.py", src), ("bad.py", "def ("), (None, src), ("n.py", None)], "path string, content string")
    got = values(extract.symbols(files, "python"), "id", "is_exported", "is_async")
    assert got == [("m.py::A#class", True, False), ("m.py::A.run#function", True, True), ("m.py::MAX#constant", True, False), ("m.py::_get#function", False, False), ("m.py::f#function", True, False)]
    refs = values(extract.references(files), "source", "target_name", "kind")
    assert ("m.py::A#class", "Base", "extends") in refs
    assert ("m.py::A.run#function", "helper", "calls") in refs
    assert ("m.py::A.run#function", "Foo", "uses_type") in refs
    assert values(extract.routes(files, "python"), "route_path", "methods", "has_auth") == [("/f", ["POST", "PUT"], False), ("/u/{id}", ["GET"], True)]


def test_go_extraction(spark):
    src = 'package x\n\ntype User struct {\n\tName string\n}\n\nfunc (u *User) Save(n int) error {\n\treturn nil\n}\nconst a, B = 1, 2\n\nfunc main() {\n\tapi := r.Group("/api")\n\tapi.GET("/users/:id", getUser)\n\thttp.HandleFunc("/h", serve)\n}\n'
    files = spark.createDataFrame([("m.go", src)], "path string, content string")
    assert values(extract.symbols(files, "go"), "id", "start_line", "end_line") == [("m.go::B#constant", 10, 10), ("m.go::User#class", 3, 5), ("m.go::User.Save#function", 7, 9), ("m.go::a#constant", 10, 10), ("m.go::main#function", 12, 16)]
    assert values(extract.routes(files, "go"), "route_path", "methods") == [("/api/users/:id", ["GET"]), ("/h", [])]


def test_typescript_extraction(spark):
    src = 'export interface User {\n  id: number;\n  nick?: string;\n}\nexport async function load() { return fetch(`/api/users/${id}`, { method: "POST" }); }\nexport const useX = () => 1;\nconst Ctx = createContext(null);\nconst r = api.get<User[]>("/api/list?x=1");\n'
    files = spark.createDataFrame([("m.ts", src)], "path string, content string")
    got = values(extract.symbols(files, "typescript"), "qualified_name", "kind", "is_exported")
    assert got == [("Ctx", "context", False), ("User", "interface", True), ("User.id", "variable", True), ("User.nick", "variable", True), ("load", "function", True), ("r", "constant", False), ("useX", "hook", True)]
    assert values(extract.calls(files), "url", "method", "line") == [("/api/list?x=1", "GET", 8), ("/api/users/:param", "POST", 5)]
    app = spark.createDataFrame([("app/(a)/users/[id]/route.ts", "export async function GET() {}\nexport const POST = 1"), ("lib/x.ts", "")], "path string, content string")
    assert values(extract.app_routes(app), "route_path", "kind", "methods") == [("/users/:id", "api-route", ["GET", "POST"])]


def test_scan(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.py", "c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    assert values(extract.scan(spark, str(tmp_path), "python"), "path") == [("src/a.py",)]
    assert extract.language_of(["a/go.mod", "pyproject.toml"]) == "go"


def test_streaming_day_counts(spark, tmp_path):
    from archgraph.streaming import activity

    df = spark.createDataFrame([(1, "2024-01-01 10:00:00", 1.5), (2, "2024-01-01 11:00:00", 1.0), (3, "2024-01-02 00:00:00", 2.0)], "id long, t string, cost_usd double").select("id", F.to_timestamp("t").alias("recorded_at"), "cost_usd")
    df.write.parquet(f"{tmp_path}/in")
    q = activity.daily(activity.read_activity(spark, f"{tmp_path}/in", df.schema)).writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert values(spark.table("days"), "day", "n", "cost") == [("2024-01-01", 2, 2.5), ("2024-01-02", 1, 2.0)]


@pytest.mark.parametrize(("text", "name", "category"), [("Promise<{ a: string }>", None, None), ("[A, B]", None, None), ("Map<string, List<Foo>>", "Map", None), ("Array<Foo | undefined>", "Foo", "array<?>"), ("List<>", "List", "array<?>"), ("(A | B)[]", None, "array<?>"), ("ns.Foo[][]", "Foo", "array<array<?>>"), ("null", None, None), ("Task<", "Task", None), (">", None, None)])
def test_odd_types(text, name, category):
    assert (types.type_name(text), types.type_category(text)) == (name, category)


def test_sole_producers_and_contract_fields(spark):
    hits = spark.createDataFrame([("c1", "s1", "User", "UserView"), ("c2", "s1", "User", "UserView"), ("c2", "s2", "Other", "UserView")], "call_id string, service string, dto string, expected string")
    used = spark.createDataFrame([("UserView", "Name", "string", False), ("UserView", "age", "string", False), ("UserView", "gone", "string", False), ("UserView", "maybe", "string", True)], "dto string, field string, type string, optional boolean")
    given = spark.createDataFrame([("User", "name", "string"), ("User", "age", "int"), ("Other", "gone", "string")], "dto string, field string, type string")
    assert values(routes.sole_producer(hits, ["call_id"]), "call_id", "dto") == [("c1", "User")]
    assert values(routes.contract_fields(hits, used, given), "call_id", "field", "problem") == [("c1", "Name", "casing"), ("c1", "age", "type"), ("c1", "gone", "missing")]


def test_route_masks_on_either_side_and_many_rows(spark):
    import random

    r = random.Random(4)
    part = lambda: r.choice(["a", "B", "b", ":x", "{y}", "c"])
    rs = sorted({"/" + "/".join(part() for _ in range(r.randint(0, 3))) + r.choice(["", "", "/*rest"]) for _ in range(60)})
    us = sorted({"/" + "/".join(part() for _ in range(r.randint(0, 4))) + r.choice(["", "?q=1"]) for _ in range(80)})
    free = lambda s: s[0] in ":*{"

    def fits(route, url):
        a, b = [s for s in route.split("/") if s], [s for s in url.split("?")[0].split("/") if s]
        if a and a[-1] == "*rest":
            a = a[:-1]
            b = b[: len(a)] if len(b) >= len(a) else None
        return b is not None and len(a) == len(b) and all(free(x) or free(y) or x.lower() == y.lower() for x, y in zip(a, b, strict=True))

    got = routes.route_match_join(spark.createDataFrame([(x,) for x in rs], "route_path string"), spark.createDataFrame([(x,) for x in us], "url string"))
    assert values(got, "route_path", "url") == sorted((a, b) for a in rs for b in us if fits(a, b))


def test_phase_completion_needs_an_open_gate(spark):
    p = spark.createDataFrame([("a", 1, "in-progress", None, None), ("b", 2, "planned", None, None), ("c", 3, "planned", None, None)], "id string, phase_number int, status string, started_at string, completed_at string")
    gates = spark.createDataFrame([("a", True), ("b", False)], "id string, may_complete boolean")
    done = delivery.complete_phase(p, gates, "a", F.lit("now"))
    assert sorted(map(tuple, done.collect())) == [("a", 1, "complete", None, "now"), ("b", 2, "in-progress", "now", None), ("c", 3, "planned", None, None)]
    assert sorted(map(tuple, delivery.complete_phase(p, gates, "b", F.lit("now")).collect())) == sorted(map(tuple, p.collect()))


def test_contract_fields_compares_each_field_once(spark):
    hits = spark.createDataFrame([(f"c{i}", "svc", "given", "wanted") for i in range(3)], "call_id string, service string, dto string, expected string")
    used = spark.createDataFrame([("wanted", "Name", "string", False)] * 5, "dto string, field string, type string, optional boolean")
    shown = spark.createDataFrame([("given", "name", "int")] * 7 + [("given", "name", "Guid")], "dto string, field string, type string")
    got = routes.contract_fields(hits, used, shown)
    assert sorted(map(tuple, got.collect())) == [(f"c{i}", "given", "Name", "casing") for i in range(3)]
