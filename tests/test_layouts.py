"""Stored layouts and exact medians: their rows, and what they read and shuffle."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from archgraph.operators import graph, indexed, median


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.range(4000).selectExpr("concat('s', id) as id", "concat(if(id % 9 = 0, 'getRing', 'other'), id) as name", "concat('Dir', id % 100, '/f', id % 7, '.ts') as file_path", "concat('svc', id % 3) as service", "'function' as kind", "id % 2 = 0 as is_exported")


@pytest.fixture(scope="module")
def index(spark, symbols, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    indexed.build_search_index(symbols, path, files=20)
    return path


@pytest.mark.parametrize("tests", [{}, {"query": "RING"}, {"query": "g9"}, {"query": "ring1", "service": "svc0"}, {"query": "nothing"}, {"file_path": "DIR4"}, {"file_path": "dir77/f3", "query": "r"}, {"file_path": "é"}, {"kind": "class"}, {"is_exported": False, "file_path": "Dir1/"}, {"query": "(%_"}])
def test_search_finds_what_a_scan_finds(spark, symbols, index, tests):
    want = symbols
    if q := tests.get("query"):
        want = want.filter(F.contains(F.lower("name"), F.lit(q.lower())))
    if p := tests.get("file_path"):
        want = want.filter(F.startswith(F.lower("file_path"), F.lit(p.lower())))
    for c in ("service", "kind", "is_exported"):
        if c in tests:
            want = want.filter(F.col(c) == F.lit(tests[c]))
    assert rows(indexed.find_symbols(spark, index, **tests).select("id")) == rows(want.select("id"))


def test_a_prefix_is_a_pushed_range_that_reads_few_files(spark, index):
    got = indexed.find_symbols(spark, index, file_path="Dir77/")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(path_low,dir77/\)[^\]]*LessThan\(path_low", plan(got))
    executed = got._jdf.queryExecution()
    assert executed.toRdd().count() == 40
    scan = executed.executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 1000  # of 4000 rows in 20 files


def test_a_name_is_looked_up_by_its_postings(spark, index):
    got = indexed.find_symbols(spark, index, query="getring")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(gram,", plan(got))


def test_joins_on_buckets_shuffle_no_symbols(spark, symbols):
    r = random.Random(1)
    edges = spark.createDataFrame([(f"s{r.randrange(4000)}", f"s{r.randrange(4100)}", "calls") for _ in range(3000)], "source string, target string, kind string")
    t = indexed.GraphTables(symbols, edges)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ends = graph.edge_endpoints(t.by_source, t.symbols)
        assert rows(ends) == rows(graph.edge_endpoints(edges, symbols))
        assert len(re.findall(r"Exchange hashpartitioning\(target", plan(ends).split("Initial Plan")[-1])) == 1 and plan(ends).split("Initial Plan")[-1].count("Exchange") == 1
        assert "Exchange" not in plan(t.in_degree())
        assert rows(t.in_degree()) == rows(graph.in_degree(edges))
        near = t.neighbours("s7")
        assert rows(near) == rows(graph.callers(edges, symbols, "s7"))
        assert "SelectedBucketsCount: 1 out of" in plan(near)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        t.drop()


def test_medians_of_hot_and_small_groups(spark):
    r = random.Random(2)
    data = [("hot", r.choice([r.uniform(-1e6, 1e6), r.gauss(0, 1), 5.0])) for _ in range(5000)] + [("ties", 3.0)] * 700 + [("wide", 10.0 ** r.randrange(-300, 300)) for _ in range(600)]
    data += [("even", float(i)) for i in range(600)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("none", None), ("hot", None), ("far", 1e308), ("far", -1e308)] + [("far", float(i)) for i in range(601)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    want = {}
    for k, v in data:
        want.setdefault(k, []).append(v)
    for small in (100, 10_000):
        got = {x["k"]: (x["median"], x["n"]) for x in median.exact_median(df, ["k"], "v", small=small).collect()}
        assert got == {k: (statistics.median([x for x in v if x is not None]) if any(x is not None for x in v) else None, len(v)) for k, v in want.items()}


def test_medians_with_nan_two_keys_and_nothing(spark):
    df = spark.createDataFrame([(1, None, math.nan)] * 30 + [(1, None, float(i)) for i in range(40)] + [(2, "x", math.nan)] * 9 + [(2, "x", 1.0)] * 3, "a int, b string, v double")
    for small in (5, 1000):
        got = {(x["a"], x["b"]): (x["median"], x["n"]) for x in median.exact_median(df, ["a", "b"], "v", small).collect()}
        assert got[1, None] == (34.5, 70) and math.isnan(got[2, "x"][0])
    assert median.exact_median(df.limit(0), ["a"], "v").collect() == []
    ints = spark.range(1001).selectExpr("id % 2 as k", "id as v")
    assert rows(median.exact_median(ints, ["k"], "v", 10)) == [(0, 500.0, 501), (1, 500.0, 500)]


def test_no_plan_of_a_large_group_holds_its_values(spark):
    df = spark.range(20_000).selectExpr("'k' as k", "cast(id * 7919 % 10007 as double) as v")
    got = median.exact_median(df, ["k"], "v", small=100)
    assert got.collect()[0]["median"] == statistics.median([i * 7919 % 10007 for i in range(20_000)])
