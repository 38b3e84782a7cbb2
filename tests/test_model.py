"""Relations take all rows of their tables."""

import re

from archgraph.operators import graph
from archgraph.plans import model
from archgraph.plans.model import RELATIONS, Model

SF = "/root/testdata/sf0.001"


def test_relations_take_every_row(spark):
    m = Model(spark, SF)
    pairs = m.lineitem.filter("l_linenumber = 1").selectExpr("l_orderkey", "l_partkey a").join(m.lineitem.filter("l_linenumber > 1").selectExpr("l_orderkey", "l_partkey b", "l_returnflag || l_linestatus k"), "l_orderkey")
    kind = "case k when 'AF' then 1 when 'RF' then 2 when 'NO' then 3 when 'NF' then 4 when 'AO' then 5 else 6 end"
    keys = [r["sym_key"] for r in m.symbols.select("sym_key").collect()]
    assert m.edges.count() == pairs.filter(pairs["a"].isin(keys) & pairs["b"].isin(keys)).selectExpr("a", "b", kind).distinct().count()
    assert m.task_refs.count() == m.lineitem.filter(m.lineitem["l_partkey"].isin(keys)).count()
    assert m.fields_used.count() == m.customer.count()
    assert m.fields_given.count() == m.customer.count()


def test_given_fields_meet_by_equality(spark):
    m = Model(spark, SF)
    assert "NestedLoopJoin" not in m.fields_given._jdf.queryExecution().executedPlan().toString()
    text = spark.sql(RELATIONS["fields_given"], supplier=m.supplier, customer=m.customer)
    assert sorted(map(tuple, m.fields_given.collect())) == sorted(map(tuple, text.collect()))


def test_given_fields_without_suppliers(spark):
    m = Model(spark, SF)
    m._held["supplier"] = m.supplier.limit(0)
    assert m.fields_given.count() == 0


def test_edges_are_dealt_out_before_repeats_go(spark):
    m = Model(spark, SF)
    plan = m.edges._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.index("Aggregate") < plan.index("RepartitionByExpression")
    text = spark.sql(RELATIONS["edges"], lineitem=m.lineitem, symbols=m.symbols)
    assert m.edges.count() == text.count() and m.edges.exceptAll(text).isEmpty()


def test_every_join_of_edges_is_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(model, "tasks_for", lambda *_: 37)
    m = Model(spark, SF)
    ends = graph.edge_endpoints(m.edges, m.symbols, m.edge_tasks)
    blocks = graph.block_edges(m.edges, m.symbols.select("id", "file_path"), m.prefixes, m.edge_tasks)
    pairs = graph.coupling(m.edges, m.symbols, 5, m.edge_tasks)
    for df in (ends, blocks, pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\((?:l_orderkey|l_partkey|sym_key|source|id|target|file_path#\d+, target)#\d+L?, (\d+)\)", plan)
        assert len(dealt) >= 9 and set(dealt) == {"37"}
        # what is joined by the ids of symbols is sorted, whatever its size is taken for
        assert not re.search(r"BroadcastHashJoin \[(source|target|l_partkey|id)#", plan)
    few = Model(spark, SF)
    plain = few.spark.sql(RELATIONS["edges"], lineitem=few.lineitem, symbols=few.symbols)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, graph.coupling(plain, few.symbols, 5).collect()))
    assert ends.exceptAll(graph.edge_endpoints(plain, few.symbols)).isEmpty() and ends.count() == plain.count()
