"""Queries of the architecture operators over the test tables, each with its DuckDB SQL.

Names start with the ids of the operators in the inventory. ``add`` registers a query with SQL
over the relations of :mod:`archgraph.plans.model`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.functions import paths, types
from archgraph.functions import text as texts
from archgraph.operators import changes, containment, delivery, drift, graph, indexed, median, prefix, propose, records, report, review, routes, telemetry
from archgraph.plans import state
from archgraph.plans.model import Model, sql
from archgraph.shared import settle, shared_dir
from archgraph.sources import declared, documents, edges, extract, sinks
from archgraph.streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, run: Callable[[Model], DataFrame], select: str | None = None, *more: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Model(spark, sf_dir))
    if select:
        ORACLE_SQL[name] = sql(select, *more)


_OWNER = "owner AS (SELECT path, block_id FROM (SELECT f.path, p.block_id, row_number() OVER (PARTITION BY f.path ORDER BY length(p.prefix) DESC, p.block_id) AS r FROM (SELECT DISTINCT file_path AS path FROM symbols) f JOIN prefixes p ON starts_with(f.path, p.prefix)) WHERE r = 1)"
_BLOCK_EDGES = "be AS (SELECT e.source, e.target, e.kind, s.file_path AS source_file, t.file_path AS target_file, so.block_id AS source_block, tb.block_id AS target_block FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target JOIN owner so ON so.path = s.file_path JOIN owner tb ON tb.path = t.file_path)"
_IGNORED = ["promo/Brand#1", "promo/Brand#2/f3"]


def _ignored(m: Model) -> DataFrame:
    return m.spark.createDataFrame([(p,) for p in _IGNORED], "prefix string")


def _block_edges(m: Model) -> DataFrame:
    return graph.block_edges(m.edges, m.symbols, m.prefixes, m.edge_tasks)


# C: filters
add("c1_point_lookup", lambda m: m.symbols.filter("sym_key = 1").select("id", "kind"), "SELECT id, kind FROM symbols WHERE sym_key = 1")
add("c2_search", lambda m: changes.search(m.symbols, query="RING", service="svc1", is_exported=True, limit=50).select("id", "name", "kind"), "SELECT id, name, kind FROM symbols WHERE lower(name) LIKE '%ring%' AND service = 'svc1' AND is_exported ORDER BY name, id LIMIT 50")
add("c4_prefix_filter", lambda m: changes.search(m.symbols, file_path="ECONOMY/brand#1", limit=200).select("id", "name"), "SELECT id, name FROM symbols WHERE starts_with(lower(file_path), 'economy/brand#1') ORDER BY name, id LIMIT 200")
add("c5_block_members", lambda m: prefix.within_prefixes(m.symbols, m.prefixes.filter("block_id like '%-brand1'"), path="file_path", fold=True).select("id"), "SELECT id FROM symbols s WHERE EXISTS (SELECT 1 FROM prefixes p WHERE p.block_id LIKE '%-brand1' AND starts_with(lower(s.file_path), lower(p.prefix)))")
add("c6_status_sets", lambda m: m.tasks.filter(~F.col("status").isin(*delivery.DONE)).select("id", "status"), "SELECT id, status FROM tasks WHERE status NOT IN ('done', 'cancelled')")
add("c11_activity_filter", lambda m: telemetry.select(m.activity, since="2024-01-05", until="2024-01-20 12:00:00", model="m2", agent_role="r1").select("id", "tool_name"), "SELECT id, tool_name FROM activity WHERE recorded_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00' AND model = 'm2' AND agent_role = 'r1'")
add("c12_route_filter", lambda m: routes.select_routes(m.api_routes, service="svc0", prefix="/FR").select("route_path", "kind"), "SELECT route_path, kind FROM api_routes WHERE service = 'svc0' AND starts_with(lower(route_path), '/fr')")
add("c13_component_filter", lambda m: graph.select_components(m.components, prefix="LARGE/", client_only=True).select("id"), "SELECT id FROM components WHERE is_client AND starts_with(lower(file_path), 'large/')")
add("c14_scenarios", lambda m: delivery.scenarios(m.scenarios, category="security", priority="must").select("id", "status"), "SELECT id, status FROM scenarios WHERE category = 'security' AND priority = 'must'")
add("c15_open_phases", lambda m: delivery.select_phases(m.phases).select("id", "phase_number"), "SELECT id, phase_number FROM phases WHERE status <> 'complete'")
add("c17_relevant", lambda m: delivery.relevant(m.scenarios, "performance").select("id"), "SELECT id FROM scenarios WHERE category = 'performance'")
add("c18_role_focus", lambda m: delivery.in_focus(m.scenarios, ["security", "reliability"]).select("id"), "SELECT id FROM scenarios WHERE category IN ('security', 'reliability') OR priority = 'must'")
_NAMED = "named AS (SELECT path || CASE length(path) % 7 WHEN 0 THEN '.env' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '/secret.js' WHEN 4 THEN '.spec.jsx' WHEN 5 THEN '.key' ELSE '' END AS path FROM files_new)"


def _named(m: Model) -> DataFrame:
    return m.files_new.selectExpr("path || CASE length(path) % 7 WHEN 0 THEN '.env' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '/secret.js' WHEN 4 THEN '.spec.jsx' WHEN 5 THEN '.key' ELSE '' END AS path")


add("c19_sensitive_names", lambda m: changes.sensitive_files(_named(m)), "SELECT path FROM named WHERE regexp_matches(path, '\\.env|secrets?\\.|credentials|\\.pem$|\\.key$')", _NAMED)
add("c20_code_or_test", lambda m: _named(m).select("path", changes.file_class(F.col("path")).alias("class")), "SELECT path, CASE WHEN regexp_matches(path, '\\.(test|spec)\\.(ts|tsx|js|jsx)$') THEN 'test' WHEN regexp_matches(path, '\\.(ts|tsx|js|jsx)$') THEN 'code' ELSE 'other' END AS class FROM named", _NAMED)
add("c22_testable", lambda m: delivery.testable(m.scenarios, m.scenarios.filter("has_tests").selectExpr("id as scenario_id")).select("id"), "SELECT id FROM scenarios WHERE verification IN ('automatic', 'semi-automatic') AND has_tests")

# D: joins
add("d1_edge_endpoints", lambda m: graph.edge_endpoints(m.edges, m.symbols, m.edge_tasks).select("source", "target", "kind", "source_file", "target_file"), "SELECT e.source, e.target, e.kind, s.file_path AS source_file, t.file_path AS target_file FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target")
add("d2_longest_prefix", lambda m: prefix.longest_prefix_join(m.files, m.prefixes), "SELECT path, block_id FROM owner", _OWNER)
add("d4_all_prefixes", lambda m: prefix.prefix_pairs(m.files, m.prefixes).select("path", "block_id"), "SELECT f.path, p.block_id FROM (SELECT DISTINCT file_path AS path FROM symbols) f JOIN prefixes p ON starts_with(f.path, p.prefix)")
add("d7_component_edges", lambda m: graph.component_edges(m.edges, m.components), "SELECT * FROM edges WHERE kind = 'renders' AND source IN (SELECT id FROM components) AND target IN (SELECT id FROM components)")
add("d9_without_prefix", lambda m: prefix.without_prefix(m.files, m.prefixes), "SELECT DISTINCT file_path AS path FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(s.file_path, p.prefix))")
add("d10_unused_prefixes", lambda m: prefix.unused_prefixes(m.prefixes, m.files, fold=True).select("block_id", "prefix"), "SELECT block_id, prefix FROM prefixes p WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE starts_with(lower(s.file_path), lower(p.prefix)))")
add("d11_empty_phases", lambda m: delivery.phases_without_tasks(m.phases, m.tasks).select("id"), "SELECT id FROM phases p WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.phase_id = p.id)")
add("d12_orphans", lambda m: delivery.orphans(m.tasks, m.blocks).select("id", "block_id"), "SELECT id, block_id FROM tasks WHERE block_id NOT IN (SELECT id FROM blocks)")
_SEGS = "segs AS (SELECT route_id, route_path, list_filter(string_split(route_path, '/'), lambda x: x <> '') AS rs FROM api_routes), urls AS (SELECT call_id, url, method, service, list_filter(string_split(regexp_extract(url, '^[^?#]*'), '/'), lambda x: x <> '') AS us FROM api_calls), served AS (SELECT s.route_id, s.route_path, u.call_id, u.url, u.method, u.service FROM segs s JOIN urls u ON (NOT contains(s.route_path, '...') AND len(rs) = len(us) OR contains(s.route_path, '...') AND len(us) >= len(rs) - 1) AND len(list_filter(range(1, len(rs) + 1), lambda i: NOT (contains(rs[i], '...') OR regexp_matches(rs[i], '^[:*]|^\\{.*\\}$|^<.*>$|^\\[.*\\]$') OR regexp_matches(coalesce(us[i], ''), '^[:*]|^\\{.*\\}$|^<.*>$|^\\[.*\\]$') OR lower(rs[i]) = lower(us[i])))) = 0)"
add("d13_route_match", lambda m: routes.route_match_join(m.api_routes.select("route_id", "route_path"), m.api_calls.select("call_id", "url")).select("route_id", "call_id"), "SELECT route_id, call_id FROM served WHERE route_id IN (SELECT route_id FROM api_routes) AND call_id IN (SELECT call_id FROM api_calls)", _SEGS)


_CATEGORY = "CASE x WHEN 'string' THEN 'string' WHEN 'Guid' THEN 'string' WHEN 'number' THEN 'number' WHEN 'int' THEN 'number' WHEN 'boolean' THEN 'boolean' WHEN 'bool' THEN 'boolean' END"
add("d14_field_shape", lambda m: routes.field_diff(m.fields_used, m.fields_given), """SELECT dto, field, type, problem FROM (
    SELECT dto, field, type, unnest(CASE WHEN got IS NULL THEN CASE WHEN optional THEN [] ELSE ['missing'] END ELSE list_filter([CASE WHEN got <> field THEN 'casing' END, CASE WHEN tc <> gc THEN 'type' END], lambda z: z IS NOT NULL) END) AS problem FROM (
    SELECT u.*, coalesce(e.g_field, l.g_field) AS got, (SELECT """ + _CATEGORY + """ FROM (SELECT u.type AS x)) AS tc, (SELECT """ + _CATEGORY + """ FROM (SELECT coalesce(e.g_type, l.g_type) AS x)) AS gc
    FROM (SELECT DISTINCT * FROM fields_used) u LEFT JOIN one e ON e.dto = u.dto AND e.g_field = u.field
    LEFT JOIN (SELECT dto, lower(g_field) AS low, g_field, g_type FROM one QUALIFY row_number() OVER (PARTITION BY dto, lower(g_field) ORDER BY g_field) = 1) l ON l.dto = u.dto AND l.low = lower(u.field)))""",
    "one AS (SELECT dto, field AS g_field, min(type) AS g_type FROM fields_given GROUP BY dto, field)")
add("d16_cross_block_consumers", lambda m: graph.cross_block_exports(m.edges, m.symbols, m.prefixes).select("id", "block_id", F.array_join("consumers", ",").alias("consumers")), "SELECT target AS id, target_block AS block_id, string_agg(DISTINCT source_block, ',' ORDER BY source_block) AS consumers FROM be WHERE source_block <> target_block AND target IN (SELECT id FROM symbols WHERE is_exported) GROUP BY 1, 2", _OWNER, _BLOCK_EDGES)
add("d17_callers", lambda m: graph.callers(m.edges, m.symbols, m.symbols.filter("sym_key = 20").select("id").scalar()).select("direction", "id", "edge"), "SELECT 'caller' AS direction, source AS id, kind AS edge FROM edges WHERE target = (SELECT id FROM symbols WHERE sym_key = 20) UNION ALL SELECT 'callee', target, kind FROM edges WHERE source = (SELECT id FROM symbols WHERE sym_key = 20)")
add("d20_phase_progress", lambda m: delivery.phase_progress(m.phases, m.tasks).select("id", "total", "done", "cancelled", "percent"), "SELECT p.id, count(t.id) AS total, count(t.id) FILTER (t.status = 'done') AS done, count(t.id) FILTER (t.status = 'cancelled') AS cancelled, CAST(coalesce(round(100.0 * count(t.id) FILTER (t.status = 'done') / nullif(count(t.id) FILTER (t.status <> 'cancelled'), 0)), 0) AS INT) AS percent FROM phases p LEFT JOIN tasks t ON t.phase_id = p.id GROUP BY p.id")
add("d21_children", lambda m: m.blocks.alias("c").join(m.blocks.alias("p"), F.col("c.parent_id") == F.col("p.id")).select(F.col("p.id").alias("parent"), F.col("c.id").alias("child")), "SELECT p.id AS parent, c.id AS child FROM blocks c JOIN blocks p ON c.parent_id = p.id")


def _tables(m: Model) -> indexed.GraphTables:
    return indexed.GraphTables(m.symbols, m.edges, m.edge_tasks)


def _bucketed(m: Model) -> DataFrame:
    t = _tables(m)
    return graph.edge_endpoints(t.by_source, t.symbols).select("source", "target", "kind", "source_file", "target_file")


add("d1_bucketed_endpoints", _bucketed, "SELECT e.source, e.target, e.kind, s.file_path AS source_file, t.file_path AS target_file FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target")
add("e19_bucketed_in_degree", lambda m: _tables(m).in_degree(), "SELECT target AS id, count(*) AS n FROM edges GROUP BY 1")


def _found(m: Model, **tests) -> DataFrame:
    path = f"{shared_dir(m.spark)}/archgraph/search-{uuid.uuid4().hex}"
    indexed.build_search_index(m.symbols, path)
    return indexed.find_symbols(m.spark, path, **tests).select("id", "name", "kind")


add("c2_indexed_search", lambda m: _found(m, query="RING", service="svc1", is_exported=True), "SELECT id, name, kind FROM symbols WHERE contains(lower(name), 'ring') AND service = 'svc1' AND is_exported")
add("c4_indexed_prefix", lambda m: _found(m, file_path="ECONOMY/brand#1"), "SELECT id, name, kind FROM symbols WHERE starts_with(lower(file_path), 'economy/brand#1')")

# E: aggregations
add("e1_totals", lambda m: telemetry.totals(m.activity), "SELECT count(*) AS n, coalesce(sum(total_tokens), 0)::BIGINT AS tokens, round(coalesce(sum(cost_usd), 0), 4) AS cost, min(recorded_at) AS first_at, max(recorded_at) AS last_at FROM activity")
for _by, _key in (("model", "coalesce(model, '(none)')"), ("task", "coalesce(task_id, '(none)')"), ("phase", "coalesce(phase_id, '(none)')"), ("tool", "tool_name"), ("day", "strftime(recorded_at, '%Y-%m-%d')")):
    add(f"e3_by_{_by}", lambda m, by=_by: telemetry.grouped(m.activity, by), f"SELECT {_key} AS key, count(*) AS n, sum(total_tokens)::BIGINT AS tokens, round(avg(duration_ms)) AS avg_ms, round(sum(cost_usd), 4) AS cost, min(recorded_at) AS first_at, max(recorded_at) AS last_at FROM activity GROUP BY 1")
add("e4_by_role", lambda m: telemetry.counts(m.activity, "agent_role"), "SELECT coalesce(agent_role, '(unknown)') AS key, count(*) AS n FROM activity GROUP BY 1")
add("e5_daily", lambda m: telemetry.daily(m.activity), "SELECT strftime(recorded_at, '%Y-%m-%d') AS day, count(*) AS n, round(sum(cost_usd), 4) AS cost FROM activity GROUP BY 1")
add("e8_task_status", lambda m: m.tasks.groupBy("status").agg(F.count("*").alias("n")), "SELECT status, count(*) AS n FROM tasks GROUP BY 1")
add("e9_pass_rate", lambda m: delivery.pass_rate(m.scenarios), "SELECT round(100.0 * count(*) FILTER (status = 'passing') / nullif(count(*) FILTER (status IN ('passing', 'failing', 'partial')), 0), 1) AS pass_rate FROM scenarios")
add("e11_verification", lambda m: m.scenarios.groupBy("verification", "status").agg(F.count("*").alias("n")), "SELECT verification, status, count(*) AS n FROM scenarios GROUP BY 1, 2")
add("e12_coupling", lambda m: graph.coupling(m.edges, m.symbols, 5, m.edge_tasks), "SELECT file_path, count(DISTINCT target) AS targets FROM edges e JOIN symbols s ON s.id = e.source GROUP BY 1 HAVING count(DISTINCT target) > 5")
add("e13_complexity", lambda m: graph.complexity(m.symbols, 2), "SELECT file_path, count(*) AS n_symbols FROM symbols GROUP BY 1 HAVING count(*) > 2")
add("e14_dashboard", lambda m: graph.dashboard(m.symbols, m.edges, m.activity), "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(DISTINCT file_path) FROM symbols) AS files, (SELECT count(DISTINCT service) FROM symbols) AS services, (SELECT count(*) FROM edges) AS edges, (SELECT max(recorded_at) FROM activity) AS last_at")
add("e15_kind_histogram", lambda m: graph.block_of_symbol(m.symbols, m.prefixes).join(m.symbols.select("id", "kind"), "id").groupBy("block_id", "kind").agg(F.count("*").alias("n")), "SELECT block_id, kind, count(*) AS n FROM symbols s JOIN owner o ON o.path = s.file_path GROUP BY 1, 2", _OWNER)
add("e16_directions", lambda m: graph.direction_counts(_block_edges(m)), "SELECT block_id, sum(i)::BIGINT AS internal, sum(o)::BIGINT AS outbound, sum(n)::BIGINT AS inbound FROM (SELECT source_block AS block_id, (source_block = target_block)::INT AS i, (source_block <> target_block)::INT AS o, 0 AS n FROM be UNION ALL SELECT target_block, 0, 0, 1 FROM be WHERE source_block <> target_block) GROUP BY 1", _OWNER, _BLOCK_EDGES)
add("e17_interfaces", lambda m: graph.derived_interfaces(_block_edges(m)).select("block_id", F.array_join("interfaces", ",").alias("interfaces")), "SELECT source_block AS block_id, string_agg(DISTINCT target_block, ',' ORDER BY target_block) AS interfaces FROM be WHERE source_block <> target_block GROUP BY 1", _OWNER, _BLOCK_EDGES)
add("e19_in_degree", lambda m: graph.in_degree(m.edges), "SELECT target AS id, count(*) AS n FROM edges GROUP BY 1")
add("e22_median", lambda m: m.activity.groupBy("tool_name").agg(F.median("duration_ms").alias("median"), F.count("*").alias("n")), "SELECT tool_name, median(duration_ms) AS median, count(*) AS n FROM activity GROUP BY 1")
add("e22_exact_median", lambda m: median.exact_median(m.activity, ["tool_name", "model"], "duration_ms", small=50), "SELECT tool_name, model, median(duration_ms) AS median, count(*) AS n FROM activity GROUP BY 1, 2")
add("e23_saving", lambda m: m.activity.select("id", F.when(F.col("input_tokens") > 0, F.round((F.col("input_tokens") - F.col("drift_count")) / F.col("input_tokens") * 100, 1)).alias("saving")), "SELECT id, CASE WHEN input_tokens > 0 THEN round((input_tokens - drift_count) / input_tokens * 100, 1) END AS saving FROM activity")
add("e26_next_number", lambda m: delivery.next_number(m.phases.filter("phase_number < 99")), "SELECT coalesce(max(phase_number) + 1, 0) AS next_number FROM phases WHERE phase_number < 99")

# F: ranks, sorts, pages
add("f3_top_symbols", lambda m: graph.top_symbols(m.edges, m.symbols, m.prefixes), "SELECT block_id, rank, id, n FROM (SELECT o.block_id, CAST(row_number() OVER (PARTITION BY o.block_id ORDER BY d.n DESC, s.name, s.id) AS INT) AS rank, s.id, d.n FROM symbols s JOIN owner o ON o.path = s.file_path JOIN (SELECT target, count(*) AS n FROM edges GROUP BY 1) d ON d.target = s.id WHERE s.is_exported) WHERE rank <= 5", _OWNER)
add("f4_latest_quality", lambda m: telemetry.latest_quality(m.activity), "SELECT model, recorded_at, drift_count FROM activity WHERE drift_count IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY recorded_at DESC, id DESC) = 1")
add("f6_recent", lambda m: telemetry.recent(m.activity, 50).select("id", "tool_name", "recorded_at"), "SELECT id, tool_name, recorded_at FROM activity ORDER BY recorded_at DESC, id DESC LIMIT 50")
add("f7_staleness", lambda m: delivery.staleness(m.blocks, F.lit("2024-02-01").cast("timestamp")), "SELECT id, CAST(date_diff('day', last_synced, DATE '2024-02-01') AS BIGINT) AS age FROM blocks")
add("f8_current_phase", lambda m: delivery.current_phase(m.phases).select("id"), "SELECT id FROM phases WHERE status IN ('in-progress', 'planned') ORDER BY status <> 'in-progress', phase_number LIMIT 1")
add("f9_next_phase", lambda m: delivery.next_phase(m.phases), "SELECT a.id, b.id AS next_id FROM phases a JOIN phases b ON b.phase_number = a.phase_number + 1 AND b.status = 'planned'")

# G: sets
_STATUS = "CASE WHEN o.content_hash IS NULL THEN 'added' WHEN n.content_hash IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'modified' ELSE 'unchanged' END"
add("g2_union_distinct", lambda m: m.decisions.filter("prefix like 'SMALL%'").unionByName(m.decisions.filter("status = 'accepted'")).dropDuplicates(["decision_id"]).select("decision_id"), "SELECT decision_id FROM decisions WHERE prefix LIKE 'SMALL%' UNION SELECT decision_id FROM decisions WHERE status = 'accepted'")
add("g4_changed_files", lambda m: changes.changed_files(m.files_old, m.files_new), f"SELECT coalesce(o.path, n.path) AS path, {_STATUS} AS change FROM files_old o FULL JOIN files_new n ON o.path = n.path")
add("g5_distinct", lambda m: m.symbols.select("service", "language").distinct(), "SELECT DISTINCT service, language FROM symbols")
add("g6_delete_scope", lambda m: changes.delete_scope(m.symbols, m.edges, m.symbols.filter("file_path like 'large/%'").select("file_path", "service", "language").distinct())[1], "SELECT * FROM edges WHERE source NOT IN (SELECT id FROM symbols WHERE file_path LIKE 'large/%') AND target NOT IN (SELECT id FROM symbols WHERE file_path LIKE 'large/%')")
add("g7_prune", lambda m: changes.prune_services(m.symbols, ["svc0", "svc2"]).select("id"), "SELECT id FROM symbols WHERE service IN ('svc0', 'svc2')")
add("g8_merge_changes", lambda m: changes.merge_changes(m.files_old.selectExpr("path", "'committed' as status"), m.files_new.selectExpr("path", "'uncommitted' as status")), "SELECT path, max(status) AS status FROM (SELECT path, 'committed' AS status FROM files_old UNION ALL SELECT path, 'uncommitted' FROM files_new) GROUP BY 1")

def _state(m: Model) -> state.ProjectState:
    """A first index of all files, then one of the files under large/, of whose symbols a third is no more and one is new for each that stays with an odd key. Only the newest version stays on disk."""
    s = state.ProjectState(m.spark, f"{shared_dir(m.spark)}/archgraph/state-{uuid.uuid4().hex}")
    m.store("edges")  # read for both indexes and for the scopes of each
    own = m.symbols.select(F.col("id").alias("source"), "service", "language")
    index = lambda symbols: (symbols, m.edges.join(own.join(symbols.select(F.col("id").alias("source")).hint("merge"), "source", "left_semi").hint("merge"), "source"), symbols.filter("kind in ('component', 'function', 'hook')").select("id", "service", "language", "is_client"))
    files = m.symbols.select("file_path", "service", "language").distinct()
    state.apply_index(s, files, *index(m.symbols))
    now = m.symbols.filter("file_path like 'large/%' and sym_key % 3 <> 0")
    state.apply_index(s, files.filter("file_path like 'large/%'"), *index(now.unionByName(now.filter("sym_key % 2 = 1").withColumn("id", F.concat("id", F.lit("2"))))))
    m.unstore("edges")
    s.vacuum()
    return s


_LEFT = "left_ids AS (SELECT id FROM symbols WHERE NOT (file_path LIKE 'large/%' AND sym_key % 3 = 0))"
_NOW = "now_symbols AS (SELECT * FROM symbols WHERE id IN (SELECT id FROM left_ids) UNION ALL SELECT * REPLACE (id || '2' AS id) FROM symbols WHERE file_path LIKE 'large/%' AND sym_key % 3 <> 0 AND sym_key % 2 = 1)"
add("a17_state_symbols", lambda m: _state(m).read("symbols").select("id", "service", "language", "kind"), "SELECT id, service, language, kind FROM now_symbols", _LEFT, _NOW)
add("a18_state_edges", lambda m: _state(m).read("edges").select("source", "target", "kind", "service"), "SELECT e.source, e.target, e.kind, s.service FROM edges e JOIN symbols s ON s.id = e.source WHERE e.source IN (SELECT id FROM left_ids) AND (e.target IN (SELECT id FROM left_ids) OR s.file_path LIKE 'large/%')", _LEFT)


def _deleted(m: Model) -> state.ProjectState:
    s = _state(m)
    state.delete_files(s, m.symbols.filter("file_path like 'small/%'").select("file_path", "service", "language").distinct())
    s.vacuum()
    return s


add("g6_state_components", lambda m: _deleted(m).read("components").select("id", "service", "is_client"), "SELECT id, service, is_client FROM now_symbols WHERE kind IN ('component', 'function', 'hook') AND file_path NOT LIKE 'small/%'", _LEFT, _NOW)


def _streamed(m: Model) -> DataFrame:
    """The old files as one micro-batch, the new ones and marks for those that are gone as the next, after a restart."""
    root = f"{shared_dir(m.spark)}/archgraph/changes-{uuid.uuid4().hex}"
    gone = m.files_old.join(m.files_new, "path", "left_anti").select("path", F.lit(None).cast("string").alias("content_hash"))
    for n, files in ((1, m.files_old), (2, m.files_new.unionByName(gone))):
        files.withColumn("batch", F.lit(n).cast("long")).write.mode("append").parquet(f"{root}/in")
        stream = activity.read_activity(m.spark, f"{root}/in", "path string, content_hash string, batch long")
        activity.changed_files(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return m.spark.read.parquet(f"{root}/out").filter("batch = 2").select("path", "change")


add("h29_streamed_changes", _streamed, f"SELECT coalesce(o.path, n.path) AS path, {_STATUS} AS change FROM files_old o FULL JOIN files_new n ON o.path = n.path")
_REFS = "refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE l_linenumber % 3 WHEN 0 THEN 'fn' ELSE 'fn' || (l_partkey % 50) END AS name, s.file_path, CASE WHEN l_linenumber % 2 = 0 THEN s.kind END AS scope FROM lineitem l JOIN symbols s ON s.sym_key = l_suppkey)"
_DECLARED = "declared AS (SELECT id, CASE WHEN sym_key % 3 = 0 THEN 'fn' ELSE 'fn' || (sym_key % 50) END AS name, file_path, CASE WHEN sym_key % 4 > 0 THEN kind END AS scope FROM symbols)"


def _part_of(m: Model, text: str, **frames: DataFrame) -> DataFrame:
    body = text[text.index("(") + 1 : -1].replace("{", "{{").replace("}", "}}")
    for name in frames:
        body = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", body)
    return m.spark.sql(body, **frames)


_TIERED = "keyed AS (SELECT ref_id, name, file_path, coalesce(scope, '') AS scope FROM refs), held AS (SELECT id, name, file_path, coalesce(scope, '') AS scope FROM declared), per AS (SELECT k.*, (SELECT count(*) FROM held h WHERE h.name = k.name AND h.file_path = k.file_path AND h.scope = k.scope) AS a, (SELECT count(*) FROM held h WHERE h.name = k.name AND h.file_path = k.file_path) AS b, (SELECT count(*) FROM held h WHERE h.name = k.name) AS c FROM keyed k)"
add("b13_resolve", lambda m: changes.resolve_tiers(_part_of(m, _REFS, lineitem=m.lineitem, symbols=m.symbols), _part_of(m, _DECLARED, symbols=m.symbols)).select("ref_id", "tier", "n"), "SELECT ref_id, CASE WHEN a > 0 THEN 'scope' WHEN b > 0 THEN 'file' ELSE 'any' END AS tier, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END AS n FROM per WHERE c > 0", _REFS, _DECLARED, _TIERED)
add("b13_near_symbols", lambda m: changes.expand_resolved(changes.resolve_tiers(_part_of(m, _REFS, lineitem=m.lineitem, symbols=m.symbols), _part_of(m, _DECLARED, symbols=m.symbols)).filter("tier <> 'any'"), _part_of(m, _DECLARED, symbols=m.symbols)), "SELECT ref_id, id FROM per JOIN held ON held.name = per.name AND held.file_path = per.file_path AND (a = 0 OR held.scope = per.scope) WHERE b > 0", _REFS, _DECLARED, _TIERED)

# H: analyses
_FINDING = "SELECT '{}' AS kind, '{}' AS severity, {} AS affected_block, {} AS affected_file, {} AS detail FROM "
_VIOLATIONS = "violations AS (SELECT u.call_id, u.url, u.method, CASE WHEN count(s.route_id) = 0 THEN 'unknown endpoint' ELSE 'method not allowed' END AS problem FROM api_calls u LEFT JOIN served s ON s.call_id = u.call_id GROUP BY 1, 2, 3 HAVING NOT coalesce(bool_or(NOT EXISTS (SELECT 1 FROM route_methods r WHERE r.route_id = s.route_id) OR EXISTS (SELECT 1 FROM route_methods r WHERE r.route_id = s.route_id AND upper(r.method) = upper(u.method))) FILTER (s.route_id IS NOT NULL), false))"
_H = {
    "h1": _FINDING.format("undocumented_module", "warning", "NULL::VARCHAR", "path", "NULL::VARCHAR") + "(SELECT DISTINCT file_path AS path FROM symbols) f WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(f.path, p.prefix)) AND NOT starts_with(path, 'promo/Brand#1') AND NOT starts_with(path, 'promo/Brand#2/f3')",
    "h2": _FINDING.format("missing_module", "warning", "block_id", "prefix", "NULL::VARCHAR") + "prefixes p WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE starts_with(lower(s.file_path), lower(p.prefix)))",
    "h3": _FINDING.format("dependency_violation", "error", "source_block", "min(source_file)", "target_block") + "be WHERE kind IN ('imports', 'calls', 'renders') AND source_block <> target_block AND NOT EXISTS (SELECT 1 FROM interfaces i WHERE i.block_id = be.source_block AND i.target = be.target_block) GROUP BY source_block, target_block",
    "h4": _FINDING.format("unlinked_test", "warning", "NULL::VARCHAR", "prefix", "scenario_id") + "tests t WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE starts_with(s.file_path, t.prefix))",
    "h5": _FINDING.format("stale_adr", "info", "NULL::VARCHAR", "prefix", "decision_id") + "decisions d WHERE status <> 'superseded' AND NOT EXISTS (SELECT 1 FROM symbols s WHERE starts_with(lower(s.file_path), lower(d.prefix)))",
    "h6": _FINDING.format("new_dependency", "info", "NULL::VARCHAR", "NULL::VARCHAR", "name") + "(SELECT DISTINCT name FROM packages WHERE source IN ('npm', 'nuget') AND name <> 'red.gear') p WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE status <> 'superseded' AND (contains(lower(text), lower(name)) OR length(regexp_extract(lower(name), '^[^./]*')) > 3 AND contains(lower(text), regexp_extract(lower(name), '^[^./]*'))))",
}
_RUN = {
    "h1": lambda m: drift.undocumented(m.symbols, m.prefixes, _ignored(m)),
    "h2": lambda m: drift.missing(m.symbols, m.prefixes),
    "h3": lambda m: drift.dependency_violations(m.symbols, m.edges, m.prefixes, m.interfaces),
    "h4": lambda m: drift.unlinked_tests(m.symbols, m.tests),
    "h5": lambda m: drift.stale_decisions(m.symbols, m.decisions),
    "h6": lambda m: drift.unmentioned_packages(m.packages, m.decisions, ["red.gear"]),
}
_NAMES = {"h1": "undocumented", "h2": "missing", "h3": "dependency_violations", "h4": "unlinked_tests", "h5": "stale_decisions", "h6": "new_dependencies"}
for _h, _run in _RUN.items():
    add(f"{_h}_{_NAMES[_h]}", _run, _H[_h], *((_OWNER, _BLOCK_EDGES) if _h == "h3" else ()))


def _contracts(m: Model) -> DataFrame:
    return drift.contract_findings(routes.endpoint_violations(m.api_routes, m.api_calls, m.route_methods), m.api_calls)


def _all(m: Model) -> DataFrame:
    """Findings of all detectors, made and written once for each model."""
    if "findings" not in m.__dict__:
        m.findings = settle(drift.detect(m.symbols, m.edges, m.prefixes, m.interfaces, ignored=_ignored(m), tests=m.tests, decisions=m.decisions, packages=m.packages, trivial=["red.gear"], contracts=_contracts(m)), "findings")
    return m.findings


_ALL_OF = (_OWNER, _BLOCK_EDGES, _SEGS, _VIOLATIONS, "found AS (" + " UNION ALL ".join(f"({q})" for q in [*_H.values(), _FINDING.format("contract_violation", "warning", "NULL::VARCHAR", "file_path", "call_id || ': ' || problem") + "violations JOIN api_calls USING (call_id)"]) + ")")
add("g1_all_findings", _all, "SELECT * FROM found", *_ALL_OF)
add("e6_severity_counts", lambda m: drift.severity_counts(_all(m)), "SELECT severity, count(kind) AS n FROM (SELECT unnest(['info', 'warning', 'error']) AS severity) s LEFT JOIN found USING (severity) GROUP BY 1", *_ALL_OF)
add("e21_by_kind", lambda m: _all(m).groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM found GROUP BY 1", *_ALL_OF)
add("a25_threshold", lambda m: drift.at_least(_all(m), "warning").groupBy("severity").agg(F.count("*").alias("n")), "SELECT severity, count(*) AS n FROM found WHERE severity IN ('warning', 'error') GROUP BY 1", *_ALL_OF)
add("c21_scope", lambda m: drift.scope_counts(_all(m), m.files.filter("path like '%f1.ts'")), "SELECT count(*) FILTER (affected_file LIKE '%f1.ts') AS kept, count(*) FILTER (affected_file NOT LIKE '%f1.ts') AS other_files, count(*) FILTER (affected_file IS NULL) AS non_file FROM found", *_ALL_OF)
add("h7_endpoint_violations", lambda m: routes.endpoint_violations(m.api_routes, m.api_calls, m.route_methods), "SELECT * FROM violations", _SEGS, _VIOLATIONS)
add("h8_contracts", lambda m: routes.contracts(m.api_routes, m.api_calls, m.route_methods).select("route_id", "route_path", "producer", F.array_join("consumers", ",").alias("consumers")), "SELECT a.route_id, a.route_path, a.service AS producer, coalesce(string_agg(DISTINCT s.service, ',' ORDER BY s.service) FILTER (NOT EXISTS (SELECT 1 FROM route_methods r WHERE r.route_id = a.route_id) OR EXISTS (SELECT 1 FROM route_methods r WHERE r.route_id = a.route_id AND upper(r.method) = upper(s.method))), '') AS consumers FROM api_routes a LEFT JOIN served s ON s.route_id = a.route_id GROUP BY 1, 2, 3", _SEGS)
add("h9_traversal", lambda m: graph.traverse(m.edges, m.symbols, "large/Brand#1/", 3), "SELECT b AS file, CAST(min(d) AS INT) AS depth FROM walk GROUP BY 1",
    "fe AS (SELECT DISTINCT s.file_path AS a, t.file_path AS b, regexp_replace(s.file_path, '/[^/]+$', '') AS dir FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target WHERE s.file_path <> t.file_path)",
    "walk(b, d) AS (SELECT DISTINCT b, 1 FROM fe WHERE starts_with(lower(a), 'large/brand#1/') UNION SELECT fe.b, walk.d + 1 FROM walk JOIN fe ON fe.dir = regexp_replace(walk.b, '/[^/]+$', '') WHERE walk.d < 3)")
add("h9_all_blocks", lambda m: graph.traverse_all(m.edges, m.symbols, m.prefixes.select(F.col("block_id").alias("start"), "prefix"), 3), "SELECT start, b AS file, CAST(min(d) AS INT) AS depth FROM walk GROUP BY 1, 2",
    "fe AS (SELECT DISTINCT s.file_path AS a, t.file_path AS b, regexp_replace(s.file_path, '/[^/]+$', '') AS dir FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target WHERE s.file_path <> t.file_path)",
    "walk(start, b, d) AS (SELECT DISTINCT p.block_id, b, 1 FROM fe JOIN prefixes p ON starts_with(lower(a), lower(p.prefix)) UNION SELECT walk.start, fe.b, walk.d + 1 FROM walk JOIN fe ON fe.dir = regexp_replace(walk.b, '/[^/]+$', '') WHERE walk.d < 3)")
add("h12_boundaries", lambda m: graph.boundaries(m.edges, m.components), "SELECT source, target, CASE WHEN t THEN 'valid' ELSE 'violation' END AS verdict FROM (SELECT e.source, e.target, coalesce(a.is_client, false) AS s, coalesce(b.is_client, false) AS t FROM edges e LEFT JOIN components a ON a.id = e.source LEFT JOIN components b ON b.id = e.target WHERE e.kind = 'renders' AND (a.id IS NOT NULL OR b.id IS NOT NULL)) WHERE s <> t")


def _inferred(m: Model) -> DataFrame:
    return delivery.infer(m.tasks, m.prefixes, m.files, m.task_refs, m.task_scenarios, m.scenarios)


_INFER = (
    "cover AS (SELECT block_id, count(*) FILTER (EXISTS (SELECT 1 FROM symbols s WHERE starts_with(lower(s.file_path), lower(p.prefix)))) >= ceil(count(*) / 2) AS covered FROM prefixes p GROUP BY 1)",
    "refs AS (SELECT task_id, count(*) AS n, count(*) FILTER (path IN (SELECT file_path FROM symbols)) AS t FROM task_refs GROUP BY 1)",
    "pass AS (SELECT task_id, bool_and(s.status = 'passing') AS ok FROM task_scenarios ts JOIN scenarios s ON s.id = ts.scenario_id GROUP BY 1)",
    "ruled AS (SELECT t.id, t.status, r.n, r.t, CASE WHEN c.covered AND t.status = 'todo' THEN 1 WHEN r.n > 0 AND r.t = r.n THEN 2 WHEN r.t > 0 AND t.status = 'todo' THEN 2 WHEN p.ok THEN 3 END AS rule FROM tasks t LEFT JOIN cover c USING (block_id) LEFT JOIN refs r ON r.task_id = t.id LEFT JOIN pass p ON p.task_id = t.id WHERE t.status NOT IN ('done', 'cancelled'))",
)
add("h15_task_inference", _inferred, "SELECT id, status, CASE WHEN rule = 1 THEN 'in-progress' WHEN rule = 2 AND t = n THEN 'done' WHEN rule = 2 THEN 'in-progress' ELSE 'done' END AS inferred, rule FROM ruled WHERE rule IS NOT NULL", *_INFER)
add("h16_apply_inferred", lambda m: delivery.apply_inferred(m.tasks.withColumn("completed_at", F.lit(None).cast("timestamp")), _inferred(m), F.lit("2024-02-01").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"), F.count("completed_at").alias("completed")), "SELECT status, count(*) AS n, sum(c)::BIGINT AS completed FROM (SELECT coalesce(i.inferred, t.status) AS status, (i.inferred IS NOT DISTINCT FROM 'done')::INT AS c FROM tasks t LEFT JOIN (SELECT id, CASE WHEN rule = 1 THEN 'in-progress' WHEN rule = 2 AND t = n THEN 'done' WHEN rule = 2 THEN 'in-progress' WHEN rule = 3 THEN 'done' END AS inferred FROM ruled) i ON i.id = t.id) GROUP BY 1", *_INFER)
add("e25_gates", lambda m: delivery.gate(m.phases, m.tasks, _all(m), m.scenarios), "SELECT p.id, coalesce(t.ok, true) AS tasks_ok, d.ok AS drift_ok, q.ok AS quality_ok, coalesce(t.ok, true) AND d.ok AND q.ok AS may_complete FROM phases p LEFT JOIN (SELECT phase_id, bool_and(status IN ('done', 'cancelled')) AS ok FROM tasks GROUP BY 1) t ON t.phase_id = p.id, (SELECT count(*) FILTER (severity = 'error') = 0 AS ok FROM found) d, (SELECT count(*) FILTER (priority = 'must' AND status = 'failing') = 0 AS ok FROM scenarios) q", *_ALL_OF)
_TITLED = "titled AS (SELECT id, title || CASE task_key % 4 WHEN 0 THEN ' Database' WHEN 1 THEN ' error handling' ELSE '' END AS title FROM tasks)"


def _titled(m: Model) -> DataFrame:
    return m.tasks.selectExpr("id", "title || CASE task_key % 4 WHEN 0 THEN ' Database' WHEN 1 THEN ' error handling' ELSE '' END AS title")


add("h25_keywords", lambda m: delivery.decision_reminder(_titled(m), m.decisions.filter("decision_id = 'ADR-3'")), "SELECT id, title FROM titled WHERE (contains(lower(title), 'auth') OR contains(lower(title), 'database') OR contains(lower(title), 'middleware') OR contains(lower(title), 'validation') OR contains(lower(title), 'caching') OR contains(lower(title), 'dependency injection') OR contains(lower(title), 'error handling')) AND (SELECT count(*) FROM decisions WHERE decision_id = 'ADR-3') <= 1", _TITLED)
add("c7_linked_scenarios", lambda m: delivery.linked_scenarios(m.scenarios, m.tests).select("id", F.array_join("linked_tests", ",").alias("linked_tests")), "SELECT s.id, string_agg(t.prefix, ',' ORDER BY t.prefix) AS linked_tests FROM scenarios s JOIN tests t ON t.scenario_id = s.id GROUP BY 1")
_LISTED = "listed AS (SELECT decision_id, list(prefix) AS files, list('b-' || right(decision_id, 1)) AS blocks FROM decisions GROUP BY 1)"


def _listed(m: Model) -> DataFrame:
    return m.decisions.groupBy("decision_id").agg(F.collect_list("prefix").alias("files"), F.collect_list(F.concat(F.lit("b-"), F.right("decision_id", F.lit(1)))).alias("blocks"))


add("c8_decisions_of_block", lambda m: changes.decisions_for(_listed(m), block="b-4").select("decision_id"), "SELECT decision_id FROM listed WHERE list_contains(blocks, 'b-4')", _LISTED)
add("c9_decisions_of_file", lambda m: changes.decisions_for(_listed(m), block="b-5", file="Small/brand#1").select("decision_id"), "SELECT DISTINCT decision_id FROM listed WHERE list_contains(blocks, 'b-5') OR len(list_filter(files, lambda f: contains(lower(f), 'small/brand#1'))) > 0", _LISTED)
_FILED = "filed AS (SELECT decision_id, CASE WHEN right(decision_id, 1) IN ('0', '3') THEN substr(prefix, 3) ELSE replace(prefix, 'SMALL/', 'small/') END AS prefix, CASE WHEN decision_id LIKE '%4' THEN 'b-small-brand2' END AS block_id FROM decisions UNION ALL SELECT 'ADR-F' || sym_key, 'old/' || file_path || '.bak', NULL FROM symbols WHERE sym_key % 97 = 0)"


def _filed(m: Model) -> DataFrame:
    return m.spark.sql(_FILED[len("filed AS (") : -1].replace("FROM decisions", "FROM {decisions}").replace("FROM symbols", "FROM {symbols}"), decisions=m.decisions, symbols=m.symbols)


add("d22_relevant_decisions", lambda m: containment.relevant_decisions(m.files, _filed(m), prefix.longest_prefix_join(m.files, m.prefixes)), "SELECT DISTINCT f.path, d.decision_id FROM (SELECT DISTINCT file_path AS path FROM symbols) f LEFT JOIN owner o ON o.path = f.path JOIN filed d ON contains(f.path, d.prefix) OR contains(d.prefix, f.path) OR d.block_id = o.block_id", _OWNER, _FILED)
add("c9_decisions_of_all_paths", lambda m: containment.decisions_of_paths(m.symbols.select(F.explode(F.array("file_path", paths.directory(F.col("file_path")), F.substring("file_path", 1, 9))).alias("path")), _filed(m).groupBy("decision_id").agg(F.collect_list("prefix").alias("files"))), "SELECT DISTINCT path, decision_id FROM (SELECT file_path AS path FROM symbols UNION SELECT regexp_replace(file_path, '/[^/]+$', '') FROM symbols UNION SELECT substr(file_path, 1, 9) FROM symbols) p JOIN filed d ON contains(lower(d.prefix), lower(p.path))", _FILED)
add("h18_scoped_findings", lambda m: drift.in_scope(_all(m), m.files.filter("path like '%f1.ts'")), "SELECT * FROM found WHERE affected_file IN (SELECT file_path FROM symbols WHERE file_path LIKE '%f1.ts')", *_ALL_OF)
_PARTS = "parts AS (SELECT id, is_client, kind = 'function' AND NOT is_client AS is_server_action FROM symbols WHERE kind IN ('component', 'function', 'hook'))"
add("d18_server_imports", lambda m: graph.server_imports(m.edges, m.symbols, m.symbols.filter("kind in ('component', 'function', 'hook')").selectExpr("id", "is_client", "kind = 'function' and not is_client as is_server_action"), m.files), "SELECT DISTINCT s.file_path AS file, t.file_path AS imports FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target JOIN parts c ON c.id = e.target WHERE e.kind = 'imports' AND c.is_server_action AND s.file_path IN (SELECT file_path FROM symbols JOIN parts USING (id) WHERE parts.is_client)", _PARTS)
add("h10_file_symbols", lambda m: graph.file_symbols(m.symbols, "LARGE/Brand#1").select("file_path", F.array_join(F.transform("symbols", lambda x: F.concat_ws(":", x["name"], x["kind"], x["is_exported"].cast("string"))), ",").alias("symbols")), "SELECT file_path, string_agg(name || ':' || kind || ':' || is_exported::VARCHAR, ',' ORDER BY name, kind) AS symbols FROM symbols WHERE starts_with(lower(file_path), 'large/brand#1') GROUP BY 1")
add("h11_component_graph", lambda m: graph.component_graph(m.edges, m.components, m.symbols).select("id", "name", "is_client", F.array_join("children", ",").alias("children"), F.array_join("parents", ",").alias("parents")), "SELECT c.id, s.name, c.is_client, coalesce((SELECT string_agg(DISTINCT t.name, ',' ORDER BY t.name) FROM rendered r JOIN symbols t ON t.id = r.target WHERE r.source = c.id), '') AS children, coalesce((SELECT string_agg(DISTINCT t.name, ',' ORDER BY t.name) FROM rendered r JOIN symbols t ON t.id = r.source WHERE r.target = c.id), '') AS parents FROM components c JOIN symbols s ON s.id = c.id", "rendered AS (SELECT * FROM edges WHERE kind = 'renders' AND source IN (SELECT id FROM components) AND target IN (SELECT id FROM components))")
add("e20_status_counts", lambda m: delivery.status_counts(m.tasks, m.scenarios), "SELECT *, (SELECT count(*) FROM scenarios WHERE status = 'passing') AS passing, (SELECT count(*) FROM scenarios WHERE status = 'failing') AS failing, (SELECT count(*) FROM scenarios WHERE status = 'untested') AS untested FROM (SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'in-progress') AS in_progress, count(*) FILTER (status = 'blocked') AS blocked FROM tasks)")
add("e24_run_totals", lambda m: changes.run_totals(m.symbols.groupBy("service").agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))), "SELECT sum(symbols)::BIGINT AS symbols, sum(files)::BIGINT AS files FROM (SELECT service, count(*) AS symbols, count(DISTINCT file_path) AS files FROM symbols GROUP BY 1)")
add("f12_sole_producer", lambda m: routes.sole_producer(m.api_routes.selectExpr("route_path", "service", "service as dto"), ["route_path"]), "SELECT route_path, min(service) AS service, min(service) AS dto FROM api_routes GROUP BY 1 HAVING count(DISTINCT service) = 1")
_STARTED = "started AS (SELECT id, phase_number, status, NULL::VARCHAR AS started_at, NULL::VARCHAR AS completed_at FROM phases)"
add("h24_complete_phase", lambda m: delivery.complete_phase(m.phases.selectExpr("id", "phase_number", "status", "cast(null as string) as started_at", "cast(null as string) as completed_at"), m.phases.selectExpr("id", "phase_number < 6 as may_complete"), "phase-1996", F.lit("2024-02-01")), "SELECT id, phase_number, CASE WHEN id = 'phase-1996' THEN 'complete' WHEN id = 'phase-1997' THEN 'in-progress' ELSE status END AS status, CASE WHEN id = 'phase-1997' THEN '2024-02-01' END AS started_at, CASE WHEN id = 'phase-1996' THEN '2024-02-01' END AS completed_at FROM started", _STARTED)

_TREE = (
    "services AS (SELECT DISTINCT {service} AS service, file_path AS path FROM symbols)",
    "dirs AS (SELECT service, coalesce(nullif(regexp_extract(path, '^(.*/)?', 0), ''), '') AS dir, count(*) AS n FROM services GROUP BY 1, 2)",
    "ups AS (SELECT service, n, unnest(list_transform(range(1, len(string_split(dir, '/'))), lambda i: [array_to_string(string_split(dir, '/')[1:i], '/') || '/', CASE WHEN i = 1 THEN '' ELSE array_to_string(string_split(dir, '/')[1:i - 1], '/') || '/' END])) AS f FROM dirs)",
    "roots AS (SELECT service, max(root) AS root, sum(n) AS n FROM (SELECT d.service, d.n, r.root FROM dirs d, (SELECT service, dir AS root FROM dirs UNION SELECT service, f[1] FROM ups UNION SELECT service, f[2] FROM ups) r WHERE r.service = d.service AND NOT EXISTS (SELECT 1 FROM dirs o WHERE o.service = d.service AND NOT starts_with(o.dir, r.root)) QUALIFY row_number() OVER (PARTITION BY d.service, d.dir ORDER BY length(r.root) DESC) = 1) GROUP BY 1)",
    "kids AS (SELECT service, f[2] AS parent, f[1] AS folder, sum(n) AS n FROM ups GROUP BY 1, 2, 3 HAVING sum(n) >= 3)",
    "kin AS (SELECT service, parent, count(*) AS k, sum(n) AS taken FROM kids GROUP BY 1, 2)",
    # each step splits the largest prefix of each service, as long as its children fit
    "st AS (SELECT 0 AS step, service, 0::BIGINT AS i, root AS p, n::BIGINT AS own, false AS done FROM roots UNION ALL (WITH pick AS (SELECT s.service, s.p, s.own, k.k, k.taken FROM st s JOIN kin k ON k.service = s.service AND k.parent = s.p AND NOT s.done QUALIFY row_number() OVER (PARTITION BY s.service ORDER BY s.own DESC, s.i) = 1), fit AS (SELECT * FROM pick WHERE k + (SELECT count(*) FROM st c WHERE c.service = pick.service) <= {most}) SELECT s.step + 1, s.service, s.i, s.p, CASE WHEN s.p = f.p THEN s.own - f.taken ELSE s.own END, s.done OR s.p = f.p FROM st s JOIN fit f ON f.service = s.service WHERE s.p <> f.p OR s.own > f.taken UNION ALL SELECT (SELECT max(step) FROM st) + 1, f.service, 1000000 * ((SELECT max(step) FROM st) + 1) + row_number() OVER (PARTITION BY f.service ORDER BY c.folder), c.folder, c.n, false FROM fit f JOIN kids c ON c.service = f.service AND c.parent = f.p))",
    "ended AS (SELECT * FROM st QUALIFY step = max(step) OVER (PARTITION BY service))",
    "plain AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS parts FROM ended)",
    "telling AS (SELECT *, list_filter(list_transform(range(1, len(parts) + 1), lambda j: CASE WHEN lower(parts[j]) IN ('src', 'source', 'packages') OR j < len(parts) AND lower(parts[j]) IN ('app', 'lib', 'apps') THEN '' ELSE parts[j] END), lambda x: x <> '') AS t FROM plain)",
    "ids AS (SELECT *, coalesce(nullif(array_to_string(list_filter(list_transform(t[-2:], lambda x: regexp_replace(lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g')), lambda x: x <> ''), '-'), ''), service) AS base FROM telling)",
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY service, base ORDER BY i) AS r FROM ids)",
)


def _tree(service: str, most: int) -> list[str]:
    return [t.replace("{service}", service).replace("{most}", str(most)) for t in _TREE]


_PROPOSED = "SELECT {} CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS block_id, p AS prefix, own AS n_files, CASE WHEN own >= 9 THEN 'high' WHEN own >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM numbered"
add("h14_proposal", lambda m: propose.propose(m.symbols, max_blocks=40), _PROPOSED.format(""), *_tree("'main'", 40))
add("h13_service_clusters", lambda m: propose.propose_services(m.symbols, max_blocks=12).select("service", "block_id", "prefix", "n_files", "confidence"), _PROPOSED.format("service,"), *_tree("service", 12))
add("s16_names", lambda m: m.blocks.select("id", propose.title_case(F.col("id")).alias("name"), paths.kebab(F.concat(F.lit("aB"), F.initcap("id"))).alias("kebab")), "SELECT id, array_to_string(list_transform(string_split(id, '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS name, regexp_replace(lower(regexp_replace(regexp_replace('aB' || upper(id[1]) || lower(id[2:]), '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS kebab FROM blocks")
add("s22_within", lambda m: m.pages.select("page_id", paths.within(F.regexp_replace("url", "^https?://", F.when(F.col("page_id") % 3 == 0, "../").when(F.col("page_id") % 3 == 1, "./a/../").otherwise("/root/b/")), "/root").alias("inside")), "SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL ELSE array_to_string(list_filter(string_split(CASE page_id % 3 WHEN 2 THEN 'b/' ELSE '' END || regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') END AS inside FROM pages")
add("h28_saving", lambda m: review.saving(m.symbols.selectExpr("file_path as path", "end_line - start_line as tokens"), "large/Brand#1", 100), "SELECT sum(end_line - start_line)::BIGINT AS baseline, round((sum(end_line - start_line) - 100) / sum(end_line - start_line) * 100, 1) AS saved_percent FROM symbols WHERE starts_with(file_path, 'large/Brand#1/')")

add("h28_block_savings", lambda m: review.block_savings(m.symbols.groupBy(F.col("file_path").alias("path")).agg(F.sum(F.col("end_line") - F.col("start_line")).alias("tokens")), m.prefixes, m.blocks.select(F.col("id").alias("block_id"), F.length("id").alias("tokens"))), "SELECT b.id AS block_id, count(s.path) AS files, coalesce(sum(s.tokens), 0)::BIGINT AS baseline, CASE WHEN coalesce(sum(s.tokens), 0) > 0 THEN round((sum(s.tokens) - length(b.id)) / sum(s.tokens) * 100, 1) END AS saved_percent FROM blocks b LEFT JOIN sized s ON s.block_id = b.id GROUP BY b.id",
    "sized AS (SELECT f.path, f.tokens, p.block_id FROM (SELECT file_path AS path, sum(end_line - start_line) AS tokens FROM symbols GROUP BY 1) f JOIN prefixes p ON f.path = rtrim(p.prefix, '/') OR starts_with(f.path, rtrim(p.prefix, '/') || '/') QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(rtrim(p.prefix, '/')) DESC, p.block_id) = 1)")

_VIEWS = {
    "changed": "SELECT DISTINCT file_path AS path, CASE length(file_path) % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'added' ELSE 'modified' END AS status FROM symbols WHERE file_path LIKE '%f1.ts'",
    "parts": "SELECT id, is_client, kind = 'function' AND NOT is_client AS is_server_action FROM symbols WHERE kind IN ('component', 'function', 'hook')",
    "scenario_blocks": "SELECT 'QS-' || n_nationkey AS scenario_id, CASE n_nationkey % 3 WHEN 0 THEN 'b-small' WHEN 1 THEN 'b-large-brand1' ELSE 'b-none' END AS block_id FROM nation",
    "open_routes": "SELECT route_path, kind, service = 'svc0' AS has_auth FROM api_routes",
    "described": "SELECT id, CASE level WHEN 1 THEN 'x' ELSE ' ' END AS description FROM blocks",
    "specified": "SELECT id, phase_id, status, task_key % 2 = 0 AS has_criteria FROM tasks",
    "placed_decisions": "SELECT decision_id, prefix, CASE WHEN decision_id LIKE '%4' THEN 'b-small-brand2' END AS block_id FROM decisions",
}


def _view(m: Model, name: str) -> DataFrame:
    text = _VIEWS[name]
    needs = [n for n in ("symbols", "nation", "api_routes", "blocks", "tasks", "decisions") if f"FROM {n}" in text]
    return m.spark.sql(text.replace(f"FROM {needs[0]}", "FROM {" + needs[0] + "}"), **{needs[0]: getattr(m, needs[0])})


def _project(m: Model) -> review.Project:
    views = [_view(m, n) for n in ("parts", "open_routes")]
    m.store("edges")
    return review.Project(m.symbols, m.edges, m.prefixes, m.interfaces, m.blocks, *views, m.scenarios, m.tests, _view(m, "scenario_blocks"), m.phases, m.tasks, _all(m), _view(m, "changed"))


def _with(*names: str) -> list[str]:
    return [*_ALL_OF, *(f"{n} AS ({_VIEWS[n]})" for n in names)]


_KEPT = "kept AS (SELECT path FROM changed WHERE status <> 'deleted')"
_UNDECLARED = "undeclared AS (SELECT DISTINCT source_file, source_block, target_block FROM be WHERE kind IN ('imports', 'calls', 'renders') AND source_block <> target_block AND NOT EXISTS (SELECT 1 FROM interfaces i WHERE i.block_id = be.source_block AND i.target = be.target_block))"
add("h19_practice_review", lambda m: review.practice_review(_project(m), many_symbols=2, many_targets=5), """
    SELECT 'architecture' AS dimension, 'warning' AS severity, 'unmapped file' AS kind, path AS subject FROM kept WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(path, p.prefix))
    UNION ALL SELECT DISTINCT 'architecture', 'error', 'undeclared interface', source_file || ' -> ' || target_block FROM undeclared WHERE source_file IN (SELECT path FROM kept)
    UNION ALL SELECT DISTINCT 'security', 'warning', 'server import', s.file_path || ' -> ' || t.file_path FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target
        WHERE e.kind = 'imports' AND s.file_path IN (SELECT path FROM kept) AND e.target IN (SELECT id FROM parts WHERE is_server_action) AND s.file_path IN (SELECT file_path FROM symbols JOIN parts USING (id) WHERE parts.is_client)
    UNION ALL SELECT 'testing', 'info', 'code without tests', count(*)::VARCHAR FROM kept HAVING count(*) > 0
    UNION ALL SELECT 'testing', CASE WHEN status = 'passing' THEN 'warning' ELSE 'error' END, 'scenario at risk', id FROM scenarios sc WHERE priority IN ('must', 'should') AND (
        EXISTS (SELECT 1 FROM tests t, kept WHERE t.scenario_id = sc.id AND starts_with(kept.path, t.prefix)) OR EXISTS (SELECT 1 FROM scenario_blocks b JOIN prefixes p ON p.block_id = b.block_id, kept WHERE b.scenario_id = sc.id AND starts_with(kept.path, p.prefix)))
    UNION ALL SELECT 'documentation', severity, 'drift', count(*)::VARCHAR FROM found WHERE severity IN ('error', 'warning') GROUP BY severity
    UNION ALL SELECT 'complexity', 'warning', 'many symbols', file_path FROM symbols WHERE file_path IN (SELECT path FROM kept) GROUP BY file_path HAVING count(*) > 2
    UNION ALL SELECT 'complexity', 'warning', 'many targets', s.file_path FROM edges e JOIN symbols s ON s.id = e.source WHERE s.file_path IN (SELECT path FROM kept) GROUP BY s.file_path HAVING count(DISTINCT e.target) > 5""",
    *_with("changed", "parts", "scenario_blocks"), _KEPT, _UNDECLARED)
_DRIFT_ROWS = "SELECT 'drift' AS section, severity AS subject, count(*)::VARCHAR AS value FROM found GROUP BY severity"
_SCENARIO_ROWS = "SELECT 'scenarios', id, status FROM scenarios"
_CHANGED_ROWS = "SELECT 'changed files', path, status FROM changed"
add("h20_security_reviewer", lambda m: review.role_check(_project(m), "security-reviewer"), f"""{_DRIFT_ROWS} UNION ALL {_SCENARIO_ROWS} WHERE category = 'security' OR priority = 'must' UNION ALL {_CHANGED_ROWS}
    UNION ALL SELECT 'boundaries', 'client components', count(*)::VARCHAR FROM parts WHERE is_client UNION ALL SELECT 'boundaries', 'server actions', count(*)::VARCHAR FROM parts WHERE is_server_action
    UNION ALL SELECT 'boundaries', 'edges across', count(*)::VARCHAR FROM edges e JOIN parts a ON a.id = e.source JOIN parts b ON b.id = e.target WHERE a.is_client <> b.is_client AND e.kind IN ('imports', 'calls', 'renders')
    UNION ALL SELECT 'routes without auth', route_path, kind FROM open_routes WHERE kind = 'api-route' AND NOT has_auth""", *_with("changed", "parts", "open_routes"))
add("h20_quality_guardian", lambda m: review.role_check(_project(m), "quality-guardian"), f"{_DRIFT_ROWS} UNION ALL {_SCENARIO_ROWS} UNION ALL SELECT 'verification', verification || ' / ' || status, count(*)::VARCHAR FROM scenarios GROUP BY verification, status", *_with())
add("h20_architect", lambda m: review.role_check(_project(m), "architect"), f"{_DRIFT_ROWS} UNION ALL SELECT 'blocks', id, NULL FROM blocks UNION ALL SELECT DISTINCT 'undeclared interfaces', source_block, target_block FROM undeclared", *_with(), _UNDECLARED)
add("h20_phase_manager", lambda m: review.role_check(_project(m), "phase-manager"), f"""{_DRIFT_ROWS} UNION ALL SELECT 'phase', id, 'in-progress' FROM phases WHERE status = 'in-progress' UNION ALL SELECT 'tasks', id, status FROM tasks WHERE phase_id IN (SELECT id FROM phases WHERE status = 'in-progress')
    UNION ALL SELECT 'progress', status, count(*)::VARCHAR FROM tasks WHERE phase_id IN (SELECT id FROM phases WHERE status = 'in-progress') GROUP BY status UNION ALL {_CHANGED_ROWS}
    UNION ALL SELECT 'gate', 'must-have scenarios', CASE WHEN count(*) FILTER (status = 'failing') = 0 THEN 'ready' ELSE 'blocked' END FROM scenarios WHERE priority = 'must' HAVING count(*) > 0
    UNION ALL SELECT 'gate', id, status FROM scenarios WHERE priority = 'must' AND status <> 'passing' AND EXISTS (SELECT 1 FROM scenarios WHERE priority = 'must' AND status = 'failing')""", *_with("changed"))
add("h20_code_reviewer", lambda m: review.role_check(_project(m), "code-reviewer"), "SELECT 'changed files' AS section, path AS subject, status AS value FROM changed UNION ALL SELECT 'affected blocks', path, block_id FROM owner WHERE path IN (SELECT path FROM kept) UNION ALL SELECT 'unmapped files', path, NULL FROM kept WHERE path NOT IN (SELECT path FROM owner)", *_with("changed"), _KEPT)
add("h20_custom_role", lambda m: review.role_check(_project(m), "gardener", ["accessibility"]), f"{_DRIFT_ROWS} UNION ALL {_SCENARIO_ROWS} WHERE category = 'accessibility' OR priority = 'must'", *_with())
add("h20_release_check", lambda m: review.role_scenarios(m.scenarios), "SELECT id, category, status FROM scenarios WHERE priority = 'must' AND status <> 'passing'")
add("h21_open_questions", lambda m: delivery.open_questions(m.scenarios, m.tests, m.phases, _view(m, "specified").selectExpr("*", "if(has_criteria, array('x'), array()) as criteria"), _view(m, "described"), m.prefixes, _all(m)), """
    SELECT 'must-have scenario' AS topic, id AS subject FROM scenarios WHERE priority = 'must' AND status IN ('untested', 'failing') UNION ALL SELECT 'should-have scenario', id FROM scenarios WHERE priority = 'should' AND status IN ('untested', 'failing')
    UNION ALL SELECT 'scenario without tests', id FROM scenarios WHERE id NOT IN (SELECT scenario_id FROM tests) UNION ALL SELECT 'block without code', id FROM blocks WHERE id NOT IN (SELECT block_id FROM prefixes)
    UNION ALL SELECT 'block without description', id FROM described WHERE trim(description) = '' UNION ALL SELECT 'drift', kind FROM found
    UNION ALL SELECT 'task without criteria', id FROM specified WHERE status <> 'done' AND NOT has_criteria AND phase_id IN (SELECT id FROM phases WHERE status = 'in-progress')""", *_with("described", "specified"))
add("h22_guidance", lambda m: review.guidance(_project(m), "small/Brand#2/f1.ts", _view(m, "placed_decisions"), "security"), """
    SELECT 'block' AS kind, 'b-small-brand2' AS subject UNION ALL SELECT 'interface', target FROM interfaces WHERE block_id = 'b-small-brand2' UNION ALL SELECT 'nearby', name FROM (SELECT name FROM symbols WHERE starts_with(file_path, 'small/Brand#2/') ORDER BY kind, name, id LIMIT 20)
    UNION ALL SELECT 'scenario', id FROM scenarios WHERE category = 'security' UNION ALL SELECT 'task', id FROM tasks WHERE block_id = 'b-small-brand2' AND status IN ('todo', 'in-progress')
    UNION ALL SELECT DISTINCT 'decision', decision_id FROM placed_decisions WHERE contains('small/Brand#2/f1.ts', prefix) OR contains(prefix, 'small/Brand#2/f1.ts') OR block_id = 'b-small-brand2'
    UNION ALL SELECT 'finding', kind FROM found WHERE affected_file = 'small/Brand#2/f1.ts' OR affected_block = 'b-small-brand2'""", *_with("placed_decisions"))
add("h23_document_proposals", lambda m: review.document_proposals(_project(m)), """
    SELECT 'unmapped folder' AS kind, regexp_replace(path, '[^/]*$', '') AS subject, count(*)::VARCHAR AS detail FROM kept WHERE path NOT IN (SELECT path FROM owner) GROUP BY 2
    UNION ALL SELECT 'interface', target, string_agg(DISTINCT source_block, ',' ORDER BY source_block) FROM be WHERE source_block <> target_block AND target IN (SELECT id FROM symbols WHERE is_exported) AND target_file IN (SELECT path FROM kept) GROUP BY target
    UNION ALL SELECT DISTINCT 'emptied prefix', p.prefix, p.block_id FROM prefixes p, changed c WHERE c.status = 'deleted' AND starts_with(c.path, p.prefix) AND NOT EXISTS (SELECT 1 FROM symbols s WHERE starts_with(lower(s.file_path), lower(p.prefix)))""", *_with("changed"), _KEPT)
add("h23_unmapped_folders", lambda m: review.unmapped_folders(m.files, m.prefixes), "SELECT regexp_replace(path, '/[^/]+$', '') AS dir, count(*) AS n_files FROM (SELECT DISTINCT file_path AS path FROM symbols) f WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(f.path, p.prefix)) GROUP BY 1")
add("d19_undeclared_use", lambda m: review.undeclared_use(_project(m)), "SELECT * FROM undeclared", _OWNER, _BLOCK_EDGES, _UNDECLARED)
add("h27_drift_summary", lambda m: report.drift_summary(_all(m)), "SELECT 'total' AS \"by\", 'all' AS key, count(*) AS n FROM found UNION ALL SELECT 'severity', severity, count(kind) FROM (SELECT unnest(['info', 'warning', 'error']) AS severity) s LEFT JOIN found USING (severity) GROUP BY severity UNION ALL SELECT 'kind', kind, count(*) FROM found GROUP BY kind UNION ALL SELECT 'block', coalesce(affected_block, '(unassigned)'), count(*) FROM found GROUP BY 2", *_with())
add("h27_plan_totals", lambda m: report.plan_totals(m.phases, m.tasks), "SELECT (SELECT count(*) FROM phases) AS phases, (SELECT count(*) FROM phases WHERE status = 'complete') AS complete, count(*) AS tasks, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'cancelled') AS cancelled FROM tasks")
add("h27_activity_by_role", lambda m: report.activity_by(m.activity, "agent_role"), "SELECT coalesce(agent_role, '(unknown)') AS key, count(*) AS activities, coalesce(sum(total_tokens), 0)::BIGINT AS tokens, round(coalesce(sum(cost_usd), 0), 4) AS cost FROM activity GROUP BY 1")
add("f5_quality_trend", lambda m: telemetry.quality_trend(m.activity.withColumn("test_pass_count", F.expr("if(id % 3 = 0, id, null)"))).select("id", "drift_count"), "SELECT id, drift_count FROM activity WHERE drift_count IS NOT NULL OR id % 3 = 0 ORDER BY recorded_at DESC, id DESC LIMIT 50")
add("d3_first_prefix", lambda m: prefix.first_prefix_join(m.files, m.prefixes.withColumn("ord", F.length("block_id"))), "SELECT path, block_id FROM (SELECT f.path, p.block_id, row_number() OVER (PARTITION BY f.path ORDER BY length(p.block_id), p.block_id) AS r FROM (SELECT DISTINCT file_path AS path FROM symbols) f JOIN prefixes p ON starts_with(f.path, p.prefix)) WHERE r = 1")
add("c16_ignored", lambda m: drift.undocumented(m.symbols, m.prefixes, drift.ignored_prefixes(m.spark, "react-vite", ["promo/Brand#1"])).select("affected_file"), "SELECT DISTINCT file_path AS affected_file FROM symbols s WHERE NOT starts_with(file_path, 'promo/Brand#1') AND NOT EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(s.file_path, p.prefix))")

_REFRESHED = "fresh AS (SELECT id, 'todo' AS status, NULL::VARCHAR AS completed_at, CASE WHEN task_key % 4 = 0 THEN 'b-unknown' ELSE block_id END AS block_id FROM tasks WHERE task_key % 13 <> 0)"
add("a12_refresh", lambda m: changes.refresh(m.tasks.withColumn("completed_at", F.when(F.col("status") == "done", F.col("title"))), m.tasks.filter("task_key % 13 <> 0").selectExpr("id", "'todo' as status", "cast(null as string) as completed_at", "if(task_key % 4 = 0, 'b-unknown', block_id) as block_id"), m.blocks), "SELECT f.id, t.status, CASE WHEN t.status = 'done' THEN t.title END AS completed_at, CASE WHEN f.block_id IN (SELECT id FROM blocks) THEN f.block_id END AS block_id, f.block_id IS NOT NULL AND f.block_id NOT IN (SELECT id FROM blocks) AS orphaned FROM fresh f JOIN tasks t ON t.id = f.id", _REFRESHED)
add("a23_log", lambda m: drift.replace_unresolved(_all(m).withColumn("resolution", F.when(F.col("kind") == "stale_adr", "accepted")), _all(m).filter("severity <> 'info'")).groupBy("kind", "resolution").agg(F.count("*").alias("n")), "SELECT kind, resolution, count(*) AS n FROM (SELECT kind, 'accepted' AS resolution FROM found WHERE kind = 'stale_adr' UNION ALL SELECT kind, NULL FROM found WHERE severity <> 'info') GROUP BY 1, 2", *_ALL_OF)
_OUTCOMES = "outcomes AS (SELECT 'QS-' || doc_id AS scenario_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'passed' WHEN toxic = 1 THEN 'missing' ELSE 'failed' END AS outcome FROM labels UNION ALL SELECT 'QS-' || doc_id, 'passed' FROM labels WHERE doc_id % 3 = 0)"
add("h26_verified", lambda m: review.verified(m.scenarios, _part_of(m, _OUTCOMES, labels=m.labels)).select("id", "status"), "SELECT s.id, CASE WHEN r.ok THEN 'passing' WHEN NOT r.ok THEN 'failing' ELSE s.status END AS status FROM scenarios s LEFT JOIN (SELECT scenario_id, bool_and(outcome = 'passed') AS ok FROM outcomes WHERE outcome <> 'missing' GROUP BY 1) r ON r.scenario_id = s.id", _OUTCOMES)
add("h30_record", lambda m: telemetry.record(m.activity, True, "sync", F.lit("2024-03-01").cast("timestamp"), task_id="t3", drift_count=4, unknown=1, duration_ms="no number").groupBy("tool_name", "task_id").agg(F.count("*").alias("n"), F.max("drift_count").alias("drift"), F.count("duration_ms").alias("timed")), "SELECT tool_name, task_id, count(*) AS n, max(drift_count) AS drift, count(duration_ms) AS timed FROM (SELECT tool_name, task_id, drift_count, duration_ms FROM activity UNION ALL SELECT 'sync', 't3', 4, NULL) GROUP BY 1, 2")
add("h31_records", lambda m: records.update_task(records.delete_phase(m.phases, records.delete_tasks(m.tasks.withColumn("completed_at", F.lit(None).cast("timestamp")), ["task-1", "task-none"])[0], "phase-1998")[1], "task-2", "done", F.lit("2024-02-01").cast("timestamp")).select("id", "status", F.col("completed_at").isNotNull().alias("completed")), "SELECT id, CASE WHEN id = 'task-2' THEN 'done' ELSE status END AS status, id = 'task-2' AS completed FROM tasks WHERE id <> 'task-1' AND phase_id <> 'phase-1998'")
_APP = "app_files AS (SELECT CASE WHEN page_id % 5 = 0 THEN '' ELSE 'src/' END || 'app/' || CASE page_id % 4 WHEN 0 THEN '(shop)/' WHEN 1 THEN '[lang]/' ELSE '' END || split_part(url, '/', 4) || '/' || CASE page_id % 3 WHEN 0 THEN '[...all]/' ELSE '' END || CASE page_id % 7 WHEN 0 THEN 'page.tsx' WHEN 1 THEN 'layout.jsx' WHEN 2 THEN 'helper.ts' ELSE 'route.ts' END AS path, CASE WHEN page_id % 2 = 0 THEN 'export async function GET() {} ' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN 'export const DELETE = 1; export function POSTED() {}' ELSE '' END AS content FROM pages)"
add("b15_app_routes", lambda m: extract.app_routes(_part_of(m, _APP, pages=m.pages)).select("path", "route_path", "kind", F.array_join("methods", ",").alias("methods")), """SELECT path, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace('/' || regexp_replace(path, '^(src/)?app/', ''), '/[^/]+$', ''), '/\\([^/]*\\)', '', 'g'), '\\[\\.\\.\\.([^\\]]+)\\]', '*\\1', 'g'), '\\[([^\\]]+)\\]', ':\\1', 'g'), ''), '/') AS route_path,
    CASE WHEN path LIKE '%/route.ts' THEN 'api-route' WHEN path LIKE '%/page.tsx' THEN 'page' ELSE 'layout' END AS kind,
    CASE WHEN path LIKE '%/route.ts' THEN array_to_string(list_filter([CASE WHEN contains(content, 'GET') THEN 'GET' END, CASE WHEN contains(content, 'DELETE') THEN 'DELETE' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS methods FROM app_files WHERE path NOT LIKE '%/helper.ts'""", _APP)
add("s24_app_route", lambda m: _part_of(m, _APP, pages=m.pages).select("path").distinct().select("path", paths.app_route(F.col("path")).alias("route")), "SELECT DISTINCT path, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace('/' || regexp_replace(path, '^(src/)?app/', ''), '/[^/]+$', ''), '/\\([^/]*\\)', '', 'g'), '\\[\\.\\.\\.([^\\]]+)\\]', '*\\1', 'g'), '\\[([^\\]]+)\\]', ':\\1', 'g'), ''), '/') AS route FROM app_files", _APP)
add("f10_ranked_routes", lambda m: changes.ranked(m.api_routes, "service", F.col("route_path").desc(), "route_id", limit=40, offset=5).select("rank", "route_id"), "SELECT rank, route_id FROM (SELECT CAST(row_number() OVER (ORDER BY service, route_path DESC, route_id) AS INT) AS rank, route_id FROM api_routes) WHERE rank BETWEEN 6 AND 45")
add("f10_ranked_tasks", lambda m: changes.ranked(m.tasks, F.col("block_id").asc_nulls_last(), F.col("status").desc(), "task_key", limit=200).select("rank", "id"), "SELECT CAST(row_number() OVER (ORDER BY block_id NULLS LAST, status DESC, task_key) AS INT) AS rank, id FROM tasks QUALIFY rank <= 200")
add("d19_scenarios_at_risk", lambda m: review.at_risk(_project(m), m.files.filter("path like '%f1.ts'")).select("id", "status"), "SELECT id, status FROM scenarios sc WHERE priority IN ('must', 'should') AND (EXISTS (SELECT 1 FROM tests t, symbols f WHERE t.scenario_id = sc.id AND f.file_path LIKE '%f1.ts' AND starts_with(f.file_path, t.prefix)) OR EXISTS (SELECT 1 FROM scenario_blocks b JOIN prefixes p ON p.block_id = b.block_id, symbols f WHERE b.scenario_id = sc.id AND f.file_path LIKE '%f1.ts' AND starts_with(f.file_path, p.prefix)))", f"scenario_blocks AS ({_VIEWS['scenario_blocks']})")
_HITS = "typed_hits AS (SELECT s.call_id, r.service, 'dto' || (length(r.route_path) % 9) AS dto, 'dto' || (CAST(substr(s.call_id, 6) AS BIGINT) % 9) AS expected FROM served s JOIN api_routes r ON r.route_id = s.route_id WHERE NOT EXISTS (SELECT 1 FROM route_methods x WHERE x.route_id = s.route_id) OR EXISTS (SELECT 1 FROM route_methods x WHERE x.route_id = s.route_id AND upper(x.method) = upper(s.method)))"
add("h7_contract_fields", lambda m: routes.contract_fields(routes.allowed_hits(m.api_routes.withColumn("dto", F.concat(F.lit("dto"), F.length("route_path") % 9)), m.api_calls.withColumn("expected", F.expr("concat('dto', cast(substring(call_id, 6) as bigint) % 9)")), m.route_methods), m.fields_used, m.fields_given), """SELECT call_id, dto, field, problem FROM (
    SELECT p.call_id, p.dto, u.field, unnest(CASE WHEN got IS NULL THEN CASE WHEN optional THEN [] ELSE ['missing'] END ELSE list_filter([CASE WHEN got <> field THEN 'casing' END, CASE WHEN tc <> gc THEN 'type' END], lambda z: z IS NOT NULL) END) AS problem
    FROM known_hits p JOIN compared u ON u.expected = p.expected AND u.dto = p.dto)""", _SEGS, _HITS,
    "known_hits AS (SELECT call_id, expected, min(dto) AS dto FROM typed_hits GROUP BY 1, 2 HAVING count(DISTINCT dto) = 1)",
    "one AS (SELECT dto, field AS g_field, min(type) AS g_type FROM fields_given GROUP BY dto, field)",
    "compared AS (SELECT k.expected, k.dto, u.field, u.optional, coalesce(e.g_field, l.g_field) AS got, (SELECT " + _CATEGORY + " FROM (SELECT u.type AS x)) AS tc, (SELECT " + _CATEGORY + """ FROM (SELECT coalesce(e.g_type, l.g_type) AS x)) AS gc
    FROM (SELECT DISTINCT expected, dto FROM known_hits WHERE dto IN (SELECT dto FROM one)) k JOIN (SELECT DISTINCT * FROM fields_used) u ON u.dto = k.expected LEFT JOIN one e ON e.dto = k.dto AND e.g_field = u.field
    LEFT JOIN (SELECT dto, lower(g_field) AS low, g_field, g_type FROM one QUALIFY row_number() OVER (PARTITION BY dto, lower(g_field) ORDER BY g_field) = 1) l ON l.dto = k.dto AND l.low = lower(u.field))""")

# S: functions
add("s2_search_prefix", lambda m: m.prefixes.select("prefix", paths.search_prefix(F.concat("prefix", F.lit("**/*"))).alias("nested"), paths.search_prefix(F.concat("prefix", F.lit("*"))).alias("plain")), "SELECT prefix, regexp_replace(prefix || '**/*', '\\*\\*?/?\\*?$', '') AS nested, regexp_replace(prefix || '*', '\\*\\*?/?\\*?$', '') AS plain FROM prefixes")
add("s1_normalize_path", lambda m: m.prefixes.select("prefix", paths.normalize_path(F.concat("prefix", F.lit("**"))).alias("plain"), paths.normalize_path(F.concat("prefix", F.lit("**/*"))).alias("nested")), "SELECT prefix, regexp_replace(prefix || '**', '\\*+/?$', '') AS plain, regexp_replace(prefix || '**/*', '\\*+/?$', '') AS nested FROM prefixes")
add("s3_under_prefix", lambda m: prefix.prefix_pairs(m.files, m.prefixes).filter(paths.under_prefix(F.col("path"), F.col("prefix"))).select("path", "block_id"), "SELECT f.path, p.block_id FROM (SELECT DISTINCT file_path AS path FROM symbols) f JOIN prefixes p ON f.path = rtrim(p.prefix, '/') OR starts_with(f.path, rtrim(p.prefix, '/') || '/')")
add("s9_strip_query", lambda m: m.pages.select("page_id", paths.strip_query(F.col("url")).alias("bare")), "SELECT page_id, regexp_extract(url, '^[^?#]*') AS bare FROM pages")
add("s14_symbol_id", lambda m: m.symbols.select("id", paths.symbol_path(F.col("id")).alias("path"), paths.symbol_name(F.col("id")).alias("name")), "SELECT id, file_path AS path, name FROM symbols")
add("s17_slug", lambda m: m.benchmark.select("item_id", paths.slug(F.col("text")).alias("slug")), "SELECT item_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) AS slug FROM benchmark")
add("s21_content_hash", lambda m: m.documents.select("doc_id", paths.content_hash(F.col("text")).alias("hash")), "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
add("s23_directory", lambda m: m.files.select("path", paths.directory(F.col("path")).alias("dir")), "SELECT DISTINCT file_path AS path, regexp_replace(file_path, '/[^/]+$', '') AS dir FROM symbols")

add("s6_json_strings", lambda m: m.activity.select("id", F.array_join(paths.json_strings(F.expr("CASE id % 3 WHEN 0 THEN concat('[\"', tool_name, '\", \"', coalesce(model, ''), '\"]') WHEN 1 THEN concat('[\"', tool_name) END")), "|").alias("items")), "SELECT id, CASE id % 3 WHEN 0 THEN tool_name || '|' || coalesce(model, '') ELSE '' END AS items FROM activity")
add("s26_escaped", lambda m: m.pages.select("page_id", F.sha2(texts.escape_html(F.col("html")), 256).alias("as_html"), F.sha2(texts.escape_cell(F.concat_ws("|", "url", "html")), 256).alias("as_cell")), "SELECT page_id, sha256(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS as_html, sha256(replace(replace(concat_ws('|', url, html), '|', '\\|'), chr(10), ' ')) AS as_cell FROM pages")
add("a20_markdown", lambda m: sinks.markdown_lines(m.activity.filter("tool_name = 'view'").select("id", "tool_name", "model")), "SELECT '| id | tool_name | model |' AS value UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || id || ' | ' || tool_name || ' | ' || coalesce(model, '') || ' |' FROM activity WHERE tool_name = 'view'")
add("s25_git_status", lambda m: m.documents.select("doc_id", paths.git_status(F.expr("substring('ADRMCT?R100', cast(doc_id % 8 as int) + 1, 4)")).alias("status")), "SELECT doc_id, CASE substr('ADRMCT?R', CAST(doc_id % 8 AS INT) + 1, 1) WHEN 'A' THEN 'added' WHEN '?' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS status FROM documents")
add("s27_total_tokens", lambda m: m.activity.select("id", telemetry.total_tokens(F.col("explicit_tokens"), F.col("input_tokens"), F.col("output_tokens")).alias("total")), "SELECT id, total_tokens AS total FROM activity")
add("g9_unassigned_files", lambda m: prefix.longest_prefix_join(m.files, m.prefixes, keep_unmatched=True), "SELECT f.path, o.block_id FROM (SELECT DISTINCT file_path AS path FROM symbols) f LEFT JOIN owner o ON o.path = f.path", _OWNER)
add("e2_span", lambda m: telemetry.span(m.activity.filter("tool_name <> 'view'")), "SELECT count(*) AS n, coalesce(sum(total_tokens), 0)::BIGINT AS tokens, round(coalesce(sum(cost_usd), 0), 4) AS cost, min(recorded_at) AS first_at, max(recorded_at) AS last_at, CAST(floor(date_diff('second', min(recorded_at), max(recorded_at)) / 86400) AS BIGINT) AS days FROM activity WHERE tool_name <> 'view'")
add("d17_bucketed_neighbours", lambda m: _tables(m).neighbours(m.symbols.filter("sym_key = 20").select("id").scalar()).select("direction", "id", "edge"), "SELECT 'caller' AS direction, source AS id, kind AS edge FROM edges WHERE target = (SELECT id FROM symbols WHERE sym_key = 20) UNION ALL SELECT 'callee', target, kind FROM edges WHERE source = (SELECT id FROM symbols WHERE sym_key = 20)")

# A, B: sources, a file or two of each row of part; @k stands for its key, @s for its size and ~ for a line break
_SOURCES = {
    "csharp": ["N@k.cs", 'namespace N@s;~[Route("api/r@k")]~public class C@kController : ControllerBase, IThing@k~{~    public int Size { get; set; }~    [HttpGet("{id}")] [Authorize]~    public Task<Dto@k> Make@k(Arg@k a) { return Help@k(a); }~    private Dto@k Help@k(Arg@k a) { return new Dto@k(); }~}~public record Dto@k(int Id);~public interface IThing@k { }~'],
    "python": ["m@k.py", 'class A@k(B@k):~    def m@k(self, x: T@k):~        return f@k(x)~~@app.get("/p@k/{id}")~async def f@k(id: int, user = Depends(auth)):~    return 1~class B@k: pass~'],
    "go": ["m@k.go", 'package a~type S@k struct {~    Base@k~}~type Base@k struct {~}~func (s *S@k) Run@k(i Base@k) error {~    return help@k(i)~}~func help@k(i Base@k) error { return nil }~func routes() {~    g := r.Group("/g@k")~    g.GET("/x", h@k)~}~'],
    "typescript": ["src/m@k.tsx", '"use client";~import { Kit@k } from "./kit@k";~export function Page@k(p: Props@k) {~  const [a, b] = useState(0);~  load@k();~  return <Kit@k a={a} />;~}~interface Props@k { a: string }~async function load@k() { return api.get<Dto@k>("/u@k/x"); }~'],
    "kit": ["src/kit@k.tsx", "export const Kit@k = (p: any) => <div/>;~"],
    "package": ["m@k/package.json", '{"dependencies": {"lib@k": "1"}, "devDependencies": {"dev@k": "@s"}}'],
    "project": ["m@k.csproj", '<Project><PackageReference Include="Nu@k" Version="@s" /></Project>'],
}


def _said(text: str) -> str:
    """SQL for a text of :data:`_SOURCES`."""
    return f"replace(replace(replace('{text}', '@k', cast(p_partkey as string)), '@s', cast(p_size as string)), '~', chr(10))"


#: A row of part has some ten bytes on disk and is a file or two to read: its bytes say nothing of the work, so keys are dealt out first.
_PART_BYTES = 1 << 16


def _files(m: Model, *names: str) -> DataFrame:
    part = m.dealt("part", _PART_BYTES, "p_partkey").select("p_partkey", "p_size")
    made = [part.selectExpr(f"{_said(path)} as path", f"{_said(text)} as content") for path, text in (_SOURCES[n] for n in names)]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def _of_part(columns: str, *rows: str) -> str:
    """SQL of ``rows`` for each row of part, the values of a row separated by bars."""
    names = columns.split()
    value = lambda v, n: "NULL" if v == "-" else v if n in ("start_line", "end_line", "line") or v in ("true", "false") else _said(v)
    return " UNION ALL ".join("SELECT " + ", ".join(f"{value(v, n)} AS {n}" for n, v in zip(names, r.split("|"), strict=True)) + " FROM part" for r in rows)


_SYMBOL = "id kind start_line end_line is_exported"


def _symbols(language: str, *more: str) -> Callable[[Model], DataFrame]:
    return lambda m: extract.symbols(_files(m, language, *more), language).select(*_SYMBOL.split())


def _edges(language: str, *more: str) -> Callable[[Model], DataFrame]:
    return lambda m: edges.edges(edges.references(f := _files(m, language, *more), language), extract.symbols(f, language))


add("b1_typescript_symbols", _symbols("typescript", "kit"), _of_part(_SYMBOL, "src/m@k.tsx::Page@k#component|component|3|7|true", "src/m@k.tsx::Props@k#interface|interface|8|8|false", "src/m@k.tsx::load@k#function|function|9|9|false", "src/kit@k.tsx::Kit@k#component|component|1|1|true"))
add("b4_csharp_symbols", _symbols("csharp"), _of_part(_SYMBOL, "N@k.cs::N@s.C@kController#class|class|3|9|true", "N@k.cs::N@s.C@kController.Size#variable|variable|5|5|true", "N@k.cs::N@s.C@kController.Make@k#function|function|7|7|true", "N@k.cs::N@s.C@kController.Help@k#function|function|8|8|false", "N@k.cs::N@s.Dto@k#class|class|10|10|true", "N@k.cs::N@s.IThing@k#interface|interface|11|11|true"))
add("b6_python_symbols", _symbols("python"), _of_part(_SYMBOL, "m@k.py::A@k#class|class|1|3|true", "m@k.py::A@k.m@k#function|function|2|3|true", "m@k.py::f@k#function|function|6|7|true", "m@k.py::B@k#class|class|8|8|true"))
add("b7_go_symbols", _symbols("go"), _of_part(_SYMBOL, "m@k.go::S@k#class|class|2|4|true", "m@k.go::Base@k#class|class|5|6|true", "m@k.go::S@k.Run@k#function|function|7|9|true", "m@k.go::help@k#function|function|10|10|false", "m@k.go::routes#function|function|11|14|false"))
_EDGE = "source target kind"
add("b8_typescript_edges", _edges("typescript", "kit"), _of_part(_EDGE, *(f"src/m@k.tsx::{a}|src/kit@k.tsx::Kit@k#component|imports" for a in ("Page@k#component", "Props@k#interface", "load@k#function")), "src/m@k.tsx::Page@k#component|src/m@k.tsx::load@k#function|calls", "src/m@k.tsx::Page@k#component|src/kit@k.tsx::Kit@k#component|renders", "src/m@k.tsx::Page@k#component|src/m@k.tsx::Props@k#interface|uses_type"))
add("b9_csharp_edges", _edges("csharp"), _of_part(_EDGE, "N@k.cs::N@s.C@kController#class|N@k.cs::N@s.IThing@k#interface|implements", "N@k.cs::N@s.C@kController.Make@k#function|N@k.cs::N@s.C@kController.Help@k#function|calls", "N@k.cs::N@s.C@kController.Help@k#function|N@k.cs::N@s.Dto@k#class|uses_type"))
add("b11_python_edges", _edges("python"), _of_part(_EDGE, "m@k.py::A@k#class|m@k.py::B@k#class|extends", "m@k.py::A@k.m@k#function|m@k.py::f@k#function|calls"))
add("b12_go_edges", _edges("go"), _of_part(_EDGE, "m@k.go::S@k#class|m@k.go::Base@k#class|extends", "m@k.go::S@k.Run@k#function|m@k.go::help@k#function|calls", "m@k.go::S@k.Run@k#function|m@k.go::Base@k#class|uses_type", "m@k.go::help@k#function|m@k.go::Base@k#class|uses_type"))
add("b14_components", lambda m: edges.components(_files(m, "typescript", "kit")).select("id", "is_client", "has_state", "props"), _of_part("id is_client has_state props", "src/m@k.tsx::Page@k#component|true|true|Props@k", "src/kit@k.tsx::Kit@k#component|false|false|any"))
_ROUTED = "route_path method has_auth response_type"


def _routes(language: str) -> Callable[[Model], DataFrame]:
    return lambda m: extract.routes(_files(m, language), language).select("route_path", F.array_join("methods", ",").alias("method"), "has_auth", "response_type")


add("b17_csharp_routes", _routes("csharp"), _of_part(_ROUTED, "/api/r@k/{id}|GET|true|Dto@k"))
add("b19_python_routes", _routes("python"), _of_part(_ROUTED, "/p@k/{id}|GET|true|-"))
add("b20_go_routes", _routes("go"), _of_part(_ROUTED, "/g@k/x|GET|false|-"))
add("b21_api_calls", lambda m: extract.calls(_files(m, "typescript")), _of_part("url method file_path line expected_type", "/u@k/x|GET|src/m@k.tsx|9|Dto@k"))
add("a7_packages", lambda m: documents.packages(_files(m, "package", "project")), _of_part("name version source service", "lib@k|1|npm|main", "dev@k|@s|npm-dev|main", "Nu@k|@s|nuget|main"))


# A: declared documents; files of some twenty items each are written out of table rows and read by the loaders
def _yaml(rows: DataFrame, path: str, item: str, head: str = "''", tail: str = "''") -> DataFrame:
    """files(path, content) of YAML lists; all arguments are SQL over ``rows``, head and tail the same for all rows of a path."""
    lists = rows.select(F.expr(path).alias("path"), F.expr(item).alias("item"), F.expr(head).alias("head"), F.expr(tail).alias("tail")).groupBy("path", "head", "tail").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return lists.select("path", F.concat("head", F.array_join("items", "\n"), "tail").alias("content"))


def _block_files(m: Model) -> DataFrame:
    item = """concat('- id: ', if(c_custkey % 7 = 0, 'C_', 'c-'), c_custkey, "\n  name: '", c_name, "'\n  level: ", 1 + c_custkey % 4,
              if(c_custkey % 2 = 1, concat("\n  code_paths:\n  - 'src/", lower(c_mktsegment), "/**'\n  - lib/", c_custkey), ''), if(c_custkey % 3 = 0, "\n  service: svc", ''))"""
    return _yaml(m.customer, "concat('arch/', c_custkey div 20, '.yaml')", item, r"'# what there is\nschema_version: 1\nblocks:\n'", r"if((c_custkey div 20) % 10 = 3, '\n  open: [', '')")


def _rejected(got: declared.Loaded) -> DataFrame:
    return got.rejected.select("path", "id", "reason")


_AT = "'arch/' || (c_custkey // 20) || '.yaml' AS path"
add("a8_blocks", lambda m: declared.blocks(_block_files(m)).rows.select("path", "id", "name", "level", F.array_join("code_paths", "|").alias("code_paths"), "service"), f"SELECT {_AT}, 'c-' || c_custkey AS id, c_name AS name, CAST(1 + c_custkey % 4 AS INT) AS level, CASE WHEN c_custkey % 2 = 1 THEN 'src/' || lower(c_mktsegment) || '/**|lib/' || c_custkey ELSE '' END AS code_paths, CASE WHEN c_custkey % 3 = 0 THEN 'svc' ELSE 'main' END AS service FROM customer WHERE (c_custkey // 20) % 10 <> 3 AND c_custkey % 7 <> 0 AND c_custkey % 4 <> 3")
add("a8_rejected", lambda m: _rejected(declared.blocks(_block_files(m))), f"SELECT {_AT}, CASE WHEN c_custkey % 7 = 0 THEN 'C_' ELSE 'c-' END || c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'bad block id' ELSE 'bad level' END AS reason FROM customer WHERE (c_custkey // 20) % 10 <> 3 AND (c_custkey % 7 = 0 OR c_custkey % 4 = 3) UNION ALL SELECT DISTINCT {_AT}, CAST(NULL AS VARCHAR), 'not readable' FROM customer WHERE (c_custkey // 20) % 10 = 3")


def _scenario_files(m: Model) -> DataFrame:
    item = """concat(if(p_partkey % 6 = 0, '- id: qs-', '- id: QS-'), p_partkey, "\n  name: '", p_name, "'\n  category: ", lower(p_type), if(p_size % 2 = 0, "\n  priority: must", ''), if(p_size % 3 = 0, concat("\n  linked_code: ['", p_brand, "', b]"), ''))"""
    return _yaml(m.part, "concat('quality/', p_partkey div 25, '.yaml')", item, r"'scenarios:\n'")


add("a9_scenarios", lambda m: declared.scenarios(_scenario_files(m)).rows.select("id", "name", "category", "priority", "verification", "status", F.array_join("linked_code", "|").alias("linked_code")), "SELECT 'QS-' || p_partkey AS id, p_name AS name, lower(p_type) AS category, CASE WHEN p_size % 2 = 0 THEN 'must' ELSE 'should' END AS priority, 'manual' AS verification, 'untested' AS status, CASE WHEN p_size % 3 = 0 THEN p_brand || '|b' ELSE '' END AS linked_code FROM part WHERE p_partkey % 6 <> 0")


def _task_files(m: Model) -> DataFrame:
    item = """concat('- id: task-', o_orderkey, "\n  title: '", o_orderpriority, "'", if(o_orderstatus = 'F', "\n  status: done", ''), if(o_custkey % 2 = 0, concat("\n  building_block: b-", o_custkey % 8), ''))"""
    return _yaml(m.orders, "concat('tasks/', o_orderkey div 30, '.yaml')", item, r"concat('phase_id: phase-', (o_orderkey div 30) % 5, if((o_orderkey div 30) % 9 = 4, '\ntasks: none\nrest:\n', '\ntasks:\n'))")


add("a10_phases", lambda m: declared.phases(_yaml(m.nation, "concat('phases/', n_regionkey, '.yaml')", """concat('- id: phase-', n_nationkey, "\n  name: '", n_name, "'\n  phase_number: ", n_nationkey, if(n_nationkey % 2 = 0, "\n  status: complete", ''))""", r"'phases:\n'")).select("id", "name", "phase_number", "status"), "SELECT 'phase-' || n_nationkey AS id, n_name AS name, n_nationkey AS phase_number, CASE WHEN n_nationkey % 2 = 0 THEN 'complete' ELSE 'planned' END AS status FROM nation")
add("a10_tasks", lambda m: declared.tasks(_task_files(m)).rows.select("id", "phase_id", "title", "status", "block_id"), "SELECT 'task-' || o_orderkey AS id, 'phase-' || ((o_orderkey // 30) % 5) AS phase_id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END AS status, CASE WHEN o_custkey % 2 = 0 THEN 'b-' || (o_custkey % 8) END AS block_id FROM orders WHERE (o_orderkey // 30) % 9 <> 4")
add("a10_warnings", lambda m: _rejected(declared.tasks(_task_files(m))), "SELECT DISTINCT 'tasks/' || (o_orderkey // 30) || '.yaml' AS path, CAST(NULL AS VARCHAR) AS id, 'no list of tasks' AS reason FROM orders WHERE (o_orderkey // 30) % 9 = 4")
add("a22_status_writeback", lambda m: declared.tasks(declared.with_statuses(_task_files(m), m.orders.filter("o_custkey % 3 = 0").select(F.concat(F.lit("task-"), "o_orderkey").alias("id"), F.lit("blocked").alias("status")), "tasks")).rows.select("path", "id", "phase_id", "title", "status"), "SELECT 'tasks/' || (o_orderkey // 30) || '.yaml' AS path, 'task-' || o_orderkey AS id, 'phase-' || ((o_orderkey // 30) % 5) AS phase_id, o_orderpriority AS title, CASE WHEN o_custkey % 3 = 0 THEN 'blocked' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END AS status FROM orders WHERE (o_orderkey // 30) % 9 <> 4")


def _decision_files(m: Model) -> DataFrame:
    fields = r"""concat('---\nid: ', lpad(doc_id % 1000, 3, '0'), '-doc-', doc_id, "\ntitle: 'Of ", coalesce(replace(source, "'", "''"), ''), if(doc_id % 2 = 0, "'\naffected_files: [a/x.ts, 'b c/y.ts']\n---\n\n", "'\n---\n"), coalesce(text, ''), ' \n')"""
    return m.documents.select(F.expr("concat('adr/', doc_id, '.md')").alias("path"), F.expr(f"if(doc_id % 20 = 0, coalesce(text, ''), {fields})").alias("content"))


_TRIMMED = "sha256(trim(coalesce(text, ''), chr(32) || chr(9) || chr(13) || chr(10)))"
add("a11_decisions", lambda m: declared.decisions(_decision_files(m)).rows.select("path", "decision_id", "title", "status", F.sha2("text", 256).alias("body"), F.array_join("affected_files", "|").alias("files")), f"SELECT 'adr/' || doc_id || '.md' AS path, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '-doc-' || doc_id AS decision_id, 'Of ' || coalesce(source, '') AS title, 'proposed' AS status, {_TRIMMED} AS body, CASE WHEN doc_id % 2 = 0 THEN 'a/x.ts|b c/y.ts' ELSE '' END AS files FROM documents WHERE doc_id % 20 <> 0")
add("s28_front_matter", lambda m: _decision_files(m).withColumn("m", declared.front_matter(F.col("content"))).select("path", F.substring_index("m.fields", "\n", 1).alias("first"), F.sha2("m.body", 256).alias("body")), "SELECT 'adr/' || doc_id || '.md' AS path, CASE WHEN doc_id % 20 <> 0 THEN 'id: ' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '-doc-' || doc_id END AS first, sha256(CASE WHEN doc_id % 20 = 0 THEN coalesce(text, '') ELSE CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END || coalesce(text, '') || ' ' || chr(10) END) AS body FROM documents")
add("a24_proposal_files", lambda m: declared.blocks(declared.blocks_files(m.blocks.selectExpr("concat(coalesce(parent_id, 'root'), '.yaml') as path", "id", "level", "parent_id"))).rows.select("path", "id", "level", "parent_id", "service"), "SELECT coalesce(parent_id, 'root') || '.yaml' AS path, id, level, parent_id, 'main' AS service FROM blocks")
add("a26_roles", lambda m: declared.roles(m.supplier.selectExpr("concat('roles/', s_suppkey, '.md') as path", r"""concat('---\nrole_id: ', if(s_suppkey % 9 = 0, 'Role ', 'role-'), s_suppkey, "\nname: '", s_name, "'", if(s_suppkey % 2 = 0, '\nfocus: [security, cost]', ''), '\n---\n\nKeep to ', s_nationkey, '.\n') as content""")).rows.select("role_id", "name", F.array_join("focus", "|").alias("focus"), "instructions"), "SELECT 'role-' || s_suppkey AS role_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'security|cost' ELSE '' END AS focus, 'Keep to ' || s_nationkey || '.' AS instructions FROM supplier WHERE s_suppkey % 9 <> 0")
_BAR = """'<td><div style="background:#48c;height:1em;width:' || CAST(round(100.0 * n / max(n) OVER ()) AS INT) || 'px"></div></td></tr>'"""
add("a21_report_lines", lambda m: sinks.html_lines("Use & cost", {"By tool": m.activity.groupBy("tool_name").agg(F.count("*").alias("n")).orderBy("tool_name")}), f"""SELECT '<tr><td>' || tool_name || '</td><td>' || n || '</td>' || {_BAR} AS value FROM (SELECT tool_name, count(*) AS n FROM activity GROUP BY tool_name)
    UNION ALL SELECT '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Use &amp; cost</title></head><body><h1>Use &amp; cost</h1>' UNION ALL SELECT '<h2>By tool</h2><table><tr><th>tool_name</th><th>n</th><th></th></tr>' UNION ALL SELECT '</table>' UNION ALL SELECT '</body></html>'""")
