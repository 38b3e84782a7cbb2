"""The data model as views over the test tables.

Each relation is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a table or
another relation. So the queries and their SQL start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from archgraph.shared import deal, forget, settle, tasks_for

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

RELATIONS = {
    "symbols": """
        SELECT file_path || '::' || name || '#' || kind AS id, file_path, name, kind, sym_key, is_exported, is_async, start_line, end_line, service, language, is_client
        FROM (SELECT lower(p_type) || '/' || p_brand || '/f' || (p_partkey % 7) || '.ts' AS file_path, replace(p_name, ' ', '_') || '_' || p_partkey AS name,
                     CASE p_size % 10 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'type' WHEN 3 THEN 'constant' WHEN 4 THEN 'interface' WHEN 5 THEN 'enum' WHEN 6 THEN 'variable' WHEN 7 THEN 'component' WHEN 8 THEN 'hook' ELSE 'context' END AS kind,
                     p_partkey AS sym_key, p_size % 2 = 0 AS is_exported, p_size % 3 = 0 AS is_async, p_partkey % 500 + 1 AS start_line, p_partkey % 500 + 1 + p_size AS end_line,
                     'svc' || (p_partkey % 3) AS service, CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'csharp' END AS language, p_partkey % 5 < 2 AS is_client
              FROM {part}) p""",
    "components": "SELECT id, file_path, is_client FROM {symbols} WHERE kind IN ('component', 'function', 'hook')",
    "edges": """
        SELECT DISTINCT s.id AS source, t.id AS target,
               CASE b.l_returnflag || b.l_linestatus WHEN 'AF' THEN 'imports' WHEN 'RF' THEN 'calls' WHEN 'NO' THEN 'uses_type' WHEN 'NF' THEN 'renders' WHEN 'AO' THEN 'extends' ELSE 'implements' END AS kind
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey JOIN {symbols} s ON s.sym_key = a.l_partkey JOIN {symbols} t ON t.sym_key = b.l_partkey
        WHERE a.l_linenumber = 1 AND b.l_linenumber > 1""",
    "blocks": """
        SELECT DISTINCT 'b-' || lower(p_type) AS id, 1 AS level, CASE WHEN 1 = 0 THEN '' END AS parent_id, CASE WHEN p_type < 'M' THEN DATE '2024-01-10' END AS last_synced FROM {part} WHERE p_type <> 'PROMO'
        UNION ALL SELECT DISTINCT 'b-' || lower(p_type) || '-' || lower(replace(p_brand, '#', '')), 2, 'b-' || lower(p_type), DATE '2024-01-20' FROM {part} WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#13') AND p_type <> 'PROMO'
        UNION ALL SELECT 'b-ghost', 1, NULL, NULL FROM {region} WHERE r_regionkey = 0""",
    "prefixes": """
        SELECT DISTINCT 'b-' || lower(p_type) AS block_id, lower(p_type) || '/' AS prefix FROM {part} WHERE p_type <> 'PROMO'
        UNION ALL SELECT DISTINCT 'b-' || lower(p_type) || '-' || lower(replace(p_brand, '#', '')), lower(p_type) || '/' || p_brand FROM {part} WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#13') AND p_type <> 'PROMO'
        UNION ALL SELECT 'b-ghost', 'ghost/' FROM {region} WHERE r_regionkey = 0
        UNION ALL SELECT 'b-small', 'SMALL/old/' FROM {region} WHERE r_regionkey = 0""",
    "interfaces": """
        SELECT a.id AS block_id, b.id AS target FROM {blocks} a JOIN {blocks} b ON b.id = a.parent_id
        UNION ALL SELECT a.id, b.id FROM {blocks} a JOIN {blocks} b ON a.level = 1 AND b.level = 1 AND a.id < b.id""",
    "activity": """
        SELECT event_id AS id, event_type AS tool_name, CASE WHEN event_type = 'view' THEN NULL ELSE 'm' || (user_id % 5) END AS model, CASE WHEN event_type = 'error' THEN NULL ELSE 't' || (user_id % 17) END AS task_id,
               'p' || (user_id % 4) AS phase_id, CASE WHEN event_type = 'signup' THEN NULL ELSE 'r' || (user_id % 3) END AS agent_role, k AS input_tokens, CASE WHEN event_type <> 'click' THEN k * 2 END AS output_tokens,
               CASE WHEN event_type = 'purchase' THEN k * 10 END AS explicit_tokens, COALESCE(CASE WHEN event_type = 'purchase' THEN k * 10 END, k + CASE WHEN event_type <> 'click' THEN k * 2 END) AS total_tokens,
               value AS cost_usd, k * 7 AS duration_ms, CASE WHEN event_type = 'error' THEN k % 5 END AS drift_count, ts AS recorded_at
        FROM (SELECT *, CAST(replace(replace(props, '{{"k": ', ''), '}}', '') AS BIGINT) AS k FROM {events}) e""",
    "phases": """
        SELECT 'phase-' || y AS id, y - 1991 AS phase_number, CASE WHEN y < 1994 THEN 'complete' WHEN y = 1994 THEN 'in-progress' ELSE 'planned' END AS status
        FROM (SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) o UNION ALL SELECT 'phase-none', 99, 'planned' FROM {region} WHERE r_regionkey = 0""",
    "tasks": """
        SELECT 'task-' || o_orderkey AS id, 'phase-' || year(o_orderdate) AS phase_id, CASE WHEN o_orderkey % 11 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'todo' ELSE 'in-progress' END AS status,
               CASE o_custkey % 8 WHEN 0 THEN 'b-economy' WHEN 1 THEN 'b-small' WHEN 2 THEN 'b-large' WHEN 3 THEN 'b-ghost' WHEN 4 THEN 'b-unknown' WHEN 5 THEN 'b-medium' WHEN 6 THEN 'b-standard' END AS block_id,
               lower(o_orderpriority) AS title, o_orderkey AS task_key
        FROM {orders}""",
    "task_refs": "SELECT 'task-' || l_orderkey AS task_id, CASE WHEN l_linenumber % 5 = 0 THEN 'nowhere.ts' ELSE s.file_path END AS path FROM {lineitem} l JOIN {symbols} s ON s.sym_key = l.l_partkey",
    "task_scenarios": "SELECT 'task-' || doc_id AS task_id, 'QS-' || doc_id AS scenario_id FROM {documents} WHERE doc_id % 2 = 0",
    "scenarios": """
        SELECT 'QS-' || d.doc_id AS id, CASE d.doc_id % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'reliability' WHEN 3 THEN 'accessibility' ELSE 'maintainability' END AS category,
               CASE d.doc_id % 3 WHEN 0 THEN 'must' WHEN 1 THEN 'should' ELSE 'could' END AS priority, CASE d.doc_id % 4 WHEN 0 THEN 'automatic' WHEN 1 THEN 'semi-automatic' ELSE 'manual' END AS verification,
               CASE WHEN l.quality IS NULL THEN 'untested' WHEN l.quality = 0 THEN 'failing' WHEN l.toxic = 1 THEN 'partial' ELSE 'passing' END AS status, d.doc_id % 2 = 0 AS has_tests
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "tests": "SELECT 'QS-' || n_nationkey AS scenario_id, CASE WHEN n_nationkey % 2 = 0 THEN 'economy/Brand#' || n_nationkey ELSE 'Economy/Brand#' || n_nationkey END AS prefix FROM {nation}",
    "decisions": "SELECT 'ADR-' || n_nationkey AS decision_id, CASE WHEN n_nationkey % 5 = 0 THEN 'superseded' ELSE 'accepted' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 'SMALL/Brand#' || n_nationkey ELSE 'lost/' || n_nationkey END AS prefix, lower(n_name) || ' small ring widget' || n_nationkey AS text FROM {nation}",
    "packages": "SELECT DISTINCT replace(p_name, ' ', '.') AS name, CASE WHEN p_size % 3 = 0 THEN 'npm-dev' WHEN p_size % 3 = 1 THEN 'npm' ELSE 'nuget' END AS source FROM {part}",
    "api_routes": """
        SELECT DISTINCT 'svc' || (page_id % 2) || ':/' || lang || '/' || seg AS route_id, '/' || lang || '/' || seg AS route_path, 'svc' || (page_id % 2) AS service, 'api-route' AS kind
        FROM (SELECT page_id, split_part(url, '/', 4) AS lang, CASE WHEN page_id % 9 = 0 THEN '[...rest]' WHEN page_id % 7 = 0 AND split_part(url, '/', 4) = 'fr' THEN '{{id}}' ELSE regexp_replace(split_part(url, '/', 5), '[^0-9].*$', '') END AS seg FROM {pages} WHERE page_id % 3 <> 1 AND url NOT LIKE '%//m.%') p
        WHERE lang <> 'en' OR seg <> '[...rest]'""",
    "route_methods": "SELECT route_id, 'GET' AS method FROM {api_routes} WHERE route_path NOT LIKE '%7' UNION ALL SELECT route_id, 'POST' FROM {api_routes} WHERE route_path LIKE '%5'",
    "api_calls": """
        SELECT 'call-' || page_id AS call_id, '/' || upper(split_part(url, '/', 4)) || '/' || split_part(url, '/', 5) AS url, CASE page_id % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method, 'web' || (page_id % 2) AS service, 'web' || (page_id % 2) || '/c' || (page_id % 40) || '.ts' AS file_path FROM {pages}""",
    "files_old": "SELECT source || '/' || doc_id || '.' || lang AS path, sha256_16(text) AS content_hash FROM {documents} WHERE doc_id % 7 <> 0",
    "files_new": "SELECT source || '/' || doc_id || '.' || lang AS path, CASE WHEN doc_id % 5 = 0 THEN sha256_16(text || '!') ELSE sha256_16(text) END AS content_hash FROM {documents} WHERE doc_id % 11 <> 0",
    "fields_used": "SELECT 'dto' || (c_custkey % 9) AS dto, c_mktsegment || (c_custkey % 4) AS field, CASE c_custkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' ELSE 'Thing' END AS type, c_custkey % 6 = 0 AS optional FROM {customer}",
    "fields_given": "SELECT 'dto' || (s_suppkey % 9) AS dto, CASE WHEN s_suppkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END || (c_custkey % 4) AS field, CASE s_suppkey % 3 WHEN 0 THEN 'Guid' WHEN 1 THEN 'int' ELSE 'bool' END AS type FROM {supplier} JOIN (SELECT * FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) k) c ON c_custkey % n = s_suppkey % n",
}


def _fields_given(m: Model) -> DataFrame:
    """Its text counts the suppliers inside the join, which leaves Spark a nested loop; here each side has its remainder and they meet by equality."""
    columns = RELATIONS["fields_given"].partition(" FROM ")[0]
    n = "nullif((SELECT count(*) FROM {supplier}), 0)"
    return m.spark.sql(f"{columns} FROM (SELECT *, s_suppkey % {n} AS s_rest FROM {{supplier}}) s JOIN (SELECT *, c_custkey % {n} AS c_rest FROM {{customer}}) c ON c_rest = s_rest", supplier=m.supplier, customer=m.customer)


def _edges(m: Model) -> DataFrame:
    """Each join and the repeats are dealt to tasks of bounded share, as a task sorts or hashes all of its own. Symbols are sorted, as their files' size tells nothing of their ids'.

    Edges come dealt by their source, so that a join on it needs no other shuffle of them.
    """
    text = RELATIONS["edges"].replace("SELECT DISTINCT", "SELECT /*+ MERGE(s, t) */", 1)
    rows = m.spark.sql(text, lineitem=deal(m.lineitem, m.edge_tasks, "l_orderkey"), symbols=deal(m.symbols, m.edge_tasks, "sym_key"))
    return deal(rows, m.edge_tasks, "source").distinct()


#: How Spark plans relations whose text it would plan badly at size; the rows are those of the text.
PLANS = {"edges": _edges, "fields_given": _fields_given}


class Model:
    """The relations of one data folder as DataFrames, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self._held, self._stored = spark, sf_dir, {}, set()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._held:
            if name in TABLES:
                self._held[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in PLANS:
                self._held[name] = PLANS[name](self)
            elif name in RELATIONS:
                text = re.sub(r"sha256_16\(([^()]*)\)", r"substring(sha2(\1, 256), 1, 16)", RELATIONS[name])
                needs = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
                self._held[name] = self.spark.sql(text, **{n: getattr(self, n) for n in needs})
            else:
                raise AttributeError(name)
        return self._held[name]

    def store(self, name: str) -> None:
        """Write a relation that many parts of a plan read, as a project has it stored."""
        if name not in self._stored:
            self._held[name] = settle(getattr(self, name), name)
            self._stored.add(name)

    def unstore(self, name: str) -> None:
        """Delete what :meth:`store` wrote, when no frame reads it any more; the relation is then built anew where it is asked for."""
        if name in self._stored:
            self._stored.remove(name)
            forget(self._held.pop(name))

    def dealt(self, table: str, per_task: int, key: str) -> DataFrame:
        """The rows of a table over as many tasks as it has times ``per_task`` bytes, by a hash of ``key``."""
        return getattr(self, table).repartition(tasks_for(self.spark, f"{self.dir}/{table}.parquet", per_task), key)

    @cached_property
    def edge_tasks(self) -> int:
        """Over how many tasks edges are dealt: about 4 MB of lineitem's files each, as many as shuffles have at least."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), tasks_for(self.spark, f"{self.dir}/lineitem.parquet", 1 << 22))

    @cached_property
    def files(self) -> DataFrame:
        return self.symbols.selectExpr("file_path as path").distinct()


def _duck(name: str) -> str:
    text = re.sub(r"sha256_16\(([^()]*)\)", r"substr(sha256(\1), 1, 16)", RELATIONS[name])
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("{{", "{").replace("}}", "}")


def sql(select: str, *more: str) -> str:
    """DuckDB SQL of ``select`` with the relations that it names, and those that they name, in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in RELATIONS:
            if n not in need and re.search(rf"\b{n}\b", text):
                add(_duck(n))
                need.append(n)

    add(select + " ".join(more))
    parts = [f"{n} AS ({_duck(n)})" for n in need] + list(more)
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + select
