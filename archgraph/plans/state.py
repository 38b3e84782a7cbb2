"""The index of a project as stored tables.

Symbols, edges and components lie in one folder for each version, table and (service, language). A
commit writes only the scopes that it touches, under a new version, then a manifest that says where
every scope is, and moves that manifest to its name last. Readers follow the newest manifest, so a
job that dies on the way changes nothing, and running it again gives what one run would have given.
"""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archgraph.operators.changes import delete_scope
from archgraph.shared import forget, path_of, release, settle

SCOPE = ("service", "language")


class ProjectState:
    """Tables with the columns service and language below ``root``, any folder that Spark's readers reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # manifests: {"tables": {table: {"schema": json, "scopes": {"service=..../language=....": version}}}}

    def version(self) -> int:
        """Of the newest manifest, 0 without any."""
        fs, p = path_of(self.spark, f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self) -> dict:
        v = self.version()
        if not v:
            return {"tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{v}", wholetext=True).first()[0])  # a line for each scope

    def read(self, table: str, scopes: list[str] | None = None) -> DataFrame | None:
        """The rows of a table, or of some of its scopes; None if it was never written."""
        found = self.manifest()["tables"].get(table)
        if found is None:
            return None
        schema = StructType.fromJson(found["schema"])
        at = [f"{self.root}/{table}/v={v}/{s}" for s, v in sorted(found["scopes"].items()) if scopes is None or s in scopes]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*at).select(*schema.names)

    def commit(self, tables: dict[str, DataFrame], emptied: dict[str, set[str]] | None = None) -> int:
        """Replace, in each table, the scopes that its rows are in and those of ``emptied``; the others stay. Returns the version.

        What one table's rows were shuffled to goes before the next is written.
        """
        new, old = self.version() + 1, self.manifest()
        fs, _ = path_of(self.spark, self.root)
        for table, rows in tables.items():
            path = f"{self.root}/{table}/v={new}"
            release(self.spark)
            rows.write.mode("overwrite").partitionBy(*SCOPE).parquet(path)  # what a dead job left under this version goes
            written = fs.globStatus(path_of(self.spark, f"{path}/service=*/language=*")[1]) or []
            made = {f"{f.getPath().getParent().getName()}/{f.getPath().getName()}" for f in written}
            known = old["tables"].setdefault(table, {"scopes": {}})
            known["schema"] = rows.schema.jsonValue()
            gone = (emptied or {}).get(table, set())
            known["scopes"] = {s: v for s, v in known["scopes"].items() if s not in gone} | dict.fromkeys(made, new)
        self._point(new, old)
        return new

    def _point(self, version: int, manifest: dict) -> None:
        """The one step that readers see: a rename."""
        text, staged = json.dumps(manifest, indent=0), f"{self.root}/manifests/_{version}"
        fs, p = path_of(self.spark, staged)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = path_of(self.spark, f"{self.root}/manifests/{version}")[1]
        if fs.exists(target) or not fs.rename(p, target):
            raise RuntimeError(f"version {version} was written by another job")

    def vacuum(self) -> None:
        """Delete what the newest manifest does not name."""
        fs, _ = path_of(self.spark, self.root)
        tables, newest = self.manifest()["tables"], self.version()
        for f in fs.globStatus(path_of(self.spark, f"{self.root}/*/v=*/service=*/language=*")[1]) or []:
            p = f.getPath()
            scope, version, table = f"{p.getParent().getName()}/{p.getName()}", p.getParent().getParent().getName()[2:], p.getParent().getParent().getParent().getName()
            if tables.get(table, {"scopes": {}})["scopes"].get(scope) != int(version):
                fs.delete(p, True)
        for f in fs.listStatus(path_of(self.spark, f"{self.root}/manifests")[1]):
            if f.getPath().getName() != str(newest):
                fs.delete(f.getPath(), False)


def scopes_of(df: DataFrame) -> set[str]:
    """Folder names of the scopes that rows are in; services and languages are declared and few."""
    return {f"service={_escaped(r['service'])}/language={_escaped(r['language'])}" for r in df.select(*SCOPE).distinct().collect()}


def _escaped(value: str | None) -> str:
    """As Spark names the folder of a partition value."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(c if c not in '"#%\'*/:=?\\{[]^\x7f' and ord(c) >= 32 else f"%{ord(c):02X}" for c in value)


def scope_values(scope: str) -> tuple[str | None, ...]:
    """(service, language) of a folder name."""
    return tuple(None if (v := part.split("=", 1)[1]) == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for part in scope.split("/"))


def apply_index(state: ProjectState, files: DataFrame, symbols: DataFrame, edges: DataFrame, components: DataFrame) -> int:
    """Bring an index of changed files into the state: A17, A18 and G6 in one commit.

    ``files(file_path, service, language)`` are all files that were read again or removed.
    ``symbols``, ``edges`` and ``components`` are what they hold now, an edge being of its source's
    file; all have service and language. Old symbols and components of these files go, and so do
    their outgoing edges and edges of any scope to symbols that are no more. Of new symbols with
    one id, and of new edges with the same ends and kind, one stays. Only scopes with a change are
    written. Repeating the call changes nothing. Joins on ids sort: both sides grow with the
    project, and what a broadcast would send to the driver with them. Each join of edges is written
    before the next one, so that one shuffle of them at a time stands on disk.
    """
    old = {t: state.read(t) for t in ("symbols", "edges", "components")}
    fresh = {"symbols": symbols.dropDuplicates(["id"]), "edges": edges.dropDuplicates(["source", "target", "kind"]), "components": components.dropDuplicates(["id"])}
    if old["symbols"] is None:
        return state.commit(fresh)
    touched = scopes_of(files) | scopes_of(symbols)
    gone = old["symbols"].join(files, ["file_path", *SCOPE], "left_semi").select("id").hint("merge")
    lost = gone.join(fresh["symbols"].select("id").hint("merge"), "id", "left_anti").hint("merge")
    hit = old["edges"].join(lost.withColumnRenamed("id", "target").hint("merge"), "target", "left_semi")
    scopes = {"symbols": touched, "edges": touched | scopes_of(edges) | scopes_of(hit), "components": touched | scopes_of(components)}
    staged = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        release(state.spark)
        staged.append(settle(df, name))
        return staged[-1]

    try:
        fresh["edges"] = stage(fresh["edges"], "fresh-edges")
        e = stage(_within(old["edges"], scopes["edges"]).join(gone.withColumnRenamed("id", "source").hint("merge"), "source", "left_anti"), "edges-by-source")
        e = stage(e.join(lost.withColumnRenamed("id", "target").hint("merge"), "target", "left_anti").select(*old["edges"].columns), "edges-by-target")
        forget(staged.pop(1))
        kept = {
            "symbols": old["symbols"].join(gone, "id", "left_anti").select(*old["symbols"].columns),
            "edges": e,
            "components": old["components"].join(gone, "id", "left_anti").select(*old["components"].columns),
        }
        out = {}
        for t, new in fresh.items():
            keys = {"symbols": ["id"], "edges": ["source", "target", "kind"], "components": ["id"]}[t]
            own = _within(kept[t], scopes[t])
            out[t] = own.join(new.select(*keys).hint("merge"), keys, "left_anti").select(*own.columns).unionByName(new)
        return state.commit(out, scopes)
    finally:
        for t in staged:
            forget(t)


def _within(df: DataFrame, scopes: set[str]) -> DataFrame:
    tests = [reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(SCOPE, scope_values(s), strict=True))) for s in sorted(scopes)]
    return df.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))


def delete_files(state: ProjectState, files: DataFrame) -> int:
    """G6 on the state: the symbols of ``files(file_path, service, language)``, their components and all edges at either end go."""
    old = {t: state.read(t) for t in ("symbols", "edges", "components")}
    symbols, edges, components = delete_scope(old["symbols"], old["edges"], files, old["components"])
    kept = {"symbols": symbols, "edges": edges, "components": components}
    cut = scopes_of(files)
    gone = old["symbols"].join(files, ["file_path", *SCOPE], "left_semi").select("id").hint("merge")
    ends = [old["edges"].join(gone.withColumnRenamed("id", end).hint("merge"), end, "left_semi") for end in ("source", "target")]
    scopes = {"symbols": cut, "components": cut, "edges": scopes_of(ends[0].unionByName(ends[1]))}
    return state.commit({t: _within(df.select(*old[t].columns), scopes[t]) for t, df in kept.items()}, scopes)
