"""Declared architecture from any number of YAML and Markdown files.

A table files(path, content) holds a whole file a row. Python only turns YAML text into JSON text, a
batch of files at a time; items, defaults, checks and the quarantine are built-in functions, so that
a project of a few files and a store of millions take the same path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "id string, name string, level int, parent_id string, responsibility string, code_paths array<string>, interfaces array<string>, service string"
SCENARIO = "id string, name string, category string, priority string, verification string, status string, linked_code array<string>, linked_tests array<string>, linked_blocks array<string>"
PHASE = "id string, name string, phase_number int, status string, description string"
TASK = "id string, title string, status string, building_block string, quality_scenarios array<string>, acceptance_criteria array<string>"
DECISION = "id string, title string, status string, date string, affected_blocks array<string>, affected_files array<string>"
ROLE = "role_id string, name string, description string, focus array<string>"
_ID = {"block": r"^[a-z0-9]+(-[a-z0-9]+)*$", "scenario": r"^[A-Z0-9]+-[0-9]+$", "decision": r"^[0-9]{3}-[a-z0-9-]+$", "any": r"(?s)^.+$"}
_MARKED = r"(?s)\A---\r?\n(?:(.*?)\r?\n)?---(?:\r?\n(.*))?\z"
_LOADER, _DUMPER = getattr(yaml, "CSafeLoader", yaml.SafeLoader), getattr(yaml, "CSafeDumper", yaml.SafeDumper)
#: Files whose items a task holds at once.
FILES = 200
#: White space that is cut from both ends of a body.
_BLANK = " \t\r\n"


class Rejected(ValueError):
    """A file that does not hold what it must."""


class Loaded(NamedTuple):
    """Rows with the path they come from, and the quarantine (path, id, reason)."""

    rows: DataFrame
    rejected: DataFrame


def read_files(spark: SparkSession, *paths: str, glob: str = "*") -> DataFrame:
    """files(path, content) of all files below ``paths`` whose name fits ``glob``, read by tasks."""
    return spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


_json = json.JSONEncoder(ensure_ascii=False, default=str).encode  # made once, as there are many items


def _items(text: str | None, name: str | None) -> tuple[str | None, str | None, list[str]]:
    """(error, other fields as JSON, items of the list ``name`` as JSON) of a YAML mapping; without a name all fields are one item."""
    try:
        data = yaml.load(text or "", _LOADER) or {}
        if not isinstance(data, dict):
            return "no mapping", None, []
        if name is None:
            return None, "{}", [_json(data)]
        items = data.pop(name, None) or []
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            return f"no list of {name}", None, []
        return None, _json(data), [_json(x) for x in items]
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return "not readable", None, []


_ITEMS = pa.struct([("error", pa.string()), ("head", pa.string()), ("items", pa.list_(pa.string()))])


def _read(files: DataFrame, name: str | None, content: str, *kept: str) -> DataFrame:
    """(kept.., error, head, items) of each file, by parts of FILES files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, FILES):
                part = b.slice(i, FILES)
                got = [dict(zip(("error", "head", "items"), _items(t, name), strict=True)) for t in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *pa.array(got, _ITEMS).flatten()], [*kept, "error", "head", "items"])

    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    return files.select(*kept, F.col(content).alias("_content")).mapInArrow(run, f"{schema}, error string, head string, items array<string>")


def front_matter(content: Column) -> Column:
    """Struct (fields, body) of Markdown, by built-in functions.

    Fields is the YAML between two lines of three hyphens at the start, null without such a block;
    the body then is the whole text. A null text has neither.
    """
    has = F.regexp_like(content, F.lit(_MARKED))
    part = lambda i: F.regexp_extract(content, _MARKED, i)
    return F.struct(F.when(has, part(1)).alias("fields"), F.when(has, part(2)).otherwise(content).alias("body"))


def _load(files: DataFrame, name: str | None, kind: str, schema: str, *kept: str, key: str = "id", content: str = "content") -> Loaded:
    """The items of every file as rows (path, head, kept.., fields of ``schema``), checked: a file that can't be read and an item without a good id go to the quarantine."""
    raw = _read(files, name, content, "path", *kept)
    item = raw.select("path", "head", *kept, "error", F.explode_outer("items").alias("item"))  # a file with an error has one row, without an item
    told = F.try_parse_json("item")
    text = F.schema_of_variant(F.try_variant_get(told, f"$.{key}", "variant")) == "STRING"
    item = item.withColumn("f", F.from_json("item", schema)).withColumn("bad", ~F.coalesce(text & F.col(f"f.{key}").rlike(_ID[kind]), F.lit(False)))
    rows = item.filter("not bad").select("path", "head", *kept, "item", "f.*")
    wrong = item.filter("error is not null or (item is not null and bad)")
    return Loaded(rows, wrong.select("path", F.get_json_object("item", f"$.{key}").alias("id"), F.coalesce("error", F.lit(f"bad {kind} id")).alias("reason")))


def _filled(df: DataFrame, **defaults) -> DataFrame:
    """Nulls of the named columns replaced; of a list by an empty one."""
    fill = lambda v: F.array().cast("array<string>") if v == [] else F.lit(v)
    return df.withColumns({c: F.coalesce(c, fill(v)) for c, v in defaults.items()})


def blocks(files: DataFrame) -> Loaded:
    """Building blocks of level 1 to 3 with kebab-case ids; others are rejected one by one.

    Missing lists are empty, a missing level is 1, a missing service "main". An empty or null file
    has no blocks. Ids that two files declare stay two rows, told apart by their path.
    """
    got = _load(files, "blocks", "block", BLOCK)
    level = F.get_json_object("item", "$.level")
    good = level.isNull() | level.isin("1", "2", "3")
    rows = _filled(got.rows.filter(good), level=1, code_paths=[], interfaces=[], service="main")
    return Loaded(rows.drop("head", "item"), got.rejected.unionByName(got.rows.filter(~good).select("path", "id", F.lit("bad level").alias("reason"))))


def scenarios(files: DataFrame) -> Loaded:
    """Quality scenarios; categories of any name stay. Ids are capitals or digits, a hyphen and a number."""
    got = _load(files, "scenarios", "scenario", SCENARIO)
    rows = _filled(got.rows, priority="should", verification="manual", status="untested", linked_code=[], linked_tests=[], linked_blocks=[])
    return Loaded(rows.drop("head", "item"), got.rejected)


def phases(files: DataFrame) -> DataFrame:
    """A10: the phases. One file or item that can't be read raises :class:`Rejected`, as a plan without its phases has no use."""
    got = _load(files, "phases", "any", PHASE)
    if (bad := got.rejected.first()) is not None:
        raise Rejected(f"{bad['path']}: {bad['reason']}")
    return _filled(got.rows, status="planned").drop("head", "item")


def tasks(files: DataFrame) -> Loaded:
    """A10: the tasks of each task file with the file's phase; a bad file or task is a warning, a row of the quarantine."""
    got = _load(files, "tasks", "any", TASK)
    rows = _filled(got.rows.withColumn("phase_id", F.get_json_object("head", "$.phase_id")), status="todo", quality_scenarios=[], acceptance_criteria=[])
    return Loaded(rows.select("path", "id", "phase_id", "title", "status", F.col("building_block").alias("block_id"), F.col("quality_scenarios").alias("scenarios"), F.col("acceptance_criteria").alias("criteria")), got.rejected)


def _marked(files: DataFrame) -> DataFrame:
    m = files.withColumn("m", front_matter(F.col("content")))
    return m.select("path", F.coalesce("m.fields", F.lit("")).alias("fields"), F.btrim("m.body", F.lit(_BLANK)).alias("text"))


def decisions(files: DataFrame) -> Loaded:
    """Decision records of Markdown files; the body is their text, whole and without blanks at its ends."""
    got = _load(_marked(files), None, "decision", DECISION, "text", content="fields")
    rows = _filled(got.rows, status="proposed", date="", affected_blocks=[], affected_files=[])
    return Loaded(rows.select("path", F.col("id").alias("decision_id"), "title", "status", "date", "text", "affected_blocks", "affected_files"), got.rejected)


def roles(files: DataFrame) -> Loaded:
    """Roles of Markdown files with a kebab-case id; the body is their instructions."""
    got = _load(_marked(files), None, "block", ROLE, "text", key="role_id", content="fields")
    return Loaded(_filled(got.rows, focus=[]).select("path", "role_id", "name", "description", "focus", F.col("text").alias("instructions")), got.rejected)


def blocks_files(proposal: DataFrame) -> DataFrame:
    """(path, content) of proposed blocks, a YAML document for each path in ``proposal(path, fields of a block..)``.

    Items are flow mappings in JSON, which YAML reads; they stand by id. :func:`blocks` reads them back.
    """
    fields = [c for c in proposal.columns if c != "path"]
    items = proposal.select("path", "id", F.concat(F.lit("- "), F.to_json(F.struct(*fields))).alias("item"))
    lists = items.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("id", "item"))).alias("items"))
    return lists.select("path", F.concat(F.lit("schema_version: 1\nblocks:\n"), F.array_join("items.item", "\n"), F.lit("\n")).alias("content"))


def with_statuses(files: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """(path, content, changed) of every file, the status of items of list ``name`` set by changes(id, status).

    ``changed`` counts the items that took another status; a file without any, and one that can't be
    read, keeps its text as it is. Items without a change stay as they are, their order too, comments are lost in changed
    files. The changes are matched by an equi-join on the ids that the files hold; of several for one id the
    largest status counts. Frames are returned: a caller commits them as one table, never file by file.
    """
    raw = _read(files, name, "content", "path").select("path", F.explode("items").alias("item")).select("path", F.get_json_object("item", "$.id").alias("id"), F.get_json_object("item", "$.status").alias("old"))
    wanted = changes.groupBy("id").agg(F.max("status").alias("status"))
    new = raw.join(wanted, "id").filter(~F.col("old").eqNullSafe(F.col("status"))).groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("id", "status"))).alias("set"))

    @F.pandas_udf("string")
    def rewritten(content: pd.Series, pairs: pd.Series) -> pd.Series:
        def one(text: str, pair: list | dict | None) -> str:
            if pair is None:
                return text
            data, statuses = yaml.load(text, _LOADER), dict(pair)
            for item in data[name]:
                if str(item.get("id")) in statuses:
                    item["status"] = statuses[str(item["id"])]
            return yaml.dump(data, Dumper=_DUMPER, sort_keys=False, allow_unicode=True)

        return pd.Series([one(t, p) for t, p in zip(content, pairs, strict=True)], dtype=object)

    out = files.select("path", "content").join(new, "path", "left")
    return out.select("path", rewritten("content", "set").alias("content"), F.coalesce(F.size("set"), F.lit(0)).alias("changed"))
