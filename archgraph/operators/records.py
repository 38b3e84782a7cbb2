"""New snapshots of tasks, phases and scenarios after one change (H31). A snapshot replaces the old one as a whole.

A change that may not be made raises :class:`Refused` and leaves everything as it was. What is
checked are lookups of one id, each a small aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A change that would break a reference or a rule."""


def slug(text: str, size: int = 30) -> str:
    """S17 for one text."""
    return re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9]+", "-", text.lower()))[:size]


def _one(df: DataFrame, item_id: str, what: str):
    row = df.filter(F.col("id") == item_id).first()
    if row is None:
        raise Refused(f"no {what} {item_id}")
    return row


def _with(df: DataFrame, **values) -> DataFrame:
    """``df`` with a row more; columns that are not given are null."""
    cols = [(v if isinstance(v := values.get(f.name), Column) else F.lit(v)).cast(f.dataType).alias(f.name) for f in df.schema]
    return df.unionByName(df.sparkSession.range(1).select(*cols))


def create_task(tasks: DataFrame, phases: DataFrame, blocks: DataFrame, phase_id: str, title: str, now: Column, block_id: str | None = None, scenarios: list[str] = (), criteria: list[str] = ()) -> tuple[DataFrame, str]:
    """(tasks, id) with a task to do; its id holds the phase's number, its own among the phase's and a slug of the title."""
    phase = _one(phases, phase_id, "phase")
    if block_id is not None:
        _one(blocks, block_id, "block")
    number = tasks.filter(F.col("phase_id") == phase_id).count() + 1
    task_id = f"task-{phase['phase_number']}.{number}-{slug(title)}"
    listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return _with(tasks, id=task_id, phase_id=phase_id, title=title, status="todo", block_id=block_id, scenarios=listed(scenarios), criteria=listed(criteria), created_at=now), task_id


def update_task(tasks: DataFrame, task_id: str, status: str, now: Column) -> DataFrame:
    """Tasks with a new status of one; completed_at is set for done and cleared for any other."""
    _one(tasks, task_id, "task")
    this = F.col("id") == task_id
    at = now if status == "done" else F.lit(None)
    return tasks.withColumns({"status": F.when(this, status).otherwise(F.col("status")), "completed_at": F.when(this, at).otherwise(F.col("completed_at"))})


def delete_tasks(tasks: DataFrame, ids: list[str]) -> tuple[DataFrame, list[str]]:
    """(tasks, unknown ids) without the tasks of these ids."""
    known = {r["id"] for r in tasks.filter(F.col("id").isin(*ids)).select("id").collect()} if ids else set()
    return (tasks.filter(~F.col("id").isin(*ids)) if ids else tasks), [i for i in ids if i not in known]


def create_phase(phases: DataFrame, name: str, number: int | None = None, description: str | None = None) -> tuple[DataFrame, str]:
    """(phases, id) with a planned phase; its number is the next one, and no other phase may have it."""
    most = phases.agg(F.max("phase_number").alias("n")).first()["n"]
    number = (-1 if most is None else most) + 1 if number is None else number
    taken = phases.filter(F.col("phase_number") == number).first()
    if taken is not None:
        raise Refused(f"phase number {number} is {taken['id']}")
    phase_id = f"phase-{number}-{slug(name) or 'unnamed'}"
    return _with(phases, id=phase_id, name=name, phase_number=number, status="planned", description=description), phase_id


def delete_phase(phases: DataFrame, tasks: DataFrame, phase_id: str) -> tuple[DataFrame, DataFrame]:
    """(phases, tasks) without a planned phase and its tasks."""
    if (status := _one(phases, phase_id, "phase")["status"]) != "planned":
        raise Refused(f"phase {phase_id} is {status}")
    return phases.filter(F.col("id") != phase_id), tasks.filter(~F.col("phase_id").eqNullSafe(F.lit(phase_id)))


def update_scenario(scenarios: DataFrame, scenario_id: str, status: str, now: Column, linked_tests: list[str] | None = None) -> DataFrame:
    """Scenarios with a new status of one, and its linked tests if given; a manual one is then semi-automatic."""
    _one(scenarios, scenario_id, "scenario")
    this = F.col("id") == scenario_id
    new = {"status": F.when(this, status).otherwise(F.col("status")), "last_checked": F.when(this, now).otherwise(F.col("last_checked"))}
    if linked_tests is not None:
        new["linked_tests"] = F.when(this, F.array(*map(F.lit, linked_tests)).cast("array<string>")).otherwise(F.col("linked_tests"))
        new["verification"] = F.when(this & (F.col("verification") == "manual"), "semi-automatic").otherwise(F.col("verification"))
    return scenarios.withColumns(new)
