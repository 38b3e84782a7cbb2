"""Plans and quality: phases, tasks and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions.paths import age_in_days
from archgraph.operators.prefix import prefix_pairs

DONE = ("done", "cancelled")


def scenarios(s: DataFrame, **equal) -> DataFrame:
    """C14: conjunction of the given filters."""
    for k, v in equal.items():
        if v is not None:
            s = s.filter(F.col(k) == v)
    return s


def relevant(s: DataFrame, category: str | None) -> DataFrame:
    """C17: scenarios of a category, must-have ones for a general action."""
    return s.filter(F.col("priority") == "must") if category is None else s.filter(F.col("category") == category)


def in_focus(s: DataFrame, categories: list[str]) -> DataFrame:
    """Of a role's categories, or must-have."""
    return s.filter(F.col("category").isin(*categories) | (F.col("priority") == "must"))


def phases_without_tasks(phases: DataFrame, tasks: DataFrame) -> DataFrame:
    """D11."""
    return phases.join(tasks.select("phase_id"), phases["id"] == tasks["phase_id"], "left_anti")


def orphans(tasks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tasks with a block that does not exist; those without a block are none."""
    return tasks.filter("block_id is not null").join(blocks.select(F.col("id").alias("block_id")), "block_id", "left_anti")


def phase_progress(phases: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task counts of each phase and percent done of those not cancelled, 0 without any."""
    per = tasks.groupBy("phase_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "cancelled").alias("cancelled"))
    p = phases.join(per, phases["id"] == per["phase_id"], "left").drop("phase_id").fillna(0, ["total", "done", "cancelled"])
    return p.withColumn("percent", F.coalesce(F.round(F.try_divide(F.col("done") * 100.0, F.col("total") - F.col("cancelled"))), F.lit(0.0)).cast("int"))


def pass_rate(s: DataFrame) -> DataFrame:
    """Passing of (passing + failing + partial) in percent with one decimal, null without any."""
    return s.agg(F.round(F.try_divide(F.count_if(F.col("status") == "passing") * 100.0, F.count_if(F.col("status").isin("passing", "failing", "partial"))), 1).alias("pass_rate"))


def current_phase(phases: DataFrame) -> DataFrame:
    """F8: the first one in progress, else the first one planned."""
    rank = F.when(F.col("status") == "in-progress", 0).otherwise(1)
    return phases.filter(F.col("status").isin("in-progress", "planned")).orderBy(rank, "phase_number").limit(1)


def next_phase(phases: DataFrame) -> DataFrame:
    """(id, next_id): each phase with the planned one of the next number, by an equi-join on the number."""
    n = phases.filter("status = 'planned'").select((F.col("phase_number") - 1).alias("phase_number"), F.col("id").alias("next_id"))
    return phases.select("id", "phase_number").join(n, "phase_number").select("id", "next_id")


def next_number(phases: DataFrame) -> DataFrame:
    """E26."""
    return phases.agg(F.coalesce(F.max("phase_number") + 1, F.lit(0)).alias("next_number"))


def staleness(blocks: DataFrame, now: Column) -> DataFrame:
    """(id, age): days since the last sync, null for never; order never first, then oldest."""
    return blocks.select("id", age_in_days(now, F.col("last_synced")).alias("age")).orderBy(F.col("age").desc_nulls_first(), "id")


def gate(phases: DataFrame, tasks: DataFrame, findings: DataFrame, s: DataFrame) -> DataFrame:
    """Of each phase whether it may be completed: all its tasks over, no error drift, no failing must-have."""
    t = tasks.groupBy("phase_id").agg(F.bool_and(F.col("status").isin(*DONE)).alias("tasks_ok"))
    drift = findings.agg((F.count_if(F.col("severity") == "error") == 0).alias("drift_ok"))
    quality = s.agg((F.count_if((F.col("priority") == "must") & (F.col("status") == "failing")) == 0).alias("quality_ok"))
    p = phases.select("id").join(t, F.col("id") == F.col("phase_id"), "left").select("id", F.coalesce("tasks_ok", F.lit(True)).alias("tasks_ok"))
    return p.crossJoin(drift).crossJoin(quality).withColumn("may_complete", F.col("tasks_ok") & F.col("drift_ok") & F.col("quality_ok"))  # one row each


def infer(tasks: DataFrame, prefixes: DataFrame, files: DataFrame, refs: DataFrame, task_scenarios: DataFrame, s: DataFrame) -> DataFrame:
    """(id, status, inferred, rule) of open tasks that the code tells something about; the first rule wins.

    Rule 1: at least half (one of one) of the block's prefixes have files, and the task is todo.
    Rule 2: of refs(task_id, path) all exist: done; some, and the task is todo: in progress.
    Rule 3: of the existing scenarios of task_scenarios(task_id, scenario_id) one at least, and all pass: done.
    """
    open_ = tasks.filter(~F.col("status").isin(*DONE))
    used = prefix_pairs(files.select("path").distinct(), prefixes.select("prefix").distinct(), fold=True).select("prefix").distinct().withColumn("used", F.lit(1))
    cover = prefixes.join(used, "prefix", "left").groupBy("block_id").agg((F.coalesce(F.sum("used"), F.lit(0)) >= F.ceil(F.count("*") / 2)).alias("covered"))
    there = refs.join(files.select("path").distinct().withColumn("there", F.lit(1)), "path", "left").groupBy("task_id").agg(F.count("*").alias("n_refs"), F.count("there").alias("n_there"))
    passing = task_scenarios.join(s.select(F.col("id").alias("scenario_id"), F.col("status").alias("s_status")), "scenario_id").groupBy("task_id").agg(F.bool_and(F.col("s_status") == "passing").alias("all_pass"))
    t = open_.join(cover, "block_id", "left").join(there, F.col("id") == there["task_id"], "left").drop("task_id").join(passing, F.col("id") == passing["task_id"], "left").drop("task_id")
    todo = F.col("status") == "todo"
    yes = lambda c: F.coalesce(c, F.lit(False))
    rule = F.when(yes(F.col("covered")) & todo, 1).when(yes(F.col("n_refs") > 0) & yes(F.col("n_there") == F.col("n_refs")), 2).when(yes(F.col("n_there") > 0) & todo, 2).when(yes(F.col("all_pass")), 3)
    status = F.when(rule == 1, "in-progress").when((rule == 2) & (F.col("n_there") == F.col("n_refs")), "done").when(rule == 2, "in-progress").when(rule == 3, "done")
    return t.select("id", "status", status.alias("inferred"), rule.alias("rule")).filter("rule is not null")


def apply_inferred(tasks: DataFrame, inferred: DataFrame, now: Column) -> DataFrame:
    """Tasks with their new status; completed_at is set for those done now."""
    i = inferred.select("id", "inferred")
    t = tasks.join(i, "id", "left")
    return t.withColumn("completed_at", F.when(F.col("inferred") == "done", now).otherwise(F.col("completed_at"))).withColumn("status", F.coalesce("inferred", "status")).drop("inferred")


def open_questions(s: DataFrame, tests: DataFrame, phases: DataFrame, tasks: DataFrame, blocks: DataFrame, prefixes: DataFrame, findings: DataFrame, now_only: bool = True) -> DataFrame:
    """(topic, subject) in seven topics; a finding is a row, its kind the subject.

    Untested or failing scenarios by priority, scenarios without a row in tests(scenario_id), blocks
    without a prefix or, of blocks(id, description), a description, findings, and of the phase in
    progress tasks(criteria) that lack criteria and are not done, none with ``now_only`` off.
    """
    ask = lambda topic, c="id": [F.lit(topic).alias("topic"), F.col(c).cast("string").alias("subject")]
    bad = s.filter(F.col("status").isin("untested", "failing"))
    here = phases.filter("status = 'in-progress'").agg(F.min(F.struct("phase_number", "id")).alias("p")).select(F.col("p.id").alias("phase_id"))
    vague = tasks.filter("status <> 'done' and coalesce(size(criteria), 0) <= 0").join(here, "phase_id", "left_semi")
    return (
        bad.filter("priority = 'must'").select(*ask("must-have scenario"))
        .unionByName(bad.filter("priority = 'should'").select(*ask("should-have scenario")))
        .unionByName(s.join(tests.select(F.col("scenario_id").alias("id")), "id", "left_anti").select(*ask("scenario without tests")))
        .unionByName(blocks.join(prefixes.select(F.col("block_id").alias("id")), "id", "left_anti").select(*ask("block without code")))
        .unionByName(blocks.filter("trim(coalesce(description, '')) = ''").select(*ask("block without description")))
        .unionByName(findings.select(*ask("drift", "kind")))
        .unionByName((vague if now_only else vague.limit(0)).select(*ask("task without criteria")))
    )


#: Words in a task's title that call for a decision record.
ARCHITECTURAL = ["auth", "database", "middleware", "validation", "caching", "dependency injection", "error handling"]


def decision_reminder(tasks: DataFrame, decisions: DataFrame, words: list[str] = ARCHITECTURAL) -> DataFrame:
    """Tasks whose title contains one of the words, ignoring case; none where more than one decision is recorded."""
    few = decisions.agg(F.count("*").alias("_n")).filter("_n <= 1")  # one row or none
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("title"), w))
    return tasks.filter(hit).join(F.broadcast(few.select(F.lit(1))), how="left_semi")


def status_counts(tasks: DataFrame, s: DataFrame) -> DataFrame:
    """Tasks done, in progress and blocked, scenarios passing, failing and untested, in one row."""
    t = tasks.agg(*[F.count_if(F.col("status") == x).alias(x.replace("-", "_")) for x in ("done", "in-progress", "blocked")])
    return t.crossJoin(s.agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("passing", "failing", "untested")]))


def complete_phase(phases: DataFrame, gates: DataFrame, phase_id: str, now: Column) -> DataFrame:
    """phases(id, phase_number, status, started_at, completed_at) with the phase complete and the planned one of the next number begun, if its gate is open.

    A new snapshot; it replaces the old one as a whole. ``gates`` is of :func:`gate`.
    """
    this = phases.agg(F.max(F.when(F.col("id") == phase_id, F.col("phase_number") + 1)).alias("_next"))
    open_ = gates.agg(F.bool_or((F.col("id") == phase_id) & F.col("may_complete")).alias("_open"))
    p = phases.crossJoin(this).crossJoin(open_)  # one row each
    ends = F.coalesce("_open", F.lit(False)) & (F.col("id") == phase_id)
    starts = F.coalesce("_open", F.lit(False)) & (F.col("phase_number") == F.col("_next")) & (F.col("status") == "planned")
    return p.select("id", "phase_number", F.when(ends, "complete").when(starts, "in-progress").otherwise(F.col("status")).alias("status"), F.when(starts, now).otherwise(F.col("started_at")).alias("started_at"), F.when(ends, now).otherwise(F.col("completed_at")).alias("completed_at"))


def linked_scenarios(s: DataFrame, tests: DataFrame) -> DataFrame:
    """Scenarios with a linked test, with these sorted."""
    linked = tests.groupBy(F.col("scenario_id").alias("id")).agg(F.sort_array(F.collect_list("prefix")).alias("linked_tests"))
    return s.join(linked, "id").filter(F.size("linked_tests") > 0)


def select_phases(phases: DataFrame, phase_id: str | None = None, status: str | None = None, include_completed: bool = False) -> DataFrame:
    """The phase of an id, else those of a status, else all that are not complete, or all."""
    if phase_id is not None:
        return phases.filter(F.col("id") == phase_id)
    if status is not None:
        return phases.filter(F.col("status") == status)
    return phases if include_completed else phases.filter("status <> 'complete'")


def testable(s: DataFrame, tests: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Scenarios with a row in tests(scenario_id): those of the ids if any are given, else those verified by machine, wholly or in part."""
    chosen = F.col("id").isin(*ids) if ids else F.col("verification").isin("automatic", "semi-automatic")
    return s.filter(chosen).join(tests.select(F.col("scenario_id").alias("id")), "id", "left_semi")
