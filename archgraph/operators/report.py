"""What a report shows of a project (H27), each section a small frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.operators import delivery, telemetry

#: Severities and how many findings of each, 0 where there are none.
_SEVERITIES = ("error", "warning", "info")


def drift_summary(findings: DataFrame) -> DataFrame:
    """(by, key, n): open findings in all, by severity, kind and block, (unassigned) for none."""
    sev = F.array(*map(F.lit, _SEVERITIES))
    none = findings.sparkSession.range(1).select(F.explode(sev).alias("key"), F.lit(0).cast("long").alias("n"))
    count = lambda c: findings.groupBy(c.alias("key")).agg(F.count("*").alias("n"))
    severity = count(F.col("severity")).unionByName(none).groupBy("key").agg(F.sum("n").alias("n"))
    label = lambda df, by: df.select(F.lit(by).alias("by"), "key", "n")
    total = findings.agg(F.count("*").alias("n")).select(F.lit("all").alias("key"), "n")
    return label(total, "total").unionByName(label(severity, "severity")).unionByName(label(count(F.col("kind")), "kind")).unionByName(label(count(F.coalesce("affected_block", F.lit("(unassigned)"))), "block"))


def plan_totals(phases: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: phases, complete ones, tasks, and those done, blocked and cancelled."""
    p = phases.agg(F.count("*").alias("phases"), F.count_if(F.col("status") == "complete").alias("complete"))
    return p.crossJoin(tasks.agg(F.count("*").alias("tasks"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "blocked", "cancelled")]))  # one row each


def activity_by(activity: DataFrame, column: str) -> DataFrame:
    """(key, activities, tokens, cost): rows and sums by a column, (unknown) for null, sums of nothing being 0."""
    sum_ = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero))
    key = F.date_format("recorded_at", "yyyy-MM-dd") if column == "day" else F.coalesce(F.col(column), F.lit("(unknown)"))
    return activity.groupBy(key.alias("key")).agg(F.count("*").alias("activities"), sum_("total_tokens", 0).alias("tokens"), F.round(sum_("cost_usd", 0.0), 4).alias("cost"))


def collect(blocks: DataFrame, findings: DataFrame, scenarios: DataFrame, phases: DataFrame, tasks: DataFrame, activity: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The sections by name, in order; :func:`archgraph.sources.sinks.html_lines` draws them. Sections of no rows are empty, totals are one row."""
    failing = scenarios.filter("priority = 'must' and status = 'failing'").select("id").orderBy("id")
    return {
        "Blocks by age": delivery.staleness(blocks, now),
        "Drift": drift_summary(findings).orderBy("by", F.col("n").desc(), "key"),
        "Scenarios": scenarios.groupBy("status").agg(F.count("*").alias("n")).orderBy("status"),
        "Pass rate": delivery.pass_rate(scenarios),
        "Failing must-have scenarios": failing,
        "Plan": plan_totals(phases, tasks),
        "Activity": telemetry.totals(activity),
        **{f"Activity by {c.replace('_', ' ')}": activity_by(activity, c).orderBy(*((F.col("activities").desc(), "key") if c != "day" else ("key",))) for c in ("model", "agent_role", "tool_name", "day")},
        "Quality trend": telemetry.quality_trend(activity) if "test_pass_count" in activity.columns else telemetry.recent(activity.filter("drift_count is not null")),
    }
