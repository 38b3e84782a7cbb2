"""Activity of agents: totals, groups, series and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a grouping may go by, and the column behind it.
KEYS = {"model": "model", "task": "task_id", "phase": "phase_id", "tool": "tool_name", "day": "recorded_at"}


def total_tokens(explicit: Column, given: Column, made: Column) -> Column:
    """The explicit total, else the sum of both parts, null if one is missing."""
    return F.coalesce(explicit, given + made)


def select(activity: DataFrame, since=None, until=None, **equal) -> DataFrame:
    """Conjunction of the filters that are given; both ends of the time belong to it."""
    if since is not None:
        activity = activity.filter(F.col("recorded_at") >= F.lit(since))
    if until is not None:
        activity = activity.filter(F.col("recorded_at") <= F.lit(until))
    for name, value in equal.items():
        if value is not None:
            activity = activity.filter(F.col(name) == F.lit(value))
    return activity


def totals(activity: DataFrame) -> DataFrame:
    """One row, sums of nothing being 0."""
    return activity.agg(F.count("*").alias("n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"))


def span(activity: DataFrame) -> DataFrame:
    """:func:`totals` with ``days``, the whole days between the first and the last row; null without rows."""
    days = F.floor((F.unix_timestamp("last_at") - F.unix_timestamp("first_at")) / 86400)
    return totals(activity).withColumn("days", days)


def grouped(activity: DataFrame, by: str) -> DataFrame:
    """Per key, (none) for null; sums of only nulls stay null."""
    key = F.date_format("recorded_at", "yyyy-MM-dd") if by == "day" else F.coalesce(F.col(KEYS[by]), F.lit("(none)"))
    return activity.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.round(F.avg("duration_ms")).alias("avg_ms"), F.round(F.sum("cost_usd"), 4).alias("cost"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"))


def counts(activity: DataFrame, column: str) -> DataFrame:
    """Rows per value, (unknown) for null."""
    return activity.groupBy(F.coalesce(F.col(column), F.lit("(unknown)")).alias("key")).agg(F.count("*").alias("n"))


def daily(activity: DataFrame) -> DataFrame:
    """E5: rows and cost of each day, in UTC."""
    return activity.groupBy(F.date_format("recorded_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost"))


def recent(activity: DataFrame, n: int = 50) -> DataFrame:
    """the latest rows; ties by id."""
    return activity.orderBy(F.col("recorded_at").desc(), F.col("id").desc()).limit(n)


def latest_quality(activity: DataFrame) -> DataFrame:
    """of each model the latest row with a drift count, by a partial aggregation instead of a sort."""
    r = activity.filter("drift_count is not null").groupBy("model").agg(F.max(F.struct("recorded_at", "id", "drift_count")).alias("r"))
    return r.select("model", F.col("r.recorded_at").alias("recorded_at"), F.col("r.drift_count").alias("drift_count"))


def quality_trend(activity: DataFrame, n: int = 50) -> DataFrame:
    """the latest rows with a drift count or a count of passed tests; ties by id."""
    return recent(activity.filter("drift_count is not null or test_pass_count is not null"), n)


#: Columns of an activity that :func:`record` fills where they are given.
FACTS = ("action", "task_id", "phase_id", "duration_ms", "drift_count", "drift_errors", "test_pass_count", "test_fail_count", "lint_clean", "typecheck_clean")


def record(activity: DataFrame, enabled: bool, tool_name: str, now: Column, **facts) -> DataFrame:
    """The activity with a row more, if recording is on. Facts that are no columns, or don't fit theirs, are left out, so a record never fails its caller."""
    if not enabled:
        return activity
    given = {k: v for k, v in facts.items() if k in FACTS} | {"tool_name": tool_name}
    row = activity.sparkSession.range(1).select(*[F.expr("uuid()").alias("id") if f.name == "id" and f.dataType.typeName() == "string" else (now if f.name == "recorded_at" else F.lit(given.get(f.name))).try_cast(f.dataType).alias(f.name) for f in activity.schema])
    return activity.unionByName(row)
