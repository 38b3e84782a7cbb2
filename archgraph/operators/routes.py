"""Route-pattern join (D13) and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import types
from archgraph.functions.paths import is_catch_all, is_param, split_segments, strip_query


def _mask(segs: str) -> Column:
    """A character for each segment, 1 for a placeholder."""
    return F.array_join(F.transform(segs, lambda s: F.when(is_param(s), "1").otherwise("0")), "")


def _literals(segs: str, *masks: str) -> Column:
    """The segments in lower case, with a star where one of the masks has a placeholder."""

    def at(s: Column, i: Column) -> Column:
        free = [F.substr(F.col(m), i + 1, F.lit(1)) == "1" for m in masks]
        return F.when(free[0] | free[1], "*").otherwise(F.lower(s))

    return F.array_join(F.transform(segs, at), "/")


def route_match_join(routes: DataFrame, calls: DataFrame, route: str = "route_path", url: str = "url") -> DataFrame:
    """Each row of ``routes`` with each row of ``calls`` whose URL it serves. Column names must differ.

    A placeholder on either side fits any segment, other segments match ignoring case, and a
    catch-all takes the rest of a URL, none included. Which places are free depends only on
    the masks of placeholders, of which few occur: for each two masks of one length the
    distinct paths and URLs join by equality on the segments that neither leaves free. The
    rows are joined to the matches by equality, too.
    """
    r = routes.select(route).distinct().withColumn("_segs", split_segments(F.col(route)))
    first = F.array_position(F.transform("_segs", is_catch_all), F.lit(True)).cast("int")
    r = r.select(route, (first > 0).alias("_open"), F.when(first > 0, F.slice("_segs", F.lit(1), first - 1)).otherwise(F.col("_segs")).alias("_head"))
    r = r.withColumn("_n", F.size("_head")).withColumn("_rm", _mask("_head"))
    u = calls.select(url).distinct().withColumn("_us", split_segments(strip_query(F.col(url))))
    shapes = r.select("_open", "_n", "_rm").distinct()
    # each URL as a whole, and cut to each length that a route has before its catch-all
    whole = u.select(url, F.lit(False).alias("_open"), "_us")
    heads = shapes.filter("_open").select("_n").distinct()
    cut = u.join(heads, F.size("_us") >= F.col("_n")).select(url, F.lit(True).alias("_open"), F.expr("slice(_us, 1, _n)").alias("_us"))
    u = whole.unionByName(cut).withColumn("_n", F.size("_us")).withColumn("_um", _mask("_us"))
    kind = ["_open", "_n"]
    both = shapes.join(u.select(*kind, "_um").distinct(), kind)
    left = r.join(both, [*kind, "_rm"]).withColumn("_key", _literals("_head", "_rm", "_um"))
    right = u.join(both, [*kind, "_um"]).withColumn("_key", _literals("_us", "_rm", "_um"))
    pairs = left.select(route, *kind, "_rm", "_um", "_key").join(right.select(url, *kind, "_rm", "_um", "_key"), [*kind, "_rm", "_um", "_key"]).select(route, url).distinct()
    return routes.join(pairs, route).join(calls, url)


def contracts(routes: DataFrame, calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Every API route with its consumer services, sorted. A route without methods takes any."""
    api = routes.filter("kind = 'api-route'")
    m = methods.groupBy("route_id").agg(F.collect_set(F.upper("method")).alias("methods"))
    hit = route_match_join(api.select("route_id", "route_path"), calls.select("url", F.upper("method").alias("method"), F.col("service").alias("consumer")))
    hit = hit.join(m, "route_id", "left").filter(F.col("methods").isNull() | F.array_contains("methods", F.col("method")))
    who = hit.groupBy("route_id").agg(F.sort_array(F.collect_set("consumer")).alias("consumers"))
    return api.join(who, "route_id", "left").select("route_id", "route_path", F.col("service").alias("producer"), F.coalesce("consumers", F.array().cast("array<string>")).alias("consumers"))


def endpoint_violations(routes: DataFrame, calls: DataFrame, methods: DataFrame) -> DataFrame:
    """H7 without fields: (call_id, url, method, problem) of calls to unknown endpoints or by methods not allowed.

    Silent without any API route.
    """
    api = routes.filter("kind = 'api-route'").select("route_id", "route_path")
    m = methods.groupBy("route_id").agg(F.collect_set(F.upper("method")).alias("methods"))
    any_api = api.limit(1).select(F.lit(1).alias("_any"))
    hit = route_match_join(api, calls.select("call_id", "url", "method")).join(m, "route_id", "left")
    ok = F.col("methods").isNull() | F.array_contains("methods", F.upper("method"))
    per = hit.groupBy("call_id").agg(F.bool_or(ok).alias("allowed"))
    out = calls.select("call_id", "url", "method").join(per, "call_id", "left").filter(~F.coalesce("allowed", F.lit(False)))
    return out.join(any_api, how="left_semi").select("call_id", "url", "method", F.when(F.col("allowed").isNull(), "unknown endpoint").otherwise("method not allowed").alias("problem"))


def field_diff(used: DataFrame, given: DataFrame) -> DataFrame:
    """(dto, field, type, problem) of consumer fields(dto, field, type, optional) against the provider's (dto, field, type).

    A field is looked for by its exact name, then ignoring case. Missing ones are a problem unless
    optional; one found otherwise may differ in casing, in type category, or in both.
    """
    used = used.distinct()
    one = given.groupBy("dto", F.col("field").alias("g_field")).agg(F.min("type").alias("g_type"))
    exact = used.join(one, (used["dto"] == one["dto"]) & (used["field"] == one["g_field"]), "left").drop(one["dto"])
    low = one.groupBy(F.col("dto").alias("l_dto"), F.lower("g_field").alias("l_low")).agg(F.min(F.struct("g_field", "g_type")).alias("l"))
    j = exact.join(low, (F.col("dto") == F.col("l_dto")) & (F.lower("field") == F.col("l_low")), "left")
    got, kind = F.coalesce("g_field", "l.g_field"), F.coalesce("g_type", "l.g_type")
    categories = F.create_map(*(F.lit(x) for kv in types.CATEGORY.items() for x in kv))
    wrong = types.conflict(categories[F.col("type")], categories[kind])
    found = F.when(got.isNull(), F.when(~F.col("optional"), F.array(F.lit("missing")))).otherwise(F.array_compact(F.array(F.when(got != F.col("field"), F.lit("casing")), F.when(wrong, F.lit("type")))))
    return j.select("dto", "field", "type", F.explode(found).alias("problem"))


def sole_producer(producers: DataFrame, keys: list[str]) -> DataFrame:
    """of producers(keys.., service, dto) the one of each key; keys with several different DTOs are left out."""
    return producers.groupBy(*keys).agg(F.min(F.struct("service", "dto")).alias("p"), F.countDistinct("dto").alias("n")).filter("n = 1").select(*keys, "p.service", "p.dto")


def contract_fields(hits: DataFrame, used: DataFrame, given: DataFrame) -> DataFrame:
    """H7: (call_id, dto, field, problem): field differences of allowed calls, hits(call_id, service, dto, expected), against the DTO of their one producer."""
    known = sole_producer(hits, ["call_id", "expected"]).withColumn("pair", F.concat_ws(" > ", "expected", "dto"))
    pairs = known.select("expected", "dto", "pair").distinct()  # each two types are compared once, however many calls they have
    # fields are few, the rows that name them are not
    used, given = used.distinct(), given.groupBy("dto", "field").agg(F.min("type").alias("type"))
    wanted = used.withColumnRenamed("dto", "expected").join(pairs.select("expected", "pair"), "expected").select(F.col("pair").alias("dto"), "field", "type", "optional")
    shown = given.join(pairs.select("dto", "pair"), "dto").select(F.col("pair").alias("dto"), "field", "type")
    found = field_diff(wanted, shown).withColumnRenamed("dto", "pair")
    # a type without any known field says nothing
    seen = shown.select(F.col("dto").alias("pair")).distinct()
    return known.select("call_id", "dto", "pair").join(found.join(seen, "pair", "left_semi"), "pair").select("call_id", "dto", "field", "problem")


def allowed_hits(routes: DataFrame, calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(call_id, service, dto, expected): calls(.., expected) that a route(.., dto) serves by their method, both types being known."""
    api = routes.filter("kind = 'api-route' and dto is not null").select("route_id", "route_path", F.col("service").alias("producer"), "dto")
    m = methods.groupBy("route_id").agg(F.collect_set(F.upper("method")).alias("methods"))
    hit = route_match_join(api, calls.filter("expected is not null").select("call_id", "url", "method", "expected")).join(m, "route_id", "left")
    return hit.filter(F.col("methods").isNull() | F.array_contains("methods", F.upper("method"))).select("call_id", F.col("producer").alias("service"), "dto", "expected")


def select_routes(routes: DataFrame, service: str | None = None, prefix: str | None = None, kind: str | None = None) -> DataFrame:
    """Routes of a service, kind and path prefix, ignoring case, by path then kind."""
    for name, value in (("service", service), ("kind", kind)):
        if value is not None:
            routes = routes.filter(F.col(name) == value)
    if prefix is not None:
        routes = routes.filter(F.lower("route_path").startswith(prefix.lower()))
    return routes.orderBy("route_path", "kind")
