"""Packages of manifests and the output of an external analyser."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.functions.types import unwrapped
from archgraph.sources.extract import SYMBOL


def packages(files: DataFrame, service: str = "main") -> DataFrame:
    """(name, version, source, service) of package.json and .csproj in files(path, content), by built-in functions."""
    js = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).select(F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    one = lambda c, s: js.select(F.explode(c).alias("name", "version"), F.lit(s).alias("source"))
    ref = F.regexp_extract_all("content", F.lit(r"<PackageReference\s[^>]*>"), F.lit(0))
    cs = files.filter(F.col("path").endswith(".csproj")).select(F.explode(ref).alias("r"))
    cs = cs.select(F.regexp_extract("r", r'Include="([^"]*)"', 1).alias("name"), F.nullif(F.regexp_extract("r", r'Version="([^"]*)"', 1), F.lit("")).alias("version"), F.lit("nuget").alias("source"))
    return one("j.dependencies", "npm").unionByName(one("j.devDependencies", "npm-dev")).unionByName(cs.filter("name <> ''")).withColumn("service", F.lit(service)).distinct()


class Analysis(NamedTuple):
    symbols: DataFrame
    edges: DataFrame
    routes: DataFrame
    changed: DataFrame
    removed: DataFrame


def roslyn(spark: SparkSession, path: str) -> Analysis:
    """What an exported analyser run says, one JSON object a line.

    Symbols, edges between ids and routes with the name of their response type, null where that is not
    told or no single type; and the files that were read again or are gone. Lists that are missing are empty.
    """
    symbol = "struct<id:string,name:string,qualifiedName:string,kind:string,filePath:string,startLine:long,endLine:long,signature:string,returnType:string,docComment:string,isExported:boolean,isAsync:boolean>"
    route = "struct<routePath:string,httpMethods:array<string>,handlerSymbolId:string,hasAuth:boolean,responseType:string>"
    edge = "struct<sourceSymbolId:string,targetSymbolId:string,kind:string>"
    raw = spark.read.schema(f"symbols array<{symbol}>, dependencies array<{edge}>, routes array<{route}>, changedFiles array<string>, removedFiles array<string>").json(path)
    each = lambda c: raw.select(F.explode(c).alias("x"))
    take = lambda df, **names: df.select(*[F.col(f"x.{there}").alias(here) for here, there in names.items()])
    names = [c.split(" ")[0] for c in SYMBOL.split(", ")][:-1]
    symbols = take(each("symbols"), **{n: re.sub(r"_(\w)", lambda m: m[1].upper(), n) for n in names}).withColumn("language", F.lit("csharp"))
    routes = take(each("routes"), route_path="routePath", methods="httpMethods", handler="handlerSymbolId", has_auth="hasAuth", response="responseType")
    return Analysis(
        symbols,
        take(each("dependencies"), source="sourceSymbolId", target="targetSymbolId", kind="kind"),
        routes.withColumn("response_type", unwrapped(F.col("response"))).drop("response"),
        each("changedFiles").toDF("path"),
        each("removedFiles").toDF("path"),
    )
