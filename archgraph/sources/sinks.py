"""Reports and exports (A20, A21, S26): rows and the lines of documents, all written by Spark."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from archgraph.functions.text import escape_cell, escape_html


def export(activity: DataFrame, path: str, form: str) -> None:
    """Activity as json, csv or Markdown files, csv quoted where a value holds a comma, quote or line break."""
    if form == "json":
        activity.write.mode("overwrite").json(path)
    elif form == "csv":
        activity.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    elif form == "markdown":
        markdown_lines(activity).write.mode("overwrite").text(path)
    else:
        raise ValueError(form)


def markdown_lines(rows: DataFrame) -> DataFrame:
    """(value) the lines of a Markdown table of all rows, head first; partitions stand in order and none is brought to the driver."""
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    cells = F.array_join(F.array(*(escape_cell(F.col(f"`{c}`")) for c in rows.columns)), " | ")
    lines = rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"), (F.monotonically_increasing_id() + len(head)).alias("at"))
    top = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(head)], "value string, at long")
    return top.unionByName(lines).orderBy("at").select("value")


def html_lines(title: str, sections: dict[str, DataFrame]) -> DataFrame:
    """(value) the lines of a self-contained page, a table for each section, in the order of its rows.

    A last column of numbers is drawn as a bar too, relative to the section's largest; null and
    negative numbers have an empty one. Everything is escaped. A section without rows keeps its
    head. No row is brought to the driver.
    """
    spark = next(iter(sections.values())).sparkSession if sections else SparkSession.active()
    safe = lambda x: html.escape(str(x))
    fixed = [(0, -1, f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{safe(title)}</title></head><body><h1>{safe(title)}</h1>')]
    parts = []
    for i, (name, df) in enumerate(sections.items(), 1):
        fixed.append((i, -1, f"<h2>{safe(name)}</h2><table><tr>" + "".join(f"<th>{safe(c)}</th>" for c in df.columns) + "<th></th></tr>"))
        fixed.append((i, (1 << 63) - 1, "</table>"))
        cells = [F.concat(F.lit("<td>"), escape_html(F.col(f"`{c}`")), F.lit("</td>")) for c in df.columns]
        bar = F.lit("<td></td>")
        if isinstance(df.schema[-1].dataType, NumericType):
            last = F.col(f"`{df.columns[-1]}`").cast("double")
            top = df.agg(F.max(F.greatest(last, F.lit(0.0)))).scalar()
            width = F.coalesce(F.round(F.lit(100.0) * F.greatest(last, F.lit(0.0)) / F.nullif(top, F.lit(0.0))), F.lit(0.0)).cast("int")
            bar = F.when(last.isNull(), bar).otherwise(F.concat(F.lit('<td><div style="background:#48c;height:1em;width:'), width, F.lit('px"></div></td>')))
        line = F.concat(F.lit("<tr>"), *cells, bar, F.lit("</tr>"))
        parts.append(df.select(F.lit(i).alias("part"), F.monotonically_increasing_id().alias("at"), line.alias("value")))
    out = spark.createDataFrame([*fixed, (len(sections) + 1, 0, "</body></html>")], "part int, at long, value string")
    for part in parts:
        out = out.unionByName(part)
    return out.orderBy("part", "at").select("value")
