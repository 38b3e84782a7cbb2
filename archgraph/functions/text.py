"""Column functions that make text safe for documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_html(text: Column) -> Column:
    """The five signs that HTML reads, as entities; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def escape_cell(text: Column) -> Column:
    """A cell of a Markdown table: bars escaped, line breaks as spaces; null is empty."""
    return F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
