"""Type strings of two languages made comparable.

A type is read once, into a tree; names and categories are then plain functions of the tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of wrappers, sequences, opaque results and primitives, as they occur in source code.
WRAPPERS = {"Promise", "Task", "ValueTask", "ActionResult", "Ok", "Results", "Array", "List", "IList", "IEnumerable", "ICollection", "IReadOnlyList", "IReadOnlyCollection", "Collection"}
SEQUENCES = {"Array", "List", "IList", "IEnumerable", "ICollection", "IReadOnlyList", "Collection"}
OPAQUE = {"IActionResult", "ActionResult", "object", "any", "unknown", "void", "Response", "HttpResponseMessage", "dynamic", "JsonResult"}
CATEGORY = {
    "string": "string", "String": "string", "guid": "string", "Guid": "string", "uuid": "string",
    "number": "number", "int": "number", "integer": "number", "short": "number", "byte": "number", "double": "number", "float": "number", "decimal": "number",
    "long": "bigint", "bigint": "bigint", "int64": "bigint", "ulong": "bigint",
    "boolean": "boolean", "bool": "boolean",
    "date": "date", "datetime": "date", "DateTime": "date", "DateTimeOffset": "date", "Date": "date", "DateOnly": "date",
}
#: Levels of wrapping that are looked through.
DEPTH = 12
_TOKEN = re.compile(r"[^\W\d][\w.$]*|\$[\w.$]*|\[\]|\S")
_CLOSING = {"<": ">", "(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Named:
    """A dotted name with its type arguments, None for a name without angle brackets."""

    path: str
    args: tuple | None = None

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]


@dataclass(frozen=True)
class ArrayOf:
    item: object


@dataclass(frozen=True)
class Union:
    members: tuple


#: Whatever has no name: object literals, functions, tuples, groups in parentheses.
ANONYMOUS = Named("")


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = _TOKEN.findall(text), 0

    @property
    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def union(self, ends: str):
        """Members between bars, up to one of ``ends`` or the end of the text."""
        members = []
        while self.next and self.next not in ends:
            if self.next == "|":
                self.take()
            else:
                members.append(self.term(ends))
        return Union(tuple(m for m in members if m not in (Named("null"), Named("undefined"))))

    def term(self, ends: str):
        if self.next in _CLOSING:
            self.skip()
            out = ANONYMOUS
        elif re.match(r"[^\W\d]|\$", self.next):
            out = Named(self.take())
            if self.next == "<":
                self.take()
                out = Named(out.path, self.arguments())
        else:
            self.take()
            out = ANONYMOUS
        while self.next and self.next != "|" and self.next not in ends:
            mark = self.next
            if mark == "[]":
                self.take()
                out = ArrayOf(out)
            elif mark == "?":
                self.take()
            else:  # an arrow, an operator or a second name: no type that has a name
                self.skip()
                out = ANONYMOUS
        return out

    def arguments(self) -> tuple:
        found = []
        while self.next and self.next != ">":
            found.append(self.union(",>"))
            if self.next == ",":
                self.take()
        if self.next:
            self.take()
        return tuple(a for a in found if a.members)

    def skip(self) -> None:
        """One token, or all up to the bracket that closes it."""
        end = _CLOSING.get(self.take())
        while end and self.next:
            if self.next == end:
                self.take()
                return
            self.skip()


def parse(text: str | None):
    """The tree of a type string."""
    return _Reader(text or "").union("")


def _only(tree):
    """The one member of a union; None for several or none."""
    return tree if not isinstance(tree, Union) else tree.members[0] if len(tree.members) == 1 else None


def _name_in(tree, depth: int) -> str | None:
    inner = _only(tree)
    if inner is None:
        return None
    if isinstance(inner, ArrayOf):
        return _name_in(inner.item, depth - 1) if depth else None
    if inner.args and inner.name in WRAPPERS and depth:
        return _name_in(inner.args[-1], depth - 1)
    known = inner.name in OPAQUE or inner.name.lower() in CATEGORY
    return inner.name if inner.name and not known else None


def type_name(text: str | None) -> str | None:
    """The innermost user-defined name of a type, None for primitives, opaque and nameless types."""
    return _name_in(parse(text), DEPTH)


def _category_of(tree) -> str | None:
    inner = _only(tree)
    if inner is None:
        return None
    if isinstance(inner, ArrayOf) or (inner.args is not None and inner.path in SEQUENCES):
        item = inner.item if isinstance(inner, ArrayOf) else inner.args[-1] if inner.args else Union(())
        return f"array<{_category_of(item) or '?'}>"
    return CATEGORY.get(inner.name, CATEGORY.get(inner.name.lower()))


def type_category(text: str | None) -> str | None:
    """String, number, bigint, boolean, date or array<..>, None where unknown."""
    return _category_of(parse(text))


def _per_value(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {x: f(x) for x in s.dropna().unique()}  # a column of types has few different ones
        return s.map(known).astype(object).where(s.notna(), None)

    return run


def unwrapped(col: Column) -> Column:
    """S10 as a column."""
    return _per_value(type_name)(col)


def category(col: Column) -> Column:
    """S11 as a column."""
    return _per_value(type_category)(col)


def conflict(a: Column, b: Column) -> Column:
    """Both categories are known and differ."""
    return F.coalesce(a != b, F.lit(False))
