"""What the extractors of languages without a parser at hand share: masked text and statements.

``masked`` blanks comments and the contents of strings and keeps every offset, so patterns can't
match inside them while the original text still tells what a string says. ``statements`` cuts a
span into statements by brackets alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

_SKIPPED = {
    "typescript": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "csharp": re.compile(r"//[^\n]*|/\*.*?\*/|[$]?@[$]?\"(?:\"\"|[^\"])*\"|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'", re.S),
}


def masked(text: str, language: str) -> str:
    """``text`` with comments blank and strings empty but for their quotes, of the same length and lines."""

    def blank(m: re.Match) -> str:
        s = re.sub(r"[^\n]", " ", m[0])
        return s if m[0][0] == "/" else m[0][0] + s[1:-1] + m[0][-1]

    return _SKIPPED[language].sub(blank, text)


class Lines:
    """Line numbers, from 1, of offsets."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


class Statement(NamedTuple):
    """Offsets: the head is before the body or the end; ``body`` is inside the braces, -1 without."""

    start: int
    head_end: int
    body: int
    body_end: int
    end: int


def statements(text: str, start: int, end: int) -> Iterator[Statement]:
    """The statements of masked text in a span: up to a semicolon, or to the brace that closes the first one opened outside of parentheses."""
    begin, depth, i = start, 0, start
    for m in re.compile(r"[;{}()\[\]]").finditer(text, start, end):
        if m.start() < i:
            continue
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif depth:
            continue
        elif c == ";":
            yield Statement(begin, m.start(), -1, -1, m.end())
            begin = m.end()
        elif c == "{":
            close = closing(text, m.start(), end)
            yield Statement(begin, m.start(), m.end(), close, min(close + 1, end))
            begin = i = min(close + 1, end)
        else:
            begin = m.end()


def closing(text: str, at: int, end: int) -> int:
    """The offset of the bracket that closes the one at ``at``, ``end`` if none does."""
    open_, close = text[at], {"{": "}", "(": ")", "[": "]", "<": ">"}[text[at]]
    depth = 0
    for m in re.compile("[" + re.escape(open_ + close) + "]").finditer(text, at, end):
        depth += 1 if m[0] == open_ else -1
        if not depth:
            return m.start()
    return end


def split_top(text: str, at: str = ",") -> list[str]:
    """Parts of ``text`` between separators outside of brackets, trimmed; empty ones left out."""
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth = max(0, depth - 1)
        elif c == at and not depth:
            parts.append(text[begin:i])
            begin = i + 1
    return [p.strip() for p in [*parts, text[begin:]] if p.strip()]


def innermost(spans: list[tuple[int, int, str]], at: int) -> str | None:
    """The id of the shortest of spans(start, end, id) that holds ``at``."""
    held = [(e - s, i) for s, e, i in spans if s <= at < e]
    return min(held)[1] if held else None
