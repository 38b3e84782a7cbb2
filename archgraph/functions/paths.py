"""Column functions for paths, routes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """A declared code path without its trailing glob; ``src/lib/**`` is ``src/lib/``."""
    return F.regexp_replace(path, r"\*+/?$", "")


def search_prefix(path: Column) -> Column:
    """A searched path without its trailing glob, slash and all: ``src/**/*`` is ``src/`` where :func:`normalize_path` leaves ``src/**/``."""
    return F.regexp_replace(path, r"\*\*?/?\*?$", "")


def under_prefix(path: Column, prefix: Column) -> Column:
    """S3: on a segment boundary, unlike :func:`matches_prefix`; an empty prefix holds everything."""
    bare = F.regexp_replace(F.regexp_replace(prefix, r"/?\*+/?$", ""), "/$", "")
    return (bare == "") | (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def matches_prefix(path: Column, prefix: Column) -> Column:
    """Equality or string prefix, so ``src/lib`` holds ``src/lib2/x`` too."""
    return path.startswith(prefix)


def json_strings(text: Column) -> Column:
    """An array of strings; what does not parse is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def split_segments(path: Column) -> Column:
    """Non-empty parts between slashes."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def is_param(seg: Column) -> Column:
    """A placeholder in any router's style."""
    return seg.rlike(r"^[:*]|^\{.*\}$|^<.*>$|^\[.*\]$")


def is_catch_all(seg: Column) -> Column:
    """A segment that takes the rest of a URL, none included."""
    return seg.startswith("*") | seg.startswith("{**") | seg.contains("...")


def strip_query(url: Column) -> Column:
    """A URL without query and fragment."""
    return F.regexp_extract(url, "^[^?#]*", 0)


def symbol_path(symbol_id: Column) -> Column:
    """The file in ``path::qualified#kind``."""
    return F.substring_index(symbol_id, "::", 1)


def symbol_name(symbol_id: Column) -> Column:
    """The qualified name in ``path::qualified#kind``."""
    return F.regexp_extract(symbol_id, r"^.*?::(.*)#[^#]*$", 1)


def declaring_scope(qualified: Column) -> Column:
    """The qualified name without its last part, null at the top level."""
    return F.nullif(F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1), F.lit(""))


def dir_with_slash(path: Column) -> Column:
    """Up to and including the last slash, empty at the root."""
    return F.regexp_extract(path, "^(.*/)", 1)


def directory(path: Column) -> Column:
    """Without the last part; a path without a slash stays."""
    return F.regexp_replace(path, "/[^/]+$", "")


def kebab(text: Column) -> Column:
    """Words, also those that only a capital begins, in lower case with single hyphens."""
    return _hyphened(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1-$2"))


def _hyphened(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(text: Column, size: int = 30) -> Column:
    """An id of bounded length in lower case; capitals begin no word."""
    return F.substring(_hyphened(text), 1, size)


def age_in_days(now: Column, then: Column) -> Column:
    """Whole days, at least 0, null where ``then`` is null."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)))


def content_hash(content: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def posix(path: Column) -> Column:
    """Forward slashes."""
    return F.regexp_replace(path, r"\\", "/")


def within(path: Column, root: str = "") -> Column:
    """The normalised path below ``root``, null if it leaves it.

    Forward slashes, without empty and ``.`` parts; ``..`` takes back the part before. Absolute
    paths, and such with a drive letter, count only if they lie below ``root``.
    """
    plain = F.regexp_replace(path, r"\\", "/")
    base = root.replace("\\", "/").rstrip("/")
    rooted = plain.rlike("^(/|[A-Za-z]:)")
    inside = F.startswith(plain, F.lit(base + "/")) & F.lit(base != "")
    rest = F.when(rooted & inside, F.substring(plain, len(base) + 2, 1 << 20)).when(~rooted, plain)
    step = lambda acc, p: F.when(acc.isNull(), acc).when(p != "..", F.array_append(acc, p)).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    parts = F.filter(F.split(rest, "/"), lambda p: ~p.isin("", "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def git_status(code: Column) -> Column:
    """The name of a status letter, modified for any other."""
    c = F.substring(code, 1, 1)
    return F.when(c.isin("A", "?"), "added").when(c == "D", "deleted").when(c == "R", "renamed").otherwise("modified")


def app_route(path: Column) -> Column:
    """The URL of a file in an app directory: groups dropped, ``[p]`` as ``:p``, ``[...p]`` as ``*p``, ``[[...p]]`` as ``*p?``."""
    p = F.regexp_replace(directory(F.concat(F.lit("/"), F.regexp_replace(path, r"^(src/)?app/", ""))), r"/\([^/]*\)", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\[\[\.\.\.([^\]]+)\]\]", "*$1?"), r"\[\.\.\.([^\]]+)\]", "*$1")
    p = F.regexp_replace(p, r"\[([^\]]+)\]", ":$1")
    return F.when(p == "", "/").otherwise(p)
