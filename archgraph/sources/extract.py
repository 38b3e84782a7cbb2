"""Symbols, references, routes and calls from source text.

Python is parsed by the standard ``ast`` module and so is exact. Go and TypeScript are read by
declaration patterns over lines, since no parser for them is at hand: declarations split over
several lines and those inside template strings can be missed. All extractors are narrow
``mapInPandas`` passes over files(path, content) and keep no state between files.
"""

from __future__ import annotations

import ast
import json
import os
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.functions.paths import app_route, content_hash
from archgraph.sources.csharp import csharp_routes, csharp_symbols
from archgraph.sources.source_text import Lines, closing, masked, statements

#: Folders that hold no sources of the project.
IGNORED = r"(^|/)(node_modules|\.venv|venv|__pycache__|\.git|dist|build|\.next|bin|obj|\.tox|\.mypy_cache|site-packages)(/|$)"
EXTENSION = {"python": "*.py", "go": "*.go", "typescript": "*.{ts,tsx}", "csharp": "*.cs"}
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
SYMBOL = "id string, name string, qualified_name string, kind string, file_path string, start_line long, end_line long, signature string, return_type string, doc_comment string, is_exported boolean, is_async boolean, language string"
REFERENCE = "source string, target_name string, kind string, file_path string, scope string"
ROUTE = "route_path string, methods array<string>, handler string, has_auth boolean, file_path string"


def scan(spark: SparkSession, root: str, language: str, service: str = "main") -> DataFrame:
    """A1-A4: (path, content, content_hash, language, service) of the sources under ``root``, declaration files left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", EXTENSION[language]).text(root, wholetext=True)
    path = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), "^" + re.escape(re.sub("^file:/*", "/", root).rstrip("/")) + "/", "")
    files = raw.select(path.alias("path"), F.col("value").alias("content"))
    return files.filter(~F.col("path").rlike(IGNORED) & ~F.col("path").endswith(".d.ts")).withColumns({"content_hash": content_hash(F.col("content")), "language": F.lit(language), "service": F.lit(service)})


def tsconfig_scan(spark: SparkSession, root: str, service: str = "main") -> DataFrame:
    """A4: :func:`scan` of the TypeScript files that ``tsconfig.json`` under ``root`` and the projects it refers to name, all of them without one.

    Files, include and exclude patterns count, by their folders; a project that can't be read names nothing.
    """
    named, left_out, todo, seen = [], [], [""], set()
    while todo:
        folder = todo.pop()
        file = os.path.join(root, folder) if folder.endswith(".json") else os.path.join(root, folder, "tsconfig.json")
        if file in seen:
            continue
        seen.add(file)
        try:
            with open(file, encoding="utf-8") as f:
                text = re.sub(r",(\s*[}\]])", r"\1", re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", f.read(), flags=re.S))
            config = json.loads(text)
        except (OSError, ValueError):
            continue
        base = os.path.relpath(os.path.dirname(file), root).replace(os.sep, "/")
        at = lambda p: posixpath.normpath(posixpath.join(base, p))  # noqa: E731, B023
        refers = [r["path"] for r in config.get("references", []) if isinstance(r, dict) and "path" in r]
        todo += [at(r) for r in refers]
        if "include" in config or "files" in config or not refers:
            named += [at(p) for p in config.get("files", []) + config.get("include", [] if "files" in config else ["**/*"])]
        left_out += [at(p) for p in config.get("exclude", [])]
    files = scan(spark, root, "typescript", service)
    held = lambda patterns: F.col("path").rlike("|".join(f"(?:{_glob(p)})" for p in sorted(set(patterns))))
    files = files.filter(held(named)) if named else files
    return files.filter(~held(left_out)) if left_out else files


def _glob(pattern: str) -> str:
    """The regular expression of a glob; one without a wildcard in its last part holds a folder too."""
    part = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    said = "".join(part.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|[*?]|[^*?]+", pattern.removeprefix("./")))
    return "^" + (".*" if pattern in (".", "./") else said) + ("$" if "*" in pattern.rsplit("/", 1)[-1] else "(?:/.*)?$")


def language_of(names: list[str]) -> str:
    """A5: the language of a project by the names of its files, in order of precedence."""
    has = lambda p: any(re.search(p, n) for n in names)
    for pattern, language in ((r"(^|/)ProjectSettings/ProjectVersion\.txt$", "csharp"), (r"(^|/)tsconfig\.json$", "typescript"), (r"\.(csproj|sln)$", "csharp"), (r"(^|/)go\.mod$", "go"), (r"(^|/)(pyproject\.toml|setup\.py|requirements\.txt)$", "python")):
        if has(pattern):
            return language
    return "typescript"


def _row(path: str, qualified: str, kind: str, lines: tuple[int, int], language: str, exported: bool, signature: str | None = None, returns: str | None = None, doc: str | None = None, is_async: bool = False) -> tuple:
    return (f"{path}::{qualified}#{kind}", qualified.rsplit(".", 1)[-1], qualified, kind, path, *lines, signature, returns, doc, exported, is_async, language)


def python_symbols(path: str, content: str) -> list[tuple]:
    """Classes, their methods, functions and ALL_CAPS constants; nothing nested in functions. A file that does not parse has none."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def visit(body: list[ast.stmt], scope: str) -> None:
        for n in body:
            q = f"{scope}.{n.name}" if scope and hasattr(n, "name") else getattr(n, "name", "")
            if isinstance(n, ast.ClassDef):
                out.append(_row(path, q, "class", (n.lineno, n.end_lineno), "python", not n.name.startswith("_"), ", ".join(map(ast.unparse, n.bases)) or None, None, ast.get_docstring(n)))
                visit(n.body, q)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(_row(path, q, "function", (n.lineno, n.end_lineno), "python", not n.name.startswith("_"), f"({ast.unparse(n.args)})", ast.unparse(n.returns) if n.returns else None, ast.get_docstring(n), isinstance(n, ast.AsyncFunctionDef)))
            elif not scope and isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                        out.append(_row(path, t.id, "constant", (n.lineno, n.end_lineno), "python", True))

    visit(tree.body, "")
    return out


def _last(n: ast.AST) -> str | None:
    return n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else None


def python_references(path: str, content: str) -> list[tuple]:
    """Superclasses (extends), calls and parameter types (uses_type), by the enclosing symbol; names only."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def visit(body: list[ast.stmt], scope: str) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                q = f"{scope}.{n.name}" if scope else n.name
                out.extend((f"{path}::{q}#class", b, "extends", path, scope or None) for b in map(_last, n.bases) if b)
                visit(n.body, q)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                q = f"{scope}.{n.name}" if scope else n.name
                own = f"{path}::{q}#function"
                for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]:
                    for t in ast.walk(a.annotation) if a.annotation else ():
                        if isinstance(t, (ast.Name, ast.Attribute)) and (name := _last(t)):
                            out.append((own, name, "uses_type", path, scope or None))
                for c in ast.walk(n):
                    if isinstance(c, ast.Call) and (name := _last(c.func)):
                        out.append((own, name, "calls", path, scope or None))

    visit(tree.body, "")
    return sorted(set(out), key=str)


def python_routes(path: str, content: str) -> list[tuple]:
    """Routes of decorators ``@x.get("/p")`` and ``@x.route("/p", methods=[..])``, GET by default; auth by the names in the arguments."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        for d in n.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
                continue
            verb = d.func.attr
            if verb in VERBS:
                methods = [verb.upper()]
            elif verb == "route":
                named = [k.value for k in d.keywords if k.arg == "methods"]
                methods = [e.value.upper() for e in named[0].elts if isinstance(e, ast.Constant)] if named and isinstance(named[0], (ast.List, ast.Tuple)) else ["GET"]
            else:
                continue
            said = ast.unparse(n.args) + " ".join(ast.unparse(x) for x in n.decorator_list)
            out.append((d.args[0].value, methods, n.name, bool(re.search(r"auth|current_user|login_required|jwt|token", said, re.I)), path))
    return out


_GO = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*)?(?P<func>\w+)\s*(?:\[[^\]]*\])?(?P<sig>\([^{]*)|^type\s+(?P<type>\w+)\s*(?:\[[^\]]*\])?\s+(?P<what>struct|interface)?|^(?P<decl>const|var)\s+(?P<names>\w+(?:\s*,\s*\w+)*)", re.M)


def _end_line(plain: str, at: int, lines: Lines) -> int:
    """The last line of the declaration at ``at`` of masked text: of its first braces outside of parentheses, else of its line."""
    depth, i = 0, at
    for m in re.compile(r"[(){};\n]").finditer(plain, at):
        i, c = m.start(), m[0]
        if c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif depth:
            continue
        elif c == "{":
            return lines.of(min(closing(plain, i, len(plain)), max(len(plain) - 1, 0)))
        elif c != "\n" or not re.search(r"(=>|[=,(&|?:])\s*$", plain[at:i]):
            return lines.of(i)
    return lines.of(max(len(plain) - 1, at))


def go_symbols(path: str, content: str) -> list[tuple]:
    """Functions, methods as ``Receiver.Name``, structs as classes, interfaces, types, constants and variables; exported by upper case."""
    out, plain, at = [], masked(content, "go"), Lines(content)
    for m in _GO.finditer(plain):
        lines = (at.of(m.start()), _end_line(plain, m.start(), at))
        if m["func"]:
            q = f"{m['recv']}.{m['func']}" if m["recv"] else m["func"]
            out.append(_row(path, q, "function", lines, "go", m["func"][0].isupper(), m["sig"].strip()))
        elif m["type"]:
            kind = {"struct": "class", "interface": "interface"}.get(m["what"], "type")
            out.append(_row(path, m["type"], kind, lines, "go", m["type"][0].isupper()))
        else:
            kind = "constant" if m["decl"] == "const" else "variable"
            out += [_row(path, n, kind, lines, "go", n[0].isupper()) for n in re.split(r"\s*,\s*", m["names"])]
    for m in re.finditer(r"^(const|var|type)\s*\(", plain, re.M):
        for s in re.finditer(r"^[ \t]+(\w+(?:\s*,\s*\w+)*)(?:\s*\[[^\]]*\])?[ \t]*(struct|interface)?", plain[: closing(plain, m.end() - 1, len(plain))][m.end() :], re.M):
            first = at.of(m.end() + s.start(1))
            for n in re.split(r"\s*,\s*", s[1]):
                kind = {"const": "constant", "var": "variable"}.get(m[1]) or {"struct": "class", "interface": "interface"}.get(s[2], "type")
                out.append(_row(path, n, kind, (first, first), "go", n[0].isupper()))
    return out


_TS = re.compile(r"^(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:(?P<async>async\s+)?function\s*\*?\s*(?P<func>\w+)(?P<sig>\([^{\n]*)|(?:abstract\s+)?class\s+(?P<cls>\w+)|interface\s+(?P<intf>\w+)|type\s+(?P<alias>\w+)|(?:const\s+)?enum\s+(?P<enum>\w+)|(?P<decl>const|let|var)\s+(?P<var>\w+)(?P<init>[^\n]*))", re.M)
_FIELD = re.compile(r"^\s*(?:readonly\s+)?(?P<name>[A-Za-z_$][\w$]*)(?P<opt>\?)?\s*:\s*(?P<type>[^;,\n]+)[;,]?\s*$", re.M)


def typescript_symbols(path: str, content: str) -> list[tuple]:
    """Top-level functions, classes, interfaces with their fields, types, enums and variables.

    Functions are hooks by ``use[A-Z]``, components by a capital in a file with markup; variables
    are contexts by ``createContext``, functions by an arrow, else constants or variables.
    """
    out, markup = [], path.endswith("x") and re.search(r"<[A-Za-z]", content) is not None
    plain, at = masked(content, "typescript"), Lines(content)
    for m in _TS.finditer(plain):
        lines = (at.of(m.start()), _end_line(plain, m.end("var") if m["var"] else m.end("func") if m["func"] else m.start(), at))
        shown, name = bool(m["export"]), m["func"] or m["cls"] or m["intf"] or m["alias"] or m["enum"] or m["var"]
        callable_ = m["func"] or (m["var"] and re.search(r"=\s*(async\s*)?(\([^=]*\)|\w+)\s*(:[^=]+)?=>|=\s*(memo|forwardRef)\(|=\s*React\.(memo|forwardRef)\(", m["init"]))
        if callable_:
            kind = "hook" if re.match(r"use[A-Z]", name) else "component" if name[0].isupper() and markup else "function"
        elif m["var"]:
            kind = "context" if "createContext" in m["init"] else "constant" if m["decl"] == "const" else "variable"
        else:
            kind = "class" if m["cls"] else "interface" if m["intf"] else "type" if m["alias"] else "enum"
        out.append(_row(path, name, kind, lines, "typescript", shown, (m["sig"] or "").strip() or None, None, None, bool(m["async"]) or bool(m["var"] and "async" in m["init"])))
        if m["cls"]:
            out += _class_members(path, content, name, m.end(), shown)
        if m["intf"]:
            body = "\n".join(content.split("\n")[lines[0] : max(lines[0], lines[1] - 1)])
            for f in _FIELD.finditer(body):
                line = lines[0] + 1 + body.count("\n", 0, f.start("name"))
                out.append(_row(path, f"{name}.{f['name']}", "variable", (line, line), "typescript", shown, "optional" if f["opt"] else None, f["type"].strip()))
    return out


_MEMBER = re.compile(r"\s*(?:@[\w$.]+(?:\([^()]*\))?\s*)*(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set)\s+)*)\*?\s*(?P<name>#?[A-Za-z_$][\w$]*)[?!]?\s*(?P<next>[(<:=;]|$)")


def _class_members(path: str, content: str, name: str, at: int, shown: bool) -> list[tuple]:
    """Methods and properties of the class whose head ends at ``at``; private ones are not exported."""
    plain, lines = masked(content, "typescript"), Lines(content)
    opened = plain.find("{", at - 1)
    if opened < 0:
        return []
    out, seen = [], set()
    for s in statements(plain, opened + 1, closing(plain, opened, len(plain))):
        # without semicolons several properties are in one statement
        head, begin = plain[s.start : s.head_end], s.start
        for line in re.split(r"(?<=\n)", head) if "(" not in head or "=" in head.partition("(")[0] else [head]:
            m = _MEMBER.match(line)
            if m and line.strip():
                mods, first = set(m["mods"].split()), lines.of(begin + m.start("name"))
                method = m["next"] in ("(", "<") or re.search(r"=\s*(?:async\s*)?\([^()]*\)\s*(?::[^=]+)?=>", line)
                kind, private = ("function" if method else "variable"), "private" in mods or m["name"].startswith("#")
                if (m["name"], kind) not in seen and m["name"] not in ("if", "for", "while", "return"):
                    seen.add((m["name"], kind))
                    q = f"{name}.{m['name']}"
                    last = lines.of(max(s.end - 1, begin)) if line is head or s.body >= 0 else first
                    told = re.match(r"\s*([^=;{\n]+)", line[m.end() :]) if m["next"] == ":" else None
                    out.append(_row(path, q, kind, (first, last), "typescript", shown and not private, None, told[1].strip() if told else None, None, "async" in mods))
            begin += len(line)
    return out


_CALL = re.compile(r"(?:\bfetch|\b(?P<client>[\w.]*(?:axios|api|client|http)[\w.]*)\.(?P<verb>get|post|put|patch|delete))\s*(?:<(?P<dto>[^<>()]*(?:<[^<>()]*>)?[^<>()]*)>)?\(\s*(?P<q>[\"'`])(?P<url>/[^\"'`]*)(?P=q)(?P<rest>[^;\n]*)", re.I)


def api_calls(path: str, content: str) -> list[tuple]:
    """(url, method, file_path, line, expected_type) of calls with a literal URL that starts with a slash; template holes are ``:param``."""
    out = []
    for m in _CALL.finditer(content):
        named = re.search(r"method\s*:\s*[\"'](\w+)", m["rest"])
        method = (m["verb"] or (named[1] if named else "GET")).upper()
        out.append((re.sub(r"\$\{[^}]*\}", ":param", m["url"]), method, path, content.count("\n", 0, m.start()) + 1, m["dto"]))
    return out


_GO_ROUTE = re.compile(r"(?P<var>\w+)\s*:?=\s*(?P<parent>\w+)\.Group\(\s*\"(?P<group>[^\"]*)\"|(?P<on>\w+)\.(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|Head|Options|HandleFunc|Handle)\(\s*\"(?P<path>/[^\"]*)\"\s*(?P<rest>[^\n]*)")


def go_routes(path: str, content: str) -> list[tuple]:
    """Router verbs with the prefixes of their groups; ``HandleFunc`` takes any method."""
    prefix: dict[str, str] = {}
    out = []
    for m in _GO_ROUTE.finditer(content):
        if m["group"] is not None:
            prefix[m["var"]] = prefix.get(m["parent"], "") + m["group"]
        else:
            methods = [] if m["verb"].startswith("Handle") else [m["verb"].upper()]
            out.append((prefix.get(m["on"], "") + m["path"], methods, m["rest"].strip(", )").split(",")[-1].strip() or None, bool(re.search("auth|jwt", m["rest"], re.I)), path))
    return out


SYMBOLS = {"python": python_symbols, "go": go_symbols, "typescript": typescript_symbols, "csharp": csharp_symbols}


#: Files whose rows a task holds at once.
FILES = 1000


def each(files: DataFrame, f, schema: str) -> DataFrame:
    """The rows that ``f(path, content)`` gives for each of files(path, content); rows without either give none."""
    names = [x.split(" ")[0] for x in re.split(r",\s*", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), FILES):
                part = b.iloc[i : i + FILES]
                rows = [r for p, c in zip(part["path"], part["content"], strict=True) if p is not None and c is not None for r in f(p, c)]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def symbols(files: DataFrame, language: str) -> DataFrame:
    """Symbols of files(path, content) in a language of EXTENSION; rows without path or content give none."""
    return each(files, SYMBOLS[language], SYMBOL)


def references(files: DataFrame) -> DataFrame:
    """References by name of Python files, for :func:`archgraph.operators.changes.resolve_names`."""
    return each(files, python_references, REFERENCE)


def routes(files: DataFrame, language: str) -> DataFrame:
    """Routes of Python, Go or C# files; the response type is null but for C#."""
    if language == "csharp":
        return each(files, csharp_routes, ROUTE + ", response_type string")
    return each(files, {"python": python_routes, "go": go_routes}[language], ROUTE).withColumn("response_type", F.lit(None).cast("string"))


def calls(files: DataFrame) -> DataFrame:
    """Outbound HTTP calls of TypeScript files."""
    return each(files, api_calls, "url string, method string, file_path string, line long, expected_type string")


def app_routes(files: DataFrame) -> DataFrame:
    """(path, route_path, kind, methods) of files in an app directory, by built-in functions."""
    name = F.regexp_extract("path", r"([^/]+)\.[jt]sx?$", 1)
    kind = F.when(name == "route", "api-route").when(name.isin("page", "layout", "loading", "error", "not-found", "middleware"), name)
    verbs = F.array(*(F.lit(v.upper()) for v in VERBS))
    made = F.filter(verbs, lambda v: F.rlike("content", F.concat(F.lit(r"export\s+(async\s+)?(function|const)\s+"), v, F.lit(r"\b"))))
    rows = files.filter(F.col("path").rlike(r"^(src/)?(app/|middleware\.)")).withColumn("kind", kind).filter("kind is not null")
    return rows.select("path", app_route(F.col("path")).alias("route_path"), "kind", F.when(F.col("kind") == "api-route", made).otherwise(F.array().cast("array<string>")).alias("methods"))


def snippet(content: Column, start: Column, end: Column, context: int = 2) -> Column:
    """The lines from ``context`` before start to end, 1-based, each with its number."""
    first = F.greatest(start - context, F.lit(1)).cast("int")
    lines = F.slice(F.split(content, "\n"), first, (end - first + 1).cast("int"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + first).cast("string"), F.lit(" | "), x)), "\n")
