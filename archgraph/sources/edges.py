"""References of TypeScript and Go text, components, and edges between symbols.

A reference is a narrow row (source, target_name, kind, file_path, scope, module). TypeScript names
the module that a name comes from, so its edges are one equi-join on (module, name). The others
name nothing but the name, so they resolve by the nearest tier.
"""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.operators.changes import resolve_names
from archgraph.shared import settle
from archgraph.sources import extract
from archgraph.sources.csharp import csharp_references
from archgraph.sources.source_text import Lines, closing, masked, split_top

REFERENCE = extract.REFERENCE + ", module string"
COMPONENT = "id string, is_client boolean, is_server_action boolean, has_state boolean, provides array<string>, consumes array<string>, props string, file_path string"
_IMPORT = re.compile(r"^\s*import\s+(?:type\s+)?(?P<what>[^'\";]*?)\s*from\s*['\"](?P<from>[^'\"]+)['\"]", re.M)
_JS = r"(/index)?\.[jt]sx?$"
_TYPES = ("class", "interface", "type", "enum")


def _module(path: str, named: str, aliases: dict[str, str]) -> str | None:
    """The path without its ending of a module named in ``path``; null for packages."""
    for short, folder in aliases.items():
        if named.startswith(short):
            return re.sub(r"\.[jt]sx?$", "", posixpath.normpath(folder + named[len(short) :]))
    if not named.startswith("."):
        return None
    return re.sub(r"\.[jt]sx?$", "", posixpath.normpath(posixpath.join(posixpath.dirname(path), named)))


def _imports(path: str, content: str, aliases: dict[str, str]) -> dict[str, tuple[str, str]]:
    """(module, name there) by the name here; a default import is taken to have the name that it has here."""
    out = {}
    for m in _IMPORT.finditer(content):
        module = _module(path, m["from"], aliases)
        if module is None or m["what"].lstrip().startswith("*"):
            continue
        braces = re.search(r"\{([^}]*)\}", m["what"])
        for part in re.split(r"\s*,\s*", braces[1].strip()) if braces else ():
            names = re.findall(r"[\w$]+", re.sub(r"^type\s+", "", part))
            if names:
                out[names[-1]] = (module, names[0])
        default = re.match(r"\s*([\w$]+)", m["what"])
        if default:
            out[default[1]] = (module, default[1])
    return out


_SEEN = re.compile(
    r"\buseContext\s*(?:<[^<>()]*>)?\(\s*(?P<context>[\w$]+)"
    r"|(?<![\w$.)\]])<(?P<provider>[A-Za-z_$][\w$]*)\.Provider\b"
    r"|(?<![\w$.)\]])<(?P<tag>[A-Z][\w$]*)(?=[\s/>])"
    r"|(?<![\w$.])(?P<call>[A-Za-z_$][\w$]*)\s*(?:<[\w$\s,.\[\]|]*>)?\("
)
_TYPED = re.compile(r"(?:(?<=[:<|&,(])|(?<=\bas)|(?<=\bextends)|(?<==>))\s*(?P<type>[A-Z][\w$]*)")
_HERITAGE = re.compile(r"\bclass\s+(?P<name>[\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+))?[^{]*?(?:\bimplements\s+(?P<faces>[^{]+))?\{")


def typescript_references(path: str, content: str, aliases: dict[str, str] | None = None) -> list[tuple]:
    """Imports (from each top-level symbol), extends and implements, calls of plain names, types, rendered tags, provided and consumed contexts.

    A name refers to what is imported under it, else to the file itself; other names are left out
    by the join. Names shadowed inside a function are not told from the file's.
    """
    shown, lines = masked(content, "typescript"), Lines(content)
    rows = extract.typescript_symbols(path, content)
    top = [(r[5], r[6], r[0]) for r in rows if "." not in r[2]]
    every = [(r[5], r[6], r[0], r[3]) for r in rows]
    known = _imports(path, content, {"@/": "src/"} if aliases is None else aliases)
    stem = re.sub(_JS, "", path)
    ids = {r[2]: r[0] for r in rows if "." not in r[2]}
    out: set[tuple] = set()

    def say(source: str | None, name: str, kind: str) -> None:
        if source is not None:
            module, there = known.get(name, (stem, name))
            out.add((source, there, kind, path, None, module))

    def owner(at: int, members: bool = False) -> str | None:
        line = lines.of(at)
        held = [(e - s, i) for s, e, i, kind in every if s <= line <= e and (kind == "function" or "." not in i.split("::", 1)[1].split("#", 1)[0])] if members else [(e - s, i) for s, e, i in top if s <= line <= e]
        return min(held)[1] if held else None

    for _, _, source in top:
        for name in known:
            say(source, name, "imports")
    for m in _HERITAGE.finditer(shown):
        if m["base"]:
            say(ids.get(m["name"]), m["base"].rsplit(".", 1)[-1], "extends")
        for f in split_top(m["faces"] or ""):
            say(ids.get(m["name"]), re.match(r"[\w$.]*", f)[0].rsplit(".", 1)[-1], "implements")
    markup = path.endswith("x")
    for m in _SEEN.finditer(shown):
        if m["context"]:
            say(owner(m.start()), m["context"], "consumes_context")
            say(owner(m.start(), True), "useContext", "calls")
        elif m["provider"] and markup:
            say(owner(m.start()), m["provider"], "provides_context")
        elif m["tag"] and markup:
            say(owner(m.start()), m["tag"], "renders")
        elif m["call"] and not re.search(r"\bfunction\s*\*?\s*$", shown[max(0, m.start() - 20) : m.start()]):
            say(owner(m.start(), True), m["call"], "calls")
    for m in _TYPED.finditer(shown):
        say(owner(m.start("type")), m["type"], "uses_type")
    return sorted(out, key=str)


_GO_WORDS = frozenset("if for switch select go defer func return range make new len cap append copy delete panic recover print println close string byte rune int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 bool error any chan map struct interface type var const case nil true false complex64 complex128 min max clear".split())


def go_references(path: str, content: str) -> list[tuple]:
    """Embedded types (extends), calls, and types of parameters, fields and variables (uses_type), by the enclosing symbol; names only."""
    shown, lines = masked(content, "go"), Lines(content)
    rows = extract.go_symbols(path, content)
    spans = [(r[5], r[6], r[0], r[2], r[3]) for r in rows]
    out: set[tuple] = set()

    def at(offset: int, kinds: tuple[str, ...]) -> tuple[str, str | None] | None:
        line = lines.of(offset)
        held = [(e - s, i, q) for s, e, i, q, k in spans if k in kinds and s <= line <= e]
        return (min(held)[1], q.rpartition(".")[0] or None) if held and (q := min(held)[2]) else None

    def types(where: tuple[str, str | None] | None, text: str) -> None:
        for n in re.findall(r"[A-Za-z_]\w*(?:\.\w+)?", text):
            n = n.rsplit(".", 1)[-1]
            if where and n not in _GO_WORDS:
                out.add((where[0], n, "uses_type", path, where[1], None))

    for m in re.finditer(r"^type\s+(\w+)(?:\s*\[[^\]]*\])?\s+(struct|interface)\s*\{", shown, re.M):
        own = at(m.start(), ("class", "interface"))
        for line in shown[m.end() : closing(shown, m.end() - 1, len(shown))].split("\n"):
            line = line.strip()
            bare = re.fullmatch(r"\*?([\w.]+)(?:\[[^\]]*\])?", re.sub(r"\s*[`\"].*$", "", line))
            if bare and own:
                name = bare[1].rsplit(".", 1)[-1]
                if name != m[1]:
                    out.add((own[0], name, "extends", path, own[1], None))
            elif m[2] == "struct" and (f := re.match(r"\w+(?:\s*,\s*\w+)*\s+([^`\"]+)", line)):
                types(own, f[1])
            elif m[2] == "interface" and "(" in line:
                types(own, line.partition("(")[2])
    for m in re.finditer(r"^func\s+(?:\([^)]*\)\s*)?\w+\s*(?:\[[^\]]*\])?\(", shown, re.M):
        args = shown[m.end() : closing(shown, m.end() - 1, len(shown))]
        for p in split_top(args):
            types(at(m.start(), ("function",)), p.partition(" ")[2] or p)
    for m in re.finditer(r"^[ \t]*var\s+\w+(?:\s*,\s*\w+)*\s+([^=\n(]+)", shown, re.M):
        types(at(m.start(), ("function", "variable")), m[1])
    for m in re.finditer(r"(?<!func )\b(\w+)\s*(?:\[[\w.,\s]*\])?\(", shown):
        where = at(m.start(), ("function",))
        if where and m[1] not in _GO_WORDS and not re.match(r"func\b[^\n{]*$", shown[shown.rfind("\n", 0, m.start()) + 1 : m.start()]):
            out.add((where[0], m[1], "calls", path, where[1], None))
    return sorted(out, key=str)


def _unplaced(f):
    return lambda path, content: [(*r, None) for r in f(path, content)]


_REFERENCES = {"typescript": typescript_references, "go": go_references, "python": _unplaced(extract.python_references), "csharp": _unplaced(csharp_references)}


def references(files: DataFrame, language: str) -> DataFrame:
    """References of files(path, content); rows without path or content give none."""
    return extract.each(files, _REFERENCES[language], REFERENCE)


def _scope(qualified: Column) -> Column:
    return F.nullif(F.regexp_replace(qualified, r"\.*[^.]*$", ""), F.lit(""))


def edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, target, kind): the references that meet a symbol, none to itself; types only meet classes, interfaces, types and enums.

    With a module: the top-level symbol of that name in it. Without: by :func:`resolve_names`.
    Both are written first, so that files are parsed once for all joins; these sort, since what
    comes out of a parser has no size that a broadcast could be judged by.
    """
    refs = settle(refs, "references")
    symbols = settle(symbols.select("id", "name", "qualified_name", "kind", "file_path"), "symbols")
    placed = symbols.filter(~F.col("qualified_name").contains(".")).select(F.regexp_replace("file_path", _JS, "").alias("module"), F.col("name").alias("target_name"), F.col("id").alias("target"), F.col("kind").alias("_kind"))
    near = refs.filter("module is not null").withColumn("module", F.regexp_replace("module", "/index$", "")).join(placed.hint("merge"), ["module", "target_name"])
    near = near.filter((F.col("kind") != "uses_type") | F.col("_kind").isin(*_TYPES)).select("source", "target", "kind")
    key = F.struct("source", "kind", "target_name", "file_path", "scope")
    open_ = refs.filter("module is null").select(key.alias("ref_id"), F.col("target_name").alias("name"), "scope", "file_path").distinct()
    named = resolve_names(open_, symbols.select("id", "name", _scope(F.col("qualified_name")).alias("scope"), "file_path"))
    far = named.select(F.col("ref_id.source").alias("source"), F.col("id").alias("target"), F.col("ref_id.kind").alias("kind"))
    return near.unionByName(far).filter("source <> target").distinct()


_STATE = re.compile(r"\b(?:useState|useReducer)\s*(?:<[^()]*>)?\(")


def typescript_components(path: str, content: str, all_client: bool = False) -> list[tuple]:
    """Components by function or variable with markup, and classes with a ``@Component`` decorator.

    Client by the file's first statement or ``all_client``; a decorated class always is. Contexts
    are sorted names; props are the type of the first parameter, or selector and imports.
    """
    shown, lines = masked(content, "typescript"), content.split("\n")
    first = re.match(r"\s*(['\"])(use client|use server)\1", re.sub(r"^(?:\s*(?://[^\n]*|/\*.*?\*/))*", "", content, flags=re.S))
    client, server = all_client or bool(first and first[2] == "use client"), not all_client and bool(first and first[2] == "use server")
    body_lines = shown.split("\n")
    out = []
    for r in extract.typescript_symbols(path, content):
        if "." in r[2]:
            continue
        body = "\n".join(body_lines[r[5] - 1 : r[6]])
        if r[3] == "component" and re.search(r"(?<![\w$.)\]])<(?:[A-Za-z]|>)", body):
            provides = sorted(set(re.findall(r"<([A-Za-z_$][\w$]*)\.Provider\b", body)))
            consumes = sorted(set(re.findall(r"\buseContext\s*(?:<[^()]*>)?\(\s*([\w$]+)", body)))
            props = re.search(r"\(\s*(?:\{[^}]*\}|[\w$]+)\s*:\s*([\w$.]+(?:<[^()]*?>)?)", body)
            out.append((r[0], client, server, bool(_STATE.search(body)), provides, consumes, props[1] if props else None, path))
        elif r[3] in ("class", "component"):
            above = "\n".join(lines[: r[5]])
            deco = list(re.finditer(r"@Component\s*\(", above))
            after = above[deco[-1].start() :] if deco else ""
            if deco and not re.search(r"\bclass\b.*\n[\s\S]*\bclass\b", after):
                selector = re.search(r"\bselector\s*:\s*['\"]([^'\"]*)", after)
                imports = re.search(r"\bimports\s*:\s*\[([^\]]*)\]", after)
                names = re.findall(r"[A-Za-z_$][\w$]*", imports[1]) if imports else []
                props = " | ".join(p for p in ("selector: " + selector[1] if selector else "", "imports: " + ", ".join(names) if names else "") if p)
                state = re.search(r"=\s*\(?\s*(?:[\w$]+\.)?(?:signal|computed)\s*(?:<[^()]*>)?\(", body)
                out.append((f"{path}::{r[2]}#component", True, False, bool(state), [], [], props or None, path))
    return out


# fixed values: project types whose components all run in the client
CLIENT_ONLY = ("react-vite", "angular-app")


def components(files: DataFrame, project_type: str | None = None) -> DataFrame:
    """Components of TypeScript files."""
    client = project_type in CLIENT_ONLY
    return extract.each(files, lambda p, c: typescript_components(p, c, client), COMPONENT)
