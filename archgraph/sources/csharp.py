"""Symbols, references and routes of C# text (B4, B9, B17), by statements between brackets.

A file is cut into statements, those of namespaces and types into theirs. Statements inside
methods are not parsed but searched for names, with comments and strings masked.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from archgraph.functions.types import type_name
from archgraph.sources.source_text import Lines, Statement, closing, innermost, masked, split_top, statements

_MODIFIER = r"(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|unsafe|new|virtual|override|async|extern|const|required|volatile|file|ref|event)"
_ATTRIBUTE = re.compile(r"\s*\[")
_HEAD = re.compile(rf"\s*((?:{_MODIFIER}\s+)*)")
_TYPE = re.compile(r"(class|record\s+struct|record\s+class|record|struct|interface|enum)\s+(\w+)")
_NAMESPACE = re.compile(r"\s*namespace\s+([\w.]+)\s*$")
_DELEGATE = re.compile(r"delegate\s+(?P<type>.+?)\s+(?P<name>\w+)\s*(?:<[^>]*>)?\s*\(", re.S)
_METHOD = re.compile(r"(?P<type>[\w.]+(?:\s*<.*?>)?(?:\s*\[[\],\s]*\])*\??|\([^()]*\)\??)\s+(?:[\w.]+(?:<[^>]*>)?\.)?(?P<name>\w+)\s*(?:<[^<>()]*>)?\s*(?=\()", re.S)
_CTOR = re.compile(r"(?P<name>\w+)\s*(?=\()")
_VALUE = re.compile(r"(?P<type>[\w.]+(?:\s*<.*>)?(?:\s*\[[\],\s]*\])*\??|\([^()]*\)\??)\s+(?P<names>\w.*)$", re.S)
_WORD = re.compile(r"\w+")
#: Words that stand before a parenthesis and are no call.
_NO_CALL = frozenset("if for foreach while switch catch using lock return nameof typeof sizeof default when checked unchecked fixed await in is as and or not base this throw var stackalloc get set init add remove where new".split())


class Declared(NamedTuple):
    id: str
    name: str
    qualified: str
    kind: str
    statement: Statement
    modifiers: frozenset
    attributes: list[tuple[str, str]]
    signature: str | None
    returns: str | None
    doc: str | None
    bases: list[str]
    scope: str | None


def _attributes(text: str, shown: str, at: int, end: int) -> tuple[list[tuple[str, str]], int]:
    """The (name, arguments) of the attributes from ``at`` on, and where they end."""
    found = []
    while (m := _ATTRIBUTE.match(shown, at, end)) is not None:
        close = closing(shown, m.end() - 1, end)
        for part in split_top(text[m.end() : close]):
            name = re.match(r"(?:\w+\s*:\s*)?([\w.]+)\s*(?:\((.*)\))?", part, re.S)
            if name:
                found.append((name[1].rsplit(".", 1)[-1].removesuffix("Attribute"), name[2] or ""))
        at = close + 1
    return found, at


def _doc(text: str, start: int, at: int) -> str | None:
    """The text of the ``///`` lines between the last declaration and ``at``, without tags."""
    lines = re.findall(r"^[ \t]*///(.*)$", text[start:at], re.M)
    said = re.sub(r"<[^>]*>", " ", " ".join(lines))
    return re.sub(r"\s+", " ", said).strip() or None


def _plain(type_: str) -> str:
    return re.sub(r"\s+", " ", type_).strip()


def declarations(path: str, text: str) -> list[Declared]:
    """The declared types and members of a file, in order of their place; types within types are qualified by the namespace alone."""
    shown = masked(text, "csharp")
    # directives of the preprocessor are no statements
    shown = re.sub(r"(?m)^[ \t]*#.*$", lambda m: " " * len(m[0]), shown)
    out: list[Declared] = []

    def add(s: Statement, at: int, name: str, owner: str, kind: str, mods: frozenset, attrs: list, signature: str | None = None, returns: str | None = None, bases: list[str] = (), scope: str | None = None) -> None:
        q = f"{owner}.{name}" if owner else name
        out.append(Declared(f"{path}::{q}#{kind}", name, q, kind, s._replace(start=at), mods, attrs, signature, returns, _doc(text, s.start, at), list(bases), scope))

    def visit(start: int, end: int, namespace: str, owner: str) -> None:
        for s in statements(shown, start, end):
            attrs, at = _attributes(text, shown, s.start, s.head_end)
            at += len(shown[at : s.head_end]) - len(shown[at : s.head_end].lstrip())
            head = shown[at : s.head_end]
            if (m := _NAMESPACE.match(head)) is not None:
                if s.body < 0:  # for the rest of the file
                    visit(s.end, end, f"{namespace}.{m[1]}" if namespace else m[1], "")
                    return
                visit(s.body, s.body_end, f"{namespace}.{m[1]}" if namespace else m[1], "")
                continue
            m = _HEAD.match(head)
            mods, rest = frozenset(m[1].split()), head[m.end() :]
            if (m := _TYPE.match(rest)) is not None:
                kind = {"interface": "interface", "enum": "enum"}.get(m[1], "class")
                after = re.sub(r"\bwhere\b.*", "", rest[m.end() :], flags=re.S)
                colon = split_top(after, ":")
                bases = split_top(colon[-1]) if ":" in re.sub(r"\([^()]*\)|<[^<>]*>", "", after) else []
                add(s, at, m[2], namespace, kind, mods, attrs, bases=bases, scope=owner or None)
                if s.body >= 0 and kind != "enum":
                    visit(s.body, s.body_end, namespace, f"{namespace}.{m[2]}" if namespace else m[2])
            elif (m := _DELEGATE.match(rest)) is not None:
                add(s, at, m["name"], namespace, "type", mods, attrs, returns=_plain(m["type"]))
            elif owner:
                member(s, at, rest, owner, mods, attrs)

    def member(s: Statement, at: int, rest: str, owner: str, mods: frozenset, attrs: list) -> None:
        before = split_top(rest.replace("=>", "= "), "=")[0] if rest.strip() else ""
        own = owner.rsplit(".", 1)[-1]
        if (m := _METHOD.match(before)) is not None and m["type"] not in ("return", "new", "operator"):
            args = before[m.end() : closing(before, m.end(), len(before)) + 1]
            add(s, at, m["name"], owner, "function", mods, attrs, _plain(args), _plain(m["type"]), scope=owner)
        elif (m := _CTOR.match(before)) is not None:
            if m["name"] == own:
                args = before[m.end() : closing(before, m.end(), len(before)) + 1]
                add(s, at, ".ctor", owner, "function", mods, attrs, own + _plain(args), scope=owner)
        elif s.body >= 0 and "=" not in rest.replace("=>", "") or "=>" in rest and "=" not in rest.split("=>", 1)[0]:
            if (m := _VALUE.match(before.strip())) is not None and _WORD.fullmatch(m["names"].strip()):
                add(s, at, m["names"].strip(), owner, "variable", mods, attrs, None, _plain(m["type"]), scope=owner)
        elif (m := _VALUE.match(rest.strip())) is not None:
            for part in split_top(m["names"]):
                name = _WORD.match(part)
                if name:
                    add(s, at, name[0], owner, "constant" if "const" in mods else "variable", mods, attrs, None, _plain(m["type"]), scope=owner)

    visit(0, len(shown), "", "")
    return out


def csharp_symbols(path: str, text: str) -> list[tuple]:
    """Rows of the schema of symbols; public ones are exported."""
    lines = Lines(text)
    return [
        (d.id, d.name, d.qualified, d.kind, path, lines.of(d.statement.start), lines.of(max(d.statement.end - 1, d.statement.start)), d.signature, d.returns, d.doc, "public" in d.modifiers, "async" in d.modifiers, "csharp")
        for d in declarations(path, text)
    ]


def _names(type_: str) -> list[str]:
    """The names in a type; of a qualified one the last part."""
    return [n.rsplit(".", 1)[-1] for n in re.findall(r"[A-Za-z_][\w.]*", type_)]


def csharp_references(path: str, text: str) -> list[tuple]:
    """Bases (implements for I and a capital, else extends), calls, made and named types (uses_type), by the enclosing symbol; names only."""
    shown = masked(text, "csharp")
    out: set[tuple] = set()
    all_ = declarations(path, text)
    bodies = [(d.statement.start, d.statement.end, d.id) for d in all_ if d.kind == "function"]
    scopes = {d.id: d.scope for d in all_}

    def say(source: str, name: str, kind: str) -> None:
        out.add((source, name, kind, path, scopes.get(source)))

    for d in all_:
        for b in d.bases:
            name = re.split(r"[<(]", b, maxsplit=1)[0].strip().rsplit(".", 1)[-1]
            if name and name != d.name:
                say(d.id, name, "implements" if re.match(r"I[A-Z]", name) else "extends")
        if d.kind in ("variable", "constant") and d.returns:  # of the type that holds it
            owner = next((x.id for x in all_ if x.qualified == d.scope and x.kind in ("class", "interface")), d.id)
            for n in _names(d.returns):
                say(owner, n, "uses_type")
        if d.kind == "function":
            for p in split_top((d.signature or "").partition("(")[2].rsplit(")", 1)[0]):
                for n in _names(re.sub(r"^(?:(?:this|ref|out|in|params)\s+)*|\s+\w+\s*(?:=.*)?$", "", p)):
                    say(d.id, n, "uses_type")
    for m in re.finditer(r"\bnew\s+([A-Za-z_][\w.]*)|(?<![\w.])([A-Z][\w.]*(?:<[\w.,\s<>]*>)?\??)\s+\w+\s*(?:=(?!=)|;|\bin\b)|(\w+)\s*(?:<[\w.,\s]*>)?\s*\(", shown):
        source = innermost(bodies, m.start())
        if source is None:
            continue
        if m[1]:
            say(source, m[1].rsplit(".", 1)[-1], "uses_type")
        elif m[2]:
            for n in _names(m[2]):
                say(source, n, "uses_type")
        elif m[3] not in _NO_CALL and not re.search(r"\bnew\s+[\w.]*$", shown[max(0, m.start() - 200) : m.start()]):
            heads = any(d.statement.start <= m.start() < d.statement.head_end and d.name in (m[3], ".ctor") for d in all_ if d.kind == "function")
            if not heads:
                say(source, m[3], "calls")
    return sorted(out, key=str)


# fixed values: attributes of actions and mapping calls, with their methods
_ACTION = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "HttpHead": "HEAD", "HttpOptions": "OPTIONS"}
_MAPPED = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
_MAP = re.compile(r"(?:\b(?P<on>\w+)\s*\.\s*)(?P<call>Map(?:Get|Post|Put|Delete|Patch|Group))\s*\(")


def _literal(text: str) -> str | None:
    m = re.match(r"\s*[$@]*\"((?:\\.|[^\"\\])*)\"", text)
    return m[1] if m else None


def csharp_routes(path: str, text: str) -> list[tuple]:
    """(route_path, methods, handler, has_auth, file_path, response_type) of controller actions and of mapped calls.

    The type of a mapped call is the lambda's declared one, else that of the first object it makes.
    """
    all_ = declarations(path, text)
    out = []
    for c in all_:
        named = {n for n, _ in c.attributes}
        if c.kind != "class" or not ("ApiController" in named or any("Controller" in b for b in c.bases)):
            continue
        prefix = next((_literal(a) or "" for n, a in c.attributes if n == "Route"), "")
        for d in all_:
            if d.kind != "function" or d.scope != c.qualified or not c.statement.start <= d.statement.start < c.statement.end:
                continue
            action = next(((_ACTION[n], _literal(a)) for n, a in d.attributes if n in _ACTION), None)
            if action:
                route = "/".join(p for p in (prefix, action[1]) if p).replace("[controller]", c.name.removesuffix("Controller").lower(), 1)
                out.append((route if route.startswith("/") else "/" + route, [action[0]], d.id, "Authorize" in named | {n for n, _ in d.attributes}, path, type_name(d.returns)))
    shown = masked(text, "csharp")
    groups: dict[str, str] = {}
    for m in _MAP.finditer(shown):
        template = _literal(text[m.end() :])
        if template is None:
            continue
        if m["call"] == "MapGroup":
            to = re.search(r"(\w+)\s*=\s*(?:\w+\s*\.\s*)?$", shown[: m.start("call")])
            if to:
                groups[to[1]] = template
            continue
        close = closing(shown, m.end() - 1, len(shown))
        stop = shown.find(";", close)
        whole = "/" + "/".join(p for p in (groups.get(m["on"], ""), template) if p)
        route = re.sub(r"/{2,}", "/", whole).rstrip("/") or "/"
        call = shown[m.end() : close]
        declared = re.search(r",\s*(?:async\s+)?([A-Za-z_][\w.]*(?:<.*?>)?\??)\s*\([^()]*\)\s*=>", call, re.S)
        made = re.search(r"=>.*?\bnew\s+([A-Za-z_][\w.]*(?:<[^()]*>)?)", call, re.S)
        said = declared[1] if declared and declared[1] != "async" else made[1] if made else None
        out.append((route, [_MAPPED[m["call"]]], None, "RequireAuthorization" in shown[close : len(shown) if stop < 0 else stop], path, type_name(said)))
    return out

