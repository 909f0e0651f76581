"""Rows of the code-model relations from TypeScript texts, without a type checker.

Call targets resolve through the file's imports and declarations; what doesn't resolve keeps its text. Return types count only where
they are written. Ids that would collide on one line carry the offset as well, and the units of a nested function hang below the
function around it, so that each unit is covered once.
"""

from __future__ import annotations

import posixpath
import re
from collections import defaultdict
from collections.abc import Collection, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from terrane.sources.lexer import Source
from terrane.sources.schema import RELATIONS

#: Modules whose calls are effects; the first kind that fits counts.
EFFECT_MODULES = (
    ("network", ("axios", "node-fetch", "undici")),
    ("file_system", ("fs", "node:fs", "fs/promises", "node:fs/promises")),
    ("queue", ("bull", "bullmq", "amqplib", "rabbitmq")),
    ("database", ("prisma", "@prisma/client", "knex", "pg", "mysql", "mysql2", "sequelize", "typeorm")),
)
ROOT_EFFECTS = {"fetch": "network", "console": "log"}
LATE_EFFECTS = {"axios": "network", "fs": "file_system", "db": "database", "database": "database"}
_CONTINUES = re.compile(r"^(\.|\?\.|\?|:|,|=>|=|[-+*/%&|^<>!=]=?=?|&&|\|\||\?\?|\(|\[|in|of|instanceof|as|satisfies)$")
_OPEN_END = re.compile(r"^(=>|=|[-+*/%&|^<>!=]=?=?|&&|\|\||\?\?|,|\.|\?\.|\(|\[|\{|:|\?|return|await|new|typeof|in|of|extends|implements|const|let|var|else)$")
_NOT_CALLED = frozenset("if for while switch catch function return typeof await new super import constructor of in".split())


@dataclass
class Callable:
    id: str
    name: str
    kind: str  # function, method, arrow
    start: int  # token the declaration starts at
    end: int
    body: int  # token of `{`, or -1 for an expression
    sig: int  # token of `(`, or -1
    exported: bool
    is_async: bool
    signature: str
    top: bool = True
    owner: str = ""
    range_from: int = -1


@dataclass
class File:
    path: str
    source: Source
    imports: dict[str, tuple[str, str]] = field(default_factory=dict)  # local name -> (module, exported name)
    callables: list[Callable] = field(default_factory=list)
    classes: list[tuple[str, str, int, int, bool]] = field(default_factory=list)  # kind, name, start, end, exported


def is_source(path: str) -> bool:
    """TypeScript outside node_modules that isn't a declaration file."""
    return path.endswith((".ts", ".tsx")) and not path.endswith(".d.ts") and "node_modules" not in path.split("/")


def parse(path: str, text: str) -> File:
    f = File(path, Source(text, "typescript"))
    src, toks = f.source, f.source.tokens
    classes: list[tuple[int, int, str, bool]] = []
    for i, t in enumerate(toks):
        if t.kind != "name":
            continue
        if t.text == "import" and (i == 0 or toks[i - 1].text != "."):
            _imports(f, i)
        elif t.text in ("class", "interface") and i + 1 < len(toks) and toks[i + 1].kind == "name" and (i == 0 or toks[i - 1].text not in (".", ":")):
            k = i + 2
            while k < len(toks) and toks[k].text != "{":
                k = src.close.get(k, k) + 1 if toks[k].text == "(" else k + 1
            if k >= len(toks):
                continue
            end, first = src.close.get(k, len(toks) - 1) + 1, _modifiers(toks, i)
            exported = any(x.text == "export" for x in toks[first:i])
            f.classes.append((t.text, toks[i + 1].text, first, end, exported))
            if t.text == "class":
                classes.append((k, end, toks[i + 1].text, exported))
        elif t.text == "function" and i + 1 < len(toks):
            k = i + 1 + (toks[i + 1].text == "*")
            if k < len(toks) and toks[k].kind == "name":
                _callable(f, i, toks[k].text, "function", k + 1, _modifiers(toks, i), f"{path}:{toks[k].text}")
        elif t.text in ("const", "let", "var"):
            _arrow(f, i)
    for brace, end, name, exported in classes:
        _methods(f, brace, end, name, exported)
    f.callables.sort(key=lambda c: c.start)
    for c in f.callables:
        c.top = not any(o is not c and o.start < c.start and c.end <= o.end for o in f.callables)
    return f


def _modifiers(toks, i: int) -> int:
    while i and toks[i - 1].kind == "name" and toks[i - 1].text in ("export", "default", "async", "declare", "abstract", "public", "private", "protected", "static", "readonly", "override"):
        i -= 1
    return i


def _imports(f: File, i: int) -> None:
    toks, k, names = f.source.tokens, i + 1, []
    while k < len(toks) and toks[k].kind != "string" and toks[k].text not in (";", "("):
        k += 1
    if k >= len(toks) or toks[k].kind != "string":
        return
    module, j, inside = toks[k].text.strip("'\""), i + 1, False
    while j < k:
        t = toks[j]
        if t.text == "{":
            inside = True
        elif t.text == "}":
            inside = False
        elif t.kind == "name" and t.text not in ("type", "from", "as"):
            if j + 2 < k and toks[j + 1].text == "as":
                names.append((toks[j + 2].text, t.text))
                j += 2
            else:
                names.append((t.text, t.text if inside else "default"))
        elif t.text == "*" and j + 2 < k:
            names.append((toks[j + 2].text, "*"))
            j += 2
        j += 1
    for local, exported in names:
        f.imports.setdefault(local, (module, exported))


def _behind_params(f: File, k: int, arrow: bool) -> tuple[int, str]:
    """From the `(` of parameters: the token of the body (`{` or the first behind =>), and the written return type."""
    src, toks = f.source, f.source.tokens
    close = src.close.get(k)
    if close is None:
        return -1, ""
    j, kind = close + 1, ""
    if j < len(toks) and toks[j].text == ":":
        a = j = j + 1
        while j < len(toks) and toks[j].text not in ("=>", ";") and not (toks[j].text == "{" and j > a and toks[j - 1].text not in ("|", "&", "<", ",", ":", "is")):
            j = src.close.get(j, j) + 1
        kind = src.slice(a, j)
    if arrow:
        return (j + 1, kind) if j < len(toks) and toks[j].text == "=>" else (-1, kind)
    return (j, kind) if j < len(toks) and toks[j].text == "{" else (-1, kind)


def _callable(f: File, i: int, name: str, kind: str, k: int, first: int, cid: str, exported: bool | None = None, owner: str = "") -> None:
    src, toks = f.source, f.source.tokens
    while k < len(toks) and toks[k].text == "<":  # type parameters
        depth = 0
        while k < len(toks):
            depth += {"<": 1, ">": -1, ">>": -2}.get(toks[k].text, 0)
            k += 1
            if depth <= 0:
                break
    if k >= len(toks) or toks[k].text != "(" or k not in src.close:
        return
    body, written = _behind_params(f, k, False)
    if body < 0:
        return
    mods = {t.text for t in toks[first:i]}
    is_async = "async" in mods or written.startswith("Promise")
    f.callables.append(Callable(cid, name, kind, first, src.close.get(body, len(toks) - 1) + 1, body, k, "export" in mods if exported is None else exported, is_async, f"{name}{_args(f, k)}: {written or 'void'}", owner=owner))


def _args(f: File, k: int) -> str:
    parts, a, close = [], k + 1, f.source.close[k]
    j = a
    while j <= close:
        if j == close or f.source.tokens[j].text == ",":
            if j > a:
                parts.append(f.source.slice(a, j))
            a = j + 1
        j = f.source.close.get(j, j) + 1 if j < close else j + 1
    return "(" + ", ".join(parts) + ")"


def _arrow(f: File, i: int) -> None:
    """const name = (..) => .. or function (..) {..}"""
    src, toks = f.source, f.source.tokens
    if i + 2 >= len(toks) or toks[i + 1].kind != "name":
        return
    k = i + 2
    if toks[k].text == ":":
        while k < len(toks) and toks[k].text not in ("=", ";"):
            k = src.close.get(k, k) + 1
    if k >= len(toks) or toks[k].text != "=":
        return
    k = begin = k + 1
    is_async = k < len(toks) and toks[k].text == "async"
    k += is_async
    if k >= len(toks):
        return
    name, first = toks[i + 1].text, _modifiers(toks, i)
    exported = any(t.text == "export" for t in toks[first:i])
    sig = -1
    if toks[k].text == "function":
        while k < len(toks) and toks[k].text != "(":
            k += 1
        body, written = _behind_params(f, k, False) if k < len(toks) else (-1, "")
        sig = k
    elif toks[k].text == "(":
        body, written = _behind_params(f, k, True)
        sig = k
    elif toks[k].kind == "name" and k + 1 < len(toks) and toks[k + 1].text == "=>":
        body, written = k + 2, ""
    else:
        return
    if body < 0 or body >= len(toks):
        return
    end = src.close.get(body, len(toks) - 1) + 1 if toks[body].text == "{" else statement_end(f, body, len(toks))
    args = _args(f, sig) if sig >= 0 and sig in src.close else f"({toks[k].text})"
    f.callables.append(Callable(f"{f.path}:{name}", name, "arrow", begin, end, body if toks[body].text == "{" else -1, sig, exported, is_async or written.startswith("Promise"), f"{name}{args}: {written or 'void'}", range_from=i + 1))


def _methods(f: File, brace: int, end: int, owner: str, exported: bool) -> None:
    src, toks, k = f.source, f.source.tokens, brace + 1
    while k < end - 1:
        t = toks[k]
        if t.kind == "name" and k + 1 < end and toks[k + 1].text in ("(", "<") and t.text not in ("constructor", "if", "for", "while", "switch", "catch") and (k == brace + 1 or toks[k - 1].text in ("}", ";", "{", ")", "*") or toks[k - 1].kind == "name" or src.line(toks[k - 1].start) < src.line(t.start)):
            n = len(f.callables)
            _callable(f, k, t.text, "method", k + 1, _modifiers(toks, k), f"{f.path}:{owner}.{t.text}", exported, owner)
            if len(f.callables) > n:
                k = f.callables[-1].end
                continue
        k = src.close.get(k, k) + 1


def statement_end(f: File, a: int, b: int) -> int:
    """Token behind the plain statement at a: a semicolon, or a line break that nothing carries on."""
    src, toks, k = f.source, f.source.tokens, a
    while k < b:
        t = toks[k]
        if t.text == ";" and t.kind == "op":
            return k + 1
        if t.text in ")]}" and t.kind == "op":
            return k
        if k > a and src.line(toks[k - 1].end - 1) < src.line(t.start) and not (t.kind in ("op", "name") and _CONTINUES.match(t.text)) and not _OPEN_END.match(toks[k - 1].text):
            return k
        k = src.close.get(k, k) + 1
    return k


class Project:
    """What the files of a project declare: paths, names by file, default exports, imports; the files themselves aren't held."""

    def __init__(self, paths: Iterable[str]):
        self.paths = frozenset(paths)
        self.names: dict[str, frozenset[str]] = {}
        self.defaults: dict[str, str] = {}
        self.imports: dict[str, dict[str, tuple[str, str]]] = {}

    def add(self, f: File) -> None:
        self.names[f.path] = frozenset([*(c.owner + "." + c.name if c.owner else c.name for c in f.callables), *(n for _, n, *_ in f.classes)])
        for c in f.callables:
            if any(t.text == "default" for t in f.source.tokens[c.start : c.start + 3]):
                self.defaults[f.path] = c.id
        if f.imports:
            self.imports[f.path] = f.imports

    def declared(self, path: str, name: str) -> str | None:
        """Symbol id of a name that the file declares."""
        return f"{path}:{name}" if name in self.names[path] else None


class Extractor:
    """Rows of a project, file by file; only the relations named."""

    def __init__(self, project: Project, names: Collection[str] = RELATIONS):
        self.project, self.names, self.rows = project, names, defaultdict(list)

    def range(self, f: File, a: int, b: int) -> dict:
        toks = f.source.tokens
        return {"file": f.path, "start_line": f.source.line(toks[a].start), "end_line": f.source.line(max(toks[b - 1].end - 1, toks[a].start))}

    def module(self, path: str, name: str) -> str | None:
        """Path of a local module that the file imports."""
        if not name.startswith("."):
            return None
        base = posixpath.normpath(posixpath.join(posixpath.dirname(path), name))
        stem = re.sub(r"\.(js|jsx|mjs)$", "", base)
        return next((p for p in (base, f"{stem}.ts", f"{stem}.tsx", f"{base}/index.ts") if p in self.project.paths), None)

    def target(self, at: str, names: list[str], seen: frozenset = frozenset()) -> str:
        """Symbol id of dotted names in the file at a path, or their text."""
        head, rest, p = names[0], names[1:], self.project
        if head in p.imports.get(at, {}):
            module, exported = p.imports[at][head]
            path = self.module(at, module)
            if path is not None:
                if exported == "*" and rest:
                    return p.declared(path, ".".join(rest)) or ".".join(names)
                if exported == "default" and path in p.defaults and not rest:
                    return p.defaults[path]
                found = p.declared(path, ".".join([exported, *rest]))
                if found:
                    return found
                if exported in p.imports.get(path, {}) and path not in seen:  # a re-export: follow it once per file
                    return self.target(path, [exported, *rest], seen | {path})
        return p.declared(at, ".".join(names)) or ".".join(names)

    def file(self, f: File) -> dict[str, list[dict]]:
        """Rows of one file by relation."""
        self.rows = defaultdict(list)
        pkg = posixpath.dirname(f.path) or "."
        self.rows["errors"] += [{"file": f.path, "message": m, "start_line": n, "end_line": n} for n, m in f.source.errors]
        for c in f.callables:
            self.rows["symbols"].append({"id": c.id, "kind": "method" if c.kind == "method" else "function", "name": c.name, "package": pkg, "source": self.range(f, c.start, c.end), "signature": c.signature, "is_exported": c.exported, "is_async": c.is_async})
        for kind, name, a, b, exported in f.classes:
            self.rows["symbols"].append({"id": f"{f.path}:{name}", "kind": "type" if kind == "class" else "interface", "name": name, "package": pkg, "source": self.range(f, a, b), "signature": f"{kind} {name}", "is_exported": exported, "is_async": False})
        if "calls" in self.names or "effects" in self.names:
            self.calls(f)
        if "entities" in self.names:
            self.entities(f)
        return {name: rows for name, rows in self.rows.items() if name in self.names}

    def call_at(self, f: File, i: int) -> tuple[int, int, list[str]] | None:
        toks, src = f.source.tokens, f.source
        if toks[i].kind != "name" or toks[i].text in _NOT_CALLED or i + 1 >= len(toks) or toks[i + 1].text != "(" or i + 1 not in src.close:
            return None
        a = i
        while a >= 2 and toks[a - 1].text in (".", "?.") and toks[a - 2].kind == "name":
            a -= 2
        if a and (toks[a - 1].text in ("function", "new") or toks[a - 1].text in (".", "?.")):
            return None
        close = src.close[i + 1]
        if close + 1 < len(toks) and toks[close + 1].text == "{" and any(c.sig == i + 1 for c in f.callables):
            return None
        if any(c.sig == i + 1 for c in f.callables):
            return None
        return a, close + 1, [t.text for t in toks[a : i + 1 : 2]]

    def calls(self, f: File) -> None:
        for i in range(len(f.source.tokens)):
            hit = self.call_at(f, i)
            if hit is None:
                continue
            a, b, names = hit
            around = [c for c in f.callables if c.start <= a and b <= c.end]
            if not around:
                continue
            owner = max(around, key=lambda c: c.start).id
            where = self.range(f, a, b)
            self.rows["calls"].append({"from": owner, "to": self.target(f.path, names), "source": where})
            kind = self.effect(f, names[0])
            if kind:
                self.rows["effects"].append({"symbol": owner, "kind": kind, "detail": ".".join(names), "source": where})

    def effect(self, f: File, root: str) -> str | None:
        if root in ROOT_EFFECTS:
            return ROOT_EFFECTS[root]
        if root in f.imports:
            module = f.imports[root][0].lower()
            for kind, modules in EFFECT_MODULES:
                if any(module == m or module.startswith(m + "/") for m in modules):
                    return kind
        return LATE_EFFECTS.get(root)

    # Entities.
    def eid(self, f: File, kind: str, a: int, name: str = "") -> str:
        t = f.source.tokens[a]
        return re.sub(r"\s+", "", f"{kind}:{f.path}{':' + name if name else ''}:{f.source.line(t.start)}:{t.start}")

    def entity(self, f: File, kind: str, eid: str, parent: str, a: int, b: int, source: dict | None = None, **more) -> str:
        base = {"id": eid, "kind": kind, "name": "", "label": "", "symbol": "", "callee": "", "condition": "", "code": "", "coverage": False, "parent_id": parent, "children": []}
        self.rows["entities"].append(base | {"source": source or self.range(f, a, b)} | more)
        return eid

    def unit(self, f: File, kind: str, parent: str, a: int, b: int, **more) -> str:
        return self.entity(f, kind, self.eid(f, kind, a), parent, a, b, coverage=True, code=f.source.slice(a, b), **more)

    def entities(self, f: File) -> None:
        fid = f"file:{f.path}"
        self.entity(f, "file", fid, "", 0, 0, source={"file": f.path, "start_line": 1, "end_line": f.source.lines}, name=f.path)
        ids: list[tuple[Callable, str]] = []
        for c in f.callables:
            if c.kind == "arrow" and not c.top:
                continue
            kind = "method" if c.kind == "method" else "function"
            parent = next((e for o, e in reversed(ids) if o.start < c.start and c.end <= o.end), fid)
            eid = self.entity(f, kind, self.eid(f, kind, c.range_from if c.range_from >= 0 else c.start, c.name), parent, c.start, c.end, name=c.name, symbol=c.id)
            ids.append((c, eid))
            if c.body >= 0:
                self.block(f, eid, c.body)
        for kind, name, a, b, _ in f.classes:
            what = "type" if kind == "class" else "interface"
            self.entity(f, what, self.eid(f, what, a, name), fid, a, b, name=name, symbol=f"{f.path}:{name}")

    def block(self, f: File, parent: str, brace: int) -> None:
        self.statements(f, parent, brace + 1, f.source.close.get(brace, brace + 1))

    def statements(self, f: File, parent: str, a: int, b: int) -> None:
        while a < b:
            if f.source.tokens[a].text == ";":
                a += 1
                continue
            end = self.statement(f, parent, a, b)
            a = max(end, a + 1)

    def head(self, f: File, a: int, b: int) -> tuple[int, int]:
        """Parenthesis and token behind it of a control statement."""
        k = a + 1
        while k < b and f.source.tokens[k].text != "(":
            k += 1
        return k, f.source.close.get(k, b - 1) + 1

    def nested(self, f: File, parent: str, a: int, b: int, emit: bool = True) -> int:
        """A block or one statement; returns the token behind it."""
        if a < b and f.source.tokens[a].text == "{":
            if emit:
                self.block(f, parent, a)
            return f.source.close.get(a, b - 1) + 1
        return self.statement(f, parent, a, b, emit) if a < b else b

    def statement(self, f: File, parent: str, a: int, b: int, emit: bool = True) -> int:
        src, toks = f.source, f.source.tokens
        word = toks[a].text if toks[a].kind == "name" else ""
        if word == "if":
            k, body = self.head(f, a, b)
            then = self.nested(f, "", body, b, False)
            other = then < b and toks[then].text == "else"
            end = self.nested(f, "", then + 1, b, False) if other else then
            if emit:
                eid = self.unit(f, "if", parent, a, end, condition=src.slice(k + 1, body - 1))
                self.nested(f, eid, body, b)
                if other and toks[then + 1].text == "if":
                    self.statement(f, parent, then + 1, b)  # a sibling of the first
                elif other:
                    els = self.unit(f, "else", eid, then + 1, end)
                    if toks[then + 1].text == "{":
                        self.block(f, els, then + 1)
            return end
        if word in ("for", "while"):
            k, body = self.head(f, a, b)
            end = self.nested(f, "", body, b, False)
            if emit:
                eid = self.unit(f, "loop", parent, a, end, condition=self.loop_condition(f, word, k, body))
                self.nested(f, eid, body, b)
            return end
        if word == "switch":
            k, body = self.head(f, a, b)
            end = src.close.get(body, b - 1) + 1
            if emit:
                eid = self.unit(f, "switch", parent, a, end, condition=src.slice(k + 1, body - 1))
                self.cases(f, eid, body + 1, end - 1)
            return end
        if word == "return":
            end = a + 1 if a + 1 < b and src.line(toks[a].start) < src.line(toks[a + 1].start) else statement_end(f, a, b)
            if emit:
                self.unit(f, "return", parent, a, end)
            return end
        if word in ("function", "class", "interface") or word in ("async", "export") and any(c.start == a for c in f.callables):
            c = next((c for c in f.callables if c.start == a), None)
            end = c.end if c else statement_end(f, a, b)
            if emit:
                self.unit(f, "statement", parent, a, end)
            return end
        if word in ("try", "do") or toks[a].text == "{":
            end = self.compound_end(f, a, b)
            if emit:
                self.unit(f, "statement", parent, a, end)
            return end
        end = statement_end(f, a, b)
        if not emit:
            return end
        sid = self.unit(f, "statement", parent, a, end)
        if word in ("const", "let", "var"):
            self.declarations(f, sid, a + 1, end)
        elif word != "throw":
            self.direct_call(f, sid, a, end)
        return end

    def loop_condition(self, f: File, word: str, k: int, body: int) -> str:
        src, toks = f.source, f.source.tokens
        if word == "while":
            return src.slice(k + 1, body - 1)
        parts, a, i = [], k + 1, k + 1
        while i < body - 1:
            if toks[i].text in ("of", "in") and toks[i].kind == "name" and i > k + 2:
                return src.slice(i + 1, body - 1)
            if toks[i].text == ";":
                parts.append((a, i))
                a = i + 1
            i = src.close.get(i, i) + 1
        parts.append((a, body - 1))
        return src.slice(*parts[1]) if len(parts) > 1 else ""

    def compound_end(self, f: File, a: int, b: int) -> int:
        src, toks = f.source, f.source.tokens
        k = a
        while k < b and toks[k].text != "{":
            k += 1
        end = src.close.get(k, b - 1) + 1
        while end < b and toks[end].text in ("catch", "finally", "while") and toks[a].text in ("try", "do"):
            if toks[end].text == "while":
                return statement_end(f, end, b)
            while end < b and toks[end].text != "{":
                end += 1
            end = src.close.get(end, b - 1) + 1
        return end

    def cases(self, f: File, parent: str, a: int, b: int) -> None:
        src, toks = f.source, f.source.tokens
        starts, k = [], a
        while k < b:
            if toks[k].kind == "name" and toks[k].text in ("case", "default") and (k == a or toks[k - 1].text != "."):
                starts.append(k)
            k = src.close.get(k, k) + 1
        for i, nxt in zip(starts, [*starts[1:], b]):
            colon = i + 1
            while colon < nxt and toks[colon].text != ":":
                colon = src.close.get(colon, colon) + 1
            cond = src.slice(i + 1, colon) if toks[i].text == "case" else "default"
            cid = self.unit(f, "case", parent, i, nxt, condition=cond)
            self.statements(f, cid, colon + 1, nxt)

    def direct_call(self, f: File, parent: str, a: int, b: int) -> bool:
        """A call entity if the expression is one call, awaited or not."""
        toks = f.source.tokens
        if b > a and toks[b - 1].text == ";":
            b -= 1
        if a < b and toks[a].text == "await":
            a += 1
        for i in range(a, b):
            hit = self.call_at(f, i)
            if hit and hit[0] == a and hit[1] == b:
                name = f.source.slice(a, i + 1)
                self.entity(f, "call", self.eid(f, "call", a, name), parent, a, b, name=name, callee=self.target(f.path, hit[2]))
                return True
            if toks[i].text == "(" and not hit:
                break
        return False

    def declarations(self, f: File, parent: str, a: int, b: int) -> None:
        src, toks = f.source, f.source.tokens
        if b > a and toks[b - 1].text == ";":
            b -= 1
        parts, start, k = [], a, a
        while k < b:
            if toks[k].text == ",":
                parts.append((start, k))
                start = k + 1
            k = src.close.get(k, k) + 1
        for x, y in [*parts, (start, b)]:
            eq = next((i for i in range(x, y) if toks[i].text == "="), None)
            if eq is not None and self.direct_call(f, parent, eq + 1, y):
                continue
            stop = x
            while stop < y and toks[stop].text not in (":", "="):
                stop = src.close.get(stop, stop) + 1
            name = src.slice(x, stop)
            self.entity(f, "variable", self.eid(f, "variable", x, name), parent, x, y, name=name)


def project_rows(texts: Mapping[str, str], names: Collection[str] = RELATIONS) -> Iterator[tuple[str, dict]]:
    """(relation, row) of a project's TypeScript files (path -> text), of the relations named. Each file is parsed for what it
    declares, and again for its rows, so that one parsed file is held at a time."""
    paths = [p for p in sorted(texts) if is_source(p)]
    if "packages" in names:
        dirs = defaultdict(list)
        for p in paths:
            dirs[posixpath.dirname(p) or "."].append(p)
        for d, some in dirs.items():
            yield "packages", {"id": d, "name": d.rsplit("/", 1)[-1], "dir": d, "files": some}
    if not set(names) - {"packages"}:
        return
    project = Project(paths)
    for p in paths:
        project.add(parse(p, texts[p]))
    extractor = Extractor(project, names)
    for p in paths:
        for name, rows in extractor.file(parse(p, texts[p])).items():
            for row in rows:
                yield name, row


def extract(texts: dict[str, str]) -> dict[str, list[dict]]:
    """All relations of a project's TypeScript files (relative path -> text)."""
    out: dict[str, list[dict]] = {name: [] for name in RELATIONS}
    for name, row in project_rows(texts):
        out[name].append(row)
    return out
