"""Rows of the code-model relations from Go texts, without a type checker.

Names resolve by what the file says: package names through imports, receivers and parameters through their written types,
functions through the declarations of the package. What that can't tell stays unresolved, and its call is left out.
Entity ids carry the offset of the node in its file.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Collection, Iterator, Mapping
from dataclasses import dataclass, field

from terrane.sources.lexer import Source
from terrane.sources.schema import RELATIONS

#: Fixed values.
BUILTINS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())
BASIC_TYPES = frozenset("bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any".split())
FILE_OPERATIONS = frozenset("Chdir Chmod Chown Create Mkdir MkdirAll Open OpenFile ReadFile Remove RemoveAll Rename Truncate WriteFile".split())
CGO_NAME = re.compile(r"^(_|_[Cc]go.*|_Cfunc.*|_Ctype.*)$")
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


@dataclass
class Function:
    name: str
    receiver: str  # type name, or ""
    start: int  # token of `func`
    body: int  # token of `{`, or -1
    end: int  # token behind the declaration
    types: dict[str, str] = field(default_factory=dict)  # names of receiver and parameters by written type
    signature: str = ""


@dataclass
class File:
    path: str
    source: Source
    package: str = ""
    imports: dict[str, str] = field(default_factory=dict)
    functions: list[Function] = field(default_factory=list)
    types: list[tuple[str, str, int, int]] = field(default_factory=list)  # name, struct|interface|other, token range
    variables: list[tuple[str, int, int]] = field(default_factory=list)


def _end(src: Source, i: int) -> int:
    """Token behind the statement that starts at i."""
    while i < len(src.tokens):
        t = src.tokens[i]
        if t.kind == "end":
            return i + 1
        if t.text in "([{" and t.kind == "op":
            if i not in src.close:
                return len(src.tokens)
            i = src.close[i]
        elif t.text in ")]}" and t.kind == "op":
            return i
        i += 1
    return i


def _params(src: Source, a: int, b: int) -> dict[str, str]:
    """Names in a parameter list (tokens between its parentheses) by written type without stars; groups share the type behind them."""
    out: dict[str, str] = {}
    waiting: list[str] = []
    i = a
    while i < b:
        j = i
        while j < b and src.tokens[j].text != ",":
            j = src.close.get(j, j) + 1
        part = src.tokens[i:j]
        if part and part[0].kind == "name":
            if len(part) == 1:
                waiting.append(part[0].text)
            else:
                kind = "".join(t.text for t in part[1:]).lstrip("*").removeprefix("...")
                for n in [*waiting, part[0].text]:
                    out[n] = kind.lstrip("*")
                waiting = []
        i = j + 1
    return out


def parse(path: str, text: str) -> File:
    src = Source(text, "go")
    f, toks, i = File(path, src), src.tokens, 0
    while i < len(toks):
        t = toks[i]
        if t.text == "package" and i + 1 < len(toks):
            f.package = toks[i + 1].text
            i = _end(src, i)
        elif t.text == "import":
            end = _end(src, i)
            name = ""
            for u in toks[i + 1 : end]:
                if u.kind == "string":
                    module = u.text.strip('"`')
                    f.imports[name or re.sub(r"^v\d+$", "", module.rsplit("/", 1)[-1]) or module.split("/")[-2]] = module
                    name = ""
                elif u.kind == "name" or u.text == ".":
                    name = u.text
            i = end
        elif t.text == "func":
            i = _function(f, i)
        elif t.text in ("type", "var", "const"):
            end = _end(src, i)
            if i + 1 < len(toks) and toks[i + 1].text == "(":
                k, stop = i + 2, src.close.get(i + 1, end)
                while k < stop:
                    nxt = _end(src, k)
                    _spec(f, t.text, k, k, min(nxt, stop))
                    k = max(nxt, k + 1)
            else:
                _spec(f, t.text, i, i + 1, end)
            i = end
        else:
            if t.kind != "end":
                src.errors.append((src.line(t.start), f"expected declaration, found {t.text}"))
            i = max(_end(src, i), i + 1)
    return f


def _spec(f: File, what: str, start: int, a: int, b: int) -> None:
    toks = f.source.tokens
    while b > a and toks[b - 1].kind == "end":
        b -= 1
    if a >= b or toks[a].kind != "name":
        return
    if what == "type":
        k = a + 1
        if k < b and toks[k].text == "[" and k in f.source.close and f.source.close[k] + 1 < b:
            k = f.source.close[k] + 1
        kind = toks[k].text if k < b and toks[k].text in ("struct", "interface") else "other"
        f.types.append((toks[a].text, kind, start, b))
        return
    for k in range(a, b):
        if toks[k].kind == "name" and (k == a or toks[k - 1].text == ","):
            f.variables.append((toks[k].text, start, b))
        elif toks[k].text != ",":
            break


def _function(f: File, i: int) -> int:
    src, toks = f.source, f.source.tokens
    k, receiver, types = i + 1, "", {}
    if k < len(toks) and toks[k].text == "(":
        close = src.close.get(k, k)
        types = _params(src, k + 1, close)
        written = next(iter(types.values()), "".join(t.text for t in toks[k + 1 : close]).lstrip("*"))
        receiver = re.split(r"[\[\s]", written)[0]
        k = close + 1
    if k >= len(toks) or toks[k].kind != "name":
        return max(_end(src, i), i + 1)
    name = toks[k].text
    k += 1
    if k < len(toks) and toks[k].text == "[":
        k = src.close.get(k, k) + 1
    if k < len(toks) and toks[k].text == "(":
        close = src.close.get(k, k)
        types |= _params(src, k + 1, close)
        sig = k
        k = close + 1
    else:
        sig = k
    body = -1
    while k < len(toks) and toks[k].kind != "end":
        if toks[k].text == "{" and (toks[k - 1].text not in ("struct", "interface")):
            body = k
            break
        k = src.close.get(k, k) + 1
    stop = body if body >= 0 else min(k, len(toks))
    end = (src.close.get(body, len(toks) - 1) if body >= 0 else k - 1) + 1
    f.functions.append(Function(name, receiver, i, body, end, types, "func" + src.slice(sig, stop)))
    return end


class Package:
    """What the files of one directory's package declare; the files themselves aren't held."""

    def __init__(self, pid: str, project: set[str]):
        self.id, self.project = pid, project
        self.functions: set[str] = set()
        self.methods: set[tuple[str, str]] = set()
        self.types: set[str] = set()

    def add(self, f: File) -> None:
        self.functions |= {fn.name for fn in f.functions if not fn.receiver}
        self.methods |= {(fn.receiver, fn.name) for fn in f.functions if fn.receiver}
        self.types |= {t[0] for t in f.types}

    def symbol(self, fn: Function) -> str:
        return f"{self.id}.{fn.receiver}.{fn.name}" if fn.receiver else f"{self.id}.{fn.name}"

    def resolve(self, f: File, names: list[str], types: dict[str, str]) -> tuple[str, str, str] | None:
        """(target id, package, receiver type) of a call of the dotted names, or None."""
        if len(names) == 1:
            n = names[0]
            if n in self.functions:
                return f"{self.id}.{n}", self.id, ""
            if n in BUILTINS and n not in types:
                return n, "", ""
            return None
        head, last = names[0], names[-1]
        if head in types:
            written = re.split(r"[\[\s]", types[head].lstrip("*&"))[0]
            if len(names) == 2:
                if "." in written:
                    pkg, kind = written.split(".", 1)
                    module = f.imports.get(pkg, pkg)
                    return f"{module}.{kind}.{last}", module, kind
                if (written, last) in self.methods or written in self.types:
                    return f"{self.id}.{written}.{last}", self.id, written
            return None
        if head in f.imports and len(names) == 2:
            module = f.imports[head]
            return f"{module}.{last}", module, ""
        return None


def effect_of(package: str, receiver: str, name: str) -> str | None:
    """Kind of effect a call has: the first rule that fits."""
    if package == "net/http":
        return "network"
    if package == "database/sql" or package.endswith(("/database", "/db")) or receiver.lower() == "db":
        return "database"
    if package == "os" and name in FILE_OPERATIONS:
        return "file_system"
    return "log" if package in ("log", "log/slog") else None


class Extractor:
    """Rows of a package, file by file in ascending order of paths; only the relations named."""

    def __init__(self, package: Package, names: Collection[str] = RELATIONS):
        self.package, self.names, self.rows, self.seen = package, names, defaultdict(list), set()

    def range(self, f: File, a: int, b: int) -> dict:
        toks = f.source.tokens
        return {"file": f.path, "start_line": f.source.line(toks[a].start), "end_line": f.source.line(max(toks[b - 1].end - 1, toks[a].start))}

    def file(self, f: File) -> dict[str, list[dict]]:
        """Rows of one file by relation."""
        p, self.rows = self.package, defaultdict(list)
        calls, entities = "calls" in self.names or "effects" in self.names, "entities" in self.names

        def symbol(kind: str, name: str, sid: str, a: int, b: int, signature: str) -> None:
            if "symbols" in self.names and sid not in self.seen and not CGO_NAME.match(name):
                self.seen.add(sid)
                self.rows["symbols"].append({"id": sid, "kind": kind, "name": name, "package": p.id, "source": self.range(f, a, b), "signature": signature, "is_exported": name[:1].isupper(), "is_async": False})

        fid = f"file:{f.path}"
        if entities:
            self.entity(f, "file", fid, "", name=f.path.rsplit("/", 1)[-1], source={"file": f.path, "start_line": 1, "end_line": f.source.lines})
        for fn in f.functions:
            kind = "method" if fn.receiver else "function"
            symbol(kind, fn.name, p.symbol(fn), fn.start, fn.end, fn.signature)
            if calls:
                self.calls(f, fn)
            if entities:
                eid = self.entity(f, kind, self.eid(f, kind, fn.start, fn.name), fid, fn.start, fn.end, name=fn.name, symbol=p.symbol(fn))
                if fn.body >= 0:
                    self.block(f, fn, eid, fn.body)
        for name, kind, a, b in f.types:
            if kind != "other":
                symbol("type" if kind == "struct" else "interface", name, f"{p.id}.{name}", a, b, f"type {name} {kind}")
            what = "interface" if kind == "interface" else "type"
            if entities:
                self.entity(f, what, self.eid(f, what, a, name), fid, a, b, name=name, symbol=f"{p.id}.{name}")
        for name, a, b in f.variables:
            symbol("variable", name, f"{p.id}.{name}", a, b, f.source.slice(a, b))
            if entities and name != "_":
                self.entity(f, "variable", self.eid(f, "variable", a, name), fid, a, b, name=name, symbol=f"{p.id}.{name}")
        return {name: rows for name, rows in self.rows.items() if name in self.names}

    def eid(self, f: File, kind: str, a: int, name: str = "") -> str:
        return f"{kind}:{f.path}{':' + name if name else ''}:{f.source.tokens[a].start}"

    def entity(self, f: File, kind: str, eid: str, parent: str, a: int = 0, b: int = 0, source: dict | None = None, **more) -> str:
        base = {"id": eid, "kind": kind, "name": "", "label": "", "symbol": "", "callee": "", "condition": "", "code": "", "coverage": False, "parent_id": parent, "children": []}
        self.rows["entities"].append(base | {"source": source or self.range(f, a, b)} | more)
        return eid

    def unit(self, f: File, kind: str, parent: str, a: int, b: int, **more) -> str:
        return self.entity(f, kind, self.eid(f, kind, a), parent, a, b, coverage=True, code=f.source.slice(a, b), **more)

    # Calls and effects of a whole body, closures included.
    def calls(self, f: File, fn: Function) -> None:
        if fn.body < 0:
            return
        src, toks, sid = f.source, f.source.tokens, self.package.symbol(fn)
        types = dict(fn.types)
        for i in range(fn.body, fn.end):
            if toks[i].text == "<-" and toks[i - 1].kind == "name" and toks[i - 1].text not in KEYWORDS or toks[i].text == "<-" and toks[i - 1].text in (")", "]"):
                self.rows["effects"].append({"symbol": sid, "kind": "queue", "detail": "channel send", "source": self.range(f, max(i - 1, 0), i + 2)})
            elif toks[i].text == "go" and toks[i].kind == "name":
                self.rows["effects"].append({"symbol": sid, "kind": "other", "detail": "goroutine", "source": self.range(f, i, min(_end(src, i), fn.end))})
            elif (c := self.call_at(f, i, types)) is not None:
                (target, package, receiver), a, b = c
                self.rows["calls"].append({"from": sid, "to": target, "source": self.range(f, a, b)})
                if kind := effect_of(package, receiver, target.rsplit(".", 1)[-1]):
                    self.rows["effects"].append({"symbol": sid, "kind": kind, "detail": target, "source": self.range(f, a, b)})

    def call_at(self, f: File, i: int, types: dict[str, str]):
        """A resolved call whose last name is token i: target, and its token range."""
        toks, src = f.source.tokens, f.source
        if toks[i].kind != "name" or toks[i].text in KEYWORDS or i + 1 >= len(toks) or toks[i + 1].text != "(" or i + 1 not in src.close:
            return None
        a = i
        while a >= 2 and toks[a - 1].text == "." and toks[a - 2].kind == "name":
            a -= 2
        if a and toks[a - 1].text in (".", "func"):
            return None
        hit = self.package.resolve(f, [t.text for t in toks[a : i + 1 : 2]], types)
        return None if hit is None else (hit, a, src.close[i + 1] + 1)

    # Statements.
    def block(self, f: File, fn: Function, parent: str, brace: int) -> None:
        self.statements(f, fn, parent, brace + 1, f.source.close.get(brace, brace + 1))

    def statements(self, f: File, fn: Function, parent: str, a: int, b: int) -> None:
        toks = f.source.tokens
        while a < b:
            if toks[a].kind == "end":
                a += 1
                continue
            end = min(self.statement_end(f, a, b), b)
            self.statement(f, fn, parent, a, end)
            a = max(end, a + 1)

    def statement_end(self, f: File, a: int, b: int) -> int:
        src, toks = f.source, f.source.tokens
        if toks[a].text == "{":
            return src.close.get(a, b - 1) + 1
        if toks[a].text in ("if", "for", "switch", "select") and toks[a].kind == "name":
            k = self.brace(f, a + 1, b)
            end = src.close.get(k, b - 1) + 1
            while toks[a].text == "if" and end < b and toks[end].text == "else":
                k = self.brace(f, end + 1, b)
                end = src.close.get(k, b - 1) + 1
            return end
        return _end(src, a)

    def brace(self, f: File, a: int, b: int) -> int:
        """The `{` of a control statement whose header starts at a."""
        src, toks = f.source, f.source.tokens
        while a < b:
            t = toks[a]
            if t.text == "{" and t.kind == "op":
                if toks[a - 1].text in ("struct", "interface"):
                    a = src.close.get(a, a) + 1
                    continue
                return a
            if t.text == "func" and t.kind == "name":  # a function literal in the header
                while a < b and toks[a].text != "{":
                    a = src.close.get(a, a) + 1 if toks[a].text == "(" else a + 1
                a = src.close.get(a, a) + 1
                continue
            a = src.close.get(a, a) + 1 if t.text in ("(", "[") and t.kind == "op" else a + 1
        return b - 1

    def header(self, f: File, a: int, b: int) -> list[tuple[int, int]]:
        """Parts of a header between semicolons."""
        toks, parts, start, k = f.source.tokens, [], a, a
        while k < b:
            if toks[k].kind == "end":
                parts.append((start, k))
                start = k + 1
            k = f.source.close.get(k, k) + 1
        return [*parts, (start, b)]

    def statement(self, f: File, fn: Function, parent: str, a: int, b: int) -> None:
        src, toks = f.source, f.source.tokens
        word = toks[a].text if toks[a].kind == "name" else ""
        last = b - 1 if toks[b - 1].kind == "end" else b
        if toks[a].text == "{":
            self.block(f, fn, parent, a)
        elif word == "if":
            self.branch(f, fn, parent, a, last)
        elif word == "for":
            brace = self.brace(f, a + 1, b)
            spread = next((k for k in range(a + 1, brace) if toks[k].text == "range" and toks[k].kind == "name"), None)
            if spread is not None:
                eid = self.unit(f, "loop", parent, a, last, name="range", condition=src.slice(spread + 1, brace))
                self.block(f, fn, eid, brace)
                return
            parts = self.header(f, a + 1, brace)
            init, cond, post = (parts + [(0, 0), (0, 0)])[:3] if len(parts) > 1 else ((0, 0), parts[0], (0, 0))
            eid = self.unit(f, "loop", parent, a, last, name="for", condition=src.slice(*cond))
            self.some(f, fn, eid, init)
            self.block(f, fn, eid, brace)
            self.some(f, fn, eid, post)
        elif word == "return":
            self.unit(f, "return", parent, a, last, name="return")
        elif word == "switch":
            self.switch(f, fn, parent, a, last)
        elif word in KEYWORDS or (word and a + 1 < b and toks[a + 1].text == ":" and toks[a + 1].kind == "op"):
            self.unit(f, "statement", parent, a, last)
        else:
            sid = self.unit(f, "statement", parent, a, last)
            assign = next((k for k in self.top(f, a, last) if toks[k].text in ("=", ":=") or re.fullmatch(r"[-+*/%&|^]=|<<=|>>=", toks[k].text)), None)
            plain = not any(toks[k].text in ("<-", "++", "--") and k != a for k in self.top(f, a, last))
            if assign is not None or plain:
                if assign is not None and toks[assign].text == ":=":
                    self.note_types(f, fn, a, assign, last)
                self.nested(f, fn, sid, a if assign is None else assign + 1, last)

    def note_types(self, f: File, fn: Function, a: int, assign: int, last: int) -> None:
        """x := T{...}, &T{...} or new(T) tells x's type to calls behind it."""
        toks = f.source.tokens
        if assign == a + 1:
            m = re.match(r"&?([A-Za-z_][\w.]*)\{|new\(([\w.]+)\)", "".join(t.text for t in toks[assign + 1 : min(last, assign + 8)]))
            if m:
                fn.types.setdefault(toks[a].text, m[1] or m[2])

    def some(self, f: File, fn: Function, parent: str, part: tuple[int, int]) -> None:
        if part[1] > part[0]:
            self.statement(f, fn, parent, *part)

    def top(self, f: File, a: int, b: int):
        """Tokens from a to b outside brackets."""
        while a < b:
            yield a
            a = f.source.close.get(a, a) + 1

    def branch(self, f: File, fn: Function, parent: str, a: int, b: int) -> None:
        src, toks = f.source, f.source.tokens
        brace = self.brace(f, a + 1, b)
        parts = self.header(f, a + 1, brace)
        eid = self.unit(f, "if", parent, a, b, name="if", condition=src.slice(*parts[-1]))
        for part in parts[:-1]:
            self.some(f, fn, eid, part)
        self.block(f, fn, eid, brace)
        k = src.close.get(brace, b) + 1
        if k < b and toks[k].text == "else":
            other = self.entity(f, "else", self.eid(f, "else", k + 1), eid, k + 1, b, name="else", coverage=True, code=src.slice(k + 1, b))
            if toks[k + 1].text == "if":
                self.branch(f, fn, other, k + 1, b)
            else:
                self.block(f, fn, other, k + 1)

    def switch(self, f: File, fn: Function, parent: str, a: int, b: int) -> None:
        src, toks = f.source, f.source.tokens
        brace = self.brace(f, a + 1, b)
        parts = [p for p in self.header(f, a + 1, brace)]
        by_type = any(toks[k].text == "type" and toks[k - 1].text == "(" for k in range(parts[-1][0], parts[-1][1]))
        eid = self.unit(f, "switch", parent, a, b, name="type switch" if by_type else "switch", condition="" if by_type else src.slice(*parts[-1]))
        if by_type:
            self.some(f, fn, eid, parts[-1])
        else:
            for part in parts[:-1]:
                self.some(f, fn, eid, part)
        k, stop = brace + 1, src.close.get(brace, b)
        starts = [i for i in self.top(f, k, stop) if toks[i].kind == "name" and toks[i].text in ("case", "default")]
        for i, nxt in zip(starts, [*starts[1:], stop]):
            colon = next((j for j in self.top(f, i, nxt) if toks[j].text == ":"), i)
            end = nxt
            while end > colon + 1 and toks[end - 1].kind == "end":
                end -= 1
            cid = self.unit(f, "case", eid, i, end, name="case")
            self.statements(f, fn, cid, colon + 1, nxt)

    def nested(self, f: File, fn: Function, parent: str, a: int, b: int) -> None:
        """Call entities in an expression: an outer call before those inside it, function literals left alone, project callees only."""
        src, toks = f.source, f.source.tokens
        found = []
        i = a
        while i < b:
            if toks[i].text == "func" and toks[i].kind == "name":
                while i < b and toks[i].text != "{":
                    i = src.close.get(i, i) + 1
                i = src.close.get(i, i) + 1
                continue
            hit = self.call_at(f, i, fn.types)
            if hit is not None and hit[0][1] in self.package.project:
                found.append((hit[1], -hit[2], hit))
            i += 1
        for _, _, ((target, _, _), x, y) in sorted(found, key=lambda r: r[:2]):
            name = target.rsplit(".", 1)[-1]
            self.entity(f, "call", self.eid(f, "call", x, name), parent, x, y, name=name, callee=target, code=src.slice(x, y))


def package_id(module: str, folder: str) -> str:
    return f"{module}/{folder}" if folder else module


def package_rows(module: str, folder: str, texts: Mapping[str, str], folders: Collection[str], names: Collection[str] = RELATIONS) -> Iterator[tuple[str, dict]]:
    """(relation, row) of one folder's files (path -> text), of the relations named; folders: those of the whole project. Each file is
    parsed for what it declares, and again for its rows, so that one parsed file is held at a time. A package with a syntax error
    gives its package row and the errors only; test files are listed, but not read for symbols."""
    paths = sorted(texts)
    code = [p for p in paths if not p.endswith("_test.go")]
    if not code:
        return
    pid = package_id(module, folder)
    if "packages" in names:
        yield "packages", {"id": pid, "name": parse(code[0], texts[code[0]]).package, "dir": folder or ".", "files": paths}
    if not set(names) - {"packages"}:
        return
    package, broken = Package(pid, {package_id(module, d) for d in folders}), False
    for path in code:
        f = parse(path, texts[path])
        package.add(f)
        for n, m in f.source.errors:
            broken = True
            if "errors" in names:
                yield "errors", {"file": path, "message": m, "start_line": max(n, 1), "end_line": max(n, 1)}
    if broken or not set(names) - {"packages", "errors"}:
        return
    extractor = Extractor(package, names)
    for path in code:
        for name, rows in extractor.file(parse(path, texts[path])).items():
            for row in rows:
                yield name, row


def extract(module: str, texts: dict[str, str]) -> dict[str, list[dict]]:
    """All relations of a module's files (relative path -> text)."""
    dirs: dict[str, dict[str, str]] = defaultdict(dict)
    for path, text in texts.items():
        dirs[path.rsplit("/", 1)[0] if "/" in path else ""][path] = text
    out: dict[str, list[dict]] = {name: [] for name in RELATIONS}
    for d in sorted(dirs):
        for name, row in package_rows(module, d, dirs[d], list(dirs)):
            out[name].append(row)
    return out
