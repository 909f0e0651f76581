"""A token scanner for Go and TypeScript: enough to find declarations, statements and calls without a compiler."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}

_COMMON = r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_GO = re.compile(_COMMON + r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`)|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<op><-|:=|\.\.\.|&&|\|\||\+\+|--|[-+*/%&|^<>=!]=|<<=|>>=|<<|>>|.)", re.S)
_TS = re.compile(_COMMON + r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<name>[#$]?[^\W\d][\w$]*|\$)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|===|!==|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*|[-+*/%&|^<>=!]=|.)", re.S)


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, op, end (statement end that a line break brings)
    text: str
    start: int
    end: int


class Source:
    """Text, tokens, and for each opening bracket the index of its closing one."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokens = self._go() if language == "go" else self._ts()
        self.close: dict[int, int] = {}
        self.errors: list[tuple[int, str]] = []
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in CLOSE:
                if stack and OPEN[self.tokens[stack[-1]].text] == t.text:
                    self.close[stack.pop()] = i
                else:
                    self.errors.append((self.line(t.start), f"unexpected {t.text}"))
        self.errors += [(self.line(self.tokens[i].start), f"{self.tokens[i].text} is not closed") for i in stack]

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    @property
    def lines(self) -> int:
        return len(self.breaks) + 1

    def slice(self, a: int, b: int) -> str:
        """Text of tokens a to b, b not included, trimmed."""
        return self.text[self.tokens[a].start : self.tokens[b - 1].end].strip() if b > a else ""

    def _go(self) -> list[Token]:
        out: list[Token] = []

        def ends() -> bool:
            return bool(out) and (out[-1].kind in ("number", "string") or out[-1].text in (")", "]", "}", "++", "--") or (out[-1].kind == "name" and out[-1].text not in _GO_OPEN))

        for m in _GO.finditer(self.text):
            kind = m.lastgroup or "op"
            if kind in ("space", "comment"):
                if "\n" in m[0] and ends():
                    out.append(Token("end", ";", m.start(), m.start()))
                continue
            out.append(Token("op" if m[0] != ";" else "end", m[0], m.start(), m.end()) if kind == "op" else Token(kind, m[0], m.start(), m.end()))
        if ends():
            out.append(Token("end", ";", len(self.text), len(self.text)))
        return out

    def _ts(self) -> list[Token]:
        out: list[Token] = []
        at, text = 0, self.text
        while at < len(text):
            if text[at] == "`":
                end = self._template(at)
                out.append(Token("string", text[at:end], at, end))
                at = end
                continue
            if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (not out or out[-1].text in _BEFORE_REGEX):
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(text, at)
                if m:
                    out.append(Token("string", m[0], at, m.end()))
                    at = m.end()
                    continue
            m = _TS.match(text, at)
            kind = m.lastgroup or "op"
            if kind not in ("space", "comment"):
                out.append(Token(kind, m[0], m.start(), m.end()))
            at = m.end()
        return out

    def _template(self, at: int) -> int:
        """End of the template literal that starts here; nested ones are skipped."""
        at += 1
        while at < len(self.text):
            c = self.text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif c == "$" and self.text[at : at + 2] == "${":
                depth, at = 1, at + 2
                while at < len(self.text) and depth:
                    if self.text[at] == "`":
                        at = self._template(at)
                        continue
                    depth += {"{": 1, "}": -1}.get(self.text[at], 0)
                    at += 1
            else:
                at += 1
        return len(self.text)


_GO_OPEN = frozenset("case chan const default defer else for func go goto if import interface map package range select struct switch type var".split())
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || return typeof case".split())
