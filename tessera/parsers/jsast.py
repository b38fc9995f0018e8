"""JavaScript and TypeScript sources: tokens, expressions, classes; tolerant of half-typed files.

Only what declarations are made of is read into nodes: literals, names, members,
calls, objects, arrays and functions.  Other operators make a ``raw`` node with
their source text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.model import Source
from tessera.parsers.tokens import Lines, unescaped

_TOKEN = re.compile(
    r"(?P<skip>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*(?:'|(?=\n|\Z))|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n|\Z)))"
    r"|(?P<template>`(?:\\.|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*(?:`|\Z))|(?P<name>[A-Za-z_$#][\w$]*|[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\?\.|\.\.\.|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Expressions within each other that are read; real ones have far fewer.
DEEPEST = 60
MODIFIERS = {"public", "private", "protected", "readonly", "static", "declare", "abstract", "override", "async", "get", "set", "accessor"}


@dataclass(slots=True)
class Tok:
    kind: str
    text: str
    start: int
    end: int


@dataclass(slots=True)
class Node:
    """``kind``: str, num, name, member, call, obj, arr, fn or raw; ``value``: the literal, name or property."""

    kind: str
    begin: int
    end: int
    value: str = ""
    of: Node | None = None
    items: list = field(default_factory=list)
    new: bool = False

    def get(self, key: str) -> Node | None:
        """A property of an object literal, the last of that name."""
        return next((v for k, v in reversed(self.items) if k == key), None) if self.kind == "obj" else None

    @property
    def string(self) -> str | None:
        return self.value if self.kind == "str" else None

    @property
    def true(self) -> bool:
        return self.kind == "name" and self.value == "true"

    @property
    def false(self) -> bool:
        return self.kind == "name" and self.value == "false"

    @property
    def path(self) -> str:
        """``a.b.c`` of names and members, through calls."""
        if self.kind == "name":
            return self.value
        if self.kind == "member":
            return f"{self.of.path}.{self.value}".lstrip(".")
        return self.of.path if self.kind == "call" else ""

    @property
    def tail(self) -> str:
        return self.path.rpartition(".")[2]

    def chain(self) -> list[tuple[str, list[Node] | None, Node]]:
        """Steps from the root: name, arguments if it is called, node."""
        out: list[tuple[str, list[Node] | None, Node]] = []
        node: Node | None = self
        while node is not None:
            if node.kind == "call":
                callee = node.of
                out.append((callee.value if callee.kind in ("name", "member") else "", node.items, node))
                node = callee.of if callee.kind == "member" else (callee if callee.kind == "call" else None)
            elif node.kind in ("member", "name"):
                out.append((node.value, None, node))
                node = node.of if node.kind == "member" else None
            else:
                break
        return out[::-1]


@dataclass
class Member:
    name: str
    decorators: list[Node]
    type: str
    optional: bool
    value: Node | None
    body: tuple[int, int] | None
    modifiers: set[str]
    at: int

    def decorator(self, *names: str) -> Node | None:
        return next((d for d in self.decorators if d.tail in names), None)


@dataclass
class Class:
    name: str
    base: Node | None
    decorators: list[Node]
    abstract: bool
    members: list[Member]
    at: int
    body: tuple[int, int]

    def decorator(self, *names: str) -> Node | None:
        return next((d for d in self.decorators if d.tail in names), None)


class Script:
    def __init__(self, path: str, text: str):
        self.path, self.text, self.lines = path, text.replace("\0", " "), Lines(text)
        self.tokens: list[Tok] = []
        self.comments: dict[int, str] = {}
        self._scan()
        self._memo: dict[tuple[int, int], Node] = {}
        self._depth = 0
        self._close = self._match()

    def _scan(self) -> None:
        at, text = 0, self.text
        while at < len(text):
            if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (not self.tokens or self.tokens[-1].text in "(,=:[!&|?{};=>" or self.tokens[-1].text == "return"):
                if m := _REGEX.match(text, at):
                    self.tokens.append(Tok("regex", m[0], at, m.end()))
                    at = m.end()
                    continue
            m = _TOKEN.match(text, at)
            if m.lastgroup == "comment":
                self.comments[len(self.tokens)] = (self.comments.get(len(self.tokens), "") + "\n" + m[0]).strip()
            elif m.lastgroup != "skip":
                self.tokens.append(Tok("string" if m.lastgroup == "template" else m.lastgroup, m[0], at, m.end()))
            at = m.end()

    def _match(self) -> dict[int, int]:
        """The closing token of each opening one; unclosed ones end with the file."""
        stacks: dict[str, list[int]] = {o: [] for o in OPEN}
        back = {c: o for o, c in OPEN.items()}
        out: dict[int, int] = {}
        for i, t in enumerate(self.tokens):
            if t.kind == "sign":
                if t.text in OPEN:
                    stacks[t.text].append(i)
                elif t.text in back and stacks[back[t.text]]:
                    out[stacks[back[t.text]].pop()] = i
        for left in stacks.values():
            out.update(dict.fromkeys(left, len(self.tokens)))
        return out

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind != "string" and self.tokens[i].text in texts

    def line(self, i: int) -> int:
        return self.lines.at(self.tokens[min(i, len(self.tokens) - 1)].start) if self.tokens else 0

    def source(self, i: int) -> Source:
        return Source(self.path, self.line(i))

    def between(self, begin: int, end: int) -> str:
        return re.sub(r"\s+", " ", self.text[self.tokens[begin].start : self.tokens[end - 1].end]) if begin < end <= len(self.tokens) else ""

    def of(self, node: Node) -> str:
        return self.between(node.begin, node.end)

    def comment(self, i: int) -> str | None:
        """What is said right before a token."""
        said = self.comments.get(i)
        if not said:
            return None
        return re.sub(r"\s+", " ", re.sub(r"(?m)^\s*(?://+|/\*+|\*(?!/))|\*/", " ", said)).strip() or None

    # Expressions

    def parts(self, opening: int) -> list[tuple[int, int]]:
        """Token ranges between commas inside brackets."""
        end, out, begin, i = self._close.get(opening, len(self.tokens)), [], opening + 1, opening + 1
        while i < end:
            t = self.tokens[i]
            if t.kind == "sign" and t.text in OPEN:
                i = min(self._close[i], end)
            elif t.kind == "sign" and t.text == ",":
                out.append((begin, i))
                begin = i + 1
            i += 1
        out.append((begin, end))
        return [(a, b) for a, b in out if a < b]

    def expr(self, begin: int, end: int) -> Node:
        """The expression in a token range."""
        i = begin
        while self.is_(i, "await", "async") and i < end:
            i += 1
        if fn := self._function(i, end):
            return fn
        if i >= end:
            return Node("raw", begin, end)
        node = self.postfix(i, end)
        while self.is_(node.end, "as", "satisfies", "!") and node.end < end:
            if self.is_(node.end, "!"):
                node = Node(node.kind, node.begin, node.end + 1, node.value, node.of, node.items, node.new)
                continue
            return Node(node.kind, node.begin, end, node.value, node.of, node.items, node.new)
        return node if node.end >= end else Node("raw", begin, end)

    def _function(self, i: int, end: int) -> Node | None:
        """An arrow function or function expression: items are its parameter range and body range; ``of`` an expression body."""
        if self.is_(i, "function"):
            j = i + 1
            while j < end and not self.is_(j, "("):
                j += 1
            close = self._close.get(j, end)
            k = close
            while k < end and not self.is_(k, "{"):
                k += 1
            return Node("fn", i, min(self._close.get(k, end) + 1, end), items=[(j + 1, close), (k + 1, min(self._close.get(k, end), end))])
        params, j = None, i
        if self.is_(i, "("):
            close = self._close[i]
            params, j = (i + 1, close), close + 1
            if self.is_(j, ":"):
                while j < end and not self.is_(j, "=>"):
                    j = self._close[j] + 1 if self.is_(j, *OPEN) else j + 1
        elif i < end and self.tokens[i].kind == "name" and self.is_(i + 1, "=>"):
            params, j = (i, i + 1), i + 1
        if params is None or not self.is_(j, "=>") or j >= end:
            return None
        if self.is_(j + 1, "{"):
            stop = min(self._close[j + 1], end)
            return Node("fn", i, min(stop + 1, end), items=[params, (j + 2, stop)])
        inner = self.expr(j + 1, end)
        if self.is_(j + 1, "(") and self._close[j + 1] >= end - 1:
            inner = self.expr(j + 2, min(self._close[j + 1], end))
        return Node("fn", i, end, of=inner, items=[params, (j + 1, end)])

    def postfix(self, i: int, end: int | None = None) -> Node:
        """A primary with its members, calls and subscripts; what is nested too deep is raw."""
        end = len(self.tokens) if end is None else end
        if (i, end) in self._memo:
            return self._memo[i, end]
        if self._depth >= DEEPEST:
            return Node("raw", i, max(end, i))
        self._depth += 1
        try:
            node = self._memo[i, end] = self._postfix(i, end)
        finally:
            self._depth -= 1
        return node

    def _postfix(self, i: int, end: int) -> Node:
        new = self.is_(i, "new")
        begin = i
        i += new
        node = self._primary(i, end)
        while node.end < end:
            j = node.end
            if self.is_(j, ".", "?.") and j + 1 < end and self.tokens[j + 1].kind == "name":
                node = Node("member", begin, j + 2, self.tokens[j + 1].text, node)
            elif self.is_(j, "<") and (k := self._generic(j, end)) and self.is_(k, "("):
                node = Node(node.kind, begin, k, node.value, node.of, node.items, node.new)
            elif self.is_(j, "("):
                node = Node("call", begin, min(self._close[j] + 1, end), of=node, items=[self.expr(a, b) for a, b in self.parts(j)], new=new)
                new = False
            elif self.is_(j, "[") and node.kind in ("name", "member", "call"):
                inside = self.parts(j)
                key = self.expr(*inside[0]) if inside else None
                node = Node("member", begin, min(self._close[j] + 1, end), (key.string if key else None) or "", node)
            elif self.is_(j, "!") and self.is_(j + 1, ".", "(", "["):
                node = Node(node.kind, begin, j + 1, node.value, node.of, node.items, node.new)
            else:
                break
        return node

    def _generic(self, i: int, end: int) -> int | None:
        depth = 0
        for j in range(i, min(end, i + 60)):
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if depth == 0:
                    return j + 1
            elif self.is_(j, ";", "(", ")", "=>", "="):
                return None
        return None

    def _primary(self, i: int, end: int) -> Node:
        if i >= end or i >= len(self.tokens):
            return Node("raw", i, i + 1 if i < end else i)
        t = self.tokens[i]
        if t.kind == "string":
            return Node("str", i, i + 1, unescaped(t.text))
        if t.kind == "number" or (self.is_(i, "-") and i + 1 < end and self.tokens[i + 1].kind == "number"):
            width = 1 if t.kind == "number" else 2
            return Node("num", i, i + width, self.between(i, i + width))
        if t.kind == "name":
            return Node("name", i, i + 1, t.text)
        if t.text == "[":
            return Node("arr", i, min(self._close[i] + 1, end), items=[self.expr(a, b) for a, b in self.parts(i)])
        if t.text == "{":
            return self._object(i, end)
        if t.text == "(":
            inner = self.parts(i)
            close = min(self._close[i] + 1, end)
            if len(inner) == 1:
                node = self.expr(*inner[0])
                return Node(node.kind, i, close, node.value, node.of, node.items, node.new)
            return Node("raw", i, close)
        return Node("raw", i, i + 1)

    def _object(self, i: int, end: int) -> Node:
        """Properties in order; a spread has the key ``...``, a method a function."""
        items = []
        for a, b in self.parts(i):
            t = self.tokens[a]
            if self.is_(a, "..."):
                items.append(("...", self.expr(a + 1, b)))
                continue
            while t.text in ("async", "get", "set", "*") and a + 1 < b and self.tokens[a + 1].kind in ("name", "string") and t.kind != "string":
                a += 1
                t = self.tokens[a]
            key = unescaped(t.text) if t.kind == "string" else t.text
            if t.text == "[" and t.kind == "sign":
                inner, close = self.parts(a), self._close[a]
                key = (self.expr(*inner[0]).string or self.expr(*inner[0]).tail) if inner else ""
                items.append((key, self.expr(close + 2, b)) if self.is_(close + 1, ":") else (key, Node("raw", a, b)))
            elif self.is_(a + 1, ":") and a + 1 < b:
                items.append((key, self.expr(a + 2, b)))
            elif self.is_(a + 1, "(") and a + 1 < b:
                close = self._close[a + 1]
                k = close
                while k < b and not self.is_(k, "{"):
                    k += 1
                items.append((key, Node("fn", a, b, items=[(a + 2, close), (k + 1, min(self._close.get(k, b), b))])))
            elif t.kind == "name":
                items.append((key, Node("name", a, a + 1, key)))
        return Node("obj", i, min(self._close[i] + 1, end), items=items)

    # Whole files

    def chains(self, begin: int = 0, end: int | None = None) -> Iterator[Node]:
        """Every expression that starts with a name, outer ones first."""
        end = len(self.tokens) if end is None else end
        for i in range(begin, end):
            t = self.tokens[i]
            if t.kind == "name" and not self.is_(i - 1, ".", "?.", "new") and (self.is_(i + 1, ".", "(", "?.", "<") or t.text == "new"):
                node = self.postfix(i)
                if node.kind == "call":
                    yield node

    def assigned(self, i: int) -> str | None:
        """The variable or property that the expression at a token is assigned to."""
        j = i - 1
        while self.is_(j, "await", "new", "("):
            j -= 1
        if self.is_(j, "=", ":") and j > 0:
            k = j - 1
            if self.is_(j, "=") and self.tokens[k].kind in ("name", "sign"):
                for m in range(k, max(k - 30, -1), -1):
                    if self.is_(m, "const", "let", "var", "export", "static"):
                        return self.tokens[m + 1].text if self.tokens[m + 1].text not in ("const", "let", "var") else self.tokens[m + 2].text
                    if self.is_(m, ";", "}", "{"):
                        break
            return self.tokens[k].text if self.tokens[k].kind == "name" else None
        return None

    def imports(self) -> list[str]:
        return [unescaped(self.tokens[i + 1].text) for i in range(len(self.tokens) - 1) if self.is_(i, "from", "import") and self.tokens[i + 1].kind == "string"] + [
            n.items[0].string for n in self.chains() if n.path == "require" and n.items and n.items[0].string
        ]

    def renamed(self, package: str) -> dict[str, str]:
        """What a package's exports are called here, by the names that imports give them: ``import { a as b }``."""
        out: dict[str, str] = {}
        for i in range(len(self.tokens)):
            if not (self.is_(i, "import") and (opening := next((k for k in (i + 1, i + 2) if self.is_(k, "{")), None))):
                continue
            close = self._close[opening]
            if self.is_(close + 1, "from") and close + 2 < len(self.tokens) and unescaped(self.tokens[close + 2].text).startswith(package):
                for a, b in self.parts(opening):
                    words = [t.text for t in self.tokens[a:b] if t.text != "type"]
                    if len(words) == 3 and words[1] == "as":
                        out[words[2]] = words[0]
        return out

    def object_named(self, name: str) -> Node | None:
        """The object literal that a constant of this name is."""
        for i in range(len(self.tokens) - 3):
            if self.is_(i, "const", "let", "var") and self.tokens[i + 1].text == name and self.is_(i + 2, "=") and self.is_(i + 3, "{"):
                return self.expr(i + 3, self._close[i + 3] + 1)
        return None

    def interfaces(self) -> Iterator[tuple[str, tuple[int, int]]]:
        """Interfaces by name, with the tokens of their bodies."""
        for i in range(len(self.tokens) - 2):
            if self.is_(i, "interface") and self.tokens[i + 1].kind == "name":
                opening = next((k for k in range(i + 2, min(i + 60, len(self.tokens))) if self.is_(k, "{")), None)
                if opening is not None:
                    yield self.tokens[i + 1].text, (opening + 1, self._close[opening])

    def classes(self) -> Iterator[Class]:
        held: list[Node] = []
        abstract, i = False, 0
        while i < len(self.tokens):
            if self.is_(i, "@"):
                node = self.postfix(i + 1)
                held.append(node)
                i = max(node.end, i + 1)
                continue
            if self.is_(i, "class") and not self.is_(i - 1, ".") and not self.is_(i + 1, ":", "=", ",", ")", "("):
                j = i + 1
                name = self.tokens[j].text if j < len(self.tokens) and self.tokens[j].kind == "name" and self.tokens[j].text not in ("extends", "implements") else ""
                base = None
                while j < len(self.tokens) and not self.is_(j, "{"):
                    if self.is_(j, "extends"):
                        base = self.postfix(j + 1)
                        j = max(base.end, j + 1)
                        while self.is_(j, "<") and (k := self._generic(j, len(self.tokens))):
                            j = k
                    else:
                        j += 1
                body = (j + 1, self._close.get(j, len(self.tokens)))
                yield Class(name, base, held, abstract, self.members(*body), i, body)
                held, abstract = [], False
                i = j + 1
                continue
            if self.is_(i, "abstract"):
                abstract = True
            elif not self.is_(i, "export", "default", "declare"):
                held, abstract = [], False
            i += 1

    def members(self, begin: int, end: int) -> list[Member]:
        out, i = [], begin
        while i < end:
            start, held, modifiers = i, [], set()
            while self.is_(i, "@") and i < end:
                node = self.postfix(i + 1, end)
                held.append(node)
                i = max(node.end, i + 1)
            while i + 1 < end and self.tokens[i].text in MODIFIERS and self.tokens[i].kind == "name" and (self.tokens[i + 1].kind in ("name", "string") or self.is_(i + 1, "[", "*", "@")):
                modifiers.add(self.tokens[i].text)
                i += 1
                while self.is_(i, "@") and i < end:
                    node = self.postfix(i + 1, end)
                    held.append(node)
                    i = max(node.end, i + 1)
            if i >= end:
                break
            t = self.tokens[i]
            if t.kind not in ("name", "string"):
                i = self._close[i] + 1 if self.is_(i, *OPEN) else i + 1
                continue
            name = unescaped(t.text) if t.kind == "string" else t.text
            at, i, optional, type_, value = i, i + 1, False, "", None
            if self.is_(i, "?", "!"):
                optional = self.is_(i, "?")
                i += 1
            if self.is_(i, "<") and (k := self._generic(i, end)):
                i = k
            if self.is_(i, "("):
                i = self._close[i] + 1
                while i < end and not self.is_(i, "{", ";") and not (self.line(i) > self.line(i - 1) and not self.is_(i, "|", "&")):
                    i = self._close[i] + 1 if self.is_(i, *OPEN) and not self.is_(i, "{") else i + 1
                body = (i + 1, self._close[i]) if self.is_(i, "{") else None
                i = body[1] + 1 if body else i
                out.append(Member(name, held, "", optional, None, body, modifiers, start))
                continue
            if self.is_(i, ":"):
                stop = self._until(i + 1, end, "=")
                type_ = self.between(i + 1, stop)
                i = stop
            if self.is_(i, "=") and i < end:
                stop = self._until(i + 1, end, ";")
                value = self.expr(i + 1, stop)
                i = stop
            out.append(Member(name, held, type_, optional, value, None, modifiers, start))
            i += self.is_(i, ";", ",")
            i = max(i, at + 1)
        return out

    def _until(self, i: int, end: int, sign: str) -> int:
        """Where a type or initial value ends: at a sign, a semicolon, or a new line that starts another member."""
        begin, depth = i, 0
        while i < end:
            if depth == 0 and self.is_(i, sign, ";"):
                return i
            t = self.tokens[i]
            if depth == 0 and i > begin and self.line(i) > self.line(i - 1) and not self.is_(i, "|", "&", ".", "?", ":", "?.") and not self.is_(i - 1, "|", "&", "=>", ":", "="):
                return i
            if t.kind == "sign" and t.text in OPEN:
                i = min(self._close[i], end - 1) + 1
                continue
            depth += self.is_(i, "<") - (self.is_(i, ">") and depth > 0)
            i += 1
        return end


def arrow_target(node: Node | None) -> str | None:
    """The model in ``() => User``, ``'User'`` or ``User``."""
    if node is None:
        return None
    if node.kind == "fn":
        return arrow_target(node.of) if node.of is not None else None
    return node.string or node.tail or None


def strings(node: Node | None) -> list[str]:
    """Texts of an array, or a single one."""
    if node is None:
        return []
    if node.kind == "arr":
        return [x.value for x in node.items if x.kind == "str"]
    return [node.value] if node.kind == "str" else []
