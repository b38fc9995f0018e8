"""Declarations of Java, Kotlin and C#: types with their marks (annotations, attributes), bases and members."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.parsers.jsast import OPEN, Node, Script

MODIFIERS = {
    "public", "private", "protected", "internal", "static", "final", "transient", "volatile", "abstract", "synchronized", "native", "strictfp", "default", "override", "virtual",
    "readonly", "required", "lateinit", "open", "sealed", "async", "new", "partial", "const", "data", "inner", "extern", "unsafe", "noinline", "vararg", "annotation", "value", "file",
}
TYPES = {"class", "enum", "record", "interface", "object", "struct"}


@dataclass
class Mark:
    """An annotation or attribute; arguments are token ranges."""

    name: str
    plain: list[tuple[int, int]]
    named: dict[str, tuple[int, int]]
    at: int


@dataclass
class Field:
    name: str
    type: str
    marks: list[Mark]
    modifiers: set[str]
    at: int
    value: tuple[int, int] | None = None
    method: bool = False
    body: tuple[int, int] | None = None

    def mark(self, *names: str) -> Mark | None:
        return next((m for m in self.marks if m.name in names), None)

    @property
    def bare(self) -> str:
        """The type without null, generics and package."""
        return re.sub(r"<.*", "", self.type).rstrip("?! ").rpartition(".")[2]

    @property
    def inner(self) -> str | None:
        """The last generic argument's bare name."""
        m = re.search(r"<(.*)>", self.type)
        return re.sub(r"<.*", "", m[1].split(",")[-1]).strip().rstrip("?! ").rpartition(".")[2].split(" ")[-1] if m else None


@dataclass
class Decl:
    kind: str
    name: str
    marks: list[Mark]
    modifiers: set[str]
    at: int
    bases: list[tuple[str, str | None, int | None]] = field(default_factory=list)
    params: int | None = None
    body: tuple[int, int] | None = None

    def mark(self, *names: str) -> Mark | None:
        return next((m for m in self.marks if m.name in names), None)


class Curly(Script):
    def __init__(self, path: str, text: str, language: str):
        super().__init__(path, text)
        self.language = language

    # Arguments

    def arguments(self, opening: int) -> tuple[list[tuple[int, int]], dict[str, tuple[int, int]]]:
        plain, named = [], {}
        for a, b in self.parts(opening):
            if b - a > 2 and self.tokens[a].kind == "name" and self.is_(a + 1, "=", ":") and not self.is_(a + 2, "=", ":"):
                named[self.tokens[a].text] = (a + 2, b)
            else:
                plain.append((a, b))
        return plain, named

    def texts(self, span: tuple[int, int] | None) -> list[str]:
        """All strings in a range."""
        return [n for n in (self.expr(i, i + 1).string for i in range(*span) if self.tokens[i].kind == "string") if n is not None] if span else []

    def text_of(self, mark: Mark | None, *keys: str, place: int | None = None) -> str | None:
        if mark is None:
            return None
        spans = [mark.named[k] for k in keys if k in mark.named] + ([mark.plain[place]] if place is not None and len(mark.plain) > place else [])
        return next((t[0] for t in map(self.texts, spans) if t), None)

    def word_of(self, mark: Mark | None, key: str) -> str | None:
        """The last name of an argument: ``IDENTITY`` of ``GenerationType.IDENTITY``."""
        span = mark.named.get(key) if mark is not None else None
        return next((self.tokens[i].text for i in range(span[1] - 1, span[0] - 1, -1) if self.tokens[i].kind == "name"), None) if span else None

    # Marks

    def mark_at(self, i: int) -> tuple[Mark, int]:
        """The annotation at ``@``, and where it ends."""
        j = i + 1
        if self.is_(j + 1, ":") and self.is_(j, "field", "get", "set", "param", "property", "file", "setparam"):
            j += 2
        start = j
        while self.is_(j + 1, ".") and j + 2 < len(self.tokens):
            j += 2
        name = self.tokens[j].text if j < len(self.tokens) else ""
        if self.is_(j + 1, "(") and (j + 1 > start):
            plain, named = self.arguments(j + 1)
            return Mark(name, plain, named, i), min(self._close[j + 1] + 1, len(self.tokens))
        return Mark(name, [], {}, i), min(j + 1, len(self.tokens))

    def marks_in(self, span: tuple[int, int] | None) -> list[Mark]:
        """Annotations within an argument, in Kotlin without their sign."""
        out, i = [], span[0] if span else 0
        while span and i < span[1]:
            if self.is_(i, "@"):
                mark, i = self.mark_at(i)
                out.append(mark)
            elif self.tokens[i].kind == "name" and self.is_(i + 1, "(") and self.tokens[i].text[:1].isupper():
                plain, named = self.arguments(i + 1)
                out.append(Mark(self.tokens[i].text, plain, named, i))
                i = self._close[i + 1] + 1
            else:
                i += 1
        return out

    def attributes_at(self, i: int) -> tuple[list[Mark], int]:
        """The C# attributes in the bracket at a place."""
        out = []
        for a, b in self.parts(i):
            if self.is_(a + 1, ":"):
                a += 2
            j = a
            while self.is_(j + 1, ".") and j + 2 < b:
                j += 2
            if j < b:
                plain, named = self.arguments(j + 1) if self.is_(j + 1, "(") else ([], {})
                out.append(Mark(self.tokens[j].text.removesuffix("Attribute"), plain, named, a))
        return out, min(self._close[i] + 1, len(self.tokens))

    # Types

    def angle(self, i: int) -> int:
        """Behind the generic arguments at a place."""
        return self._generic_end(i) if self.is_(i, "<") else i

    def _generic_end(self, i: int) -> int:
        depth = 0
        for j in range(i, min(len(self.tokens), i + 200)):
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if depth == 0:
                    return j + 1
            elif self.is_(j, ";", "{", "}"):
                break
        return i + 1

    def declarations(self) -> Iterator[Decl]:
        marks: list[Mark] = []
        modifiers: set[str] = set()
        i, n = 0, len(self.tokens)
        while i < n:
            if self.language != "cs" and self.is_(i, "@") and not self.is_(i + 1, "interface"):
                mark, i = self.mark_at(i)
                marks.append(mark)
            elif self.language == "cs" and self.is_(i, "[") and (i == 0 or self.is_(i - 1, ";", "{", "}", "]") or self.tokens[i - 1].text.startswith("#") or self.line(i) > self.line(i - 1)):
                more, i = self.attributes_at(i)
                marks += more
            elif self.tokens[i].kind == "name" and self.tokens[i].text in TYPES and not self.is_(i - 1, ".", ":") and i + 1 < n and self.tokens[i + 1].kind == "name":
                j = i
                while self.tokens[j].text in TYPES and j + 1 < n and self.tokens[j + 1].kind == "name" and self.tokens[j + 1].text in TYPES:
                    j += 1
                kind = "enum" if self.is_(i, "enum") else self.tokens[i].text
                if j + 1 >= n:
                    return
                decl = Decl(kind, self.tokens[j + 1].text, marks, modifiers, i)
                i = self._header(decl, self.angle(j + 2))
                marks, modifiers = [], set()
                yield decl
            elif self.tokens[i].kind == "name" and self.tokens[i].text in MODIFIERS:
                modifiers.add(self.tokens[i].text)
                i += 1
            else:
                marks, modifiers = [], set()
                i += 1

    def _header(self, decl: Decl, j: int) -> int:
        """Parameters, bases and body; returns where members begin."""
        n = len(self.tokens)
        first = j
        while j < n and not self.is_(j, "{", ";"):
            if j > first and self.line(j) > self.line(j - 1) and self.language == "kt" and (self.is_(j, "@", "class", "object", "fun", "val", "var", "enum", "interface") or (self.tokens[j].text in MODIFIERS and self.tokens[j].kind == "name")):
                return j
            if self.is_(j, "(") and decl.params is None and not decl.bases:
                decl.params = j
                j = self._close[j] + 1
            elif self.is_(j, "extends", ":") or (decl.bases and self.is_(j, ",")):
                j += 1
                if j >= n:
                    break
                while self.is_(j + 1, ".") and j + 2 < n:
                    j += 2
                if j < n and self.tokens[j].kind == "name":
                    name, k = self.tokens[j].text, self.angle(j + 1)
                    generic = self.between(j + 2, k - 1) if k > j + 2 else None
                    opening = k if self.is_(k, "(") else None
                    decl.bases.append((name, generic, opening))
                    j = self._close[k] + 1 if opening is not None else k
            elif self.is_(j, "implements", "where", "permits"):
                while j < n and not self.is_(j, "{", ";"):
                    j += 1
            else:
                j += 1
        if self.is_(j, "{"):
            decl.body = (j + 1, min(self._close[j], n))
        return j + 1

    # Members

    def fields(self, decl: Decl) -> list[Field]:
        """Parameters of the header, then fields, properties and methods of the body."""
        out = [f for a, b in (self.parts(decl.params) if decl.params is not None else []) if (f := self._param(a, b))]
        return out + (self.members_of(*decl.body) if decl.body else [])

    def _lead(self, i: int, end: int) -> tuple[list[Mark], set[str], int]:
        """Marks and modifiers before a member."""
        marks: list[Mark] = []
        modifiers: set[str] = set()
        while i < end:
            if self.language != "cs" and self.is_(i, "@"):
                mark, i = self.mark_at(i)
                marks.append(mark)
            elif self.language == "cs" and self.is_(i, "["):
                more, i = self.attributes_at(i)
                marks += more
            elif self.tokens[i].kind == "name" and self.tokens[i].text in MODIFIERS and i + 1 < end and (self.tokens[i + 1].kind == "name" or self.is_(i + 1, "@", "(")):
                modifiers.add(self.tokens[i].text)
                i += 1
            else:
                break
        return marks, modifiers, i

    def _param(self, a: int, b: int) -> Field | None:
        marks, modifiers, i = self._lead(a, b)
        if self.language == "kt":
            if not self.is_(i, "val", "var") or i + 1 >= b:
                return None
            stop = next((k for k in self._flat(i + 1, b) if self.is_(k, "=")), b)
            return Field(self.tokens[i + 1].text, self.between(i + 3, stop) if self.is_(i + 2, ":") else "", marks, modifiers, a, (stop + 1, b) if stop < b else None)
        stop = next((k for k in self._flat(i, b) if self.is_(k, "=")), b)
        return Field(self.tokens[stop - 1].text, self.between(i, stop - 1), marks, modifiers, a) if stop - 1 > i else None

    def _flat(self, i: int, end: int) -> Iterator[int]:
        """Tokens outside brackets."""
        while i < end:
            yield i
            i = self._close[i] + 1 if self.is_(i, *OPEN) else i + 1

    def members_of(self, begin: int, end: int) -> list[Field]:
        out, i = [], begin
        while i < end:
            start = i
            marks, modifiers, i = self._lead(i, end)
            if i >= end:
                break
            if self.tokens[i].kind == "name" and self.tokens[i].text in TYPES and i + 1 < end and self.tokens[i + 1].kind == "name":
                i = self._header(Decl("", "", [], set(), i), self.angle(i + 2))
                i = self._close[i - 1] + 1 if self.is_(i - 1, "{") else max(i, start + 1)
                continue
            f, i = (self._kotlin if self.language == "kt" else self._typed)(i, end, marks, modifiers, start)
            if f is not None:
                out.append(f)
            i = max(i, start + 1)
        return out

    def _kotlin(self, i: int, end: int, marks: list[Mark], modifiers: set[str], start: int) -> tuple[Field | None, int]:
        if self.is_(i, "val", "var") and i + 1 < end:
            name, j, type_, value = self.tokens[i + 1].text, i + 2, "", None
            if self.is_(j, ":"):
                k = next((k for k in self._flat(j + 1, end) if self.is_(k, "=", "by", ";") or (k > j + 1 and self.line(k) > self.line(k - 1))), end)
                type_, j = self.between(j + 1, k), k
            if self.is_(j, "=", "by") and j < end:
                k = next((k for k in self._flat(j + 1, end) if self.is_(k, ";") or (k > j + 1 and self.line(k) > self.line(k - 1) and not self.is_(k, ".", "?.", "?") and not self.is_(k - 1, "=", ","))), end)
                value, j = (j + 1, k), k
            return Field(name, type_, marks, modifiers, start, value), max(j, i + 2)
        if self.is_(i, "{"):
            return None, self._close[i] + 1
        if self.is_(i, "init", "constructor", "companion", "fun"):
            body = next((k for k in range(i, min(end, i + 400)) if self.is_(k, "{") or (k > i and self.line(k) > self.line(i) and self.is_(k, "fun", "val", "var", "@", "class"))), end)
            if self.is_(i, "init") and self.is_(body, "{"):
                return Field("init", "", [], set(), i, None, True, (body + 1, min(self._close[body], end))), self._close[body] + 1
            return None, (self._close[body] + 1 if self.is_(body, "{") else max(body, i + 1))
        return None, i + 1

    def _typed(self, i: int, end: int, marks: list[Mark], modifiers: set[str], start: int) -> tuple[Field | None, int]:
        j = i
        while j < end and not self.is_(j, ";", "=", "{", "(", "=>", "}"):
            j = self.angle(j) if self.is_(j, "<") else self._close[j] + 1 if self.is_(j, "[") else j + 1
        if j >= end or self.is_(j, "}"):
            return None, j + 1
        name = self.tokens[j - 1].text if j - 1 > i else ""
        type_ = self.between(i, j - 1) if j - 1 > i else ""
        if self.is_(j, "("):
            k, body = self._close[j] + 1, None
            while k < end and not self.is_(k, "{", ";", "=>"):
                k = self._close[k] + 1 if self.is_(k, "(", "[") else k + 1
            if self.is_(k, "{"):
                body, k = (k + 1, min(self._close[k], end)), self._close[k]
            elif self.is_(k, "=>"):
                stop = next((x for x in self._flat(k, end) if self.is_(x, ";")), end)
                body, k = (k + 1, stop), stop
            return Field(self.tokens[j - 1].text, self.between(i, j - 1) if j - 1 > i else "", marks, modifiers, start, None, True, body), k + 1
        if self.is_(j, "{"):
            if not name:
                return None, self._close[j] + 1
            f = Field(name, type_, marks, modifiers | {"property"}, start)
            if not any(self.is_(k, "get", "set", "init") for k in range(j + 1, min(self._close[j], end))):
                f = None
            elif not any(self.is_(k, "set", "init") for k in range(j + 1, min(self._close[j], end))):
                f.modifiers = f.modifiers | {"getter"}
                if any(self.is_(k, "=>", "return") for k in range(j + 1, min(self._close[j], end))):
                    f.modifiers = f.modifiers | {"computed"}
            k = self._close[j] + 1
            if self.is_(k, "=") and k < end:
                k = next((x for x in self._flat(k, end) if self.is_(x, ";")), end) + 1
            return f, k
        if self.is_(j, "=>"):
            stop = next((x for x in self._flat(j, end) if self.is_(x, ";")), end)
            return (Field(name, type_, marks, modifiers | {"computed"}, start, (j + 1, stop)) if name else None), stop + 1
        stop = next((x for x in self._flat(j, end) if self.is_(x, ";")), end) if self.is_(j, "=") else j
        return (Field(name, type_, marks, modifiers, start, (j + 1, stop) if stop > j else None) if name else None), stop + 1

    def enum_values(self, decl: Decl) -> list[str]:
        if not decl.body:
            return []
        out, fresh = [], True
        for k in self._flat(*decl.body):
            if self.is_(k, ";"):
                break
            if self.is_(k, ","):
                fresh = True
            elif fresh and self.tokens[k].kind == "name" and not self.is_(k - 1, "@"):
                out.append(self.tokens[k].text)
                fresh = False
        return out


def node_text(script: Script, node: Node | None) -> str | None:
    return None if node is None else node.string if node.string is not None else script.of(node)
