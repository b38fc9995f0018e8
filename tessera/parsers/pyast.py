"""Python sources as syntax trees, also where a file is half typed.

What does not parse as a whole is parsed block by block; of a block that fails,
the longest run of leading lines that parses is kept.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

from tessera.model import Source

def _try(text: str) -> tuple[ast.Module | None, int]:
    """The tree, or the line at which it breaks off (0 if that isn't known)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text), 0
    except SyntaxError as error:
        return None, error.lineno or 0
    except (ValueError, RecursionError, MemoryError):
        return None, 0


def _leading(lines: list[str]) -> ast.Module | None:
    """The tree of the leading lines that parse: those before each error in turn, or fewer and fewer where it lies at the end."""
    size, step = len(lines), 1
    while size > 0:
        found, line = _try("\n".join(lines[:size]))
        if found:
            return found
        if 1 < line <= size:
            size = line - 1
        else:
            size, step = size - step, 2 * step
    return None


def tree(text: str) -> list[ast.stmt]:
    """Top-level statements with the lines of the file."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", " ").removeprefix("﻿").expandtabs(8)
    if whole := _try(text)[0]:
        return whole.body
    lines = text.split("\n")
    starts = [i for i, line in enumerate(lines) if line[:1].strip() and line[0] not in ")]}#'\""]
    starts = [i for i in starts if not (lines[i].startswith(("else", "elif", "except", "finally")))]
    out: list[ast.stmt] = []
    joined: list[int] = []
    for i, start in enumerate(starts):
        joined.append(start)
        end = starts[i + 1] if i + 1 < len(starts) else len(lines)
        if lines[start].startswith("@"):
            continue
        if found := _leading(lines[joined[0] : end]):
            for node in found.body:
                ast.increment_lineno(node, joined[0])
            out += found.body
        joined = []
    return out


def classes(body: list[ast.stmt]) -> Iterator[ast.ClassDef]:
    """All classes but ``Meta``, outer ones first."""
    for node in body:
        if isinstance(node, ast.ClassDef):
            if node.name != "Meta":
                yield node
            yield from classes(node.body)
        elif isinstance(node, (ast.If, ast.Try, ast.With)):
            yield from classes(node.body)


def dotted(node: ast.AST | None) -> str:
    """``a.b.c`` of names and attributes, through subscripts and calls; empty otherwise."""
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}".lstrip(".")
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, (ast.Subscript, ast.Call)):
        return dotted(node.value if isinstance(node, ast.Subscript) else node.func)
    return ""


def tail(text: str) -> str:
    return text.rpartition(".")[2]


def base_names(node: ast.ClassDef) -> list[str]:
    return [n for n in (tail(dotted(b)) for b in node.bases) if n]


def string(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def strings(node: ast.AST | None) -> list[str]:
    """All texts inside, in order."""
    return [x.value for x in ast.walk(node) if isinstance(x, ast.Constant) and isinstance(x.value, str)] if node is not None else []


def true(node: ast.AST | None) -> bool:
    return isinstance(node, ast.Constant) and node.value is True


def source_text(node: ast.AST) -> str:
    return ast.unparse(node)


def reference(node: ast.AST | None) -> str:
    """A text or a dotted name."""
    return string(node) or dotted(node)


@dataclass
class Call:
    """A call with its arguments at hand."""

    node: ast.Call

    @classmethod
    def of(cls, node: ast.AST | None) -> Call | None:
        return cls(node) if isinstance(node, ast.Call) else None

    @property
    def name(self) -> str:
        return tail(dotted(self.node.func))

    def arg(self, place: int | None, *names: str) -> ast.AST | None:
        for keyword in self.node.keywords:
            if keyword.arg in names:
                return keyword.value
        return self.node.args[place] if place is not None and place < len(self.node.args) else None

    def string(self, place: int | None, *names: str) -> str | None:
        return string(self.arg(place, *names))

    def flag(self, name: str) -> bool | None:
        value = self.arg(None, name)
        return value.value if isinstance(value, ast.Constant) and isinstance(value.value, bool) else None

    def text(self, *names: str) -> str | None:
        value = self.arg(None, *names)
        return None if value is None else source_text(value)


@dataclass
class Member:
    """An assignment in a class body."""

    name: str
    value: ast.AST | None
    annotation: ast.AST | None
    line: int

    @property
    def call(self) -> Call | None:
        return Call.of(self.value)


def members(node: ast.ClassDef) -> list[Member]:
    out = []
    for x in node.body:
        if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
            out.append(Member(x.targets[0].id, x.value, None, x.lineno - 1))
        elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
            out.append(Member(x.target.id, x.value, x.annotation, x.lineno - 1))
    return out


def meta(node: ast.ClassDef) -> dict[str, ast.AST]:
    inner = next((x for x in node.body if isinstance(x, ast.ClassDef) and x.name == "Meta"), None)
    return {m.name: m.value for m in members(inner) if m.value is not None} if inner else {}


def doc(node: ast.ClassDef) -> str | None:
    said = ast.get_docstring(node)
    return re.sub(r"\s+", " ", said).strip() or None if said else None


def at(path: str, node: ast.AST) -> Source:
    return Source(path, node.lineno - 1)


def reaches(node: ast.ClassDef, known: dict[str, ast.ClassDef], root) -> bool:
    """Whether a class or one of its bases in the file has a base for which ``root`` holds."""
    seen, queue = set(), [node]
    while queue:
        for base in queue.pop().bases:
            name = dotted(base)
            if root(name):
                return True
            if (inner := known.get(tail(name))) is not None and inner.name not in seen:
                seen.add(inner.name)
                queue.append(inner)
    return False


def optional(annotation: ast.AST | None) -> tuple[str, bool]:
    """Type of an annotation without wrappers, and whether it may be None."""
    if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
        inner = _try(annotation.value)
        annotation = inner.body[0].value if inner and inner.body and isinstance(inner.body[0], ast.Expr) else None
    if annotation is None:
        return "", False
    if isinstance(annotation, ast.Subscript):
        head = tail(dotted(annotation.value))
        if head in ("Mapped", "Annotated", "Final", "ClassVar", "Required"):
            first = annotation.slice.elts[0] if isinstance(annotation.slice, ast.Tuple) else annotation.slice
            return optional(first)
        if head == "Optional":
            return optional(annotation.slice)[0], True
        if head == "Union":
            return _union(annotation.slice.elts if isinstance(annotation.slice, ast.Tuple) else [annotation.slice])
    if isinstance(annotation, ast.BinOp) and isinstance(annotation.op, ast.BitOr):
        parts, node = [], annotation
        while isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            parts.insert(0, node.right)
            node = node.left
        return _union([node, *parts])
    return source_text(annotation), False


def _union(parts: list[ast.AST]) -> tuple[str, bool]:
    none = [p for p in parts if isinstance(p, ast.Constant) and p.value is None]
    rest = [optional(p) for p in parts if p not in none]
    return " | ".join(t for t, _ in rest), bool(none) or any(o for _, o in rest)


WRAPPERS = {"list", "List", "set", "Set", "Sequence", "Optional", "Mapped", "Union", "dict", "Dict", "None", "WriteOnlyMapped", "DynamicMapped", "relationship", "Relationship"}


def model_in(annotation: ast.AST | None) -> str | None:
    """The model that an annotation is about."""
    if annotation is None:
        return None
    names = [n for n in re.findall(r"[A-Za-z_]\w*", source_text(annotation)) if n not in WRAPPERS]
    return names[-1] if names else None
