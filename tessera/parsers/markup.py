"""Tolerant readers of XML and of the YAML that mapping files use, as nodes with lines."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field
from typing import Any

from tessera.parsers.tokens import Lines

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[?!][^>]*(?:>|\Z)|<(?P<close>/)?\s*(?P<name>[\w:.-]+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<single>/)?>", re.S)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)


@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    line: int = 0
    children: list[Element] = field(default_factory=list)
    text: str = ""

    def get(self, *names: str) -> str | None:
        return next((self.attributes[n] for n in names if n in self.attributes), None)

    def all(self, *names: str) -> list[Element]:
        return [c for c in self.children if c.name in names]

    def first(self, *names: str) -> Element | None:
        return next(iter(self.all(*names)), None)

    def find(self, name: str) -> Element | None:
        """The first element of that name at any depth."""
        for c in self.children:
            if c.name == name:
                return c
            if (inner := c.find(name)) is not None:
                return inner
        return None

    def true(self, *names: str) -> bool:
        return (self.get(*names) or "").strip().lower() == "true"


def parse_xml(text: str) -> Element:
    """The document below a nameless root; tags that never close end with their parent, names lose their prefix."""
    root, lines = Element(""), Lines(text)
    open_, at = [root], 0
    for m in _TAG.finditer(text):
        open_[-1].text += html.unescape(text[at : m.start()])
        at = m.end()
        if m["data"] is not None:
            open_[-1].text += m["data"]
        if not m["name"]:
            continue
        name = m["name"].rpartition(":")[2]
        if m["close"]:
            if any(e.name == name for e in open_[1:]):
                while open_.pop().name != name:
                    pass
            continue
        element = Element(name, {k.rpartition(":")[2]: html.unescape(a if a or not b else b) for k, a, b in _ATTRIBUTE.findall(m["attrs"])}, lines.at(m.start()))
        open_[-1].children.append(element)
        if not m["single"]:
            open_.append(element)
    return root


class Yaml(dict):
    """A mapping that knows its lines: ``line`` of itself, ``at`` of its keys."""

    line = 0

    def __init__(self, line: int = 0):
        super().__init__()
        self.line, self.at = line, {}


def _scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] in "'\"" and text[-1] == text[0]:
        return text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1].replace('\\"', '"').replace("\\\\", "\\")
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text in ("", "~", "null"):
        return None
    return int(text) if re.fullmatch(r"-?\d{1,15}", text) else text


def _flow(text: str, line: int) -> Any:
    text = text.strip()
    if not text or text[0] not in "{[":
        return _scalar(text)
    parts, depth, quote, begin = [], 0, "", 1
    body = text[:-1] if text[-1:] in "}]" else text
    for i, c in enumerate(body[1:], 1):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        elif c == "," and not depth:
            parts.append(body[begin:i])
            begin = i + 1
    parts = [p for p in [*parts, body[begin:]] if p.strip()]
    if text[0] == "[":
        return [_flow(p, line) for p in parts]
    out = Yaml(line)
    for p in parts:
        key, _, value = p.partition(":")
        out[str(_scalar(key))], out.at[str(_scalar(key))] = _flow(value, line), line
    return out


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


_KEY = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^\s#:\-\[\]{},&*!|>'\"%@`][^#:]*?|[\w\\./$-]+))\s*:(?:\s+(.*))?$")


def parse_yaml(text: str) -> Any:
    """Mappings, sequences, scalars, flow collections and block texts."""
    rows = []
    for number, raw in enumerate(re.split(r"\r\n|\r|\n", text.expandtabs(2))):
        line = _uncommented(raw)
        if line.strip() and not line.startswith(("---", "...", "%")):
            rows.append((len(line) - len(line.lstrip()), line.strip(), number))
    value, _ = _block(rows, 0, rows[0][0] if rows else 0)
    return value


def _block(rows: list, i: int, indent: int) -> tuple[Any, int]:
    if i >= len(rows):
        return None, i
    if rows[i][1].startswith("- ") or rows[i][1] == "-":
        out = []
        while i < len(rows) and rows[i][0] == indent and (rows[i][1].startswith("- ") or rows[i][1] == "-"):
            rest, number = rows[i][1][1:].strip(), rows[i][2]
            if not rest:
                i += 1
                value = None
                if i < len(rows) and rows[i][0] > indent:
                    value, i = _block(rows, i, rows[i][0])
                out.append(value)
            elif _KEY.match(rest) and rest[0] not in "{[":
                inner = indent + rows[i][1].index(rest[0], 1)
                rows[i] = (inner, rest, number)
                value, i = _block(rows, i, inner)
                out.append(value)
            else:
                out.append(_flow(rest, number))
                i += 1
        return out, i
    out = Yaml(rows[i][2])
    while i < len(rows) and rows[i][0] >= indent:
        level, line, number = rows[i]
        m = _KEY.match(line)
        if level > indent or not m:
            i += 1
            continue
        if line.startswith("- "):
            break
        key, value = str(_scalar(m[1])), (m[2] or "").strip()
        out.at[key] = number
        i += 1
        if value in ("|", ">", "|-", ">-", "|+", ">+"):
            said = []
            while i < len(rows) and rows[i][0] > indent:
                said.append(rows[i][1])
                i += 1
            out[key] = "\n".join(said)
        elif value:
            while value[0] in "{[" and value.count("{") + value.count("[") > value.count("}") + value.count("]") and i < len(rows):
                value += " " + rows[i][1]
                i += 1
            out[key] = _flow(value, number)
        elif i < len(rows) and (rows[i][0] > indent or (rows[i][0] == indent and rows[i][1].startswith("- "))):
            out[key], i = _block(rows, i, rows[i][0])
        else:
            out[key] = None
    return out, i


def parse_json(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None
