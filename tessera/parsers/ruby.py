"""Statements of Ruby, and of Elixir, which writes them alike."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_PIECE = re.compile(
    r"""(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<list>[%~][wi](?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})a?)|(?P<comment>\#[^\n]*)"""
    r"""|(?P<key>[A-Za-z_]\w*[?!]?:(?!:))|(?P<symbol>(?<![\w:]):(?:[A-Za-z_]\w*[?!]?|"[^"]*"))|(?P<name>@{0,2}[A-Za-z_]\w*[?!]?(?:::[A-Za-z_]\w*)*)"""
    r"""|(?P<number>\d[\d_.]*)|(?P<sign>=>|->|&\.|::|&&|\|\||==|<<|[^\sA-Za-z_0-9])|(?P<line>\n)""",
    re.X | re.S,
)


@dataclass
class Piece:
    kind: str
    text: str
    line: int


@dataclass
class Call:
    """A statement ``receiver.name args do |variable| ... end``; its block holds statements."""

    receiver: str
    name: str
    args: list[Any]
    options: dict[str, Any]
    line: int
    variable: str = ""
    block: list[Call] = field(default_factory=list)
    tail: list[str] = field(default_factory=list)

    def text(self, i: int) -> str | None:
        return self.args[i] if len(self.args) > i and isinstance(self.args[i], str) else None


class Code(str):
    """A Ruby expression that isn't a literal."""


def _pieces(text: str) -> list[Piece]:
    text = re.sub(r"^=begin\b.*?^=end\b[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.M | re.S)
    text = text.partition("\n__END__")[0]
    out, line, at = [], 0, 0
    for m in _PIECE.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "comment":
            out.append(Piece(m.lastgroup or "sign", m[0], line))
    return out


def _string(text: str) -> str:
    body = text[1:-1]
    return re.sub(r"\\(.)", r"\1", body) if text[0] == "'" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body)


def _split(pieces: list[Piece]) -> list[list[Piece]]:
    out, depth, begin = [], 0, 0
    for i, p in enumerate(pieces):
        if p.kind == "sign":
            depth += (p.text in "([{") - (p.text in ")]}")
            if p.text == "," and depth == 0:
                out.append(pieces[begin:i])
                begin = i + 1
    out.append(pieces[begin:])
    return [[p for p in o if p.kind != "line"] for o in out if any(p.kind != "line" for p in o)]


def _value(pieces: list[Piece]) -> Any:
    if not pieces:
        return None
    first = pieces[0]
    if len(pieces) == 1:
        if first.kind == "string":
            return _string(first.text)
        if first.kind == "symbol":
            return first.text[1:].strip('"')
        if first.kind == "list":
            return first.text[3:].rstrip("a")[:-1].split()
        if first.kind == "number":
            return int(first.text.replace("_", "")) if re.fullmatch(r"[\d_]+", first.text) else float(first.text) if re.fullmatch(r"[\d_]+\.\d+", first.text) else Code(first.text)
        if first.text in ("true", "false", "nil"):
            return {"true": True, "false": False, "nil": None}[first.text]
    if first.text == "[" and pieces[-1].text == "]":
        return [_value(x) for x in _split(pieces[1:-1])]
    if first.text == "{" and pieces[-1].text == "}":
        args, options = _arguments(pieces[1:-1])
        return [*args, *([options] if options else [])] if args else options
    if first.text == "[" or (len(pieces) > 2 and pieces[-2].text == "." and pieces[-1].text == "freeze"):
        return _value(pieces[:-2]) if pieces[-1].text == "freeze" else Code(_code(pieces))
    return Code(_code(pieces))


def _code(pieces: list[Piece]) -> str:
    out = ""
    for i, p in enumerate(pieces):
        glued = not out or p.text in ").,]}" or out[-1] in "([.{" or (p.text == "(" and pieces[i - 1].kind == "name") or (p.text == "." and True)
        out += ("" if glued else " ") + p.text
    return out


def _arguments(pieces: list[Piece]) -> tuple[list[Any], dict[str, Any]]:
    args, options = [], {}
    for part in _split(pieces):
        head = part[0]
        if head.kind == "key":
            options[head.text[:-1]] = _value(part[1:])
        elif head.kind == "string" and len(part) > 2 and part[1].text == ":":
            options[_string(head.text)] = _value(part[2:])
        elif (at := next((i for i, p in enumerate(part) if p.text == "=>"), None)) is not None and at == 1:
            options[str(_value(part[:1]))] = _value(part[at + 1 :])
        elif head.text != "&":
            args.append(_value(part))
    return args, options


_OPENERS = {"if", "unless", "case", "def", "class", "module", "begin", "while", "until", "for"}


def statements(text: str) -> list[Call]:
    """The statements of a file as a tree of calls."""
    pieces, rows, row, depth = _pieces(text), [], [], 0
    for i, p in enumerate(pieces):
        if p.kind == "line":
            following = next((q for q in pieces[i + 1 : i + 4] if q.kind != "line"), None)
            open_ = depth > 0 or (row and (row[-1].text in (",", "\\", ".", "=>", "&&", "||", "=", "<<") or row[-1].kind == "key")) or (following is not None and following.text in (".", "&.") and row)
            if not open_:
                if row:
                    rows.append(row)
                row = []
            continue
        if p.kind == "sign":
            depth = max(0, depth + (p.text in ("(", "[")) - (p.text in (")", "]")))
            if p.text == ";" and depth == 0:
                if row:
                    rows.append(row)
                row = []
                continue
            # a block in braces is read like one in words
            if p.text == "{" and depth == 0 and row and _opens_block(row, pieces, i):
                row.append(Piece("name", "do", p.line))
                continue
            if p.text in "{}":
                depth += 1 if p.text == "{" else -1 if depth else 0
        row.append(p)
    if row:
        rows.append(row)
    root: list[Call] = []
    stack: list[list[Call]] = [root]
    for row in rows:
        if row[0].text in ("end", "}") and row[0].kind in ("name", "sign"):
            if len(stack) > 1:
                stack.pop()
            continue
        call = _call(row)
        stack[-1].append(call)
        do = next((i for i, p in enumerate(row) if p.kind == "name" and p.text == "do"), None)
        if row[0].text in _OPENERS and row[0].kind == "name":
            if not any((p.text == "end" and p.kind == "name") or p.text == "do:" for p in row[1:]):
                stack.append(call.block)
        elif do is not None and row[-1].text not in ("end", "}"):
            stack.append(call.block)
    return root


def _opens_block(row: list[Piece], pieces: list[Piece], i: int) -> bool:
    """Whether a brace begins a block that goes on after its line: ``create_table :x { |t|``."""
    return i + 1 < len(pieces) and pieces[i + 1].text == "|" and any(p.kind == "line" for p in pieces[i + 2 : i + 6])


def _call(row: list[Piece]) -> Call:
    line = row[0].line
    if row[0].text in _OPENERS:
        return Call("", row[0].text, [Code(_code(row[1:]))], {}, line)
    do = next((i for i, p in enumerate(row) if p.kind == "name" and p.text == "do"), len(row))
    variable = next((p.text for p in row[do:] if p.kind == "name" and p.text != "do"), "")
    row = row[:do]
    # a condition behind a statement doesn't count
    depth = 0
    for i, p in enumerate(row):
        depth += (p.text in ("(", "[", "{")) - (p.text in (")", "]", "}")) if p.kind == "sign" else 0
        if i and depth == 0 and p.kind == "name" and p.text in ("if", "unless"):
            row = row[:i]
            break
    if not row:
        return Call("", "", [], {}, line)
    receiver, i = [], 0
    while i + 2 < len(row) and row[i].kind == "name" and row[i + 1].text in (".", "&."):
        receiver.append(row[i].text)
        i += 2
    name = row[i].text if i < len(row) else ""
    rest = row[i + 1 :]
    tail = []
    if rest and rest[0].text == "(":
        depth = 0
        for j, p in enumerate(rest):
            depth += (p.text in "([{") - (p.text in ")]}") if p.kind == "sign" else 0
            if depth == 0:
                break
        tail, rest = [p.text for p in rest[j + 1 :]], rest[1:j]
    args, options = _arguments(rest)
    return Call(".".join(receiver), name, args, options, line, variable, tail=tail)
