"""GraphQL types with database directives, ZenStack models, and the tables and entities of two Rust libraries."""

from __future__ import annotations

import re
from types import SimpleNamespace

from tessera.functions.names import lcfirst_plain, snake
from tessera.model import Column, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.parsers import prisma
from tessera.parsers.tokens import SIGN, STRING, WORD, Cursor, Lines, Token, scan, unescaped

# GraphQL

_GRAPHQL = r'(?P<skip>[\s,]+|#[^\r\n]*|""".*?(?:"""|\Z)|﻿)|(?P<string>"(?:\\.|[^"\\\r\n])*(?:"|(?=[\r\n]|\Z)))|(?P<word>[A-Za-z_]\w*)|(?P<number>-?\d[\w.]*)|(?P<sign>.)'
DIRECTIVES = {"model", "entity", "table", "node", "db", "dbtable", "sqltable", "collection", "dgraph"}
RENAMES, KEYS = {"column", "db", "map", "dbfield"}, {"id", "primarykey", "unique_id"}
OPERATIONS = {"Query", "Mutation", "Subscription"}


def graphql_detect(path: str, text: str) -> bool:
    return path.lower().endswith((".graphql", ".gql", ".graphqls")) and bool(re.search(r"@(?:model|entity|table|node|db|dbTable|sqlTable|collection|dgraph)\b", text)) and bool(re.search(r"\b(?:type|interface)\s+[A-Za-z_]", text))


def _directives(c: Cursor) -> dict[str, dict[str, str]]:
    """Directives by lower-case name, with the texts and names among their arguments."""
    out: dict[str, dict[str, str]] = {}
    while c.peek() and c.peek().text == "@":
        c.at += 1
        name = c.take()
        args: dict[str, str] = {}
        inside = c.group() if c.peek() and c.peek().text == "(" else None
        while inside and not inside.done():
            key = inside.take()
            if inside.sign(":") and (value := inside.peek()):
                values = inside.group()
                if values is None:
                    inside.at += 1
                    args[key.text] = unescaped(value.text) if value.kind == STRING else value.text
                else:
                    first = next((t for t in values.tokens[values.at : values.end] if t.kind in (STRING, WORD)), None)
                    args[key.text] = unescaped(first.text) if first and first.kind == STRING else first.text if first else ""
        if name:
            out[name.text.lower()] = args
    return out


def _first(args: dict[str, str] | None, *names: str) -> str | None:
    return next((args[n] for n in names if n in args), None) if args else None


def graphql(path: str, text: str) -> Parsed:
    out, lines = Parsed(path, "graphql"), Lines(text)
    c = Cursor(text, scan(text, _GRAPHQL))
    types, enums = [], []
    while not c.done():
        token = c.take()
        if token.kind != WORD or token.text not in ("type", "interface", "enum") or not c.peek() or c.peek().kind != WORD:
            continue
        name = c.take().text
        while c.peek() and c.peek().text not in ("@", "{") and c.peek().text not in ("type", "interface", "enum", "input", "union", "scalar", "extend"):
            c.at += 1
        marks = _directives(c)
        body = c.group() if c.peek() and c.peek().text == "{" else None
        if body is not None:
            (enums if token.text == "enum" else types).append((name, marks, body, lines.at(token.start)))
    entities = [(n, m, _graphql_fields(b, lines), line) for n, m, b, line in types if n not in OPERATIONS and DIRECTIVES & set(m)]
    if not entities:
        return out
    known = {n: fields for n, _, fields, _ in entities}
    for name, marks, fields, line in entities:
        mark = next(k for k in marks if k in DIRECTIVES)
        table = next((t for k in marks if k in DIRECTIVES and (t := _first(marks[k], "name", "table", "tableName", "label", "collection"))), None)
        raw = RawEntity(table or name, "collection" if mark == "collection" else "table", model_name=name, name_certainty=2 if table else 0, source=Source(path, line))
        own = lambda: Ref(raw.name, name)  # noqa: B023, E731
        for f in fields:
            source = Source(path, f.line)
            if f.type in known:
                many = "hasmany" in f.marks
                back = any(x.type == name and not x.many for x in known[f.type])
                if f.many and (not many or back):
                    continue
                named = _first(f.marks.get("belongsto") or f.marks.get("hasone") or f.marks.get("relation"), "fields", "field", "foreignKey", "column")
                columns = [f"{lcfirst_plain(name)}Id"] if f.many else [named or f"{f.name}Id"]
                a, b = (Ref(model=f.type), own()) if f.many else (own(), Ref(model=f.type))
                out.relations.append(RawRelation(a, b, columns, cardinality="one-to-one" if "hasone" in f.marks else "many-to-one", kind="orm", optional=not f.required, navigation=f.name, source=source))
            elif not f.args:
                rename = next((f.marks[k] for k in f.marks if k in RENAMES), None)
                key = f.type == "ID" or bool(KEYS & set(f.marks))
                column = Column(_first(rename, "name", "column") or f.name, f.type, not f.required and not key, key, "unique" in f.marks, source=source)
                column.is_array = True if f.many else None
                column.generated = True if f.type == "ID" and f.required else None
                raw.columns.append(column)
        out.entities.append(raw)
    for name, _, body, line in enums:
        values = []
        while not body.done():
            token = body.take()
            if token.text == "@":
                body.at -= 1
                _directives(body)
            elif token.kind == WORD:
                values.append(token.text)
        if values:
            out.enums.append(RawEnum(name, values, source=Source(path, line)))
    return out


def _graphql_fields(body: Cursor, lines: Lines) -> list[SimpleNamespace]:
    out = []
    while not body.done():
        name = body.take()
        if name.kind != WORD:
            continue
        args = body.group() is not None if body.peek() and body.peek().text == "(" else False
        if not body.sign(":"):
            continue
        many = bool(body.peek() and body.peek().text == "[")
        inside = body.group() if many else body
        kind = inside.take() if inside and not inside.done() else None
        required = body.sign("!")
        if kind is not None and kind.kind == WORD:
            out.append(SimpleNamespace(name=name.text, type=kind.text, many=many, required=required, args=args, marks=_directives(body), line=lines.at(name.start)))
    return out


# ZenStack


def zenstack_detect(path: str, text: str) -> bool:
    return path.lower().endswith(".zmodel") and bool(re.search(r"(?m)^\s*(?:abstract\s+)?(?:model|enum|datasource|generator|plugin)\s+[A-Za-z_]", text))


def zenstack(path: str, text: str) -> Parsed:
    """The same blocks with bases and abstract models; clauses are blanked in place, so lines stay."""
    bases: dict[str, list[str]] = {}

    def blank(m: re.Match) -> str:
        bases[m[1]] = [b.strip() for b in m[3].split(",")]
        return m[0][: m.start(2) - m.start()] + re.sub(r"[^\r\n]", " ", m[2])

    plain = re.sub(r"\b(?:model|view)\s+([A-Za-z_]\w*)(\s+(?:extends|with)\s+([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*))(?=\s*\{)", blank, text)
    out = prisma.parse(path, plain, "zenstack")
    abstract = set(re.findall(r"\babstract\s+model\s+([A-Za-z_]\w*)", plain)) | set(re.findall(r"(?m)^\s*type\s+([A-Za-z_]\w*)", plain))
    for e in out.entities:
        e.abstract = e.model_name in abstract
        e.extends = bases.get(e.model_name, [])
    return out


# Rust

_RUST = (
    r"(?P<skip>\s+|//[^\r\n]*|/\*.*?(?:\*/|\Z))|(?P<string>b?r(?P<hash>#*)\".*?(?:\"(?P=hash)|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])')"
    r"|(?P<word>[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<sign>->|::|=>|.)"
)


def _rust(text: str) -> list[Token]:
    return [Token(STRING if t.kind == "hash" else t.kind, t.text, t.start, t.end) for t in scan(text, _RUST)]


def diesel_detect(path: str, text: str) -> bool:
    return path.lower().endswith(".rs") and bool(re.search(r"\btable!\s*[{(\[]", text))


def _generic(c: Cursor) -> tuple[str, Cursor | None]:
    """A path and what is in its angle brackets."""
    name = ""
    while c.peek() and (c.peek().kind == WORD or c.peek().text == "::"):
        token = c.take()
        name = token.text if token.kind == WORD else name
    if not c.sign("<"):
        return name, None
    begin, depth = c.at, 1
    while not c.done() and depth:
        t = c.take().text
        depth += (t == "<") - (t == ">")
    return name, Cursor(c.text, c.tokens, begin, max(begin, c.at - 1))


def diesel(path: str, text: str) -> Parsed:
    out, lines = Parsed(path, "diesel"), Lines(text)
    c = Cursor(text, _rust(text))
    while not c.done():
        token = c.take()
        if token.kind == WORD and token.text in ("table", "joinable") and c.sign("!"):
            body = c.group()
            if body is not None:
                (_diesel_table if token.text == "table" else _diesel_join)(path, body, lines, out)
    return out


def _diesel_table(path: str, body: Cursor, lines: Lines, out: Parsed) -> None:
    marks: dict[str, str] = {}
    while not body.done():
        if body.peek().text == "#":
            marks |= _rust_marks(body)
        elif body.peek().text == "use":
            while not body.done() and not body.sign(";"):
                body.at += 1
        else:
            break
    parts, head = [], body.peek()
    while body.peek() and body.peek().kind == WORD:
        parts.append(body.take().text)
        if not body.sign("."):
            break
    if not parts:
        return
    keys = [t.peek().text for t in group.split()] if (group := body.group() if body.peek() and body.peek().text == "(" else None) else ["id"]
    fields = body.group() if body.peek() and body.peek().text == "{" else None
    raw = RawEntity(marks.get("sql_name", parts[-1]), "table", schema=parts[-2] if len(parts) > 1 else None, model_name=parts[-1], source=Source(path, lines.at(head.start)))
    while fields and not fields.done():
        marks = {}
        while fields.peek() and fields.peek().text == "#":
            marks |= _rust_marks(fields)
        name = fields.take()
        if not name or name.kind != WORD or not fields.sign("->"):
            continue
        column = Column(marks.get("sql_name", name.text), nullable=False, source=Source(path, lines.at(name.start)))
        type_, inner = _generic(fields)
        while type_ in ("Nullable", "Array") and inner is not None:
            column.nullable = column.nullable or type_ == "Nullable"
            column.is_array = True if type_ == "Array" else column.is_array
            type_, inner = _generic(inner)
        column.type = type_ + (f"({marks['max_length']})" if "max_length" in marks else "")
        if name.text in keys:
            column.primary_key, column.nullable = True, False
        raw.columns.append(column)
        while fields.peek() and not fields.sign(","):
            fields.at += 1
    out.entities.append(raw)


def _rust_marks(c: Cursor) -> dict[str, str]:
    """``#[a = "x"]``, ``#[a(b, c = "y")]``: all names with their values."""
    c.sign("#")
    inside = c.group()
    out: dict[str, str] = {}
    tokens = inside.tokens[inside.at : inside.end] if inside else []
    for i, t in enumerate(tokens):
        if t.kind == WORD:
            value = tokens[i + 2] if i + 2 < len(tokens) and tokens[i + 1].text == "=" else None
            out[t.text] = "" if value is None else unescaped(value.text) if value.kind == STRING else value.text
    return out


def _diesel_join(path: str, body: Cursor, lines: Lines, out: Parsed) -> None:
    child, source = body.take(), None
    if child is None or not body.sign("->"):
        return
    parent = body.take()
    columns = [p.peek().text for p in group.split()] if (group := body.group()) else []
    source = Source(path, lines.at(child.start))
    if parent and columns:
        out.relations.append(RawRelation(Ref(child.text), Ref(parent.text), columns, source=source))


INTEGERS = re.compile(r"[iu](?:8|16|32|64|128|size)")


def seaorm_detect(path: str, text: str) -> bool:
    return path.lower().endswith(".rs") and bool(re.search(r"\bDeriveEntityModel\b|\bDeriveRelation\b|\bDeriveActiveEnum\b", text)) and "sea_orm" in text


def _module(path: str) -> str:
    parts = path.split("/")
    base = re.sub(r"\.rs$", "", parts[-1])
    return parts[-2] if base == "mod" and len(parts) > 1 else base


def _sea_module(text: str) -> str:
    parts = [p for p in text.split("::") if p not in ("super", "crate", "Entity", "entity", "self", "Column")]
    return parts[-1] if parts else ""


def seaorm(path: str, text: str) -> Parsed:
    """The module is the model; ``Model`` is its table, ``Relation`` its links."""
    out, lines = Parsed(path, "seaorm"), Lines(text)
    c, marks, model = Cursor(text, _rust(text)), {}, _module(path)
    raw: RawEntity | None = None
    while not c.done():
        if c.peek().text == "#" and c.peek(1) and c.peek(1).text == "[":
            marks |= _rust_marks(c)
            continue
        token = c.take()
        if token.kind != WORD or token.text not in ("struct", "enum", "impl", "fn", "use", "mod"):
            if token.kind != WORD or token.text not in ("pub",):
                marks = {} if token.kind != SIGN or token.text in ";}" else marks
            continue
        name = c.take() if c.peek() and c.peek().kind == WORD else None
        while c.peek() and c.peek().text not in "{;(":
            c.at += 1
        body = c.group() if c.peek() and c.peek().text == "{" else None
        if name is None or body is None:
            marks = {}
            continue
        if token.text == "struct" and "DeriveEntityModel" in marks:
            table = marks.get("table_name")
            raw = RawEntity(table or snake(model), "table", schema=marks.get("schema_name"), model_name=model, name_certainty=2 if table else 0, comment=marks.get("comment") or None, source=Source(path, lines.at(token.start)))
            _sea_columns(path, body, lines, raw)
            out.entities.append(raw)
        elif token.text == "enum" and "DeriveRelation" in marks:
            _sea_links(path, body, lines, model, raw, out)
        elif token.text == "enum" and "DeriveActiveEnum" in marks:
            values = [v for m, _ in _variants(body) if (v := m.get("string_value") or m.get("num_value"))]
            if values:
                out.enums.append(RawEnum(marks.get("enum_name") or snake(name.text), values, source=Source(path, lines.at(token.start))))
        marks = {}
    return out


def _variants(body: Cursor) -> list[tuple[dict[str, str], Token]]:
    out, marks = [], {}
    while not body.done():
        if body.peek().text == "#":
            marks = marks | _rust_marks(body)
            continue
        token = body.take()
        if token.kind == WORD:
            out.append((marks, token))
            marks = {}
            while body.peek() and not body.sign(","):
                if body.group() is None:
                    body.at += 1
    return out


def _sea_columns(path: str, body: Cursor, lines: Lines, raw: RawEntity) -> None:
    marks: dict[str, str] = {}
    while not body.done():
        if body.peek().text == "#":
            marks |= _rust_marks(body)
            continue
        token = body.take()
        if token.text == "pub":
            body.group() if body.peek() and body.peek().text == "(" else None
            continue
        if token.kind != WORD or not body.sign(":"):
            continue
        type_, inner = _generic(body)
        optional = type_ == "Option"
        if optional and inner is not None:
            type_, inner = _generic(inner)
        column = Column(marks.get("column_name") or snake(token.text), marks.get("column_type") or type_, (optional or "nullable" in marks) and "primary_key" not in marks, "primary_key" in marks, "unique" in marks, source=Source(path, lines.at(token.start)))
        if type_ == "Vec" and inner is not None and (item := _generic(inner)[0]) != "u8":
            column.is_array, column.type = True, marks.get("column_type") or item
        if column.primary_key and marks.get("auto_increment") != "false" and INTEGERS.fullmatch(type_):
            column.generated = True
        column.default = marks.get("default_value") or marks.get("default_expr")
        if "ignore" not in marks:
            raw.columns.append(column)
        marks = {}
        while body.peek() and not body.sign(","):
            body.at += 1


def _sea_links(path: str, body: Cursor, lines: Lines, model: str, raw: RawEntity | None, out: Parsed) -> None:
    column = lambda text: [snake(x) for x in re.findall(r"Column::(\w+)", text or "")]
    for marks, token in _variants(body):
        if target := _sea_module(marks.get("belongs_to", "")):
            own = column(marks.get("from"))
            free = next((c.nullable for c in raw.columns if c.name in own), None) if raw else None
            act = lambda k: re.sub(r"(?<=[a-z])(?=[A-Z])", " ", marks[k]).upper() if k in marks else None  # noqa: B023, E731
            out.relations.append(RawRelation(Ref(model=model), Ref(model=target), own, column(marks.get("to")), kind="orm", on_delete=act("on_delete"), on_update=act("on_update"), optional=free, source=Source(path, lines.at(token.start))))


READERS = {
    "diesel": SimpleNamespace(detect=diesel_detect, parse=diesel),
    "seaorm": SimpleNamespace(detect=seaorm_detect, parse=seaorm),
    "graphql": SimpleNamespace(detect=graphql_detect, parse=graphql),
    "zenstack": SimpleNamespace(detect=zenstack_detect, parse=zenstack),
}
