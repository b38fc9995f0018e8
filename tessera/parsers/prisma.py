"""Schemas of models, views, enums and composite types in blocks of one field a line."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.model import Column, Hint, Index, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.parsers.tokens import SIGN, STRING, WORD, Cursor, Lines, Token, scan, unescaped

KIND = "prisma"
SCALARS = ("String", "Boolean", "Int", "BigInt", "Float", "Decimal", "DateTime", "Json", "Bytes")
ENGINES = {"postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "sqlite": "sqlite", "sqlserver": "sqlserver", "mongodb": "mongodb", "cockroachdb": "cockroachdb"}
BLOCKS = ("datasource", "generator", "model", "view", "enum", "type")
_TOKENS = r'(?P<skip>\s+|///?[^\r\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\r\n])*(?:"|(?=[\r\n]|\Z)))|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>.)'


@dataclass
class Attribute:
    name: str
    args: Cursor | None

    def parts(self) -> list[Cursor]:
        return Cursor(self.args.text, self.args.tokens, self.args.at, self.args.end).split() if self.args else []

    def named(self, key: str) -> Cursor | None:
        for part in self.parts():
            if part.peek().text == key and part.peek(1) and part.peek(1).text == ":":
                part.at += 2
                return part
        return None

    def first(self) -> Cursor | None:
        return next((p for p in self.parts() if not (p.peek(1) and p.peek(1).text == ":")), None)

    def names(self, key: str | None = None) -> list[str]:
        """Field names of a list, without their own arguments."""
        cursor = self.named(key) if key else (self.named("fields") or self.first())
        inside = cursor.group() if cursor else None
        return [p.peek().text for p in inside.split()] if inside else []

    def text(self, key: str | None = None) -> str | None:
        cursor = self.named(key) if key else self.first()
        token = cursor.peek() if cursor else None
        return unescaped(token.text) if token and token.kind == STRING else None

    def bare(self, key: str) -> str | None:
        cursor = self.named(key)
        return cursor.peek().text if cursor and cursor.peek() else None


@dataclass
class Field:
    name: str
    type: str
    many: bool
    optional: bool
    attributes: list[Attribute]
    line: int

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)


@dataclass
class Block:
    keyword: str
    name: str
    line: int
    lines: list[list[Token]] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)
    attributes: list[Attribute] = field(default_factory=list)
    comment: str | None = None

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    @property
    def table(self) -> str:
        mapped = self.attribute("map")
        return (mapped.text() or mapped.text("name") if mapped else None) or self.name

    @property
    def schema(self) -> str | None:
        found = self.attribute("schema")
        return found.text() if found else None

    def column(self, name: str) -> str:
        found = next((f for f in self.fields if f.name == name), None)
        mapped = found.attribute("map") if found else None
        return (mapped.text() or mapped.text("name") if mapped else None) or name

    def uniques(self) -> list[list[str]]:
        return [a.names() for a in self.attributes if a.name == "unique"]


def detect(path: str, text: str) -> bool:
    return path.lower().endswith(".prisma")


def _attributes(text: str, c: Cursor) -> list[Attribute]:
    out = []
    while not c.done():
        if not c.sign("@"):
            c.at += 1
            continue
        c.sign("@")
        name = c.take()
        if not name or name.kind != WORD:
            continue
        parts = [name.text]
        while c.peek() and c.peek().text == "." and c.peek(1) and c.peek(1).kind == WORD:
            c.at += 1
            parts.append(c.take().text)
        out.append(Attribute(".".join(parts), c.group() if c.peek() and c.peek().text == "(" else None))
    return out


def _read_field(text: str, tokens: list[Token], begin: int, end: int, lines: Lines) -> Field | None:
    c = Cursor(text, tokens, begin, end)
    name, kind = c.take(), c.take()
    if not name or not kind or name.kind != WORD or kind.kind != WORD:
        return None
    type_ = kind.text
    if c.peek() and c.peek().text == "(":
        at = c.at
        c.group()
        type_ += c.since(at)
    many = c.group() is not None if c.peek() and c.peek().text == "[" else False
    optional = c.sign("?")
    return Field(name.text, type_, many, optional, _attributes(text, c), lines.at(name.start))


def blocks(text: str) -> list[Block]:
    tokens, lines = scan(text, _TOKENS), Lines(text)
    source = re.split(r"\r\n|\r|\n", text)
    out, c = [], Cursor(text, tokens)
    while not c.done():
        head = c.take()
        if head.text not in BLOCKS or not c.peek() or c.peek().kind != WORD or not c.peek(1) or c.peek(1).text != "{":
            continue
        block = Block(head.text, c.take().text, lines.at(head.start))
        docs, above = [], block.line - 1
        while above >= 0 and source[above].strip().startswith("///"):
            docs.insert(0, source[above].strip()[3:].strip())
            above -= 1
        block.comment = " ".join(d for d in docs if d) or None
        inside = c.group()
        begin, depth = inside.at, 0
        for i in range(inside.at, inside.end + 1):
            token = tokens[i] if i < inside.end else None
            if token is None or (depth == 0 and i > begin and lines.at(token.start) > lines.at(tokens[i - 1].start)):
                if begin < i:
                    block.lines.append(tokens[begin:i])
                    if tokens[begin].text == "@":
                        block.attributes += _attributes(text, Cursor(text, tokens, begin, i))
                    elif f := _read_field(text, tokens, begin, i, lines):
                        block.fields.append(f)
                begin = i
            if token is not None and token.kind == SIGN:
                depth += (token.text in "([{") - (token.text in ")]}")
        out.append(block)
    return out


def _default(attribute: Attribute, column: Column) -> None:
    if not attribute.args:
        return
    args = attribute.args
    expression = Cursor(args.text, args.tokens, args.end, args.end).text[args.tokens[args.at].start : args.tokens[args.end - 1].end] if args.at < args.end else ""
    if re.match(r"(?:autoincrement|uuid|cuid|auto|sequence|nanoid|ulid)\s*\(", expression):
        column.generated = True
    elif re.match(r"now\s*\(", expression):
        column.generated, column.default = True, "now()"
    elif m := re.match(r"dbgenerated\s*\((.*)\)$", expression, re.S):
        column.generated = True
        column.default = unescaped(m[1].strip()) if m[1].strip().startswith('"') else None
    elif expression:
        column.default = unescaped(expression) if expression.startswith('"') else expression


def parse(path: str, text: str, kind: str = KIND) -> Parsed:
    out, lines = Parsed(path, kind), Lines(text)
    found = blocks(text)
    provider = None
    for b in found:
        if b.keyword == "datasource":
            for line in b.lines:
                words = [t.text for t in line]
                if words[:2] == ["provider", "="] and len(line) > 2 and line[2].kind == STRING:
                    name = unescaped(line[2].text)
                    if name in ENGINES:
                        provider = ENGINES[name]
                        out.engines.append(Hint(provider, lines.at(line[0].start), f'datasource provider "{name}"'))
    enums = {b.name: b for b in found if b.keyword == "enum"}
    types = {b.name for b in found if b.keyword == "type"}
    models = {b.name: b for b in found if b.keyword in ("model", "view") and not b.attribute("ignore")}
    for b in enums.values():
        values = []
        for line in b.lines:
            if line[0].kind == WORD:
                mapped = next((a for a in _attributes(text, Cursor(text, line)) if a.name == "map"), None)
                values.append((mapped.text() if mapped else None) or line[0].text)
        out.enums.append(RawEnum(b.table, values, b.schema, source=Source(path, b.line)))
    for b in models.values():
        out.entities.append(_entity(path, b, models, enums, types, provider))
    many: dict[tuple, list[str]] = {}
    for b in models.values():
        _relations(path, b, models, enums, types, out, many)
    done = set()
    for (model, target, name), _ in many.items():
        pair = tuple(sorted((model, target)))
        partners = len(many.get((target, model, name), [])) - (model == target)
        if partners > 0 and (*pair, name) not in done:
            done.add((*pair, name))
            a, z = (models.get(m) for m in pair)
            out.relations.append(
                RawRelation(
                    Ref(a.table if a else None, pair[0]), Ref(z.table if z else None, pair[1]), cardinality="many-to-many", kind="orm", name=name,
                    through=Ref(f"_{name}" if name else f"_{pair[0]}To{pair[1]}"), source=Source(path, a.line if a else 0),
                )
            )
    return out


def _is_relation(f: Field, models: dict, enums: dict, types: set) -> bool:
    if f.type in SCALARS or f.type.startswith("Unsupported") or f.type in enums or f.type in types:
        return False
    if f.type in models or f.attribute("relation") or f.many:
        return True
    return f.optional and not any(a.name in ("id", "unique", "default", "map", "updatedAt") or a.name.startswith("db.") for a in f.attributes)


def _entity(path: str, b: Block, models: dict, enums: dict, types: set, provider: str | None) -> RawEntity:
    kind = "view" if b.keyword == "view" else "collection" if provider == "mongodb" else "table"
    keys = b.attribute("id").names() if b.attribute("id") else []
    columns = []
    for f in b.fields:
        if f.attribute("ignore") or _is_relation(f, models, enums, types):
            continue
        column = Column(b.column(f.name), f.type, f.optional, source=Source(path, f.line))
        for a in f.attributes:
            if a.name == "id":
                column.primary_key = True
            elif a.name == "unique":
                column.unique = True
            elif a.name == "updatedAt":
                column.generated = True
            elif a.name == "default":
                _default(a, column)
            elif a.name.startswith("db."):
                inside = a.args.text[a.args.tokens[a.args.at].start : a.args.tokens[a.args.end - 1].end] if a.args and a.args.at < a.args.end else ""
                column.type = a.name[3:] + (f"({inside})" if inside else "")
        column.primary_key = column.primary_key or f.name in keys
        if f.many:
            column.is_array = True
        if f.many or column.primary_key:
            column.nullable = False
        if f.type in enums:
            column.enum_ref = enums[f.type].table
        columns.append(column)
    indexes = [Index([b.column(n) for n in a.names()], a.name == "unique", a.text("name") or a.text("map")) for a in b.attributes if a.name in ("unique", "index", "fulltext")]
    certainty = 2
    return RawEntity(
        b.table, kind, columns, b.schema, b.name, certainty, indexes=[i for i in indexes if i.columns], engine=provider, comment=b.comment, source=Source(path, b.line)
    )


def _relations(path: str, b: Block, models: dict, enums: dict, types: set, out: Parsed, many: dict) -> None:
    for f in b.fields:
        attribute = f.attribute("relation")
        if f.attribute("ignore") or f.type in SCALARS or f.type in types or f.type in enums or f.type.startswith("Unsupported"):
            continue
        if not (f.type in models or attribute or f.many):
            continue
        name = (attribute.text() or attribute.text("name")) if attribute else None
        fields = attribute.names("fields") if attribute else []
        target = models.get(f.type)
        if fields:
            used = sorted(b.column(n).lower() for n in fields)
            single = len(fields) == 1 and any(x.name == fields[0] and x.attribute("unique") for x in b.fields)
            unique = single or any(sorted(b.column(n).lower() for n in u) == used for u in b.uniques())
            out.relations.append(
                RawRelation(
                    Ref(b.table, b.name, b.schema), Ref(target.table if target else None, f.type, target.schema if target else None), [b.column(n) for n in fields],
                    [target.column(n) if target else n for n in attribute.names("references")], "one-to-one" if unique else "many-to-one", "orm", name,
                    attribute.bare("onDelete"), attribute.bare("onUpdate"), optional=True if f.optional else None, source=Source(path, f.line),
                )
            )
        elif f.many:
            many.setdefault((b.name, f.type, name), []).append(f.name)
