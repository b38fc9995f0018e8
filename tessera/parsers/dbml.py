"""Tables, references, enums and projects of the database markup language."""

from __future__ import annotations

import re

from tessera.model import Column, Hint, Index, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.parsers.tokens import NAME, SIGN, STRING, WORD, Cursor, Lines, Token, scan, unescaped

KIND = "dbml"
_TOKENS = (
    r"(?P<skip>\s+|//[^\r\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'''.*?(?:'''|\Z)|'(?:\\.|[^'\\\r\n])*(?:'|(?=[\r\n]|\Z))|`[^`]*(?:`|\Z))"
    r'|(?P<name>"(?:\\.|[^"\\])*(?:"|\Z))|(?P<word>[^\W\d][\w]*)|(?P<number>-?\d[\w.]*)|(?P<sign><>|.)'
)
ENGINES = (("postgresql", r"postgre"), ("mysql", r"mysql"), ("mariadb", r"maria"), ("sqlserver", r"sql\s*server|mssql"), ("sqlite", r"sqlite"), ("oracle", r"oracle"), ("snowflake", r"snowflake"), ("bigquery", r"bigquery"))
ONE, MANY = "one", "many"
SIGNS = {">": (MANY, ONE), "<": (ONE, MANY), "-": (ONE, ONE), "<>": (MANY, MANY)}


def detect(path: str, text: str) -> bool:
    return path.lower().endswith(".dbml")


def _text(token: Token) -> str:
    return unescaped(token.text) if token.kind in (NAME, STRING) else token.text


class Reader:
    def __init__(self, path: str, text: str):
        self.path, self.text, self.lines = path, text, Lines(text)
        self.tokens = scan(text, _TOKENS)
        self.out = Parsed(path, KIND)
        self.aliases: dict[str, Ref] = {}
        self.later: list[tuple[Ref, list[str], str, Ref, list[str], str | None, dict, Source]] = []

    def source(self, token: Token) -> Source:
        return Source(self.path, self.lines.at(token.start))

    def path_of(self, c: Cursor) -> list[str]:
        """Names between dots; a group of names at the end becomes its own list elsewhere."""
        parts = []
        while c.peek() and c.peek().kind in (WORD, NAME):
            parts.append(_text(c.take()))
            if not (c.peek() and c.peek().text == "." and c.peek(1) and (c.peek(1).kind in (WORD, NAME))):
                break
            c.at += 1
        return parts

    def settings(self, c: Cursor) -> dict[str, Cursor | None]:
        """What stands in square brackets, by lower-case key."""
        out: dict[str, Cursor | None] = {}
        inside = c.group() if c.peek() and c.peek().text == "[" else None
        for part in inside.split() if inside else []:
            words = []
            while part.peek() and part.peek().kind in (WORD, NAME):
                words.append(_text(part.take()).lower())
            out.setdefault(" ".join(words), part if part.sign(":") else None)
        return out

    def read(self) -> Parsed:
        c = Cursor(self.text, self.tokens)
        while not c.done():
            token = c.take()
            action = {"table": self.table, "enum": self.enum, "ref": self.ref, "project": self.project, "tablegroup": self.group}.get(token.text.lower() if token.kind == WORD else "")
            if action:
                action(c, token)
            elif token.text == "{":
                c.at -= 1
                c.group()
        for a, a_columns, sign, b, b_columns, name, settings, source in self.later:
            self.relate(self.aliases.get((a.name or "").lower(), a), a_columns, sign, self.aliases.get((b.name or "").lower(), b), b_columns, name, settings, source)
        return self.out

    def qualified(self, parts: list[str]) -> Ref:
        return Ref(parts[-1], schema=parts[-2] if len(parts) > 1 else None)

    def rows(self, inside: Cursor) -> list[Cursor]:
        """Lines of a block; brackets hold several lines together."""
        out, begin, depth = [], inside.at, 0
        for i in range(inside.at, inside.end):
            t = self.tokens[i]
            if depth == 0 and i > begin and self.lines.at(t.start) > self.lines.at(self.tokens[i - 1].end - 1) and t.text not in "[{":
                out.append(Cursor(self.text, self.tokens, begin, i))
                begin = i
            if t.kind == SIGN:
                depth += (t.text in "([{") - (t.text in ")]}")
        out.append(Cursor(self.text, self.tokens, begin, inside.end))
        return [r for r in out if not r.done()]

    def note(self, c: Cursor) -> str | None:
        token = c.peek()
        return _text(token).strip() if token and token.kind in (STRING, NAME) else None

    def table(self, c: Cursor, head: Token) -> None:
        parts = self.path_of(c)
        if not parts:
            return
        ref = self.qualified(parts)
        if c.word() == "AS":
            c.at += 1
            self.aliases[_text(c.take()).lower()] = ref
        settings = self.settings(c)
        entity = RawEntity(ref.name, "table", schema=ref.schema, source=self.source(head))
        if settings.get("note"):
            entity.comment = self.note(settings["note"])
        body = c.group() if c.peek() and c.peek().text == "{" else None
        for row in self.rows(body) if body else []:
            first, second = row.peek(), row.peek(1)
            word = first.text.lower() if first.kind == WORD else ""
            if word == "indexes" and second and second.text == "{":
                row.at += 1
                self.indexes(row.group(), entity)
            elif word == "note" and second and second.text in (":", "{"):
                row.at += 1
                inside = row.group()
                if inside is None:
                    row.at += 1
                entity.comment = self.note(inside or row)
            else:
                self.column(row, entity, ref)
        self.out.entities.append(entity)

    def column(self, row: Cursor, entity: RawEntity, table: Ref) -> None:
        first = row.take()
        if first.kind not in (WORD, NAME):
            return
        column = Column(_text(first), source=self.source(first))
        begin = row.at
        while not row.done() and row.peek().text != "[" or row.peek() and row.peek().text == "[" and row.peek(1) and row.peek(1).text == "]":
            if row.peek().text in "([":
                row.group()
            elif row.peek().kind == WORD and row.at > begin and self.tokens[row.at - 1].text != "." and row.word() in ("PK", "UNIQUE"):
                break
            else:
                row.at += 1
        column.type = re.sub(r'^"|"$', "", row.since(begin))
        column.is_array = True if column.type.endswith("[]") else None
        settings = self.settings(row)
        for key, value in settings.items():
            if key in ("pk", "primary key"):
                column.primary_key, column.nullable = True, False
            elif key == "not null":
                column.nullable = False
            elif key == "unique":
                column.unique = True
            elif key == "increment":
                column.generated = True
            elif key == "default" and value and value.peek():
                token = value.peek()
                column.default = _text(token) if token.kind == STRING and not token.text.startswith("'") else Cursor(self.text, self.tokens, value.at, value.end).text[token.start : self.tokens[value.end - 1].end]
            elif key == "note" and value:
                column.comment = self.note(value)
            elif key == "ref" and value and value.peek() and value.peek().text in SIGNS:
                sign = value.take().text
                parts = self.path_of(value)
                if len(parts) > 1:
                    self.later.append((table, [column.name], sign, self.qualified(parts[:-1]), [parts[-1]], None, {}, column.source))
        entity.columns.append(column)

    def indexes(self, inside: Cursor, entity: RawEntity) -> None:
        for row in self.rows(inside):
            group = row.group() if row.peek().text == "(" else None
            names = [_text(p.peek()) for p in group.split() if p.peek().kind in (WORD, NAME)] if group else []
            if group is None and row.peek() and row.peek().kind in (WORD, NAME):
                names = [_text(row.take())]
            settings = self.settings(row)
            if not names:
                continue
            if "pk" in settings:
                for c in entity.columns:
                    if c.name in names:
                        c.primary_key, c.nullable = True, False
            else:
                label = self.note(settings["name"]) if settings.get("name") else None
                entity.indexes.append(Index(names, "unique" in settings, label))

    def enum(self, c: Cursor, head: Token) -> None:
        parts = self.path_of(c)
        body = c.group() if c.peek() and c.peek().text == "{" else None
        if parts and body:
            ref = self.qualified(parts)
            values = []
            while not body.done():
                if body.group() is None and (token := body.take()).kind in (WORD, NAME):
                    values.append(_text(token))
            self.out.enums.append(RawEnum(ref.name, values, ref.schema, source=self.source(head)))

    def project(self, c: Cursor, head: Token) -> None:
        self.path_of(c)
        body = c.group() if c.peek() and c.peek().text == "{" else None
        for row in self.rows(body) if body else []:
            if row.word() == "DATABASE_TYPE":
                row.at += 1
                row.sign(":")
                said = self.note(row) or ""
                engine = next((e for e, p in ENGINES if re.search(p, said.lower())), None)
                if engine:
                    self.out.engines.append(Hint(engine, self.lines.at(row.tokens[row.at].start), f'database_type "{said}"'))

    def group(self, c: Cursor, head: Token) -> None:
        name = self.path_of(c)
        self.settings(c)
        body = c.group() if c.peek() and c.peek().text == "{" else None
        members = {tuple(x.lower() for x in self.path_of(row)) for row in self.rows(body)} if body else set()
        for e in self.out.entities:
            if (e.name.lower(),) in members or (str(e.schema).lower(), e.name.lower()) in members:
                e.group = name[-1] if name else None

    def ref(self, c: Cursor, head: Token) -> None:
        name = self.path_of(c)
        rows = []
        if c.sign(":"):
            line = self.lines.at(self.tokens[c.at - 1].start)
            end, depth = c.at, 0
            while end < c.end and (depth or self.lines.at(self.tokens[end].start) == line):
                depth += (self.tokens[end].text in "([{") - (self.tokens[end].text in ")]}")
                end += 1
            rows = [Cursor(self.text, self.tokens, c.at, end)]
            c.at = end
        elif c.peek() and c.peek().text == "{":
            rows = self.rows(c.group())
        for row in rows:
            a, a_columns = self.end(row)
            sign = row.take()
            b, b_columns = self.end(row)
            if a and b and sign and sign.text in SIGNS:
                self.later.append((a, a_columns, sign.text, b, b_columns, name[0] if name else None, self.settings(row), self.source(head)))

    def end(self, c: Cursor) -> tuple[Ref | None, list[str]]:
        """One side of a reference: ``schema.table.column`` or ``table.(a, b)``."""
        parts = self.path_of(c)
        if c.peek() and c.peek().text == "." and c.peek(1) and c.peek(1).text == "(":
            c.at += 1
            return self.qualified(parts) if parts else None, [_text(p.peek()) for p in c.group().split()]
        return (self.qualified(parts[:-1]), parts[-1:]) if len(parts) > 1 else (None, [])

    def relate(self, a: Ref, a_columns: list[str], sign: str, b: Ref, b_columns: list[str], name: str | None, settings: dict, source: Source) -> None:
        left, right = SIGNS[sign]
        copy = lambda r: Ref(r.name, r.model, r.schema)
        if (left, right) == (ONE, MANY):
            a, a_columns, b, b_columns = b, b_columns, a, a_columns
        cardinality = "many-to-many" if left == right == MANY else "one-to-one" if left == right else "many-to-one"
        act = lambda key: value.text[value.tokens[value.at].start : value.tokens[value.end - 1].end].upper() if (value := settings.get(key)) and not value.done() else None
        self.out.relations.append(RawRelation(copy(a), copy(b), list(a_columns), list(b_columns), cardinality, "foreign-key", name, act("delete"), act("update"), source=source))


def parse(path: str, text: str) -> Parsed:
    return Reader(path, text).read()
