"""Schema definitions, migrations and models of Active Record."""

from __future__ import annotations

import re
from types import SimpleNamespace
from typing import Any

from tessera.functions.inflect import pluralize, singularize
from tessera.functions.names import pascal, short, snake
from tessera.model import Column, Hint, Index, Op, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.parsers.ruby import Call, Code, statements

KIND = "rails"

# Column methods of table definitions, and what a rule on deletion is called in SQL.
TYPES = {
    "string", "text", "integer", "bigint", "float", "decimal", "numeric", "datetime", "timestamp", "timestamptz", "time", "date", "binary", "blob", "boolean",
    "json", "jsonb", "uuid", "hstore", "inet", "cidr", "macaddr", "citext", "point", "xml", "tsvector", "int4range", "int8range", "daterange", "numrange",
    "tsrange", "tstzrange", "bit", "bit_varying", "money", "interval", "oid", "ltree", "line", "lseg", "box", "path", "polygon", "circle", "serial",
    "bigserial", "primary_key", "geometry", "geography", "st_point", "vector", "virtual", "tinyint", "mediumtext", "longtext", "tinytext", "unsigned_integer",
    "unsigned_bigint",
}
RULES = {"cascade": "CASCADE", "nullify": "SET NULL", "restrict": "RESTRICT"}

def detect(path: str, text: str) -> bool:
    if not path.endswith(".rb"):
        return False
    return bool(
        re.search(r"ActiveRecord::(?:Schema|Migration)|<\s*(?:::)?(?:ApplicationRecord|ActiveRecord::Base)\b", text)
        or (re.search(r"^\s*class\s+\w+(?:::\w+)*\s*<", text, re.M) and re.search(r"^\s*(?:belongs_to|has_many|has_one|has_and_belongs_to_many|self\.table_name\s*=)", text, re.M))
    )


def parse(path: str, text: str) -> Parsed:
    migration = "ActiveRecord::Migration" in text
    out = Parsed(path, KIND, "migration" if migration else "definition")
    _Reader(out).walk(statements(text), [])
    return out


class _Reader:
    def __init__(self, out: Parsed):
        self.out = out
        self.path = out.file

    def source(self, call: Call) -> Source:
        return Source(self.path, call.line)

    def walk(self, calls: list[Call], modules: list[str]) -> None:
        for c in calls:
            head = str(c.args[0]) if c.args else ""
            if c.name == "module":
                self.walk(c.block, [*modules, head.strip()])
            elif c.name == "class":
                m = re.match(r"([\w:]+)\s*(?:<\s*(?:::)?\s*([\w:]+(?:\s*\[\s*[\d.]+\s*\])?))?", head)
                name, base = (m[1], re.sub(r"\s*\[.*", "", m[2] or "")) if m else ("", "")
                if base == "ActiveRecord::Migration":
                    for d in c.block:
                        if d.name == "def" and re.match(r"(?:self\s*\.\s*)?(?:change|up)\b", str(d.args[0])):
                            self.changes(d.block)
                elif base and base.startswith("ActiveRecord::Schema"):
                    self.walk(c.block, modules)
                elif base or any(d.name == "self" or d.receiver == "self" for d in c.block):
                    self.model(c, name, base, modules)
            elif "Schema" in c.receiver and c.name in ("define", "[]") or (c.receiver == "" and c.name.startswith("ActiveRecord::Schema")):
                self.changes(c.block)

    # Tables

    def changes(self, calls: list[Call]) -> None:
        for c in calls:
            handler = getattr(self, "do_" + c.name, None)
            if handler and c.receiver in ("", "connection"):
                handler(c)
            elif c.name in ("if", "unless", "reversible", "safety_assured", "begin", "up_only") or (c.name == "up" and c.receiver):
                self.changes(c.block)
            elif c.receiver and c.name == "up":
                self.changes(c.block)

    def table(self, c: Call, i: int = 0) -> Ref | None:
        name = c.text(i)
        if not name or isinstance(name, Code):
            return None
        schema, _, plain = name.rpartition(".")
        return Ref(plain, schema=schema or None)

    def entity(self, c: Call, ref: Ref, partial: bool) -> RawEntity:
        e = RawEntity(ref.name or "", "table", schema=ref.schema, partial=partial, source=self.source(c))
        self.out.entities.append(e)
        return e

    def do_create_table(self, c: Call) -> None:
        ref = self.table(c)
        if ref is None:
            return
        e = self.entity(c, ref, False)
        e.comment = c.options.get("comment")
        key, named = c.options.get("id", True), c.options.get("primary_key", "id")
        if isinstance(named, list):
            key = False
        if key is not False:
            kind = key.get("type", "bigint") if isinstance(key, dict) else key if isinstance(key, str) else "bigint"
            e.columns.append(Column(named if isinstance(named, str) else "id", kind, False, True, generated=True if kind in ("bigint", "integer", "serial", "bigserial", "primary_key") else None, source=e.source))
        self.body(c, e, ref)
        for name in named if isinstance(named, list) else []:
            for column in e.columns:
                if column.name == name:
                    column.primary_key, column.nullable = True, False

    def do_create_join_table(self, c: Call) -> None:
        pair = [x for x in c.args[:2] if isinstance(x, str)]
        if len(pair) < 2:
            return
        name = c.options.get("table_name") or "_".join(sorted(pluralize(x) for x in pair))
        e = self.entity(c, Ref(name), False)
        for x in pair:
            e.columns.append(Column(singularize(x) + "_id", "bigint", False, source=e.source))
        self.body(c, e, Ref(name))

    def do_change_table(self, c: Call) -> None:
        ref = self.table(c)
        if ref is not None:
            e = RawEntity(ref.name or "", "table", schema=ref.schema, partial=True, source=self.source(c))
            self.body(c, e, ref)
            if e.columns or e.indexes:
                self.out.entities.append(e)

    def body(self, c: Call, e: RawEntity, ref: Ref) -> None:
        for t in c.block:
            if t.receiver == c.variable and c.variable:
                self.column(t, e, ref)
            elif t.name in ("if", "unless"):
                self.body(Call("", "", [], {}, t.line, c.variable, t.block), e, ref)

    def column(self, t: Call, e: RawEntity, ref: Ref) -> None:
        names = [x for x in t.args if isinstance(x, str) and not isinstance(x, Code)]
        here, own = self.source(t), lambda: Ref(ref.name, schema=ref.schema)
        ops = self.out.ops
        match t.name:
            case "timestamps":
                e.columns += [Column(n, "datetime", t.options.get("null") is True, default=_default(t.options.get("default")), source=here) for n in ("created_at", "updated_at")]
            case "references" | "belongs_to":
                for n in names:
                    self.reference(e, ref, n, t.options, here)
            case "index" if t.args:
                self.index(e, t.args[0], t.options)
            case "column" | "add" if len(t.args) > 1 and isinstance(t.args[0], str):
                e.columns.append(self.made(t.args[0], str(t.args[1]), t.options, here, e))
            case "remove" | "remove_columns":
                ops += [Op("dropColumn", own(), n, source=here) for n in names]
            case "remove_timestamps":
                ops += [Op("dropColumn", own(), n, source=here) for n in ("created_at", "updated_at")]
            case "remove_references" | "remove_belongs_to":
                ops += [Op("dropColumn", own(), f"{n}_id", source=here) for n in names]
            case "rename" if len(names) > 1:
                ops.append(Op("renameColumn", own(), names[0], names[1], source=here))
            case "change" if len(names) > 1:
                ops.append(Op("alterColumn", own(), names[0], set=self.patch(names[1], t.options), source=here))
            case "change_default" if names:
                ops.append(Op("alterColumn", own(), names[0], set={"default": _default(_to(t))}, source=here))
            case "change_null" if names and len(t.args) > 1:
                ops.append(Op("alterColumn", own(), names[0], set={"nullable": t.args[1] is not False}, source=here))
            case "foreign_key" if names:
                self.foreign(own(), names[0], t.options, here)
            case kind if kind in TYPES or (kind == "enum" and names) or ("enum_type" in t.options):
                e.columns += [self.made(n, kind, t.options, here, e) for n in names]

    def made(self, name: str, kind: str, options: dict[str, Any], here: Source, e: RawEntity) -> Column:
        c = Column(name, kind, options.get("null") is not False, source=here)
        if kind == "primary_key":
            c.type, c.primary_key, c.nullable, c.generated = "bigint", True, False, True
        c.type = _sized(c.type, options)
        c.primary_key = c.primary_key or options.get("primary_key") is True
        c.default, c.comment = _default(options.get("default")), options.get("comment")
        c.is_array = True if options.get("array") is True else None
        enum = options.get("enum_type")
        if kind == "enum" and isinstance(enum, str):
            c.enum_ref = c.type = enum
        if kind == "virtual":
            c.type, c.generated = str(options.get("type", "virtual")), True
        rule = options.get("index")
        if rule:
            e.indexes.append(Index([name], isinstance(rule, dict) and rule.get("unique") is True))
        return c

    def reference(self, e: RawEntity, ref: Ref, name: str, options: dict[str, Any], here: Source) -> None:
        kind = options.get("type", "bigint")
        c = Column(f"{name}_id", kind if isinstance(kind, str) else "bigint", options.get("null") is not False, comment=options.get("comment"), source=here)
        e.columns.append(c)
        if poly := options.get("polymorphic"):
            e.columns.append(Column(f"{name}_type", "string", c.nullable and not (isinstance(poly, dict) and poly.get("null") is False), source=here))
        rule = options.get("index")
        if isinstance(rule, dict) and rule.get("unique") is True:
            e.indexes.append(Index([c.name], True))
        key = options.get("foreign_key")
        if key and not poly:
            more = key if isinstance(key, dict) else {}
            target = more.get("to_table") or pluralize(name)
            self.foreign(Ref(ref.name, schema=ref.schema), str(target), {**more, "column": c.name}, here)

    def foreign(self, own: Ref, target: str, options: dict[str, Any], here: Source) -> None:
        columns = options.get("column") or f"{singularize(target.rpartition('.')[2])}_id"
        to = options.get("primary_key")
        schema, _, plain = target.rpartition(".")
        rules = {k: RULES.get(v) if isinstance(v := options.get(k), str) else None for k in ("on_delete", "on_update")}
        listed = lambda x: [] if x is None else list(x) if isinstance(x, list) else [str(x)]
        self.out.relations.append(RawRelation(own, Ref(plain, schema=schema or None), listed(columns), listed(to), name=options.get("name"), **rules, source=here))

    def index(self, e: RawEntity, columns: Any, options: dict[str, Any]) -> None:
        names = [x for x in (columns if isinstance(columns, list) else [columns]) if isinstance(x, str)]
        if names and not any(isinstance(x, Code) or re.search(r"[\s(]", x) for x in names):
            unique = options.get("unique") is True and "where" not in options
            e.indexes.append(Index(names, unique, options.get("name") if isinstance(options.get("name"), str) else None))

    # Changes

    def part(self, c: Call) -> tuple[Ref, RawEntity] | None:
        ref = self.table(c)
        return None if ref is None else (ref, RawEntity(ref.name or "", "table", schema=ref.schema, partial=True, source=self.source(c)))

    def keep(self, e: RawEntity) -> None:
        if e.columns or e.indexes:
            self.out.entities.append(e)

    def do_add_column(self, c: Call) -> None:
        if (p := self.part(c)) and c.text(1):
            p[1].columns.append(self.made(c.args[1], str(c.args[2]) if len(c.args) > 2 else "", c.options, self.source(c), p[1]))
            self.keep(p[1])

    def do_add_columns(self, c: Call) -> None:
        if p := self.part(c):
            p[1].columns += [self.made(n, str(c.options.get("type", "")), c.options, self.source(c), p[1]) for n in c.args[1:] if isinstance(n, str)]
            self.keep(p[1])

    def do_add_timestamps(self, c: Call) -> None:
        if p := self.part(c):
            p[1].columns += [Column(n, "datetime", c.options.get("null") is True, source=self.source(c)) for n in ("created_at", "updated_at")]
            self.keep(p[1])

    def do_add_reference(self, c: Call) -> None:
        if (p := self.part(c)) and c.text(1):
            self.reference(p[1], p[0], c.args[1], c.options, self.source(c))
            self.keep(p[1])

    do_add_belongs_to = do_add_reference

    def do_add_index(self, c: Call) -> None:
        if (p := self.part(c)) and len(c.args) > 1:
            self.index(p[1], c.args[1], c.options)
            self.keep(p[1])

    def do_add_foreign_key(self, c: Call) -> None:
        ref = self.table(c)
        if ref is not None and c.text(1):
            self.foreign(ref, c.args[1], c.options, self.source(c))

    def op(self, name: str, c: Call, **more: Any) -> None:
        if (ref := self.table(c)) is not None:
            self.out.ops.append(Op(name, ref, source=self.source(c), **more))

    def do_drop_table(self, c: Call) -> None:
        self.op("dropTable", c)

    def do_rename_table(self, c: Call) -> None:
        if c.text(1):
            self.op("renameTable", c, to=c.args[1])

    def do_remove_column(self, c: Call) -> None:
        if c.text(1):
            self.op("dropColumn", c, column=c.args[1])

    def do_remove_columns(self, c: Call) -> None:
        for n in c.args[1:]:
            if isinstance(n, str):
                self.op("dropColumn", c, column=n)

    def do_remove_timestamps(self, c: Call) -> None:
        for n in ("created_at", "updated_at"):
            self.op("dropColumn", c, column=n)

    def do_remove_reference(self, c: Call) -> None:
        if c.text(1):
            self.op("dropColumn", c, column=f"{c.args[1]}_id")
            if c.options.get("polymorphic"):
                self.op("dropColumn", c, column=f"{c.args[1]}_type")

    do_remove_belongs_to = do_remove_reference

    def do_rename_column(self, c: Call) -> None:
        if c.text(1) and c.text(2):
            self.op("renameColumn", c, column=c.args[1], to=c.args[2])

    def do_change_column(self, c: Call) -> None:
        if c.text(1) and len(c.args) > 2:
            self.op("alterColumn", c, column=c.args[1], set=self.patch(str(c.args[2]), c.options))

    def do_change_column_null(self, c: Call) -> None:
        if c.text(1) and len(c.args) > 2:
            self.op("alterColumn", c, column=c.args[1], set={"nullable": c.args[2] is not False})

    def do_change_column_default(self, c: Call) -> None:
        if c.text(1):
            self.op("alterColumn", c, column=c.args[1], set={"default": _default(_to(c, 2))})

    def do_remove_foreign_key(self, c: Call) -> None:
        ref = self.table(c)
        if ref is not None:
            column = c.options.get("column") or (f"{singularize(c.args[1])}_id" if c.text(1) else None)
            self.out.ops.append(Op("dropForeignKey", ref, name=c.options.get("name"), columns=[column] if isinstance(column, str) else [], source=self.source(c)))

    def do_create_enum(self, c: Call) -> None:
        if c.text(0) and len(c.args) > 1 and isinstance(c.args[1], list):
            self.out.enums.append(RawEnum(c.args[0], [str(v) for v in c.args[1]], source=self.source(c)))

    def do_drop_enum(self, c: Call) -> None:
        if c.text(0):
            self.out.ops.append(Op("dropEnum", name=c.args[0], source=self.source(c)))

    def do_enable_extension(self, c: Call) -> None:
        self.out.engines.append(Hint("postgresql", c.line, "enable_extension"))

    def patch(self, kind: str, options: dict[str, Any]) -> dict[str, Any]:
        out: dict[str, Any] = {"type": _sized(kind, options)}
        if "null" in options:
            out["nullable"] = options["null"] is not False
        if "default" in options:
            out["default"] = _default(options["default"])
        return out

    # Models

    def model(self, c: Call, name: str, base: str, modules: list[str]) -> None:
        links = [d for d in c.block if d.name in ("belongs_to", "has_many", "has_one", "has_and_belongs_to_many", "enum") and not d.receiver]
        given = next((d for d in c.block if d.receiver == "self" and d.name == "table_name"), None)
        table = next((x for x in (_assigned(given) if given else []) if x), None)
        root = base in ("ApplicationRecord", "ActiveRecord::Base")
        if not root and not links and table is None:
            return
        abstract = any(d.receiver == "self" and d.name == "abstract_class" for d in c.block)
        plain = short(name.replace("::", "."))
        e = RawEntity(table or pluralize(snake(plain)), "table", model_name=plain, name_certainty=2 if table else 0, abstract=abstract, source=self.source(c))
        if table and "." in table:
            e.schema, _, e.name = table.rpartition(".")
        if not root:
            e.extends, e.shared_table = [short(base.replace("::", "."))], True
        self.out.entities.append(e)
        for d in links:
            if d.name == "enum":
                self.model_enum(d, e)
            elif d.text(0):
                self.link(d, plain, e)

    def model_enum(self, d: Call, e: RawEntity) -> None:
        pairs = [(d.args[0], d.args[1] if len(d.args) > 1 else {k: v for k, v in d.options.items() if not re.match(r"_?(?:prefix|suffix|default|scopes|validate|instance_methods)$", k)})] if d.text(0) else list(d.options.items())
        for column, values in pairs:
            listed = [str(v) for v in (values if isinstance(values, list) else values.keys())] if isinstance(values, (list, dict)) else []
            if listed and not str(column).startswith("_"):
                self.out.enums.append(RawEnum(f"{e.name}_{column}", listed, source=self.source(d)))
                e.columns.append(Column(str(column), "", enum_ref=f"{e.name}_{column}", source=self.source(d), implied=True))

    def link(self, d: Call, model: str, e: RawEntity) -> None:
        name, o = d.args[0], d.options
        if o.get("polymorphic") or ("through" in o and d.name != "has_and_belongs_to_many"):
            return
        target = short(str(o["class_name"]).replace("::", ".")) if isinstance(o.get("class_name"), str) else pascal(name if d.name in ("belongs_to", "has_one") else singularize(name))
        key = o.get("foreign_key")
        keys = [str(k) for k in key] if isinstance(key, list) else [str(key)] if isinstance(key, str) else []
        to = [str(o["primary_key"])] if isinstance(o.get("primary_key"), str) else []
        own, other, here = Ref(model=model), Ref(model=target), self.source(d)
        if d.name == "belongs_to":
            self.out.relations.append(RawRelation(own, other, keys or [f"{name}_id"], to, kind="orm", optional=True if o.get("optional") is True else None, navigation=name, source=here))
        elif d.name == "has_and_belongs_to_many":
            through = o.get("join_table")
            mine = e.name
            joined = through if isinstance(through, str) else "_".join(sorted([mine, pluralize(snake(target))]))
            self.out.relations.append(RawRelation(own, other, cardinality="many-to-many", kind="orm", through=Ref(joined), navigation=name, source=here))
        else:
            back = keys or [f"{o['as']}_id" if isinstance(o.get("as"), str) else f"{snake(model)}_id"]
            if isinstance(o.get("as"), str):
                return
            if d.name == "has_one":
                self.out.relations.append(RawRelation(other, own, back, to, "one-to-one", "orm", source=here))
            else:
                self.out.relations.append(RawRelation(own, other, to, back, "one-to-many", "orm", navigation=name, source=here))


def _assigned(call: Call) -> list[str]:
    m = re.match(r"=\s*[\"':]([\w.]+)", str(call.args[0])) if call.args else None
    return [m[1]] if m else []


def _to(c: Call, i: int = 1) -> Any:
    """The new default of ``from: a, to: b`` or of a plain value."""
    return c.options.get("to") if "to" in c.options else c.args[i] if len(c.args) > i else None


def _sized(kind: str, options: dict[str, Any]) -> str:
    limit, precision, scale = (options.get(k) for k in ("limit", "precision", "scale"))
    if isinstance(limit, int) and not isinstance(limit, bool):
        return f"{kind}({limit})"
    if isinstance(precision, int) and not isinstance(precision, bool) and kind in ("decimal", "numeric"):
        return f"{kind}({precision}" + (f",{scale})" if isinstance(scale, int) else ")")
    return kind


def _default(value: Any) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(str, value)) + "]"
    if isinstance(value, dict):
        return "{}" if not value else str(value)
    text = str(value)
    m = re.fullmatch(r"->\s*\{\s*[\"'](.*)[\"']\s*\}", text) if isinstance(value, Code) else None
    return m[1] if m else text


READERS = {KIND: SimpleNamespace(detect=detect, parse=parse)}
