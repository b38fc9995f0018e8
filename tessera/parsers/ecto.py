"""Schemas and migrations of Ecto."""

from __future__ import annotations

import re
from types import SimpleNamespace
from typing import Any

from tessera.functions.names import short, snake
from tessera.model import Column, Index, Op, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.parsers.ruby import Call, Code, statements

KIND = "ecto"

# What a rule on deletion or update is called in SQL.
RULES = {"delete_all": "CASCADE", "update_all": "CASCADE", "nilify_all": "SET NULL", "default_all": "SET DEFAULT", "restrict": "RESTRICT", "nothing": "NO ACTION"}


def detect(path: str, text: str) -> bool:
    return path.endswith((".ex", ".exs")) and bool(re.search(r"\buse\s+Ecto\.(?:Schema|Migration)\b|^\s*schema\s+\"[^\"]+\"\s+do\b|\bcreate\s+table\(", text, re.M))


def parse(path: str, text: str) -> Parsed:
    migration = bool(re.search(r"\buse\s+\S*Migration\b|\bcreate(?:_if_not_exists)?[ (]\s*table\(", text))
    out = Parsed(path, KIND, "migration" if migration else "definition")
    plain = re.sub(r'"""(?:.*?)(?:"""|\Z)|\'\'\'(?:.*?)(?:\'\'\'|\Z)', lambda m: '""' + "\n" * m[0].count("\n"), text.replace("\r\n", "\n"), flags=re.S)
    _Reader(out).walk(statements(plain), "")
    return out


def _again(value: Any) -> Call | None:
    """The call in an argument: ``table(:users, prefix: "x")``."""
    calls = statements(value) if isinstance(value, Code) else []
    return calls[0] if calls else None


def _model(value: Any) -> str | None:
    text = str(value) if value is not None else ""
    return short(text) if re.fullmatch(r"[A-Z][\w.]*", text) else None


def _default(value: Any) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    inner = _again(value)
    if inner is not None and inner.name == "fragment" and inner.text(0):
        return inner.args[0]
    return ("[]" if isinstance(value, list) else "{}") if value in ([], {}) else str(value)


class _Reader:
    def __init__(self, out: Parsed):
        self.out = out

    def source(self, call: Call) -> Source:
        return Source(self.out.file, call.line)

    def walk(self, calls: list[Call], module: str) -> None:
        settings: dict[str, list[Any]] = {}
        for c in calls:
            if c.name == "defmodule":
                self.walk(c.block, short(str(c.args[0])) if c.args else "")
            elif c.name.startswith("@"):
                settings[c.name] = c.args
            elif c.name == "schema" and c.text(0):
                self.schema(c, module, settings)
            elif c.name == "def" and re.match(r"(?:change|up)\b", str(c.args[0])):
                self.changes(c.block)

    # Schemas

    def schema(self, c: Call, module: str, settings: dict[str, list[Any]]) -> None:
        prefix = (settings.get("@schema_prefix") or [None])[0]
        e = RawEntity(c.args[0], "table", schema=prefix if isinstance(prefix, str) else None, model_name=module or None, source=self.source(c))
        key = (settings.get("@primary_key") or [["id", "bigint"]])[0]
        if isinstance(key, list) and key and isinstance(key[0], str):
            kind = str(key[1]) if len(key) > 1 and isinstance(key[1], str) else "bigint"
            e.columns.append(Column(key[0], "bigint" if kind == "id" else kind, False, True, generated=True, source=e.source))
        foreign = (settings.get("@foreign_key_type") or ["bigint"])[0]
        self.out.entities.append(e)
        for f in c.block:
            self.entry(f, e, module, foreign if isinstance(foreign, str) else "bigint")

    def entry(self, f: Call, e: RawEntity, module: str, foreign: str) -> None:
        here, name, o = self.source(f), f.text(0), f.options
        if f.name == "timestamps":
            self.timestamps(e, o, here)
            return
        if not name:
            return
        own, target = Ref(model=module), _model(f.args[1]) if len(f.args) > 1 else None
        key = o.get("foreign_key")
        match f.name:
            case "field" if not o.get("virtual"):
                self.field(f, e, name, here)
            case "belongs_to" if target:
                column = key or f"{name}_id"
                if o.get("define_field") is not False:
                    e.columns.append(Column(column, str(o.get("type", foreign)), o.get("null") is not False, source=here))
                to = [o["references"]] if isinstance(o.get("references"), str) else []
                self.out.relations.append(RawRelation(own, Ref(model=target), [column], to, kind="orm", navigation=name, source=here))
            case "has_many" if target and "through" not in o:
                self.out.relations.append(RawRelation(own, Ref(model=target), [], [key or f"{snake(module)}_id"], "one-to-many", "orm", navigation=name, source=here))
            case "has_one" if target and "through" not in o:
                self.out.relations.append(RawRelation(Ref(model=target), own, [key or f"{snake(module)}_id"], [], "one-to-one", "orm", source=here))
            case "many_to_many" if target:
                through = o.get("join_through")
                by = None if through is None else Ref(model=_model(through)) if isinstance(through, Code) and _model(through) else Ref(str(through))
                self.out.relations.append(RawRelation(own, Ref(model=target), cardinality="many-to-many", kind="orm", through=by, navigation=name, source=here))
            case "embeds_one" | "embeds_many":
                e.columns.append(Column(name, "map", is_array=True if f.name == "embeds_many" else None, source=here))

    def field(self, f: Call, e: RawEntity, name: str, here: Source) -> None:
        kind = f.args[1] if len(f.args) > 1 else "string"
        o = f.options
        column = Column(str(o.get("source", name)), "", o.get("null") is not False, o.get("primary_key") is True, source=here, default=_default(o.get("default")))
        if isinstance(kind, list) and kind and kind[0] == "array":
            column.is_array, kind = True, kind[1] if len(kind) > 1 else ""
        if isinstance(kind, list):
            kind = next((k for k in kind if isinstance(k, str)), "")
        column.type = "enum" if kind == "Ecto.Enum" else str(kind)
        values = o.get("values")
        if kind == "Ecto.Enum" and isinstance(values, (list, dict)):
            column.enum_ref = f"{e.name}_{name}"
            self.out.enums.append(RawEnum(column.enum_ref, [str(v) for v in values if not isinstance(v, dict)] or [str(k) for v in values for k in v], source=here))
        column.nullable = column.nullable and not column.primary_key
        e.columns.append(column)

    def timestamps(self, e: RawEntity, o: dict[str, Any], here: Source) -> None:
        for given, name in (("inserted_at", "inserted_at"), ("updated_at", "updated_at")):
            if o.get(given) is not False:
                e.columns.append(Column(o[given] if isinstance(o.get(given), str) else name, str(o.get("type", "naive_datetime")), False, source=here))

    # Migrations

    def table(self, value: Any) -> tuple[Ref, Call] | None:
        t = _again(value)
        if t is None or t.name != "table" or not t.text(0):
            return None
        prefix = t.options.get("prefix")
        return Ref(t.args[0], schema=prefix if isinstance(prefix, str) else None), t

    def changes(self, calls: list[Call]) -> None:
        for c in calls:
            here, first = self.source(c), c.args[0] if c.args else None
            found = self.table(first)
            inner = _again(first)
            if c.name in ("if", "unless", "case"):
                self.changes(c.block)
            elif c.name in ("create", "create_if_not_exists") and found:
                self.create(c, *found)
            elif c.name in ("create", "create_if_not_exists") and inner is not None and inner.name in ("index", "unique_index"):
                self.index(inner, here)
            elif c.name == "alter" and found:
                self.alter(c, found[0])
            elif c.name in ("drop", "drop_if_exists") and found:
                self.out.ops.append(Op("dropTable", found[0], source=here))
            elif c.name == "rename" and found:
                target = c.options.get("to")
                if c.text(1) and isinstance(target, str):
                    self.out.ops.append(Op("renameColumn", found[0], c.args[1], target, source=here))
                elif other := self.table(target):
                    self.out.ops.append(Op("renameTable", found[0], to=other[0].name, source=here))

    def create(self, c: Call, ref: Ref, t: Call) -> None:
        e = RawEntity(ref.name or "", "table", schema=ref.schema, source=self.source(c))
        key = t.options.get("primary_key", True)
        if key is not False and not any(f.options.get("primary_key") is True for f in c.block):
            named = key if isinstance(key, dict) else dict([*(k for k in key if isinstance(k, dict))][0]) if isinstance(key, list) and any(isinstance(k, dict) for k in key) else {}
            kind = str(named.get("type", "bigint"))
            e.columns.append(Column(str(named.get("name", "id")), "bigint" if kind == "id" else kind, False, True, generated=True, source=e.source))
        comment = t.options.get("comment")
        e.comment = comment if isinstance(comment, str) else None
        for f in c.block:
            self.added(f, e, ref)
        self.out.entities.append(e)

    def added(self, f: Call, e: RawEntity, ref: Ref) -> None:
        here = self.source(f)
        if f.name == "timestamps":
            self.timestamps(e, f.options, here)
        elif f.name in ("add", "add_if_not_exists") and f.text(0):
            e.columns.append(self.column(f, ref, here))

    def column(self, f: Call, ref: Ref, here: Source) -> Column:
        name, o, kind = f.args[0], f.options, f.args[1] if len(f.args) > 1 else ""
        column = Column(name, "", o.get("null") is not False, o.get("primary_key") is True, source=here, default=_default(o.get("default")))
        comment = o.get("comment")
        column.comment = comment if isinstance(comment, str) else None
        column.nullable = column.nullable and not column.primary_key
        target = _again(kind)
        if target is not None and target.name == "references" and target.text(0):
            more = target.options
            column.type = str(more.get("type", "bigint"))
            rules = {k: RULES.get(v) if isinstance(v := more.get(k), str) else None for k in ("on_delete", "on_update")}
            prefix = more.get("prefix")
            to = [str(more["column"])] if "column" in more else ["id"]
            self.out.relations.append(
                RawRelation(Ref(ref.name, schema=ref.schema), Ref(target.args[0], schema=prefix if isinstance(prefix, str) else None), [name], to, name=more.get("name"), **rules, optional=column.nullable, source=here)
            )
        elif isinstance(kind, list) and kind and kind[0] == "array":
            column.is_array, column.type = True, str(kind[1]) if len(kind) > 1 else ""
        else:
            column.type = str(kind)
        size, precision = o.get("size"), o.get("precision")
        if isinstance(size, int) and not isinstance(size, bool):
            column.type += f"({size})"
        elif isinstance(precision, int) and not isinstance(precision, bool):
            column.type += f"({precision}" + (f",{o['scale']})" if isinstance(o.get("scale"), int) else ")")
        return column

    def alter(self, c: Call, ref: Ref) -> None:
        e = RawEntity(ref.name or "", "table", schema=ref.schema, partial=True, source=self.source(c))
        own = lambda: Ref(ref.name, schema=ref.schema)
        for f in c.block:
            here = self.source(f)
            if f.name in ("remove", "remove_if_exists") and f.text(0):
                self.out.ops.append(Op("dropColumn", own(), f.args[0], source=here))
            elif f.name == "modify" and f.text(0):
                column = self.column(f, ref, here)
                patch: dict[str, Any] = {"type": column.type} if column.type else {}
                if "null" in f.options:
                    patch["nullable"] = f.options["null"] is not False
                if "default" in f.options:
                    patch["default"] = column.default
                self.out.ops.append(Op("alterColumn", own(), column.name, set=patch, source=here))
            else:
                self.added(f, e, ref)
        if e.columns:
            self.out.entities.append(e)

    def index(self, inner: Call, here: Source) -> None:
        columns = inner.args[1] if len(inner.args) > 1 else None
        names = [x for x in (columns if isinstance(columns, list) else [columns]) if isinstance(x, str) and not isinstance(x, Code)]
        if inner.text(0) and names:
            unique = (inner.name == "unique_index" or inner.options.get("unique") is True) and "where" not in inner.options
            name, prefix = inner.options.get("name"), inner.options.get("prefix")
            index = Index(names, unique, name if isinstance(name, str) else None)
            self.out.entities.append(RawEntity(inner.args[0], "table", schema=prefix if isinstance(prefix, str) else None, partial=True, indexes=[index], source=here))


READERS = {KIND: SimpleNamespace(detect=detect, parse=parse)}
