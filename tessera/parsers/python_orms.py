"""Models of five Python ORMs and migrations of one, read from syntax trees."""

from __future__ import annotations

import ast
import re
from types import SimpleNamespace

from tessera.functions.names import default_table, snake
from tessera.model import Column, Index, Op, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.parsers import pyast as py
from tessera.parsers.pyast import Call, Member

ON_DELETE = {"CASCADE": "CASCADE", "SET_NULL": "SET NULL", "SET NULL": "SET NULL", "SET_DEFAULT": "SET DEFAULT", "SET DEFAULT": "SET DEFAULT", "PROTECT": "RESTRICT", "RESTRICT": "RESTRICT", "DO_NOTHING": "NO ACTION", "NO ACTION": "NO ACTION", "NO_ACTION": "NO ACTION"}


def _action(text: str | None) -> str | None:
    word = py.tail(text or "").upper()
    return ON_DELETE.get(word, word) or None


def _many(model: str, target: Ref, through: Ref | None, source: Source) -> RawRelation:
    return RawRelation(Ref(model=model), target, cardinality="many-to-many", kind="orm", through=through, source=source)


def _tuples(node: ast.AST | None) -> list[ast.AST]:
    return list(node.elts) if isinstance(node, (ast.Tuple, ast.List, ast.Set)) else []


# Django

DJANGO_BASES = {"Model", "AbstractUser", "AbstractBaseUser", "AbstractEmailUser", "PolymorphicModel"}
CHOICES = {"TextChoices", "IntegerChoices", "Choices"}
NOT_ABSTRACT = DJANGO_BASES | CHOICES | {"object", "PermissionsMixin"}


def _app(path: str) -> str:
    folders = [p for p in path.split("/")[:-1] if p]
    if not folders:
        return ""
    if path.rpartition("/")[2].lower() != "models.py" and "models" in folders[1:]:
        return folders[len(folders) - 1 - folders[::-1].index("models") - 1]
    return folders[-1]


def _django_kind(m: Member) -> str | None:
    name = m.call.name if m.call else ""
    kinds = {"ForeignKey": "one", "ForeignKeyField": "one", "OneToOneField": "own", "ManyToManyField": "many"}
    return kinds.get(name) or ("field" if name.endswith("Field") else None)


def _django_target(node: ast.AST | None, model: str) -> Ref:
    said = py.source_text(node) if node is not None else ""
    if "AUTH_USER_MODEL" in said or "get_user_model" in said:
        return Ref("auth_user", "User")
    name = py.tail(py.reference(node))
    return Ref(model=model if name in ("self", "") else name)


def django_detect(path: str, text: str) -> bool:
    if not path.endswith(".py") or "migrations" in path.split("/") or "django" not in text:
        return False
    return bool(re.search(r"\bmodels\.Model\b|\bAbstract(?:User|BaseUser)\b|models\.\w+Field\s*\(|models\.(?:ForeignKey|OneToOneField|ManyToManyField)\s*\(", text))


def django(path: str, text: str) -> Parsed:
    out = Parsed(path, "django")
    if "migrations" in path.split("/"):
        return out
    app = _app(path)
    found = list(py.classes(py.tree(text)))
    known = {c.name: c for c in found}
    choices = [c for c in found if CHOICES & set(py.base_names(c))]
    models = {c.name for c in found if c not in choices and (DJANGO_BASES & set(py.base_names(c)) or any(map(_django_kind, py.members(c))))}
    for c in found:
        if c in choices:
            values = [x for m in py.members(c) if re.match(r"[A-Z]", m.name) and (x := _choice(m.value)) is not None]
            if values:
                out.enums.append(RawEnum(c.name, list(dict.fromkeys(values)), source=py.at(path, c)))
        elif c.name in models or any(b in known and known[b] not in choices and b not in NOT_ABSTRACT for b in py.base_names(c)):
            _django_model(path, c, app, out)
    return out


def _choice(node: ast.AST | None) -> str | None:
    first = node.elts[0] if isinstance(node, ast.Tuple) and node.elts else node
    return str(first.value) if isinstance(first, ast.Constant) and isinstance(first.value, (str, int, float)) else None


def _django_model(path: str, c: ast.ClassDef, app: str, out: Parsed) -> None:
    meta = py.meta(c)
    if py.true(meta.get("proxy")):
        return
    columns, keyed = [], False
    for m in py.members(c):
        kind, call, source = _django_kind(m), m.call, Source(path, m.line)
        if kind is None:
            continue
        nullable, target = call.flag("null") is True, _django_target(call.arg(0, "to"), c.name)
        if kind == "many":
            through = call.arg(None, "through")
            table = call.string(None, "db_table") or "_".join(filter(None, (app, c.name.lower(), m.name.lower())))
            out.relations.append(_many(c.name, target, Ref(model=py.tail(py.reference(through))) if through is not None else Ref(table), source))
            continue
        primary = call.flag("primary_key") is True or call.flag("parent_link") is True
        keyed = keyed or primary or call.name in ("AutoField", "BigAutoField", "SmallAutoField")
        unique = kind == "own" or call.flag("unique") is True
        column = Column(call.string(None, "db_column") or (m.name if kind == "field" else f"{m.name}_id"), call.name if kind == "field" else "", nullable and not primary, primary, unique, source=source)
        columns.append(column)
        if kind == "field":
            column.default, column.comment = call.text("default"), call.string(None, "db_comment")
            choices = call.text("choices")
            name = py.tail(re.sub(r"\.choices$", "", choices)) if choices else ""
            column.enum_ref = name if re.fullmatch(r"[A-Z]\w*", name) else None
        else:
            field = call.string(None, "to_field")
            out.relations.append(
                RawRelation(Ref(model=c.name), target, [column.name], [field] if field else [], "one-to-one" if kind == "own" else "many-to-one", "orm",
                    on_delete=_action(py.dotted(call.arg(1, "on_delete"))), optional=nullable, source=source)
            )
    abstract = py.true(meta.get("abstract"))
    if not abstract and not keyed and not any(x.name == "id" for x in columns):
        columns.insert(0, Column("id", "BigAutoField", False, True, generated=True))
    indexes = []
    together = meta.get("unique_together")
    nested = _tuples(together) if any(isinstance(x, (ast.Tuple, ast.List)) for x in _tuples(together)) else [together]
    indexes += [Index(names, True) for x in nested if (names := py.strings(x))]
    for key, name, unique in (("indexes", "Index", False), ("constraints", "UniqueConstraint", True)):
        for call in filter(None, map(Call.of, _tuples(meta.get(key)))):
            if call.name == name and (names := py.strings(call.arg(None, "fields"))):
                indexes.append(Index(names, unique, call.string(None, "name")))
    table = py.string(meta.get("db_table"))
    out.entities.append(
        RawEntity(table or default_table("django", c.name, app), "table", columns, model_name=c.name, name_certainty=2 if table else 0, abstract=abstract,
            extends=[b for b in py.base_names(c) if b not in NOT_ABSTRACT], indexes=indexes, group=app or None,
            comment=py.string(meta.get("db_table_comment")) or py.doc(c), source=py.at(path, c))
    )


# SQLAlchemy

ROOTS = {"Base", "DeclarativeBase"}
NO_MIXINS = {"Model", "object", "Base", "DeclarativeBase", "Generic", "ABC"}
COLUMNS = ("Column", "mapped_column")
#: Positional arguments of a column that are not its type.
NOT_TYPES = re.compile(r"(?:\w+\.)*(?:ForeignKey|ForeignKeyConstraint|PrimaryKeyConstraint|UniqueConstraint|CheckConstraint|Index|Computed|Identity|Sequence|FetchedValue)\b")


def _imports(text: str, *packages: str) -> bool:
    """Whether a line imports one of the packages or something of theirs."""
    return bool(re.search(rf"(?m)^[ \t]*(?:from|import)[ \t]+(?:{'|'.join(packages)})(?![\w-])", text))


def _calls(text: str, *names: str) -> bool:
    return bool(re.search(rf"(?<![\w.])(?:\w+\.)?(?:{'|'.join(names)})[ \t]*\(", text))


def sqlalchemy_detect(path: str, text: str) -> bool:
    """The library, its Flask extension or its migrations are imported, or a class with a table name makes columns."""
    if not path.endswith(".py"):
        return False
    return _imports(text, "sqlalchemy", "flask_sqlalchemy", "alembic") or ("__tablename__" in text and _calls(text, "Column", "mapped_column", "reference_col"))


def _fk_target(text: str) -> tuple[Ref, str | None]:
    parts = text.split(".")
    if len(parts) == 1:
        return Ref(parts[0]), None
    return Ref(parts[-2], schema=".".join(parts[:-2]) or None), parts[-1]


def _type_text(node: ast.AST) -> str:
    said = py.source_text(node)
    return re.sub(r"^(?:\w+\.)+", "", re.sub(r"\(\)$", "", said))


class Alchemy:
    """Columns, tables and models of one file."""

    def __init__(self, path: str, out: Parsed):
        self.path, self.out = path, out
        self.variables: dict[str, str] = {}

    def column(self, call: Call, fallback: str | None, line: int, annotation: ast.AST | None = None) -> tuple[Column, RawRelation | None] | None:
        args = list(call.node.args)
        name = py.string(args[0]) if args else None
        if name is not None:
            args = args[1:]
        name = name or call.string(None, "name") or fallback
        if not name:
            return None
        type_node = next((a for a in args if not NOT_TYPES.match(py.source_text(a))), None)
        type_node = type_node if type_node is not None else call.arg(None, "type_")
        hinted, maybe = py.optional(annotation)
        primary, nullable = call.flag("primary_key") is True, call.flag("nullable")
        if nullable is None:
            nullable = not primary and (maybe if annotation is not None else True)
        column = Column(name, _type_text(type_node) if type_node is not None else ("" if hinted == "None" else hinted), nullable and not primary, primary, call.flag("unique") is True, source=Source(self.path, line))
        if call.flag("autoincrement") is True:
            column.generated = True
        column.default = call.text("default") or call.text("server_default")
        column.comment = call.string(None, "comment")
        self.enum(type_node, column, line)
        relation = None
        for fk in filter(None, map(Call.of, args)):
            if fk.name == "ForeignKey" and (target := py.reference(fk.arg(0, "column"))):
                ref, to = _fk_target(target)
                relation = RawRelation(Ref(), ref, [name], [to] if to else [], on_delete=_upper(fk, "ondelete"), on_update=_upper(fk, "onupdate"), optional=column.nullable, source=column.source)
                break
        return column, relation

    def enum(self, node: ast.AST | None, column: Column, line: int) -> None:
        call = Call.of(node)
        name = call.string(None, "name") if call and call.name in ("Enum", "ENUM") else None
        values = [v for a in call.node.args if (v := py.string(a)) is not None] if name else []
        if values:
            column.enum_ref = column.type = name
            if not any(e.name == name for e in self.out.enums):
                self.out.enums.append(RawEnum(name, values, source=Source(self.path, line)))

    def constraints(self, nodes: list[ast.AST], owner: Ref, columns: list[Column], indexes: list[Index], line: int) -> None:
        known = {c.name: c for c in columns}
        for call in filter(None, map(Call.of, nodes)):
            names = [v for a in call.node.args if (v := py.string(a)) is not None]
            if call.name == "UniqueConstraint" and names:
                indexes.append(Index(names, True, call.string(None, "name")))
            elif call.name == "PrimaryKeyConstraint":
                for n in names:
                    if n in known:
                        known[n].primary_key, known[n].nullable = True, False
            elif call.name == "Index" and names:
                rest = [py.dotted(a) for a in call.node.args[1:] if not py.string(a)]
                used = names[1:] + [r for r in rest if r]
                if used:
                    indexes.append(Index(used, call.flag("unique") is True, names[0]))
            elif call.name == "ForeignKeyConstraint":
                own, others = py.strings(call.arg(0, "columns")), py.strings(call.arg(1, "refcolumns"))
                if own and others:
                    ref, _ = _fk_target(others[0])
                    free = all(known[n].nullable for n in own if n in known)
                    self.out.relations.append(RawRelation(owner, ref, own, [c for o in others if (c := _fk_target(o)[1])], name=call.string(None, "name"), on_delete=_upper(call, "ondelete"), on_update=_upper(call, "onupdate"), optional=free, source=Source(self.path, line)))

    def table(self, call: Call, line: int, from_: int = 1) -> tuple[list[Column], list[Index]]:
        """Columns and constraints among positional arguments."""
        name, columns, indexes = call.string(0, "name"), [], []
        owner = lambda: Ref(name, schema=call.string(None, "schema"))
        for a in call.node.args[from_:]:
            inner = Call.of(a)
            if inner and inner.name == "Column" and (got := self.column(inner, None, a.lineno - 1)):
                columns.append(got[0])
                if got[1]:
                    got[1].from_ = owner()
                    self.out.relations.append(got[1])
        self.constraints(call.node.args[from_:], owner(), columns, indexes, line)
        return columns, indexes

    def core(self, body: list[ast.stmt]) -> None:
        for node in body:
            value = node.value if isinstance(node, (ast.Assign, ast.AnnAssign)) else None
            call = Call.of(value)
            if call and call.name == "Table" and (name := call.string(0, "name")):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                self.variables.update((t.id, name) for t in targets if isinstance(t, ast.Name))
                columns, indexes = self.table(call, node.lineno - 1)
                self.out.entities.append(RawEntity(name, "table", columns, call.string(None, "schema"), indexes=indexes, source=py.at(self.path, node)))

    def model(self, c: ast.ClassDef, abstract: bool, abstracts: set[str], roots: set[str]) -> None:
        table, certainty, schema, columns, indexes, args = None, 0, None, [], [], None
        for m in py.members(c):
            call = m.call
            if m.name == "__tablename__":
                if said := py.string(m.value):
                    table, certainty = said, 2
                elif m.value is not None and re.search(r"__name__\s*\.\s*lower\(\)", py.source_text(m.value)):
                    table, certainty = c.name.lower(), 1
            elif m.name == "__table_args__":
                args = m
            elif m.name.startswith("__"):
                continue
            elif call and call.name == "relationship":
                self.many(c.name, m, call)
            elif call and call.name == "reference_col":
                target, key = call.string(0, "tablename"), call.string(2, "pk_name") or "id"
                nullable = call.flag("nullable") is True
                columns.append(Column(m.name, nullable=nullable, source=Source(self.path, m.line)))
                if target:
                    self.out.relations.append(RawRelation(Ref(model=c.name), Ref(target), [m.name], [key], optional=nullable, source=Source(self.path, m.line)))
            elif call and call.name in COLUMNS or m.annotation is not None and py.dotted(m.annotation).endswith("Mapped"):
                self.member(c.name, m, columns)
        if args is not None:
            parts = _tuples(args.value) or [args.value]
            for d in parts:
                if isinstance(d, ast.Dict):
                    schema = next((py.string(v) for k, v in zip(d.keys, d.values) if py.string(k) == "schema"), schema)
            self.constraints(parts, Ref(model=c.name), columns, indexes, args.line)
        extends = [b for b in py.base_names(c) if b in abstracts or (b not in roots and b not in NO_MIXINS)]
        self.out.entities.append(RawEntity(table or snake(c.name), "table", columns, schema, c.name, certainty, abstract=abstract, extends=extends, indexes=indexes, comment=py.doc(c), source=py.at(self.path, c)))

    def member(self, model: str, m: Member, columns: list[Column]) -> None:
        call = m.call if m.call and m.call.name in COLUMNS else None
        if call is None:
            type_, maybe = py.optional(m.annotation)
            columns.append(Column(m.name, "" if type_ == "None" else type_, maybe, source=Source(self.path, m.line)))
            return
        column, relation = self.column(call, m.name, m.line, m.annotation)
        columns.append(column)
        if relation:
            relation.from_ = Ref(model=model)
            self.out.relations.append(relation)

    def many(self, model: str, m: Member, call: Call) -> None:
        secondary = call.arg(None, "secondary")
        target = py.tail(py.reference(call.arg(0, "argument"))) or py.model_in(m.annotation)
        if secondary is not None and target:
            through = py.string(secondary) or self.variables.get(py.dotted(secondary)) or self.variables.get(py.tail(py.dotted(secondary))) or py.tail(py.dotted(secondary))
            self.out.relations.append(_many(model, Ref(model=target), Ref(through), Source(self.path, m.line)))


def _upper(call: Call, name: str) -> str | None:
    said = call.string(None, name)
    return said.upper() if said else None


def sqlalchemy(path: str, text: str) -> Parsed:
    body = py.tree(text)
    upgrade = next((n for n in body if isinstance(n, ast.FunctionDef) and n.name == "upgrade"), None)
    if upgrade and re.search(r"\b(?:op|batch_op)\s*\.\s*\w+\s*\(", text):
        return Alembic(path, body, upgrade).read()
    if upgrade and re.search(r"(?m)^revision\b", text):
        return Alembic(path, body, upgrade).read()
    out = Parsed(path, "sqlalchemy")
    alchemy = Alchemy(path, out)
    found = list(py.classes(body))
    known = {c.name: c for c in found}
    roots = set(ROOTS) | {c.name for c in found if "DeclarativeBase" in py.base_names(c)}
    for n in body:
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and Call(n.value).name in ("declarative_base", "generate_base"):
            roots |= {t.id for t in n.targets if isinstance(t, ast.Name)}
    alchemy.core(body)
    roles = {}
    for c in found:
        bases = py.base_names(c)
        rooted = py.reaches(c, known, lambda n: py.tail(n) in roots or py.tail(n) == "Model")
        mine = py.members(c)
        has = lambda name: any(m.name == name for m in mine)  # noqa: B023, E731
        columns = any((m.call and m.call.name in (*COLUMNS, "reference_col")) or (m.annotation is not None and py.dotted(m.annotation).endswith("Mapped") and not (m.call and m.call.name == "relationship")) for m in mine if not m.name.startswith("__"))
        if c.name in roots or "SQLModel" in bases or any(k.arg == "table" for k in c.keywords) or ("BaseModel" in bases and not rooted):
            continue
        if any(m.name == "__abstract__" and py.true(m.value) for m in mine) or (columns and not rooted):
            roles[c.name] = (c, True)
        elif rooted and (columns or has("__tablename__") or has("__table__")):
            roles[c.name] = (c, False)
    abstracts = {n for n, (_, a) in roles.items() if a}
    for c, abstract in roles.values():
        alchemy.model(c, abstract, abstracts, roots)
    return out


class Alembic:
    """The upgrade of one revision."""

    def __init__(self, path: str, body: list[ast.stmt], upgrade: ast.FunctionDef):
        self.path, self.upgrade = path, upgrade
        self.out = Parsed(path, "sqlalchemy", "migration")
        self.alchemy = Alchemy(path, self.out)
        for n in body:
            target = n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, ast.AnnAssign) else None
            if isinstance(target, ast.Name) and target.id == "revision":
                self.out.revision = py.string(n.value)
            elif isinstance(target, ast.Name) and target.id == "down_revision":
                self.out.after = py.strings(n.value)

    def read(self) -> Parsed:
        self.walk(self.upgrade.body, {})
        return self.out

    def walk(self, body: list[ast.stmt], batches: dict[str, Ref]) -> None:
        for node in body:
            inner = dict(batches)
            if isinstance(node, ast.With):
                for item in node.items:
                    call = Call.of(item.context_expr)
                    if call and call.name == "batch_alter_table" and isinstance(item.optional_vars, ast.Name) and (name := call.string(0, "table_name")):
                        inner[item.optional_vars.id] = Ref(name, schema=call.string(None, "schema"))
            for value in [getattr(node, "value", None)]:
                call = Call.of(value)
                if call and isinstance(call.node.func, ast.Attribute):
                    self.apply(call, inner.get(py.dotted(call.node.func.value)), node)
            for part in ("body", "orelse", "handlers", "finalbody"):
                self.walk([x for x in getattr(node, part, []) if isinstance(x, ast.stmt)], inner)

    def apply(self, call: Call, batch: Ref | None, node: ast.AST) -> None:
        act = getattr(self, "op_" + call.name, None)
        if act:
            act(call, batch, py.at(self.path, node))

    def target(self, call: Call, batch: Ref | None, place: int = 0, *names: str) -> tuple[Ref | None, int]:
        """The table, and the place of the next argument."""
        if batch:
            return Ref(batch.name, schema=batch.schema), place
        name = call.string(place, "table_name", *names)
        return (Ref(name, schema=call.string(None, "schema")) if name else None), place + 1

    def partial(self, ref: Ref, source: Source, columns=(), indexes=()) -> None:
        self.out.entities.append(RawEntity(ref.name, "table", list(columns), ref.schema, partial=True, indexes=list(indexes), source=source))

    def op_create_table(self, call: Call, batch: Ref | None, source: Source) -> None:
        if name := call.string(0, "table_name"):
            columns, indexes = self.alchemy.table(call, source.line)
            self.out.entities.append(RawEntity(name, "table", columns, call.string(None, "schema"), indexes=indexes, comment=call.string(None, "comment"), source=source))

    def op_drop_table(self, call: Call, batch: Ref | None, source: Source) -> None:
        ref, _ = self.target(call, batch)
        if ref:
            self.out.ops.append(Op("dropTable", ref, source=source))

    def op_rename_table(self, call: Call, batch: Ref | None, source: Source) -> None:
        old, new = call.string(0, "old_table_name"), call.string(1, "new_table_name")
        if old and new:
            self.out.ops.append(Op("renameTable", Ref(old, schema=call.string(None, "schema")), to=new, source=source))

    def op_add_column(self, call: Call, batch: Ref | None, source: Source) -> None:
        ref, place = self.target(call, batch)
        inner = Call.of(call.arg(place, "column"))
        got = self.alchemy.column(inner, None, source.line) if ref and inner else None
        if got:
            self.partial(ref, source, [got[0]])
            if got[1]:
                got[1].from_ = Ref(ref.name, schema=ref.schema)
                self.out.relations.append(got[1])

    def op_drop_column(self, call: Call, batch: Ref | None, source: Source) -> None:
        ref, place = self.target(call, batch)
        if ref and (name := call.string(place, "column_name")):
            self.out.ops.append(Op("dropColumn", ref, name, source=source))

    def op_alter_column(self, call: Call, batch: Ref | None, source: Source) -> None:
        ref, place = self.target(call, batch)
        name = call.string(place, "column_name") if ref else None
        if not name:
            return
        new = call.string(None, "new_column_name")
        if new:
            self.out.ops.append(Op("renameColumn", ref, name, new, source=source))
        patch = {}
        if (nullable := call.flag("nullable")) is not None:
            patch["nullable"] = nullable
        if (type_ := call.arg(None, "type_")) is not None:
            patch["type"] = _type_text(type_)
        default = call.arg(None, "server_default")
        if default is not None and not (isinstance(default, ast.Constant) and default.value in (None, False)):
            patch["default"] = py.source_text(default)
        if comment := call.string(None, "comment"):
            patch["comment"] = comment
        if patch:
            self.out.ops.append(Op("alterColumn", Ref(ref.name, schema=ref.schema), new or name, set=patch, source=source))

    def op_create_foreign_key(self, call: Call, batch: Ref | None, source: Source) -> None:
        name = call.string(0, "constraint_name")
        ref, place = (batch, 1) if batch else (Ref(s, schema=call.string(None, "source_schema")) if (s := call.string(1, "source_table")) else None, 2)
        target = call.string(place, "referent_table")
        own, others = py.strings(call.arg(place + 1, "local_cols")), py.strings(call.arg(place + 2, "remote_cols"))
        if ref and target and own:
            self.out.relations.append(RawRelation(Ref(ref.name, schema=ref.schema), Ref(target, schema=call.string(None, "referent_schema")), own, others, name=name, on_delete=_upper(call, "ondelete"), on_update=_upper(call, "onupdate"), source=source))

    def op_drop_constraint(self, call: Call, batch: Ref | None, source: Source) -> None:
        name = call.string(0, "constraint_name")
        ref, _ = (batch, 1) if batch else self.target(call, None, 1)
        if ref and name:
            self.out.ops.append(Op("dropForeignKey", Ref(ref.name, schema=ref.schema), name=name, source=source))

    def op_create_index(self, call: Call, batch: Ref | None, source: Source, unique: bool | None = None) -> None:
        name = call.string(0, "index_name", "constraint_name")
        ref, place = (batch, 1) if batch else self.target(call, None, 1)
        columns = py.strings(call.arg(place, "columns")) if ref else []
        if columns:
            self.partial(Ref(ref.name, schema=ref.schema), source, indexes=[Index(columns, call.flag("unique") is True if unique is None else unique, name)])

    def op_create_unique_constraint(self, call: Call, batch: Ref | None, source: Source) -> None:
        self.op_create_index(call, batch, source, True)

    def op_create_primary_key(self, call: Call, batch: Ref | None, source: Source) -> None:
        ref, place = (batch, 1) if batch else self.target(call, None, 1)
        for name in py.strings(call.arg(place, "columns")) if ref else []:
            self.out.ops.append(Op("alterColumn", Ref(ref.name, schema=ref.schema), name, set={"primary_key": True}, source=source))


# SQLModel, Peewee, Tortoise


def sqlmodel_detect(path: str, text: str) -> bool:
    return path.endswith(".py") and bool(re.search(r"\bsqlmodel\b", text) and re.search(r"\bSQLModel\b", text))


def sqlmodel(path: str, text: str) -> Parsed:
    out = Parsed(path, "sqlmodel")
    found = list(py.classes(py.tree(text)))
    known = {c.name: c for c in found}
    table_flag = lambda c: next((k.value for k in c.keywords if k.arg == "table"), None)
    names = {c.name for c in found if table_flag(c) is not None or py.reaches(c, known, lambda n: py.tail(n) == "SQLModel")}
    for c in found:
        if c.name not in names:
            continue
        columns, table = [], None
        for m in py.members(c):
            call, source = m.call, Source(path, m.line)
            if m.name == "__tablename__":
                table = py.string(m.value)
            elif m.name.startswith("__") or m.annotation is None:
                continue
            elif call and call.name == "Relationship":
                link, target = call.arg(None, "link_model"), py.model_in(m.annotation)
                if link is not None and target:
                    out.relations.append(_many(c.name, Ref(model=target), Ref(model=py.tail(py.reference(link))), source))
            else:
                field = call if call and call.name == "Field" else None
                type_, maybe = py.optional(m.annotation)
                primary = bool(field and field.flag("primary_key"))
                column = Column(m.name, "" if type_ == "None" else type_, maybe and not primary, primary, bool(field and field.flag("unique")), source=source)
                default = field.text("default") if field else None
                column.default = default if default != "None" else None
                if field and (fk := field.string(None, "foreign_key")):
                    name, _, to = fk.rpartition(".")
                    ref = Ref(name or to)
                    out.relations.append(RawRelation(Ref(model=c.name), ref, [m.name], [to] if name else [], kind="orm", on_delete=_action(field.string(None, "ondelete")), optional=column.nullable, source=source))
                columns.append(column)
        out.entities.append(
            RawEntity(table or c.name.lower(), "table", columns, model_name=c.name, name_certainty=2 if table else 0, abstract=not py.true(table_flag(c)),
                extends=[b for b in py.base_names(c) if b != "SQLModel" and b in names], comment=py.doc(c), source=py.at(path, c))
        )
    return out


#: How the two active-record ORMs spell the same things.
PEEWEE = SimpleNamespace(kind="peewee", column="column_name", key=("primary_key",), target="model", table=("table_name", "db_table"), id_type="AutoField", one=("ForeignKeyField", "DeferredForeignKey"), own=(), many=("ManyToManyField",), auto=("AutoField", "BigAutoField", "IdentityField"))
TORTOISE = SimpleNamespace(
    kind="tortoise", column="source_field", key=("pk", "primary_key"), target="model_name", table=("table",), id_type="IntField", one=("ForeignKeyField", "ForeignKeyRelation"),
    own=("OneToOneField", "OneToOneRelation"), many=("ManyToManyField", "ManyToManyRelation"), auto=(),
)


def _active(path: str, text: str, o: SimpleNamespace) -> Parsed:
    out = Parsed(path, o.kind)
    found = list(py.classes(py.tree(text)))
    known = {c.name: c for c in found}
    names = {c.name for c in found if py.reaches(c, known, lambda n: py.tail(n) == "Model")}
    for c in found:
        if c.name not in names:
            continue
        meta, columns, keyed, fields = py.meta(c), [], False, 0
        for m in py.members(c):
            call, source = m.call, Source(path, m.line)
            if call is None or not (call.name in o.one + o.own + o.many or call.name.endswith("Field")):
                continue
            fields += 1
            nullable = call.flag("null") is True
            said = py.reference(call.arg(0, o.target))
            target = Ref(model=c.name if said in ("", "self") else py.tail(said))
            if call.name in o.many:
                through = call.arg(None, "through_model", "through")
                name = py.string(through)
                link = None if through is None else Ref(name) if name and o.kind == "tortoise" else Ref(model=py.tail(py.reference(through)))
                out.relations.append(_many(c.name, target, link, source))
                continue
            linked = call.name in o.one + o.own
            primary = any(call.flag(k) is True for k in o.key)
            keyed = keyed or primary or call.name in o.auto
            unique = call.name in o.own or call.flag("unique") is True
            column = Column(call.string(None, o.column) or (f"{m.name}_id" if linked else m.name), "" if linked else call.name, nullable and not primary, primary, unique, source=source)
            columns.append(column)
            if not linked:
                column.default = call.text("default")
                if primary and o.kind == "tortoise" and call.name in ("IntField", "BigIntField"):
                    column.generated = True
                continue
            to = call.string(None, "field") if o.kind == "peewee" else None
            one = call.name in o.own or (o.kind == "peewee" and unique)
            deleted = call.arg(None, "on_delete")
            out.relations.append(RawRelation(Ref(model=c.name), target, [column.name], [to] if to else [], "one-to-one" if one else "many-to-one", "orm", on_delete=_action(py.reference(deleted)) if deleted is not None else None, optional=nullable, source=source))
        abstract = py.true(meta.get("abstract")) if o.kind == "tortoise" else not fields
        composite = Call.of(meta.get("primary_key"))
        for name in py.strings(composite.node) if composite and composite.name == "CompositeKey" else []:
            keyed = True
            for x in columns:
                if x.name in (name, f"{name}_id"):
                    x.primary_key, x.nullable = True, False
        keyed = keyed or (isinstance(meta.get("primary_key"), ast.Constant) and meta["primary_key"].value is False)
        if not abstract and not keyed and not any(x.name == "id" for x in columns):
            columns.insert(0, Column("id", o.id_type, False, True, generated=True))
        table = next((t for k in o.table if (t := py.string(meta.get(k)))), None)
        indexes = []
        for x in _tuples(meta.get("indexes")):
            parts = _tuples(x)
            names_ = py.strings(parts[0]) if parts and _tuples(parts[0]) else py.strings(x)
            if names_:
                indexes.append(Index(names_, len(parts) > 1 and py.true(parts[1])))
        out.entities.append(
            RawEntity(table or default_table(o.kind, c.name), "table", columns, py.string(meta.get("schema")), c.name, 2 if table else 0, abstract=abstract,
                extends=[b for b in py.base_names(c) if b != "Model" and b in names], indexes=indexes, comment=py.doc(c), source=py.at(path, c))
        )
    return out


def peewee_detect(path: str, text: str) -> bool:
    return path.endswith(".py") and _imports(text, "peewee") and _calls(text, r"\w*Field")


def tortoise_detect(path: str, text: str) -> bool:
    return path.endswith(".py") and "tortoise" in text and (_imports(text, "tortoise") or "fields." in text and _calls(text, r"\w*Field"))


def peewee(path: str, text: str) -> Parsed:
    return _active(path, text, PEEWEE)


def tortoise(path: str, text: str) -> Parsed:
    return _active(path, text, TORTOISE)


READERS = {
    "django": SimpleNamespace(detect=django_detect, parse=django),
    "sqlalchemy": SimpleNamespace(detect=sqlalchemy_detect, parse=sqlalchemy),
    "sqlmodel": SimpleNamespace(detect=sqlmodel_detect, parse=sqlmodel),
    "peewee": SimpleNamespace(detect=peewee_detect, parse=peewee),
    "tortoise": SimpleNamespace(detect=tortoise_detect, parse=tortoise),
}
