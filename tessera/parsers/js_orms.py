"""Models and migrations of JavaScript and TypeScript libraries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

from tessera.functions.names import default_table, lcfirst_plain, pluralize, snake
from tessera.model import Column, Hint, Index, Op, Parsed, RawEntity, RawEnum, RawRelation, Ref
from tessera.parsers.jsast import Class, Member, Node, Script, arrow_target, strings

EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
TS_TYPES = {"string", "number", "boolean", "Date", "Buffer", "bigint", "object", "any", "unknown"}


def _is_js(path: str) -> bool:
    return path.lower().endswith(EXTENSIONS) and not path.lower().endswith(".d.ts")


def _bare_type(type_: str) -> tuple[str, bool]:
    """A TypeScript type without null, and whether it was there."""
    parts = [p.strip() for p in type_.split("|")] if "|" in type_ and "<" not in type_ else [type_.strip()]
    rest = [p for p in parts if p not in ("null", "undefined")]
    return " | ".join(rest), len(rest) < len(parts)


def _flag(options: Node | None, name: str) -> bool | None:
    value = options.get(name) if options else None
    return None if value is None else True if value.true else False if value.false else None


def _text(options: Node | None, name: str) -> str | None:
    value = options.get(name) if options else None
    return value.string if value is not None else None


def _options(args: list[Node]) -> Node | None:
    return next((a for a in args if a.kind == "obj"), None)


# TypeORM

COLUMN_DECORATORS = {"Column", "PrimaryColumn", "PrimaryGeneratedColumn", "CreateDateColumn", "UpdateDateColumn", "DeleteDateColumn", "VersionColumn", "ObjectIdColumn", "Generated"}
TYPEORM_LINKS = {"ManyToOne": "many-to-one", "OneToOne": "one-to-one", "ManyToMany": "many-to-many", "OneToMany": "one-to-many"}


def typeorm_detect(path: str, text: str) -> bool:
    return _is_js(path) and bool(re.search(r"from\s+['\"]typeorm['\"]|require\(\s*['\"]typeorm['\"]", text)) and bool(re.search(r"@(?:Entity|ChildEntity|ViewEntity|Column|Primary\w*Column)\b|EntitySchema", text))


def typeorm(path: str, text: str) -> Parsed:
    script, out = Script(path, text), Parsed(path, "typeorm")
    for c in script.classes():
        entity = c.decorator("Entity", "ChildEntity", "ViewEntity")
        columns = [m for m in c.members if any(d.tail in COLUMN_DECORATORS or d.tail in TYPEORM_LINKS for d in m.decorators)]
        if not c.name or (entity is None and not columns):
            continue
        args = entity.items if entity is not None and entity.kind == "call" else []
        options = _options(args)
        name = (args[0].string if args else None) or _text(options, "name")
        raw = RawEntity(name or snake(c.name), "view" if entity is not None and entity.tail == "ViewEntity" else "table", schema=_text(options, "schema"), model_name=c.name, name_certainty=2 if name else 0, abstract=entity is None, source=script.source(c.at), comment=_text(options, "comment"))
        raw.shared_table = entity is not None and entity.tail == "ChildEntity"
        raw.extends = [c.base.tail] if c.base is not None and c.base.tail else []
        for m in columns:
            _typeorm_member(script, out, raw, c, m)
        for d in c.decorators:
            if d.tail in ("Index", "Unique") and d.kind == "call":
                names = next((strings(a) or [x.tail for x in (a.of.items if a.kind == "fn" and a.of is not None and a.of.kind == "arr" else [])] for a in d.items if a.kind in ("arr", "fn")), [])
                unique = d.tail == "Unique" or bool(_flag(_options(d.items), "unique"))
                if names:
                    raw.indexes.append(Index(names, unique, d.items[0].string if d.items else None))
        out.entities.append(raw)
    return out


def _typeorm_member(script: Script, out: Parsed, raw: RawEntity, c: Class, m: Member) -> None:
    source = script.source(m.at)
    link = next((d for d in m.decorators if d.tail in TYPEORM_LINKS and d.kind == "call"), None)
    if link is not None:
        _typeorm_link(script, out, raw, c, m, link)
        return
    d = next((d for d in m.decorators if d.tail in COLUMN_DECORATORS), None)
    if d is None:
        return
    args = d.items if d.kind == "call" else []
    options = _options(args)
    hinted, null = _bare_type(m.type)
    column = Column(_text(options, "name") or m.name, nullable=bool(_flag(options, "nullable")), source=source, comment=_text(options, "comment") or script.comment(m.at))
    column.type = (args[0].string if args else None) or _text(options, "type") or ("" if not hinted else re.sub(r"\[\]$", "", hinted))
    size = options.get("length") if options else None
    if size is not None and column.type:
        column.type += f"({size.value})"
    elif options and options.get("precision") is not None:
        scale = options.get("scale")
        column.type += f"({options.get('precision').value}{',' + scale.value if scale is not None else ''})"
    column.primary_key = d.tail.startswith("Primary") or d.tail == "ObjectIdColumn" or bool(_flag(options, "primary"))
    column.unique = bool(_flag(options, "unique"))
    column.is_array = True if _flag(options, "array") else None
    if d.tail in ("PrimaryGeneratedColumn", "CreateDateColumn", "UpdateDateColumn", "VersionColumn", "Generated") or m.decorator("Generated"):
        column.generated = True
    if d.tail == "PrimaryGeneratedColumn":
        first = args[0].string if args else None
        column.type = "uuid" if first == "uuid" else _text(options, "type") or "integer"
    if d.tail == "DeleteDateColumn":
        column.nullable = True
    if column.primary_key:
        column.nullable = False
    default = options.get("default") if options else None
    if default is not None:
        column.default = (script.of(default.of) if default.kind == "fn" and default.of is not None else default.string if default.kind == "str" else script.of(default))
        if default.kind == "fn" and default.of is not None and default.of.string:
            column.default = default.of.string
    values = options.get("enum") if options else None
    if values is not None:
        listed = strings(values)
        if listed:
            column.enum_ref = f"{raw.name}_{column.name}_enum"
            out.enums.append(RawEnum(column.enum_ref, listed, source=source))
        elif values.kind == "name":
            column.enum_ref = values.value
    raw.columns.append(column)
    if index := m.decorator("Index"):
        unique = index.kind == "call" and bool(_flag(_options(index.items), "unique"))
        raw.indexes.append(Index([column.name], unique))


def _typeorm_link(script: Script, out: Parsed, raw: RawEntity, c: Class, m: Member, link: Node) -> None:
    source = script.source(m.at)
    target = arrow_target(link.items[0]) if link.items else None
    if not target or link.tail == "OneToMany":
        return
    options = next((a for a in link.items[1:] if a.kind == "obj"), None)
    join, table = m.decorator("JoinColumn"), m.decorator("JoinTable")
    if link.tail == "ManyToMany":
        if table is not None:
            inner = _options(table.items) if table.kind == "call" else None
            name = _text(inner, "name") or snake(f"{raw.name}_{m.name}_{target}")
            out.relations.append(RawRelation(Ref(model=c.name), Ref(model=target), cardinality="many-to-many", kind="orm", through=Ref(name), source=source))
        return
    if link.tail == "OneToOne" and join is None:
        return
    inner = _options(join.items) if join is not None and join.kind == "call" else None
    column = _text(inner, "name") or f"{m.name}Id"
    to = _text(inner, "referencedColumnName")
    nullable = _flag(options, "nullable")
    optional = nullable if nullable is not None else True
    primary = bool(_flag(options, "primary")) or m.decorator("PrimaryColumn") is not None
    if not any(x.name == column for x in raw.columns):
        raw.columns.append(Column(column, nullable=optional and not primary, primary_key=primary, unique=link.tail == "OneToOne", source=source))
    out.relations.append(
        RawRelation(Ref(model=c.name), Ref(model=target), [column], [to] if to else [], TYPEORM_LINKS[link.tail], "orm", on_delete=_text(options, "onDelete"), on_update=_text(options, "onUpdate"), optional=optional, source=source)
    )


# MikroORM

MIKRO_COLUMNS = {"PrimaryKey", "SerializedPrimaryKey", "Property", "Enum", "Formula"}
MIKRO_LINKS = {"ManyToOne": "many-to-one", "OneToOne": "one-to-one", "OneToMany": "one-to-many", "ManyToMany": "many-to-many"}


def mikroorm_detect(path: str, text: str) -> bool:
    return _is_js(path) and bool(re.search(r"['\"]@mikro-orm/\w+", text)) and bool(re.search(r"@(?:Entity|PrimaryKey|Property|ManyToOne|Embeddable)\b|\bEntitySchema\b|\bdefineEntity\b", text))


def mikroorm(path: str, text: str) -> Parsed:
    script, out = Script(path, text), Parsed(path, "mikroorm")
    classes = list(script.classes())
    parts = {c.name: c for c in classes if c.decorator("Embeddable")}
    for c in classes:
        entity = c.decorator("Entity")
        mapped = [m for m in c.members if any(d.tail in MIKRO_COLUMNS | set(MIKRO_LINKS) | {"Embedded"} for d in m.decorators)]
        if not c.name or c.name in parts or (entity is None and not mapped):
            continue
        options = _options(entity.items) if entity is not None and entity.kind == "call" else None
        name = _text(options, "tableName") or _text(options, "collection")
        raw = RawEntity(name or snake(c.name), "table", schema=_text(options, "schema"), model_name=c.name, name_certainty=2 if name else 0, comment=_text(options, "comment") or script.comment(c.at), source=script.source(c.at))
        raw.abstract = entity is None or bool(_flag(options, "abstract"))
        raw.shared_table = options is not None and options.get("discriminatorValue") is not None
        raw.extends = [c.base.tail] if c.base is not None and c.base.tail else []
        for m in mapped:
            _mikro_member(script, out, raw, c, m, parts, "")
        for d in c.decorators:
            if d.tail in ("Index", "Unique") and d.kind == "call":
                inner = _options(d.items)
                given = inner.get("properties") if inner else None
                names = [next((x.name for x in raw.columns if x.name == snake(n)), snake(n)) for n in strings(given)]
                if names:
                    raw.indexes.append(Index(names, d.tail == "Unique", _text(inner, "name")))
        out.entities.append(raw)
    for node in script.chains():
        if node.new and node.path == "EntitySchema" and node.items and node.items[0].kind == "obj":
            _mikro_schema(script, out, node)
    return out


def _mikro_column(script: Script, out: Parsed, raw: RawEntity, prop: str, options: Node | None, hinted: str, source) -> Column:
    """A column from its options and the type of its property."""
    plain, null = _bare_type(hinted)
    column = Column(_text(options, "fieldName") or _text(options, "name") or snake(prop), nullable=bool(_flag(options, "nullable")) or null, source=source, comment=_text(options, "comment"))
    type_ = options.get("type") if options else None
    column.type = _text(options, "columnType") or (type_.string or type_.tail if type_ is not None else "") or re.sub(r"^Opt<(.*)>$|^(.*)\s*&\s*Opt$", lambda m: m[1] or m[2], plain)
    if (size := options.get("length") if options else None) is not None and column.type:
        column.type += f"({size.value})"
    column.unique = bool(_flag(options, "unique"))
    column.primary_key = bool(_flag(options, "primary"))
    column.generated = True if _flag(options, "autoincrement") else None
    default = (options.get("defaultRaw") or options.get("default")) if options else None
    if default is not None:
        column.default = default.string if default.string is not None else script.of(default)
    items = options.get("items") if options else None
    if items is not None and (listed := strings(items)):
        column.enum_ref = f"{raw.name}_{column.name}"
        out.enums.append(RawEnum(column.enum_ref, listed, source=source))
    elif items is not None and arrow_target(items):
        column.enum_ref = arrow_target(items)
    return column


def _mikro_member(script: Script, out: Parsed, raw: RawEntity, c: Class, m: Member, parts: dict[str, Class], prefix: str) -> None:
    source = script.source(m.at)
    d = next(d for d in m.decorators if d.tail in MIKRO_COLUMNS | set(MIKRO_LINKS) | {"Embedded"})
    args = d.items if d.kind == "call" else []
    options = _options(args)
    if d.tail in MIKRO_LINKS:
        _mikro_link(script, out, raw, c.name, m.name, d.tail, (arrow_target(args[0]) if args and args[0].kind != "obj" else None) or arrow_target(options.get("entity") if options else None) or _bare_type(m.type)[0], options, source, m.decorator("PrimaryKey") is not None)
        return
    if d.tail == "Embedded":
        part = parts.get((arrow_target(args[0]) if args and args[0].kind != "obj" else None) or _bare_type(m.type)[0])
        said = options.get("prefix") if options else None
        begin = "" if said is not None and said.false else said.string if said is not None and said.string else f"{snake(m.name)}_"
        for inner in part.members if part is not None and not prefix else []:
            if inner.decorator("Property", "Enum"):
                _mikro_member(script, out, raw, c, inner, parts, prefix + begin)
        return
    if d.tail == "Formula" or (_flag(options, "persist") is False):
        return
    column = _mikro_column(script, out, raw, m.name, options, m.type or "", source)
    if d.tail == "Enum" and column.enum_ref is None and args and args[0].kind == "fn":
        column.enum_ref = arrow_target(args[0])
    column.name = prefix + column.name
    column.nullable = column.nullable or (m.optional and _flag(options, "nullable") is not False and d.tail != "PrimaryKey")
    column.comment = column.comment or script.comment(m.at)
    if d.tail in ("PrimaryKey", "SerializedPrimaryKey"):
        column.primary_key, column.nullable = True, False
        if column.type in ("number", "int", "integer", "bigint") and _flag(options, "autoincrement") is not False:
            column.generated = True
    column.unique = column.unique or m.decorator("Unique") is not None
    if index := m.decorator("Index"):
        raw.indexes.append(Index([column.name], False, _text(_options(index.items) if index.kind == "call" else None, "name")))
    raw.columns.append(column)


def _mikro_link(script: Script, out: Parsed, raw: RawEntity, model: str, prop: str, kind: str, target: str | None, options: Node | None, source, primary: bool = False) -> None:
    inner = re.search(r"<(\w+)", target or "")
    target = inner[1] if inner else target
    if not target or kind == "OneToMany" or _text(options, "mappedBy") or (options is not None and options.get("mappedBy") is not None):
        return
    own, other = Ref(model=model), Ref(model=target)
    rules = {"on_delete": _text(options, "deleteRule") or _text(options, "onDelete"), "on_update": _text(options, "updateRule") or _text(options, "onUpdateIntegrity")}
    if kind == "ManyToMany":
        through = _text(options, "pivotTable") or f"{raw.name}_{snake(prop)}"
        out.relations.append(RawRelation(own, other, cardinality="many-to-many", kind="orm", through=Ref(through), source=source))
        return
    if kind == "OneToOne" and options is not None and _flag(options, "owner") is False:
        return
    names = strings(options.get("joinColumns")) if options and options.get("joinColumns") is not None else []
    names = names or [_text(options, "joinColumn") or _text(options, "fieldName") or f"{snake(prop)}_id"]
    primary = primary or bool(_flag(options, "primary"))
    said = _flag(options, "nullable")
    nullable = (said if said is not None else kind != "OneToOne") and not primary
    to = [x for x in [_text(options, "referenceColumnName") or _text(options, "referencedColumnName")] if x]
    for name in names:
        raw.columns.append(Column(name, "", nullable, primary, kind == "OneToOne", source=source))
    out.relations.append(RawRelation(own, other, names, to, MIKRO_LINKS[kind], "orm", optional=nullable, source=source, **rules))


def _mikro_schema(script: Script, out: Parsed, node: Node) -> None:
    options, here = node.items[0], script.source(node.begin)
    class_ = options.get("class")
    model = _text(options, "name") or (class_.tail if class_ is not None else None)
    name = _text(options, "tableName") or _text(options, "collection")
    properties = options.get("properties")
    if not (model or name) or properties is None or properties.kind != "obj":
        return
    raw = RawEntity(name or snake(model), "table", model_name=model, name_certainty=2 if name else 0, abstract=bool(_flag(options, "abstract")), source=here)
    parent = options.get("extends")
    raw.extends = [parent.string or parent.tail] if parent is not None and (parent.string or parent.tail) else []
    kinds = {"m:1": "ManyToOne", "1:1": "OneToOne", "1:m": "OneToMany", "m:n": "ManyToMany", "MANY_TO_ONE": "ManyToOne", "ONE_TO_ONE": "OneToOne", "ONE_TO_MANY": "OneToMany", "MANY_TO_MANY": "ManyToMany"}
    for prop, value in properties.items:
        if value.kind != "obj":
            continue
        source = script.source(value.begin)
        said = value.get("kind") or value.get("reference")
        kind = kinds.get((said.string or said.tail) if said is not None else "")
        if kind:
            entity = value.get("entity") or value.get("type")
            _mikro_link(script, out, raw, model or raw.name, prop, kind, arrow_target(entity), value, source)
            continue
        column = _mikro_column(script, out, raw, prop, value, "", source)
        if column.primary_key:
            column.nullable = False
            column.generated = True if column.type in ("number", "int", "integer", "bigint") else column.generated
        raw.columns.append(column)
    out.entities.append(raw)


# Mongoose

BSON = {"String", "Number", "Date", "Boolean", "Buffer", "ObjectId", "Mixed", "Map", "Decimal128", "UUID", "BigInt", "Array", "Object"}


def mongoose_detect(path: str, text: str) -> bool:
    return _is_js(path) and "mongoose" in text and bool(re.search(r"new\s+(?:[\w.]+\.)?Schema\b|@Schema\b|@Prop\b|from\s+['\"]@nestjs/mongoose['\"]", text))


def _bson(node: Node | None) -> str:
    name = node.tail if node is not None else ""
    return {"ObjectID": "ObjectId", "Oid": "ObjectId", "string": "String", "number": "Number", "boolean": "Boolean", "Types": "Mixed"}.get(name, name) or (node.value if node is not None and node.kind == "str" else "")


def mongoose(path: str, text: str) -> Parsed:
    script, out = Script(path, text), Parsed(path, "mongoose")
    schemas: dict[str, tuple[Node, list[Node]]] = {}
    models: list[tuple[str, str | None, str | None, Node]] = []
    anonymous = []
    for node in script.chains():
        if node.new and node.tail == "Schema":
            name = script.assigned(node.begin)
            schemas[name or f"#{node.begin}"] = (node, node.items)
        elif node.tail == "model" and node.path in ("mongoose.model", "model", "db.model", "connection.model", "conn.model") and node.items and node.items[0].string:
            schema = node.items[1] if len(node.items) > 1 else None
            key = schema.path if schema is not None and schema.kind == "name" else f"#{schema.begin}" if schema is not None else None
            models.append((node.items[0].value, key, node.items[2].string if len(node.items) > 2 else None, node))
        elif node.tail == "discriminator" and len(node.items) > 1 and node.items[0].string:
            anonymous.append(node)
    for inner in list(script.chains()):
        for arg in inner.items:
            if arg.kind == "call" and arg.new and arg.tail == "Schema":
                schemas.setdefault(f"#{arg.begin}", (arg, arg.items))
    used = set()
    for model, key, collection, node in models:
        used.add(key)
        _mongoose_schema(script, out, model, schemas.get(key, (node, []))[1], collection, schemas.get(key, (node, []))[0].begin)
    nested = {x.value for _, args in schemas.values() for a in args[:1] for x in _names(a)}
    for name, (node, args) in schemas.items():
        if name not in used and name not in nested and not name.startswith("#") and (model := re.sub(r"(?i)_?schema$", "", name)):
            _mongoose_schema(script, out, model[:1].upper() + model[1:], args, None, node.begin)
    for node in anonymous:
        base = node.path.rpartition(".")[0]
        inner = node.items[1]
        args = schemas.get(inner.path, (inner, inner.items))[1] if inner.kind in ("name", "call") else []
        _mongoose_schema(script, out, node.items[0].value, args, None, node.begin, base)
    for c in script.classes():
        d = c.decorator("Schema")
        if d is not None and c.name:
            _mongoose_class(script, out, c, _options(d.items) if d.kind == "call" else None)
    if out.entities:
        out.engines.append(Hint("mongodb", out.entities[0].source.line, "Mongoose schema"))
    return out


def _names(node: Node):
    for item in node.items:
        value = item[1] if isinstance(item, tuple) else item
        if isinstance(value, Node):
            if value.kind == "name":
                yield value
            yield from _names(value)


def _mongoose_entity(script: Script, model: str, options: Node | None, collection: str | None, at: int) -> RawEntity:
    name = collection or _text(options, "collection")
    return RawEntity(name or default_table("mongoose", model), "collection", model_name=model, name_certainty=2 if name else 0, engine="mongodb", source=script.source(at))


def _mongoose_done(raw: RawEntity, options: Node | None) -> None:
    if _flag(options, "_id") is not False and not any(c.name == "_id" for c in raw.columns):
        raw.columns.insert(0, Column("_id", "ObjectId", False, True, generated=True))
    stamps = options.get("timestamps") if options else None
    if stamps is not None and not stamps.false:
        for key in ("createdAt", "updatedAt"):
            own = stamps.get(key)
            if own is None or not own.false:
                raw.columns.append(Column((own.string if own is not None else None) or key, "Date", False, generated=True))


def _mongoose_schema(script: Script, out: Parsed, model: str, args: list[Node], collection: str | None, at: int, base: str | None = None) -> None:
    options = args[1] if len(args) > 1 and args[1].kind == "obj" else None
    raw = _mongoose_entity(script, model, options, collection, at)
    if base:
        raw.shared_table, raw.extends = True, [base.rpartition(".")[2]]
    for key, value in args[0].items if args and args[0].kind == "obj" else []:
        if key != "..." and value.kind != "fn":
            _mongoose_field(script, out, raw, key, value)
    if not base:
        _mongoose_done(raw, options)
    raw.partial = not args
    out.entities.append(raw)


def _mongoose_field(script: Script, out: Parsed, raw: RawEntity, name: str, value: Node, type_: str = "") -> None:
    source = script.source(value.begin)
    many = value.kind == "arr"
    inner = value.items[0] if many and value.items else value
    options = inner if inner.kind == "obj" and (inner.get("type") is not None and not (inner.get("type").kind == "obj" and inner.get("type").get("type") is not None) or inner.get("ref") is not None) else None
    column = Column(name, source=source)
    if options is not None:
        kind = options.get("type")
        if kind is not None and kind.kind == "arr":
            many = True
            kind = kind.items[0] if kind.items else None
            if kind is not None and kind.kind == "obj":
                options_ref = kind.get("ref")
                column.type = _bson(kind.get("type")) if kind.get("type") is not None else "Object"
                options.items += [("ref", options_ref)] if options_ref is not None else []
                kind = None
        if kind is not None:
            column.type = "Object" if kind.kind == "obj" else _bson(kind)
        required = options.get("required")
        column.nullable = not (required is not None and (required.true or (required.kind == "arr" and required.items and required.items[0].true)))
        column.unique = _flag(options, "unique") is True
        default = options.get("default")
        if default is not None and default.kind != "fn":
            column.default = default.string if default.kind == "str" else script.of(default)
        values = options.get("enum")
        listed = strings(values if values is None or values.kind != "obj" else values.get("values"))
        if listed:
            column.enum_ref = f"{raw.name}_{name}"
            out.enums.append(RawEnum(column.enum_ref, listed, source=source))
        target = arrow_target(options.get("ref"))
        if target and target != "refPath":
            cardinality = "many-to-many" if many else "many-to-one"
            out.relations.append(RawRelation(Ref(model=raw.model_name), Ref(model=target), [name], ["_id"], cardinality, "orm", optional=column.nullable, source=source))
    else:
        column.type = "Object" if inner.kind == "obj" else type_ if inner.kind == "raw" else (_bson(inner) if not many or value.items else "Array")
        if column.type and column.type not in BSON:
            column.type = "Object" if inner.kind == "name" and inner.value[:1].islower() else column.type
    column.type = column.type or type_
    column.is_array = True if many else None
    raw.columns.append(column)


def _mongoose_class(script: Script, out: Parsed, c: Class, options: Node | None) -> None:
    raw = _mongoose_entity(script, c.name, options, None, c.at)
    for m in c.members:
        d = m.decorator("Prop")
        if d is None:
            continue
        hinted, null = _bare_type(m.type)
        many = hinted.endswith("[]")
        bare = {"string": "String", "number": "Number", "boolean": "Boolean"}.get(re.sub(r"\[\]$", "", hinted), re.sub(r"\[\]$", "", hinted))
        if d.kind == "call" and d.items:
            value = d.items[0]
            before = len(raw.columns)
            if value.kind == "obj" and value.get("type") is None:
                value.items.append(("type", Node("name", value.begin, value.begin + 1, bare if bare in BSON else "Object" if not value.get("ref") else "ObjectId")))
            _mongoose_field(script, out, raw, m.name, value, bare)
            if many and len(raw.columns) > before:
                raw.columns[-1].is_array = True
        else:
            raw.columns.append(Column(m.name, bare if bare in BSON else "Object", True, is_array=True if many else None))
        raw.columns[-1].source = script.source(m.at)
    _mongoose_done(raw, options)
    out.entities.append(raw)


# Sequelize

ASSOCIATIONS = {"belongsTo": "many-to-one", "hasMany": "one-to-many", "hasOne": "one-to-one", "belongsToMany": "many-to-many"}


def sequelize_detect(path: str, text: str) -> bool:
    return _is_js(path) and bool(re.search(r"sequelize|queryInterface", text, re.I)) and bool(re.search(r"\.define\s*\(|\.init\s*\(|queryInterface\s*\.|@Table\b|\.(?:belongsTo|hasMany|hasOne|belongsToMany)\s*\(", text))


def _seq_type(script: Script, node: Node | None) -> tuple[str, list[str], bool]:
    """Type text, enum values, array."""
    if node is None:
        return "", [], False
    if node.kind == "call" and node.tail == "ENUM":
        return "ENUM", [v for a in node.items for v in strings(a)], False
    if node.kind == "call" and node.tail == "ARRAY":
        inner = _seq_type(script, node.items[0]) if node.items else ("", [], False)
        return inner[0], inner[1], True
    if node.kind == "call":
        args = ",".join(script.of(a) for a in node.items)
        return f"{node.tail}({args})" if args else node.tail, [], False
    return node.string or node.tail, [], False


def _seq_column(script: Script, out: Parsed, table: str, owner: Ref, name: str, value: Node, underscored: bool) -> Column:
    source = script.source(value.begin)
    options = value if value.kind == "obj" else None
    column = Column(_text(options, "field") or (snake(name) if underscored else name), source=source)
    column.type, values, array = _seq_type(script, options.get("type") if options else value)
    column.is_array = True if array else None
    if options:
        column.primary_key = _flag(options, "primaryKey") is True
        column.nullable = _flag(options, "allowNull") is not False and not column.primary_key
        unique = options.get("unique")
        column.unique = unique is not None and not unique.false
        column.generated = True if _flag(options, "autoIncrement") else None
        default = options.get("defaultValue")
        if default is not None:
            column.default = default.string if default.kind == "str" else script.of(default)
        column.comment = _text(options, "comment")
        values = values or strings(options.get("values"))
        references = options.get("references")
        if references is not None:
            model = references.get("model") if references.kind == "obj" else references
            inner = model.get("tableName") if model is not None and model.kind == "obj" else None
            target = Ref(inner.string, schema=_text(model, "schema")) if inner is not None else Ref(model.string) if model is not None and model.string else Ref(model=model.tail) if model is not None else None
            if target is not None:
                key = _text(references, "key") if references.kind == "obj" else None
                out.relations.append(RawRelation(owner, target, [column.name], [key] if key else [], on_delete=_text(options, "onDelete"), on_update=_text(options, "onUpdate"), optional=column.nullable, source=source))
    if values:
        column.enum_ref = f"{table}_{column.name}"
        out.enums.append(RawEnum(column.enum_ref, values, source=source))
    return column


def _seq_model(script: Script, out: Parsed, model: str, attributes: Node | None, options: Node | None, at: int, columns: list[Column] | None = None) -> None:
    table, frozen, underscored = _text(options, "tableName"), _flag(options, "freezeTableName"), _flag(options, "underscored") is True
    name = table or (model if frozen else pluralize(snake(model) if underscored else model))
    raw = RawEntity(name, "table", schema=_text(options, "schema"), model_name=model, name_certainty=2 if table else 1 if frozen else 0, comment=_text(options, "comment"), source=script.source(at))
    raw.columns = list(columns or [])
    for key, value in attributes.items if attributes is not None and attributes.kind == "obj" else []:
        if key != "...":
            raw.columns.append(_seq_column(script, out, name, Ref(model=model), key, value, underscored))
    if not any(c.primary_key for c in raw.columns) and not any(c.name == "id" for c in raw.columns):
        raw.columns.insert(0, Column("id", "INTEGER", False, True, generated=True))
    style = snake if underscored else (lambda x: x)
    if _flag(options, "timestamps") is not False:
        stamps = [(k, k, False) for k in ("createdAt", "updatedAt")] + ([("deletedAt", "deletedAt", True)] if _flag(options, "paranoid") else [])
        for key, default, nullable in stamps:
            own = options.get(key) if options else None
            column = (own.string if own is not None else None) or style(default)
            if not (own is not None and own.false) and not any(c.name == column for c in raw.columns):
                raw.columns.append(Column(column, "DATE", nullable, generated=True))
    for index in options.get("indexes").items if options and options.get("indexes") is not None else []:
        fields = index.get("fields") if isinstance(index, Node) else None
        names = [f.string or _text(f, "name") or "" for f in fields.items] if fields is not None else []
        if names:
            raw.indexes.append(Index([n for n in names if n], _flag(index, "unique") is True, _text(index, "name")))
    out.entities.append(raw)


def sequelize(path: str, text: str) -> Parsed:
    script, out = Script(path, text), Parsed(path, "sequelize")
    if re.search(r"\bqueryInterface\b", text) and re.search(r"\bup\b", text):
        return _seq_migration(script, Parsed(path, "sequelize", "migration"))
    bodies = []
    for c in script.classes():
        bodies.append((c.body, c.name))
        if c.decorator("Table") is not None:
            _seq_class(script, out, c)
    for node in script.chains():
        tail, args = node.tail, node.items
        if tail == "define" and args and args[0].string and len(args) > 1 and args[1].kind == "obj":
            _seq_model(script, out, args[0].value, args[1], args[2] if len(args) > 2 and args[2].kind == "obj" else None, node.begin)
        elif tail == "init" and args and args[0].kind == "obj" and node.of.kind == "member" and node.of.of.kind == "name":
            options = args[1] if len(args) > 1 and args[1].kind == "obj" else None
            owner = next((n for (a, b), n in bodies if a <= node.begin < b), None) if node.of.of.value in ("this", "super") else node.of.of.value
            model = _text(options, "modelName") or owner
            if model and (options is not None and any(k in ("sequelize", "modelName", "tableName", "...") for k, _ in options.items)):
                _seq_model(script, out, model, args[0], options, node.begin)
        elif tail in ASSOCIATIONS and node.of.kind == "member" and args and (target := arrow_target(args[0])):
            owner = next((n for (a, b), n in bodies if a <= node.begin < b), None) if node.of.of.path == "this" else node.of.of.tail
            if owner:
                _seq_link(script, out, tail, owner, target, args[1] if len(args) > 1 else None, node.begin)
    return out


def _seq_link(script: Script, out: Parsed, kind: str, owner: str, target: str, options: Node | None, at: int) -> None:
    key = options.get("foreignKey") if options is not None else None
    column = (key.string if key is not None and key.kind == "str" else _text(key, "name") or _text(key, "field")) if key is not None else None
    actions = {"on_delete": _text(options, "onDelete"), "on_update": _text(options, "onUpdate")}
    source = script.source(at)
    if kind == "belongsToMany":
        through = options.get("through") if options is not None else None
        name = through.string if through is not None else None
        link = Ref(name) if name else Ref(model=through.tail) if through is not None and through.tail else None
        out.relations.append(RawRelation(Ref(model=owner), Ref(model=target), cardinality="many-to-many", kind="orm", through=link, source=source))
    elif kind == "belongsTo":
        out.relations.append(RawRelation(Ref(model=owner), Ref(model=target), [column or f"{lcfirst_plain(_text(options, 'as') or target)}Id"], kind="orm", source=source, **actions))
    elif kind == "hasOne":
        out.relations.append(RawRelation(Ref(model=target), Ref(model=owner), [column or f"{lcfirst_plain(owner)}Id"], cardinality="one-to-one", kind="orm", source=source, **actions))
    else:
        out.relations.append(RawRelation(Ref(model=owner), Ref(model=target), [], [column or f"{lcfirst_plain(owner)}Id"], "one-to-many", "orm", source=source, **actions))


def _seq_class(script: Script, out: Parsed, c: Class) -> None:
    d = c.decorator("Table")
    options = _options(d.items) if d.kind == "call" else None
    underscored, columns = _flag(options, "underscored") is True, []
    for m in c.members:
        source = script.source(m.at)
        link = next((x for x in m.decorators if x.tail in ("BelongsTo", "HasMany", "HasOne", "BelongsToMany") and x.kind == "call"), None)
        if link is not None:
            target = arrow_target(link.items[0]) if link.items else None
            keys = [a for a in link.items[1:] if a.kind in ("str", "obj")]
            if target and link.tail == "BelongsToMany":
                through = arrow_target(link.items[1]) if len(link.items) > 1 else None
                ref = None if not through else Ref(through) if link.items[1].kind == "str" else Ref(model=through)
                out.relations.append(RawRelation(Ref(model=c.name), Ref(model=target), cardinality="many-to-many", kind="orm", through=ref, source=source))
            elif target and link.tail == "BelongsTo":
                own = next((x for x in c.members if (f := x.decorator("ForeignKey")) is not None and f.kind == "call" and f.items and arrow_target(f.items[0]) == target), None)
                column = (keys[0].string or _text(keys[0], "foreignKey")) if keys else own.name if own else f"{m.name}Id"
                out.relations.append(RawRelation(Ref(model=c.name), Ref(model=target), [column], kind="orm", source=source))
            continue
        d = m.decorator("Column")
        if d is None:
            continue
        value = d.items[0] if d.kind == "call" and d.items else None
        hinted = {"string": "STRING", "number": "INTEGER", "boolean": "BOOLEAN", "Date": "DATE"}.get(_bare_type(m.type)[0], _bare_type(m.type)[0])
        if value is not None:
            column = _seq_column(script, out, c.name, Ref(model=c.name), m.name, value, underscored)
            column.type = column.type or hinted
        else:
            column = Column(snake(m.name) if underscored else m.name, hinted, source=source)
        if m.decorator("PrimaryKey"):
            column.primary_key, column.nullable = True, False
        if m.decorator("AutoIncrement"):
            column.generated = True
        if m.decorator("Unique"):
            column.unique = True
        allow = m.decorator("AllowNull")
        if allow is not None and allow.kind == "call":
            column.nullable = not (allow.items and allow.items[0].false) and not column.primary_key
        default = m.decorator("Default")
        if default is not None and default.kind == "call" and default.items:
            column.default = script.of(default.items[0])
        foreign = m.decorator("ForeignKey")
        if foreign is not None and foreign.kind == "call" and foreign.items and (target := arrow_target(foreign.items[0])):
            out.relations.append(RawRelation(Ref(model=c.name), Ref(model=target), [column.name], kind="orm", optional=column.nullable, source=source))
        columns.append(column)
    _seq_model(script, out, c.name, None, options, c.at, columns)


def _up_range(script: Script) -> tuple[int, int]:
    """The body of ``up``; without one, the part before ``down``."""
    for i, t in enumerate(script.tokens):
        if t.kind == "name" and t.text == "up":
            for j in range(i + 1, min(i + 40, len(script.tokens))):
                if script.is_(j, "=>") and not script.is_(j + 1, "{"):
                    end = next((k for k in range(j, len(script.tokens)) if script.is_(k, "down")), len(script.tokens))
                    return j + 1, end
                if script.is_(j, "{") and not script.is_(j - 1, "(", ","):
                    return j + 1, script._close[j]
    down = next((i for i in range(len(script.tokens)) if script.is_(i, "down")), len(script.tokens))
    return 0, down


def _seq_table(node: Node | None) -> Ref | None:
    if node is None:
        return None
    if node.kind == "obj":
        name = _text(node, "tableName")
        return Ref(name, schema=_text(node, "schema")) if name else None
    return Ref(node.string) if node.string else None


def _seq_migration(script: Script, out: Parsed) -> Parsed:
    begin, end = _up_range(script)
    for node in script.chains(begin, end):
        args, source = node.items, script.source(node.begin)
        ref = _seq_table(args[0]) if args else None
        if ref is None:
            continue
        name = args[1].string if len(args) > 1 else None
        options = args[1] if len(args) > 1 and args[1].kind == "obj" else None
        same = lambda: Ref(ref.name, schema=ref.schema)  # noqa: B023, E731
        if node.tail == "createTable" and options is not None:
            columns = [_seq_column(script, out, ref.name, same(), k, v, False) for k, v in options.items if k != "..."]
            out.entities.append(RawEntity(ref.name, "table", columns, ref.schema, source=source))
        elif node.tail == "addColumn" and name and len(args) > 2:
            out.entities.append(RawEntity(ref.name, "table", [_seq_column(script, out, ref.name, same(), name, args[2], False)], ref.schema, partial=True, source=source))
        elif node.tail == "removeColumn" and name:
            out.ops.append(Op("dropColumn", ref, name, source=source))
        elif node.tail == "renameColumn" and name and len(args) > 2 and args[2].string:
            out.ops.append(Op("renameColumn", ref, name, args[2].value, source=source))
        elif node.tail == "changeColumn" and name and len(args) > 2:
            column = _seq_column(script, out, ref.name, same(), name, args[2], False)
            patch = {"type": column.type or None, "default": column.default, "unique": column.unique or None, "primary_key": column.primary_key or None, "comment": column.comment}
            if args[2].kind == "obj" and args[2].get("allowNull") is not None:
                patch["nullable"] = column.nullable
            out.ops.append(Op("alterColumn", ref, name, set={k: v for k, v in patch.items() if v is not None}, source=source))
        elif node.tail == "dropTable":
            out.ops.append(Op("dropTable", ref, source=source))
        elif node.tail == "renameTable" and len(args) > 1 and (to := _seq_table(args[1])):
            out.ops.append(Op("renameTable", ref, to=to.name, source=source))
        elif node.tail == "addIndex":
            inner = args[1].get("fields") if options is not None else args[1] if len(args) > 1 else None
            if names := strings(inner):
                more = options or (args[2] if len(args) > 2 else None)
                out.entities.append(RawEntity(ref.name, "table", schema=ref.schema, partial=True, indexes=[Index(names, _flag(more, "unique") is True or _text(more, "type") == "UNIQUE", _text(more, "name"))], source=source))
        elif node.tail == "addConstraint" and (options is not None or len(args) > 2):
            more = options if options is not None else args[2]
            fields, kind = strings(more.get("fields") if options is not None else args[1]), (_text(more, "type") or "").lower()
            references = more.get("references")
            if "foreign" in kind and references is not None and fields and (to := _seq_table(references.get("table")) or Ref(_text(references, "table"))):
                key = _text(references, "field")
                out.relations.append(RawRelation(same(), to, fields, [key] if key else strings(references.get("fields")), name=_text(more, "name"), on_delete=_text(more, "onDelete"), on_update=_text(more, "onUpdate"), source=source))
            elif "unique" in kind and fields:
                out.entities.append(RawEntity(ref.name, "table", schema=ref.schema, partial=True, indexes=[Index(fields, True, _text(more, "name"))], source=source))
            elif "primary" in kind:
                out.ops += [Op("alterColumn", same(), f, set={"primary_key": True}, source=source) for f in fields]
        elif node.tail == "removeConstraint" and name:
            out.ops.append(Op("dropForeignKey", ref, name=name, source=source))
    return out


# Drizzle

DIALECTS = {"pgTable": "postgresql", "mysqlTable": "mysql", "sqliteTable": "sqlite", "singlestoreTable": "mysql"}


def drizzle_detect(path: str, text: str) -> bool:
    return _is_js(path) and "drizzle-orm" in text and bool(re.search(r"\b(?:pg|mysql|sqlite|singlestore)(?:Table|View|Schema|Enum)(?:Creator)?\s*(?:\(|as\b)|\brelations\s*(?:\(|as\b)", text))


def drizzle(path: str, text: str) -> Parsed:
    script, out = Script(path, text), Parsed(path, "drizzle")
    schemas, enums, creators, tables = {}, {}, {}, {}
    calls = [(n, script.assigned(n.begin)) for n in script.chains()]
    alias = script.renamed("drizzle-orm")
    called = lambda n: alias.get(n.path, n.path)
    for node, name in calls:
        first = node.items[0] if node.items else None
        if called(node) in ("pgSchema", "mysqlSchema") and name and first is not None and first.string:
            schemas[name] = (first.value, "postgresql" if called(node) == "pgSchema" else "mysql")
        elif called(node).rpartition(".")[2] in ("pgEnum", "enum") and name and first is not None and first.string and len(node.items) > 1 and (values := strings(node.items[1])):
            schema = schemas.get(node.path.rpartition(".")[0], (None,))[0]
            enums[name] = first.value
            out.enums.append(RawEnum(first.value, values, schema, source=script.source(node.begin)))
        elif called(node).endswith("TableCreator") and name and first is not None:
            prefix = first.of.value if first.kind == "fn" and first.of is not None else ""
            creators[name] = (DIALECTS.get(called(node).replace("Creator", "")), re.sub(r"\$\{.*", "", prefix))
    found = []
    for node, name in calls:
        if not name or not node.items or not node.items[0].string or len(node.items) < 2:
            continue
        schema, engine, table = None, None, node.items[0].value
        if called(node) in DIALECTS:
            engine = DIALECTS[called(node)]
        elif node.tail == "table" and node.path.rpartition(".")[0] in schemas:
            schema, engine = schemas[node.path.rpartition(".")[0]]
        elif node.path in creators:
            engine, prefix = creators[node.path]
            table = prefix + table
        else:
            continue
        body = node.items[1].of if node.items[1].kind == "fn" else node.items[1]
        raw = RawEntity(table, "table", schema=schema, model_name=name, engine=engine, source=script.source(node.begin))
        fields = {}
        for key, value in _spread(script, body):
            column = _drizzle_column(script, out, raw, key, value, enums)
            if column:
                raw.columns.append(column)
                fields[key] = column.name
        tables[name] = (raw, fields)
        found.append((raw, fields, node))
        out.entities.append(raw)
        if engine and not out.engines:
            out.engines.append(Hint(engine, raw.source.line, f"Drizzle {called(node)}"))
    names = {variable: (raw, fields) for variable, (raw, fields) in tables.items()}
    for r in out.relations:  # columns of targets are known by their keys until now
        if r.to.model in names and r.to_columns:
            r.to_columns = [names[r.to.model][1].get(c, c) for c in r.to_columns]
    for raw, fields, node in found:
        if len(node.items) > 2:
            _drizzle_extras(script, out, raw, fields, node.items[2], names)
    for node, name in calls:
        if called(node) == "relations" and len(node.items) > 1 and node.items[0].kind == "name" and node.items[1].kind == "fn" and node.items[1].of is not None:
            _drizzle_relations(script, out, node.items[0].value, node.items[1].of, names)
    return out


def _spread(script: Script, body: Node | None, depth: int = 0) -> Iterator[tuple[str, Node]]:
    """Properties of an object, those of constants that are spread into it in their place."""
    for key, value in body.items if body is not None and body.kind == "obj" else []:
        if key != "...":
            yield key, value
        elif value.kind == "name" and depth < 8:
            yield from _spread(script, script.object_named(value.value), depth + 1)


def _drizzle_column(script: Script, out: Parsed, raw: RawEntity, key: str, value: Node, enums: dict) -> Column | None:
    steps = value.chain() if value.kind == "call" else []
    if not steps:
        return None
    begin = next((i for i, s in enumerate(steps) if s[1] is not None), None)
    if begin is None:
        return None
    kind, args, _ = steps[begin]
    name = args[0].value if args and args[0].kind == "str" else key
    options = _options(args)
    column = Column(name, kind, source=script.source(value.begin))
    if kind in enums:
        column.enum_ref = column.type = enums[kind]
    if options is not None:
        size = options.get("length")
        precision, scale = options.get("precision"), options.get("scale")
        if size is not None:
            column.type += f"({size.value})"
        elif precision is not None:
            column.type += f"({precision.value}{',' + scale.value if scale is not None else ''})"
    if kind in ("serial", "bigserial", "smallserial"):
        column.generated, column.nullable = True, False
    if kind in ("mysqlEnum",) and len(args) > 1 and (values := strings(args[1])):
        column.enum_ref = f"{raw.name}_{name}"
        out.enums.append(RawEnum(column.enum_ref, values, source=column.source))
    for step, args, node in steps[begin + 1 :]:
        first = args[0] if args else None
        if step == "notNull":
            column.nullable = False
        elif step == "primaryKey":
            column.primary_key, column.nullable = True, False
            if first is not None and _flag(first, "autoIncrement"):
                column.generated = True
        elif step == "unique":
            column.unique = True
        elif step == "array":
            column.is_array = True
        elif step in ("autoincrement", "generatedAlwaysAsIdentity", "generatedByDefaultAsIdentity", "generatedAlwaysAs"):
            column.generated = True
        elif step == "defaultNow":
            column.default = "now()"
        elif step == "defaultRandom":
            column.default, column.generated = "gen_random_uuid()", True
        elif step == "default" and first is not None:
            column.default = f"'{first.value}'" if first.kind == "str" and not script.of(first).startswith("`") else script.of(first)
        elif step == "references" and first is not None and first.kind == "fn" and first.of is not None:
            target, _, to = first.of.path.rpartition(".")
            more = _options(args[1:])
            out.relations.append(RawRelation(Ref(raw.name, raw.model_name, raw.schema), Ref(model=target or to), [name], [to] if target else [], on_delete=_text(more, "onDelete"), on_update=_text(more, "onUpdate"), source=column.source))
    return column


def _drizzle_used(node: Node | None, fields: dict) -> list[str]:
    items = node.items if node is not None and node.kind == "arr" else [node] if node is not None else []
    return [fields.get(x.tail, x.tail) for x in items if x.kind in ("member", "call") and x.tail]


def _drizzle_extras(script: Script, out: Parsed, raw: RawEntity, fields: dict, extras: Node, tables: dict) -> None:
    body = extras.of if extras.kind == "fn" and extras.of is not None else extras
    items = [v for _, v in body.items] if body.kind == "obj" else body.items if body.kind == "arr" else []
    if extras.kind == "fn" and extras.of is None:
        items = list(script.chains(*extras.items[1]))
    for item in items:
        steps = item.chain() if isinstance(item, Node) and item.kind == "call" else []
        if not steps or steps[0][1] is None:
            continue
        kind, args, _ = steps[0]
        options = _options(args)
        on = next((a for s, a, _ in steps[1:] if s == "on" and a), [])
        if kind in ("index", "uniqueIndex", "unique"):
            names = [n for x in on for n in _drizzle_used(x, fields)]
            if names:
                raw.indexes.append(Index(names, kind != "index", args[0].string if args else None))
        elif kind == "primaryKey":
            names = _drizzle_used(options.get("columns"), fields) if options is not None else [n for x in args for n in _drizzle_used(x, fields)]
            for c in raw.columns:
                if c.name in names:
                    c.primary_key, c.nullable = True, False
        elif kind == "foreignKey" and options is not None:
            others = options.get("foreignColumns")
            target = others.items[0].path.rpartition(".")[0] if others is not None and others.items else None
            if target:
                known = tables.get(target, (None, {}))[1]
                actions = {s: a[0].string for s, a, _ in steps[1:] if s in ("onDelete", "onUpdate") and a}
                out.relations.append(RawRelation(Ref(raw.name, raw.model_name, raw.schema), Ref(model=target), _drizzle_used(options.get("columns"), fields), _drizzle_used(others, known), name=_text(options, "name"), on_delete=actions.get("onDelete"), on_update=actions.get("onUpdate"), source=script.source(item.begin)))


def _drizzle_relations(script: Script, out: Parsed, model: str, body: Node, tables: dict) -> None:
    for _, value in body.items if body.kind == "obj" else []:
        if value.kind != "call" or value.tail != "one" or not value.items:
            continue
        options = _options(value.items)
        if options is None or options.get("fields") is None:
            continue
        target = value.items[0].tail
        own, others = tables.get(model, (None, {}))[1], tables.get(target, (None, {}))[1]
        out.relations.append(RawRelation(Ref(model=model), Ref(model=target), _drizzle_used(options.get("fields"), own), _drizzle_used(options.get("references"), others), kind="orm", source=script.source(value.begin)))


# Knex and Kysely migrations

KNEX_TYPES = {
    "increments": "integer", "bigIncrements": "bigint", "integer": "integer", "int": "integer", "tinyint": "tinyint", "smallint": "smallint", "mediumint": "mediumint", "bigint": "bigint",
    "bigInteger": "bigint", "text": "text", "string": "varchar", "float": "float", "double": "double", "decimal": "decimal", "boolean": "boolean", "date": "date", "datetime": "datetime",
    "dateTime": "datetime", "time": "time", "timestamp": "timestamp", "binary": "binary", "json": "json", "jsonb": "jsonb", "uuid": "uuid", "geometry": "geometry", "geography": "geography", "point": "point",
    "enu": "enum", "enum": "enum", "specificType": "", "specific": "",
}


def knex_detect(path: str, text: str) -> bool:
    if not _is_js(path):
        return False
    if re.search(r"\bknex\b", text, re.I) and re.search(r"\.schema\b|\bcreateTable\b|\balterTable\b", text) and not re.search(r"from\s+['\"]kysely['\"]", text):
        return bool(re.search(r"\.\s*(?:createTable|alterTable|table|dropTable|renameTable|createTableIfNotExists|dropTableIfExists)\s*\(", text))
    return bool(re.search(r"['\"]objection['\"]", text) and re.search(r"\btableName\b", text))


def knex(path: str, text: str) -> Parsed:
    script = Script(path, text)
    if re.search(r"['\"]objection['\"]", text) and not re.search(r"\bcreateTable\b", text):
        return _objection(script, Parsed(path, "knex"))
    out = Parsed(path, "knex", "migration")
    begin, end = _up_range(script)
    done = set()
    for node in script.chains(begin, end):
        steps = node.chain()
        schema = next((a[0].string for s, a, _ in steps if s == "withSchema" and a), None)
        for step, args, part in steps:
            if part.end in done or args is None or not args:
                continue
            name, source = args[0].string, script.source(part.end - 1)
            source = script.source(args[0].begin)
            if step in ("createTable", "createTableIfNotExists", "alterTable", "table") and name and len(args) > 1 and args[1].kind == "fn":
                done.add(part.end)
                _knex_table(script, out, Ref(name, schema=schema), args[1], step.startswith("create"), source)
            elif step in ("dropTable", "dropTableIfExists") and name:
                done.add(part.end)
                out.ops.append(Op("dropTable", Ref(name, schema=schema), source=source))
            elif step == "renameTable" and name and len(args) > 1 and args[1].string:
                done.add(part.end)
                out.ops.append(Op("renameTable", Ref(name, schema=schema), to=args[1].value, source=source))
    return out


def _knex_table(script: Script, out: Parsed, table: Ref, builder: Node, create: bool, source) -> None:
    columns, indexes = [], []
    params, body = builder.items
    variable = script.tokens[params[0]].text if params[0] < params[1] else ""
    ref = lambda: Ref(table.name, schema=table.schema)
    for node in script.chains(*body):
        steps = node.chain()
        if not steps or steps[0][0] != variable or len(steps) < 2 or steps[1][1] is None:
            continue
        kind, args, part = steps[1]
        rest = steps[2:]
        here = script.source(part.begin)
        first = args[0].string if args else None
        if kind == "timestamps":
            columns += [Column(n, "timestamp", not (len(args) > 1 and args[1].true), source=here) for n in ("created_at", "updated_at")]
        elif kind in ("dropColumn", "dropColumns"):
            out.ops += [Op("dropColumn", ref(), n, source=here) for a in args for n in strings(a)]
        elif kind == "dropTimestamps":
            out.ops += [Op("dropColumn", ref(), n, source=here) for n in ("created_at", "updated_at")]
        elif kind == "renameColumn" and first and len(args) > 1 and args[1].string:
            out.ops.append(Op("renameColumn", ref(), first, args[1].value, source=here))
        elif kind in ("setNullable", "dropNullable") and first:
            out.ops.append(Op("alterColumn", ref(), first, set={"nullable": kind == "setNullable"}, source=here))
        elif kind == "primary":
            for n in strings(args[0]) if args else []:
                known = next((c for c in columns if c.name == n), None)
                if known:
                    known.primary_key, known.nullable = True, False
                else:
                    out.ops.append(Op("alterColumn", ref(), n, set={"primary_key": True}, source=here))
        elif kind in ("unique", "index"):
            if names := strings(args[0]) if args else []:
                label = args[1].string if len(args) > 1 else None
                indexes.append(Index(names, kind == "unique", label))
                known = next((c for c in columns if [c.name] == names), None)
                if kind == "unique" and known:
                    known.unique = True
        elif kind == "foreign":
            names = strings(args[0]) if args else []
            _knex_foreign(out, ref(), names, rest, here, args[1].string if len(args) > 1 else None)
        elif kind == "dropForeign":
            names = strings(args[0]) if args else []
            out.ops.append(Op("dropForeignKey", ref(), columns=names, name=args[1].string if len(args) > 1 else None, source=here))
        elif kind in KNEX_TYPES and (first or kind in ("increments", "bigIncrements")):
            column = Column(first or "id", KNEX_TYPES[kind] or (args[1].string if len(args) > 1 else "") or "", source=here)
            if kind == "string":
                column.type = f"varchar({args[1].value if len(args) > 1 and args[1].kind == 'num' else 255})"
            elif kind == "decimal" and len(args) > 2:
                column.type = f"decimal({args[1].value},{args[2].value})"
            elif kind in ("enu", "enum") and len(args) > 1 and (values := strings(args[1])):
                column.enum_ref = f"{table.name}_{column.name}"
                out.enums.append(RawEnum(column.enum_ref, values, source=here))
            if kind in ("increments", "bigIncrements"):
                column.generated = column.primary_key = True
                column.nullable = False
            named = {s: a for s, a, _ in rest if a is not None}
            if "notNullable" in named or "notNull" in named:
                column.nullable = False
            if "primary" in named:
                column.primary_key, column.nullable = True, False
            if "unique" in named:
                column.unique = True
            if named.get("defaultTo"):
                value = named["defaultTo"][0]
                column.default = f"'{value.value}'" if value.kind == "str" else script.of(value)
            if named.get("comment"):
                column.comment = named["comment"][0].string
            if "references" in named:
                _knex_foreign(out, ref(), [column.name], rest, here, None, column.nullable)
            if "alter" in named:
                patch = {"type": column.type or None, "default": column.default, "unique": column.unique or None}
                if "notNullable" in named or "notNull" in named or "nullable" in named:
                    patch["nullable"] = column.nullable
                out.ops.append(Op("alterColumn", ref(), column.name, set={k: v for k, v in patch.items() if v is not None}, source=here))
            else:
                columns.append(column)
    if create or columns or indexes:
        out.entities.append(RawEntity(table.name, "table", columns, table.schema, partial=not create, indexes=indexes, source=source))


def _knex_foreign(out: Parsed, table: Ref, names: list[str], rest: list, source, label: str | None, optional: bool | None = None) -> None:
    named = {s: a for s, a, _ in rest if a}
    to = strings(named["references"][0]) if "references" in named else []
    target = named["inTable"][0].string if "inTable" in named else None
    if target is None and len(to) == 1 and "." in to[0]:
        target, _, to[0] = to[0].rpartition(".")
    if target and names:
        schema, _, name = target.rpartition(".")
        act = lambda k: named[k][0].string if k in named else None
        out.relations.append(RawRelation(table, Ref(name, schema=schema or None), names, to, name=label or act("withKeyName"), on_delete=act("onDelete"), on_update=act("onUpdate"), optional=optional, source=source))


def _objection(script: Script, out: Parsed) -> Parsed:
    def returned(m: Member) -> Node | None:
        if m.value is not None:
            return m.value
        for i in range(*(m.body or (0, 0))):
            if script.is_(i, "return"):
                return script.postfix(i + 1)
        return None

    for c in script.classes():
        parts = {m.name: returned(m) for m in c.members if m.name in ("tableName", "relationMappings", "idColumn")}
        table = parts.get("tableName")
        if table is None or not table.string:
            continue
        out.entities.append(RawEntity(table.value, model_name=c.name, source=script.source(c.at)))
        mappings = parts.get("relationMappings")
        for _, m in mappings.items if mappings is not None and mappings.kind == "obj" else []:
            kind, join = (m.get("relation"), m.get("join")) if m.kind == "obj" else (None, None)
            target = arrow_target(m.get("modelClass")) if m.kind == "obj" else None
            if kind is None or join is None or not target:
                continue
            (a, own), (b, other) = ([(x := (_text(join, k) or "").rpartition("."))[0], x[2]] for k in ("from", "to"))
            source, model = script.source(m.begin), Ref(model=c.name)
            target_ref = Ref(b or None, target.rpartition("/")[2])
            if kind.tail == "BelongsToOneRelation":
                out.relations.append(RawRelation(model, target_ref, [own], [other], kind="orm", source=source))
            elif kind.tail in ("HasManyRelation", "HasOneRelation"):
                out.relations.append(RawRelation(target_ref, model, [other], [own], "one-to-one" if kind.tail == "HasOneRelation" else "many-to-one", "orm", source=source))
            elif kind.tail == "ManyToManyRelation" and join.get("through") is not None:
                through = (_text(join.get("through"), "from") or "").rpartition(".")[0]
                out.relations.append(RawRelation(model, target_ref, cardinality="many-to-many", kind="orm", through=Ref(through) if through else None, source=source))
    return out


def kysely_detect(path: str, text: str) -> bool:
    """Migrations that build a schema, and interfaces of a database whose columns may be generated."""
    if not _is_js(path):
        return False
    imported = bool(re.search(r"['\"]kysely['\"]", text))
    built = ".schema" in text and bool(re.search(r"\.\s*(?:createTable|alterTable|dropTable|createIndex|createType)\s*\(", text))
    typed = "interface" in text and bool(re.search(r"\bGenerated\w*\s*<|\bKysely\s*<", text))
    return imported and (built or typed)


def kysely(path: str, text: str) -> Parsed:
    script = Script(path, text)
    if not re.search(r"\.\s*(?:createTable|alterTable|dropTable|createIndex|createType)\s*\(", text):
        return _kysely_types(script, Parsed(path, "kysely"))
    out = Parsed(path, "kysely", "migration")
    for node in script.chains(*_up_range(script)):
        steps = node.chain()
        at = next((i for i, s in enumerate(steps) if s[0] in ("createTable", "alterTable", "dropTable", "createIndex", "createType", "createView") and s[1]), None)
        if at is None or not any(s[0] == "schema" for s in steps[:at]):
            continue
        schema = next((a[0].string for s, a, _ in steps[:at] if s == "withSchema" and a), None)
        _kysely_chain(script, out, steps[at][0], steps[at][1], steps[at + 1 :], schema, script.source(steps[at][1][0].begin))
    return out


def _kysely_types(script: Script, out: Parsed) -> Parsed:
    """Tables of the database's interface: each property names a table, its type the interface of its rows."""
    rows = dict(script.interfaces())
    used = re.search(r"\bKysely\s*<\s*([\w$]+)\s*>", script.text)
    database = rows.get(used[1]) if used else None
    database = database or next((at for name, at in rows.items() if name.lower() in ("database", "db")), None)
    for table in script.members(*database) if database else []:
        row = rows.get(re.sub(r"<.*|\[\]$", "", table.type).strip())
        if row is None:
            continue
        path, _, name = table.name.rpartition(".")
        columns = [_kysely_field(script, m) for m in script.members(*row)]
        out.entities.append(RawEntity(name, "table", columns, path.rpartition(".")[2] or None, model_name=re.sub(r"<.*", "", table.type).strip(), source=script.source(table.at)))
    return out


def _kysely_field(script: Script, m) -> Column:
    """A column of a row's interface; what a select gives counts, and a generated one needs no value."""
    type_ = m.type.strip()
    generated = re.match(r"Generated\w*\s*<(.*)>$", type_, re.S)
    type_ = generated[1].strip() if generated else type_
    if selected := re.match(r"ColumnType\s*<(.*)>$", type_, re.S):
        type_ = re.split(r",(?![^<]*>)", selected[1])[0].strip()
    options = [x.strip() for x in type_.split("|")]
    kept = [x for x in options if x not in ("null", "undefined")]
    return Column(m.name, kept[0] if len(kept) == 1 else "", nullable=m.optional or len(kept) < len(options), generated=True if generated else None, source=script.source(m.at))


def _kysely_chain(script: Script, out: Parsed, act: str, args: list[Node], rest: list, schema: str | None, source) -> None:
    name = args[0].string
    if not name:
        return
    own, _, name = name.rpartition(".")
    schema = own or schema
    ref = lambda: Ref(name, schema=schema)
    if act == "dropTable":
        out.ops.append(Op("dropTable", ref(), source=source))
        return
    if act == "createType":
        values = next((strings(a[0]) for s, a, _ in rest if s == "asEnum" and a), [])
        out.enums.append(RawEnum(name, values, schema, source=source))
        return
    if act == "createIndex":
        named = {s: a for s, a, _ in rest if a is not None}
        table = named["on"][0].string if named.get("on") else None
        columns = [c for s, a, _ in rest if s in ("column", "columns") and a for c in strings(a[0])]
        if table and columns:
            out.entities.append(RawEntity(table, "table", schema=schema, partial=True, indexes=[Index([re.sub(r"\s+(?:asc|desc)$", "", c) for c in columns], "unique" in named, name)], source=source))
        return
    columns, indexes = [], []
    for step, args, node in rest:
        if args is None or not args:
            continue
        here, first = script.source(args[0].begin), args[0].string
        if step == "addColumn" and first and len(args) > 1:
            type_ = args[1].string or re.sub(r"^sql`|`$", "", script.of(args[1]))
            column = Column(first, type_, source=here)
            if "serial" in type_:
                column.generated, column.nullable = True, False
            steps = args[2].of.chain()[1:] if len(args) > 2 and args[2].kind == "fn" and args[2].of is not None else []
            _kysely_modifiers(script, out, ref(), column, steps)
            columns.append(column)
        elif step in ("addPrimaryKeyConstraint", "addUniqueConstraint") and len(args) > 1:
            names = strings(args[1])
            if step == "addUniqueConstraint":
                indexes.append(Index(names, True, first))
            for n in names if step == "addPrimaryKeyConstraint" else []:
                known = next((c for c in columns if c.name == n), None)
                if known:
                    known.primary_key, known.nullable = True, False
                else:
                    out.ops.append(Op("alterColumn", ref(), n, set={"primary_key": True}, source=here))
        elif step == "addForeignKeyConstraint" and len(args) > 3 and args[2].string:
            more = {s: a[0].string for s, a, _ in (args[4].of.chain() if len(args) > 4 and args[4].kind == "fn" and args[4].of is not None else []) if a}
            out.relations.append(RawRelation(ref(), Ref(args[2].value), strings(args[1]), strings(args[3]), name=first, on_delete=more.get("onDelete"), on_update=more.get("onUpdate"), source=here))
        elif step == "dropColumn" and first:
            out.ops.append(Op("dropColumn", ref(), first, source=here))
        elif step == "renameColumn" and first and len(args) > 1 and args[1].string:
            out.ops.append(Op("renameColumn", ref(), first, args[1].value, source=here))
        elif step == "renameTo" and first:
            out.ops.append(Op("renameTable", ref(), to=first, source=here))
        elif step == "dropConstraint" and first:
            out.ops.append(Op("dropForeignKey", ref(), name=first, source=here))
        elif step == "alterColumn" and first and len(args) > 1 and args[1].kind == "fn" and args[1].of is not None:
            patch = {}
            for s, a, _ in args[1].of.chain()[1:]:
                if s in ("setNotNull", "dropNotNull"):
                    patch["nullable"] = s == "dropNotNull"
                elif s == "setDataType" and a:
                    patch["type"] = a[0].string or script.of(a[0])
                elif s == "setDefault" and a:
                    patch["default"] = f"'{a[0].value}'" if a[0].kind == "str" else script.of(a[0])
            if patch:
                out.ops.append(Op("alterColumn", ref(), first, set=patch, source=here))
    if act == "createTable" or columns or indexes:
        out.entities.append(RawEntity(name, "table", columns, schema, partial=act != "createTable", indexes=indexes, source=source))


def _kysely_modifiers(script: Script, out: Parsed, table: Ref, column: Column, steps: list) -> None:
    relation = None
    for step, args, _ in steps:
        first = args[0] if args else None
        if step == "primaryKey":
            column.primary_key, column.nullable = True, False
        elif step == "notNull":
            column.nullable = False
        elif step == "unique":
            column.unique = True
        elif step in ("autoIncrement", "generatedAlwaysAsIdentity", "generatedByDefaultAsIdentity", "generatedAlwaysAs", "identity"):
            column.generated = True
        elif step == "defaultTo" and first is not None:
            column.default = f"'{first.value}'" if first.kind == "str" else re.sub(r"^sql`|`$", "", script.of(first))
        elif step == "references" and first is not None and first.string:
            target, _, to = first.value.rpartition(".")
            schema, _, name = target.rpartition(".")
            relation = RawRelation(table, Ref(name, schema=schema or None), [column.name], [to], source=column.source)
            out.relations.append(relation)
        elif step in ("onDelete", "onUpdate") and relation is not None and first is not None:
            setattr(relation, "on_delete" if step == "onDelete" else "on_update", first.string)
    if relation is not None:
        relation.optional = column.nullable


# MongoDB validators

MOST_DEPTH = 4


def mongovalidator_detect(path: str, text: str) -> bool:
    return path.lower().endswith((".js", ".mjs", ".cjs", ".ts")) and "$jsonSchema" in text and "createCollection" in text


def mongovalidator(path: str, text: str) -> Parsed:
    script, out = Script(path, text), Parsed(path, "mongovalidator")
    for node in script.chains():
        if node.tail != "createCollection" or not node.items or not node.items[0].string:
            continue
        options = _options(node.items[1:])
        validator = options.get("validator") if options is not None else None
        schema = validator.get("$jsonSchema") if validator is not None else None
        if schema is None or schema.kind != "obj":
            continue
        raw = RawEntity(node.items[0].value, "collection", engine="mongodb", source=script.source(node.begin), comment=_text(schema, "description"))
        _validator_fields(script, schema, "", raw, out, 1)
        if not any(c.name == "_id" for c in raw.columns):
            raw.columns.insert(0, Column("_id", "objectId", False, True, generated=True))
        out.entities.append(raw)
    if out.entities:
        out.engines.append(Hint("mongodb", out.entities[0].source.line, "createCollection validator"))
    return out


def _validator_fields(script: Script, schema: Node, prefix: str, raw: RawEntity, out: Parsed, depth: int) -> None:
    required = strings(schema.get("required"))
    properties = schema.get("properties")
    for key, value in properties.items if properties is not None and properties.kind == "obj" else []:
        if value.kind != "obj":
            continue
        kinds = strings(value.get("bsonType")) or strings(value.get("type"))
        name, types = prefix + key, [k for k in kinds if k != "null"]
        column = Column(name, types[0] if types else "", key not in required or "null" in kinds, name == "_id", source=script.source(value.begin), comment=_text(value, "description"))
        if column.type == "array":
            items = value.get("items")
            inner = strings(items.get("bsonType")) if items is not None and items.kind == "obj" else []
            column.type, column.is_array = (inner[0] if inner else "array"), True
        if column.primary_key:
            column.nullable = False
        if values := strings(value.get("enum")):
            column.enum_ref = f"{raw.name}_{name.replace('.', '_')}"
            out.enums.append(RawEnum(column.enum_ref, values, source=column.source))
        raw.columns.append(column)
        if value.get("properties") is not None and depth < MOST_DEPTH:
            _validator_fields(script, value, f"{name}.", raw, out, depth + 1)


READERS = {
    name: SimpleNamespace(detect=detect, parse=parse)
    for name, detect, parse in (
        ("typeorm", typeorm_detect, typeorm), ("mikroorm", mikroorm_detect, mikroorm), ("drizzle", drizzle_detect, drizzle), ("sequelize", sequelize_detect, sequelize), ("mongoose", mongoose_detect, mongoose),
        ("knex", knex_detect, knex), ("kysely", kysely_detect, kysely), ("mongovalidator", mongovalidator_detect, mongovalidator),
    )
}
