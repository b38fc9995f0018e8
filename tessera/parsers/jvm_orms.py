"""JPA entities in Java and Kotlin, and Exposed tables."""

from __future__ import annotations

import re
from types import SimpleNamespace

from tessera.functions.names import default_table, lcfirst_plain, snake
from tessera.model import Column, Index, Parsed, RawEntity, RawEnum, RawRelation, Ref
from tessera.parsers.curly import Curly, Decl, Field, Mark, node_text

# Java types that are never null.
PRIMITIVES = {"int", "long", "short", "byte", "boolean", "char", "float", "double"}
LINKS = ("ManyToOne", "OneToOne", "OneToMany", "ManyToMany")
COLLECTIONS = {"List", "Set", "Collection", "Map", "MutableList", "MutableSet", "MutableCollection", "SortedSet", "Iterable", "MutableMap", "ArrayList", "HashSet"}


def _unquoted(text: str | None) -> str | None:
    return text.strip('"`[]\\') if text else None


def jpa_detect(path: str, text: str) -> bool:
    if not path.endswith((".java", ".kt")):
        return False
    return bool(re.search(r"@(?:jakarta\.persistence\.|javax\.persistence\.)?(?:Entity|MappedSuperclass|Embeddable)\b", text) or (re.search(r"springframework\.data\.(?:relational|r2dbc|jdbc)", text) and "@Table" in text))


def jpa(path: str, text: str) -> Parsed:
    script, out = Curly(path, text, "kt" if path.endswith(".kt") else "java"), Parsed(path, "jpa")
    decls = list(script.declarations())
    enums = {d.name for d in decls if d.kind == "enum"}
    parts = {d.name: d for d in decls if d.mark("Embeddable")}
    #: Parents whose children have tables of their own; all others share theirs, as is the default.
    joined = {d.name for d in decls if (m := d.mark("Inheritance")) and script.word_of(m, "strategy") in ("JOINED", "TABLE_PER_CLASS")}
    reader = _Jpa(script, out, enums, parts)
    spring_data = "springframework.data" in text
    for d in decls:
        entity, base, table = d.mark("Entity"), d.mark("MappedSuperclass"), d.mark("Table")
        if d.kind == "enum":
            if values := script.enum_values(d):
                out.enums.append(RawEnum(d.name, values, source=script.source(d.at)))
            continue
        spring = table is not None and spring_data
        if entity is None and base is None and not spring:
            continue
        named, given = _unquoted(script.text_of(table, "name", "value", place=0)), script.text_of(entity, "name", place=0)
        schema = _unquoted(script.text_of(table, "schema"))
        name, certainty = (named, 2) if named else (snake(given), 1) if given else (default_table("jpa", d.name), 0)
        e = RawEntity(name, "table", schema=schema, model_name=d.name, name_certainty=certainty, abstract=entity is None and not spring, comment=script.comment(d.marks[0].at if d.marks else d.at), source=script.source(d.at))
        parent = next((b for b, _, opening in d.bases if script.language == "java" or opening is not None), None)
        if parent:
            e.extends = [parent]
            apart = parent in joined or d.mark("PrimaryKeyJoinColumn") is not None
            e.shared_table = base is None and not apart and (named is None or d.mark("DiscriminatorValue") is not None)
        reader.columns(d, e)
        for m in script.marks_in(table.named.get("indexes")) if table else []:
            listed = [re.sub(r"\s+(?:asc|desc)$", "", c.strip(), flags=re.I) for c in (script.text_of(m, "columnList") or "").split(",") if c.strip()]
            if listed:
                e.indexes.append(Index(listed, reader.says(m, "unique", "true"), script.text_of(m, "name")))
        for m in script.marks_in(table.named.get("uniqueConstraints")) if table else []:
            if listed := script.texts(m.named.get("columnNames")):
                e.indexes.append(Index(listed, True, script.text_of(m, "name")))
        out.entities.append(e)
    return out


class _Jpa:
    def __init__(self, script: Curly, out: Parsed, enums: set[str], parts: dict[str, Decl]):
        self.script, self.out, self.enums, self.parts = script, out, enums, parts

    def says(self, mark: Mark | None, key: str, word: str) -> bool:
        return self.script.word_of(mark, key) == word

    def columns(self, d: Decl, e: RawEntity, prefix: str = "", key: bool = False, open_: frozenset = frozenset()) -> None:
        fields = self.script.fields(d)
        getters = {}
        for f in fields:
            m = re.fullmatch(r"(?:get|is)([A-Z]\w*)", f.name) if f.method else None
            if m and f.marks:
                getters[lcfirst_plain(m[1])] = f
        seen = set()
        for f in fields:
            if f.method or f.name in seen:
                continue
            seen.add(f.name)
            if f.name in getters:
                f.marks = f.marks + getters[f.name].marks
            if f.mark("Transient") or f.modifiers & {"static", "transient"}:
                continue
            self.field(d, f, e, key, open_)
        for name, f in getters.items():
            if name not in seen and f.mark("Column", "Id", "JoinColumn", *LINKS) and not f.mark("Transient"):
                self.field(d, Field(name, f.type, f.marks, f.modifiers, f.at), e, key, open_)

    def field(self, d: Decl, f: Field, e: RawEntity, key: bool, open_: frozenset) -> None:
        script, here = self.script, self.script.source(f.at)
        link = f.mark(*LINKS)
        if link is not None:
            self.link(d, f, link, e)
            return
        if f.mark("ElementCollection") or (f.bare in COLLECTIONS and not f.mark("Column", "Convert", "JdbcTypeCode", "Type")):
            return
        part = self.parts.get(f.bare)
        if part is not None and part.name not in open_:
            before = len(e.columns)
            self.columns(part, e, key=key or f.mark("EmbeddedId") is not None, open_=open_ | {part.name})
            renames = {}
            for m in f.marks:
                for o in [m] if m.name == "AttributeOverride" else self.script.marks_in((m.plain or [next(iter(m.named.values()), (0, 0))])[0]) if m.name == "AttributeOverrides" else []:
                    inner = next((script.text_of(c, "name") for c in script.marks_in(o.named.get("column"))), None)
                    if (said := script.text_of(o, "name")) and inner:
                        renames[snake(said)] = inner
            for c in e.columns[before:]:
                c.name = renames.get(c.name, c.name)
            return
        if f.mark("Embedded", "EmbeddedId") and part is None:
            return
        m = f.mark("Column")
        primary = key or f.mark("Id") is not None
        strict = self.says(m, "nullable", "false") or f.mark("NotNull", "NotBlank", "NotEmpty", "NonNull", "Nonnull") is not None
        bare = f.type in PRIMITIVES or (script.language == "kt" and bool(f.type) and not f.type.endswith("?"))
        said = self.says(m, "nullable", "true")
        column = Column(_unquoted(script.text_of(m, "name", "value", place=0)) or snake(f.name), script.text_of(m, "columnDefinition") or f.type.rstrip("?"), not (primary or strict or (bare and not said)), primary, source=here)
        column.unique = self.says(m, "unique", "true")
        column.generated = True if f.mark("GeneratedValue", "CreationTimestamp", "UpdateTimestamp", "Version") and not f.mark("Version") else None
        column.comment = script.text_of(f.mark("Comment"), "value", place=0)
        if (default := f.mark("ColumnDefault")) is not None:
            column.default = script.text_of(default, "value", place=0)
        if f.mark("Enumerated") or f.bare in self.enums:
            column.enum_ref = f.bare
        e.columns.append(column)

    def joins(self, f: Field) -> list[Mark]:
        out = [m for m in f.marks if m.name == "JoinColumn"]
        for m in f.marks:
            if m.name == "JoinColumns":
                out += [x for span in [*m.plain, *m.named.values()] for x in self.script.marks_in(span) if x.name == "JoinColumn"]
        return out

    def link(self, d: Decl, f: Field, link: Mark, e: RawEntity) -> None:
        script, here = self.script, self.script.source(f.at)
        target = script.word_of(link, "targetEntity")
        target = (None if target in (None, "class") else target) or f.inner or f.bare
        if not target or script.text_of(link, "mappedBy"):
            return
        own, other, joins = Ref(model=d.name), Ref(model=target), self.joins(f)
        if link.name == "ManyToMany":
            table = f.mark("JoinTable")
            name = _unquoted(script.text_of(table, "name")) or f"{e.name}_{default_table('jpa', target)}"
            self.out.relations.append(RawRelation(own, other, cardinality="many-to-many", kind="orm", through=Ref(name, schema=script.text_of(table, "schema")), navigation=f.name, source=here))
        elif link.name == "OneToMany":
            names = [n for j in joins if (n := script.text_of(j, "name", place=0))]
            if names:
                self.out.relations.append(RawRelation(own, other, [], names, "one-to-many", "orm", navigation=f.name, source=here))
        else:
            shared = f.mark("MapsId", "PrimaryKeyJoinColumn") is not None
            primary = f.mark("Id") is not None or shared
            required = primary or self.says(link, "optional", "false") or any(self.says(j, "nullable", "false") for j in joins) or (script.language == "kt" and bool(f.type) and not f.type.endswith("?"))
            names = [_unquoted(script.text_of(j, "name", place=0)) or f"{snake(f.name)}_id" for j in joins] or [f"{snake(f.name)}_id"]
            for name, j in zip(names, joins or [None]):
                if not any(c.name == name for c in e.columns):
                    e.columns.append(Column(name, "", not required, primary, link.name == "OneToOne" or self.says(j, "unique", "true"), source=here))
            to = [_unquoted(t) for j in joins if (t := script.text_of(j, "referencedColumnName"))]
            rule = {"CASCADE": "CASCADE", "SET_NULL": "SET NULL"}.get(next((self.script.tokens[k].text for m in f.marks if m.name == "OnDelete" for s in [*m.named.values(), *m.plain] for k in range(s[1] - 1, s[0] - 1, -1) if self.script.tokens[k].kind == "name"), ""))
            self.out.relations.append(RawRelation(own, other, names, to, "one-to-one" if link.name == "OneToOne" else "many-to-one", "orm", on_delete=rule, optional=not required, navigation=f.name, source=here))


# Exposed

ID_TABLES = {"IntIdTable": "integer", "LongIdTable": "long", "UUIDTable": "uuid", "UIntIdTable": "uinteger", "ULongIdTable": "ulong"}
REFERENCES = ("reference", "optReference")


def exposed_detect(path: str, text: str) -> bool:
    return path.endswith(".kt") and bool(re.search(r"\b(?:object|class)\s+\w+(?:\([^)]*\))?\s*:\s*(?:\w+\.)*(?:Int|Long|UUID|UInt|ULong|Composite)?(?:Id)?Table\b", text)) and "@Entity" not in text


def exposed(path: str, text: str) -> Parsed:
    script, out = Curly(path, text, "kt"), Parsed(path, "exposed")
    for d in script.declarations():
        if d.kind == "enum":
            if values := script.enum_values(d):
                out.enums.append(RawEnum(d.name, values, source=script.source(d.at)))
            continue
        base = next((b for b in d.bases if b[0] in ID_TABLES or b[0] in ("Table", "IdTable", "CompositeIdTable") or b[0].endswith("Table")), None)
        if base is None:
            continue
        plain, named = script.arguments(base[2]) if base[2] is not None else ([], {})
        given = (script.texts(named.get("name")) or (script.texts(plain[0]) if plain else []) or [None])[0]
        schema, _, name = (given or "").rpartition(".")
        e = RawEntity(name or d.name.removesuffix("Table") or d.name, "table", schema=schema or None, model_name=d.name, name_certainty=2 if given else 0, abstract="abstract" in d.modifiers or ("open" in d.modifiers and d.kind == "class"), comment=script.comment(d.at), source=script.source(d.at))
        if base[0] in ID_TABLES:
            label = (script.texts(named.get("columnName")) or (script.texts(plain[1]) if len(plain) > 1 else []) or ["id"])[0]
            e.columns.append(Column(label, ID_TABLES[base[0]], False, True, generated=True, source=e.source))
        elif base[0] not in ("Table", "IdTable", "CompositeIdTable"):
            e.extends = [base[0]]
        _exposed_table(script, d, e, out)
        out.entities.append(e)
    return out


def _exposed_table(script: Curly, d: Decl, e: RawEntity, out: Parsed) -> None:
    members = script.members_of(*d.body) if d.body else []
    of: dict[str, Column] = {"id": e.columns[0]} if e.columns else {}
    for f in members:
        if f.method or f.value is None or f.name == "primaryKey":
            continue
        steps = script.postfix(f.value[0], f.value[1]).chain()
        if not steps or steps[0][1] is None:
            continue
        column = _exposed_column(script, d, f, steps, e, out)
        if column is not None:
            of[f.name] = column
            e.columns.append(column)

    def listed(nodes: list) -> list[str]:
        return [of[n.tail].name for n in nodes if n.tail in of]

    for f in members:
        if f.name == "primaryKey" and f.value:
            steps = script.postfix(*f.value).chain()
            for n in (steps[0][1] or []) if steps else []:
                if n.tail in of:
                    of[n.tail].primary_key, of[n.tail].nullable = True, False
        if f.name == "init" and f.body:
            for node in script.chains(*f.body):
                steps = node.chain()
                kind, args, _ = steps[0]
                if kind in ("index", "uniqueIndex") and args is not None:
                    columns = listed(args)
                    unique = kind == "uniqueIndex" or any(a.true for a in args)
                    label = next((a.string for a in args if a.string), None)
                    if columns:
                        e.indexes.append(Index(columns, unique, label))


def _exposed_column(script: Curly, d: Decl, f: Field, steps: list, e: RawEntity, out: Parsed) -> Column | None:
    kind, args, part = steps[0]
    here = script.source(f.at)
    first = args[0].string if args else None
    opening = next((k for k in range(part.begin, part.end) if script.is_(k, "(")), None)
    plain, named = script.arguments(opening) if opening is not None else ([], {})
    first = first or (script.texts(named.get("name")) or [None])[0]
    if first is None:
        return None
    numbers = [a.value for a in args[1:] if a.kind == "num"] + [script.between(*named[k]) for k in ("length", "precision", "scale") if k in named]
    column = Column(first, kind, False, source=here, comment=script.comment(f.at))
    target = None
    if kind in ("varchar", "char", "binary") and numbers:
        column.type = f"{kind}({numbers[0]})"
    elif kind == "decimal" and numbers:
        column.type = f"decimal({', '.join(numbers[:2])})"
    elif kind in ("enumeration", "enumerationByName"):
        generic = script.between(part.begin + 2, opening - 1) if opening is not None and script.is_(part.begin + 1, "<") else None
        column.type = generic or next((script.tokens[k].text for a, b in plain[1:] for k in range(a, b) if script.tokens[k].kind == "name" and script.tokens[k].text[:1].isupper()), kind)
        column.enum_ref = column.type
    elif kind in REFERENCES:
        target = args[1] if len(args) > 1 else script.expr(*named["foreign"]) if "foreign" in named else None
        target = target if target is not None else script.expr(*named["refColumn"]) if "refColumn" in named else None
        column.type, column.nullable = "", kind == "optReference"
    rules = {k: named[k] for k in ("onDelete", "onUpdate") if k in named}
    for step, given, node in steps[1:]:
        value = given[0] if given else None
        match step:
            case "nullable":
                column.nullable = True
            case "uniqueIndex":
                column.unique = True
            case "index":
                e.indexes.append(Index([column.name], bool(given and any(g.true for g in given))))
            case "default" | "defaultExpression" | "clientDefault" if value is not None:
                column.default = node_text(script, value)
            case "autoIncrement":
                column.generated = True
            case "references" if value is not None:
                target = value
                inner = next((k for k in range(node.of.end, node.end) if script.is_(k, "(")), None)
                rules |= {k: v for k, v in (script.arguments(inner)[1] if inner is not None else {}).items() if k in ("onDelete", "onUpdate")}
    if target is not None and target.path:
        table, _, field_ = target.path.partition(".")
        said = lambda k: script.tokens[rules[k][1] - 1].text.replace("_", " ") if k in rules else None
        out.relations.append(RawRelation(Ref(model=d.name), Ref(model=table), [column.name], [snake(field_)] if field_ else [], kind="orm", on_delete=said("onDelete"), on_update=said("onUpdate"), optional=column.nullable, navigation=None, source=here))
    return column


READERS = {"jpa": SimpleNamespace(detect=jpa_detect, parse=jpa), "exposed": SimpleNamespace(detect=exposed_detect, parse=exposed)}
