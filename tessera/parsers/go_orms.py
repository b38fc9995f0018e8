"""Structs and schemas of three Go libraries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from types import SimpleNamespace

from tessera.functions.names import default_table, pluralize, short, snake
from tessera.model import Column, Index, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.parsers.jsast import Script

#: Packages whose types are values of columns.
VALUES = {
    "time", "sql", "driver", "uuid", "datatypes", "decimal", "json", "pq", "null", "nulls", "zero", "gorm", "pgtype", "types", "big", "net", "netip",
    "xid", "ulid", "primitive", "bson", "civil", "mysql", "geom", "orb", "money", "pgvector", "ksuid", "shortuuid", "carbon", "hstore", "bun",
}
BASIC = re.compile(r"(?:u?int(?:8|16|32|64)?|float(?:32|64)|complex\d+|string|bool|byte|rune|error|any|uintptr)$|map\[|func\(|interface|chan ")


@dataclass
class GoField:
    name: str
    type: str
    tag: str
    line: int
    embedded: bool = False

    @property
    def pointer(self) -> bool:
        return bool(re.match(r"(?:\[\])?\*", self.type))

    @property
    def many(self) -> bool:
        return self.type.startswith("[]") and self.base != "byte"

    @property
    def base(self) -> str:
        return re.sub(r"^(?:\[\w*\]|\*)+", "", self.type)


@dataclass
class Struct:
    name: str
    line: int
    fields: list[GoField] = field(default_factory=list)
    comment: str | None = None


def _plain(text: str) -> str:
    """Comments blanked; strings stay."""
    return re.sub(r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\])'|//[^\n]*|/\*.*?(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") else m[0], text, flags=re.S)


_FIELD = re.compile(r"\s*(?:(?P<names>[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+(?P<type>(?:\[\w*\]|\*)*(?:map\[[^\]]+\]\S+|[\w.]+(?:\[[^\]]*\])?))|(?P<embedded>\*?[\w.]+))\s*(?P<tag>`[^`]*`|\"[^\"]*\")?\s*;?$")


def structs(text: str) -> list[Struct]:
    """All struct types; nested anonymous structs are passed over."""
    plain, source = _plain(text).replace("\r\n", "\n").split("\n"), text.replace("\r\n", "\n").split("\n")
    out, i = [], 0
    while i < len(plain):
        m = re.match(r"\s*(?:type\s+)?([A-Z_a-z]\w*)(?:\[[^\]]*\])?\s+struct\s*\{(.*)$", plain[i])
        if not m or not re.match(r"\s*type\b|\s*[A-Z]", plain[i]):
            i += 1
            continue
        s, above, docs = Struct(m[1], i), i - 1, []
        while above >= 0 and source[above].strip().startswith("//"):
            docs.insert(0, source[above].strip().lstrip("/").strip())
            above -= 1
        s.comment = " ".join(d for d in docs if d) or None
        out.append(s)
        rest = m[2]
        if "}" in rest:
            rows = [(i, r) for r in rest[: rest.rindex("}")].split(";")]
            i += 1
        else:
            rows, depth = [(i, rest)], 1
            i += 1
            while i < len(plain) and depth > 0:
                line = plain[i]
                bare = re.sub(r"`[^`]*`|\"[^\"]*\"", "", line)
                if depth == 1:
                    rows.append((i, line))
                depth += bare.count("{") - bare.count("}")
                i += 1
        for number, row in rows:
            f = _FIELD.match(row)
            if f and row.strip() not in ("", "}"):
                tag = (f["tag"] or "")[1:-1]
                if f["embedded"]:
                    s.fields.append(GoField(short(f["embedded"].lstrip("*")), f["embedded"], tag, number, True))
                else:
                    s.fields += [GoField(n.strip(), f["type"], tag, number) for n in f["names"].split(",")]
    return out


def _tag(tag: str, key: str) -> str | None:
    m = re.search(rf'(?:^|\s){key}:"((?:\\.|[^"\\])*)"', tag)
    return m[1].replace('\\"', '"') if m else None


def table_names(text: str) -> dict[str, str]:
    """What ``TableName`` of each type returns."""
    return {m[1]: m[2] for m in re.finditer(r"func\s*\(\s*(?:\w+\s+)?\*?(\w+)\s*\)\s*TableName\s*\(\s*\)\s*string\s*\{\s*return\s+[\"`]([^\"`]+)[\"`]", text)}


# GORM


def gorm_detect(path: str, text: str) -> bool:
    return path.endswith(".go") and bool(re.search(r"gorm\.io/gorm|jinzhu/gorm", text) or re.search(r"`[^`\n]*\bgorm:\"", text))


def _settings(text: str | None) -> tuple[set[str], dict[str, str]]:
    flags, values = set(), {}
    for part in re.split(r"(?<!\\);", text or ""):
        key, colon, value = part.partition(":")
        if colon:
            values[key.strip().lower()] = value.strip().replace(r"\;", ";")
        elif key.strip():
            flags.add(key.strip().lower())
    return flags, values


def _ignored(text: str | None) -> bool:
    return bool(re.match(r"\s*-(?::all)?\s*(?:;|$)", text or ""))


def _linked(f: GoField, values: dict[str, str], names: set[str]) -> bool:
    if {"many2many", "foreignkey", "references", "polymorphic"} & set(values):
        return True
    package, dot, name = f.base.rpartition(".")
    if dot:
        return name[:1].isupper() and package not in VALUES and (bool({f"{f.name}ID", f"{name}ID"} & names) or f.many)
    return not BASIC.match(f.base) and f.base[:1].isupper() and not ({"serializer", "embedded"} & set(values)) and "type" not in values


def gorm(path: str, text: str) -> Parsed:
    out = Parsed(path, "gorm")
    found = structs(text)
    known, tables = {s.name: s for s in found}, table_names(text)
    uses = "gorm.io/gorm" in text or "jinzhu/gorm" in text
    embedded = {f.name for s in found for f in s.fields if f.embedded} | {f.base for s in found for f in s.fields if "embedded" in _settings(_tag(f.tag, "gorm"))[0]}
    migrated = set(re.findall(r"&?(?:\w+\.)?(\w+)\{\}", " ".join(re.findall(r"AutoMigrate\(([^)]*)\)", text))))
    for s in found:
        tagged = any(_tag(f.tag, "gorm") is not None for f in s.fields)
        model = any(f.embedded and f.type.lstrip("*") == "gorm.Model" for f in s.fields)
        keyed = uses and any(f.name == "ID" for f in s.fields)
        if not (tagged or model or s.name in tables or s.name in migrated or keyed) or (s.name in embedded and not s.name in tables and not model and not keyed):
            continue
        table = tables.get(s.name)
        raw = RawEntity(table or default_table("gorm", s.name), "table", model_name=s.name, name_certainty=2 if table else 0, comment=s.comment, source=Source(path, s.line))
        _gorm_columns(path, s, "", known, raw, set())
        names = {f.name for f in s.fields if not f.embedded}
        for f in s.fields:
            tag = _tag(f.tag, "gorm")
            flags, values = _settings(tag)
            if not f.embedded and not _ignored(tag) and "embedded" not in flags and _linked(f, values, names):
                _gorm_link(path, s, f, values, names, out)
        out.entities.append(raw)
    return out


def _gorm_columns(path: str, s: Struct, prefix: str, known: dict[str, Struct], raw: RawEntity, open_: set[str]) -> None:
    if s.name in open_:
        return
    names = {f.name for f in s.fields if not f.embedded}
    for f in s.fields:
        tag = _tag(f.tag, "gorm")
        flags, values = _settings(tag)
        source = Source(path, f.line)
        if _ignored(tag):
            continue
        if f.embedded or "embedded" in flags:
            inner = prefix + values.get("embeddedprefix", "")
            if f.type.lstrip("*") == "gorm.Model":
                parts = (("id", "uint", False, True), ("created_at", "time.Time", False, False), ("updated_at", "time.Time", False, False), ("deleted_at", "gorm.DeletedAt", True, False))
                raw.columns += [Column(inner + n, t, nullable, key, generated=True if key else None, source=source) for n, t, nullable, key in parts]
            elif f.base in known:
                _gorm_columns(path, known[f.base], inner, known, raw, open_ | {s.name})
            continue
        if _linked(f, values, names):
            continue
        column = Column(values.get("column") or prefix + snake(f.name), source=source)
        column.primary_key = (f.name == "ID" and not prefix) or "primarykey" in flags or "primary_key" in flags
        column.type = values.get("type") or (f"varchar({values['size']})" if f.base == "string" and "size" in values else f.base)
        strict = bool({"not null", "notnull"} & flags) or column.primary_key
        column.nullable = not strict and (f.pointer or f.base.startswith("sql.Null") or f.base in ("gorm.DeletedAt", "string"))
        column.unique = bool({"unique", "uniqueindex"} & flags) or "uniqueindex" in values
        column.generated = True if {"autoincrement", "autocreatetime", "autoupdatetime"} & flags else None
        column.default, column.comment = values.get("default"), values.get("comment")
        column.is_array = True if f.many else None
        raw.columns.append(column)
        named = values.get("index") or values.get("uniqueindex")
        if "index" in flags or named:
            label = (named or "").split(",")[0] or None
            same = next((i for i in raw.indexes if label and i.name == label), None)
            if same:
                same.columns.append(column.name)
            else:
                raw.indexes.append(Index([column.name], "uniqueindex" in values or "uniqueindex" in flags, label))
        elif "uniqueindex" in flags:
            raw.indexes.append(Index([column.name], True))


def _gorm_link(path: str, s: Struct, f: GoField, values: dict[str, str], names: set[str], out: Parsed) -> None:
    target, source = short(f.base), Source(path, f.line)
    rules = dict((k.strip().lower(), v.strip()) for k, _, v in (p.partition(":") for p in values.get("constraint", "").split(",")) if v)
    more = {"kind": "orm", "on_delete": rules.get("ondelete"), "on_update": rules.get("onupdate"), "source": source}
    to = [snake(values["references"])] if "references" in values else []
    own, other = lambda: Ref(model=s.name), lambda: Ref(model=target)
    if "many2many" in values:
        out.relations.append(RawRelation(own(), other(), cardinality="many-to-many", through=Ref(values["many2many"]), **more))
    elif "polymorphic" in values or f.many:
        key = snake(f"{values['polymorphic']}ID" if "polymorphic" in values else values.get("foreignkey", f"{s.name}ID"))
        if f.many:
            out.relations.append(RawRelation(own(), other(), to, [key], "one-to-many", **more))
        else:
            out.relations.append(RawRelation(other(), own(), [key], to, "one-to-one", **more))
    else:
        tagged = values.get("foreignkey")
        local = tagged if tagged in names else next((n for n in (f"{f.name}ID", f"{target}ID") if n in names), None) if not tagged or f"{f.name}ID" in names else None
        if local:
            out.relations.append(RawRelation(own(), other(), [snake(tagged or local)], to, **more))
        else:
            out.relations.append(RawRelation(other(), own(), [snake(tagged or f"{s.name}ID")], to, "one-to-one", **more))


# Bun


def bun_detect(path: str, text: str) -> bool:
    return path.endswith(".go") and bool(re.search(r"uptrace/bun\"|\bbun\.BaseModel\b", text) or re.search(r"`[^`\n]*\bbun:\"", text))


def _bun(tag: str | None) -> tuple[str, list[str]]:
    parts, depth, begin = [], 0, 0
    text = tag or ""
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth <= 0:
            parts.append(text[begin:i])
            begin = i + 1
    parts.append(text[begin:])
    return parts[0].strip(), [p.strip() for p in parts[1:]]


def bun(path: str, text: str) -> Parsed:
    out = Parsed(path, "bun")
    for s in structs(text):
        base = next((f for f in s.fields if f.embedded and f.type.lstrip("*") == "bun.BaseModel"), None)
        if base is None and not any(_tag(f.tag, "bun") is not None for f in s.fields):
            continue
        table = re.search(r"(?:^|,)table:([^,]+)", _tag(base.tag, "bun") or "") if base else None
        schema, _, name = (table[1].strip() if table else "").rpartition(".")
        raw = RawEntity(name or default_table("bun", s.name), "table", schema=schema or None, model_name=s.name, name_certainty=2 if table else 0, comment=s.comment, source=Source(path, s.line))
        for f in s.fields:
            tag = _tag(f.tag, "bun")
            first, options = _bun(tag)
            rules = [first, *options] if ":" in first else options
            values = dict((k, v) for k, colon, v in (o.partition(":") for o in rules) if colon)
            if f.embedded or first == "-":
                continue
            source, target = Source(path, f.line), short(f.base)
            if "rel" in values or "m2m" in values:
                joins = [j.partition("=") for j in (o[5:] for o in rules if o.startswith("join:"))]
                own, others = [a for a, _, _ in joins], [b for _, _, b in joins]
                if "m2m" in values:
                    out.relations.append(RawRelation(Ref(model=s.name), Ref(model=target), cardinality="many-to-many", kind="orm", through=Ref(values["m2m"]), source=source))
                elif values["rel"] == "belongs-to":
                    out.relations.append(RawRelation(Ref(model=s.name), Ref(model=target), own or [f"{snake(f.name)}_id"], others, kind="orm", source=source))
                else:
                    cardinality = "one-to-one" if values["rel"] == "has-one" else "one-to-many"
                    key = others or [f"{snake(s.name)}_id"]
                    if cardinality == "one-to-one":
                        out.relations.append(RawRelation(Ref(model=target), Ref(model=s.name), key, own, cardinality, "orm", source=source))
                    else:
                        out.relations.append(RawRelation(Ref(model=s.name), Ref(model=target), own, key, cardinality, "orm", source=source))
                continue
            if tag is None and not BASIC.match(f.base) and f.base[:1].isupper():
                continue
            flags = set(options)
            primary = "pk" in flags or (f.name == "ID" and not any("pk" in _bun(_tag(x.tag, "bun"))[1] for x in s.fields))
            column = Column((first if ":" not in first else "") or snake(f.name), values.get("type") or f.base, "notnull" not in flags and not primary, primary, "unique" in flags or "unique" in values, source=source)
            column.generated = True if {"autoincrement", "identity"} & flags else None
            column.default = values.get("default")
            column.is_array = True if "array" in flags or f.many else None
            raw.columns.append(column)
        out.entities.append(raw)
    return out


# Ent


def ent_detect(path: str, text: str) -> bool:
    return path.endswith(".go") and bool(re.search(r"entgo\.io/ent|facebook(?:incubator)?/ent|\bent\.Schema\b", text))


ENT_TYPES = {"Int": "int", "String": "string", "Text": "text", "Bool": "bool", "Time": "time", "Float": "float64", "UUID": "uuid", "JSON": "json", "Bytes": "bytes", "Enum": "enum", "Strings": "json", "Ints": "json", "Other": "other", "Any": "json"}


def _bodies(script: Script) -> list[tuple[str, str, tuple[int, int]]]:
    """Owner, name and body of every method."""
    out = []
    for i in range(len(script.tokens)):
        if script.is_(i, "func") and script.is_(i + 1, "("):
            close = script._close[i + 1]
            names = [t.text for t in script.tokens[i + 2 : close] if t.kind == "name"]
            j = close + 1
            if not names or j >= len(script.tokens):
                continue
            k = script._close.get(j + 1, j) + 1 if script.is_(j + 1, "(") else j
            while k < len(script.tokens) and not script.is_(k, "{"):
                k = script._close[k] + 1 if script.is_(k, "(", "[") else k + 1
            if k < len(script.tokens):
                out.append((names[-1], script.tokens[j].text, (k + 1, script._close[k])))
    return out


def ent(path: str, text: str) -> Parsed:
    out = Parsed(path, "ent")
    found = {s.name: s for s in structs(text)}
    script = Script(path, text)
    bodies = _bodies(script)
    if "schema.Table" in text:
        _ent_migrated(script, out)
    for s in found.values():
        kinds = {f.type.lstrip("*") for f in s.fields if f.embedded}
        if not kinds & {"ent.Schema", "mixin.Schema"}:
            continue
        raw = RawEntity(pluralize(snake(s.name)), "table", model_name=s.name, name_certainty=0, abstract="mixin.Schema" in kinds, comment=s.comment, source=Source(path, s.line))
        mine = {name: body for owner, name, body in bodies if owner == s.name}
        if "Annotations" in mine:
            said = re.search(r"Table:\s*\"([^\"]+)\"", script.between(*mine["Annotations"]))
            if said:
                raw.name, raw.name_certainty = said[1], 2
            if schema := re.search(r"\bSchema(?::|\()\s*\"([^\"]+)\"", script.between(*mine["Annotations"])):
                raw.schema = schema[1]
        for node in script.chains(*mine.get("Fields", (0, 0))):
            _ent_field(script, node, raw, out)
        for node in script.chains(*mine.get("Edges", (0, 0))):
            _ent_edge(script, node, s.name, raw, out)
        for node in script.chains(*mine.get("Indexes", (0, 0))):
            steps = node.chain()
            if [x[0] for x in steps[:2]] == ["index", "Fields"] and steps[1][1] is not None:
                names = [a.string for a in steps[1][1] if a.string]
                if names:
                    raw.indexes.append(Index(names, any(x[0] == "Unique" for x in steps)))
        if "Mixin" in mine:
            raw.extends = re.findall(r"(\w+)\s*\{", script.between(*mine["Mixin"]).partition("return")[2].partition("{")[2])
        if not raw.abstract and not any(c.name == "id" for c in raw.columns):
            raw.columns.insert(0, Column("id", "int", False, True, generated=True))
        out.entities.append(raw)
    return out


def _ent_field(script: Script, node, raw: RawEntity, out: Parsed) -> None:
    steps = node.chain()
    if len(steps) < 2 or steps[0][0] != "field" or not steps[1][1] or steps[1][1][0].string is None:
        return
    kind, args, part = steps[1]
    column = Column(args[0].value, ENT_TYPES.get(kind, kind.lower()), False, source=script.source(part.begin))
    for step, more, _ in steps[2:]:
        first = more[0] if more else None
        if step in ("Optional", "Nillable"):
            column.nullable = True
        elif step == "Unique":
            column.unique = True
        elif step == "StorageKey" and first is not None and first.string:
            column.name = first.value
        elif step == "Comment" and first is not None:
            column.comment = first.string
        elif step in ("Default", "DefaultFunc") and first is not None:
            column.generated = True
            column.default = first.string if first.string is not None else script.of(first)
        elif step == "Values" and more:
            column.enum_ref = f"{raw.name}_{column.name}"
            out.enums.append(RawEnum(column.enum_ref, [a.value for a in more if a.kind == "str"], source=column.source))
    if column.name == "id":
        column.primary_key, column.nullable, column.generated = True, False, True if column.type == "int" else None
    raw.columns.append(column)


def _ent_edge(script: Script, node, model: str, raw: RawEntity, out: Parsed) -> None:
    steps = node.chain()
    if len(steps) < 2 or steps[0][0] != "edge" or steps[1][0] not in ("To", "From") or not steps[1][1] or len(steps[1][1]) < 2:
        return
    kind, args, part = steps[1]
    name, target = args[0].string or "", args[1].path.partition(".")[0]
    named = {s: a for s, a, _ in steps[2:]}
    unique, required, source = "Unique" in named, "Required" in named, script.source(part.begin)
    own, other = Ref(model=model), Ref(model=target)
    if kind == "To":
        key = named["Field"][0].string if named.get("Field") else None
        column = f"{snake(model)}_{snake(name)}"
        if key and unique:
            if not any(c.name == key for c in raw.columns):
                raw.columns.append(Column(key, "", not required, source=source))
            out.relations.append(RawRelation(own, other, [key], kind="orm", optional=not required, source=source))
        elif unique:
            out.relations.append(RawRelation(other, own, [column], [], "one-to-one", "orm", optional=not required, source=source))
        else:
            out.relations.append(RawRelation(own, other, [], [column], "one-to-many", "orm", source=source))
        return
    ref = named["Ref"][0].string if named.get("Ref") else None
    if not unique:
        out.relations.append(RawRelation(own, other, cardinality="many-to-many", kind="orm", source=source))
        return
    key = (named["Field"][0].string if named.get("Field") else None) or f"{snake(target)}_{snake(ref or name)}"
    if not any(c.name == key for c in raw.columns):
        raw.columns.append(Column(key, "", not required, source=source))
    out.relations.append(RawRelation(own, other, [key], kind="orm", optional=not required, source=source))


def _ent_migrated(script: Script, out: Parsed) -> None:
    """Tables of a generated migration schema: variables of columns, of tables, and what keys refer to."""
    columns: dict[str, list[Column]] = {}
    choices: dict[int, list[str]] = {}
    tables: dict[str, RawEntity] = {}
    keys: dict[str, list[RawRelation]] = {}

    def opening(i: int, end: int) -> int | None:
        return next((k for k in range(i, min(end, i + 12)) if script.is_(k, "{")), None)

    def span(item: tuple[int, int], key: str) -> tuple[int, int] | None:
        return next(((a + 2, b) for a, b in script.parts(item[0]) if script.is_(a, key) and script.is_(a + 1, ":") and a + 2 < b), None) if script.is_(item[0], "{") else None

    def items(where: tuple[int, int] | None) -> list[tuple[int, int]]:
        at = opening(*where) if where else None
        return script.parts(at) if at is not None else []

    def texts(where: tuple[int, int] | None) -> list[str]:
        return [n.value for k in range(*where or (0, 0)) if (n := script.expr(k, k + 1)).kind == "str"]

    def picked(where: tuple[int, int] | None) -> list[Column]:
        """``UsersColumns[0]``."""
        held = []
        for a, b in items(where):
            of, at = columns.get(script.tokens[a].text, []), script.tokens[a + 2].text if a + 2 < b else ""
            held += of[int(at) : int(at) + 1] if at.isdigit() else []
        return held

    for i in range(len(script.tokens) - 2):
        name = script.tokens[i].text
        if not script.is_(i + 1, "=") or script.tokens[i].kind != "name":
            continue
        at = opening(i + 2, len(script.tokens))
        head = [t.text for t in script.tokens[i + 2 : at]] if at is not None else []
        if head[-1:] == ["Column"] and head[:1] == ["["]:
            columns[name] = []
            for item in script.parts(at):
                said = script.expr(*item)
                get = lambda k: said.get(k)
                label = get("Name").string if get("Name") is not None else None
                if label:
                    kind = (get("Type").tail if get("Type") is not None else "").removeprefix("Type")
                    true = lambda k: get(k) is not None and get(k).true
                    type_ = f"varchar({get('Size').value})" if kind == "String" and get("Size") is not None else ENT_TYPES.get(kind, kind.lower())
                    c = Column(label, type_, true("Nullable"), unique=true("Unique"), generated=True if true("Increment") else None, source=script.source(item[0]))
                    if get("Default") is not None:
                        c.default = get("Default").string if get("Default").string is not None else script.of(get("Default"))
                    if values := texts(span(item, "Enums")):
                        c.type, choices[id(c)] = "enum", values
                    columns[name].append(c)
        elif head[-1:] == ["Table"] and head[:1] == ["&"]:
            body = (at, script._close[at])
            label = texts(span(body, "Name"))
            if not label:
                continue
            e = tables[name] = RawEntity(label[0], "table", source=script.source(i))
            of = script.tokens[span(body, "Columns")[0]].text if span(body, "Columns") else ""
            e.columns = columns.get(of, [])
            for c in picked(span(body, "PrimaryKey")):
                c.primary_key, c.nullable = True, False
            for c in e.columns:
                if id(c) in choices:
                    c.enum_ref = f"{e.name}_{c.name}"
                    out.enums.append(RawEnum(c.enum_ref, choices[id(c)], source=c.source))
            for item in items(span(body, "Indexes")):
                if listed := [c.name for c in picked(span(item, "Columns"))]:
                    unique = span(item, "Unique")
                    e.indexes.append(Index(listed, bool(unique) and script.is_(unique[0], "true"), next(iter(texts(span(item, "Name"))), None)))
            keys[name] = []
            for item in items(span(body, "ForeignKeys")):
                rule = span(item, "OnDelete")
                said = script.tokens[rule[1] - 1].text if rule else None
                rule_text = None if said in (None, "NoAction") else re.sub(r"(?<=[a-z])(?=[A-Z])", " ", said).upper()
                keys[name].append(RawRelation(Ref(e.name), Ref(), [c.name for c in picked(span(item, "Columns"))], [c.name for c in picked(span(item, "RefColumns"))], name=next(iter(texts(span(item, "Symbol"))), None), on_delete=rule_text, source=script.source(item[0])))
    for m in re.finditer(r"\b(\w+)\.ForeignKeys\[(\d+)\]\.RefTable\s*=\s*(\w+)", script.text):
        if m[1] in keys and int(m[2]) < len(keys[m[1]]) and m[3] in tables:
            relation = keys[m[1]][int(m[2])]
            relation.to = Ref(tables[m[3]].name)
            out.relations.append(relation)
    out.entities += tables.values()


READERS = {
    "gorm": SimpleNamespace(detect=gorm_detect, parse=gorm),
    "ent": SimpleNamespace(detect=ent_detect, parse=ent),
    "bun": SimpleNamespace(detect=bun_detect, parse=bun),
}
