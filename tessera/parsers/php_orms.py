"""Laravel migrations and models, and Doctrine entities.

PHP is brought into the shape that the reader of scripts knows: members with a
dot, attributes and annotations as decorators with an object of their named
arguments.  Lines stay where they are.
"""

from __future__ import annotations

import re
from types import SimpleNamespace

from tessera.functions.inflect import pluralize
from tessera.functions.names import default_table, snake
from tessera.model import Column, Index, Op, Parsed, RawEntity, RawEnum, RawRelation, Ref
from tessera.parsers.jsast import Class, Member, Node, Script, strings

_PIECES = re.compile(
    r"""(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<attribute>\#\[)|(?P<doc>/\*\*.*?(?:\*/|\Z))|(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*|\#[^\n]*)"""
    r"""|(?P<dot>\?->|->|::)|(?P<name>\\?[A-Za-z_]\w*(?:\\[A-Za-z_]\w*)+|\\[A-Za-z_]\w*)""",
    re.X | re.S,
)


def _lines(text: str) -> str:
    return "\n" * text.count("\n")


def _bracket(text: str, i: int) -> int:
    """The end of the bracket that opens at a place, strings passed over."""
    depth = 0
    for m in re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[(\[{]|[)\]}]", re.S).finditer(text, i):
        depth += (m[0] in "([{") - (m[0] in ")]}") if len(m[0]) == 1 else 0
        if depth == 0 and len(m[0]) == 1:
            return m.end()
    return len(text)


def _parts(text: str) -> list[str]:
    out, begin, i = [], 0, 0
    while i < len(text):
        if text[i] in "([{":
            i = _bracket(text, i)
            continue
        if text[i] in "'\"":
            m = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S).match(text, i)
            i = m.end() if m else len(text)
            continue
        if text[i] == ",":
            out.append(text[begin:i])
            begin = i + 1
        i += 1
    return [p for p in [*out, text[begin:]] if p.strip()]


def _named(args: str, sign: str) -> str:
    """Arguments with the named ones gathered in an object at the end."""
    plain, named = [], []
    for part in _parts(args):
        m = re.match(rf"(\s*)([A-Za-z_]\w*)(\s*){sign}(?![:>=])(.*)$", part, re.S)
        if m:
            named.append(f"{m[1]}{m[2]}{m[3]}:{m[4]}")
        else:
            plain.append(part)
    return ",".join([*plain, *(["{" + ",".join(named) + "}"] if named else [])])


def _maps(text: str) -> str:
    """``['a' => 1]`` as an object."""
    return re.sub(r"\[([^\[\]]*=>[^\[\]]*)\]", lambda m: "{" + m[1].replace("=>", ":") + "}", text)


def _dotted(text: str) -> str:
    """A class name in a string, which has dots here."""
    return re.sub(r"([\"'])\\{0,2}((?:[A-Za-z_]\w*\\{1,2})+[A-Za-z_]\w*)(?=\1)", lambda m: m[1] + re.sub(r"\\+", ".", m[2]), text)


def _annotation(name: str, args: str | None, sign: str) -> str:
    return f"@{name.lstrip(chr(92)).replace(chr(92), '.')}" + (f"({_named(_maps(args), sign)})" if args is not None else "") + " "


def _doc(text: str) -> str:
    """The annotations of a comment."""
    body = re.sub(r"^(\s*)\*(?!/)", r"\1 ", text[3:].removesuffix("*/"), flags=re.M)
    out, at = "", 0
    while m := re.compile(r"@((?:[A-Za-z_]\w*\\)+[A-Za-z_]\w*)[ \t]*").search(body, at):
        out += _lines(body[at : m.start()])
        at, args = m.end(), None
        if body[at : at + 1] == "(":
            stop = _bracket(body, at)
            args, at = _dotted(body[at + 1 : stop - 1]), stop
            # lists are in braces here, and so are maps
            args = re.sub(r"\{([^{}=:]*)\}", r"[\1]", args)
            args = re.sub(r"@(?:[A-Za-z_]\w*\\)*([A-Za-z_]\w*)\s*\(([^()]*)\)", lambda x: "\x01" + x[2].replace("=", ":") + "\x02", args)
            args = re.sub(r"\{([^{}]*)\}", lambda x: f"[{x[1]}]" if "\x01" in x[1] else "{" + x[1].replace("=", ":") + "}", args)
            args = args.replace("\x01", "{").replace("\x02", "}")
        out += _annotation(m[1], args, "=")
    return out + _lines(body[at:])


def adapted(text: str) -> str:
    out, i = [], 0
    while m := _PIECES.search(text, i):
        out.append(text[i : m.start()])
        i = m.end()
        match m.lastgroup:
            case "string":
                out.append(_dotted(m[0]))
            case "attribute":
                stop = _bracket(text, m.end() - 1)
                for part in _parts(text[m.end() : stop - 1]):
                    a = re.match(r"\s*([\\\w]+)\s*(?:\((.*)\)\s*)?$", part, re.S)
                    if a:
                        args = None if a[2] is None else re.sub(r"::", ".", re.sub(r"(?<![\\\w])\\?(?:[A-Za-z_]\w*\\)+(?=\w)", "", a[2]))
                        out.append(_lines(part[: a.start(1)]) + _annotation(a[1], args, ":"))
                    else:
                        out.append(_lines(part))
                i = stop
            case "doc":
                out.append(_doc(m[0]) if re.search(r"@\w+\\", m[0]) else m[0])
            case "comment":
                out.append(_lines(m[0]))
            case "dot":
                out.append(".")
            case "name":
                out.append(m[0].lstrip("\\").replace("\\", "."))
    plain = "".join([*out, text[i:]]) if i else text
    plain = re.sub(r"\bfunction\s+&?\s*(?=\w+\s*\()", " ", plain)
    plain = re.sub(r"\b(?:final|readonly)\s+(?=(?:abstract\s+|readonly\s+)?class\b)", "", plain)
    return re.sub(r"\b(public|protected|private|var)((?:\s+(?:readonly|static))*)\s+((?:\?\s*)?[\w.|]+\s+)?\$(\w+)", lambda m: f"private {m[4]}: {(m[3] or 'mixed').strip()}" + _lines(m[0]), plain)


def _class_of(node: Node | None) -> str | None:
    """The class of ``User::class``, ``'App\\Models\\User'`` or a bare name."""
    if node is None:
        return None
    if node.string is not None:
        return re.split(r"[\\.]", node.string)[-1] or None
    path = node.path.removesuffix(".class")
    return path.rpartition(".")[2] or None


# Laravel


def laravel_detect(path: str, text: str) -> bool:
    if not path.endswith(".php") or doctrine_detect(path, text):
        return False
    return bool(
        re.search(r"\bIlluminate\\Database\b", text)
        or (re.search(r"\bBlueprint\b", text) and re.search(r"\bSchema::(?:create|table|drop|dropIfExists|rename|connection)\b", text))
        or re.search(r"\bextends\s+(?:Model|Authenticatable|Pivot|MorphPivot|Eloquent)\b", text)
    )


#: Column methods with a type, besides the integers.
LARAVEL_TYPES = {
    "string", "char", "text", "tinyText", "mediumText", "longText", "boolean", "decimal", "unsignedDecimal", "float", "double", "date", "dateTime", "dateTimeTz",
    "time", "timeTz", "timestamp", "timestampTz", "year", "json", "jsonb", "binary", "uuid", "ulid", "ipAddress", "macAddress", "geometry", "geography", "point", "vector",
}


def _laravel_type(kind: str) -> str | None:
    plain = re.sub(r"^unsigned(\w)", lambda m: m[1].lower(), kind)
    if m := re.fullmatch(r"(tiny|small|medium|big)?[iI]nteger", plain):
        return f"{m[1]}int" if m[1] else "integer"
    if kind not in LARAVEL_TYPES:
        return None
    if plain.endswith("Text"):
        return "text"
    plain = plain.removesuffix("Tz")
    return "datetime" if plain == "dateTime" else plain


def laravel(path: str, text: str) -> Parsed:
    script = Script(path, adapted(text))
    migration = bool(re.search(r"\bSchema::|extends\s+Migration\b", text))
    out = Parsed(path, "laravel", "migration" if migration else "definition")
    if migration:
        _Migration(script, out).read()
    for c in script.classes():
        if c.name and c.base is not None and c.base.tail not in ("Migration", "Seeder", "Factory", "Controller", "TestCase"):
            _eloquent(script, c, out)
    return out


class _Migration:
    def __init__(self, script: Script, out: Parsed):
        self.script, self.out = script, out

    def body(self) -> tuple[int, int]:
        for c in self.script.classes():
            for m in c.members:
                if m.name == "up" and m.body:
                    return m.body
        return 0, len(self.script.tokens)

    def read(self) -> None:
        for node in self.script.chains(*self.body()):
            steps = node.chain()
            if not steps or steps[0][0] != "Schema":
                continue
            name, args, part = steps[-1]
            first = args[0].string if args else None
            source = self.script.source(part.begin)
            if not first:
                continue
            schema, _, plain = first.rpartition(".")
            ref = Ref(plain, schema=schema or None)
            if name in ("create", "table") and len(args) > 1 and args[1].kind == "fn":
                self.table(ref, args[1], name == "create", source)
            elif name in ("drop", "dropIfExists"):
                self.out.ops.append(Op("dropTable", ref, source=source))
            elif name == "rename" and len(args) > 1 and args[1].string:
                self.out.ops.append(Op("renameTable", ref, to=args[1].value, source=source))
            elif name == "dropColumns" and len(args) > 1:
                self.out.ops += [Op("dropColumn", Ref(plain, schema=ref.schema), n, source=source) for n in strings(args[1])]

    def table(self, ref: Ref, builder: Node, create: bool, source) -> None:
        e = RawEntity(ref.name or "", "table", schema=ref.schema, partial=not create, source=source)
        params, body = builder.items
        variable = next((t.text for t in reversed(self.script.tokens[params[0] : params[1]]) if t.kind == "name"), "")
        for node in self.script.chains(*body):
            steps = node.chain()
            if len(steps) > 1 and steps[0][0] == variable and steps[0][1] is None and steps[1][1] is not None:
                self.step(ref, e, steps)
        if create or e.columns or e.indexes or e.comment:
            self.out.entities.append(e)

    def step(self, ref: Ref, e: RawEntity, steps: list) -> None:
        kind, args, part = steps[1]
        here, ops, texts = self.script.source(part.begin), self.out.ops, [a.string for a in args if a.string is not None]
        own = lambda: Ref(ref.name, schema=ref.schema)
        names = strings(args[0]) if args and args[0].kind == "arr" else texts
        gone = {
            "dropSoftDeletes": ["deleted_at"], "dropSoftDeletesTz": ["deleted_at"], "dropTimestamps": ["created_at", "updated_at"], "dropTimestampsTz": ["created_at", "updated_at"],
            "dropRememberToken": ["remember_token"], "dropMorphs": [f"{texts[0]}_id", f"{texts[0]}_type"] if texts else [], "dropConstrainedForeignId": texts[:1],
            "dropColumn": names, "dropColumns": names,
        }.get(kind)
        if gone is not None:
            ops += [Op("dropColumn", own(), n, source=here) for n in gone]
        elif kind == "renameColumn" and len(texts) > 1:
            ops.append(Op("renameColumn", own(), texts[0], texts[1], source=here))
        elif kind == "rename" and texts:
            ops.append(Op("renameTable", own(), to=texts[0], source=here))
        elif kind == "dropForeign":
            listed = strings(args[0]) if args and args[0].kind == "arr" else []
            ops.append(Op("dropForeignKey", own(), columns=listed, name=None if listed else next(iter(texts), None), source=here))
        elif kind == "comment" and texts:
            e.comment = texts[0]
        elif kind in ("primary", "unique", "index", "fullText", "spatialIndex") and names:
            if kind == "primary":
                for n in names:
                    c = next((c for c in e.columns if c.name == n), None)
                    if c is not None:
                        c.primary_key = True
                    else:
                        ops.append(Op("alterColumn", own(), n, set={"primary_key": True}, source=here))
            else:
                label = args[1].string if len(args) > 1 else None
                e.indexes.append(Index(names, kind == "unique", label))
        elif kind == "foreign" and names:
            self.foreign(own(), names, steps[2:], None, None, here)
        else:
            self.column(ref, e, kind, args, steps[2:], here)

    def column(self, ref: Ref, e: RawEntity, kind: str, args: list[Node], more: list, here) -> None:
        first = args[0].string if args else None
        made = lambda n, t, **k: Column(n, t, **{"nullable": False, "source": here, **k})
        target, columns = None, []
        if kind in ("id", "increments", "bigIncrements", "tinyIncrements", "smallIncrements", "mediumIncrements", "integerIncrements"):
            columns = [made(first or "id", "bigint", primary_key=True, generated=True)]
        elif kind in ("foreignId", "foreignUuid", "foreignUlid") and first:
            columns = [made(first, {"foreignId": "bigint", "foreignUuid": "uuid"}.get(kind, "ulid"))]
        elif kind == "foreignIdFor" and args:
            model = _class_of(args[0]) or ""
            columns = [made(args[1].string if len(args) > 1 and args[1].string else f"{snake(model)}_id", "bigint")]
            target = default_table("laravel", model)
        elif re.fullmatch(r"(?:nullable)?(?:uuid|ulid|numeric)?[mM]orphs|nullable(?:Uuid|Ulid|Numeric)Morphs", kind) and first:
            id_type = "uuid" if "uuid" in kind.lower() else "ulid" if "ulid" in kind.lower() else "bigint"
            columns = [made(f"{first}_id", id_type, nullable="nullable" in kind), made(f"{first}_type", "string", nullable="nullable" in kind)]
        elif kind in ("timestamps", "timestampsTz", "nullableTimestamps"):
            columns = [made(n, "timestamp", nullable=True) for n in ("created_at", "updated_at")]
        elif kind in ("softDeletes", "softDeletesTz"):
            columns = [made(first or "deleted_at", "timestamp", nullable=True)]
        elif kind == "rememberToken":
            columns = [made("remember_token", "string", nullable=True)]
        elif kind in ("enum", "set") and first:
            name = f"{e.name}_{first}"
            if values := strings(args[1]) if len(args) > 1 else []:
                self.out.enums.append(RawEnum(name, values, source=here))
            columns = [made(first, kind, enum_ref=name)]
        elif first and (plain := _laravel_type(kind)):
            columns = [made(first, plain)]
        elif kind in ("addColumn", "rawColumn") and len(args) > 1 and args[0].string and args[1].string:
            columns = [made(args[1].value, args[0].value)] if kind == "addColumn" else [made(args[0].value, args[1].value)]
        if not columns:
            return
        c, change = columns[0], False
        for step, given, _ in more:
            value = given[0] if given else None
            match step:
                case "nullable":
                    c.nullable = not (value is not None and value.false)
                case "default" if value is not None:
                    c.default = value.string if value.string is not None else self.script.of(value)
                case "useCurrent":
                    c.default = "CURRENT_TIMESTAMP"
                case "comment" if value is not None:
                    c.comment = value.string
                case "unique":
                    c.unique = True
                case "index":
                    e.indexes.append(Index([c.name]))
                case "primary":
                    c.primary_key, c.nullable = True, False
                case "autoIncrement" | "storedAs" | "virtualAs" | "generatedAs":
                    c.generated = True
                case "change":
                    change = True
        self.foreign(Ref(ref.name, schema=ref.schema), [c.name], more, target, c, here)
        if change:
            patch = {"type": c.type, "nullable": c.nullable, "default": c.default, "comment": c.comment}
            self.out.ops.append(Op("alterColumn", Ref(ref.name, schema=ref.schema), c.name, set={k: v for k, v in patch.items() if v is not None}, source=here))
        else:
            e.columns += columns

    def foreign(self, own: Ref, columns: list[str], steps: list, target: str | None, column: Column | None, here) -> None:
        """A relation, if the steps behind a column or ``foreign`` make one."""
        named = {s: a or [] for s, a, _ in steps}
        text = lambda s, i=0: named[s][i].string if s in named and len(named[s]) > i else None
        if "constrained" in named:
            target = text("constrained") or target or pluralize(re.sub(r"_(?:id|uuid|ulid)$", "", columns[0]))
            to = [text("constrained", 1) or "id"]
        elif "references" in named and "on" in named:
            target = text("on")
            to = strings(named["references"][0]) if named["references"] else []
        else:
            return
        if not target:
            return
        rule = {"cascade": "cascade", "restrict": "restrict", "null": "set null", "noAction": "no action"}
        short_ = lambda event: next((v for k, v in rule.items() if f"{k}On{event}" in named), None) or text(f"on{event}")
        schema, _, plain = target.rpartition(".")
        nullable = column.nullable if column is not None else None
        self.out.relations.append(RawRelation(own, Ref(plain, schema=schema or None), columns, to, on_delete=short_("Delete"), on_update=short_("Update"), optional=nullable, source=here))


def _eloquent(script: Script, c: Class, out: Parsed) -> None:
    roots = ("Model", "Authenticatable", "Pivot", "MorphPivot", "Eloquent")
    table = next((m.value.string for m in c.members if m.name == "table" and m.value is not None and m.value.string), None)
    links = []
    for m in c.members:
        if m.body:
            for node in script.chains(*m.body):
                steps = node.chain()
                if len(steps) > 1 and steps[0][0] in ("$this", "this") and steps[1][1] and re.fullmatch(r"(?:belongsTo|has|morph)(?:Many|One|To|ToMany)?", steps[1][0]):
                    links.append((m, steps[1], steps[2:]))
                    break
    if c.base.tail not in roots and table is None and not links:
        return
    schema, _, plain = (table or "").rpartition(".")
    e = RawEntity(plain or default_table("laravel", c.name), "table", schema=schema or None, model_name=c.name, name_certainty=2 if table else 0, abstract=c.abstract, comment=script.comment(c.at), source=script.source(c.at))
    if c.base.tail not in roots:
        e.extends = [c.base.tail]
    out.entities.append(e)
    for m, (kind, args, part), rest in links:
        target, here = _class_of(args[0]), script.source(part.begin)
        given = [a.string for a in args[1:]] + [None] * 4
        own, other = lambda: Ref(model=c.name), lambda: Ref(model=target)
        if not target:
            continue
        if kind == "belongsTo":
            out.relations.append(RawRelation(own(), other(), [given[0] or f"{snake(m.name)}_id"], [given[1]] if given[1] else [], kind="orm", navigation=m.name, source=here))
        elif kind in ("hasMany", "hasOne"):
            key, to = [given[0] or f"{snake(c.name)}_id"], [given[1]] if given[1] else []
            if kind == "hasMany":
                out.relations.append(RawRelation(own(), other(), to, key, "one-to-many", "orm", navigation=m.name, source=here))
            else:
                out.relations.append(RawRelation(other(), own(), key, to, "one-to-one", "orm", source=here))
        elif kind == "belongsToMany":
            through = given[0] or "_".join(sorted([snake(c.name), snake(target)]))
            out.relations.append(RawRelation(own(), other(), cardinality="many-to-many", kind="orm", through=Ref(through), navigation=m.name, source=here))


# Doctrine


def doctrine_detect(path: str, text: str) -> bool:
    return path.endswith(".php") and bool(re.search(r"\bDoctrine\\ORM\\Mapping\b|@ORM\\|#\[\s*ORM\\", text))


def _of(m: Member | Class, name: str) -> dict[str, Node] | None:
    """Named arguments of a mapping, a positional one under its place; none if it isn't there."""
    d = m.decorator(name)
    return None if d is None else _values(d)


def _values(d: Node) -> dict[str, Node]:
    out: dict[str, Node] = {}
    for i, a in enumerate(d.items if d.kind == "call" else []):
        out |= dict(a.items) if a.kind == "obj" else {str(i): a}
    return out


def _text(options: dict[str, Node] | None, *keys: str) -> str | None:
    return next((options[k].string for k in keys if options and k in options and options[k].string is not None), None)


def _is(options: dict[str, Node] | None, key: str, value: bool) -> bool:
    return bool(options) and key in options and (options[key].true if value else options[key].false)


def doctrine(path: str, text: str) -> Parsed:
    script, out = Script(path, adapted(text)), Parsed(path, "doctrine")
    classes = list(script.classes())
    shared = {c.name for c in classes if (o := _of(c, "InheritanceType")) is not None and _text(o, "0", "value") == "SINGLE_TABLE"}
    for c in classes:
        root, base = c.decorator("Entity"), c.decorator("MappedSuperclass")
        mapped = [m for m in c.members if m.body is None and m.decorators]
        if not c.name or c.decorator("Embeddable") or (root is None and base is None and not any(m.decorator("Column", "ManyToOne") for m in mapped)):
            continue
        table = _of(c, "Table") or {}
        name = _text(table, "name", "0")
        raw = RawEntity(name or default_table("doctrine", c.name), "table", schema=_text(table, "schema"), model_name=c.name, name_certainty=2 if name else 0, source=script.source(c.at))
        raw.abstract = root is None
        if c.base is not None and c.base.tail:
            raw.extends, raw.shared_table = [c.base.tail], c.base.tail in shared
        for m in mapped:
            _doctrine_member(script, c, m, raw, out)
        for d in c.decorators:
            if d.tail in ("Index", "UniqueConstraint"):
                _doctrine_index(_values(d), d.tail != "Index", raw)
        for key, unique in (("indexes", False), ("uniqueConstraints", True)):
            for item in table[key].items if key in table and table[key].kind == "arr" else []:
                if item.kind == "obj":
                    _doctrine_index(dict(item.items), unique, raw)
        out.entities.append(raw)
    return out


def _doctrine_index(options: dict[str, Node], unique: bool, raw: RawEntity) -> None:
    names = strings(options.get("columns")) or strings(options.get("fields"))
    if names:
        raw.indexes.append(Index(names, unique, _text(options, "name")))


def _doctrine_member(script: Script, c: Class, m: Member, raw: RawEntity, out: Parsed) -> None:
    here = script.source(m.at)
    declared = m.type.lstrip("? ").strip()
    if (o := _of(m, "Column")) is not None:
        kind = _text(o, "type", "1") or ("" if "type" not in o else o["type"].tail.lower()) or ("" if declared == "mixed" else declared)
        column = Column(_text(o, "name", "0") or snake(m.name), kind, _is(o, "nullable", True), m.decorator("Id") is not None, _is(o, "unique", True), source=here)
        if m.decorator("Id"):
            column.nullable = False
        column.generated = True if m.decorator("GeneratedValue", "SequenceGenerator") else None
        options = o.get("options")
        if options is not None and options.kind == "obj":
            if (given := options.get("default")) is not None:
                column.default = given.string if given.string is not None else script.of(given)
            if (said := options.get("comment")) is not None:
                column.comment = said.string
        if "enumType" in o:
            column.enum_ref = _class_of(o["enumType"])
        raw.columns.append(column)
        return
    for kind in ("ManyToOne", "OneToOne", "OneToMany", "ManyToMany"):
        if (o := _of(m, kind)) is not None:
            break
    else:
        return
    target = _class_of(o.get("targetEntity") or o.get("0")) or (declared.rpartition(".")[2] if declared not in ("", "mixed", "Collection", "iterable", "array") else None)
    if not target or "mappedBy" in o or kind == "OneToMany":
        return
    own, other = Ref(model=c.name), Ref(model=target)
    if kind == "ManyToMany":
        table = _of(m, "JoinTable") or {}
        through = _text(table, "name", "0") or f"{raw.name}_{default_table('doctrine', target)}"
        out.relations.append(RawRelation(own, other, cardinality="many-to-many", kind="orm", through=Ref(through, schema=_text(table, "schema")), navigation=m.name, source=here))
        return
    joins = [_values(d) for d in m.decorators if d.tail == "JoinColumn"] or [{}]
    nullable = not any(_is(j, "nullable", False) for j in joins) and m.decorator("Id") is None
    names = [_text(j, "name", "0") or f"{snake(m.name)}_id" for j in joins]
    for name, j in zip(names, joins):
        raw.columns.append(Column(name, "", nullable, m.decorator("Id") is not None, kind == "OneToOne" or _is(j, "unique", True), source=here))
    to = [_text(j, "referencedColumnName", "1") or "id" for j in joins]
    rule = next((_text(j, "onDelete") for j in joins if "onDelete" in j), None)
    out.relations.append(RawRelation(own, other, names, to, "one-to-one" if kind == "OneToOne" else "many-to-one", "orm", on_delete=rule, optional=nullable, navigation=m.name, source=here))


READERS = {"laravel": SimpleNamespace(detect=laravel_detect, parse=laravel), "doctrine": SimpleNamespace(detect=doctrine_detect, parse=doctrine)}
