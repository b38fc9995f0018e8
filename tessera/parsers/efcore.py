"""Entity Framework Core: entity classes, contexts, configurations, migrations and snapshots."""

from __future__ import annotations

import re
from types import SimpleNamespace
from typing import Any

from tessera.functions.names import short
from tessera.model import Column, Hint, Index, Op, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.parsers.curly import Curly, Decl, Field, node_text
from tessera.parsers.jsast import Node

KIND = "efcore"

# Types of columns, what of them is a value and so never null, engines of providers, names of rules.
VALUES = {
    "int", "long", "short", "byte", "sbyte", "uint", "ulong", "ushort", "bool", "char", "float", "double", "decimal", "Guid", "DateTime", "DateTimeOffset", "DateOnly",
    "TimeOnly", "TimeSpan", "Int16", "Int32", "Int64", "Boolean", "Decimal", "Double", "Single", "Byte", "Instant", "LocalDate", "LocalDateTime", "Ulid",
}
SCALARS = VALUES | {"string", "String", "object", "Uri", "JsonDocument", "JsonElement", "NpgsqlTsVector", "IPAddress", "Point", "Geometry", "HierarchyId", "XmlDocument", "Vector"}
COLLECTIONS = {"List", "ICollection", "IList", "IEnumerable", "Collection", "HashSet", "ISet", "IReadOnlyCollection", "IReadOnlyList", "ObservableCollection", "ObservableHashSet", "SortedSet"}
PROVIDERS = {"UseSqlServer": "sqlserver", "UseNpgsql": "postgresql", "UseSqlite": "sqlite", "UseMySql": "mysql", "UseMySQL": "mysql", "UseOracle": "oracle", "UseCosmos": "cosmosdb", "UseAzureSql": "sqlserver"}
RULES = {"Cascade": "CASCADE", "ClientCascade": "CASCADE", "SetNull": "SET NULL", "ClientSetNull": "SET NULL", "Restrict": "RESTRICT", "NoAction": "NO ACTION", "ClientNoAction": "NO ACTION", "SetDefault": "SET DEFAULT"}
#: Configuration calls that begin something new.
STARTS = {"ToTable", "ToView", "Property", "HasKey", "HasAlternateKey", "HasNoKey", "HasIndex", "HasOne", "HasMany", "OwnsOne", "OwnsMany", "HasQueryFilter", "Ignore", "HasDiscriminator", "HasData"}
NOT_ENTITIES = re.compile(r"(?:Controller|Service|Repository|Exception|Attribute|Validator|Handler|Middleware|Factory|Profile|Hub|PageModel|ComponentBase|Startup|Program|Tests?)$")


def detect(path: str, text: str) -> bool:
    if not path.endswith(".cs") or path.endswith((".Designer.cs", ".g.cs")):
        return False
    if re.search(r":\s*(?:\w+\.)*\w*(?:DbContext)\b|\bDbSet<|:\s*(?:\w+\.)*Migration\b|\bMigrationBuilder\b|\bModelSnapshot\b|\bIEntityTypeConfiguration<", text):
        return True
    if "Microsoft.EntityFrameworkCore" in text or "System.ComponentModel.DataAnnotations.Schema" in text:
        return bool(re.search(r"\[\s*(?:Table|Key|Column|ForeignKey|Index|Owned|Keyless)\b", text))
    return bool(re.search(r"\bpublic\s+(?:(?:abstract|sealed|partial)\s+)*(?:class|record)\s+\w+", text) and (re.search(r"\{\s*get;", text) or re.search(r"\brecord\s+\w+\s*\(", text)))


def parse(path: str, text: str) -> Parsed:
    migration = bool(re.search(r":\s*(?:\w+\.)*Migration\b|\bmigrationBuilder\b", text)) and "ModelSnapshot" not in text
    out = Parsed(path, KIND, "migration" if migration else "definition")
    if path.endswith((".Designer.cs", ".g.cs")):
        return out
    text = re.sub(r'@"((?:[^"]|"")*)"', lambda m: '"' + m[1].replace("\\", "/").replace('""', "'").replace("\n", " ") + '"' + "\n" * m[1].count("\n"), text)
    reader = _Reader(Curly(path, text, "cs"), out, bool(re.search(r"#nullable enable|\bstring\?|=\s*null!|=\s*default!|\brequired\s", text)))
    reader.read()
    return out


class _Reader:
    def __init__(self, script: Curly, out: Parsed, strict: bool):
        #: ``strict``: reference types without a question mark are never null.
        self.script, self.out, self.strict = script, out, strict

    def read(self) -> None:
        decls = list(self.script.declarations())
        if re.search(r"DbContext|DbSet<", self.script.text):
            self.providers()
        self.enums = {d.name: d for d in decls if d.kind == "enum"}
        for d in decls:
            bases = [b for b, _, _ in d.bases]
            config = next((g for b, g, _ in d.bases if b == "IEntityTypeConfiguration"), None)
            members = self.script.fields(d) if d.kind != "enum" else []
            methods = {f.name: f for f in members if f.method and f.body}
            if "Migration" in bases or ("Up" in methods and "MigrationBuilder" in self.script.text):
                if "Up" in methods:
                    self.migration(*methods["Up"].body)
            elif "ModelSnapshot" in bases and "BuildModel" in methods:
                self.fluent(methods["BuildModel"].body, None, {})
            elif config and "Configure" in methods:
                body = methods["Configure"].body
                self.fluent(body, self.parameter(body) or "builder", {self.parameter(body) or "builder": short(config)})
            elif any(b.endswith("DbContext") for b in bases) or any(f.type.startswith("DbSet<") for f in members):
                self.context(members, methods)
            elif d.kind in ("class", "record") and self.plausible(d, members):
                self.entity(d, members)

    def parameter(self, body: tuple[int, int]) -> str | None:
        """The name of the last parameter of the method with this body."""
        i = body[0] - 1
        while i > 0 and not self.script.is_(i, ")"):
            i -= 1
        return self.script.tokens[i - 1].text if i > 0 else None

    def providers(self) -> None:
        s = self.script
        for i, t in enumerate(s.tokens):
            if t.kind == "name" and t.text in PROVIDERS and s.is_(i - 1, ".") and s.is_(i + 1, "(") and not any(h.engine == PROVIDERS[t.text] for h in self.out.engines):
                self.out.engines.append(Hint(PROVIDERS[t.text], s.line(i), t.text))

    # Classes

    def plausible(self, d: Decl, members: list[Field]) -> bool:
        marked = d.mark("Table", "Index", "Owned", "Keyless", "PrimaryKey") or any(f.mark("Key", "Column", "ForeignKey") for f in members)
        if d.mark("NotMapped") or "static" in d.modifiers or (NOT_ENTITIES.search(d.name) and not marked):
            return False
        return bool(marked) or any(not f.method and ("property" in f.modifiers or d.kind == "record") for f in members)

    def entity(self, d: Decl, members: list[Field]) -> None:
        s, table = self.script, d.mark("Table")
        name = s.text_of(table, "name", place=0)
        e = RawEntity(name or d.name, "table", schema=s.text_of(table, "Schema"), model_name=d.name, name_certainty=2 if name else 0, candidate=True, abstract="abstract" in d.modifiers, source=s.source(d.at), comment=s.comment(d.at))
        parent = next((b for b, _, _ in d.bases if not re.match(r"I[A-Z]", b)), None)
        e.extends = [parent] if parent else []
        params = {k for a, b in (s.parts(d.params) if d.params is not None and d.kind == "record" else []) for k in range(a, b)}
        props = [f for f in members if not f.method and ("property" in f.modifiers or f.at in params) and "static" not in f.modifiers and "computed" not in f.modifiers and not f.mark("NotMapped")]
        of = {f.name: f for f in props}
        for f in props:
            self.prop(d, f, of, e)
        for m in d.marks:
            if m.name == "Index":
                columns = [t for span in m.plain for t in self.names(span)]
                if columns:
                    e.indexes.append(Index(columns, s.word_of(m, "IsUnique") == "true", s.text_of(m, "Name")))
            elif m.name == "PrimaryKey":
                for n in [t for span in m.plain for t in self.names(span)]:
                    for c in e.columns:
                        if c.name == n:
                            c.primary_key, c.nullable = True, False
        self.out.entities.append(e)
        if d.mark("Owned"):
            self.out.relations.append(RawRelation(Ref(model=d.name), Ref(model=d.name), kind="orm", owned=True, source=e.source))

    def names(self, span: tuple[int, int]) -> list[str]:
        """Names in strings and in ``nameof``."""
        tokens = self.script.tokens
        return [self.script.expr(i, i + 1).string or "" if tokens[i].kind == "string" else tokens[i].text for i in range(*span) if tokens[i].kind == "string" or (tokens[i].kind == "name" and self.script.is_(i + 1, ")"))]

    def prop(self, d: Decl, f: Field, of: dict[str, Field], e: RawEntity) -> None:
        s, here = self.script, self.script.source(f.at)
        optional, bare = f.type.rstrip().endswith("?"), f.bare
        outer = re.sub(r"<.*", "", f.type).rstrip("? ").rpartition(".")[2]
        if outer == "Nullable" and f.inner:
            optional, bare, outer = True, f.inner, f.inner
        array = f.type.rstrip("? ").endswith("[]")
        if outer in COLLECTIONS and f.inner and f.inner not in SCALARS and f.inner not in self.enums:
            self.out.relations.append(RawRelation(Ref(model=d.name), Ref(model=f.inner), cardinality="one-to-many", kind="orm", navigation=f.name, source=here))
            return
        element = bare.removesuffix("[]").strip()
        if not array and outer not in COLLECTIONS and element not in SCALARS and element not in self.enums and not f.mark("Column") and "<" not in f.type:
            self.navigation(d, f, element, of, here)
            return
        m = f.mark("Column")
        name = s.text_of(m, "Name", place=0) or f.name
        primary = f.mark("Key") is not None or (f.name.lower() in ("id", f"{d.name}id".lower()) and not any(x.mark("Key") for x in of.values()) and not d.mark("Keyless"))
        value = (element in VALUES or element in self.enums) and not array
        nullable = optional or (not value and not self.strict and "required" not in f.modifiers)
        if f.mark("Required") or primary:
            nullable = False
        size = f.mark("MaxLength", "StringLength")
        type_ = s.text_of(m, "TypeName") or f.type.rstrip("? ")
        column = Column(name, type_, nullable, primary, source=here, comment=s.text_of(f.mark("Comment"), place=0) or s.comment(f.at))
        if size is not None and size.plain and not s.text_of(m, "TypeName"):
            column.type += f"({s.between(*size.plain[0])})"
        generated = f.mark("DatabaseGenerated")
        if generated is not None and generated.plain:
            column.generated = True if s.tokens[generated.plain[0][1] - 1].text in ("Identity", "Computed") else None
        column.unique = False
        if element in self.enums:
            column.enum_ref = element
            if not any(x.name == element for x in self.out.enums):
                self.out.enums.append(RawEnum(element, s.enum_values(self.enums[element]), source=s.source(self.enums[element].at)))
        e.columns.append(column)

    def navigation(self, d: Decl, f: Field, target: str, of: dict[str, Field], here: Source) -> None:
        if "property" not in f.modifiers:
            return
        s, named = self.script, f.mark("ForeignKey")
        given = [x.strip() for x in ((s.texts(named.plain[0]) or self.names(named.plain[0]) or [""])[0] if named and named.plain else "").split(",") if x.strip()]
        back = next((k for k, x in of.items() if (m := x.mark("ForeignKey")) and m.plain and f.name in self.names(m.plain[0])), None)
        keys = given or ([back] if back else []) or [k for k in (f"{f.name}Id", f"{f.name}ID", f"{f.name}{target}Id", f"{target}Id", f"{target}ID") if k in of][:1] or [f"{f.name}Id"]
        key = of.get(keys[0])
        column = lambda k: s.text_of(of[k].mark("Column"), "Name", place=0) or k if k in of else k
        optional = key.type.rstrip().endswith("?") if key is not None else f.type.rstrip().endswith("?") or not (self.strict or f.mark("Required"))
        self.out.relations.append(RawRelation(Ref(model=d.name), Ref(model=target), [column(k) for k in keys], kind="orm", optional=optional, navigation=f.name, source=here))

    # Contexts

    def context(self, members: list[Field], methods: dict[str, Field]) -> None:
        for f in members:
            m = re.match(r"DbSet<\s*(?:[\w.]*\.)?(\w+)\s*>", f.type)
            if m:
                self.out.entities.append(RawEntity(f.name, "table", model_name=m[1], name_certainty=1, partial=True, source=self.script.source(f.at)))
        if "OnModelCreating" in methods:
            self.fluent(methods["OnModelCreating"].body, None, {})

    def fluent(self, body: tuple[int, int], variable: str | None, known: dict[str, str]) -> None:
        """``Entity<T>`` and the variables that stand for such."""
        s = self.script
        spans: list[tuple[int, int]] = []
        for i in range(*body):
            if any(a <= i < b for a, b in spans):
                continue
            t = s.tokens[i]
            if t.kind != "name" or s.is_(i - 1, "."):
                continue
            if t.text in known:
                self.entity_steps(i, known[t.text])
                continue
            if not s.is_(i + 1, ".") or not s.is_(i + 2, "Entity"):
                continue
            k, model = i + 3, None
            if s.is_(k, "<"):
                stop = s.angle(k)
                model, k = short(s.between(k + 1, stop - 1)), stop
            if not s.is_(k, "("):
                continue
            args = s.parts(k)
            if model is None and args:
                first = s.expr(*args[0])
                model = short(first.string) if first.string else None
            if not model:
                continue
            builder = next((n for n in (s.expr(a, b) for a, b in args) if n.kind == "fn"), None)
            if builder is not None:
                (a, b), inner = builder.items[0], builder.items[1]
                spans.append((k, s._close[k]))
                self.steps_in(inner, s.tokens[a].text if a < b else "", model)
            self.steps(k, min(s._close[k] + 1, body[1]), model)

    def steps_in(self, span: tuple[int, int], variable: str, model: str) -> None:
        skip = span[0]
        for i in range(*span):
            if i >= skip and self.script.is_(i, variable) and not self.script.is_(i - 1, "."):
                skip = self.entity_steps(i, model)

    def entity_steps(self, i: int, model: str) -> int:
        return self.steps(i, i + 1, model)

    def steps(self, begin: int, i: int, model: str) -> int:
        """The calls that follow a token: ``.Property(...).HasColumnName(...)``."""
        s, calls = self.script, []
        while s.is_(i, ".") and i + 1 < len(s.tokens):
            name, k, generic = s.tokens[i + 1].text, i + 2, None
            if s.is_(k, "<"):
                stop = s.angle(k)
                generic, k = s.between(k + 1, stop - 1), stop
            if not s.is_(k, "("):
                break
            calls.append((name, generic, k))
            i = min(s._close[k] + 1, len(s.tokens))
        starts = [n for n, c in enumerate(calls) if n == 0 or c[0] in STARTS]
        for a, b in zip(starts, [*starts[1:], len(calls)]):
            _Config(self, model, s.source(begin)).apply(calls[a:b])
        return max(i, begin + 1)

    # Migrations

    def migration(self, begin: int, end: int) -> None:
        s = self.script
        for i in range(begin, end):
            if s.tokens[i].kind == "name" and s.is_(i - 1, ".") and s.is_(i - 2, "migrationBuilder"):
                k = i + 1
                generic = None
                if s.is_(k, "<"):
                    stop = s.angle(k)
                    generic, k = s.between(k + 1, stop - 1), stop
                if s.is_(k, "("):
                    self.change(s.tokens[i].text, generic, k, s.source(i))

    def text(self, named: dict[str, tuple[int, int]], key: str, plain: list[tuple[int, int]] = [], place: int | None = None) -> str | None:
        span = named.get(key) or (plain[place] if place is not None and len(plain) > place else None)
        return (self.script.texts(span) or [None])[0]

    def column(self, name: str, generic: str | None, named: dict[str, tuple[int, int]], here: Source) -> Column:
        s = self.script
        says = lambda key, word: key in named and s.between(*named[key]) == word
        column = Column(self.text(named, "name") or name, self.text(named, "type") or (generic or "").rstrip("?"), not says("nullable", "false"), source=here)
        column.default = self.text(named, "defaultValueSql") or (node_text(s, s.expr(*named["defaultValue"])) if "defaultValue" in named else None)
        column.comment = self.text(named, "comment")
        if "computedColumnSql" in named:
            column.generated = True
        return column

    def annotated(self, i: int) -> set[str]:
        """First strings of the ``Annotation`` calls behind a call."""
        s, out = self.script, set()
        while s.is_(i, ".") and s.is_(i + 1, "Annotation", "OldAnnotation") and s.is_(i + 2, "("):
            out |= set(s.texts((i + 3, s._close[i + 2]))[:1]) if s.is_(i + 1, "Annotation") else set()
            i = s._close[i + 2] + 1
        return out

    def change(self, kind: str, generic: str | None, opening: int, here: Source) -> None:
        s, ops = self.script, self.out.ops
        plain, named = s.arguments(opening)
        table = self.text(named, "table", plain, 1)
        schema = self.text(named, "schema")
        name = self.text(named, "name", plain, 0)
        ref = lambda: Ref(table, schema=schema)
        match kind:
            case "CreateTable" if name:
                self.create(name, schema, named, here)
            case "DropTable" if name:
                ops.append(Op("dropTable", Ref(name, schema=schema), source=here))
            case "RenameTable" if name:
                new = self.text(named, "newName", plain, 1)
                if new:
                    ops.append(Op("renameTable", Ref(name, schema=schema), to=new, source=here))
            case "AddColumn" if name and table:
                column = self.column(name, generic, named, here)
                column.generated = True if any(re.search(r"Identity|ValueGenerat|Autoincrement", a) for a in self.annotated(min(s._close[opening] + 1, len(s.tokens)))) else column.generated
                self.out.entities.append(RawEntity(table, "table", schema=schema, partial=True, columns=[column], source=here))
            case "DropColumn" if name and table:
                ops.append(Op("dropColumn", ref(), name, source=here))
            case "RenameColumn" if name and table:
                new = self.text(named, "newName", plain, 2)
                if new:
                    ops.append(Op("renameColumn", ref(), name, new, source=here))
            case "AlterColumn" if name and table:
                column = self.column(name, generic, named, here)
                patch: dict[str, Any] = {"type": column.type} if column.type else {}
                patch["nullable"] = column.nullable
                patch |= {k: v for k, v in (("default", column.default), ("comment", column.comment)) if v is not None}
                ops.append(Op("alterColumn", ref(), name, set=patch, source=here))
            case "CreateIndex" if table:
                columns = self.texts_of(named, "column", "columns") or (s.texts(plain[2]) if len(plain) > 2 else [])
                if columns:
                    unique = "unique" in named and s.between(*named["unique"]) == "true" and "filter" not in named
                    self.out.entities.append(RawEntity(table, "table", schema=schema, partial=True, indexes=[Index(columns, unique, name)], source=here))
            case "AddForeignKey" if table:
                self.foreign(Ref(table, schema=schema), named, self.texts_of(named, "column", "columns"), here)
            case "DropForeignKey" if table:
                ops.append(Op("dropForeignKey", ref(), name=name, source=here))
            case "AddPrimaryKey" if table:
                ops += [Op("alterColumn", ref(), c, set={"primary_key": True}, source=here) for c in self.texts_of(named, "column", "columns")]

    def texts_of(self, named: dict[str, tuple[int, int]], *keys: str) -> list[str]:
        return [t for k in keys for t in self.script.texts(named.get(k))]

    def foreign(self, own: Ref, named: dict[str, tuple[int, int]], columns: list[str], here: Source) -> None:
        target = self.text(named, "principalTable")
        if target and columns:
            rule = lambda k: RULES.get(self.script.tokens[named[k][1] - 1].text) if k in named else None
            to = self.texts_of(named, "principalColumn", "principalColumns")
            self.out.relations.append(RawRelation(own, Ref(target, schema=self.text(named, "principalSchema")), columns, to, name=self.text(named, "name"), on_delete=rule("onDelete"), on_update=rule("onUpdate"), source=here))

    def create(self, name: str, schema: str | None, named: dict[str, tuple[int, int]], here: Source) -> None:
        s = self.script
        e = RawEntity(name, "table", schema=schema, comment=self.text(named, "comment"), source=here)
        props: dict[str, Column] = {}
        for i in range(*named.get("columns", (0, 0))):
            if s.is_(i, "Column") and s.is_(i - 1, ".") and s.is_(i - 3, "=") and i >= 4:
                k, generic = i + 1, None
                if s.is_(k, "<"):
                    stop = s.angle(k)
                    generic, k = s.between(k + 1, stop - 1), stop
                if s.is_(k, "("):
                    prop = s.tokens[i - 4].text
                    column = self.column(prop, generic, s.arguments(k)[1], s.source(i - 4))
                    if any(re.search(r"Identity|ValueGenerat|Autoincrement", a) for a in self.annotated(min(s._close[k] + 1, len(s.tokens)))):
                        column.generated = True
                    props[prop] = column
                    e.columns.append(column)
        for i in range(*named.get("constraints", (0, 0))):
            if not (s.is_(i, "PrimaryKey", "ForeignKey", "UniqueConstraint") and s.is_(i - 1, ".") and s.is_(i + 1, "(")):
                continue
            plain, more = s.arguments(i + 1)
            spans = [more[k] for k in ("column", "columns") if k in more] or plain[1:2]
            columns = [props[m].name for span in spans for m in self.lambda_names(span) if m in props]
            if s.is_(i, "PrimaryKey"):
                for c in e.columns:
                    if c.name in columns:
                        c.primary_key, c.nullable = True, False
            elif s.is_(i, "ForeignKey"):
                more.setdefault("name", plain[0] if plain else (0, 0))
                self.foreign(Ref(name, schema=schema), more, columns, s.source(i))
            elif columns:
                e.indexes.append(Index(columns, True, (s.texts(more.get("name")) or (s.texts(plain[0]) if plain else []) or [None])[0]))
        self.out.entities.append(e)

    def lambda_names(self, span: tuple[int, int]) -> list[str]:
        """Members of ``x => x.A`` and ``x => new { x.A, x.B }``, or strings."""
        s = self.script
        named = [s.tokens[i].text for i in range(span[0] + 1, span[1]) if s.tokens[i].kind == "name" and s.is_(i - 1, ".") and s.tokens[i - 2].kind == "name" and s.tokens[i - 2].text == s.tokens[span[0]].text]
        return named or s.texts(span)


class _Config:
    """One chain of configuration calls on an entity."""

    def __init__(self, reader: _Reader, model: str, here: Source):
        self.r, self.s, self.out, self.model, self.here = reader, reader.script, reader.out, model, here

    def partial(self, **values: Any) -> RawEntity:
        e = RawEntity(values.pop("name", self.model), "table", model_name=self.model, name_certainty=values.pop("certainty", 0), partial=True, source=self.here, **values)
        self.out.entities.append(e)
        return e

    def apply(self, calls: list[tuple[str, str | None, int]]) -> None:
        name, generic, opening = calls[0]
        plain, named = self.s.arguments(opening)
        args = [self.s.expr(a, b) for a, b in plain]
        first = args[0].string if args else None
        listed = [n for span in plain[:1] for n in self.r.lambda_names(span)] if name not in ("ToTable", "ToView", "HasOne", "HasMany") else []
        match name:
            case "ToTable" | "ToView" if first:
                schema = self.r.text(named, "schema") or (args[1].string if len(args) > 1 else None)
                self.partial(name=first, certainty=2, schema=schema)
            case "Property" if listed or first:
                self.property(listed[0] if listed else first or "", generic, calls[1:])
            case "HasKey":
                keys = listed if len(plain) < 2 else [t for span in plain for t in self.r.script.texts(span)]
                self.out.ops += [Op("alterColumn", Ref(model=self.model), k, set={"primary_key": True, "nullable": False}, source=self.here) for k in keys]
            case "HasIndex":
                columns = listed if len(plain) < 2 else [t for span in plain for t in self.s.texts(span)] or listed
                more = {n: k for n, _, k in calls[1:]}
                unique = "IsUnique" in more and "false" not in [t.text for t in self.s.tokens[more["IsUnique"] : self.s._close[more["IsUnique"]]]]
                label = (self.s.texts((more["HasDatabaseName"], self.s._close[more["HasDatabaseName"]])) or [None])[0] if "HasDatabaseName" in more else None
                if columns:
                    self.partial(indexes=[Index(columns, unique and "HasFilter" not in more, label)])
            case "OwnsOne" | "OwnsMany":
                nav = (self.r.lambda_names(plain[0]) or [None])[-1] if plain else None
                target = short(generic) if generic else short(first) if first and len(args) > 1 and args[1].string else None
                self.out.relations.append(RawRelation(Ref(model=self.model), Ref(model=target), kind="orm", name=args[1].string if len(args) > 1 and args[1].string else nav or first, owned=True, source=self.here))
            case "HasOne" | "HasMany":
                self.relation(name, generic, plain, args, calls[1:])
            case "HasComment" if first:
                self.partial(comment=first)

    def property(self, prop: str, generic: str | None, calls: list[tuple[str, str | None, int]]) -> None:
        s, patch, rename = self.s, {}, None
        for name, _, k in calls:
            plain, _ = s.arguments(k)
            value = s.expr(*plain[0]) if plain else None
            text = value.string if value is not None else None
            match name:
                case "HasColumnName" if text:
                    rename = text
                case "HasColumnType" if text:
                    patch["type"] = text
                case "IsRequired":
                    patch["nullable"] = value is not None and value.false
                case "HasMaxLength" if value is not None and generic and "type" not in patch:
                    patch["type"] = f"{generic.rstrip('?')}({s.of(value)})"
                case "HasDefaultValueSql" | "HasDefaultValue" if value is not None:
                    patch["default"] = text if text is not None else s.of(value)
                case "HasComment" if text:
                    patch["comment"] = text
                case "ValueGeneratedOnAdd" | "UseIdentityColumn" | "UseIdentityByDefaultColumn" | "UseIdentityAlwaysColumn" | "ValueGeneratedOnAddOrUpdate" | "HasComputedColumnSql":
                    patch["generated"] = True
        if generic is not None:
            nullable = patch.get("nullable", generic.endswith("?") or generic.rstrip("?") not in VALUES)
            column = Column(rename or prop, patch.get("type", generic.rstrip("?")), nullable, generated=patch.get("generated"), default=patch.get("default"), comment=patch.get("comment"), source=self.here)
            known = next((e for e in reversed(self.out.entities) if e.model_name == self.model and e.columns), None)
            (known.columns.append(column) if known else self.partial(columns=[column]))
            return
        if patch:
            self.out.ops.append(Op("alterColumn", Ref(model=self.model), prop, set=patch, source=self.here))
        if rename and rename != prop:
            self.out.ops.append(Op("renameColumn", Ref(model=self.model), prop, rename, source=self.here))

    def relation(self, kind: str, generic: str | None, plain: list[tuple[int, int]], args: list[Node], calls: list[tuple[str, str | None, int]]) -> None:
        s = self.s
        steps = {n: k for n, _, k in calls}
        nav = args[-1].string if len(args) > 1 else (self.r.lambda_names(plain[0]) or [None])[-1] if plain and not args[0].string else args[0].string if args and generic else None
        target = short(generic) if generic else short(args[0].string) if args and args[0].string and (len(args) > 1 or "." in args[0].string) else None
        if target is None and nav:
            made = next((r for r in self.out.relations if r.navigation == nav and r.from_.model == self.model), None)
            target = made.to.model if made else nav if kind == "HasOne" else None
        through = next((n for n in ("WithMany", "WithOne") if n in steps), None)
        if target is None or through is None:
            return
        key, rule = steps.get("HasForeignKey"), steps.get("OnDelete")
        columns = [n for a, b in s.parts(key) for n in self.r.lambda_names((a, b))] if key else []
        principal = steps.get("HasPrincipalKey")
        to = [n for a, b in s.parts(principal) for n in self.r.lambda_names((a, b))] if principal else []
        on_delete = RULES.get(s.tokens[s._close[rule] - 1].text) if rule and s._close[rule] <= len(s.tokens) else None
        own, other = Ref(model=self.model), Ref(model=target)
        more = {"kind": "orm", "on_delete": on_delete, "source": self.here}
        if kind == "HasMany" and through == "WithMany":
            using = steps.get("UsingEntity")
            table = (s.texts(s.parts(using)[0]) or [None])[0] if using and s.parts(using) else None
            self.out.relations.append(RawRelation(own, other, cardinality="many-to-many", through=Ref(table) if table else None, **more))
        elif kind == "HasMany":
            self.out.relations.append(RawRelation(other, own, columns, to, **more))
        elif through == "WithMany":
            optional = None if "IsRequired" not in steps else any(t.text == "false" for t in s.tokens[steps["IsRequired"] : s._close[steps["IsRequired"]]])
            self.out.relations.append(RawRelation(own, other, columns, to, optional=optional, navigation=nav, **more))
        else:
            generic_key = next((g for n, g, _ in calls if n == "HasForeignKey"), None)
            depends = key is not None and not (generic_key and short(generic_key) != self.model)
            first = s.texts(s.parts(key)[0]) if key and s.parts(key) else []
            if len(first) == 1 and key and len(s.parts(key)) > 1:
                depends, columns = short(first[0]) == self.model, [t for a, b in s.parts(key)[1:] for t in s.texts((a, b))]
            a, b = (own, other) if depends else (other, own)
            self.out.relations.append(RawRelation(a, b, columns, to, "one-to-one", **more))


READERS = {KIND: SimpleNamespace(detect=detect, parse=parse)}
