"""Text exports of resolved models: Mermaid, Markdown, DBML, PlantUML, JSON.

A document is rendered from one workspace's model; ``export_models`` renders
all workspaces side by side.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators.scan import ENGINES

#: Characters that a diagram may have before columns are left out.
MOST_CHARS = 45_000
MANY = "many-to-many"

# Words that a Mermaid entity can't be called without quotes.
RESERVED = (
    "end", "style", "classdef", "class", "erdiagram", "subgraph", "direction", "one", "many", "zero", "to", "or", "only", "optionally",
    "title", "acctitle", "accdescr", "click",
)
LABELS = {
    "sql": "SQL", "dbml": "DBML", "diesel": "Diesel", "liquibase": "Liquibase", "prisma": "Prisma", "typeorm": "TypeORM", "mikroorm": "MikroORM", "drizzle": "Drizzle",
    "sequelize": "Sequelize", "mongoose": "Mongoose", "knex": "Knex", "kysely": "Kysely", "django": "Django", "sqlalchemy": "SQLAlchemy", "sqlmodel": "SQLModel",
    "peewee": "Peewee", "tortoise": "Tortoise ORM", "rails": "Rails", "laravel": "Laravel", "doctrine": "Doctrine", "ecto": "Ecto", "gorm": "GORM", "ent": "Ent", "bun": "Bun",
    "seaorm": "SeaORM", "jpa": "JPA", "exposed": "Exposed", "efcore": "EF Core", "hibernate": "Hibernate", "doctrinemap": "Doctrine mapping", "graphql": "GraphQL",
    "zenstack": "ZenStack", "mongovalidator": "MongoDB validator",
}


# Sentences of the Markdown document, which readers of its changes expect word by word.
GENERATED = "> Generated on {} from the schema definitions in this repository. Re-export instead of editing by hand."
NOTHING = "_No database schema was detected._"
REDUCED = {
    "keys": "_The schema is large, so the diagram only lists key columns. All columns are listed below._",
    "none": "_The schema is large, so the diagram only shows tables and relations. Columns are listed below._",
}


@dataclass(frozen=True)
class Choice:
    """What goes into a document."""

    entity_ids: tuple[str, ...] | None = None
    inferred: bool = True
    external: bool = True
    columns: str = "auto"
    most_chars: int = MOST_CHARS


def qualified(x: dict) -> str:
    return f"{x['schema']}.{x['name']}" if x.get("schema") else x["name"]


def keys(c: dict) -> list[str]:
    return [k for k, holds in (("PK", c["primary_key"]), ("FK", c.get("references")), ("UK", c["unique"] and not c["primary_key"])) if holds]


def shown_type(c: dict) -> str:
    type_ = c.get("type", "")
    return f"{type_}[]" if c.get("is_array") and type_ and not re.search(r"(?i)\[\]$|^array|<.*>$|\[$", type_) else type_


# Mermaid


def mermaid_type(type_: str) -> str:
    out = re.sub(r"[\"'`]", "", type_.strip()).replace("<", "[").replace(">", "]")
    out = re.sub(r"\s+", "_", re.sub(r"\s*,\s*", "-", out))
    out = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_\-()\[\]]", "_", out)).strip("_")
    if not out:
        return "unknown"
    return out if re.match(r"[A-Za-z]", out) and not re.fullmatch(r"(?i)[pfu]k", out) else f"t_{out}"


def mermaid_name(name: str) -> str:
    out = re.sub(r"[^A-Za-z0-9_-]", "_", name.strip())
    if not out:
        return "unnamed"
    out = out if re.match(r"[A-Za-z_]", out) else f"_{out}"
    return f"{out}_" if re.fullmatch(r"(?i)[pfu]k", out) else out


def mermaid_text(text: str, most: int) -> str:
    out = re.sub(r"\s+", " ", text.replace('"', "'")).strip()
    return out if len(out) <= most else out[: most - 1] + "…"


def _token(name: str) -> str:
    if re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", name) and name.lower() not in RESERVED:
        return name
    return '"' + (re.sub(r"[\"%\\\r\n\v\b]", "", name).strip() or "entity") + '"'


def _unique(base: str, used: set[str], numbered) -> str:
    out, n = base, 2
    while out.lower() in used:
        out, n = numbered(base, n), n + 1
    used.add(out.lower())
    return out


def _ends(r: dict) -> str:
    line = ".." if r["kind"] == "inferred" else "--"
    if r["cardinality"] == MANY:
        return f"}}o{line}o{{"
    return ("|o" if r["cardinality"] == "one-to-one" else "}o") + line + ("o|" if r["optional"] else "||")


def _mermaid(model: dict, choice: Choice, columns: str) -> str:
    wanted = [e for e in model["entities"] if (choice.entity_ids is None or e["id"] in choice.entity_ids) and (choice.external or not e.get("external"))]
    used: set[str] = set()
    tokens = {e["id"]: _unique(_token(qualified(e)), used, lambda b, n: f'{b[:-1]} ({n})"' if b.startswith('"') else f"{b}_{n}") for e in wanted}
    lines = ["erDiagram"]
    for e in wanted:
        shown = {"none": [], "keys": [c for c in e["columns"] if keys(c)]}.get(columns, e["columns"])
        if not shown:
            lines.append(f"    {tokens[e['id']]}")
            continue
        lines.append(f"    {tokens[e['id']]} {{")
        names: set[str] = set()
        for c in shown:
            parts = [mermaid_type(shown_type(c) or "unknown"), _unique(mermaid_name(c["name"]), names, lambda b, n: f"{b}_{n}")]
            if keys(c):
                parts.append(", ".join(keys(c)))
            if c.get("comment"):
                parts.append(f'"{mermaid_text(c["comment"], 80)}"')
            lines.append("        " + " ".join(parts))
        lines.append("    }")
    for r in model["relations"]:
        if r["from"] not in tokens or r["to"] not in tokens or (r["kind"] == "inferred" and not choice.inferred):
            continue
        label = ", ".join(r["from_columns"])
        if r["cardinality"] == MANY:
            if r.get("through") in tokens:
                continue
            label = f"via {r['through_name']}" if r.get("through_name") else MANY
        lines.append(f'    {tokens[r["from"]]} {_ends(r)} {tokens[r["to"]]} : "{mermaid_text(label, 60)}"')
    return "\n".join(lines)


def mermaid_with_mode(model: dict, choice: Choice = Choice()) -> tuple[str, str]:
    """The diagram and its column mode: all columns, keys, or none, the first that is short enough."""
    if choice.columns != "auto":
        return _mermaid(model, choice, choice.columns), choice.columns
    for mode in ("all", "keys", "none"):
        text = _mermaid(model, choice, mode)
        if len(text) <= choice.most_chars:
            break
    return text, mode


def to_mermaid(model: dict, choice: Choice = Choice()) -> str:
    return mermaid_with_mode(model, choice)[0]


# Markdown


def cell(text: str | None) -> str:
    return re.sub(r"\r?\n", " ", (text or "").replace("\\", "\\\\").replace("|", "\\|").replace("<", "&lt;"))


def heading(text: str) -> str:
    special = {"<": "&lt;", "&": "&amp;"}
    return re.sub(r"[\\`*_{}\[\]<>#|~&!]", lambda m: special.get(m[0], "\\" + m[0]), re.sub(r"\s+", " ", text).strip())


def code(text: str | None) -> str:
    if not text:
        return ""
    out = re.sub(r"\r?\n", " ", text).replace("|", "\\|")
    return f"`` {out} ``" if "`" in out else f"`{out}`"


def slugs(headings: Iterable[str]) -> list[str]:
    """Anchors of headings; repeated ones are numbered."""
    seen: Counter[str] = Counter()
    out = []
    for text in headings:
        base = re.sub(r"[^\w -]", "", text.lower()).replace(" ", "-")
        out.append(base if not seen[base] else f"{base}-{seen[base]}")
        seen[base] += 1
    return out


def href(path: str) -> str:
    path, anchor = re.fullmatch(r"(.*?)(#L\d+)?", path, re.S).groups()
    return quote(path, safe="/:;,@&=+$-_.!~*'") + (anchor or "")


def count_text(model: dict) -> str:
    """How many tables, views, collections, relations and enums there are."""
    kinds = Counter(e["kind"] for e in model["entities"] if not e.get("external"))
    some = lambda n, one: f"{n} {one}" + ("" if n == 1 else "s")
    parts = [some(kinds["table"], "table")] if kinds["table"] or not (kinds["view"] or kinds["collection"]) else []
    parts += [some(kinds[k], k) for k in ("view", "collection") if kinds[k]] + [some(len(model["relations"]), "relation")]
    return " · ".join(parts + ([some(len(model["enums"]), "enum")] if model["enums"] else []))


def adjacency(model: dict) -> dict[str, tuple[list[dict], list[dict]]]:
    """Relations out of and into each entity; a many-to-many one goes out of both."""
    out: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    for r in model["relations"]:
        out[r["from"]][0].append(r)
        if r["cardinality"] != MANY:
            out[r["to"]][1].append(r)
        elif r["to"] != r["from"]:
            out[r["to"]][0].append(r)
    return out


def to_markdown(model: dict, name: str = "workspace", generated: str = "", notes: dict | None = None, link=lambda source: None) -> str:
    """Index, diagram, details of every table, enums and databases."""
    notes = notes or {}
    ids = {e["id"]: qualified(e) for e in model["enums"]} | {e["id"]: qualified(e) for e in model["entities"]}
    defined = [e for e in model["entities"] if not e.get("external")]
    title = f"Database map: {name}"
    anchors = dict(zip([e["id"] for e in defined], slugs([title, "Diagram", "Tables", *(re.sub(r"\s+", " ", qualified(e)).strip() or e["id"] for e in defined)])[3:]))
    linked = lambda x: f"[{heading(ids.get(x, x))}](#{anchors[x]})" if x in anchors else heading(ids.get(x, x))

    def place(source: dict | None) -> str:
        if not source:
            return ""
        label, target = code(f"{source['file']}:{source['line'] + 1}"), link(source)
        return f"[{label}]({href(target)})" if target else label

    out = [f"# {title}", "", GENERATED.format(generated), "", f"**{count_text(model)}**", ""]
    if model.get("engines"):
        out += ["**Databases:** " + ", ".join(e["label"] for e in model["engines"]), ""]
    if model.get("sources"):
        out += ["**Detected from:** " + ", ".join(f"{LABELS.get(s['kind'], s['kind'])} ({s['files']} {'file' if s['files'] == 1 else 'files'})" for s in model["sources"]), ""]
    if not model["entities"]:
        return "\n".join([*out, NOTHING, ""])
    diagram, mode = mermaid_with_mode(model)
    out += ["## Diagram", "", *([REDUCED[mode], ""] if mode in REDUCED else []), "```mermaid", diagram, "```", "", "## Tables", "", "| Name | Kind | Columns | Relations | Defined in |", "|---|---|---|---|---|"]
    beside = adjacency(model)
    for e in defined:
        kind = "join table" if e.get("join_table") and e["kind"] == "table" else e["kind"]
        out.append(f"| {linked(e['id'])} | {kind} | {len(e['columns'])} | {sum(map(len, beside[e['id']]))} | {place(e.get('source'))} |")
    out.append("")
    for e in defined:
        note = notes.get(e["id"], {})
        out += [f"### {heading(qualified(e) or e['id'])}", ""]
        out += [cell(e["comment"]), ""] if e.get("comment") else []
        out += [*(f"> {line.replace('<', '&lt;')}" for line in note["table"].split("\n")), ""] if note.get("table") else []
        meta = [f"**Model:** {', '.join(map(code, e['model_names']))}"] if e["model_names"] else []
        meta += [f"**Engine:** {ENGINES.get(e['engine'], (e['engine'],))[0]}"] if e.get("engine") else []
        meta.append("**Source:** " + ", ".join(LABELS.get(s, s) for s in e["sources"]))
        meta += [f"**Defined in:** {place(e['source'])}"] if e.get("source") else []
        out += [" · ".join(meta), ""]
        if e["columns"]:
            out += ["| Column | Type | Nullable | Key | Default | References | Notes |", "|---|---|---|---|---|---|---|"]
            out += [_column_row(c, ids, note.get("columns", {}).get(c["name"])) for c in e["columns"]] + [""]
        else:
            out += ["_No columns are declared in the scanned files._", ""]
        if e["indexes"]:
            listed = (f"{code(i['name']) + ' ' if i.get('name') else ''}({', '.join(map(code, i['columns']))}){' unique' if i['unique'] else ''}" for i in e["indexes"])
            out += ["**Indexes:** " + "; ".join(listed), ""]
        outgoing, incoming = beside[e["id"]]
        plain = [f"{', '.join(map(code, r['from_columns'])) or '?'} → {linked(r['to'])}{' _(inferred)_' if r['kind'] == 'inferred' else ''}" for r in outgoing if r["cardinality"] != MANY]
        back = [linked(r["from"]) + (f" ({', '.join(map(code, r['from_columns']))})" if r["from_columns"] else "") for r in incoming]
        via = lambda r: f" via {linked(r['through']) if r.get('through') else code(r['through_name'])}" if r.get("through_name") else ""
        many = [linked(r["to"] if r["from"] == e["id"] else r["from"]) + via(r) for r in outgoing if r["cardinality"] == MANY]
        for label, items in (("References", plain), ("Referenced by", back), ("Many-to-many", many)):
            out += [f"**{label}:** " + "; ".join(items), ""] if items else []
    external = [e for e in model["entities"] if e.get("external")]
    if external:
        out += ["## Referenced but not defined here", "", "These tables are referenced by relations but defined outside the scanned files (framework tables, other services…).", ""]
        out += [f"- {code(qualified(e))}" for e in external] + [""]
    if model["enums"]:
        out += ["## Enums", "", "| Enum | Values | Defined in |", "|---|---|---|"]
        shown = lambda v: ", ".join(v[:30]) + (f", … (+{len(v) - 30})" if len(v) > 30 else "")
        out += [f"| {code(qualified(e))} | {cell(shown(e['values']))} | {place(e.get('source'))} |" for e in model["enums"]] + [""]
    if model.get("engines"):
        out += ["## Databases", ""]
        for e in model["engines"]:
            shown = "; ".join(f"{cell(x['detail'])} ({place(x)})" for x in e["evidence"][:5])
            out.append(f"- **{e['label']}** ({e['category']}): {shown}" + (f", +{len(e['evidence']) - 5} more" if len(e["evidence"]) > 5 else ""))
        out.append("")
    return "\n".join(out)


def _column_row(c: dict, ids: dict[str, str], note: str | None) -> str:
    ref = c.get("references")
    target = ids.get(ref["entity"], ref["entity"]) + (f".{ref['column']}" if ref.get("column") else "") + (" (inferred)" if ref.get("inferred") else "") if ref else ""
    said = ["generated"] if c.get("generated") else []
    said += [f"enum {ids.get(c['enum_ref'], c['enum_ref'])}"] if c.get("enum_ref") else []
    said += [c["comment"]] if c.get("comment") else []
    said += [f"Note: {note}"] if note else []
    optional = "yes" if c["nullable"] and not c["primary_key"] else ""
    return f"| {code(c['name'])} | {code(shown_type(c))} | {optional} | {', '.join(keys(c))} | {code(c.get('default'))} | {cell(target)} | {cell('; '.join(said))} |"


def strip_volatile(markdown: str) -> str:
    """A document without the lines that change on every export."""
    return "\n".join(line for line in re.split(r"\r?\n", markdown) if not line.startswith(("> Generated ", "_Scanned "))).strip()


# Other diagrams


def _chosen(model: dict, choice: Choice) -> tuple[list[dict], list[dict]]:
    entities = [e for e in model["entities"] if choice.entity_ids is None or e["id"] in choice.entity_ids]
    ids = {e["id"] for e in entities}
    whole = lambda r: r["from"] in ids and r["to"] in ids and r["from_columns"] and r["to_columns"]
    return entities, [r for r in model["relations"] if whole(r) and (choice.inferred or r["kind"] != "inferred")]


def _dbml_name(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else '"' + re.sub(r"[\\\"\r\n]", "_", name) + '"'


def _dbml_table(x: dict) -> str:
    return ".".join(_dbml_name(n) for n in (x.get("schema"), x["name"]) if n)


def _dbml_text(text: str) -> str:
    return "'" + re.sub(r"\r?\n", " ", text.replace("\\", "\\\\").replace("'", "\\'")) + "'"


def _dbml_type(type_: str) -> str:
    out = type_.strip() or "unknown"
    plain = r"[A-Za-z_][A-Za-z0-9_.]*(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?(?:\[\])?"
    return out if re.fullmatch(plain, out) else '"' + re.sub(r"[\\\"\r\n]", "_", out) + '"'


def to_dbml(model: dict, choice: Choice = Choice()) -> str:
    """A document that the DBML reader reads back."""
    entities, relations = _chosen(model, choice)
    out = []
    for e in model.get("enums", []):
        if e["values"]:
            out += [f"Enum {_dbml_table(e)} {{", *(f"  {_dbml_name(v)}" for v in e["values"]), "}", ""]
    group = lambda names: _dbml_name(names[0]) if len(names) == 1 else f"({', '.join(map(_dbml_name, names))})"
    boxed = lambda settings: f" [{', '.join(settings)}]" if settings else ""
    for e in entities:
        out.append(f"Table {_dbml_table(e)} {{")
        for c in e["columns"]:
            settings = [s for s, holds in (("pk", c["primary_key"]), ("not null", not c["nullable"] and not c["primary_key"]), ("unique", c["unique"] and not c["primary_key"])) if holds]
            settings += [f"default: `{re.sub(r'[`\r\n]', ' ', c['default'])}`"] if c.get("default") else []
            settings += [f"note: {_dbml_text(c['comment'])}"] if c.get("comment") else []
            out.append(f"  {_dbml_name(c['name'])} {_dbml_type(c.get('type', ''))}{boxed(settings)}")
        indexes = [i for i in e["indexes"] if i["columns"]]
        if indexes:
            rows = (f"    {group(i['columns'])}{boxed((['unique'] if i['unique'] else []) + ([f'name: {_dbml_text(i["name"])}'] if i.get('name') else []))}" for i in indexes)
            out += ["", "  indexes {", *rows, "  }"]
        out += ["", f"  Note: {_dbml_text(e['comment'])}"] if e.get("comment") else []
        out += ["}", ""]
    tables = {e["id"]: _dbml_table(e) for e in entities}
    signs = {"many-to-one": ">", "one-to-one": "-", MANY: "<>"}
    for r in relations:
        settings = [f"{key}: {r[name].lower()}" for key, name in (("delete", "on_delete"), ("update", "on_update")) if r.get(name)]
        out.append(f"Ref: {tables[r['from']]}.{group(r['from_columns'])} {signs[r['cardinality']]} {tables[r['to']]}.{group(r['to_columns'])}{boxed(settings)}")
    return "\n".join(out).rstrip() + "\n"


def _plant(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[\"\r\n{}]", " ", text)).strip() or "unknown"


def to_plantuml(model: dict, choice: Choice = Choice()) -> str:
    entities, relations = _chosen(model, choice)
    alias = {e["id"]: f"e{i}" for i, e in enumerate(entities, 1)}
    out = ["@startuml", "hide circle", "skinparam linetype ortho", ""]
    for e in entities:
        out.append(f'entity "{_plant(qualified(e))}" as {alias[e["id"]]} {{')
        key, rest = ([c for c in e["columns"] if c["primary_key"] is flag] for flag in (True, False))
        for i, part in enumerate((key, rest)):
            out += ["  --"] if i and key and rest else []
            for c in part:
                marks = " ".join(m for m, holds in (("<<PK>>", c["primary_key"]), ("<<FK>>", c.get("references"))) if holds)
                out.append(f"  {'' if c['nullable'] or c['primary_key'] else '* '}{_plant(c['name'])} : {_plant(c.get('type', ''))}{' ' + marks if marks else ''}")
        out += ["}", ""]
    for r in relations:
        line = ".." if r["kind"] == "inferred" else "--"
        one = "|o" if r["optional"] else "||"
        ends = f"}}o{line}o{{" if r["cardinality"] == MANY else ("|o" if r["cardinality"] == "one-to-one" else "}o") + line + one
        out.append(f"{alias[r['from']]} {ends} {alias[r['to']]} : {', '.join(map(_plant, r['from_columns']))}")
    return "\n".join([*out, "@enduml"]) + "\n"


def to_json(model: dict) -> str:
    return json.dumps({"version": 1, **model}, indent=2, ensure_ascii=False)


FORMATS = {"mermaid": to_mermaid, "markdown": to_markdown, "dbml": to_dbml, "plantuml": to_plantuml, "json": to_json}
PARTS = ("entities", "relations", "enums", "engines", "sources", "warnings")


def render(model: dict, format: str, name: str) -> str:
    return to_markdown(model, name) if format == "markdown" else FORMATS[format](model)


def export_models(models: DataFrame, format: str) -> DataFrame:
    """One document for each workspace of ``scan.build_models``: ``workspace``, ``document``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        model: dict = {part: [] for part in PARTS}
        for row in group.sort_values("seq", kind="stable").itertuples():
            model[row.part].append(json.loads(row.record))
        name = str(group.workspace.iloc[0])
        return pd.DataFrame({"workspace": [name], "document": [render(model, format, name)]})

    return models.groupBy("workspace").applyInPandas(run, "workspace string, document string")
