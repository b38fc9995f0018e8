"""Mapping files and change logs in XML, YAML and JSON."""

from __future__ import annotations

import re
from types import SimpleNamespace
from typing import Any

from tessera.functions.names import short, snake
from tessera.model import Column, Index, Op, Parsed, RawEntity, RawRelation, Ref, Source
from tessera.parsers.markup import Element, Yaml, parse_json, parse_xml, parse_yaml

# Hibernate


def hibernate_detect(path: str, text: str) -> bool:
    return path.lower().endswith(".hbm.xml") and "<hibernate-mapping" in text


def _hbm_columns(node: Element, fallback: str | None) -> list[str]:
    names = [c.get("name") for c in node.all("column")]
    return [n.strip("`\"[]") for n in names if n] or ([(node.get("column") or fallback).strip("`\"[]")] if node.get("column") or fallback else [])


def hibernate(path: str, text: str) -> Parsed:
    out = Parsed(path, "hibernate")
    root = parse_xml(text).find("hibernate-mapping")
    for node in root.all("class", "entity") if root else []:
        _hbm_class(path, node, root.get("schema"), None, out)
    return out


def _hbm_class(path: str, node: Element, schema: str | None, parent: RawEntity | None, out: Parsed) -> None:
    name = node.get("name", "entity-name")
    if not name:
        return
    model = short(name)
    table = node.get("table")
    raw = RawEntity((table or model).strip("`\"[]"), "table", schema=node.get("schema") or schema, model_name=model, name_certainty=2 if table else 0, abstract=node.true("abstract") and not table, source=Source(path, node.line))
    comment = node.first("comment")
    raw.comment = (comment.text.strip() or None) if comment else None
    if parent is not None:
        raw.extends = [parent.model_name]
        raw.shared_table = node.name == "subclass"
    out.entities.append(raw)
    _hbm_members(path, node, raw, out)
    for join in node.all("join"):
        _hbm_members(path, join, raw, out)
    for child in node.all("subclass", "joined-subclass", "union-subclass"):
        _hbm_class(path, child, schema, raw, out)


def _hbm_members(path: str, node: Element, raw: RawEntity, out: Parsed, keys: bool = False) -> None:
    ref = lambda: Ref(raw.name, raw.model_name, raw.schema)
    for m in node.children:
        source, name = Source(path, m.line), m.get("name", "field")
        inner = m.first("column")
        if m.name in ("id", "key-property", "property", "version", "timestamp", "discriminator"):
            names = _hbm_columns(m, name or ("class" if m.name == "discriminator" else None))
            for n in names:
                primary = keys or m.name in ("id", "key-property")
                type_ = m.get("type") or ""
                size = (inner.get("length") if inner else None) or m.get("length")
                if inner is not None and inner.get("sql-type"):
                    type_ = inner.get("sql-type")
                elif size:
                    type_ = f"{type_ if type_ and type_ != 'string' else 'varchar'}({size})"
                strict = m.true("not-null") or (inner is not None and inner.true("not-null"))
                unique = m.true("unique") or (inner is not None and inner.true("unique"))
                column = Column(n, type_, not (primary or strict or m.name in ("version", "discriminator")), primary, unique, source=source)
                if m.first("generator") is not None and m.first("generator").get("class") not in (None, "assigned"):
                    column.generated = True
                raw.columns.append(column)
        elif m.name in ("composite-id",):
            _hbm_members(path, m, raw, out, True)
        elif m.name in ("component", "natural-id", "properties", "dynamic-component"):
            _hbm_members(path, m, raw, out)
        elif m.name in ("many-to-one", "key-many-to-one") or (m.name == "one-to-one" and m.true("constrained")):
            names = _hbm_columns(m, name)
            primary = keys or m.name == "key-many-to-one"
            free = not (primary or m.true("not-null") or (inner is not None and inner.true("not-null")))
            for n in names if m.name != "one-to-one" else []:
                raw.columns.append(Column(n, "", free, primary, m.true("unique"), source=source))
            target = m.get("class", "entity-name")
            own = names if m.name != "one-to-one" else [c.name for c in raw.columns if c.primary_key]
            one = m.name == "one-to-one" or m.true("unique")
            out.relations.append(RawRelation(ref(), Ref(model=short(target or name or "")), own, cardinality="one-to-one" if one else "many-to-one", kind="orm", name=m.get("foreign-key"), optional=free, source=source))
        elif m.name in ("set", "bag", "list", "map", "idbag", "array"):
            _hbm_collection(path, m, raw, out)
        elif m.name == "key" and node.name == "joined-subclass":
            for n in _hbm_columns(m, None):
                raw.columns.append(Column(n, "", False, True, source=source))
                parent = raw.extends[0] if raw.extends else None
                if parent:
                    out.relations.append(RawRelation(ref(), Ref(model=parent), [n], cardinality="one-to-one", kind="orm", optional=False, source=source))


def _hbm_collection(path: str, m: Element, raw: RawEntity, out: Parsed) -> None:
    source, key = Source(path, m.line), m.first("key")
    columns = _hbm_columns(key, None) if key is not None else []
    one, many, element = m.first("one-to-many"), m.first("many-to-many"), m.first("element")
    table = (m.get("table") or "").strip("`\"[]")
    if one is not None:
        out.relations.append(RawRelation(Ref(raw.name, raw.model_name, raw.schema), Ref(model=short(one.get("class", "entity-name") or "")), [], columns, "one-to-many", "orm", source=source))
    elif many is not None:
        target = Ref(model=short(many.get("class", "entity-name") or ""))
        if not m.true("inverse"):
            out.relations.append(RawRelation(Ref(raw.name, raw.model_name, raw.schema), target, cardinality="many-to-many", kind="orm", through=Ref(table) if table else None, source=source))
    elif element is not None and table:
        names = _hbm_columns(element, "elt")
        out.entities.append(RawEntity(table, "table", [Column(n, nullable=False, source=source) for n in columns] + [Column(n, element.get("type") or "", source=source) for n in names], raw.schema, source=source))
        out.relations.append(RawRelation(Ref(table, schema=raw.schema), Ref(raw.name, raw.model_name, raw.schema), columns, kind="orm", source=source))


# Doctrine mappings


def doctrinemap_detect(path: str, text: str) -> bool:
    low = path.lower()
    if low.endswith(".xml"):
        return "<doctrine-mapping" in text
    if low.endswith((".yml", ".yaml")):
        return (low.endswith((".dcm.yml", ".dcm.yaml", ".orm.yml", ".orm.yaml")) or "/doctrine/" in low) and bool(re.search(r"(?m)^\s+type:\s*(?:entity|mappedSuperclass)\b", text))
    return False


LINKS = {"many-to-one": "many-to-one", "manyToOne": "many-to-one", "one-to-one": "one-to-one", "oneToOne": "one-to-one", "many-to-many": "many-to-many", "manyToMany": "many-to-many"}


def doctrinemap(path: str, text: str) -> Parsed:
    out = Parsed(path, "doctrinemap")
    if path.lower().endswith(".xml"):
        root = parse_xml(text).find("doctrine-mapping")
        for node in root.all("entity", "mapped-superclass") if root else []:
            _dcm_entity(path, _dcm_xml(node), out)
        return out
    document = parse_yaml(text)
    for name, body in document.items() if isinstance(document, Yaml) else []:
        if isinstance(body, Yaml) and body.get("type") in ("entity", "mappedSuperclass"):
            _dcm_entity(path, _dcm_yaml(name, body, document.at[name]), out)
    return out


def _join(attributes: dict, name: str) -> dict:
    return {"name": attributes.get("name"), "to": attributes.get("referenced-column-name") or attributes.get("referencedColumnName"), "nullable": attributes.get("nullable"), "on_delete": attributes.get("on-delete") or attributes.get("onDelete"), "for": name}


def _dcm_xml(node: Element) -> dict:
    fields = [{"name": f.get("name", "field"), "id": f.name == "id", "line": f.line, "generated": f.first("generator") is not None, **f.attributes} for f in node.all("id", "field")]
    links = []
    for m in node.children:
        if m.name in LINKS:
            table = m.first("join-table")
            joins = [j for box in [m, *m.all("join-columns")] for j in box.all("join-column")]
            links.append({"kind": LINKS[m.name], "field": m.get("field"), "target": m.get("target-entity"), "mapped": m.get("mapped-by"), "joins": [_join(j.attributes, m.get("field") or "") for j in joins], "table": table.get("name") if table else None, "line": m.line})
    indexes = [(re.split(r"\s*,\s*", i.get("columns", "fields") or ""), unique, i.get("name")) for box, kind, unique in (("indexes", "index", False), ("unique-constraints", "unique-constraint", True)) for b in node.all(box) for i in b.all(kind)]
    return {"name": node.get("name"), "table": node.get("table"), "schema": node.get("schema"), "abstract": node.name == "mapped-superclass", "fields": fields, "links": links, "indexes": indexes, "line": node.line}


def _dcm_yaml(name: str, body: Yaml, line: int) -> dict:
    fields, links, indexes = [], [], []
    for box, primary in (("id", True), ("fields", False)):
        part = body.get(box)
        for key, value in part.items() if isinstance(part, Yaml) else []:
            value = value if isinstance(value, dict) else {}
            fields.append({"name": key, "id": primary or value.get("id") is True, "line": part.at[key], "generated": "generator" in value, **{k: v for k, v in value.items() if k not in ("id", "generator")}})
    for box, kind in LINKS.items():
        part = body.get(box)
        for key, value in part.items() if isinstance(part, Yaml) else []:
            value = value if isinstance(value, dict) else {}
            one, several = value.get("joinColumn"), value.get("joinColumns")
            joins = [_join(one, key)] if isinstance(one, dict) else [_join({"name": n, **(j or {})}, key) for n, j in several.items()] if isinstance(several, dict) else []
            table = value.get("joinTable")
            links.append({"kind": kind, "field": key, "target": value.get("targetEntity"), "mapped": value.get("mappedBy"), "joins": joins, "table": table.get("name") if isinstance(table, dict) else None, "line": part.at[key]})
    for box, unique in (("indexes", False), ("uniqueConstraints", True)):
        part = body.get(box)
        for key, value in part.items() if isinstance(part, Yaml) else []:
            columns = value.get("columns") if isinstance(value, dict) else None
            indexes.append((columns if isinstance(columns, list) else re.split(r"\s*,\s*", str(columns or "")), unique, key))
    return {"name": name, "table": body.get("table"), "schema": body.get("schema"), "abstract": body.get("type") == "mappedSuperclass", "fields": fields, "links": links, "indexes": indexes, "line": line}


def _dcm_entity(path: str, d: dict, out: Parsed) -> None:
    if not d["name"]:
        return
    model, yes = short(str(d["name"])), lambda x: str(x).strip().lower() == "true"
    schema, _, table = str(d["table"] or "").strip("`").rpartition(".")
    raw = RawEntity(table or snake(model), "table", schema=schema or d["schema"], model_name=model, name_certainty=2 if table else 0, abstract=d["abstract"], source=Source(path, d["line"]))
    for f in d["fields"]:
        if not f["name"]:
            continue
        type_ = str(f.get("type") or "")
        if f.get("length"):
            type_ += f"({f['length']})"
        elif f.get("precision"):
            type_ += f"({f['precision']}{',' + str(f['scale']) if f.get('scale') else ''})"
        column = Column(str(f.get("column") or f["name"]).strip("`"), type_, yes(f.get("nullable")) and not f["id"], bool(f["id"]), yes(f.get("unique")), source=Source(path, f["line"]))
        column.generated = True if f["generated"] else None
        raw.columns.append(column)
    raw.indexes = [Index([c for c in columns if c], unique, name) for columns, unique, name in d["indexes"] if any(columns)]
    out.entities.append(raw)
    for x in d["links"]:
        if not x["target"] or x["mapped"]:
            continue
        target = Ref(model=short(str(x["target"])))
        source = Source(path, x["line"])
        if x["kind"] == "many-to-many":
            out.relations.append(RawRelation(Ref(model=model), target, cardinality="many-to-many", kind="orm", through=Ref(x["table"] or f"{raw.name}_{snake(target.model)}"), source=source))
            continue
        joins = x["joins"] or [{"name": None, "to": None, "nullable": None, "on_delete": None}]
        columns = [j["name"] or f"{snake(str(x['field']))}_id" for j in joins]
        free = not any(str(j["nullable"]).lower() == "false" for j in joins)
        action = next((j["on_delete"] for j in joins if j["on_delete"]), None)
        out.relations.append(RawRelation(Ref(model=model), target, columns, [j["to"] for j in joins if j["to"]], x["kind"], "orm", on_delete=action, optional=free, source=source))


# Liquibase


def liquibase_detect(path: str, text: str) -> bool:
    low = path.lower()
    return low.endswith((".xml", ".yaml", ".yml", ".json")) and "databaseChangeLog" in text


def _as_elements(value: Any, name: str = "", line: int = 0) -> Element:
    """YAML and JSON change logs in the shape of the XML ones."""
    out = Element(name, line=getattr(value, "line", line))
    if isinstance(value, dict):
        at = getattr(value, "at", {})
        for k, v in value.items():
            here = at.get(k, out.line)
            if isinstance(v, (dict, list)):
                items = v if isinstance(v, list) else [v]
                for item in items:
                    if isinstance(v, list) and isinstance(item, dict) and len(item) == 1:
                        (inner, content), = item.items()
                        child = _as_elements(content, inner, getattr(item, "line", here))
                        if k in ("changes", "columns", "databaseChangeLog"):
                            out.children.append(child)
                        else:
                            out.children.append(Element(k, line=here, children=[child]))
                    elif isinstance(item, dict):
                        out.children.append(_as_elements(item, k, here))
            elif v is not None:
                out.attributes[k] = str(v).lower() if isinstance(v, bool) else str(v)
    return out


def liquibase(path: str, text: str) -> Parsed:
    out = Parsed(path, "liquibase", "migration")
    low = path.lower()
    if low.endswith(".xml"):
        root = parse_xml(text).find("databaseChangeLog")
    else:
        document = parse_json(text) if low.endswith(".json") else parse_yaml(text)
        root = None
        if isinstance(document, dict) and isinstance(document.get("databaseChangeLog"), list):
            root = _as_elements({"databaseChangeLog": document["databaseChangeLog"]} if not isinstance(document, Yaml) else document)
    for change_set in root.all("changeSet") if root is not None else []:
        for change in change_set.children:
            act = CHANGES.get(change.name)
            if act:
                act(path, change, out)
    return out


def _lq_table(x: Element, table: str = "tableName", schema: str = "schemaName") -> Ref | None:
    return Ref(x.get(table), schema=x.get(schema)) if x.get(table) else None


def _lq_columns(x: Element) -> list[Element]:
    return x.all("column") + [c for box in x.all("columns") for c in box.all("column")]


def _lq_column(path: str, c: Element, table: Ref, out: Parsed) -> Column | None:
    if not c.get("name"):
        return None
    rules, source = c.first("constraints"), Source(path, c.line)
    rules = rules if rules is not None else Element("")
    primary = rules.true("primaryKey")
    nullable = not (primary or (rules.get("nullable") or "").lower() == "false")
    column = Column(c.get("name"), re.sub(r"\s+", " ", c.get("type") or ""), nullable, primary, rules.true("unique"), source=source, comment=c.get("remarks"))
    if c.true("autoIncrement"):
        column.generated = True
    column.default = c.get("defaultValue", "defaultValueNumeric", "defaultValueBoolean", "defaultValueComputed", "defaultValueDate")
    if c.get("defaultValueSequenceNext"):
        column.generated = True
    target, columns = rules.get("referencedTableName"), rules.get("referencedColumnNames")
    if not target and (m := re.match(r"\s*(?:([\w\"]+)\.)?([\w\"]+)\s*\(([^)]*)\)", rules.get("references") or "")):
        target, columns = m[2].strip('"'), m[3]
    if target:
        out.relations.append(RawRelation(Ref(table.name, schema=table.schema), Ref(target), [column.name], _lq_names(columns), name=rules.get("foreignKeyName"), on_delete="CASCADE" if rules.true("deleteCascade") else None, optional=nullable, source=source))
    return column


def _lq_names(text: str | None) -> list[str]:
    return [n for n in re.split(r"\s*,\s*", (text or "").strip()) if n]


def _create(path: str, x: Element, out: Parsed) -> None:
    ref = _lq_table(x)
    if ref:
        columns = [c for e in _lq_columns(x) if (c := _lq_column(path, e, ref, out))]
        out.entities.append(RawEntity(ref.name, "table", columns, ref.schema, comment=x.get("remarks"), source=Source(path, x.line)))


def _add_columns(path: str, x: Element, out: Parsed) -> None:
    ref = _lq_table(x)
    if ref:
        columns = [c for e in _lq_columns(x) if (c := _lq_column(path, e, ref, out))]
        out.entities.append(RawEntity(ref.name, "table", columns, ref.schema, partial=True, source=Source(path, x.line)))


def _op(op: str, **fields: str):
    """A change whose fields come from attributes."""

    def act(path: str, x: Element, out: Parsed) -> None:
        ref = _lq_table(x, "oldTableName" if op == "renameTable" else "baseTableName" if op == "dropForeignKey" else "tableName", "baseTableSchemaName" if op == "dropForeignKey" else "schemaName")
        values = {k: x.get(a) for k, a in fields.items()}
        if ref and all(values.values()):
            out.ops.append(Op(op, ref, source=Source(path, x.line), **values))

    return act


def _drop_column(path: str, x: Element, out: Parsed) -> None:
    ref = _lq_table(x)
    for name in ([x.get("columnName")] if x.get("columnName") else [c.get("name") for c in _lq_columns(x)]) if ref else []:
        out.ops.append(Op("dropColumn", Ref(ref.name, schema=ref.schema), name, source=Source(path, x.line)))


def _patch(make):
    def act(path: str, x: Element, out: Parsed) -> None:
        ref, patch = _lq_table(x), make(x)
        for name in _lq_names(x.get("columnName") or x.get("columnNames")) if ref and patch else []:
            out.ops.append(Op("alterColumn", Ref(ref.name, schema=ref.schema), name, set=dict(patch), source=Source(path, x.line)))

    return act


def _index(unique: bool | None):
    def act(path: str, x: Element, out: Parsed) -> None:
        ref = _lq_table(x)
        names = _lq_names(x.get("columnNames")) or [c.get("name") for c in _lq_columns(x) if c.get("name")]
        if ref and names:
            index = Index(names, x.true("unique") if unique is None else unique, x.get("indexName", "constraintName"))
            out.entities.append(RawEntity(ref.name, "table", schema=ref.schema, partial=True, indexes=[index], source=Source(path, x.line)))

    return act


def _foreign(path: str, x: Element, out: Parsed) -> None:
    ref, target = _lq_table(x, "baseTableName", "baseTableSchemaName"), _lq_table(x, "referencedTableName", "referencedTableSchemaName")
    columns = _lq_names(x.get("baseColumnNames"))
    if ref and target and columns:
        out.relations.append(RawRelation(ref, target, columns, _lq_names(x.get("referencedColumnNames")), name=x.get("constraintName"), on_delete=x.get("onDelete"), on_update=x.get("onUpdate"), source=Source(path, x.line)))


def _view(path: str, x: Element, out: Parsed) -> None:
    if x.get("viewName"):
        out.entities.append(RawEntity(x.get("viewName"), "view", schema=x.get("schemaName"), source=Source(path, x.line)))


def _sql(path: str, x: Element, out: Parsed) -> None:
    from tessera.parsers import sql

    text = x.text or x.get("sql") or ""
    inner = sql.parse("migrations/inline.sql", text)
    for rows in (inner.entities, inner.relations, inner.enums, inner.ops):
        for r in rows:
            r.source = Source(path, x.line + (r.source.line if r.source else 0))
            for c in getattr(r, "columns", []) if isinstance(r, RawEntity) else []:
                c.source = None
    out.entities += inner.entities
    out.relations += inner.relations
    out.enums += inner.enums
    out.ops += inner.ops


_DEFAULTS = ("defaultValue", "defaultValueNumeric", "defaultValueBoolean", "defaultValueComputed", "defaultValueDate")
CHANGES = {
    "createTable": _create,
    "addColumn": _add_columns,
    "dropTable": _op("dropTable"),
    "renameTable": _op("renameTable", to="newTableName"),
    "dropColumn": _drop_column,
    "renameColumn": _op("renameColumn", column="oldColumnName", to="newColumnName"),
    "modifyDataType": _patch(lambda x: {"type": x.get("newDataType")} if x.get("newDataType") else {}),
    "addNotNullConstraint": _patch(lambda x: {"nullable": False}),
    "dropNotNullConstraint": _patch(lambda x: {"nullable": True}),
    "addDefaultValue": _patch(lambda x: {"default": x.get(*_DEFAULTS)} if x.get(*_DEFAULTS) else {}),
    "addAutoIncrement": _patch(lambda x: {"generated": True}),
    "setColumnRemarks": _patch(lambda x: {"comment": x.get("remarks")} if x.get("remarks") else {}),
    "addPrimaryKey": _patch(lambda x: {"primary_key": True}),
    "addUniqueConstraint": _index(True),
    "createIndex": _index(None),
    "addForeignKeyConstraint": _foreign,
    "dropForeignKeyConstraint": _op("dropForeignKey", name="constraintName"),
    "createView": _view,
    "dropView": lambda path, x, out: out.ops.append(Op("dropTable", Ref(x.get("viewName"), schema=x.get("schemaName")), source=Source(path, x.line))) if x.get("viewName") else None,
    "sql": _sql,
}

READERS = {
    "liquibase": SimpleNamespace(detect=liquibase_detect, parse=liquibase),
    "hibernate": SimpleNamespace(detect=hibernate_detect, parse=hibernate),
    "doctrinemap": SimpleNamespace(detect=doctrinemap_detect, parse=doctrinemap),
}
