"""Diffs, exports and catalogs."""

import json

from building import build

from tessera.operators import export, introspect, model_diff, scan
from tessera.parsers import dbml, sql

BASE = "CREATE TABLE users (id int PRIMARY KEY, email text, old int);\nCREATE TABLE posts (id int PRIMARY KEY, user_id int REFERENCES users (id));\nCREATE TABLE gone (id int);\nCREATE TYPE mood AS ENUM ('a', 'b');"
HEAD = "CREATE TABLE users (id int PRIMARY KEY, email varchar NOT NULL UNIQUE, fresh int);\nCREATE TABLE posts (id int PRIMARY KEY, user_id int REFERENCES users (id) ON DELETE CASCADE);\nCREATE TABLE new (id int);\nCREATE TYPE mood AS ENUM ('b', 'c');"


def models(spark, text):
    files = spark.createDataFrame([("w", "db/schema.sql", text)], "workspace string, path string, text string")
    return scan.build_models(scan.parse_files(files)).cache()


def test_diff(spark):
    diff = model_diff.compare(models(spark, BASE), models(spark, HEAD))
    assert [(r.id, r.change) for r in model_diff.ordered(diff.entities).collect()] == [("new", "added"), ("users", "changed"), ("gone", "removed")]
    columns = {(r.entity_id, r.name): (r.change, r.changes) for r in diff.columns.collect()}
    assert columns["users", "email"] == ("changed", ["type: text -> varchar", "now NOT NULL", "now unique"])
    assert columns["users", "fresh"][0] == "added" and columns["users", "old"][0] == "removed"
    assert [(r.change, r.changes) for r in diff.relations.collect()] == [("changed", ["on delete: (none) -> CASCADE"])]
    assert [(r.change, r.values_added, r.values_removed) for r in diff.enums.collect()] == [("changed", ["c"], ["a"])]
    counts = {(r.part, r.change): r.n for r in diff.summary().collect()}
    assert counts == {("entities", "added"): 1, ("entities", "removed"): 1, ("entities", "changed"): 1, ("columns", "added"): 1, ("columns", "removed"): 1, ("columns", "changed"): 1, ("relations", "changed"): 1, ("enums", "changed"): 1}
    text = diff.summary_text().first().summary
    assert text == "1 table added, 1 table removed, 1 table changed, 1 column added, 1 column removed, 1 column changed, 1 relation changed, 1 enum changed"
    markdown = model_diff.to_markdown(diff).first().markdown
    assert markdown.index("## Added") < markdown.index("#### new") < markdown.index("## Changed") < markdown.index("- ~ `email`: type: text -> varchar") < markdown.index("## Removed") < markdown.index("#### gone")
    assert model_diff.compare(models(spark, BASE), models(spark, BASE)).summary().count() == 0


def model(text):
    return build([sql.parse("db/schema.sql", text)])


def test_mermaid():
    built = model('CREATE TABLE "end" (id int PRIMARY KEY, "PK" text, a_id int REFERENCES b (id));\nCREATE TABLE b (id int PRIMARY KEY, c decimal(10, 2));')
    text = export.to_mermaid(built)
    assert text.startswith("erDiagram\n    b {\n        int id PK\n        decimal(10-2) c\n    }\n    \"end\" {")
    assert '    "end" }o--o| b : "a_id"' in text and "text PK_" in text
    assert export.mermaid_with_mode(built, export.Choice(most_chars=10))[1] == "none"
    assert "{" not in export.to_mermaid(built, export.Choice(columns="none")).replace("o{", "")


def test_dbml_round_trip():
    built = model(BASE + "\nCREATE UNIQUE INDEX by_email ON users (email);")
    back = build([dbml.parse("x.dbml", export.to_dbml(built))])
    assert [e["id"] for e in back["entities"]] == [e["id"] for e in built["entities"]]
    assert [(r["from"], r["from_columns"], r["to"]) for r in back["relations"]] == [(r["from"], r["from_columns"], r["to"]) for r in built["relations"]]
    assert back["enums"][0]["values"] == ["a", "b"]
    assert any(i["unique"] for e in back["entities"] for i in e["indexes"])


def test_documents(spark):
    built = models(spark, BASE)
    docs = {f: export.export_models(built, f).first().document for f in export.FORMATS}
    assert "| [users](#users) | table | 3 | 1 | `db/schema.sql:1` |" in docs["markdown"] and "**References:** `user_id` → [users](#users)" in docs["markdown"]
    assert docs["plantuml"].startswith("@startuml") and "e2 }o--|o e3 : user_id" in docs["plantuml"]
    assert json.loads(docs["json"])["entities"][0]["id"] == "gone"
    assert export.strip_volatile(docs["markdown"]).startswith("# Database map: w")
    assert export.slugs(["A b", "a b", "C!", "a b"]) == ["a-b", "a-b-1", "c", "a-b-2"]


def test_catalog(spark):
    column = lambda t, n, p, null="NO", kind="BASE TABLE", type="INTEGER": ("public", t, n, type, null, None, p, kind)
    columns = spark.createDataFrame(
        [column("users", "email", 2, "YES", type="TEXT"), column("users", "id", 1), column("posts", "id", 1), column("posts", "user_id", 2, "YES"), column("profiles", "user_id", 1), column("active", "id", 1, kind="VIEW")],
        "schema string, table string, name string, type string, nullable string, default string, position int, table_type string",
    )
    key = lambda t, n, k, c, p=1, rt=None, rc=None: ("public", t, n, k, c, p, "public" if rt else None, rt, rc)
    constraints = spark.createDataFrame(
        [key("users", "u_pk", "PRIMARY KEY", "id"), key("posts", "p_pk", "p", "id"), key("posts", "p_fk", "f", "user_id", 1, "users", "id"), key("profiles", "r_pk", "p", "user_id"), key("profiles", "r_fk", "FOREIGN KEY", "user_id", 1, "users", "id"), key("users", "chk", "c", "id")],
        "schema string, table string, name string, type string, column string, position int, ref_schema string, ref_table string, ref_column string",
    )
    entities = {r.id: r for r in introspect.catalog_entities(columns, constraints).collect()}
    assert sorted(entities) == ["active", "posts", "profiles", "users"] and entities["active"].kind == "view"
    assert [(c.name, c.type, c.nullable, c.primary_key) for c in entities["users"].columns] == [("id", "integer", False, True), ("email", "text", True, False)]
    relations = {r.id: (r.cardinality, r.optional) for r in introspect.catalog_relations(columns, constraints).collect()}
    assert relations == {"posts(user_id)>users": ("many-to-one", True), "profiles(user_id)>users": ("one-to-one", False)}
