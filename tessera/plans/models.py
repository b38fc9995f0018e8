"""Queries: schema text made from the driver's tables, read and resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.plans.readers import expected_sql, filled
from tessera.plans.registry import Tables, query
from tessera.sources import files


def _files(t: Tables) -> DataFrame:
    """A workspace for each supplier: a definition and, for odd ones, a migration that renames."""
    base = t.supplier.select(F.concat(F.lit("w"), "s_suppkey").alias("workspace"), "s_suppkey", "s_nationkey")
    ddl = F.format_string(
        "CREATE TABLE nation_%d (id int PRIMARY KEY, name varchar(20) NOT NULL);\n"
        "CREATE TABLE parts (id serial PRIMARY KEY, nation_id int NOT NULL REFERENCES nation_%d (id) ON DELETE CASCADE, price decimal(10,2) DEFAULT 0);\n"
        "CREATE TABLE part_notes (part_id int, body text);\n",
        "s_nationkey", "s_nationkey",
    )
    definition = base.select("workspace", F.lit("db/schema.sql").alias("path"), ddl.alias("text"))
    change = F.lit("CREATE TABLE logs (id int PRIMARY KEY, parts_id int);\nALTER TABLE logs RENAME TO audit_logs;\nALTER TABLE audit_logs ADD COLUMN at timestamp NOT NULL;\n")
    migration = base.where("s_suppkey % 2 = 1").select("workspace", F.lit("db/migrations/001_logs.sql").alias("path"), change.alias("text"))
    return definition.unionByName(migration)


_SUPPLIERS = "SELECT 'w' || s_suppkey AS workspace, s_suppkey % 2 = 1 AS odd, 'nation_' || s_nationkey AS nation FROM supplier"


@query(f"""
WITH s AS ({_SUPPLIERS})
SELECT workspace, nation AS id, 'table' AS kind, CAST(2 AS INTEGER) AS n_columns, 'id,name' AS names FROM s
UNION ALL SELECT workspace, 'parts', 'table', 3, 'id,nation_id,price' FROM s
UNION ALL SELECT workspace, 'part_notes', 'table', 2, 'part_id,body' FROM s
UNION ALL SELECT workspace, 'audit_logs', 'table', 3, 'id,parts_id,at' FROM s WHERE odd
""")
def resolved_entities(t: Tables) -> DataFrame:
    models = scan.build_models(scan.parse_files(_files(t)))
    e = scan.entities(models)
    return e.select("workspace", "id", "kind", F.size("columns").alias("n_columns"), F.array_join(F.col("columns.name"), ",").alias("names"))


@query(f"""
WITH s AS ({_SUPPLIERS})
SELECT workspace, 'parts(nation_id)>' || nation AS id, 'foreign-key' AS kind, 'many-to-one' AS cardinality, false AS optional, 'CASCADE' AS on_delete FROM s
UNION ALL SELECT workspace, 'part_notes(part_id)>parts', 'inferred', 'many-to-one', true, NULL FROM s
UNION ALL SELECT workspace, 'audit_logs(parts_id)>parts', 'inferred', 'many-to-one', true, NULL FROM s WHERE odd
""")
def resolve_fixture(t: Tables) -> DataFrame:
    models = scan.build_models(scan.parse_files(_files(t)))
    return scan.relations(models).select("workspace", "id", "kind", "cardinality", "optional", "on_delete")


_FOLDERS = ("src", "db", "src/models", "docs", "Db", "test/db", "lib/sql/old")
_NAMES = ("schema.rb", "a.sql", "index.ts", "shop.entity.ts", "ShopDbContext.cs", "schema.sql", "x.model.cjs", "models.pyc")


@query(f"""
WITH f(i, folder, hint, low) AS (VALUES (0, 'src', 0, 0), (1, 'db', 5, 0), (2, 'src/models', 5, 0), (3, 'docs', 0, 6), (4, 'Db', 0, 0), (5, 'test/db', 5, 6), (6, 'lib/sql/old', 5, 0)),
n(j, name, strong) AS (VALUES (0, 'schema.rb', 10), (1, 'a.sql', 3), (2, 'index.ts', 0), (3, 'shop.entity.ts', 10), (4, 'ShopDbContext.cs', 10), (5, 'schema.sql', 13), (6, 'x.model.cjs', 10), (7, 'models.pyc', 0))
SELECT page_id, folder || '/' || name AS path, CAST(hint - low + strong AS INTEGER) AS priority FROM pages JOIN f ON page_id % {len(_FOLDERS)} = i JOIN n ON page_id % {len(_NAMES)} = j
""")
def path_priority(t: Tables) -> DataFrame:
    """How likely paths declare a schema, one for every page."""
    pick = lambda some: F.element_at(F.array(*[F.lit(x) for x in some]), (F.col("page_id") % len(some)).cast("int") + 1)
    path = F.concat(pick(_FOLDERS), F.lit("/"), pick(_NAMES))
    return t.pages.select("page_id", path.alias("path")).withColumn("priority", files.priority(F.col("path")))


_LISTED = (
    ("db/schema.sql", 18), ("docs/db/x.sql", 2), ("src/a@N.ts", 0), ("src/b.ts", 0), ("src/c.ts", 0), ("lib/models.py", 10), ("node_modules/x/schema.sql", None), ("test/fixtures/schema.sql", None), ("db/1.down.sql", None),
    ("readme.md", None), ("tmp/z.sql", 3), ("huge.sql", None),
)


@query(expected_sql([("6 of 7", path, str(rank)) for path, rank in _LISTED if rank is not None and path != "src/c.ts"]))
def scan_filter(t: Tables) -> DataFrame:
    """Files of every nation's tree that are chosen: included, not excluded, small enough, the likeliest ones."""
    each = F.explode(F.array(*[F.struct(filled(path).alias("path"), F.lit(files.MOST_BYTES + 1 if path == "huge.sql" else 10).alias("length")) for path, _ in _LISTED]))
    listed = t.nation.select(F.concat(F.lit("w"), "n_nationkey").alias("workspace"), "n_nationkey", "n_regionkey", each.alias("f")).select("workspace", "f.*")
    chosen = files.candidates(files.wanted(listed, scan.include_regex()), scan.include_regex(), 6)
    return chosen.select("workspace", F.when(F.col("truncated"), "6 of 7").otherwise("all").alias("part"), F.col("path").alias("name"), F.col("priority").cast("string").alias("detail"))
