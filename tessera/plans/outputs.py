"""Queries: exports, changes, views, searches and catalogs of models, told by hand for every nation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import export, introspect, model_diff, model_views, sanitize, scan, search
from tessera.plans.readers import expected_sql, filled, sources
from tessera.plans.registry import QUERIES, SQL, Tables

BEFORE = "CREATE TYPE cargo AS ENUM ('coal', 'corn');\nCREATE TABLE docks (id int PRIMARY KEY, name varchar(20), depth int);\nCREATE TABLE cranes_@N (id int PRIMARY KEY, dock_id int REFERENCES docks (id));\nCREATE TABLE gone (id int);\n"
AFTER = (
    "CREATE TYPE cargo AS ENUM ('corn', 'cars');\nCREATE TABLE docks (id int PRIMARY KEY, name varchar(30) NOT NULL UNIQUE, lit boolean DEFAULT true);\nCREATE TABLE cranes_@N (id int PRIMARY KEY, dock_id int NOT NULL REFERENCES docks (id) ON DELETE CASCADE, load cargo);\n"
    "CREATE TABLE sheds (id int PRIMARY KEY, dock_id int);\nCREATE INDEX shed_dock ON sheds (dock_id);\nCREATE TABLE crane_sheds (crane_id int REFERENCES cranes_@N (id), shed_id int REFERENCES sheds (id), PRIMARY KEY (crane_id, shed_id));\nCREATE TABLE south.yards (id int PRIMARY KEY, owner int REFERENCES guilds (id));\n"
)


def _models(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return scan.build_models(scan.parse_files(sources(Tables(spark, folder), {"db/schema.sql": text}))).cache()


def told(name: str, expected: list[tuple[str, str, str]]):
    """Register a function of the models of AFTER, whose rows are (workspace, part, name, detail)."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(_models(spark, folder, AFTER))
        SQL[name] = expected_sql(expected)
        return f

    return register


def lines_of(documents: DataFrame, column: str = "document") -> DataFrame:
    """Rows of each document's lines, by number."""
    each = documents.select("workspace", F.posexplode(F.split(column, "\n", -1)).alias("i", "line"))
    return each.select("workspace", F.lit("line").alias("part"), F.col("i").cast("string").alias("name"), F.col("line").alias("detail"))


def document(text: str) -> list[tuple[str, str, str]]:
    return [("line", str(i), line) for i, line in enumerate(text.split("\n"))]


MERMAID = r"""erDiagram
    crane_sheds {
        int crane_id PK, FK
        int shed_id PK, FK
    }
    cranes_@N {
        int id PK
        int dock_id FK
        cargo load
    }
    docks {
        int id PK
        varchar(30) name UK
        boolean lit
    }
    sheds {
        int id PK
        int dock_id FK
    }
    "south.yards" {
        int id PK
        int owner FK
    }
    guilds {
        unknown id PK
    }
    crane_sheds }o--|| cranes_@N : "crane_id"
    crane_sheds }o--|| sheds : "shed_id"
    cranes_@N }o--|| docks : "dock_id"
    sheds }o..o| docks : "dock_id"
    "south.yards" }o--o| guilds : "owner"
"""
DBML = r"""Enum cargo {
  corn
  cars
}

Table crane_sheds {
  crane_id int [pk]
  shed_id int [pk]
}

Table cranes_@N {
  id int [pk]
  dock_id int [not null]
  load cargo
}

Table docks {
  id int [pk]
  name varchar(30) [not null, unique]
  lit boolean [default: `true`]
}

Table sheds {
  id int [pk]
  dock_id int

  indexes {
    dock_id [name: 'shed_dock']
  }
}

Table south.yards {
  id int [pk]
  owner int
}

Table guilds {
  id unknown [pk]
}

Ref: crane_sheds.crane_id > cranes_@N.id
Ref: crane_sheds.shed_id > sheds.id
Ref: cranes_@N.dock_id > docks.id [delete: cascade]
Ref: cranes_@N.id <> sheds.id
Ref: sheds.dock_id > docks.id
Ref: south.yards.owner > guilds.id
"""
PLANTUML = r"""@startuml
hide circle
skinparam linetype ortho

entity "crane_sheds" as e1 {
  crane_id : int <<PK>> <<FK>>
  shed_id : int <<PK>> <<FK>>
}

entity "cranes_@N" as e2 {
  id : int <<PK>>
  --
  * dock_id : int <<FK>>
  load : cargo
}

entity "docks" as e3 {
  id : int <<PK>>
  --
  * name : varchar(30)
  lit : boolean
}

entity "sheds" as e4 {
  id : int <<PK>>
  --
  dock_id : int <<FK>>
}

entity "south.yards" as e5 {
  id : int <<PK>>
  --
  owner : int <<FK>>
}

entity "guilds" as e6 {
  id : unknown <<PK>>
}

e1 }o--|| e2 : crane_id
e1 }o--|| e4 : shed_id
e2 }o--|| e3 : dock_id
e2 }o--o{ e4 : id
e4 }o..|o e3 : dock_id
e5 }o--|o e6 : owner
@enduml
"""
MARKDOWN = r"""# Database map: w@N


**5 tables · 6 relations · 1 enum**

**Detected from:** SQL (1 file)

## Diagram

```mermaid
erDiagram
    crane_sheds {
        int crane_id PK, FK
        int shed_id PK, FK
    }
    cranes_@N {
        int id PK
        int dock_id FK
        cargo load
    }
    docks {
        int id PK
        varchar(30) name UK
        boolean lit
    }
    sheds {
        int id PK
        int dock_id FK
    }
    "south.yards" {
        int id PK
        int owner FK
    }
    guilds {
        unknown id PK
    }
    crane_sheds }o--|| cranes_@N : "crane_id"
    crane_sheds }o--|| sheds : "shed_id"
    cranes_@N }o--|| docks : "dock_id"
    sheds }o..o| docks : "dock_id"
    "south.yards" }o--o| guilds : "owner"
```

## Tables

| Name | Kind | Columns | Relations | Defined in |
|---|---|---|---|---|
| [crane\_sheds](#crane_sheds) | join table | 2 | 2 | `db/schema.sql:6` |
| [cranes\_@N](#cranes_@N) | table | 3 | 3 | `db/schema.sql:3` |
| [docks](#docks) | table | 3 | 2 | `db/schema.sql:2` |
| [sheds](#sheds) | table | 2 | 3 | `db/schema.sql:4` |
| [south.yards](#southyards) | table | 2 | 1 | `db/schema.sql:7` |

### crane\_sheds

**Source:** SQL · **Defined in:** `db/schema.sql:6`

| Column | Type | Nullable | Key | Default | References | Notes |
|---|---|---|---|---|---|---|
| `crane_id` | `int` |  | PK, FK |  | cranes_@N.id |  |
| `shed_id` | `int` |  | PK, FK |  | sheds.id |  |

**References:** `crane_id` → [cranes\_@N](#cranes_@N); `shed_id` → [sheds](#sheds)

### cranes\_@N

**Source:** SQL · **Defined in:** `db/schema.sql:3`

| Column | Type | Nullable | Key | Default | References | Notes |
|---|---|---|---|---|---|---|
| `id` | `int` |  | PK |  |  |  |
| `dock_id` | `int` |  | FK |  | docks.id |  |
| `load` | `cargo` | yes |  |  |  | enum cargo |

**References:** `dock_id` → [docks](#docks)

**Referenced by:** [crane\_sheds](#crane_sheds) (`crane_id`)

**Many-to-many:** [sheds](#sheds) via [crane\_sheds](#crane_sheds)

### docks

**Source:** SQL · **Defined in:** `db/schema.sql:2`

| Column | Type | Nullable | Key | Default | References | Notes |
|---|---|---|---|---|---|---|
| `id` | `int` |  | PK |  |  |  |
| `name` | `varchar(30)` |  | UK |  |  |  |
| `lit` | `boolean` | yes |  | `true` |  |  |

**Referenced by:** [cranes\_@N](#cranes_@N) (`dock_id`); [sheds](#sheds) (`dock_id`)

### sheds

**Source:** SQL · **Defined in:** `db/schema.sql:4`

| Column | Type | Nullable | Key | Default | References | Notes |
|---|---|---|---|---|---|---|
| `id` | `int` |  | PK |  |  |  |
| `dock_id` | `int` | yes | FK |  | docks.id (inferred) |  |

**Indexes:** `shed_dock` (`dock_id`)

**References:** `dock_id` → [docks](#docks) _(inferred)_

**Referenced by:** [crane\_sheds](#crane_sheds) (`shed_id`)

**Many-to-many:** [cranes\_@N](#cranes_@N) via [crane\_sheds](#crane_sheds)

### south.yards

**Source:** SQL · **Defined in:** `db/schema.sql:7`

| Column | Type | Nullable | Key | Default | References | Notes |
|---|---|---|---|---|---|---|
| `id` | `int` |  | PK |  |  |  |
| `owner` | `int` | yes | FK |  | guilds.id |  |

**References:** `owner` → guilds

## Referenced but not defined here

These tables are referenced by relations but defined outside the scanned files (framework tables, other services…).

- `guilds`

## Enums

| Enum | Values | Defined in |
|---|---|---|
| `cargo` | corn, cars | `db/schema.sql:1` |"""
CHANGES = r"""# Schema changes: old -> new

**4 tables added, 1 table removed, 2 tables changed, 2 columns added, 1 column removed, 2 columns changed, 5 relations added, 1 relation changed, 1 enum changed**

## Added
### Tables
#### crane_sheds
- + `crane_id` `int`
- + `shed_id` `int`
#### guilds
- + `id`
#### sheds
- + `dock_id` `int`
- + `id` `int`
- + index (dock_id)
#### south.yards
- + `id` `int`
- + `owner` `int`
### Relations
- crane_sheds(crane_id)->cranes_@N (many-to-one)
- crane_sheds(shed_id)->sheds (many-to-one)
- cranes_@N(id)->sheds (many-to-many)
- sheds(dock_id)->docks (many-to-one)
- south.yards(owner)->guilds (many-to-one)
## Changed
### Tables
#### cranes_@N
- ~ `dock_id`: now NOT NULL
- + `load` `cargo`
#### docks
- - `depth` `int`
- + `lit` `boolean`
- ~ `name`: type: varchar(20) -> varchar(30); now NOT NULL; now unique
### Relations
- cranes_@N(dock_id)->docks (many-to-one): now required; on delete: (none) -> CASCADE
### Enums
- `cargo`: + cars; - coal
## Removed
### Tables
#### gone
- - `id` `int`
"""

EXPORT_JSON = [
    ('entity', 'crane_sheds', 'crane_id,shed_id'),
    ('entity', 'cranes_@N', 'id,dock_id,load'),
    ('entity', 'docks', 'id,name,lit'),
    ('entity', 'guilds', 'id'),
    ('entity', 'sheds', 'id,dock_id'),
    ('entity', 'south.yards', 'id,owner'),
    ('relation', 'crane_sheds(crane_id)>cranes_@N', 'foreign-key'),
    ('relation', 'crane_sheds(shed_id)>sheds', 'foreign-key'),
    ('relation', 'cranes_@N(dock_id)>docks', 'foreign-key'),
    ('relation', 'cranes_@N<>sheds@crane_sheds', 'foreign-key'),
    ('relation', 'sheds(dock_id)>docks', 'inferred'),
    ('relation', 'south.yards(owner)>guilds', 'foreign-key'),
]
MODEL_CHANGES = [
    ('column added', 'crane_sheds.crane_id', ''),
    ('column added', 'crane_sheds.shed_id', ''),
    ('column added', 'cranes_@N.load', ''),
    ('column added', 'docks.lit', ''),
    ('column added', 'guilds.id', ''),
    ('column added', 'sheds.dock_id', ''),
    ('column added', 'sheds.id', ''),
    ('column added', 'south.yards.id', ''),
    ('column added', 'south.yards.owner', ''),
    ('column changed', 'cranes_@N.dock_id', 'now NOT NULL'),
    ('column changed', 'docks.name', 'type: varchar(20) -> varchar(30); now NOT NULL; now unique'),
    ('column removed', 'docks.depth', ''),
    ('column removed', 'gone.id', ''),
    ('count of columns', 'added', '2'),
    ('count of columns', 'changed', '2'),
    ('count of columns', 'removed', '1'),
    ('count of entities', 'added', '4'),
    ('count of entities', 'changed', '2'),
    ('count of entities', 'removed', '1'),
    ('count of enums', 'changed', '1'),
    ('count of relations', 'added', '5'),
    ('count of relations', 'changed', '1'),
    ('enum changed', 'cargo', 'cars; coal'),
    ('relation added', 'crane_sheds(crane_id)->cranes_@N', ''),
    ('relation added', 'crane_sheds(shed_id)->sheds', ''),
    ('relation added', 'cranes_@N(id)->sheds', ''),
    ('relation added', 'sheds(dock_id)->docks', ''),
    ('relation added', 'south.yards(owner)->guilds', ''),
    ('relation changed', 'cranes_@N(dock_id)->docks', 'now required; on delete: (none) -> CASCADE'),
    ('table added', 'crane_sheds', '; ; 2'),
    ('table added', 'guilds', '; ; 1'),
    ('table added', 'sheds', '(dock_id); ; 2'),
    ('table added', 'south.yards', '; ; 2'),
    ('table changed', 'cranes_@N', '; ; 2'),
    ('table changed', 'docks', '; ; 3'),
    ('table removed', 'gone', '; ; 1'),
]
MODEL_VIEWS = [
    ('card', 'crane_sheds', 'join table crane_id:PK+FK,shed_id:PK+FK'),
    ('card', 'cranes_@N', 'table id:PK,dock_id:FK'),
    ('card', 'docks', 'table id:PK,name:UK'),
    ('card', 'guilds', 'external id:PK'),
    ('card', 'sheds', 'table id:PK,dock_id:FK'),
    ('card', 'south.yards', 'table id:PK,owner:FK'),
    ('connected', 'cranes_@N', '1 3'),
    ('connected', 'sheds', '2 3'),
    ('counts', '', '5 0 0 1'),
    ('degree', 'crane_sheds', '2'),
    ('degree', 'cranes_@N', '3'),
    ('degree', 'docks', '2'),
    ('degree', 'guilds', '1'),
    ('degree', 'sheds', '3'),
    ('degree', 'south.yards', '1'),
    ('drawn', 'cranes_@N(dock_id)>docks', 'relation'),
    ('drawn', 'cranes_@N<>sheds@crane_sheds', 'm2m'),
    ('goes in', 'cranes_@N', 'crane_sheds(crane_id)>cranes_@N'),
    ('goes in', 'docks', 'cranes_@N(dock_id)>docks'),
    ('goes in', 'docks', 'sheds(dock_id)>docks'),
    ('goes in', 'guilds', 'south.yards(owner)>guilds'),
    ('goes in', 'sheds', 'crane_sheds(shed_id)>sheds'),
    ('goes out', 'crane_sheds', 'crane_sheds(crane_id)>cranes_@N'),
    ('goes out', 'crane_sheds', 'crane_sheds(shed_id)>sheds'),
    ('goes out', 'cranes_@N', 'cranes_@N(dock_id)>docks'),
    ('goes out', 'cranes_@N', 'cranes_@N<>sheds@crane_sheds'),
    ('goes out', 'sheds', 'cranes_@N<>sheds@crane_sheds'),
    ('goes out', 'sheds', 'sheds(dock_id)>docks'),
    ('goes out', 'south.yards', 'south.yards(owner)>guilds'),
    ('group', 'table/', '4'),
    ('group', 'table/*', '5'),
    ('group', 'table/south', '1'),
    ('known', 'crane_sheds(crane_id)>cranes_@N', 'Declared · high confidence | Declared as a foreign key. | From db/schema.sql:6'),
    ('known', 'crane_sheds(shed_id)>sheds', 'Declared · high confidence | Declared as a foreign key. | From db/schema.sql:6'),
    ('known', 'cranes_@N(dock_id)>docks', 'Declared · high confidence | Declared as a foreign key. | From db/schema.sql:3'),
    ('known', 'cranes_@N<>sheds@crane_sheds', 'Declared · high confidence | Declared as a foreign key. | From db/schema.sql:6'),
    ('known', 'sheds(dock_id)>docks', "? Inferred from naming · low confidence | Inferred from the column's name; nothing declares it. | From db/schema.sql:4"),
    ('known', 'south.yards(owner)>guilds', '? Declared · low confidence | Declared as a foreign key. | The target "guilds" is not defined in the workspace. | From db/schema.sql:7'),
    ('largest', 'crane_sheds', '3 2'),
    ('largest', 'cranes_@N', '1 3'),
    ('largest', 'docks', '2 3'),
    ('mode', '6', 'all all none'),
    ('near docks', 'cranes_@N', '1'),
    ('near docks', 'docks', '0'),
    ('near docks', 'sheds', '1'),
    ('reads', 'crane_sheds(crane_id)>cranes_@N', 'crane_id → cranes_@N.id (many-to-one)'),
    ('reads', 'crane_sheds(shed_id)>sheds', 'shed_id → sheds.id (many-to-one)'),
    ('reads', 'cranes_@N(dock_id)>docks', 'dock_id → docks.id (many-to-one)'),
    ('reads', 'cranes_@N<>sheds@crane_sheds', '↔ sheds via crane_sheds (many-to-many)'),
    ('reads', 'sheds(dock_id)>docks', 'dock_id → docks.id (many-to-one)'),
    ('reads', 'south.yards(owner)>guilds', 'owner → guilds.id (many-to-one)'),
    ('visible', 'cranes_@N', ''),
    ('visible', 'docks', ''),
    ('visible', 'sheds', ''),
]
MODEL_SEARCH = [
    ('hit', 'column dock_id cranes', '649.1'),
    ('hit', 'column dock_id sheds', '649.1'),
    ('hit', 'table docks docks', '699.7'),
    ('matched', 'cranes', '2'),
    ('matched', 'docks', '1'),
    ('matched', 'sheds', '3'),
]

for _format, _text in (("mermaid", MERMAID.rstrip()), ("dbml", DBML), ("plantuml", PLANTUML)):
    told(f"export_{_format}", document(_text))(lambda models, f=_format: lines_of(export.export_models(models, f)))


@told("export_markdown", document(MARKDOWN))
def export_markdown(models: DataFrame) -> DataFrame:
    documents = export.export_models(models, "markdown")
    without = F.udf(export.strip_volatile)
    return lines_of(documents.select("workspace", without("document").alias("document")))


@told("export_json", EXPORT_JSON)
def export_json(models: DataFrame) -> DataFrame:
    documents = export.export_models(models, "json")
    read = F.from_json("document", "version int, entities array<struct<id:string,columns:array<struct<name:string>>>>, relations array<struct<id:string,kind:string>>")
    rows = documents.select("workspace", read.alias("d"))
    entities = rows.select("workspace", F.explode("d.entities").alias("e")).select("workspace", F.lit("entity").alias("part"), F.col("e.id").alias("name"), F.array_join(F.col("e.columns.name"), ",").alias("detail"))
    relations = rows.select("workspace", F.explode("d.relations").alias("r")).select("workspace", F.lit("relation").alias("part"), F.col("r.id").alias("name"), F.col("r.kind").alias("detail"))
    return entities.unionByName(relations)


def _changes(spark: SparkSession, folder: str) -> model_diff.ModelDiff:
    return model_diff.compare(_models(spark, folder, BEFORE), _models(spark, folder, AFTER))


def model_changes(spark: SparkSession, folder: str) -> DataFrame:
    d = _changes(spark, folder)
    joined = lambda *c: F.concat_ws("; ", *c)
    entities = d.entities.select("workspace", F.concat(F.lit("table "), "change").alias("part"), "name", joined(F.array_join("indexes_added", ","), F.array_join("indexes_removed", ","), F.col("n_columns").cast("string")).alias("detail"))
    columns = d.columns.select("workspace", F.concat(F.lit("column "), "change").alias("part"), F.concat_ws(".", "entity_id", "name").alias("name"), F.array_join("changes", "; ").alias("detail"))
    relations = d.relations.select("workspace", F.concat(F.lit("relation "), "change").alias("part"), F.col("key").alias("name"), F.array_join("changes", "; ").alias("detail"))
    enums = d.enums.select("workspace", F.concat(F.lit("enum "), "change").alias("part"), "name", joined(F.array_join("values_added", ","), F.array_join("values_removed", ",")).alias("detail"))
    counts = d.summary().select("workspace", F.concat_ws(" ", F.lit("count of"), "part").alias("part"), F.col("change").alias("name"), F.col("n").cast("string").alias("detail"))
    return entities.unionByName(columns).unionByName(relations).unionByName(enums).unionByName(counts)


QUERIES["model_changes"] = model_changes
SQL["model_changes"] = expected_sql(MODEL_CHANGES)
QUERIES["model_changelog"] = lambda spark, folder: lines_of(model_diff.to_markdown(_changes(spark, folder), "old", "new"), "markdown")
SQL["model_changelog"] = expected_sql(document(CHANGES))


@told("model_views", MODEL_VIEWS)
def views(models: DataFrame) -> DataFrame:
    """Counts, groups, largest, most connected, degrees, adjacency, what is visible and drawn, focus, cards, order."""
    lit, s = F.lit, lambda c: F.col(c).cast("string")
    counts = model_views.counts(models).select("workspace", lit("counts").alias("part"), lit("").alias("name"), F.concat_ws(" ", "tables", "views", "collections", "external").alias("detail"))
    groups = model_views.groups(models).select("workspace", lit("group").alias("part"), F.concat_ws("/", "kind", F.coalesce("schema", lit("*"))).alias("name"), s("n").alias("detail"))
    largest = model_views.largest(models, 3).select("workspace", lit("largest").alias("part"), F.col("id").alias("name"), F.concat_ws(" ", "rank", "n_columns").alias("detail"))
    connected = model_views.most_connected(models, 2).select("workspace", lit("connected").alias("part"), F.col("id").alias("name"), F.concat_ws(" ", "rank", "degree").alias("detail"))
    degrees = model_views.degrees(models).select("workspace", lit("degree").alias("part"), F.col("id").alias("name"), s("degree").alias("detail"))
    beside = model_views.adjacency(models).select("workspace", F.concat(lit("goes "), "direction").alias("part"), F.col("entity").alias("name"), F.col("relation").alias("detail"))
    filters = model_views.Filters(hide_external=True, hide_join_tables=True, hide_inferred=True, disabled_schemas=("south",))
    shown = model_views.visible(models, filters)
    seen = shown.select("workspace", lit("visible").alias("part"), F.col("id").alias("name"), lit("").alias("detail"))
    drawn = model_views.drawn_edges(models, shown, filters).select("workspace", lit("drawn").alias("part"), F.col("id").alias("name"), F.col("variant").alias("detail"))
    everything = model_views.drawn_edges(models, model_views.visible(models))
    near = model_views.focus(everything, models.select("workspace", lit("docks").alias("id")).distinct(), 1).select("workspace", lit("near docks").alias("part"), F.col("id").alias("name"), s("hop").alias("detail"))
    cards = model_views.cards(models, "keys").select("workspace", lit("card").alias("part"), F.col("id").alias("name"), F.concat_ws(" ", "kind", F.array_join(F.transform("rows", lambda r: F.concat(r["name"], lit(":"), F.array_join(r["keys"], "+"))), ",")).alias("detail"))
    modes = scan.entities(models).groupBy("workspace").agg(F.count("*").alias("n")).select("workspace", lit("mode").alias("part"), s("n").alias("name"), F.concat_ws(" ", model_views.column_mode(F.col("n")), model_views.column_mode(F.col("n") * 5), model_views.column_mode(F.col("n") * 42)).alias("detail"))
    r = scan.relations(models)
    told_ = r.select("workspace", lit("reads").alias("part"), F.col("id").alias("name"), model_views.describe_relation(F.col("from"), F.col("to")).alias("detail"))
    known = r.select("workspace", lit("known").alias("part"), F.col("id").alias("name"), F.concat(F.when(model_views.uncertain(F.col("provenance")), "? ").otherwise(""), F.array_join(model_views.provenance_lines(F.col("provenance")), " | ")).alias("detail"))
    out = counts
    for more in (groups, largest, connected, degrees, beside, seen, drawn, near, cards, modes, told_, known):
        out = out.unionByName(more)
    return out


@told("model_search", MODEL_SEARCH)
def model_search(models: DataFrame) -> DataFrame:
    """Hits of a search in each workspace's first place, and the entities that they match, over the items of one workspace."""
    items = model_views.search_items(models).where("workspace = 'w0'")
    hits = search.search(items, "dock").cache()
    rows = hits.select(F.lit("hit").alias("part"), F.concat_ws(" ", "kind", "label", "entity").alias("name"), F.round("score", 4).cast("string").alias("detail"))
    matched = search.matched(hits).select(F.lit("matched").alias("part"), F.col("entity").alias("name"), F.col("place").cast("string").alias("detail"))
    everywhere = models.select("workspace").distinct()
    found = rows.unionByName(matched).select("part", F.replace("name", F.lit("cranes_0"), F.lit("cranes")).alias("name"), "detail")
    return everywhere.crossJoin(F.broadcast(found))  # a search gives 200 hits at most


CATALOG_COLUMNS = [
    ("public", "docks", "name", "TEXT", "YES", "'x'", 2, "BASE TABLE"), ("public", "docks", "id", "INTEGER", "NO", None, 1, "BASE TABLE"),
    ("public", "cranes", "id", "INTEGER", "NO", None, 1, "BASE TABLE"), ("public", "cranes", "dock_id", "INTEGER", "YES", None, 2, "BASE TABLE"),
    ("south", "yards", "a", "int", "NO", None, 1, "BASE TABLE"), ("south", "yards", "b", "int", "NO", None, 2, "BASE TABLE"), ("public", "calm", "id", "INTEGER", "YES", None, 1, "VIEW"),
]
CATALOG_KEYS = [
    ("public", "docks", "docks_pk", "PRIMARY KEY", "id", 1, None, None, None), ("public", "docks", "docks_name", "u", "name", 1, None, None, None),
    ("public", "cranes", "cranes_fk", "f", "dock_id", 1, "public", "docks", "id"), ("south", "yards", "yards_pk", "p", "b", 2, None, None, None),
    ("south", "yards", "yards_pk", "p", "a", 1, None, None, None), ("public", "docks", "deep", "c", "id", 1, None, None, None),
]


def catalog_model(spark: SparkSession, folder: str) -> DataFrame:
    """Models of catalogs, one for each nation, whose name is the catalog's schema of one table."""
    columns = spark.createDataFrame(CATALOG_COLUMNS, "schema string, table string, name string, type string, nullable string, default string, position int, table_type string")
    keys = spark.createDataFrame(CATALOG_KEYS, "schema string, table string, name string, type string, column string, position int, ref_schema string, ref_table string, ref_column string")
    nations = Tables(spark, folder).nation.select("n_nationkey", "n_regionkey")
    south = F.when(F.col("schema") == "south", filled("south_@N")).otherwise(F.col("schema"))
    own = F.concat(F.col("table"), F.when(F.col("schema") == "public", filled("_@N")).otherwise(""))
    columns = nations.crossJoin(F.broadcast(columns)).withColumns({"schema": south, "table": own}).drop("n_regionkey")
    refs = F.when(F.col("ref_table").isNotNull(), F.concat("ref_table", filled("_@N")))
    keys = nations.crossJoin(F.broadcast(keys)).withColumns({"schema": south, "table": own, "ref_table": refs}).drop("n_regionkey", "n_nationkey")
    columns = columns.drop("n_nationkey")
    nation = F.concat(F.lit("w"), F.regexp_extract("id", r"_(\d+)", 1))
    entities = introspect.catalog_entities(columns, keys)
    flags = F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"], F.when(c["nullable"], "?"), F.when(c["primary_key"], "key"), F.when(c["unique"], "unique"), F.concat(F.lit("= "), c["default"]), F.concat(F.lit("-> "), c["references"]["entity"], F.lit("."), c["references"]["column"])))
    tables = entities.select(nation.alias("workspace"), F.col("kind").alias("part"), F.col("id").alias("name"), F.array_join(flags, ", ").alias("detail"))
    relations = introspect.catalog_relations(columns, keys).select(nation.alias("workspace"), F.lit("relation").alias("part"), F.col("id").alias("name"), F.concat_ws(" ", "cardinality", F.when(F.col("optional"), "optional"), "name", F.array_join("to_columns", ",")).alias("detail"))
    return tables.unionByName(relations)


QUERIES["catalog_model"] = catalog_model
SQL["catalog_model"] = expected_sql(
    [
        ("table", "docks_@N", "id integer key unique, name text ? unique = 'x'"),
        ("table", "cranes_@N", "id integer, dock_id integer ? -> docks_@N.id"),
        ("table", "south_@N.yards", "a int key, b int key"),
        ("view", "calm_@N", "id integer ?"),
        ("relation", "cranes_@N(dock_id)>docks_@N", "many-to-one optional cranes_fk id"),
    ]
)


def settings_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Notes, views, layouts and states of maps that untrusted files have, one of each for every nation."""
    files = {
        "notes": '{"tables": {"ships_@N": " a\\r\\nb ", "x": "  ", "__proto__": "no"}, "columns": {"ships_@N": {"id": "key", "": "no"}}}',
        "broken": "{broken",
        "views": '{"views": [{"name": " All  ships ", "entities": ["a_@N", "a_@N", ""]}, {"name": "ALL SHIPS", "entities": []}, {"name": "", "entities": []}, {"entities": []}]}',
        "layout": '{"a_@N": {"x": 1.25, "y": -1.25}, "b": {"x": "z"}, "c": {"x": 1}}',
        "ui": '{"columnMode": "keys", "direction": "XY", "expanded": ["a_@N", null], "viewport": {"x": 1, "y": 2, "scale": 0}, "filters": {"hideExternal": true, "disabledSchemas": ["s"], "focusHops": 7}}',
    }
    nations = Tables(spark, folder).nation
    of = lambda *names: nations.select(F.concat(F.lit("w"), "n_nationkey").alias("workspace"), F.explode(F.array(*[filled(files[n]) for n in names])).alias("text"))
    lit = F.lit
    notes = sanitize.notes(of("notes", "broken"))
    change = nations.select(F.concat(lit("w"), "n_nationkey").alias("workspace"), F.explode(F.array(F.struct(filled("ships_@N").alias("entity"), lit(None).cast("string").alias("column"), lit("new").alias("note")), F.struct(filled("ships_@N").alias("entity"), lit("id").alias("column"), lit(" ").alias("note")))).alias("c")).select("workspace", "c.*")
    note = lambda df, part: df.select("workspace", lit(part).alias("part"), F.concat_ws(".", "entity", "column").alias("name"), F.replace("note", lit("\n"), lit("/")).alias("detail"))
    views = sanitize.views(of("views", "broken")).select("workspace", lit("view").alias("part"), "name", F.array_join("entities", ",").alias("detail"))
    places = sanitize.layout(of("layout", "broken")).select("workspace", lit("place").alias("part"), F.col("entity").alias("name"), F.concat_ws(" ", "x", "y").alias("detail"))
    states = sanitize.ui_state(of("ui")).select("workspace", lit("state").alias("part"), lit("").alias("name"), F.concat_ws(" ", "column_mode", "direction", F.array_join("expanded", ","), F.col("viewport").isNull().cast("string"), F.array_join("disabled_schemas", ","), F.col("hide_external").cast("string"), F.col("side_panel_open").cast("string"), F.coalesce(F.col("focus_hops").cast("string"), lit("-"))).alias("detail"))
    return note(notes, "note").unionByName(note(sanitize.update_notes(notes, change), "changed note")).unionByName(views).unionByName(places).unionByName(states)


QUERIES["settings_cleaned"] = settings_cleaned
SQL["settings_cleaned"] = expected_sql(
    [
        ("note", "ships_@N", "a/b"),
        ("note", "ships_@N.id", "key"),
        ("changed note", "ships_@N", "new"),
        ("view", "All ships", "a_@N"),
        ("place", "a_@N", "1.3 -1.2"),
        ("state", "", "keys LR a_@N true s true true -"),
    ]
)
