"""Queries: what the resolver makes of the sources of a workspace, told by hand for every nation.

Each query's sources exercise some rules of the resolver; the SQL lists what
must come out of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.plans.readers import columns_and_relations, expected_sql, sources
from tessera.plans.registry import QUERIES, SQL, Tables

Rows = list[tuple[str, str, str]]


def entities(models: DataFrame) -> DataFrame:
    """Entities: kind, marks, how they are known, comment."""
    said = F.concat_ws(" ", "kind", F.when(F.col("external"), "external"), F.when(F.col("join_table"), "junction"), "provenance.derivation", "provenance.confidence", F.concat(F.lit("-- "), "comment"))
    return scan.entities(models).select("workspace", F.lit("entity").alias("part"), F.col("id").alias("name"), said.alias("detail"))


def columns(models: DataFrame) -> DataFrame:
    """Columns with all that is known of them, in their order."""
    c = scan.columns(models)
    mark = lambda name, yes: F.when(F.col(name), yes)
    said = F.concat_ws(
        " ", F.concat("type", F.when(F.col("nullable"), "?").otherwise("")), mark("primary_key", "key"), mark("unique", "unique"), mark("generated", "generated"), mark("is_array", "array"), mark("implied", "implied"),
        F.concat(F.lit("= "), "default"), F.concat(F.lit("in "), "enum_ref"), F.concat(F.lit("-> "), "references.entity", F.lit("."), "references.column"), F.concat(F.lit("-- "), "comment"),
    )
    return c.select("workspace", F.lit("column").alias("part"), F.concat_ws(".", "entity_id", "name").alias("name"), F.concat((F.col("pos") + 1).cast("string"), F.lit(" "), said).alias("detail"))


def indexes(models: DataFrame) -> DataFrame:
    each = scan.entities(models).select("workspace", "id", F.explode("indexes").alias("i"))
    return each.select("workspace", F.lit("index").alias("part"), F.col("id").alias("name"), F.concat(F.when(F.col("i.unique"), "unique ").otherwise(""), F.array_join("i.columns", ",")).alias("detail"))


def enums(models: DataFrame) -> DataFrame:
    return scan.enums(models).select("workspace", F.lit("enum").alias("part"), F.col("id").alias("name"), F.array_join("values", ",").alias("detail"))


def relations(models: DataFrame) -> DataFrame:
    r = columns_and_relations(models).where("part = 'relation'")
    how = scan.relations(models).select("workspace", F.col("id").alias("name"), F.concat_ws(" ", "provenance.confidence", F.concat(F.lit("via "), "through")).alias("how"))
    return r.join(how, ["workspace", "name"]).select("workspace", "part", "name", F.concat_ws(" ", "detail", "how").alias("detail"))


def warnings(models: DataFrame) -> DataFrame:
    w = scan.part(models, "warnings", "file string, line int, message string")
    return w.select("workspace", F.lit("warning").alias("part"), F.concat_ws(":", "file", "line").alias("name"), F.col("message").alias("detail"))


def engines(models: DataFrame) -> DataFrame:
    e = scan.part(models, "engines", "id string, label string, category string, evidence array<struct<file:string,line:int,detail:string>>")
    each = e.select("workspace", F.lit("engine").alias("part"), F.concat_ws(" ", "seq", "id").alias("name"), F.explode("evidence").alias("x"))
    return each.select("workspace", "part", "name", F.concat_ws(":", "x.file", "x.line", "x.detail").alias("detail"))


def kinds(models: DataFrame) -> DataFrame:
    s = scan.part(models, "sources", "kind string, files int, entities int")
    return s.select("workspace", F.lit("source").alias("part"), F.concat_ws(" ", "seq", "kind").alias("name"), F.concat_ws(" ", "files", "entities").alias("detail"))


def order(models: DataFrame) -> DataFrame:
    """The order of entities, relations and enums."""
    rows = models.where("part IN ('entities', 'relations', 'enums')")
    return rows.select("workspace", F.concat(F.lit("place in "), "part").alias("part"), F.col("id").alias("name"), F.col("seq").cast("string").alias("detail"))


def story(name: str, files: dict[str, str], views: tuple[Callable[[DataFrame], DataFrame], ...], expected: Rows) -> None:
    """Register a query over workspaces that have these files, one for each nation."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        models = scan.build_models(scan.parse_files(sources(Tables(spark, folder), files))).cache()
        out = views[0](models)
        for view in views[1:]:
            out = out.unionByName(view(models))
        return out

    QUERIES[name] = run
    SQL[name] = expected_sql(expected)


story(
    "ddl_of_postgres",
    {
        "db/schema.sql": "CREATE TYPE weather_@N AS ENUM ('calm', 'rough');\nALTER TYPE weather_@N ADD VALUE 'wild';\n"
        "CREATE TABLE crews (id serial PRIMARY KEY, name varchar(20) DEFAULT 'none' NOT NULL, since timestamp with time zone DEFAULT now(), likes weather_@N, tags text[], lead int, CONSTRAINT one_name UNIQUE (name));\n"
        "CREATE TABLE scrap (id int);\nDROP TABLE scrap;\n"
        "CREATE TABLE bunks (deck int, number int, crew int, PRIMARY KEY (deck, number), FOREIGN KEY (crew) REFERENCES crews (id) ON DELETE SET NULL ON UPDATE CASCADE);\n"
        "CREATE INDEX bunk_crew ON bunks (crew, lower(number));\nCREATE UNIQUE INDEX bunk_number ON bunks (number);\n"
        "CREATE VIEW calm_crews AS SELECT c.id, c.name AS called FROM crews c;\n"
        "COMMENT ON TABLE bunks IS 'where they sleep';\nCOMMENT ON COLUMN bunks.number IS 'by the door';\n"
        "ALTER TABLE crews ADD COLUMN size int NOT NULL;\nALTER TABLE crews RENAME COLUMN lead TO captain;\nALTER TABLE crews ALTER COLUMN size SET DEFAULT 4;\nINSERT INTO crews VALUES (1);\n"
    },
    (entities, columns, indexes, enums, relations),
    [
        ("entity", "bunks", "table declared high -- where they sleep"),
        ("entity", "calm_crews", "view declared high"),
        ("entity", "crews", "table declared high"),
        ("column", "bunks.deck", "1 int key"),
        ("column", "bunks.number", "2 int key -- by the door"),
        ("column", "bunks.crew", "3 int? -> crews.id"),
        ("column", "calm_crews.id", "1 ?"),
        ("column", "calm_crews.called", "2 ?"),
        ("column", "crews.id", "1 serial key generated"),
        ("column", "crews.name", "2 varchar(20) unique = 'none'"),
        ("column", "crews.since", "3 timestamp with time zone? = now()"),
        ("column", "crews.likes", "4 weather_@N? in weather_@N"),
        ("column", "crews.tags", "5 text[]? array"),
        ("column", "crews.captain", "6 int?"),
        ("column", "crews.size", "7 int = 4"),
        ("index", "bunks", "unique number"),
        ("index", "bunks", "crew"),
        ("index", "crews", "unique name"),
        ("enum", "weather_@N", "calm,rough,wild"),
        ("relation", "bunks(crew)>crews", "many-to-one foreign-key optional SET NULL high"),
    ],
)
story(
    "ddl_of_mysql_and_sql_server",
    {
        "db/mysql.sql": "CREATE TABLE `gulls_@N` (`id` int unsigned NOT NULL AUTO_INCREMENT, `kind` enum('herring','laughing') NOT NULL, `seen` datetime DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY (`id`), KEY `by_kind` (`kind`)) ENGINE=InnoDB;\n"
        "CREATE TABLE terns (id int, old varchar(5));\nRENAME TABLE terns TO skuas;\nALTER TABLE skuas CHANGE old age varchar(9) NOT NULL, MODIFY id bigint;\n",
        "db/server.sql": "CREATE TABLE [dbo].[Depots] ([Id] int IDENTITY(1,1) PRIMARY KEY, [Name] nvarchar(30))\nGO\nEXEC sp_rename 'Depots.Name', 'Title', 'COLUMN'\nGO\nEXEC sp_rename 'dbo.Depots', 'Stores'\nGO\n",
    },
    (columns, indexes, enums, engines),
    [
        ("column", "gulls_@N.id", "1 int unsigned key generated"),
        ("column", "gulls_@N.kind", "2 enum('herring','laughing') in gulls_@N_kind"),
        ("column", "gulls_@N.seen", "3 datetime? = CURRENT_TIMESTAMP"),
        ("column", "skuas.id", "1 bigint?"),
        ("column", "skuas.age", "2 varchar(9)"),
        ("column", "stores.Id", "1 int key generated"),
        ("column", "stores.Title", "2 nvarchar(30)?"),
        ("index", "gulls_@N", "kind"),
        ("enum", "gulls_@N_kind", "herring,laughing"),
        ("engine", "0 mysql", "db/mysql.sql:0:MySQL syntax (ENGINE= / AUTO_INCREMENT)"),
        ("engine", "1 sqlserver", "db/server.sql:0:SQL Server syntax (IDENTITY / brackets)"),
    ],
)
story(
    "migrations_in_order",
    {
        "db/migration/V10__last.sql": "ALTER TABLE sails RENAME TO sheets;\n",
        "db/migration/V2__more.sql": "ALTER TABLE sails ADD COLUMN area int;\nCREATE TABLE ropes (id int PRIMARY KEY, sails_id int);\nCREATE TABLE lost_@N (id int);\n",
        "db/migration/V1__first.sql": "CREATE TABLE sails (id int PRIMARY KEY, cloth text, tear text);\n",
        "db/migration/V3_1__drop.sql": "ALTER TABLE sails DROP COLUMN tear;\nDROP TABLE lost_@N;\nALTER TABLE ropes ADD CONSTRAINT held FOREIGN KEY (sails_id) REFERENCES sails (id);\n",
        "db/migration/U2__undo.sql": "DROP TABLE ropes;\n",
        "goose/00001_knots.sql": "-- +goose Up\nCREATE TABLE knots (id int PRIMARY KEY, turns int);\n-- +goose Down\nDROP TABLE knots;\n",
        "alembic/versions/b2_second.py": 'from alembic import op\nimport sqlalchemy as sa\nrevision = "b2"\ndown_revision = "c1"\n\ndef upgrade():\n    op.alter_column("buoys", "tint", new_column_name="colour")\n\ndef downgrade():\n    op.drop_table("buoys")\n',
        "alembic/versions/c1_first.py": 'from alembic import op\nimport sqlalchemy as sa\nrevision = "c1"\ndown_revision = None\n\ndef upgrade():\n    op.create_table("buoys", sa.Column("id", sa.Integer(), primary_key=True), sa.Column("tint", sa.String(9)))\n\ndef downgrade():\n    pass\n',
    },
    (columns, relations),
    [
        ("column", "sheets.id", "1 int key"),
        ("column", "sheets.cloth", "2 text?"),
        ("column", "sheets.area", "3 int?"),
        ("column", "ropes.id", "1 int key"),
        ("column", "ropes.sails_id", "2 int? -> sheets.id"),
        ("column", "knots.id", "1 int key"),
        ("column", "knots.turns", "2 int?"),
        ("column", "buoys.id", "1 Integer key"),
        ("column", "buoys.colour", "2 String(9)?"),
        ("relation", "ropes(sails_id)>sheets", "many-to-one foreign-key optional high"),
    ],
)
story(
    "definitions_over_history",
    {
        "prisma/schema.prisma": "model Lamp@N {\n  id   Int    @id\n  glow String\n}\n",
        "prisma/migrations/1_init/migration.sql": 'CREATE TABLE "Lamp@N" (id SERIAL PRIMARY KEY, glow TEXT, oil int);\nCREATE INDEX by_glow ON "Lamp@N" (glow);\nCREATE INDEX by_oil ON "Lamp@N" (oil);\nCREATE TABLE wicks (id int PRIMARY KEY);\n',
        "db/extra.sql": "CREATE INDEX by_id ON ghosts (id);\n",
    },
    (entities, columns, indexes, kinds),
    [
        ("entity", "lamp@N", "table declared high"),
        ("entity", "wicks", "table declared high"),
        ("column", "lamp@N.id", "1 Int key generated"),
        ("column", "lamp@N.glow", "2 String"),
        ("column", "wicks.id", "1 int key"),
        ("index", "lamp@N", "glow"),
        ("source", "0 sql", "2 2"),
        ("source", "1 prisma", "1 1"),
    ],
)
story(
    "guessed_names_meet_tables",
    {
        "src/tide.entity.ts": 'import { Entity, PrimaryGeneratedColumn, Column } from "typeorm";\n@Entity()\nexport class Tide {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column()\n  heightCm: number;\n}\n@Entity()\nexport class Lagoon {\n  @PrimaryGeneratedColumn()\n  id: number;\n}\n',
        "db/schema.sql": "CREATE TABLE tides (id int PRIMARY KEY, height_cm int, moon text);\nCREATE TABLE reefs_@N (id int PRIMARY KEY, tide_id int REFERENCES tides (id));\n",
    },
    (entities, relations, order),
    [
        ("entity", "lagoon", "table guessed medium"),
        ("entity", "reefs_@N", "table declared high"),
        ("entity", "tides", "table declared high"),
        ("relation", "reefs_@N(tide_id)>tides", "many-to-one foreign-key optional high"),
        ("place in entities", "lagoon", "0"),
        ("place in entities", "reefs_@N", "1"),
        ("place in entities", "tides", "2"),
        ("place in relations", "reefs_@N(tide_id)>tides", "0"),
    ],
)
story(
    "bases_owned_and_shared",
    {
        "fleet/models.py": "from django.db import models\n\nclass Stamped(models.Model):\n    made = models.DateTimeField()\n    maker = models.ForeignKey('Sailor', on_delete=models.CASCADE)\n\n    class Meta:\n        abstract = True\n\nclass Sailor(models.Model):\n    name = models.TextField()\n\n    class Meta:\n        db_table = 'sailors'\n\nclass Log(Stamped):\n    words = models.TextField()\n\n    class Meta:\n        db_table = 'logs_@N'\n",
        "Data/Place.cs": "public class Spot\n{\n    public int Lat { get; set; }\n    public int Lon { get; set; }\n}\npublic class Wreck\n{\n    public int Id { get; set; }\n    public Spot Where { get; set; }\n}\npublic class WreckDto\n{\n    public int Id { get; set; }\n}\n",
        "Data/SeaContext.cs": "using Microsoft.EntityFrameworkCore;\npublic class SeaContext : DbContext\n{\n    public DbSet<Wreck> Wrecks { get; set; }\n    protected override void OnModelCreating(ModelBuilder b)\n    {\n        b.Entity<Wreck>().OwnsOne(w => w.Where);\n    }\n}\n",
        "db/schema.rb": 'ActiveRecord::Schema.define(version: 1) do\n  create_table "boats" do |t|\n    t.string "type"\n    t.string "name"\n  end\nend\n',
        "app/models/boat.rb": "class Boat < ApplicationRecord\nend\n",
        "app/models/tug.rb": "class Tug < Boat\nend\n",
    },
    (entities, relations),
    [
        ("entity", "boats", "table declared high"),
        ("entity", "logs_@N", "table declared high"),
        ("entity", "sailors", "table declared high"),
        ("entity", "wrecks", "table guessed medium"),
        ("relation", "logs_@N(maker_id)>sailors", "many-to-one orm CASCADE medium"),
    ],
)
story(
    "references_found",
    {
        "db/schema.sql": "CREATE TABLE ports (id int PRIMARY KEY);\nCREATE TABLE north.ports (id int PRIMARY KEY);\nCREATE TABLE north.piers (id int PRIMARY KEY, port int REFERENCES ports (id), far int REFERENCES public.ports (id));\nCREATE TABLE cranes_@N (id int PRIMARY KEY, pier int REFERENCES piers (ID), owner int REFERENCES guilds (id));\n",
        "app/models/ghost.rb": "class Ghost < ApplicationRecord\n  belongs_to :port\nend\n",
    },
    (entities, columns, relations),
    [
        ("entity", "ports", "table declared high"),
        ("entity", "north.ports", "table declared high"),
        ("entity", "north.piers", "table declared high"),
        ("entity", "cranes_@N", "table declared high"),
        ("entity", "ghosts", "table guessed medium"),
        ("entity", "guilds", "table external external low"),
        ("column", "ports.id", "1 int key"),
        ("column", "north.ports.id", "1 int key"),
        ("column", "north.piers.id", "1 int key"),
        ("column", "north.piers.port", "2 int? -> ports.id"),
        ("column", "north.piers.far", "3 int? -> ports.id"),
        ("column", "cranes_@N.id", "1 int key"),
        ("column", "cranes_@N.pier", "2 int? -> north.piers.id"),
        ("column", "cranes_@N.owner", "3 int? -> guilds.id"),
        ("column", "ghosts.port_id", "1 int? implied -> ports.id"),
        ("column", "guilds.id", "1  key"),
        ("relation", "north.piers(port)>ports", "many-to-one foreign-key optional high"),
        ("relation", "north.piers(far)>ports", "many-to-one foreign-key optional high"),
        ("relation", "cranes_@N(pier)>north.piers", "many-to-one foreign-key optional high"),
        ("relation", "cranes_@N(owner)>guilds", "many-to-one foreign-key optional low"),
        ("relation", "ghosts(port_id)>ports", "many-to-one orm optional medium"),
    ],
)
story(
    "links_that_meet",
    {
        "db/schema.rb": 'ActiveRecord::Schema.define(version: 1) do\n  create_table "pilots" do |t|\n    t.string "name", null: false\n    t.bigint "chart_id", null: false\n    t.index ["name"], unique: true\n  end\n  create_table "charts" do |t|\n    t.string "title"\n  end\n  create_table "badges" do |t|\n    t.bigint "pilot_id", null: false\n    t.index ["pilot_id"], unique: true\n  end\n  add_foreign_key "pilots", "charts"\n  add_foreign_key "badges", "pilots"\nend\n',
        "app/models/pilot.rb": "class Pilot < ApplicationRecord\n  belongs_to :chart\n  has_one :badge\n  has_many :gone_things\nend\n",
        "app/models/chart.rb": "class Chart < ApplicationRecord\n  has_many :pilots\nend\n",
        "app/models/badge.rb": "class Badge < ApplicationRecord\n  belongs_to :pilot\n  belongs_to :chart\nend\n",
        "notes_@N.txt": "nothing",
    },
    (entities, relations, warnings),
    [
        ("entity", "badges", "table declared high"),
        ("entity", "charts", "table declared high"),
        ("entity", "pilots", "table declared high"),
        ("relation", "badges(pilot_id)>pilots", "one-to-one foreign-key high"),
        ("relation", "pilots(chart_id)>charts", "many-to-one foreign-key high"),
        ("warning", "app/models/pilot.rb:3", 'Relation ignored: entity "GoneThing" is not defined in the workspace.'),
        ("warning", "app/models/badge.rb:2", 'Association not drawn: table "badges" has no column "chart_id" (declared in the model, missing in the schema).'),
    ],
)
story(
    "links_inferred",
    {
        "db/schema.sql": "CREATE TABLE boxes (id int PRIMARY KEY);\nCREATE TABLE people (id int PRIMARY KEY, box_id int, peopleId int);\nCREATE TABLE notes (id int PRIMARY KEY, person_id int, subject_id int, subject_type text, nowhere_id int);\nCREATE TABLE subjects (id int PRIMARY KEY);\nCREATE TABLE lids (box_id int PRIMARY KEY);\nCREATE TABLE keys_@N (id int PRIMARY KEY, boxId int UNIQUE);\nCREATE TABLE pairs (a int, b int, PRIMARY KEY (a, b));\nCREATE TABLE uses (pair_id int);\n"
    },
    (relations,),
    [
        ("relation", "people(box_id)>boxes", "many-to-one inferred optional low"),
        ("relation", "people(peopleid)>people", "many-to-one inferred optional low"),
        ("relation", "notes(person_id)>people", "many-to-one inferred optional low"),
        ("relation", "lids(box_id)>boxes", "one-to-one inferred low"),
        ("relation", "keys_@N(boxid)>boxes", "one-to-one inferred optional low"),
    ],
)
story(
    "tables_that_join",
    {
        "db/schema.sql": "CREATE TABLE crews (id int PRIMARY KEY);\nCREATE TABLE skills (id int PRIMARY KEY);\nCREATE TABLE crew_skills (crew_id int REFERENCES crews (id), skill_id int REFERENCES skills (id), created_at timestamp, PRIMARY KEY (crew_id, skill_id));\n"
        "CREATE TABLE trips_@N (id int PRIMARY KEY, crew_id int REFERENCES crews (id), skill_id int REFERENCES skills (id), miles int);\nCREATE TABLE bonds (id int PRIMARY KEY, one int REFERENCES crews (id), two int REFERENCES skills (id));\n",
        "app/models.prisma": "model Deck {\n  id     Int    @id\n  sails  Sail[]\n}\nmodel Sail {\n  id    Int    @id\n  decks Deck[]\n}\n",
    },
    (entities, relations),
    [
        ("entity", "bonds", "table declared high"),
        ("entity", "crew_skills", "table junction declared high"),
        ("entity", "crews", "table declared high"),
        ("entity", "deck", "table declared high"),
        ("entity", "sail", "table declared high"),
        ("entity", "skills", "table declared high"),
        ("entity", "trips_@N", "table declared high"),
        ("relation", "bonds(one)>crews", "many-to-one foreign-key optional high"),
        ("relation", "bonds(two)>skills", "many-to-one foreign-key optional high"),
        ("relation", "crew_skills(crew_id)>crews", "many-to-one foreign-key high"),
        ("relation", "crew_skills(skill_id)>skills", "many-to-one foreign-key high"),
        ("relation", "crews<>skills@crew_skills", "many-to-many foreign-key optional high via crew_skills"),
        ("relation", "deck<>sail@_decktosail", "many-to-many orm optional medium"),
        ("relation", "trips_@N(crew_id)>crews", "many-to-one foreign-key optional high"),
        ("relation", "trips_@N(skill_id)>skills", "many-to-one foreign-key optional high"),
    ],
)
story(
    "enums_linked",
    {
        "prisma/schema.prisma": "enum Flag {\n  RED\n  BLUE\n}\nmodel Mast@N {\n  id   Int  @id\n  flag Flag\n}\n",
        "db/migrations/001.sql": "CREATE TYPE wind AS ENUM ('low');\nCREATE TYPE gone AS ENUM ('x');\nCREATE TABLE vanes (id int PRIMARY KEY, now wind, past wind[]);\n",
        "db/migrations/002.sql": "ALTER TYPE wind ADD VALUE 'high';\nDROP TYPE gone;\nALTER TYPE wind RENAME TO winds;\n",
    },
    (enums, columns, order),
    [
        ("enum", "flag", "RED,BLUE"),
        ("enum", "winds", "low,high"),
        ("column", "mast@N.id", "1 Int key"),
        ("column", "mast@N.flag", "2 Flag in flag"),
        ("column", "vanes.id", "1 int key"),
        ("column", "vanes.now", "2 wind?"),
        ("column", "vanes.past", "3 wind[]? array"),
        ("place in entities", "mast@N", "0"),
        ("place in entities", "vanes", "1"),
        ("place in enums", "flag", "0"),
        ("place in enums", "winds", "1"),
    ],
)
story(
    "engines_hinted",
    {
        "docker-compose.yml": "services:\n  db:\n    image: ${DB:-postgres:16}\n  cache:\n    image: redis:7\n  admin:\n    image: dpage/pgadmin4\n",
        "package.json": '{\n  "dependencies": {\n    "pg": "^8.0.0",\n    "left-pad": "1.0.0"\n  }\n}\n',
        "requirements.txt": "psycopg2==2.9\npymongo>=4\n",
        "go.mod": "module x\n\nrequire (\n\tgithub.com/jackc/pgx/v5 v5.5.0\n)\n",
        "pyproject.toml": '[tool.poetry.dependencies]\npython = "^3.12"\nasyncpg = "*"\n\n[tool.other]\nmysqlclient = "x"\n',
        ".env.example": "DATABASE_URL=postgresql://u:secret@host/db@N\n",
        "src/main/resources/application.properties": "spring.datasource.url=jdbc:postgresql://h/db\n",
        "config/database.yml": "default:\n  adapter: postgresql\n",
        "db/schema.sql": "CREATE TABLE crabs (id int PRIMARY KEY);\n",
        "models/shell.js": "const mongoose = require('mongoose');\nmodule.exports = mongoose.model('Shell', new mongoose.Schema({ size: Number }));\n",
    },
    (engines, kinds),
    [
        ('engine', '0 postgresql', '.env.example:0:DATABASE_URL uses postgresql://'),
        ('engine', '0 postgresql', 'config/database.yml:1:database.yml adapter "postgresql"'),
        ('engine', '0 postgresql', 'docker-compose.yml:2:docker compose image "postgres:16"'),
        ('engine', '0 postgresql', 'go.mod:3:dependency "github.com/jackc/pgx/v5"'),
        ('engine', '0 postgresql', 'package.json:2:dependency "pg"'),
        ('engine', '0 postgresql', 'pyproject.toml:2:dependency "asyncpg"'),
        ('engine', '0 postgresql', 'requirements.txt:0:dependency "psycopg2"'),
        ('engine', '0 postgresql', 'src/main/resources/application.properties:0:spring.datasource.url uses jdbc:postgresql:'),
        ('engine', '1 mongodb', 'models/shell.js:1:Mongoose schema'),
        ('engine', '1 mongodb', 'requirements.txt:1:dependency "pymongo"'),
        ('engine', '2 redis', 'docker-compose.yml:4:docker compose image "redis:7"'),
        ('source', '0 mongoose', '1 1'),
        ('source', '1 sql', '1 1'),
    ],
)
