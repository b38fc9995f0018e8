"""Queries: one for each reader of schema declarations, over sources made from nations and their regions.

Every nation is a workspace: a harbour of its region and a ship that calls it
home, declared the way each technology does it, and once more inside comments,
where nothing may be read.  The expected columns and relations are written out
by hand from the technologies' documentation, so the SQL does not share a line
with the readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.parsers import READERS
from tessera.plans.registry import QUERIES, SQL, Tables

#: Stand for the keys of the nation and of its region.
NATION, REGION = "@N", "@R"
#: The files of each reader's query.
FILES: dict[str, dict[str, str]] = {}
#: What begins a comment to the end of the line, by extension.
COMMENTS = {"--": ("sql",), "#": ("py", "rb", "exs", "graphql"), "//": ("dbml", "rs", "prisma", "zmodel", "ts", "js", "php", "go", "java", "kt", "cs")}


def filled(text: str) -> Column:
    return F.replace(F.replace(F.lit(text), F.lit(NATION), F.col("n_nationkey").cast("string")), F.lit(REGION), F.col("n_regionkey").cast("string"))


def sources(t: Tables, files: dict[str, str]) -> DataFrame:
    """Files of one workspace for each nation: (workspace, path, text)."""
    each = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), filled(text).alias("text")) for path, text in files.items()]))
    rows = t.nation.select(F.concat(F.lit("w"), "n_nationkey").alias("workspace"), "n_nationkey", each.alias("file"))
    return rows.select("workspace", "file.*")


def with_comments(path: str, text: str) -> str:
    """The text, and after it the same about ghosts as comments."""
    ghost = text.replace("arbour", "aunt").replace("hip", "host")
    extension = path.rpartition(".")[2]
    if extension == "xml":
        return f"{text}\n<!-- {ghost} -->\n"
    mark = next(m for m, extensions in COMMENTS.items() if extension in extensions)
    return text + "".join(f"{mark} {line}\n" for line in ghost.split("\n"))


def columns_and_relations(models: DataFrame) -> DataFrame:
    """What models say as rows (workspace, part, name, detail)."""
    mark = lambda c, yes: F.when(F.col(c), yes).otherwise("")
    own = scan.entities(models).where("external IS NULL").select("workspace", F.col("id").alias("entity_id"))
    columns = scan.columns(models).join(own, ["workspace", "entity_id"], "left_semi").select(
        "workspace", F.lit("column").alias("part"), F.concat_ws(".", "entity_id", "name").alias("name"),
        F.concat(F.col("type"), mark("nullable", "?"), mark("primary_key", " key"), mark("unique", " unique")).alias("detail"),
    )
    relations = scan.relations(models).select(
        "workspace", F.lit("relation").alias("part"), F.col("id").alias("name"),
        F.concat_ws(" ", "cardinality", "kind", F.when(F.col("optional"), "optional"), "on_delete").alias("detail"),
    )
    return columns.unionByName(relations)


def expected_sql(rows: list[tuple[str, str, str]]) -> str:
    """The same rows (part, name, detail) for each nation."""
    rows = rows or [("", "", "")]
    values = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)
    fill = lambda c: f"replace(replace(v.{c}, '{NATION}', CAST(n_nationkey AS VARCHAR)), '{REGION}', CAST(n_regionkey AS VARCHAR))"
    return f"SELECT 'w' || n_nationkey AS workspace, v.part, {fill('name')} AS name, {fill('detail')} AS detail FROM nation CROSS JOIN (VALUES {values}) AS v(part, name, detail)"


def reader(kind: str, files: dict[str, str], columns: dict[str, str], relations: dict[str, str]) -> None:
    """Register ``read_<kind>``; only that reader looks at the files, so that each query tells of one."""
    FILES[kind] = files = {path: with_comments(path, text) for path, text in files.items()}

    def run(spark: SparkSession, folder: str) -> DataFrame:
        others = tuple(k for k in READERS if k != kind)
        return columns_and_relations(scan.build_models(scan.parse_files(sources(Tables(spark, folder), files), others)))

    QUERIES[f"read_{kind}"] = run
    SQL[f"read_{kind}"] = expected_sql([("column", *x) for x in columns.items()] + [("relation", *x) for x in relations.items()])


reader(
    "sql",
    {"db/schema.sql": "CREATE TABLE harbour_@R (code int PRIMARY KEY, city varchar(40) NOT NULL UNIQUE);\nCREATE TABLE ship_@N (id bigint PRIMARY KEY, name text, home int NOT NULL REFERENCES harbour_@R (code) ON DELETE CASCADE);\n"},
    {"harbour_@R.code": "int key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "int"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key CASCADE"},
)
reader(
    "dbml",
    {"docs/fleet.dbml": "Table harbour_@R {\n  code int [pk]\n  city varchar(40) [not null, unique]\n}\nTable ship_@N {\n  id bigint [pk]\n  name text\n  home int [not null]\n}\nRef: ship_@N.home > harbour_@R.code [delete: cascade]\n"},
    {"harbour_@R.code": "int key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "int"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key CASCADE"},
)
reader(
    "diesel",
    {"src/tables.rs": "diesel::table! {\n    harbour_@R (code) {\n        code -> Int4,\n        city -> Varchar,\n    }\n}\ndiesel::table! {\n    ship_@N (id) {\n        id -> Int8,\n        name -> Nullable<Text>,\n        home -> Int4,\n    }\n}\ndiesel::joinable!(ship_@N -> harbour_@R (home));\n"},
    {"harbour_@R.code": "Int4 key", "harbour_@R.city": "Varchar", "ship_@N.id": "Int8 key", "ship_@N.name": "Text?", "ship_@N.home": "Int4"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key"},
)
reader(
    "liquibase",
    {
        "db/changelog/fleet.xml": '<databaseChangeLog><changeSet id="1" author="x"><createTable tableName="harbour_@R"><column name="code" type="int"><constraints primaryKey="true" nullable="false"/></column>'
        '<column name="city" type="varchar(40)"><constraints nullable="false" unique="true"/></column></createTable><createTable tableName="ship_@N"><column name="id" type="bigint"><constraints primaryKey="true"/></column>'
        '<column name="label" type="clob"/><column name="home" type="int"/></createTable></changeSet><changeSet id="2" author="x"><renameColumn tableName="ship_@N" oldColumnName="label" newColumnName="name"/>'
        '<addNotNullConstraint tableName="ship_@N" columnName="home"/><addForeignKeyConstraint constraintName="home_fk" baseTableName="ship_@N" baseColumnNames="home" referencedTableName="harbour_@R" referencedColumnNames="code" onDelete="CASCADE"/></changeSet></databaseChangeLog>'
    },
    {"harbour_@R.code": "int key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "clob?", "ship_@N.home": "int"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key CASCADE"},
)
reader(
    "prisma",
    {"prisma/fleet.prisma": 'model Harbour@R {\n  code  Int    @id\n  city  String @unique\n  ships Ship@N[]\n  @@map("harbour_@R")\n}\nmodel Ship@N {\n  id     BigInt  @id\n  name   String?\n  homeId Int     @map("home")\n  home   Harbour@R @relation(fields: [homeId], references: [code], onDelete: Cascade)\n  @@map("ship_@N")\n}\n'},
    {"harbour_@R.code": "Int key", "harbour_@R.city": "String unique", "ship_@N.id": "BigInt key", "ship_@N.name": "String?", "ship_@N.home": "Int"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm Cascade"},
)
reader(
    "typeorm",
    {
        "src/harbour.entity.ts": 'import { Entity, PrimaryColumn, Column, OneToMany } from "typeorm";\n@Entity("harbour_@R")\nexport class Harbour {\n  @PrimaryColumn("int")\n  code: number;\n  @Column("varchar", { length: 40, unique: true })\n  city: string;\n  @OneToMany(() => Ship, (s) => s.home)\n  ships: Ship[];\n}\n',
        "src/ship.entity.ts": 'import { Entity, PrimaryColumn, Column, ManyToOne, JoinColumn } from "typeorm";\n@Entity("ship_@N")\nexport class Ship {\n  @PrimaryColumn("bigint")\n  id: string;\n  @Column("text", { nullable: true })\n  name: string | null;\n  @ManyToOne(() => Harbour, (h) => h.ships, { nullable: false, onDelete: "CASCADE" })\n  @JoinColumn({ name: "home" })\n  home: Harbour;\n}\n',
    },
    {"harbour_@R.code": "int key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": ""},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "mikroorm",
    {
        "src/fleet.ts": "import { Entity, PrimaryKey, Property, ManyToOne } from '@mikro-orm/core';\n@Entity({ tableName: 'harbour_@R' })\nexport class Harbour {\n  @PrimaryKey({ type: 'int' })\n  code!: number;\n  @Property({ columnType: 'varchar(40)', unique: true })\n  city!: string;\n}\n"
        "@Entity({ tableName: 'ship_@N' })\nexport class Ship {\n  @PrimaryKey({ type: 'bigint' })\n  id!: bigint;\n  @Property({ type: 'text', nullable: true })\n  name?: string;\n  @ManyToOne(() => Harbour, { fieldName: 'home' })\n  home!: Harbour;\n}\n"
    },
    {"harbour_@R.code": "int key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "?"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm optional"},
)
reader(
    "drizzle",
    {
        "src/tables.ts": "import { pgTable as table, integer, bigint, text, varchar } from 'drizzle-orm/pg-core';\nconst named = { name: text('name') };\nexport const harbours = table('harbour_@R', { code: integer('code').primaryKey(), city: varchar('city', { length: 40 }).notNull().unique() });\n"
        "export const ships = table('ship_@N', { id: bigint('id', { mode: 'number' }).primaryKey(), ...named, home: integer('home').notNull().references(() => harbours.code, { onDelete: 'cascade' }) });\n"
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key cascade"},
)
reader(
    "sequelize",
    {
        "models/fleet.js": "const { DataTypes } = require('sequelize');\nmodule.exports = (sequelize) => {\n  const Harbour = sequelize.define('Harbour', { code: { type: DataTypes.INTEGER, primaryKey: true }, city: { type: DataTypes.STRING(40), allowNull: false, unique: true } }, { tableName: 'harbour_@R', timestamps: false });\n"
        "  const Ship = sequelize.define('Ship', { id: { type: DataTypes.BIGINT, primaryKey: true }, name: DataTypes.TEXT, home: { type: DataTypes.INTEGER, allowNull: false } }, { tableName: 'ship_@N', timestamps: false });\n  Ship.belongsTo(Harbour, { foreignKey: 'home' });\n};\n"
    },
    {"harbour_@R.code": "INTEGER key", "harbour_@R.city": "STRING(40) unique", "ship_@N.id": "BIGINT key", "ship_@N.name": "TEXT?", "ship_@N.home": "INTEGER"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm"},
)
reader(
    "mongoose",
    {
        "models/fleet.js": "const mongoose = require('mongoose');\nconst harbourSchema = new mongoose.Schema({ city: { type: String, required: true, unique: true } }, { collection: 'harbour_@R' });\nconst shipSchema = new mongoose.Schema({ name: String, home: { type: mongoose.Schema.Types.ObjectId, ref: 'Harbour', required: true } }, { collection: 'ship_@N' });\n"
        "module.exports = { Harbour: mongoose.model('Harbour', harbourSchema), Ship: mongoose.model('Ship', shipSchema) };\n"
    },
    {"doc:harbour_@R._id": "ObjectId key", "doc:harbour_@R.city": "String unique", "doc:ship_@N._id": "ObjectId key", "doc:ship_@N.name": "String?", "doc:ship_@N.home": "ObjectId"},
    {"doc:ship_@N(home)>doc:harbour_@R": "many-to-one orm"},
)
reader(
    "knex",
    {
        "migrations/1_fleet.js": "exports.up = async (knex) => {\n  await knex.schema.createTable('harbour_@R', (t) => {\n    t.integer('code').primary();\n    t.string('city', 40).notNullable().unique();\n  });\n  await knex.schema.createTable('ship_@N', (t) => {\n    t.bigInteger('id').primary();\n    t.text('label');\n    t.integer('home').notNullable().references('code').inTable('harbour_@R').onDelete('CASCADE');\n  });\n};\nexports.down = (knex) => knex.schema.dropTable('ship_@N');\n",
        "migrations/2_names.js": "exports.up = (knex) => knex.schema.alterTable('ship_@N', (t) => {\n  t.renameColumn('label', 'name');\n});\n",
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key CASCADE"},
)
reader(
    "kysely",
    {
        "migrations/1_fleet.ts": "import { Kysely } from 'kysely';\nexport async function up(db: Kysely<any>) {\n  await db.schema.createTable('harbour_@R').addColumn('code', 'integer', (c) => c.primaryKey()).addColumn('city', 'varchar(40)', (c) => c.notNull().unique()).execute();\n"
        "  await db.schema.createTable('ship_@N').addColumn('id', 'bigint', (c) => c.primaryKey()).addColumn('name', 'text').addColumn('home', 'integer', (c) => c.notNull().references('harbour_@R.code').onDelete('cascade')).execute();\n}\nexport async function down(db: Kysely<any>) {\n  await db.schema.dropTable('ship_@N').execute();\n}\n"
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key cascade"},
)
reader(
    "django",
    {
        "fleet/models.py": 'from django.db import models\n\nclass Harbour(models.Model):\n    code = models.IntegerField(primary_key=True)\n    city = models.CharField(max_length=40, unique=True)\n\n    class Meta:\n        db_table = "harbour_@R"\n\nclass Ship(models.Model):\n    name = models.TextField(null=True)\n    home = models.ForeignKey(Harbour, on_delete=models.CASCADE, db_column="home")\n\n    class Meta:\n        db_table = "ship_@N"\n'
    },
    {"harbour_@R.code": "IntegerField key", "harbour_@R.city": "CharField unique", "ship_@N.id": "BigAutoField key", "ship_@N.name": "TextField?", "ship_@N.home": ""},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "sqlalchemy",
    {
        "fleet/tables.py": 'from sqlalchemy import BigInteger, Column, ForeignKey, Integer, String, Text\nfrom sqlalchemy.orm import DeclarativeBase\n\nclass Base(DeclarativeBase):\n    pass\n\nclass Harbour(Base):\n    __tablename__ = "harbour_@R"\n    code = Column(Integer, primary_key=True)\n    city = Column(String(40), nullable=False, unique=True)\n\n'
        'class Ship(Base):\n    __tablename__ = "ship_@N"\n    id = Column(BigInteger, primary_key=True)\n    name = Column(Text)\n    home = Column(Integer, ForeignKey("harbour_@R.code", ondelete="CASCADE"), nullable=False)\n'
    },
    {"harbour_@R.code": "Integer key", "harbour_@R.city": "String(40) unique", "ship_@N.id": "BigInteger key", "ship_@N.name": "Text?", "ship_@N.home": "Integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key CASCADE"},
)
reader(
    "sqlmodel",
    {
        "fleet/models.py": 'from sqlmodel import Field, SQLModel\n\nclass Harbour(SQLModel, table=True):\n    __tablename__ = "harbour_@R"\n    code: int = Field(primary_key=True)\n    city: str = Field(unique=True)\n\nclass Named(SQLModel):\n    name: str | None = None\n\nclass Ship(Named, table=True):\n    __tablename__ = "ship_@N"\n    id: int = Field(primary_key=True)\n    home: int = Field(foreign_key="harbour_@R.code")\n'
    },
    {"harbour_@R.code": "int key", "harbour_@R.city": "str unique", "ship_@N.name": "str?", "ship_@N.id": "int key", "ship_@N.home": "int"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm"},
)
reader(
    "peewee",
    {
        "fleet/models.py": "from peewee import AutoField, CharField, ForeignKeyField, IntegerField, Model, TextField\n\nclass Harbour(Model):\n    code = IntegerField(primary_key=True)\n    city = CharField(max_length=40, unique=True)\n\n    class Meta:\n        table_name = 'harbour_@R'\n\nclass Ship(Model):\n    name = TextField(null=True)\n    home = ForeignKeyField(Harbour, column_name='home', on_delete='CASCADE')\n\n    class Meta:\n        table_name = 'ship_@N'\n"
    },
    {"harbour_@R.code": "IntegerField key", "harbour_@R.city": "CharField unique", "ship_@N.id": "AutoField key", "ship_@N.name": "TextField?", "ship_@N.home": ""},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "tortoise",
    {
        "fleet/models.py": 'from tortoise import fields\nfrom tortoise.models import Model\n\nclass Harbour(Model):\n    code = fields.IntField(primary_key=True)\n    city = fields.CharField(max_length=40, unique=True)\n\n    class Meta:\n        table = "harbour_@R"\n\nclass Ship(Model):\n    name = fields.TextField(null=True)\n    home = fields.ForeignKeyField("models.Harbour", source_field="home", on_delete=fields.CASCADE)\n\n    class Meta:\n        table = "ship_@N"\n'
    },
    {"harbour_@R.code": "IntField key", "harbour_@R.city": "CharField unique", "ship_@N.id": "IntField key", "ship_@N.name": "TextField?", "ship_@N.home": ""},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "rails",
    {
        "db/migrate/20240101000000_create_fleet.rb": 'class CreateFleet < ActiveRecord::Migration[7.1]\n  def change\n    create_table :harbour_@R, id: false do |t|\n      t.integer :code, primary_key: true, null: false\n      t.string :city, limit: 40, null: false\n    end\n    create_table :ship_@N do |t|\n      t.text :label\n      t.integer :home, null: false\n    end\n    add_foreign_key :ship_@N, :harbour_@R, column: :home, primary_key: :code, on_delete: :cascade\n  end\nend\n',
        "db/migrate/20240201000000_rename.rb": "class Rename < ActiveRecord::Migration[7.1]\n  def change\n    rename_column :ship_@N, :label, :name\n    add_index :harbour_@R, :city, unique: true\n  end\nend\n",
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "string(40)", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key CASCADE"},
)
reader(
    "laravel",
    {
        "database/migrations/2024_01_01_000000_fleet.php": "<?php\nuse Illuminate\\Database\\Migrations\\Migration;\nuse Illuminate\\Database\\Schema\\Blueprint;\nuse Illuminate\\Support\\Facades\\Schema;\nreturn new class extends Migration {\n    public function up(): void {\n        Schema::create('harbour_@R', function (Blueprint $table) {\n            $table->integer('code')->primary();\n            $table->string('city', 40)->unique();\n        });\n"
        "        Schema::create('ship_@N', function (Blueprint $table) {\n            $table->id();\n            $table->text('name')->nullable();\n            $table->integer('home');\n            $table->foreign('home')->references('code')->on('harbour_@R')->onDelete('cascade');\n        });\n    }\n    public function down(): void {\n        Schema::dropIfExists('ship_@N');\n    }\n};\n"
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "string unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key cascade"},
)
reader(
    "doctrine",
    {
        "src/Entity/Fleet.php": "<?php\nnamespace App\\Entity;\nuse Doctrine\\ORM\\Mapping as ORM;\n#[ORM\\Entity]\n#[ORM\\Table(name: 'harbour_@R')]\nclass Harbour {\n    #[ORM\\Id]\n    #[ORM\\Column(type: 'integer')]\n    private int $code;\n    #[ORM\\Column(length: 40, unique: true)]\n    private string $city;\n}\n"
        "#[ORM\\Entity]\n#[ORM\\Table(name: 'ship_@N')]\nclass Ship {\n    #[ORM\\Id]\n    #[ORM\\Column(type: 'bigint')]\n    private int $id;\n    #[ORM\\Column(type: 'text', nullable: true)]\n    private ?string $name;\n    #[ORM\\ManyToOne(targetEntity: Harbour::class)]\n    #[ORM\\JoinColumn(name: 'home', referencedColumnName: 'code', nullable: false, onDelete: 'CASCADE')]\n    private Harbour $home;\n}\n"
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "string unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": ""},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "ecto",
    {
        "priv/repo/migrations/1_fleet.exs": "defmodule Fleet.Repo.Migrations.Fleet do\n  use Ecto.Migration\n\n  def change do\n    create table(:harbour_@R, primary_key: false) do\n      add :code, :integer, primary_key: true\n      add :city, :string, size: 40, null: false\n    end\n\n    create table(:ship_@N) do\n      add :name, :text\n      add :home, references(:harbour_@R, column: :code, type: :integer, on_delete: :delete_all), null: false\n    end\n  end\nend\n"
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "string(40)", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one foreign-key CASCADE"},
)
reader(
    "gorm",
    {
        "fleet/models.go": 'package fleet\n\nimport "gorm.io/gorm"\n\ntype Harbour struct {\n\tCode int `gorm:"primaryKey"`\n\tCity string `gorm:"size:40;not null;unique"`\n}\n\nfunc (Harbour) TableName() string { return "harbour_@R" }\n\ntype Ship struct {\n\tID int64 `gorm:"primaryKey"`\n\tName *string `gorm:"type:text"`\n\tHome int `gorm:"not null"`\n\tPort Harbour `gorm:"foreignKey:Home;references:Code;constraint:OnDelete:CASCADE"`\n}\n\nfunc (Ship) TableName() string { return "ship_@N" }\n\nvar _ = gorm.Model{}\n'
    },
    {"harbour_@R.code": "int key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "int64 key", "ship_@N.name": "text?", "ship_@N.home": "int"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "ent",
    {
        "ent/schema/harbour.go": 'package schema\n\nimport (\n\t"entgo.io/ent"\n\t"entgo.io/ent/dialect/entsql"\n\t"entgo.io/ent/schema"\n\t"entgo.io/ent/schema/field"\n)\n\ntype Harbour struct{ ent.Schema }\n\nfunc (Harbour) Annotations() []schema.Annotation {\n\treturn []schema.Annotation{entsql.Annotation{Table: "harbour_@R"}}\n}\n\nfunc (Harbour) Fields() []ent.Field {\n\treturn []ent.Field{field.String("city").Unique()}\n}\n',
        "ent/schema/ship.go": 'package schema\n\nimport (\n\t"entgo.io/ent"\n\t"entgo.io/ent/dialect/entsql"\n\t"entgo.io/ent/schema"\n\t"entgo.io/ent/schema/edge"\n\t"entgo.io/ent/schema/field"\n)\n\ntype Ship struct{ ent.Schema }\n\nfunc (Ship) Annotations() []schema.Annotation {\n\treturn []schema.Annotation{entsql.Annotation{Table: "ship_@N"}}\n}\n\nfunc (Ship) Fields() []ent.Field {\n\treturn []ent.Field{field.Text("name").Optional(), field.Int("home")}\n}\n\nfunc (Ship) Edges() []ent.Edge {\n\treturn []ent.Edge{edge.To("port", Harbour.Type).Field("home").Unique().Required()}\n}\n',
    },
    {"harbour_@R.id": "int key", "harbour_@R.city": "string unique", "ship_@N.id": "int key", "ship_@N.name": "text?", "ship_@N.home": "int"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm"},
)
reader(
    "bun",
    {
        "fleet/models.go": 'package fleet\n\nimport "github.com/uptrace/bun"\n\ntype Harbour struct {\n\tbun.BaseModel `bun:"table:harbour_@R"`\n\tCode int64 `bun:"code,pk"`\n\tCity string `bun:"city,notnull,unique"`\n}\n\ntype Ship struct {\n\tbun.BaseModel `bun:"table:ship_@N"`\n\tID int64 `bun:"id,pk"`\n\tName string `bun:"name,type:text"`\n\tHome int64 `bun:"home,notnull"`\n\tPort *Harbour `bun:"rel:belongs-to,join:home=code"`\n}\n'
    },
    {"harbour_@R.code": "int64 key", "harbour_@R.city": "string unique", "ship_@N.id": "int64 key", "ship_@N.name": "text?", "ship_@N.home": "int64"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm"},
)
reader(
    "seaorm",
    {
        "src/entity/harbour.rs": 'use sea_orm::entity::prelude::*;\n\n#[derive(Clone, Debug, DeriveEntityModel)]\n#[sea_orm(table_name = "harbour_@R")]\npub struct Model {\n    #[sea_orm(primary_key, auto_increment = false)]\n    pub code: i32,\n    #[sea_orm(unique)]\n    pub city: String,\n}\n',
        "src/entity/ship.rs": 'use sea_orm::entity::prelude::*;\n\n#[derive(Clone, Debug, DeriveEntityModel)]\n#[sea_orm(table_name = "ship_@N")]\npub struct Model {\n    #[sea_orm(primary_key)]\n    pub id: i64,\n    pub name: Option<String>,\n    pub home: i32,\n}\n\n#[derive(Copy, Clone, Debug, EnumIter, DeriveRelation)]\npub enum Relation {\n    #[sea_orm(belongs_to = "super::harbour::Entity", from = "Column::Home", to = "super::harbour::Column::Code", on_delete = "Cascade")]\n    Harbour,\n}\n',
    },
    {"harbour_@R.code": "i32 key", "harbour_@R.city": "String unique", "ship_@N.id": "i64 key", "ship_@N.name": "String?", "ship_@N.home": "i32"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "jpa",
    {
        "src/main/java/fleet/Harbour.java": 'package fleet;\nimport jakarta.persistence.*;\n@Entity\n@Table(name = "harbour_@R")\npublic class Harbour {\n  @Id\n  private int code;\n  @Column(length = 40, nullable = false, unique = true)\n  private String city;\n}\n',
        "src/main/java/fleet/Ship.java": 'package fleet;\nimport jakarta.persistence.*;\n@Entity\n@Table(name = "ship_@N")\npublic class Ship {\n  @Id\n  private long id;\n  private String name;\n  @ManyToOne(optional = false)\n  @JoinColumn(name = "home", nullable = false)\n  private Harbour home;\n}\n',
    },
    {"harbour_@R.code": "int key", "harbour_@R.city": "String unique", "ship_@N.id": "long key", "ship_@N.name": "String?", "ship_@N.home": ""},
    {"ship_@N(home)>harbour_@R": "many-to-one orm"},
)
reader(
    "exposed",
    {
        "src/main/kotlin/Fleet.kt": 'import org.jetbrains.exposed.sql.*\n\nobject Harbours : Table("harbour_@R") {\n    val code = integer("code")\n    val city = varchar("city", 40).uniqueIndex()\n    override val primaryKey = PrimaryKey(code)\n}\n\nobject Ships : Table("ship_@N") {\n    val id = long("id")\n    val name = text("name").nullable()\n    val home = integer("home").references(Harbours.code, onDelete = ReferenceOption.CASCADE)\n    override val primaryKey = PrimaryKey(id)\n}\n'
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "long key", "ship_@N.name": "text?", "ship_@N.home": "integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "efcore",
    {
        "Fleet/Harbour.cs": 'using System.ComponentModel.DataAnnotations;\nusing System.ComponentModel.DataAnnotations.Schema;\n[Table("harbour_@R")]\npublic class Harbour\n{\n    [Key]\n    public int Code { get; set; }\n    [Required, MaxLength(40)]\n    public string City { get; set; }\n}\n',
        "Fleet/Ship.cs": '#nullable enable\nusing System.ComponentModel.DataAnnotations.Schema;\n[Table("ship_@N")]\npublic class Ship\n{\n    public long Id { get; set; }\n    public string? Name { get; set; }\n    [Column("home")]\n    public int HomeCode { get; set; }\n    [ForeignKey("HomeCode")]\n    public Harbour Home { get; set; } = null!;\n}\n',
        "Fleet/FleetContext.cs": "using Microsoft.EntityFrameworkCore;\npublic class FleetContext : DbContext\n{\n    public DbSet<Harbour> Harbours { get; set; }\n    public DbSet<Ship> Ships { get; set; }\n}\n",
    },
    {"harbour_@R.Code": "int key", "harbour_@R.City": "string(40)", "ship_@N.Id": "long key", "ship_@N.Name": "string?", "ship_@N.home": "int"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm"},
)
reader(
    "hibernate",
    {
        "src/main/resources/Fleet.hbm.xml": '<hibernate-mapping package="fleet"><class name="Harbour" table="harbour_@R"><id name="code" type="int"/><property name="city" type="string" length="40" not-null="true" unique="true"/></class>'
        '<class name="Ship" table="ship_@N"><id name="id" type="long"/><property name="name" type="text"/><many-to-one name="home" class="Harbour" column="home" not-null="true"/></class></hibernate-mapping>'
    },
    {"harbour_@R.code": "int key", "harbour_@R.city": "varchar(40) unique", "ship_@N.id": "long key", "ship_@N.name": "text?", "ship_@N.home": ""},
    {"ship_@N(home)>harbour_@R": "many-to-one orm"},
)
reader(
    "doctrinemap",
    {
        "config/doctrine/Harbour.orm.xml": '<doctrine-mapping><entity name="App\\Entity\\Harbour" table="harbour_@R"><id name="code" type="integer"/><field name="city" type="string" length="40" unique="true"/></entity></doctrine-mapping>',
        "config/doctrine/Ship.orm.xml": '<doctrine-mapping><entity name="App\\Entity\\Ship" table="ship_@N"><id name="id" type="bigint"/><field name="name" type="text" nullable="true"/><many-to-one field="home" target-entity="App\\Entity\\Harbour"><join-column name="home" referenced-column-name="code" nullable="false" on-delete="CASCADE"/></many-to-one></entity></doctrine-mapping>',
    },
    {"harbour_@R.code": "integer key", "harbour_@R.city": "string(40) unique", "ship_@N.id": "bigint key", "ship_@N.name": "text?", "ship_@N.home": "integer"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm CASCADE"},
)
reader(
    "graphql",
    {
        "amplify/backend/api/fleet/schema.graphql": "type Harbour@R @model {\n  id: ID!\n  city: String!\n  ships: [Ship@N] @hasMany\n}\n\ntype Ship@N @model {\n  id: ID!\n  name: String\n  homeId: ID!\n  home: Harbour@R! @belongsTo(fields: \"homeId\")\n}\n"
    },
    {"harbour@R.id": "ID key", "harbour@R.city": "String", "ship@N.id": "ID key", "ship@N.name": "String?", "ship@N.homeId": "ID key"},
    {"ship@N(homeid)>harbour@R": "many-to-one orm"},
)
reader(
    "zenstack",
    {
        "fleet.zmodel": 'abstract model Named {\n  name String?\n}\nmodel Harbour@R {\n  code  Int    @id\n  city  String @unique\n  ships Ship@N[]\n  @@map("harbour_@R")\n  @@allow(\'read\', true)\n}\nmodel Ship@N extends Named {\n  id     BigInt @id\n  homeId Int    @map("home")\n  home   Harbour@R @relation(fields: [homeId], references: [code])\n  @@map("ship_@N")\n}\n'
    },
    {"harbour_@R.code": "Int key", "harbour_@R.city": "String unique", "ship_@N.name": "String?", "ship_@N.id": "BigInt key", "ship_@N.home": "Int"},
    {"ship_@N(home)>harbour_@R": "many-to-one orm"},
)
reader(
    "mongovalidator",
    {
        "scripts/fleet.js": "db.createCollection('harbour_@R', { validator: { $jsonSchema: { bsonType: 'object', required: ['city'], properties: { city: { bsonType: 'string' }, where: { bsonType: 'object', required: ['lat'], properties: { lat: { bsonType: 'double' } } } } } } });\ndb.createCollection('ship_@N', { validator: { $jsonSchema: { bsonType: 'object', required: ['home'], properties: { name: { bsonType: ['string', 'null'] }, home: { bsonType: 'objectId' } } } } });\n"
    },
    {"doc:harbour_@R._id": "objectId key", "doc:harbour_@R.city": "string", "doc:harbour_@R.where": "object?", "doc:harbour_@R.where.lat": "double", "doc:ship_@N._id": "objectId key", "doc:ship_@N.name": "string?", "doc:ship_@N.home": "objectId"},
    {},
)
