"""What readers make of the finer points of their technologies, on sources about boats."""

import json

import pytest

from tessera.parsers import parse_file


def read(path, text, kind=None):
    """What one reader finds in a file."""
    found = [p for p in parse_file(path, text) if p.kind != "engines" and kind in (None, p.kind)]
    assert len(found) == 1, [p.kind for p in found]
    return found[0]


def told(p):
    """Entities by name, and their columns by name."""
    return {e.name: {c.name: c for c in e.columns} for e in p.entities if not e.partial}


def links(p):
    label = lambda ref: ref.model or ref.name
    return {(label(r.from_), tuple(r.from_columns), label(r.to), tuple(r.to_columns), r.cardinality) for r in p.relations}


def test_sql_dialects():
    engine = lambda text, path="a.sql": [h.engine for x in parse_file(path, text) for h in x.engines]
    assert engine("CREATE TABLE oars (id INTEGER PRIMARY KEY AUTOINCREMENT) WITHOUT ROWID;") == ["sqlite"]
    assert engine("CREATE TABLE oars (id NUMBER(9) PRIMARY KEY, wood VARCHAR2(20 CHAR));\n/\n", "a.ddl") == ["oracle"]
    assert engine("CREATE TABLE tides (moon uuid, at timeuuid, seen map<text, int>, PRIMARY KEY ((moon), at));", "a.cql") == ["cassandra"]
    assert engine("CREATE TABLE `sea-lab.logs.waves` (id STRING NOT NULL, parts STRUCT<h INT64, t STRING>, marks ARRAY<STRING>);") == ["bigquery"]
    assert engine("CREATE TABLE pings (id UInt64) ENGINE = MergeTree() ORDER BY id;") == ["clickhouse"]
    waves = read("a.sql", "CREATE TABLE `sea-lab.logs.waves` (id STRING NOT NULL, parts STRUCT<h FLOAT64, t STRING>, marks ARRAY<STRING>);").entities[0]
    assert (waves.name, waves.schema, waves.columns[1].type, waves.columns[2].is_array) == ("waves", "logs", "STRUCT<h FLOAT64, t STRING>", True)
    tides = told(read("a.cql", "CREATE TABLE tides (moon uuid, at timeuuid, seen map<text, int>, PRIMARY KEY ((moon), at));"))["tides"]
    assert [n for n, c in tides.items() if c.primary_key] == ["moon", "at"] and tides["seen"].type == "map<text, int>"
    assert not parse_file("q.sql", "SELECT * FROM oars") and not parse_file("notes.md", "CREATE TABLE oars (id int)")


def test_sql_around_tables():
    p = read("a.sql", """
        CREATE TABLE hulls (id int PRIMARY KEY, made text);
        CREATE TRIGGER t AFTER INSERT ON hulls BEGIN UPDATE yards SET n = n + 1; DELETE FROM x; END;
        CREATE TABLE yards (n int) -- no more
        ;
        ALTER TABLE ONLY hulls ALTER COLUMN id SET DEFAULT nextval('hulls_seq'::regclass);
        ALTER TABLE hulls WITH CHECK ADD CONSTRAINT built FOREIGN KEY (made) REFERENCES yards (n) ON DELETE CASCADE;
        CREATE VIEW v (a, b) AS SELECT 1, 2;
        CREATE TABLE ( nothing ;
        DROP ;
    """)  # fmt: skip
    assert set(told(p)) >= {"hulls", "yards", "v"} and list(told(p)["v"]) == ["a", "b"]
    assert [(r.name, r.on_delete) for r in p.relations] == [("built", "CASCADE")]
    for up, down in (("-- +goose Up", "-- +goose Down"), ("-- migrate:up", "-- migrate:down"), ("-- +migrate Up", "-- +migrate Down")):
        p = read("migrations/1.sql", f"{up}\nCREATE TABLE keels (id int);\n{down}\nDROP TABLE keels;")
        assert list(told(p)) == ["keels"] and not p.ops and p.origin == "migration"
    p = read("migrations/2.sql", "ALTER TABLE keels MODIFY `wood` VARCHAR(9) NOT NULL;\nALTER TABLE keels CHANGE `old` `new` INT NOT NULL;")
    assert p.ops[0].set == {"nullable": False, "type": "VARCHAR(9)"} and (p.ops[1].column, p.ops[1].to) == ("old", "new")


def test_typeorm():
    p = read("a.ts", """
        import { Entity, PrimaryGeneratedColumn, Column, CreateDateColumn, ManyToMany, JoinTable, OneToOne, JoinColumn } from 'typeorm';
        export abstract class Dated { @CreateDateColumn() launchedAt: Date; }
        @Entity({ name: 'boats', schema: 'fleet' })
        export class Boat extends Dated {
          @PrimaryGeneratedColumn('uuid') id: string;
          // painted on the stern
          @Column({ type: 'enum', enum: ['oak', 'pine'], default: 'oak' }) wood: string;
          @ManyToMany(() => Sailor) @JoinTable({ name: 'boat_crew' }) crew: Sailor[];
          @OneToOne(() => Anchor) @JoinColumn() anchor: Anchor;
        }
    """)  # fmt: skip
    base, boat = p.entities
    assert base.abstract and (boat.name, boat.schema, boat.extends) == ("boats", "fleet", ["Dated"])
    columns = told(p)["boats"]
    assert list(columns) == ["id", "wood", "anchorId"] and columns["id"].type == "uuid" and columns["wood"].comment == "painted on the stern" and columns["wood"].enum_ref == "boats_wood_enum"
    assert links(p) == {("Boat", (), "Sailor", (), "many-to-many"), ("Boat", ("anchorId",), "Anchor", (), "one-to-one")} and p.relations[0].through.name == "boat_crew"


def test_mikroorm():
    p = read("a.ts", """
        import { Entity, PrimaryKey, Property, Enum, ManyToOne, ManyToMany, Embeddable, Embedded, EntitySchema } from '@mikro-orm/core';
        @Embeddable() export class Spot { @Property() bay!: string; }
        @Entity({ tableName: 'buoys' }) export class Buoy {
          @PrimaryKey() id!: number;
          @Enum({ items: ['red', 'green'] }) side!: string;
          @Embedded(() => Spot) at!: Spot;
          @ManyToOne({ entity: () => Buoy, nullable: true }) nextOne?: Buoy;
          @ManyToMany({ entity: () => Light, owner: true, pivotTable: 'buoy_lights' }) lights;
        }
        export const LightSchema = new EntitySchema({ name: 'Light', tableName: 'lights', properties: { id: { type: 'number', primary: true }, farSeen: { type: 'string', fieldName: 'far' } } });
    """)  # fmt: skip
    assert list(told(p)["buoys"]) == ["id", "side", "at_bay", "next_one_id"] and list(told(p)["lights"]) == ["id", "far"] and p.enums[0].values == ["red", "green"]
    assert ("Buoy", ("next_one_id",), "Buoy", (), "many-to-one") in links(p)


def test_mongoose():
    p = read("a.ts", """
        import { Schema, model } from 'mongoose';
        const netSchema = new Schema({
          mesh: { type: Number, required: true }, kind: { type: String, enum: ['drift', 'trawl'], default: 'drift' },
          owner: { type: Schema.Types.ObjectId, ref: 'Fisher' }, catches: [{ type: Schema.Types.ObjectId, ref: 'Fish' }], marks: [String], rope: { made: String },
        }, { timestamps: true, collection: 'netting' });
        export const Net = model('Net', netSchema);
        @Schema({ collection: 'gulls' }) export class Gull { @Prop({ required: true }) cry: string; @Prop([String]) flights: string[]; }
    """, "mongoose")  # fmt: skip
    net = told(p)["netting"]
    assert list(net) == ["_id", "mesh", "kind", "owner", "catches", "marks", "rope", "createdAt", "updatedAt"] and not net["mesh"].nullable and net["marks"].is_array and net["rope"].type == "Object"
    assert {x[2:] for x in links(p)} == {("Fisher", ("_id",), "many-to-one"), ("Fish", ("_id",), "many-to-many")}
    assert [(c.name, c.nullable) for c in told(p)["gulls"].values()] == [("_id", False), ("cry", False), ("flights", True)]


def test_sequelize():
    p = read("a.js", """
        const { DataTypes, Model } = require('sequelize');
        const Oar = sequelize.define('Oar', { madeOf: { type: DataTypes.STRING, field: 'made_of', allowNull: false }, boatId: { type: DataTypes.INTEGER, references: { model: 'boats', key: 'id' }, onDelete: 'CASCADE' } });
        class Rower extends Model { static associate(m) { this.belongsTo(m.Oar, { foreignKey: 'oarId' }); } }
        Rower.init({ code: { type: DataTypes.UUID, primaryKey: true } }, { sequelize, modelName: 'Rower', timestamps: false });
        Oar.belongsToMany(Port, { through: 'OarPorts' });
        sequelize.define('Stroke', { n: DataTypes.ENUM('long', 'short') }, { freezeTableName: true, paranoid: true, underscored: true });
    """)  # fmt: skip
    assert list(told(p)["Oars"]) == ["id", "made_of", "boatId", "createdAt", "updatedAt"] and list(told(p)["Rowers"]) == ["code"] and list(told(p)["Stroke"]) == ["id", "n", "created_at", "updated_at", "deleted_at"]
    assert links(p) == {("Oar", ("boatId",), "boats", ("id",), "many-to-one"), ("Rower", ("oarId",), "Oar", (), "many-to-one"), ("Oar", (), "Port", (), "many-to-many")}
    p = read("migrations/1.js", """
        module.exports = { async up(q, Sequelize) {
            await q.createTable('oars', { id: { type: Sequelize.INTEGER, primaryKey: true, autoIncrement: true } });
            await q.addColumn('oars', 'length', { type: Sequelize.INTEGER, allowNull: false });
            await q.removeColumn('oars', 'weight'); await q.addIndex('oars', ['length'], { unique: true });
        }, async down(q) { await q.dropTable('oars'); } };
    """.replace("q.", "queryInterface.").replace("(q", "(queryInterface"))  # fmt: skip
    assert p.origin == "migration" and [o.op for o in p.ops] == ["dropColumn"] and [e.partial for e in p.entities] == [False, True, True] and p.entities[2].indexes[0].unique


def test_drizzle():
    p = read("a.ts", """
        import { pgTable, pgEnum as listed, pgSchema, serial, integer, text, timestamp, index, uniqueIndex, primaryKey } from 'drizzle-orm/pg-core';
        import { relations } from 'drizzle-orm';
        export const side = listed('side', ['port', 'starboard']);
        const dated = { madeAt: timestamp('made_at').defaultNow() };
        const named = { title: text('title').notNull(), ...dated };
        export const masts = pgTable('masts', { id: serial('id').primaryKey(), where: side('where').default('port'), ...named }, (t) => [index('by_title').on(t.title), uniqueIndex('by_where').on(t.where)]);
        export const fleet = pgSchema('fleet');
        export const sails = fleet.table('sails', { mastId: integer('mast_id'), row: integer() }, (t) => ({ pk: primaryKey({ columns: [t.mastId, t.row] }) }));
        export const sailRelations = relations(sails, ({ one }) => ({ mast: one(masts, { fields: [sails.mastId], references: [masts.id] }) }));
    """, "drizzle")  # fmt: skip
    masts, sails = p.entities
    assert [c.name for c in masts.columns] == ["id", "where", "title", "made_at"] and masts.columns[1].enum_ref == "side" and masts.columns[3].default == "now()" and masts.engine == "postgresql"
    assert [(i.columns, i.unique) for i in masts.indexes] == [(["title"], False), (["where"], True)]
    assert sails.schema == "fleet" and all(c.primary_key for c in sails.columns) and links(p) == {("sails", ("mast_id",), "masts", ("id",), "many-to-one")}


def test_knex_objection_and_kysely():
    p = read("migrations/1.js", """
        exports.up = (knex) => knex.schema.createTable('ropes', (t) => { t.increments('id'); t.enu('twist', ['s', 'z']).notNullable().defaultTo('s'); t.timestamps(true, true); t.integer('boat_id').references('id').inTable('boats').onDelete('CASCADE'); })
          .alterTable('knots', (t) => { t.dropColumn('loops'); t.renameColumn('a', 'b'); t.string('name').notNullable().alter(); });
        exports.down = (knex) => knex.schema.dropTable('ropes');
    """)  # fmt: skip
    ropes = told(p)["ropes"]
    assert list(ropes) == ["id", "twist", "created_at", "updated_at", "boat_id"] and ropes["id"].generated and ropes["twist"].default == "'s'" and p.enums[0].name == "ropes_twist"
    assert [(o.op, o.column) for o in p.ops] == [("dropColumn", "loops"), ("renameColumn", "a"), ("alterColumn", "name")]
    p = read("a.js", "const { Model } = require('objection');\nclass Skipper extends Model {\n  static get tableName() { return 'skippers'; }\n  static get relationMappings() { return { boats: { relation: Model.HasManyRelation, modelClass: Boat, join: { from: 'skippers.id', to: 'boats.skipper_id' } } }; }\n}\n")
    assert list(told(p)) == ["skippers"] and p.relations[0].from_columns == ["skipper_id"]
    p = read("a.ts", "import { Generated } from 'kysely';\ninterface PumpTable { id: Generated<number>; made_by: string | null }\ninterface Database { pumps: PumpTable }\n")
    assert [(c.name, c.nullable) for c in told(p)["pumps"].values()] == [("id", False), ("made_by", True)]


def test_go():
    p = read("a.go", 'package a\n\nimport "gorm.io/gorm"\n\n// Boat floats.\ntype Boat struct {\n\tgorm.Model\n\tHull *string `gorm:"column:hull_kind;type:varchar(9);not null;uniqueIndex;comment:shape"`\n\tYardID int\n\tYard Yard\n\tOars []Oar\n\tFlags []Flag `gorm:"many2many:boat_flags;"`\n\tHidden string `gorm:"-"`\n}\n\ntype Yard struct {\n\tID uint `gorm:"primaryKey"`\n}\n\ntype Oar struct {\n\tID uint\n\tBoatID uint\n}\n\ntype Flag struct {\n\tID uint\n}\n', "gorm")
    boat = told(p)["boats"]
    assert list(boat) == ["id", "created_at", "updated_at", "deleted_at", "hull_kind", "yard_id"] and (boat["hull_kind"].type, boat["hull_kind"].nullable, boat["hull_kind"].unique, boat["hull_kind"].comment) == ("varchar(9)", False, True, "shape")
    assert {(x[0], x[1], x[2], x[4]) for x in links(p)} >= {("Boat", ("yard_id",), "Yard", "many-to-one"), ("Boat", (), "Oar", "one-to-many"), ("Boat", (), "Flag", "many-to-many")} and p.entities[0].comment == "Boat floats."
    p = read("a.go", 'package a\nimport "github.com/uptrace/bun"\ntype Tug struct {\n\tbun.BaseModel `bun:"table:fleet.tugs,alias:t"`\n\tID int64 `bun:"id,pk,autoincrement"`\n\tCalled string `bun:",nullzero"`\n\tTows []*Tow `bun:"rel:has-many,join:id=tug_id"`\n\tPorts []Port `bun:"m2m:tug_ports,join:Tug=Port"`\n}\n', "bun")
    assert (p.entities[0].name, p.entities[0].schema, [c.name for c in p.entities[0].columns]) == ("tugs", "fleet", ["id", "called"]) and {x[4] for x in links(p)} == {"one-to-many", "many-to-many"}
    p = read("ent/schema/crane.go", 'package schema\nimport (\n\t"entgo.io/ent"\n\t"entgo.io/ent/schema/field"\n)\ntype Crane struct {\n\tent.Schema\n}\nfunc (Crane) Mixin() []ent.Mixin {\n\treturn []ent.Mixin{Dated{}}\n}\nfunc (Crane) Fields() []ent.Field {\n\treturn []ent.Field{\n\t\tfield.Enum("reach").Values("near", "far").Default("near"),\n\t\tfield.String("nick").StorageKey("called"),\n\t}\n}\nfunc (Crane) Edges() []ent.Edge {\n\treturn []ent.Edge{\n\t\tedge.To("loads", Load.Type),\n\t\tedge.From("dock", Dock.Type).Ref("cranes").Unique().Field("dock_id").Required(),\n\t}\n}\nfunc (Crane) Indexes() []ent.Index {\n\treturn []ent.Index{index.Fields("called", "reach").Unique()}\n}\ntype Dated struct {\n\tmixin.Schema\n}\nfunc (Dated) Fields() []ent.Field {\n\treturn []ent.Field{field.Time("made_at").Immutable()}\n}\n', "ent")
    crane, dated = p.entities
    assert [c.name for c in crane.columns] == ["id", "reach", "called", "dock_id"] and crane.extends == ["Dated"] and dated.abstract and p.enums[0].values == ["near", "far"] and crane.indexes[0].unique
    assert links(p) == {("Crane", (), "Load", ("crane_loads",), "one-to-many"), ("Crane", ("dock_id",), "Dock", (), "many-to-one")}
    p = read("ent/migrate/schema.go", 'package migrate\nimport "entgo.io/ent/dialect/sql/schema"\nvar (\n\tDocksColumns = []*schema.Column{\n\t\t{Name: "id", Type: field.TypeInt, Increment: true},\n\t\t{Name: "label", Type: field.TypeString, Unique: true, Size: 40},\n\t}\n\tDocksTable = &schema.Table{\n\t\tName:       "docks",\n\t\tColumns:    DocksColumns,\n\t\tPrimaryKey: []*schema.Column{DocksColumns[0]},\n\t}\n\tCranesColumns = []*schema.Column{\n\t\t{Name: "id", Type: field.TypeInt, Increment: true},\n\t\t{Name: "dock_id", Type: field.TypeInt, Nullable: true},\n\t}\n\tCranesTable = &schema.Table{\n\t\tName:       "cranes",\n\t\tColumns:    CranesColumns,\n\t\tPrimaryKey: []*schema.Column{CranesColumns[0]},\n\t\tForeignKeys: []*schema.ForeignKey{\n\t\t\t{\n\t\t\t\tSymbol:     "stands_on",\n\t\t\t\tColumns:    []*schema.Column{CranesColumns[1]},\n\t\t\t\tRefColumns: []*schema.Column{DocksColumns[0]},\n\t\t\t\tOnDelete:   schema.SetNull,\n\t\t\t},\n\t\t},\n\t}\n)\n\nfunc init() {\n\tCranesTable.ForeignKeys[0].RefTable = DocksTable\n}\n', "ent")
    assert list(told(p)["docks"]) == ["id", "label"] and told(p)["docks"]["label"].type == "varchar(40)" and [(r.from_columns, r.to.name, r.on_delete) for r in p.relations] == [(["dock_id"], "docks", "SET NULL")]


def test_efcore():
    p = read("Boat.cs", '#nullable enable\nnamespace Sea;\n[Index(nameof(Name), IsUnique = true)]\npublic class Boat : Floating\n{\n    public int BoatId { get; set; }\n    [Column("boat_name", TypeName = "varchar(40)")]\n    public string Name { get; set; } = "";\n    public string? Motto { get; set; }\n    public Wood Wood { get; set; }\n    [NotMapped] public string Shine { get; set; }\n    public string Loud => Name + "!";\n    public List<Oar> Oars { get; } = new();\n}\npublic enum Wood { Oak, Pine = 4 }\n', "efcore")
    (boat,) = p.entities
    assert [(c.name, c.nullable) for c in boat.columns] == [("BoatId", False), ("boat_name", False), ("Motto", True), ("Wood", False)] and boat.candidate and boat.columns[0].primary_key and boat.columns[3].enum_ref == "Wood" and boat.extends == ["Floating"]
    assert [(i.columns, i.unique) for i in boat.indexes] == [(["Name"], True)] and [(r.to.model, r.cardinality) for r in p.relations] == [("Oar", "one-to-many")]
    p = read("C.cs", 'public class BoatMap : IEntityTypeConfiguration<Boat> { public void Configure(EntityTypeBuilder<Boat> b) { b.ToTable("boats", "sea"); b.HasIndex(x => x.Name).IsUnique(); b.HasOne(x => x.Yard).WithMany(y => y.Boats).HasForeignKey(x => x.YardId).OnDelete(DeleteBehavior.Cascade); } }', "efcore")
    assert (p.entities[0].name, p.entities[0].schema, p.entities[0].name_certainty) == ("boats", "sea", 2) and p.relations[0].from_columns == ["YardId"] and p.relations[0].on_delete == "CASCADE"
    p = read("Migrations/1_Boats.cs", 'using Microsoft.EntityFrameworkCore.Migrations;\npublic partial class Boats : Migration\n{\n    protected override void Up(MigrationBuilder m)\n    {\n        m.CreateTable(name: "Boats", columns: table => new { Id = table.Column<int>(type: "int", nullable: false).Annotation("SqlServer:Identity", "1, 1"), Wood = table.Column<string>(name: "wood", nullable: true), YardId = table.Column<int>(nullable: false) },\n            constraints: table => { table.PrimaryKey("PK_Boats", x => x.Id); table.ForeignKey(name: "FK_Yard", column: x => x.YardId, principalTable: "Yards", principalColumn: "Id", onDelete: ReferentialAction.Cascade); });\n        m.RenameColumn(name: "wood", table: "Boats", newName: "timber");\n        m.CreateIndex(name: "IX", table: "Boats", column: "timber", unique: true);\n        m.DropTable(name: "Rafts");\n    }\n    protected override void Down(MigrationBuilder m) { m.DropTable(name: "Boats"); }\n}\n'.replace("m.", "migrationBuilder.").replace("Builder m)", "Builder migrationBuilder)"), "efcore")
    assert p.origin == "migration" and list(told(p)["Boats"]) == ["Id", "wood", "YardId"] and told(p)["Boats"]["Id"].generated and [o.op for o in p.ops] == ["renameColumn", "dropTable"] and p.relations[0].on_delete == "CASCADE"
    p = read("SeaContextModelSnapshot.cs", '[DbContext(typeof(SeaContext))]\npartial class SeaContextModelSnapshot : ModelSnapshot\n{\n    protected override void BuildModel(ModelBuilder modelBuilder)\n    {\n        modelBuilder.Entity("Sea.Boat", b =>\n        {\n            b.Property<int>("Id").ValueGeneratedOnAdd().HasColumnType("int");\n            b.Property<string>("Wood").IsRequired().HasColumnName("wood");\n            b.HasKey("Id");\n            b.ToTable("Boats");\n            b.HasOne("Sea.Yard", "Yard").WithMany("Boats").HasForeignKey("YardId").IsRequired();\n        });\n    }\n}\n', "efcore")
    assert p.origin == "definition" and [[c.name for c in e.columns] for e in p.entities if e.columns] == [["Id", "wood"]] and p.relations[0].from_columns == ["YardId"]
    assert not parse_file("Migrations/1.Designer.cs", "public class A : DbContext { }") and not parse_file("Prog.cs", "public class Program { static void Main() {} }")


def test_mappings():
    p = read("Hulls.hbm.xml", '<hibernate-mapping schema="sea"><class name="sea.Hull" table="HULLS"><id name="id" column="HULL_ID"><generator class="native"/></id><property name="note"><column name="NOTE" length="80"/></property><set name="ribs" table="RIBS"><key column="HULL_ID"/><one-to-many class="sea.Rib"/></set><joined-subclass name="sea.SteelHull" table="STEEL_HULLS"><key column="HULL_ID"/><property name="rivets"/></joined-subclass></class></hibernate-mapping>')
    assert [(e.name, [c.name for c in e.columns]) for e in p.entities] == [("HULLS", ["HULL_ID", "NOTE"]), ("STEEL_HULLS", ["HULL_ID", "rivets"])] and p.entities[0].schema == "sea" and told(p)["HULLS"]["NOTE"].type == "varchar(80)"
    assert next(r for r in p.relations if r.cardinality == "one-to-many").to_columns == ["HULL_ID"]
    p = read("Pier.dcm.yml", "Sea\\Pier:\n  type: entity\n  table: piers # of stone\n  id:\n    id:\n      type: integer\n      generator: { strategy: AUTO }\n  fields:\n    label:\n      type: string\n      length: 60\n      unique: true\n  manyToOne:\n    port:\n      targetEntity: Port\n      joinColumn:\n        name: port_id\n        referencedColumnName: id\n")
    assert told(p)["piers"]["label"].type == "string(60)" and told(p)["piers"]["label"].unique and links(p) == {("Pier", ("port_id",), "Port", ("id",), "many-to-one")}
    p = read("db/changelog.xml", '<databaseChangeLog><changeSet id="1" author="a"><createTable tableName="piles" schemaName="sea"><column name="id" type="bigint" autoIncrement="true"><constraints primaryKey="true"/></column><column name="pier_id" type="bigint" remarks="stands under"><constraints foreignKeyName="f" references="piers(id)"/></column></createTable><createIndex tableName="piles" indexName="ix" unique="true"><column name="pier_id"/></createIndex><addNotNullConstraint tableName="piles" columnName="pier_id"/><sql>CREATE TABLE caps (id int PRIMARY KEY);</sql><rollback><dropTable tableName="piles"/></rollback></changeSet></databaseChangeLog>')
    assert p.origin == "migration" and p.entities[0].schema == "sea" and told(p)["piles"]["id"].generated and told(p)["piles"]["pier_id"].comment == "stands under" and "caps" in told(p) and [o.op for o in p.ops] == ["alterColumn"] and p.relations[0].to.name == "piers"
    p = read("db/changelog.yaml", "databaseChangeLog:\n  - changeSet:\n      id: 1\n      changes:\n        - createTable:\n            tableName: cleats\n            columns:\n              - column:\n                  name: id\n                  constraints:\n                    primaryKey: true\n              - column: { name: made, type: text }\n        - dropColumn:\n            tableName: cleats\n            columnName: rust\n")
    assert [(c.name, c.primary_key) for c in p.entities[0].columns] == [("id", True), ("made", False)] and p.ops[0].column == "rust"
    p = read("db/changelog.json", json.dumps({"databaseChangeLog": [{"changeSet": {"id": 1, "changes": [{"createTable": {"tableName": "bitts", "columns": [{"column": {"name": "id", "constraints": {"primaryKey": True}}}]}}]}}]}))
    assert p.entities[0].columns[0].primary_key and not parse_file("docker-compose.yml", "services:\n  db:\n    image: x\n")


def test_schema_languages():
    p = read("a.graphql", '"""A lamp"""\ntype Lamp @model @table(name: "sea_lamps") {\n  id: ID!\n  glow: String! @unique\n  oil: String @column(name: "oil_kind")\n  state: State\n  marks: [String!]\n  rays: [Ray!]! @hasMany\n}\nenum State { LIT OUT }\ntype Ray @model {\n  id: ID!\n  lamp: Lamp! # where it comes from\n}\ntype Shade { id: ID! }\n')
    assert [(c.name, c.nullable, bool(c.is_array)) for c in told(p)["sea_lamps"].values()] == [("id", False, False), ("glow", False, False), ("oil_kind", True, False), ("state", True, False), ("marks", True, True)]
    assert set(told(p)) == {"sea_lamps", "Ray"} and links(p) == {("Ray", ("lampId",), "Lamp", (), "many-to-one")} and p.enums[0].values == ["LIT", "OUT"]
    assert not parse_file("api.graphql", "type Query { lamps: [Lamp!]! }\ntype Lamp { id: ID! }\n")
    p = read("a.rs", 'diesel::table! {\n    use diesel::sql_types::*;\n\n    lamps (id) {\n        id -> Int4,\n        #[max_length = 40]\n        glow -> Varchar,\n        marks -> Array<Nullable<Text>>,\n        #[sql_name = "type"]\n        kind -> Varchar,\n    }\n}\ndiesel::table! { sea.rays (lamp_id, n) { lamp_id -> Int4, n -> Int4, } }\n')
    assert [(c.name, c.type) for c in told(p)["lamps"].values()] == [("id", "Int4"), ("glow", "Varchar(40)"), ("marks", "Text"), ("type", "Varchar")] and p.entities[1].schema == "sea" and all(c.primary_key for c in p.entities[1].columns)
    p = read("lamp.rs", 'use sea_orm::entity::prelude::*;\n#[derive(Clone, Debug, DeriveEntityModel)]\n#[sea_orm(table_name = "lamps", schema_name = "sea")]\npub struct Model {\n    #[sea_orm(primary_key)]\n    pub id: i32,\n    #[sea_orm(column_type = "Text", nullable, column_name = "glow_kind")]\n    pub glow: Option<String>,\n}\n#[derive(EnumIter, DeriveActiveEnum)]\n#[sea_orm(rs_type = "String", db_type = "Enum", enum_name = "hue")]\npub enum Hue {\n    #[sea_orm(string_value = "Amber")]\n    Amber,\n}\n')
    assert (p.entities[0].schema, [(c.name, c.type) for c in p.entities[0].columns]) == ("sea", [("id", "i32"), ("glow_kind", "Text")]) and p.enums[0].values == ["Amber"]
    p = read("a.js", "db.createCollection('crabs', { validator: { $jsonSchema: { bsonType: 'object', required: ['claw'], properties: { claw: { bsonType: 'string' }, legs: { bsonType: 'array', items: { bsonType: 'int' } }, home: { bsonType: 'object', properties: { rock: { bsonType: ['string', 'null'] } } } } } } });")
    assert [(c.name, c.type, c.nullable) for c in told(p)["crabs"].values()] == [("_id", "objectId", False), ("claw", "string", False), ("legs", "int", True), ("home", "object", True), ("home.rock", "string", True)]


@pytest.mark.parametrize("path, text", [("a.ts", "@Entity("), ("a.cs", "public class C : DbContext { public DbSet<"), ("a.go", "type A struct {"), ("a.sql", "CREATE TABLE `a` (b ENUM('x'"), ("a.hbm.xml", "<hibernate-mapping><class"), ("a.rs", "diesel::table! {")])
def test_beginnings(path, text):
    assert all(not p.warnings for p in parse_file(path, text))
