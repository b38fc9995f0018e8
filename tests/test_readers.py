"""All readers on the sources of their queries, cut and damaged; a megabyte of each in seconds."""

import time

import pytest

from tessera.parsers import READERS, parse_file
from tessera.parsers.jsast import Script
from tessera.parsers.markup import parse_xml, parse_yaml
from tessera.plans import readers

SOURCES = [(kind, path, text.replace("@N", "3").replace("@R", "1")) for kind, files in readers.FILES.items() for path, text in files.items()]


def shape(path, text):
    found = parse_file(path, text)
    return [(p.kind, e.name, [c.name for c in e.columns], e.source.line if e.source else None) for p in found for e in p.entities] + [(p.kind, o.op, o.column, o.source.line) for p in found for o in p.ops]


def test_every_reader_has_a_source():
    assert set(readers.FILES) == set(READERS)


@pytest.mark.parametrize("kind, path, text", SOURCES, ids=[f"{k}-{p.rpartition('/')[2]}" for k, p, _ in SOURCES])
def test_half_typed_files(kind, path, text):
    """Whatever is cut off, nothing is raised; line ends make no difference; what stands before a broken rest is read."""
    for n in range(0, len(text) + 1, 29):
        READERS[kind].parse(path, text[:n])
    for junk in ("\0", "((((", "{[(<", "'", '"', "`", "/*", "}}))", "=>"):
        READERS[kind].parse(path, text + junk)
        READERS[kind].parse(path, junk + text)
    assert shape(path, text) == shape(path, text.replace("\n", "\r\n")) and shape(path, text)


LINES = {
    "sql": ("a.sql", "", "CREATE TABLE t{i} (id int PRIMARY KEY, a varchar(20) NOT NULL DEFAULT 'x', r int REFERENCES t{j} (id));\n"),
    "dbml": ("a.dbml", "", "Table t{i} {{\n  id int [pk]\n  r int [ref: > t{j}.id]\n}}\n"),
    "prisma": ("a.prisma", "", "model T{i} {{\n  id Int @id\n  name String?\n  r Int\n}}\n"),
    "django": ("a/models.py", "from django.db import models\n", "class T{i}(models.Model):\n    name = models.CharField(max_length=9)\n    r = models.ForeignKey('T{j}', on_delete=models.CASCADE)\n"),
    "rails": ("db/schema.rb", "ActiveRecord::Schema.define(version: 1) do\n", '  create_table "t{i}" do |t|\n    t.string "name", null: false\n    t.bigint "r_id"\n  end\n'),
    "typeorm": ("a.entity.ts", "import {{ Entity, Column }} from 'typeorm';\n", "@Entity('t{i}')\nexport class T{i} {{\n  @PrimaryColumn() id: number;\n  @Column() name: string;\n}}\n"),
    "doctrine": ("src/A.php", "<?php\nuse Doctrine\\ORM\\Mapping as ORM;\n", "#[ORM\\Entity]\n#[ORM\\Table(name: 't{i}')]\nclass T{i} {{\n    #[ORM\\Id]\n    #[ORM\\Column(type: 'integer')]\n    private int $id;\n}}\n"),
    "gorm": ("a.go", 'package a\nimport "gorm.io/gorm"\n', 'type T{i} struct {{\n\tgorm.Model\n\tName string `gorm:"size:9"`\n}}\n'),
    "jpa": ("A.java", "import jakarta.persistence.*;\n", '@Entity @Table(name = "t{i}")\nclass T{i} {{\n  @Id private Long id;\n  private String name;\n}}\n'),
}


@pytest.mark.parametrize("kind", LINES)
def test_a_megabyte_is_read_in_three_seconds(kind):
    path, head, each = LINES[kind]
    n = 1_000_000 // len(each)
    text = head.replace("{{", "{").replace("}}", "}") + "".join(each.format(i=i, j=i - 1) for i in range(n))
    start = time.process_time()
    found = READERS[kind].parse(path, text)
    assert time.process_time() - start < 3 and len(found.entities) >= n


def test_scripts():
    s = Script("x.ts", "import { pgTable as table, type Foo, one } from 'drizzle-orm/pg-core';\nconst kept = { a: 1 };\nconst a = f<T>(x as any, { b: [1, -2], c() { return 1 }, ...d, [e]: /re'g/.test(y) }, async (q: number): Promise<void> => ({ z: `t${1}` }));")
    (call,) = [n for n in s.chains() if n.path == "f"]
    assert [x.kind for x in call.items] == ["name", "obj", "fn"] and call.items[1].get("b").items[1].value == "-2" and call.items[2].of.get("z").kind == "str"
    assert s.renamed("drizzle-orm") == {"table": "pgTable"} and s.renamed("other") == {} and s.object_named("kept").get("a").value == "1" and s.object_named("d") is None


def test_markup():
    root = parse_xml('<net mesh="3 &lt; 4"><cork>c<lead/></cork><!-- <gone/> --><rope>left open')
    assert root.children[0].get("mesh") == "3 < 4" and [c.name for c in root.children[0].children] == ["cork", "rope"]
    assert parse_yaml("net:\n  - mesh: 3\n    made: [hemp, 'flax, wet']\n  - plain\nkeel: {oak: true, iron: {weight: null}}\nlog: |\n  calm\n  fog\n") == {
        "net": [{"mesh": 3, "made": ["hemp", "flax, wet"]}, "plain"], "keel": {"oak": True, "iron": {"weight": None}}, "log": "calm\nfog",
    }
