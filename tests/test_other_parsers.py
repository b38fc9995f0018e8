"""Prisma and DBML schemas, engine detection, and reading without errors."""

import pytest
from building import build

from tessera.parsers import dbml, engines, parse_file, prisma

PRISMA = '''
datasource db {
  provider = "postgresql"
  url      = env("DATABASE_URL")
}

enum Role {
  USER
  ADMIN @map("admin")
}

/// People who sign in
model User {
  id      Int      @id @default(autoincrement())
  email   String   @unique @db.VarChar(255)
  role    Role     @default(USER)
  posts   Post[]
  profile Profile?
  created DateTime @default(now()) @map("created_at")

  @@map("users")
}

model Profile {
  id     Int  @id
  userId Int  @unique @map("user_id")
  user   User @relation(fields: [userId], references: [id], onDelete: Cascade)
}

model Post {
  id         Int        @id
  title      String?
  tags       String[]
  author     User?      @relation(fields: [authorId], references: [id])
  authorId   Int?
  categories Category[]

  @@index([title, authorId])
}

model Category {
  id    Int    @id
  posts Post[]
}
'''

DBML = """
Project shop { database_type: 'PostgreSQL' }
Enum status { draft  published [note: 'seen'] }
Table users as U [note: 'People'] {
  id int [pk, increment]
  email varchar(255) [not null, unique, note: 'login']
  state status [default: 'draft']
  indexes {
    (email, state) [unique, name: 'by_email']
    state
  }
}
Table blog.posts {
  id int [pk]
  user_id int [ref: > U.id, not null]
  title varchar
  Note: 'Articles'
}
Ref owner: blog.posts.title > users.email [delete: cascade]
Ref: users.id <> blog.posts.id
"""


def test_prisma():
    p = prisma.parse("prisma/schema.prisma", PRISMA)
    assert p.engines[0].engine == "postgresql"
    assert p.enums[0].values == ["USER", "admin"]
    user = next(e for e in p.entities if e.model_name == "User")
    assert user.name == "users" and user.comment == "People who sign in"
    assert [c.name for c in user.columns] == ["id", "email", "role", "created_at"]
    assert user.columns[0].generated and user.columns[1].type == "VarChar(255)" and user.columns[2].enum_ref == "Role" and user.columns[3].default == "now()"
    post = next(e for e in p.entities if e.model_name == "Post")
    assert [c.name for c in post.columns] == ["id", "title", "tags", "authorId"] and post.columns[2].is_array and post.indexes[0].columns == ["title", "authorId"]
    r = build([p])
    assert [(x["from"], x["to"], x["cardinality"]) for x in r["relations"]] == [("category", "post", "many-to-many"), ("post", "users", "many-to-one"), ("profile", "users", "one-to-one")]
    assert r["relations"][0]["through_name"] == "_CategoryToPost" and r["relations"][2]["on_delete"] == "Cascade"


def test_dbml():
    p = dbml.parse("db.dbml", DBML)
    assert p.engines[0].engine == "postgresql" and p.enums[0].values == ["draft", "published"]
    users, posts = p.entities
    assert users.comment == "People" and posts.comment == "Articles" and posts.schema == "blog"
    assert users.columns[0].generated and users.columns[0].primary_key and users.columns[1].unique and users.columns[1].comment == "login"
    assert [(i.columns, i.unique, i.name) for i in users.indexes] == [(["email", "state"], True, "by_email"), (["state"], False, None)]
    r = build([p])
    links = {(x["from"], tuple(x["from_columns"]), x["to"], x["cardinality"]) for x in r["relations"]}
    assert ("blog.posts", ("user_id",), "users", "many-to-one") in links and ("users", ("id",), "blog.posts", "many-to-many") in links
    assert next(x for x in r["relations"] if x.get("name") == "owner")["on_delete"] == "CASCADE"


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("docker-compose.yml", 'services:\n  db:\n    image: "${PG:-postgres:16}"\n  a:\n    image: adminer\n  r:\n    image: bitnami/redis:7\n', [("postgresql", 2), ("redis", 6)]),
        ("package.json", '{"dependencies": {\n"pg": "^8",\n"mongoose": "1"}}', [("postgresql", 1), ("mongodb", 2)]),
        ("pyproject.toml", "[tool.poetry.dependencies]\npython = '3'\npsycopg2 = '*'\n[x]\nredis = 1\n", [("postgresql", 2)]),
        ("go.mod", "require github.com/jackc/pgx/v5 v5.0.0\n", [("postgresql", 0)]),
        ("Gemfile", 'gem "mysql2"\n', [("mysql", 0)]),
        ("config/database.yml", "adapter: sqlite3\n", [("sqlite", 0)]),
        ("app/settings.py", "ENGINE = 'django.db.backends.postgresql'\n", [("postgresql", 0)]),
        (".env.example", "DB_CONNECTION=pgsql\nURL=mysql://u:secret@h/d\n", [("postgresql", 0), ("mysql", 1)]),
        (".env", "URL=mysql://u:p@h/d\n", []),
        ("pom.xml", "<artifactId>h2</artifactId>", [("h2", 0)]),
    ],
)
def test_engines(path, text, want):
    found = engines.hints(path, text)
    assert [(h.engine, h.line) for h in found] == want
    assert not any("secret" in h.detail for h in found)


HOSTILE = ["", "\0" * 9, "{{{{", "]]]]", "'", '"""', "model A {", "model A { b", "Table t {", "Ref: a.", "enum E { A @map(", "/*", "@@@", "model M { a B @relation(fields: [", "Table a { b c [ref: >"]


@pytest.mark.parametrize("text", HOSTILE + [PRISMA, DBML])
@pytest.mark.parametrize("path", ["a.prisma", "a.dbml", "a.sql", "docker-compose.yml", "package.json"])
def test_nothing_is_thrown(path, text):
    for n in range(0, len(text) + 1, 11):
        parse_file(path, text[:n])


@pytest.mark.parametrize("path, text", [("a.prisma", PRISMA), ("a.dbml", DBML)])
def test_line_ends_do_not_matter(path, text):
    shape = lambda t: [(e.name, [(c.name, c.type, c.nullable) for c in e.columns], e.source.line) for p in parse_file(path, t) for e in p.entities]
    assert shape(text) == shape(text.replace("\n", "\r\n"))
