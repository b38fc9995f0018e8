"""The resolver's semantics on small fixtures."""

from building import build

from tessera.model import Column, Index, Op, Parsed, RawEntity, RawEnum, RawRelation, Ref, Source
from tessera.operators.resolve.history import migration_key, migration_order


def pk(name="id", type="int"):
    return Column(name, type, nullable=False, primary_key=True)


def col(name, type="text", **more):
    return Column(name, type, **more)


def table(file, name, columns=(), line=0, **more):
    return RawEntity(name, columns=list(columns), source=Source(file, line), **more)


def rel(file, a, columns, b, to=(), line=0, **more):
    ref = lambda x: Ref(name=x) if isinstance(x, str) else x
    return RawRelation(ref(a), ref(b), list(columns), list(to), source=Source(file, line), **more)


def orm(file, a, columns, b, to=(), line=0, **more):
    return rel(file, Ref(model=a), columns, Ref(model=b), to, line, kind="orm", **more)


def ids(r):
    return [e["id"] for e in r["entities"]]


def entity(r, key):
    return next(e for e in r["entities"] if e["id"] == key)


def names(e):
    return [c["name"] for c in e["columns"]]


def arrows(r):
    return [f"{x['from']}.{','.join(x['from_columns'])}>{x['to']}" for x in r["relations"]]


def test_foreign_keys_default_to_the_key_and_mark_columns():
    f = "schema.sql"
    users = table(f, "users", [pk(), col("email", nullable=False)])
    posts = table(f, "posts", [pk(), col("author_id", "int", nullable=False), col("editor_id", "int")], 5)
    r = build([Parsed(f, "sql", entities=[users, posts], relations=[rel(f, "posts", ["author_id"], "users", ["id"], 7), rel(f, "posts", ["editor_id"], "users", (), 8)])])
    assert ids(r) == ["posts", "users"]
    author, editor = r["relations"]
    assert (author["optional"], editor["optional"], editor["to_columns"]) == (False, True, ["id"])
    assert entity(r, "posts")["columns"][1]["references"] == {"entity": "users", "column": "id"}
    assert author["id"] == "posts(author_id)>users"


def test_collections_and_schemas_are_namespaces():
    f = "db.sql"
    r = build(
        [
            Parsed(
                f,
                "sql",
                entities=[
                    table(f, "users", [pk()], schema="public"),
                    table(f, "users", [pk()], schema="auth"),
                    table(f, "sessions", [pk(), col("user_id")], schema="auth"),
                    table(f, "profiles", [pk(), col("auth_user_id"), col("session_id")]),
                ],
                relations=[
                    rel(f, Ref("sessions", schema="auth"), ["user_id"], "users"),
                    rel(f, "profiles", ["auth_user_id"], Ref("users", schema="auth")),
                    rel(f, "profiles", ["session_id"], "sessions"),
                ],
            ),
            Parsed("u.js", "mongoose", entities=[table("u.js", "users", [pk("_id")], kind="collection", model_name="User")]),
        ]
    )
    assert sorted(ids(r)) == ["auth.sessions", "auth.users", "doc:users", "profiles", "users"]
    assert sorted(f"{x['from']}>{x['to']}" for x in r["relations"]) == ["auth.sessions>users", "profiles>auth.sessions", "profiles>auth.users"]


def test_first_definition_wins_and_gaps_are_filled():
    r = build(
        [
            Parsed("b/model.py", "sqlalchemy", entities=[table("b/model.py", "users", [pk(), col("email", "String", comment="login"), col("bio")], model_name="User")]),
            Parsed("a/schema.sql", "sql", entities=[table("a/schema.sql", "users", [pk("id", "serial"), col("email", "")])]),
        ]
    )
    users = r["entities"][0]
    assert names(users) == ["id", "email", "bio"]
    assert [c["type"] for c in users["columns"][:2]] == ["serial", "String"]
    assert users["columns"][1]["comment"] == "login"
    assert users["sources"] == ["sql", "sqlalchemy"] and users["source"]["file"] == "b/model.py"


def test_changes_in_definitions_are_local_and_late_alters_run_again():
    r = build(
        [
            Parsed("db/schema.sql", "sql", entities=[table("db/schema.sql", "users", [col("id", "int")], 1)], ops=[Op("dropTable", Ref("users"), source=Source("db/schema.sql", 0))]),
            Parsed("db/reset.sql", "sql", ops=[Op("dropTable", Ref("users"), source=Source("db/reset.sql"))]),
            Parsed("db/constraints.sql", "sql", ops=[Op("alterColumn", Ref("users"), "id", set={"primary_key": True}, source=Source("db/constraints.sql"))]),
        ]
    )
    assert r["entities"][0]["columns"][0]["primary_key"] and not r["entities"][0]["columns"][0]["nullable"]


def test_migrations_replay_in_order():
    f1, f2 = "db/migrate/001_init.sql", "db/migrate/002_change.sql"
    ops = [
        Op("renameColumn", Ref("users"), "name", "full_name", source=Source(f2, 1)),
        Op("renameTable", Ref("users"), to="members", source=Source(f2, 2)),
        Op("dropColumn", Ref("posts"), "body", source=Source(f2, 3)),
        Op("dropTable", Ref("legacy"), source=Source(f2, 4)),
        Op("alterColumn", Ref("members"), "email", set={"nullable": False, "unique": True}, source=Source(f2, 5)),
    ]
    m1 = Parsed(
        f1, "sql", "migration",
        entities=[table(f1, "users", [pk(), col("name")]), table(f1, "posts", [pk(), col("user_id", "int"), col("body")], 3), table(f1, "legacy", [pk()], 6)],
        relations=[rel(f1, "posts", ["user_id"], "users", ["id"], 4)],
    )
    m2 = Parsed(f2, "sql", "migration", entities=[table(f2, "users", [col("email")], partial=True)], ops=ops)
    r = build([m2, m1])
    assert ids(r) == ["members", "posts"]
    assert names(r["entities"][0]) == ["id", "full_name", "email"] and names(r["entities"][1]) == ["id", "user_id"]
    assert arrows(r) == ["posts.user_id>members"]


def test_redefined_table_keeps_incoming_links():
    f1, f2 = "m/1/migration.sql", "m/2/migration.sql"
    r = build(
        [
            Parsed(f1, "sql", "migration",
                entities=[table(f1, "users", [pk()]), table(f1, "posts", [pk(), col("author_id", "int")], 2), table(f1, "comments", [pk(), col("post_id", "int")], 4)],
                relations=[rel(f1, "posts", ["author_id"], "users", ["id"], 3), rel(f1, "comments", ["post_id"], "posts", ["id"], 5)]),
            Parsed(f2, "sql", "migration",
                entities=[table(f2, "new_posts", [pk(), col("author_id", "int"), col("title")])], relations=[rel(f2, "new_posts", ["author_id"], "users", ["id"], 1)],
                ops=[Op("dropTable", Ref("posts"), source=Source(f2, 3)), Op("renameTable", Ref("new_posts"), to="posts", source=Source(f2, 4))]),
        ]
    )
    assert ids(r) == ["comments", "posts", "users"] and names(entity(r, "posts")) == ["id", "author_id", "title"]
    assert arrows(r) == ["comments.post_id>posts", "posts.author_id>users"]


def test_foreign_keys_are_dropped_four_ways():
    f1, f2 = "m/001.sql", "m/002.sql"
    drop = lambda **k: Op("dropForeignKey", source=Source(f2), **k)
    r = build(
        [
            Parsed(f1, "sql", "migration",
                entities=[table(f1, "users", [pk()]), table(f1, "posts", [pk(), col("author_id"), col("editor_id")]), table(f1, "comments", [pk(), col("post_id"), col("user_id")])],
                relations=[rel(f1, "posts", ["author_id"], "users"), rel(f1, "posts", ["editor_id"], "users", name="fk_editor"), rel(f1, "comments", ["post_id"], "posts"), rel(f1, "comments", ["user_id"], "users")]),
            Parsed(f2, "sql", "migration", ops=[
                drop(table=Ref("posts"), name="posts_author_id_fkey"), drop(table=Ref("posts"), name="FK_EDITOR"),
                drop(table=Ref("comments"), columns=["post_id"]), drop(table=Ref("comments"), target=Ref("users"))]),
        ],
        infer_relations=False,
    )
    assert r["relations"] == []


def test_order_of_migrations():
    files = [f"db/migration/{f}" for f in ("V10__x.sql", "V1_1__b.sql", "V1__a.sql", "R__views.sql", "V1.2__c.sql", "V2__d.sql")]
    assert [f[13:] for f in sorted(files, key=migration_key)] == ["V1__a.sql", "V1_1__b.sql", "V1.2__c.sql", "V2__d.sql", "V10__x.sql", "R__views.sql"]
    chain = [
        Parsed("alembic/versions/aaa_third.py", "sqlalchemy", revision="aaa", after=["ccc"]),
        Parsed("alembic/versions/bbb_first.py", "sqlalchemy", revision="bbb"),
        Parsed("alembic/versions/ccc_second.py", "sqlalchemy", revision="ccc", after=["bbb"]),
        Parsed("sql/0001_other.sql", "sql"),
    ]
    assert [f.file.rpartition("/")[2] for f in migration_order(chain)] == ["bbb_first.py", "ccc_second.py", "aaa_third.py", "0001_other.sql"]


def test_definitions_come_before_history():
    p, m = "prisma/schema.prisma", "prisma/migrations/1_init/migration.sql"
    r = build(
        [
            Parsed(m, "sql", "migration", entities=[table(m, "User", [pk("id", "SERIAL"), col("email", "TEXT"), col("old_col")])]),
            Parsed(p, "prisma", entities=[table(p, "User", [pk("id", "Int"), col("email", "", nullable=False)], 10, model_name="User")]),
        ]
    )
    user = r["entities"][0]
    assert names(user) == ["id", "email"] and [c["type"] for c in user["columns"]] == ["Int", "TEXT"]
    assert user["sources"] == ["prisma", "sql"] and user["source"] == {"file": p, "line": 10}


def test_models_without_columns_use_history_and_both_sides_meet():
    mig, u, p = "db/migrate/20240101_create.rb", "app/models/user.rb", "app/models/post.rb"
    r = build(
        [
            Parsed(mig, "rails", "migration", entities=[table(mig, "users", [pk(), col("name")]), table(mig, "posts", [pk(), col("user_id", "bigint", nullable=False), col("title")])]),
            Parsed(u, "rails", entities=[table(u, "users", model_name="User", name_certainty=0)], relations=[orm(u, "User", [], "Post", ["user_id"], 2, cardinality="one-to-many")]),
            Parsed(p, "rails", entities=[table(p, "posts", model_name="Post", name_certainty=0)], relations=[orm(p, "Post", ["user_id"], "User", (), 2)]),
        ]
    )
    assert len(r["relations"]) == 1 and names(entity(r, "posts")) == ["id", "user_id", "title"]
    assert r["relations"][0]["kind"] == "orm" and not r["relations"][0]["optional"]


def test_candidates_bases_and_certainty():
    c = "Data/AppDbContext.cs"
    maybe = lambda f, n, cols, **k: table(f, n, cols, model_name=n, name_certainty=0, candidate=True, **k)
    r = build(
        [
            Parsed("Models/Blog.cs", "efcore", entities=[maybe("Models/Blog.cs", "Blog", [pk("Id"), col("Url")], extends=["BaseEntity"])], relations=[orm("Models/Blog.cs", "Blog", [], "Post", (), 3, cardinality="one-to-many")]),
            Parsed("Models/Post.cs", "efcore", entities=[maybe("Models/Post.cs", "Post", [pk("Id"), col("BlogId", "int"), col("Title")])], relations=[orm("Models/Post.cs", "Post", ["BlogId"], "Blog", (), 4)]),
            Parsed("Models/BaseEntity.cs", "efcore", entities=[maybe("Models/BaseEntity.cs", "BaseEntity", [col("CreatedAt")])]),
            Parsed("Models/UserDto.cs", "efcore", entities=[maybe("Models/UserDto.cs", "UserDto", [col("BlogId")])], relations=[orm("Models/UserDto.cs", "UserDto", ["BlogId"], "Blog")]),
            Parsed(c, "efcore", entities=[table(c, "Blogs", line=5, model_name="Blog", name_certainty=1), table(c, "blog_posts", line=9, model_name="Post", partial=True)]),
        ]
    )
    assert ids(r) == ["blog_posts", "blogs"] and names(entity(r, "blogs")) == ["CreatedAt", "Id", "Url"]
    assert arrows(r) == ["blog_posts.BlogId>blogs"] and r["relations"][0]["to_columns"] == ["Id"]


def test_abstract_bases_fan_out_and_unknown_targets_are_external():
    f = "blog/models.py"
    r = build(
        [
            Parsed(f, "django",
                entities=[
                    table(f, "blog_timestamped", [col("created_at"), col("created_by_id")], model_name="Timestamped", abstract=True),
                    table(f, "blog_article", [pk(), col("title")], 5, model_name="Article", extends=["Timestamped"]),
                    table(f, "blog_comment", [pk()], 9, model_name="Comment", extends=["Timestamped"])],
                relations=[RawRelation(Ref(model="Timestamped"), Ref("auth_user", "User"), ["created_by_id"], kind="orm", source=Source(f, 2))]),
        ]
    )
    assert ids(r) == ["blog_article", "blog_comment", "auth_user"]
    assert names(r["entities"][0]) == ["created_at", "created_by_id", "id", "title"]
    assert [f"{x['from']}>{x['to']}" for x in r["relations"]] == ["blog_article>auth_user", "blog_comment>auth_user"]
    assert r["entities"][2]["external"] and r["entities"][2]["columns"][0]["primary_key"]


def test_single_table_inheritance():
    f = "db/migrate/1_init.rb"
    r = build(
        [
            Parsed(f, "rails", "migration", entities=[table(f, "users", [pk(), col("team_id")]), table(f, "teams", [pk()])]),
            Parsed("u.rb", "rails", entities=[table("u.rb", "users", model_name="User", name_certainty=0)]),
            Parsed("t.rb", "rails", entities=[table("t.rb", "teams", model_name="Team", name_certainty=0)]),
            Parsed("a.rb", "rails", entities=[table("a.rb", "admins", model_name="Admin", name_certainty=0, shared_table=True, extends=["User"])], relations=[orm("a.rb", "Admin", ["team_id"], "Team")]),
        ]
    )
    assert ids(r) == ["teams", "users"] and entity(r, "users")["model_names"] == ["User", "Admin"]
    assert entity(r, "users")["source"]["file"] == "u.rb" and arrows(r) == ["users.team_id>teams"]


def test_guessed_names_adopt_sure_tables():
    mig = "Migrations/20240101_Init.cs"
    r = build(
        [
            Parsed(mig, "efcore", "migration", entities=[table(mig, "Posts", [pk("Id"), col("Title"), col("BlogId", "int"), col("Legacy")])]),
            Parsed("Models/Post.cs", "efcore", entities=[table("Models/Post.cs", "Post", [pk("Id"), col("Title"), col("BlogId", "int"), col("Summary")], 3, model_name="Post", name_certainty=0)],
                relations=[rel("Models/Post.cs", "Post", ["BlogId"], "Blogs", kind="orm")]),
            Parsed("src/user.entity.ts", "typeorm", entities=[table("src/user.entity.ts", "user", [pk()], model_name="User", name_certainty=0)]),
            Parsed("db/schema.sql", "sql", entities=[table("db/schema.sql", "users", [pk(), col("email")])]),
        ]
    )
    assert ids(r) == ["posts", "users", "blogs"]
    assert names(entity(r, "posts")) == ["Id", "Title", "BlogId", "Summary"] and entity(r, "posts")["source"]["line"] == 3
    assert names(entity(r, "users")) == ["id", "email"] and sorted(entity(r, "users")["sources"]) == ["sql", "typeorm"]


def test_dead_associations_and_ghosts_warn():
    schema, a = "db/schema.rb", "app/models/article.rb"
    r = build(
        [
            Parsed(schema, "rails", entities=[table(schema, "articles", [pk(), col("user_id")]), table(schema, "users", [pk()])]),
            Parsed(a, "rails", entities=[table(a, "articles", model_name="Article", name_certainty=0)],
                relations=[orm(a, "Article", ["user_id"], "User", (), 1), orm(a, "Article", ["id"], "Article", ["article_id"], 14, cardinality="one-to-many")]),
            Parsed("p.ts", "typeorm", entities=[table("p.ts", "post", [pk()], model_name="Post", name_certainty=0), table("p.ts", "author", [pk()], model_name="Author", name_certainty=0)],
                relations=[orm("p.ts", "Post", ["authorId"], "Author")]),
            Parsed("x.rb", "rails", relations=[orm("x.rb", "Ghost", ["user_id"], "User")]),
        ]
    )
    assert arrows(r) == ["articles.user_id>users", "post.authorId>author"]
    assert [(w["file"], w.get("line")) for w in r["warnings"]] == [("x.rb", 0), (a, 14)]
    assert names(entity(r, "post")) == ["id", "authorId"]


def test_one_to_one_and_inference():
    f = "s.sql"
    r = build(
        [
            Parsed(f, "sql",
                entities=[table(f, "users", [pk()]), table(f, "profiles", [pk("user_id")]), table(f, "wallets", [pk(), col("owner_id", unique=True, nullable=False)]),
                    table(f, "orders", [pk(), col("user_id"), col("external_id")]), table(f, "comments", [pk(), col("commentable_id"), col("commentable_type")]), table(f, "commentables", [pk()])],
                relations=[rel(f, "profiles", ["user_id"], "users"), rel(f, "wallets", ["owner_id"], "users")]),
        ]
    )
    assert [(x["from"], x["cardinality"], x["kind"]) for x in r["relations"]] == [("orders", "many-to-one", "inferred"), ("profiles", "one-to-one", "foreign-key"), ("wallets", "one-to-one", "foreign-key")]
    assert entity(r, "orders")["columns"][1]["references"] == {"entity": "users", "column": "id", "inferred": True}


def test_junction_tables():
    f = "s.sql"
    key = lambda n: Column(n, "int", nullable=False, primary_key=True)
    r = build(
        [
            Parsed(f, "sql",
                entities=[table(f, "posts", [pk()]), table(f, "tags", [pk()]), table(f, "post_tags", [key("post_id"), key("tag_id"), col("created_at")]),
                    table(f, "order_items", [pk(), col("post_id"), col("tag_id"), col("quantity")])],
                relations=[rel(f, t, [f"{s}_id"], f"{s}s") for t in ("post_tags", "order_items") for s in ("post", "tag")]),
        ]
    )
    assert [e["id"] for e in r["entities"] if e.get("join_table")] == ["post_tags"]
    many = [x for x in r["relations"] if x["cardinality"] == "many-to-many"]
    assert [(x["from"], x["to"], x["through"], x["kind"]) for x in many] == [("posts", "tags", "post_tags", "foreign-key")]


def test_declared_many_to_many_meets_its_table():
    p, m = "schema.prisma", "migrations/1/migration.sql"
    both = [(a, b) for a, b in (("Post", "Category"), ("Category", "Post"))]
    r = build(
        [
            Parsed(p, "prisma", entities=[table(p, n, [pk()], model_name=n) for n in ("Post", "Category")], relations=[orm(p, a, [], b, cardinality="many-to-many", through=Ref("_CategoryToPost")) for a, b in both]),
            Parsed(m, "sql", "migration", entities=[table(m, "_CategoryToPost", [col("A", nullable=False), col("B", nullable=False)])],
                relations=[rel(m, "_CategoryToPost", ["A"], "Category", ["id"]), rel(m, "_CategoryToPost", ["B"], "Post", ["id"])]),
        ]
    )
    many = [x for x in r["relations"] if x["cardinality"] == "many-to-many"]
    assert len(many) == 1 and many[0]["through"] == "_categorytopost" and many[0]["kind"] == "orm"


def test_enums_replay_and_link():
    p, f1, f2 = "schema.prisma", "migrations/001.sql", "migrations/002.sql"
    r = build(
        [
            Parsed(p, "prisma", entities=[table(p, "User", [pk(), col("role", "Role")], model_name="User")], enums=[RawEnum("Role", ["USER", "ADMIN"], source=Source(p, 9))]),
            Parsed(f1, "sql", "migration", entities=[table(f1, "people", [pk(), col("moods", '"mood"[]', is_array=True)], 3)],
                enums=[RawEnum("mood", ["sad", "ok"], source=Source(f1, 0)), RawEnum("mood", ["happy"], partial=True, source=Source(f1, 1))]),
            Parsed(f2, "sql", "migration", enums=[RawEnum("mood", ["ok", "great"], source=Source(f2, 1))],
                ops=[Op("renameEnum", name="mood", to="mood_old", source=Source(f2, 0)), Op("dropEnum", name="mood_old", source=Source(f2, 2))]),
        ]
    )
    assert [(e["id"], e["values"]) for e in r["enums"]] == [("mood", ["ok", "great"]), ("role", ["USER", "ADMIN"])]
    assert entity(r, "user")["columns"][1]["enum_ref"] == "role" and entity(r, "people")["columns"][1]["enum_ref"] == "mood"


def test_partial_noise_is_dropped_and_placeholders_are_absorbed():
    f, d = "db/extra.sql", "Domain/F.cs"
    r = build(
        [
            Parsed(f, "sql", entities=[table(f, "users", [pk()]), table(f, "ghost", [], 3, partial=True, indexes=[Index(["x"])]), table(f, "audit_log", [col("x")], 5, partial=True)]),
            Parsed(d, "efcore", entities=[table(d, "Follows", [pk("ObserverId")], model_name="Follow"), table(d, "Persons", [pk("PersonId")], model_name="Person")], relations=[orm(d, "Follow", ["ObserverId"], "Person")]),
            Parsed("C.cs", "efcore", relations=[orm("C.cs", "Follow", ["ObserverId"], "Observer", on_delete="RESTRICT")]),
        ]
    )
    assert ids(r) == ["audit_log", "follows", "persons", "users"]
    assert [(x["to"], x["on_delete"]) for x in r["relations"]] == [("persons", "RESTRICT")]
