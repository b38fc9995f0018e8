"""From folders to models, on Spark."""

import datetime
import subprocess

from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.sources import cache, files
from tessera.sources.globs import expand_braces, glob_regex

SCHEMA = "CREATE TABLE users (id int PRIMARY KEY, email text);\nCREATE TABLE posts (id int PRIMARY KEY, user_id int, note text);\n"


def tree(tmp_path):
    for name, text in {"db/schema.sql": SCHEMA, "docker-compose.yml": "image: postgres:16\n", "node_modules/x/schema.sql": "CREATE TABLE no (id int);", "readme.md": "CREATE TABLE t"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "db" / "wide.sql").write_bytes("CREATE TABLE wide (id int);".encode("utf-16"))
    (tmp_path / "db" / "binary.sql").write_bytes(b"CREATE TABLE x\0\1\2\xff")
    return str(tmp_path)


def test_tree_to_model(spark, tmp_path):
    found = files.read_tree(spark, tree(tmp_path), scan.include_regex(), workspace="w").cache()
    assert sorted(r.path for r in found.collect()) == ["db/schema.sql", "db/wide.sql", "docker-compose.yml"]
    models = scan.build_models(scan.parse_files(found)).cache()
    assert [(r.id, r.engine) for r in scan.entities(models).orderBy("seq").collect()] == [("posts", "postgresql"), ("users", "postgresql"), ("wide", "postgresql")]
    assert [r.id for r in scan.relations(models).collect()] == ["posts(user_id)>users"]
    assert scan.columns(models).where("entity_id = 'posts' AND name = 'user_id'").first().references.entity == "users"
    assert files.changed(found, found).count() == 0


def test_models_do_not_depend_on_order_or_partitions(spark):
    rows = [(f"w{w}", f"db/{i}.sql", f"CREATE TABLE t{i} (id int PRIMARY KEY, t{i + 1}_id int);") for w in range(3) for i in range(5)]
    schema = "workspace string, path string, text string"
    pick = lambda df: sorted(map(tuple, scan.build_models(scan.parse_files(df)).collect()))
    one = pick(spark.createDataFrame(rows, schema).coalesce(1))
    assert one == pick(spark.createDataFrame(rows[::-1], schema).repartition(7))
    assert sum(r[1] == "relations" for r in one) == 12


def test_empty_input(spark):
    none = spark.createDataFrame([], "workspace string, path string, text string")
    assert scan.build_models(scan.parse_files(none)).count() == 0


def test_globs(spark):
    assert expand_braces("a{b,c{d,e}}f") == ["abf", "acdf", "acef"] and expand_braces(r"a\{b,c}") == [r"a\{b,c}"]
    rows = spark.createDataFrame([(p,) for p in ("src/a.SQL", "a.sql", "x/y/b.dbml", "x/b.txt", "x/c1.ts")], "path string")
    match = lambda *g: sorted(r.path for r in rows.where(rows.path.rlike(glob_regex(list(g)))).collect())
    assert match("**/*.{sql,dbml}") == ["a.sql", "src/a.SQL", "x/y/b.dbml"]
    assert match("x/?[!2].ts") == ["x/c1.ts"] and match("*.sql") == ["a.sql"] and match() == []


def test_priority(spark):
    want = {"db/schema.sql": 18, "tests/db/a.sql": 2, "src/app.ts": 0, "a/docker-compose.yml": 0, "Db/x.ts": 0, "src/schema.rs": 10, "src/Shop.Model.cts": 10, "api/cart.schema.tsx": 10, "Data/ShopModelSnapshot.cs": 10,
            "orm/a.py": 5, "alembic/v.py": 5, "demo/models.py": 4, "benchmarks/sql/x.sql": 2, "sql": 0, "schema.tsx": 0}
    rows = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.p for r in rows.select("path", files.priority(rows.path).alias("p")).collect()} == want


def test_what_is_left_out(spark):
    no = ("test/fixtures/schema.sql", "a/tests/x.py", "spec/m.rb", "src/test/java/A.java", "app/storage/framework/v.php", "db/1.down.sql", "db/down.sql", "M/A.Designer.cs", "a/user.test.ts", "a/user.spec.js", ".vscode-test/x.sql", "a/x.min.js", "a/x.test.d/b.sql", "node_modules/a.sql", "mine/skip.sql", "mine/skip.sql/x.sql")
    yes = ("tmp/a.sql", "logs/b.sql", "db/1.up.sql", "src/testing/a.sql", "a/latest.sql", "storage/a.sql", "temp/x.py", "down.sql.py")
    rows = spark.createDataFrame([(p, 10) for p in no + yes] + [("big.sql", files.MOST_BYTES + 1)], "path string, length long")
    kept = files.wanted(rows, scan.include_regex(), ["**/mine/skip.sql"])
    assert {r.path for r in kept.collect()} == set(yes)


def test_the_likeliest_files_of_each_workspace(spark):
    rows = [("a", f"src/f{i:03}.ts") for i in range(50)] + [("a", "db/schema.sql"), ("a", "docs/db/x.sql"), ("b", "src/one.ts")]
    df = spark.createDataFrame(rows, "workspace string, path string")
    got = files.candidates(df, scan.include_regex(), 3).cache()
    assert [(r.workspace, r.path, r.truncated) for r in got.orderBy("workspace", F.desc("priority"), "path").collect()] == [
        ("a", "db/schema.sql", True), ("a", "docs/db/x.sql", True), ("a", "src/f000.ts", True), ("b", "src/one.ts", False)]
    assert [(r.workspace, "more than 3" in r.message) for r in files.truncation_warnings(got, 3).collect()] == [("a", True)]
    assert files.candidates(df, scan.include_regex()).where("truncated").count() == 0
    assert files.search_cap(100) == 2000 and files.search_cap(5000) == 20_000 and files.search_cap(10**6) == 200_000


def test_decoding(spark):
    word = "CREATE TABLE größe (id int);"
    texts = {
        "utf8": (word.encode(), word), "mark8": (b"\xef\xbb\xbf" + word.encode(), word), "mark16": (word.encode("utf-16"), word), "be": (b"\xfe\xff" + word.encode("utf-16-be"), word),
        "bare16": (f"-- 中文 {word}".encode("utf-16-le"), f"-- 中文 {word}"), "bare16be": (f"-- 文 {word}".encode("utf-16-be"), f"-- 文 {word}"),
        "latin": ("é = größe".encode("latin-1"), "\ufffd = gr\ufffd\ufffde"), "odd": (word.encode("utf-16-le") + b"x", word + "\ufffd"), "binary": (b"CREATE TABLE x\0\1\2\xff", None), "short": (b"a\0b\0", None), "empty": (b"", ""),
    }
    rows = spark.createDataFrame([(n, bytearray(raw)) for n, (raw, _) in texts.items()], "name string, content binary")
    assert {r.name: r.t for r in rows.select("name", files.decode_text(rows.content).alias("t")).collect()} == {n: t for n, (_, t) in texts.items()}


def test_down_migrations_and_fixtures_stay_out_of_the_model(spark, tmp_path):
    tree = {
        "migrations/001_members.up.sql": "CREATE TABLE members (id int PRIMARY KEY, joined date);",
        "migrations/001_members.down.sql": "DROP TABLE members;",
        "migrations/002_seed.up.sql": "INSERT INTO members VALUES (1, now());",
        "migrations/002_seed.down.sql": "DROP TABLE members;",
        "migrations/003_loans/up.sql": "ALTER TABLE members ADD COLUMN fee int;",
        "migrations/003_loans/down.sql": "ALTER TABLE members DROP COLUMN joined;",
        "test/fixtures/schema.sql": "CREATE TABLE pretend (id int);",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    models = scan.build_models(scan.parse_files(files.read_tree(spark, str(tmp_path), scan.include_regex(), workspace="w")))
    assert [(r.id, [c.name for c in r.columns]) for r in scan.entities(models).collect()] == [("members", ["id", "joined", "fee"])]


def test_only_chosen_files_are_opened(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"m{i}.sql").write_text(f"CREATE TABLE t{i} (id int);")
    read = lambda n: sorted(r.path for r in files.read_tree(spark, str(tmp_path), scan.include_regex(), most_files=n).collect())
    assert read(2) == ["m0.sql", "m1.sql"] and len(read(9)) == 5
    (tmp_path / "odd[1].sql").write_text("CREATE TABLE odd (id int);")
    assert "odd[1].sql" in read(9)


def test_files_of_a_revision(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for name, text in {"a.sql": "CREATE TABLE a (id int);", "gone.sql": "CREATE TABLE gone (id int);", "tests/t.sql": "CREATE TABLE t (id int);", "é b.sql": "-- é", "readme.md": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "gone.sql").unlink()
    (tmp_path / "a.sql").write_text("CREATE TABLE a (id int, more int);")
    (tmp_path / "new.sql").write_text("CREATE TABLE new (id int);")
    got = {r.path: r.text for r in files.git_files(spark, str(tmp_path), "HEAD", scan.include_regex(), "w").collect()}
    assert got == {"a.sql": "CREATE TABLE a (id int);", "gone.sql": "CREATE TABLE gone (id int);", "é b.sql": "-- é"}


def test_cache_of_parsed_files(spark, tmp_path):
    kept = cache.ParseCache(spark, f"{tmp_path}/cache")
    schema = "workspace string, path string, size long, mtime timestamp, text string"
    when = lambda h: datetime.datetime(2024, 1, 1, h)
    one = [("w", "a.sql", 1, when(1), "CREATE TABLE a (id int);"), ("w", "b.sql", 1, when(1), "-- nothing"), ("w", "c.sql", 1, when(1), "CREATE TABLE c (id int);")]
    read_paths = []

    def scan_of(rows, after=None):
        whole = spark.createDataFrame(rows, schema)

        def read(listing):
            read_paths.append(sorted(r.path for r in listing.collect()))
            return whole.join(listing.select("workspace", "path"), ["workspace", "path"], "left_semi").select("workspace", "path", "text")

        relist = (lambda: spark.createDataFrame(after, schema).drop("text")) if after else None
        return sorted(r.path for r in kept.scan(whole.drop("text"), read, scan.parse_files, relist).collect())

    assert scan_of(one) == ["a.sql", "c.sql"]
    two = [one[1], ("w", "c.sql", 2, when(2), "CREATE TABLE c (id int, x int);")]
    assert scan_of(two, after=[one[1], ("w", "c.sql", 3, when(3), "")]) == ["c.sql"]
    assert scan_of(two) == ["c.sql"]
    assert read_paths == [["a.sql", "b.sql", "c.sql"], ["c.sql"], ["c.sql"]]


def test_what_readers_may_claim():
    yes = ("a.py", "src/User.java", "db/schema.rb", "x.kt", "m.ex", "go/m.go", "A.cs", "a/b.zmodel", "q.graphqls", "db/changelog/1.yaml", "my-changelog.xml", "a/User.hbm.xml", "config/doctrine/User.orm.yml", "docker-compose.yml", "x.TSX")
    no = ("readme.md", "a.txt", "pom2.xml.bak", "config.yaml", "data.json", "x.python")
    assert [p for p in yes if not scan.claimed(p)] == [] and [p for p in no if scan.claimed(p)] == []


def test_many_technologies_in_one_tree(spark, tmp_path):
    sources = {
        "db/schema.sql": "CREATE TABLE users (id int PRIMARY KEY);",
        "app/models/user.rb": "class User < ApplicationRecord\n  has_many :posts\nend\nclass Post < ApplicationRecord\n  belongs_to :user\nend\n",
        "src/Note.java": "import jakarta.persistence.*;\n@Entity @Table(name = \"notes\") class Note { @Id Long id; @ManyToOne @JoinColumn(name = \"user_id\") User author; }\n@Entity @Table(name = \"users\") class User { @Id Long id; }",
        "lib/tag.ex": "defmodule App.Tag do\n  use Ecto.Schema\n  schema \"tags\" do\n    field :name, :string\n  end\nend\n",
    }
    for name, text in sources.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    models = scan.build_models(scan.parse_files(files.read_tree(spark, str(tmp_path), scan.include_regex(), workspace="w"))).cache()
    assert {r.id for r in scan.entities(models).collect()} == {"users", "posts", "notes", "tags"}
    assert {"posts(user_id)>users", "notes(user_id)>users"} <= {r.id for r in scan.relations(models).collect()}
