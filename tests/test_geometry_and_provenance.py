"""Lines between cards, how things are known, and paths."""

from pyspark.sql import functions as F

from building import build

from tessera.functions import text as tx
from tessera.operators import geometry as g
from tessera.operators import linking, model_views, scan
from tessera.parsers import js_orms, sql

RECT = "struct<x:double,y:double,width:double,height:double>"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def rect(x, y, w, h):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(w)).alias("width"), F.lit(float(h)).alias("height"))


def test_lines(spark):
    a, b = rect(0, 0, 100, 50), rect(300, 100, 100, 50)
    r = one(
        spark, sides=g.sides(a, b), back=g.sides(b, a), anchor=g.anchor(a, F.lit("right")), low=g.anchor(a, F.lit("left"), F.lit(7.0)), top=g.anchor(a, F.lit("top")),
        path=g.edge_path(g.anchor(a, F.lit("right")), F.lit("right"), g.anchor(b, F.lit("left")), F.lit("left")), loop=g.loop_path(a, F.lit(25.0)),
    )
    assert tuple(r.sides) == ("right", "left") and tuple(r.back) == ("left", "right") and tuple(r.anchor) == (100, 25) and tuple(r.low) == (0, 7) and tuple(r.top) == (50, 0)
    assert r.path == "M 100 25 C 189.44 25 210.56 125 300 125" and r.loop == "M 100 11 C 146 11 146 39 100 39"


def test_markers(spark):
    p = g.point(F.lit(10.0), F.lit(20.0))
    r = one(spark, many=g.marker(p, F.lit("right"), F.lit("zero-or-many")), one=g.marker(p, F.lit("left"), F.lit("one")))
    assert r.many.path == "M 23 20 L 10 27 M 23 20 L 10 20 M 23 20 L 10 13" and tuple(r.many.circle) == (30, 20, 4)
    assert r.one.path == "M 1 14 L 1 26" and r.one.circle is None


def test_boxes(spark):
    rows = spark.createDataFrame([("a", (0.0, 0.0, 10.0, 5.0)), ("a", (20.0, -5.0, 10.0, 5.0)), ("b", (1.0, 1.0, 1.0, 1.0))], f"k string, rect {RECT}")
    assert {tuple(r) for r in g.bounds(rows, "k").collect()} == {("a", 0, -5, 30, 10), ("b", 1, 1, 1, 1)} and g.bounds(rows.where("false"), "k").count() == 0
    r = one(spark, yes=g.overlap(rect(0, 0, 10, 10), rect(9, 9, 5, 5)), no=g.overlap(rect(0, 0, 10, 10), rect(10, 0, 5, 5)), pad=g.overlap(rect(0, 0, 10, 10), rect(10, 0, 5, 5), 1))
    assert (r.yes, r.no, r.pad) == (True, False, True)


def test_provenance(spark):
    parsed = [
        sql.parse("schema.sql", "CREATE TABLE users (id int PRIMARY KEY);\nCREATE TABLE posts (id int PRIMARY KEY, user_id int, org_id int REFERENCES orgs(id));\n"),
        js_orms.typeorm("user.ts", "import { Entity } from 'typeorm';\n@Entity()\nexport class Account { @PrimaryGeneratedColumn() id: number; }"),
    ]
    built = build(parsed)
    of = {e["id"]: e["provenance"] for e in built["entities"]} | {r["id"]: r["provenance"] for r in built["relations"]}
    say = lambda k: (of[k]["derivation"], of[k]["confidence"])
    assert say("users") == ("declared", "high") and say("orgs") == ("external", "low") and say("account") == ("guessed", "medium") and '"Account"' in of["account"]["notes"][0]
    assert say("posts(user_id)>users") == ("inferred", "low") and "not defined in the workspace" in " ".join(of["posts(org_id)>orgs"]["notes"])
    schema = f"p {linking.PROVENANCE}"
    rows = spark.createDataFrame([(("inferred", "low", None, [], []),), (("declared", "high", True, [("f.sql", n) for n in range(7)], ["n1"]),), (None,)], schema)
    out = rows.select(model_views.uncertain(F.col("p")).alias("u"), model_views.provenance_lines(F.col("p")).alias("l")).collect()
    assert [r.u for r in out] == [True, False, False] and out[0].l == ["Inferred from naming · low confidence"]
    assert out[1].l == ["Declared · high confidence · merged", "n1", "From f.sql:1, f.sql:2, f.sql:3, f.sql:4, f.sql:5, +2 more"]


def test_paths_and_names(spark):
    cases = [("/c:/repo/docs", "/c:/repo/db/a.sql", "../db/a.sql"), ("/c:/repo", "/d:/x/a.sql", "/d:/x/a.sql"), ("/a/b", "/a/b/c.md", "c.md"), ("/", "/x/y", "x/y"), ("/a/b/c", "/a", "../../../a"), ("/a/x", "/A/x/f", "../../A/x/f")]
    rows = spark.createDataFrame(cases, "f string, t string, want string")
    assert [r.got for r in rows.select(tx.relative_path(F.col("f"), F.col("t")).alias("got")).collect()] == [c[2] for c in cases]
    assert one(spark, x=tx.relative_path(F.lit("/A/x"), F.lit("/a/X/f"), True)).x == "f"
    r = one(spark, a=tx.split_qualified(F.lit('app."my ""t"".x".`c`.[d e].f')), b=tx.unquoted(F.lit("plain")))
    assert r.a == ["app", 'my "t".x', "c", "d e", "f"] and r.b == "plain"
