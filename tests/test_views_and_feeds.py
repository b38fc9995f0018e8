"""Visibility, sanitizers, layouts and streams."""

import json
import math
import os
import random
import shutil
import time

from pyspark import InheritableThread
from pyspark.sql import functions as F

from tessera.operators import layout, model_views, sanitize, scan
from tessera.streaming import feed

DDL = """CREATE TABLE users (id int PRIMARY KEY, name text);
CREATE TABLE tags (id int PRIMARY KEY);
CREATE TABLE posts (id int PRIMARY KEY, author_id int REFERENCES users (id), team_id int);
CREATE TABLE post_tags (post_id int REFERENCES posts (id), tag_id int REFERENCES tags (id), PRIMARY KEY (post_id, tag_id));
CREATE TABLE teams (id int PRIMARY KEY);
CREATE TABLE blog.notes (id int PRIMARY KEY, other_id int REFERENCES elsewhere (id));
CREATE VIEW v AS SELECT id FROM users;
"""


def models(spark, text=DDL):
    files = spark.createDataFrame([("w", "db/schema.sql", text)], "workspace string, path string, text string")
    return scan.build_models(scan.parse_files(files)).cache()


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_counts_and_rankings(spark):
    m = models(spark)
    row = model_views.counts(m).first()
    assert (row.tables, row.views, row.collections, row.external) == (6, 1, 0, 1)
    assert [(r.id, r.degree) for r in model_views.most_connected(m, 2).orderBy("rank").collect()] == [("posts", 4), ("post_tags", 2)]
    assert model_views.largest(m, 1).first().id == "posts"
    got = {(r.kind, r.schema, r.n) for r in model_views.groups(m).collect()}
    assert got == {("table", None, 6), ("table", "", 5), ("table", "blog", 1), ("view", None, 1)}
    assert [r.id for r in model_views.in_order(scan.entities(m)).collect()][-1] == "elsewhere"


def test_visibility_and_focus(spark):
    m = models(spark)
    all_ = model_views.visible(m)
    edges = model_views.drawn_edges(m, all_)
    assert "posts<>tags@post_tags" not in ids(edges)
    hidden = model_views.Filters(hide_join_tables=True, hide_external=True, hide_inferred=True, disabled_schemas=("blog",))
    some = model_views.visible(m, hidden)
    assert ids(some) == ["posts", "tags", "teams", "users", "v"]
    assert ids(model_views.drawn_edges(m, some, hidden)) == ["posts(author_id)>users", "posts<>tags@post_tags"]
    near = model_views.focus(edges, spark.createDataFrame([("w", "users")], "workspace string, id string"), 2)
    assert {(r.id, r.hop) for r in near.collect()} == {("users", 0), ("posts", 1), ("post_tags", 2), ("teams", 2)}
    assert model_views.visible(m, model_views.Filters(disabled_sources=("sql",))).count() == 0
    assert ids(model_views.visible(m, only=spark.createDataFrame([("w", "tags")], "workspace string, id string"))) == ["tags"]
    assert model_views.search_items(m).where("kind = 'column' AND label = 'author_id'").count() == 1


def test_cards(spark):
    m = models(spark, "CREATE TABLE wide (" + ", ".join(f"c{i} int" for i in range(20)) + ", id int PRIMARY KEY);")
    row = model_views.cards(m).first()
    assert len(row.rows) == 12 and row.hidden == 9
    assert [r["keys"] for r in model_views.cards(m, "keys").first().rows] == [["PK"]]


def test_sanitizers(spark):
    files = lambda *texts: spark.createDataFrame([("w", t) for t in texts], "workspace string, text string")
    good = {"tables": {"users": " a\r\nb ", "x": "  ", "__proto__": "no"}, "columns": {"users": {"id": "key", "": "no"}}}
    got = sanitize.notes(files(json.dumps(good), "{broken", "[]"))
    assert {(r.entity, r.column, r.note) for r in got.collect()} == {("users", None, "a\nb"), ("users", "id", "key")}
    change = spark.createDataFrame([("w", "users", None, "new"), ("w", "users", "id", " ")], "workspace string, entity string, column string, note string")
    assert [(r.entity, r.note) for r in sanitize.update_notes(got, change).collect()] == [("users", "new")]
    views = {"views": [{"name": " All  tables ", "entities": ["a", "a", ""]}, {"name": "ALL TABLES", "entities": []}, {"name": "", "entities": []}, {"entities": []}]}
    assert [(r.name, r.entities) for r in sanitize.views(files(json.dumps(views))).collect()] == [("All tables", ["a"])]
    places = sanitize.layout(files(json.dumps({"a": {"x": 1.25, "y": -1.25}, "b": {"x": "z"}, "c": {"x": 1}})))
    assert [tuple(r) for r in places.collect()] == [("w", "a", 1.3, -1.2)]
    config = sanitize.Config.of({"maxFiles": 5, "maxFileSizeKB": 10**9, "inferRelations": False, "exclude": ["a", 3, " "]})
    assert (config.most_files, config.most_kilobytes, config.infer_relations, config.exclude) == (100, 1_048_576, False, ("a",))
    assert sanitize.export_path("../../etc//x.md") == "etc/x.md" and sanitize.export_path("..") == "DATABASE.md"


def test_layouts_do_not_overlap():
    rnd = random.Random(1)
    for nodes, edges in ((1, 0), (12, 20), (80, 79), (300, 900)):
        sizes = {f"n{i}": (rnd.randint(100, 300), rnd.randint(40, 400)) for i in range(nodes)}
        links = [(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for _ in range(edges)] + [("n0", "ghost")]
        for direction in ("LR", "TB"):
            placed = layout.lay_out(sizes, links, direction)
            assert set(placed) == set(sizes) and all(map(math.isfinite, sum(placed.values(), ())))
            boxes = [(*placed[v], *sizes[v]) for v in sizes]
            assert not any(layout.overlaps(boxes[i], boxes[j]) for i in range(len(boxes)) for j in range(i))
    known = {"n0": (5.0, 5.0), "gone": (0.0, 0.0)}
    more = layout.place_new(known, {"n0": (10, 10), "n1": (10, 10)}, [("n0", "n1")])
    assert more["n0"] == (5.0, 5.0) and more["n1"][0] > 15
    assert layout.components(["a", "b", "c", "d"], [("c", "d"), ("a", "a")]) == [["c", "d"], ["a"], ["b"]]


def test_layouts_of_models(spark):
    placed = layout.lay_out_models(models(spark)).collect()
    assert len(placed) == 8 and len({(r.x, r.y) for r in placed}) == 8


def stream(spark, tmp_path, name, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")


def test_replay_stream(spark, tmp_path):
    schema = "key string, seq long, op string, name string, value string"
    rows = [[("t", 2, "set", "a", "1"), ("t", 1, "create", None, None)], [("t", 3, "rename", "a", "b"), ("u", 1, "create", None, None), ("u", 2, "drop", None, None)]]
    query = feed.replay_stream(stream(spark, tmp_path, "ops", rows, schema)).writeStream.format("memory").queryName("replayed").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    got = {r.key: r for r in spark.sql("SELECT key, max_by(attributes, n_changes) AS attributes, max(n_changes) AS n, max_by(alive, n_changes) AS alive FROM replayed GROUP BY key").collect()}
    assert (got["t"].attributes, got["t"].n, got["t"].alive, got["u"].alive) == ('{"b": "1"}', 3, True, False)


def test_bursts(spark, tmp_path):
    schema = "user string, ts timestamp"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, s // 60, s % 60)
    events = stream(spark, tmp_path, "events", [[("a", at(1)), ("a", at(2)), ("a", at(30))], [("b", at(3000))]], schema)
    query = feed.bursts(events, "user", gap="5 seconds", late="1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n_events for r in spark.sql("SELECT * FROM bursts").collect()) == [1, 2]


def test_rescan_publishes_changes_once(spark, tmp_path):
    texts, published = {"w": "CREATE TABLE a (id int);"}, []
    load = lambda touched: touched.join(spark.createDataFrame([(w, "s.sql", t) for w, t in texts.items()], "workspace string, path string, text string"), "workspace")
    rescan = feed.Rescan(load, lambda f: scan.build_models(scan.parse_files(f)), lambda df, batch: published.append((batch, df.where("part = 'entities'").count())), f"{tmp_path}/signatures")
    event = spark.createDataFrame([("w",)], "workspace string")
    rescan(event, 0)
    rescan(event, 1)
    texts["w"] += " CREATE TABLE b (id int);"
    rescan(event, 2)
    assert published == [(0, 1), (2, 2)]


def test_a_batch_that_runs_again_publishes_the_same(spark, tmp_path):
    """A failure after publishing, and old signatures that go."""
    texts = {"w": "1", "v": "1"}
    rows = lambda: spark.createDataFrame(list(texts.items()), "workspace string, said string")
    rescan = feed.Rescan(lambda touched: touched.join(rows(), "workspace"), lambda f: f, feed.to_folder(f"{tmp_path}/out"), f"{tmp_path}/signatures", every=2)
    event = spark.createDataFrame([("w",), ("v",)], "workspace string")
    read = lambda n: sorted(r.workspace for r in spark.read.parquet(f"{tmp_path}/out/batch={n}").collect())
    rescan(event, 0)
    shutil.rmtree(f"{tmp_path}/signatures/batch=0")
    rescan(event, 0)
    assert read(0) == ["v", "w"]
    texts["w"] = "2"
    rescan(event, 1)
    rescan(event, 1)
    assert read(1) == ["w"]
    for batch in range(2, 8):
        texts["v"] = str(batch)
        rescan(event, batch)
        assert read(batch) == ["v"]
    assert sorted(n for n in os.listdir(f"{tmp_path}/signatures")) == ["batch=4", "batch=5", "batch=6", "batch=7"]
    assert {r.workspace: r.seen for r in rescan.known(spark).collect()} == {"v": 7, "w": 1}


def test_the_newest_run_counts(spark):
    latest, out = feed.Latest(spark), {}
    slow = F.udf(lambda i: time.sleep(0.3) or i, "long")

    def run(name, n):
        out[name] = latest.run(lambda: spark.range(n, numPartitions=1).select(slow("id")).collect())

    first = InheritableThread(target=run, args=("old", 200))
    first.start()
    time.sleep(2)
    second = InheritableThread(target=run, args=("new", 2))
    second.start()
    for t in (second, first):
        t.join(60)
    assert out["old"] is None and len(out["new"]) == 2
