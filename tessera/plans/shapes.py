"""Queries: aggregates, graphs and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import geometry, graph
from tessera.plans.registry import Tables, query


@query("SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS INTEGER) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_region_nation(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    level = (F.grouping("r_name") + F.grouping("n_name")).cast("int")
    return joined.rollup("r_name", "n_name").agg(level.alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY user_id")
def counts_if(t: Tables) -> DataFrame:
    n = lambda c: F.count_if(c)
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), n(F.col("event_type") == "click").alias("clicks"), n(F.col("event_type") == "purchase").alias("purchases"), n(F.col("value") > 50).alias("large")
    )


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ':' || text, ' | ' ORDER BY turn, role) AS said FROM conversations GROUP BY conv_id")
def ordered_concat(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), " | ")
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), said.alias("said"))


@query("SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey ORDER BY n_lines DESC, l_orderkey LIMIT 50")
def topk_largest(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).orderBy(F.desc("n_lines"), "l_orderkey").limit(50)


def _part_supplier(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()


@query()
def components(t: Tables) -> DataFrame:
    """Over every edge of the table; without SQL, tests compare with brute force."""
    edges = _part_supplier(t)
    return graph.components(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct(), edges)


@query("""
WITH edges AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT 's' || s AS v, count(*) AS degree FROM edges GROUP BY s UNION ALL SELECT 'p' || p, count(*) FROM edges GROUP BY p
""")
def degree_rank(t: Tables) -> DataFrame:
    return graph.degrees(_part_supplier(t))


@query("""
WITH e AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem),
start AS (SELECT least(min(p), min(s)) AS v FROM e),
one AS (SELECT s AS v FROM e WHERE p = (SELECT v FROM start) UNION SELECT p FROM e WHERE s = (SELECT v FROM start)),
two AS (SELECT p AS v FROM e WHERE s IN (SELECT v FROM one) UNION SELECT s FROM e WHERE p IN (SELECT v FROM one)),
reach AS (SELECT v, 0 AS hop FROM start UNION ALL SELECT v, 1 FROM one UNION ALL SELECT v, 2 FROM two)
SELECT v, CAST(min(hop) AS INTEGER) AS hop FROM reach GROUP BY v
""")
def hops2(t: Tables) -> DataFrame:
    edges = _part_supplier(t)
    return graph.within_hops(edges, graph.undirected(edges).agg(F.min("a").alias("v")), 2)


@query("""
WITH visible AS (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey NOT IN (0, 3)),
edges AS (SELECT DISTINCT l_suppkey AS a, o_custkey % 100 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a, CAST(b AS BIGINT) AS b FROM edges WHERE a IN (SELECT s_suppkey FROM visible) AND b IN (SELECT s_suppkey FROM visible)
""")
def visible_nodes_edges(t: Tables) -> DataFrame:
    return _visible(t, t.lineitem)


def _visible(t: Tables, lineitem: DataFrame) -> DataFrame:
    hidden = F.array(F.lit(0), F.lit(3))
    nodes = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).where(F.forall(hidden, lambda r: r != F.col("n_regionkey"))).select(F.col("s_suppkey").alias("v"))
    lines = lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.select(F.col("l_suppkey").alias("a"), (F.col("o_custkey") % 100 + 1).alias("b")).distinct()
    return graph.visible_edges(edges, nodes).select("a", "b")


@query("""
SELECT l_orderkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers, bool_and(l_quantity >= 2) AS all_many
FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 2 AND count(DISTINCT l_suppkey) = 2
""")
def join_table_detect(t: Tables) -> DataFrame:
    both = t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.bool_and(F.col("l_quantity") >= 2).alias("all_many"))
    return both.where("n_parts = 2 AND n_suppliers = 2")


@query("SELECT lang, count(DISTINCT source) AS n_sources, count(*) AS n_docs, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def engine_aggregate(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_docs"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("""
WITH r AS (SELECT event_id, user_id, epoch_ms(ts) // 1000 AS low, epoch_ms(ts) // 1000 + CAST(floor(value * 60) AS BIGINT) AS high FROM events)
SELECT a.event_id AS a, b.event_id AS b FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.low < b.high AND b.low < a.high
""")
def rect_overlap(t: Tables) -> DataFrame:
    low = F.unix_seconds(F.col("ts").cast("timestamp"))
    spans = t.events.select("user_id", F.col("event_id").alias("id"), low.alias("low"), (low + F.floor(F.col("value") * 60)).alias("high"))
    return geometry.overlapping(spans, ["user_id"], 3600)


@query("SELECT label, round(min(embedding[1]), 5) AS min_x, round(max(embedding[1]), 5) AS max_x, round(min(embedding[2]), 5) AS min_y, round(max(embedding[2]), 5) AS max_y, count(*) AS n FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) GROUP BY label")
def bounding_box(t: Tables) -> DataFrame:
    x, y = (F.col("embedding")[k].cast("double") for k in (0, 1))
    zero = F.lit(0.0)
    rects = t.embeddings.select("label", F.struct(x.alias("x"), y.alias("y"), zero.alias("width"), zero.alias("height")).alias("rect"))
    box = geometry.bounds(rects, "label").join(t.embeddings.groupBy("label").agg(F.count("*").alias("n")), "label")
    of = lambda c: F.round(c, 5)
    return box.select("label", of(F.col("x")).alias("min_x"), of(F.col("x") + F.col("width")).alias("max_x"), of(F.col("y")).alias("min_y"), of(F.col("y") + F.col("height")).alias("max_y"), "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k BIGINT", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS ordinal, round(CAST(embedding[i] AS DOUBLE), 5) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def unnest_ordinality(t: Tables) -> DataFrame:
    each = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return each.select("vec_id", (F.col("i") + 1).alias("ordinal"), F.round(F.col("x").cast("double"), 5).alias("x"))


_KEYS = [("orders", "o_custkey", "customer", "c_custkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]
_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in _KEYS)
_COLUMNS = ", ".join(f"('{a}', '{b}', 1)" for a, b in sorted({(k[i], k[i + 1]) for k in _KEYS for i in (0, 2)}))


@query(f"""
WITH k(tbl, col, ref_tbl, ref_col) AS (VALUES {_VALUES}), c(tbl, col, pos) AS (VALUES {_COLUMNS})
SELECT k.tbl, k.col, CAST(c.pos AS INTEGER) AS pos, k.ref_tbl, r.col AS ref_col FROM k JOIN c ON k.tbl = c.tbl AND k.col = c.col LEFT JOIN c r ON k.ref_tbl = r.tbl AND k.ref_col = r.col
""")
def catalog_join(t: Tables) -> DataFrame:
    k = t.spark.sql(f"SELECT * FROM VALUES {_VALUES} AS k(tbl, col, ref_tbl, ref_col)")
    c = t.spark.sql(f"SELECT * FROM VALUES {_COLUMNS} AS c(tbl, col, pos)")
    r = c.select(F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"), F.lit(True).alias("known"))
    joined = k.join(c, ["tbl", "col"]).join(r, ["ref_tbl", "ref_col"], "left")
    return joined.select("tbl", "col", "pos", "ref_tbl", F.when(F.col("known"), F.col("ref_col")).alias("ref_col"))
