"""Queries: differences, merges, replay and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import loose
from tessera.operators import diff, lookup, merge, replay
from tessera.plans.registry import Tables, query
from tessera.sources import files

_STATES = """
base AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0),
head AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
         FROM orders WHERE o_orderkey % 11 <> 0),
rows AS (
    SELECT coalesce(b.o_orderkey, h.o_orderkey) AS o_orderkey,
           CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN h.o_orderkey IS NULL THEN 'removed'
                WHEN b.o_totalprice IS DISTINCT FROM h.o_totalprice OR b.o_orderstatus IS DISTINCT FROM h.o_orderstatus THEN 'changed' END AS change
    FROM base b FULL JOIN head h ON b.o_orderkey = h.o_orderkey)
"""


def _order_diff(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    base = t.orders.where("o_orderkey % 10 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    head = t.orders.where("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderstatus", price.alias("o_totalprice"))
    return diff.keyed_diff(base, head, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(f"WITH {_STATES} SELECT change, count(*) AS n FROM rows WHERE change IS NOT NULL GROUP BY change")
def keyed_diff_summary(t: Tables) -> DataFrame:
    return diff.diff_summary(_order_diff(t))


@query(
    f"WITH {_STATES} SELECT o_orderkey, change, CAST(CASE change WHEN 'added' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END AS INTEGER) AS change_rank, "
    "CASE WHEN change = 'changed' THEN 'o_totalprice' ELSE '' END AS attributes FROM rows WHERE change IS NOT NULL"
)
def keyed_diff_rows(t: Tables) -> DataFrame:
    rows = _order_diff(t)
    return rows.select("o_orderkey", "change", diff.change_order(F.col("change")).alias("change_rank"), F.array_join("attributes", ",").alias("attributes"))


@query("""
WITH mid AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS mid_ts FROM events),
e AS (SELECT user_id, event_type || ':' || CAST(hour(ts) AS VARCHAR) AS what, ts < mid_ts AS early FROM events, mid),
base AS (SELECT DISTINCT user_id, what FROM e WHERE early), head AS (SELECT DISTINCT user_id, what FROM e WHERE NOT early)
SELECT user_id, what, 'removed' AS change FROM base b WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.user_id = b.user_id AND h.what = b.what)
UNION ALL
SELECT user_id, what, 'added' AS change FROM head h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE h.user_id = b.user_id AND h.what = b.what)
""")
def set_diff_per_user(t: Tables) -> DataFrame:
    middle = t.events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("mid_ts"))
    both = t.events.crossJoin(F.broadcast(middle)).withColumn("what", F.concat_ws(":", "event_type", F.hour("ts").cast("string")))
    return diff.set_diff(both.where("ts < mid_ts"), both.where("ts >= mid_ts"), "user_id", "what")


@query("""
SELECT user_id, event_type, event_id, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
""")
def first_per_group(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    return merge.first_per_group(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT user_id, event_type, event_id, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def last_per_group(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    return merge.last_per_group(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
WITH c AS (SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer),
s AS (SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank, s_name AS name, s_acctbal AS balance FROM supplier)
SELECT coalesce(c.nation, s.nation) AS nation, CAST(coalesce(c.rank, s.rank) AS INTEGER) AS rank, coalesce(c.name, s.name) AS name, coalesce(c.balance, s.balance) AS balance
FROM c FULL JOIN s ON c.nation = s.nation AND c.rank = s.rank
""")
def fill_missing(t: Tables) -> DataFrame:
    def ranked(df: DataFrame, nation: str, key: str, name: str, balance) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(nation).orderBy(key))
        return df.select(F.col(nation).alias("nation"), rank.alias("rank"), F.col(name).alias("name"), balance.alias("balance"))

    left = ranked(t.customer, "c_nationkey", "c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    right = ranked(t.supplier, "s_nationkey", "s_suppkey", "s_name", F.col("s_acctbal"))
    return merge.fill_missing(left, right, ["nation", "rank"], ["name", "balance"])


@query("""
WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events),
l AS (SELECT *, max(epoch) OVER (PARTITION BY user_id) AS last_epoch FROM e),
alive AS (SELECT * FROM l WHERE epoch = last_epoch AND event_type <> 'error'),
vals AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM alive WHERE event_type = 'purchase')
SELECT a.user_id, CAST(count(*) AS BIGINT) AS n_changes, max(v.value) AS value
FROM alive a LEFT JOIN vals v ON a.user_id = v.user_id AND v.rn = 1
GROUP BY a.user_id HAVING max(CASE WHEN a.event_type = 'signup' THEN 1 ELSE 0 END) = 1
""")
def replay_state(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return replay.replay(t.events, "user_id", ["ts", "event_id"], creates=kind == "signup", drops=kind == "error", attributes={"value": F.when(kind == "purchase", F.col("value"))})


@query("""
WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n_events FROM r GROUP BY user_id, run
""")
def debounce(t: Tables) -> DataFrame:
    runs = replay.bursts(t.events, "user_id", "ts", "event_id", "1 HOUR")
    return runs.withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query("""
SELECT lang, source, doc_id, n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1
""")
def primary_pick(t: Tables) -> DataFrame:
    docs = t.documents.select("lang", "source", "doc_id", "n_chars")
    return merge.best_per_group(docs, ["lang", "source"], F.struct("n_chars", -F.col("doc_id")))


@query("""
SELECT doc_id, first_value(doc_id) OVER w AS best_doc, first_value(n_chars) OVER w AS best_chars
FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def adopt_best(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "n_chars", "source")
    return merge.adopt_best(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], {"doc_id": "best_doc", "n_chars": "best_chars"}).select("doc_id", "best_doc", "best_chars")


@query("""
WITH refs AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(replace(n_name, '_', '-')) WHEN 2 THEN n_name || 'x' ELSE 'none' END AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey),
hits AS (
    SELECT c_custkey, 0 AS rank, n_nationkey FROM refs JOIN nation ON ref = n_name
    UNION ALL SELECT c_custkey, 1, n_nationkey FROM refs JOIN nation ON lower(regexp_replace(ref, '[\\s_-]', '', 'g')) = lower(regexp_replace(n_name, '[\\s_-]', '', 'g'))
    UNION ALL SELECT c_custkey, 2, n_nationkey FROM refs JOIN nation ON lower(substring(ref, 1, 8)) = lower(substring(n_name, 1, 8))
), best AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rank, n_nationkey) AS rn FROM hits)
SELECT r.c_custkey, r.ref, CAST(b.rank AS INTEGER) AS rank, b.n_nationkey FROM refs r LEFT JOIN best b ON r.c_custkey = b.c_custkey AND b.rn = 1
""")
def prioritized_lookup(t: Tables) -> DataFrame:
    """What every customer says of a nation: its name, its name in another spelling, its beginning, or nothing."""
    said = F.expr("CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(replace(n_name, '_', '-')) WHEN 2 THEN concat(n_name, 'x') ELSE 'none' END")
    refs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", said.alias("ref"))

    def keys(c: str) -> list:
        return [F.col(c), loose(F.col(c)), F.lower(F.substring(c, 1, 8))]

    found = lookup.prioritized_lookup(refs, "c_custkey", keys("ref"), t.nation.select("n_nationkey", "n_name"), keys("n_name"), [F.col("__target.n_nationkey")])
    return found.select("c_custkey", "ref", "rank", F.col("target.n_nationkey").alias("n_nationkey"))


@query("""
SELECT doc_id, false AS external FROM labels
UNION ALL SELECT doc_id, true FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def placeholder_insert(t: Tables) -> DataFrame:
    return lookup.placeholders(t.documents, "doc_id", t.labels, "doc_id")


@query("""
SELECT user_id, event_id, event_type FROM (
    SELECT *, max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS has_real FROM events)
WHERE has_real = 0 OR event_type <> 'error'
""")
def prefer_real(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "event_id", "event_type", F.to_date("ts").alias("day"))
    return merge.prefer(events, ["user_id", "day"], F.col("event_type") != "error").drop("day")


@query("""
SELECT fk, n_rows, n_distinct, n_null, n_rows = n_distinct + n_null AS one_to_one, n_null > 0 AS optional FROM (
    SELECT 'orders.o_custkey' AS fk, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_distinct, count(*) FILTER (WHERE o_custkey IS NULL) AS n_null FROM orders
    UNION ALL SELECT 'labels.doc_id', count(*), count(DISTINCT doc_id), count(*) FILTER (WHERE doc_id IS NULL) FROM labels
    UNION ALL SELECT 'nation.n_regionkey', count(*), count(DISTINCT n_regionkey), count(*) FILTER (WHERE n_regionkey IS NULL) FROM nation)
""")
def cardinality_detect(t: Tables) -> DataFrame:
    out = None
    for table, column in (("orders", "o_custkey"), ("labels", "doc_id"), ("nation", "n_regionkey")):
        one = lookup.cardinality(getattr(t, table), column).select(F.lit(f"{table}.{column}").alias("fk"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT 'orders.o_custkey' AS fk, count(*) AS n_missing FROM (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = v)
UNION ALL SELECT 'documents.doc_id', count(*) FROM (SELECT DISTINCT doc_id AS v FROM documents WHERE doc_id IS NOT NULL) WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = v)
UNION ALL SELECT 'lineitem.l_suppkey', count(*) FROM (SELECT DISTINCT l_suppkey AS v FROM lineitem WHERE l_suppkey IS NOT NULL) WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = v)
""")
def inclusion_check(t: Tables) -> DataFrame:
    out = None
    for child, column, parent, key in (("orders", "o_custkey", "customer", "c_custkey"), ("documents", "doc_id", "labels", "doc_id"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")):
        one = lookup.inclusion(getattr(t, child), column, getattr(t, parent), key).select(F.lit(f"{child}.{column}").alias("fk"), "n_missing")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT DISTINCT least(l_suppkey, o_custkey) AS s1, greatest(l_suppkey, o_custkey) AS s2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey
""")
def symmetric_dedupe(t: Tables) -> DataFrame:
    """Directed pairs of every line of the table."""
    pairs = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s1"), F.col("o_custkey").alias("s2"))
    return merge.dedupe_symmetric(pairs.where("s1 <> s2"), "s1", "s2")


@query("""
SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN (SELECT count(DISTINCT event_type) FROM events WHERE event_type = 'click') = 1 THEN 'click' END) AS filled FROM documents
""")
def scalar_fill(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("filled"))
    return merge.scalar_fill(docs, "filled", t.events.where("event_type = 'click'").select("event_type"))


@query("""
WITH named AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part),
first AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey, name) AS rn FROM named)
SELECT p_partkey, name FROM first WHERE rn = 1 ORDER BY p_partkey, name LIMIT 200
""")
def sanitize_dedup(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return merge.sanitize_names(named, "name", ["p_partkey", "name"], 200)


@query("""
SELECT c_nationkey, count(*) AS n, CAST(CAST(sum(CAST('0x' || substring(md5('["' || c_custkey || '","' || c_name || '"]'), 1, 15) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS signature
FROM customer GROUP BY c_nationkey
""")
def signature(t: Tables) -> DataFrame:
    return diff.signature(t.customer, ["c_custkey", "c_name"], "c_nationkey")


@query("SELECT doc_id, n_chars, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, n_chars + 1 FROM documents WHERE doc_id % 3 = 0) c WHERE c.doc_id = d.doc_id AND c.n_chars = d.n_chars)")
def incremental_anti(t: Tables) -> DataFrame:
    """Files that are new or have another size than those that were parsed before."""
    when = F.lit("2024-01-01").cast("timestamp")
    docs = t.documents.select(F.lit("w").alias("workspace"), F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), when.alias("mtime"), "lang")
    cached = docs.withColumn("size", F.when(F.col("path") % 3 != 0, F.col("size")).otherwise(F.col("size") + 1))
    return files.changed(docs, cached).select(F.col("path").alias("doc_id"), F.col("size").alias("n_chars"), "lang")
