"""Queries: text, paths and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import inflect
from tessera.functions import text as tx
from tessera.operators import scan, search
from tessera.plans.registry import Tables, query
from tessera.sources import files


@query("""
WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), k AS (SELECT source, regexp_extract(source, '^\\D+') AS stem, regexp_extract(source, '\\d+') AS num FROM s)
SELECT source, stem || CASE WHEN num = '' THEN '' ELSE '|0' || lpad(CAST(length(CAST(CAST(num AS BIGINT) AS VARCHAR)) AS VARCHAR), 6, '0') || CAST(num AS BIGINT) || lpad(CAST(999999 - length(num) AS VARCHAR), 6, '0') END AS sort_key FROM k
""")
def natural_order(t: Tables) -> DataFrame:
    """The key by which texts sort as people number them, of every source."""
    sources = t.documents.select("source").where("source IS NOT NULL").distinct()
    return sources.select("source", F.array_join(tx.natural_key(F.col("source")), "|").alias("sort_key"))


@query("""
SELECT c_custkey AS id, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')) AS snake FROM customer
UNION ALL SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) FROM part
UNION ALL SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) FROM part
""")
def snake_words(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), tx.snake_case(F.col("c_name")).alias("snake")).unionAll(
        t.part.select(F.col("p_partkey"), tx.snake_case(F.col("p_name"))).unionAll(t.part.select("p_partkey", tx.snake_case(F.col("p_brand"))))
    )


# Words with their plural and their singular, by hand.
_INFLECTED = [tuple(x.split("/")) for x in (
    "quiz/quizzes/quiz ox/oxen/ox mouse/mice/mouse louse/lice/louse matrix/matrices/matrix vertex/vertices/vertex index/indices/index box/boxes/box church/churches/church class/classes/class bush/bushes/bush "
    "category/categories/category query/queries/query hive/hives/hive wolf/wolves/wolf half/halves/half knife/knives/knife wife/wives/wife analysis/analyses/analysis crisis/crises/crisis datum/data/datum "
    "stadium/stadia/stadium buffalo/buffaloes/buffalo tomato/tomatoes/tomato bus/buses/bus alias/aliases/alias status/statuses/status octopus/octopi/octopus virus/viri/virus axis/axes/axis testis/testes/testis "
    "news/news/news user/users/user person/people/person salesperson/salespeople/salesperson child/children/child woman/women/woman salesman/salesmen/salesman sheep/sheep/sheep equipment/equipment/equipment "
    "move/moves/move zombie/zombies/zombie campus/campus/campus menu/menus/menu database/databases/database shoe/shoes/shoe hero/heros/hero movie/movies/movie series/series/series tie/ties/tie "
    "cookie/cookies/cookie cache/caches/cache niche/niches/niche comment/comments/comment thesis/theses/thesis boxes/boxes/box people/people/person wolves/wolves/wolf knives/knives/knife categories/categories/category "
    "matrices/matrices/matrix mice/mice/mouse databases/databases/database shoes/shoes/shoe heroes/heroes/hero movies/movies/movie ties/ties/tie cookies/cookies/cookie caches/caches/cache statuses/statuses/status "
    "buses/buses/bus children/children/child analyses/analyses/analysis data/data/datum oxen/oxen/ox hives/hives/hive addresses/addresses/address keys/keys/key days/days/day"
).split()]
_INFLECTED_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _INFLECTED)


@query(f"""
WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), v(word, plural, singular) AS (VALUES {_INFLECTED_SQL})
SELECT word, CASE WHEN regexp_matches(word, '(x|ch|ss|sh)$') THEN word || 'es' WHEN regexp_matches(word, '[^aeiouy]y$') THEN left(word, length(word) - 1) || 'ies' WHEN word LIKE '%s' THEN word ELSE word || 's' END AS plural,
       CASE WHEN word LIKE '%ss' THEN word WHEN word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS singular FROM w WHERE word NOT IN (SELECT word FROM v)
UNION ALL SELECT word, plural, singular FROM v
""")
def pluralize_rules(t: Tables) -> DataFrame:
    """Every word of the names of parts, and words of each rule."""
    fixed = t.spark.range(1).select(F.explode(F.array(*[F.lit(w) for w, _, _ in _INFLECTED])).alias("word"))
    words = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).union(fixed).distinct()
    return words.select("word", inflect.inflect_column(F.col("word"), True).alias("plural"), inflect.inflect_column(F.col("word"), False).alias("singular"))


@query("SELECT p_partkey, lower(regexp_replace(p_name || '-' || p_brand, '[\\s_-]', '', 'g')) AS loose FROM part")
def loose_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.loose(F.concat_ws("-", "p_name", "p_brand")).alias("loose"))


@query("""
SELECT doc_id, CASE WHEN length(c) > 40 THEN substring(c, 1, 39) || '…' ELSE c END AS clipped
FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS c FROM documents)
""")
def clip_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.clip(F.col("text"), 40).alias("clipped"))


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, split_part(url, '/', -1) AS base,
       CAST(len(list_filter(string_split(url, '/'), lambda s: s <> '')) AS INTEGER) AS n_segments, lower(regexp_extract(split_part(url, '/', -1), '^.+(\\.[^.]*)$', 1)) AS ext
FROM pages
""")
def path_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select(
        "page_id", F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host"), tx.base_name(url).alias("base"), F.size(tx.path_segments(url)).alias("n_segments"), tx.extension(url).alias("ext")
    )


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^(?:https?://.*/[^/]*[0-4])$')")
def glob_filter(t: Tables) -> DataFrame:
    from tessera.sources.globs import glob_regex

    return t.pages.where(F.col("url").rlike(glob_regex(["http{,s}:/**/*[0-4]"]))).select("page_id", "url")


@query("""
SELECT source || '/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.down.sql' WHEN doc_id % 5 = 0 THEN '.SQL' ELSE '.sql' END AS path, n_chars AS length
FROM documents WHERE n_chars <= 2000 AND doc_id % 7 <> 0 AND source IS NOT NULL
""")
def size_limit(t: Tables) -> DataFrame:
    """Files that are small enough and not excluded, made of documents."""
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".down.sql").when(F.col("doc_id") % 5 == 0, ".SQL").otherwise(".sql"))
    return files.wanted(t.documents.select(name.alias("path"), F.col("n_chars").alias("length")), scan.include_regex(), most_bytes=2000)


@query("""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, rtrim(split[i], chr(13)) AS text FROM (
    SELECT doc_id, split, unnest(range(1, len(split) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS split FROM documents))
""")
def line_explode(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.select("doc_id", "line", F.rtrim("text", F.lit("\r")).alias("text"))


_SCHEMES = ["https", "http", "ftp", "postgres", "mysql", "mongodb", "redis"]


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(url, '\\b{s}://') THEN '{s}'" for s in _SCHEMES) + " END AS scheme FROM pages")
def url_scheme(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.coalesce(*[F.when(F.col("url").rlike(rf"\b{s}://"), s) for s in _SCHEMES]).alias("scheme"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def href_extract(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT page_id, length(html) AS chars, length(regexp_replace(html, '<!--(?s:.*?)-->', '', 'g')) AS code_chars FROM pages")
def mask_comments(t: Tables) -> DataFrame:
    bare = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    return t.pages.select("page_id", F.char_length("html").cast("long").alias("chars"), F.char_length(bare).cast("long").alias("code_chars"))


_Q = "ring"


@query(f"""
WITH l AS (SELECT DISTINCT p_name AS label, lower(p_name) AS h FROM part),
m AS (SELECT *, strpos(h, '{_Q}') - 1 AS pos, strpos(h, 'r') AS p1 FROM l),
m2 AS (SELECT *, CASE WHEN p1 > 0 AND strpos(substring(h, p1 + 1), 'i') > 0 THEN p1 + strpos(substring(h, p1 + 1), 'i') END AS p2 FROM m),
m3 AS (SELECT *, CASE WHEN strpos(substring(h, p2 + 1), 'n') > 0 THEN p2 + strpos(substring(h, p2 + 1), 'n') END AS p3 FROM m2),
m4 AS (SELECT *, CASE WHEN strpos(substring(h, p3 + 1), 'g') > 0 THEN p3 + strpos(substring(h, p3 + 1), 'g') END AS p4 FROM m3),
s AS (SELECT label, h, CASE WHEN h = '{_Q}' THEN 1000.0 WHEN pos = 0 THEN 700.0 WHEN pos > 0 AND regexp_matches(substring(h, pos, 1), '[^a-z0-9]') THEN 560.0 - pos WHEN pos > 0 THEN 420.0 - pos
      WHEN p4 IS NOT NULL THEN 240.0 - (p4 - p1 + 1) - 4.0 * (1 + CAST(p2 <> p1 + 1 AS INTEGER) + CAST(p3 <> p2 + 1 AS INTEGER) + CAST(p4 <> p3 + 1 AS INTEGER)) - (p1 - 1) END AS score FROM m4)
SELECT label, round(CAST(score - greatest(length(h) - {len(_Q)}, 0) * 0.3 AS DOUBLE), 6) AS score FROM s WHERE score IS NOT NULL ORDER BY score DESC, length(label), label LIMIT 200
""")
def fuzzy_rank(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_name").alias("label"), F.lit("table").alias("kind")).distinct()
    return search.search(items, _Q).select("label", F.round("score", 6).alias("score"))


_CATALOG = {
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "users": ["id", "name"],
    "conv": ["id", "title"],
}
_ROWS = ", ".join(f"('{t}', '{c}')" for t, cs in _CATALOG.items() for c in cs)


@query("SELECT * FROM (VALUES ('documents', 'doc_id', NULL), ('labels', 'doc_id', NULL), ('conversations', 'conv_id', 'conv'), ('events', 'event_id', 'events'), ('events', 'user_id', 'users')) AS v(tbl, col, target)")
def fk_inference(t: Tables) -> DataFrame:
    from tessera.operators.lookup import prioritized_lookup

    catalog = t.spark.sql(f"SELECT * FROM VALUES {_ROWS} AS c(tbl, col)")
    refs = catalog.where("col RLIKE '^.+_id$'").select("*", F.concat_ws(".", "tbl", "col").alias("ref"), F.regexp_extract("col", "^(.+)_id$", 1).alias("stem"))
    tables = catalog.select("tbl").distinct()
    found = prioritized_lookup(refs, "ref", [inflect.inflect_column(F.col("stem"), True), F.col("stem")], tables, [F.col("tbl"), F.col("tbl")], [F.col("__target.tbl")])
    return found.select("tbl", "col", F.col("target.tbl").alias("target"))
