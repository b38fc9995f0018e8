"""Analytics over resolved models: counts, rankings, visibility, focus, search items, cards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import natural_key
from tessera.operators import scan
from tessera.operators.graph import within_hops

MANY = "many-to-many"
#: Columns that a card shows before it collapses, and how many it shows then.
COLLAPSE_ABOVE, COLLAPSE_TO = 15, 12


@dataclass(frozen=True)
class Filters:
    hide_external: bool = False
    hide_join_tables: bool = False
    hide_inferred: bool = False
    disabled_schemas: tuple[str, ...] = ()
    disabled_engines: tuple[str, ...] = ()
    disabled_sources: tuple[str, ...] = ()


def qualified(schema: str = "schema", name: str = "name") -> Column:
    return F.concat_ws(".", schema, name)


def kind_label() -> Column:
    join = F.when(F.coalesce("join_table", F.lit(False)), "join table").otherwise("table")
    return F.when(F.coalesce("external", F.lit(False)), "external").when(F.col("kind") != "table", F.col("kind")).otherwise(join)


def column_keys(c: Column) -> Column:
    """PK, FK and UK as they hold."""
    marks = F.array(F.when(c["primary_key"], "PK"), F.when(c["references"].isNotNull(), "FK"), F.when(c["unique"] & ~c["primary_key"], "UK"))
    return F.filter(marks, lambda k: k.isNotNull())


def display_type(c: Column) -> Column:
    plain = (c["type"] != "") & ~c["type"].rlike(r"(?i)\[\]$|^array|<.*>$|\[$")
    return F.when(F.coalesce(c["is_array"], F.lit(False)) & plain, F.concat(c["type"], F.lit("[]"))).otherwise(c["type"])


def counts(models: DataFrame) -> DataFrame:
    """Tables, views, collections and external ones of each workspace."""
    external = F.coalesce("external", F.lit(False))
    of = lambda kind: F.count_if(~external & (F.col("kind") == kind))
    return scan.entities(models).groupBy("workspace").agg(of("table").alias("tables"), of("view").alias("views"), of("collection").alias("collections"), F.count_if(external).alias("external"))


def groups(models: DataFrame) -> DataFrame:
    """Entities by kind and, where a kind has several, by schema: a two-level rollup with the default schema first."""
    defined = scan.entities(models).where("NOT coalesce(external, false)").select("workspace", "kind", F.coalesce("schema", F.lit("")).alias("schema"))
    rolled = defined.rollup("workspace", "kind", "schema").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level IN (0, 1)")
    several = F.count(F.when(F.col("level") == 0, 1)).over(Window.partitionBy("workspace", "kind"))
    return rolled.withColumn("schemas", several).where("level = 1 OR schemas > 1").select("workspace", "kind", "schema", "n", (F.col("level") == 1).alias("whole_kind"))


def _pairs(models: DataFrame) -> DataFrame:
    r = scan.relations(models).where(F.col("from") != F.col("to"))
    return r.select("workspace", F.col("from").alias("id"), F.col("to").alias("other")).unionByName(r.select("workspace", F.col("to").alias("id"), F.col("from").alias("other")))


def degrees(models: DataFrame) -> DataFrame:
    """Distinct neighbours of each entity over all relations."""
    return _pairs(models).distinct().groupBy("workspace", "id").agg(F.count("*").alias("degree"))


def _top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("workspace").orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def largest(models: DataFrame, n: int = 5) -> DataFrame:
    """Defined entities with most columns, ties in model order."""
    sized = scan.entities(models).where("NOT coalesce(external, false)").select("workspace", "id", "seq", F.size("columns").alias("n_columns"))
    return _top(sized, [F.desc("n_columns"), F.col("seq")], n).select("workspace", "rank", "id", "n_columns")


def most_connected(models: DataFrame, n: int = 5) -> DataFrame:
    joined = degrees(models).join(scan.entities(models).select("workspace", "id", "seq"), ["workspace", "id"])
    return _top(joined, [F.desc("degree"), F.col("seq")], n).select("workspace", "rank", "id", "degree")


def adjacency(models: DataFrame) -> DataFrame:
    """Relations seen from each entity: ``direction`` is out or in; a many-to-many one goes out of both ends."""
    r = scan.relations(models)
    out = r.select("workspace", F.col("from").alias("entity"), F.lit("out").alias("direction"), F.col("id").alias("relation"), F.col("to").alias("other"))
    direction = F.when(F.col("cardinality") == MANY, "out").otherwise("in")
    back = r.where((F.col("cardinality") != MANY) | (F.col("from") != F.col("to"))).select("workspace", F.col("to").alias("entity"), direction.alias("direction"), F.col("id").alias("relation"), F.col("from").alias("other"))
    return out.unionByName(back)


def visible(models: DataFrame, filters: Filters = Filters(), only: DataFrame | None = None) -> DataFrame:
    """Entities that pass the filters and, with ``only`` (workspace, id), belong to a saved view."""
    rows = scan.entities(models)
    listed = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    keep = F.lit(True)
    if filters.hide_external:
        keep = keep & ~F.coalesce("external", F.lit(False))
    if filters.hide_join_tables:
        keep = keep & ~F.coalesce("join_table", F.lit(False))
    keep = keep & ~F.coalesce("schema", F.lit("")).isin(*filters.disabled_schemas) & ~F.coalesce("engine", F.lit("")).isin(*filters.disabled_engines)
    hidden = (F.size("sources") > 0) & F.forall("sources", lambda s: F.array_contains(listed(filters.disabled_sources), s))
    rows = rows.where(keep & ~hidden)
    return rows.join(only.select("workspace", "id").distinct(), ["workspace", "id"], "left_semi") if only is not None else rows


def drawn_edges(models: DataFrame, shown: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Relations with both ends shown; a many-to-many one only where its join table is not shown."""
    r = scan.relations(models)
    if filters.hide_inferred:
        r = r.where("kind <> 'inferred'")
    ids = shown.select("workspace", "id")
    for end in ("from", "to"):
        r = r.join(ids.withColumnRenamed("id", end), ["workspace", end], "left_semi")
    through = ids.select("workspace", F.col("id").alias("through"), F.lit(True).alias("__drawn"))
    r = r.join(through, ["workspace", "through"], "left").where(f"cardinality <> '{MANY}' OR __drawn IS NULL")
    variant = F.when(F.col("cardinality") == MANY, "m2m").otherwise("relation")
    return r.select("workspace", "id", "from", "to", variant.alias("variant"), (F.col("from") == F.col("to")).alias("self"))


def focus(edges: DataFrame, selection: DataFrame, hops: int) -> DataFrame:
    """Entities within some hops of the selected one of each workspace (workspace, id): ``workspace``, ``id``, ``hop``."""
    key = lambda c: F.struct("workspace", c)
    plain = edges.where("NOT self").select(key(F.col("from").alias("id")).alias("a"), key(F.col("to").alias("id")).alias("b"))
    reached = within_hops(plain, selection.select(key(F.col("id")).alias("v")), hops)
    return reached.select("v.workspace", "v.id", "hop")


def search_items(models: DataFrame) -> DataFrame:
    """One item for each table and each column: ``workspace``, ``entity``, ``label``, ``kind``."""
    e = scan.entities(models)
    tables = e.select("workspace", F.col("id").alias("entity"), qualified().alias("label"), F.lit("table").alias("kind"))
    columns = e.select("workspace", F.col("id").alias("entity"), F.explode("columns.name").alias("label"), F.lit("column").alias("kind"))
    return tables.unionByName(columns)


def cards(models: DataFrame, mode: str = "all") -> DataFrame:
    """Rows of each entity's card, collapsed where there are many, and how many are hidden."""
    shown = {"none": F.slice("columns", 1, 0), "keys": F.filter("columns", lambda c: F.size(column_keys(c)) > 0)}.get(mode, F.col("columns"))
    e = scan.entities(models).withColumn("shown", shown)
    long = F.size("shown") > COLLAPSE_ABOVE
    rows = F.when(long, F.slice("shown", 1, COLLAPSE_TO)).otherwise(F.col("shown"))
    lines = F.transform(rows, lambda c: F.struct(c["name"].alias("name"), display_type(c).alias("type"), column_keys(c).alias("keys")))
    return e.select("workspace", "id", kind_label().alias("kind"), lines.alias("rows"), F.when(long, F.size("shown") - COLLAPSE_TO).otherwise(0).alias("hidden"))


def column_mode(entities: Column) -> Column:
    """Columns that a map of so many tables shows."""
    return F.when(entities < 40, "all").when(entities < 250, "keys").otherwise("none")


def in_order(entities: DataFrame) -> DataFrame:
    """External ones last, then by schema and name as people sort them."""
    low = lambda c: natural_key(F.lower(F.coalesce(c, F.lit(""))))
    return entities.orderBy("workspace", F.coalesce("external", F.lit(False)), low("schema"), low("name"), "id")


def describe_relation(perspective: Column, other_name: Column) -> Column:
    """A relation as it reads from one of its ends."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("?")
    via = F.when(F.col("through_name").isNotNull(), F.concat(F.lit(" via "), "through_name")).otherwise("")
    both = F.concat(F.lit("↔ "), other_name, via, F.lit(" (many-to-many)"))
    out = F.concat(listed("from_columns"), F.lit(" → "), other_name, F.lit("."), listed("to_columns"), F.lit(" ("), "cardinality", F.lit(")"))
    back = F.when(F.col("cardinality") == "one-to-one", "one-to-one").otherwise("one-to-many")
    inward = F.concat(F.lit("← "), other_name, F.lit("."), listed("from_columns"), F.lit(" ("), back, F.lit(")"))
    return F.when(F.col("cardinality") == MANY, both).when(F.col("from") == perspective, out).otherwise(inward)


# What is said about how something is known.
DERIVATIONS = {
    "declared": "Declared", "orm": "ORM association", "inferred": "Inferred from naming", "guessed": "Name guessed", "implied": "Implied column", "external": "Not in workspace",
}
MOST_PLACES = 5


def uncertain(provenance: Column) -> Column:
    """Whether something needs a mark of doubt; without provenance it needs none."""
    return F.coalesce(~provenance["derivation"].isin("declared", "orm") | (provenance["confidence"] == "low"), F.lit(False))


def provenance_summary(provenance: Column) -> Column:
    """``Inferred from naming · low confidence · merged``."""
    labels = F.create_map(*[F.lit(x) for pair in DERIVATIONS.items() for x in pair])
    label = F.coalesce(F.try_element_at(labels, provenance["derivation"]), provenance["derivation"])
    merged = F.when(F.coalesce(provenance["merged"], F.lit(False)), F.lit("merged"))
    return F.concat_ws(" · ", label, F.concat(provenance["confidence"], F.lit(" confidence")), merged)


def provenance_lines(provenance: Column) -> Column:
    """The summary, the notes, and the first places with lines from one."""
    places = F.transform(F.slice(provenance["refs"], 1, MOST_PLACES), lambda r: F.concat(r["file"], F.lit(":"), (r["line"] + 1).cast("string")))
    left = F.size(provenance["refs"]) - MOST_PLACES
    more = F.when(left > 0, F.concat(F.lit(", +"), left.cast("string"), F.lit(" more"))).otherwise("")
    last = F.when(F.size(provenance["refs"]) > 0, F.array(F.concat(F.lit("From "), F.array_join(places, ", "), more))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(provenance_summary(provenance)), provenance["notes"], last)
