"""Resolved models from linked tables: what is kept, in which order, under which ids, and how it is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import natural_key
from tessera.operators.linking import MANY, MOST_REFS


def _natural(text: Column) -> Column:
    return natural_key(F.lower(F.coalesce(text, F.lit(""))))


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their place in their workspace as ``seq``, from 0."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("workspace").orderBy(*order)) - 1)


def entities(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Tables that are declared or that a link leads to, external ones last, each with how it is known."""
    ends = links.select("workspace", F.explode(F.array("from", "to", "through")).alias("id")).where("id IS NOT NULL").distinct().withColumn("met", F.lit(True))
    declared = ~F.col("external") & (F.col("created") | (F.size("columns") > 0) | (F.size("models") > 0))
    kept = tables.join(ends, ["workspace", "id"], "left").where(F.coalesce("met", F.lit(False)) | declared)
    there = F.transform("columns", lambda c: F.lower(c["name"]))
    indexes = F.filter("indexes", lambda i: F.forall(i["columns"], lambda n: F.array_contains(there, F.lower(n))))
    kept = kept.withColumns({"indexes": indexes, "external": F.when(F.col("external"), True)})
    kept = _numbered(kept, F.coalesce("external", F.lit(False)), _natural(F.col("schema")), _natural(F.col("name")), F.col("id"))
    names = ("id", "name", "schema", "kind", "model_names", "columns", "indexes", "sources", "files", "comment", "engine", "group", "source", "external", "join_table", "provenance")
    return kept.select("workspace", "seq", *names)


def _counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def _known(kind: Column) -> tuple[Column, Column, Column]:
    """How a link of a kind is known, how surely, and why."""
    pick = lambda fk, orm, rest: F.when(kind == "foreign-key", fk).when(kind == "orm", orm).otherwise(rest)
    why = pick("Declared as a foreign key.", "Declared as an association of models.", "Inferred from the column's name; nothing declares it.")
    return pick("declared", "orm", "inferred"), pick("high", "medium", "low"), why


def relations(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links with their ids, in the order of the names at their ends; of equal ids all but the first are numbered."""
    names = entities.select("workspace", F.col("id").alias("__id"), F.col("name").alias("__name"), F.coalesce("external", F.lit(False)).alias("__external"))
    ends = links
    for end in ("from", "to"):
        ends = ends.join(names.select("workspace", F.col("__id").alias(end), F.col("__name").alias(f"{end}_name"), F.col("__external").alias(f"{end}_external")), ["workspace", end])
    through = F.coalesce(F.concat(F.lit("@"), F.lower("through_name")), F.lit(""))
    many = F.concat("from", F.lit("<>"), "to", through)
    plain = F.concat("from", F.lit("("), F.array_join(F.transform("from_columns", F.lower), ","), F.lit(")>"), "to")
    ends = ends.withColumn("base", F.when(F.col("cardinality") == MANY, many).otherwise(plain))
    nth = F.row_number().over(Window.partitionBy("workspace", "base").orderBy("seq"))
    ends = ends.withColumn("nth", nth).withColumn("id", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), F.col("nth").cast("string"))))

    derivation, sure, why = _known(F.col("kind"))
    own = F.when(F.col("source").isNotNull(), F.array(F.struct("source.file", "source.line"))).otherwise(F.slice("refs", 1, 0))
    refs = F.slice(F.array_distinct(F.concat("refs", own)), 1, MOST_REFS)
    ends = ends.withColumn("refs", refs).withColumn("merged", (F.size("refs") > 1) | (F.size("sources") > 1))
    doubt = F.col("guessed_fk") | F.col("to_external")
    confidence = F.when(doubt, "low").when(F.col("guessed_target") & (sure == "high"), "medium").otherwise(sure)
    notes = F.array(
        why,
        F.when(F.col("guessed_fk"), "The columns are guessed from the target's name."),
        F.when(F.col("guessed_target"), "The target's name is guessed from the model's."),
        F.when(F.col("to_external"), F.concat(F.lit('The target "'), "to_name", F.lit('" is not defined in the workspace.'))),
        F.when(F.col("merged"), F.concat(F.lit("Merged from "), _counted(F.size("refs"), "declaration"), F.lit("."))),
    )
    provenance = F.struct(derivation.alias("derivation"), confidence.alias("confidence"), F.when(F.col("merged"), True).alias("merged"), "refs", F.filter(notes, lambda n: n.isNotNull()).alias("notes"))
    out = _numbered(ends.withColumn("provenance", provenance), _natural(F.col("from_name")), _natural(F.col("to_name")), natural_key(F.col("id")))
    columns = ("id", "from", "from_columns", "to", "to_columns", "cardinality", "kind", "optional", "name", "on_delete", "on_update", "through", "through_name", "sources", "source", "provenance")
    return out.select("workspace", "seq", *columns)


def enums(rows: DataFrame) -> DataFrame:
    return _numbered(rows, _natural(F.col("schema")), _natural(F.col("name")), F.col("id"))


def engines(hints: DataFrame, entities: DataFrame, known: dict[str, tuple[str, str]]) -> DataFrame:
    """Engines that anything hints at, those with most evidence first; a model's own engine is evidence if nothing else is."""
    hints = hints.select("workspace", "engine", "file", "line", "detail")
    models = entities.where(F.col("engine").isin(*known) & F.col("source").isNotNull()).join(hints.select("workspace", "engine").distinct(), ["workspace", "engine"], "left_anti")
    said = F.concat(F.get("sources", F.lit(0)), F.lit(' model "'), "name", F.lit('"'))
    models = models.groupBy("workspace", "engine").agg(F.min_by(F.struct("source.file", "source.line", said.alias("detail")), "seq").alias("e")).select("workspace", "engine", "e.*")
    each = hints.unionByName(models).select("workspace", F.col("engine").alias("id"), F.struct(natural_key(F.col("file")).alias("key"), "line", "detail", "file").alias("e"))
    found = each.groupBy("workspace", "id").agg(F.array_sort(F.collect_set("e")).alias("e"))
    evidence = F.transform("e", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["detail"].alias("detail")))
    names = F.create_map(*[F.lit(x) for engine, (label, category) in known.items() for x in (engine, f"{label}|{category}")])
    both = F.split(F.element_at(names, F.col("id")), r"\|")
    found = found.select("workspace", "id", both[0].alias("label"), both[1].alias("category"), evidence.alias("evidence"))
    return _numbered(found, -F.size("evidence"), F.col("label"))


def with_engines(entities: DataFrame, engines: DataFrame) -> DataFrame:
    """Entities without an engine get the only one of their kind, if there is exactly one."""
    of = lambda category: F.when(F.count_if(F.col("category") == category) == 1, F.max(F.when(F.col("category") == category, F.col("id"))))
    only = engines.groupBy("workspace").agg(of("relational").alias("__tables"), of("document").alias("__documents"))
    filled = entities.join(only, "workspace", "left").withColumn("engine", F.coalesce("engine", F.when(F.col("kind") == "collection", F.col("__documents")).otherwise(F.col("__tables"))))
    return filled.select(*entities.columns)


def sources(kinds: DataFrame, entities: DataFrame) -> DataFrame:
    """Files and entities of each technology, those with most first."""
    files = kinds.groupBy("workspace", "kind").agg(F.countDistinct("file").alias("files"))
    made = entities.where("external IS NULL").select("workspace", F.explode("sources").alias("kind")).groupBy("workspace", "kind").agg(F.count("*").alias("entities"))
    both = files.join(made, ["workspace", "kind"], "full").fillna(0, ["files", "entities"])
    return _numbered(both, F.desc("entities"), F.desc("files"), F.col("kind"))


def warnings(said: DataFrame, dead: DataFrame, most: int) -> DataFrame:
    """The first warnings: those of readers and of the replay, then those of links."""
    first = said.select("workspace", "file", "line", "message", F.lit(0).alias("late"), F.col("seq").alias("place"))
    last = dead.select("workspace", "file", "line", "message", F.lit(1).alias("late"), "place")
    return _numbered(first.unionByName(last), F.col("late"), F.col("place"), F.col("message")).where(F.col("seq") < most).drop("late", "place")


def as_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows of a part as JSON records, absent values left out."""
    columns = [c for c in df.columns if c not in ("workspace", "seq")]
    ident = F.col("id") if "id" in columns else F.lit("")
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    return df.select("workspace", F.lit(name).alias("part"), F.col("seq").cast("int").alias("seq"), ident.alias("id"), record.alias("record"))
