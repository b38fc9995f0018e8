"""Linking as joins: from tables and declared links of all workspaces to their final relations.

A link is a row from one table to another.  Links that mean the same meet in one
group, links to tables that nobody declares give way to others on the same
columns, columns and cardinalities follow from the tables at both ends, and what
nobody declares is inferred from the names of columns.  Every pass is a join, a
window or an aggregate over tables, columns or links, so no workspace is one
task's work.

The order of the declarations decides wherever one of several must be taken:
``seq`` numbers a workspace's links and tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import loose
from tessera.model import AUTO_FK_KINDS

SOURCE = "struct<file:string,line:int>"
REFS = f"array<{SOURCE}>"
PROVENANCE = f"struct<derivation:string,confidence:string,merged:boolean,refs:{REFS},notes:array<string>>"
COLUMNS = (
    "array<struct<name:string,type:string,nullable:boolean,primary_key:boolean,unique:boolean,generated:boolean,`default`:string,comment:string,is_array:boolean,enum_ref:string,"
    f"source:{SOURCE},references:struct<entity:string,column:string,inferred:boolean>,implied:boolean,provenance:{PROVENANCE}>>"
)
#: What the replay of a workspace leaves of each table.  ``hints`` has what a column may mean by its name, ``said`` how other names may mention the table.
TABLE = (
    f"id string, name string, schema string, kind string, external boolean, full boolean, certain boolean, created boolean, columns {COLUMNS}, "
    "indexes array<struct<name:string,columns:array<string>,unique:boolean>>, models array<struct<name:string,kind:string,child:boolean>>, sources array<string>, files array<string>, "
    f"refs {REFS}, comment string, engine string, `group` string, source {SOURCE}, aliases array<string>, hints array<struct<column:string,names:array<string>,model:string>>, said array<string>, "
    f"model_names array<string>, provenance {PROVENANCE}"
)
#: Declared links between tables that are known or external; ``guesses`` are columns that one without columns may use.
LINK = (
    "`from` string, from_columns array<string>, `to` string, to_columns array<string>, cardinality string, kind string, sources array<string>, name string, on_delete string, on_update string, "
    f"through string, through_name string, declared_optional boolean, source {SOURCE}, refs {REFS}, guessed_target boolean, guessed_fk boolean, guesses array<string>"
)
MANY, ONE = "many-to-many", "one-to-one"
#: Kinds of links, the weakest first.
STRENGTH = ("inferred", "orm", "foreign-key")
MOST_REFS = 12
# Fixed value: columns that a table which only joins two others may have besides.
BOOKKEEPING = r"(?i)^(id|created_?at|updated_?at|inserted_?at|created_?on|updated_?on|date_?created|date_?updated|created|modified)$"
IMPLIED_NOTE = "An association of models implies this column."



def _texts() -> Column:
    return F.array().cast("array<string>")


def _low(names: Column) -> Column:
    """Names beyond case and order, as a key."""
    return F.array_sort(F.transform(names, F.lower))


def _named(columns: Column, name: Column) -> Column:
    """The column of this name, null without one."""
    return F.get(F.filter(columns, lambda c: F.lower(c["name"]) == F.lower(name)), F.lit(0))


def _alike(columns: Column, name: Column) -> Column:
    """The column of this name, else the only one of like spelling."""
    some = F.filter(columns, lambda c: loose(c["name"]) == loose(name))
    return F.coalesce(_named(columns, name), F.when(F.size(some) == 1, F.get(some, F.lit(0))))


def _keys_of(columns: Column) -> Column:
    return F.transform(F.filter(columns, lambda c: c["primary_key"]), lambda c: c["name"])


def key_columns(columns: Column) -> Column:
    """The primary key, else ``id`` or ``_id``."""
    spare = F.coalesce(_named(columns, F.lit("id")), _named(columns, F.lit("_id")))
    keys = _keys_of(columns)
    return F.when(F.size(keys) > 0, keys).when(spare.isNotNull(), F.array(spare["name"])).otherwise(_texts())


def _strength(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in STRENGTH]), kind)


def _first(column: str) -> Column:
    """The first value that is not null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def _first_filled(column: str) -> Column:
    filled = F.size(column) > 0 if column.endswith("columns") else F.col(column).isNotNull()
    return F.coalesce(F.min_by(column, F.when(filled, F.col("seq"))), F.min_by(column, "seq")).alias(column)


def _united(column: str) -> Column:
    """Distinct members of all arrays, in order of the links."""
    each = F.array_sort(F.collect_list(F.struct("seq", F.col(column).alias("some"))))
    return F.array_distinct(F.flatten(F.transform(each, lambda x: x["some"]))).alias(column)


def united(links: DataFrame, *key: str) -> DataFrame:
    """One link for each key, which knows what any of the group's links knows; the earliest is asked first."""
    single = F.when(F.count_if(F.col("cardinality") == ONE) > 0, ONE).otherwise(F.min_by("cardinality", "seq"))
    out = links.groupBy("workspace", *key).agg(
        *[F.min_by(c, "seq").alias(c) for c in ("from", "to", "from_columns") if c not in key],
        *[_first_filled(c) for c in ("to_columns", "through", "through_name")],
        *[_first(c) for c in ("name", "on_delete", "on_update", "declared_optional", "source")],
        F.max_by("kind", _strength(F.col("kind"))).alias("kind"),
        single.alias("cardinality"),
        _united("sources"),
        F.slice(_united("refs"), 1, MOST_REFS).alias("refs"),
        F.bool_and("guessed_target").alias("guessed_target"),
        F.bool_and("guessed_fk").alias("guessed_fk"),
        F.min("seq").alias("first"),
    )
    return out.withColumnRenamed("first", "seq")


def _side(tables: DataFrame, end: str, *columns: str) -> DataFrame:
    """Tables as one end of links: ``from`` or ``to`` and a struct of some of their columns."""
    return tables.select("workspace", F.col("id").alias(end), F.struct(*columns).alias(f"{end}_table"))


def with_columns(links: DataFrame, tables: DataFrame) -> DataFrame:
    """Links without columns get those of the only link beside them, else the first likely column of their table.

    One that has neither goes if several links lead the same way, and stays bare if none does.
    """
    plain = links.where(F.col("cardinality") != MANY)
    has = F.size("from_columns") > 0
    beside = plain.where(has).groupBy("workspace", "from", "to").agg(F.countDistinct(_low(F.col("from_columns"))).alias("ways"), F.min_by("from_columns", "seq").alias("way"))
    bare = plain.where(~has).join(beside, ["workspace", "from", "to"], "left").join(_side(tables, "from", "columns"), ["workspace", "from"])
    likely = F.filter(F.transform("guesses", lambda g: _alike(F.col("from_table.columns"), g)["name"]), lambda n: n.isNotNull())
    bare = bare.withColumn("likely", F.slice(likely, 1, 1))
    one = F.coalesce(F.col("ways") == 1, F.lit(False))
    bare = bare.where(one | (F.size("likely") > 0) | F.col("ways").isNull())
    bare = bare.withColumns({"from_columns": F.when(one, F.col("way")).otherwise(F.col("likely")), "guessed_fk": ~one & (F.size("likely") > 0), "seq": F.col("seq") + LATER})
    return plain.where(has).select(*links.columns).unionByName(bare.select(*links.columns)).unionByName(links.where(F.col("cardinality") == MANY))


#: Added to the place of links that others are asked before.
LATER = 1 << 40


def without_doubles(links: DataFrame, tables: DataFrame) -> DataFrame:
    """Links that mean the same as one.

    Links on the same columns to the same table do.  So do those on the same
    columns to a table that nothing declares, if another leads to a declared
    one.  Links of many to many meet whichever way they run, if what joins their
    tables has one name or, in either, none.
    """
    plain = links.where(F.col("cardinality") != MANY).join(_side(tables, "to", "external"), ["workspace", "to"]).withColumn("key", _low(F.col("from_columns")))
    real = ~F.col("to_table.external")
    same_columns = Window.partitionBy("workspace", "from", "key")
    target = F.max(F.when(real & (F.size("key") > 0), F.struct("seq", "to"))).over(same_columns)["to"]
    plain = plain.withColumn("target", target)
    gives_way = ~real & F.col("target").isNotNull()
    plain = plain.withColumns({"to": F.when(gives_way, F.col("target")).otherwise(F.col("to")), "seq": F.when(gives_way, F.col("seq") + 2 * LATER).otherwise(F.col("seq"))})
    plain = united(plain, "from", "key", "to")

    pair = F.array_sort(F.array("from", "to"))
    many = links.where(F.col("cardinality") == MANY).withColumns({"pair": pair, "by": loose(F.col("through_name"))})
    first_name = F.min(F.when(F.col("by").isNotNull(), F.struct("seq", "by"))).over(Window.partitionBy("workspace", "pair"))["by"]
    many = united(many.withColumn("by", F.coalesce("by", first_name, F.lit(""))), "pair", "by")
    return plain.drop("key").unionByName(many.drop("pair", "by"))


def living(links: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that can be drawn, and warnings about those that can't.

    An association whose column a complete table lacks can't, unless its framework makes such columns itself.
    """
    joined = links.join(_side(tables, "from", "name", "full", "external", "columns"), ["workspace", "from"])
    lacking = F.filter("from_columns", lambda n: _alike(F.col("from_table.columns"), n).isNull())
    sure = F.col("from_table.full") & ~F.col("from_table.external")
    makes = F.arrays_overlap("sources", F.array(*[F.lit(k) for k in AUTO_FK_KINDS]))
    dead = (F.col("kind") == "orm") & (F.col("cardinality") != MANY) & sure & ~makes & (F.size("lacking") > 0)
    joined = joined.withColumn("lacking", lacking).withColumn("dead", dead)
    said = F.concat(F.lit('Association not drawn: table "'), "from_table.name", F.lit('" has no column '), F.array_join(F.transform("lacking", lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", "), F.lit(" (declared in the model, missing in the schema)."))
    warnings = joined.where("dead").select("workspace", F.col("seq").alias("place"), F.col("source.file").alias("file"), F.col("source.line").alias("line"), said.alias("message"))
    return joined.where("NOT dead").select(*links.columns), warnings


def implied_columns(links: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables with the columns that links use and they don't declare, the earliest link's first.

    Incomplete tables get them, and complete ones from frameworks that make such columns.
    """
    plain = links.where((F.col("cardinality") != MANY) & (F.size("from_columns") > 0))
    joined = plain.join(_side(tables, "from", "full", "external", "columns"), ["workspace", "from"]).join(_side(tables, "to", "columns"), ["workspace", "to"])
    makes = F.arrays_overlap("sources", F.array(*[F.lit(k) for k in AUTO_FK_KINDS])) & (F.col("kind") == "orm")
    joined = joined.where(~F.col("from_table.external") & (~F.col("from_table.full") | makes))
    each = joined.select("*", F.posexplode("from_columns").alias("i", "column")).where(_alike(F.col("from_table.columns"), F.col("column")).isNull())
    target = _named(F.col("to_table.columns"), F.get("to_columns", F.col("i")))
    why = F.struct(
        F.lit("implied").alias("derivation"), F.lit("medium").alias("confidence"), F.lit(None).cast("boolean").alias("merged"),
        F.when(F.col("source").isNotNull(), F.array("source")).otherwise(F.array().cast(REFS)).alias("refs"), F.array(F.lit(IMPLIED_NOTE)).alias("notes"),
    )
    fresh = {"name": F.col("column"), "type": F.coalesce(target["type"], F.lit("")), "nullable": F.coalesce("declared_optional", F.lit(True)), "primary_key": F.lit(False), "unique": F.lit(False), "implied": F.lit(True), "provenance": why}
    fields = tables.schema["columns"].dataType.elementType.fields
    column = F.struct(*[fresh.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    each = each.select("workspace", F.col("from").alias("id"), F.struct("seq", "i").alias("place"), loose(F.col("column")).alias("key"), column.alias("column"))
    once = each.groupBy("workspace", "id", "key").agg(F.min("place").alias("place"), F.min_by("column", "place").alias("column"))
    # array_sort would compare whole columns: places first, which differ.
    more = once.groupBy("workspace", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "column"))), lambda x: x["column"]).alias("more"))
    return tables.join(more, ["workspace", "id"], "left").withColumn("columns", F.when(F.col("more").isNotNull(), F.concat("columns", "more")).otherwise(F.col("columns"))).drop("more")


def finished(links: DataFrame, tables: DataFrame) -> DataFrame:
    """Links with ``cardinality`` and ``optional`` as the columns of their table have it.

    Columns that are a key of their table, or a unique index, lead from one row to one.
    """
    joined = links.join(_side(tables, "from", "columns", "indexes"), ["workspace", "from"])
    columns = F.col("from_table.columns")
    used = F.filter(F.transform("from_columns", lambda n: _named(columns, n)), lambda c: c.isNotNull())
    joined = joined.withColumn("used", used)
    unique = F.transform(F.filter("from_table.indexes", lambda i: i["unique"]), lambda i: _low(i["columns"]))
    keys = F.concat(F.array(_low(_keys_of(columns))), unique)
    alone = (F.size("used") == 1) & F.get("used", F.lit(0))["unique"]
    all_there = (F.size("used") > 0) & (F.size("used") == F.size("from_columns"))
    single = (F.col("cardinality") == "many-to-one") & all_there & (F.array_contains(keys, _low(F.col("from_columns"))) | alone)
    absent = F.coalesce("declared_optional", F.lit(True))
    may = F.when(F.col("cardinality") == MANY, True).when(F.size("used") > 0, F.exists("used", lambda c: c["nullable"] & ~c["primary_key"])).otherwise(absent)
    return joined.withColumns({"cardinality": F.when(single, ONE).otherwise(F.col("cardinality")), "optional": may}).select(*links.columns, "optional")


def referenced(links: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables whose columns say what they reference: what is declared before what is inferred, the earliest first."""
    each = links.where(F.col("cardinality") != MANY).select("*", F.posexplode("from_columns").alias("i", "column"))
    inferred = F.col("kind") == "inferred"
    side = F.coalesce(F.get("to_columns", F.col("i")), F.get("to_columns", F.lit(0)))
    target = F.struct(F.col("to").alias("entity"), side.alias("column"), F.when(inferred, True).alias("inferred"))
    each = each.select("workspace", F.col("from").alias("id"), F.lower("column").alias("key"), F.struct(inferred.alias("weak"), "seq", "i").alias("place"), target.alias("target"))
    best = each.groupBy("workspace", "id", "key").agg(F.min_by("target", "place").alias("target"))
    found = best.groupBy("workspace", "id").agg(F.collect_list(F.struct("key", "target")).alias("found"))

    def told(c: Column) -> Column:
        new = F.get(F.filter("found", lambda x: x["key"] == F.lower(c["name"])), F.lit(0))["target"]
        old = c["references"]
        weak_old, weak_new = F.coalesce(old["inferred"], F.lit(False)), F.coalesce(new["inferred"], F.lit(False))
        return c.withField("references", F.when(old.isNull() | (weak_old & new.isNotNull() & ~weak_new), new).otherwise(old))

    told_columns = F.when(F.col("found").isNull(), F.col("columns")).otherwise(F.transform("columns", told))
    return tables.join(found, ["workspace", "id"], "left").withColumn("columns", told_columns).drop("found")


def inferred(links: DataFrame, tables: DataFrame) -> DataFrame:
    """Links that columns' names suggest: ``author_id`` means the key of ``authors``.

    Each column without a link has names of tables that it may mean, the likeliest
    first, and of a model.  They are looked up among the tables of the workspace;
    the first name that a declared table of the same kind answers to wins.
    """
    own = tables.where("NOT external").select("workspace", "id", "schema", "kind", "sources", "seq", "source", "columns", "indexes", F.explode("hints").alias("h"))
    own = own.withColumn("c", _named(F.col("columns"), F.col("h.column"))).where(F.col("c").isNotNull() & F.col("c.references").isNull())
    taken = links.where(F.col("cardinality") != MANY).select("workspace", F.col("from").alias("id"), F.explode("from_columns").alias("n")).select("workspace", "id", F.lower("n").alias("low")).distinct()
    own = own.withColumn("low", F.lower("h.column")).join(taken, ["workspace", "id", "low"], "left_anti")

    asked = own.select("workspace", "id", "low", "kind", "schema", "sources", F.posexplode(F.concat("h.names", F.array("h.model"))).alias("rank", "said"), (F.size("h.names")).alias("names"))
    asked = asked.withColumn("model", F.col("rank") == F.col("names")).withColumn("key", F.when(F.col("model"), F.concat(F.lit("model "), F.lower("said"))).otherwise(F.lower("said")))
    answers = tables.select("workspace", F.col("id").alias("t_id"), F.col("seq").alias("t_seq"), F.col("kind").alias("t_kind"), F.col("schema").alias("t_schema"), F.col("external").alias("t_external"), "name", "aliases", "models")
    by_name = answers.select("*", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), F.lower))).alias("key"), F.lit(None).cast("string").alias("m_kind"))
    by_model = answers.select("*", F.explode("models").alias("m")).select(*answers.columns, F.concat(F.lit("model "), F.lower("m.name")).alias("key"), F.col("m.kind").alias("m_kind"))
    found = asked.join(by_name.unionByName(by_model).withColumn("t_name", F.lower("name")).drop("name", "aliases", "models"), ["workspace", "key"])
    same_kind, same_schema = F.col("kind") == F.col("t_kind"), F.col("schema").eqNullSafe(F.col("t_schema"))
    # A table without schema answers to its own name first, then one of the asking table's kind and schema, then one without schema.
    plain = F.col("t_schema").isNull() & (F.col("t_name") == F.col("key"))
    by_table = F.when(plain & same_kind, 0).when(plain, 1).when(same_kind & same_schema, 2).when(same_kind & F.col("t_schema").isNull(), 3).otherwise(4)
    by_class = F.when(F.col("m_kind") == F.coalesce(F.get("sources", F.lit(0)), F.lit("sql")), 0).otherwise(2) + F.when(same_schema, 0).otherwise(1)
    found = found.withColumn("order", F.struct(F.when(F.col("model"), by_class).otherwise(by_table).alias("a"), F.col("t_seq")))
    # Of each name the best answer, fitting or not; of the names the first whose answer fits.
    answered = found.groupBy("workspace", "id", "low", "rank").agg(F.min_by(F.struct("t_id", (same_kind & ~F.col("t_external")).alias("fits")), "order").alias("best"))
    chosen = answered.where("best.fits").groupBy("workspace", "id", "low").agg(F.min_by("best.t_id", "rank").alias("to"))

    linked = own.join(chosen, ["workspace", "id", "low"]).withColumnRenamed("id", "from").join(_side(tables, "to", "columns"), ["workspace", "to"])
    to_columns, self_ = key_columns(F.col("to_table.columns")), F.col("to") == F.col("from")
    linked = linked.withColumn("to_columns", to_columns).where((F.size("to_columns") == 1) & ~(self_ & (F.col("c.primary_key") | (F.lower(F.get("to_columns", F.lit(0))) == F.col("low")))))
    only = F.array(F.col("low"))
    unique = F.col("c.unique") | (_low(_keys_of(F.col("columns"))) == only) | F.exists("indexes", lambda i: i["unique"] & (_low(i["columns"]) == only))
    where = F.coalesce(F.col("c.source"), F.col("source"))
    place = F.array_position(F.transform("columns", lambda c: F.lower(c["name"])), F.col("low"))
    rows = {
        "workspace": F.col("workspace"), "seq": 4 * LATER + F.col("seq") * (1 << 16) + place, "from": F.col("from"), "from_columns": F.array("c.name"), "to": F.col("to"), "to_columns": F.col("to_columns"),
        "cardinality": F.when(unique, ONE).otherwise("many-to-one"), "kind": F.lit("inferred"), "sources": F.slice("sources", 1, 1), "source": where,
        "refs": F.when(where.isNotNull(), F.array(where)).otherwise(F.array().cast(REFS)), "guessed_target": F.lit(False), "guessed_fk": F.lit(False),
    }
    return linked.select(*[rows.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in links.schema.fields])


def junctions(links: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables that only join two others, as ``join_table``, and links of many to many through each.

    Such a table has two links out and none in, and no columns but theirs and
    bookkeeping.  It has a key of the links' columns, no number of its own, or a
    name that mentions both its targets.  A declared link of many to many that
    names it, or names nothing, is its link; else it gets one.
    """
    plain = links.where(F.col("cardinality") != MANY)
    out = plain.groupBy("workspace", F.col("from").alias("id")).agg(
        F.count("*").alias("ways"), F.bool_and(F.size("from_columns") > 0).alias("spelt"), F.array_distinct(F.flatten(F.collect_list(F.transform("from_columns", F.lower)))).alias("used"),
        F.min_by(F.struct("to", "to_columns"), "seq").alias("one"), F.max_by(F.struct("to", "to_columns"), "seq").alias("two"), F.min_by("kind", _strength(F.col("kind"))).alias("weaker"),
    )
    pointed = plain.where(F.col("from") != F.col("to")).select("workspace", F.col("to").alias("id")).distinct()
    rows = tables.drop("said").where((F.col("kind") == "table") & ~F.col("external") & (F.size("columns") > 0)).join(out.where("ways = 2 AND spelt"), ["workspace", "id"]).join(pointed, ["workspace", "id"], "left_anti")
    others = F.filter(F.transform("columns", lambda c: c["name"]), lambda n: ~F.array_contains(F.col("used"), F.lower(n)))
    rows = rows.withColumn("others", others).where(F.forall("others", lambda n: n.rlike(BOOKKEEPING)))
    within = lambda names: (F.size(names) > 1) & F.forall(names, lambda n: F.array_contains(F.col("used"), F.lower(n)))
    composite = within(_keys_of(F.col("columns"))) | F.exists("indexes", lambda i: i["unique"] & within(i["columns"]))
    numbered = F.exists("others", lambda n: F.lower(n).isin("id", "_id"))
    for end in ("one", "two"):
        rows = rows.withColumn("end", F.col(f"{end}.to")).join(tables.select("workspace", F.col("id").alias("end"), F.col("said").alias(f"{end}_said")), ["workspace", "end"]).drop("end")
    mentions = reduce(Column.__and__, [F.exists(f"{end}_said", lambda s: F.contains(loose(F.col("name")), s)) for end in ("one", "two")])
    found = rows.where(composite | ~numbered | mentions).select("workspace", "id", "name", "seq", "sources", "source", "one", "two", "weaker", F.array_sort(F.array("one.to", "two.to")).alias("pair"))

    many = links.where(F.col("cardinality") == MANY).withColumn("pair", F.array_sort(F.array("from", "to"))).select("workspace", "pair", F.col("seq").alias("link"), F.col("through").alias("via"), "through_name")
    told = F.coalesce((F.col("via") == F.col("id")) | (F.lower("through_name") == F.lower("name")), F.lit(False))
    named = found.join(many, ["workspace", "pair"]).where(told).groupBy("workspace", "id", "pair", "name").agg(F.min("link").alias("link"))
    nth = lambda order: F.row_number().over(Window.partitionBy("workspace", "pair").orderBy(order))
    free = many.where("via IS NULL AND through_name IS NULL").withColumn("nth", nth("link"))
    waiting = found.join(named, ["workspace", "id"], "left_anti").withColumn("nth", nth("seq"))
    taken = waiting.join(free, ["workspace", "pair", "nth"]).select("workspace", "id", "pair", "name", "link")
    through = named.unionByName(taken).groupBy("workspace", F.col("link").alias("seq")).agg(F.min(F.struct("id", "name")).alias("by"))
    links = links.join(through, ["workspace", "seq"], "left").withColumns({"through": F.coalesce("by.id", "through"), "through_name": F.coalesce("by.name", "through_name")}).drop("by")

    fresh = found.join(named.unionByName(taken).select("workspace", "id").distinct(), ["workspace", "id"], "left_anti")
    rows = {
        "workspace": F.col("workspace"), "seq": 8 * LATER + F.col("seq"), "from": F.col("one.to"), "from_columns": F.col("one.to_columns"), "to": F.col("two.to"), "to_columns": F.col("two.to_columns"),
        "cardinality": F.lit(MANY), "kind": F.col("weaker"), "sources": F.col("sources"), "through": F.col("id"), "through_name": F.col("name"), "source": F.col("source"),
        "refs": F.when(F.col("source").isNotNull(), F.array("source")).otherwise(F.array().cast(REFS)), "guessed_target": F.lit(False), "guessed_fk": F.lit(False), "optional": F.lit(True),
    }
    more = fresh.select(*[rows.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in links.schema.fields])
    marks = found.select("workspace", "id", F.lit(True).alias("join_table"))
    return links.unionByName(more), tables.join(marks, ["workspace", "id"], "left")
