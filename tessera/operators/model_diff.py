"""What changed between two sets of models, as tables of changes.

``base`` and ``head`` are frames of ``scan.build_models``; everything is joined
by workspace and id, so any number of workspaces is compared at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.operators.diff import change_order, last_by_key

SIDES = ("base", "head")


@dataclass
class ModelDiff:
    """Changes of entities, columns, relations and enums."""

    entities: DataFrame
    columns: DataFrame
    relations: DataFrame
    enums: DataFrame

    def summary(self) -> DataFrame:
        """Counts for each workspace, part and kind of change; columns of added and removed entities are not counted."""
        counted = [
            self.entities.select("workspace", F.lit("entities").alias("part"), "change"),
            self.columns.where("entity_change = 'changed'").select("workspace", F.lit("columns").alias("part"), "change"),
            self.relations.select("workspace", F.lit("relations").alias("part"), "change"),
            self.enums.select("workspace", F.lit("enums").alias("part"), "change"),
        ]
        rows = counted[0]
        for more in counted[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("workspace", "part", "change").agg(F.count("*").alias("n"))

    def summary_text(self) -> DataFrame:
        """One line for each workspace with changes."""
        names = F.create_map(*[F.lit(x) for pair in (("entities", "table"), ("columns", "column"), ("relations", "relation"), ("enums", "enum")) for x in pair])
        rank = F.element_at(F.create_map(*[F.lit(x) for pair in (("entities", 0), ("columns", 1), ("relations", 2), ("enums", 3)) for x in pair]), F.col("part")) * 10
        rank = rank + F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
        said = F.concat(F.col("n").cast("string"), F.lit(" "), F.element_at(names, F.col("part")), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" "), F.col("change"))
        rows = self.summary().select("workspace", F.struct(rank.alias("rank"), said.alias("said")).alias("x"))
        return rows.groupBy("workspace").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"]), ", ").alias("summary"))


def _joined(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of whole rows as ``base`` and ``head`` structs; of rows with one key the last counts."""
    sides = []
    for df, side in zip((base, head), SIDES):
        rest = [c for c in df.columns if c not in keys]
        one = last_by_key(df, keys, F.col("seq")) if "seq" in df.columns else df
        sides.append(one.select(*keys, F.struct(*[c for c in rest]).alias(side)))
    joined = sides[0].join(sides[1], keys, "full_outer")
    return joined.withColumn("change", F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "removed").otherwise("changed"))


def _said(*pairs: tuple[Column, Column]) -> Column:
    """Texts of the differences that hold."""
    return F.filter(F.array(*[F.when(differs, text) for differs, text in pairs]), lambda x: x.isNotNull())


def _flag(name: str, yes: str, no: str) -> tuple[Column, Column]:
    a, b = (F.coalesce(F.col(f"{s}.{name}"), F.lit(False)) for s in SIDES)
    return a != b, F.when(b, yes).otherwise(no)


def _value(name: str, title: str, missing: str, lower: bool = False) -> tuple[Column, Column]:
    a, b = (F.coalesce(F.col(f"{s}.{name}"), F.lit("")) for s in SIDES)
    differs = F.lower(a) != F.lower(b) if lower else a != b
    show = lambda x: F.when(x == "", missing).otherwise(x)
    return differs, F.concat(F.lit(f"{title}: "), show(a), F.lit(" -> "), show(b))


def _qualified(side: str) -> Column:
    return F.concat_ws(".", f"{side}.schema", f"{side}.name")


def _index_signatures(side: str) -> Column:
    signature = lambda i: F.concat(F.when(i["unique"], "unique ").otherwise(""), F.lit("("), F.array_join(i["columns"], ", "), F.lit(")"))
    return F.coalesce(F.transform(f"{side}.indexes", signature), F.array().cast("array<string>"))


def column_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Added, removed and changed columns of entities that either side has, with texts of what changed."""
    keyed = [scan.columns(m).withColumn("key", F.lower("name")).withColumn("seq", F.col("pos")) for m in (base, head)]
    joined = _joined(*keyed, ["workspace", "entity_id", "key"])
    said = _said(
        _value("type", "type", "?", lower=True),
        _flag("nullable", "now nullable", "now NOT NULL"),
        _flag("primary_key", "now primary key", "no longer primary key"),
        _flag("unique", "now unique", "no longer unique"),
        _flag("generated", "now generated", "no longer generated"),
        _flag("is_array", "now an array", "no longer an array"),
        _value("default", "default", "(none)"),
        (F.coalesce("base.comment", F.lit("")) != F.coalesce("head.comment", F.lit("")), F.lit("comment changed")),
    )
    changes = F.when(F.col("change") == "changed", said).otherwise(F.array().cast("array<string>"))
    rows = joined.select("workspace", "entity_id", F.coalesce("head.name", "base.name").alias("name"), "change", changes.alias("changes"), F.coalesce("head.type", "base.type").alias("type"))
    return rows.where("change <> 'changed' OR size(changes) > 0")


def compare(base: DataFrame, head: DataFrame) -> ModelDiff:
    """All changes from ``base`` to ``head``."""
    columns = column_changes(base, head)
    entities = _joined(scan.entities(base), scan.entities(head), ["workspace", "id"])
    entities = entities.withColumn("indexes_added", F.array_sort(F.array_except(_index_signatures("head"), _index_signatures("base"))))
    entities = entities.withColumn("indexes_removed", F.array_sort(F.array_except(_index_signatures("base"), _index_signatures("head"))))
    kind = F.when((F.col("change") == "changed") & (F.col("base.kind") != F.col("head.kind")), F.concat("base.kind", F.lit(" -> "), "head.kind"))
    entities = entities.select("workspace", "id", F.coalesce(_qualified("head"), _qualified("base")).alias("__name"), "base", "head", "change", "indexes_added", "indexes_removed", kind.alias("kind_change"))
    name = F.when(F.col("head").isNotNull(), _qualified("head")).otherwise(_qualified("base"))
    entities = entities.select("workspace", "id", name.alias("name"), "change", "indexes_added", "indexes_removed", "kind_change")
    touched = columns.groupBy("workspace", F.col("entity_id").alias("id")).agg(F.count("*").alias("n_columns"))
    entities = entities.join(touched, ["workspace", "id"], "left").withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))
    entities = entities.where("change <> 'changed' OR n_columns > 0 OR size(indexes_added) > 0 OR size(indexes_removed) > 0 OR kind_change IS NOT NULL")
    of = entities.select("workspace", F.col("id").alias("entity_id"), F.col("change").alias("entity_change"))
    return ModelDiff(entities, columns.join(of, ["workspace", "entity_id"]), relation_changes(base, head), enum_changes(base, head))


def relation_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    key = F.concat(F.col("from"), F.lit("("), F.array_join(F.array_sort("from_columns"), ","), F.lit(")->"), F.col("to"))
    joined = _joined(*[scan.relations(m).withColumn("key", key) for m in (base, head)], ["workspace", "key"])
    columns = lambda s: F.concat(F.lit("("), F.array_join(f"{s}.to_columns", ", "), F.lit(")"))
    said = _said(
        _value("cardinality", "cardinality", "?"),
        (columns("base") != columns("head"), F.concat(F.lit("references: "), columns("base"), F.lit(" -> "), columns("head"))),
        _flag("optional", "now optional", "now required"),
        _value("on_delete", "on delete", "(none)", lower=True),
        _value("on_update", "on update", "(none)", lower=True),
    )
    changes = F.when(F.col("change") == "changed", said).otherwise(F.array().cast("array<string>"))
    rows = joined.select("workspace", "key", "change", F.coalesce("head.cardinality", "base.cardinality").alias("cardinality"), changes.alias("changes"))
    return rows.where("change <> 'changed' OR size(changes) > 0")


def enum_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    joined = _joined(scan.enums(base), scan.enums(head), ["workspace", "id"])
    none = F.array().cast("array<string>")
    old, new = (F.coalesce(f"{s}.values", none) for s in SIDES)
    rows = joined.select("workspace", "id", F.coalesce("head.name", "base.name").alias("name"), "change", F.array_except(new, old).alias("values_added"), F.array_except(old, new).alias("values_removed"))
    return rows.where("change <> 'changed' OR size(values_added) > 0 OR size(values_removed) > 0")


def ordered(changes: DataFrame, name: str = "name") -> DataFrame:
    """Added before changed before removed, then by name."""
    return changes.orderBy("workspace", change_order(F.col("change")), name)


MARKS = {"added": "+", "changed": "~", "removed": "-"}


def to_markdown(diff: ModelDiff, base: str = "base", head: str = "head") -> DataFrame:
    """A changelog for each workspace: ``workspace``, ``markdown``.

    Lines carry their place as a sort key and are joined for each workspace; a
    workspace's changelog is one document.
    """

    def line(df: DataFrame, part: int, name: Column, sub: Column, text: Column) -> DataFrame:
        place = F.struct(change_order(F.col("change")).alias("c"), F.lit(part).alias("p"), name.alias("n"), sub.alias("s"))
        return df.select("workspace", F.struct(place.alias("place"), text.alias("text")).alias("x"))

    mark = F.element_at(F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair]), F.col("change"))
    tail = F.when(F.size("changes") > 0, F.concat(F.lit(": "), F.array_join("changes", "; "))).otherwise("")
    e, zero = diff.entities, F.lit("")
    titles = F.concat(F.lit("#### "), "name", F.when(F.col("kind_change").isNotNull(), F.concat(F.lit(" ("), "kind_change", F.lit(")"))).otherwise(""))
    names = e.select("workspace", F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    columns = diff.columns.join(names, ["workspace", "entity_id"])
    type_ = F.when((F.col("change") != "changed") & (F.col("type") != ""), F.concat(F.lit(" `"), "type", F.lit("`"))).otherwise("")
    said = F.concat(F.lit("- "), mark, F.lit(" `"), "name", F.lit("`"), type_, tail)
    at_entity = columns.select("workspace", F.col("entity_change").alias("change"), "entity_name", "name", said.alias("said"))
    index = lambda c, sign: e.select("workspace", "change", "name", F.explode(c).alias("i")).transform(
        lambda d: line(d, 1, F.col("name"), F.concat(F.lit(f"~{sign}"), "i"), F.concat(F.lit(f"- {sign} index "), "i"))
    )
    listed = F.filter(F.array(F.when(F.size("values_added") > 0, F.concat(F.lit("+ "), F.array_join("values_added", ", "))), F.when(F.size("values_removed") > 0, F.concat(F.lit("- "), F.array_join("values_removed", ", ")))), lambda x: x.isNotNull())
    rows = line(e, 1, F.col("name"), zero, titles)
    for more in (
        line(at_entity, 1, F.col("entity_name"), F.concat(F.lit(" "), "name"), F.col("said")),
        index("indexes_added", "+"),
        index("indexes_removed", "-"),
        line(diff.relations, 3, F.col("key"), zero, F.concat(F.lit("- "), "key", F.lit(" ("), "cardinality", F.lit(")"), tail)),
        line(diff.enums, 5, F.col("name"), zero, F.concat(F.lit("- `"), "name", F.lit("`: "), F.array_join(listed, "; "))),
    ):
        rows = rows.unionByName(more)
    parts = {1: "### Tables", 3: "### Relations", 5: "### Enums"}
    firsts = rows.select("workspace", F.col("x.place.c").alias("c"), F.col("x.place.p").alias("p")).distinct()
    kinds = F.element_at(F.array(F.lit("## Added"), F.lit("## Changed"), F.lit("## Removed")), F.col("c") + 1)
    top = firsts.select("workspace", "c").distinct().select("workspace", F.struct(F.struct("c", F.lit(-1).alias("p"), F.lit("").alias("n"), F.lit("").alias("s")).alias("place"), kinds.alias("text")).alias("x"))
    titled = F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.col("p"))
    second = firsts.select("workspace", F.struct(F.struct("c", (F.col("p") - 1).alias("p"), F.lit("").alias("n"), F.lit("").alias("s")).alias("place"), titled.alias("text")).alias("x"))
    lines = rows.unionByName(top).unionByName(second).groupBy("workspace").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n").alias("body"))
    return lines.join(diff.summary_text(), "workspace").select(
        "workspace", F.concat(F.lit(f"# Schema changes: {base} -> {head}\n\n**"), "summary", F.lit("**\n\n"), "body", F.lit("\n")).alias("markdown")
    )
