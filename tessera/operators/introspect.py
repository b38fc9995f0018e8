"""Models from catalog rows, as joins and aggregates.

``columns``: schema, table, name, type, nullable, default, position, table_type;
``constraints``: schema, table, name, type, column, position, ref_schema,
ref_table, ref_column.  Results have the parts of ``scan.build_models``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import DEFAULT_SCHEMAS

KINDS = {"P": "primary", "PRIMARY KEY": "primary", "U": "unique", "UNIQUE": "unique", "F": "foreign", "FOREIGN KEY": "foreign"}


def entity_id(schema: Column, table: Column) -> Column:
    bare = schema.isNull() | (F.trim(schema) == "") | F.lower(F.trim(schema)).isin(*DEFAULT_SCHEMAS)
    return F.lower(F.when(bare, table).otherwise(F.concat(F.trim(schema), F.lit("."), table)))


def _constraints(rows: DataFrame) -> DataFrame:
    """One row for each constraint, its columns in order."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.upper(F.trim("type")))
    member = F.struct("position", "column", "ref_column", "ref_schema", "ref_table")
    grouped = rows.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("schema", "table", F.col("name").alias("constraint")).agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(member)).alias("m"))
    names = F.transform("m", lambda x: x["column"])
    return grouped.select("schema", "table", "constraint", "kind", names.alias("names"), F.transform("m", lambda x: x["ref_column"]).alias("ref_names"), F.col("m")[0]["ref_schema"].alias("ref_schema"), F.col("m")[0]["ref_table"].alias("ref_table"))


def catalog_columns(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Columns with keys, uniqueness and references."""
    each = _constraints(constraints).select("schema", "table", "kind", F.size("names").alias("n"), F.posexplode("names").alias("i", "name"), "ref_schema", "ref_table", "ref_names")
    single = F.col("n") == 1
    flags = each.groupBy("schema", "table", "name").agg(
        F.bool_or(F.col("kind") == "primary").alias("primary_key"),
        F.bool_or(single & F.col("kind").isin("primary", "unique")).alias("unique"),
        F.max(F.when(single & (F.col("kind") == "foreign"), F.struct(entity_id(F.coalesce("ref_schema", "schema"), F.col("ref_table")).alias("entity"), F.col("ref_names")[0].alias("column")))).alias("references"),
    )
    nullable = F.upper(F.trim(F.col("nullable").cast("string"))).isin("NO", "FALSE")
    base = columns.select("schema", "table", "name", "position", F.lower("type").alias("type"), (~nullable).alias("nullable"), "default", "table_type")
    joined = base.join(flags, ["schema", "table", "name"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("primary_key", "unique")})


def catalog_entities(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Tables and views with their columns in order and their unique indexes."""
    column = F.struct("position", "name", "type", "nullable", "primary_key", "unique", "default", "references")
    rows = catalog_columns(columns, constraints)
    grouped = rows.groupBy("schema", "table").agg(F.max("table_type").alias("table_type"), F.collect_list(column).alias("columns"))
    in_order = F.array_sort("columns", lambda a, b: a["position"] - b["position"])
    unique = _constraints(constraints).where("kind = 'unique'").groupBy("schema", "table").agg(F.array_sort(F.collect_list(F.struct(F.col("constraint").alias("name"), F.col("names").alias("columns")))).alias("indexes"))
    kind = F.when(F.upper("table_type").contains("VIEW"), "view").otherwise("table")
    joined = grouped.join(unique, ["schema", "table"], "left")
    return joined.select(entity_id(F.col("schema"), F.col("table")).alias("id"), F.col("table").alias("name"), "schema", kind.alias("kind"), in_order.alias("columns"), F.coalesce("indexes", F.array().cast("array<struct<name:string,columns:array<string>>>")).alias("indexes"))


def catalog_relations(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Foreign keys; one-to-one if their only column is unique, optional if any column is nullable."""
    foreign = _constraints(constraints).where("kind = 'foreign' AND ref_table IS NOT NULL")
    known = catalog_columns(columns, constraints).select("schema", "table", "name", "nullable", "unique")
    each = foreign.select("*", F.explode("names").alias("name")).join(known, ["schema", "table", "name"], "left")
    facts = each.groupBy("schema", "table", "constraint").agg(F.bool_or(F.coalesce("nullable", F.lit(True))).alias("optional"), F.bool_or(F.coalesce("unique", F.lit(False))).alias("unique"))
    tables = columns.select("schema", "table").distinct()
    joined = foreign.join(facts, ["schema", "table", "constraint"]).join(tables, ["schema", "table"], "left_semi")
    from_, to = entity_id(F.col("schema"), F.col("table")), entity_id(F.coalesce("ref_schema", "schema"), F.col("ref_table"))
    return joined.select(
        F.concat(from_, F.lit("("), F.lower(F.array_join("names", ",")), F.lit(")>"), to).alias("id"), from_.alias("from"), F.col("names").alias("from_columns"), to.alias("to"), F.col("ref_names").alias("to_columns"),
        F.when((F.size("names") == 1) & F.col("unique"), "one-to-one").otherwise("many-to-one").alias("cardinality"), F.lit("foreign-key").alias("kind"), "optional", F.col("constraint").alias("name"),
    )
