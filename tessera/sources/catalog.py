"""Catalogs of live databases over JDBC, and of Spark itself, as the rows that ``introspect`` reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTGRESQL_COLUMNS = """
SELECT c.table_schema AS "schema", c.table_name AS "table", c.column_name AS name, c.udt_name AS type, c.is_nullable AS nullable,
       c.column_default AS "default", c.ordinal_position AS position, t.table_type
FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name
WHERE c.table_schema NOT IN ('pg_catalog', 'information_schema')
"""
POSTGRESQL_CONSTRAINTS = """
SELECT n.nspname AS "schema", r.relname AS "table", k.conname AS name, k.contype::text AS type, a.attname AS "column", u.ord AS position,
       fn.nspname AS ref_schema, fr.relname AS ref_table, fa.attname AS ref_column
FROM pg_constraint k JOIN pg_class r ON r.oid = k.conrelid JOIN pg_namespace n ON n.oid = r.relnamespace
CROSS JOIN LATERAL unnest(k.conkey) WITH ORDINALITY AS u(attnum, ord) JOIN pg_attribute a ON a.attrelid = r.oid AND a.attnum = u.attnum
LEFT JOIN pg_class fr ON fr.oid = k.confrelid LEFT JOIN pg_namespace fn ON fn.oid = fr.relnamespace
LEFT JOIN pg_attribute fa ON fa.attrelid = k.confrelid AND fa.attnum = k.confkey[u.ord]
WHERE k.contype IN ('p', 'u', 'f') AND n.nspname NOT IN ('pg_catalog', 'information_schema')
"""
MYSQL_COLUMNS = """
SELECT c.TABLE_SCHEMA AS `schema`, c.TABLE_NAME AS `table`, c.COLUMN_NAME AS name, c.COLUMN_TYPE AS type, c.IS_NULLABLE AS nullable,
       c.COLUMN_DEFAULT AS `default`, c.ORDINAL_POSITION AS position, t.TABLE_TYPE AS table_type
FROM information_schema.COLUMNS c JOIN information_schema.TABLES t ON t.TABLE_SCHEMA = c.TABLE_SCHEMA AND t.TABLE_NAME = c.TABLE_NAME
WHERE c.TABLE_SCHEMA = DATABASE()
"""
MYSQL_CONSTRAINTS = """
SELECT k.TABLE_SCHEMA AS `schema`, k.TABLE_NAME AS `table`, k.CONSTRAINT_NAME AS name, t.CONSTRAINT_TYPE AS type, k.COLUMN_NAME AS `column`,
       k.ORDINAL_POSITION AS position, k.REFERENCED_TABLE_SCHEMA AS ref_schema, k.REFERENCED_TABLE_NAME AS ref_table, k.REFERENCED_COLUMN_NAME AS ref_column
FROM information_schema.KEY_COLUMN_USAGE k JOIN information_schema.TABLE_CONSTRAINTS t
  ON t.CONSTRAINT_SCHEMA = k.CONSTRAINT_SCHEMA AND t.CONSTRAINT_NAME = k.CONSTRAINT_NAME AND t.TABLE_NAME = k.TABLE_NAME
WHERE k.TABLE_SCHEMA = DATABASE() AND t.CONSTRAINT_TYPE IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')
"""
QUERIES = {"postgresql": (POSTGRESQL_COLUMNS, POSTGRESQL_CONSTRAINTS), "mysql": (MYSQL_COLUMNS, MYSQL_CONSTRAINTS)}


def read_catalog(spark: SparkSession, engine: str, url: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """Column and constraint rows of a live database; the driver's jar must be on the class path."""
    read = lambda sql: spark.read.format("jdbc").options(url=url, query=sql.strip(), **options).load()
    return tuple(read(sql) for sql in QUERIES[engine])


def without_database(rows: DataFrame, database: str) -> DataFrame:
    """Rows with one schema taken as the default one, so that ids are those of the code."""
    own = lambda c: F.when(F.lower(c) != database.lower(), F.col(c))
    return rows.withColumns({c: own(c) for c in ("schema", "ref_schema") if c in rows.columns})


def spark_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Column rows of Spark's own catalog; the listing is the driver's, it is as long as the catalog."""
    rows = []
    for table in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(table.name, database) if not table.isTemporary else spark.catalog.listColumns(table.name), 1):
            rows.append((table.database, table.name, c.name, c.dataType, "YES" if c.nullable else "NO", None, i, table.tableType))
    return spark.createDataFrame(rows, "schema string, table string, name string, type string, nullable string, default string, position int, table_type string")
