"""Scanning workspaces: files in, parsed records, resolved models out.

Files are routed by native predicates on path and size before their content
meets Python, parsed one by one in Arrow batches, and only what was parsed is
grouped by workspace: the text of files never moves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache, reduce
from typing import Any, get_args, get_origin, get_type_hints

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import model
from tessera.model import Parsed, as_dict
from tessera.operators import assemble, linking
from tessera.operators.resolve import settle
from tessera.parsers import engines, parse_file
from tessera.session import cut
from tessera.sources.globs import glob_regex

MOST_WARNINGS = 500

# Engines with label and category, and labels of technologies.
ENGINES = {
    "postgresql": ("PostgreSQL", "relational"), "mysql": ("MySQL", "relational"), "mariadb": ("MariaDB", "relational"), "sqlite": ("SQLite", "relational"),
    "sqlserver": ("SQL Server", "relational"), "oracle": ("Oracle", "relational"), "cockroachdb": ("CockroachDB", "relational"), "h2": ("H2", "relational"),
    "mongodb": ("MongoDB", "document"), "firestore": ("Firestore", "document"), "cosmosdb": ("Cosmos DB", "document"),
    "dynamodb": ("DynamoDB", "key-value"), "redis": ("Redis", "key-value"), "cassandra": ("Cassandra", "wide-column"),
    "neo4j": ("Neo4j", "graph"), "elasticsearch": ("Elasticsearch", "search"),
    "clickhouse": ("ClickHouse", "analytical"), "duckdb": ("DuckDB", "analytical"), "snowflake": ("Snowflake", "analytical"), "bigquery": ("BigQuery", "analytical"),
}
PARSED = "workspace string, path string, kind string, parsed string"
MODEL = "workspace string, part string, seq int, id string, record string"


@cache
def _decoder(kind: Any) -> Callable[[Any], Any]:
    """A function that gives a value of a type of ``tessera.model`` back from its dictionary; made once for each type."""
    args = [a for a in get_args(kind) if a is not type(None)]
    if get_origin(kind) is list:
        one = _decoder(args[0])
        return lambda value: None if value is None else [one(x) for x in value]
    if get_origin(kind) is not None and args and isinstance(kind, type(int | None)):
        return _decoder(args[0])
    if hasattr(kind, "__dataclass_fields__"):
        hints = get_type_hints(kind, vars(model))
        fields = [(n, n.rstrip("_"), _decoder(hints[n])) for n in kind.__dataclass_fields__]
        return lambda value: None if value is None else kind(**{n: read(value[key]) for n, key, read in fields if key in value})
    return lambda value: value


def decode(kind: Any, value: Any) -> Any:
    """A dataclass of ``tessera.model`` back from its dictionary."""
    return _decoder(kind)(value)


def parse_files(files: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Records of every reader that claims a file of (workspace, path, text): one row for file and reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"workspace": [], "path": [], "kind": [], "parsed": []}
            for workspace, path, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for parsed in parse_file(path or "", text or "", disabled):
                    for key, value in zip(rows, (workspace, path, parsed.kind, json.dumps(as_dict(parsed)))):
                        rows[key].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.string()) for k in rows]))

    return files.select("workspace", "path", "text").mapInArrow(run, PARSED)


ENTITY = (
    "id string, name string, schema string, kind string, model_names array<string>, sources array<string>, files array<string>, engine string, `group` string, comment string, "
    f"external boolean, join_table boolean, source {linking.SOURCE}, columns {linking.COLUMNS}, indexes array<struct<name:string,columns:array<string>,unique:boolean>>, "
    f"provenance {linking.PROVENANCE}"
)
RELATION = (
    "id string, `from` string, from_columns array<string>, `to` string, to_columns array<string>, cardinality string, kind string, optional boolean, name string, on_delete string, "
    f"on_update string, through string, through_name string, sources array<string>, source {linking.SOURCE}, provenance {linking.PROVENANCE}"
)
ENUM = "id string, name string, schema string, values array<string>, sources array<string>"


def settled(parsed: DataFrame) -> DataFrame:
    """What each workspace's declarations come to before links are weighed: rows (workspace, part, seq, record).

    A workspace is replayed in one task, since migrations rename and drop what
    others made; its records are orders of magnitude smaller than its files,
    of which a scan has ``MOST_FILES`` at most.  Workspaces are dealt to as many
    tasks as the session shuffles, however small their records are.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        records = [decode(Parsed, json.loads(p)) for p in group.sort_values(["path", "kind"], kind="stable").parsed]
        out = settle([p for p in records if p.kind != "engines"])
        own = [{"file": p.file, "line": line, "message": message} for p in records for line, message in p.warnings]
        out["warnings"] = [{k: v for k, v in w.items() if v is not None} for w in own] + out["warnings"]
        out["hints"] = [{"engine": h.engine, "file": p.file, "line": h.line, "detail": h.detail} for p in records for h in p.engines if h.engine in ENGINES]
        out["kinds"] = [{"kind": p.kind, "file": p.file} for p in records if p.entities or p.relations or p.enums or p.ops]
        rows = [(group.workspace.iloc[0], part, i, json.dumps(r)) for part, some in out.items() for i, r in enumerate(some)]
        return pd.DataFrame(rows, columns=["workspace", "part", "seq", "record"])

    # A number that is asked for is kept by adaptive execution, which would put small groups into one task.
    tasks = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parsed.repartition(tasks, "workspace").groupBy("workspace").applyInPandas(run, "workspace string, part string, seq long, record string")


def build_models(parsed: DataFrame, infer_relations: bool = True) -> DataFrame:
    """Models of all workspaces as rows (workspace, part, seq, id, record): entities, relations, enums, engines, sources, warnings."""
    rows = cut(settled(parsed), "settled")
    tables = part(rows, "tables", linking.TABLE)
    links = part(rows, "links", linking.LINK)
    links = cut(linking.without_doubles(linking.with_columns(links, tables), tables), "links")
    links, dead = linking.living(links, tables)
    tables = cut(linking.implied_columns(links, tables), "tables")
    links = linking.finished(links, tables)
    if infer_relations:
        known = linking.referenced(links, tables)
        more = linking.inferred(links.drop("optional"), known)
        links = cut(links.unionByName(linking.finished(more, tables)), "links")
    tables = linking.referenced(links, tables)
    links, tables = linking.junctions(links, tables)
    links, tables = cut(links, "links"), cut(tables, "tables")
    found = assemble.entities(tables, links)
    engines = assemble.engines(part(rows, "hints", "engine string, file string, line int, detail string"), found, ENGINES)
    found, engines = cut(found, "entities"), cut(engines, "engines")
    parts = {
        "entities": assemble.with_engines(found, engines),
        "relations": assemble.relations(links, found),
        "enums": assemble.enums(part(rows, "enums", f"{ENUM}, source {linking.SOURCE}")),
        "engines": engines,
        "sources": assemble.sources(part(rows, "kinds", "kind string, file string"), found),
        "warnings": assemble.warnings(part(rows, "warnings", "file string, line int, message string"), dead, MOST_WARNINGS),
    }
    return reduce(DataFrame.unionByName, [assemble.as_rows(df, name) for name, df in parts.items()])


def collected(models: DataFrame, workspace: str | None = None) -> dict[str, list[dict]]:
    """One workspace's model on the driver: a list of records for each part."""
    rows = models if workspace is None else models.where(F.col("workspace") == workspace)
    out: dict[str, list[dict]] = {name: [] for name in ("entities", "relations", "enums", "engines", "sources", "warnings")}
    for row in sorted(rows.select("part", "seq", "record").collect()):
        out[row.part].append(json.loads(row.record))
    return out


def part(models: DataFrame, name: str, schema: str) -> DataFrame:
    """One part of the models as columns."""
    rows = models.where(F.col("part") == name).select("workspace", "seq", F.from_json("record", schema).alias("r"))
    return rows.select("workspace", "seq", "r.*")


def entities(models: DataFrame) -> DataFrame:
    return part(models, "entities", ENTITY)


def columns(models: DataFrame) -> DataFrame:
    """One row for each column of each entity."""
    each = entities(models).select("workspace", F.col("id").alias("entity_id"), F.posexplode("columns").alias("pos", "c"))
    return each.select("workspace", "entity_id", "pos", "c.*")


def relations(models: DataFrame) -> DataFrame:
    return part(models, "relations", RELATION)


def enums(models: DataFrame) -> DataFrame:
    return part(models, "enums", ENUM)


# Extensions that readers claim outright, and the paths of mappings among documents of many kinds.
EXTENSIONS = (
    "sql", "ddl", "cql", "dbml", "prisma", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "py", "rb", "php", "ex", "exs", "go", "rs", "java", "kt", "cs",
    "graphql", "gql", "graphqls", "zmodel",
)
MAPPINGS = (
    "**/*changelog*.{xml,yaml,yml,json}", "**/db/changelog/**/*.{xml,yaml,yml,json}", "**/liquibase/**/*.{xml,yaml,yml,json}", "**/*.hbm.xml",
    "**/*.dcm.{xml,yml,yaml}", "**/*.orm.{xml,yml,yaml}", "**/doctrine/**/*.{xml,yml,yaml}",
)


def include_regex() -> str:
    """Paths that any reader may claim, for a predicate before content is read."""
    names = "|".join(pattern for pattern, _ in engines.FILES)
    mappings = glob_regex(list(MAPPINGS)).removeprefix("(?i)")
    return rf"(?i)(?:\.(?:{'|'.join(EXTENSIONS)})$|(?:^|/)(?:{names})$|{mappings})"


def claimed(path: str) -> bool:
    return bool(re.search(include_regex(), path))
