"""The metadata model: raw records that parsers emit, and the resolved schema.

Records are plain dataclasses; ``as_dict`` leaves out what is absent, so their
JSON has no nulls.  Lines count from zero.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

# Technologies in order of priority (sources of definitions), and engines by category.
KINDS = (
    "sql", "dbml", "diesel", "liquibase", "prisma", "typeorm", "mikroorm", "drizzle", "sequelize", "mongoose", "knex", "kysely",
    "django", "sqlalchemy", "sqlmodel", "peewee", "tortoise", "rails", "laravel", "doctrine", "ecto", "gorm", "ent", "bun",
    "seaorm", "jpa", "exposed", "efcore", "hibernate", "doctrinemap", "graphql", "zenstack", "mongovalidator",
)
DDL_KINDS = ("sql", "dbml", "diesel")
DEFAULT_SCHEMAS = ("public", "dbo", "main")
#: ORMs that create the foreign key columns of an association themselves.
AUTO_FK_KINDS = ("typeorm", "mikroorm", "sequelize", "jpa", "efcore", "doctrine", "django", "peewee", "tortoise", "ent", "doctrinemap")


@dataclass
class Source:
    file: str
    line: int = 0


@dataclass
class Column:
    name: str
    type: str = ""
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    generated: bool | None = None
    default: str | None = None
    comment: str | None = None
    is_array: bool | None = None
    enum_ref: str | None = None
    source: Source | None = None
    references: dict[str, Any] | None = None
    implied: bool | None = None
    provenance: dict[str, Any] | None = None


@dataclass
class Index:
    columns: list[str]
    unique: bool = False
    name: str | None = None


@dataclass
class Ref:
    """A table by name, by model, or both."""

    name: str | None = None
    model: str | None = None
    schema: str | None = None

    def label(self) -> str:
        return self.name or self.model or "?"


@dataclass
class RawEntity:
    name: str
    kind: str = "table"
    columns: list[Column] = field(default_factory=list)
    schema: str | None = None
    model_name: str | None = None
    name_certainty: int = 2
    partial: bool = False
    abstract: bool = False
    shared_table: bool = False
    candidate: bool = False
    extends: list[str] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    engine: str | None = None
    group: str | None = None
    comment: str | None = None
    source: Source | None = None


@dataclass
class RawRelation:
    from_: Ref
    to: Ref
    from_columns: list[str] = field(default_factory=list)
    to_columns: list[str] = field(default_factory=list)
    cardinality: str = "many-to-one"
    kind: str = "foreign-key"
    name: str | None = None
    on_delete: str | None = None
    on_update: str | None = None
    through: Ref | None = None
    optional: bool | None = None
    owned: bool = False
    navigation: str | None = None
    source: Source | None = None


@dataclass
class RawEnum:
    name: str
    values: list[str]
    schema: str | None = None
    partial: bool = False
    source: Source | None = None


@dataclass
class Op:
    """A change: dropTable, renameTable, dropColumn, renameColumn, alterColumn, dropForeignKey, dropEnum, renameEnum."""

    op: str
    table: Ref | None = None
    column: str | None = None
    to: str | None = None
    set: dict[str, Any] = field(default_factory=dict)
    name: str | None = None
    schema: str | None = None
    columns: list[str] = field(default_factory=list)
    target: Ref | None = None
    source: Source | None = None


@dataclass
class Hint:
    engine: str
    line: int
    detail: str


@dataclass
class Parsed:
    """What one parser read in one file."""

    file: str
    kind: str
    origin: str = "definition"
    entities: list[RawEntity] = field(default_factory=list)
    relations: list[RawRelation] = field(default_factory=list)
    enums: list[RawEnum] = field(default_factory=list)
    ops: list[Op] = field(default_factory=list)
    engines: list[Hint] = field(default_factory=list)
    warnings: list[tuple[int | None, str]] = field(default_factory=list)
    revision: str | None = None
    after: list[str] = field(default_factory=list)

    def empty(self) -> bool:
        return not (self.entities or self.relations or self.enums or self.ops or self.engines or self.warnings)


def as_dict(record: Any) -> Any:
    """Dataclasses as dictionaries, absent values left out."""
    if dataclasses.is_dataclass(record):
        return {f.name.rstrip("_"): as_dict(v) for f in dataclasses.fields(record) if (v := getattr(record, f.name)) is not None}
    if isinstance(record, (list, tuple)):
        return [as_dict(x) for x in record]
    if isinstance(record, dict):
        return {k: as_dict(v) for k, v in record.items()}
    return record


def normal_schema(schema: str | None) -> str | None:
    text = (schema or "").strip()
    return None if not text or text.lower() in DEFAULT_SCHEMAS else text


def entity_id(kind: str, schema: str | None, name: str) -> str:
    schema = normal_schema(schema)
    return ("doc:" if kind == "collection" else "") + (f"{schema}.{name}" if schema else name).lower()


def enum_id(schema: str | None, name: str) -> str:
    return entity_id("table", schema, name)
