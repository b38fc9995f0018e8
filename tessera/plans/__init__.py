"""All queries of the library over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import changes, models, names, outputs, readers, registry, schemas, shapes, strings  # noqa: F401 - they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.SQL
