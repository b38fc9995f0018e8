"""Priority merges: first and last values by an explicit order, never by arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each group that comes first in ``order``."""
    return _pick(df, keys, F.min_by, order)


def last_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each group that comes last in ``order``."""
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: list[str], by, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def best_per_group(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The row of each group with the greatest ``score``, a struct that breaks ties."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), score).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def adopt_best(df: DataFrame, keys: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """Every row with the values of the best row of its group: ``columns`` names source and target."""
    best = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({target: F.first(source).over(best) for source, target in columns.items()})


def fill_missing(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer join in which the left side's values win and the right side's fill gaps."""
    a, b = (df.select(*keys, F.struct(*columns).alias(side)) for df, side in ((left, "__l"), (right, "__r")))
    return a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(f"__l.{c}", f"__r.{c}").alias(c) for c in columns])


def scalar_fill(df: DataFrame, column: str, only: DataFrame) -> DataFrame:
    """Nulls of ``column`` filled with the value of ``only`` (one column) if that has exactly one."""
    name = only.columns[0]
    value = only.agg(F.when(F.countDistinct(name) == 1, F.max(name)).alias("__only"))
    return df.crossJoin(F.broadcast(value)).withColumn(column, F.coalesce(column, "__only")).drop("__only")


def prefer(df: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """Rows without ``wanted`` go where their group has one with it; groups are counted before they are joined, so a large one is split."""
    some = df.where(wanted).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__some", F.lit(True))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(some, same, "left").where(F.col("__some").isNull() | wanted).select(*df.columns)


def dedupe_symmetric(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected pairs once, without loops."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def sanitize_names(df: DataFrame, name: str, order: list[str], most: int) -> DataFrame:
    """Names that differ beyond case, the first spelling of each, the first ``most`` in order."""
    first = df.withColumn("__key", F.lower(name)).where(F.length(F.trim(name)) > 0)
    first = _pick(first.select("__key", name, *[c for c in order if c != name]), ["__key"], F.min_by, [*order])
    return first.orderBy(*order).limit(most).drop("__key")
