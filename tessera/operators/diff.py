"""Keyed and set differences between two states of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = {"added": 0, "changed": 1, "removed": 2}


def last_by_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, the last in ``order``; the rows are combined before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def keyed_diff(base: DataFrame, head: DataFrame, keys: list[str], compared: list[str], *, absent: dict[str, object] | None = None) -> DataFrame:
    """``keys``, ``change`` (added, removed, changed) and ``attributes``, the names that differ, by one full outer join.

    Nulls are equal to each other, and to ``absent[column]`` where that is given.
    """
    absent = absent or {}

    def state(df: DataFrame, side: str) -> DataFrame:
        value = lambda c: F.coalesce(F.col(c), F.lit(absent[c])) if c in absent else F.col(c)
        return df.select(*keys, F.struct(F.lit(1).alias("__there"), *[value(c).alias(c) for c in compared]).alias(side))

    joined = state(base, "base").join(state(head, "head"), keys, "full_outer")
    differs = [F.when(~F.col(f"base.{c}").eqNullSafe(F.col(f"head.{c}")), F.lit(c)) for c in compared]
    change = F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "removed").when(F.size("attributes") > 0, "changed")
    both = F.col("base").isNotNull() & F.col("head").isNotNull()
    attributes = F.when(both, F.filter(F.array(*differs), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("attributes", attributes).withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", "attributes", "base", "head")


def diff_summary(changes: DataFrame) -> DataFrame:
    """Counts for each kind of change."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def change_order(change: Column) -> Column:
    out = F.lit(len(ORDER))
    for name, rank in ORDER.items():
        out = F.when(change == name, rank).otherwise(out)
    return out


def set_diff(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """Values that a key has on one side only: ``key``, ``value``, ``change``."""
    pairs = [df.select(key, value).distinct() for df in (base, head)]
    removed = pairs[0].join(pairs[1], [key, value], "left_anti").withColumn("change", F.lit("removed"))
    added = pairs[1].join(pairs[0], [key, value], "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(removed)


def signature(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Rows of each key and a sum of their hashes, whatever their order: equal tables have equal ones.

    Sixty bits of each row's MD5 are added up, so that nothing is gathered.
    """
    row = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
    number = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(number).cast("string").alias("signature"))
