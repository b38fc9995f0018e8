"""Cascading lookups as one equi-join over ranked candidate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prioritized_lookup(refs: DataFrame, ref_key: str, candidates: list[Column], targets: DataFrame, target_keys: list[Column], order: list[Column]) -> DataFrame:
    """Each reference with its best target, null if there is none.

    ``candidates`` are the keys that a reference tries in turn, ``target_keys``
    the keys under which a target is found for the candidate of the same place.
    Keys are exploded with their rank and joined by equality: an OR of
    conditions would be a nested loop.
    """
    tried = refs.select("*", F.posexplode(F.array(*candidates)).alias("__rank", "__key")).where("__key IS NOT NULL")
    found = targets.select(F.struct("*").alias("__target"), F.posexplode(F.array(*target_keys)).alias("__rank", "__key")).where("__key IS NOT NULL")
    hits = tried.join(found, ["__rank", "__key"])
    ranked = hits.groupBy(ref_key).agg(F.min_by(F.struct("__target", "__rank"), F.struct("__rank", *order)).alias("__hit"))
    return refs.join(ranked, ref_key, "left").select(*refs.columns, F.col("__hit.__target").alias("target"), F.col("__hit.__rank").alias("rank"))


def placeholders(refs: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Targets and, for keys that only references know, placeholder rows: ``target_key`` and ``external``."""
    known = targets.select(target_key).withColumn("external", F.lit(False))
    missing = refs.select(F.col(key).alias(target_key)).where(F.col(target_key).isNotNull()).distinct().join(targets.select(target_key), target_key, "left_anti")
    return known.unionByName(missing.withColumn("external", F.lit(True)))


def cardinality(df: DataFrame, column: str) -> DataFrame:
    """What a foreign key column is like: rows, distinct values, nulls, one-to-one and optional."""
    counts = df.agg(F.count("*").alias("n_rows"), F.countDistinct(column).alias("n_distinct"), F.count_if(F.col(column).isNull()).alias("n_null"))
    return counts.withColumn("one_to_one", F.col("n_rows") == F.col("n_distinct") + F.col("n_null")).withColumn("optional", F.col("n_null") > 0)


def inclusion(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """How many distinct non-null child values have no parent."""
    values = child.select(F.col(child_column).alias("__v")).where("__v IS NOT NULL").distinct()
    missing = values.join(parent.select(F.col(parent_column).alias("__v")), "__v", "left_anti")
    return missing.agg(F.count("*").alias("n_missing"))
