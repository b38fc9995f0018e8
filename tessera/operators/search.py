"""Ranked fuzzy search over names, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores of the tiers.
EXACT, PREFIX, BOUNDARY, SUBSTRING, SCATTERED = 1000.0, 700.0, 560.0, 420.0, 240.0
COLUMN_PENALTY, LENGTH_PENALTY, RANGE_PENALTY = 50.0, 0.3, 4.0
LIMIT = 200


def _scattered(label: Column, query: str) -> Column:
    """Start, span and number of runs of the query's letters, taken greedily from the left; null if they don't come in order."""
    state = F.struct(F.lit(0).alias("next"), F.lit(-1).alias("first"), F.lit(-2).alias("last"), F.lit(0).alias("runs"))
    letters = F.array(*[F.lit(c) for c in query])

    def step(s: Column, letter: Column) -> Column:
        at = F.when(s["next"] < 0, 0).otherwise(F.call_function("locate", letter, label, s["next"] + 1))
        found = at > 0
        return F.struct(
            F.when(found, at).otherwise(-1).alias("next"),
            F.when(found & (s["first"] < 0), at - 1).otherwise(s["first"]).alias("first"),
            F.when(found, at - 1).otherwise(s["last"]).alias("last"),
            (s["runs"] + F.when(found & (at - 1 != s["last"] + 1), 1).otherwise(0)).alias("runs"),
        )

    return F.aggregate(letters, state, step)


def score(label: Column, query: str) -> Column:
    """Score of a label, null where nothing matches."""
    q = query.lower()
    low = F.lower(label)
    at = F.instr(low, q) - 1
    boundary = F.substr(low, at, F.lit(1)).rlike("[^a-z0-9]")
    gap = F.greatest(F.length(label) - len(q), F.lit(0)) * LENGTH_PENALTY
    scattered = _scattered(low, q)
    span = scattered["last"] - scattered["first"] + 1
    out = F.when(low == q, F.lit(EXACT)).when(at == 0, F.lit(PREFIX)).when((at > 0) & boundary, BOUNDARY - at).when(at > 0, SUBSTRING - at)
    out = out.when(scattered["next"] > 0, SCATTERED - span - RANGE_PENALTY * scattered["runs"] - scattered["first"])
    return out - gap


def search(items: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Items (label, kind) that match, best first: score, then length, then label."""
    penalty = F.when(F.col("kind") == "column", COLUMN_PENALTY).otherwise(0.0)
    hits = items.withColumn("score", score(F.col("label"), query) - penalty).where("score IS NOT NULL")
    return hits.orderBy(F.desc("score"), F.length("label"), "label").limit(limit)


def matched(hits: DataFrame, entity: str = "entity") -> DataFrame:
    """Entities that have a hit, once each, in the order of their best: (entity, place).  Hits are as few as ``search`` gives."""
    best = hits.groupBy(entity).agg(F.min(F.struct((-F.col("score")).alias("score"), F.length("label").alias("length"), "label")).alias("best"))
    return best.select(entity, F.row_number().over(Window.orderBy("best")).alias("place"))
