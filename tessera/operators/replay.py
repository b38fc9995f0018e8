"""Replay of ordered change events without renames, by windows.

A drop ends an epoch.  An entity's state is made of the events since its last
drop: each attribute has the last value that was set, and it exists if an event
created it.  Epochs are running counts, so the fold needs no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(events: DataFrame, key: str, order: list[str], *, creates: Column, drops: Column, attributes: dict[str, Column]) -> DataFrame:
    """Entities that exist at the end: ``key``, ``n_changes`` and each attribute's last value."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = events.withColumn("__epoch", F.sum(F.when(drops, 1).otherwise(0)).over(so_far)).withColumn("__creates", creates).withColumn("__drops", drops)
    last_epoch = F.max("__epoch").over(Window.partitionBy(key))
    alive = marked.withColumn("__last", last_epoch).where("__epoch = __last AND NOT __drops")
    for name, value in attributes.items():
        alive = alive.withColumn(f"__v_{name}", value)
    step = F.struct(*order)
    aggregates = [F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), step)).alias(n) for n in attributes]
    state = alive.groupBy(key).agg(F.max(F.col("__creates").cast("int")).alias("__made"), F.count("*").alias("n_changes"), *aggregates)
    return state.where("__made = 1").drop("__made")


def bursts(events: DataFrame, key: str, ts: str, tie: str, gap: str) -> DataFrame:
    """Trailing edges: the last event of every run whose gaps stay within ``gap``, with the size of the run."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    before = F.lag(ts).over(order)
    started = events.withColumn("__new", F.when(before.isNull() | (F.col(ts) > before + F.expr(f"INTERVAL {gap}")), 1).otherwise(0))
    numbered = started.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "__run").agg(F.max(ts).alias("last_ts"), F.count("*").alias("n_events")).drop("__run")
