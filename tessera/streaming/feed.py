"""Live metadata: quiet-time triggers, incremental scans and stateful replay over change events."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import children, cut, remove

T = TypeVar("T")

#: Quiet time after events on files, settings and folders, in milliseconds.
QUIET_MS = {"files": 1000, "settings": 400, "folders": 300}


def bursts(events: DataFrame, key: str, ts: str = "ts", gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Runs of events whose gaps stay below ``gap``: one row when a run closes at the watermark."""
    session = F.session_window(F.col(ts), gap)
    grouped = events.withWatermark(ts, late).groupBy(session.alias("w"), key)
    return grouped.agg(F.count("*").alias("n_events"), F.max(ts).alias("last_ts")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "last_ts", "n_events")


REPLAYED = "key string, attributes string, n_changes long, alive boolean"
_STATE = "attributes string, n_changes long, alive boolean"


def replay_stream(changes: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """State of each key after changes (key, seq, op, name, value): create, set, unset, rename, drop.

    A key's state is its attributes and a count; a batch is folded in the order
    of ``seq``.  Updates are emitted whenever a key changes.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attributes, n, alive = ({}, 0, False) if not state.exists else (json.loads(state.get[0]), *state.get[1:])
        for row in pd.concat(batches).sort_values("seq", kind="stable").itertuples():
            n += 1
            if row.op == "create":
                alive = True
            elif row.op == "drop":
                attributes, alive = {}, False
            elif row.op == "set":
                attributes[row.name_] = row.value
            elif row.op == "unset":
                attributes.pop(row.name_, None)
            elif row.op == "rename" and row.name_ in attributes:
                attributes[row.value] = attributes.pop(row.name_)
        state.update((json.dumps(attributes, sort_keys=True), n, alive))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"key": [key[0]], "attributes": [json.dumps(attributes, sort_keys=True)], "n_changes": [n], "alive": [alive]})

    rows = changes.select("key", "seq", "op", F.col("name").alias("name_"), "value")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(fold, REPLAYED, _STATE, "update", timeout)


class Rescan:
    """A ``foreachBatch`` sink: rebuilds what changed workspaces say, and publishes a result only if it differs.

    ``load`` reads the files of some workspaces (a one-column frame), ``build``
    makes the result, ``publish`` gets the rows whose signature is new and the
    batch's number.  Signatures lie in one folder for each batch.  A batch that is
    run again after a failure compares with earlier batches alone, so it
    publishes the same rows under the same number: a publisher that overwrites
    what it wrote under a number, as ``to_folder`` does, publishes nothing twice.
    Every ``every`` batches the folder of a batch has all signatures, and those
    before the last such folder but one go.
    """

    def __init__(self, load: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], None], signatures: str, every: int = 50):
        self.load, self.build, self.publish, self.signatures, self.every = load, build, publish, signatures.rstrip("/"), every

    SCHEMA = "workspace string, signature string, seen long"

    def _batches(self, spark: SparkSession) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in children(spark, self.signatures) if n.startswith("batch="))

    def known(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The latest signature of each workspace, from the batches before one: (workspace, signature, seen)."""
        folders = [f"{self.signatures}/batch={n}" for n in self._batches(spark) if before is None or n < before]
        rows = spark.read.schema(self.SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy("workspace").agg(F.max_by("signature", "seen").alias("signature"), F.max("seen").alias("seen"))

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        touched = events.select("workspace").distinct()
        result = cut(self.build(self.load(touched)), "rebuilt")
        row = F.struct(*[c for c in result.columns if c != "workspace"])
        now = result.groupBy("workspace").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.to_json(row)))), 256).alias("signature"))
        before = self.known(spark, batch)
        changed = cut(now.join(before.select("workspace", "signature"), ["workspace", "signature"], "left_anti").withColumn("seen", F.lit(batch).cast("long")), "changed")
        if changed.isEmpty():
            return
        self.publish(result.join(changed.select("workspace"), "workspace", "left_semi"), batch)
        whole = batch % self.every == 0
        rows = changed.unionByName(before.join(changed, "workspace", "left_anti")) if whole else changed
        rows.write.mode("overwrite").parquet(f"{self.signatures}/batch={batch}")
        if whole:
            for n in self._batches(spark):
                if n < batch - self.every:
                    remove(spark, f"{self.signatures}/batch={n}")


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A publisher that writes each batch to a folder of its own, once however often it runs."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class Latest:
    """Runs of one thing of which only the newest counts: a new run cancels the Spark jobs of the one before."""

    def __init__(self, spark: SparkSession, name: str = "scan"):
        self.spark, self.name, self.newest, self._lock = spark, name, 0, threading.Lock()

    def run(self, work: Callable[[], T]) -> T | None:
        """What ``work`` gives, None if a newer run began meanwhile.  Call it in a thread of its own."""
        context = self.spark.sparkContext
        with self._lock:
            if self.newest:
                context.cancelJobsWithTag(f"{self.name}-{self.newest}")
            self.newest += 1
            mine = self.newest
        context.addJobTag(f"{self.name}-{mine}")
        try:
            out = work()
        except Exception:
            if mine != self.newest:
                return None
            raise
        finally:
            context.removeJobTag(f"{self.name}-{mine}")
        return out if mine == self.newest else None
