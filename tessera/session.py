"""Session helper: adaptive execution on, UTC, and scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """The active session, or a local one for tests and the command line."""
    if active := SparkSession.getActiveSession():
        return active
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one where driver and executors are one process."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not (held := context._jsc.sc().getCheckpointDir()).isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []


_cleared: set[str] = set()


def _clear(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        remove(spark, folder)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new place for a scratch table; those of this application go when the driver ends."""
    folder = f"{checkpoint_dir(spark)}/tessera/{spark.sparkContext.applicationId}/core"
    if folder not in _cleared:
        _cleared.add(folder)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """``df`` written to a scratch table and read back: loops keep short lineages and survive lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
