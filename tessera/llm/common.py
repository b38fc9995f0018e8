"""Shared plumbing of the training-data operators: scratch tables and Arrow batches.

Operators cut lineage with Parquet tables under ``spark.checkpoint.dir``, which
every executor of a cluster can reach, so a lost executor costs only the tasks
that it ran.  Nothing here collects rows of documents to the driver.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to a Python worker at once: texts can be very long, so
#: batches are kept far below the default of 10,000.
BATCH_ROWS = 1000

#: The white space of every contract here: space and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> None:
    """Set the batch limit and, where the cluster names none, a checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (held := context._jsc.sc().getCheckpointDir()).isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


_cleared: set[str] = set()


def scratch_folder(spark: SparkSession) -> str:
    """This application's scratch tables, which go when the driver ends."""
    folder = f"{checkpoint_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    if folder not in _cleared:
        _cleared.add(folder)
        atexit.register(clear_scratch, spark, folder)
    return folder


def clear_scratch(spark: SparkSession, folder: str | None = None) -> None:
    """Remove the application's scratch tables; results that were not yet read are lost with them."""
    with contextlib.suppress(Exception):  # the JVM may be gone already
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder or scratch_folder(spark))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_folder(spark)}/{what}-{uuid.uuid4().hex}"


_temporary: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are written inside go at the end, but for those that ask to be kept."""
    _temporary.append([])
    try:
        yield
    finally:
        for path in _temporary.pop():
            clear_scratch(spark, path)


def written(df: DataFrame, what: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    if _temporary and not keep:
        _temporary[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def named(column: str, row: str | None = None) -> Column:
    """The column of exactly this name, whatever characters it has; a field of the struct ``row`` if that is given."""
    quoted = "`" + column.replace("`", "``") + "`"
    return F.col(f"{row}.{quoted}" if row else quoted)


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that those an operator adds can't clash with them."""
    return F.struct(*[named(c) for c in df.columns]).alias("row")


def lowered(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, UPPER, UPPER.lower())


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def release() -> None:
    """Workers outlive their tasks: what Arrow and Python no longer use goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux can be asked
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, most_bytes: int = 0
) -> DataFrame:
    """``mapInArrow`` with a function that is made once for each task; batches are joined up to ``most_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in gathered(batches, most_bytes) if most_bytes else batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out
        release()

    return df.mapInArrow(run, schema)


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
