"""Token ids of a corpus in binary segments with Elias-Fano document boundaries.

Documents are dealt out by ranges of their id, sorted, encoded and laid end to
end; a segment holds some millions of ids of consecutive documents:

    magic, version, bytes an id, documents, ids, null ids, least id
    Elias-Fano: document ids less the least one
    Elias-Fano: boundaries, 0 to the number of ids
    the ids, 16 bits each if the vocabulary allows it, else 32

Segments are the rows of a Parquet table, so they are committed task by task,
survive lost executors, and can be read from any store that Spark reads.  A
reader finds each document by select on the boundaries.  Its place in the whole
corpus is that and a running sum over the segments of its part and over the
parts, one small row each.

Cases: a null text counts as empty; a text of any length is one document, if need
be in a segment of its own; null document ids come first; rows with one id are
kept apart, in order of their text's hash; an empty table gives a table without
segments; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.elias_fano import EliasFano, encode
from tessera.llm.encoder import ENCODE_BYTES, Encoder

END_ID = 2
#: Ids after which a segment is closed.
SEGMENT_IDS = 2_000_000
#: Places of up to so many segments, 24 bytes each, are broadcast; more are joined by a shuffle.
SMALL_SEGMENTS = 500_000

SEGMENTS = "part long, segment long, n_docs long, n_ids long, data binary"
_HEAD = struct.Struct("<4sBBHQQQq")
MAGIC, VERSION = b"TSEG", 1


def build_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One segment; ``ids`` are little-endian unsigned numbers of ``width`` bytes, nulls come first in ``doc_ids``."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.concatenate([[0], np.cumsum([len(raw) // width for raw in ids])]).astype(np.uint64)
    head = _HEAD.pack(MAGIC, VERSION, width, 0, len(doc_ids), int(ends[-1]), len(doc_ids) - len(known), base)
    offsets = known.astype(np.uint64) - np.uint64(base % (1 << 64))
    return head + encode(offsets) + encode(ends) + b"".join(ids)


def id_bytes(tokenizer: str, end_id: int) -> int:
    """Bytes that an id of this vocabulary takes."""
    return 2 if max(Encoder.of(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


class Segment:
    """A segment read back: whole, or one document at a time through select."""

    def __init__(self, data: bytes):
        magic, version, width, _, self.n_docs, self.n_ids, self.n_null, self.base = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment")
        self._ids = EliasFano(data, _HEAD.size)
        self._ends = EliasFano(data, self._ids.end)
        self.ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", self.n_ids, self._ends.end)

    def doc_ids(self) -> list[int | None]:
        known = (self._ids.selected(np.arange(self.n_docs - self.n_null)) + np.uint64(self.base % (1 << 64))).astype(np.int64)
        return [None] * self.n_null + known.tolist()

    def boundaries(self) -> np.ndarray:
        """Where each document begins, and the end of the last."""
        return self._ends.selected(np.arange(self.n_docs + 1)).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self._ends.select(i) : self._ends.select(i + 1)]


def write_segments(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    *,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode all documents in ascending order of their id and write the segments to ``path``."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(common.named(id_col).cast("long").alias("doc_id"), F.coalesce(common.named(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    width = id_bytes(tokenizer, end_id)
    kind = "<u2" if width == 2 else "<u4"
    end = np.array([end_id], kind).tobytes()

    rows = rows.repartitionByRange(common.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        part, segment = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = build_segment([d for d, _ in held], [raw for _, raw in held], width)
            return pa.RecordBatch.from_pydict({"part": [part], "segment": [segment], "n_docs": [len(held)], "n_ids": [size], "data": [data]})

        for batch in common.gathered(batches, ENCODE_BYTES):
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                held.append((doc_id, np.frombuffer(raw, "<u4").astype(kind).tobytes() + end))
                size += len(raw) // 4 + 1
                if size >= segment_ids:
                    yield close()
                    held, size, segment = [], 0, segment + 1
        if held:
            yield close()

    rows.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the segments: its id, place, length, and the crc32 of its ids."""
    common.prepare(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("start"))
    within = segments.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("within"))
    places = within.join(F.broadcast(parts), "part").select("part", "segment", (F.col("start") + F.col("within")).alias("base"))  # a row for each task that wrote
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for data, base in zip(batch.column(0), batch.column(1).to_pylist()):
                segment = Segment(data.as_py())
                ends = segment.boundaries()
                raw = memoryview(segment.ids.astype("<u4").tobytes())
                cuts = (4 * ends).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                out.append(common.record(schema, [segment.doc_ids(), base + ends[:-1], np.diff(ends), crc]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return step

    if segments.count() <= SMALL_SEGMENTS:
        places = F.broadcast(places)
    placed = segments.join(places, ["part", "segment"]).select("data", "base")
    return common.map_batches(placed, make, "doc_id long, start long, n_tokens long, ids_crc32 long")
