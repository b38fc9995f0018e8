"""Packing by power-of-two decomposition.

A document of ``n`` ids is cut into ``n // length`` pieces of ``length`` ids and
one piece for each set bit of the rest, longest first.  Every piece is a whole
training sequence: its length is a power of two, so it needs no padding, no
sequence crosses documents, and batches are drawn from one bucket of equal
lengths at a time.  The work is one pass over the documents without a shuffle;
sequence ids carry the number of the partition in their upper bits, so they are
unique without any count over the corpus.

Cases: a null text counts as empty and gives the end id alone; a text of any
length is cut into as many pieces as it takes; a null document id stays null; repeated rows are packed as often as they come; an empty table
gives an empty result; columns other than the two that are named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.encoder import ENCODE_BYTES, Encoder

LENGTH = 1024
END_ID = 0
#: Parts of texts that a worker keeps, and bytes of text that it takes at once: as the pipeline's last stage it shares executors with what others left.
KEPT_PARTS = 150_000
BATCH_BYTES = ENCODE_BYTES // 2
#: Lower bits of a sequence id: the sequences that one partition may hold.
SEQUENCE_BITS = 38

SCHEMA = "doc_id long, start long, length long, bucket int, doc_tokens long, sequence_id long, offset long, ids binary"


def piece_lengths(n: int, length: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids; ``length`` is a power of two."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer: str, *, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents, each with its ids as little-endian unsigned 32-bit numbers."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    common.prepare(docs.sparkSession)
    rows = docs.select(common.named(id_col).cast("long").alias("doc_id"), F.coalesce(common.named(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length")] + [("bucket", pa.int32())] + [(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
    )

    def make():
        encoder = Encoder.of(tokenizer, KEPT_PARTS)
        upcoming = TaskContext.get().partitionId() << SEQUENCE_BITS

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal upcoming
            ids = [raw + end for raw in encoder.encode(batch.column(1))]
            tokens = np.array([len(raw) // 4 for raw in ids], np.int64)
            cuts = [piece_lengths(n, length) for n in tokens.tolist()]
            pieces = np.array([len(c) for c in cuts], np.int64)
            lengths = np.array([x for c in cuts for x in c], np.int64)
            ends = np.cumsum(lengths)
            first = np.repeat(np.cumsum(tokens) - tokens, pieces)
            joined = b"".join(ids)
            data = pa.Array.from_buffers(
                pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes()), pa.py_buffer(joined)]
            )
            sequence = upcoming + np.arange(len(lengths))
            upcoming += len(lengths)
            of = pa.array(np.repeat(np.arange(batch.num_rows), pieces))
            buckets = np.round(np.log2(lengths)).astype(np.int32)
            return common.record(
                schema, [batch.column(0).take(of), ends - lengths - first, lengths, buckets, np.repeat(tokens, pieces), sequence, np.zeros(len(lengths), np.int64), data]
            )

        return step

    return common.map_batches(rows, make, SCHEMA, BATCH_BYTES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences, one folder for each length, for curricula over lengths."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The columns of the packing contract."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
