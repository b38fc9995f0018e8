"""Line dedup through a sharded minimal perfect hash.

1. Every long enough line becomes a 128-bit hash of its key; one aggregation,
   combined before the shuffle, finds the hashes of two documents or more with
   the smallest document that holds each.
2. Those hashes are dealt to shards.  A shard is a minimal perfect hash that
   indexes three compact arrays: fingerprints, owners and counts.
3. Up to ``PROBE_KEYS`` hashes in all, every worker gets the shards, and documents
   probe the arrays where they lie: no text is moved.
4. More hashes stay where they are.  Lines are routed to their shard as 128-bit
   hashes and probe its arrays as they stream past it, and the few hits go back
   to their documents as lists of line numbers.  Shards with more lines than an
   even share are cut by a salt, their arrays copied to each part, so a line that
   a third of all documents hold is probed everywhere.

Cases: a null or empty text is one empty line; a text of any length is one list
of lines; a null document id counts as the greatest id; rows with one id are one
document, and a key is dropped in all of them or in none; an empty table stays
empty.  All columns of the input are kept; ``text`` is replaced and ``n_lines``,
``n_dropped`` are added, replacing columns of these names.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, perfect_hash

MIN_CHARS = 10
#: Distinct hashes of all shards up to which every worker gets them, some 60 bytes each there.
PROBE_KEYS = 500_000
#: Distinct hashes of a shard, about 3 MB of arrays.
SHARD_KEYS = 131_072
#: Shards for each shuffle partition at least, so that they spread evenly.
SPREAD = 8
LAST_ID = (1 << 63) - 1
_COUNT = struct.Struct("<Q")


#: Seeds of the two halves of a line's hash.
SEEDS = (42, 0x5DEECE66D)
_BLANK = common.BLANKS.encode()


def line_hashes(texts: list[str | None], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines whose key is long enough: place of the text, number of the line, and the two halves of the key's hash."""
    of, number, first, second = [], [], [], []
    digest, (one, two) = xxhash.xxh64_intdigest, SEEDS
    for t, text in enumerate(texts):
        for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
            key = line.strip(_BLANK)
            # A code point has four bytes at most.
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                of.append(t)
                number.append(i)
                first.append(digest(key, one))
                second.append(digest(key, two))
    return np.array(of, np.int64), np.array(number, np.int64), np.array(first, np.uint64), np.array(second, np.uint64)


def _unsigned(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64)


def build_shard(h1: np.ndarray, h2: np.ndarray, owner: np.ndarray, count: np.ndarray) -> bytes:
    """The perfect hash of one shard and the arrays that it indexes."""
    head = perfect_hash.build(h1, h2)
    at = perfect_hash.PerfectHash(head).numbers(h1, h2)
    arrays = []
    for values, kind in ((h1, "<u8"), (owner, "<i8"), (np.minimum(count, (1 << 32) - 1), "<u4")):
        array = np.empty(len(at), kind)
        array[at] = values
        arrays.append(array.tobytes())
    return _COUNT.pack(len(at)) + head + b"".join(arrays)


class Shard:
    def __init__(self, data: bytes):
        (n,) = _COUNT.unpack_from(data)
        self.hash = perfect_hash.PerfectHash(data, _COUNT.size)
        at = self.hash.end
        self.fingerprints = np.frombuffer(data, "<u8", n, at)
        self.owners = np.frombuffer(data, "<i8", n, at + 8 * n)
        self.counts = np.frombuffer(data, "<u4", n, at + 16 * n)

    def foreign(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which lines are indexed and owned by another document."""
        at = self.hash.numbers(h1, h2)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == h1[known]
        known[known] = self.owners[at[known]] != doc[known]
        return known


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream lines, sorted by shard, past the arrays of their shard, which come first."""
    at, shard = None, None
    for batch in batches:
        cell = batch.column(0).to_numpy()
        data = batch.column(1)
        doc, h, i, h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 7))
        loads = np.flatnonzero(np.asarray(data.is_valid()))
        hits = []
        for first, end in zip([0, *loads.tolist()], [*loads.tolist(), len(cell)]):
            if first in loads:
                at, shard = cell[first], Shard(data[first].as_py())
                first += 1
            rows = first + np.flatnonzero(cell[first:end] == at) if shard is not None else []
            if len(rows):
                a, b, d = _unsigned(h1[rows]), _unsigned(h2[rows]), doc[rows].astype(np.int64)
                hits.append(rows[shard.foreign(a, b, d)])
        found = np.concatenate(hits) if hits else np.array([], np.int64)
        if len(found):
            yield pa.RecordBatch.from_pydict({"doc": doc[found].astype(np.int64), "text_hash": h[found].astype(np.int64), "i": i[found].astype(np.int32)})


def _counted(min_chars: int):
    """Lines of a batch by their hash: the smallest and the greatest document, and how many."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        of, _, h1, h2 = line_hashes(batch.column(1).to_pylist(), min_chars)
        if not len(of):
            return None
        doc = batch.column(0).to_numpy()[of]
        order = np.lexsort((doc, h2, h1))
        doc, h1, h2 = doc[order], h1[order], h2[order]
        heads = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        counts = np.diff([*heads, len(doc)])
        columns = {"h1": h1[heads].view(np.int64), "h2": h2[heads].view(np.int64), "owner": doc[heads], "last": doc[heads + counts - 1], "n": counts.astype(np.int64)}
        return pa.RecordBatch.from_pydict(columns)

    return step


def _numbered(min_chars: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        of, i, h1, h2 = line_hashes(batch.column(2).to_pylist(), min_chars)
        doc, text = batch.column(0).to_numpy()[of], batch.column(1).to_numpy()[of]
        return pa.RecordBatch.from_pydict({"doc": doc, "text_hash": text, "i": i.astype(np.int32), "h1": h1.view(np.int64), "h2": h2.view(np.int64)})

    return step


def shared_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes of lines that two documents or more hold: ``h1``, ``h2``, ``owner``, ``n``, a written table."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(common.named(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), common.named(text_col).alias("text"))
    lines = common.map_batches(rows, lambda: _counted(min_chars), "h1 long, h2 long, owner long, last long, n long")
    keys = lines.groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return common.written(keys.where("owner < last").select("h1", "h2", "owner", "n"), "line-keys")


def routed_lines(docs: DataFrame, keys: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Lists of the lines to drop, found by lines that stream past the shards: ``doc`` (null ids as the greatest), ``text_hash``, ``lines``."""
    spark = docs.sparkSession
    n_parts = common.partitions(spark)
    rows = docs.select(F.coalesce(common.named(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(common.named(text_col)).alias("text_hash"), common.named(text_col).alias("text"))
    lines = common.map_batches(rows, lambda: _numbered(min_chars), "doc long, text_hash long, i int, h1 long, h2 long")
    found, rows = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(SPREAD * n_parts, math.ceil(found / SHARD_KEYS))
    share = max(1, math.ceil(rows / (SPREAD * n_parts)))
    of_shard = F.pmod(F.col("h2"), F.lit(shards)).alias("shard")
    index = common.written(sharded(keys, shards, share), "line-shards")
    hot = F.broadcast(index.where("salts > 1").select("shard", "salts"))  # their rows add up, so there are SPREAD * n_parts at most
    salt_bits = 24
    salt = F.pmod(F.xxhash64("doc", "i"), F.coalesce("salts", F.lit(1)))
    routed = lines.select("*", of_shard).join(hot, "shard", "left").select(
        (F.shiftleft("shard", salt_bits) + salt).alias("cell"), F.lit(None).cast("binary").alias("data"), "doc", "text_hash", "i", "h1", "h2"
    )
    arrays = index.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "shard", "data").select(
        (F.shiftleft("shard", salt_bits) + F.col("salt")).alias("cell"), "data", *[F.lit(0).cast(t).alias(c) for c, t in (("doc", "long"), ("text_hash", "long"), ("i", "int"), ("h1", "long"), ("h2", "long"))]
    )
    stream = arrays.unionByName(routed).repartition(n_parts, "cell").sortWithinPartitions("cell", F.col("data").isNull())
    hits = stream.mapInArrow(_probe, "doc long, text_hash long, i int")
    return hits.groupBy("doc", "text_hash").agg(F.collect_set("i").alias("lines"))


def sharded(keys: DataFrame, shards: int, share: int) -> DataFrame:
    """Shards of the hashes: ``shard``, ``salts`` (parts that its lines are worth), ``data``."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        data = build_shard(_unsigned(group.h1), _unsigned(group.h2), group.owner.to_numpy(), group.n.to_numpy())
        return pd.DataFrame({"shard": [int(group.shard.iloc[0])], "salts": [max(1, math.ceil(int(group.n.sum()) / share))], "data": [data]})

    return keys.select("*", F.pmod(F.col("h2"), F.lit(shards)).alias("shard")).groupBy("shard").applyInPandas(build, "shard long, salts long, data binary")


#: What a worker has loaded of broadcast shards, of the latest only.
_loaded: dict[str, dict[int, Shard]] = {}


def _prober(shared: Broadcast, min_chars: int):
    """A function of ids and texts: the texts without the lines that another document owns, their lines, and how many went."""

    def probe(docs: pd.Series, texts: pd.Series) -> pd.DataFrame:
        name, shards, data = shared.value
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = {k: Shard(raw) for k, raw in data.items()}
        index = _loaded[name]
        said = [t or "" for t in texts.tolist()]
        of, number, h1, h2 = line_hashes(said, min_chars)
        shard = h2.view(np.int64) % shards
        gone = np.zeros(len(of), bool)
        doc = docs.to_numpy(np.int64)[of]
        order = np.argsort(shard, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(rows) and (one := index.get(int(shard[rows[0]]))) is not None:
                gone[rows] = one.foreign(h1[rows], h2[rows], doc[rows])
        dropped = np.bincount(of[gone], minlength=len(said))
        lines = [t.count("\n") + 1 for t in said]
        starts = np.searchsorted(of[gone], np.arange(len(said) + 1))
        places = number[gone]
        for t in np.flatnonzero(dropped).tolist():
            out = set(places[starts[t] : starts[t + 1]].tolist())
            said[t] = "\n".join([line for i, line in enumerate(said[t].split("\n")) if i not in out])
        common.release()
        return pd.DataFrame({"text": pd.Series(said, dtype=object), "n_lines": np.array(lines, np.int64), "n_dropped": dropped.astype(np.int64)})

    return probe


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines whose key a smaller document holds first."""
    spark = docs.sparkSession
    keys = shared_keys(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(common.as_row(docs), F.coalesce(common.named(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(common.named(text_col), F.lit("")).alias("text"))
    if (found := keys.count()) <= PROBE_KEYS:
        shards = max(1, math.ceil(found / SHARD_KEYS))
        data = {r.shard: bytes(r.data) for r in sharded(keys, shards, 1 << 62).select("shard", "data").collect()}
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, shards, data))
        # A filter on the result must not call it again.
        probe = F.pandas_udf(_prober(shared, min_chars), "text string, n_lines long, n_dropped long").asNondeterministic()
        out = rows.select("row", probe("doc", "text").alias("new"))
        return out.select(*[F.col("new.text").alias(c) if c == text_col else common.named(c, "row").alias(c) for c in names], F.col("new.n_lines").alias("n_lines"), F.col("new.n_dropped").alias("n_dropped"))
    drops = routed_lines(docs, keys, id_col=id_col, text_col=text_col, min_chars=min_chars)
    joined = rows.withColumn("text_hash", F.xxhash64(common.named(text_col, "row"))).join(drops, ["doc", "text_hash"], "left")
    numbers = F.sequence(F.lit(0), F.col("n_lines") - 1)
    kept = F.array_join(F.transform(F.array_except(numbers, F.col("lines")), lambda i: F.get(F.col("split"), i)), "\n")
    out = joined.select("row", "lines", "text", F.split("text", "\n", -1).alias("split")).select("*", F.size("split").alias("n_lines"))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept)
    return out.select(
        *[text.alias(c) if c == text_col else common.named(c, "row").alias(c) for c in names],
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"),
    )
