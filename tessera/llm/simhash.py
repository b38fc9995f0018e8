"""SimHash near-duplicates through hierarchical indexes in Gray order.

1. Each document becomes a 64-bit fingerprint of its word shingles; equal
   fingerprints are one from here on, whatever the number of copies.
2. Two fingerprints within ``DISTANCE`` bits agree on one of ``DISTANCE + 1``
   blocks of their bits, and on two of ``DISTANCE + 2``.  Each fingerprint goes to
   its cell of every block, or of every two blocks if there are very many.
3. A cell sorts its fingerprints by Gray rank, so that neighbours share bits,
   and factors the shared ones into the nodes of a tree: a node holds the bits
   that all below it share and its parent does not.  A search adds up
   differences on the way down and leaves whole groups once there are too many.
   Groups that are known to be linked with the searcher are left as well, so
   dense cells do not cost all their pairs.  A cell hands on a spanning forest.
4. Components of the forest edges are found without gathering any of them.

A cell above an even share of the rows is cut into segments, and every two of
them meet in a task of their own.

Cases: null, empty and blank texts have fingerprint zero and are linked like
any other; a text of any length is read in pieces; rows with one id are one
document; a null id ties nothing and is nobody's smallest id, so a component of
such rows alone has a null id; an empty table stays empty; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import components, local_roots

SHINGLE = 4
DISTANCE = 4
SEED = 42
FANOUT = 8
#: Rows of a cell up to which it is never cut.
CELL_ROWS = 2000
#: Blocks that make a cell, and fingerprints above which one more makes it: cells of 12 bits would hold too many.
KEYED = 1
MANY_PRINTS = 1 << 27
#: Rows that a task searches at once, and pairs of a search that it holds at once.
CHUNK_ROWS = 50_000
CHUNK_PAIRS = 2_000_000
#: Bytes of a text that are cut into words, and hashes whose bits are counted, at once.
PIECE_BYTES = 1 << 20
PIECE_HASHES = 1 << 16
_BLANK = frozenset(common.BLANKS.encode())


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` words, repeats included; of all words if they are fewer; nothing without words.

    Long texts come in pieces, so that neither their words nor their hashes are all held at once.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, at, kept, whole = xxhash.xxh64_intdigest, 0, [], True
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        while end < len(raw) and raw[end] not in _BLANK:
            end += 1
        words = kept + raw[at:end].split()
        at = end
        if len(words) < size and at < len(raw):
            kept = words
            continue
        if len(words) <= size and whole and at >= len(raw):
            if words:
                yield np.array([digest(b" ".join(words), SEED)], np.uint64)
            return
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        yield np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)
        kept, whole = words[len(words) - size + 1 :], False


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that more than half of all hashes have set, as a signed 64-bit number; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        for part in np.split(hashes, range(PIECE_HASHES, len(hashes), PIECE_HASHES)):
            ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    return majority(shingle_hashes(text, size))


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts.tolist()], dtype="int64")


def fingerprint_column(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each number in the sequence of Gray codes."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class GrayIndex:
    """Trees over fingerprints that are sorted by cell and Gray rank, one tree for each cell."""

    def __init__(self, values: np.ndarray, cells: np.ndarray, roots: np.ndarray):
        self.values, self.roots = values, roots
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        cell_of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(cells)]))
        every, none = values, values
        first, owner, linked = np.arange(len(values)), cell_of, roots
        self.levels = []
        while True:
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            heads = np.flatnonzero(place % FANOUT == 0)
            every, none = np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(none, heads)
            low, high = np.minimum.reduceat(linked, heads), np.maximum.reduceat(linked, heads)
            linked = np.where(low == high, low, -1)
            counts = np.diff([*heads, len(owner)])
            first, owner = first[heads], owner[heads]
            self.levels.append({"mask": ~(every ^ none), "bits": every, "child": heads, "count": counts, "first": first, "linked": linked})
            linked = np.where(linked < 0, -1 - np.arange(len(linked)), linked)
            if np.all(np.bincount(owner) <= FANOUT):
                break
        for upper, lower in zip(self.levels[1:], self.levels):
            parent = np.repeat(upper["mask"], upper["count"])
            lower["rest"] = lower["mask"] & ~parent
        self.levels[-1]["rest"] = self.levels[-1]["mask"]
        self.leaf_rest = ~np.repeat(self.levels[0]["mask"], self.levels[0]["count"])
        top = self.levels[-1]["first"]
        for level in self.levels:
            level["end"] = np.append(level["first"][1:], len(values))
        self.top_start = np.searchsorted(owner, cell_of)
        self.top_count = np.bincount(owner)[cell_of]
        assert len(top) == len(owner)

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a later member of its cell within ``distance`` that are not known to be linked."""
        counts = self.top_count[queries]
        query, node = np.repeat(queries, counts), _ranges(self.top_start[queries], counts)
        total = np.zeros(len(query), np.uint8)
        for level in reversed(self.levels):
            wanted = (level["end"][node] > query + 1) & (level["linked"][node] != self.roots[query])
            query, node, total = query[wanted], node[wanted], total[wanted]
            total = total + np.bitwise_count((self.values[query] ^ level["bits"][node]) & level["rest"][node])
            near = total <= distance
            query, node, total = query[near], node[near], total[near]
            counts = level["count"][node]
            query, total, node = np.repeat(query, counts), np.repeat(total, counts), _ranges(level["child"][node], counts)
        wanted = node > query
        query, node, total = query[wanted], node[wanted], total[wanted]
        total = total + np.bitwise_count((self.values[query] ^ self.values[node]) & self.leaf_rest[node])
        near = total <= distance
        return query[near], node[near]


def cell_forest(values: np.ndarray, cells: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints of a cell within ``distance``; the input is sorted by cell and Gray rank."""
    beside = np.flatnonzero((cells[1:] == cells[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= distance))
    roots = local_roots(len(values), beside, beside + 1)
    index = GrayIndex(values, cells, roots)
    found = [(beside, beside + 1)]
    starts = np.searchsorted(cells, cells)
    sizes = np.searchsorted(cells, cells, side="right") - starts
    work = np.cumsum(sizes) // CHUNK_PAIRS
    for part in np.split(np.arange(len(values)), np.flatnonzero(np.diff(work)) + 1):
        found.append(index.search(part, distance))
    a, b = (np.concatenate(x) for x in zip(*found))
    roots = local_roots(len(values), a, b)
    linked = np.flatnonzero(roots != np.arange(len(values)))
    return roots[linked], linked


def _cell_edges(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def edges(rows: list) -> pa.RecordBatch | None:
            cells, values, owners = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((gray_rank(values), cells))
            cells, values, owners = cells[order], values[order], owners[order]
            a, b = cell_forest(values, cells, distance)
            return pa.RecordBatch.from_pydict({"a": owners[a], "b": owners[b]}) if len(a) else None

        size = 0
        for batch in batches:
            cells, values, owners = (batch.column(k).to_numpy() for k in range(3))
            held.append((cells, values.view(np.uint64), owners))
            size += len(cells)
            if size < CHUNK_ROWS or cells[-1] == held[0][0][0]:
                continue
            cells, values, owners = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(cells, cells[-1]))
            if cut and (out := edges([(cells[:cut], values[:cut], owners[:cut])])) is not None:
                yield out
            held, size = [(cells[cut:], values[cut:], owners[cut:])], len(cells) - cut
        if size and (out := edges(held)) is not None:
            yield out

    return run


def dealt(rows: DataFrame, limit: int, key: Column) -> DataFrame:
    """``rows`` with a ``cell`` each, sorted by cell in as many partitions as the session shuffles.

    A cell of more than ``limit`` rows is cut into segments by ``key``, and every two
    of them meet in a cell of their own.  ``rows`` is read more than once: hand
    over a written table or a short plan.
    """
    # A cell's number leaves its low bits for two segments.
    room = 20
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    hot = common.written(sizes.where(F.col("n") > limit).select("cell", F.ceil(2 * F.col("n") / limit).cast("long").alias("segments")), "hot-cells")
    routed = rows.join(hot, "cell", "left")
    segment = F.pmod(key, F.col("segments"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1), lambda s: s != segment)
    pairs = F.transform(others, lambda s: F.shiftleft(F.least(s, segment), room) + F.greatest(s, segment))
    places = F.when(F.col("segments").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    routed = routed.withColumn("place", F.explode(places)).withColumn("cell", F.when(F.col("segments").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "place")))
    return routed.drop("segments", "place").repartition(common.partitions(rows.sparkSession), "cell").sortWithinPartitions("cell")


def link(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between owners that connect all fingerprints within ``distance``.

    ``prints`` has distinct fingerprints ``fp`` and their ``owner``; it is read
    more than once: hand over a written table.
    """
    n = prints.count()
    keyed = KEYED if n <= MANY_PRINTS else KEYED + 1
    cuts = [64 * k // (distance + keyed) for k in range(distance + keyed + 1)]
    blocks = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    chosen = list(combinations(range(len(blocks)), keyed))
    cells = [F.xxhash64(F.lit(k), *[blocks[i] for i in some]) for k, some in enumerate(chosen)]
    rows = prints.select(F.explode(F.array(*cells)).alias("cell"), "fp", "owner")
    limit = max(CELL_ROWS, math.ceil(len(chosen) * n / common.partitions(prints.sparkSession)))
    return dealt(rows, limit, F.xxhash64("fp")).select("cell", "fp", "owner").mapInArrow(_cell_edges(distance), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Fingerprint (signed) and component of every row: ``doc_id``, ``fp``, ``component_id``."""
    common.prepare(docs.sparkSession)
    rows = common.written(docs.select(common.named(id_col).cast("long").alias("doc_id"), fingerprint_column(common.named(text_col)).alias("fp")), "fingerprints")
    prints = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    edges = link(prints.select("fp", F.col("fp").alias("owner")), distance)
    by_id = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    repeated = common.written(by_id.where("low <> high").select("doc_id", "low"), "repeated-ids")
    # Rows with one id and different texts: their fingerprints are one document.
    edges = edges.unionByName(rows.join(repeated, "doc_id").select(F.col("low").alias("a"), F.col("fp").alias("b")))
    placed = prints.join(components(edges).withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = common.written(placed, "fingerprint-components")
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(groups, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the near-duplicate contract."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
