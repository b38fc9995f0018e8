"""Benchmark decontamination by the q-gram lemma.

A document is contaminated by an item if some part of it is within the item's
edit budget, a share of its length.  Texts are normalised first: lower case,
ASCII punctuation and white space as single blanks; edits, q-grams and places are
counted in characters of the normalised text.

A part within ``k`` edits of an item of ``m`` characters shares ``m + 1 - q (k + 1)``
of its q-grams at least, and these lie on diagonals that are ``k`` apart at most.
The same holds of any choice of its q-grams that don't overlap: an edit touches
one of them at most, so of ``p`` such tiles ``p - k`` stay.  The tiles that a
document shares with each item are counted in overlapping bands of diagonals,
every two bands beside each other together; bands with enough tiles are counted
again with all q-grams, and those that meet the bound are verified by alignment
within the band.  Short items have shorter q-grams, so that one tile stays of
each within its budget.  Items enter by their tiles in blocks of bounded size, so
no document is ever paired with an item that it doesn't share enough with.

Cases: a null or empty text has no match; an item of less than ``Q`` characters has
no edits to spare and matches as whole words; a null or empty item has no match;
a text of any length is searched whole; repeated rows match alike; an empty table
or benchmark gives no rows; columns of any name are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Characters of a q-gram.  Eight come by chance at one place in eight of such texts, so documents are searched for tiles first.
Q = 8
EDIT_RATE = 0.10
#: Normalised characters of the items that are held at once, some 25 bytes each in every worker; a larger benchmark takes more passes.
BLOCK_CHARS = 2 << 20
FILTER_BITS = 21
#: Documents' characters that are searched at once.
SEARCH_CHARS = 1 << 19
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BLANK = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def normalised(text: str | None) -> np.ndarray:
    """The characters of the normalised text as numbers; none is 0."""
    data = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split())
    if data.isascii():
        return np.frombuffer(data, np.uint8).astype(np.uint32)
    return np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q-gram at each place of ``data``."""
    out = data.astype(np.uint64)
    if len(data) < q:
        return out[:0]
    with np.errstate(over="ignore"):
        if q == 8:
            for step, by in zip(_STEPS, (1, 2, 4)):
                out = out[:-by] * step + out[by:]
            return out
        single, out = out, out[: len(out) - q + 1].copy()
        for k in range(1, q):
            out = out * _STEPS[0] + single[k : k + len(out)]
        return out


def budget(m: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed in an item of ``m`` characters."""
    return int(rate * m)


def tile_size(m: int, k: int) -> int:
    """Characters of an item's q-grams: so many that ``k + 1`` of them fit beside each other, ``Q`` at most."""
    return min(Q, m // (k + 1))


def best_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Least edits between ``item`` and a part of ``text``, on diagonals (place in text less place in item) from low to high.

    Returns edits, start and end, or None above ``k``; of equal ones the first to end.
    """
    width = high - low + 1
    letters = np.zeros(len(item) + width + 1, np.uint32)
    first, last = max(0, low), min(len(text), low + len(letters))
    if first < last:
        letters[first - low : last - low] = text[first:last]
    far = 1 << 20
    steps = np.arange(width)
    at = low + steps
    cost = np.where((at >= 0) & (at <= len(text)), 0, far)
    start = at.copy()
    for i in range(len(item)):
        # cost[j] is of the prefix i and the text up to low + i + j.
        change = cost + (letters[i : i + width] != item[i])
        skip = np.append(cost[1:], far) + 1
        here = np.minimum(change, skip)
        begin = np.where(change <= skip, start, np.append(start[1:], 0))
        ends = low + i + 1 + steps
        here = np.where((ends >= 0) & (ends <= len(text)), here, far)
        run = np.minimum.accumulate(here - steps)
        source = np.maximum.accumulate(np.where(here - steps == run, steps, 0))
        cost, start = run + steps, begin[source]
        cost = np.where((ends >= 0) & (ends <= len(text)), cost, far)
        if cost.min() > k:
            return None
    j = int(cost.argmin())
    return int(cost[j]), int(start[j]), low + len(item) + j


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class ShortItems:
    """Items that match only as they are, from one word boundary to another."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in sorted({len(x) for x in items}):
            of = np.array([i for i, x in enumerate(items) if len(x) == m])
            hashes = np.array([grams(items[i], m)[0] for i in of], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.by_length[m] = hashes[order], of[order]

    def found(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Rows (document, item, edits, start, end), the first of each pair."""
        edge = (data == 0) | (data == _BLANK)
        for m, (hashes, of) in self.by_length.items():
            places = np.flatnonzero(edge[m:] & ~edge[: len(edge) - m])
            places = places[(places == 0) | edge[places - 1]]
            values = grams(data, m)[places]
            left, right = np.searchsorted(hashes, values), np.searchsorted(hashes, values, side="right")
            met: set[tuple[int, int]] = set()
            for at, item in zip(np.repeat(places, right - left).tolist(), of[_ranges(left, right - left)].tolist()):
                doc = int(np.searchsorted(starts, at, side="right")) - 1
                if (doc, item) not in met and (data[at : at + m] == self.items[item]).all():
                    met.add((doc, item))
                    yield doc, item, 0, at - int(starts[doc]), at - int(starts[doc]) + m


class ItemIndex:
    """The q-grams of items that have q-grams of one size."""

    def __init__(self, items: list[np.ndarray], q: int, rate: float = EDIT_RATE):
        self.items, self.q = items, q
        lengths = np.array([len(x) for x in items], np.int64)
        self.edits = np.array([budget(m, rate) for m in lengths.tolist()], np.int64)
        self.needed = lengths + 1 - q * (self.edits + 1)
        #: Tiles of an item that stay at least.
        self.staying = lengths // q - self.edits
        every = [grams(x, q) for x in items]
        orders = [np.argsort(g, kind="stable").astype(np.int32) for g in every]
        self.sorted = [(g[o], o) for g, o in zip(every, orders)]
        per_item = [g[::q] for g in every]
        tiles = np.concatenate([*per_item, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(items)), [len(g) for g in per_item])
        place = np.concatenate([*[np.arange(len(g)) * q for g in per_item], np.zeros(0, np.int64)])
        order = np.argsort(tiles, kind="stable")
        self.of, self.place = of[order], place[order]
        self.grams, self.first, self.count = np.unique(tiles[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        with np.errstate(over="ignore"):
            self.seen[(self.grams * _MIX) >> np.uint64(64 - FILTER_BITS)] = True

    def bands(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Document, item and band of diagonals wherever two bands beside each other meet the bound.

        ``data`` is the documents with gaps between; a band is ``edits + 1``
        wide, and the one beside it is counted with it.
        """
        found = grams(data, self.q)
        with np.errstate(over="ignore"):
            at = np.flatnonzero(self.seen[(found * _MIX) >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.grams):
            return
        values = found[at]
        slot = np.minimum(np.searchsorted(self.grams, values), len(self.grams) - 1)
        same = self.grams[slot] == values
        at, slot = at[same], slot[same]
        doc = np.searchsorted(starts, at, side="right") - 1
        counts = self.count[slot]
        pick = np.repeat(self.first[slot] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        item, doc = self.of[pick], np.repeat(doc, counts)
        pair = doc * len(self.items) + item
        if len(starts) * len(self.items) <= 4 * len(pair) + 1_000_000:
            enough = np.bincount(pair, minlength=len(starts) * len(self.items))[pair] >= self.staying[item]
        else:
            enough = np.ones(len(pair), bool)
        item, doc, pair = item[enough], doc[enough], pair[enough]
        diagonal = np.repeat(at - starts[np.searchsorted(starts, at, side="right") - 1], counts)[enough] - self.place[pick[enough]]
        band = diagonal // (self.edits[item] + 1)
        if not len(pair):
            return
        low = int(band.min()) - 1
        span = int(band.max()) - low + 3
        keys, counts = np.unique(pair * span + (band - low), return_counts=True)
        # Bands b and b + 1 together; b may be empty, so each key also counts for the band before it.
        together = np.unique(np.concatenate([keys, keys - 1]))
        total = sum(np.where((i := np.minimum(np.searchsorted(keys, together + s), len(keys) - 1), keys[i] == together + s)[1], counts[i], 0) for s in (0, 1))
        pairs = together // span
        for p, b in zip(pairs[good := total >= self.staying[pairs % len(self.items)]].tolist(), (together[good] % span + low).tolist()):
            doc, item = divmod(p, len(self.items))
            wide = int(self.edits[item]) + 1
            # Places of the document at which a q-gram of the item can lie within the bands.
            first, last = starts[doc] + max(0, b * wide), starts[doc] + (b + 2) * wide - 1 + len(self.sorted[item][0])
            last = min(last, starts[doc + 1] if doc + 1 < len(starts) else len(found))
            if self.meets(item, found[first:last], int(first - starts[doc]), b * wide):
                yield doc, item, b

    def meets(self, item: int, part: np.ndarray, place: int, low: int) -> bool:
        """Whether enough q-grams of the item are in ``part``, which begins at ``place``, on diagonals ``edits`` apart, of two bands from ``low``."""
        sorted_grams, places = self.sorted[item]
        left, right = np.searchsorted(sorted_grams, part), np.searchsorted(sorted_grams, part, side="right")
        counts = right - left
        at = np.repeat(place + np.arange(len(part)), counts)
        diagonal = at - places[_ranges(left, counts)]
        k, needed = int(self.edits[item]), int(self.needed[item])
        diagonal = np.sort(diagonal[(diagonal >= low) & (diagonal < low + 2 * (k + 1))])
        return bool(np.any(diagonal[needed - 1 :] - diagonal[: max(0, len(diagonal) - needed + 1)] <= k))

    def found(self, data: np.ndarray, starts: np.ndarray, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """Rows (document, item, edits, start, end), the best of each pair."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, band in self.bands(data, starts):
            k = int(self.edits[item])
            if best.get((doc, item), (k + 1,))[0] == 0:
                continue
            low, high = band * (k + 1) - k, (band + 2) * (k + 1) - 1 + k
            got = best_alignment(self.items[item], docs[doc], low, high, k)
            if got and got < best.get((doc, item), (k + 1,)):
                best[doc, item] = got
        for (doc, item), got in best.items():
            yield doc, item, *got


class Items:
    """A block of a benchmark, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], rate: float = EDIT_RATE):
        by_size: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for i, x in items:
            by_size.setdefault(tile_size(len(x), budget(len(x), rate)) if len(x) >= Q else 0, []).append((i, x))
        short = by_size.pop(0, [])
        self.short = ShortItems([x for _, x in short])
        self.short_ids = [i for i, _ in short]
        self.indexes = [(ItemIndex([x for _, x in some], q, rate), [i for i, _ in some]) for q, some in sorted(by_size.items())]

    def matches(self, texts: list[str | None]) -> list[tuple[int, int | None, int, int, int]]:
        """Rows (text, item id, edits, start, end), places in the normalised text; the best match of each pair."""
        out, held, size, first = [], [], 0, 0
        gap = np.zeros(Q, np.uint32)
        for i, text in enumerate(texts):
            held.append(normalised(text))
            size += len(held[-1])
            if size < SEARCH_CHARS and i + 1 < len(texts):
                continue
            starts = np.cumsum([0] + [len(d) + Q for d in held[:-1]])
            data = np.concatenate([part for d in held for part in (d, gap)])
            rows = [(doc, self.short_ids[item], *rest) for doc, item, *rest in self.short.found(data, starts)]
            for index, ids in self.indexes:
                rows += [(doc, ids[item], *rest) for doc, item, *rest in index.found(data, starts, held)]
            out += [(first + doc, *rest) for doc, *rest in sorted(rows, key=lambda r: r[0])]
            held, size, first = [], 0, i + 1
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = EDIT_RATE) -> Iterator[Items]:
    """The benchmark in blocks of BLOCK_CHARS of text, one on the driver at a time."""
    rows = benchmark.select(common.named(id_col).cast("long"), F.coalesce(common.named(text_col), F.lit("")))
    held, size = [], 0
    for item_id, text in rows.toLocalIterator():
        data = normalised(text)
        if not len(data):
            continue
        if held and size + len(data) > BLOCK_CHARS:
            yield Items(held, rate)
            held, size = [], 0
        held.append((item_id, data))
        size += len(data)
    if held:
        yield Items(held, rate)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits``, ``start`` and ``end`` of the best match of every document and item within the budget.

    One pass over the documents for each block of items.  All but the last are
    written at once, so that workers hold one block at a time.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "edits", "start", "end")])
    ddl = "doc_id long, item_id long, edits long, start long, end long"
    rows = docs.select(common.named(id_col).cast("long").alias("doc_id"), common.named(text_col).alias("text"))
    out, last = spark.createDataFrame([], ddl), None
    for index in item_blocks(benchmark, rate=rate):
        if last is not None:
            out = out.unionByName(common.written(last, "leaks"))
            shared.unpersist()  # noqa: F821 - set with ``last``
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                found = shared.value.matches(batch.column(1).to_pylist())
                if not found:
                    return None
                text, item, edits, start, end = zip(*found)
                return common.record(schema, [batch.column(0).take(pa.array(text)), item, edits, start, end])

            return step

        last = common.map_batches(rows, make, ddl)
    return out if last is None else out.unionByName(last)


def _cleaner(shared: Broadcast):
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        out[np.array([m[0] for m in shared.value.matches(texts.tolist())], np.int64)] = False
        common.release()
        return pd.Series(out)

    return clean


def drop_leaked(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without those that hold a benchmark item, in one pass for each block of items; all but the last are written."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared: Broadcast | None = None
    for index in item_blocks(benchmark, rate=rate):
        if shared is not None:
            docs = common.written(docs, "clean")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(index)
        kept: Column = F.pandas_udf(_cleaner(shared), "boolean")(common.named(text_col))
        docs = docs.where(kept)
    return docs
