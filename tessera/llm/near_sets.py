"""Near-duplicates: SimHash fingerprints in Gray-ordered indexes, verified by exact Jaccard similarity.

Two texts are near-duplicates if the sets of their five-word shingles have a
similarity of ``SIMILAR`` or more; equal sets are one vertex from here on.  At
that similarity fingerprints differ in ten bits on average, which is beyond the
reach of a pigeonhole split, so cells are keyed by bands of minimum hashes:

1. Each distinct set gets a fingerprint and ``BANDS`` keys of ``ROWS`` minimum hashes.
   Two sets of similarity 0.8 share no key at all once in 8 million pairs.  Their
   fingerprints differ in more than ``DISTANCE`` bits once in a million, and so do
   sketches of the lowest bits of minimum hashes in more than ``SKETCH_DISTANCE``.
2. Every member of a cell is paired with the cell's smallest and greatest name.
   Pairs whose sizes or fingerprints differ too much are left; the others are
   verified on the whole sets, and components are found.
3. In cells that have members of different components yet, a part of the cells
   after the other, each member is paired with one that its cell draws, so that
   large groups of texts at the edge of similarity grow together without all
   their pairs.
4. In what is left of such cells a Gray-ordered tree looks for members that can
   be similar to one of another component; it leaves groups that are linked with
   the searcher already.  Those that it finds meet once more by the rarest hashes
   that they share: first with the member of each such cell that has least for
   itself, as the original of many copies has, then by the tree, which gives the
   pairs that are left.  Sets that have more for themselves than
   similar ones may have meet nobody, so a large group of texts that are almost
   similar makes few pairs.  All that is found is verified.

A cell above an even share of the rows is cut into segments, and every two of
them meet in a task of their own.

Cases: null, empty and blank texts are one group; a text of fewer words than a
shingle is one shingle; a text of any length is read in pieces, its distinct
hashes are held; rows with one id are one document, of which the row of least
hash stays; a null id ties nothing, and comes after every other id; an empty
table stays empty; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import components
from tessera.llm.simhash import CELL_ROWS, CHUNK_PAIRS, GrayIndex, dealt, gray_rank, majority, shingle_hashes

SHINGLE = 5
#: Similarity of near-duplicates, as a fraction.
SIMILAR = (4, 5)
#: Bits in which the fingerprints of similar sets, and their sketches of 128 minimum hashes, differ at most.
DISTANCE = 24
SKETCH_DISTANCE = 32
#: Minimum hashes of a key, and keys.
ROWS, BANDS = 5, 40
#: Parts of the cells, a round for each, in which members meet one that is drawn; the first round of which not one pair in FRUITFUL is similar is the last.
ROUNDS, FRUITFUL = 4, 20
#: Hashes of a set that are mixed at once.
MIXED = 2048
#: Sets up to which their names are broadcast, 8 bytes each; more are joined by a shuffle.
MOST_NAMES = 500_000
#: Rows of a batch that holds two whole sets in each.
PAIR_ROWS = 200

_MIX = np.random.default_rng(20).integers(1 << 63, size=(2, ROWS * BANDS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, size)]))


def similar(shared: int, a: int, b: int) -> bool:
    up, down = SIMILAR
    return (up + down) * shared >= up * (a + b)


def bands(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """The keys of a set, signed, and its sketch, two numbers; the empty set has no keys."""
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    if not len(hashes):
        return [], [0, 0]
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), MIXED):
            mixed = _MIX[0][:, None] * hashes[None, i : i + MIXED]
            mixed ^= mixed >> np.uint64(32)
            mixed *= _MIX[1][:, None]
            np.minimum(least, mixed.min(axis=1), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(ROWS, BANDS):
            key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    # The products' upper bits decide which is least, so a bit from below is as good as random.
    sketch = np.packbits((least[:128] >> np.uint64(17)) & np.uint64(1) != 0).view(np.int64)
    return key.view(np.int64).tolist(), sketch.tolist()


SETS = "doc_id long, name long, n long, fp long, s1 long, s2 long, keys array<long>, hashes binary"
#: What is known of a set without its hashes.
ABOUT = ("n", "fp", "s1", "s2")


def _sets():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        data = [s.tobytes() for s in sets]
        keys, sketches = zip(*map(bands, sets))
        sketches = np.array(sketches, np.int64).reshape(-1, 2)
        columns = {
            "doc_id": batch.column(0),
            "name": np.array([xxhash.xxh3_64_intdigest(d) for d in data], np.uint64).view(np.int64),
            "n": np.array([len(s) for s in sets], np.int64),
            "fp": np.array([majority([s]) for s in sets], np.int64),
            "s1": sketches[:, 0],
            "s2": sketches[:, 1],
            "keys": pa.array(keys, pa.list_(pa.int64())),
            "hashes": pa.array(data, pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    return step


def _close(a: str, b: str) -> Column:
    """Whether sets with the columns of ``ABOUT`` under these ends can be similar."""
    up, down = SIMILAR
    differ = lambda c: F.bit_count(F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}")))
    sizes = down * F.least(f"n_{a}", f"n_{b}") >= up * F.greatest(f"n_{a}", f"n_{b}")
    return sizes & (differ("fp") <= DISTANCE) & (differ("s1") + differ("s2") <= SKETCH_DISTANCE)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            good.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        if kept.num_rows:
            yield kept
    common.release()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of the distinct ``pairs`` (a, b) of names, a written table."""
    spark = sets.sparkSession
    wanted = common.written(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct(), "wanted-sets")
    names = F.broadcast(wanted) if wanted.count() <= MOST_NAMES else wanted
    held = common.written(sets.select("name", "hashes").join(names, "name", "left_semi").dropDuplicates(["name"]), "candidate-sets", "none")
    x, y = (held.select(F.col("name").alias(c), F.col("hashes").alias(f"of_{c}")) for c in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIR_ROWS))
    out = common.written(both.mapInArrow(_verified, "a long, b long"), "similar-pairs")
    common.prepare(spark)
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(x.as_buffer()) // 8 for x in batch.column(2)]
        if sum(sizes):
            name, n = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"name": name, "n": n, "token": np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)})
    common.release()


def prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The rarest hashes of each of the distinct ``members`` (name, root and ABOUT): those with ``cell`` and ``rank``.

    Hashes are ordered by how many members have them.  Similar sets share a hash
    among so many of the first of both that the rest is less than they must
    share; what texts have for themselves alone comes before it and is not written.
    """
    names = F.broadcast(members.select("name")) if members.count() <= MOST_NAMES else members.select("name")
    whole = sets.select("name", "n", "hashes").join(names, "name", "left_semi").dropDuplicates(["name"])
    tokens = common.written(whole.mapInArrow(_tokens, "name long, n long, token long"), "shingles")
    often = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    shared = tokens.join(often, "token")
    own = Window.partitionBy("name")
    rank = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "token")) - 1
    up, down = SIMILAR
    first = shared.withColumn("rank", rank).where((F.col("n") - F.col("rank")) * down >= up * F.col("n"))
    return first.select(F.col("token").alias("cell"), "rank", "name").join(members, "name")


class _Cells:
    """Members of cells, of which a Gray-ordered tree finds pairs of different components that can be similar.

    ``ranks`` are the places of the cells' hashes among those of each member:
    what two sets have from there on must be enough for what they must share.
    """

    def __init__(self, cells: np.ndarray, names: np.ndarray, roots: np.ndarray, n: np.ndarray, fp: np.ndarray, s1: np.ndarray, s2: np.ndarray, ranks: np.ndarray | None = None):
        values = fp.view(np.uint64)
        order = np.lexsort((gray_rank(values), cells))
        cells, values = cells[order], values[order]
        self.names, self.n, self.s1, self.s2 = names[order], n[order], s1[order], s2[order]
        self.rest = self.n if ranks is None else self.n - ranks[order]
        self.index = GrayIndex(values, cells, np.unique(roots[order], return_inverse=True)[1])
        self.lengths = np.diff([*np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])), len(cells)])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of both, some pairs at a time."""
        up, down = SIMILAR
        work = np.cumsum(np.repeat(self.lengths, self.lengths)) // CHUNK_PAIRS
        for part in np.split(np.arange(len(work)), np.flatnonzero(np.diff(work)) + 1):
            a, b = self.index.search(part, DISTANCE)
            sketch = np.bitwise_count(self.s1[a] ^ self.s1[b]).astype(int) + np.bitwise_count(self.s2[a] ^ self.s2[b])
            good = (sketch <= SKETCH_DISTANCE) & (down * np.minimum(self.n[a], self.n[b]) >= up * np.maximum(self.n[a], self.n[b]))
            good &= (up + down) * np.minimum(self.rest[a], self.rest[b]) >= up * (self.n[a] + self.n[b])
            yield a[good], b[good]


def _by_cell(found: Callable[[_Cells], Iterator[pa.RecordBatch]]):
    """A function of batches that are sorted by cell, their first column, for whole cells at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                if held[-1][0][-1] != held[0][0][0] and sum(len(h[0]) for h in held) >= CELL_ROWS:
                    columns = [np.concatenate(c) for c in zip(*held)]
                    cut = int(np.searchsorted(columns[0], columns[0][-1]))
                    yield from found(_Cells(*[c[:cut] for c in columns]))
                    held = [[c[cut:] for c in columns]]
        if held:
            yield from found(_Cells(*[np.concatenate(c) for c in zip(*held)]))
        common.release()

    return run


def _beside(cells: _Cells) -> Iterator[pa.RecordBatch]:
    """Names that have somebody to meet, once a cell: as many as its members at most."""
    met = np.zeros(len(cells.names), bool)
    for a, b in cells.pairs():
        met[a] = met[b] = True
    if met.any():
        yield pa.RecordBatch.from_pydict({"name": np.unique(cells.names[met])})


def _across(cells: _Cells) -> Iterator[pa.RecordBatch]:
    for a, b in cells.pairs():
        if len(a):
            x, y = cells.names[a], cells.names[b]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def link(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between names that connect all similar sets; ``sets`` is a written table with the columns of ``SETS``."""
    spark = sets.sparkSession
    names = common.written(sets.groupBy("name").agg(*[F.min(c).alias(c) for c in (*ABOUT, "keys")]), "names")
    rows = names.select(F.explode("keys").alias("cell"), "name")
    cells = rows.groupBy("cell").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low < high")
    cells = common.written(rows.join(cells, "cell"), "cells")
    ends = cells.select(F.explode(F.array("low", "high")).alias("x"), F.col("name").alias("y")).where("x <> y")
    a, b = (names.select(F.col("name").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ABOUT]) for side in ("a", "b"))
    pairs = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = common.written(pairs.join(a, "a").join(b, "b").where(_close("a", "b")).select("a", "b"), "candidate-pairs")
    edges = _verify(tried, sets)
    cells = common.written(cells.select("cell", "name").join(names.select("name", *ABOUT), "name"), "cells")
    for k in range(ROUNDS):
        some = _split(cells.where(F.pmod("cell", F.lit(ROUNDS)) == k), edges)
        centre = some.groupBy("cell").agg(F.min_by(F.struct("name", "root", *ABOUT), F.xxhash64("cell", "name")).alias("c"))
        pairs = common.written(_to_centres(some, centre).join(tried, ["a", "b"], "left_anti"), "candidate-pairs")
        found = _verify(pairs, sets)
        tried, edges = tried.unionByName(pairs), edges.unionByName(found)
        if found.count() * FRUITFUL <= pairs.count():
            break
    cells = _split(cells, edges)

    def searched(rows: DataFrame, *more: str) -> DataFrame:
        limit = max(CELL_ROWS, math.ceil(rows.count() / common.partitions(spark)))
        return dealt(rows, limit, F.xxhash64("name")).select("cell", "name", "root", *ABOUT, *more)

    met = searched(cells).mapInArrow(_by_cell(_beside), "name long").distinct()
    members = cells.groupBy("name").agg(*[F.min(c).alias(c) for c in ("root", *ABOUT)]).join(met, "name", "left_semi")
    members = common.written(members, "members")
    if members.isEmpty():
        return edges
    first = common.written(prefixes(members, sets), "prefixes")
    # What a large group has in common may be one text alone, which has least for itself.
    centre = first.groupBy("cell").agg(F.min_by(F.struct("name", "root", *ABOUT), F.struct("rank", "name")).alias("c"))
    pairs = common.written(_to_centres(first, centre).join(tried, ["a", "b"], "left_anti"), "candidate-pairs")
    found = _verify(pairs, sets)
    tried, edges = tried.unionByName(pairs), edges.unionByName(found)
    roots = components(edges).withColumnRenamed("v", "name")
    first = common.written(first.drop("root").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name")), "prefixes")
    rest = searched(first, "rank").mapInArrow(_by_cell(_across), "a long, b long")
    rest = common.written(rest.distinct().join(tried, ["a", "b"], "left_anti"), "candidate-pairs")
    return edges.unionByName(_verify(rest, sets))


def _to_centres(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with the struct ``c`` of its cell, if that is of another component and can be similar."""
    both = rows.join(centres, "cell").where("root <> c.root")
    both = both.select("name", F.col("c.name").alias("other"), *[F.col(c).alias(f"{c}_a") for c in ABOUT], *[F.col(f"c.{c}").alias(f"{c}_b") for c in ABOUT])
    return both.where(_close("a", "b")).select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct()


def _split(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of cells that have several components, with the root of each."""
    roots = components(edges).withColumnRenamed("v", "name")
    known = common.written(cells.select("cell", "name", *ABOUT).join(roots, "name", "left").withColumn("root", F.coalesce("root", "name")), "labelled-cells")
    several = known.groupBy("cell").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("cell")
    return common.written(known.join(several, "cell", "left_semi"), "split-cells")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids that go (doc_id), ids of several rows (doc_id), and sets whose groups have no row with an id (name); nothing else stays written."""
    spark = docs.sparkSession
    common.prepare(spark)
    with common.temporary(spark):
        rows = docs.select(common.named(id_col).cast("long").alias("doc_id"), common.named(text_col).alias("text"))
        sets = common.written(common.map_batches(rows, _sets, SETS), "shingle-sets", "none")
        rows = sets.select("doc_id", "name")
        by_id = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.count("*").alias("rows"))
        repeated = common.written(by_id.where("rows > 1"), "repeated-ids", keep=True)
        ties = rows.join(repeated.where("low <> high").select("doc_id", "low"), "doc_id").select(F.col("low").alias("a"), F.col("name").alias("b"))
        roots = components(link(sets).unionByName(ties)).withColumnRenamed("v", "name")
        placed = common.written(rows.join(roots, "name", "left").select("doc_id", "name", F.coalesce("root", "name").alias("root")), "groups")
        first = placed.groupBy("root").agg(F.min("doc_id").alias("first"))
        gone = common.written(placed.join(first, "root").where("doc_id <> first").select("doc_id").distinct(), "gone", keep=True)
        alone = placed.join(first.where("first IS NULL"), "root").groupBy("root").agg(F.min("name").alias("name")).select("name")
        return gone, repeated.select("doc_id"), common.written(alone, "nameless", keep=True)


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each group of near-duplicates alone, once."""
    gone, repeated, alone = groups(docs, id_col=id_col, text_col=text_col)
    whole = docs.select(common.as_row(docs), common.named(id_col).cast("long").alias("doc_id"), common.named(text_col).alias("text"))
    names = F.broadcast(gone) if gone.count() <= MOST_NAMES else gone
    kept = whole.where("doc_id IS NOT NULL").join(names, "doc_id", "left_anti")
    if not repeated.isEmpty():
        kept = _one_each(kept, repeated, "doc_id")
    # Rows without an id: one stays of each group that has no row with an id.
    nameless = whole.where("doc_id IS NULL")
    if not alone.isEmpty():
        of = F.udf(lambda t: int(np.array(xxhash.xxh3_64_intdigest(shingles(t).tobytes()), np.uint64).view(np.int64)), "long")
        nameless = nameless.withColumn("name", of("text")).join(alone, "name", "left_semi")
        kept = kept.select("row").unionByName(_one_each(nameless, alone, "name").select("row"))
    return kept.select(*[common.named(c, "row") for c in docs.columns])


def _one_each(rows: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """``rows`` with one row for each of the ``repeated`` keys: the one whose columns have the least hash."""
    order = Window.partitionBy(key).orderBy(F.xxhash64("row"), F.to_json("row"))
    several = rows.join(repeated, key, "left_semi").withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    return rows.join(repeated, key, "left_anti").unionByName(several)
