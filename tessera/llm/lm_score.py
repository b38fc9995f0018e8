"""Stupid-backoff scores of an n-gram model of the corpus itself.

    score(w | c) = count(c w) / count(c)          if count(c w) >= min_count
                   ALPHA * score(w | c')          otherwise, c' without its first word
    score(w)     = count(w) / words

and a document's score is the mean of its words' decimal logarithms, each after
as many of the words before it as the order allows.  An n-gram that occurs once
occurs in the scored document alone, so at a ``min_count`` of 1 the corpus would
vouch for every n-gram of its own and nothing would ever back off; at 2 an n-gram
must have been met elsewhere or again.

``score_by_join`` is the relational form, for any order, by DataFrames alone:
n-gram counts partitioned by hash, joined to the exploded n-grams of the
documents, and summed for each document.  A known n-gram adds to a document's sum
what it scores above backing off, so one table of such gains serves all orders.

A row for every n-gram of every document is several times the corpus.  For
bigrams ``score`` keeps the same relations in blocks, as long as these have rows
enough to be worth it:

1. documents of some megabytes become a block: the 64-bit hashes of its words
   and its text as word numbers;
2. a block's distinct n-grams are sorted by hash and cut into buckets; a bucket
   gets one row from each block, whatever the n-gram's frequency;
3. a bucket adds up its counts and answers each block in the block's own order;
4. the answers meet their block again, which scores its documents.

Blocks and buckets both grow with the corpus, so beyond ``MOST_SLICES`` rows, when
a row has few n-grams left, the join takes over.

Cases: a null, empty or blank text has no words and a null score; a text of any
length is one list of words; words are lower-cased in A-Z; repeated rows count
and are scored as often as they come; an empty table stays empty; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

ALPHA = 0.4
MIN_COUNT = 2
#: Characters after which a block is closed, and n-grams that a bucket should hold.
BLOCK_CHARS = 8 << 20
BUCKET_NGRAMS = 1_000_000
#: Blocks times buckets up to which n-grams travel in blocks.
MOST_SLICES = 50_000_000
#: Words whose hash a worker keeps, and bytes of a word that is worth keeping.
CACHE_WORDS = 400_000
LONG = 64

BLOCKS = "block long, n_words long, n_ngrams long, data binary"
SLICES = "bucket long, block long, data binary"
ANSWERS = "block long, bucket long, data binary"


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) & ~1
        if len(word) <= LONG:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_word_hash = _WordHash()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; numbers are stored plane by plane."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        width = a.dtype.itemsize
        parts += [np.array([width, len(a)], "<i8").tobytes(), np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8, []
    for kind in kinds:
        width, n = np.frombuffer(raw, "<i8", 2, at)
        planes = np.frombuffer(raw, np.uint8, width * n, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 16 + int(width * n)
    return out


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))


def build_block(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the words of all documents as numbers of these, and words for each document."""
    sizes = np.array([len(h) for h in hashes], np.uint32)
    vocabulary, numbers = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True)
    return vocabulary, numbers.astype(np.uint32), sizes


def ngrams(vocabulary: np.ndarray, numbers: np.ndarray, sizes: np.ndarray):
    """Distinct n-grams of a block: hashes in order, counts, the place of each word and of the bigram that each word ends.

    Hashes of words are even, those of bigrams odd.  First words end none: -1.
    """
    n = len(numbers)
    follows = np.ones(n, bool)
    starts = np.cumsum(sizes.astype(np.int64)) - sizes
    follows[starts[sizes > 0]] = False
    ends = np.flatnonzero(follows)
    pairs = numbers[ends - 1].astype(np.uint64) * np.uint64(len(vocabulary) + 1) + numbers[ends]
    distinct, which, pair_counts = np.unique(pairs, return_inverse=True, return_counts=True)
    with np.errstate(over="ignore"):
        first, second = (vocabulary[x.astype(np.int64)] for x in np.divmod(distinct, np.uint64(len(vocabulary) + 1)))
        x = first * np.uint64(0x9E3779B97F4A7C15) + second
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bigrams = (x ^ (x >> np.uint64(32))) | np.uint64(1)
    hashes = np.concatenate([vocabulary, bigrams])
    counts = np.concatenate([np.bincount(numbers, minlength=len(vocabulary)), pair_counts])
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ended = np.full(n, -1, np.int64)
    ended[ends] = place[len(vocabulary) + which]
    return hashes[order], counts[order], place[numbers], ended


def score_block(totals: np.ndarray, word_at: np.ndarray, bigram_at: np.ndarray, sizes: np.ndarray, corpus_words: int):
    """Sum of log10 scores and number of words that were backed off, for each document of a block."""
    words = totals[word_at].astype(float)
    bigrams = np.where(bigram_at >= 0, totals[bigram_at], 0).astype(float)
    known = bigrams > 0
    before = np.concatenate([[1.0], words[:-1]]) if len(words) else words
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.where(known, np.log10(bigrams / before), np.log10(words / corpus_words))
    backed = ~known & (bigram_at >= 0)
    log += np.where(backed, np.log10(ALPHA), 0.0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(doc, log, minlength=len(sizes)), np.bincount(doc, backed, minlength=len(sizes)).astype(np.int64)


def _make_blocks(block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        words: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            vocabulary, numbers, sizes = build_block(words)
            known = np.array([d if d is not None else 0 for d in ids], np.int64)
            null = np.array([d is None for d in ids], np.uint8)
            data = pack(vocabulary, numbers, sizes, known, null)
            return pa.RecordBatch.from_pydict({"block": [block], "n_words": [len(numbers)], "n_ngrams": [len(vocabulary) + len(numbers)], "data": [data]})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                words.append(word_hashes(text))
                size += len(text)
                if size >= block_chars:
                    yield close()
                    block, ids, words, size = block + 1, [], [], 0
        if ids:
            yield close()

    return run


BLOCK_KINDS = ("<u8", "<u4", "<u4", "<i8", "u1")


def _slice(buckets: int):
    shift = np.uint64(64 - (buckets - 1).bit_length())
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes, counts, _, _ = ngrams(*unpack(data.as_py(), *BLOCK_KINDS)[:3])
                bucket = (hashes >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(k, block, pack(np.diff(hashes[a:b], prepend=np.uint64(0)), counts[a:b].astype(np.uint32))) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield common.record(schema, list(zip(*rows))) if rows else pa.RecordBatch.from_pylist([], schema)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each value of the first column, by which the input is sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
            key = row[0].as_py()
            if held and held[0][0] != key:
                yield held[0][0], held
                held = []
            held.append((key, *(x.as_py() for x in row[1:])))
    if held:
        yield held[0][0], held


def _add_up(min_count: int):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches):
            slices = [unpack(data, "<u8", "<u4") for _, _, data in rows]
            hashes = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in slices])
            counts = np.concatenate([c for _, c in slices]).astype(np.int64)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            sums = np.add.reduceat(counts[order], heads)
            sums[(sums < min_count) & (ordered[heads] & np.uint64(1) == 1)] = 0
            total = np.empty(len(order), np.int64)
            total[order] = np.repeat(sums, np.diff([*heads, len(order)]))
            cuts = np.cumsum([0] + [len(c) for _, c in slices])
            yield common.record(schema, [[b for _, b, _ in rows], [bucket] * len(rows), [pack(total[x:y]) for x, y in zip(cuts, cuts[1:])]])

    return run


def _score(corpus_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log10_sum", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            rows.sort(key=lambda row: row[1])  # the block has bucket -1
            vocabulary, numbers, sizes, ids, null = unpack(rows[0][2], *BLOCK_KINDS)
            _, _, word_at, bigram_at = ngrams(vocabulary, numbers, sizes)
            answers = [unpack(data, "<i8")[0] for _, _, data in rows[1:]]
            totals = np.concatenate(answers) if answers else np.zeros(1, np.int64)
            sums, backed = score_block(totals, word_at, bigram_at, sizes, corpus_words)
            yield common.record(schema, [pa.array(ids, mask=null.astype(bool)), sizes.astype(np.int64), backed, sums])

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, min_count: int = MIN_COUNT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_backoff`` and ``lm_score``, the mean log10 score of a word, of every document."""
    spark = docs.sparkSession
    common.prepare(spark)
    if order != 2:
        return score_by_join(docs, id_col=id_col, text_col=text_col, order=order, min_count=min_count)
    n_parts = common.partitions(spark)
    rows = docs.select(common.named(id_col).cast("long").alias("doc_id"), F.coalesce(common.named(text_col), F.lit("")).alias("text"))
    blocks = common.written(rows.mapInArrow(_make_blocks(block_chars), BLOCKS), "lm-blocks", codec="none")
    n_blocks, words, grams = blocks.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_ngrams"), F.lit(0))).first()
    buckets = 1 << max(0, max(2 * n_parts, grams // BUCKET_NGRAMS) - 1).bit_length()
    if n_blocks * buckets > MOST_SLICES:
        return score_by_join(docs, id_col=id_col, text_col=text_col, order=order, min_count=min_count)
    slices = blocks.select("block", "data").mapInArrow(_slice(buckets), SLICES)
    answers = slices.repartition(n_parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_add_up(min_count), ANSWERS)
    both = answers.unionByName(blocks.select("block", F.lit(-1).cast("long").alias("bucket"), "data"))
    scored = both.repartition(n_parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(_score(max(words, 1)), "doc_id long, n_words long, n_backoff long, log10_sum double")
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log10_sum") / F.col("n_words"), 6))
    return scored.select("doc_id", "n_words", "n_backoff", mean.alias("lm_score"))


def exploded(docs: DataFrame, order: int) -> DataFrame:
    """The n-grams of rows (key, words), words as hashes: ``size``, ``gram``, the grams before and after its ends (``context``, ``rest``), and ``longest``, whether a longer one could end there."""
    words = F.col("words")

    def hashed(at: Column, size: int) -> Column:
        return F.xxhash64(F.slice(words, at + 1, size))

    def of_size(k: int) -> Column:
        none = F.lit(0).cast("long")

        def gram(i: Column) -> Column:
            context, rest = (hashed(i, k - 1), hashed(i + 1, k - 1)) if k > 1 else (none, none)
            return F.struct(F.lit(k).alias("size"), hashed(i, k).alias("gram"), context.alias("context"), rest.alias("rest"), (F.lit(k == order) | (i == 0)).alias("longest"))

        every = F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), gram))
        return F.coalesce(every, F.array().cast("array<struct<size:int,gram:bigint,context:bigint,rest:bigint,longest:boolean>>"))

    sizes = [of_size(k) for k in range(1, order + 1)]
    return docs.select("key", F.explode(F.concat(*sizes)).alias("g")).select("key", "g.*")


def score_by_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, min_count: int = MIN_COUNT) -> DataFrame:
    """The same by joins, for any order; nothing runs in Python."""
    common.prepare(docs.sparkSession)
    blank = "[\\x20\\x09-\\x0D]+"
    text = common.lowered(F.coalesce(common.named(text_col), F.lit("")))
    words = F.transform(F.filter(F.split(text, blank), lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = docs.select(common.named(id_col).cast("long").alias("doc_id"), words.alias("words"))
    # Written, so that the keys of rows stay what they are.
    rows = common.written(rows.withColumn("key", F.monotonically_increasing_id()), "lm-words")
    grams = exploded(rows, order)
    counts = grams.groupBy("size", "gram", "context", "rest").agg(F.count("*").alias("n"))
    counts = common.written(counts.where((F.col("size") == 1) | (F.col("n") >= min_count)), "lm-counts")
    total = max(rows.agg(F.sum(F.size("words"))).first()[0] or 0, 1)
    known = counts.where("size = 1").select("gram", "n", F.log10(F.col("n") / total).alias("score"))
    gains = known.select(F.lit(1).alias("size"), "gram", F.col("score").alias("gain"))
    for k in range(2, order + 1):
        shorter = known.select(F.col("gram").alias("context"), F.col("n").alias("n_context")), known.select(F.col("gram").alias("rest"), F.col("score").alias("rest_score"))
        longer = counts.where(F.col("size") == k).join(shorter[0], "context").join(shorter[1], "rest").withColumn("score", F.log10(F.col("n") / F.col("n_context")))
        gains = gains.unionByName(longer.select(F.lit(k).alias("size"), "gram", (F.col("score") - F.lit(math.log10(ALPHA)) - F.col("rest_score")).alias("gain")))
        known = common.written(longer.where(F.col("n") >= min_count).select("gram", "n", "score"), "lm-known")
    met = grams.groupBy("key", "size", "gram", "longest").agg(F.count("*").alias("times")).join(gains, ["size", "gram"], "left")
    backed = F.when(F.col("longest") & (F.col("size") > 1) & F.col("gain").isNull(), F.col("times")).otherwise(0)
    worth = F.coalesce("gain", F.lit(0.0)) + F.when(F.col("size") > 1, math.log10(ALPHA)).otherwise(0.0)
    sums = met.groupBy("key").agg(F.sum(F.col("times") * worth).alias("log10_sum"), F.sum(backed).cast("long").alias("n_backoff"))
    n_words = F.size("words").cast("long")
    out = rows.join(sums, "key", "left").select("doc_id", n_words.alias("n_words"), F.coalesce("n_backoff", F.lit(0)).cast("long").alias("n_backoff"), "log10_sum")
    return out.select("doc_id", "n_words", "n_backoff", F.when(F.col("n_words") > 0, F.round(F.col("log10_sum") / F.col("n_words"), 6)).alias("lm_score"))
