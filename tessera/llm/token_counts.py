"""Token counts by a linear longest-match automaton.

The greedy word-piece length of a word is the number of pieces that repeated
longest match from the left gives.  The automaton is a trie of the vocabulary;
each node has a failure link, to the node of what is left after the pieces that
its string surely begins with, and the number of those pieces.  A word is read
once, byte by byte, and no piece is ever built.

Words are maximal runs without white space; the first piece of a word may begin
with a blank, as the vocabulary of byte-level BPE has it.  Counts add up over
words, so each worker keeps the counts of the words that it has met.

Cases: null, empty and blank texts have no words and no pieces; a text of any
length is counted whole, one word after the other, and words over ``LONG`` bytes
are not kept; null ids stay null; repeated rows are counted alike; an empty table
stays empty; other columns are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Words that a worker keeps, beyond which the cache starts anew, and bytes of a word that is worth keeping.
CACHE_WORDS = 1_000_000
LONG = 64
START = b" "

_counters: dict[str, WordCounts] = {}


class Automaton:
    """Counts the pieces of greedy longest match over a set of byte strings."""

    def __init__(self, vocabulary: set[bytes]):
        self.children: list[dict[int, int]] = [{}]
        final = [False]
        parents, order = [(0, 0)], [0]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    final.append(False)
                    parents.append((node, byte))
                node = self.children[node][byte]
            final[node] = True
        for node in order:
            order.extend(self.children[node].values())
        #: Where reading goes on once the pieces counted in ``popped`` are gone; -1 if nothing matches.
        self.failure, self.popped = [-1] * len(final), [0] * len(final)
        for node in order[1:]:
            parent, byte = parents[node]
            if final[node]:
                self.failure[node], self.popped[node] = 0, 1
                continue
            at, popped = self.failure[parent], self.popped[parent]
            while at >= 0 and byte not in self.children[at]:
                popped += self.popped[at]
                at = self.failure[at]
            if at >= 0:
                self.failure[node], self.popped[node] = self.children[at][byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1, the unknown piece, if the vocabulary can't spell it."""
        node, pieces = 0, 0
        children, failure, popped = self.children, self.failure, self.popped
        for byte in word:
            while (to := children[node].get(byte)) is None:
                pieces += popped[node]
                node = failure[node]
                if node < 0:
                    return 1
            node = to
        while node > 0:
            pieces += popped[node]
            node = failure[node]
        return pieces if node == 0 else 1


class WordCounts(dict):
    """Pieces of words, counted when they are first asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as file:
            self.automaton = Automaton({base64.b64decode(line.split()[0]) for line in file if line.strip()})

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(START + word)
        if len(word) <= LONG:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    @classmethod
    def of(cls, path: str) -> WordCounts:
        """The worker's own counts for this vocabulary file, one base64 piece and its rank a line."""
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, greedy pieces and bytes of the text of every document, in one pass without a shuffle."""
    common.prepare(docs.sparkSession)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_pieces", "n_bytes")])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = WordCounts.of(vocabulary)
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            words = [raw.split() for raw in raws]
            return common.record(schema, [batch.column(0), list(map(len, words)), [sum(map(counts.__getitem__, w)) for w in words], list(map(len, raws))])

        return step

    rows = docs.select(common.named(id_col).cast("long").alias("doc_id"), F.coalesce(common.named(text_col), F.lit("")).alias("text"))
    return common.map_batches(rows, make, "doc_id long, n_words long, n_pieces long, n_bytes long")
