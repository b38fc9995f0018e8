"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad.  A line's features are counts of its own characters
and words and those of the lines beside it; the chain adds how labels follow
each other.  It is trained on a bounded sample of labelled documents whose
lines all carry the document's label, and a document's quality is the mean of
its lines' forward-backward marginals, weighted by their length, on a scale
that is fitted to the same sample.

The sample is bounded in documents and in lines: documents of more than
``TRAIN_DOC_LINES`` lines, and those of greatest hash beyond ``TRAIN_LINES`` lines of
all, are not learned from, and repeated rows once.  Every document is scored.

Cases: a null text is empty and an empty text is one blank line, and both get a
score; a text of any length is one chain of its lines; a label that is null is not
learned from; a null id stays null, is not held out and not learned from; rows
with one id are scored one by one; without both labels in the sample every score
is the share of label 1 (0.5 if there are none); an empty table stays empty; other
columns, labels, lang, source and ids are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Labelled documents that are learned from, those of least hash; the lines that they may have together, and one alone.
TRAIN_DOCS = 3000
TRAIN_LINES = 400_000
TRAIN_DOC_LINES = 10_000
THRESHOLD = 0.7
ROUNDS = 150
RIDGE = 1e-3
CAPITALS = common.UPPER.encode()
LETTERS = CAPITALS + common.UPPER.lower().encode()
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CLOSERS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "。".encode())
OWN = 14


def line_counts(text: str) -> list[tuple]:
    """Own features of each line and, last, its length in bytes and one."""
    rows, seen = [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        n, n_words = len(line) or 1, len(words) or 1
        letters = len(line) - len(line.translate(None, LETTERS))
        rows.append(
            (
                len(words) == 0,
                min(n, 400) / 400,
                min(n_words, 12) / 12,
                min(n / n_words, 30) / 30,
                letters / n,
                (len(line) - len(line.translate(None, CAPITALS))) / max(letters, 1),
                (len(line) - len(line.translate(None, MARKS))) / n,
                (len(line) - len(line.translate(None, SYMBOLS))) / n_words,
                min(line.count(b"!!") / n_words, 1),
                (len(line) - len(line.translate(None, DIGITS))) / n,
                1 - len(set(words)) / n_words if words else 0,
                sum(map(eq, words, words[1:])) / n_words,
                line.rstrip().endswith(CLOSERS),
                line in seen and len(words) > 0,
                len(line) + 1,
            )
        )
        seen.add(line)
    return rows


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, with those of the lines beside; weights of lines; lines of each text."""
    rows = [line_counts(t) for t in texts]
    lines = np.array([len(r) for r in rows], np.int64)
    flat = np.array([x for r in rows for x in r], np.float64).reshape(-1, OWN + 1)
    own, weight = flat[:, :OWN], flat[:, OWN]
    ends = np.cumsum(lines)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[ends - lines] = 0
    after[ends - 1] = 0
    first, last = np.zeros(len(own)), np.zeros(len(own))
    first[ends - lines], last[ends - 1] = 1, 1
    return np.column_stack([own, before, after, first, last, np.ones(len(own))]), weight, lines


WIDTH = 3 * OWN + 3


def _steps(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains from the longest to the shortest, and how many reach each step."""
    order = np.argsort(-lines, kind="stable")
    reach = len(lines) - np.searchsorted(np.sort(lines), np.arange(int(lines.max(initial=0))), side="right")
    return order, reach


def forward_backward(emission: np.ndarray, lines: np.ndarray, transition: np.ndarray, chain_weight: np.ndarray | None = None):
    """For chains whose line scores for label 1 over label 0 are laid end to end: log of the partition sum of
    each chain, marginal of label 1 for each line, and expected transitions of all chains, weighted."""
    chain_weight = np.ones(len(lines)) if chain_weight is None else chain_weight
    order, reach = _steps(lines)
    start = (np.cumsum(lines) - lines)[order]
    alpha, beta = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    now = None
    for t, n in enumerate(reach.tolist()):
        at = start[:n] + t
        score = np.stack([np.zeros(n), emission[at]], axis=1)
        if now is not None:
            score = score + np.logaddexp(now[:n, :1] + transition[0], now[:n, 1:] + transition[1])
        alpha[at] = now = score
    expected = np.zeros((2, 2))
    last = start + lines[order] - 1
    total = np.empty(len(lines))
    total[order] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    for t in range(len(reach) - 2, -1, -1):
        n = int(reach[t + 1])
        at = start[:n] + t
        follow = beta[at + 1].copy()
        follow[:, 1] += emission[at + 1]
        joint = transition[None] + follow[:, None, :]
        beta[at] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        seen = np.exp(alpha[at][:, :, None] + joint - total[order[:n]][:, None, None])
        expected += np.tensordot(chain_weight[order[:n]], seen, axes=1)
    chain = np.repeat(np.arange(len(lines)), lines)
    return total, np.exp(alpha[:, 1] + beta[:, 1] - total[chain]), expected


@dataclass(frozen=True)
class Model:
    """Weights of features for label 1 over label 0, of transitions, and of the scale; ``share`` if nothing was learned."""

    weights: np.ndarray
    transition: np.ndarray
    scale: tuple[float, float]
    share: float | None = None

    def raw(self, x: np.ndarray, weight: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each text."""
        _, marginal, _ = forward_backward(x @ self.weights, lines, self.transition)
        starts = np.cumsum(lines) - lines
        return np.add.reduceat(marginal * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.share is not None or not texts:
            return np.full(len(texts), self.share or 0.0)
        return _scaled(self.raw(*features(texts)), *self.scale)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _scaled(raw: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * _logit(raw) + offset, -500, 500)))


def _adam(value: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    first, second = np.zeros_like(value), np.zeros_like(value)
    for i in range(1, rounds + 1):
        g = gradient(value)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        value = value - rate * (1 - i / (rounds + 1)) * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-9)
    return value


def train(x: np.ndarray, weight: np.ndarray, lines: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Most likely weights, with a ridge, by gradient descent; every document counts alike."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), (1.0, 0.0), float(labels.mean()) if len(labels) else 0.5)
    line_label = np.repeat(labels, lines).astype(float)
    per_line = np.repeat(1 / lines, lines)
    stays = np.zeros((2, 2))
    for y in (0, 1):
        stays[y, y] = ((lines - 1) / lines)[labels == y].sum()

    def gradient(v: np.ndarray) -> np.ndarray:
        weights, transition = v[:WIDTH], v[WIDTH:].reshape(2, 2)
        _, marginal, expected = forward_backward(x @ weights, lines, transition, 1 / lines)
        slope = x.T @ ((marginal - line_label) * per_line)
        change = expected - stays
        return np.concatenate([slope, change.reshape(-1)]) / len(lines) + RIDGE * v

    v = _adam(np.zeros(WIDTH + 4), gradient, rounds, 0.3)
    model = Model(v[:WIDTH], v[WIDTH:].reshape(2, 2), (1.0, 0.0))
    raw = _logit(model.raw(x, weight, lines))

    def fit(s: np.ndarray) -> np.ndarray:
        wrong = 1 / (1 + np.exp(-np.clip(s[0] * raw + s[1], -500, 500))) - labels
        return np.array([(wrong * raw).mean(), wrong.mean()]) + 1e-3 * (s - np.array([1.0, 0.0]))

    slope, offset = _adam(np.array([1.0, 0.0]), fit, 400, 0.05)
    return Model(model.weights, model.transition, (max(float(slope), 1e-3), float(offset)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Model:
    """Train on the ``train_docs`` labelled documents of least hash that are not held out, up to ``train_lines`` lines.

    The sample is found by all tasks at once and written; the driver reads what is
    left of it, some 200 bytes a line.
    """
    common.prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    chosen = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.where(F.size(F.split("text", "\n", -1)) <= TRAIN_DOC_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x, weight, _ = features([text])
                columns = {"doc_id": [doc_id], "label": pa.array([label], pa.int32()), "n_lines": [len(weight)], "x": [x.astype("<f4").tobytes()], "weight": [weight.astype("<f8").tobytes()]}
                yield pa.RecordBatch.from_pydict(columns)

    found = common.written(rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, n_lines long, x binary, weight binary"), "labelled-lines")
    found = found.withColumn("key", F.xxhash64("x"))
    some = found.select("doc_id", "key", "n_lines").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(train_docs).collect()
    kept = [(r.doc_id, r.key) for r, lines in zip(some, accumulate(r.n_lines for r in some)) if lines <= train_lines]
    kept = docs.sparkSession.createDataFrame(kept, "doc_id long, key long")
    sample = found.join(F.broadcast(kept), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).collect()
    sample = sorted(sample, key=lambda r: (r.doc_id, r.x))
    weights = [np.frombuffer(r.weight, "<f8") for r in sample]
    x = np.concatenate([np.zeros((0, WIDTH)), *[np.frombuffer(r.x, "<f4").reshape(-1, WIDTH) for r in sample]])
    return train(x, np.concatenate([np.zeros(0), *weights]), np.array([len(w) for w in weights], np.int64), np.array([r.label for r in sample], np.int64))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return common.record(schema, [batch.column(0), shared.value.score(batch.column(1).to_pylist())])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = common.map_batches(rows, make, "doc_id long, score double")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), F.round("score", 9).alias("score"), (F.round("score", 9) >= threshold).cast("int").alias("predicted"))
