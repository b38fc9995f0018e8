"""Quality rules as weak supervision.

Each rule looks at counts of a document and votes good, bad, or abstains.  No
rule decides: expectation-maximisation over the counts of vote patterns (3 to
the number of rules at most, whatever the corpus) estimates how often each rule
casts each vote on good and on bad documents, and a document is kept if its
posterior probability of being good is high enough.  Only the base limits of
the contract reject outright.

Cases: a null or empty text has no words and fails the base; a text of any length
is counted whole; a null id stays null; repeated rows are judged alike, each for
itself; an empty table stays empty; columns of any name are kept by the filter
and ignored by the counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP = 0.35
SYMBOLS = b"#*$%&|<>"
CAPITALS = common.UPPER.encode()
LETTERS = CAPITALS + common.UPPER.lower().encode()
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CLOSERS = (".", "!", "?", ":", ";", '"', "'", ")", "…", "。")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_letters", "n_capitals", "n_top_word", "n_shouts", "n_marks")
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Belief before EM: how often a voting rule votes bad on a bad and on a good document, and its weight in shares of the rows.
BAD_VOTES = (0.3, 0.01)
PRIOR = 0.02


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on and good up to ``good``; ``swap`` turns the sense of the ratio around."""

    name: str
    ratio: tuple[str, str]
    good: float
    bad: float
    least: int = 1

    def vote(self) -> Column:
        top, bottom = (F.col(c) for c in self.ratio)
        ratio = top / F.greatest(bottom, F.lit(1))
        low_is_good = self.good < self.bad
        bad, good = (ratio >= self.bad, ratio <= self.good) if low_is_good else (ratio <= self.bad, ratio >= self.good)
        return F.when(bottom < self.least, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


#: Every rule may abstain; limits follow the rules of public web corpora.
RULES = (
    Rule("word_length", ("word_chars", "n_words"), good=9.0, bad=12.0),
    Rule("symbols", ("n_symbols", "n_words"), good=0.02, bad=0.1),
    Rule("marks", ("n_marks", "word_chars"), good=0.08, bad=0.16),
    Rule("same_lines", ("n_dup_lines", "n_lines"), good=0.05, bad=0.3, least=2),
    Rule("same_windows", ("n_repeat_words", "n_words"), good=0.02, bad=0.15),
    Rule("open_lines", ("n_closed_lines", "n_lines"), good=0.6, bad=0.2, least=2),
    Rule("capitals", ("n_capitals", "n_letters"), good=0.1, bad=0.3),
    Rule("top_word", ("n_top_word", "n_words"), good=0.12, bad=0.25, least=20),
    Rule("shouts", ("n_shouts", "n_words"), good=0.01, bad=0.1),
)


def repeat_words(docs: list[list[bytes]]) -> np.ndarray:
    """For each list of words, how many lie in a window of five that comes twice or more in it.

    Windows of equal hash, of all documents at once, are compared word by word.
    """
    sizes = np.array([len(w) for w in docs], np.int64)
    total = int(sizes.sum())
    out = np.zeros(len(docs), np.int64)
    if total < WINDOW:
        return out
    words = [w for some in docs for w in some]
    hashes = np.fromiter(map(hash, words), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    n = total - WINDOW + 1
    with np.errstate(over="ignore"):
        window = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        window ^= window >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = inside[np.argsort(window[inside], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return out
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    found: dict[tuple, list[int]] = {}
    for i in order[twin].tolist():
        found.setdefault((doc[i], *words[i : i + WINDOW]), []).append(i)
    starts = np.array([i for places in found.values() if len(places) > 1 for i in places], np.int64)
    steps = np.bincount(starts, minlength=total + 1) - np.bincount(starts + WINDOW, minlength=total + 1)
    covered = np.cumsum(steps[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(docs))


def count(texts: list[str]) -> list[np.ndarray]:
    """The counts of ``COUNTS`` for each text."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [raw.split() for raw in raws]
    rows = []
    for text, raw, some in zip(texts, raws, words):
        lines = [line for line in text.split("\n") if line.strip(common.BLANKS)]
        top = max(Counter(some).values(), default=0)
        rows.append(
            (
                len(some),
                len(text) - sum(map(text.count, common.BLANKS)),
                len(raw) - len(raw.translate(None, SYMBOLS)),
                len(lines) - len(set(lines)),
                0,
                len(lines),
                sum(line.rstrip(common.BLANKS).endswith(CLOSERS) for line in lines),
                len(raw) - len(raw.translate(None, LETTERS)),
                len(raw) - len(raw.translate(None, CAPITALS)),
                top,
                raw.count(b"!!"),
                len(raw) - len(raw.translate(None, MARKS)),
            )
        )
    columns = list(np.array(rows, np.int64).reshape(len(rows), len(COUNTS)).T)
    columns[COUNTS.index("n_repeat_words")] = repeat_words(words)
    return columns


def counts_of(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(dict(zip(COUNTS, count(texts.tolist()))))
    common.release()
    return out


def measured(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` as the struct ``row`` beside the counts of its text; null texts are empty."""
    common.prepare(docs.sparkSession)
    row = common.as_row(docs)
    return docs.select(row, F.pandas_udf(counts_of, ", ".join(f"{c} long" for c in COUNTS))(F.coalesce(common.named(text_col), F.lit(""))).alias("counts")).select("row", "counts.*")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray]:
    """EM over vote patterns: the share of good documents, and P(bad vote | class, a vote) as [class, rule].

    Abstentions say nothing.  Faults seldom come together, so EM alone could
    make one kind of fault a class of its own; prior counts of PRIOR times the
    rows hold every rule near the belief that it errs seldom on good documents.
    """
    belief = np.repeat([[BAD_VOTES[BAD]], [BAD_VOTES[GOOD]]], patterns.shape[1], axis=1)
    prior = PRIOR * counts.sum() + 1
    table, share = belief, 0.85
    bad_votes, some_vote = (patterns == BAD).astype(float), (patterns != ABSTAIN).astype(float)
    for _ in range(rounds):
        good = posterior(patterns, share, table)
        mass = np.stack([counts * (1 - good), counts * good])
        share = (mass[GOOD].sum() + 0.85 * prior) / (mass.sum() + prior)
        fresh = (mass @ bad_votes + prior * belief) / (mass @ some_vote + prior)
        done = np.abs(fresh - table).max() < 1e-9
        table = fresh
        if done:
            break
    return share, table


def weights(table: np.ndarray) -> np.ndarray:
    """What a vote of each rule adds to the log odds of a good document, as [vote, rule]."""
    return np.stack([np.log(table[GOOD] / table[BAD]), np.log((1 - table[GOOD]) / (1 - table[BAD])), np.zeros(table.shape[1])])


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    odds = np.log(share / (1 - share)) + weights(table)[patterns, np.arange(patterns.shape[1])].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


@dataclass(frozen=True)
class Judge:
    """What EM has learned: the share of good documents and the rules' behaviour."""

    share: float
    table: np.ndarray
    rules: tuple[Rule, ...] = RULES

    @classmethod
    def learned(cls, counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> Judge:
        """From the vote patterns of all rows; only the patterns reach the driver, 3 to the number of rules at most."""
        votes = counts.select(*[r.vote().alias(r.name) for r in rules])
        seen = votes.groupBy(*votes.columns).agg(F.count("*").alias("n")).collect()
        patterns = np.array([row[:-1] for row in seen], np.int64).reshape(len(seen), len(rules))
        return cls(*estimate(patterns, np.array([row[-1] for row in seen], float)), rules)

    def verdicts(self, counts: DataFrame, keep: float = KEEP) -> DataFrame:
        """``counts`` with ``base_failed``, ``posterior`` and ``kept``."""
        odds: Column = F.lit(float(np.log(self.share / (1 - self.share))))
        for rule, w in zip(self.rules, weights(self.table).T):
            vote = rule.vote()
            odds = odds + F.when(vote == BAD, float(w[BAD])).when(vote == GOOD, float(w[GOOD])).otherwise(0.0)
        failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
        out = counts.withColumn("base_failed", failed).withColumn("posterior", F.round(1 / (1 + F.exp(-odds)), 9))
        return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, posterior and verdict of every document; texts are read once."""
    rows = measured(docs, text_col=text_col)
    counts = common.written(rows.select(common.named(id_col, "row").cast("long").alias("doc_id"), *COUNTS), "rule-counts")
    return Judge.learned(counts).verdicts(counts)


def keep_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Rows are written beside their counts: EM reads the counts alone, the verdict
    the rest, and no text is counted twice or moved by a shuffle.
    """
    rows = common.written(measured(docs, text_col=text_col), "counted-rows")
    kept = Judge.learned(rows.select(*COUNTS)).verdicts(rows).where("kept")
    return kept.select(*[common.named(c, "row") for c in docs.columns])
