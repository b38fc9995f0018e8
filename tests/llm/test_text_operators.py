"""Token counts, line dedup, LM scores, quality rules against brute force."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import awkward, frame, rows_of
from pyspark.sql import functions as F

from tessera.llm import line_dedup, lm_score, perfect_hash, quality_rules, token_counts

PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken")
BLANK = "\x20\t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_automaton_is_greedy_longest_match():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        vocabulary = {bytes(rnd.integers(97, 100, rnd.integers(1, 6)).astype(np.uint8)) for _ in range(rnd.integers(1, 12))}
        if rnd.random() < 0.7:
            vocabulary |= {b"a", b"b", b"c"}
        automaton = token_counts.Automaton(vocabulary)
        for _ in range(60):
            word = bytes(rnd.integers(97, 100, rnd.integers(1, 14)).astype(np.uint8))
            at = n = 0
            while at < len(word):
                size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in vocabulary), default=0)
                if not size:
                    n = 1
                    break
                at, n = at + size, n + 1
            assert automaton.count(word) == n, (vocabulary, word)


def test_token_counts(spark):
    vocabulary = {base64.b64decode(line.split()[0]) for line in open(PIECES, "rb") if line.strip()}
    longest = max(map(len, vocabulary))

    def pieces(word):
        raw, at, n = b" " + word.encode(), 0, 0
        while at < len(raw):
            at += next(k for k in range(min(longest, len(raw) - at), 0, -1) if raw[at : at + k] in vocabulary)
            n += 1
        return n

    rows = awkward(n=12)
    got = rows_of(token_counts.count_tokens(frame(spark, rows), PIECES), "doc_id", "n_words", "n_pieces")
    assert got == sorted(((r[0], len(words(r[1])), sum(map(pieces, words(r[1])))) for r in rows), key=repr)
    assert token_counts.count_tokens(frame(spark, []), PIECES).count() == 0


def test_perfect_hash():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = rnd.integers(0, 2**63, n, dtype=np.uint64), rnd.integers(0, 5, n, dtype=np.uint64)
        hashed = perfect_hash.PerfectHash(perfect_hash.build(a, b))
        assert sorted(hashed.numbers(a, b).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def dedup(rows):
    order = {}
    for i, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            key = line.strip(BLANK).translate(LOW)
            if len(key) >= 10:
                order.setdefault(key, set()).add(line_dedup.LAST_ID if r[0] is None else r[0])
    out = []
    for r in rows:
        doc = line_dedup.LAST_ID if r[0] is None else r[0]
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(BLANK).translate(LOW)) >= 10 and len(order[k]) > 1 and min(order[k]) != doc)]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts, most, shard", [(1, 10**6, 10**6), (4, 0, 10**6), (3, 10**6, 2), (2, 0, 3)])
def test_line_dedup(spark, monkeypatch, parts, most, shard):
    monkeypatch.setattr(line_dedup, "PROBE_KEYS", most)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    shared = ["Shared LINE number one", "  shared line NUMBER one\t", "éÉ another line", "short", "shared\xa0line number two"]
    rows = [(r[0], "\n".join([r[1] or "", shared[i % 5], shared[(i * 3) % 5], shared[i % 2]]) if r[1] is not None and i % 4 else r[1], *r[2:]) for i, r in enumerate(awkward(n=40))]
    got = line_dedup.dedup_lines(frame(spark, rows).repartition(parts))
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "text") == dedup(rows)
    assert set(frame(spark, []).columns) <= set(got.columns) and got.where("lang = 'en'").count() > 0
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_a_line_of_every_document(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "PROBE_KEYS", most)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line\nown line number "), F.col("id")).alias("text"))
    got = line_dedup.dedup_lines(docs.repartition(8))
    assert got.where("n_dropped = 1").count() == 2999 and got.where("doc_id = 0").first().n_dropped == 0


def backoff_scores(rows, order):
    docs = [words((r[1] or "").translate(LOW)) for r in rows]
    counts = Counter(tuple(d[i : i + k]) for d in docs for k in range(1, order + 1) for i in range(len(d) - k + 1))
    total = sum(len(d) for d in docs)

    def score(gram):
        if len(gram) == 1:
            return math.log10(counts[gram] / total)
        return math.log10(counts[gram] / counts[gram[:-1]]) if counts[gram] >= 2 else math.log10(0.4) + score(gram[1:])

    want = []
    for r, d in zip(rows, docs):
        grams = [tuple(d[max(0, i - order + 1) : i + 1]) for i in range(len(d))]
        want.append((r[0], len(d), sum(len(g) > 1 and counts[g] < 2 for g in grams), sum(map(score, grams)) / len(d) if d else None))
    return sorted(want, key=lambda x: repr((x[0], x[1], x[2], None if x[3] is None else round(x[3], 6))))


@pytest.mark.parametrize("order, block, slices", [(2, 200, 10**9), (2, 1 << 20, 10**9), (2, 200, 0), (1, 0, 0), (3, 0, 0)])
def test_lm_scores(spark, monkeypatch, order, block, slices):
    monkeypatch.setattr(lm_score, "MOST_SLICES", slices)
    rows = awkward(n=25)
    got = rows_of(lm_score.score(frame(spark, rows).repartition(3), order=order, block_chars=block), "doc_id", "n_words", "n_backoff", "lm_score")
    for g, w in zip(got, backoff_scores(rows, order), strict=True):
        assert g[:3] == w[:3] and (g[3] is None) == (w[3] is None) and (g[3] is None or abs(g[3] - w[3]) < 1e-5)
    assert lm_score.score(frame(spark, []), order=order).count() == 0


def base_counts(text):
    text = text or ""
    some = words(text)
    places = defaultdict(list)
    for i in range(len(some) - 4):
        places[tuple(some[i : i + 5])].append(i)
    covered = {k for found in places.values() if len(found) > 1 for i in found for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(some), sum(map(len, some)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    good = "This is a perfectly ordinary sentence number {i} about gardens, rivers and the weather of the day.\nAnother line follows it here, also number {i}.\n"
    rows = awkward(n=20) + [(1000 + i, good.format(i=i) * 1 + f"Something else {i * 7} closes it.", "en", "s", 1) for i in range(300)]
    rows += [(2000 + i, " | ".join(f"cell{i}{k}%%%" for k in range(30)), "en", "s", 1) for i in range(30)] + [(3000 + i, "SPAM SPAM!! BUY!! NOW!! " * 20, "en", "s", 1) for i in range(10)]
    got = {(r.doc_id, r.n_words): r for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    for r in rows:
        n_words, *rest = base_counts(r[1])
        row = got[r[0], n_words]
        assert [row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words] == rest
        assert row.base_failed == (n_words < 10 or 100 * rest[3] > 20 * n_words) and not (row.base_failed and row.kept)
    assert all(got[k].kept for k in got if k[0] and 1000 <= k[0] < 2000) and not any(got[k].kept for k in got if k[0] and k[0] >= 2000)
    kept = quality_rules.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(r.kept * (1 + (r.doc_id == 104)) for r in got.values())
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0 and quality_rules.keep_good(frame(spark, [])).count() == 0


def test_repeat_words_with_equal_hashes_of_windows():
    docs = [[b"a"] * 9, [], [b"a", b"b"] * 5, [b"x%d" % i for i in range(20)], [b"p", b"q", b"r", b"s", b"t", b"u", b"p", b"q", b"r", b"s", b"t"]]
    assert quality_rules.repeat_words(docs).tolist() == [base_counts(" ".join(w.decode() for w in d))[4] for d in docs]


def test_digest_of_kept_text(spark):
    from tessera.llm import entry

    rows = [(1, "first long line\nshared long line", "", "", 0), (2, "shared long line\nsecond", "", "", 0)]
    assert entry.oracle_sql()["op3_line_dedup"]
    kept = line_dedup.dedup_lines(frame(spark, rows)).orderBy("doc_id").collect()
    assert [hashlib.sha256(r.text.encode()).hexdigest() for r in kept] == [hashlib.sha256(t.encode()).hexdigest() for t in ("first long line\nshared long line", "second")]
