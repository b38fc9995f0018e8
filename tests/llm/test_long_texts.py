"""One document of millions of characters through every operator, beside ordinary ones."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from cases import frame
from tokenizers import Tokenizer

from tessera.llm import binary_ids, common, crf_quality, decontaminate, line_dedup, lm_score, near_sets, packing, quality_rules, simhash, token_counts

PATH, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARED = "a line that the long text and another document have in common"
ITEM = "the item of a benchmark that lies deep inside of the very long text"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(12)
    lines = [" ".join(f"w{rnd.randint(0, 40_000)}" for _ in range(12)) for _ in range(25_000)]
    lines[20_000] = SHARED
    lines[24_000] += f" {ITEM.upper()}!"
    lines[10] = "y" * 200_000
    return {1: "a short text\n" + SHARED, 2: "\n".join(lines), 3: "", 4: "another short text of a few words"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return common.written(frame(spark, [(d, t, "en", "s", 1) for d, t in texts.items()]).coalesce(1), "long-texts")


def test_ids(spark, docs, texts):
    tokenizer = Tokenizer.from_file(PATH)
    n = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    packed = packing.digest(packing.pack(docs, PATH)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == n
    path = common.scratch_path(spark, "long")
    binary_ids.write_segments(docs, PATH, path)
    assert {r.doc_id: r.n_tokens for r in binary_ids.read_documents(spark, path).collect()} == n


def test_counts(docs, texts):
    words = {d: t.split() for d, t in texts.items()}
    assert {r.doc_id: r.n_words for r in token_counts.count_tokens(docs, PIECES).collect()} == {d: len(w) for d, w in words.items()}
    judged = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert {d: (r.n_words, r.word_chars) for d, r in judged.items()} == {d: (len(w), sum(map(len, w))) for d, w in words.items()}
    assert {r.doc_id: r.n_words for r in lm_score.score(docs).collect()} == {d: len(w) for d, w in words.items()}


def test_lines(docs, texts):
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    lines = texts[2].split("\n")
    assert (kept[2].n_lines, kept[2].n_dropped) == (len(lines), 1) and kept[1].n_dropped == 0
    want = "\n".join(x for x in lines if x != SHARED)
    assert hashlib.sha256(kept[2].text.encode()).digest() == hashlib.sha256(want.encode()).digest()


def test_fingerprints(docs, texts):
    words = texts[2].lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)], np.uint64)
    bits = [2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes) for b in range(64)]
    want = f"{sum(1 << b for b, on in enumerate(bits) if on):016x}"
    found = {r.doc_id: r.fingerprint for r in simhash.digest(simhash.near_duplicates(docs)).collect()}
    assert found[2] == want and found[3] == "0" * 16
    assert sorted(r.doc_id for r in near_sets.keep_first(docs).collect()) == [1, 2, 3, 4]


def test_quality_and_leaks(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in crf_quality.score_documents(docs, crf_quality.learn(docs, labels)).collect()}
    assert set(scores) == {1, 2, 3, 4} and all(0 <= s <= 1 for s in scores.values())
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs, bench).collect()] == [(2, 7, 0)]
