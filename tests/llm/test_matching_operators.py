"""Near-duplicates, components, decontamination, the CRF, chats and the pipeline."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from cases import awkward, frame, rows_of

import corpus_pipeline
from tessera.llm import chat_format, common, crf_quality, decontaminate, near_sets, simhash
from tessera.llm import components as contraction
from tessera.llm.components import components, local_roots


LAST_ID = (1 << 63) - 1


def fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w.decode() for w in low.encode().split()]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints):
    """Smallest id reachable over pairs of prints within four bits, and over equal ids; null ids tie nothing."""
    a, b = [], []
    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4 or None is not ids[i] == ids[j]:
            a.append(i)
            b.append(j)
    roots = local_roots(len(ids), np.array(a, int), np.array(b, int))
    best = {}
    for i, r in enumerate(roots.tolist()):
        best[r] = min((x for x in (best.get(r), ids[i]) if x is not None), default=None)
    return [best[r] for r in roots.tolist()]


def near(rows, seed=0):
    rnd = random.Random(seed)
    out = list(rows)
    base = [f"tok{rnd.randint(0, 500)}" for _ in range(120)]
    for i in range(25):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"new{rnd.randint(0, 99)}"
        out.append((500 + i, " ".join(words), "en", "s", 1))
    return out


@pytest.mark.parametrize("parts, many", [(1, 1 << 27), (4, 1 << 27), (3, 0)])
def test_near_duplicates(spark, monkeypatch, parts, many):
    monkeypatch.setattr(simhash, "MANY_PRINTS", many)
    rows = near(awkward(n=25)) + [(None, "quite another document that has no id either, and that nobody ties to others", "en", "s", 1)] * 2 + [(None, "one two three four", "en", "s", 1), (900, "one two three four", "en", "s", 1)]
    prints = [fingerprint(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    want = sorted(((i, f"{p:016x}", g) for i, p, g in zip(ids, prints, groups(ids, prints))), key=repr)
    assert rows_of(simhash.digest(simhash.near_duplicates(frame(spark, rows).repartition(parts))), "doc_id", "fingerprint", "component_id") == want


def test_fingerprints_of_texts_in_pieces(monkeypatch):
    rnd = random.Random(3)
    texts = ["", " \n", "one", "a b c d", "a b c d e", *[" ".join(rnd.choice(["x", "yy", "z" * 30, "é"]) + rnd.choice(["", "\t", "\n "]) for _ in range(rnd.randint(1, 60))) for _ in range(300)]]
    want = [(simhash.fingerprint(t) % (1 << 64), near_sets.shingles(t).tolist()) for t in texts]
    assert [w[0] for w in want] == [fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE_BYTES", 7)
    monkeypatch.setattr(simhash, "PIECE_HASHES", 3)
    assert want == [(simhash.fingerprint(t) % (1 << 64), near_sets.shingles(t).tolist()) for t in texts]


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and near_sets.keep_first(frame(spark, [])).count() == 0


def test_rows_of_one_id_with_different_texts_are_one_document(spark):
    rows = [(1, "a b c d e f", "", "", 0), (2, "q r s t u v", "", "", 0), (2, "a b c d e f", "", "", 0), (3, "q r s t u v", "", "", 0)]
    assert {r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()} == {1}


def similar_groups(rows):
    """Smallest place of each row's group over five-word Jaccard of 0.8 and equal ids; null ids tie nothing."""
    words = [(r[1] or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or None is not rows[i][0] == rows[j][0]]
    return local_roots(len(rows), *(np.array(x, int) for x in zip(*near))).tolist()


@pytest.mark.parametrize("parts, names, cells", [(1, 10**6, 2000), (4, 0, 3)])
def test_pipeline_keeps_one_of_similar_documents(spark, monkeypatch, parts, names, cells):
    monkeypatch.setattr(near_sets, "MOST_NAMES", names)
    monkeypatch.setattr(near_sets, "CELL_ROWS", cells)
    rnd = random.Random(parts)
    rows = near(awkward(n=20))
    common_part = " ".join(f"same{i}" for i in range(30))
    rows += [(700 + i, f"{common_part} " + " ".join(f"own{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([2, 6, 12]))), "en", "s", 1) for i in range(20)]
    chain = [f"link{i}" for i in range(300)]
    rows += [(800 + i, " ".join(chain[8 * i : 8 * i + 120]), "en", "s", 1) for i in range(15)]
    rows += [(None, " ".join(f"null{k}x{i}" for i in range(50)), "en", "s", 1) for k in (1, 2, 2)] + [(None, rows[-1][1], "en", "s", 1)]
    roots, best = similar_groups(rows), {}
    for r, row in zip(roots, rows):
        best[r] = min(best.get(r, LAST_ID), LAST_ID if row[0] is None else row[0])
    want = sorted((None if v == LAST_ID else v for v in best.values()), key=repr)
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows).repartition(parts), "")
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert want.count(None) == 3 and sum(700 <= w < 720 for w in want if w) > 3
    assert corpus_pipeline.near_duplicates(spark, frame(spark, []), "").count() == 0


def test_cut_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 20)
    rnd = random.Random(2)
    centre = rnd.getrandbits(63)
    prints = sorted({centre ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for _ in range(400)})
    df = common.written(spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, owner long"), "test")
    found = simhash.link(df).collect()
    pairs = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = local_roots(len(prints), *(np.array(x) for x in zip(*pairs)))
    got = local_roots(len(prints), np.array([r.a for r in found]), np.array([r.b for r in found]))
    assert (got == want).all()


def test_cell_forest():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = rng.integers(2, 400)
        base = rng.integers(0, 2**63, size=max(1, n // 6), dtype=np.uint64)
        v = base[rng.integers(0, len(base), n)].copy()
        for k in range(n):
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                v[k] ^= np.uint64(1 << int(b))
        v = np.unique(v)
        cells = rng.integers(0, 3, len(v))
        order = np.lexsort((simhash.gray_rank(v), cells))
        v, cells = v[order], cells[order]
        a, b = simhash.cell_forest(v, cells, 4)
        close = (np.bitwise_count(v[:, None] ^ v[None]) <= 4) & (cells[:, None] == cells[None])
        assert (local_roots(len(v), a, b) == local_roots(len(v), *np.nonzero(np.triu(close, 1)))).all()


@pytest.mark.parametrize("local", [0, 25, 500_000])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, monkeypatch, kind, local):
    monkeypatch.setattr(contraction, "LOCAL_EDGES", local)
    rnd = random.Random(4)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 80)], "random": [(rnd.randrange(90), rnd.randrange(90)) for _ in range(70)], "none": [(5, 5)]}[kind]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = local_roots(100, np.array([min(e) for e in edges]), np.array([max(e) for e in edges]))
    assert got == {v: int(r) for v, r in enumerate(roots) if r != v}


def edits(item, text):
    """Least edits between the item and a part of the text, over the whole table of costs."""
    place = np.arange(len(text) + 1)
    before = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item):
        now = np.minimum(np.append(len(item) + len(text), before[:-1] + (text != c)), before + 1)
        before = np.minimum.accumulate(now - place) + place
    return int(before.min())


def leaks(rows, items):
    want = []
    for r in rows:
        text = decontaminate.normalised(r[1])
        said = f" {''.join(map(chr, text))} "
        for item, its in items:
            data = decontaminate.normalised(its)
            if 0 < len(data) < decontaminate.Q:
                if f" {''.join(map(chr, data))} " in said:
                    want.append((r[0], item, 0))
            elif len(data) and (e := edits(data, text)) <= len(data) // 10:
                want.append((r[0], item, e))
    return want


def test_decontamination(spark):
    rnd = random.Random(6)
    letters = "abcdefghijkl mnoé中"
    items = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 160)))) for i in range(8)] + [(8, None), (9, ""), (None, "the benchmark item that has no id at all"), (3, "another text under the same id, quite long")]
    items += [(20 + n, "".join(rnd.choice(letters) for _ in range(n))) for n in range(1, 34)] + [(60, "long7"), (61, "To Be"), (62, "文本")]
    rows = awkward(n=6)
    for i in range(120):
        text = list(rnd.choice(items)[1] or "")
        for _ in range(rnd.randint(0, 7) if i < 60 else rnd.randint(0, 2)):
            at = rnd.randrange(len(text) + 1)
            text[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "y"])
        rows.append((200 + i, f"Before, {rnd.choice(letters)}: " + "".join(text).upper() + rnd.choice([" and after", "", " to be", "tobe", " to,be."]), "en", "s", 1))
    want = leaks(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(frame(spark, rows).repartition(3), bench)
    assert rows_of(found, "doc_id", "item_id", "edits") == sorted(want, key=repr)
    assert len(want) > 60 and any(0 < e for _, item, e in want if item is not None and 30 <= item < 44) and any(item == 61 for _, item, _ in want)
    kept = decontaminate.drop_leaked(frame(spark, rows), bench)
    assert kept.columns == frame(spark, []).columns and kept.count() == len(rows) - sum(r[0] in {w[0] for w in want} for r in rows)
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0 and decontaminate.find_leaks(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.drop_leaked(frame(spark, rows), bench.limit(0)).count() == len(rows)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    items = [(i, f"passage number {i} of the benchmark with words {i * 17}") for i in range(7)]
    rows = [(i, f"start {items[i][1]} end", "", "", 0) for i in range(7)] + [(50, "clean text", "", "", 0)]
    found = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found.where("edits = 0"), "doc_id", "item_id") == [(i, i) for i in range(7)]
    kept = decontaminate.drop_leaked(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [50]


def test_decontamination_allows_a_tenth_of_an_item(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(16, 60)))) for i in range(12)]
    rows, rates = [], []
    for i in range(72):
        text = items[i % 12][1]
        broken = list(text)
        for at in rnd.sample(range(len(text)), int(len(text) * rnd.uniform(0.03, 0.15))):
            broken[at] = rnd.choice(["", "x", "ou"])
        rows.append((i, f"{word()} {word()} {''.join(broken)} {word()}", "en", "s", 1))
        rates.append(edits(decontaminate.normalised(text), decontaminate.normalised(rows[-1][1])) / len(text))
    found = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found, "doc_id", "item_id") == sorted(((i, i % 12) for i, r in enumerate(rates) if r <= 0.1), key=repr)
    assert sum(0.05 < r <= 0.1 for r in rates) > 10 and sum(r > 0.1 for r in rates) > 5


def test_forward_backward():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 5])
    emission, transition = rng.normal(size=9), rng.normal(size=(2, 2))
    total, marginal, expected = crf_quality.forward_backward(emission, lines, transition)
    at, sums = 0, np.zeros((2, 2))
    for k, n in enumerate(lines):
        z, ones, steps = 0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emission[at + i] * y[i] for i in range(n)) + sum(transition[y[i], y[i + 1]] for i in range(n - 1)))
            z, ones = z + w, ones + w * np.array(y)
            for i in range(n - 1):
                steps[y[i], y[i + 1]] += w
        assert np.isclose(total[k], np.log(z)) and np.allclose(marginal[at : at + n], ones / z)
        sums, at = sums + steps / z, at + n
    assert np.allclose(expected, sums)


def test_classifier(spark):
    rnd = random.Random(1)
    good = lambda i: "\n".join(f"An ordinary line of {rnd.randint(3, 99)} words about topic {i}, which ends well." for _ in range(rnd.randint(1, 6)))
    bad = lambda i: "\n".join(" | ".join(f"c{rnd.randint(0, 99)}%%" for _ in range(12)) for _ in range(rnd.randint(1, 6)))
    rows = [(i, good(i) if i % 3 else bad(i), "en", "s", 1) for i in range(400)] + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward(n=5)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = crf_quality.learn(frame(spark, rows, False), labels, train_docs=150)
    got = {r.doc_id: r for r in crf_quality.score_documents(frame(spark, rows), model).collect()}
    held = [d for d in range(400) if got[d].held_out]
    assert 60 < len(held) < 140 and np.mean([got[d].predicted == int(d % 3 > 0) for d in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values()) and len(got) == len({r[0] for r in rows})
    nothing = crf_quality.learn(frame(spark, rows, False), labels.limit(0))
    assert {r.score for r in crf_quality.score_documents(frame(spark, rows), nothing).collect()} == {0.5}
    assert crf_quality.score_documents(frame(spark, []), model).count() == 0


CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[NEXT]", "[ROLE]", "[/ROLE]", "[\\INST]", "<\\\\s>", "\\", "$1", "[", "<", "é", "\n", "ok", " ", "[ROLE]user[/ROLE]"]


def test_chats(spark):
    rnd = random.Random(8)
    turns = []
    for conv in [*range(12), None]:
        for turn in range(rnd.randint(1, 9)):
            text = rnd.choice([None, "", "".join(rnd.choice(CONTROLS) for _ in range(6))])
            turns.append((conv, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", "assistant", "system", "tool]", "[/ROLE]", None]), text, "clash", "clash"))
    turns.append(turns[-1])
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string, turns string")
    want = []
    for conv in {t[0] for t in turns}:
        some = sorted(((t[1] is not None, t[1] or 0), t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in some)
        loss = "".join(text for _, role, text in some if role == "assistant")
        want.append((conv, len(some), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    for chunk in (3, 64):
        got = rows_of(chat_format.digest(chat_format.format_conversations(df.repartition(3), chunk=chunk)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
        assert got == sorted(want, key=repr)
    formatted = chat_format.format_conversations(df)
    read = chat_format.read_back(formatted).collect()
    assert all(len(r.formatted) == 7 + sum(m.control_chars + m.chars for m in r.loss_mask) for r in read)
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_merges_turns_of_one_role(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 70, "assistant", "d")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(df).first().formatted == "<s>[INST]a[NEXT]b[/INST]c[NEXT]d</s>"


def test_pipeline(spark, tmp_path):
    passage = "the benchmark passage that nobody should train on because it is part of a test that measures models"
    prose = lambda i: f"Document {i} tells of the river near village {i * 13}, of its mills and its {i} bridges over water.\nPeople of place {i * 7} remember the year {1500 + i} well, and they speak of it.\nIt ends with remark {i * 31}."
    rows = [(i, prose(i), "en", "s", len(prose(i))) for i in range(60)]
    rows += [(100 + i, prose(5), "en", "s", 1) for i in range(4)]
    rows += [(200 + i, prose(300 + i) + "\nA shared boilerplate line of the whole site", "en", "s", 1) for i in range(5)]
    near_copy = " ".join(f"stone{i} in wall{i % 9}" for i in range(60))
    rows += [(400 + i, f"Copy {i} says that {near_copy}.", "en", "s", 1) for i in range(3)]
    rows += [(300, prose(400) + "\n" + passage.upper() + ".", "en", "s", 1), (301, "too short", "en", "s", 1), (302, " | ".join(["c%%%"] * 40), "en", "s", 1), (303, None, None, None, None)]
    folder = str(tmp_path)
    frame(spark, rows, False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    # Line dedup empties the copies, which go; of those that differ in a word two stay apart in lines and meet in near dedup.
    assert left[0] == {r[0] for r in rows} - {301, 302, 303} and left[1] == left[0] - {100, 101, 102, 103}
    assert left[1] - left[2] == {401, 402} and left[2] - left[3] == {300} and left[3] == left[4]
    whole = corpus_pipeline.run(spark, folder)
    assert rows_of(whole, "doc_id", "start", "length", "ids_crc32") == rows_of(docs, "doc_id", "start", "length", "ids_crc32")


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Clashing columns, rows of one id with other texts, null ids; and nothing at all."""
    text = lambda i: f"The {i} gardens near house {i * 7} are open to all who like to walk there.\nIn year {1900 + i} somebody planted {i * 3} trees along the path."
    rows = [(i, text(i), "en", "s", 1) for i in range(30)] + [(3, text(103), "en", "s", 1), (None, text(200), "en", "s", 1), (None, text(201), "en", "s", 1), (None, text(200), "en", "s", 1)] + awkward(n=4)[4:]
    for name, some in (("all", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        frame(spark, some).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = common.written(f(spark, docs, folder), stage)
            assert docs.columns == frame(spark, []).columns
            seen.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
        if not some:
            assert not any(seen) and corpus_pipeline.run(spark, folder).count() == 0
            continue
        kept = [d for d, _ in seen[2]]
        assert set(range(30)) <= set(kept) and kept.count(3) == 1
        assert kept.count(None) == len({t for d, t in seen[1] if d is None and t.strip()})
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert sum(p.length for p in pieces) == sum({(p.doc_id, p.sequence_id if p.doc_id is None else 0): p.doc_tokens for p in pieces if p.start == 0}.values())


def test_entry_lists_the_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in names if q.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
