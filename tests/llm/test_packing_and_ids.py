"""Packing, the binary format, and the encoder against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import awkward, frame, rows_of
from tokenizers import Tokenizer

from tessera.llm import binary_ids, common, elias_fano, packing
from tessera.llm.encoder import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(text):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(text, add_special_tokens=False)]


def test_encoder_equals_the_library():
    rnd = random.Random(3)
    pieces = ["a", "The", " ", "  ", "\n", "\n\n", ".", ",", "'s", "'ll", "é", "%", "1", "23", "\t", "\xa0", "\r", "\r\n", "中文", "\x85", "<|endoftext|>", " ", "​", "😀", "_", "\x01", "\x1c", "　", "x" * 70]
    texts = ["".join(rnd.choice(pieces[: 16 if k % 2 else None]) for _ in range(rnd.randint(0, 12))) for k in range(3000)]
    encoder = Encoder(PATH)
    assert encoder.encode(texts) == reference(texts)
    assert encoder.encode(texts) == reference(texts)  # from the cache


def test_added_tokens_are_one_id():
    rnd = random.Random(4)
    pieces = ["<|endoftext|>", "<|endoftext|", "|>", "<|", "endoftext", " ", "a", "\n", ".", "word"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", *["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9))) for _ in range(2000)]]
    encoder = Encoder(PATH)
    assert encoder.encode(texts) == reference(texts)
    assert np.frombuffer(encoder.encode(texts[:1])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_piece_lengths():
    for n in range(1, 5000, 7):
        pieces = packing.piece_lengths(n, 1024)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 1024 for p in pieces) and len([p for p in pieces if p < 1024]) <= 10


@pytest.mark.parametrize("parts", [1, 5])
def test_pack(spark, parts):
    rows = awkward()
    got = packing.digest(packing.pack(frame(spark, rows).repartition(parts), PATH)).collect()
    want = {}
    for doc, ids in zip(rows, reference([r[1] or "" for r in rows])):
        raw = ids + np.array([0], "<u4").tobytes()
        at, pieces = 0, []
        for n in packing.piece_lengths(len(raw) // 4, 1024):
            pieces.append((at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(raw) // 4))
            at += n
        want.setdefault(doc[0], []).append(pieces)
    for doc, some in want.items():
        flat = sorted(p for pieces in some for p in pieces)
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == doc) == flat
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_bucket_files(spark, tmp_path):
    pieces = packing.pack(frame(spark, awkward(n=5)), PATH)
    packing.write_buckets(pieces, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert back.count() == pieces.count() and back.where("length <> pow(2, bucket)").count() == 0


def test_elias_fano():
    rnd = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (1, 10**15), (700, 3), (5000, 10**6), (300, 2**60)):
        values = np.sort(rnd.integers(0, top, n, dtype=np.uint64))
        data = b"xx" + elias_fano.encode(values)
        coded = elias_fano.EliasFano(data, 2)
        assert (coded.all() == values).all() and coded.end == len(data)
        assert [coded.select(i) for i in range(0, n, 13)] == [int(v) for v in values[::13]]
        for a, b in ((0, n), (n // 3, n // 2), (max(0, n - 2), n)):
            assert (coded.selected(np.arange(a, b)) == values[a:b]).all()
        if n:
            some = rnd.integers(0, n, 40)
            assert (coded.selected(some) == values[some]).all()
            with pytest.raises(IndexError):
                coded.selected(np.array([n]))
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))


def test_segments(spark):
    rows = awkward()
    path = common.scratch_path(spark, "test")
    binary_ids.write_segments(frame(spark, rows).repartition(3), PATH, path, segment_ids=500)
    got = sorted(map(tuple, binary_ids.read_documents(spark, path).collect()), key=lambda r: r[1])
    raws = [raw + np.array([2], "<u4").tobytes() for raw in reference([r[1] or "" for r in rows])]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((r[0] or -1, len(raw) // 4, zlib.crc32(raw)) for r, raw in zip(rows, raws))
    for row in spark.read.schema(binary_ids.SEGMENTS).parquet(path).limit(3).collect():
        segment = binary_ids.Segment(bytes(row.data))
        ends = segment.boundaries()
        assert all((segment.document(i) == segment.ids[ends[i] : ends[i + 1]]).all() for i in range(segment.n_docs))
    assert binary_ids.Segment(binary_ids.build_segment([None, 1 << 62, (1 << 62) + 5], [b"\1\0\0\0"] * 3, 4)).doc_ids() == [None, 1 << 62, (1 << 62) + 5]
    empty = common.scratch_path(spark, "test")
    binary_ids.write_segments(frame(spark, []), PATH, empty)
    assert rows_of(binary_ids.read_documents(spark, empty), "doc_id") == []
