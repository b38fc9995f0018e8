"""Byte-level BPE ids of whole texts, by the ``tokenizers`` library with a word cache.

The pre-tokenizer of byte-level BPE never joins a lone blank to what stands
before it, and BPE never merges across its pieces.  So a text without runs of
blanks can be cut before every blank and around every line break, and the ids
of the parts, one after the other, are the ids of the text.  Natural texts
repeat their parts: each worker keeps the ids of those that it has met, as
bytes, and asks the library only about new ones, many in one call.  Texts with
other white space next to a cut, and texts that hold one of the vocabulary's added
tokens, go to the library whole, whose settings are left as they are.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Texts with runs of white space that begin or end at a cut, or with the mark below.
ODD = "\x01|  | \n|\n\n[\n ]| \\z|\n\n\\z"
#: Stands before a part that has no blank before it.
BARE = "\x01"
#: Parts that a worker keeps; beyond it the cache starts anew.
CACHE_PARTS = 300_000
#: Bytes of text that are best encoded at once: the more, the fewer parts are distinct.
ENCODE_BYTES = 4 << 20
#: Longer parts are forgotten after their batch.
LONG = 60
#: New parts that are joined into one text for the library.
JOINED = 160

#: Tasks are parallel already; threads of the library's own would each hold memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts into little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, parts: int = CACHE_PARTS):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        pre = described.get("pre_tokenizer") or {}
        added = [t["content"] for t in described.get("added_tokens") or []]
        self.cached = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and self.tokenizer.normalizer is None
        # Parts are joined by white space for the library: an added token with white space could arise there.
        self.cached = self.cached and not any(re.search(r"\s", t) for t in added)
        self.odd = "|".join([ODD, *[rf"\Q{t}\E" for t in added]])
        self.newline = self._each(["\n"])[0]
        self.line = int(np.frombuffer(self.newline, "<u4")[0])
        self.marks = dict(zip(".,", self._each([".", ","])))
        self.empty = {"\n": self.newline, BARE: b""}
        self.cache = dict(self.empty)
        self.parts = parts

    @classmethod
    def of(cls, path: str, parts: int = CACHE_PARTS) -> Encoder:
        """The worker's own encoder for this vocabulary file, which from now on keeps so many parts."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        _encoders[path].parts = parts
        return _encoders[path]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new parts into the cache.

        A word before a full stop or comma is looked up without it.  Parts stay
        apart when line breaks join them, so one call encodes many and the line
        break's id parts them again.  Parts with white space at an end would
        not, and stay unknown.
        """
        cache, marks = self.cache, self.marks
        words = [p for p in new if p.isalpha()]
        other = [p for p in new if not p.isalpha()]
        ends = [p for p in other if p[-1] in marks and p[:-1].isalpha()]
        words.extend({p[:-1] for p in ends}.difference(cache, words))
        rest = [p for p in other if not (p[-1] in marks and p[:-1].isalpha()) and not (p[0].isspace() or p[-1].isspace() or p[1:2].isspace())]
        words.extend(p for p in rest if p[0] != BARE)
        self._learn_joined(words, "\n ", " ")
        self._learn_joined([p for p in rest if p[0] == BARE], "\n", "")
        for p in ends:
            cache[p] = cache[p[:-1]] + marks[p[-1]]

    def _learn_joined(self, words: list[str], between: str, before: str) -> None:
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        texts = [before + between.join(g).replace(BARE, "") for g in groups]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw = ids.tobytes()
            cuts = np.flatnonzero(ids == self.line) * 4
            if len(cuts) != len(some) - 1:
                raise AssertionError("the vocabulary joins line breaks with letters")
            starts, stops = (cuts + 4).tolist(), cuts.tolist()
            starts.insert(0, 0)
            stops.append(len(raw))
            self.cache.update(zip(some, [raw[a:b] for a, b in zip(starts, stops)]))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; an empty text has none.

        Arrow cuts the texts, numbers the distinct parts and lays their ids end
        to end; Python only sees each distinct part once a call.
        """
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.cached:
            return self._each(texts.to_pylist())
        out: list[bytes | None] = [None] * len(texts)
        plain = np.flatnonzero(~pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        if len(plain):
            marked = pc.binary_join_element_wise(BARE, pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n " + BARE), "")
            lists = pc.split_pattern(marked, " ")
            coded = lists.flatten().dictionary_encode()
            parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids = list(map(self.cache.get, parts))
            if gaps := [i for i, x in enumerate(ids) if x is None]:
                if len(self.cache) > self.parts:
                    self.cache = dict(self.empty)
                self._learn([parts[i] for i in gaps])
                for i in gaps:
                    ids[i] = self.cache.get(parts[i])
                for i in gaps:
                    if len(parts[i]) > LONG:
                        self.cache.pop(parts[i], None)
            unknown = [i for i, x in enumerate(ids) if x is None]
            codes = coded.indices.to_numpy()
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            laid = pa.array([x or b"" for x in ids], pa.binary()).take(coded.indices)
            ends = np.frombuffer(laid.buffers()[1], np.int32, len(laid) + 1, 4 * laid.offset)[bounds].tolist()
            data = memoryview(laid.buffers()[2]) if laid.buffers()[2] else memoryview(b"")
            whole = set()
            if unknown:
                whole = set((np.searchsorted(bounds, np.flatnonzero(np.isin(codes, unknown)), side="right") - 1).tolist())
            for k, (doc, first, last) in enumerate(zip(plain.tolist(), ends, ends[1:])):
                if k not in whole:
                    out[doc] = bytes(data[first:last])
        left = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(left, self._each([texts[k].as_py() for k in left])):
            out[k] = x
        return out
