"""Readers take time in proportion to a file, whatever is in it."""

import time

import pytest

from tessera.parsers import READERS
from tessera.plans import readers

#: One file of each reader, about harbours and ships.
SAMPLES = {kind: next(iter(files.items())) for kind, files in readers.FILES.items()}


def seconds(kind, path, text):
    began = time.process_time()
    READERS[kind].parse(path, text)
    return time.process_time() - began


@pytest.mark.parametrize("kind", SAMPLES)
def test_a_megabyte(kind):
    path, text = SAMPLES[kind]
    assert seconds(kind, path, text * (1_000_000 // len(text) + 1)) < 3


@pytest.mark.parametrize("kind", READERS)
def test_what_is_never_closed(kind):
    for text in ("(", "[", "{", "<", '"', "`", "@", "a.b(", "#[", "do\n", "@A("):
        assert seconds(kind, SAMPLES[kind][0], text * 20_000) < 3
