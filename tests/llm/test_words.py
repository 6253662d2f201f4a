"""Word hashing against regular expressions."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scanloom.llm import words as w

PATTERNS = [(w.BLANK, r"[^\x20\x09-\x0D]+"), (w.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("block", [3, 50, 1 << 17])
@pytest.mark.parametrize("table,pattern", PATTERNS)
def test_words_are_those_of_the_pattern(monkeypatch, block, table, pattern):
    monkeypatch.setattr(w, "BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", "a" * 700] + ["".join(rng.choice("ab Z9,.\n\t\x00é中😀\x1c\x85") for _ in range(rng.randrange(60))) for _ in range(150)]
    got = w.words(pa.array(texts), table)
    want = [re.findall(pattern, lower(t or "")) for t in texts]
    assert np.diff(got.rows).tolist() == [len(x) for x in want]
    raw = [lower(bytes(got.data[a:b]).decode()) for a, b in zip(got.start, got.end)]
    flat = [x for words in want for x in words]
    assert raw == flat
    seen = {}
    for word, h in zip(flat, got.hashes.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_slice():
    texts = ["one two", "three one", "", "two"]
    whole = w.words(pa.array(texts), w.BLANK).hashes.tolist()
    apart = [h for t in texts for h in w.words(pa.array([t]), w.BLANK).hashes.tolist()]
    assert whole == apart == w.words(pa.array(["x", *texts]).slice(1), w.BLANK).hashes.tolist()


def test_slices_keep_every_row():
    batch = pa.record_batch([pa.array([1, 2, 3, 4, 5]), pa.array(["aa", None, "b" * 50, "", "c"])], ["id", "text"])
    got = list(w.slices([batch, batch.slice(5)], 10))
    assert [i for b in got for i in b.column(0).to_pylist()] == [1, 2, 3, 4, 5]
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(1).to_pylist()) <= 10 for b in got)
