"""BPE against the tokenizers library."""
import random

import pyarrow as pa
import pytest

import cases
from scanloom.llm import bpe
from scanloom.llm.queries import vocabulary

ALPHABET = list("aA'sΣςİéß\x1c\x85​ \n\t12½ⅫK#$_<|>😀न中文\x00﻿") + ["é", "'re", "'LL", "the", "in", "<|endoftext|>", "<|STARTOFTEXT|>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary())
    tool.no_truncation()
    tool.no_padding()
    return tool


@pytest.fixture(scope="module")
def coder():
    with open(vocabulary(), "rb") as file:
        return bpe.Coder(file.read())


def test_random_texts(library, coder):
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(16)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, repr(text)
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_take_the_same_steps(library, coder):
    rng = random.Random(4)
    for size in (bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 3000):
        word = "".join(rng.choice("abcdeéinthan") for _ in range(size))
        assert coder.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_known_words_may_be_forgotten(monkeypatch, library, coder):
    monkeypatch.setattr(bpe, "KEPT", 5)
    text = " ".join(f"word{i % 17}s" for i in range(200))
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    rows = cases.awkward()
    got = bpe.encode(cases.docs(spark, rows), vocabulary(), decoded=True, keep=["key"]).collect()
    assert len(got) == len(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got)
    again = bpe.decode(spark.createDataFrame([(1, None), (2, got[0].ids)], "doc_id long, ids array<int>"), vocabulary()).collect()
    assert sorted((r.doc_id, r.decoded) for r in again) == [(1, ""), (2, got[0].decoded)]
    assert bpe.encode(cases.docs(spark, []), vocabulary()).count() == 0


def test_vocabulary_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FILE_LIMIT", 10)
    with pytest.raises(ValueError):
        bpe.encode(cases.docs(spark, []), vocabulary())


def test_ids_are_held_as_numbers_of_four_bytes(coder):
    for text in ("", " \x1c ", "one two, two", "a<|endoftext|>b é"):
        assert coder.coded(text) == b"".join(i.to_bytes(4, "little") for i in coder.encode(text))
    assert all(isinstance(ids, bytes) for ids in coder.chunks.values())


def test_a_large_vocabulary_of_words_is_coded_once(library, coder):
    coder.forget()
    found, find = [], coder.chunks.find
    coder.chunks.find = lambda chunk: found.append(chunk) or find(chunk)
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(150_000))
    first = coder.coded(text)
    assert coder.coded(text) == first and len(found) == 150_000
    assert coder.encode(text[:5000]) == library.encode(text[:5000], add_special_tokens=False).ids
    coder.chunks.find = find


def test_rows_decoded_at_once(coder):
    ids = [coder.encode(text) for text in ("", "one two", "a<|endoftext|>b é", "\x00")]
    assert coder.decoded(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [coder.decode(x) for x in ids]


def test_a_run_that_is_one_word_is_held_once(library, coder):
    coder.forget()
    assert coder.encode("one two, two") == library.encode("one two, two", add_special_tokens=False).ids
    assert sorted(word for held in vars(coder).values() if isinstance(held, bpe.Known) for word in held) == [",", "one", "two", "two,"]
