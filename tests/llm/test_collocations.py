"""Collocations against counting by dictionaries, and transducers against their n-grams."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import cases
from compare import compare, connect
from scanloom.llm import collocations as c
from scanloom.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, phrase string, w1 string, f long, edge boolean, rank int"


def brute(rows, least=10, top=2000):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    count[lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + 2] for p, a in candidates.items() if len(p) == 3 for i in (0, 1) if 100 * a >= 50 * candidates[p[i:i + 2]]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, t, lang, "p", "w", 1, True, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in c.collocations(table, **more).collect())


def texts(seed, docs=60, vocabulary=25):
    rng = random.Random(seed)
    names = [f"{x}é" if i % 7 == 0 else x for i, x in enumerate("".join(rng.choices("abcXYZ", k=2)) for _ in range(vocabulary))]
    out = []
    for _ in range(docs):
        w = []
        for _ in range(rng.randrange(40)):
            w += rng.choice([["new", "york"], ["new", "york", "city"], [names[min(int(rng.expovariate(0.2)), vocabulary - 1)]]])
            w[-1] += rng.choice(["", "", "", "", ",", ". ", "\n", "!?"])
        out.append((rng.choice([" ", "  ", "\t"]).join(w), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return out


@pytest.mark.parametrize("seed,least,range_bytes,fan", [(1, 10, 1 << 24, 512), (2, 3, 400, 512), (3, 2, 150, 3), (4, 1, 100, 2)])
def test_collocations(spark, monkeypatch, seed, least, range_bytes, fan):
    monkeypatch.setattr(c, "FAN", fan)
    monkeypatch.setattr(c, "SLICE_BYTES", 500)
    monkeypatch.setattr(c, "CHUNK", 50)
    rows = texts(seed)
    got = found(spark, rows, least=least, range_bytes=range_bytes, shard_bytes=1500)
    assert got == brute(rows, least) and len(got) > 20


def test_awkward_rows(spark):
    rows = [(t if t != cases.LONG else " ".join(t.split()[:4000]), "en") for _, t in cases.awkward()] * 3 + [("x" * 5000 + " b", None)] * 2 + [("..;!?", ""), ("A\x00B a\x00b", "")]
    assert found(spark, rows, least=2) == brute(rows, 2)


def test_ties_and_top(spark):
    rows = [(f"{a} {b}", "en") for a in "klmn" for b in "pq"] * 3
    assert found(spark, rows, least=3, top=5) == brute(rows, 3, 5)


def test_a_hot_pair_with_many_ends(spark):
    rows = [(f"very common w{i % 400}", "en") for i in range(1200)]
    got = found(spark, rows, least=2, range_bytes=800, shard_bytes=2000)
    assert got == brute(rows, 2) and len(got) > 300


def test_scores_beyond_64_bits(spark):
    import pandas as pd  # noqa: F401

    monkey = c.counts
    try:
        big = 3 * 10**12
        c.counts = lambda *a: spark.createDataFrame([("en", None, None, None, 9 * big), ("en", "a", None, None, big + 1), ("en", "b", None, None, big + 7),
                                                     ("en", "a", "b", None, big - 5)], "lang string, w1 string, w2 string, w3 string, f long")
        got = [tuple(r) for r in c.collocations(spark.createDataFrame([], SCHEMA)).collect()]
    finally:
        c.counts = monkey
    assert got == [("en", 1, "a b", big - 5, big + 1, big + 7, 9 * big, 1000000 * (big - 5) ** 2 // ((big + 1) * (big + 7)))]


def test_empty(spark):
    assert found(spark, []) == []


def test_transducer_holds_its_ngrams_in_fewer_states():
    rng = np.random.default_rng(2)
    names = pa.array(sorted({bytes(rng.integers(97, 101, 3).astype(np.uint8)) for _ in range(60)}), pa.large_binary())
    keys = np.unique(c.packed(rng.integers(1, 5, 3000), rng.integers(0, 20, 3000), np.zeros(3000, int)) | rng.integers(0, 6, 3000).astype(np.uint64))
    weights = rng.integers(1, 3, len(keys))
    made = c.Transducer.of(names, keys, weights)
    again = c.Transducer.unpack(*made.pack())
    for t in (made, again):
        assert all((x == y).all() for x, y in zip(t.expand(), (keys, weights)))
        assert (t.weights(*c.unpacked(keys)) == weights).all()
        assert (t.weights(*c.unpacked(keys + np.uint64(30))) == -1).all()
    assert len(made.symbols[2]) < len(keys)
    both = c.united([made, c.Transducer.of(names, keys[::2], weights[::2])])
    want = weights.copy()
    want[::2] *= 2
    used, counts = both.expand()
    assert (counts == want).all() and len(used) == len(keys)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got, _, _, _, problem = compare(spark, connect(folder), "op11", QUERIES["op11_collocations"], SQL["op11_collocations"], folder)
    assert problem is None and len(got) > 50
