"""Windows of the benchmark against a search for each."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import cases
from scanloom.llm import decontaminate as d
from scanloom.llm.queries import op8_decontaminate
from scanloom.llm.words import ALNUM, words


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, width=13):
    windows = {}
    for name, text in items:
        w = split(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add(name)
    out = []
    for text in texts:
        w, names = split(text), set()
        hit = [False] * len(w)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k:k + size]))
                if found:
                    names |= found
                    hit[k:k + size] = [True] * size
        out.append((len(w), sum(hit), sorted(names)))
    return out


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    for size, letters in ((1, 2), (40, 2), (300, 5)):
        text = np.concatenate([rng.integers(1, letters + 1, size), [0]])
        order = d.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = d.Index(text, sample=4)
        assert index.locate(np.arange(len(text))).tolist() == order.tolist()
        for length in (1, 2, 3):
            patterns = rng.integers(1, letters + 3, (20, length)).astype(np.int32)
            low, high = index.search(patterns, np.full(20, length))
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(len(text) - length + 1) if text[i:i + length].tolist() == p.tolist()]
                assert sorted(order[a:max(a, b)].tolist()) == want


@pytest.mark.parametrize("width", [1, 3, 13])
def test_hits(width):
    rng = random.Random(width)
    letters = ["a", "B", "b", "c", "é", "dd"]
    items = [(f"i{k % 9}", " ".join(rng.choice(letters) for _ in range(rng.randrange(16)))) for k in range(12)]
    texts = [", ".join(rng.choice(letters + ["z"]) for _ in range(rng.randrange(80))) for _ in range(60)] + ["", None, items[3][1]]
    windows = d.windows_of(items, width)
    found = words(pa.array(texts), ALNUM)
    hit, names = d.shard_hits(found, windows, len(texts))
    got = [(int(b - a), int(hit[a:b].sum()), sorted(n)) for a, b, n in zip(found.rows[:-1], found.rows[1:], names)]
    assert got == brute(texts, items, width)


def test_blocks_of_the_benchmark_agree(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(20)] + [(7, None), (None, "v1 v2"), (5, "v1"), (50, "")]
    rows = cases.awkward() + [(100 + k, f"before {items[k][1]} after, {items[k + 1][1]}") for k in range(10)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = cases.docs(spark, rows)
    want = brute([t for _, t in rows], [(str(i), t) for i, t in items if i is not None and t])
    for limit in (700, 1 << 20):
        names = ("a", "b", "c", "d")
        found = d.hits(table, benchmark, limit=limit, names=names)
        got = found.collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1:])
        assert sorted(((r.doc_id, r.a, r.b, r.c) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
        assert found.columns[:len(table.columns)] == table.columns
        texts = {r.doc_id: r.text for r in d.hits(table, benchmark, limit=limit, names=names, cut=True).collect()}
        assert texts[1] is None and texts[8] == cases.LONG and not brute([texts[100]], [(str(i), t) for i, t in items[:20]])[0][1]
        assert texts[100].startswith("before ") and " after, " in texts[100]
    assert d.hits(table, benchmark.limit(0), names=names).where("b > 0").count() == 0
    assert d.hits(table.limit(0), benchmark, names=names).count() == 0
    with pytest.raises(ValueError):
        d.hits(table, benchmark, names=("a", "ID", "c", "d"))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").toPandas()
    want = brute(docs.text, [(str(i), t) for i, t in zip(items.item_id, items.text)])
    got = {r.doc_id: r for r in op8_decontaminate(spark, folder).collect()}
    for i, (n, hit, names) in zip(docs.doc_id, want):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0 and 20 * hit >= n)
    assert any(hit for _, hit, _ in want)
