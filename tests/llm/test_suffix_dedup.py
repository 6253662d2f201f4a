"""Kept bytes against a dictionary of all windows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import cases
from scanloom.llm import suffix_dedup as s


def brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k: k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if seen[b[k: k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def found(spark, rows, **more):
    return [(*tuple(r)[:5], bytes(r[5])) for r in s.without_repeats(cases.docs(spark, rows), **more).collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def passages(seed, length, n=60, alphabet="abcd é"):
    rng, out = random.Random(seed), []
    pool = ["".join(rng.choices(alphabet, k=rng.randrange(10, 400 + 3 * length))) for _ in range(12)]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(p[a: a + rng.randrange(1, 300 + 2 * length)] if rng.random() < 0.6 else "".join(rng.choices(alphabet, k=rng.randrange(60))))
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("seed,length,gram,anchor,bucket,shard", [
    (1, 40, 8, 1 << 20, 1 << 20, 1 << 18), (2, 40, 8, 1 << 20, 3000, 500), (3, 30, 5, 150, 2000, 300), (4, 200, 32, 1 << 20, 1 << 21, 2000), (5, 7, 2, 30, 500, 64)])
def test_kept(spark, monkeypatch, seed, length, gram, anchor, bucket, shard):
    monkeypatch.setattr(s, "BLOCK", 37)
    monkeypatch.setattr(s, "CONTEXT", 20)
    monkeypatch.setattr(s, "SLICE_BYTES", 1500)
    rows = passages(seed, length)
    want = brute(rows, length)
    same(found(spark, rows, length=length, gram=gram, anchor_bytes=anchor, bucket_bytes=bucket, shard_bytes=shard), want)
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_awkward_rows(spark):
    rows = [(i, t if t != cases.LONG else " ".join(t.split()[:4000])) for i, t in cases.awkward()] + [(20, "é" * 150), (21, "é" * 90), (22, "ab" * 3000), (23, "ba" * 120), (24, "x" * 199), (25, "x" * 200)]
    same(found(spark, rows), brute(rows))


def test_a_passage_in_all_texts_with_unlike_surroundings(spark):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=350))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=rng.randrange(50, 250))) + passage + "".join(rng.choices("abcdefgh ", k=100))) for i in range(150)]
    same(found(spark, rows, anchor_bytes=3000, bucket_bytes=20000, shard_bytes=4000), brute(rows))


def test_what_fits_a_bucket_is_not_dealt_anew(spark, monkeypatch):
    rng, dealt, anew = random.Random(9), [], s._dealt_anew
    monkeypatch.setattr(s, "_dealt_anew", lambda cuts, *rest: dealt.append(cuts.count()) or anew(cuts, *rest))
    ends = lambda: "".join(rng.choices("cdefgh ", k=60))
    rows = [(i, ends() + "ab" * 1200 + ends()) for i in range(100)]
    same(found(spark, rows), brute(rows))
    assert dealt == []
    same(found(spark, rows, anchor_bytes=1 << 17), brute(rows))
    assert dealt[0] >= 100


def test_empty(spark):
    assert found(spark, []) == []
    same(found(spark, [(1, None), (None, "")]), brute([(1, None), (None, "")]))


def test_merged_transforms_equal_the_transform_of_all():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (30, 45, 12, 60, 33)]
    windows = np.array([len(t) - 9 for t in texts])
    one = s.repeated(texts, windows, np.ones(5, int), 10, 5, 1 << 20)
    many = s.repeated(texts, windows, np.ones(5, int), 10, 5, 20)
    seen = Counter(t[k: k + 10] for t in texts for k in range(len(t) - 9))
    for t, a, b in zip(texts, one, many):
        want = [seen[t[k: k + 10]] > 1 for k in range(len(t) - 9)]
        assert a.tolist() == want and b.tolist() == want
