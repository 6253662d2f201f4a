"""Nodes against a trie of dictionaries, and the query against its SQL."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from compare import compare, connect
from scanloom.llm import conversation_trie as t
from scanloom.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, key string, path long, words string"


def brute(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            held[conv].append(((turn is not None, turn or 0, key), role, text))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in held.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path)))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        own_saved = (len(members[p]) - 1) * len(re.findall(t.WORD, p[-1][1])) if p else 0
        saved[p] = own_saved + sum(saved[k] for k in children[p])
    return sorted((min(m)[0], len(p), min(members[p[:-1]])[0] if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(c for c, n in m if n == len(p))).encode()).hexdigest()) for p, m in members.items())


def found(spark, rows, **more):
    table = spark.createDataFrame([(*r, "k", 1, "w") for r in rows], SCHEMA)
    return sorted(tuple(-1 if x is None else x for x in r) for r in t.trie(table, **more).collect())


def chats(seed, convs, alphabet, length):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(convs * 2), convs):
        for turn in range(rng.randrange(length)):
            rows.append((c, turn, rng.choice(["user", "bot"]), " ".join(rng.choice(alphabet) for _ in range(rng.randrange(4)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,limit", [(1, 1 << 17), (2, 7), (3, 1)])
def test_nodes(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(t, "RUN", 3)
    rows = chats(seed, 150, "ab", 7) + [(500, i, "user", "a") for i in range(40)] + [(501, i, "user", "a") for i in range(41)]
    assert found(spark, rows, limit=limit) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, "x y"), (1, 0, "", "x y"), (1, 2, "a", None), (3, 0, "user", "short"),
            (7, 0, "é", "ü 中 😀"), (7, 0, "é", "ü 中 😀"), (20, 0, "user", "hi"), (21, 5, "user", ""), (22, 1, None, None), (2**60, 0, "u", "w " * 50_000)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(t, "RUN", 4)
    rows = [(c, i, "user", f"turn {i}") for c in range(300) for i in range(6)] + chats(5, 40, "xyz", 5)
    rows = [r for r in rows if r[0] < 300 or r[1] >= 0]
    assert found(spark, rows, limit=5) == brute(rows)


def test_double_array_walks_what_it_holds():
    rng = np.random.default_rng(3)
    paths = sorted({tuple(rng.integers(0, 30, rng.integers(0, 6)).tolist()) for _ in range(400)})
    first = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    trie = t.DoubleArray(np.array([c for p in paths for c in p], np.int64), first)
    assert (trie.check >= 0).sum() == len({p[:d] for p in paths for d in range(len(p) + 1)})
    for p in paths:
        assert len(trie.walk(np.array(p, np.int64))) == len(p)
    assert len(trie.walk(np.array([29, 29, 29, 29, 29, 29, 29]))) < 7


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got, _, _, _, problem = compare(spark, connect(folder), "op12", QUERIES["op12_conversation_trie"], SQL["op12_conversation_trie"], folder)
    assert problem is None and len(got) > 50
