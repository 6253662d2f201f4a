"""Base spans against the patterns, the field's message passing against all labelings."""
import random
import re
from itertools import product

import numpy as np

import cases
from scanloom.llm import pii
from scanloom.llm.queries import op7_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(digits[::-1])]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_base_spans():
    rng = random.Random(1)
    parts = ["a", "b@", "@", "c.d", ".", "1", "23", "255", "256", "0007", "+1", " ", "-", "(", "4111111111111111", "00", "é", "%", "٣", "\n"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(15)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1 (" * 9_000, "1 " * 9_000, "555-1055 " * 9_000):
        assert pii.all_spans(text, pii.Field(np.zeros((pii.WIDTH + 1, 5)), np.zeros((5, 5)), np.eye(5)))[0] == pii.base_spans(text)


def test_message_passing_on_a_tree_is_exact():
    rng = np.random.default_rng(5)
    field = pii.Field(rng.normal(size=(pii.WIDTH + 1, 5)), *(lambda a, b: (a + a.T, b + b.T))(rng.normal(size=(5, 5)), rng.normal(size=(5, 5))))
    found = pii.Tokens([0, 3, 6, 9], [2, 5, 8, 11], [pii._shape(w, "") for w in ("12", "a@b", "1.2.3.4", "555-1055")], [0, 1], [(1, 3)])
    known = [0, 0, 3, 0]
    node = pii._design(np.array(found.features)) @ field.node
    total = np.zeros((4, 5))
    for labels in product(range(5), repeat=4):
        if labels[2] == 3:
            weight = np.exp(sum(node[i, labels[i]] for i in (0, 1, 3)) + field.chain[labels[0], labels[1]] + field.chain[labels[1], labels[2]]
                            + field.skip[labels[1], labels[3]])
            for i in range(4):
                total[i, labels[i]] += weight
    assert np.allclose(pii.beliefs(field, found, known, 60), total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_far_mentions_take_the_kind_of_the_first():
    field = pii.Field(np.zeros((pii.WIDTH + 1, 5)), np.zeros((5, 5)), 14 * np.eye(5))
    text = "call +1 (501) 555-1001 now " + "or 555-1001 as said " * 400
    base, every = pii.all_spans(text, field)
    assert len(base) == 1 and [k for _, k, _ in every[1:]] == [3] * 400
    found = pii.tokens(text)
    got = pii.beliefs(field, found, pii.silver(found, base))
    pair = np.exp(field.skip) / np.exp(field.skip).sum(axis=1)
    want = np.linalg.matrix_power(pair, 400)[4]
    assert np.allclose(got[-1], want, atol=1e-4)


def test_fields_without_a_fixed_point_come_to_an_end():
    field = pii.Field(np.random.default_rng(2).normal(size=(pii.WIDTH + 1, 5)), -9 * np.eye(5), 9 * np.roll(np.eye(5), 1, 0))
    found = pii.tokens("12 555-1001 a@b.cd 12 7 555-1001 12 a@b.cd 555-1001 " * 20)
    p = pii.beliefs(field, found, [0] * len(found.start))
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1)


def test_repeats_take_the_kind_of_their_like(spark):
    texts = [f"word call +1 ({500 + i}) 555-10{i:02} today" for i in range(30)] + [f"in {i} days 4{i} of them" for i in range(30)]
    table = cases.docs(spark, list(enumerate(texts)))
    field = pii.fit(table)
    again = "call +1 (501) 555-1001 now\nor 555-1001 for short, at 12 sharp"
    base, every = pii.all_spans(again, field)
    assert [again[a:b] for a, _, b in base] == ["+1 (501) 555-1001"]
    assert [again[a:b] for a, _, b in every] == ["+1 (501) 555-1001", "555-1001"] and every[1][1] == 3
    assert pii.mask(again, every) == "call [PHONE] now\nor [PHONE] for short, at 12 sharp"
    assert pii.mask("ab", []) == "ab" and pii.mask("0123", [(0, 0, 2), (1, 1, 3)]) == "[EMAIL]3"


def test_rows(spark):
    rows = cases.awkward() + [(20, "mail a@b.cd or 10.0.0.1, 10.0.0.1"), (20, "mail a@b.cd or 10.0.0.1, 10.0.0.1")]
    table = cases.docs(spark, rows)
    field = pii.fit(table)
    got = pii.spans(table, field).collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    want = [(i, [(pii.KINDS[k], a, b) for a, k, b in brute(t or "")]) for i, t in rows]
    assert sorted(((r.key, [(s.kind, s.start, s.end) for s in r.spans if not s.added]) for r in got), key=key) == sorted(want, key=key)
    hidden = pii.masked(table, field)
    assert hidden.columns == table.columns
    texts = {(r.doc_id, r.text) for r in hidden.collect()}
    assert (1, None) in texts and (2, "") in texts and (20, "mail [EMAIL] or [IP], [IP]") in texts
    assert pii.fit(table.limit(0)) is None and pii.spans(table.limit(0), None).count() == 0


def test_query(spark):
    import hashlib

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    some = 0
    for r in op7_pii(spark, folder).collect():
        spans = brute(texts[r.doc_id])
        some += len(spans)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in spans) for i in range(4))
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert some
