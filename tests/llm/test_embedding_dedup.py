"""Links and components against all pairs."""
import math

import numpy as np
import pytest

from scanloom.llm import embedding_dedup as e


def brute(rows, threshold=0.93):
    def good(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v is not None and len(v) > 0 and all(
            x is not None and math.isfinite(x) for x in v) and any(v)

    count, root = [0] * len(rows), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    count[i] += 1
                    p, q = find(a[0]), find(b[0])
                    root[max(p, q)] = min(p, q)
    return [(r[0], n, find(r[0]), r[0] is not None and r[0] == find(r[0])) for r, n in zip(rows, count)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 33)) * 10.0 ** rng.integers(-3, 4, (60, 33))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, s, n, err = e.quantise(unit)
    near = (q.astype(int) @ q.T.astype(int)) * s[:, None] * s
    assert (np.abs(unit @ unit.T - near) <= err[:, None] + n[:, None] * err + 1e-12).all()
    assert (e._products(q, q) == q.astype(int) @ q.T.astype(int)).all()


@pytest.mark.parametrize("block", [4, 4096])
def test_near_duplicates(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 6))
    rows = []
    for i in range(90):
        v = base[rng.integers(8)] + rng.normal(size=6) * rng.choice([0, 0.02, 0.12, 0.5])
        rows.append((int(200 - i), [float(np.float32(x)) for x in v], int(i % 2) if i % 7 else 0))
    inf, nan = float("inf"), float("nan")
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 6, 0), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (304, [nan] * 6, 0), (305, [inf] * 6, 0),
             (306, rows[0][1], None), (306, rows[0][1], None), (307, [1.0, 2.0], 0), (308, [1.0, 2.0], 0), (None, rows[0][1], 0),
             (309, [-0.0, 1.0], 0), (310, [0.0, 1.0], 0), (311, [1e-30, 2e-30], 0), rows[3], (400, rows[3][1], rows[3][2])]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                  "vec_id long, embedding array<float>, label int, id int, vector string, copies int")
    got = [tuple(r) for r in e.near_duplicates(table, block=block).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert e.near_duplicates(table.limit(0)).count() == 0
