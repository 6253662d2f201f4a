"""Connected components against union and find."""
import random

import pytest

from scanloom.llm.components import components


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(2, 1), (1, 2), (3, 3)], [(i, i + 1) for i in range(60)], [(i + 1, i) for i in range(0, 60, 2)],
    [(0, i) for i in range(50)], [((i * 7) % 61, (i * 7 + 7) % 61) for i in range(60)],
    [(random.Random(i).randrange(80), random.Random(i + 99).randrange(80)) for i in range(60)]])
def test_components(spark, links):
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in root)
