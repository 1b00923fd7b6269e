"""Components in one task and in distributed rounds, against plain union."""

import random

import pytest

from ledgerlens.llm.simhash import components


@pytest.mark.parametrize("at_once", [0, 1 << 20])
def test_components(spark, at_once):
    rng = random.Random(3)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)] + [(500, 500)]
    root = {x: x for e in edges for x in e}
    for a, b in edges * 60:
        root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()}
    assert got == {x: r for x, r in root.items() if r != x}
    assert components(spark.createDataFrame([], "a long, b long"), at_once).collect() == []
