"""Connected components, of few edges and of many."""

import numpy as np
import pytest

from tintloom.llm import common


def expected(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in list(root)}


@pytest.mark.parametrize("few", [0, common.FEW_EDGES])
def test_few_and_many_edges_give_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rng = np.random.default_rng(3)
    edges = [(int(a) - 200, int(b) - 200) for a, b in rng.integers(0, 400, (260, 2))]
    edges += [(1000 + (7 * i) % 101, 1000 + (7 * i + 7) % 101) for i in range(100)] + [(5000, i) for i in range(5001, 5100)] + [edges[0]]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == expected(edges)


def test_few_edges_take_no_shuffles(spark):
    found = common.components(spark.createDataFrame([(3, 2), (2, 1), (7, 9)], "a long, b long").repartition(3))
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert found.count() == 5 and common.components(spark.createDataFrame([], "a long, b long")).count() == 0
