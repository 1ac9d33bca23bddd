"""Components of random graphs, in one task and in rounds."""

from __future__ import annotations

import random

import pytest

from quarryline.operators import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("most", [components.TASK_EDGES, 40])
def test_matches_union_find(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    dice = random.Random(most)
    edges = [(dice.randrange(-90, 90), dice.randrange(-90, 90)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)]
    edges += edges[:20] + [(7, 7), (2**62, -(2**62))]
    dice.shuffle(edges)
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == brute(edges)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0
