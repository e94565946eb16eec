"""Connected components against union-find, with tasks small enough to need many rounds."""

import random

import pytest

from waymark.llm.components import connected_components


def union_find(edges) -> set:
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in parent if root(x) != x}


SHAPES = {
    "none": [], "self": [(4, 4)], "chain": [(i, i + 1) for i in range(60)], "shuffled chain": [(i * 37 % 61, (i + 1) * 37 % 61) for i in range(60)],
    "star": [(0 if i % 2 else i, i if i % 2 else 0) for i in range(1, 80)], "high star": [(1000, i) for i in range(80)],
    "random": [(random.Random(i).randrange(300), random.Random(i + 10_000).randrange(-300, 300)) for i in range(240)],
}


@pytest.mark.parametrize("most", [9, 1_000_000])
@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape, most):
    edges = SHAPES[shape]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3) if edges else spark.createDataFrame([], "a long, b long")
    got = connected_components(df, most).collect()
    assert {tuple(r) for r in got} == union_find(edges) and len(got) == len(set(got))
