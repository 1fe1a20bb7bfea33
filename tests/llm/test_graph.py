"""Connected components against a search."""

import random

import pytest

from voltpoint.llm.graph import connected_components


def search(edges):
    near, seen = {}, {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start] if start not in seen else []
        while todo:
            node = todo.pop()
            if node not in seen:
                seen[node] = start
                todo += near[node]
    return seen


@pytest.mark.parametrize("kind", ["random", "chain", "stars", "none"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "chain": [(i, i + 1) for i in range(60)],
        "stars": [(i, i % 7) for i in range(100)] + [(3, 3)],
        "none": [(1, 1)],
    }[kind]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == search(edges)
