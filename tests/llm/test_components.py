"""Connected components against a plain union of sets."""

import random

import numpy as np
import pytest

from rankfield.llm import components


def plain(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {n: c for n, c in label.items() if any(a != b and n in (a, b) for a, b in edges)}


def graphs():
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    rng.shuffle(chain)
    hub = [(-7, 1000 + i) for i in range(1500)] + [(1000 + i, 9000 + i) for i in range(40)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    return {"chain": chain, "hub": hub, "loose": loose, "self": [(5, 5), (6, 6), (6, 7)], "none": [], "copies": [(2**62, -(2**62))] * 9}


@pytest.mark.parametrize("task_edges", [components.TASK_EDGES, 40])
@pytest.mark.parametrize("name", ["chain", "hub", "loose", "self", "none", "copies"])
def test_components_equal_a_plain_union(spark, name, task_edges):
    edges = graphs()[name]
    if task_edges == 40 and name in ("self", "none", "copies"):
        pytest.skip("fits a task either way")
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), task_edges).collect()
    want = plain(edges)
    got = {r.node: r.component for r in found}
    assert len(got) == len(found) and {n: got.get(n, n) for n in want} == want and set(got) <= set(want)


def test_contraction_of_one_task():
    rng = random.Random(8)
    for _ in range(200):
        edges = [(rng.randrange(-9, 9), rng.randrange(-9, 9)) for _ in range(rng.randrange(12))]
        root, node = components.contracted(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
        got = dict(zip(node.tolist(), root.tolist(), strict=True))
        want = plain(edges)
        assert {n: got.get(n, n) for n in want} == want and all(r < n for n, r in got.items())


@pytest.mark.parametrize("task_edges", [components.TASK_EDGES, 500])
def test_components_with_a_split_hub(spark, task_edges):
    edges = [(5, 10_000 + i) for i in range(3_000)] + [(10_000 + i, 20_000 + i) for i in range(0, 3_000, 3)]
    edges += [(i, i + 1) for i in range(50_000, 50_040)] + [(7, 7), (90_000, -3), (90_000, -3), (-3, 90_000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in parent if x != root(x)}
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), task_edges).collect()
    got = {r.node: r.component for r in found if r.node != r.component}
    assert got == want
