"""Blocks on DataFrames against the depth-first search on arrays."""

import random

import numpy as np
import pytest
from graphs import random_graph

from graphloom.graph import Graph
from graphloom.operators import biconnected, blocks, kernel
from graphloom.plans import planner


def many_graphs():
    """Random graphs side by side, some split, a long path, a star, a ring of rings, and a clique; ids are shuffled."""
    r, out, n = random.Random(5), [], 0

    def add(k, edges):
        nonlocal n
        names = list(range(k))
        r.shuffle(names)
        out.extend((n + names[a], n + names[b]) for a, b in edges)
        n += k

    for seed in range(60):
        k, e = random_graph(seed)
        add(k, [x for i, x in enumerate(e) if seed % 3 or i % 4])
    add(150, [(i, i + 1) for i in range(149)])
    add(90, [(0, i) for i in range(1, 90)])
    add(40, [(i, i + 1) for i in range(39)] + [(0, 9), (9, 19), (19, 29), (29, 39), (39, 0)])
    add(12, [(a, b) for a in range(12) for b in range(a)])
    return n, sorted({(min(e), max(e)) for e in out})


@pytest.fixture(scope="module")
def both(spark):
    """The blocks of DataFrames, with lists shortened and ranges of 64 places, and those of arrays."""
    n, e = many_graphs()
    patch = pytest.MonkeyPatch()
    for name, x in (("LONG_LIST", 100), ("PICKED", 8), ("RANGE_BITS", 6), ("BUCKETS", 4)):
        patch.setattr(biconnected, name, x)
    found = biconnected.Blocks.of(Graph.from_list(spark, e, n + 5))
    edges, branches = found.edges.collect(), found.branches.collect()
    patch.undo()
    u, v = np.array(e).T
    g = kernel.Csr.of(np.arange(n + 5), u, v)
    return found, edges, branches, g, kernel._searched(g)[:3]


def test_edges_of_blocks(both):
    _, edges, _, _, (u, v, b) = both
    want, got = {}, {}
    for x in zip(u.tolist(), v.tolist(), b.tolist()):
        want.setdefault(x[2], set()).add(x[:2])
    for r in edges:
        got.setdefault(r.top, set()).add((r.u, r.v))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_branches_and_numbers(both):
    found, edges, branches, g, (u, v, b) = both
    least = {}
    for r in edges:
        least[r.top] = min(least.get(r.top, (r.u, r.v)), (r.u, r.v))
    first = {}
    for x in zip(b.tolist(), u.tolist(), v.tolist()):
        first[x[0]] = min(first.get(x[0], x[1:]), x[1:])
    want = sorted((first[x], y, z) for x, y, z in zip(*[c.tolist() for c in kernel.branches(g, u, v, b)]))
    assert sorted((least[r.top], r.id, r.n) for r in branches) == want
    numbers = found.numbers.collect()
    assert {r.top: (r.u, r.v) for r in numbers} == least
    assert [(r.u, r.v) for r in sorted(numbers, key=lambda r: r.block_id)] == sorted(least.values()) and {r.block_id for r in numbers} == set(range(len(least)))


def test_odd_graphs(spark):
    for pairs, n in (([], 0), ([], 3), ([(0, 1)], 2), ([(4, 7), (9, 4)], 10)):
        g = Graph.of(spark.createDataFrame(pairs, "a long, b long"), spark.range(n))
        assert sorted(map(tuple, blocks.bridges(g, "relational").collect())) == sorted((min(e), max(e)) for e in pairs)


def test_large_graphs_are_not_refused(spark, monkeypatch):
    e = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (5, 6)]
    g = Graph.from_list(spark, e)
    want = {r.id: r for r in blocks.block_vertices(g).collect()}, sorted(map(tuple, blocks.connection_vertices(g).collect())), blocks.largest_block(g)
    monkeypatch.setattr(planner, "SEARCHED_EDGES", 3)
    assert planner.search_strategy(g) == "relational" and planner.strategy(g) == "kernel"
    assert ({r.id: r for r in blocks.block_vertices(g).collect()}, sorted(map(tuple, blocks.connection_vertices(g).collect())), blocks.largest_block(g)) == want
