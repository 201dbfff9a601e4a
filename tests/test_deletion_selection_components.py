"""Deletions in the kept state, selection by counts of ranges, components as graphs."""

import random

import numpy as np
import pytest
from graphs import brandes, random_graph

from graphloom.functions import stats
from graphloom.graph import Graph
from graphloom.operators import incremental, kernel, traverse


@pytest.mark.parametrize("seed", range(150))
def test_distances_and_counts_after_a_deletion(seed):
    n, e = random_graph(seed)
    r = random.Random(seed)
    n, e = (n + 12, sorted({*e, *((x, n + k) for k in range(12) for x in r.sample(range(n), 2))})) if seed % 2 else (n, e)
    a, b = r.choice(e)
    csr = lambda pairs: kernel.Csr.of(np.arange(n), *np.array(pairs or [(0, 0)]).T)
    g = csr(e)
    h = g.without(a, b)
    for s in range(n):
        d, sigma, _ = kernel.paths(g, s)
        want = kernel.paths(h, s)
        for x, y in ((a, b), (b, a)):
            d2, sigma2 = incremental.sunk(h, x, y, d, sigma)
            assert (d2 == want[0]).all() and (sigma2 == want[1]).all()


def test_state_through_insertions_and_deletions(spark):
    e = [(0, 1), (1, 2), (2, 3), (0, 3), *((k % 4, k) for k in range(4, 16)), (20, 21), (1, 20), (2, 20)]
    n = sorted({x for p in e for x in p})
    g = Graph.from_list(spark, e)
    state = incremental.SourceState(g)
    for op, a, b in (("delete", 0, 1), ("delete", 4, 0), ("insert", 4, 9), ("delete", 20, 2), ("delete", 1, 20), ("delete", 5, 6)):
        before = brandes(e, n)
        e = [*e, (a, b)] if op == "insert" else [x for x in e if set(x) != {a, b}]
        out = {r.id: r.delta for r in (state.insert if op == "insert" else state.delete)(a, b).collect()}
        after = brandes(e, n)
        assert {k: before[k] + out.get(k, 0) for k in n} == pytest.approx(after, abs=1e-9)
    want = {tuple(r) for r in traverse.all_pairs(Graph(g.vertices, Graph.from_list(spark, e).edges)).collect()}
    assert {tuple(r) for r in state.table.collect()} == want


def test_selection(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 5)
    monkeypatch.setattr(stats, "RANGES", 7)
    r = random.Random(1)
    inf = float("inf")
    for values in ([r.gauss(0, 10) for _ in range(300)], [1e308, -1e308, 0.0, 1.0, 2.0, 3.0, 1e-300, -5.0], [3.0] * 40 + [4.0] * 3, [inf] * 9 + [-inf] * 9 + [1.0, 2.0]):
        df = spark.createDataFrame([(x,) for x in [*values, None]], "`a b` double")
        for k in {0, len(values) // 2, len(values) - 1}:
            assert stats.select(df, "a b", k) == sorted(values)[k]
    with_nan = spark.createDataFrame([(float("nan"),)] * 8 + [(1.0,)], "x double")
    assert stats.select(with_nan, "x", 0) == 1.0 and stats.select(with_nan, "x", 5) != stats.select(with_nan, "x", 5)


def test_components_as_graphs(spark):
    e = [(0, 1), (1, 2), (5, 6), (6, 7), (5, 7)]
    for wanted in ("kernel", "relational"):
        vertices, edges = traverse.component_graphs(Graph.from_list(spark, e, 9), wanted)
        assert sorted(map(tuple, edges.collect())) == [(0, 0, 1), (0, 1, 2), (5, 5, 6), (5, 5, 7), (5, 6, 7)]
        assert traverse.part(vertices, edges, 5).size() == (3, 3) and traverse.part(vertices, edges, 8).size() == (1, 0)
