"""Searches of 64 edges at once, against one search from each end, and speedup information from them."""

import random

import numpy as np
import pytest
from graphs import AP21, TOY, edges, random_graph

from graphloom.functions import stats
from graphloom.graph import Graph
from graphloom.operators import bitsearch, incremental, kernel


def by_one(n, e, a, b, some=None):
    """d0, d1, d2 of the vertices, or of some, from one search from each end without the edge."""
    u, v = np.array([x for x in e if set(x) != {a, b}] or np.zeros((0, 2)), int).reshape(-1, 2).T
    g = kernel.Csr.of(np.arange(n), u, v)
    gap = np.abs(kernel.distances(g, a) - kernel.distances(g, b))[slice(None) if some is None else some]
    return [int((gap == 0).sum()), int((gap == 1).sum()), int((gap >= 2).sum())]


def all_pairs_of(n):
    return [(a, b) for a in range(n) for b in range(a + 1, n)]


@pytest.mark.parametrize("seed", range(30))
def test_arrays(seed):
    n, e = random_graph(seed)
    n += seed % 3  # isolated vertices
    if seed % 4 == 0:
        e = e[1:]  # components
    u, v = np.array(e).T
    g, pairs = kernel.Csr.of(np.arange(n), u, v), all_pairs_of(n)
    for k in range(0, len(pairs), bitsearch.WORD):
        a, b = np.array(pairs[k : k + bitsearch.WORD]).T
        c0, c1, ra, rb, ends, met = bitsearch.search(g, a, b)
        for j, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            assert met[j] == c0[j] + c1[j] and ends[j] == 2
            d0 = c0[j] + n - (ra[j] if met[j] else ra[j] + rb[j])
            d1 = c1[j] if met[j] else 2
            assert [d0, d1, n - d0 - d1] == by_one(n, e, x, y), (x, y)


@pytest.mark.parametrize("wanted", ["kernel", "relational"])
@pytest.mark.parametrize("seed", [3, 5])
def test_gaps(spark, wanted, seed):
    n, e = random_graph(seed)
    pairs = all_pairs_of(n)
    assert (len(pairs) > bitsearch.WORD) == (seed == 5)
    r = random.Random(seed)
    some = {(k, x) for k in range(len(pairs)) for x in range(n) if r.random() < 0.5 or k == 0}
    g, df = Graph.from_list(spark, e, n), spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, a long, b long")
    got = {x.k: [x.n, x.d0, x.d1, x.d2] for x in bitsearch.gaps(g, df, wanted=wanted).collect()}
    assert got == {k: [n, *by_one(n, e, *p)] for k, p in enumerate(pairs)}
    within = spark.createDataFrame(sorted(some), "k long, id long")
    got = {x.k: [x.n, x.d0, x.d1, x.d2] for x in bitsearch.gaps(g, df, within, wanted).collect()}
    for k, p in enumerate(pairs):
        own = [x for x in range(n) if (k, x) in some]
        assert got[k] == [len(own), *by_one(n, e, *p, own)]


@pytest.mark.parametrize("wanted", [None, "relational"])
def test_speedup_info(spark, wanted):
    e = edges(TOY) + [(30, 31), (31, 32), (30, 32)]
    g = Graph.from_list(spark, e, 34)  # two components, and an isolated vertex
    drawn = [(3, 18), (0, 1), (2, 19), (5, 9), (17, 30), (1, 3), (33, 4), (30, 31), (6, 12)]
    got = {(r.u, r.v): r for r in stats.speedup_info(g, spark.createDataFrame(drawn, "u long, v long"), wanted=wanted).collect()}
    assert set(got) == {(min(p), max(p)) for p in drawn}
    have = {tuple(sorted(x)) for x in e}
    for (a, b), r in got.items():
        if wanted is None:
            p = incremental.explain(g, a, b, "delete" if (a, b) in have else "insert")
            if p.op in ("insert", "delete"):
                assert (r.n, r.m, r.d0, r.d1 + r.d2) == (p.block_vertices, p.block_edges, p.pruned, p.sources), (a, b)
        assert r.n == r.d0 + r.d1 + r.d2 and r.frac == pytest.approx(1 - r.d0 / r.n)
        part = r.n / 34 * r.frac * (r.n + r.m) / (34 + len(have))
        assert r.speedup_120 == pytest.approx(100 / 120 / part) if r.frac else r.speedup_120 is None
    assert (got[17, 30].n, got[17, 30].m, got[17, 30].d0, got[17, 30].d1) == (2, 1, 0, 2)


def test_largest_block(spark):
    g = Graph.from_list(spark, edges(AP21))
    each, total = stats.largest_block_speedups(g, 100, 5)
    each, total = each.collect(), {r.stat: r for r in total.collect()}
    d = stats.block_sizes(g).collect()
    n, m = max(((r.n, r.m) for r in d), key=sum)
    assert {r.n for r in each} == {n} and len(each) == m
    inside = {(r.u, r.v) for r in each}
    ids = sorted({x for p in inside for x in p})
    at = {x: k for k, x in enumerate(ids)}
    for r in each:
        assert [r.d0, r.d1, r.d2] == by_one(n, [(at[a], at[b]) for a, b in inside], at[r.u], at[r.v])
    shares = np.array([r.d0 / n for r in each])
    assert total["mean"].frac_d0 == pytest.approx(shares.mean()) and total["stddev"].frac_d0 == pytest.approx(shares.std())
    assert total["median"].frac_d0 == sorted(shares)[m // 2] and total["max"].frac_d0 == shares.max()
    gn, gm = g.size()
    assert total["min"].speedup_120 == pytest.approx(100 / 120 / (n / gn * (1 - shares.min()) * (n + m) / (gn + gm)))
    few, _ = stats.largest_block_speedups(g, 3, 5)
    assert {(r.u, r.v) for r in few.collect()} < inside


def test_empty(spark):
    g = Graph.from_list(spark, [], 0)
    assert all(df.count() == 0 for df in stats.largest_block_speedups(g, 3))
    one = Graph.from_list(spark, [(0, 1)])
    assert stats.speedup_info(one, spark.createDataFrame([], "u long, v long")).count() == 0
    r = stats.speedup_info(one, spark.createDataFrame([(1, 0)], "u long, v long")).first()
    assert (r.n, r.m, r.d0, r.d1, r.d2) == (2, 1, 0, 2, 0)
