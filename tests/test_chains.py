"""Searches over the ends of chains only, and searches of large graphs in slices of arcs."""

import tracemalloc

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.operators import betweenness, kernel
from graphloom.operators.chains import Chains

from graphs import brandes


def chained(seed, longest=9):
    r = np.random.default_rng(seed)
    n = int(r.integers(4, 12))
    e = {(min(a, b), max(a, b)) for a, b in ((k, (k + 1) % n) for k in range(n))}
    e |= {tuple(sorted(map(int, r.choice(n, 2, replace=False)))) for _ in range(int(r.integers(1, 12)))}
    out = []
    for a, b in sorted(e):
        way = [a, *range(n, n + int(r.integers(longest))), b]
        n += len(way) - 2
        out += list(zip(way, way[1:]))
    name = r.permutation(n)
    return n, [(int(name[a]), int(name[b])) for a, b in out]


def test_chains_give_the_same_dependencies():
    used = 0
    for seed in range(60):
        n, e = chained(seed)
        r = np.random.default_rng(seed)
        weight, times = r.integers(1, 6, n).astype(float), r.integers(1, 4, n) / 2
        g = kernel.Csr.of(np.arange(n), *np.array(e).T)
        chains = Chains.of_graph(g, weight)
        if chains is not None:
            used += 1
            want = sum(k * kernel.dependencies(g, s, weight) for s, k in enumerate(times))
            assert chains.dependencies_of(np.arange(n), times) == pytest.approx(want, rel=1e-10)
    assert used > 40


def test_betweenness_of_chains(spark):
    n, e = chained(3, 30)
    e += [(0, n), (n, n + 1)]
    got = {r.id: r.bc for r in betweenness.by_blocks(Graph.from_list(spark, e)).collect()}
    assert got == pytest.approx(brandes(e), abs=1e-8)


def test_long_chains_are_not_walked_level_by_level(monkeypatch):
    """A ring of 60 ends with chains of 200 between them and some chords: levels of a search are few."""
    ends, length = 60, 200
    e = [(k * length + i, (k * length + i + 1) % (ends * length)) for k in range(ends) for i in range(length)]
    e += [(k * length, (k + 7) % ends * length) for k in range(ends)]
    g = kernel.Csr.of(np.arange(ends * length), *np.array(e).T)
    chains = Chains.of_graph(g, np.ones(len(g)))
    seen = []
    real = Chains._searched
    monkeypatch.setattr(Chains, "_searched", lambda *a: seen.append(real(*a)) or seen[-1])
    got = chains.dependencies_of(np.array([5, 200]), np.ones(2))
    assert got == pytest.approx(kernel.dependencies(g, 5, np.ones(len(g))) + kernel.dependencies(g, 200, np.ones(len(g))))
    assert all(len(dag) <= ends for dag in seen)


def test_slices_give_the_same_dependencies():
    for seed in range(20):
        n, e = chained(seed)
        g = kernel.Csr.of(np.arange(n + 2), *np.array([*e, (n, n + 1)]).T)
        weight = np.random.default_rng(seed).integers(1, 6, n + 2).astype(float)
        for s in range(0, n + 2, 5):
            assert kernel._dependencies_in_slices(g, s, weight, 3) == pytest.approx(kernel.dependencies(g, s, weight))


def test_large_graphs_are_searched_without_keeping_arcs():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 20_000, (2, 1_500_000))
    g = kernel.Csr.of(np.arange(20_000), u[u != v], v[u != v])
    tracemalloc.start()
    kernel.dependencies(g, 0, np.ones(len(g)))
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def searched(monkeypatch, chains, sources, times):
    """Sums, and how many searches they took."""
    count = []
    real = Chains._searched
    monkeypatch.setattr(Chains, "_searched", lambda *a: count.append(1) or real(*a))
    return chains.dependencies_of(sources, times), len(count)


def test_sources_near_one_end_share_a_search(monkeypatch):
    """Long chains between ends that a few hops join: two searches a chain, and some around its middle."""
    r = np.random.default_rng(5)
    ends, length = 20, 60
    e = [(length * k + i, length * k + i + 1) for k in range(ends) for i in range(length - 1)]
    e += {(length * int(a) + length - 1, length * int(b)) for a, b in r.integers(0, ends, (100, 2))}
    g = kernel.Csr.of(np.arange(ends * length), *np.array(e).T)
    weight, times = r.integers(1, 6, len(g)).astype(float), r.integers(1, 4, len(g)) / 2
    chains = Chains.of_graph(g, weight)
    got, n = searched(monkeypatch, chains, np.arange(len(g)), times)
    assert got == pytest.approx(sum(k * kernel.dependencies(g, s, weight) for s, k in enumerate(times)), rel=1e-9)
    assert n <= 7 * ends  # 60 a chain, a search for each source


@pytest.mark.parametrize("longest", [4, 9, 40])
def test_any_sources_of_chains(longest):
    """Some sources only, some of one end without it, both ways of equal length, several chains between the same ends."""
    used = 0
    for seed in range(60 if longest < 40 else 15):
        n, e = chained(seed, longest)
        r = np.random.default_rng(seed)
        for k in range(int(r.integers(3))):  # beside an edge, and beside the first
            a, b = e[int(r.integers(len(e)))]
            way = [a, *range(n, n + int(r.integers(1, longest))), b]
            n += len(way) - 2
            e += zip(way, way[1:])
        weight = r.integers(1, 6, n).astype(float)
        g = kernel.Csr.of(np.arange(n), *np.array(e).T)
        chains = Chains.of_graph(g, weight)
        if chains is not None:
            used += 1
            some = r.permutation(n)[: int(r.integers(1, n + 1))]
            times = r.integers(1, 4, len(some)) / 2
            want = sum(k * kernel.dependencies(g, s, weight) for s, k in zip(some.tolist(), times))
            assert chains.dependencies_of(some, times) == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert used > 10


@pytest.mark.parametrize("most", [1, 7, 30, 1000])
def test_tasks_hold_all_sources_once(most):
    n, e = chained(4, 30)
    g = kernel.Csr.of(np.arange(n), *np.array(e).T)
    chains = Chains.of_graph(g, np.ones(n))
    sources = np.arange(0, n, 2)
    order, begin = chains.tasks_of(sources, most)
    sizes = np.diff([*begin, len(order)])
    assert sorted(order.tolist()) == list(range(len(sources)))
    assert begin[0] == 0 and (sizes > 0).all() and (sizes < 2 * most).all()
    near = chains.nearest(sources)[order]
    for a in begin[1:].tolist():
        assert near[a] != near[a - 1] or (near == near[a]).sum() > most
