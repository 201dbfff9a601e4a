"""The pass for sources whose distances stay the same, against two whole searches."""

import random

import numpy as np
from graphs import brandes, random_graph

from graphloom.graph import Graph
from graphloom.operators import incremental, kernel


def test_one_pass_equals_two_searches():
    r, edges, sources = random.Random(11), 0, 0
    while edges < 300:
        n, e = random_graph(r.randrange(10**6))
        u, v = np.array(e).T
        g = kernel.Csr.of(np.arange(n), u, v)
        op, a, b = r.choice(["insert", "delete"]), *sorted(r.sample(range(n), 2))
        work = incremental._work(g, a, b, op, "graph")
        if not isinstance(work, incremental._Work):
            continue
        edges += 1
        x, y = (int(work.with_edge.at(k)) for k in (a, b))
        weight = work.weight + np.array([r.randrange(3) for _ in work.weight])
        held = (work.without, work.with_edge, x, y, weight)
        assert work.plan.at_once == work.same.sum() and set(np.flatnonzero(work.same)) <= set(work.sources)
        for s in np.flatnonzero(work.same).tolist():
            sources += 1
            two = incremental._dependencies_both(work.without, work.with_edge, s, weight)
            assert np.allclose(incremental._change_at_once(held, s), two) and np.allclose(incremental._change(held, s), two)
    assert sources > 300


def test_updates_take_it(spark, monkeypatch):
    # a ring of eight with a chord
    e = [(k, (k + 1) % 8) for k in range(8)] + [(1, 6)]
    g = Graph.from_list(spark, e)
    for op, a, b in (("insert", 0, 2), ("insert", 2, 5), ("delete", 1, 6), ("delete", 3, 4)):
        plan = incremental.explain(g, a, b, op, "graph")
        assert plan.at_once <= plan.near
        after = [x for x in e if set(x) != {a, b}] + ([(a, b)] if op == "insert" else [])
        before, want = brandes(e), brandes(after)
        got = {r.id: r.delta for r in incremental.delta(g, a, b, op, "graph").collect()}
        assert all(abs(want[v] - before[v] - got.get(v, 0.0)) < 1e-9 for v in want)
    assert incremental.explain(g, 2, 5, "insert", "graph").at_once > 0
