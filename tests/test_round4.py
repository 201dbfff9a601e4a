"""Updates on DataFrames: new vertices, and one search for the graph before and after."""

import os

import pytest

from graphloom.graph import Graph
from graphloom.operators import betweenness, incremental
from graphloom.store import shared_dir

from graphs import brandes


def got(df):
    return {r.id: r.bc for r in df.collect()}


def test_relational_insert_of_new_vertices(spark):
    e = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (2, 5)]
    g = Graph.from_list(spark, e)
    for a, b in ((9, 2), (2, 9), (8, 9)):
        assert got(incremental.update(g, betweenness.brandes(g), a, b, "insert", wanted="relational")) == pytest.approx(brandes([*e, (a, b)]))


def test_relational_update_searches_both_graphs_at_once(spark):
    e = [(k, k + 1) for k in range(6)]
    g = Graph.from_list(spark, e)
    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    out = incremental.delta(g, 1, 4, "insert", "graph", wanted="relational")
    # the graph, levels of the ends, sources, levels of both graphs there and back; 42 when each was searched by itself
    assert len(set(os.listdir(at)) - before) <= 27
    want, old = brandes([*e, (1, 4)]), brandes(e)
    assert {r.id: r.delta for r in out.collect() if r.delta} == pytest.approx({k: want[k] - old[k] for k in want if want[k] != old[k]})
