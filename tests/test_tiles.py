"""Rows of twins that are made tile by tile: the same rows, in few bytes, by tasks that hold few sources and vertices."""

import random
from pathlib import Path

import pytest

from graphloom.graph import Graph
from graphloom.operators import incremental, kernel, traverse
from graphloom.plans.planner import collected
from graphloom.store import stored

from graphs import random_graph

HUBS = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (4, 2)]


def leaves(n, at=1_000_000, apart=1, seed=1):
    """n vertices behind the hubs, and as many as hubs behind two of them."""
    r = random.Random(seed)
    return [*HUBS, *((r.randrange(4), at + apart * k) for k in range(n)), *((h, -5 - k) for k in range(6) for h in (1, 3))]


def bytes_a_row(df, to):
    df.write.parquet(str(to))
    return sum(f.stat().st_size for f in Path(to).glob("*.parquet")) / df.sparkSession.read.parquet(str(to)).count()


def searched(g):
    """Rows of a search from each vertex."""
    c = collected(g)
    out = []
    for k, s in enumerate(c.ids.tolist()):
        d, sigma, _ = kernel.paths(c, k)
        out += zip([s] * len(c), c.ids.tolist(), d.tolist(), sigma.tolist())
    return sorted(out)


def test_rows_of_a_state_take_few_bytes(spark, tmp_path):
    g = Graph.from_list(spark, leaves(3000))
    state = incremental.SourceState(g)
    state.insert(0, 2)
    assert bytes_a_row(state.table, tmp_path / "inserted") < 1.0
    state.delete(1, 2)
    assert bytes_a_row(state.table, tmp_path / "deleted") < 1.0


@pytest.mark.parametrize("apart", [1, 5000])
def test_tiles_give_the_rows_of_all_searches(spark, monkeypatch, apart):
    monkeypatch.setattr(traverse, "TILE", 4)
    g = Graph.from_list(spark, [*leaves(40, apart=apart), (-90, -91), (-92, -91)], n=6)
    same = stored(g.twins())
    rows = stored(traverse.sssp(g, same.select("rep").distinct()))
    assert sorted(map(tuple, traverse.in_tiles(rows, same).collect())) == searched(g)


@pytest.mark.parametrize("seed", range(4))
def test_states_in_tiles_equal_searches(spark, monkeypatch, seed):
    monkeypatch.setattr(traverse, "TILE", 2)
    n, e = random_graph(seed)
    g = Graph.from_list(spark, [*e, *((seed % n, n + k) for k in range(5))])
    state = incremental.SourceState(g)
    state.insert(n, n + 1)
    assert sorted(map(tuple, state.table.collect())) == searched(state.graph)
    state.delete(*e[0])
    assert sorted(map(tuple, state.table.collect())) == searched(state.graph)
