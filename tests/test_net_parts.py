"""Graphs written in parts by many tasks, and read back."""

import random

import pytest

from graphloom.graph import Graph
from graphloom.sources.text import read_graph, write_graph


@pytest.mark.parametrize("parts", [1, 7])
def test_parts(spark, tmp_path, parts):
    r = random.Random(parts)
    e = {tuple(sorted(r.sample(range(500), 2))) for _ in range(900)}
    g = Graph.from_list(spark, sorted(e), 503)
    path = f"{tmp_path}/g.net"
    write_graph(Graph(g.vertices, g.edges.repartition(parts)), path)
    files = sorted(x for x in (tmp_path / "g.net").iterdir() if x.name.startswith("part-"))
    assert files[0].read_text().startswith(f"503 {len(e)}\n") and len(files) >= parts
    back = read_graph(spark, path)
    assert back.size() == (503, len(e)) and {tuple(x) for x in back.edges.collect()} == e


def test_no_edges(spark, tmp_path):
    write_graph(Graph.from_list(spark, [], 4), f"{tmp_path}/g.net")
    assert read_graph(spark, f"{tmp_path}/g.net").size() == (4, 0)


def test_empty_file(spark, tmp_path):
    (tmp_path / "g.net").write_text("")
    with pytest.raises(ValueError):
        read_graph(spark, f"{tmp_path}/g.net")
