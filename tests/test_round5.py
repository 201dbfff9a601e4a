"""A graph is stored from one reading of what its edges are made of."""

import uuid

from graphloom.graph import Graph
from graphloom.operators import traverse


def counted(spark, edges, at):
    """The pairs, in one partition, with a file for each time that they are made."""

    def run(batches):
        (at / uuid.uuid4().hex).touch()
        yield from batches

    return spark.createDataFrame(edges, "u long, v long").coalesce(1).mapInArrow(run, "u long, v long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_kept_graph_reads_its_pairs_once(spark, tmp_path):
    g = traverse.kept(Graph.of(counted(spark, [(2, 1), (1, 2), (3, 1), (4, 4)], tmp_path)))
    assert rows(g.edges) == [(1, 2), (1, 3)] and rows(g.vertices) == [(1,), (2,), (3,)]
    assert len(list(tmp_path.iterdir())) == 1


def test_a_kept_graph_keeps_vertices_without_edges(spark):
    for g in (Graph.from_list(spark, [(0, 1)], 4), Graph.of(spark.createDataFrame([(0, 1), (2, 3)], "u long, v long")).remove_edges(spark.createDataFrame([(2, 3)], "u long, v long"))):
        kept = traverse.kept(traverse.kept(g))
        assert rows(kept.edges) == [(0, 1)] and rows(kept.vertices) == [(0,), (1,), (2,), (3,)]
