"""All pairs are made by tasks of bounded numbers of rows, and states in an order that is quick to store."""

from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import incremental, traverse
from graphloom.store import stored

from test_tiles import leaves, searched


def test_tasks_of_all_pairs_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(traverse, "TASK_ROWS", 200)
    g = Graph.from_list(spark, [(k, k + 1) for k in range(119)])  # no twins but the ends
    rows = stored(traverse.all_pairs(g).withColumn("task", F.spark_partition_id()))
    assert rows.select("task").distinct().count() > 32  # 16 tasks before
    assert sorted(map(tuple, rows.drop("task").collect())) == searched(g)


def test_tasks_of_a_state_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(traverse, "TASK_ROWS", 500)
    monkeypatch.setattr(traverse, "TILE", 4)
    g = Graph.from_list(spark, leaves(400))
    state = incremental.SourceState(g)
    assert state._rows.select(F.input_file_name()).distinct().count() > 2  # searches of all sources in one task before
    state.insert(0, 2)
    rows = stored(state.table.withColumn("task", F.spark_partition_id()))
    assert rows.select("task").distinct().count() > 100  # at most 64 tasks of copies, and few of the others, before
    assert sorted(map(tuple, rows.drop("task").collect())) == searched(state.graph)


def test_equal_distances_of_a_source_lie_together(spark):
    g = Graph.from_list(spark, leaves(2000))
    same, rows = stored(g.twins()), stored(traverse.sssp(g, g.twins().select("rep").distinct()))
    copies = stored(same.where("id <> rep"))
    got = traverse.in_tiles(rows, copies).select("s", "dist", "sigma").limit(100_000).toPandas()
    changes = (got != got.shift()).any(axis=1).sum()
    assert changes < len(got) / 16
