"""Traversal: distances, path counts, shortest paths, connected components.

The relational plans advance one level a step for all sources at once: frontier joined with arcs, new vertices
by anti-join with what is settled, path counts summed by vertex. Each level is a stored table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, ends
from ..plans.planner import collected, shared, strategy
from ..store import broadcast_if_small, stored, stored_with
from . import kernel


def kept(graph: Graph) -> Graph:
    """The graph as stored tables, for plans that read it at each level. What the edges are made of is read once."""
    edges = stored(graph.edges)
    return Graph(stored(ends(edges).distinct() if graph.covered else graph.vertices), edges, graph.covered)


def _levels(graph: Graph, sources: DataFrame) -> list[DataFrame]:
    """(s, v, d, sigma) by distance."""
    starts = sources.select(F.col(sources.columns[0]).cast("long").alias("s")).join(graph.vertices.withColumnRenamed("id", "s"), "s", "left_semi").distinct()
    return advanced(graph.arcs.toDF("v", "t"), starts)


def advanced(arcs: DataFrame, starts: DataFrame, side: tuple = ()) -> list[DataFrame]:
    """(s, v, d, sigma) by distance along arcs(v, t) from starts(s). Columns in side tell apart graphs that are
    searched at once; arcs, starts and what comes out have them too."""
    key = [*side, "s", "v"]
    front = stored(starts.select(*side, "s", F.col("s").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    out = []
    while front.limit(1).count():
        out.append(front)
        # a neighbour of a level is in it, in the one before, or new
        known = reduce(DataFrame.union, [x.select(*key) for x in out[-2:]]).hint("merge")  # small files of many rows
        step = front.hint("merge").join(arcs, [*side, "v"]).groupBy(*side, "s", F.col("t").alias("v")).agg(F.sum("sigma").alias("sigma"))
        front = stored(step.join(known, key, "left_anti").select(*key, F.lit(len(out)).alias("d"), "sigma"))
    return out


def sssp(graph: Graph, sources: DataFrame, wanted: str | None = None) -> DataFrame:
    """s, v, dist, sigma (number of shortest paths) for every source and vertex; -1 and 0 where there is no path."""
    if strategy(graph, wanted) == "relational":
        graph = kept(graph)
        levels = _levels(graph, sources)
        if not levels:
            return sources.sparkSession.createDataFrame([], "s long, v long, dist int, sigma double")
        found = reduce(DataFrame.union, levels)
        starts = levels[0].select("s")
        # every source with every vertex is the result itself
        return starts.crossJoin(graph.vertices.withColumnRenamed("id", "v")).join(found, ["s", "v"], "left").select("s", "v", F.coalesce("d", F.lit(-1)).cast("int").alias("dist"), F.coalesce("sigma", F.lit(0.0)).alias("sigma"))
    csr = shared(graph, collected(graph))

    def run(batches):
        g = csr.value
        for b in batches:
            for s in b.column(0).to_pylist():
                k = int(g.at(s))
                if k < len(g) and g.ids[k] == s:
                    d, sigma, _ = kernel.paths(g, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), s)), pa.array(g.ids), pa.array(d.astype(np.int32)), pa.array(sigma)], names=["s", "v", "dist", "sigma"])

    return sources.select(F.col(sources.columns[0]).cast("long").alias("s")).distinct().mapInArrow(run, "s long, v long, dist int, sigma double")


def distances(graph: Graph, sources: DataFrame, wanted: str | None = None) -> DataFrame:
    """s, v, dist; -1 where there is no path."""
    return sssp(graph, sources, wanted).select("s", "v", "dist")


#: Twins whose rows are made from those of one of them.
TWINS = 64
#: Vertices for which a source's rows follow one another, before those of its next twin for the same vertices.
TILE = 256
#: Rows of all pairs that one task makes, about. Their number grows with the square of the vertices, a task's doesn't.
TASK_ROWS = 1 << 26


def tasks(rows: int, least: int, df: DataFrame) -> int:
    """For so many rows; least for each core."""
    return max(least * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def all_pairs(graph: Graph, wanted: str | None = None) -> DataFrame:
    """sssp from every vertex; of some twins, one is searched from and the rows of the others follow from its rows."""
    same = stored(graph.twins(most=TWINS))
    from_one = same.select(F.col("rep").alias("s")).distinct()
    rows = sssp(graph, from_one.repartition(tasks(same.count() ** 2, 4, same)), wanted)
    return expanded(rows, same)


def expanded(rows: DataFrame, same: DataFrame) -> DataFrame:
    """s, v, dist, sigma of all vertices, from those of representatives. same: id, rep, n as of twins()."""
    of = F.broadcast(same.withColumnRenamed("id", "of"))  # as many as vertices, where the result has their square
    return _of_twins(rows.withColumnRenamed("s", "rep").join(of, "rep"))


def in_tiles(rows: DataFrame, same: DataFrame) -> DataFrame:
    """expanded() for stored rows and many twins, in an order that takes few bytes and little time to store: of a tile of
    vertices, the rows of one twin after another, equal distances and path counts together. A task has a range of
    representatives and tiles: few sources, and not all vertices."""
    part = F.shiftright("id", 10).alias("part")
    twins = stored(same.groupBy("rep", "n", part).agg(F.sort_array(F.collect_list("id")).alias("twins")).drop("part"))
    reps = broadcast_if_small(stored(twins.select(F.col("rep").alias("s")).distinct()))
    rows, seen = stored_with(rows.join(reps, "s", "left_semi"), n=F.count("*"), least=F.min("s"))
    vertices = rows.where(F.col("s") == seen["least"]).count()
    tile = F.pmod(F.xxhash64("v"), F.lit(max(1, vertices // TILE))).alias("tile")  # ids may be sparse
    most = max(tasks(same.count() * vertices, 16, same), seen["n"] // (1 << 16))
    dealt = rows.select(F.col("s").alias("rep"), tile, "v", "dist", "sigma").repartitionByRange(most, "rep", "tile")
    tiles = dealt.groupBy("rep", "tile").agg(F.sort_array(F.collect_list(F.struct("dist", "sigma", "v"))).alias("rows"))
    each = tiles.join(broadcast_if_small(twins), "rep").select("rep", "n", "rows", F.explode("twins").alias("of"))
    return _of_twins(each.select("rep", "n", "of", F.inline("rows")))


def _of_twins(rows: DataFrame) -> DataFrame:
    """s, v, dist, sigma of twins (of), each with the rows of rep: they are at n paths from one another."""
    itself, other = F.col("v") == F.col("of"), F.col("v") == F.col("rep")
    dist = F.when(itself, 0).when(other, 2).otherwise(F.col("dist")).cast("int")
    sigma = F.when(itself, 1.0).when(other, F.col("n").cast("double")).otherwise(F.col("sigma"))
    return rows.select(F.col("of").alias("s"), "v", dist.alias("dist"), sigma.alias("sigma"))


def shortest_path(graph: Graph, a: int, b: int, wanted: str | None = None) -> list[int]:
    """One shortest path from a to b, both included: of the next vertices always the least. Empty if there is none.
    The walk reads one level at a time, each narrowed to the neighbours of the last vertex."""
    d = graph.vertices.sparkSession.createDataFrame([(b,)], "s long")
    dist = stored(distances(graph, d, wanted).select("v", "dist"))
    at = dist.where(F.col("v") == a).first()
    if at is None or at.dist < 0:
        return []
    path, left = [a], at.dist
    while left:
        left -= 1
        nxt = graph.arcs.where(F.col("s") == path[-1]).join(dist.where(F.col("dist") == left), F.col("t") == F.col("v")).agg(F.min("t")).first()[0]
        path.append(nxt)
    return path


def connected_components(graph: Graph, wanted: str | None = None) -> DataFrame:
    """id, component: the least id of the component; isolated vertices are their own."""
    if strategy(graph, wanted) == "kernel":
        g = collected(graph)
        spark = graph.vertices.sparkSession
        return spark.createDataFrame(pa.table({"id": g.ids, "component": g.ids[kernel.labels(g)]}).to_pandas(), "id long, component long")
    edges = stored(graph.edges.toDF("b", "a"))  # a > b
    while True:
        arcs = edges.select("a", "b").union(edges.select("b", "a"))
        low = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = arcs.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        both = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = stored(large.join(low, "a").select(F.explode(both).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        mark = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        if now.agg(*mark).first() == edges.select("a", "b").agg(*mark).first():
            break
        edges = now
    return graph.vertices.join(now.toDF("id", "c"), "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def component_sizes(graph: Graph, wanted: str | None = None) -> DataFrame:
    """component, size."""
    return connected_components(graph, wanted).groupBy("component").agg(F.count("*").alias("size"))


def component_graphs(graph: Graph, wanted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The components as graphs: component, id of all vertices, and component, u, v of all edges. Rows of one component
    are in no task of their own, so a large one stays spread; part() gives one of them as a graph."""
    names = stored(connected_components(graph, wanted))
    edges = graph.edges.join(broadcast_if_small(names).withColumnRenamed("id", "u"), "u").select("component", "u", "v")
    return names.select("component", "id"), edges


def part(vertices: DataFrame, edges: DataFrame, component: int) -> Graph:
    """One of component_graphs()."""
    own = F.col("component") == component
    return Graph(vertices.where(own).select("id"), edges.where(own).select("u", "v"))
