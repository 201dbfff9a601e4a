"""Decomposition: biconnected components, articulation points, bridges, and the parts left by bridges.

Graphs that the planner calls kernel are searched depth first, on the collected arrays; larger ones, and all where wanted
is "relational", by the plans on DataFrames of biconnected.py.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.planner import SEARCHED_EDGES, collected, search_strategy
from . import kernel
from .biconnected import Blocks


class GraphTooLarge(ValueError):
    pass


@dataclass
class Decomposition:
    """Arrays over one graph: edges u, v with their block, and branches (block, vertex, outside size)."""

    g: kernel.Csr
    u: np.ndarray
    v: np.ndarray
    block: np.ndarray
    branch_block: np.ndarray
    branch_vertex: np.ndarray
    branch_size: np.ndarray

    @staticmethod
    def of(g: kernel.Csr) -> Decomposition:
        u, v, b = kernel.blocks(g)
        if len(b):  # a block is numbered by its least edge
            if not (np.diff(u * len(g) + v) > 0).all():
                order = np.lexsort((v, u))
                u, v, b = u[order], v[order], b[order]
            first = np.full(b.max() + 1, len(b))
            np.minimum.at(first, b, np.arange(len(b)))
            b = np.unique(first[b], return_inverse=True)[1]
        return Decomposition(g, u, v, b, *kernel.branches(g, u, v, b))

    @staticmethod
    def of_graph(graph: Graph) -> Decomposition:
        if search_strategy(graph) != "kernel":
            raise GraphTooLarge(f"this needs the decomposition as arrays; more than {SEARCHED_EDGES} edges would be searched")
        return Decomposition.of(collected(graph))

    def block_of(self, a: int, b: int) -> int | None:
        """The block of the edge between places a and b."""
        k = np.flatnonzero((self.u == min(a, b)) & (self.v == max(a, b)))
        return int(self.block[k[0]]) if len(k) else None

    def bridges(self) -> np.ndarray:
        return np.bincount(self.block)[self.block] == 1 if len(self.block) else np.empty(0, bool)

    def is_articulation(self) -> np.ndarray:
        return np.bincount(self.branch_vertex, minlength=len(self.g)) > 1

    def outside(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The vertices of a block, and how many others hang off each outside it."""
        own = self.branch_block == block
        vertices = self.branch_vertex[own]
        sums = np.zeros(len(self.g), np.int64)
        np.add.at(sums, self.branch_vertex, self.branch_size)
        return vertices, sums[vertices] - self.branch_size[own]

    def regions(self) -> np.ndarray:
        """For each vertex the least place in its part after all bridges are deleted."""
        k = ~self.bridges()
        return kernel.labels(kernel.Csr.of(np.arange(len(self.g)), self.u[k], self.v[k]))

    def region_outside(self, root: int) -> tuple[np.ndarray, np.ndarray]:
        """The vertices of a bridge-free part, and how many others hang off each by bridges."""
        region = self.regions()
        vertices = np.flatnonzero(region == root)
        out = np.zeros(len(self.g), np.int64)
        bridge = self.bridges()
        hang = dict(zip(zip(self.branch_block.tolist(), self.branch_vertex.tolist()), self.branch_size.tolist()))
        for u, v, b in zip(self.u[bridge].tolist(), self.v[bridge].tolist(), self.block[bridge].tolist()):
            for x in (u, v):
                if region[x] == root:
                    out[x] += hang[b, x]
        return vertices, out[vertices]


def _frame(graph: Graph, columns: dict, schema: str) -> DataFrame:
    return graph.vertices.sparkSession.createDataFrame(pd.DataFrame(columns), schema)


def biconnected_components(graph: Graph, wanted: str | None = None) -> DataFrame:
    """block_id, u, v; blocks are numbered in the order of their least edges."""
    if search_strategy(graph, wanted) == "relational":
        d = Blocks.of(graph)
        return d.edges.join(d.numbers.select("top", "block_id"), "top").select("block_id", "u", "v")
    d = Decomposition.of_graph(graph)
    ids = d.g.ids
    return _frame(graph, {"block_id": d.block, "u": ids[d.u], "v": ids[d.v]}, "block_id long, u long, v long")


def _members(d: Blocks, tops: DataFrame | None = None) -> DataFrame:
    """top, id, is_art, vg of the vertices of blocks, of all or of those in tops."""
    every = d.branches.groupBy("id").agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    own = d.branches if tops is None else d.branches.join(F.broadcast(tops), "top")
    return own.join(every, "id").select("top", "id", (F.col("k") > 1).alias("is_art"), (F.col("all") - F.col("n")).alias("vg"))


def _branch_lists(d: Blocks, members: DataFrame) -> DataFrame:
    """members with branch_sizes; a list is as long as its vertex has other blocks."""
    other = d.branches.select(F.col("top").alias("other"), "id", "n")
    each = members.join(other, "id").where("other <> top").groupBy("top", "id").agg(F.sort_array(F.collect_list("n")).alias("branch_sizes"))
    return members.join(each, ["top", "id"], "left").withColumn("branch_sizes", F.coalesce("branch_sizes", F.array().cast("array<long>")))


def block_vertices(graph: Graph, wanted: str | None = None) -> DataFrame:
    """block_id, id, is_art, vg (vertices outside the block that hang off id), branch_sizes (of those, by branch)."""
    if search_strategy(graph, wanted) == "relational":
        found = Blocks.of(graph)
        return _branch_lists(found, _members(found)).join(found.numbers.select("top", "block_id"), "top").select("block_id", "id", "is_art", "vg", "branch_sizes")
    d = Decomposition.of_graph(graph)
    rows, art = [], d.is_articulation()
    by_vertex: dict[int, list[tuple[int, int]]] = {}
    for b, x, n in zip(d.branch_block.tolist(), d.branch_vertex.tolist(), d.branch_size.tolist()):
        by_vertex.setdefault(x, []).append((b, n))
    for b, x in zip(d.branch_block.tolist(), d.branch_vertex.tolist()):
        sizes = sorted(n for c, n in by_vertex[x] if c != b)
        rows.append((b, int(d.g.ids[x]), bool(art[x]), sum(sizes), sizes))
    return graph.vertices.sparkSession.createDataFrame(rows, "block_id long, id long, is_art boolean, vg long, branch_sizes array<long>")


def articulation_points(graph: Graph, wanted: str | None = None) -> DataFrame:
    """id, branches: the number of parts that are left of its component without it; each point once."""
    if search_strategy(graph, wanted) == "relational":
        return Blocks.of(graph).branches.groupBy("id").agg(F.count("*").alias("branches")).where("branches > 1")
    d = Decomposition.of_graph(graph)
    n = np.bincount(d.branch_vertex, minlength=len(d.g))
    return _frame(graph, {"id": d.g.ids[n > 1], "branches": n[n > 1]}, "id long, branches long")


def branch_sizes(graph: Graph, wanted: str | None = None) -> DataFrame:
    """id, size of every branch of every articulation point."""
    if search_strategy(graph, wanted) == "relational":
        b = Blocks.of(graph).branches
        several = b.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
        return b.join(several, "id", "left_semi").select("id", F.col("n").alias("size"))
    d = Decomposition.of_graph(graph)
    k = d.is_articulation()[d.branch_vertex]
    return _frame(graph, {"id": d.g.ids[d.branch_vertex[k]], "size": d.branch_size[k]}, "id long, size long")


def bridges(graph: Graph, wanted: str | None = None) -> DataFrame:
    """u, v."""
    if search_strategy(graph, wanted) == "relational":
        return Blocks.of(graph).bridges.select("u", "v")
    d = Decomposition.of_graph(graph)
    k = d.bridges()
    return _frame(graph, {"u": d.g.ids[d.u[k]], "v": d.g.ids[d.v[k]]}, "u long, v long")


def edge_block(graph: Graph, a: int, b: int, wanted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The block of the edge (a, b), which is added if it isn't there: its edges u, v, and id, is_art, vg,
    branch_sizes of its vertices."""
    spark = graph.vertices.sparkSession
    grown = graph.insert_edges(spark.createDataFrame([(a, b)], "u long, v long"))
    if search_strategy(grown, wanted) == "relational":
        found = Blocks.of(grown)
        top = found.edges.where((F.col("u") == min(a, b)) & (F.col("v") == max(a, b))).select("top")
        edges = found.edges.join(F.broadcast(top), "top").select("u", "v")
        return edges, _branch_lists(found, _members(found, top)).drop("top")
    d = Decomposition.of_graph(grown)
    block = d.block_of(int(d.g.at(a)), int(d.g.at(b)))
    return biconnected_components(grown).where(F.col("block_id") == block).drop("block_id"), block_vertices(grown).where(F.col("block_id") == block).drop("block_id")


def _parts(graph: Graph, d: Blocks) -> DataFrame:
    from .traverse import connected_components

    rest = graph.edges.join(d.bridges, ["u", "v"], "left_anti").select("u", "v")
    return connected_components(Graph(graph.vertices, rest), "relational").withColumnRenamed("component", "muc_id")


def bridge_free_parts(graph: Graph, wanted: str | None = None) -> DataFrame:
    """id, muc_id: the least vertex of what holds together when all bridges are deleted; single vertices too."""
    if search_strategy(graph, wanted) == "relational":
        return _parts(graph, Blocks.of(graph))
    d = Decomposition.of_graph(graph)
    return _frame(graph, {"id": d.g.ids, "muc_id": d.g.ids[d.regions()]}, "id long, muc_id long")


def parts_after_insertion(graph: Graph, parts: DataFrame, a: int, b: int) -> DataFrame:
    """id, muc_id after the edge (a, b) has come in, from bridge_free_parts of the graph before it: the parts on a
    shortest path from a to b become one. Nothing changes within a part, or where the edge joins two components."""
    from .traverse import shortest_path

    path = shortest_path(graph, a, b)
    on = parts.where(F.col("id").isin(path)).select("muc_id").distinct() if path else parts.select("muc_id").limit(0)
    least = F.min("muc_id").over(Window.partitionBy(F.lit(0)))  # the parts of one path
    merged = on.select(F.col("muc_id").alias("old"), least.alias("new"))
    return parts.join(F.broadcast(merged), F.col("muc_id") == F.col("old"), "left").select("id", F.coalesce("new", "muc_id").alias("muc_id"))


def count_parts(graph: Graph, least: int = 1, wanted: str | None = None) -> int:
    """How many bridge-free parts have at least so many vertices."""
    return bridge_free_parts(graph, wanted).groupBy("muc_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).count()


def connection_vertices(graph: Graph, wanted: str | None = None) -> DataFrame:
    """muc_id, id, outside_size: ends of bridges, and how many vertices are behind their bridges."""
    if search_strategy(graph, wanted) == "relational":
        found = Blocks.of(graph)
        behind = found.branches.join(found.bridges.select("top"), "top", "left_semi").groupBy("id").agg(F.sum("n").alias("outside_size"))
        return behind.join(_parts(graph, found), "id").select("muc_id", "id", "outside_size")
    d = Decomposition.of_graph(graph)
    region, k, rows = d.regions(), d.bridges(), {}
    hang = dict(zip(zip(d.branch_block.tolist(), d.branch_vertex.tolist()), d.branch_size.tolist()))
    for u, v, b in zip(d.u[k].tolist(), d.v[k].tolist(), d.block[k].tolist()):
        for x in (u, v):
            rows[x] = rows.get(x, 0) + hang[b, x]
    return graph.vertices.sparkSession.createDataFrame([(int(d.g.ids[region[x]]), int(d.g.ids[x]), n) for x, n in sorted(rows.items())], "muc_id long, id long, outside_size long")


def largest_block(graph: Graph, by: str = "vertices", wanted: str | None = None) -> int | None:
    """The number of the block with most vertices (or edges, or both together: size); the least of equals."""
    if search_strategy(graph, wanted) == "relational":
        found = Blocks.of(graph)
        n = found.branches.groupBy("top").agg(F.count("*").alias("n"))
        size = {"vertices": F.col("n"), "edges": F.col("n_edges"), "size": F.col("n") + F.col("n_edges")}[by]
        return found.numbers.join(n, "top").agg(F.max_by("block_id", F.struct(size, -F.col("block_id")))).first()[0]
    d = Decomposition.of_graph(graph)
    if not len(d.block):
        return None
    m, n = np.bincount(d.block), np.bincount(d.branch_block)
    return int({"vertices": n, "edges": m, "size": n + m}[by].argmax())
