"""Exact betweenness: of unordered pairs, ends not counted, not normalised."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.planner import collected, shared, strategy
from ..store import stored
from . import kernel
from .blocks import Decomposition
from .chains import Chains
from .traverse import _levels, kept, sssp


def spread(sources: DataFrame) -> DataFrame:
    """Sources dealt out evenly, a few to each task slot, as their costs differ."""
    return sources.repartition(4 * sources.sparkSession.sparkContext.defaultParallelism)


def naive(graph: Graph, wanted: str | None = None) -> DataFrame:
    """id, bc by its definition: every vertex between every pair. For small graphs and as a second opinion.
    Twins are counted by their number, as a vertex between them and others, or they as a pair, is the same for all."""
    same = stored(graph.twins())
    kinds = stored(same.groupBy("rep").agg(F.count("*").cast("double").alias("w"), F.max("n").cast("double").alias("n")))
    r = sssp(graph, kinds.select("rep"), wanted).where("dist >= 0").join(kinds.hint("merge"), F.col("v") == F.col("rep"))
    # rows of a vertex with itself become those with its twins, each pair from both ends
    itself = F.col("s") == F.col("v")
    pairs = F.when(itself, F.col("w") * (F.col("w") - 1) / 2).otherwise(F.col("w"))
    r = stored(r.select("s", "v", F.when(itself, 2).otherwise(F.col("dist")).alias("dist"), F.when(itself, F.col("n")).otherwise(F.col("sigma")).alias("sigma"), pairs.alias("w")))
    apart = r.where("s <> v").select("s", "v", "dist", "sigma")
    x, y, z = apart.toDF("s", "m", "d1", "g1"), apart.toDF("m", "t", "d2", "g2"), r.where("s < v or (s = v and w > 0)").toDF("s", "t", "d", "g", "w")
    many = kinds.select(F.col("rep").alias("s"), F.col("w").alias("ws"))
    z = z.join(many, "s").select("s", "t", "d", "g", F.when(F.col("s") == F.col("t"), F.col("w")).otherwise(F.col("w") * F.col("ws")).alias("w"))
    between = x.hint("merge").join(y, "m").where("s <= t").join(z.hint("merge"), ["s", "t"]).where("d1 + d2 = d")
    sums = between.groupBy("m").agg(F.sum(F.col("w") * F.col("g1") * F.col("g2") / F.col("g")).alias("bc"))
    return same.join(sums, F.col("rep") == F.col("m"), "left").select("id", F.coalesce("bc", F.lit(0.0)).alias("bc"))


def first_sources(graph: Graph, k: int | None) -> DataFrame:
    ids = graph.vertices.select("id")
    return ids if k is None else ids.orderBy("id").limit(k)


def brandes(graph: Graph, max_sources: int | None = None, halve: bool | None = None, wanted: str | None = None) -> DataFrame:
    """id, bc. With max_sources, only of that many sources, the least ids, and by default not halved."""
    half = (max_sources is None) if halve is None else halve
    sources = alike(graph, graph.vertices) if max_sources is None else first_sources(graph, max_sources).withColumn("w", F.lit(1.0))
    if strategy(graph, wanted) == "kernel":
        sums = _kernel_sums(graph, sources)
    else:
        sums = _relational_sums(graph, sources)
    return graph.vertices.join(sums, "id", "left").select("id", (F.coalesce("delta", F.lit(0.0)) * (0.5 if half else 1.0)).alias("bc"))


def alike(graph: Graph, sources: DataFrame, apart: tuple = ()) -> DataFrame:
    """id, w: one source for each kind of twins, and how many of the sources are of that kind. Twins have the same
    dependencies on all vertices but themselves, and none on one another."""
    same = graph.twins(apart).hint("merge")
    return sources.distinct().join(same, "id").groupBy(F.col("rep").alias("id")).agg(F.count("*").cast("double").alias("w"))


def _kernel_sums(graph: Graph, sources: DataFrame) -> DataFrame:
    """id, delta: sums over sources (id, w)."""
    csr = shared(graph, collected(graph))

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                g = csr.value  # a task without sources needs no graph
                total = np.zeros(len(g)) if total is None else total
                for k, w in zip(g.at(b.column(0).to_numpy()), b.column(1).to_pylist()):
                    total += w * kernel.dependencies(g, int(k), np.ones(len(g)))
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[some]), pa.array(total[some])], names=["id", "delta"])

    return spread(sources).mapInArrow(run, "id long, delta double").groupBy("id").agg(F.sum("delta").alias("delta"))


def _relational_sums(graph: Graph, sources: DataFrame) -> DataFrame:
    graph, sources = kept(graph), stored(sources)
    found = dependencies(_levels(graph, sources.select("id")), graph.arcs.toDF("p", "v"))
    if found is None:
        return graph.vertices.select("id", F.lit(0.0).alias("delta"))
    weights = sources.toDF("s", "w").hint("merge")
    return found.join(weights, "s").groupBy("id").agg(F.sum(F.col("delta") * F.col("w")).alias("delta"))


def dependencies(levels: list[DataFrame], arcs: DataFrame, side: tuple = ()) -> DataFrame | None:
    """s, id, delta of every source and vertex where it isn't 0, from the levels along arcs(p, v); None if there is
    one level only. Columns in side as in advanced()."""
    key, deltas, below = [*side, "s", "v"], [], None
    for k in range(len(levels) - 1, 0, -1):
        level = levels[k]
        known = level if below is None else level.hint("merge").join(below, key, "left")
        now = known.select(*key, "d", "sigma", F.coalesce(F.col("delta") if below is not None else F.lit(0.0), F.lit(0.0)).alias("delta"))
        now = stored(now)
        deltas.append(now.where("delta <> 0").select(*side, "s", F.col("v").alias("id"), "delta"))
        up = levels[k - 1].select(*side, "s", F.col("v").alias("p"), F.col("sigma").alias("sp"))
        below = now.hint("merge").join(arcs, [*side, "v"]).join(up.hint("merge"), [*side, "s", "p"]).groupBy(*side, "s", F.col("p").alias("v")).agg(F.sum(F.col("sp") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
    return reduce(DataFrame.union, deltas) if deltas else None


def one_source(graph: Graph, source: int, wanted: str | None = None) -> DataFrame:
    """id, bc: what one source adds, not halved."""
    only = graph.vertices.where(F.col("id") == source).select("id", F.lit(1.0).alias("w"))
    sums = _kernel_sums(graph, only) if strategy(graph, wanted) == "kernel" else _relational_sums(graph, only)
    return graph.vertices.join(sums, "id", "left").select("id", F.coalesce("delta", F.lit(0.0)).alias("bc"))


def exact(graph: Graph) -> DataFrame:
    """id, bc of the whole graph, by blocks where it can be had as arrays."""
    graph = kept(graph)
    return by_blocks(graph) if strategy(graph) == "kernel" else brandes(graph, wanted="relational")


def by_blocks(graph: Graph) -> DataFrame:
    """id, bc from one weighted pass in each block: a vertex stands for those that hang off it outside."""
    d = Decomposition.of_graph(graph)
    parts = {}
    size = np.bincount(d.branch_block) if len(d.branch_block) else np.empty(0, np.int64)
    hang = np.bincount(d.branch_vertex, d.branch_size, len(d.g))
    order = np.argsort(d.block, kind="stable")
    edge, vertex = (np.searchsorted(x, np.arange(len(size) + 1)) for x in (d.block[order], d.branch_block))  # branches are in order
    for b in np.flatnonzero(size >= 3).tolist():
        k, own = order[edge[b] : edge[b + 1]], slice(vertex[b], vertex[b + 1])
        parts[b] = (d.branch_vertex[own], hang[d.branch_vertex[own]] - d.branch_size[own], d.u[k], d.v[k])
    squares = np.zeros(len(d.g))
    np.add.at(squares, d.branch_vertex, d.branch_size.astype(np.float64) ** 2)
    return _by_parts(graph, d, parts, squares, np.bincount(d.branch_vertex, minlength=len(d.g)) > 0)


def by_bridge_free_parts(graph: Graph) -> DataFrame:
    """id, bc from one weighted pass in each bridge-free part: a vertex stands for those behind its bridges."""
    d = Decomposition.of_graph(graph)
    region, bridge = d.regions(), d.bridges()
    hang = dict(zip(zip(d.branch_block.tolist(), d.branch_vertex.tolist()), d.branch_size.tolist()))
    behind, squares = np.zeros(len(d.g)), np.zeros(len(d.g))
    for u, v, b in zip(d.u[bridge].tolist(), d.v[bridge].tolist(), d.block[bridge].tolist()):
        for x in (u, v):
            behind[x] += hang[b, x]
            squares[x] += float(hang[b, x]) ** 2
    within = kernel.labels(d.g)
    squares += (np.bincount(within, minlength=len(d.g))[within] - 1 - behind) ** 2  # the part itself is one more side
    parts = {}
    for r in np.flatnonzero(np.bincount(region, minlength=len(d.g)) >= 3).tolist():
        vertices, k = np.flatnonzero(region == r), ~bridge & (region[d.u] == r)
        parts[r] = (vertices, behind[vertices], d.u[k], d.v[k])
    return _by_parts(graph, d, parts, squares, np.ones(len(d.g), bool))


def _by_parts(graph: Graph, d: Decomposition, parts: dict, squares: np.ndarray, linked: np.ndarray) -> DataFrame:
    """parts: vertices, what each stands for outside, and edges, by places. squares: of the sizes of what is left of
    a vertex's component when it goes, side by side, and which vertices have such sides."""
    spark = graph.vertices.sparkSession
    weighted, jobs, share = {}, [], 4 * spark.sparkContext.defaultParallelism
    for b in list(parts):
        vertices, out, u, v = parts.pop(b)
        h = kernel.Csr.of(vertices, u, v)
        weight = np.ones(len(h))
        weight[h.at(vertices)] += out
        sources, times = np.unique(kernel.twins(h, weight, []), return_counts=True)
        chains, step = Chains.of_graph(h, weight), min(max(1, len(sources) // share), 256)
        begin = np.arange(0, len(sources), step)
        if chains is not None:  # those that share a search in one task
            order, begin = chains.tasks_of(sources, step)
            sources, times = sources[order], times[order]
        weighted[b] = (chains, h, weight, sources, times * weight[sources] / 2)
        jobs += [(b, *k) for k in zip(begin.tolist(), [*begin[1:].tolist(), len(sources)])]
    held, ids = graph.edges.sparkSession.sparkContext.broadcast(weighted), d.g.ids
    n = np.bincount(kernel.labels(d.g), minlength=len(d.g))[kernel.labels(d.g)].astype(np.float64)
    cut = np.where(linked, ((n - 1) ** 2 - squares) / 2, 0.0)
    slices = spark.createDataFrame(jobs, "b long, begin long, stop long")

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, begin, stop in zip(*[c.to_pylist() for c in batch.columns]):
                chains, h, w, sources, times = held.value[b]
                some = sources[begin:stop], times[begin:stop]
                total[b] = total.get(b, 0) + (kernel.dependencies_of(h, *some, w) if chains is None else chains.dependencies_of(*some))
        for b, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids[held.value[b][1].ids]), pa.array(t)], names=["id", "delta"])

    base = spark.createDataFrame(list(zip(ids.tolist(), cut.tolist())), "id long, delta double")
    return spread(slices).mapInArrow(run, "id long, delta double").union(base).groupBy("id").agg(F.sum("delta").alias("bc"))


def top(bc: DataFrame, k: int) -> DataFrame:
    """The k largest, ties to the smaller id."""
    return bc.orderBy(F.desc("bc"), "id").limit(k)
