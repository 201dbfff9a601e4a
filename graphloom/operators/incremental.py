"""Betweenness after one edge is inserted or deleted.

Only the block that holds the edge can change (the whole component, its biconnected component, or its
bridge-free part), and in it only sources whose distances to the two ends differ. Each of them takes back its
old dependencies and adds the new ones, weighted by what hangs off the vertices outside the block. Where the
edge joins or splits components, the components concerned are computed anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.planner import UpdatePlan, collected, strategy
from ..store import stored
from . import kernel
from .betweenness import brandes, spread
from .blocks import Decomposition, GraphTooLarge
from .traverse import distances

DECOMPOSITIONS = ("graph", "bcc", "muc")


def repaired(g: kernel.Csr, a: int, b: int, d: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and path counts after the edge (a, b) has come in (g has it), from those before it: only
    vertices that get nearer, or as near by more paths, are visited, level by level from the farther end."""
    if d[b] >= 0 and (d[a] < 0 or d[a] > d[b]):
        a, b = b, a
    d, sigma = d.copy(), sigma.copy()
    if d[a] < 0 or d[a] == d[b]:
        return d, sigma
    level, front = int(d[a]) + 1, np.array([b])
    while len(front):
        front = np.unique(front[(d[front] < 0) | (d[front] >= level)])
        d[front] = level
        s, t = g.out(front)
        sigma[front] = 0.0
        back = d[t] == level - 1
        np.add.at(sigma, s[back], sigma[t[back]])
        front, level = t[(d[t] < 0) | (d[t] > level)], level + 1
    return d, sigma


def sunk(g: kernel.Csr, a: int, b: int, d: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and path counts after the edge (a, b) has gone (g is without it), from those before it. Vertices that
    lose their last neighbour a level up sink, level by level from the farther end; then they rise to the first level
    where another neighbour holds them, and path counts are summed anew below what has changed."""
    if d[a] > d[b]:
        a, b = b, a
    d, sigma, old = d.copy(), sigma.copy(), d
    if d[a] < 0 or d[b] == d[a]:
        return d, sigma
    down, touched = np.zeros(len(g), bool), np.zeros(len(g), bool)
    level, front = int(d[b]), np.array([b])
    while len(front):
        s, t = g.out(front)
        held = np.zeros(len(g), bool)
        held[s[(old[t] == level - 1) & ~down[t]]] = True
        touched[front] = True
        falls = front[~held[front]]
        down[falls] = True
        s, t = g.out(falls)
        front, level = np.unique(t[old[t] == level + 1]), level + 1
    fallen = np.flatnonzero(down)
    d[fallen], sigma[fallen] = -1, 0.0
    s, t = g.out(fallen)
    waits = np.full(len(g), np.iinfo(np.int64).max)
    np.minimum.at(waits, s[d[t] >= 0], d[t[d[t] >= 0]] + 1)
    left = fallen[waits[fallen] < np.iinfo(np.int64).max]
    while len(left):
        level = int(waits[left].min())
        now = left[waits[left] == level]
        d[now] = level
        _, t = g.out(now)
        more = t[down[t] & (d[t] < 0)]
        waits[more] = np.minimum(waits[more], level + 1)
        left = np.union1d(left, more)
        left = left[d[left] < 0]
    dirty = np.flatnonzero(touched & (d >= 0))
    while len(dirty):
        level = int(d[dirty].min())
        now = dirty[d[dirty] == level]
        s, t = g.out(now)
        before = sigma[now].copy()
        sigma[now] = 0.0
        up = d[t] == level - 1
        np.add.at(sigma, s[up], sigma[t[up]])
        other = np.zeros(len(g), bool)
        other[now[(sigma[now] != before) | down[now]]] = True
        below = t[other[s] & (d[t] == level + 1)]
        dirty = np.union1d(dirty[d[dirty] > level], below)
    return d, sigma


@dataclass
class _Work:
    """A block with and without the edge, as arrays; weights; affected sources."""

    with_edge: kernel.Csr
    without: kernel.Csr
    weight: np.ndarray
    sources: np.ndarray
    gap: np.ndarray  # of each vertex's distances to the two ends, before
    same: np.ndarray  # whether its distances to all vertices are the same with and without the edge
    plan: UpdatePlan


def _work(g: kernel.Csr, a: int, b: int, op: str, decomposition: str) -> _Work | UpdatePlan:
    """g: the graph before. a, b: ids."""
    if decomposition not in DECOMPOSITIONS:
        raise ValueError(f"decomposition is one of {DECOMPOSITIONS}")
    if op not in ("insert", "delete"):
        raise ValueError("op is insert or delete")
    ids = np.unique(np.concatenate([g.ids, [a, b]])) if op == "insert" else g.ids
    s = np.repeat(np.arange(len(g)), np.diff(g.start))
    u, v = g.ids[s], g.ids[g.to]
    there = bool(((u == a) & (v == b)).any())
    if a == b or there == (op == "insert"):
        return UpdatePlan(decomposition, "none", 0, 0, 0, 0)
    one = u < v
    full = kernel.Csr.of(ids, np.append(u[one], a), np.append(v[one], b)) if op == "insert" else g
    x, y = int(full.at(a)), int(full.at(b))
    rest = full.without(x, y)
    if kernel.distances(rest, x)[y] < 0:
        n = int((kernel.distances(full, x) >= 0).sum())
        return UpdatePlan(decomposition, "recompute", n, 0, n, 0)
    if decomposition == "graph":
        vertices = np.flatnonzero(kernel.distances(full, x) >= 0)
        out = np.zeros(len(vertices), np.int64)
    else:
        d = Decomposition.of(full)
        vertices, out = d.outside(d.block_of(x, y)) if decomposition == "bcc" else d.region_outside(int(d.regions()[x]))
    inside = np.zeros(len(full), bool)
    inside[vertices] = True
    s = np.repeat(np.arange(len(full)), np.diff(full.start))
    k = inside[s] & inside[full.to] & (s < full.to)
    if decomposition == "bcc":
        block = d.block == d.block_of(x, y)
        eu, ev = d.u[block], d.v[block]
    else:
        eu, ev = s[k], full.to[k]
    h = kernel.Csr.of(full.ids[vertices], full.ids[eu], full.ids[ev])
    weight = np.ones(len(h))
    weight[h.at(full.ids[vertices])] += out
    p, q = int(h.at(a)), int(h.at(b))
    less = h.without(p, q)
    base = less if op == "insert" else h
    gap = np.abs(kernel.distances(base, p) - kernel.distances(base, q))
    far, near = gap > 0, gap == 1
    same = near if op == "insert" else np.abs(kernel.distances(less, p) - kernel.distances(less, q)) == 1
    plan = UpdatePlan(decomposition, op, len(h), len(h.to) // 2, int(far.sum()), int((~far).sum()), int(near.sum()), int(same.sum()))
    return _Work(h, less, weight, np.flatnonzero(far), gap, same, plan)


def explain(graph: Graph, a: int, b: int, op: str, decomposition: str = "bcc") -> UpdatePlan:
    if strategy(graph) != "kernel":
        raise GraphTooLarge("an update's plan needs the edges as arrays")
    work = _work(collected(graph), a, b, op, decomposition)
    return work if isinstance(work, UpdatePlan) else work.plan


def _dependencies_both(old: kernel.Csr, new: kernel.Csr, s: int, weight: np.ndarray) -> np.ndarray:
    """What _change gives, by two whole searches: a second opinion."""
    return kernel.dependencies(new, s, weight) - kernel.dependencies(old, s, weight)


def _change(work: tuple, s: int) -> np.ndarray:
    """What the edge adds to the dependencies of source s: one search without it, repaired to the one with it; the
    old dependencies come off, the new ones go on."""
    less, more, x, y, weight = work
    d, sigma, _ = kernel.paths(less, s)
    d2, sigma2 = repaired(more, x, y, d, sigma)
    return kernel.accumulated(more, s, d2, sigma2, weight) - kernel.accumulated(less, s, d, sigma, weight)


def _change_at_once(work: tuple, s: int) -> np.ndarray:
    """What _change gives, for a source one hop nearer to one end even without the edge: no distance changes, so both
    graphs have the levels of one search, and the one without the edge lacks one arc of them. Path counts and
    dependencies of both are the two columns of one pass forth and one back."""
    _, more, x, y, weight = work
    d, _, dag = kernel.paths(more, s)
    if d[x] > d[y]:
        x, y = y, x
    sigma, delta = np.zeros((len(more), 2)), np.zeros((len(more), 2))
    sigma[s] = 1.0
    for a, t in dag:
        paths = sigma[a]
        paths[(a == x) & (t == y), 0] = 0.0
        np.add.at(sigma, t, paths)
    for a, t in reversed(dag):
        share = sigma[a] / sigma[t] * (weight[t, None] + delta[t])
        share[(a == x) & (t == y), 0] = 0.0
        np.add.at(delta, a, share)
    delta[s] = 0.0
    return delta[:, 1] - delta[:, 0]


def delta(graph: Graph, a: int, b: int, op: str, decomposition: str = "bcc", max_sources: dict[int, int] | None = None, wanted: str | None = None) -> DataFrame:
    """id, delta: how betweenness changes; vertices that don't change may be left out.

    max_sources caps the affected sources by class of |d(s,a) - d(s,b)| (1, and 2 for more), least ids first;
    the result is then a part of the change, for estimates of time. The relational plan refuses caps; it works on
    the whole graph with any decomposition, which only bounds the work and changes no result.
    """
    spark = graph.vertices.sparkSession
    if strategy(graph, wanted) == "relational":
        if max_sources is not None:
            raise GraphTooLarge("caps of sources need the edges as arrays")
        return _relational_delta(graph, a, b, op)
    work = _work(collected(graph), a, b, op, decomposition)
    if isinstance(work, UpdatePlan):
        return _recomputed(graph, a, b, op) if work.op == "recompute" else spark.createDataFrame([], "id long, delta double")
    sources, times = work.sources, np.ones(len(work.sources), np.int64)
    if max_sources is None:
        ends = [int(k) for k in work.with_edge.at([a, b])]
        sources, times = np.unique(kernel.twins(work.with_edge, work.weight, ends)[sources], return_counts=True)
    else:
        gap = work.gap[sources]
        sources = np.concatenate([sources[gap == 1][: max_sources.get(1, len(sources))], sources[gap >= 2][: max_sources.get(2, len(sources))]])
        times = times[: len(sources)]
    held = spark.sparkContext.broadcast((work.without, work.with_edge, int(work.with_edge.at(a)), int(work.with_edge.at(b)), work.weight))
    sign = 0.5 if op == "insert" else -0.5
    jobs = spark.createDataFrame(pd.DataFrame({"s": sources, "times": times, "same": work.same[sources]}), "s long, times long, same boolean")

    def run(batches):
        work = held.value
        total = np.zeros(len(work[0]))
        for batch in batches:
            for s, times, same in zip(*[c.to_pylist() for c in batch.columns]):
                total += sign * times * work[-1][s] * (_change_at_once if same else _change)(work, s)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(work[0].ids[some]), pa.array(total[some])], names=["id", "delta"])

    return spread(jobs).mapInArrow(run, "id long, delta double").groupBy("id").agg(F.sum("delta").alias("delta"))


def part_betweenness(graph: Graph, a: int, b: int, decomposition: str = "muc", max_sources: int | None = None, edge_in: bool = True) -> DataFrame:
    """id, bc: what paths between the vertices of one part give its vertices, each end weighted by what hangs off it.
    The part is the one that holds the edge (a, b) once it is in; edge_in says whether it is. With max_sources, only
    so many sources, least ids first. What the edge adds to betweenness is the difference of the two.
    A loop, an edge that is there already, and one that joins components have no such part: no rows."""
    spark = graph.vertices.sparkSession
    if strategy(graph) != "kernel":
        raise GraphTooLarge("a part's betweenness needs the edges as arrays")
    work = _work(collected(graph), a, b, "insert", decomposition)
    if isinstance(work, UpdatePlan):
        return spark.createDataFrame([], "id long, bc double")
    h = work.with_edge if edge_in else work.without
    held = spark.sparkContext.broadcast((h, work.weight))
    jobs = spark.createDataFrame(pd.DataFrame({"s": np.arange(len(h))[:max_sources]}), "s long")

    def run(batches):
        h, weight = held.value
        total = np.zeros(len(h))
        for batch in batches:
            for s in batch.column(0).to_pylist():
                total += weight[s] * kernel.dependencies(h, s, weight) / 2
        yield pa.RecordBatch.from_arrays([pa.array(h.ids), pa.array(total)], names=["id", "bc"])

    return spread(jobs).mapInArrow(run, "id long, bc double").groupBy("id").agg(F.sum("bc").alias("bc"))


def changed(graph: Graph, a: int, b: int, op: str) -> Graph:
    pair = graph.vertices.sparkSession.createDataFrame([(a, b)], "u long, v long")
    return graph.insert_edges(pair) if op == "insert" else graph.remove_edges(pair)


def _recomputed(graph: Graph, a: int, b: int, op: str) -> DataFrame:
    """For edges that join or split components: both components anew, before and after."""
    whole = changed(graph, a, b, "insert")
    ends = graph.vertices.sparkSession.createDataFrame([(a,)], "id long")
    reach = stored(distances(whole, ends).where("dist >= 0").select(F.col("v").alias("id")))
    before, after = graph.restricted(reach), changed(graph, a, b, op).restricted(reach)
    old, new = brandes(before).withColumnRenamed("bc", "old"), brandes(after).withColumnRenamed("bc", "new")
    return new.join(old, "id", "left").select("id", (F.col("new") - F.coalesce("old", F.lit(0.0))).alias("delta"))


def _relational_delta(graph: Graph, a: int, b: int, op: str) -> DataFrame:
    """On DataFrames: affected sources from a search from both ends, their dependencies before and after, which one
    search of both graphs (sides 0 and 1) gives."""
    from .betweenness import alike, dependencies
    from .traverse import _levels, advanced, kept

    spark = graph.vertices.sparkSession
    after = changed(graph, a, b, op)
    before = kept(Graph(after.vertices, graph.edges))  # with new ends of an inserted edge
    ends = spark.createDataFrame([(a, 0.0), (b, 0.0)], "id long, delta double")
    levels = _levels(before, ends)
    if not levels:
        return ends.limit(0)
    to_a, to_b = (F.max(F.when(F.col("s") == x, F.col("d"))) for x in (a, b))
    far = reduce(DataFrame.union, levels).groupBy(F.col("v").alias("id")).agg(to_a.alias("da"), to_b.alias("db")).where("not da <=> db").select("id")
    far = stored(alike(before, far, (a, b)))  # twins before and after, as only a and b get other neighbours
    both = [g.select(F.lit(k).alias("side"), F.col("s").alias("v"), "t") for k, g in enumerate((before.arcs, Graph(before.vertices, stored(after.edges)).arcs))]
    arcs = both[0].union(both[1])
    starts = far.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.col("id").alias("s"))
    found = dependencies(advanced(arcs, starts, ("side",)), arcs.toDF("side", "p", "v"), ("side",))
    change = ends if op == "insert" else ends.limit(0)
    if found is not None:
        sign = F.when(F.col("side") == 1, 0.5).otherwise(-0.5)
        change = change.union(found.join(far.toDF("s", "w").hint("merge"), "s").select("id", F.col("delta") * F.col("w") * sign))
    return change.groupBy("id").agg(F.sum("delta").alias("delta"))


def update(graph: Graph, bc: DataFrame, a: int, b: int, op: str, decomposition: str = "bcc", wanted: str | None = None) -> DataFrame:
    """id, bc after the change; new ends of an inserted edge come in. graph is as before and stays so."""
    d = delta(graph, a, b, op, decomposition, wanted=wanted).toDF("id", "x")
    return bc.join(d, "id", "full").select("id", (F.coalesce("bc", F.lit(0.0)) + F.coalesce("x", F.lit(0.0))).alias("bc"))


def insert_and_update(graph: Graph, bc: DataFrame, a: int, b: int, decomposition: str = "bcc") -> tuple[Graph, DataFrame]:
    return changed(graph, a, b, "insert"), update(graph, bc, a, b, "insert", decomposition)


class SourceState:
    """Distances and path counts of every source, kept for one of some twins and rewritten only for affected sources."""

    def __init__(self, graph: Graph):
        from .traverse import kept, sssp, tasks

        self.graph = kept(graph)
        self._same = stored(self.graph.twins())
        from_one = self._same.select(F.col("rep").alias("s")).distinct()
        self._rows = stored(sssp(self.graph, from_one.repartition(tasks(from_one.count() * self._same.count(), 4, from_one))))

    @property
    def table(self) -> DataFrame:
        """s, v, dist, sigma of all sources."""
        from .traverse import in_tiles

        copies = stored(self._same.where("id <> rep"))
        return self._rows.unionByName(in_tiles(self._rows, copies)) if copies.limit(1).count() else self._rows

    def insert(self, a: int, b: int) -> DataFrame:
        """Takes the edge in; id, delta of betweenness. Both ends are vertices of the graph."""
        return self._change(a, b, "insert")

    def delete(self, a: int, b: int) -> DataFrame:
        """Takes the edge out; id, delta of betweenness. Components may split."""
        return self._change(a, b, "delete")

    def _change(self, a: int, b: int, op: str) -> DataFrame:
        from .traverse import expanded, kept

        out = stored(delta(self.graph, a, b, op, "graph"))
        # both ends get or lose a neighbour, other than their twins; those may need another to stand for them
        alone = F.col("id").isin(a, b)
        rest = self._same.where(~alone)
        least = rest.groupBy("rep").agg(F.min("id").alias("now"))
        rest = rest.join(least, "rep").select("id", F.col("now").alias("rep"), "n")
        same = stored(rest.union(self._same.where(alone).select("id", F.col("id").alias("rep"), F.lit(0).cast("long").alias("n"))))
        rows = stored(expanded(self._rows, self._same.join(same.where("id = rep").select("id"), "id", "left_semi")))
        da, db = (rows.where(F.col("v") == x).select("s", F.col("dist").alias(n)) for x, n in ((a, "da"), (b, "db")))
        far = stored(da.join(db, "s").where("da <> db").select("s"))
        self.graph = kept(changed(self.graph, a, b, op))
        g, repair = collected(self.graph), repaired if op == "insert" else sunk
        held = self.graph.edges.sparkSession.sparkContext.broadcast((g, int(g.at(a)), int(g.at(b))))

        def run(_, rows: pd.DataFrame) -> pd.DataFrame:
            g, x, y = held.value
            rows = rows.sort_values("v")
            dist, sigma = repair(g, x, y, rows["dist"].to_numpy(np.int64), rows["sigma"].to_numpy())
            return rows.assign(dist=dist.astype(np.int32), sigma=sigma)

        moved = rows.join(far, "s", "left_semi").groupBy("s").applyInPandas(run, "s long, v long, dist int, sigma double")  # a row for each vertex
        self._rows = stored(rows.join(far, "s", "left_anti").unionByName(moved))
        self._same = same
        return out


def pruning_counts(graph: Graph, a: int, b: int, wanted: str | None = None) -> DataFrame:
    """d0, d1, d2: sources whose distances to a and b differ by 0, 1 and more, without the edge (a, b)."""
    spark = graph.vertices.sparkSession
    base = changed(graph, a, b, "delete")
    d = distances(base, spark.createDataFrame([(a,), (b,)], "s long"), wanted)
    both = d.where(F.col("s") == a).select("v", F.col("dist").alias("x")).join(d.where(F.col("s") == b).select("v", F.col("dist").alias("y")), "v")
    gap = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count_if(gap == 0).alias("d0"), F.count_if(gap == 1).alias("d1"), F.count_if(gap >= 2).alias("d2"))
