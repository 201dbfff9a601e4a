"""Biconnected components on DataFrames, without a search that visits one vertex after another.

1. A spanning forest: every component takes the edge to its least neighbouring component, if that is less than itself, and
   pointers are followed in leaps; at most half of the components are left after a round.
2. The tour of each tree, down and up every edge, is a list; its places come from leaps along the list, over all of it or, if
   it is long, up to the next of some elements picked by hash, which then are a shorter list. They give each vertex its
   parent, its place in the order of descent (pre), and the size of its subtree, which is a range of places.
3. The least and largest place that the subtree of a vertex reaches by edges outside the tree: minima over ranges, in arrays
   for ranges of places and from the minima of whole ranges between them.
4. Vertices are in one block with their parent's edge if that edge isn't the only way out of the subtree; they are joined
   along such edges and along edges between subtrees that aren't within one another. The components of that graph are the
   blocks without their heads, the vertices above them (as Tarjan and Vishkin, and Dong, Wang, Gu and Sun have it).

Every table has a row for a vertex or an edge, each step is a join or a sum that is spread by its keys, and a vertex with
very many neighbours is cut into buckets of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..order import numbered
from ..store import stored, stored_with

#: Buckets that the neighbours of a vertex are dealt to.
BUCKETS = 256
#: Lists of more elements are shortened: one of so many stays.
LONG_LIST, PICKED = 2_000_000, 32
#: Places of a range whose minima are found as arrays, as a power of two.
RANGE_BITS = 14


def forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v): the edges of a spanning forest of edges(u, v); (id, component) of the vertices of edges, by the least id."""
    cross = stored(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v"))
    names, trees = None, []
    while True:
        arcs = cross.select("a", "b", "u", "v").union(cross.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v"))
        hooks = arcs.groupBy("a").agg(F.min(F.struct("b", "u", "v")).alias("x")).select("a", "x.*")
        hooks, seen = stored_with(hooks.where("b < a"), n=F.count("*"))
        if not seen["n"]:
            break
        trees.append(hooks.select("u", "v"))
        up = _roots(hooks.select(F.col("a").alias("c"), F.col("b").alias("root")))
        if names is None:
            names = stored(arcs.select("a").distinct().join(up, F.col("a") == F.col("c"), "left").select(F.col("a").alias("id"), F.coalesce("root", "a").alias("component")))
        else:
            names = stored(names.join(up, F.col("component") == F.col("c"), "left").select("id", F.coalesce("root", "component").alias("component")))
        x, y = up.toDF("a", "ra"), up.toDF("b", "rb")
        moved = cross.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "u", "v").where("a <> b")
        least = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("u", "v")).alias("x"))
        cross, seen = stored_with(least.select("a", "b", "x.u", "x.v"), n=F.count("*"))
        if not seen["n"]:
            break
    if names is None:
        return edges, edges.select(F.col("u").alias("id"), F.col("u").alias("component"))
    tree = trees[0]
    for t in trees[1:]:
        tree = tree.union(t)
    return tree, names


def _roots(up: DataFrame) -> DataFrame:
    """c, root: pointers(c, root) followed to their end."""
    up = stored(up)
    while True:
        far = up.toDF("root", "further")
        up, seen = stored_with(up.join(far, "root", "left").select("c", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), n=F.count_if("moved"))
        up = up.select("c", "root")
        if not seen["n"]:
            return up


def _followed(items: DataFrame, stop: Column | None = None) -> DataFrame:
    """s, t, ns, nt, w: each element with all that follow summed up, to the end of its list, or up to an element that stop
    holds for. items have the same columns: an element (s, t), the next one or nulls, and its weight."""
    goes = F.col("ns").isNotNull() if stop is None else F.col("ns").isNotNull() & ~stop
    items = stored(items)
    while True:
        far = items.toDF("fs", "ft", "ns2", "nt2", "more")
        met = items.join(far, goes & (F.col("ns") == F.col("fs")) & (F.col("nt") == F.col("ft")), "left")
        found = F.col("fs").isNotNull()
        step = lambda c: F.when(found, F.col(f"{c}2")).otherwise(F.col(c)).alias(c)
        items, seen = stored_with(met.select("s", "t", step("ns"), step("nt"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")), n=F.count_if(goes))
        if not seen["n"]:
            return items


def ranked(items: DataFrame, n: int) -> DataFrame:
    """s, t, w: for each element of the lists the sum of its weight and of all that follow; n: elements, about."""
    if n <= LONG_LIST:
        return _followed(items).select("s", "t", "w")
    picked = lambda s, t: F.pmod(F.xxhash64(s, t, F.lit(n)), F.lit(PICKED)) == 0
    near = _followed(items, picked("ns", "nt"))
    ends = ranked(near.where(picked("s", "t")), n // PICKED).toDF("ns", "nt", "more")
    return near.join(stored(ends), ["ns", "nt"], "left").select("s", "t", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))


def tour(tree: DataFrame, names: DataFrame) -> DataFrame:
    """s, t, ns, nt, w, component: the arcs of the tree's edges, each with the next of its tour, which begins and ends at
    the least vertex of a component."""
    arcs = tree.select(F.col("u").alias("s"), F.col("v").alias("t")).union(tree.select("v", "u"))
    arcs = stored(arcs.join(names.withColumnRenamed("id", "t"), "t").select("s", "t", "component", F.pmod(F.xxhash64("s"), F.lit(BUCKETS)).alias("bucket")))
    within = arcs.withColumn("after", F.lead("s").over(Window.partitionBy("t", "bucket").orderBy("s")))
    by_bucket = Window.partitionBy("t").orderBy("bucket")  # BUCKETS rows at most
    heads = arcs.groupBy("t", "bucket").agg(F.min("s").alias("first"))
    heads = heads.select("t", "bucket", F.lead("first").over(by_bucket).alias("later"), F.first("first").over(by_bucket).alias("around"))
    closed = F.coalesce("after", "later").isNull() & (F.col("t") == F.col("component"))
    n = F.when(~closed, F.coalesce("after", "later", "around"))
    return within.join(heads, ["t", "bucket"]).select("s", "t", F.when(n.isNotNull(), F.col("t")).alias("ns"), n.alias("nt"), F.lit(1).cast("long").alias("w"), "component")


def _range_minima(low: str, high: str):
    """pre, low, high of what lies in the range itself of each subtree; before_low, before_high of all from the range's
    beginning up to the place. Rows come by range and place."""
    names = ["pre", "low", "high", "before_low", "before_high"]

    def of(rows):
        pre, size, lo, hi = (np.concatenate(c) for c in zip(*rows))
        end = np.minimum(np.arange(len(pre)) + size, len(pre))
        out = []
        for values, best in ((lo, np.minimum), (hi, np.maximum)):
            table = [values]
            while 2 << (len(table) - 1) <= len(values):
                half = 1 << (len(table) - 1)
                table.append(best(table[-1][:-half], table[-1][half:]))
            n = end - np.arange(len(pre))
            k = np.frexp(n)[1] - 1
            found = np.empty(len(pre), np.int64)
            for j in np.unique(k).tolist():
                at = np.flatnonzero(k == j)
                found[at] = best(table[j][at], table[j][end[at] - (1 << j)])
            out.append(found)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (pre, *out, np.minimum.accumulate(lo), np.maximum.accumulate(hi))], names=names)

    def run(batches):
        held, now = [], None
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            ranges = columns[0] >> RANGE_BITS
            for some in np.split(np.arange(len(ranges)), np.flatnonzero(np.diff(ranges)) + 1):
                if len(some):
                    if held and ranges[some[0]] != now:
                        yield of(held)
                        held = []
                    now = ranges[some[0]]
                    held.append([c[some] for c in columns])
        if held:
            yield of(held)

    return run


def _between(totals: np.ndarray):
    """low and high over whole ranges from `first` up to `last`, added to those of the rows."""

    def run(batches):
        for b in batches:
            pre, first, last, low, high = (c.to_numpy() for c in b.columns)
            low, high = low.copy(), high.copy()
            for k in np.flatnonzero(first < last).tolist():
                some = totals.value[first[k] : last[k]]
                low[k], high[k] = min(low[k], some[:, 0].min()), max(high[k], some[:, 1].max())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pre, low, high)], names=["pre", "low", "high"])

    return run


def reaches(places: DataFrame) -> DataFrame:
    """pre, low, high: minimum of lo and maximum of hi over the places from pre to pre + nd - 1. places: pre (0, 1, ...), nd, lo, hi."""
    dealt = places.select("pre", "nd", "lo", "hi").withColumn("range", F.shiftright("pre", RANGE_BITS)).repartition("range").sortWithinPartitions("range", "pre").drop("range")
    part = stored(dealt.mapInArrow(_range_minima("lo", "hi"), "pre long, low long, high long, before_low long, before_high long"))
    spark, r = places.sparkSession, lambda c: F.shiftright(c, RANGE_BITS)
    totals = places.groupBy(r("pre").alias("range")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("range").toArrow()  # two numbers for 16,384 vertices
    whole = spark.sparkContext.broadcast(np.stack([totals["lo"].to_numpy(), totals["hi"].to_numpy()], axis=1).reshape(-1, 2))
    end = F.col("pre") + F.col("nd") - 1
    far = places.withColumn("end", end).where(r("end") > r("pre")).select("pre", "end").join(part.select("pre", "low", "high"), "pre")
    tail = part.select(F.col("pre").alias("end"), "before_low", "before_high")
    far = far.join(tail, "end").select("pre", (r("pre") + 1).alias("first"), r("end").alias("last"), F.least("low", "before_low").alias("low"), F.greatest("high", "before_high").alias("high"))
    far = far.mapInArrow(_between(whole), "pre long, low long, high long")
    near = part.join(places.where(r(end) == r("pre")).select("pre"), "pre", "left_semi").select("pre", "low", "high")
    return near.union(far)


@dataclass
class Blocks:
    """vertices: id, pre, nd, parent (its pre; null of a component's first vertex), size (of the component), top. edges: u, v,
    top. A block is named by the place of its first vertex below its head (top); a component's first vertex is below none.
    Isolated vertices are in no block."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(graph: Graph) -> Blocks:
        from .traverse import connected_components

        edges = stored(graph.edges)
        tree, names = forest(edges)
        arcs = stored(tour(tree, names))
        n = arcs.count()
        rank = ranked(arcs.drop("component"), n).join(arcs.select("s", "t", "component"), ["s", "t"])
        down, up = F.max(F.when(F.col("s") < F.col("t"), F.col("w"))).alias("forth"), F.max(F.when(F.col("s") > F.col("t"), F.col("w"))).alias("back")
        both = rank.groupBy(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v"), "component").agg(down, up)
        forth = F.col("forth") > F.col("back")
        child, parent = F.when(forth, F.col("v")).otherwise(F.col("u")), F.when(forth, F.col("u")).otherwise(F.col("v"))
        below = stored(both.select(child.alias("id"), parent.alias("over"), "component", F.greatest("forth", "back").alias("w"), ((F.abs(F.col("forth") - F.col("back")) + 1) / 2).cast("long").alias("nd")))
        sizes = below.groupBy("component").agg((F.count("*") + 1).alias("size"), F.max("w").alias("w"))
        first = sizes.select(F.col("component").alias("id"), F.lit(None).cast("long").alias("over"), "component", (F.col("w") + 1).alias("w"), F.col("size").alias("nd"))
        placed = stored(numbered(below.unionByName(first).withColumn("turn", -F.col("w")), ["component", "turn"], "pre"))
        of_parent = placed.select(F.col("id").alias("over"), F.col("pre").alias("parent"), F.col("nd").alias("parent_nd"))
        placed = stored(placed.join(of_parent, "over", "left").join(sizes.select("component", "size"), "component").select("id", "pre", "nd", "parent", "parent_nd", "size"))
        at = lambda c: placed.select(F.col("id").alias(c), F.col("pre").alias(f"p{c}"), F.col("nd").alias(f"n{c}"), F.col("parent").alias(f"q{c}"))
        e = edges.join(at("u"), "u").join(at("v"), "v")
        ahead = F.col("pu") < F.col("pv")
        a, b, na, qb = (F.when(ahead, F.col(x)).otherwise(F.col(y)) for x, y in (("pu", "pv"), ("pv", "pu"), ("nu", "nv"), ("qv", "qu")))
        e = stored(e.select("u", "v", a.alias("a"), b.alias("b"), (b >= a + na).alias("across"), (qb == a).alias("tree")))  # a is before b
        others = e.where("not tree")
        seen = others.select(F.col("a").alias("pre"), F.col("b").alias("x")).union(others.select("b", "a")).groupBy("pre").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        places = stored(placed.join(seen, "pre", "left").select("pre", "nd", "parent", "parent_nd", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi")))
        reach = places.select("pre", "parent", "parent_nd").where("parent is not null").join(reaches(places), "pre")
        open_ = reach.where((F.col("low") < F.col("parent")) | (F.col("high") >= F.col("parent") + F.col("parent_nd"))).select(F.col("parent").alias("u"), F.col("pre").alias("v"))
        joined = open_.union(others.where("across").select(F.col("a").alias("u"), F.col("b").alias("v")))
        tops = connected_components(Graph(placed.select(F.col("pre").alias("id")), joined), "relational").toDF("pre", "top")
        vertices = stored(placed.drop("parent_nd").join(tops, "pre"))
        return Blocks(vertices, stored(e.select("u", "v", "b").join(vertices.select(F.col("pre").alias("b"), "top"), "b").select("u", "v", "top")))

    @cached_property
    def numbers(self) -> DataFrame:
        """top, block_id, u, v, n_edges: blocks in the order of their least edges, which are (u, v)."""
        least = self.edges.groupBy("top").agg(F.min(F.struct("u", "v")).alias("e"), F.count("*").alias("n_edges")).select("top", "e.u", "e.v", "n_edges")
        return stored(numbered(least, ["u", "v"], "block_id"))

    @cached_property
    def branches(self) -> DataFrame:
        """top, id, n: how many vertices are cut off from the rest, through that block, when the vertex goes."""
        v = self.vertices
        tops = v.where("pre = top and parent is not null").select("top", F.col("parent").alias("head"))
        # of a block's head: the subtrees of its children in the block
        inside = v.join(tops, "top").where("parent = head").groupBy("top", "head").agg(F.sum("nd").alias("n"))
        inside = stored(inside)
        behind = inside.groupBy("head").agg(F.sum("n").alias("behind"))
        own = v.where("parent is not null").join(behind, F.col("pre") == F.col("head"), "left")
        rest = own.select("top", "id", (F.col("size") - 1 - F.coalesce("behind", F.lit(0))).cast("long").alias("n"))
        heads = inside.join(v.select(F.col("pre").alias("head"), "id"), "head").select("top", "id", "n")
        return stored(rest.union(heads))

    @property
    def bridges(self) -> DataFrame:
        """top, u, v."""
        return self.numbers.where("n_edges = 1").select("top", "u", "v")
