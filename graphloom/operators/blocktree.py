"""Blocks and bridge-free parts kept up to date while edges come in; nothing is decomposed anew.

A spanning forest of the graph gives each vertex a place and, to its subtree, a range of places. The vertices above one of a
and b, but not above both, are the way between them in the tree, and the edge to the parent of each lies in one of the
blocks between a and b, every one of which has such an edge. So one filter by ranges finds what an edge (a, b) makes one
block, or one part, and the tree stays as it is. Names that have become one are kept in a table of their own, which has a
row for a name that is no longer in use; vertices are not written again.

An edge between two components is a bridge. The tree of the smaller one gets its end of the edge as its first vertex and
is hung below the other end, for which its vertices are sorted and all vertices are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..order import numbered
from ..store import broadcast_if_small, stored, stored_with
from .biconnected import Blocks
from .blocks import _parts

#: Names that have become one, of blocks and of parts.
_NAMES = "kind int, was long, now long"
_BLOCK, _PART = 0, 1
_COLUMNS = ["id", "pre", "nd", "parent", "size", "top", "part"]


def _above(place: int) -> Column:
    """Vertices whose subtree has the place."""
    return (F.col("pre") <= place) & (F.lit(place) < F.col("pre") + F.col("nd"))


class BlockTree:
    """The blocks of a graph, from one decomposition, and after each insert() those of the graph with its edge."""

    def __init__(self, graph: Graph):
        self._spark = graph.vertices.sparkSession
        graph = Graph(stored(graph.vertices), stored(graph.edges))
        found = Blocks.of(graph)
        self._edges, self._added = graph.edges, []
        placed, seen = stored_with(found.vertices, n=F.count("*"))
        alone = numbered(graph.vertices.join(placed, "id", "left_anti"), ["id"], "k").withColumn("pre", F.lit(seen["n"]) + F.col("k"))
        one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
        alone = alone.select("id", "pre", one.alias("nd"), none.alias("parent"), one.alias("size"), F.col("pre").alias("top"))
        every = placed.select(*_COLUMNS[:-1]).union(alone).join(_parts(graph, found).withColumnRenamed("muc_id", "part"), "id")
        self._vertices, seen = stored_with(every.select(*_COLUMNS), n=F.count("*"))
        self._n = seen["n"]
        self._unnamed()

    def _unnamed(self) -> None:
        self._names = self._spark.createDataFrame([], _NAMES)

    @property
    def vertices(self) -> DataFrame:
        """id; pre, nd, parent, size, top as in Blocks, but with isolated vertices, each below none; part: the least
        vertex of its bridge-free part."""
        v = self._vertices
        for c, kind in (("top", _BLOCK), ("part", _PART)):
            names = self._names.where(F.col("kind") == kind).drop("kind")
            v = v.join(names, F.col(c) == F.col("was"), "left").withColumn(c, F.coalesce("now", c)).drop("was", "now")
        return v.select(*_COLUMNS)

    @property
    def edges(self) -> DataFrame:
        """u, v."""
        return self._edges.union(self._spark.createDataFrame(self._added, "u long, v long")) if self._added else self._edges

    @property
    def parts(self) -> DataFrame:
        """id, muc_id."""
        return self.vertices.select("id", F.col("part").alias("muc_id"))

    def blocks(self) -> Blocks:
        """The blocks now, with their edges, numbers, branches and bridges. An edge is in the block that its later end
        is in with its parent, as only the first vertex of a block may be in others above it."""
        v = stored(self.vertices.drop("part"))
        ends = [v.select(F.col("id").alias(c), F.col("pre").alias(f"p{c}"), F.col("top").alias(f"t{c}")) for c in "uv"]
        e = self.edges.join(ends[0], "u").join(ends[1], "v")
        return Blocks(v, stored(e.select("u", "v", F.when(F.col("pu") < F.col("pv"), F.col("tv")).otherwise(F.col("tu")).alias("top"))))

    def insert(self, a: int, b: int) -> None:
        """Takes the edge (a, b) in. Ends that are no vertices yet come in; loops and edges that are there change nothing."""
        edge = (min(a, b), max(a, b))
        if a == b or edge in self._added or self._edges.where((F.col("u") == edge[0]) & (F.col("v") == edge[1])).limit(1).count():
            return
        ends = {r.id: r for r in self._vertices.where(F.col("id").isin(a, b)).collect()}  # two rows
        new = [x for x in edge if x not in ends]
        if new:
            rows = [(x, self._n + k, 1, None, 1, self._n + k, x) for k, x in enumerate(new)]
            self._vertices = self._vertices.union(self._spark.createDataFrame(rows, self._vertices.schema))
            self._n += len(new)
            ends |= {r[0]: self._vertices.where(F.col("id") == r[0]).first() for r in rows}
        over_a, over_b = _above(ends[a].pre), _above(ends[b].pre)
        way = self._vertices.where(over_a | over_b).select("pre", "parent", "top", "part", (over_a & over_b).alias("both"))
        way, seen = stored_with(way, meet=F.max(F.when(F.col("both"), F.col("pre"))))
        if seen["meet"] is None:
            small, large = sorted((ends[a], ends[b]), key=lambda r: r.size)
            self._hang(small, large, way)
        else:
            self._unite(way, seen["meet"])
        self._added.append(edge)

    def _unite(self, way: DataFrame, meet: int) -> None:
        """The blocks on the way become one, and the parts, each with the least name. meet: the place where it turns."""
        on = F.array(
            F.struct(F.lit(_BLOCK).alias("kind"), F.col("top").alias("was"), (~F.col("both")).alias("on")),
            F.struct(F.lit(_PART).alias("kind"), F.col("part").alias("was"), (~F.col("both") | (F.col("pre") == meet)).alias("on")),
        )
        some = way.select(F.explode(on).alias("x")).select("x.*").where("on").select("kind", "was").distinct()
        met = some.join(self._names, ["kind", "was"], "left").select("kind", F.coalesce("now", "was").alias("old")).distinct()
        of = lambda k, f: f(F.when(F.col("kind") == k, F.col("old")))
        met, seen = stored_with(met, blocks=of(_BLOCK, F.count), parts=of(_PART, F.count), block=of(_BLOCK, F.min), part=of(_PART, F.min))
        if seen["blocks"] < 2 and seen["parts"] < 2:
            return
        least = F.when(F.col("kind") == _BLOCK, seen["block"]).otherwise(seen["part"]).cast("long")
        old = broadcast_if_small(met).select("kind", F.col("old").alias("now"), F.lit(True).alias("met"))
        moved = self._names.join(old, ["kind", "now"], "left").select("kind", "was", F.when(F.col("met"), least).otherwise(F.col("now")).alias("now"))
        self._names = broadcast_if_small(stored(moved.union(met.where(F.col("old") != least).select("kind", "old", least))))

    def _hang(self, y, x, way: DataFrame) -> None:
        """Makes y the first vertex of its tree, and a child of x, which is in another one."""
        begin = way.where((F.col("parent").isNull()) & (F.col("pre") <= y.pre)).agg(F.max("pre")).first()[0]
        k, pre = y.size, F.col("pre")
        now = self.vertices
        own = (pre >= begin) & (pre < begin + k)
        tree = stored(now.where(own))
        # the vertices above y turn over: what was the child towards y is now the parent
        up = tree.where(_above(y.pre))
        child = up.select(F.col("parent").alias("at"), F.col("pre").alias("c_pre"), F.col("nd").alias("c_nd"), F.col("top").alias("c_top"))
        turned = tree.join(broadcast_if_small(stored(child.where("at is not null"))), pre == F.col("at"), "left")
        turns, is_y = F.col("at").isNotNull(), pre == y.pre
        after = pre >= y.pre + y.nd
        turned = turned.select(
            "id",
            pre.alias("old"),
            F.when(turns, k - F.col("c_nd")).when(is_y, F.lit(k)).otherwise(F.col("nd")).cast("long").alias("nd"),
            F.when(turns, F.col("c_pre")).when(~is_y, F.col("parent")).alias("over"),
            F.when(turns, F.col("c_top")).when(~is_y, F.col("top")).alias("block"),
            "part",
            # the new order: below y; then each vertex above y, and what came after y below it; then what came before y
            F.when(_within(y), 0).when(turns | after, 1).otherwise(2).alias("k1"),
            F.when(turns, F.col("c_pre") + F.col("c_nd")).otherwise(pre).alias("k2"),
            F.when(turns, 0).otherwise(1).alias("k3"),
            (-pre).alias("k4"),
        )
        at = x.pre - k if x.pre > begin else x.pre  # x's place once the tree is taken out
        placed = numbered(turned, ["k1", "k2", "k3", "k4"], "place").withColumn("pre", F.col("place") + at + 1)
        placed = stored(placed)
        tops = placed.where("block is not null").groupBy("block").agg(F.min("pre").alias("top"))
        overs = placed.select(F.col("old").alias("over"), F.col("pre").alias("parent"))
        hung = placed.join(overs, "over", "left").join(tops, "block", "left")
        hung = hung.select("id", "pre", "nd", F.coalesce("parent", F.lit(self._moved(x.pre, begin, k, at))).cast("long").alias("parent"), F.lit(x.size + k).cast("long").alias("size"), F.coalesce("top", "pre").alias("top"), "part")
        first = way.where((F.col("parent").isNull()) & (F.col("pre") <= x.pre)).agg(F.max("pre")).first()[0]
        more = lambda rows: F.when(rows, k).otherwise(0)
        move = lambda c: self._moved(F.col(c), begin, k, at)
        rest = now.where(~own).select("id", move("pre").alias("pre"), (F.col("nd") + more(_above(x.pre))).alias("nd"), move("parent").alias("parent"), (F.col("size") + more((pre >= first) & (pre < first + x.size))).alias("size"), move("top").alias("top"), "part")
        self._vertices = stored(rest.union(hung))
        self._unnamed()

    @staticmethod
    def _moved(place: Column | int, begin: int, k: int, at: int) -> Column | int:
        """A place outside a tree of k vertices from begin, after the tree has been put behind the place `at` of what is
        left without it."""
        if isinstance(place, int):
            return at
        left = place - F.when(place >= begin, k).otherwise(0)
        return (left + F.when(left > at, k).otherwise(0)).cast("long")


def _within(y) -> Column:
    return (F.col("pre") >= y.pre) & (F.col("pre") < y.pre + y.nd)
