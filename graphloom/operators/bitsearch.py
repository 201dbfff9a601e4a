"""Hops from both ends of many edges at once: 64 edges share the bits of a word, so that one search serves them all.

A vertex has two words for each 64 edges, one bit an edge: which searches from first ends, and which from second ends, have
come to it. A step is the bitwise or over the neighbours. Each search does without its own edge. That matters only at the
first step, as the edge's other end is where it would begin.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.planner import collected, search_strategy, shared, strategy
from ..store import broadcast_if_small, stored
from .biconnected import Blocks
from .blocks import Decomposition
from .kernel import Csr
from .traverse import kept

#: Edges of a word.
WORD = 64
_COUNTS = ("c0", "c1", "ra", "rb", "ends", "met")
_SCHEMA = "word long, bit int, " + ", ".join(f"{c} long" for c in _COUNTS)


def per_bit(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit, from the lowest."""
    total = np.zeros(WORD, np.int64)
    for k in range(0, len(words), 1 << 16):
        part = np.ascontiguousarray(words[k : k + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def search(g: Csr, a: np.ndarray, b: np.ndarray, member: np.ndarray | None = None) -> np.ndarray:
    """For up to 64 edges between the vertices at places a and b, rows of counts of vertices: as far from a as from b, one
    hop farther from one of them, reached from a, reached from b, a and b themselves; and those of the first two together,
    of all vertices. member: of each vertex, the edges it counts for in the others."""
    bit = np.left_shift(np.uint64(1), np.arange(len(a), dtype=np.uint64))
    seen, last = np.zeros((2, len(g)), np.uint64), np.zeros((2, len(g)), np.uint64)
    for side, at in enumerate((a, b)):
        np.bitwise_or.at(seen[side], at, bit)
    front, counts, first = np.unique(np.concatenate([a, b])), np.zeros((len(_COUNTS), WORD), np.int64), True
    last[:, front] = seen[:, front]

    def count(at: np.ndarray, rows) -> None:
        for k, x in rows:
            counts[k] += per_bit(x if member is None else x & member[at])

    count(front, ((2, last[0, front]), (3, last[1, front]), (4, last[0, front]), (4, last[1, front])))
    while len(front):
        s, t = g.out(front)
        at, place = np.unique(t, return_inverse=True)
        got = np.zeros((2, len(at)), np.uint64)
        for side in (0, 1):
            np.bitwise_or.at(got[side], place, last[side, s])
        if first:
            for side, end in ((0, b), (1, a)):
                k = np.searchsorted(at, end)
                own = (k < len(at)) & (at[np.minimum(k, len(at) - 1)] == end) if len(at) else np.zeros(len(end), bool)
                np.bitwise_and.at(got[side], k[own], ~bit[own])
            first = False
        new = got & ~seen[:, at]
        even, near = new[0] & new[1], (new[0] & last[1, at]) | (new[1] & last[0, at])
        count(at, ((0, even), (1, near), (2, new[0]), (3, new[1])))
        counts[5] += per_bit(even | near)
        last[:, front] = 0
        some = (new[0] | new[1]) != 0
        front, new = at[some], new[:, some]
        last[:, front] = new
        seen[:, front] |= new
    return counts


def _by_arrays(graph: Graph, pairs: DataFrame, member: DataFrame | None) -> DataFrame:
    """word, bit and counts; a task searches for the edges of one word."""
    held = shared(graph, collected(graph))

    def run(word, pairs: pd.DataFrame, member: pd.DataFrame | None = None) -> pd.DataFrame:
        g, mask = held.value, None
        pairs = pairs.sort_values("bit")
        bits = pairs["bit"].to_numpy()
        if member is not None:
            mask = np.zeros(len(g), np.uint64)
            of = np.zeros(WORD, np.uint64)
            of[bits] = np.left_shift(np.uint64(1), np.arange(len(bits), dtype=np.uint64))
            np.bitwise_or.at(mask, g.at(member["id"].to_numpy()), of[member["bit"].to_numpy()])
        counts = search(g, g.at(pairs["a"].to_numpy()), g.at(pairs["b"].to_numpy()), mask)[:, : len(bits)]
        return pd.DataFrame({"word": pairs["word"].to_numpy(), "bit": bits} | dict(zip(_COUNTS, counts)))

    if member is None:
        return pairs.groupBy("word").applyInPandas(lambda rows: run(None, rows), _SCHEMA)
    return pairs.groupBy("word").cogroup(member.groupBy("word")).applyInPandas(lambda pairs, member: run(None, pairs, member), _SCHEMA)


def _bits_counted(batches):
    for b in batches:
        word, columns = b.column(0).to_numpy(), [c.to_numpy().view(np.uint64) for c in b.columns[1:]]
        for w in np.unique(word).tolist():
            counts = [per_bit(c[word == w]) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(WORD, w)), pa.array(np.arange(WORD, dtype=np.int32)), *map(pa.array, counts)], names=["word", "bit", *_COUNTS])


def _by_tables(graph: Graph, pairs: DataFrame, member: DataFrame | None) -> DataFrame:
    """word, bit and counts; a stored table of (word, vertex, bits of both sides) at each level."""
    bit, none = F.expr("shiftleft(1L, bit)"), F.lit(0).cast("long")
    ends = pairs.select("word", F.col("a").alias("v"), bit.alias("x"), none.alias("y"), none.alias("nx"), bit.alias("ny"))
    ends = ends.union(pairs.select("word", "b", none, bit, bit, none))
    ends = stored(ends.groupBy("word", "v").agg(*[F.bit_or(c).alias(c) for c in ("x", "y", "nx", "ny")]))
    arcs, key = kept(graph).arcs.toDF("v", "t"), ["word", "v"]
    front, levels = stored(ends.select("word", "v", "x", "y", none.alias("c0"), none.alias("c1"))), []
    and_not = lambda a, b: F.col(a).bitwiseAND(F.bitwise_not(F.coalesce(b, none)))
    while front.limit(1).count():
        levels.append(front)
        # neighbours of a level are in it, in the one before, or new; across its own edge a search meets its beginning
        known = front.select(*key, "x", "y", F.col("x").alias("lx"), F.col("y").alias("ly"))
        for old in [ends, *levels[-2:-1]]:
            known = known.union(old.select(*key, "x", "y", none, none))
        known = known.groupBy(*key).agg(*[F.bit_or(c).alias(f"k{c}") for c in ("x", "y", "lx", "ly")])
        step = front.select("word", "v", "x", "y").hint("merge").join(arcs, "v").groupBy("word", F.col("t").alias("v")).agg(F.bit_or("x").alias("x"), F.bit_or("y").alias("y"))
        if len(levels) == 1:
            step = step.join(ends.select(*key, "nx", "ny").hint("merge"), key, "left").select(*key, and_not("x", "nx").alias("x"), and_not("y", "ny").alias("y"))
        new = step.join(known.hint("merge"), key, "left").select(*key, and_not("x", "kx").alias("x"), and_not("y", "ky").alias("y"), F.coalesce("klx", none).alias("lx"), F.coalesce("kly", none).alias("ly"))
        x, y = F.col("x"), F.col("y")
        near = x.bitwiseAND(F.col("ly")).bitwiseOR(y.bitwiseAND(F.col("lx")))
        front = stored(new.where(x.bitwiseOR(y) != 0).select(*key, "x", "y", x.bitwiseAND(y).alias("c0"), near.alias("c1")))
    x, y, c0, c1 = (F.col(c) for c in ("x", "y", "c0", "c1"))
    some = [df.withColumn("ends", x.bitwiseOR(y) if k == 0 else none) for k, df in enumerate(levels)]
    found = reduce(DataFrame.union, some).select("word", "v", c0, c1, x.alias("ra"), y.alias("rb"), "ends", c0.bitwiseOR(c1).alias("met"))
    if member is not None:
        mask = member.groupBy("word", F.col("id").alias("v")).agg(F.bit_or(bit).alias("m"))
        own = lambda c: F.col(c).bitwiseAND(F.coalesce("m", none)).alias(c)
        found = found.join(mask, key, "left").select("word", *[F.col(c) if c == "met" else own(c) for c in _COUNTS])
    counted = found.select("word", *_COUNTS).mapInArrow(_bits_counted, _SCHEMA)
    return counted.groupBy("word", "bit").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def gaps(graph: Graph, pairs: DataFrame, within: DataFrame | None = None, wanted: str | None = None) -> DataFrame:
    """k, n, d0, d1, d2 for pairs(k, a, b) of different vertices, k from 0 without gaps: of n vertices, how many have
    distances to a and b that differ by 0, by 1 and by more, without the edge (a, b). Of all vertices, or of those in
    within(k, id), each once. A distance that there isn't is -1, as elsewhere. pairs and within are stored tables."""
    place = lambda df: df.withColumns({"word": F.floor(F.col("k") / WORD).cast("long"), "bit": (F.col("k") % WORD).cast("int")})
    dealt, member = place(pairs), None if within is None else place(within).drop("k")
    plan = _by_arrays if strategy(graph, wanted) == "kernel" else _by_tables
    counts = plan(graph, dealt, member).withColumn("k", F.col("word") * WORD + F.col("bit"))
    out = pairs.select("k").join(counts, "k")
    if within is None:
        out = out.withColumn("n", F.lit(graph.vertices.count()))
    else:
        out = out.join(within.groupBy("k").agg(F.count("*").alias("n")), "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # a shortest way from a to b has a middle, as far from both but for one hop; without a way only the ends are 1 apart
    met = F.col("met") > 0
    d0 = F.col("c0") + F.col("n") - F.when(met, F.col("ra")).otherwise(F.col("ra") + F.col("rb"))
    d1 = F.when(met, F.col("c1")).otherwise(F.col("ends"))
    return out.select("k", "n", d0.cast("long").alias("d0"), d1.cast("long").alias("d1")).withColumn("d2", F.col("n") - F.col("d0") - F.col("d1"))


def _ways(g: Csr, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k, x, y: the edges of a forest of shortest paths between the vertices at places a[k] and b[k], none without a way."""
    parent, depth, tree = np.full(len(g), -1), np.zeros(len(g), np.int64), np.full(len(g), -1)
    for root in np.unique(np.concatenate([a, b])).tolist():
        if tree[root] >= 0:
            continue
        tree[root], front = root, np.array([root])
        while len(front):
            s, t = g.out(front)
            new = tree[t] < 0
            front, at = np.unique(t[new], return_index=True)
            tree[front], parent[front] = root, s[new][at]
            depth[front] = depth[parent[front]] + 1
    k = np.flatnonzero(tree[a] == tree[b])
    x, y, out = a[k], b[k], []
    while True:
        apart = x != y
        k, x, y = k[apart], x[apart], y[apart]
        if not len(k):
            break
        swap = depth[x] < depth[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        out.append((k, x, parent[x]))
        x = parent[x]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (k, x, y)


def joined_blocks(graph: Graph, pairs: DataFrame, wanted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """For pairs(k, a, b): which blocks the edge (a, b) makes one, or is in, as (k, block); and (block, u, v) of all edges.
    Those are the blocks along the way between a and b in a spanning forest; none in different components. pairs is a
    stored table."""
    if search_strategy(graph, wanted) == "kernel":
        d = Decomposition.of_graph(graph)
        rows = pairs.orderBy("k").toArrow()  # as many as edges were drawn
        k, x, y = _ways(d.g, d.g.at(rows["a"].to_numpy()), d.g.at(rows["b"].to_numpy()))
        n, order = len(d.g), np.argsort(d.u * len(d.g) + d.v)
        at = order[np.searchsorted(d.u[order] * n + d.v[order], np.minimum(x, y) * n + np.maximum(x, y))]
        spark = graph.vertices.sparkSession
        crossed = np.unique(np.stack([rows["k"].to_numpy()[k], d.block[at]], axis=1), axis=0) if len(k) else np.zeros((0, 2), np.int64)
        frame = lambda names, *cols: spark.createDataFrame(pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, cols)}))
        return stored(frame(("k", "block"), crossed[:, 0], crossed[:, 1])), stored(frame(("block", "u", "v"), d.block, d.g.ids[d.u], d.g.ids[d.v]))
    d = Blocks.of(graph)
    place = lambda c: d.vertices.select(F.col("id").alias(c), F.col("pre").alias(f"p{c}"), F.col("size").alias(f"s{c}"))
    ends = stored(pairs.join(place("a"), "a").join(place("b"), "b").select("k", "pa", "pb"))
    # the drawn edges against all vertices: is one end below the vertex, or both, by ranges of places
    below = lambda p: (F.col(p) >= F.col("pre")) & (F.col(p) < F.col("pre") + F.col("nd"))
    met = d.vertices.select("pre", "nd", "parent", "top").join(broadcast_if_small(ends), below("pa") | below("pb")).select("k", "parent", "top", (below("pa") & below("pb")).alias("both"))
    same = met.where("parent is null and both").select("k")
    crossed = stored(met.where("parent is not null and not both").join(same, "k", "left_semi").select("k", F.col("top").alias("block")).distinct())
    return crossed, d.edges.select(F.col("top").alias("block"), "u", "v")
