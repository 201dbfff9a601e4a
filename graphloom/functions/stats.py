"""Summary statistics and estimators of the experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, canonical
from ..operators import blocks
from ..store import broadcast_if_small, stored


#: Ranges that a pass of select() counts, and values few enough to be sorted.
RANGES, FEW = 4096, 10_000


def select(df: DataFrame, col: str, k: int) -> float:
    """The k-th smallest value (from 0) of a column of numbers, NaN last; nulls don't count. Each pass counts the values
    of RANGES equal ranges and goes on in the one that holds the k-th, so no task and no buffer sees more than a partition."""
    x = df.select(F.col(f"`{col}`").cast("double").alias("x")).where("x is not null")
    while True:
        finite = F.abs("x") < float("inf")
        seen = x.agg(F.count("*").alias("n"), F.min(F.when(finite, F.col("x"))).alias("lo"), F.max(F.when(finite, F.col("x"))).alias("hi")).first()
        if not 0 <= k < seen.n:
            raise IndexError(f"there are {seen.n} values")
        if seen.n <= FEW:
            return x.orderBy("x").offset(k).limit(1).first().x
        lo, hi = seen.lo or 0.0, seen.hi or 0.0
        width = hi / 2 - lo / 2 or 1.0  # halves, as the difference may be too large
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("x") / 2 - F.lit(lo / 2)) / F.lit(width) * RANGES).cast("int"))
        place = F.when(F.isnan("x"), RANGES + 1).when(F.col("x") == float("inf"), RANGES).when(F.col("x") == -float("inf"), -1).otherwise(place)
        ranges = x.groupBy(place.alias("r")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("r").collect()  # RANGES rows
        for r in ranges:
            if k < r.n:
                break
            k -= r.n
        if r.lo == r.hi or r.r > RANGES:
            return r.lo
        x = x.where((F.col("x") >= r.lo) & (F.col("x") <= r.hi))


def simple_stats(df: DataFrame, col: str) -> DataFrame:
    """n, min, max, mean, stddev (of the population), median (the upper one). Nulls don't count; no rows: nulls."""
    x = F.col(col)
    n = df.agg(F.count(x)).first()[0]
    median = F.lit(select(df, col, n // 2) if n else None).cast("double")
    return df.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev"), median.alias("median"))


def confidence_95(stats: DataFrame) -> DataFrame:
    """lo and hi of the mean, for what simple_stats returns."""
    half = 1.96 * F.col("stddev") / F.sqrt("n")
    return stats.withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half})


def ideal_speedup_bcc(iter_frac: Column, bcc_n: Column, bcc_m: Column, g_n: Column, g_m: Column, ratio: Column | int = 100) -> Column:
    """How many times faster an update can be than a full run: sources and edges of the block against those of
    the graph; ratio: cost of an update's iteration in per cent of a full one's."""
    part = (bcc_n / g_n) * iter_frac * ((bcc_n + bcc_m) / (g_n + g_m))
    return F.lit(1.0) / part * F.lit(100.0) / ratio


def ideal_speedup_muc(n: Column, m: Column, muc_n: Column, muc_m: Column) -> Column:
    return ((n + m) / (muc_n + muc_m)) * (n / muc_n)


def block_sizes(graph: Graph, wanted: str | None = None) -> DataFrame:
    """block_id, n, m."""
    e = blocks.biconnected_components(graph, wanted)
    both = e.select("block_id", F.explode(F.array("u", "v")).alias("id"))
    n = both.groupBy("block_id").agg(F.countDistinct("id").alias("n"))
    return n.join(e.groupBy("block_id").agg(F.count("*").alias("m")), "block_id")


def largest_block_stats(graph: Graph, wanted: str | None = None) -> DataFrame:
    """One row: nodes, edges, frac_nodes, frac_edges of the block with most vertices (the first of equals)."""
    n, m = graph.size()
    best = block_sizes(graph, wanted).agg(F.max_by(F.struct("n", "m"), F.struct(F.col("n"), -F.col("block_id"))).alias("b"))
    zero = F.lit(0).cast("long")
    nodes, edges = F.coalesce("b.n", zero), F.coalesce("b.m", zero)
    return best.select(nodes.alias("nodes"), edges.alias("edges"), (nodes / F.lit(float(max(n, 1)))).alias("frac_nodes"), (edges / F.lit(float(max(m, 1)))).alias("frac_edges"))


def count_blocks(graph: Graph, least_edges: int, wanted: str | None = None) -> DataFrame:
    """One row: blocks, blocks_of_size (with at least so many edges), largest, second, frac_largest (of edges)."""
    by_size = block_sizes(graph, wanted).groupBy("m").agg(F.count("*").alias("k"))
    top = by_size.agg(F.sum("k").alias("blocks"), F.coalesce(F.sum(F.when(F.col("m") >= least_edges, F.col("k"))), F.lit(0)).alias("blocks_of_size"), F.max("m").alias("largest"), F.sum(F.col("m") * F.col("k")).alias("all"), F.max_by("k", "m").alias("ties"))
    below = by_size.join(F.broadcast(top.select("largest")), F.col("m") < F.col("largest")).agg(F.max("m").alias("next"))
    second = F.when(F.col("ties") > 1, F.col("largest")).otherwise(F.col("next"))
    return top.join(F.broadcast(below)).select(F.coalesce("blocks", F.lit(0)).alias("blocks"), "blocks_of_size", "largest", second.alias("second"), (F.col("largest") / F.col("all")).alias("frac_largest"))


def random_non_edges(graph: Graph, k: int, seed: int = 0) -> DataFrame:
    """seq, u, v: k pairs of different vertices without an edge, by a seeded order; fewer if there are fewer.

    The ends of draw i are the MD5 of `seed i 1` and of `seed i 2`, the first eight digits as a number, modulo the
    number of vertices; draws go on, four times as many each time, until enough pairs are new.
    """
    g, names = graph.relabelled()
    n, m = g.size()
    free = n * (n - 1) // 2 - m
    want, spark = min(k, free), graph.vertices.sparkSession
    if not want:
        return spark.createDataFrame([], "seq int, u long, v long")
    draws = max(64, int(4 * want * (n * (n - 1) / 2) / free))
    rows = []
    while len(rows) < want:
        h = lambda x: F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("id").cast("string"), F.lit(str(x)))), 1, 8), 16, 10).cast("long") % n
        pairs = spark.range(draws).select("id", h(1).alias("a"), h(2).alias("b")).select("id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v")
        new = pairs.groupBy("u", "v").agg(F.min("id").alias("id")).join(g.edges, ["u", "v"], "left_anti")
        rows, draws = new.orderBy("id").limit(want).collect(), draws * 4  # k rows
    found = spark.createDataFrame([(i, r.u, r.v) for i, r in enumerate(rows)], "seq int, a long, b long")
    return found.join(names.toDF("u", "a"), "a").join(names.toDF("v", "b"), "b").select("seq", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def random_edges(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """u, v of k edges in the order of the MD5 of `seed u v`."""
    return edges.select("u", "v").orderBy(F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("u").cast("string"), F.col("v").cast("string"))), "u", "v").limit(k)


def random_non_bridges(graph: Graph, k: int, seed: int = 0, wanted: str | None = None) -> DataFrame:
    return random_edges(graph.edges.join(blocks.bridges(graph, wanted), ["u", "v"], "left_anti"), k, seed)


#: Costs of an update's iteration in per cent of a full one's, that speedups are estimated for.
RATIOS = (100, 120, 150)


def _numbered(edges: DataFrame, order: list[str]) -> DataFrame:
    """k, a, b, stored, of drawn edges."""
    return stored(edges.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("k"), F.col("u").alias("a"), F.col("v").alias("b")))  # drawn edges only


def speedup_info(graph: Graph, edges: DataFrame, ratios: tuple[int, ...] = RATIOS, wanted: str | None = None) -> DataFrame:
    """u, v, n, m, d0, d1, d2, frac (of sources with work to do) and speedups for edges(u, v) that may come in or are
    there: n vertices and m edges of the block with the edge in it, sources in it by how much nearer they are to one end
    without the edge (0, 1, more), and ideal speedups (null where no source has work). One search serves 64 edges. Both
    ends are different vertices of the graph; pairs are taken once, in any order."""
    from ..operators.bitsearch import gaps, joined_blocks

    n, m = graph.size()
    pairs = _numbered(canonical(edges.select("u", "v")), ["u", "v"])
    crossed, of_blocks = joined_blocks(graph, pairs, wanted)
    parts = stored(of_blocks.join(broadcast_if_small(crossed), "block"))  # the edges of an edge's block, as often as drawn edges are in it
    ends = pairs.select("k", F.explode(F.array("a", "b")).alias("id"))
    within = stored(parts.select("k", F.explode(F.array("u", "v")).alias("id")).union(ends).distinct())
    there = graph.edges.join(F.broadcast(pairs.select("k", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))), ["u", "v"]).select("k", F.lit(0).alias("new"))
    sizes = pairs.select("k", "a", "b").join(parts.groupBy("k").agg(F.count("*").alias("m")), "k", "left").join(there, "k", "left")
    sizes = sizes.select("k", F.col("a").alias("u"), F.col("b").alias("v"), (F.coalesce("m", F.lit(0)) + F.coalesce("new", F.lit(1))).cast("long").alias("m"))
    out = sizes.join(gaps(graph, pairs, within, wanted), "k").withColumn("frac", F.lit(1.0) - F.col("d0") / F.col("n"))
    speedup = lambda r: F.when(F.col("frac") > 0, ideal_speedup_bcc(F.col("frac"), F.col("n"), F.col("m"), F.lit(n), F.lit(m), r))
    return out.select("u", "v", "n", "m", "d0", "d1", "d2", "frac", *[speedup(r).alias(f"speedup_{r}") for r in ratios])


def speedup_summary(info: DataFrame, ratios: tuple[int, ...] = RATIOS) -> DataFrame:
    """ratio, and simple_stats of the speedups of speedup_info for it."""
    info = stored(info)
    each = [simple_stats(info, f"speedup_{r}").select(F.lit(r).alias("ratio"), "*") for r in ratios]
    return reduce(DataFrame.union, each)


def largest_block_speedups(graph: Graph, k: int, seed: int = 0, ratios: tuple[int, ...] = RATIOS, wanted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """For k edges of the block with most vertices and edges (the first of equals), in a seeded order: u, v, n, d0, d1,
    d2, frac_d0 in it, each without its edge. And of all: stat (mean, stddev, median, min, max), frac_d0, and the ideal
    speedup if that share of the sources has no work, by ratio; null where none has any."""
    from ..operators.bitsearch import gaps

    n, m = graph.size()
    found = stored(blocks.biconnected_components(graph, wanted))
    both = found.select("block_id", F.explode(F.array("u", "v")).alias("id"))
    sizes = both.groupBy("block_id").agg(F.countDistinct("id").alias("n")).join(found.groupBy("block_id").agg(F.count("*").alias("m")), "block_id")
    best = sizes.orderBy((F.col("n") + F.col("m")).desc(), "block_id").first()
    if best is None:
        spark = graph.vertices.sparkSession
        return spark.createDataFrame([], "u long, v long, n long, d0 long, d1 long, d2 long, frac_d0 double"), spark.createDataFrame([], "stat string, frac_d0 double, " + ", ".join(f"speedup_{r} double" for r in ratios))
    block = Graph.of(stored(found.where(F.col("block_id") == best.block_id).select("u", "v")))
    pairs = _numbered(random_edges(block.edges, k, seed), ["u", "v"])
    each = stored(pairs.join(gaps(block, pairs, wanted=wanted), "k").select(F.col("a").alias("u"), F.col("b").alias("v"), "n", "d0", "d1", "d2", (F.col("d0") / F.col("n")).alias("frac_d0")))
    names = ["mean", "stddev", "median", "min", "max"]
    rows = simple_stats(each, "frac_d0").select(F.explode(F.array(*[F.struct(F.lit(x).alias("stat"), F.col(x).cast("double").alias("frac_d0")) for x in names])).alias("r")).select("r.*")
    left, of = F.lit(1.0) - F.col("frac_d0"), [F.lit(x) for x in (best.n, best.m, n, m)]
    return each, rows.select("stat", "frac_d0", *[F.when(left > 0, ideal_speedup_bcc(left, *of, r)).alias(f"speedup_{r}") for r in ratios])


def speedup_report(graph: Graph, edges: list[tuple[int, int]], ratios: tuple[int, ...] = RATIOS) -> DataFrame:
    """For each edge that may come in or is there: its block's size, pruning counts in it, and ideal speedups."""
    info = speedup_info(graph, graph.vertices.sparkSession.createDataFrame(edges, "u long, v long"), ratios)
    return info.select("u", "v", "n", "m", F.col("d0").alias("pruned"), (F.col("n") - F.col("d0")).alias("sources"), *[f"speedup_{r}" for r in ratios])
