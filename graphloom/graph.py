"""The data model: an undirected simple graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(pairs: DataFrame) -> DataFrame:
    """edges(u, v) with u < v, each once; loops and pairs with a null go."""
    a, b = pairs.columns[:2]
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    return pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where((u != v) & u.isNotNull() & v.isNotNull()).distinct()


def ends(edges: DataFrame) -> DataFrame:
    """id of both ends of each edge."""
    return edges.select(F.col("u").alias("id")).union(edges.select("v"))


@dataclass(frozen=True)
class Graph:
    """vertices(id) and edges(u, v), canonical. Changes return new graphs; ids may be sparse. With covered, the vertices
    are the ends of the edges, so that they can be had from stored edges."""

    vertices: DataFrame
    edges: DataFrame
    covered: bool = False

    @staticmethod
    def of(pairs: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """From pairs of ids in any order and number; vertices adds isolated ones."""
        edges = canonical(pairs)
        ids = ends(edges)
        if vertices is not None:
            ids = ids.union(vertices.select(F.col(vertices.columns[0]).cast("long")))
        return Graph(ids.distinct(), edges, vertices is None)

    @staticmethod
    def from_list(spark: SparkSession, edges: Iterable[tuple[int, int]], n: int | None = None) -> Graph:
        pairs = spark.createDataFrame([tuple(e) for e in edges], "u long, v long")
        return Graph.of(pairs, spark.range(n) if n is not None else None)

    @property
    def arcs(self) -> DataFrame:
        """(s, t) in both directions."""
        e = self.edges
        return e.select(F.col("u").alias("s"), F.col("v").alias("t")).union(e.select("v", "u"))

    def twins(self, apart: Iterable[int] = (), most: int | None = None) -> DataFrame:
        """id, rep, n of every vertex. Vertices with the same one or two neighbours are at the same distances from all
        others, by as many paths, and 2 apart, by n; rep is the least of them, and of its own for all other vertices
        and those in apart. With most, groups of twins are split into some of about that size."""
        ends = self.arcs.groupBy("s").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("n <= 2")
        if apart:
            ends = ends.where(~F.col("s").isin(*apart))
        kind = ["lo", "hi"]
        if most is not None:
            sizes = ends.groupBy(*kind).agg(F.count("*").alias("size"))
            ends = ends.join(sizes, kind).withColumn("part", F.pmod(F.xxhash64("s"), F.ceil(F.col("size") / most)))
            kind = [*kind, "part"]
        same = ends.join(ends.groupBy(*kind).agg(F.min("s").alias("rep")), kind).select(F.col("s").alias("id"), "rep", "n")
        return self.vertices.join(same, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(0)).alias("n"))

    def insert_edges(self, pairs: DataFrame) -> Graph:
        """Inserting an edge that is there, either way round, changes nothing."""
        return Graph.of(self.edges.union(canonical(pairs)), self.vertices)

    def remove_edges(self, pairs: DataFrame) -> Graph:
        """Vertices stay; removing an edge that isn't there changes nothing."""
        return Graph(self.vertices, self.edges.join(canonical(pairs), ["u", "v"], "left_anti"))

    def insert_vertices(self, ids: DataFrame) -> Graph:
        return Graph(self.vertices.union(ids.select(F.col(ids.columns[0]).cast("long"))).distinct(), self.edges)

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """The given pairs with a column `there`."""
        a, b = pairs.columns[:2]
        keyed = pairs.withColumns({"_u": F.least(a, b), "_v": F.greatest(a, b)})
        held = self.edges.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.lit(True).alias("_there"))
        return keyed.join(held, ["_u", "_v"], "left").select(*pairs.columns, F.coalesce("_there", F.lit(False)).alias("there"))

    def neighbours(self, ids: DataFrame | None = None) -> DataFrame:
        """id, neighbour."""
        out = self.arcs.select(F.col("s").alias("id"), F.col("t").alias("neighbour"))
        return out if ids is None else out.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")

    def degrees(self) -> DataFrame:
        """id, degree; 0 for isolated vertices."""
        n = self.arcs.groupBy("s").agg(F.count("*").alias("degree"))
        return self.vertices.join(n, F.col("id") == F.col("s"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def adjacency(self) -> DataFrame:
        """id, neighbours in order."""
        lists = self.arcs.groupBy("s").agg(F.sort_array(F.collect_set("t")).alias("neighbours"))
        return self.vertices.join(lists, F.col("id") == F.col("s"), "left").select("id", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))

    def size(self) -> tuple[int, int]:
        """Numbers of vertices and edges."""
        return self.vertices.count(), self.edges.count()

    def restricted(self, ids: DataFrame) -> Graph:
        """The subgraph between the given vertices."""
        some = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        e = self.edges.join(some.withColumnRenamed("id", "u"), "u", "left_semi").join(some.withColumnRenamed("id", "v"), "v", "left_semi")
        return Graph(self.vertices.join(some, "id", "left_semi"), e)

    def relabelled(self) -> tuple[Graph, DataFrame]:
        """The graph on 0..N-1 in the order of ids, and map(id, label). Labels come from counts of ranges of
        ids, so the numbering needs no single task."""
        parts = self.vertices.select("id", F.shiftright("id", 16).alias("part"))
        from pyspark.sql import Window

        counts = parts.groupBy("part").agg(F.count("*").alias("n"))
        before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        names = parts.join(before, "part").select("id", (F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1 + F.col("before")).alias("label"))
        e = self.edges.join(names.toDF("u", "a"), "u").join(names.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        return Graph(names.select(F.col("label").alias("id")), canonical(e)), names
