"""Graphs and experiment settings as text, results as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def _numbers(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim(F.col("value")), r"\s+")
    n = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("long")
    return lines.select(n(1).alias("u"), n(2).alias("v")).where("u is not null and v is not null")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """A .net file, or a folder of its parts: `N M`, then `source target` in each line. Vertices are 0..N-1; edges to
    others are left out (so is the first line, whose N is one), as are loops and repeated edges. In a folder the first
    line is that of the first part by name."""
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    head = spark.read.text(files[0]).first() if files else None
    if head is None:
        raise ValueError(f"{path} is empty")
    n = int(head.value.split()[0])
    pairs = _numbers(lines).where((F.col("u") < n) & (F.col("v") < n) & (F.col("u") >= 0) & (F.col("v") >= 0))
    return Graph.of(pairs, spark.range(n))


def write_graph(graph: Graph, path: str) -> None:
    """A .net file in parts: the first holds `N M`, each task writes its edges to another. Vertices must be 0..N-1."""
    n, m = graph.size()
    spark = graph.vertices.sparkSession
    head = spark.createDataFrame([(f"{n} {m}",)], "value string").coalesce(1)
    head.union(graph.edges.select(F.concat_ws(" ", "u", "v"))).write.text(path)  # partitions in that order


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """`v1 v2` in each line: u, v as they are."""
    return _numbers(spark.read.text(path))


def write_delta(delta: DataFrame, path: str, form: str = "parquet") -> None:
    """By the graph's own ids."""
    delta.write.format(form).option("header", True).save(path)


def graph_name(path: str) -> str:
    """What follows the last slash."""
    return path.rsplit("/", 1)[-1]


@dataclass
class Config:
    deletion: bool
    num_edges: int
    num_threads: int
    rand_seed: int
    external_edges: bool
    update_whole: bool
    update_blocks: bool
    run_full_fast: bool
    run_full: bool
    run_parts: bool
    update_parts: bool
    paths: list[str] = field(default_factory=list)


@dataclass
class PaperConfig:
    num_edges: int
    num_iter: int
    max_time: float
    rand_seed: int
    update_whole: bool
    run_parts: bool
    update_parts: bool
    update_blocks: bool
    paths: list[str] = field(default_factory=list)


def _lines(text: str, rows: int) -> tuple[list[list[str]], list[str]]:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) < rows:
        raise ValueError("the settings are cut off")
    return [[y.strip() for y in x.split(",")] for x in lines[:rows]], " ".join(lines[rows:]).split()


def parse_config(text: str) -> Config:
    """Deletion flag; edges, threads, seed; three switches; four switches; paths. Without the first line, as in
    older files, edges are inserted."""
    first = next((x for x in text.splitlines() if x.strip()), "")
    if "," in first:
        text = "0\n" + text
    rows, paths = _lines(text, 4)
    return Config(rows[0][0] == "1", *map(int, rows[1]), *[x != "0" for x in rows[2]], *[x != "0" for x in rows[3]], paths)


def parse_paper_config(text: str) -> PaperConfig:
    """Edges, iterations, seconds, seed; four switches; paths."""
    rows, paths = _lines(text, 2)
    a = rows[0]
    return PaperConfig(int(a[0]), int(a[1]), float(a[2]), int(a[3]), *[x != "0" for x in rows[1]], paths)
