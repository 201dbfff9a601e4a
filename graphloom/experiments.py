"""Experiment drivers: time updates of single edges, and compare methods on the same edges."""

from __future__ import annotations

import time
from statistics import fmean, median

from pyspark.sql import DataFrame, SparkSession

from .functions.stats import random_non_bridges, random_non_edges
from .graph import Graph
from .operators.betweenness import brandes, by_blocks
from .operators.incremental import DECOMPOSITIONS, changed, delta, explain, part_betweenness, update
from .sources.text import Config, graph_name, parse_config, parse_paper_config, read_edges, read_graph
from .store import stored


def timed(df: DataFrame) -> tuple[float, list]:
    began = time.perf_counter()
    rows = df.collect()
    return time.perf_counter() - began, rows


def workload(spark: SparkSession, graph: Graph, config: Config, path: str) -> list[tuple[int, int]]:
    """The edges of an experiment: from <graph>.edges, or drawn by the seed (no bridges for deletions)."""
    if config.external_edges:
        found = read_edges(spark, path + ".edges")
    elif config.deletion:
        found = random_non_bridges(graph, config.num_edges, config.rand_seed)
    else:
        found = random_non_edges(graph, config.num_edges, config.rand_seed).orderBy("seq")
    return [(r.u, r.v) for r in found.select("u", "v").collect()]


def update_experiment(spark: SparkSession, text: str) -> list[dict]:
    """For each graph of the settings: every edge's update against the same base graph, times and speedups."""
    config, out = parse_config(text), []
    for path in config.paths:
        graph = read_graph(spark, path)
        edges = workload(spark, graph, config, path)
        op = "delete" if config.deletion else "insert"
        base, bc = timed(brandes(graph)) if config.run_full or config.run_full_fast else (1.0, [])
        total = stored(spark.createDataFrame(bc, "id long, bc double")) if bc else None
        rows = []
        for a, b in edges:
            from_graph = changed(graph, a, b, "delete") if config.external_edges and op == "insert" else graph
            s, _ = timed(delta(from_graph, a, b, op, "bcc"))
            rows.append({"edge": (a, b), "seconds": s, "speedup": base / s, "plan": explain(from_graph, a, b, op).explain()})
            if total is not None:
                total = stored(update(from_graph, total, a, b, op, "bcc"))
        out.append({"graph": graph_name(path), "edges": rows, "mean_seconds": fmean(r["seconds"] for r in rows) if rows else None, "mean_speedup": fmean(r["speedup"] for r in rows) if rows else None, "bc": total})
    return out


def compare(graph: Graph, edges: list[tuple[int, int]], op: str = "insert", sources: int | None = None) -> list[dict]:
    """Full run, run by blocks, and updates with each decomposition over the same edges; with sources, full runs
    are estimated from so many of them."""
    n = graph.vertices.count()
    whole, _ = timed(brandes(graph, sources))
    whole *= n / min(n, sources) if sources else 1
    out = [{"method": "brandes", "seconds": whole}, {"method": "by_blocks", "seconds": timed(by_blocks(graph))[0]}]
    for how in DECOMPOSITIONS:
        times = [timed(delta(graph, a, b, op, how))[0] for a, b in edges]
        out.append({"method": f"update_{how}", "seconds": fmean(times), "median": median(times), "speedup": whole / fmean(times)})
    return out


def _seconds(graph: Graph, edge: tuple[int, int], method: str, k: int | None) -> float:
    """The time of one method for one insertion; with k, estimated from so many sources (of either class)."""
    a, b = edge
    if method == "part":
        plan = explain(graph, a, b, "insert", "muc")
        s, _ = timed(part_betweenness(graph, a, b, "muc", k))
        return s * max(1.0, plan.block_vertices / k) if k and plan.op == "insert" else s
    plan = explain(graph, a, b, "insert", method)
    s, _ = timed(delta(graph, a, b, "insert", method, {1: k, 2: k} if k else None))
    done = min(plan.near, k) + min(plan.sources - plan.near, k) if k else 0
    return s * plan.sources / done if done and plan.op == "insert" else s


def paper_experiment(spark: SparkSession, text: str) -> dict[str, list[dict]]:
    """For each graph of the settings: a full run, and the chosen methods over the same random insertions into the
    base graph, with their speedups. Times are estimated from num_iter sources (-1: all). Where the full run's
    estimate is below max_time, it is run whole, and so are all methods but the update without decomposition."""
    config, out = parse_paper_config(text), {}
    few = None if config.num_iter == -1 else config.num_iter
    chosen = [("graph", config.update_whole), ("part", config.run_parts), ("muc", config.update_parts), ("bcc", config.update_blocks)]
    for path in config.paths:
        graph = read_graph(spark, path)
        graph = Graph(stored(graph.vertices), stored(graph.edges))
        edges = [(r.u, r.v) for r in random_non_edges(graph, config.num_edges, config.rand_seed).orderBy("seq").collect()]
        n, k, whole = graph.vertices.count(), few, 0.0
        if few:
            whole = timed(brandes(graph, few))[0] * n / min(n, few)
            k = None if whole < config.max_time else few
        if k is None:
            whole, _ = timed(brandes(graph))
        rows = [{"method": "brandes", "seconds": whole, "sources": k}]
        for method, wanted in chosen:
            if wanted and edges:
                cap = few if method == "graph" else k
                mean = fmean(_seconds(graph, e, method, cap) for e in edges)
                rows.append({"method": "static_part" if method == "part" else f"update_{method}", "seconds": mean, "sources": cap, "speedup": whole / mean})
        out[graph_name(path)] = rows
    return out
