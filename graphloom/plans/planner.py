"""Which physical strategy a graph gets, and what an update will do."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast

from ..graph import Graph
from ..operators.kernel import Csr

#: Up to so many edges the adjacency is collected once and broadcast as arrays (16 bytes an arc); beyond, the
#: level-synchronous plans on DataFrames run.
KERNEL_EDGES = 10_000_000
#: Edges that the depth-first search for blocks may visit on the driver, by its memory (about 1200 bytes each). Of dense
#: graphs two forests are searched, fewer than two edges a vertex. Beyond, blocks are found on DataFrames.
SEARCHED_EDGES = 1_000_000


def strategy(graph: Graph, wanted: str | None = None) -> str:
    """kernel or relational. Counts at most KERNEL_EDGES + 1 edges, and as many vertices."""
    if wanted is not None:
        return wanted
    small = all(df.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES for df in (graph.edges, graph.vertices))
    return "kernel" if small else "relational"


def search_strategy(graph: Graph, wanted: str | None = None) -> str:
    """strategy() of the decomposition into blocks."""
    if wanted is not None or strategy(graph) == "relational":
        return wanted or "relational"
    few = any(df.limit(most + 1).count() <= most for df, most in ((graph.edges, SEARCHED_EDGES), (graph.vertices, SEARCHED_EDGES // 2)))
    return "kernel" if few else "relational"


def collected(graph: Graph) -> Csr:
    """The adjacency as arrays on the driver; only for graphs that strategy() calls kernel."""
    ids, e = graph.vertices.toArrow()["id"].to_numpy(), graph.edges.toArrow()
    return Csr.of(ids.astype(np.int64), e["u"].to_numpy().astype(np.int64, copy=False), e["v"].to_numpy().astype(np.int64, copy=False))


def shared(graph: Graph, g: Csr) -> Broadcast:
    return graph.edges.sparkSession.sparkContext.broadcast(g)


@dataclass(frozen=True)
class UpdatePlan:
    """What an incremental update works on."""

    decomposition: str  # graph, bcc or muc
    op: str  # insert, delete, none, or recompute where connectivity changes
    block_vertices: int
    block_edges: int
    sources: int  # affected ones
    pruned: int
    near: int = 0  # affected sources that are one step nearer to one end
    at_once: int = 0  # of these, sources whose distances are the same with and without the edge: one pass for both graphs

    def explain(self) -> str:
        share = self.pruned / max(1, self.pruned + self.sources)
        return f"{self.op} in {self.decomposition}: block of {self.block_vertices} vertices and {self.block_edges} edges, {self.sources} affected sources ({share:.1%} pruned)"
