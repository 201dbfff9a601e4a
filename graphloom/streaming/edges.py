"""Edge events as a stream: betweenness is kept up to date batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..graph import Graph
from ..operators.betweenness import brandes
from ..operators.incremental import changed, update
from ..store import mark, matching, remove, shared_dir, stored


class LiveBetweenness:
    """The graph and its betweenness after all events so far. A batch's events are applied in the order of seq;
    a batch that comes again after a failure is known by its number and not applied twice.

    The state after each batch is stored in ``home``, by the batch's number, and counts once its mark is written.
    Where home holds a state already, the last one is taken up and ``graph`` is not looked at, so a restarted
    driver goes on where its stream's checkpoint does. A home belongs to one checkpoint; the last two states
    are kept. Without a home, the state lasts as long as the driver.
    """

    def __init__(self, graph: Graph, decomposition: str = "bcc", home: str | None = None):
        self.spark, self.decomposition = graph.vertices.sparkSession, decomposition
        self.home = (home or f"{shared_dir(self.spark)}/live-{uuid.uuid4().hex}").rstrip("/")
        if kept := self._kept():
            self._take(kept[-1])
        else:
            self._keep(-1, graph, brandes(graph))

    def _at(self, number: int) -> str:
        return f"{self.home}/after-{number}"

    def _kept(self) -> list[int]:
        return sorted(int(p.split("/")[-2].removeprefix("after-")) for p in matching(self.spark, f"{self.home}/after-*/complete"))

    def _take(self, number: int) -> None:
        at, read = self._at(number), self.spark.read
        self.graph = Graph(read.schema("id long").parquet(f"{at}/vertices"), read.schema("u long, v long").parquet(f"{at}/edges"))
        self.bc, self.done = read.schema("id long, bc double").parquet(f"{at}/bc"), number

    def _keep(self, number: int, graph: Graph, bc: DataFrame) -> None:
        at = self._at(number)
        for df, name in ((graph.vertices, "vertices"), (graph.edges, "edges"), (bc, "bc")):
            stored(df, f"{at}/{name}")
        mark(self.spark, f"{at}/complete")
        self._take(number)
        for old in self._kept()[:-2]:
            remove(self.spark, self._at(old))

    def apply(self, batch: DataFrame, number: int) -> None:
        """batch(seq, op, u, v); op is + or -."""
        if number <= self.done:
            return
        graph, bc, work = self.graph, self.bc, f"{self.home}/work"
        for k, e in enumerate(batch.select("seq", "op", "u", "v").orderBy("seq").toLocalIterator()):
            op = {"+": "insert", "-": "delete"}[e.op]
            bc = stored(update(graph, bc, e.u, e.v, op, self.decomposition), f"{work}/{k}/bc")
            after = changed(graph, e.u, e.v, op)
            graph = Graph(stored(after.vertices, f"{work}/{k}/vertices"), stored(after.edges, f"{work}/{k}/edges"))
            if k > 1:
                remove(self.spark, f"{work}/{k - 2}")
        self._keep(number, graph, bc)
        remove(self.spark, work)

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        """events: a streaming frame of seq, op, u, v."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay(graph: Graph, events: DataFrame, decomposition: str = "bcc") -> LiveBetweenness:
    """The same over a finite table of events."""
    live = LiveBetweenness(graph, decomposition)
    live.apply(events, 0)
    return live
