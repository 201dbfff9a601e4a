"""What the operators share: stored intermediate tables, slices of Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..store import broadcast_if_small, remove, shared_dir, stored_result  # noqa: F401

#: Stands for a null id inside the operators, so that ids can be joined and compared.
NULL_ID = -(2**63)
#: Text that is worked on at once in a Python worker.
SLICE_BYTES = 4 << 20
#: Rows of a few numbers that are sent to all executors; larger tables are joined by a shuffle.
FEW = 1_000_000


class Scratch:
    """Intermediate tables of one operator call, stored in the shared folder.

    A stored table cuts the lineage and survives lost executors. ``drop`` deletes a table as soon as
    nothing that is still to run reads it; the others stay for the result that was handed out.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.at}/{self.n:02d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with stored_result(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._graphloom_path = path
        return out

    def small(self, df: DataFrame, name: str, rows: int = FEW, **figures: Column) -> tuple[DataFrame, dict]:
        """The stored table, to be sent to all executors if it has at most so many rows of a few numbers each, and
        figures of it, taken while it is written: n, its rows, and aggregates asked for."""
        seen = Observation()
        out = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in figures.items()]), name)
        sent = F.broadcast(out) if seen.get["n"] <= rows else out
        sent._graphloom_path = out._graphloom_path
        return sent, seen.get

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            remove(self.spark, df._graphloom_path)


def row_id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def null_again(col: Column) -> Column:
    return F.when(col != NULL_ID, col)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of the text column, one row at least. What has been
    freed meanwhile goes back to the system after each batch, as idle workers keep theirs beside those that work."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch, col
        give_back()


def give_back() -> None:
    """Free memory of this process to the system, where its C library has a call for that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [x or b"" for x in values(batch, name).cast(pa.large_binary()).to_pylist()]


def ids_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return values(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


def word_hashes(words: list[bytes], key: str = "graphloom-words!") -> np.ndarray:
    """64-bit SipHash of each word, the same in every process. key: 16 characters."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False, hash_key=key)


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in one list, and where each text's words start (one more entry at the end).

    A word is a run of bytes other than space and \\x09-\\x0D, which is what bytes.split() splits at.
    """
    parts = [t.split() for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return [w for p in parts for w in p], starts


def stars(scratch: Scratch, links: DataFrame, most: int = 60) -> tuple[DataFrame, int]:
    """(id, component) for each id of links(a, b) that has a smaller one within reach: the smallest. A stored table,
    and how many rows it has.

    Each round sends every id's smallest neighbour to all of its neighbours (large-star, then small-star), so
    that paths shorten by powers of two; groups of any size stay spread, as minima are pre-aggregated. The minima
    of few links are sent to all tasks, so that only sums and what is stored are shuffled, and so are few links
    themselves, to see whether they lead to the smallest ids at once.
    """
    def put(df: DataFrame) -> tuple[DataFrame, tuple[int, object]]:
        out, seen = scratch.small(df, "edges", 0, mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        return out, (seen["n"], seen["mark"])

    edges, before = put(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most if before[0] else 0):
        few = before[0] <= FEW // 2  # so many ends at most
        if few:  # settled where no id has two links, or one to an id that has a link itself
            to = F.broadcast(edges.toDF("c", "d"))
            more = edges.join(to, [F.col("a") == F.col("c"), F.col("b") < F.col("d")], "left_semi").union(edges.join(to, F.col("b") == F.col("c"), "left_semi"))
            if not more.limit(1).count():
                break
        sent = F.broadcast if few else lambda df: df
        arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = arcs.where("b > a").join(sent(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large if few else large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(low), "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now, last = edges, before
        edges, before = put(small)
        scratch.drop(now)
        if before == last:
            break
    else:
        if before[0]:
            raise RuntimeError("the components have not settled")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")), before[0]


def components(scratch: Scratch, links: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) for each id of links(a, b): the smallest id reachable."""
    found, _ = stars(scratch, links, most)
    return found.union(found.select(F.col("component").alias("id"), "component")).distinct()
