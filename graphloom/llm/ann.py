"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample; every row is indexed. A
query probes the lists of the largest bound: the product with the centroid, and the length of the query times
the spread that the list's residuals are likely to reach. How many lists that takes is measured on some of the queries, which
are held against all rows: queries may lie elsewhere than the rows, and the rows elsewhere than the sample. Then
each query knows how near its k-th row is, and probes all further lists that may hold nearer ones, by a reach of
the residuals that is measured on the same queries; so a query among few or odd rows gets more lists than others.
Scores are summed from the query's table of products with all codewords (asymmetric distances); the best of a
block are scored again on the original vectors in double precision.

Rows are stored in blocks of bounded size in the order of their lists, queries likewise, and a pair of blocks
meets where a query of the one probes a list of the other. Vectors are not copied for each list that is probed,
and neither a list that holds a third of the rows nor one that all queries probe meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, null_again, slices, values
from .vectors import matrix, usable

#: Rows that the centroids and codebooks are fitted on.
SAMPLE = 20_000
#: Queries that the number of probes and the reach of residuals are measured with.
PROBED = 256
#: Vectors of a block, in bytes.
BLOCK_BYTES, QUERY_BYTES = 4 << 20, 2 << 20
PARTS, WORDS = 16, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[k : k + 4096] @ c.T - half).argmax(axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


@dataclass
class Index:
    centroids: np.ndarray  # lists x d
    words: list[np.ndarray]  # of each part: codewords x its dimensions
    cuts: list[int]
    scale: np.ndarray  # of each list: of its residuals in one direction; they are quantised in this unit, so dense lists finely
    spread: np.ndarray  # of each list: what its residuals are likely to reach in one direction

    def bounds(self, q: np.ndarray, lists: slice | np.ndarray = slice(None)) -> np.ndarray:
        """queries x lists: the larger, the likelier the list holds near rows."""
        return q @ self.centroids[lists].T + np.sqrt((q * q).sum(axis=1))[:, None] * self.spread[lists]

    def probes(self, sample: np.ndarray, k: int, recall: float) -> int:
        """Lists to probe so that this share of the k nearest in the sample is in them, for queries of the sample."""
        q = sample[:PROBED]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centroids)
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        at = np.repeat(np.arange(len(q)), k)
        return self.measured(q, at, nearest(sample, self.centroids)[best.ravel()], score[at, best.ravel()], recall)[0]

    def measured(self, q: np.ndarray, at: np.ndarray, lists: np.ndarray, scores: np.ndarray, recall: float) -> tuple[int, float]:
        """Lists to probe, and the reach: both so that this share of the nearest rows (of which query, in which list, and
        how near) is in them; of what the first lists miss, the second step misses a third at most."""
        place = np.empty((len(q), len(self.centroids)), np.int64)
        np.put_along_axis(place, np.argsort(-self.bounds(q), axis=1, kind="stable"), np.arange(place.shape[1])[None, :], axis=1)
        found = np.cumsum(np.bincount(place[at, lists], minlength=place.shape[1]))
        least = np.full(len(q), np.inf)
        np.minimum.at(least, at, scores)
        room = np.sqrt((q * q).sum(axis=1))[at] * self.spread[lists]
        reach = (least[at] - (q[at] * self.centroids[lists]).sum(axis=1)) / room
        return int(np.searchsorted(found, recall * len(at))) + 1, float(np.quantile(reach, 1 - (1 - recall) / 3, method="higher"))

    def further(self, q: np.ndarray, lists: slice | np.ndarray, least: np.ndarray, floor: np.ndarray, reach: float) -> np.ndarray:
        """queries x lists: those whose bound is at least `least`; where a floor is given, instead those below that may
        hold rows with scores over it."""
        near = self.bounds(q, lists) >= least[:, None]
        again = q @ self.centroids[lists].T + reach * np.sqrt((q * q).sum(axis=1))[:, None] * self.spread[lists] >= floor[:, None]
        return np.where(np.isnan(floor)[:, None], near, ~near & again)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centroids)
        r = (x - self.centroids[lists]) / self.scale[lists, None]
        return lists, np.stack([nearest(r[:, a:b], w) for w, a, b in zip(self.words, self.cuts, self.cuts[1:])], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x codewords: products of the queries' parts with the codewords, in units of a list."""
        out = np.zeros((len(q), len(self.words), WORDS), np.float32)
        for p, (w, a, b) in enumerate(zip(self.words, self.cuts, self.cuts[1:])):
            out[:, p, : len(w)] = q[:, a:b] @ w.T
        return out


def fit(sample: np.ndarray, n_rows: int) -> Index:
    d = sample.shape[1]
    centroids = kmeans(sample, int(min(SAMPLE // 40, max(1, 2 * n_rows**0.5))))
    near = nearest(sample, centroids)
    r, size = sample - centroids[near], np.bincount(near, minlength=len(centroids))
    of_all = (r * r).mean()  # as eight rows of every list, so that small ones aren't taken for dense
    variance = (np.bincount(near, (r * r).mean(axis=1), len(centroids)) + 8 * of_all) / (size + 8)
    scale = np.sqrt(variance) + 1e-12
    spread = np.sqrt(2 * np.log(np.maximum(size, 2))) * scale
    r /= scale[near, None]
    cuts = [round(d * k / min(PARTS, d)) for k in range(min(PARTS, d) + 1)]
    return Index(centroids, [kmeans(r[:, a:b], WORDS) for a, b in zip(cuts, cuts[1:])], cuts, scale, spread)


def _lists(d: int, index):
    """list, i, v, _query of every row."""

    def run(batches):
        for b in batches:
            x = matrix(values(b, "v"), d)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(nearest(x, index.value.centroids)), *(values(b, c) for c in ("i", "v", "_query"))], names=["list", "i", "v", "_query"])

    return run


def _buckets(sizes: dict[int, int], n_lists: int, size: int) -> tuple[list[int], list[int]]:
    """First bucket of each list, and how many it is split into: small lists share one of about `size` rows."""
    first, parts, bucket, room = [], [], 0, size
    for n in (sizes.get(k, 0) for k in range(n_lists)):
        if n > room and room < size:
            bucket, room = bucket + 1, size
        first.append(bucket)
        parts.append(max(1, -(-n // size)))
        room -= n
        if n > size:
            bucket, room = bucket + parts[-1], size
    return first, parts


def _cut(batches, d: int, size: int):
    """(block, lists, ids, vectors) of rows that come by bucket, in the order of their lists. A bucket that is
    larger than planned, as parts are dealt by hash, is cut."""
    held, n, of, block = [], 0, None, TaskContext.get().partitionId() << 32
    for b in batches:
        buckets, lists, ids, x, at = *(values(b, c).to_numpy() for c in ("bucket", "list", "i")), matrix(values(b, "v"), d), 0
        while at < len(lists):
            if held and (buckets[at] != of or n >= 2 * size):
                yield block, *(np.concatenate(c) for c in zip(*held))
                held, n, block = [], 0, block + 1
            of = buckets[at]
            end = min(int(np.searchsorted(buckets, of, side="right")), at + 2 * size - n)
            held.append((lists[at:end], ids[at:end], x[at:end]))
            n, at = n + end - at, end
    if held:
        yield block, *(np.concatenate(c) for c in zip(*held))


def _row_blocks(d: int, index, size: int):
    def run(batches):
        for block, lists, ids, x in _cut(batches, d, size):
            codes = index.value.code(x)[1]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.unique(lists)]), *(pa.array([z.tobytes()], pa.binary()) for z in (lists, ids, x, codes))], names=["block", "has", "lists", "ids", "x", "codes"])

    return run


def _query_blocks(d: int, index, size: int, probes: int, reach: float):
    """With the least bound of the lists that each query probes first, its floor, and the lists that any of them probes."""

    def run(batches):
        for block, _, ids, x in _cut(batches, d + 1, size):
            x, floor = np.ascontiguousarray(x[:, :d]), np.ascontiguousarray(x[:, d])
            bounds = index.value.bounds(x)
            least = np.partition(bounds, bounds.shape[1] - probes, axis=1)[:, bounds.shape[1] - probes]
            least -= 1e-9 * (1 + np.abs(least))  # products of other shapes may differ in the last places
            asks = np.flatnonzero(index.value.further(x, slice(None), least, floor, reach).any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([asks]), *(pa.array([z.tobytes()], pa.binary()) for z in (ids, x, least, floor))], names=["qblock", "asks", "qids", "qx", "least", "floor"])

    return run


def _truth(d: int, index, ids: np.ndarray, q: np.ndarray, k: int):
    """q (a place), i, list, score of the k nearest rows of a batch for each of the given queries."""

    def run(batches):
        for b in batches:
            x, own = matrix(values(b, "v"), d), values(b, "i").to_numpy()
            if not len(x):
                continue
            score = q @ x.T
            score[ids[:, None] == own] = -np.inf
            most = min(k, len(x))
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            at, best = np.repeat(np.arange(len(q)), most), best.ravel()
            keep = score[at, best] > -np.inf
            at, best = at[keep], best[keep]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[best]), pa.array(values(b, "list").to_numpy()[best]), pa.array(score[at, best])], names=["q", "i", "list", "score"])

    return run


def _search(d: int, index, k: int, rerank: int, reach: float):
    names = ["q", "i", "score"]

    def run(batches):
        for part in slices(batches, "x", 1 << 20):
            for row in part.to_pylist():
                lists, ids, qids = (np.frombuffer(row[c], "<i8") for c in ("lists", "ids", "qids"))
                x, q = (np.frombuffer(row[c], "<f8").reshape(-1, d) for c in ("x", "qx"))
                columns = np.ascontiguousarray(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1).T)
                own, starts = np.unique(lists, return_index=True)
                ends, out, scale = [*starts[1:].tolist(), len(ids)], [], index.value.scale[lists]
                within = np.repeat(np.arange(len(own)), np.diff([*starts, len(ids)]))
                for m in range(0, len(q), 256):
                    probed = index.value.further(q[m : m + 256], own, *(np.frombuffer(row[c], "<f8")[m : m + 256] for c in ("least", "floor")), reach)
                    products = q[m : m + 256] @ index.value.centroids[own].T
                    for n, (t, which, product) in enumerate(zip(index.value.tables(q[m : m + 256]), probed, products), m):
                        if not which.any():
                            continue
                        runs = [np.arange(starts[j], ends[j]) for j in np.flatnonzero(which)]
                        at = np.concatenate(runs)
                        at = at[ids[at] != qids[n]]
                        score = t[0][columns[0][at]]
                        for p in range(1, len(columns)):
                            score += t[p][columns[p][at]]
                        score = product[within[at]] + scale[at] * score
                        if len(at) > rerank:
                            at = at[score >= np.partition(score, len(at) - rerank)[len(at) - rerank]]  # with all ties
                        exact = (x[at] * q[n]).sum(axis=1)
                        best = np.lexsort((ids[at], -exact))[:k]
                        out.append((np.full(len(best), qids[n]), ids[at][best], exact[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=names)

    return run


def search(rows: DataFrame, queries: Column, k: int = 20, recall: float = 0.97, rerank: int = 200, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k nearest rows found for each row that `queries` holds for.

    Nearness is the inner product, in double precision on the original vectors; ties go to the smaller id; a
    query is no candidate of itself. recall: share of the k nearest of all rows that are to be in the lists that a query
    probes first, measured on some queries; a query that finds fewer than k rows there is searched in all lists, others in
    those that may hold nearer rows. rerank: scored again
    in each pair of blocks. Rows that take no part (see usable) are neither queries nor candidates. Rows that
    repeat an id and vector are one. A null id is smaller than any other and comes back null.
    Other columns are not looked at. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    found, d = usable(rows.withColumn("_query", F.coalesce(queries, F.lit(False))), id_col, vec_col, "_query")
    kind = rows.schema[id_col].dataType
    if not d:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, `{id_col}` {kind.simpleString()}, score double")
    found = scratch.save(found.distinct(), "found")
    n = found.count()
    share = min(1.0, 1.5 * SAMPLE / n)
    near = found.where(F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("i", F.lit("sample")), "i").limit(SAMPLE).select("v")
    sample = matrix(near.toArrow().column("v").combine_chunks(), d)  # the bounded sample
    if not len(sample):
        sample = np.zeros((1, d))
    own = fit(sample, n)
    index = spark.sparkContext.broadcast(own)  # at most SAMPLE / 40 centroids and PARTS x WORDS codewords
    listed = scratch.save(found.select("i", "v", "_query").mapInArrow(_lists(d, index), "list long, i long, v array<double>, _query boolean"), "listed")

    def blocks(df: DataFrame, size: int, run, schema: str, name: str) -> DataFrame:
        sizes = {int(x.list): int(x.n) for x in df.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
        first, parts = (F.element_at(F.lit(z), F.col("list").cast("int") + 1) for z in _buckets(sizes, len(own.centroids), size))
        dealt = df.select((first + F.pmod(F.xxhash64("i", "v"), parts)).cast("long").alias("bucket"), "list", "i", "v")
        return scratch.save(dealt.repartition("bucket").sortWithinPartitions("bucket", "list", "i").mapInArrow(run(d, index, size), schema), name)

    stored = blocks(listed, max(1, BLOCK_BYTES // (8 * d)), _row_blocks, "block long, has array<long>, lists binary, ids binary, x binary, codes binary", "rows")

    some = listed.where("_query").orderBy(F.xxhash64("i", F.lit("probed")), "i").limit(PROBED).select("i", "v").toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, `{id_col}` {kind.simpleString()}, score double")
    q, qids = matrix(some.column("v").combine_chunks(), d), some.column("i").to_numpy()
    nearest_first = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    true = listed.select("i", "list", "v").mapInArrow(_truth(d, index, qids, q, k), "q long, i long, list long, score double")
    true = true.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).toArrow()  # k rows for each of the bounded queries
    probes, reach = own.measured(q, *(true.column(c).to_numpy() for c in ("q", "list", "score")), recall) if true.num_rows else (1, 0.0)
    probes = min(probes, len(own.centroids))

    def find(asking: DataFrame, name: str) -> DataFrame:
        asked = blocks(asking, max(1, QUERY_BYTES // (8 * d)), partial(_query_blocks, probes=probes, reach=reach), "qblock long, asks array<long>, qids binary, qx binary, least binary, floor binary", "queries")
        has, asks = stored.select("block", F.explode("has").alias("list")), asked.select("qblock", F.explode("asks").alias("list"))
        pairs = scratch.save(has.join(asks, "list").select("block", "qblock").distinct(), "pairs")
        spread = pairs.join(asked.drop("asks"), "qblock").join(stored.drop("has"), "block")
        return scratch.save(spread.drop("block", "qblock").mapInArrow(_search(d, index, k, rerank, reach), "q long, i long, score double"), name)

    asking = listed.where("_query")
    got = find(asking.withColumn("v", F.concat("v", F.array(F.lit(float("nan"))))), "got")
    if probes < len(own.centroids):
        last = got.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") == k).select(F.col("q").alias("i"), "score")
        floor = F.coalesce("score", F.lit(float("-inf")))  # fewer than k were found
        got = got.union(find(asking.join(last, "i", "left").withColumn("v", F.concat("v", F.array(floor))).drop("score"), "more"))
    best = got.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return best.select(null_again(F.col("q")).cast(kind).alias("query_id"), F.col("rank").cast("int").alias("rank"), null_again(F.col("i")).cast(kind).alias(id_col), "score")
