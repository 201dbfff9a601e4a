"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels in a
window of scores, by product quantisation with exact bounds.

Vectors are whole numbers, floor(scale * x), so scores are exact. A row is stored as the codewords of its parts and the
length of what they leave over. An anchor's table of products with all codewords gives its score with any row up to its
own length times that residual's: a row whose score plus that cannot reach what is wanted, or whose score minus that is
beyond it, is no candidate. Candidates are scored again in whole numbers, so nothing depends on the codebooks but time.

Rows are stored in blocks of one size, in the order of their labels, and anchors likewise; a pair of blocks meets once
for positives if both hold a label, and once for negatives. A task takes a block of anchors through several blocks of
rows, one after another, and hands on the best of each anchor only, so results don't grow with the number of blocks.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ann import kmeans, nearest
from .common import Scratch, broadcast_if_small, null_again, row_id, slices, values
from .vectors import common_length, matrix

#: Rows that the codebooks are fitted on, codewords of a part, and coordinates of a part.
SAMPLE, WORDS, WIDTH = 20_000, 256, 2
#: Rows of a block, anchors of a block, and blocks of rows that a task takes a block of anchors through.
ROWS, ANCHORS, GROUP = 16_384, 4096, 4
#: Larger numbers are not taken, so that scores fit 64 bits.
LARGEST = 1 << 23


class Codebook:
    def __init__(self, sample: np.ndarray):
        d = sample.shape[1]
        self.cuts = [*range(0, d, WIDTH), d]
        self.words = [kmeans(sample[:, a:b], WORDS) for a, b in zip(self.cuts, self.cuts[1:])]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the rows' parts, and a bound of the length of what is left over, with room for rounding in tables."""
        codes = np.stack([nearest(x[:, a:b], w) for w, a, b in zip(self.words, self.cuts, self.cuts[1:])], axis=1).astype(np.uint8)
        near = np.concatenate([w[c] for w, c in zip(self.words, codes.T)], axis=1)
        return codes, np.sqrt(((x - near) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-5 * np.sqrt((near * near).sum(axis=1)) + 1e-9

    def tables(self, q: np.ndarray) -> np.ndarray:
        """anchors x parts x codewords: products of the anchors' parts with the codewords."""
        out = np.zeros((len(q), len(self.words), WORDS), np.float32)
        for p, (w, a, b) in enumerate(zip(self.words, self.cuts, self.cuts[1:])):
            out[:, p, : len(w)] = q[:, a:b] @ w.T
        return out


def _blocks(d: int, size: int, kind: str, book=None):
    """Rows that come in order, in blocks: block, has (the labels), and keys, ids, labels and vectors as bytes, with codes and
    bounds where there is a codebook."""
    names = ["block", "has", "keys", "ids", "labels", "x"] + (["codes", "rest"] if book else [])

    def run(batches):
        held, n, block = [], 0, TaskContext.get().partitionId() << 32

        def out():
            keys, ids, labels, x = (np.concatenate(c) for c in zip(*held))
            more = book.value.code(x) if book else []
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.unique(labels)]), *(pa.array([z.tobytes()], pa.binary()) for z in (keys, ids, labels, x.astype(kind), *more))], names=names)

        for b in batches:
            columns, at = [*(values(b, c).to_numpy() for c in ("key", "i", "y")), matrix(values(b, "v"), d)], 0
            while at < b.num_rows:
                end = min(b.num_rows, at + size - n)
                held.append([c[at:end] for c in columns])
                n, at = n + end - at, end
                if n == size:
                    yield out()
                    held, n, block = [], 0, block + 1
        if held:
            yield out()

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


class _Rows:
    """A block of rows as arrays."""

    def __init__(self, part: pa.RecordBatch, k: int, d: int, kind: str):
        ids, labels, x, codes, rest = (values(part, c)[k].as_buffer() for c in ("ids", "labels", "x", "codes", "rest"))
        self.ids, self.labels, self.x = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(x, kind).reshape(-1, d)
        self.codes = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(len(self.ids), -1).T)
        self.rest = np.frombuffer(rest, "<f8")

    def scores(self, table: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        total = table[0][self.codes[0][at]]
        for p in range(1, len(table)):
            total = total + table[p][self.codes[p][at]]
        return total.astype(np.float64)

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.x[at].astype(np.int64) @ q


def _merge(best: tuple, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([best[0], score]), np.concatenate([best[1], ids])
    at = _best(score, ids, k)
    return score[at], ids[at]


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


def _nearest_same(rows: _Rows, table: np.ndarray, q: np.ndarray, own: int, label: int, best: tuple, k: int) -> tuple:
    """The k best rows of the label, of those known and those of the block."""
    at = np.flatnonzero((rows.labels == label) & (rows.ids != own))
    if not len(at):
        return best
    score, slack = rows.scores(table, at), np.sqrt(float((q.astype(np.float64) ** 2).sum())) * rows.rest[at]
    least = float(best[0][-1]) if len(best[0]) == k else -np.inf
    if len(at) >= k:
        least = max(least, np.partition(score - slack, len(at) - k)[len(at) - k])
    at = at[score + slack >= least]
    return _merge(best, rows.exact(q, at), rows.ids[at], k)


def _nearest_other(rows: _Rows, table: np.ndarray, q: np.ndarray, own: int, label: int, windows: list[tuple[int, int]], best: list[tuple], k: int) -> list[tuple]:
    """For each window of scores the k best rows of other labels within it, of those known and those of the block."""
    at = np.flatnonzero((rows.labels != label) & (rows.ids != own))
    if not len(at):
        return best
    score, slack = rows.scores(table, at), np.sqrt(float((q.astype(np.float64) ** 2).sum())) * rows.rest[at]
    low, high = score - slack, score + slack
    wanted = np.zeros(len(at), bool)
    for (lo, hi), known in zip(windows, best):
        least = max(lo, int(known[0][-1])) if len(known[0]) == k else lo
        sure = low[(low >= lo) & (high <= hi)]  # within the window for certain
        if len(sure) >= k:
            least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
        wanted |= (high >= least) & (low <= hi)
    at = at[wanted]
    score, ids, out = rows.exact(q, at), rows.ids[at], []
    for (lo, hi), known in zip(windows, best):
        inside = (score >= lo) & (score <= hi)
        out.append(_merge(known, score[inside], ids[inside], k))
    return out


class _Anchors:
    """A block of anchors as arrays, and what has been found for them."""

    def __init__(self, part: pa.RecordBatch, k: int, d: int, kind: str):
        keys, ids, labels, x = (values(part, c)[k].as_buffer() for c in ("akeys", "aids", "alabels", "ax"))
        self.keys, self.ids, self.labels = (np.frombuffer(z, "<i8") for z in (keys, ids, labels))
        self.x, self.best = np.frombuffer(x, kind).reshape(-1, d).astype(np.int64), {}
        at = {int(i): n for n, i in enumerate(self.keys)}
        self.windows: dict[int, list] = {}
        if "windows" in part.schema.names:
            for w in values(part, "windows")[k].as_py():
                self.windows.setdefault(at[w["anchor"]], []).append((w["positive"], w["positive_score"], w["lo"], w["hi"]))

    def tables(self, book: Codebook, some: np.ndarray):
        """(place, table) of some of them."""
        for m in range(0, len(some), 64):
            yield from zip(some[m : m + 64].tolist(), book.tables(self.x[some[m : m + 64]].astype(np.float64)))


def _through(batches, d: int, kind: str, step, out):
    """Takes each block of anchors through the blocks of rows that come with it; out gives its results as tuples."""
    now, held = None, None
    for part in slices(batches, "x", 1 << 20):
        for k, block in enumerate(values(part, "ablock").to_pylist()):
            if block != now:
                yield from out(held) if held else []
                now, held = block, _Anchors(part, k, d, kind)
            step(held, _Rows(part, k, d, kind))
    yield from out(held) if held else []


def _in_batches(found, names: list[str], most: int = 20_000):
    rows = iter(found)
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], names=names)


def _positives(d: int, kind: str, book, k: int):
    def step(a: _Anchors, rows: _Rows) -> None:
        for n, table in a.tables(book.value, np.flatnonzero(np.isin(a.labels, rows.labels))):
            a.best[n] = _nearest_same(rows, table, a.x[n], a.ids[n], a.labels[n], a.best.get(n, _NONE), k)

    def out(a: _Anchors):
        return ((a.keys[n], i, x) for n, found in a.best.items() for x, i in zip(*found))

    return lambda batches: _in_batches(_through(batches, d, kind, step, out), ["anchor", "positive", "score"])


def _negatives(d: int, kind: str, book, k: int):
    def step(a: _Anchors, rows: _Rows) -> None:
        for n, table in a.tables(book.value, np.array(sorted(a.windows), np.int64)):
            windows = [(lo, hi) for _, _, lo, hi in a.windows[n]]
            a.best[n] = _nearest_other(rows, table, a.x[n], a.ids[n], a.labels[n], windows, a.best.get(n, [_NONE] * len(windows)), k)

    def out(a: _Anchors):
        return ((a.keys[n], p, s, i, x) for n, held in a.best.items() for (p, s, _, _), found in zip(a.windows[n], held) for x, i in zip(*found))

    return lambda batches: _in_batches(_through(batches, d, kind, step, out), ["anchor", "positive", "positive_score", "negative", "score"])


def _keys_of_blocks(batches):
    for b in batches:
        for block, keys, ids in zip(values(b, "ablock").to_pylist(), values(b, "akeys"), values(b, "aids")):
            keys, ids = (np.frombuffer(z.as_buffer(), "<i8") for z in (keys, ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(keys), pa.array(ids)], names=["ablock", "anchor", "id"])


def mine(rows: DataFrame, anchors: Column, scale: float = 256, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that `anchors` holds for. The positives of one are its first other rows of the same label by
    score, ties to the smaller id; for each, the first `negatives` rows of other labels come out whose score is between
    least and most per cent of the positive's, both included. All scores are inner products of floor(scale * x).

    Rows take no part if their label or vector is null, if a component is null, not finite or larger than LARGEST after
    scaling, or if the vector is not of the most common length (the least of equals). Zero vectors do take part. Rows
    that repeat an id, label and vector are one; a row is never compared with rows of its own id, and of rows that share
    an id, each has its own results. A null id is smaller than any other and comes back null. Other columns are not
    looked at. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    scratch, kind = Scratch(spark, "negatives"), rows.schema[id_col].dataType
    schema = T.StructType([T.StructField("anchor_id", kind), T.StructField("positive_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("negative_id", kind), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])
    given = rows.select(row_id(id_col).alias("i"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= LARGEST))
    taken = given.where(F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & fits, F.lit(False)))
    found = taken.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double"))).distinct()
    found, d = common_length(scratch.save(found.withColumn("key", F.monotonically_increasing_id()), "found"))
    if not d:
        return spark.createDataFrame([], schema)
    n, largest = found.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()
    width = "<i2" if largest < 1 << 15 else "<i4"
    labels = scratch.save(found.select("label").distinct().withColumn("y", F.monotonically_increasing_id()), "labels")
    found = found.join(broadcast_if_small(labels), "label")
    order, share = F.xxhash64("i", "v"), min(1.0, 1.5 * SAMPLE / n)
    sample = found.where(F.pmod(order, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(order).limit(SAMPLE).select("v")
    sample = matrix(sample.toArrow().column("v").combine_chunks(), d)  # the bounded sample
    book = spark.sparkContext.broadcast(Codebook(sample if len(sample) else np.zeros((1, d))))

    def blocks(df: DataFrame, size: int, more: str, name: str, *book) -> DataFrame:
        dealt = df.select("key", "i", "y", "v").repartitionByRange("y", "i", "key").sortWithinPartitions("y", "i", "key")
        return scratch.save(dealt.mapInArrow(_blocks(d, size, width, *book), "block long, has array<long>, keys binary, ids binary, labels binary, x binary" + more), name)

    stored = blocks(found, ROWS, ", codes binary, rest binary", "rows", book)
    asked = blocks(found.where("anchor"), ANCHORS, "", "anchors").select(*[F.col(c).alias(f"a{c}") for c in ("block", "has", "keys", "ids", "labels", "x")])
    place = F.row_number().over(Window.orderBy("block")) - 1  # a row a block
    numbers = scratch.save(stored.select("block", F.floor(place / GROUP).cast("long").alias("of")), "numbers")

    def met(pairs: DataFrame, asked: DataFrame, run, out: str, name: str) -> DataFrame:
        """pairs(ablock, block, of): each task takes a block of anchors through a group of blocks."""
        full = pairs.join(asked, "ablock").join(stored.select("block", "ids", "labels", "x", "codes", "rest"), "block")
        dealt = full.repartition("ablock", "of").sortWithinPartitions("ablock", "of", "block").drop("of", "block")
        return scratch.save(dealt.mapInArrow(run, out), name)

    has, asks = stored.select("block", F.explode("has").alias("y")), asked.select("ablock", F.explode("ahas").alias("y"))
    asked = asked.drop("ahas")
    got = met(has.join(asks, "y").select("ablock", "block").distinct().join(numbers, "block"), asked, _positives(d, width, book, positives), "anchor long, positive long, score long", "near")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive"))
    near = got.withColumn("r", first).where(F.col("r") <= positives)
    # the whole numbers n with least * score <= 100 * n <= most * score
    lo, hi = F.expr(f"-((-{least} * score - pmod(-{least} * score, 100)) div 100)"), F.expr(f"({most} * score - pmod({most} * score, 100)) div 100")
    near = near.select("anchor", "positive", F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    owners = scratch.save(asked.select("ablock", "akeys", "aids").mapInArrow(_keys_of_blocks, "ablock long, anchor long, id long"), "owners")
    windows = owners.join(near, "anchor").groupBy("ablock").agg(F.collect_list(F.struct("anchor", "positive", "positive_score", "lo", "hi")).alias("windows"))  # positives of ANCHORS
    asked = scratch.save(asked.join(windows, "ablock"), "asked")
    pairs = asked.select("ablock").crossJoin(numbers)  # the stated anchors against all rows, in blocks
    got = met(pairs, asked, _negatives(d, width, book, negatives), "anchor long, positive long, positive_score long, negative long, score long", "far")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "negative"))
    best = got.withColumn("rank", rank).where(F.col("rank") <= negatives).join(owners.select("anchor", "id"), "anchor")
    back = lambda c: null_again(F.col(c)).cast(kind)
    return best.select(back("id").alias("anchor_id"), back("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), back("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
