"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of unit length are turned to the axes of their second moments, largest first (over all rows). Equal
vectors of a label become one, with a count. Each label is put in order of the first coordinate and cut into
tiles of bounded size; two tiles are compared unless their first coordinates are too far apart for any pair.
Within a pair of tiles, the products of the leading coordinates are summed first; what the others can add is
bounded by the product of the suffix norms, and a pair is given up as soon as sum and bound stay below the
threshold. What survives is decided by the cosine of the original vectors in double precision.

A comparison returns, for each vector, how many it links with and one link to its group's first, never all
pairs. Tiles are joined by their own ids, so a label that holds most rows is spread like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, null_again, row_id, slices, values
from .vectors import matrix, norms, usable

TILE = 512
#: Coordinates that are added between two tests of the bound.
STEP = 16


def axes(rows: DataFrame, d: int) -> np.ndarray:
    """Principal axes (columns) of the unit vectors v, from sums over all rows."""

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = matrix(values(b, "v"), d)
            x /= norms(x)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["r", "c"])

    sums = F.array(*[F.sum(F.col("c")[k]) for k in range(d)])
    got = rows.select("v").mapInArrow(run, "r long, c array<double>").groupBy("r").agg(sums.alias("c")).collect()  # d x d numbers
    m = np.zeros((d, d))
    for r in got:
        m[r.r] = r.c
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


def linked(xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two tiles (x: original, y: turned unit vectors) whose cosine reaches the threshold."""
    d, slack = ya.shape[1], 1e-5
    ta, tb = (np.sqrt(np.maximum(0, np.cumsum((y.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1])) for y in (ya, yb))
    total, at = ya[:, :STEP] @ yb[:, :STEP].T, min(STEP, d)
    while at < d:
        live = total + np.outer(ta[:, at], tb[:, at]) >= threshold - slack
        left = int(live.sum())
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if left * 20 < live.size:  # few: only these go on
            i, j = np.nonzero(live)
            part = total[i, j]
            while at < d and len(i):
                part = part + np.einsum("ij,ij->i", ya[i, at : at + STEP], yb[j, at : at + STEP])
                at = min(at + STEP, d)
                go = part + (ta[i, at] * tb[j, at] if at < d else 0) >= threshold - slack
                i, j, part = i[go], j[go], part[go]
            break
        total += ya[:, at : at + STEP] @ yb[:, at : at + STEP].T
        at = min(at + STEP, d)
    else:
        i, j = np.nonzero(total >= threshold - slack)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 50_000):
        a, b = xa[i[k : k + 50_000]].astype(np.float64), xb[j[k : k + 50_000]].astype(np.float64)
        keep[k : k + 50_000] = (a * b).sum(axis=1) / (norms(a) * norms(b)) >= threshold
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _tiles(d: int, turn: np.ndarray):
    names = ["tile", "label", "lo", "hi", "ids", "counts", "x", "y"]

    def run(batches):
        held, label, tile = [], None, TaskContext.get().partitionId() << 32

        def out():
            nonlocal tile
            tile += 1
            ids, counts, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            y = ((x / norms(x)[:, None]) @ turn).astype("<f4")
            return pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([label]), pa.array([float(y[:, 0].min())]), pa.array([float(y[:, 0].max())]), *[pa.array([z.tobytes()], pa.binary()) for z in (ids, counts, x.astype("<f8"), y)]], names=names)

        for b in batches:
            labels, ids, counts, x = values(b, "label").to_pylist(), values(b, "key").to_numpy(), values(b, "k").to_numpy(), matrix(values(b, "v"), d)
            at = 0
            while at < len(labels):
                room = TILE - sum(len(h[0]) for h in held)
                if held and (labels[at] != label or not room):
                    yield out()
                    held, room = [], TILE
                label, end = labels[at], at
                while end < len(labels) and end - at < room and labels[end] == label:
                    end += 1
                held.append((ids[at:end], counts[at:end], x[at:end]))
                at = end
        if held:
            yield out()

    return run


def _compare(d: int, threshold: float):
    names = ["key", "links", "root"]

    def run(batches):
        for part in slices(batches, "xa", 2 << 20):
            for row in part.to_pylist():
                (ia, ib), (ka, kb) = ([np.frombuffer(row[c + s], "<i8") for s in "ab"] for c in ("ids", "counts"))
                (xa, xb), (ya, yb) = ([np.frombuffer(row[c + s], t).reshape(-1, d) for s in "ab"] for c, t in (("x", "<f8"), ("y", "<f4")))
                i, j = linked(xa, ya, xb, yb, threshold)
                if row["a"] == row["b"]:
                    i, j = i[i < j], j[i < j]
                    n, ids, jj = len(ia), ia, j
                else:
                    n, ids, jj = len(ia) + len(ib), np.concatenate([ia, ib]), j + len(ia)
                links = np.bincount(i, kb[j], n) + np.bincount(jj, ka[i], n)
                root, seen = _roots(n, i, jj), np.flatnonzero(links)
                if len(seen):
                    least = np.full(n, np.iinfo(np.int64).max)
                    np.minimum.at(least, root[seen], ids[seen])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(links[seen].astype(np.int64)), pa.array(least[root[seen]])], names=names)

    return run


def dedup(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The id, n_links, component_id and kept of every row.

    Vectors link if their labels are equal and not null and their cosine is at least the threshold; those that
    take no part (see usable) have no links. component_id is the smallest id that links reach. Rows that repeat
    an id, label and vector are one vector and come out each; rows that share an id otherwise count their own
    vector's links, and their components are one. A null id is smaller than any other and comes back null; its row
    is kept if it is its component's first. Other columns are not looked at. An empty table gives an empty table.
    """
    scratch = Scratch(rows.sparkSession, "embdedup")
    given = rows.select(row_id(id_col).alias("i"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))
    every = scratch.save(given.withColumn("row", F.monotonically_increasing_id()), "every")
    found, d = usable(every.where("label is not null"), "i", "v", "label", "row")
    if not d:
        return every.select(null_again(F.col("i")).alias(id_col), F.lit(0).cast("long").alias("n_links"), null_again(F.col("i")).alias("component_id"), F.lit(True).alias("kept"))
    classes = found.select("label", "v", "i").distinct().groupBy("label", "v").agg(F.min("i").alias("i"), F.count("*").alias("k"))
    classes = scratch.save(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    got = _compared(scratch, classes, d, threshold)
    of = scratch.save(found.join(classes.select("label", "v", "key"), ["label", "v"]).select("row", "i", "key"), "rows")
    several = of.groupBy("i").agg(F.min("key").alias("b"), F.max("key").alias("z")).where("b <> z").select("i", "b")
    same = of.join(several, "i").where("key <> b").select(F.col("key").alias("a"), "b")
    roots = scratch.save(components(scratch, got.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).union(same)), "roots")
    counts = got.groupBy("key").agg(F.sum("links").alias("links"))
    each = classes.select("key", "k", "i").join(counts, "key", "left").join(roots.withColumnRenamed("id", "key"), "key", "left")
    each = scratch.save(each.select("key", "i", (F.col("k") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "key").alias("root")), "each")
    least = each.groupBy("root").agg(F.min("i").alias("least"))
    of = of.select("row", "key").join(each.select("key", "links", "root"), "key").join(least, "root").select("row", "links", "least")
    out = every.select("row", "i").join(of, "row", "left").select("i", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("least", "i").alias("c"))
    return out.select(null_again(F.col("i")).alias(id_col), F.col("n_links").cast("long").alias("n_links"), null_again(F.col("c")).alias("component_id"), (F.col("i") == F.col("c")).alias("kept"))


def _compared(scratch: Scratch, classes: DataFrame, d: int, threshold: float) -> DataFrame:
    """key, links, root: what each pair of tiles has found for a class."""
    turn = axes(classes, d)
    first = [float(x) for x in turn[:, 0]]
    lead = F.aggregate(F.arrays_zip(F.col("v"), F.array(*map(F.lit, first)).alias("w")), F.lit(0.0), lambda s, z: s + z["v"] * z["w"]) / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, z: s + z * z))
    ordered = classes.withColumn("lead", lead).repartitionByRange("label", "lead", "key").sortWithinPartitions("label", "lead", "key")
    tiles = scratch.save(ordered.select("label", "key", "k", "v").mapInArrow(_tiles(d, turn), "tile long, label string, lo double, hi double, ids binary, counts binary, x binary, y binary"), "tiles")
    reach = (2 - 2 * threshold) ** 0.5 + 1e-5
    cell = lambda x: F.floor(x / F.lit(reach))
    # of two tiles that may hold a pair, the second begins within the first or its reach
    a = tiles.select(F.col("tile").alias("a"), "label", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") + reach))).alias("cell"))
    b = tiles.select(F.col("tile").alias("b"), "label", F.col("lo").alias("begin"), cell(F.col("lo")).alias("cell"))
    after = (F.col("begin") > F.col("lo")) | ((F.col("begin") == F.col("lo")) & (F.col("b") >= F.col("a")))
    pairs = scratch.save(a.join(b, ["label", "cell"]).where(after & (F.col("begin") <= F.col("hi") + reach)).select("a", "b"), "pairs")
    side = lambda s: tiles.select(F.col("tile").alias(s), *[F.col(c).alias(c + s) for c in ("ids", "counts", "x", "y")])
    spread = pairs.join(side("a"), "a").join(side("b"), "b")
    return scratch.save(spread.mapInArrow(_compare(d, threshold), "key long, links long, root long"), "links")
