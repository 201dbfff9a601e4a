"""A Merkle manifest of a dataset, by higher-order SQL functions on blocks.

A row's leaf is the digest of its fields. The leaves of a group, in the order of a key, are joined run by run until
one digest, the subroot, is left; the subroots in the order of their groups give the root in the same way. Leaves are
numbered by ranges and gathered in ordered arrays of BLOCK, the fan's power; sequence, transform, slice and aggregate
collapse all levels of an array within one expression, and the blocks' roots are the leaves of the next round, of
which there are as many as a group's size has digits to the base BLOCK. On the way back each block hands the path
above it to its leaves. A group that holds most rows is many blocks like any other; no task sees more than a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..order import numbered
from .common import Scratch, broadcast_if_small

#: Leaves of an array, at most.
BLOCK = 1024
#: Paths of a kilobyte or two that are sent to all executors.
FEW = 20_000


def digest(value: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a text's UTF-8."""
    return F.sha2(value.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Of each field `-` if it is null, else its number of bytes, a colon and its value as text; concatenated."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def folded(first: Column, path: Column) -> Column:
    """The root that a leaf and its path (before, after: the digests beside it in its run, level by level) lead to."""
    return F.aggregate(path, first, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def siblings(path: Column) -> Column:
    """The digests of a path, one after another."""
    return F.aggregate(path, F.lit(""), lambda t, s: F.concat(t, s["before"], s["after"]))


def _steps(fan: int) -> int:
    """Levels of a full block: as many as the fan's largest power within BLOCK."""
    k = 1
    while fan ** (k + 1) <= BLOCK:
        k += 1
    return k


def _run(nodes: Column, i: Column, n: Column | int) -> Column:
    """n digests from the i-th on (from 0), concatenated."""
    return F.array_join(F.slice(nodes, (i + 1).cast("int"), n if isinstance(n, int) else n.cast("int")), "")


def _levels(leaves: Column, n: Column, fan: int) -> Column:
    """Arrays of the digests of all levels, the leaves first; n: how often they are collapsed."""
    up = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / fan).cast("int")), lambda i: digest(_run(x, i * fan, fan)))
    return F.aggregate(F.slice(F.sequence(F.lit(0), n), 2, n), F.array(leaves), lambda held, _: F.concat(held, F.array(up(F.element_at(held, -1)))))


def _beside(levels: Column, at: Column, n: Column, fan: int) -> Column:
    """(before, after) at each of the n levels for the leaf at a place in its block."""

    def one(k):
        nodes = F.element_at(levels, k)
        i = F.floor(at / F.pow(F.lit(float(fan)), k - 1)).cast("int")
        own = i % fan
        return F.struct(_run(nodes, i - own, own).alias("before"), _run(nodes, i + 1, F.lit(fan - 1) - own).alias("after"))

    return F.transform(F.slice(F.sequence(F.lit(0), n), 2, n), one)


class _Tree:
    """The rounds over nodes(g, pos, h, and others) of groups with n nodes each; n is a column of theirs."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, fan: int):
        self.scratch, self.fan, self.steps = scratch, fan, _steps(fan)
        self.full = fan**self.steps
        self.rounds: list[DataFrame] = []
        tops = []
        while True:
            more = [c for c in nodes.columns if c not in ("g", "pos", "h", "n")]
            item = F.struct("pos", "h", *more)
            block = F.floor(F.col("pos") / self.full).cast("long")
            rows = nodes.groupBy("g", block.alias("block"), "n").agg(F.sort_array(F.collect_list(item)).alias("items"))
            deep = sum(((F.col("n") > fan**k).cast("int") for k in range(self.steps)), F.lit(0))  # all levels unless the block is the last
            rows = rows.withColumn("deep", deep).withColumn("levels", _levels(F.col("items.h"), F.col("deep"), fan))
            rows = scratch.save(rows, "blocks")
            self.rounds.append(rows)
            top = F.element_at(F.element_at("levels", -1), 1)
            tops.append(rows.where(F.col("n") <= self.full).select("g", top.alias("h")))
            left = rows.where(F.col("n") > self.full).select("g", F.col("block").alias("pos"), top.alias("h"), F.ceil(F.col("n") / self.full).cast("long").alias("n"))
            if left.isEmpty():
                break
            nodes = left
        out = tops[0]
        for t in tops[1:]:
            out = out.union(t)
        self.tops = scratch.save(out, "tops")

    def paths(self, above: DataFrame) -> DataFrame:
        """g, pos, h, path and others of all nodes of the first round. above: g, path of the tops."""
        path = None
        for k in range(len(self.rounds) - 1, -1, -1):
            rows = self.rounds[k]
            last = rows.where(F.col("n") <= self.full).select("g", "block").join(above, "g").withColumnRenamed("path", "upper")
            upper = last if path is None else last.union(path.select("g", F.col("pos").alias("block"), F.col("path").alias("upper")))
            upper = broadcast_if_small(self.scratch.save(upper, "upper"), FEW)
            whole = lambda x: F.struct(x.alias("item"), F.concat(_beside(F.col("levels"), F.pmod(x["pos"], F.lit(self.full)), F.col("deep"), self.fan), F.col("upper")).alias("path"))
            each = rows.join(upper, ["g", "block"]).select("g", F.explode(F.transform("items", whole)).alias("x"))
            path = each.select("g", "x.item.*", "x.path")
        return path


@dataclass
class Manifest:
    root: str | None
    subroots: DataFrame  # g, subroot: g is the group as text after `=`, or nothing for null
    leaves: DataFrame  # g, pos, h (the leaf), path to the root, subroot, and the columns that were kept


def build(rows: DataFrame, fields: list[str], group: str, key: str, keep: dict[str, Column] | None = None, fan: int = 2) -> Manifest:
    """The manifest of rows: leaves of the fields in their order, by group in the order of key.

    keep: further columns for the leaves. Groups are ordered as text by bytes, null first; within a group null keys
    come first, and rows with equal keys are in the order of their leaves. Rows that repeat are a leaf each. Long
    texts are digested whole; empty and null fields differ. Other columns are not looked at. An empty table has no
    root and no leaves.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = rows.select(g.alias("g"), F.col(key).alias("key"), leaf(*[F.col(f) for f in fields]).alias("h"), *[c.alias(k) for k, c in (keep or {}).items()])
    leaves = numbered(own, ["key", "h"], "pos", ("g",), lambda df: scratch.save(df, "leaves")).drop("key")
    sizes = broadcast_if_small(scratch.save(leaves.groupBy("g").agg(F.count("*").alias("n")), "sizes"))
    tree = _Tree(scratch, leaves.join(sizes, "g"), fan)
    groups = numbered(tree.tops.withColumnRenamed("g", "name"), ["name"], "pos", (), lambda df: scratch.save(df, "groups"))
    n = groups.count()
    over = _Tree(scratch, groups.select(F.lit("").alias("g"), "pos", "h", "name", F.lit(n).cast("long").alias("n")), fan)
    root = over.tops.first()
    none = rows.sparkSession.range(1).select(F.lit("").alias("g"), F.slice(F.array(F.struct(F.lit("").alias("before"), F.lit("").alias("after"))), 1, 0).alias("path"))
    above = scratch.save(over.paths(none).select(F.col("name").alias("g"), F.col("h").alias("subroot"), "path"), "above")
    found = tree.paths(above.select("g", "path"))
    subroots = above.select("g", "subroot")
    return Manifest(root.h if root else None, subroots, found.join(broadcast_if_small(subroots), "g"))
