"""Places in an order, without a task that sees all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import broadcast_if_small, stored

_AT = "_at"


def numbered(df: DataFrame, keys: list[str], name: str, within: tuple[str, ...] = (), save=stored) -> DataFrame:
    """df with its place in the order of keys, from 0, and anew for each value of the columns in within.

    Rows are sorted in ranges, each in a task of its own, and stored; what comes before a range is summed from a row
    for each range and value. Rows with equal keys are in any order. save: how a table is stored.
    """
    order = [*within, *keys]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = save(rows.withColumn(_AT, F.monotonically_increasing_id()))  # the range, and the place in it
    part, at = F.shiftright(_AT, 33), F.col(_AT).bitwiseAND((1 << 33) - 1)
    counts = rows.select(*within, part.alias("_part"), at.alias("_i")).groupBy(*within, "_part").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*within).orderBy("_part")) - F.col("_n")  # a row a range
    starts = save(counts.select(*[F.col(f"`{c}`").alias(f"_w{k}") for k, c in enumerate(within)], "_part", (before - F.col("_first")).alias("_shift")))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_w{k}")) for k, c in enumerate(within)]
    met = rows.withColumn("_range", part).join(broadcast_if_small(starts), reduce(and_, same, F.col("_range") == F.col("_part")))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (at + F.col("_shift")).alias(name))
