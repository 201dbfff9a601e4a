"""Graphs that the queries derive from the tables, each from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph

SUPPLIERS, REGIONS, NATIONS = 1_000_000, 500, 25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk(spark: SparkSession, sf_dir: str) -> Graph:
    """Users whose events follow one another in the whole event log. Events are put in order within each hour, so
    that no task sorts them all; the last of an hour is followed by the first of the next hour that has any."""
    events = _table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "user_id")
    after = F.lead("user_id").over(Window.partitionBy("hour").orderBy("ts", "event_id"))
    place = F.struct("ts", "event_id")
    hours = events.groupBy("hour").agg(F.min_by("user_id", place).alias("first"), F.max_by("user_id", place).alias("last"))
    across = hours.select("last", F.lead("first").over(Window.orderBy("hour")))  # a row an hour
    pairs = events.select("user_id", after.alias("next")).union(across)
    return Graph.of(pairs)


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers to nations, nations to regions, and a ring of the regions."""
    s = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIERS).alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), (F.col("n_regionkey") + REGIONS).cast("long"))
    r = _table(spark, sf_dir, "region").select((F.col("r_regionkey") + REGIONS).cast("long").alias("a"))
    ring = r.select("a", F.when(F.col("a") == REGIONS + 4, REGIONS).otherwise(F.col("a") + 1).cast("long"))
    return Graph.of(s.union(n).union(ring))


def mesh(spark: SparkSession, sf_dir: str) -> Graph:
    """geo with a ring of the nations: one large block, whose vertices have suppliers behind bridges."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    ring = nations.select("a", ((F.col("a") + 1) % NATIONS).cast("long"))
    g = geo(spark, sf_dir)
    return Graph.of(g.edges.union(ring), g.vertices)


GEO_SQL = """
g(a, b) as (
  select s_suppkey + 1000000, cast(s_nationkey as bigint) from supplier
  union all select cast(n_nationkey as bigint), cast(n_regionkey + 500 as bigint) from nation
  union all select cast(r_regionkey + 500 as bigint), cast(case when r_regionkey = 4 then 500 else r_regionkey + 501 end as bigint) from region),
"""
MESH_SQL = GEO_SQL.rstrip().removesuffix("),") + f"""
  union all select cast(n_nationkey as bigint), cast((n_nationkey + 1) % {NATIONS} as bigint) from nation),
"""
WALK_SQL = """
g(a, b) as (select user_id, lead(user_id) over (order by ts, event_id) from events),
"""
#: edges(u, v) and ids n(id), arcs e(s, t)
EDGES_SQL = """
edges(u, v) as (select distinct least(a, b), greatest(a, b) from g where a <> b),
"""
ARCS_SQL = """
e(s, t) as (select u, v from edges union all select v, u from edges),
n(id) as (select distinct s from e),
"""
