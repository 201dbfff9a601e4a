"""Queries over the derived graphs, and SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..graph import Graph
from ..operators import betweenness, blocks, incremental, traverse
from ..operators.blocktree import BlockTree
from ..sources import text
from ..store import shared_dir, stored
from ..streaming.edges import replay
from .graphs import ARCS_SQL, EDGES_SQL, GEO_SQL, MESH_SQL, REGIONS, SUPPLIERS, WALK_SQL, geo, mesh, walk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The edge that updates insert into geo, and the one that they delete.
NEW, OLD = (SUPPLIERS, REGIONS + 2), (REGIONS, REGIONS + 1)
_NEW_SQL = f"select * from edges0 union select {NEW[1]}, {NEW[0]}"
_OLD_SQL = f"select * from edges0 where not (u = {OLD[0]} and v = {OLD[1]})"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(graph: str, tail: str, change: str | None = None) -> str:
    """SQL over edges, e and n of a graph, after a change of its edges if there is one."""
    edges = EDGES_SQL if change is None else EDGES_SQL.replace("edges(u, v)", "edges0(u, v)") + f"edges(u, v) as ({change}),\n"
    return "with recursive " + {"geo": GEO_SQL, "mesh": MESH_SQL, "walk": WALK_SQL}[graph] + edges + ARCS_SQL + tail


#: r(s, v, d, sg): hops and path counts from the sources in src(id)
_PATHS = """
r(s, v, d, sg) using key (s, v) as (
  select id, id, 0, cast(1 as double) from src
  union
  select r.s, e.t, r.d + 1, sum(r.sg) from r join e on e.s = r.v left join recurring.r q on q.s = r.s and q.v = e.t
  where q.s is null group by 1, 2, 3),
"""
_ALL = "src(id) as (select id from n)," + _PATHS
_PAIRS = """
pairs(mid, total) as (
  select x.v, sum(x.sg * y.sg / z.sg) from r x join r y on y.s = x.v join r z on z.s = x.s and z.v = y.v
  where x.s <> x.v and y.v <> x.v and x.s < y.v and x.d + y.d = z.d group by 1),
bc(id, bc) as (select n.id, coalesce(pairs.total, 0) from n left join pairs on mid = n.id)
"""
_BC = _ALL + _PAIRS
_ROUNDED = "select id, round(bc, 4) + 0.0 as bc from bc"
#: c(a, v, l): the component of v, by its least id, when a is taken out
_CUT = """
lab(a, v, l) as (
  select x.id, y.id, y.id from n x join n y on x.id <> y.id
  union
  select lab.a, e.t, lab.l from lab join e on e.s = lab.v where e.t <> lab.a),
c(a, v, l) as (select a, v, min(l) from lab group by 1, 2),
"""
_BRIDGES = """
reach(u, v, x) as (
  select u, v, u from edges
  union
  select reach.u, reach.v, e.t from reach join e on e.s = reach.x where not (e.s = reach.u and e.t = reach.v) and not (e.s = reach.v and e.t = reach.u)),
bridges(u, v) as (select u, v from edges except select u, v from reach where x = v),
"""
_PARTS = _BRIDGES + """
ml(id, l) as (
  select id, id from n
  union
  select x.t, ml.l from ml join (select e.s, e.t from e where not exists (select 1 from bridges b where b.u = least(e.s, e.t) and b.v = greatest(e.s, e.t))) x on x.s = ml.id),
muc(id, muc_id) as (select id, min(l) from ml group by 1),
"""
#: blk(u, v, bu, bv): the least edge of each edge's block
_BLOCKS = _CUT + """
inc(a, u, v, l) as (select edges.u, edges.u, edges.v, c.l from edges join c on c.a = edges.u and c.v = edges.v union all select edges.v, edges.u, edges.v, c.l from edges join c on c.a = edges.v and c.v = edges.u),
near(u, v, x, y) as (select p.u, p.v, q.u, q.v from inc p join inc q on p.a = q.a and p.l = q.l),
eb(u, v, x, y) as (
  select u, v, u, v from edges
  union
  select near.x, near.y, eb.x, eb.y from eb join near on near.u = eb.u and near.v = eb.v where eb.x < near.x or (eb.x = near.x and eb.y < near.y)),
blk(u, v, bu, bv) as (select u, v, min((x, y))[1], min((x, y))[2] from eb group by 1, 2),
sizes(bu, bv, n, m) as (select bu, bv, (select count(distinct z) from (select b.u as z from blk b where b.bu = k.bu and b.bv = k.bv union all select b.v from blk b where b.bu = k.bu and b.bv = k.bv)), count(*) from blk k group by 1, 2)
"""


def _rounded(bc: DataFrame) -> DataFrame:
    return bc.select("id", (F.round("bc", 4) + F.lit(0.0)).alias("bc"))


def _ids(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


@query(_with("walk", "last as (select 1) select u, v from edges"))
def edges_canonical(spark, d):
    return walk(spark, d).edges


@query(_with("walk", "last as (select 1) select s as id, count(*) as degree from e group by 1"))
def degrees(spark, d):
    return walk(spark, d).degrees()


@query(_with("geo", "last as (select 1) select s as id, string_agg(cast(t as varchar), ',' order by t) as neighbours from e group by 1"))
def adjacency(spark, d):
    return geo(spark, d).adjacency().select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query(_with("geo", f"p(a, b) as (select cast(n_regionkey + {REGIONS} as bigint), cast(n_nationkey as bigint) from nation union all select cast({REGIONS} + (n_regionkey + 1) % 5 as bigint), cast(n_nationkey as bigint) from nation) select a, b, exists (select 1 from e where s = a and t = b) as there from p"))
def has_edge(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey").cast("long").alias("b")
    pairs = n.select((F.col("n_regionkey") + REGIONS).cast("long").alias("a"), key).union(n.select((F.lit(REGIONS) + (F.col("n_regionkey") + 1) % 5).cast("long"), key))
    return geo(spark, d).has_edges(pairs)


@query(_with("geo", "last as (select 1) select u, v from edges", _OLD_SQL))
def remove_edge(spark, d):
    return geo(spark, d).remove_edges(spark.createDataFrame([OLD], "a long, b long")).edges


@query(_with("geo", "last as (select 1) select least(u, v) as u, greatest(u, v) as v from edges", _NEW_SQL))
def insert_edge(spark, d):
    return geo(spark, d).insert_edges(spark.createDataFrame([NEW, OLD], "a long, b long")).edges


@query(_with("walk", "last as (select 1) select (select count(*) from n) as n, (select count(*) from edges) as m"))
def graph_size(spark, d):
    g = walk(spark, d)
    return spark.createDataFrame([g.size()], "n long, m long")


@query(_with("geo", "o as (select id, row_number() over (order by id) - 1 as label from n) select x.label as u, y.label as v from edges join o x on x.id = u join o y on y.id = v"))
def relabelled(spark, d):
    return geo(spark, d).relabelled()[0].edges


@query(_with("walk", "src(id) as (select min(id) from n)," + _PATHS + "last as (select 1) select n.id as v, coalesce(d, -1) as dist, coalesce(sg, 0) as sigma from n left join r on v = n.id"))
def sssp_from_min(spark, d):
    g = walk(spark, d)
    return traverse.sssp(g, g.vertices.agg(F.min("id").alias("id"))).select("v", "dist", "sigma")


@query(_with("geo", _ALL + "last as (select 1) select s, v, d as dist, sg as sigma from r"))
def all_pairs_dist_sigma(spark, d):
    return traverse.all_pairs(geo(spark, d))


@query(_with("geo", "src(id) as (select cast(500 as bigint))," + _PATHS + "last as (select 1) select v, d as dist, sg as sigma from r"))
def sssp_relational(spark, d):
    return traverse.sssp(geo(spark, d), _ids(spark, REGIONS), "relational").select("v", "dist", "sigma")


@query(_with("geo", f"src(id) as (select max(id) from n)," + _PATHS + f"p(seq, id) as (select 0, cast({SUPPLIERS} as bigint) union all select p.seq + 1, (select min(e.t) from e join r y on y.v = e.t where e.s = p.id and y.d = r.d - 1) from p join r on r.v = p.id where r.d > 0) select seq, id from p"))
def shortest_path(spark, d):
    g = stored_graph(geo(spark, d))
    last = g.vertices.agg(F.max("id")).first()[0]
    return spark.createDataFrame(list(enumerate(traverse.shortest_path(g, SUPPLIERS, last))), "seq int, id long")


stored_graph = traverse.kept


_RINGLESS = f"select * from edges0 where not (u >= {REGIONS} and v < {SUPPLIERS} and u < {SUPPLIERS})"


def _ringless(spark, d) -> Graph:
    g = geo(spark, d)
    return Graph(g.vertices, g.edges.where(~((F.col("u") >= REGIONS) & (F.col("v") < SUPPLIERS))))


_CC = _with("geo", "lab(v, l) as (select id, id from n union select e.t, lab.l from lab join e on e.s = lab.v where lab.l < e.t), comp(id, c) as (select v, min(l) from lab group by 1) select c as component, count(*) as size from comp group by 1", _RINGLESS)


@query(_CC)
def component_sizes(spark, d):
    return traverse.component_sizes(_ringless(spark, d))


@query(_with("geo", "lab(v, l) as (select id, id from n union select e.t, lab.l from lab join e on e.s = lab.v where lab.l < e.t), comp(id, c) as (select v, min(l) from lab group by 1) select c as component, u, v from edges join comp on comp.id = u union all select c, id, id from comp", _RINGLESS))
def component_graphs(spark, d):
    """The edges of every component, and its vertices as (component, id, id)."""
    vertices, edges = traverse.component_graphs(_ringless(spark, d), "relational")
    return edges.union(vertices.select("component", "id", F.col("id")))


@query(_CC)
def component_sizes_relational(spark, d):
    return traverse.component_sizes(_ringless(spark, d), "relational")


@query(_with("geo", _CUT + "last as (select 1) select a as id, count(distinct l) as branches from c group by 1 having count(distinct l) > 1"))
def articulation_points(spark, d):
    return blocks.articulation_points(geo(spark, d))


@query(_with("geo", _BRIDGES + "last as (select 1) select u, v from bridges"))
def bridges(spark, d):
    return blocks.bridges(geo(spark, d))


@query(_with("geo", _CUT + "k(a, l, size) as (select a, l, count(*) from c group by 1, 2) select a as id, size from k where a in (select a from k group by 1 having count(*) > 1)"))
def branch_sizes(spark, d):
    return blocks.branch_sizes(geo(spark, d))


@query(_with("geo", _BLOCKS + "select least(u, v) as u, greatest(u, v) as v, bu as block_u, bv as block_v from blk", _NEW_SQL.replace(f"{NEW[1]}, {NEW[0]}", f"cast({NEW[1]} as bigint), cast({NEW[0]} as bigint)")))
def bicomponents(spark, d):
    g = geo(spark, d).insert_edges(spark.createDataFrame([NEW], "a long, b long"))
    b = blocks.biconnected_components(g)
    first = b.groupBy("block_id").agg(F.min(F.struct("u", "v")).alias("m"))
    return b.join(first, "block_id").select("u", "v", F.col("m.u").alias("block_u"), F.col("m.v").alias("block_v"))


@query(_with("geo", _BLOCKS.rstrip() + f", b as (select bu, bv from blk where u = {NEW[1]} and v = {NEW[0]}), bvx(id) as (select u from blk join b using (bu, bv) union select v from blk join b using (bu, bv)) select bvx.id, (select count(distinct l) > 1 from c where c.a = bvx.id) as is_art, (select count(*) from c where c.a = bvx.id and c.l <> (select min(x.l) from c x where x.a = bvx.id and x.v = (select min(y.id) from bvx y where y.id <> bvx.id))) as vg from bvx", _NEW_SQL))
def edge_block(spark, d):
    return blocks.edge_block(geo(spark, d), *NEW)[1].select("id", "is_art", "vg")


@query(_with("geo", _PARTS + "last as (select 1) select muc_id, count(*) as size from muc group by 1"))
def bridge_free_parts(spark, d):
    return blocks.bridge_free_parts(geo(spark, d)).groupBy("muc_id").agg(F.count("*").alias("size"))


@query(_with("geo", _PARTS + _CUT + "k(a, l, size) as (select a, l, count(*) from c group by 1, 2), ends(x, y) as (select u, v from bridges union all select v, u from bridges) select muc_id, ends.x as id, cast(sum(size) as bigint) as outside_size from ends join muc on muc.id = ends.x join c on c.a = ends.x and c.v = ends.y join k on k.a = c.a and k.l = c.l group by 1, 2"))
def connection_vertices(spark, d):
    return blocks.connection_vertices(geo(spark, d))


@query(_with("walk", _BC + _ROUNDED))
def bc_exact(spark, d):
    return _rounded(betweenness.exact(walk(spark, d)))


@query(_with("geo", _BC + _ROUNDED))
def bc_exact_geo(spark, d):
    return _rounded(betweenness.brandes(geo(spark, d)))


@query(_with("geo", _BC + _ROUNDED))
def bc_naive(spark, d):
    return _rounded(betweenness.naive(stored_graph(geo(spark, d))))


@query(_with("geo", _BC + _ROUNDED))
def bc_by_blocks(spark, d):
    return _rounded(betweenness.by_blocks(geo(spark, d)))


@query(_with("geo", _BC + _ROUNDED))
def bc_relational(spark, d):
    return _rounded(betweenness.brandes(stored_graph(geo(spark, d)), wanted="relational"))


@query(_with("walk", _BC + ", t as (select id, round(bc, 4) + 0.0 as bc from bc order by bc.bc desc, id limit 10) select id, bc from t"))
def bc_topk(spark, d):
    return _rounded(betweenness.top(betweenness.exact(walk(spark, d)), 10))


_PARTIAL = """
part(mid, bc) as (select x.v, sum(x.sg * y.sg / z.sg) from r x join r y on y.s = x.v join r z on z.s = x.s and z.v = y.v
  where x.s in (select id from n order by id limit 5) and x.s <> x.v and y.v <> x.v and x.s <> y.v and x.d + y.d = z.d group by 1)
select n.id, round(coalesce(bc, 0), 4) + 0.0 as bc from n left join part on mid = n.id"""


@query(_with("walk", _ALL + _PARTIAL))
def bc_partial_k(spark, d):
    return _rounded(betweenness.brandes(walk(spark, d), 5))


@query(_with("walk", _ALL + _PARTIAL.replace("limit 5", "limit 1")))
def bc_one_source(spark, d):
    g = walk(spark, d)
    return _rounded(betweenness.one_source(g, g.vertices.agg(F.min("id")).first()[0]))


def _updated(op: str, how: str, wanted: str | None = None) -> Query:
    def run(spark, d):
        g = stored_graph(geo(spark, d))
        return _rounded(incremental.update(g, betweenness.brandes(g), *(NEW if op == "insert" else OLD), op, how, wanted))

    run.__name__ = f"bc_{op}_{wanted or how}"
    return run


for _op, _sql in (("insert", _NEW_SQL), ("delete", _OLD_SQL)):
    for _how in incremental.DECOMPOSITIONS:
        query(_with("geo", _BC + _ROUNDED, _sql))(_updated(_op, _how))
    query(_with("geo", _BC + _ROUNDED, _sql))(_updated(_op, "graph", "relational"))


def _delta_sql(change: str) -> str:
    """Betweenness over edges (after the change) and over edges0 (before it), and the difference."""
    one = ARCS_SQL + _BC
    names = re.compile(r"(?<![\w.])(edges|e|n|src|pairs|r|bc)(?=\(|\.\w|\s+(?:join|left|where|x\b|y\b|z\b|on|union|using)|\)|\s*$)", re.M)
    before = re.sub(r"\brecurring\.r\b", "recurring.r0", names.sub(r"\g<1>0", one)).replace("bc0(id, bc0)", "bc0(id, bc)")
    head = "with recursive " + GEO_SQL + EDGES_SQL.replace("edges(u, v)", "edges0(u, v)") + f"edges(u, v) as ({change}),\n"
    return head + before + "," + one + "select bc.id, round(bc.bc - coalesce(bc0.bc, 0), 4) + 0.0 as delta from bc left join bc0 on bc0.id = bc.id where abs(bc.bc - coalesce(bc0.bc, 0)) > 1e-6"


def _delta(op: str) -> Query:
    def run(spark, d):
        out = incremental.delta(geo(spark, d), *(NEW if op == "insert" else OLD), op, "bcc")
        return out.where(F.abs("delta") > 1e-6).select("id", (F.round("delta", 4) + F.lit(0.0)).alias("delta"))

    run.__name__ = f"delta_{op}"
    return run


query(_delta_sql(_NEW_SQL))(_delta("insert"))
query(_delta_sql(_OLD_SQL))(_delta("delete"))


@query(_with("geo", f"src(id) as (select {NEW[0]} union all select {NEW[1]})," + _PATHS + f"gap(g) as (select abs(x.d - y.d) from r x join r y on x.v = y.v where x.s = {NEW[0]} and y.s = {NEW[1]}) select count(*) filter (g = 0) as d0, count(*) filter (g = 1) as d1, count(*) filter (g >= 2) as d2 from gap"))
def pruning_counts(spark, d):
    return incremental.pruning_counts(geo(spark, d), *NEW)


@query(_with("geo", _BLOCKS + ", b as (select * from sizes order by n desc, bu, bv limit 1) select b.n as nodes, b.m as edges, b.n / (select count(*) from n)::double as frac_nodes, b.m / (select count(*) from edges)::double as frac_edges from b"))
def largest_block(spark, d):
    return stats.largest_block_stats(geo(spark, d))


@query(_with("geo", _BLOCKS + ", o as (select m, row_number() over (order by m desc) as k from sizes) select count(*) as blocks, count(*) filter (m >= 2) as blocks_of_size, max(m) as largest, max(m) filter (k = 2) as second, max(m) / sum(m)::double as frac_largest from o"))
def count_blocks(spark, d):
    return stats.count_blocks(geo(spark, d), 2)


@query(_with("geo", _BLOCKS + ", t as (select (select count(*) from n) as gn, (select count(*) from edges) as gm) select bu as block_u, bv as block_v, round(1 / ((n / gn::double) * 0.5 * ((n + m) / (gn + gm)::double)) * 100 / 120, 6) as bcc_speedup, round(((gn + gm) / (n + m)::double) * (gn / n::double), 6) as muc_speedup from sizes, t"))
def ideal_speedup(spark, d):
    g = geo(spark, d)
    n, m = g.size()
    first = blocks.biconnected_components(g).groupBy("block_id").agg(F.min(F.struct("u", "v")).alias("b"))
    s = stats.block_sizes(g).join(first, "block_id")
    gn, gm = F.lit(float(n)), F.lit(float(m))
    return s.select(F.col("b.u").alias("block_u"), F.col("b.v").alias("block_v"), F.round(stats.ideal_speedup_bcc(F.lit(0.5), F.col("n"), F.col("m"), gn, gm, 120), 6).alias("bcc_speedup"), F.round(stats.ideal_speedup_muc(gn, gm, F.col("n"), F.col("m")), 6).alias("muc_speedup"))


_STATS = "s as (select count(*) as n, min(value) as min, max(value) as max, avg(value) as mean, stddev_pop(value) as stddev, list_sort(list(value))[cast(floor(count(*) / 2) as int) + 1] as median from events) select n, min, max, round(mean, 6) as mean, round(stddev, 6) as stddev, median, round(mean - 1.96 * stddev / sqrt(n), 6) as lo, round(mean + 1.96 * stddev / sqrt(n), 6) as hi from s"


@query("with " + _STATS)
def simple_stats(spark, d):
    s = stats.confidence_95(stats.simple_stats(spark.read.parquet(f"{d}/events.parquet"), "value"))
    return s.select("n", "min", "max", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "median", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_DRAWS = """o as (select id, row_number() over (order by id) - 1 as k, count(*) over () as nn from n),
draw as (select i, cast('0x' || substr(md5('1111 ' || i || ' 1'), 1, 8) as bigint) % (select count(*) from n) as a, cast('0x' || substr(md5('1111 ' || i || ' 2'), 1, 8) as bigint) % (select count(*) from n) as b from range(20000) t(i)),
pick as (select x.id as u, y.id as v, min(i) as i from draw join o x on x.k = least(a, b) join o y on y.k = greatest(a, b) where a <> b group by 1, 2)
select row_number() over (order by i) - 1 as seq, least(u, v) as u, greatest(u, v) as v from pick where not exists (select 1 from edges where edges.u = pick.u and edges.v = pick.v) order by i limit 10"""


@query(_with("geo", _DRAWS))
def random_non_edges(spark, d):
    return stats.random_non_edges(stored_graph(geo(spark, d)), 10, 1111).select(F.col("seq").cast("long").alias("seq"), "u", "v")


@query(_with("mesh", _BRIDGES + "k as (select u, v from edges where not exists (select 1 from bridges b where b.u = edges.u and b.v = edges.v)) select u, v from k order by md5('1111 ' || u || ' ' || v), u, v limit 7"))
def random_non_bridges(spark, d):
    return stats.random_non_bridges(stored_graph(mesh(spark, d)), 7, 1111)


@query(_with("geo", _BC + _ROUNDED, f"({_NEW_SQL}) except select {OLD[0]}, {OLD[1]}"))
def stream_replay(spark, d):
    events = spark.createDataFrame([(2, "-", *OLD), (1, "+", *NEW)], "seq long, op string, u long, v long")
    return _rounded(replay(stored_graph(geo(spark, d)), events).bc)


def _on_mesh(name: str, sql: str, run: Callable[[Graph], DataFrame], change: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: run(mesh(spark, d))
    ORACLES[name] = _with("mesh", sql, change)


#: An edge of the ring of nations, between two regions' nations.
_RING = (3, 4)
_RING_SQL = f"select * from edges0 where not (u = {_RING[0]} and v = {_RING[1]})"
_on_mesh("articulation_points_mesh", _CUT + "last as (select 1) select a as id, count(distinct l) as branches from c group by 1 having count(distinct l) > 1", blocks.articulation_points)
_on_mesh("bridges_mesh", _BRIDGES + "last as (select 1) select u, v from bridges", blocks.bridges)
_on_mesh("bridge_free_parts_mesh", _PARTS + "last as (select 1) select id, muc_id from muc", blocks.bridge_free_parts)
_on_mesh("count_parts", _PARTS + "k as (select muc_id, count(*) as n from muc group by 1) select count(*) as parts, count(*) filter (n >= 3) as large from k", lambda g: g.vertices.sparkSession.createDataFrame([(blocks.count_parts(g), blocks.count_parts(g, 3))], "parts long, large long"))
_on_mesh("parts_after_insertion", _PARTS + "last as (select 1) select id, muc_id from muc", lambda g: blocks.parts_after_insertion(g, blocks.bridge_free_parts(g), SUPPLIERS, SUPPLIERS + 1), f"select * from edges0 union select cast({SUPPLIERS} as bigint), cast({SUPPLIERS + 1} as bigint)")
_on_mesh("bc_by_blocks_mesh", _BC + _ROUNDED, lambda g: _rounded(betweenness.by_blocks(g)))
_on_mesh("bc_by_parts_mesh", _BC + _ROUNDED, lambda g: _rounded(betweenness.by_bridge_free_parts(g)))
_on_mesh("vertices", "last as (select 1) select id from n union all select -7", lambda g: g.insert_vertices(_ids(g.vertices.sparkSession, -7, 500)).vertices)
for _how in incremental.DECOMPOSITIONS:
    _on_mesh(f"bc_insert_mesh_{_how}", _BC + _ROUNDED, lambda g, how=_how: _rounded(incremental.update(g, betweenness.brandes(g), *NEW, "insert", how)), _NEW_SQL)
    _on_mesh(f"bc_delete_mesh_{_how}", _BC + _ROUNDED, lambda g, how=_how: _rounded(incremental.update(g, betweenness.brandes(g), *_RING, "delete", how)), _RING_SQL)
_on_mesh("insert_and_update", _BC + _ROUNDED, lambda g: _rounded(incremental.insert_and_update(g, betweenness.brandes(g), *NEW)[1]), _NEW_SQL)


def _by_static_part(g: Graph) -> DataFrame:
    """Betweenness after an insertion, from the one part that it changes, taken off without and put on with the edge."""
    before, after = (incremental.part_betweenness(g, *NEW, edge_in=x) for x in (False, True))
    return _rounded(betweenness.brandes(g).union(before.select("id", -F.col("bc"))).union(after).groupBy("id").agg(F.sum("bc").alias("bc")))


_on_mesh("bc_insert_mesh_static_part", _BC + _ROUNDED, _by_static_part, _NEW_SQL)


def _state(g: Graph) -> DataFrame:
    state = incremental.SourceState(g)
    state.insert(*NEW)
    return state.table.select("s", "v", F.col("dist").cast("long").alias("dist"), "sigma")


def _state_after_deletion(g: Graph) -> DataFrame:
    state = incremental.SourceState(g)
    state.insert(*NEW)
    state.delete(*_RING)
    return state.table.select("s", "v", F.col("dist").cast("long").alias("dist"), "sigma")


_on_mesh("source_state_deletion", _ALL + "last as (select 1) select s, v, cast(d as bigint) as dist, sg as sigma from r", _state_after_deletion, f"({_NEW_SQL}) except select {_RING[0]}, {_RING[1]}")
_on_mesh("source_state", _ALL + "last as (select 1) select s, v, cast(d as bigint) as dist, sg as sigma from r", _state, _NEW_SQL)


@query(_with("geo", "o as (select id, row_number() over (order by id) - 1 as label from n), k as (select x.label as u, y.label as v from edges join o x on x.id = u join o y on y.id = v) select u, v from k union all select (select count(*) from o), (select count(*) from k)"))
def net_file(spark, d):
    """The graph written as a .net file and read again, and its numbers of vertices and edges as the last row."""
    path = f"{shared_dir(spark)}/net-{uuid.uuid4().hex}"
    text.write_graph(stored_graph(geo(spark, d).relabelled()[0]), path)
    g = text.read_graph(spark, path)
    return g.edges.union(spark.createDataFrame([g.size()], "u long, v long"))


@query(_with("geo", "last as (select 1) select u, v from edges"))
def edge_file(spark, d):
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    geo(spark, d).edges.select(F.concat_ws(" ", "u", "v")).write.text(path)
    return text.read_edges(spark, path)


QUERIES["delta_file"], ORACLES["delta_file"] = lambda spark, d: _delta_file(spark, d), ORACLES["delta_insert"]


def _delta_file(spark, d):
    path = f"{shared_dir(spark)}/delta-{uuid.uuid4().hex}"
    text.write_delta(QUERIES["delta_insert"](spark, d), path)
    return spark.read.parquet(path)


_SETTINGS = "1\n10, 20, 1111\n0, 1, 1\n1, 0, 1, 0\n/data/a.net /data/b.net"


@query("select * from (values ('a.net', true, 10, 20, 1111, false, true, true, true, false, true, false), ('b.net', true, 10, 20, 1111, false, true, true, true, false, true, false)) t(name, deletion, num_edges, num_threads, rand_seed, external_edges, update_whole, update_blocks, run_full_fast, run_full, run_parts, update_parts)")
def settings(spark, d):
    c = text.parse_config(_SETTINGS)
    rows = [(text.graph_name(p), c.deletion, c.num_edges, c.num_threads, c.rand_seed, c.external_edges, c.update_whole, c.update_blocks, c.run_full_fast, c.run_full, c.run_parts, c.update_parts) for p in c.paths]
    return spark.createDataFrame(rows, "name string, deletion boolean, num_edges int, num_threads int, rand_seed int, external_edges boolean, update_whole boolean, update_blocks boolean, run_full_fast boolean, run_full boolean, run_parts boolean, update_parts boolean")


# Speedup information of drawn edges. A vertex is in the block that an edge makes if no other vertex cuts it off from both ends.
_PICKED = _DRAWS.replace("\nselect row_number()", ",\ndrawn as (select row_number()", 1) + "),\n"
_INFO = _CUT + _PICKED + """
src(id) as (select u from drawn union select v from drawn),""" + _PATHS + """
member as (select drawn.u as a, drawn.v as b, n.id from drawn, n where n.id in (drawn.u, drawn.v) or not exists (
  select 1 from c x left join c y on y.a = x.a and y.v = drawn.u left join c z on z.a = x.a and z.v = drawn.v
  where x.v = n.id and not coalesce(x.l = y.l, false) and not coalesce(x.l = z.l, false))),
inner_edges as (select x.a, x.b, count(*) + 1 as m from edges join member x on x.id = edges.u join member y on y.id = edges.v and y.a = x.a and y.b = x.b group by 1, 2),
gap as (select k.a as u, k.b as v, abs(x.d - y.d) as g from member k join r x on x.s = k.a and x.v = k.id join r y on y.s = k.b and y.v = k.id),
counts as (select u, v, count(*) as n, count(*) filter (g = 0) as d0, count(*) filter (g = 1) as d1, count(*) filter (g >= 2) as d2 from gap group by 1, 2),
info as (select u, v, n, m, d0, d1, d2, 1 / ((n / (select count(*) from n)::double) * (1 - d0 / n::double) * ((n + m) / ((select count(*) from n) + (select count(*) from edges))::double)) as speedup from counts join inner_edges on a = u and b = v)
"""
_INFO_ROWS = _INFO + "select u, v, n, m, d0, d1, d2, round(speedup, 6) as speedup_100, round(speedup * 100 / 150, 6) as speedup_150 from info"


def _drawn_info(g: Graph, wanted: str | None = None) -> DataFrame:
    g = stored_graph(g)
    return stats.speedup_info(g, stats.random_non_edges(g, 10, 1111), (100, 150), wanted)


def _info_rows(g: Graph, wanted: str | None = None) -> DataFrame:
    return _drawn_info(g, wanted).select("u", "v", "n", "m", "d0", "d1", "d2", F.round("speedup_100", 6).alias("speedup_100"), F.round("speedup_150", 6).alias("speedup_150"))


def _rounded_stats(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[F.round(c, 6).alias(c) for c in names])


_on_mesh("speedup_info", _INFO_ROWS, _info_rows)
_on_mesh("speedup_info_relational", _INFO_ROWS, lambda g: _info_rows(g, "relational"))
_on_mesh("speedup_summary", _INFO + ", each as (select ratio, speedup * 100 / ratio as x from info, (values (100), (150)) t(ratio)) select ratio, count(*) as n, round(min(x), 6) as min, round(max(x), 6) as max, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as stddev, round(list_sort(list(x))[cast(floor(count(*) / 2) as int) + 1], 6) as median from each group by 1", lambda g: _rounded_stats(stats.speedup_summary(_drawn_info(g), (100, 150)), "min", "max", "mean", "stddev", "median"))
_LARGEST = _BLOCKS.rstrip() + """,
best as (select * from sizes order by n + m desc, bu, bv limit 1),
inside(u, v) as (select u, v from blk join best using (bu, bv)),
arc(s, t) as (select u, v from inside union all select v, u from inside),
drawn as (select u, v from inside order by md5('1111 ' || u || ' ' || v), u, v limit 20),
hop(u, v, s, x, d) using key (u, v, s, x) as (
  select u, v, u, u, 0 from drawn union all select u, v, v, v, 0 from drawn
  union
  select h.u, h.v, h.s, arc.t, min(h.d + 1) from hop h join arc on arc.s = h.x left join recurring.hop q on q.u = h.u and q.v = h.v and q.s = h.s and q.x = arc.t
  where q.s is null and not (arc.s = h.u and arc.t = h.v) and not (arc.s = h.v and arc.t = h.u) group by 1, 2, 3, 4),
gap as (select x.u, x.v, abs(x.d - y.d) as g from hop x join hop y on y.u = x.u and y.v = x.v and y.x = x.x where x.s = x.u and y.s = x.v),
each as (select u, v, count(*) as n, count(*) filter (g = 0) as d0, count(*) filter (g = 1) as d1, count(*) filter (g >= 2) as d2, count(*) filter (g = 0) / count(*)::double as f from gap group by 1, 2)
"""
_on_mesh("largest_block_gaps", _LARGEST + "select u, v, n, d0, d1, d2, round(f, 6) as frac_d0 from each", lambda g: _rounded_stats(stats.largest_block_speedups(stored_graph(g), 20, 1111)[0], "frac_d0"))
_on_mesh("largest_block_speedups", _LARGEST.rstrip() + """,
total as (select unnest(['mean', 'stddev', 'median', 'min', 'max']) as stat, unnest([avg(f), stddev_pop(f), list_sort(list(f))[cast(floor(count(*) / 2) as int) + 1], min(f), max(f)]) as f from each),
whole as (select n, m, (select count(*) from n) as gn, (select count(*) from edges) as gm from best)
select stat, round(f, 6) as frac_d0, round(case when f < 1 then 1 / ((n / gn::double) * (1 - f) * ((n + m) / (gn + gm)::double)) end, 6) as speedup_100, round(case when f < 1 then 1 / ((n / gn::double) * (1 - f) * ((n + m) / (gn + gm)::double)) * 100 / 120 end, 6) as speedup_120 from total, whole""", lambda g: _rounded_stats(stats.largest_block_speedups(stored_graph(g), 20, 1111, (100, 120))[1], "frac_d0", "speedup_100", "speedup_120"))

# Decomposition on DataFrames, of graphs of any size.


def _on_dataframes(name: str, of: str, run: Query) -> None:
    """A query whose rows are those of another one, found on DataFrames."""
    QUERIES[f"{name}_relational"], ORACLES[f"{name}_relational"] = run, ORACLES[of]


def _by_least_edge(g: Graph) -> DataFrame:
    b = blocks.biconnected_components(g, "relational")
    first = b.groupBy("block_id").agg(F.min(F.struct("u", "v")).alias("m"))
    return b.join(first, "block_id").select("u", "v", F.col("m.u").alias("block_u"), F.col("m.v").alias("block_v"))


_ids_of_points = _CUT + "last as (select 1) select a as id, count(distinct l) as branches from c group by 1 having count(distinct l) > 1"
_on_dataframes("bicomponents", "bicomponents", lambda spark, d: _by_least_edge(geo(spark, d).insert_edges(spark.createDataFrame([NEW], "a long, b long"))))
_on_dataframes("articulation_points", "articulation_points_mesh", lambda spark, d: blocks.articulation_points(mesh(spark, d), "relational"))
_on_dataframes("bridges", "bridges_mesh", lambda spark, d: blocks.bridges(mesh(spark, d), "relational"))
_on_dataframes("branch_sizes", "branch_sizes", lambda spark, d: blocks.branch_sizes(geo(spark, d), "relational"))
_on_dataframes("edge_block", "edge_block", lambda spark, d: blocks.edge_block(geo(spark, d), *NEW, "relational")[1].select("id", "is_art", "vg"))
_on_dataframes("bridge_free_parts", "bridge_free_parts_mesh", lambda spark, d: blocks.bridge_free_parts(mesh(spark, d), "relational"))
_on_dataframes("connection_vertices", "connection_vertices", lambda spark, d: blocks.connection_vertices(geo(spark, d), "relational"))
_on_dataframes("largest_block", "largest_block", lambda spark, d: stats.largest_block_stats(geo(spark, d), "relational"))
_on_dataframes("count_blocks", "count_blocks", lambda spark, d: stats.count_blocks(geo(spark, d), 2, "relational"))
_on_dataframes("random_non_bridges", "random_non_bridges", lambda spark, d: stats.random_non_bridges(stored_graph(mesh(spark, d)), 7, 1111, "relational"))
QUERIES["articulation_points_walk"] = lambda spark, d: blocks.articulation_points(walk(spark, d), "relational")
ORACLES["articulation_points_walk"] = _with("walk", _ids_of_points)
QUERIES["bridges_walk"] = lambda spark, d: blocks.bridges(walk(spark, d), "relational")
ORACLES["bridges_walk"] = _with("walk", _BRIDGES + "last as (select 1) select u, v from bridges")


# The tree of blocks after insertions, nothing decomposed anew: two suppliers, of different nations; a vertex that comes in,
# and its second edge; a supplier and a region.
_GROWN = [(SUPPLIERS + 1, SUPPLIERS + 2), (-7, SUPPLIERS + 3), (-7, 3), NEW]
_GROWN_SQL = "select * from edges0" + "".join(f" union select cast({min(e)} as bigint), cast({max(e)} as bigint)" for e in _GROWN)


def _grown(g: Graph) -> BlockTree:
    tree = BlockTree(g)
    for e in _GROWN:
        tree.insert(*e)
    return tree


def _tree_blocks(g: Graph) -> DataFrame:
    found = _grown(g).blocks()
    return found.edges.join(found.numbers.select("top", F.col("u").alias("block_u"), F.col("v").alias("block_v")), "top").select("u", "v", "block_u", "block_v")


_on_mesh("block_tree", _BLOCKS + "select u, v, bu as block_u, bv as block_v from blk", _tree_blocks, _GROWN_SQL)
_on_mesh("block_tree_branches", ORACLES["branch_sizes"].split(ARCS_SQL)[1], lambda g: (b := _grown(g).blocks().branches).join(b.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"), "id", "left_semi").select("id", F.col("n").alias("size")), _GROWN_SQL)
_on_mesh("block_tree_parts", _PARTS + "last as (select 1) select id, muc_id from muc", lambda g: _grown(g).parts, _GROWN_SQL)
