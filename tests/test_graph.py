import numpy as np
import pytest
from graphs import AP21, BCC7, CYCLES, NAIVE, STAR, TOY, brandes, edges, random_graph

from graphloom.functions import stats
from graphloom.graph import Graph
from graphloom.operators import betweenness, blocks, incremental, kernel, traverse
from graphloom.sources import text
from graphloom.streaming.edges import replay

BC = {
    TOY: [81.5, 17.5, 66.5, 95.5, 70.5, 23.5, 1, 1, 23.5, 0.5, 72, 23, 9, 2, 9, 23, 34, 18, 0, 0],
    STAR: [0.5, 1.5, 1.5, 7.5, 0, 0],
    NAIVE: [7, 1, 0.25, 0.25, 0.25, 0.25, 7, 1],
    BCC7: [0.5, 2, 2, 10, 2, 2, 0.5],
    CYCLES: [0.5, 2.5, 2.5, 12.5, 12.5, 2.5, 2.5, 0.5],
    AP21: [91, 84, 30, 30, 51, 96, 15.5, 104, 78.5, 9.5, 11, 90.5, 9, 0.5, 81.5, 9, 0, 0, 36, 19, 0],
}
POINTS = {STAR: {3}, NAIVE: set(), BCC7: {3}, CYCLES: {3, 4}, AP21: {0, 1, 4, 5, 7, 11, 14, 18, 19}, TOY: {0, 2, 3, 4, 10, 16, 17}}


def got(df, value="bc"):
    return {r.id: r[value] for r in df.collect()}


def arrays(pairs, n):
    u, v = np.array(sorted({(min(e), max(e)) for e in pairs if e[0] != e[1]})).T
    return kernel.Csr.of(np.arange(n), u, v)


@pytest.mark.parametrize("toy", BC)
def test_known_betweenness(spark, toy):
    g = Graph.from_list(spark, edges(toy))
    assert got(betweenness.brandes(g)) == pytest.approx(dict(enumerate(BC[toy])))
    assert got(betweenness.by_blocks(g)) == pytest.approx(dict(enumerate(BC[toy])))
    assert {r.id for r in blocks.articulation_points(g).collect()} == POINTS[toy]


def test_other_plans_agree(spark):
    g = Graph.from_list(spark, edges(BCC7))
    want = dict(enumerate(BC[BCC7]))
    assert got(betweenness.naive(g)) == pytest.approx(want)
    assert got(betweenness.brandes(g, wanted="relational")) == pytest.approx(want)
    part = got(betweenness.brandes(g, 2))
    assert part == pytest.approx(got(betweenness.brandes(g, 2, wanted="relational")))
    one = [got(betweenness.one_source(g, s)) for s in (0, 1)]
    assert part == pytest.approx({k: one[0][k] + one[1][k] for k in part})
    assert sum(want.values()) == pytest.approx(sum(r.dist - 1 for r in traverse.all_pairs(g).where("s < v").collect()))
    a, b = (sorted(map(tuple, traverse.sssp(g, g.vertices, w).collect())) for w in ("kernel", "relational"))
    assert a == b


def test_toy_blocks(spark):
    g = Graph.from_list(spark, edges(TOY))
    found = {}
    for r in blocks.block_vertices(g).collect():
        found.setdefault(r.block_id, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == sorted([list(range(10, 16)), [3, 10], [17, 18], [16, 17], [2, 16], [2, 19], [0, 1, 2, 3], list(range(4, 10)), [0, 4]])
    assert {tuple(r) for r in blocks.bridges(g).collect()} == {(0, 4), (2, 16), (2, 19), (3, 10), (16, 17), (17, 18)}
    parts = {}
    for r in blocks.bridge_free_parts(g).collect():
        parts.setdefault(r.muc_id, set()).add(r.id)
    assert sorted(sorted(p) for p in parts.values() if len(p) > 2) == [[0, 1, 2, 3], list(range(4, 10)), list(range(10, 16))]
    _, vertices = blocks.edge_block(g, 3, 8)
    assert {r.id: r.vg for r in vertices.where("is_art").collect()} == {2: 4, 3: 6}
    conn = {(r.muc_id, r.id): r.outside_size for r in blocks.connection_vertices(g).collect()}
    assert conn[0, 0] == 6 and conn[0, 2] == 4 and conn[0, 3] == 6 and conn[4, 4] == 14


DELTAS = [
    (3, 8, "insert", (0, 4, 6), {0: -61.25, 1: -12.083333, 2: 0.916667, 3: 15.25, 4: -54.75, 5: -18.416667, 7: 12, 8: 30.75, 9: 3.583333}),
    (17, 19, "insert", (0, 2, 2), {16: -18, 17: 0.5, 2: -2.5, 19: 16}),
    (0, 2, "insert", (2, 0, 2), {1: -17.5, 3: -17.5}),
    (3, 18, "insert", (1, 0, 6), {0: 0.5, 1: -7, 2: -28.5, 3: 10, 16: -31, 17: -17, 18: 14}),
    (5, 9, "delete", (1, 5, 0), {4: 1.5, 5: -8.5, 7: 1, 8: 9.5, 9: -0.5}),
    (0, 1, "delete", (0, 4, 0), {0: -3.5, 1: -17.5, 2: 10.5, 3: 24.5}),
]


@pytest.mark.parametrize("a,b,op,counts,want", DELTAS)
def test_toy_updates(spark, a, b, op, counts, want):
    g = Graph.from_list(spark, edges(TOY))
    for how in incremental.DECOMPOSITIONS:
        d = {k: x for k, x in got(incremental.delta(g, a, b, op, how), "delta").items() if abs(x) > 1e-9}
        assert d == pytest.approx(want, abs=1e-5)
    plan = incremental.explain(g, a, b, op)
    assert (plan.pruned, plan.sources) == (counts[0], counts[1] + counts[2])
    assert "affected sources" in plan.explain()


@pytest.mark.parametrize("seed", range(150))
def test_random_updates_in_arrays(seed):
    import random

    n, e = random_graph(seed)
    g, r = arrays(e, n), random.Random(seed)
    for op in ("insert", "delete"):
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        a, b = r.choice(e if op == "delete" else [p for p in pairs if p not in e] or e)
        after = [x for x in e if x != (a, b)] if op == "delete" else sorted({*e, (a, b)})
        want0, want1 = brandes(e, range(n)), brandes(after, range(n))
        for how in incremental.DECOMPOSITIONS:
            work = incremental._work(g, a, b, op, how)
            if isinstance(work, incremental.UpdatePlan):
                assert work.op in ("none", "recompute")
                continue
            old, new = (work.without, work.with_edge) if op == "insert" else (work.with_edge, work.without)
            held = (work.without, work.with_edge, int(work.with_edge.at(a)), int(work.with_edge.at(b)), work.weight)
            repaired = np.zeros(n)
            for s in work.sources:
                repaired[old.ids] += (1 if op == "insert" else -1) * work.weight[s] * incremental._change(held, s) / 2
            assert repaired == pytest.approx([want1[k] - want0[k] for k in range(n)], abs=1e-9)
            total = np.zeros(n)
            for s in work.sources:
                total[old.ids] += work.weight[s] * incremental._dependencies_both(old, new, s, work.weight) / 2
            assert total == pytest.approx([want1[k] - want0[k] for k in range(n)], abs=1e-9)
        if op == "insert" and (a, b) not in e:
            h = arrays(after, n)
            for s in range(n):
                d, sigma, _ = kernel.paths(g, s)
                d1, sigma1, _ = kernel.paths(h, s)
                d2, sigma2 = incremental.repaired(h, a, b, d, sigma)
                assert (d1 == d2).all() and (sigma1 == sigma2).all()


def test_joining_splitting_and_no_change(spark):
    g = Graph.from_list(spark, [(0, 1), (1, 2), (3, 4), (4, 5), (3, 5)])
    bc = betweenness.brandes(g)
    for a, b, op in ((2, 3, "insert"), (0, 1, "delete"), (0, 9, "insert"), (0, 1, "insert"), (0, 5, "delete"), (4, 4, "insert")):
        after = set(edges("0-1 1-2 3-4 4-5 3-5"))
        after = after | ({(a, b)} if a != b else set()) if op == "insert" else after - {(a, b)}
        assert got(incremental.update(g, bc, a, b, op)) == pytest.approx(brandes(after, range(6)))
    assert got(incremental.update(g, bc, 0, 2, "insert", wanted="relational")) == pytest.approx(brandes([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]))


def test_data_model(spark):
    g = Graph.from_list(spark, [(1, 2), (2, 1), (1, 2), (5, 6), (6, 10), (7, 7)])
    assert g.size() == (5, 3)
    assert Graph.from_list(spark, [(1, 2), (2, 3)]).insert_vertices(spark.createDataFrame([(4,)], "id long")).size() == (4, 2)
    cc = traverse.component_sizes(Graph.of(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), spark.range(1, 5)))
    assert sorted(r["size"] for r in cc.collect()) == [1, 3]
    h, names = g.relabelled()
    assert {tuple(r) for r in h.edges.collect()} == {(0, 1), (2, 3), (3, 4)} and names.count() == 5
    assert [r.there for r in g.has_edges(spark.createDataFrame([(2, 1), (1, 5)], "a long, b long")).orderBy("b").collect()] == [True, False]
    empty = Graph.of(spark.createDataFrame([], "a long, b long"))
    assert betweenness.brandes(empty).count() == 0 and blocks.bridges(empty).count() == 0 and traverse.connected_components(empty).count() == 0
    assert traverse.shortest_path(Graph.from_list(spark, edges(CYCLES)), 0, 7) == [0, 1, 3, 4, 5, 7]
    assert traverse.shortest_path(g, 1, 10) == []


def test_text_formats(spark, tmp_path):
    (tmp_path / "x.net").write_text("5 5\n0 1\n0 2\n0 3\n0 4\n2 3\n3 2\n7 1\n")
    g = text.read_graph(spark, str(tmp_path / "x.net"))
    assert g.size() == (5, 5)
    text.write_graph(g, str(tmp_path / "y.net"))
    assert {tuple(r) for r in text.read_graph(spark, str(tmp_path / "y.net")).edges.collect()} == {tuple(r) for r in g.edges.collect()}
    (tmp_path / "x.net.edges").write_text("1 2\n4 3\n")
    assert [tuple(r) for r in text.read_edges(spark, str(tmp_path / "x.net.edges")).collect()] == [(1, 2), (4, 3)]
    c = text.parse_config("1\n10, 20, 1111\n0, 0, 1\n0, 0, 0, 0\n/a/b.net\n/c/d.net\n")
    assert c.deletion and c.num_edges == 10 and c.update_blocks and not c.update_whole and [text.graph_name(p) for p in c.paths] == ["b.net", "d.net"]
    assert not text.parse_config("10, 2, 1111\n0, 0, 1\n0, 0, 0, 0\n/a\n").deletion
    p = text.parse_paper_config("2, 10, 100.4, 1234\n1, 0, 0, 0\n/a.net\n")
    assert p.num_iter == 10 and p.max_time == 100.4 and p.update_whole
    text.write_delta(incremental.delta(g, 1, 2, "insert"), str(tmp_path / "d"))
    old, new = brandes([(0, 1), (0, 2), (0, 3), (0, 4), (2, 3)]), brandes([(0, 1), (0, 2), (0, 3), (0, 4), (2, 3), (1, 2)])
    want = {k: new[k] - old[k] for k in new if new[k] != old[k]}
    assert {r.id: r.delta for r in spark.read.parquet(str(tmp_path / "d")).collect()} == pytest.approx(want) and set(want) == {0, 2}


def test_statistics_and_samples(spark):
    s = stats.confidence_95(stats.simple_stats(spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double"), "x")).first()
    assert (s.min, s.max, s.mean, s.median) == (1, 4, 2.5, 3) and s.stddev == pytest.approx(1.118034) and s.lo < 2.5 < s.hi
    g = Graph.from_list(spark, edges(TOY))
    new = stats.random_non_edges(g, 12, 3).collect()
    assert len({(r.u, r.v) for r in new}) == 12 and all(r.u < r.v for r in new)
    assert not {(r.u, r.v) for r in new} & {(min(e), max(e)) for e in edges(TOY)}
    assert [tuple(r) for r in stats.random_non_edges(g, 12, 3).collect()] == [tuple(r) for r in new]
    assert stats.random_non_edges(Graph.from_list(spark, [(0, 1), (1, 2), (0, 2)]), 5).count() == 0
    old = {(r.u, r.v) for r in stats.random_non_bridges(g, 50, 1).collect()}
    assert len(old) == 17 and not old & {(0, 4), (2, 16), (2, 19), (3, 10), (16, 17), (17, 18)}
    b = stats.largest_block_stats(g).first()
    assert (b.nodes, b.edges) == (6, 7)  # 4..9, whose least edge comes before that of 10..15
    c = stats.count_blocks(g, 4).first()
    assert (c.blocks, c.blocks_of_size, c.largest) == (9, 3, 7)
    r = stats.speedup_report(g, [(3, 8), (5, 9)]).orderBy("u").collect()
    assert [x.n for x in r] == [10, 6] and r[0].speedup_100 == pytest.approx(1 / ((10 / 20) * 1.0 * (23 / 43)))


def test_states_and_streams(spark, tmp_path):
    g = Graph.from_list(spark, edges(BCC7))
    state = incremental.SourceState(g)
    d = got(state.insert(0, 6), "delta")
    want = brandes(edges(BCC7) + [(0, 6)])
    assert {k: BC[BCC7][k] + d.get(k, 0) for k in want} == pytest.approx(want)
    assert sorted(map(tuple, state.table.collect())) == sorted(map(tuple, traverse.all_pairs(state.graph).collect()))
    events = spark.createDataFrame([(1, "+", 0, 6), (2, "-", 3, 4)], "seq long, op string, u long, v long")
    after = [e for e in edges(BCC7) if e != (3, 4)] + [(0, 6)]
    live = replay(g, events)
    assert got(live.bc) == pytest.approx(brandes(after))
    live.apply(events, 0)  # known already
    assert got(live.bc) == pytest.approx(brandes(after))
    from graphloom.streaming.edges import LiveBetweenness

    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    home, arriving = f"file://{tmp_path}/home", spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    streamed = LiveBetweenness(g, home=home)
    streamed.start(arriving, str(tmp_path / "ck")).awaitTermination(120)
    assert got(streamed.bc) == pytest.approx(brandes(after))
    # a driver that starts again: the state is taken up, known batches are not applied twice, new ones are
    spark.createDataFrame([(3, "-", 0, 6), (4, "+", 3, 4)], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = LiveBetweenness(Graph.from_list(spark, []), home=home)
    assert again.done == 0 and got(again.bc) == pytest.approx(brandes(after))
    again.apply(events, 0)
    again.start(arriving, str(tmp_path / "ck")).awaitTermination(120)
    assert again.done == 1 and got(again.bc) == pytest.approx(brandes(edges(BCC7)))
    assert sorted(x.name for x in (tmp_path / "home").iterdir()) == ["after-0", "after-1"]
    # a state without its mark, of a driver that was lost while it wrote, doesn't count
    (tmp_path / "home" / "after-1" / "complete").unlink()
    assert LiveBetweenness(g, home=home).done == 0


def test_experiments(spark, tmp_path):
    from graphloom.experiments import compare, paper_experiment, update_experiment

    path = tmp_path / "toy.net"
    path.write_text(f"20 23\n" + "\n".join(f"{a} {b}" for a, b in edges(TOY)))
    (out,) = update_experiment(spark, f"0\n2, 1, 7\n0, 0, 1\n0, 1, 0, 0\n{path}\n")
    assert out["graph"] == "toy.net" and len(out["edges"]) == 2 and out["bc"].count() == 20
    assert {x["method"] for x in compare(Graph.from_list(spark, edges(BCC7)), [(0, 6)], sources=3)} == {"brandes", "by_blocks", "update_graph", "update_bcc", "update_muc"}
    names = lambda settings: [(x["method"], x["sources"]) for x in paper_experiment(spark, f"{settings}\n{path}\n")["toy.net"]]
    assert names("1, 5, 0.0, 3\n1, 1, 1, 1") == [("brandes", 5), ("update_graph", 5), ("static_part", 5), ("update_muc", 5), ("update_bcc", 5)]
    assert names("1, 5, 1e9, 3\n1, 0, 0, 1") == [("brandes", None), ("update_graph", 5), ("update_bcc", None)]
    assert names("1, -1, 0.0, 3\n0, 1, 0, 0") == [("brandes", None), ("static_part", None)]


def test_static_parts_differ_by_the_change(spark):
    g = Graph.from_list(spark, edges(TOY))
    for how in ("muc", "bcc"):
        after, before = (got(incremental.part_betweenness(g, 3, 8, how, edge_in=x)) for x in (True, False))
        want = got(incremental.delta(g, 3, 8, "insert", how), "delta")
        assert {k: after[k] - before[k] for k in after} == pytest.approx({k: want.get(k, 0) for k in after}, abs=1e-9)
    assert incremental.part_betweenness(g, 0, 1).count() == 0
    assert incremental.explain(g, 3, 8, "insert").near <= incremental.explain(g, 3, 8, "insert").sources
