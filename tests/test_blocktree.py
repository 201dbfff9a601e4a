"""The tree of blocks after insertions against a decomposition of the graph that they give."""

import random

import numpy as np
import pytest
from graphs import random_graph

from graphloom.graph import Graph
from graphloom.operators import kernel
from graphloom.operators.blocks import Decomposition
from graphloom.operators.blocktree import BlockTree


def recomputed(edges, ids):
    """Blocks as sets of edges, branches by (least edge of the block, vertex), and the parts of vertices."""
    u, v = np.array(sorted(edges)).reshape(-1, 2).T
    d = Decomposition.of(kernel.Csr.of(np.array(sorted(ids)), u, v))
    found, names = {}, d.g.ids
    for b, x, y in zip(d.block.tolist(), names[d.u].tolist(), names[d.v].tolist()):
        found.setdefault(b, set()).add((x, y))
    branches = {(min(found[b]), int(names[x]), n) for b, x, n in zip(d.branch_block.tolist(), d.branch_vertex.tolist(), d.branch_size.tolist())}
    return sorted(map(sorted, found.values())), branches, dict(zip(names.tolist(), names[d.regions()].tolist()))


def kept_up(tree):
    found = tree.blocks()
    sets = {}
    for r in found.edges.collect():
        sets.setdefault(r.top, set()).add((r.u, r.v))
    branches = {(min(sets[r.top]), r.id, r.n) for r in found.branches.collect()}
    return sorted(map(sorted, sets.values())), branches, {r.id: r.muc_id for r in tree.parts.collect()}


def follow(spark, edges, ids, inserted, every):
    """Inserts one edge after another and compares after so many, and at the end."""
    tree = BlockTree(Graph.of(spark.createDataFrame(sorted(edges), "a long, b long"), spark.createDataFrame([(i,) for i in sorted(ids)], "id long")))
    now, names = set(edges), set(ids)
    assert kept_up(tree) == recomputed(now, names)
    for k, (a, b) in enumerate(inserted):
        tree.insert(a, b)
        if a != b:
            now.add((min(a, b), max(a, b)))
            names |= {a, b}
        if k % every == every - 1 or k == len(inserted) - 1:
            assert kept_up(tree) == recomputed(now, names), (k, a, b)
    return tree


def forest(n, seed):
    """Several trees with some blocks in them, and vertices without edges; names are shuffled."""
    r = random.Random(seed)
    name = list(range(n))
    r.shuffle(name)
    e = [(k, r.randrange(max(0, k - 6), k)) for k in range(1, n) if k % 17]
    e += [(k, k - 3) for k in range(5, n, 11)]
    return {(min(name[a], name[b]), max(name[a], name[b])) for a, b in e if a != b}


def test_fifty_insertions_in_a_row(spark):
    r = random.Random(3)
    edges = forest(120, 1)
    follow(spark, edges, range(124), [(r.randrange(126), r.randrange(126)) for _ in range(50)], 25)


@pytest.mark.parametrize("seed", range(2))
def test_every_insertion(spark, seed):
    n, e = random_graph(seed)
    r = random.Random(seed)
    edges = {(min(x), max(x)) for i, x in enumerate(e) if i % 3 and x[0] != x[1]}
    follow(spark, edges, range(n), [(r.randrange(n + 2), r.randrange(n + 2)) for _ in range(6)], 1)


def test_a_tree_is_hung_by_a_vertex_deep_in_it(spark):
    # 20 has children before and after the way to 24, as have 22 and 23
    deep = {(20, 21), (20, 22), (20, 30), (22, 25), (22, 23), (22, 31), (23, 26), (23, 24), (23, 32), (24, 33), (30, 31)}
    large = {(k, k + 1) for k in range(15)} | {(3, 5), (9, 12)}
    follow(spark, deep | large, set(range(16)) | set(range(20, 27)) | set(range(30, 34)), [(24, 7), (26, 14), (33, 0)], 1)


def test_what_changes_nothing_and_an_empty_graph(spark):
    tree = follow(spark, {(0, 1), (1, 2), (0, 2), (2, 3)}, range(5), [(0, 1), (2, 2), (1, 0)], 3)
    assert tree.edges.count() == 4
    tree = BlockTree(Graph.from_list(spark, []))
    tree.insert(5, 3)
    tree.insert(3, 9)
    tree.insert(9, 5)
    assert sorted(map(tuple, tree.blocks().edges.select("u", "v").collect())) == [(3, 5), (3, 9), (5, 9)]
    assert {tuple(r) for r in tree.parts.collect()} == {(3, 3), (5, 3), (9, 3)}
