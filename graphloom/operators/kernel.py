"""Array kernels on one graph in compressed rows: breadth-first search, dependencies, blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Arcs of a graph beyond which a search for dependencies keeps none of them.
SLICED = 2_000_000


@dataclass
class Csr:
    """ids in order; neighbours of the k-th are to[start[k]:start[k + 1]]."""

    ids: np.ndarray
    start: np.ndarray
    to: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> Csr:
        """From ids and edges between them, by id."""
        ids = np.unique(ids)
        n = len(ids)
        a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
        key = np.concatenate([a * n + b, b * n + a])
        del a, b
        key.sort()
        start = np.searchsorted(key, np.arange(n + 1) * n)
        return Csr(ids, start, np.remainder(key, n, out=key) if n else key)

    def __len__(self) -> int:
        return len(self.ids)

    def at(self, ids) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def out(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs that leave the given vertices."""
        n = self.start[some + 1] - self.start[some]
        ends = np.cumsum(n)
        k = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[some] - ends + n, n)
        return np.repeat(some, n), self.to[k]

    def without(self, a: int, b: int) -> Csr:
        """Without the edge between the vertices at places a and b."""
        s = np.repeat(np.arange(len(self)), np.diff(self.start))
        keep = ~(((s == a) & (self.to == b)) | ((s == b) & (self.to == a)))
        start = np.zeros(len(self) + 1, np.int64)
        np.cumsum(np.bincount(s[keep], minlength=len(self)), out=start[1:])
        return Csr(self.ids, start, self.to[keep])


def distances(g: Csr, s: int) -> np.ndarray:
    """Hops from the vertex at place s; -1 where it doesn't reach."""
    d = np.full(len(g), -1)
    d[s], front, level = 0, np.array([s]), 0
    while len(front):
        _, t = g.out(front)
        front = np.unique(t[d[t] < 0])
        level += 1
        d[front] = level
    return d


def paths(g: Csr, s: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hops, numbers of shortest paths, and by level the arcs of the shortest-path DAG."""
    d, sigma = np.full(len(g), -1), np.zeros(len(g))
    d[s], sigma[s], front, level, dag = 0, 1.0, np.array([s]), 0, []
    while True:
        a, t = g.out(front)
        d[t[d[t] < 0]] = level + 1
        new = d[t] == level + 1
        a, t = a[new], t[new]
        if not len(t):
            return d, sigma, dag
        np.add.at(sigma, t, sigma[a])
        dag.append((a, t))
        front, level = np.unique(t), level + 1


def dependencies(g: Csr, s: int, weight: np.ndarray) -> np.ndarray:
    """Brandes' dependency of s on each vertex, targets weighted; 0 at s itself."""
    if len(g.to) > SLICED:
        return _dependencies_in_slices(g, s, weight)
    _, sigma, dag = paths(g, s)
    delta = np.zeros(len(g))
    for a, t in reversed(dag):
        np.add.at(delta, a, sigma[a] / sigma[t] * (weight[t] + delta[t]))
    delta[s] = 0.0
    return delta


def _dependencies_in_slices(g: Csr, s: int, weight: np.ndarray, most: int = 500_000) -> np.ndarray:
    """The same with no arcs kept and about so many at once, so beside the graph it holds some numbers a vertex."""

    def slices(front):
        cuts = np.flatnonzero(np.diff(np.cumsum(g.start[front + 1] - g.start[front]) // most)) + 1
        for some in np.split(front, cuts):
            yield g.out(some)

    d, sigma, fronts = np.full(len(g), -1), np.zeros(len(g)), [np.array([s])]
    d[s], sigma[s] = 0, 1.0
    while len(fronts[-1]):
        level, found = len(fronts), [np.empty(0, np.int64)]
        for a, t in slices(fronts[-1]):
            found.append(np.unique(t[d[t] < 0]))
            d[found[-1]] = level
            new = d[t] == level
            np.add.at(sigma, t[new], sigma[a[new]])
        fronts.append(np.concatenate(found))
    delta = np.zeros(len(g))
    for level in range(len(fronts) - 1, 0, -1):
        for a, t in slices(fronts[level]) if len(fronts[level]) else ():
            up = d[t] == level - 1
            a, t = a[up], t[up]
            np.add.at(delta, t, sigma[t] / sigma[a] * (weight[a] + delta[a]))
    delta[s] = 0.0
    return delta


def dependencies_of(g: Csr, sources: np.ndarray, times: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the dependencies of some sources, each taken so many times. Small dense graphs as matrices, all sources
    together."""
    n, total = len(g), np.zeros(len(g))
    if n > 4096 or 20 * len(g.to) < n * n:
        for s, k in zip(sources.tolist(), times.tolist()):
            total += k * dependencies(g, s, weight)
        return total
    arc = np.zeros((n, n))
    arc[np.repeat(np.arange(n), np.diff(g.start)), g.to] = 1.0
    rows, d = np.arange(len(sources)), np.full((len(sources), n), -1, np.int32)
    sigma = np.zeros(d.shape)
    d[rows, sources], sigma[rows, sources] = 0, 1.0
    front, level = sigma, 0
    while (d < 0).any():
        front = front @ arc
        front[d >= 0] = 0.0
        new = front > 0
        if not new.any():
            break
        level += 1
        d[new] = level
        sigma = sigma + front
    delta = np.zeros(d.shape)
    for k in range(level, 1, -1):
        at = d == k
        share = np.divide(weight + delta, sigma, out=np.zeros(d.shape), where=at) @ arc
        np.multiply(sigma, share, out=delta, where=d == k - 1)
    return times @ delta


def accumulated(g: Csr, s: int, d: np.ndarray, sigma: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same from distances and path counts that are known already."""
    a = np.repeat(np.arange(len(g)), np.diff(g.start))
    on = (d[a] >= 0) & (d[g.to] == d[a] + 1)
    a, t = a[on], g.to[on]
    order = np.argsort(d[a], kind="stable")
    a, t = a[order], t[order]
    ends = np.append(np.flatnonzero(np.diff(d[a])) + 1, len(a)) if len(a) else np.empty(0, np.int64)
    delta, stop = np.zeros(len(g)), len(a)
    for begin in [*ends[:-1].tolist()[::-1], 0]:
        x, y = a[begin:stop], t[begin:stop]
        np.add.at(delta, x, sigma[x] / sigma[y] * (weight[y] + delta[y]))
        stop = begin
    delta[s] = 0.0
    return delta


def twins(g: Csr, weight: np.ndarray, apart: list[int]) -> np.ndarray:
    """For each vertex the least place with the same one or two neighbours and the same weight; its own for all others
    and those in apart. As sources, they have the same dependencies on all vertices but themselves, and none on one
    another."""
    n, out = np.diff(g.start), np.arange(len(g))
    some = np.flatnonzero((n == 1) | (n == 2))
    some = some[~np.isin(some, apart)]
    kind = np.stack([g.to[g.start[some]], g.to[g.start[some + 1] - 1], weight[some]], axis=1)
    _, first, of = np.unique(kind, axis=0, return_index=True, return_inverse=True)
    out[some] = some[first[of.ravel()]]
    return out


def labels(g: Csr) -> np.ndarray:
    """For each vertex the least place in its connected component."""
    out = np.full(len(g), -1)
    for k in range(len(g)):
        if out[k] < 0:
            front = np.array([k])
            out[k] = k
            while len(front):
                _, t = g.out(front)
                front = np.unique(t[out[t] < 0])
                out[front] = k
    return out


def _searched(g: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends u < v of every edge, the number of its biconnected component (depth-first, without recursion), and the first
    vertex of each component."""
    n = len(g)
    seen, low, up = np.full(n, -1).tolist(), [0] * n, [-1] * n
    at, end, to = g.start[:-1].tolist(), g.start[1:].tolist(), g.to.tolist()
    eu, ev, eb, held, top, clock, number = [], [], [], [], [], 0, 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        stack = [root]
        seen[root] = low[root] = clock
        clock += 1
        while stack:
            x = stack[-1]
            if at[x] < end[x]:
                y = to[at[x]]
                at[x] += 1
                if seen[y] < 0:
                    held.append((x, y))
                    up[y], seen[y], low[y] = x, clock, clock
                    clock += 1
                    stack.append(y)
                elif y != up[x] and seen[y] < seen[x]:
                    held.append((x, y))
                    low[x] = min(low[x], seen[y])
            else:
                stack.pop()
                if stack:
                    p = stack[-1]
                    low[p] = min(low[p], low[x])
                    if low[x] >= seen[p]:  # p separates what hangs below it
                        while True:
                            a, b = held.pop()
                            eu.append(min(a, b))
                            ev.append(max(a, b))
                            eb.append(number)
                            if (a, b) == (p, x):
                                break
                        top.append(p)
                        number += 1
    return np.array(eu, np.int64), np.array(ev, np.int64), np.array(eb, np.int64), np.array(top, np.int64)


def _forest(g: Csr) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a breadth-first forest, a vertex's new neighbours all by way of it."""
    seen, child, parent = np.zeros(len(g), bool), [], []
    for root in np.flatnonzero(np.diff(g.start)).tolist():
        if seen[root]:
            continue
        seen[root], front = True, np.array([root])
        while len(front):
            found = []
            ends = np.cumsum(g.start[front + 1] - g.start[front]) // 1_000_000  # bounded slices of arcs
            for some in np.split(front, np.flatnonzero(np.diff(ends)) + 1):
                a, t = g.out(some)
                new = ~seen[t]
                t, first = np.unique(t[new], return_index=True)
                seen[t] = True
                child.append(t)
                parent.append(a[new][first])
                found.append(t)
            front = np.concatenate(found)
    none = [np.empty(0, np.int64)]
    return np.concatenate(child or none), np.concatenate(parent or none)


def blocks(g: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends u < v of every edge, and the number of its biconnected component. Of dense graphs only two forests are
    searched: one of the graph, and one of what is left without it; vertices share a block of both together if they
    share one of the graph (Cheriyan, Kao and Thurimella)."""
    n = len(g)
    if len(g.to) <= 8 * n:
        return _searched(g)[:3]
    s = np.repeat(np.arange(n), np.diff(g.start))
    c, p = _forest(g)
    tree = np.sort(np.concatenate([c * n + p, p * n + c]))
    key = s * n + g.to
    out = tree[np.minimum(np.searchsorted(tree, key), len(tree) - 1)] == key
    del key
    start = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(s[~out], minlength=n), out=start[1:])
    c2, p2 = _forest(Csr(g.ids, start, g.to[~out]))
    eu, ev, eb, top = _searched(Csr.of(np.arange(n), np.concatenate([c, c2]), np.concatenate([p, p2])))
    home = np.full(n, -1)  # the block of a vertex in which it isn't the first
    for x in (eu, ev):
        below = top[eb] != x
        home[x[below]] = eb[below]
    one = s < g.to
    u, v = s[one], g.to[one]
    del s
    b = home[v]
    there = (b >= 0) & ((home[u] == b) | (top[b] == u))
    return u, v, np.where(there, b, home[u])


def branches(g: Csr, u: np.ndarray, v: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, vertex, size): how many vertices are cut off from the rest, through that block, when the vertex
    goes. A vertex is an articulation point if it has several rows."""
    pair = np.union1d(np.unique(b * len(g) + u), np.unique(b * len(g) + v))
    blk, vtx = np.divmod(pair, max(1, len(g)))
    if not len(pair):
        return blk, vtx, np.empty(0, np.int64)
    n, of_block, of_vertex = len(g), {}, {}
    for k, (x, y) in enumerate(zip(blk.tolist(), vtx.tolist())):
        of_block.setdefault(x, []).append((k, y))
        of_vertex.setdefault(y, []).append((k, x))
    comp = labels(g)
    total = np.bincount(comp, minlength=n)
    size, below, seen = np.zeros(len(pair), np.int64), np.ones(n, np.int64), np.zeros(n, bool)
    for root in np.unique(comp[vtx]).tolist():
        order, stack = [], [(root, -1)]
        seen[root] = True
        while stack:  # vertices by way of blocks
            x, by = stack.pop()
            order.append((x, by))
            for _, blk_ in of_vertex[x]:
                if blk_ != by:
                    for _, y in of_block[blk_]:
                        if y != x and not seen[y]:
                            seen[y] = True
                            stack.append((y, blk_))
        inside: dict[int, int] = {}
        for x, by in reversed(order):
            for k, blk_ in of_vertex[x]:
                if blk_ != by:
                    size[k] = inside.get(blk_, 0)
                    below[x] += size[k]
            if by >= 0:
                inside[by] = inside.get(by, 0) + int(below[x])
                size[next(k for k, z in of_vertex[x] if z == by)] = total[root] - below[x]
    return blk, vtx, size
