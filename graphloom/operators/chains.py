"""Dependencies in graphs with long chains: runs of vertices with two neighbours between others.

A search goes over the vertices at the ends of chains only, along arcs as long as their chains. What lies inside a chain
is reached from one end or the other, up to a place that follows from the distances of both; dependencies there are
sums of weights up to that place. A source inside a chain takes the place of that chain with the two parts of it.

A source inside a chain that is so near to one end that the shortest paths to the other one leave by way of it has the
shortest paths of that end, but to the vertices of its own chain. Such sources take one search with the end together:
dependencies are sums over targets, so targets are weighted by the number of sources, and those of the own chain that
are reached by way of the other end are weights of that end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .kernel import Csr

_FAR = np.int32(1 << 29)


def _arcs(start: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Places of all arcs that leave the given vertices."""
    n = start[some + 1] - start[some]
    stop = np.cumsum(n)
    return np.arange(stop[-1]) + np.repeat(start[some] - stop + n, n)


@dataclass
class Chains:
    """Ends are vertices without just two neighbours, by number; chains of length 1 are edges between ends."""

    n: int
    ends: np.ndarray  # places of the ends
    a: np.ndarray  # of each chain of length 2 and more: its first and last end, by number
    b: np.ndarray
    length: np.ndarray
    at: np.ndarray  # where its places begin: one for the first end, then its vertices inside
    inside: np.ndarray  # places of the vertices, -1 for the first end
    up_to: np.ndarray  # weights inside the chain, up to and with each place
    weight: np.ndarray  # of all vertices
    edges: Csr  # between ends
    begin: np.ndarray  # where each arc of it begins
    start: np.ndarray  # chains from the k-th end: to[start[k]:start[k + 1]], with their lengths and numbers
    to: np.ndarray
    far: np.ndarray
    chain: np.ndarray
    of: np.ndarray  # of each vertex: its chain, -1 for ends
    place: np.ndarray  # of each vertex: its place in the chain, or the number of the end

    @staticmethod
    def of_graph(g: Csr, weight: np.ndarray) -> Chains | None:
        """None where fewer than half of the vertices are inside chains, or a chain begins and ends at one vertex."""
        degree = np.diff(g.start)
        inner = degree == 2
        ends = np.flatnonzero(~inner)
        if len(ends) < 2 or 2 * len(ends) > len(g):
            return None
        number = np.full(len(g), -1)
        number[ends] = np.arange(len(ends))
        first, now = g.out(ends)
        last, one, steps = first.copy(), np.arange(len(first)), []
        length, goal = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        while len(one):  # a step along all chains at once
            length[one] += 1
            over = ~inner[now]
            goal[one[over]] = now[over]
            one, last, now = one[~over], last[~over], now[~over]
            steps.append((one, now))
            last, now = now, g.to[g.start[now]] + g.to[g.start[now] + 1] - last
        if (goal == first).any():
            return None
        long = np.flatnonzero((length > 1) & (first < goal))
        at = np.cumsum(length[long]) - length[long]
        row = np.full(len(first), -1)
        row[long] = np.arange(len(long))
        total = int(length[long].sum())
        inside, of, place = np.full(total, -1), np.full(len(g), -1), number.copy()
        for k, (one, now) in enumerate(steps, 1):
            own = row[one] >= 0
            inside[at[row[one[own]]] + k] = now[own]
            of[now[own]], place[now[own]] = row[one[own]], k
        if (of[inner] < 0).any():
            return None
        a, b, size = number[first[long]], number[goal[long]], length[long]
        up_to = np.zeros(total)
        for j in range(len(long)):
            own = slice(at[j] + 1, at[j] + size[j])
            np.cumsum(weight[inside[own]], out=up_to[own])
        edge = length == 1
        edges = Csr.of(np.arange(len(ends)), number[first[edge]], number[goal[edge]])
        apart = np.append(True, np.diff(edges.to) != 0) if len(edges.to) else np.empty(0, bool)  # each edge came from both ends
        apart[edges.start[:-1][np.diff(edges.start) > 0]] = True
        begin = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(edges.start))[apart]
        edges = Csr(edges.ids, np.searchsorted(begin, np.arange(len(ends) + 1)), edges.to[apart].astype(np.int32))
        s, t, chain = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(long)), 2)
        order = np.argsort(s, kind="stable")
        start = np.searchsorted(s[order], np.arange(len(ends) + 1))
        far = np.tile(size, 2)[order].astype(np.int32)
        return Chains(len(g), ends, a, b, size, at, inside, up_to, weight, edges, begin, start, t[order], far, chain[order], of, place)

    def nearest(self, sources: np.ndarray) -> np.ndarray:
        """By number, the nearer end of the chain of each source, its first where both are as near; ends themselves."""
        own, place = self.of[sources], self.place[sources]
        inner = own >= 0
        out, c = place.copy(), own[inner]
        out[inner] = np.where(2 * place[inner] <= self.length[c], self.a[c], self.b[c])
        return out

    def tasks_of(self, sources: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of the sources that has those of one nearest end together, and where in it tasks begin, of fewer than
        2 * most each. Ends with fewer sources than most are not shared by tasks."""
        end = self.nearest(sources)
        order = np.lexsort((sources, end))
        end = end[order]
        begin = np.arange(0, len(order), most)
        first = np.searchsorted(end, end[begin])
        return order, np.unique(np.where(begin - first < most, first, begin))

    def dependencies_of(self, sources: np.ndarray, times: np.ndarray) -> np.ndarray:
        """As kernel.dependencies_of."""
        self.far = self.far.copy()  # changed for a while where a source is inside a chain
        at_ends, total, through = np.zeros(len(self.ends)), np.zeros(self.n), np.zeros(len(self.a))
        sums = [np.zeros(len(self.up_to)) for _ in range(4)]
        end = self.nearest(sources)
        order = np.argsort(end, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(end[order])) + 1):
            if len(some):
                self._add_near(int(end[some[0]]), sources[some], times[some], at_ends, total, through, sums)
        total[self.ends] += at_ends
        for size in np.unique(self.length).tolist():
            rows = np.flatnonzero(self.length == size)
            where = self.at[rows, None] + np.arange(size)
            up, (va, na, vb, nb) = self.up_to[where], (np.cumsum(x[where][:, ::-1], axis=1)[:, ::-1] for x in sums)
            back = up[:, -1:] - up[:, ::-1]  # the same weights from the last end
            here = (va - up * na) + through[rows, None]
            here[:, 1:] += (vb - back * nb)[:, :0:-1]
            total[self.inside[where[:, 1:]]] += here[:, 1:]
        return total

    def _searched(self, dist: np.ndarray, sigma: np.ndarray, begun: list[tuple[int, int]]) -> list[tuple]:
        """Fills in distances and path counts from ends that are begun at some distance; arcs of the shortest paths."""
        waits, dag = np.full(len(dist), _FAR), []
        for x, d in begun:
            dist[x] = waits[x] = d
        while (now := waits.min()) < _FAR:
            front = np.flatnonzero(waits == now)
            waits[front] = _FAR
            for x, d in begun:
                if d == now and dist[x] == now:
                    sigma[x] += 1.0
            arc = _arcs(self.edges.start, front)
            t = self.edges.to[arc]
            reach = dist[t]
            back = np.flatnonzero(reach == now - 1)
            p, q = self.begin[arc[back]], t[back]
            new = t[reach > now + 1]
            dist[new] = waits[new] = now + 1
            arc = _arcs(self.start, front)
            s, t, far = np.repeat(front, self.start[front + 1] - self.start[front]), self.to[arc], self.far[arc]
            reach = dist[t]
            back = np.flatnonzero(reach + far == now)
            dag.append((p, q, s[back], t[back], self.chain[arc[back]]))
            sigma += np.bincount(p, sigma[q], len(dist)) + np.bincount(s[back], sigma[t[back]], len(dist))
            new = np.flatnonzero(reach > now + far)
            np.minimum.at(dist, t[new], now + far[new])
            waits[t[new]] = dist[t[new]]
        return dag

    def _halves(self, dist: np.ndarray, sigma: np.ndarray, count: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Weights inside each chain that are reached by way of its first and its last end, counted into sums so often."""
        a, b, size, at, up = self.a, self.b, self.length, self.at, self.up_to
        h = dist[b] - dist[a] + size  # twice the place where both ways are as long
        na, nb = np.clip((h - 1) // 2, 0, size - 1), np.clip((2 * size - h - 1) // 2, 0, size - 1)
        half = h // 2
        tie = np.flatnonzero((h % 2 == 0) & (half > 0) & (half < size))
        fa, fb = up[at + na], up[at + size - 1] - up[at + size - 1 - nb]
        both = up[at[tie] + half[tie]] - up[at[tie] + half[tie] - 1]
        part = both * sigma[a[tie]] / (sigma[a[tie]] + sigma[b[tie]])
        fa[tie] += part
        fb[tie] += both - part
        for x, where, values in ((0, at + na, fa), (2, at + nb, fb)):
            sums[x][where] += count * values
            sums[x + 1][where] += count
        return fa, fb

    def _back(self, dag: list[tuple], sigma: np.ndarray, delta: np.ndarray, w: np.ndarray, k: float, through: np.ndarray) -> None:
        """Adds to delta, along the arcs of the shortest paths, what is behind; targets at the ends have the weights w."""
        n = len(delta)
        for p, q, x, y, chain in reversed(dag):
            share = np.divide(w + delta, sigma, out=np.zeros(n), where=sigma > 0)
            flow = sigma[y] * share[x]
            through[chain] += k * flow  # a chain is passed one way only
            delta += np.bincount(q, sigma[q] * share[p], n) + np.bincount(y, flow, n)

    def _add_near(self, e: int, sources: np.ndarray, times: np.ndarray, at_ends: np.ndarray, total: np.ndarray, through: np.ndarray, sums: list[np.ndarray]) -> None:
        """Sources of which e is the nearest end."""
        n, own = len(self.ends), self.of[sources]
        inner = own >= 0
        first = self.a[own] == e  # of no meaning where the source is e itself
        hops = np.where(inner, np.where(first, self.place[sources], self.length[own] - self.place[sources]), 0)
        goal, size = np.where(first, self.b[own], self.a[own]), self.length[own]
        alone = inner & (2 * hops + 1 >= size)  # the other end is one hop away or more
        if not alone.all():
            dist, sigma = np.full(n, _FAR), np.zeros(n)
            dag = self._searched(dist, sigma, [(e, 0)])
            alone |= inner & (2 * hops + dist[goal] >= size)
            w, k = self.weight[self.ends], float(times[~alone].sum())
            some = np.flatnonzero(inner & ~alone)
            if k:
                count = np.full(len(self.a), k)
                np.subtract.at(count, own[some], times[some])
                fa, fb = self._halves(dist, sigma, count, sums)
                delta = np.bincount(self.a, count * fa, n) + np.bincount(self.b, count * fb, n)
                behind = w.sum() - w[e] + fa.sum() + fb.sum()
                over = 0.0  # dependencies of the sources inside chains on e
                for c in np.unique(own[some]).tolist():
                    mine = some[own[some] == c]
                    far = self._within(c, e, hops[mine], times[mine], dist, sigma, w[e] + behind - fa[c] - fb[c], total)
                    delta[goal[mine[0]]] += times[mine] @ far
                    over += times[mine] @ (behind - fa[c] - fb[c] + far)
                self._back(dag, sigma, delta, k * w, 1.0, through)
                delta[e] = over
                at_ends += delta
        for s, k in zip(sources[alone].tolist(), times[alone].tolist()):
            self._add(s, k, at_ends, total, through, sums)

    def _within(self, c: int, e: int, hops: np.ndarray, times: np.ndarray, dist: np.ndarray, sigma: np.ndarray, behind: float, total: np.ndarray) -> np.ndarray:
        """Dependencies inside chain c of sources in it, so many hops from its end e, by way of which they reach all but
        some of c; behind: the weights from e on, without c. Gives the weights in c that each reaches by its other end."""
        own = slice(self.at[c] + 1, self.at[c] + self.length[c])
        way, goal = (self.inside[own], int(self.b[c])) if self.a[c] == e else (self.inside[own][::-1], int(self.a[c]))
        up = np.concatenate([[0.0], np.cumsum(self.weight[way])])  # up[p]: of the first p vertices from e
        size, h = int(self.length[c]), int(self.length[c] + dist[goal])  # h: twice the hops at which both ways are as long
        found, far = np.zeros(size), np.zeros(len(hops))
        for j, (i, k) in enumerate(zip(hops.tolist(), times.tolist())):
            m, q = min((h - 1) // 2, size - i - 1), max(0, (2 * (size - i) - h - 1) // 2)
            near, back = up[i + m] - up[i], up[-1] - up[size - 1 - q]
            if h % 2 == 0 and h // 2 < size - i:
                both = up[i + h // 2] - up[i + h // 2 - 1]
                near += both / (1.0 + sigma[goal])
                back += both * sigma[goal] / (1.0 + sigma[goal])
            found[1:i] += k * (up[: i - 1] + behind + back)
            found[i + 1 : i + m + 1] += k * (near - (up[i + 1 : i + m + 1] - up[i]))
            found[size - q :] += k * (back - (up[-1] - up[size - q - 1 : -1]))
            far[j] = back
        total[way] += found[1:]
        return far

    def _add(self, s: int, k: float, at_ends: np.ndarray, total: np.ndarray, through: np.ndarray, sums: list[np.ndarray]) -> None:
        """A source inside a chain, by itself."""
        n, own, i = len(self.ends), int(self.of[s]), int(self.place[s])
        dist, sigma, w = np.full(n, _FAR), np.zeros(n), self.weight[self.ends]
        a, b, size, at = int(self.a[own]), int(self.b[own]), int(self.length[own]), int(self.at[own])
        arcs = np.concatenate([self.start[e] + np.flatnonzero(self.chain[self.start[e] : self.start[e + 1]] == own) for e in (a, b)])
        self.far[arcs] = _FAR
        dag = self._searched(dist, sigma, [(a, i), (b, size - i)])
        self.far[arcs] = size
        count = np.full(len(self.a), float(k))
        count[own] = 0.0
        fa, fb = self._halves(dist, sigma, count, sums)
        fa[own] = fb[own] = 0.0
        delta = np.bincount(self.a, fa, n) + np.bincount(self.b, fb, n)
        sides = [(a, i, self.inside[at + 1 : at + i][::-1]), (b, size - i, self.inside[at + i + 1 : at + size])]
        for e, far, way in sides:  # from the source out to an end
            up = np.concatenate([[0.0], np.cumsum(self.weight[way])])
            h = int(dist[e]) + far
            m, q = min((h - 1) // 2, far - 1), max(0, min((2 * far - h - 1) // 2, far - 1))
            near, back = up[m], up[-1] - up[far - 1 - q]
            if h % 2 == 0 and 0 < h // 2 < far:
                both = up[h // 2] - up[h // 2 - 1]
                near += both / (1.0 + sigma[e])
                back += both * sigma[e] / (1.0 + sigma[e])
            delta[e] += back
            total[way[:m]] += k * (near - up[1 : m + 1])
            if q:
                total[way[far - 1 - q :]] += k * (back - (up[-1] - up[far - 1 - q : far - 1]))
        self._back(dag, sigma, delta, w, k, through)
        for e, far, way in sides:
            if dist[e] == far:
                total[way] += k * (w[e] + delta[e]) / sigma[e]
        at_ends += k * delta
