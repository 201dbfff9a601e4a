"""Small graphs with known results, and a plain Brandes to compare with."""

import random
from collections import defaultdict, deque

TOY = "0-1 1-2 2-3 3-0 0-4 4-5 5-6 6-7 7-8 8-4 5-9 9-8 3-10 10-11 11-12 12-13 13-14 14-15 15-10 2-16 16-17 17-18 2-19"
STAR = "0-1 0-2 1-3 2-3 3-4 3-5 3-5"
NAIVE = "0-7 7-1 0-2 0-3 0-4 0-5 6-1 6-2 6-3 6-4 6-5"
BCC7 = "0-1 0-2 1-3 2-3 3-4 3-5 4-6 5-6"
CYCLES = "0-1 0-2 1-3 2-3 3-4 4-5 4-6 5-7 6-7"
AP21 = "0-1 0-5 1-2 1-3 2-3 2-4 3-4 5-7 7-6 7-8 6-9 8-11 9-10 10-11 11-14 14-12 14-15 14-16 14-17 12-13 13-15 16-17 4-18 18-19 19-20"


def edges(text):
    return [tuple(map(int, e.split("-"))) for e in text.split()]


def brandes(pairs, vertices=()):
    adj = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    ids = set(adj) | set(vertices)
    bc = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, sigma, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w] / 2
    return bc


def random_graph(seed):
    r = random.Random(seed)
    n = r.randint(4, 14)
    e = {(r.randrange(k), k) for k in range(1, n)}
    for _ in range(r.randint(0, 8)):
        a, b = sorted(r.sample(range(n), 2))
        e.add((a, b))
    return n, sorted(e)
