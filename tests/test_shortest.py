"""Shortest ways over a graph in rounds, against Dijkstra on the whole."""

import heapq
import random

from limnos.operators import graph


def dijkstra(near, a):
    best, queue = {a: 0.0}, [(0.0, a)]
    while queue:
        d, u = heapq.heappop(queue)
        if d > best[u]:
            continue
        for v, w in near.get(u, ()):
            if d + w < best.get(v, float("inf")):
                best[v] = d + w
                heapq.heappush(queue, (d + w, v))
    return best


def test_many_pairs_on_one_graph(spark):
    rng = random.Random(9)
    n = 150
    edges = [(i, (i * 7 + 1) % n, float(rng.randint(1, 9))) for i in range(n)] + [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 40))) for _ in range(260)]
    edges += [(n + k, n + k + 1, 0.5) for k in range(20)] + [(3, 4, None), (None, 5, 1.0), (2, 2, 0.0), (1, 8, -3.0)]
    near = {}
    for u, v, w in edges:
        if u is not None and w is not None and w >= 0:
            near.setdefault(u, []).append((v, w))
    asks = [(k, rng.choice([0, 5, 9, 77]), rng.randrange(n)) for k in range(40)] + [(90, n, n + 20), (91, n + 20, n), (92, 4, 4), (93, None, 3), (94, 0, 10_000)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(5)
    out = {r["request"]: r for r in graph.shortest(df, spark.createDataFrame(asks, "request long, a long, b long")).collect()}
    assert len(out) == len(asks)
    for k, a, b in asks:
        want = dijkstra(near, a).get(b) if a is not None else None
        r = out[k]
        assert r["length"] == want, (k, a, b)
        if want is None:
            assert r["path"] is None
            continue
        path = r["path"]
        assert (path[0], path[-1], len(path) - 1) == (a, b, r["hops"])
        assert sum(min(w for v, w in near[x] if v == y) for x, y in zip(path, path[1:], strict=False)) == want
