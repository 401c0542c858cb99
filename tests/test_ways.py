"""Ways over legs told from places, against Dijkstra over a table of all legs."""

import numpy as np

from limnos.functions import blocks, kernels
from limnos.operators import ways


def test_routes_equal_dijkstra_over_all_legs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = np.random.default_rng(11)
    rows = [(g, 1000 * g + k, float(x), float(y), None if k % 9 == 0 else float(d)) for g in (0, 1) for k, (x, y, d) in enumerate(np.c_[rng.normal(-81, 0.15, 160), rng.normal(34, 0.15, 160), rng.uniform(0, 10, 160)])]
    rows += [(1, 1990, -70.0, 34.0, 5.0), (1, 1991, None, 34.0, 5.0), (0, 7, rows[3][2], rows[3][3], 9.0)]
    asks = [(g, 50 * g + k, 1000 * g + a, 1000 * g + b, f) for g in (0, 1) for k, (a, b, f) in enumerate([(0, 50, 2.0), (0, 50, 9.5), (3, 3, 1.0), (17, 120, 6.0), (17, 121, 0.0), (4, 990, 1.0), (4, 991, 1.0), (5, 33, 8.0)])]
    points = spark.createDataFrame(rows, "grp int, id long, lon double, lat double, depth double").repartition(5)
    got = {r["request"]: r for r in ways.routes(points, spark.createDataFrame(asks, "grp int, request long, a long, b long, min_depth double"), "grp", 6000.0).collect()}
    assert len(got) == len(asks)
    relaxed = 0
    for g, k, a, b, floor in asks:
        own = [r for r in rows if r[0] == g and r[2] is not None]
        at = {r[1]: i for i, r in enumerate(own)}
        if a not in at or b not in at:
            assert got[k]["length"] is None and got[k]["path"] is None and not got[k]["depth_held"]
            continue
        x, y = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        d = np.hypot((x[:, None] - x) * np.cos(np.radians((y[:, None] + y) / 2)) * 111320.0, (y[:, None] - y) * 110570.0)
        arcs = [(i, j, d[i, j]) for i, j in zip(*np.nonzero(np.triu(d <= 6000, 1)), strict=True)]
        deep = [r[4] is None or r[4] >= floor for r in own]
        want = kernels.shortest_path(len(own), arcs, at[a], at[b], deep)
        held = want is not None
        want = want or kernels.shortest_path(len(own), arcs, at[a], at[b])
        r = got[k]
        assert r["depth_held"] == held
        relaxed += not held and want is not None
        if want is None:
            assert r["length"] is None and r["path"] is None
            continue
        assert abs(r["length"] - want[0]) < 1e-5
        path = [at[n] for n in r["path"]]
        assert (path[0], path[-1]) == (at[a], at[b]) and all(d[i, j] <= 6000 for i, j in zip(path, path[1:], strict=False))
        assert abs(sum(d[i, j] for i, j in zip(path, path[1:], strict=False)) - want[0]) < 1e-5
        assert not held or all(deep[i] for i in path[1:-1])
    assert relaxed


def test_no_leg_is_a_row(spark):
    """Four thousand points within one leg's reach: before, sixteen million legs were joined and shuffled."""
    n = 4000
    points = spark.range(n).selectExpr("0 as grp", "id", "-81D + id * 1e-6D as lon", "34D as lat", "cast(null as double) as depth")
    ask = spark.createDataFrame([(0, 1, 0, n - 1, 2.0)], "grp int, request long, a long, b long, min_depth double")
    (r,) = ways.routes(points, ask, "grp", 15000.0).collect()
    assert r["path"] == [0, n - 1] and r["depth_held"]
