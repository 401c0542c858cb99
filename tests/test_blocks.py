"""Kernels on blocks and the joins on them, against all pairs at once."""

import numpy as np

from limnos.functions import blocks
from limnos.operators import binding, spatial


def test_pairs_are_counted_not_made(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(y)) for g, lat in ((0, 34.0), (1, 0.0), (2, 70.0)) for x, y in np.c_[rng.normal(-81, 0.05, 700), rng.normal(lat, 0.05, 700)]] + [(3, -81.0, 34.0), (0, None, 34.0)]
    want = {}
    for g in range(3):
        x, y = np.array([r[1:] for r in rows if r[0] == g and r[1] is not None]).T
        d = np.hypot((x[:, None] - x) * np.cos(np.radians((y[:, None] + y) / 2)) * 111320.0, (y[:, None] - y) * 110570.0)
        want[g] = int(np.triu(d <= 6000, 1).sum())
        monkeypatch.setattr(blocks, "BLOCK", 32)
        assert (blocks.count_within(x, y, x, y, 6000.0) - len(x)) // 2 == want[g]
    got = spatial.near_counts(spark.createDataFrame(rows, "grp int, lon double, lat double"), "grp", ("lon", "lat"), 6000.0)
    assert {r["grp"]: r["pairs"] for r in got.collect()} == want


def test_near_blocks_are_not_looked_at(monkeypatch):
    x = np.random.default_rng(2).normal(0, 0.001, 4000)
    looked = []
    monkeypatch.setattr(blocks, "flat", lambda *a: looked.append(a))
    assert blocks.count_within(x, x, x, x, 6000.0) == 16_000_000 and not looked


def test_overlapped(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(3)
    box = lambda n, half: np.hstack([c := rng.normal(0, 1, (n, 2)).round(2), c]) + np.array([-half, -half, half, half])
    a, b = box(400, 0.05), np.vstack([box(60, 0.05), box(5, 0.3)])
    b[0] = a[0] = (5, 5, 6, 6)
    ids, other = np.arange(400), np.concatenate([[0], np.arange(1000, 1064)])
    meet = (a[:, None, 0] <= b[:, 2]) & (b[:, 0] <= a[:, None, 2]) & (a[:, None, 1] <= b[:, 3]) & (b[:, 1] <= a[:, None, 3])
    meet[0, 0] = False
    assert (blocks.overlapped(a, ids, b, other) == meet.any(1)).all() and 0 < meet.any(1).sum() < 400


def flat(x, y, u, v):
    return np.hypot((u - x[:, None]) * np.cos(np.radians((v + y[:, None]) / 2)) * 111320.0, (v - y[:, None]) * 110570.0)


def test_dams_meet_waters_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(5)
    some = lambda n, k: [(i, float(x), float(y), None if i % k == 0 else float(d)) for i, (x, y, d) in enumerate(np.c_[rng.normal(-81, 0.08, n).round(3), rng.normal(34, 0.08, n).round(3), rng.integers(-1, 30, n)])]
    dams, waters = [*some(150, 4), (900, None, 34.0, 1.0), (901, float("nan"), 34.0, 1.0)], [*some(260, 5), (901, -81.5, 34.0, None)]
    df = binding.bind_by_drainage(spark.createDataFrame(dams, "dam long, lon double, lat double, drainage double"), spark.createDataFrame(waters, "water int, wlon double, wlat double, wdrainage double"), "dam", "water", 7000, 0.1)
    got = {r["dam"]: (r["water"], r["verdict"], r["km"]) for r in df.collect()}
    want = {}
    for k, x, y, d in dams[:-2]:
        m = flat(np.array([x]), np.array([y]), np.array([w[1] for w in waters]), np.array([w[2] for w in waters]))[0]
        off = [abs(d - w[3]) / max(d, w[3]) if d is not None and d > 0 and w[3] is not None and w[3] > 0 else None for w in waters]
        best = min(((o is None, o or 0.0, round(far, 6), w[0]) for o, far, w in zip(off, m, waters, strict=True) if far <= 7000), default=None)
        if best:
            want[k] = (best[3], "position only" if best[0] else "confirmed" if best[1] <= 0.1 else "refused", round(best[2] / 1000, 3))
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and all(abs(got[k][2] - want[k][2]) < 0.0015 for k in want)
    assert {v[1] for v in got.values()} == {"position only", "confirmed", "refused"}


def test_stations_are_counted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(6)
    at = [(f"s{i:04}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.2, (900, 2)).round(2))]
    boxes = [(i, float(x), float(y), float(x + w), float(y + w)) for i, (x, y, w) in enumerate(np.c_[rng.normal(0, 0.3, (80, 2)).round(2), rng.choice([0.0, 0.02, 0.3], 80)])]
    df = binding.stations_of(spark.createDataFrame(boxes, "box int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([*at, (None, 0.0, 0.0), ("t", float("nan"), 0.0)], "s string, lon double, lat double"), "box", "s", 0.1, 5)
    got = {r["box"]: (r["n"], r["first"]) for r in df.collect()}
    for k, x0, y0, x1, y1 in boxes:
        own = [s for s, x, y in at if x0 <= x <= x1 and y0 <= y <= y1]
        assert got[k] == (len(own), own[:5])
