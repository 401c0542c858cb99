"""Sums over overlapped boxes, and rivers of boxes by them: against plain Python."""

import random

import numpy as np

from limnos.functions import dominance
from limnos.operators import binding


def random_boxes(rng, n):
    at = rng.integers(0, 40, (n, 2)) / 10
    return np.concatenate([at, at + rng.integers(0, 12, (n, 2)) / 10], 1)


def test_overlap_sums_equal_plain_ones():
    rng = np.random.default_rng(2)
    for m, n in ((0, 5), (5, 0), (7, 300), (300, 7), (257, 190), (400, 1024)):
        a, b = random_boxes(rng, m), random_boxes(rng, n)
        w = rng.integers(-1000, 1000, (2, n))
        hit = (a[:, None, 0] <= b[:, 2]) & (b[:, 0] <= a[:, None, 2]) & (a[:, None, 1] <= b[:, 3]) & (b[:, 1] <= a[:, None, 3])
        want = np.concatenate([hit.sum(1)[None], w @ hit.T.astype(int)])
        assert (dominance.overlap_sums(a, b, w) == want).all()


def test_rivers_are_summed_without_pairs(spark, monkeypatch):
    rng = random.Random(4)
    box = lambda: (lambda x, y: (x, y, x + rng.uniform(0, 0.5), y + rng.uniform(0, 0.5)))(rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5))
    boxes = [(k, *box()) for k in range(120)]
    segments = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, 0.1, 0.2, 0.3, 7.0]), *box()) for _ in range(400)]
    want = {}
    for k, *a in boxes:
        sums = {}
        for n, m, *b in segments:
            if n and m is not None and a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
                sums[n] = sums.get(n, 0) + round(10 * m)
        best = sorted(sums.items(), key=lambda x: (-x[1], x[0]))
        want |= {(k, n): (v / 10, r) for r, (n, v) in enumerate(best, 1) if r <= 3 and v >= 0.5 * best[0][1]}
    for some in (30, 10_000):
        monkeypatch.setattr(binding, "BOX_PART", some)
        monkeypatch.setattr(binding, "SEGMENT_PART", some)
        out = binding.rivers_of(spark.createDataFrame(boxes, "box long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(segments, "name string, len double, tx0 double, ty0 double, tx1 double, ty1 double"), "box", "name", "len", 0.2, 0.5, 3)
        got = {(r["box"], r["name"]): (round(r["length"], 9), r["rank"]) for r in out.collect()}
        assert got == want
        # Boxes and segments don't meet as rows of a join.
        assert "CoGroup" in out._jdf.queryExecution().optimizedPlan().toString()


def test_polygons_count_soundings_without_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from limnos.operators import polygons

    rng = random.Random(9)
    points = [(k, rng.choice([0, 1, 2]), rng.gauss(0, 0.2), rng.gauss(0, 0.2)) for k in range(600)] + [(600, None, 0.0, 0.0), (601, 1, None, 0.0)]
    shapes = []
    for k in range(60):
        x, y, h = rng.gauss(0, 0.2), rng.gauss(0, 0.2), rng.choice((0.03, 0.2, 0.5))
        ring = [(x - h, y - h / 3), (x, y - h / 5), (x + h, y - h), (x + h / 2, y), (x + h, y + h), (x - h / 4, y + h / 2)]
        shapes.append((k, [ring] + ([[(x - h / 9, y - h / 9), (x + h / 9, y - h / 9), (x, y + h / 9)]] if k % 2 else [])))
    p = spark.createDataFrame(points, "id long, grp int, lon double, lat double")
    s = spark.createDataFrame(shapes, "poly long, rings array<array<struct<x: double, y: double>>>")
    want = {(r["grp"], r["poly"]): r["n"] for r in polygons.inside(p, s, ("lon", "lat"), "rings", 0.1).where("grp is not null").groupBy("grp", "poly").agg(F.count("*").alias("n")).collect()}
    for size, cell in ((20, 0.1), (5000, 1.0)):
        monkeypatch.setattr(binding, "POLYGON_PART", size)
        monkeypatch.setattr(binding, "SOUNDING_PART", size)
        out = binding.holds_most(p, s, "grp", "poly", cell)
        got = {r["grp"]: (r["poly"], r["inside"], r["total"]) for r in out.collect()}
        for g in (0, 1, 2):
            n, k = min((-n, k) for (h, k), n in want.items() if h == g)
            assert got[g] == (k, -n, sum(q[1] == g for q in points))
        assert got[None] == (None, 0, 1) and "CoGroup" in out._jdf.queryExecution().optimizedPlan().toString()
