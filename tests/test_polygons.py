"""The index of polygons against the plain even-odd test, masks against centres, and overlays against sampled points and exact areas."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limnos.operators import graph, polygons, spatial

KINDS = "id long, grp long, rings array<array<struct<x: double, y: double>>>"


def crossings(rings, x, y):
    """Edges right of a point, by the plain rule."""
    return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for r in rings for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True))


def star(rng, x, y, most, corners, digits=None):
    """A ring about a point that doesn't cross itself."""
    angles = (np.arange(corners) + rng.uniform(0.02, 0.98, corners)) * 2 * np.pi / corners
    far = rng.uniform(0.3 * most, most, corners)
    ring = np.stack([x + far * np.cos(angles), y + far * np.sin(angles)], 1)
    return [tuple(map(float, p)) for p in (ring if digits is None else np.round(ring, digits))]


def arrow(shapes):
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.array([[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in shapes], pa.list_(pa.list_(point)))


@pytest.mark.parametrize("digits", [None, 1, 0])
def test_cells_decide_as_whole_rings_do(digits):
    """Also with vertices on the borders of cells, level edges, closed rings, holes, and points on vertices' heights."""
    rng = np.random.default_rng(4)
    for size in (0.1, 0.25, 0.5, 1.0, 7.0):
        shapes = []
        for k in range(12):
            x, y = rng.uniform(-3, 3, 2)
            rings = [star(rng, x, y, 2.0, int(rng.integers(3, 25)), digits)]
            if k % 2:
                rings.append([(x + (a - x) * 0.25, y + (b - y) * 0.25) for a, b in rings[0]])
            if k % 3 == 0:
                rings[0].append(rings[0][0])
            shapes.append(rings)
        rows, cells = polygons.cells_of(arrow(shapes), size)
        table = {(r, i, j): (o, f, e) for r, i, j, o, f, e in zip(rows.tolist(), *(c.to_pylist() for c in cells), strict=True)}
        assert len(table) == len(rows)
        for x, y in (rng.uniform(-6, 6, (150, 2)) if digits is None else np.round(rng.uniform(-6, 6, (150, 2)), digits)).tolist():
            for k, rings in enumerate(shapes):
                odd, flips, edges = table.get((k, int(np.floor(x / size)), int(np.floor(y / size))), (0, [], []))
                right = sum((e["ay"] > y) != (e["by"] > y) and x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"]) for e in edges)
                assert (odd + sum(v > y for v in flips) + right) % 2 == crossings(rings, x, y) % 2


def frame(spark, shapes, groups=None):
    rows = [(i, groups[i] if groups else 0, [[{"x": x, "y": y} for x, y in r] for r in rings] if rings is not None else None) for i, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, KINDS)


def test_join_and_border_cells_carry_only_their_own_edges(spark):
    rng = np.random.default_rng(9)
    ring = star(rng, 0, 0, 4.0, 400)
    shapes = [[ring], [star(rng, 1, 1, 2.0, 7)], None, []]
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-5, 5, (400, 2)))]
    got = {(r["k"], r["id"]) for r in polygons.inside(spark.createDataFrame(points, "k int, px double, py double"), frame(spark, shapes), ("px", "py"), "rings", 0.2).collect()}
    assert got == {(k, i) for k, x, y in points for i in (0, 1) if crossings(shapes[i], x, y) % 2}
    cells = polygons.index(frame(spark, shapes).where("id = 0"), "rings", 0.2)
    assert cells.agg(F.max(F.size("edges"))).first()[0] < 60 and cells.where("size(edges) = 0").count() > 50


def test_masks_are_centres_and_what_is_near(spark):
    rng = np.random.default_rng(2)
    shapes = [[star(rng, 0, 0, 1.5, 9), [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]]]
    size, reach = 0.1, 2
    filled = {(i, j) for i in range(-40, 40) for j in range(-40, 40) if crossings(shapes[0], (i + 0.5) * size, (j + 0.5) * size) % 2}
    near = {(i + a, j + b) for i, j in filled for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4}
    df = frame(spark, shapes)
    assert {(r["i"], r["j"]) for r in polygons.mask(df, "id", "rings", size).collect()} == filled
    assert {(r["i"], r["j"]) for r in polygons.mask(df, "id", "rings", size, reach).collect()} == near


def ring_area(r):
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True)) / 2


def parts_of(df, key="id"):
    out = {}
    for r in df.collect():
        rings = [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
        assert ring_area(rings[0]) > 0 and all(ring_area(h) < 0 for h in rings[1:])
        out.setdefault(r[key], []).append(rings)
    return out


def hold(parts, x, y):
    return any(crossings(p, x, y) % 2 for p in parts)


def check(spark, shapes, cutters, groups=None, cutter_groups=None, size=0.5, seed=0):
    a, b = frame(spark, shapes, groups), frame(spark, cutters, cutter_groups).withColumnRenamed("id", "cut")
    on = "grp" if groups else None
    less = parts_of(polygons.overlay(a, b, "id", "cut", size, on))
    both = parts_of(polygons.overlay(a, b, "id", "cut", size, on, common=True))
    rng = np.random.default_rng(seed)
    for i, rings in enumerate(shapes):
        mine = [c for k, c in enumerate(cutters) if not groups or cutter_groups[k] == groups[i]]
        for x, y in rng.uniform(-4.013, 4.017, (500, 2)).tolist():
            inside, gone = crossings(rings, x, y) % 2 == 1, any(crossings(c, x, y) % 2 for c in mine)
            assert hold(less.get(i, []), x, y) == (inside and not gone), (i, x, y)
            assert hold(both.get(i, []), x, y) == (inside and gone), (i, x, y)
        whole = sum(ring_area(r) for p in [[*(r if (ring_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings))]] for r in p)
        left, taken = (sum(ring_area(r) for p in side.get(i, []) for r in p) for side in (less, both))
        assert left + taken == pytest.approx(whole, abs=1e-6)
    return less, both


def test_overlays_of_random_shapes(spark):
    rng = np.random.default_rng(11)
    shapes = [[star(rng, *rng.uniform(-2, 2, 2), 1.8, int(rng.integers(3, 14)))] for _ in range(7)]
    shapes.append([star(rng, 0, 0, 3.0, 12), [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]])
    cutters = [[star(rng, *rng.uniform(-2, 2, 2), 1.2, int(rng.integers(3, 10)))] for _ in range(6)]
    check(spark, shapes, cutters, size=0.7)
    check(spark, shapes, cutters, groups=[i % 3 for i in range(8)], cutter_groups=[i % 3 for i in range(6)], size=0.4)


def square(x, y, h):
    x, y = float(x), float(y)
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]


def test_touching_edges_holes_and_copies(spark):
    """Shared edges and corners, cutters side by side, equal and nested ones, cutters in the middle, at a vertex, and over the whole."""
    shapes = [[square(0, 0, 1)], [square(2, 0, 1)], [square(0, 2, 1)], [square(-2.5, -2.5, 1)], [square(2.5, 2.5, 1)], [square(2, -2, 0.5)], [square(-2, 2, 1), square(-2, 2, 0.5)]]
    cutters = [[square(0.5, 0, 0.5)], [square(0.5, 0, 0.5)], [square(2, 0, 0.25)], [square(2.5, 0, 0.25)], [square(0, 2, 1)], [square(-4.5, -2.5, 1)], [square(-1.5, -1.5, 0.25)], [square(2.5, 2.5, 2)], [square(2, -1.25, 0.25)], [square(-2, 2, 0.5)], [square(-2, 2.75, 0.25)], [square(-0.75, -0.75, 0.25)], [square(-0.25, -0.75, 0.25)]]
    less, both = check(spark, shapes, cutters, size=0.5)
    assert 2 not in less and 4 not in less and 5 in less
    assert sorted(len(p) for p in less[1]) == [2]  # two cutters that touch make one hole
    assert less[3] and sum(ring_area(r) for p in less[3] for r in p) == pytest.approx(4 - 0.0, abs=0.3)


def test_nothing_to_cut(spark):
    a = frame(spark, [[square(0, 0, 1)], None])
    none = a.limit(0).withColumnRenamed("id", "cut")
    assert list(parts_of(polygons.overlay(a, none, "id", "cut", 0.5))) == [0]
    assert polygons.overlay(a, none, "id", "cut", 0.5, common=True).count() == 0
    assert polygons.overlay(a.limit(0), a.withColumnRenamed("id", "cut"), "id", "cut", 0.5).count() == 0


def test_lists_are_ranked(spark):
    rng = random.Random(3)
    ids = list(range(3000))
    rng.shuffle(ids)
    rows, want, at = [], {}, 0
    for n, closed in ((1, False), (1, True), (2, False), (2, True), (700, False), (1500, True), (64, True), (65, False), (300, False)):
        part, at = ids[at : at + n], at + n
        if closed:
            k = part.index(min(part))
            part = part[k:] + part[:k]
        rows += [(x, part[k + 1] if k + 1 < n else part[0] if closed else None) for k, x in enumerate(part)]
        want |= {x: (min(part), k, closed) for k, x in enumerate(part)}
    out = graph.ranked(spark.createDataFrame(rows, "id long, next long"))
    assert {r["id"]: (r["list"], r["rank"], r["closed"]) for r in out.collect()} == want


def test_polygon_join_is_the_whole_rings(spark):
    rng = np.random.default_rng(5)
    shapes = [[star(rng, *rng.uniform(-2, 2, 2), 1.5, 8)] for _ in range(20)]
    df = frame(spark, shapes)
    from limnos.functions import geo

    boxed = df.select("id", "rings", geo.bounds(F.col("rings")[0]).alias("b")).select("id", "rings", "b.*")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-3, 3, (300, 2)))], "k int, px double, py double")
    got = {(r["k"], r["id"]) for r in spatial.polygon_join(points, boxed, ("px", "py"), "rings", ("x0", "y0", "x1", "y1"), 0.3).collect()}
    assert got == {(r["k"], i) for r in points.collect() for i, s in enumerate(shapes) if crossings(s, r["px"], r["py"]) % 2}


def test_tiles_are_dissolved(spark):
    """A lake with an island over nine tiles is one ring and its hole; a pond within a tile stays; what ends at a missing tile stays as it came."""
    rng = np.random.default_rng(21)
    lake, island = star(rng, 1.5, 1.5, 1.3, 40), star(rng, 1.55, 1.45, 0.3, 11)
    pond, lost = star(rng, 0.1, 2.9, 0.08, 6), star(rng, 5.0, 0.5, 0.4, 9)
    shapes = [(1, [lake, island]), (1, [pond]), (2, [lost])]
    tiles = [(i, j) for i in range(3) for j in range(3)] + [(5, 0)]  # the western half of the lost one has no tile
    rows, squares = [], []
    for k, (owner, rings) in enumerate(shapes):
        for i, j in tiles:
            rows.append((len(rows), 0, [[{"x": x, "y": y} for x, y in r] for r in rings], owner, float(i), float(j), i + 1.0, j + 1.0))
            squares.append((len(rows) - 1, len(rows) - 1, [[{"x": float(x), "y": float(y)} for x, y in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]]))
        assert k is not None
    a = spark.createDataFrame(rows, KINDS + ", owner long, x0 double, y0 double, x1 double, y1 double")
    pieces = polygons.overlay(a, spark.createDataFrame(squares, KINDS).select("id", F.col("id").alias("cut"), "rings"), "id", "cut", 0.5, "id", common=True)
    cut = pieces.drop("part").join(a.drop("rings", "grp"), "id").select("owner", "rings", "x0", "y0", "x1", "y1")
    whole = parts_of(polygons.dissolve(cut, "owner", ("x0", "y0", "x1", "y1"), 0.5), "owner")
    sizes = sorted((len(p), round(sum(map(ring_area, p)), 6)) for p in whole[1])
    want = sorted([(2, round(abs(ring_area(lake)) - abs(ring_area(island)), 6)), (1, round(abs(ring_area(pond)), 6))])
    assert sizes == want
    assert len(whole[2]) == 1 and 0.2 * abs(ring_area(lost)) < ring_area(whole[2][0][0]) < 0.8 * abs(ring_area(lost))
