"""Rings of small polygons are tied in tasks, without ranking; those of large ones in rounds, to the same rings."""

import numpy as np

from limnos.operators import graph, polygons

PIECES = "owner struct<a: long, b: long>, ax double, ay double, bx double, by double"


def edges(ring):
    return [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]


def rings(df):
    out = {}
    for r in df.collect():
        points = [(p["x"], p["y"]) for p in r["points"]]
        k = points.index(min(points))
        out.setdefault(tuple(r["owner"]), []).append(points[k:] + points[:k])
    return {k: sorted(v) for k, v in out.items()}


def test_rings_are_tied_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    square = lambda x, y, h: [(x, y), (x + h, y), (x + h, y + h), (x, y + h)]
    wheel = [(float(np.cos(t)), float(np.sin(t))) for t in np.linspace(0, 2 * np.pi, 700, endpoint=False)]
    want = {
        (1, 1): [square(0.0, 0.0, 1.0), square(1.0, 1.0, 1.0)],  # they touch at a corner and don't cross
        (1, 2): [square(0.0, 0.0, 3.0), square(1.0, 1.0, 1.0)[::-1]],
        (2, 1): [wheel],
        **{(3, k): [square(float(k), 0.0, 1.0)] for k in range(600)},
    }
    rows = [((a, b), *e) for (a, b), some in want.items() for r in some for e in edges(r)]
    rows += [((1, 1), 5.0, 5.0, 6.0, 5.0), ((1, 1), 6.0, 5.0, 6.0, 6.0), ((4, 0), 0.0, 0.0, 1.0, 0.0), (None, 0.0, 0.0, 1.0, 0.0)]  # lines that stay open, and nobody's
    rows = [rows[k] for k in rng.permutation(len(rows))]
    path = polygons.cut(spark.createDataFrame(rows, PIECES))
    turned = {k: sorted(r[r.index(min(r)) :] + r[: r.index(min(r))] for r in v) for k, v in want.items()}
    assert rings(polygons.rings_of(path, most=500)) == turned  # the wheel in rounds
    numbers = [(r["owner"], r["ring"]) for r in polygons.rings_of(path).collect()]
    assert len(numbers) == len(set(numbers))

    def never(*_):
        raise AssertionError("ranked in rounds")

    monkeypatch.setattr(graph, "ranked", never)
    monkeypatch.setattr(graph, "components", never)
    assert rings(polygons.rings_of(path)) == turned


def test_whole_tiles_need_no_components(spark, monkeypatch):
    """Two halves of a diamond: nothing is open, so nothing is looked through."""
    half = lambda *p: [[{"x": x, "y": y} for x, y in p]]
    rows = [(7, half((0.0, 0.0), (1.0, -1.0), (1.0, 1.0)), 0.0, -2.0, 1.0, 2.0), (7, half((1.0, -1.0), (2.0, 0.0), (1.0, 1.0)), 1.0, -2.0, 2.0, 2.0)]
    tiles = spark.createDataFrame(rows, f"id long, rings {polygons.RINGS}, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(graph, "components", lambda *_: 1 / 0)
    got = polygons.dissolve(tiles, "id", ("x0", "y0", "x1", "y1"), 0.5).collect()
    assert [(r["id"], r["part"], len(r["rings"]), len(r["rings"][0])) for r in got] == [(7, 0, 1, 4)]
