"""Joins at any latitude, tiled contours, bucketed upserts, pointer chases: against plain Python."""

import math
import random

import numpy as np
import pytest

from limnos.functions import kernels
from limnos.operators import entity, graph, raster, spatial
from limnos.plans import registry
from limnos.plans.surrogates import points
from limnos.streaming import feeds

SF = "/root/testdata/sf0.001"


def flat_m(a, b):
    return math.hypot((b[0] - a[0]) * math.cos(math.radians((a[1] + b[1]) / 2)) * 111_320.0, (b[1] - a[1]) * 110_570.0)


@pytest.mark.parametrize("lat", [0.0, 45.0, 70.0, -84.0, 88.9])
def test_radius_join_loses_no_pair(spark, lat):
    rng = random.Random(5)
    spread = 0.05 / max(0.02, math.cos(math.radians(lat)))
    rows = [(i, i % 3, 10 + rng.uniform(-spread, spread), lat + rng.uniform(-0.05, 0.05)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, k int, lon double, lat double")
    other = df.withColumnsRenamed({"id": "id2", "k": "k2", "lon": "lon2", "lat": "lat2"})
    want = {(a[0], b[0]) for a in rows for b in rows if flat_m(a[2:], b[2:]) <= 3000}
    got = {(r["id"], r["id2"]) for r in spatial.radius_join(df, other, ("lon", "lat"), ("lon2", "lat2"), 3000).collect()}
    assert got == want and len(want) > 150
    keyed = {(r["id"], r["id2"]) for r in spatial.radius_join(df, other, ("lon", "lat"), ("lon2", "lat2"), 3000, [("k", "k2")]).collect()}
    assert keyed == {(a, b) for a, b in want if a % 3 == b % 3}


def plain_segments(grid, level):
    """Marching squares, block by block."""
    out = []
    for j in range(grid.shape[0] - 1):
        for i in range(grid.shape[1] - 1):
            c = [((i, j), grid[j, i]), ((i + 1, j), grid[j, i + 1]), ((i + 1, j + 1), grid[j + 1, i + 1]), ((i, j + 1), grid[j + 1, i])]
            if any(np.isnan(v) for _, v in c):
                continue
            cuts = []
            for (p, u), (q, v) in zip(c, c[1:] + c[:1], strict=True):
                if (u >= level) != (v >= level):
                    t = (level - u) / (v - u)
                    cuts.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if len(cuts) == 4 and ((np.mean([v for _, v in c]) >= level) == (c[0][1] >= level)):
                out += [(cuts[0], cuts[1]), (cuts[2], cuts[3])]
            elif len(cuts) == 4:
                out += [(cuts[3], cuts[0]), (cuts[1], cuts[2])]
            elif cuts:
                out.append(tuple(cuts))
    return out


def test_iso_segments_equal_plain_ones():
    rng = np.random.default_rng(3)
    for shape in ((1, 5), (2, 2), (9, 14)):
        grid = rng.uniform(0, 10, shape)
        grid[rng.random(shape) < 0.1] = np.nan
        assert np.allclose(np.array(kernels.iso_segments(grid, 5.0)).reshape(-1, 4), np.array(plain_segments(grid, 5.0)).reshape(-1, 4))


def test_contours_by_tile_equal_whole_grids(spark):
    cells = raster.rasterize(points(spark, SF).withColumn("k", F_lit(1)), ["k"], "lon", "lat", "depth", 0.05)
    levels = [2.0, 5.0, 9.0, 1e9]
    grids = {(r["i"], r["j"]): r["mean"] for r in cells.collect()}
    i0, j0 = min(i for i, _ in grids), min(j for _, j in grids)
    grid = np.full((max(j for _, j in grids) - j0 + 1, max(i for i, _ in grids) - i0 + 1), np.nan)
    for (i, j), v in grids.items():
        grid[j - j0, i - i0] = v
    want = {}
    for level in levels:
        s = plain_segments(grid, level)
        want[level] = (len(s), len(kernels.chain_lines([list(x) for x in s])), round(sum(math.dist(*x) for x in s), 4))
    for tile in (3, 7, 256):
        got = {r["level"]: (r["segments"], r["lines"], round(r["length"], 4)) for r in raster.contours(cells, "k", "mean", levels, tile).collect()}
        assert got == want
    assert want[5.0][0] > 10


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_upserts_rewrite_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    write = feeds.upsert_into(path, ["k"], ["v"], buckets=4)
    rng, want = random.Random(2), {}
    for epoch in range(5):
        rows = [(rng.randrange(40), epoch * 100 + i, f"x{i}") for i in range(3 if epoch else 60)]
        batch = spark.createDataFrame(rows, "k long, v long, x string")
        write(batch, epoch)
        write(batch, epoch)  # a replay
        for k, v, x in rows:
            want[k] = max(want.get(k, (-1, "")), (v, x))
        assert {r["k"]: (r["v"], r["x"]) for r in feeds.current(spark, path).collect()} == want
    write(spark.createDataFrame([], "k long, v long, x string"), 5)
    assert feeds.current(spark, path).count() == len(want)
    folders = list((tmp_path / "table").glob("epoch=*/_bucket=*"))
    assert len(folders) <= 8 and len({f.name for f in folders}) == 4


def test_chase_with_cycles_and_lost_ends(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, 3), (5, 6), (6, 5), (7, 99), (8, 7), (9, 9)] + [(i, i + 1) for i in range(100, 160)] + [(160, None)]
    got = {r["id"]: (r["end"], r["steps"]) for r in graph.chase(spark.createDataFrame(rows, "id long, next long")).collect()}
    want = {1: (3, 2), 2: (3, 1), 3: (3, 0), 4: (3, 1), 5: (None, None), 6: (None, None), 7: (99, 1), 8: (99, 2), 9: (None, None)} | {i: (160, 160 - i) for i in range(100, 161)}
    assert got == want
    assert graph.chase(spark.createDataFrame([], "id long, next long")).count() == 0


def test_merge_places_of_a_common_name(spark):
    """Rows of one name far apart stay apart; the nearest within reach merges."""
    a = spark.createDataFrame([(1, "Boat Ramp", 10.0, 50.0, None), (2, "boat ramp", 11.0, 50.0, 2.0)], "id long, name string, lon double, lat double, v double")
    b = spark.createDataFrame([(7, "boat-ramp", 10.0003, 50.0, 5.0), (8, "BOAT RAMP", 10.0001, 50.0, 6.0), (9, "boat ramp", 12.0, 50.0, 7.0)], "id long, name string, lon double, lat double, v double")
    got = sorted((r["id"], r["v"], r["source"]) for r in entity.merge_places(a, b, "id", "name", ["v"]).collect())
    assert got == [(1, 6.0, "both"), (2, 2.0, "left"), (7, 5.0, "right"), (9, 7.0, "right")]


def test_spaced_picks_and_first_wins_equal_plain_loops(spark):
    rows = [r.asDict() for r in points(spark, SF).collect()]
    hav = lambda a, b: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(b["lat"] - a["lat"]) / 2) ** 2 + math.cos(math.radians(a["lat"])) * math.cos(math.radians(b["lat"])) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2))
    want = set()
    for g in {r["grp"] for r in rows}:
        picked = []
        for r in sorted((r for r in rows if r["grp"] == g), key=lambda r: (-r["depth"], r["id"])):
            if len(picked) < 10 and all(hav(r, p) >= 12_000 for p in picked):
                picked.append(r)
        want |= {(g, p["id"], i) for i, p in enumerate(picked, 1)}
    assert {tuple(r) for r in registry.QUERIES["plan_spaced_picks"](spark, SF).select("grp", "id", "rank").collect()} == want
    kept = set()
    for g in {r["grp"] for r in rows}:
        leaders = []
        for r in sorted((r for r in rows if r["grp"] == g), key=lambda r: r["id"]):
            p = (r["lon"] / 20, r["lat"] / 20 + 32, f"cove{r['id'] % 5}")
            if not any(math.hypot(p[0] - q[0], p[1] - q[1]) < (0.02 if q[2] in p[2] and len(p[2]) >= 4 else 0.006) for q in leaders):
                leaders.append(p)
                kept.add((g, r["id"]))
    assert {tuple(r) for r in registry.QUERIES["struct_first_wins"](spark, SF).collect()} == kept
