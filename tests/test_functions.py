"""Scalars, kernels, sources and operators without a SQL oracle, against plain Python."""

import gzip
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.functions import geo, kernels, numbers
from limnos.operators import entity, graph, planning, raster, sequence, spatial, structure, text
from limnos.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances(spark):
    ft = one(spark, geo.haversine(F.lit(34.0), F.lit(-81.0), F.lit(34.0), F.lit(-81.0)))
    assert ft == 0
    mi = one(spark, geo.miles(F.lit(40.7128), F.lit(-74.0060), F.lit(34.0522), F.lit(-118.2437)))
    assert abs(mi - 2445) < 5
    assert one(spark, geo.haversine_or_inf(F.lit(float("nan")), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == math.inf
    to = one(spark, geo.destination(F.lit(34.0), F.lit(-81.0), F.lit(90.0), F.lit(5280.0)))
    assert abs(one(spark, geo.miles(F.lit(34.0), F.lit(-81.0), F.lit(to["lat"]), F.lit(to["lon"]))) - 1) < 1e-6
    assert one(spark, geo.angle_between(F.lit(350.0), F.lit(20.0))) == 30
    assert one(spark, geo.head_wind(F.lit(0.0), F.lit(None).cast("double"), F.lit(5.0))) == 0


@pytest.mark.parametrize(
    ("text_", "want"),
    [("34.5", 34.5), ("34 30 0", 34.5), ("34° 30.0' N", 34.5), ("81°15'0\" W", -81.25), ("-81.5", -81.5), ("S 10.25", -10.25), ("none", math.nan)],
)
def test_coordinates(spark, text_, want):
    got = one(spark, geo.parse_coordinate(F.lit(text_)))
    assert math.isnan(got) if math.isnan(want) else abs(got - want) < 1e-9


def ring(*xy):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy))


def test_rings(spark):
    square, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))
    assert one(spark, geo.shoelace(square)) == 100
    assert one(spark, geo.in_polygon(F.lit(1.0), F.lit(1.0), F.array(square, hole)))
    assert not one(spark, geo.in_polygon(F.lit(5.0), F.lit(5.0), F.array(square, hole)))
    c = one(spark, geo.area_centroid(square))
    assert (c["area"], c["x"], c["y"]) == (100, 5, 5)
    km2 = one(spark, geo.spherical_area_km2(ring((0, 0), (1, 0), (1, 1), (0, 1))))
    assert abs(km2 - 12363.7) < 5
    line = ring((0, 0), (0, 1), (1, 1))
    at = one(spark, geo.point_at(line, geo.cumulative_m(line), F.lit(geo.M_LAT_POINT / 2)))
    assert abs(at["y"] - 0.5) < 1e-9 and at["x"] == 0


def test_numbers(spark):
    got = [one(spark, numbers.leading_number(F.lit(t))) for t in ("5-8", "12 in", "null", "", "-3.5x", "about 4")]
    assert got == [7.0, 12.0, None, None, -3.5, None]
    assert one(spark, numbers.number_or_null(F.lit(" "))) is None and one(spark, numbers.grouped_number(F.lit("1,923.38"))) == 1923.38
    assert [one(spark, numbers.js_round(F.lit(x))) for x in (0.5, -0.5, 2.5, -1.6)] == [1, 0, 3, -2]
    assert [one(spark, numbers.tri_state(F.lit(x).cast("double"))) for x in (None, 0.0, 0.2)] == ["unknown", "no", "yes"]
    assert one(spark, numbers.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert [one(spark, numbers.minutes_of(F.lit(t))) for t in ("06:30", "24:00", "x")] == [390, None, None]
    assert one(spark, sequence.longest_run(F.array(*map(F.lit, [30.0] * 6 + [4.0, 4.0] + [30.0] * 4)), F.lit(22))) == 6
    assert one(spark, sequence.knots_value(F.lit(5.0), [(0, 1.0), (10, 0.0)])) == 0.5


def test_rdp_and_overlap():
    rng = np.random.default_rng(1)
    xy = np.cumsum(rng.normal(size=(300, 2)), 0)
    keep = kernels.rdp_keep(xy, 1.0)
    kept = np.flatnonzero(keep)
    for a, b in zip(kept, kept[1:], strict=False):
        d, rel = xy[b] - xy[a], xy[a : b + 1] - xy[a]
        t = np.clip(rel @ d / (d @ d), 0, 1)
        assert np.hypot(*(rel - t[:, None] * d).T).max() <= 1.0 + 1e-9
    a = [np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)]
    assert kernels.sampled_overlap(a, a)[:2] == (100, 100)
    small = [np.array([(3, 3), (6, 3), (6, 6), (3, 6)], float)]
    got = kernels.sampled_overlap(small, a)
    assert got[0] == 100 and abs(got[1] - 9) < 2
    runs = kernels.scanline_runs([a[0], small[0]], 1.0)
    assert sum(b - a + 1 for _, a, b in runs) == 100 - 9


def test_chains_and_contours():
    pieces = [[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(5, 5), (6, 5)], [(2, 0), (3, 1)]]
    assert sorted(map(len, kernels.chain_lines(pieces))) == [2, 4]
    y, x = np.mgrid[0:20, 0:20]
    segments = kernels.iso_segments(-np.hypot(x - 9.5, y - 9.5), -5.0)
    lines = kernels.chain_lines([list(s) for s in segments])
    length = sum(np.hypot(*np.diff(np.array(s), axis=0)[0]) for s in segments)
    assert len(lines) == 1 and abs(length - 2 * np.pi * 5) < 0.6


def test_routes_relax_and_report(spark):
    e = [(1, a, b, 1.0, d) for a, b, d in ((0, 1, 9.0), (1, 0, 9.0), (1, 2, 1.0), (2, 1, 9.0), (2, 3, 9.0), (3, 2, 1.0))]
    edges = spark.createDataFrame(e, "grp int, src long, dst long, weight double, depth double")
    ask = spark.createDataFrame([(1, 7, 0, 3, 5.0), (1, 8, 0, 3, 0.5)], "grp int, request long, a long, b long, min_depth double")
    got = {r["request"]: r for r in graph.routes(edges, ask, "grp").collect()}
    assert got[7]["path"] == [0, 1, 2, 3] and not got[7]["depth_held"] and got[8]["depth_held"] and got[8]["length"] == 3


def test_chase_knows_cycles_and_strays(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 99)], "id long, next long")
    got = {r["id"]: (r["end"], r["steps"]) for r in graph.chase(p).collect()}
    assert got == {1: (3, 2), 2: (3, 1), 3: (3, 0), 4: (None, None), 5: (None, None), 6: (99, 1)}


def test_tour_and_orientation():
    rng = np.random.default_rng(2)
    pts, home = rng.normal(0, 0.05, (6, 2)) + [-81, 34], np.array([-81.0, 34.0])
    order, total = planning.tour(pts, home)
    assert sorted(order) == list(range(6))
    # Ten stops on a circle: the heuristic finds the circle.
    angle = np.arange(10) * 2 * np.pi / 10
    circle = np.stack([np.cos(angle), np.sin(angle)], 1) * 0.1 + [-81, 34]
    order, total = planning.tour(circle[rng.permutation(10)], np.array([-80.88, 34.0]))
    assert total < 2 * np.pi * 0.1 * 112_000
    starts, ends = rng.normal(0, 0.05, (5, 2)) + [-81, 34], rng.normal(0, 0.05, (5, 2)) + [-81, 34]
    flipped, best = planning.orient(starts, ends, home)
    from itertools import product

    def cost(f):
        at, s = home, 0.0
        for i, x in enumerate(f):
            a, b = (ends[i], starts[i]) if x else (starts[i], ends[i])
            s, at = s + planning._metres(at, a), b
        return s + planning._metres(at, home)

    assert abs(best - min(map(cost, product((0, 1), repeat=5)))) < 1e-6 and abs(cost(flipped) - best) < 1e-6
    far = np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0.0]])
    assert planning.farthest_first(3, lambda i: far[i]) == [1, 2, 0]


def test_tour_of_many_stops_has_no_better_turn():
    rng = np.random.default_rng(8)
    pts, home = np.stack([rng.uniform(-81, -80, 60), rng.uniform(33, 34, 60)], 1), np.array([-80.5, 33.5])
    order, total = planning.tour(pts, home)
    stops = [home, *pts[order], home]
    hop = planning._metres
    assert sorted(order) == list(range(60)) and abs(total - sum(hop(a, b) for a, b in zip(stops, stops[1:], strict=False))) < 1e-3
    for i in range(1, 60):
        for j in range(i + 1, 61):
            assert hop(stops[i - 1], stops[i]) + hop(stops[j], stops[j + 1]) <= hop(stops[i - 1], stops[j]) + hop(stops[i], stops[j + 1]) + 1e-6


def test_greedy_first_wins(spark):
    rows = [(1, i, 0.0, 34.0 + i * 0.001, f"n{i}", "boat_ramp", "a") for i in range(4)] + [(1, 9, 0.0, 34.0, "fuel", "fuel_dock", "b")]
    df = spark.createDataFrame(rows, "grp int, id long, lon double, lat double, name string, kind string, source string")
    got = {r["leader"]: r["n"] for r in structure.collapse(df, "grp", "id").collect()}
    # 111 m apart: 0 takes 1, then 2 takes 3; the chain does not join them all.
    assert got == {0: 2, 2: 2, 9: 1}


def test_resolution_stops_at_an_ambiguous_pass(spark):
    q = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "k int, exact string, loose string")
    r = spark.createDataFrame([(10, "a", "q"), (11, "b", "y"), (12, "b", "w"), (13, "n", "z")], "id int, name string, alias string")
    got = {x["k"]: (x["id"], x["pass"]) for x in entity.resolve(q, r, "k", "id", [(F.col("exact"), F.col("name")), (F.col("loose"), F.col("alias"))]).collect()}
    assert got == {1: (10, 0), 2: (None, 0), 3: (13, 1)}


def test_chunks_cover_the_text(spark):
    body = "\n\n".join("word " * 60 for _ in range(40))
    at = text.chunk_offsets(body, 1200, 100)
    assert at[0][0] == 0 and at[-1][1] == len(body) and all(b - a <= 1200 for a, b in at)
    assert all(n[0] == max(a[1] - 100, a[0] + 1) for a, n in zip(at, at[1:], strict=False))
    assert text.chunk_offsets("") == []


def test_erosion_and_dilation(spark):
    cells = spark.createDataFrame([(1, i, j) for i in range(5) for j in range(5)], "k int, i long, j long")
    assert raster.erode(cells, ["k"]).count() == 9 and raster.dilate(cells, ["k"]).count() == 49


def test_simplify_in_spark(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (2.0, 2.0)],)], "line array<struct<x:double,y:double>>")
    got = df.select(spatial.simplify(0.1)("line").alias("l")).first()["l"]
    assert [(p["x"], p["y"]) for p in got] == [(0, 0), (2, 0), (2, 2)]


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"depth_dm": d}, "geometry": {"type": "LineString", "coordinates": [[-81.0, 34.0, 5], [-81.1, 34.1, 5]]}} for d in (10, 20)]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(doc))
    (tmp_path / "in/b.json.gz").write_bytes(gzip.compress(json.dumps(doc).encode()))
    df = readers.read_geojson(spark, str(tmp_path / "in"), "depth_dm int")
    assert df.count() == 4 and df.agg(F.sum("depth_dm")).first()[0] == 60
    readers.to_geojson(df, "coordinates", "LineString", ["depth_dm"]).write.text(str(tmp_path / "out"))
    assert readers.read_geojson(spark, str(tmp_path / "out"), "depth_dm int", lines=True).agg(F.sum("depth_dm")).first()[0] == 60
    assert one(spark, F.size(readers.line_of(F.array(F.array(F.lit(1.0), F.lit(2.0)))))) == 1


def test_feeds(spark, tmp_path):
    (tmp_path / "a.rdb").write_text("# note\nsite_no\tp50_va\n15s\t12n\n01\t7.5\n02\t\n")
    rows = readers.read_rdb(spark, str(tmp_path / "a.rdb")).select("site_no", numbers.number_or_null("p50_va").alias("v")).collect()
    assert [(r["site_no"], r["v"]) for r in rows] == [("01", 7.5), ("02", None)]
    (tmp_path / "a.gpx").write_text('<gpx><wpt lat="34.5" lon="-81.25"><name>Hump</name><sym>Fish</sym></wpt></gpx>')
    assert tuple(readers.read_gpx(spark, str(tmp_path / "a.gpx")).first()) == ("Hump", "Fish", 34.5, -81.25)
    (tmp_path / "a.kml").write_text("<kml><Placemark><name>Run</name><LineString><coordinates>-81,34,0 -81.5,34.5,0</coordinates></LineString></Placemark></kml>")
    line = readers.read_kml(spark, str(tmp_path / "a.kml")).first()["line"]
    assert [(p["x"], p["y"]) for p in line] == [(-81, 34), (-81.5, 34.5)]
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""q"", y\nz"\n')
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), "a int, b string").first()["b"] == 'x "q", y\nz'
    xml = "<rss><item><title><![CDATA[Lake &amp; fish]]></title><link>http://x</link><pubDate>now</pubDate></item></rss>"
    assert tuple(one(spark, text.rss_items(F.lit(xml)))[0]) == ("Lake & fish", "http://x", "now")


def test_binary_sources(spark, tmp_path):
    ring_ = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    wkb = struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in ring_)
    multi_z = struct.pack("<BII", 1, 1005, 1) + struct.pack("<BII", 1, 1002, 2) + struct.pack("<6d", 1, 2, 9, 3, 4, 9)
    blob = b"GP\0" + bytes([0b0011]) + struct.pack("<i", 4326) + b"\0" * 32 + wkb
    df = spark.createDataFrame([(blob,)], "b binary").select(readers.gpkg_wkb("b").alias("w"))
    assert bytes(df.first()["w"]) == wkb
    rows = spark.createDataFrame([(wkb,), (multi_z,), (b"\x01",), (None,)], "b binary").select(readers.decode_wkb("b").alias("g")).collect()
    assert rows[0]["g"]["kind"] == "polygon" and [(p["x"], p["y"]) for p in rows[0]["g"]["parts"][0][0]] == ring_
    assert rows[1]["g"]["kind"] == "line" and [(p["x"], p["y"]) for p in rows[1]["g"]["parts"][0][0]] == [(1, 2), (3, 4)]
    assert rows[2]["g"]["kind"] is None and rows[3]["g"]["kind"] is None
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.bin").write_bytes(readers.pack_graph([(-81.0, 34.0, 5), (-81.5, 34.25, 7)], [(0, 1)]))
    (tmp_path / "g/b.bin").write_bytes(b"\0" * 40)
    nodes = readers.read_graphs(spark, str(tmp_path / "g"), "nodes").orderBy("id").collect()
    assert [(r["lon"], r["lat"], r["depth"]) for r in nodes] == [(-81.0, 34.0, 5), (-81.5, 34.25, 7)]
    assert [(r["src"], r["dst"]) for r in readers.read_graphs(spark, str(tmp_path / "g"), "edges").collect()] == [(0, 1)]


def test_layers_replace_their_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "layers")
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "v int, slug string, layer int")
    readers.write_layers(df, path, ["slug", "layer"])
    readers.write_layers(spark.createDataFrame([(9, "b", 1)], df.schema), path, ["slug", "layer"])
    assert sorted((r["slug"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]


def test_verdicts(spark):
    rows = [(100.0, 100.0, 1.0), (100.0, 1.0, 0.01), (95.0, 60.0, 0.6), (60.0, 50.0, 0.9), (5.0, 5.0, 0.9)]
    df = spark.createDataFrame(rows, "a double, b double, r double").select(spatial.overlap_verdict("a", "b", "r").alias("v"))
    assert [tuple(r["v"]) for r in df.collect()] == [("same outline", True), ("within, sizes unlike", False), ("within, sizes alike", True), ("heavy overlap", True), ("touching", False)]


def test_exact_overlap():
    square = lambda x, y, s: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)
    assert np.allclose(kernels.exact_overlap([square(0, 0, 10)], [square(5, 0, 10)]), (100, 100, 50))
    assert np.allclose(kernels.exact_overlap([square(0, 0, 10), square(4, 4, 2)], [square(0, 0, 10)]), (96, 100, 96))
    assert kernels.exact_overlap([square(0, 0, 1)], [square(5, 5, 1)])[2] == 0
    diamond = np.array([(5, -5), (15, 5), (5, 15), (-5, 5)], float)
    assert np.allclose(kernels.exact_overlap([square(0, 0, 10)], [diamond])[2], 100)
    rng = np.random.default_rng(4)
    for _ in range(5):
        a, b = ([np.stack([np.cos(t), np.sin(t)], 1) * rng.uniform(0.5, 1.5, (9, 1)) + rng.normal(0, 0.3, 2)] for t in (np.arange(9) * 2 * np.pi / 9,) * 2)
        area = kernels.exact_overlap(a, b)
        grid = np.stack(np.meshgrid(*(np.linspace(-2.5, 2.5, 801),) * 2), -1).reshape(-1, 2)
        assert abs(area[2] - (kernels.inside(grid, a) & kernels.inside(grid, b)).mean() * (5 * 801 / 800) ** 2) < 0.03


def test_pulled_string():
    path = np.array([(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)], float)
    assert kernels.pull_string(path, lambda p: True, 0.1) == [0, 4]
    assert kernels.pull_string(path, lambda p: p[1] > 0.4 or abs(p[0] - round(p[0] / 4) * 4) < 0.5, 0.1) == [0, 1, 3, 4]


def test_albers_round_trip(spark):
    df = spark.createDataFrame([(-81.0, 34.0), (-96.0, 23.0), (-120.5, 47.25)], "lon double, lat double")
    p = df.withColumn("p", geo.albers("lon", "lat")).withColumn("b", geo.inverse_albers(F.col("p.x"), F.col("p.y"))).collect()
    assert all(abs(r["b"]["lon"] - r["lon"]) < 1e-9 and abs(r["b"]["lat"] - r["lat"]) < 1e-7 for r in p)
    assert abs(p[1]["p"]["x"]) < 1e-6 and abs(p[1]["p"]["y"]) < 1e-6


def test_sides(spark):
    pts = spark.createDataFrame([(1, -81.0, 34.001), (2, -81.0, 33.999), (3, -70.0, 34.0)], "id long, lon double, lat double")
    seg = spark.createDataFrame([(1, -81.002, 34.0, -80.998, 34.0)], "seg int, ax double, ay double, bx double, by double")
    assert {r["id"]: r["side"] for r in spatial.side_of(pts, seg, "id", 500).collect()} == {1: 1, 2: -1}


def test_shapes_and_tables(spark, tmp_path):
    fields = [(b"NAME", 6), (b"N", 3)]
    head = 32 + 32 * len(fields) + 1
    dbf = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 2, head, 10) + b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(dbf + b" " + b"Lake  " + b"  7" + b"*" + b"gone  " + b"  8")
    rows = readers.read_dbf(spark, str(tmp_path / "a.dbf")).collect()
    assert [(r["row"], r["fields"]) for r in rows] == [(0, {"NAME": "Lake", "N": "7"})]
    xy = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<I4dII", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<I", 0) + b"".join(struct.pack("<dd", *p) for p in xy)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body + struct.pack(">II", 2, 2) + struct.pack("<I", 0))
    shapes = readers.read_shapes(spark, str(tmp_path / "a.shp")).orderBy("row").collect()
    assert [(p["x"], p["y"]) for p in shapes[0]["rings"][0]] == xy and shapes[1]["rings"] == []
    way = spark.createDataFrame([("Hump", "Fish", 34.5, -81.25)], "name string, sym string, lat double, lon double")
    readers.write_gpx(way, str(tmp_path / "gpx"))
    assert tuple(readers.read_gpx(spark, str(tmp_path / "gpx")).first()) == ("Hump", "Fish", 34.5, -81.25)
    (tmp_path / "s.json").write_text('{"name": "x", "units": "ft", "values": [[0, 1.5, 0], [3600000, null, 0]]}')
    got = readers.read_series(spark, str(tmp_path / "s.json")).collect()
    assert [(r["unit"], r["value"]) for r in got] == [("ft", 1.5), ("ft", None)]


def test_exact_overlaps_of_many_pairs(spark):
    from limnos.operators import spatial

    rng = np.random.default_rng(5)

    def polygon():
        turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 7)))
        outer = rng.uniform(0, 3, 2) + np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(0.5, 2)
        return [outer] if rng.random() < 0.7 else [outer, outer.mean(0) + (outer - outer.mean(0)) * 0.4]

    pairs = [(polygon(), polygon()) for _ in range(300)]
    pairs += [(p, p) for p, _ in pairs[:9]]
    said = lambda p: [[(float(x), float(y)) for x, y in r] for r in p]
    df = spark.createDataFrame([(i, said(a), said(b)) for i, (a, b) in enumerate(pairs)] + [(999, None, said(pairs[0][0]))], "id int, a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>")
    got = {r["id"]: (r["a_in_b"], r["b_in_a"], r["ratio"]) for r in spatial.exact_overlaps(df, "a", "b", ["id"]).collect()}
    assert got.pop(999) == (0, 0, 0)
    for i, (a, b) in enumerate(pairs):
        na, nb, both = kernels.exact_overlap(a, b)
        assert np.allclose(got[i], (100 * both / na, 100 * both / nb, min(na, nb) / max(na, nb)), atol=1e-9)
