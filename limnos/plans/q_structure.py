"""Queries over bottom structure, plans, sun and moon."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import astro
from limnos.operators import planning, structure
from limnos.plans.registry import query
from limnos.plans.surrogates import LEGS, POINTS, legs, metres, points, table

LEVELS = f"{POINTS}, lv AS (SELECT id, 1 AS w, lon / 10 AS lon, lat / 10 + 30 AS lat, CAST(floor(depth / 3) * 3 AS DOUBLE) AS lev FROM points)"


def levels(spark, sf_dir):
    """The points drawn together, at depths of three feet."""
    return points(spark, sf_dir).select("id", F.lit(1).alias("w"), (F.col("lon") / 10).alias("lon"), (F.col("lat") / 10 + 30).alias("lat"), (F.floor(F.col("depth") / 3) * 3).cast("double").alias("lev"))


@query(f"""WITH {LEVELS}, l AS (SELECT DISTINCT lev FROM lv), s AS (SELECT a.lev AS d1, min(b.lev) AS d2 FROM l a JOIN l b ON b.lev - a.lev >= 5 GROUP BY a.lev),
 n AS (SELECT a.id, a.lon, a.lat, d1, d2, min({metres('a.lon', 'a.lat', 'b.lon', 'b.lat')}) AS m FROM lv a JOIN s ON a.lev = d1 JOIN lv b ON b.lev = d2 AND {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 400 GROUP BY ALL)
 SELECT CAST(trunc(lon / 0.0008) AS BIGINT) AS i, CAST(trunc(lat / 0.0008) AS BIGINT) AS j, round(max((d2 - d1) / (greatest(m, 5) / 30.48)), 4) AS slope FROM n GROUP BY 1, 2""")
def struct_ledges(spark, sf_dir):
    return structure.ledges(levels(spark, sf_dir), "w", "lev").select("i", "j", F.round("slope", 4).alias("slope"))


@query(f"""WITH {POINTS}, h AS (SELECT id, grp, depth AS relief, id % 4 + 1 AS levels, 0.4 + id % 50 AS acres FROM points)
 SELECT id, round(100 * (0.45 * (relief / max(relief) OVER w) + 0.35 * (levels / max(levels) OVER w) + 0.20 * (acres / max(acres) OVER w)), 1) AS score FROM h WINDOW w AS (PARTITION BY grp)""")
def struct_hump_scores(spark, sf_dir):
    h = points(spark, sf_dir).select("id", "grp", F.col("depth").alias("relief"), (F.col("id") % 4 + 1).alias("levels"), (0.4 + F.col("id") % 50).alias("acres"))
    return structure.score_humps(h, "grp").select("id", "score")


@query(f"""WITH {POINTS}, h AS (SELECT id, grp, round(id * 17 + depth * 20) AS s, depth AS d FROM points),
 b AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR s - lag(s) OVER w > 120 THEN 1 ELSE 0 END AS x FROM h WINDOW w AS (PARTITION BY grp ORDER BY s)),
 g AS (SELECT *, sum(x) OVER (PARTITION BY grp ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM b), a AS (SELECT grp, min(s) AS lo, max(s) AS hi, min(d) AS d, count(*) AS n FROM g GROUP BY grp, k)
 SELECT grp, CASE WHEN hi - lo >= 250 AND n >= 4 THEN 'dock_line' WHEN n > 1 THEN 'dock_cluster' ELSE 'dock' END AS kind, CASE WHEN hi - lo >= 250 AND n >= 4 THEN lo ELSE (lo + hi) / 2 END AS s, d, n, CAST(hi - lo AS BIGINT) AS span_m FROM a""")
def struct_dock_groups(spark, sf_dir):
    h = points(spark, sf_dir).select("grp", F.round(F.col("id") * 17 + F.col("depth") * 20).alias("s"), F.col("depth").alias("d"))
    return structure.dock_groups(h, "grp", "s", "d")


@query("""WITH p AS (SELECT p_partkey, p_size AS own, p_size + p_partkey % 20 AS deepest, p_size - p_partkey % 7 AS shallowest FROM part)
 SELECT p_partkey, CASE WHEN deepest - own >= 15 THEN 'channel_edge' WHEN deepest - shallowest <= 4 THEN 'flat' WHEN shallowest <= 2 AND deepest - shallowest >= 8 THEN 'steep_bank' ELSE 'break' END AS edge FROM p""")
def struct_edge_classes(spark, sf_dir):
    k, own = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", structure.classify_edge(own, own + k % 20, own - k % 7).alias("edge"))


#: Great-circle metres between two points of a DuckDB row.
ARC = "2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * power(sin(radians({2} - {0}) / 2), 2))))"


@query(f"""WITH RECURSIVE {POINTS}, v AS (SELECT grp, id, lon / 50 AS x, lat / 50 + 33 AS y, 'Ramp ' || id % 7 AS name, id % 9 = 0 AS fuel, 's' || id % 3 AS source, row_number() OVER (PARTITION BY grp ORDER BY id) AS i FROM points),
 w AS (SELECT grp, i, id, id AS leader, [{{'id': id, 'x': x, 'y': y, 'f': fuel}}] AS kept FROM v WHERE i = 1 UNION ALL SELECT v.grp, v.i, v.id, coalesce(c.lead, v.id), CASE WHEN c.lead IS NULL THEN list_append(w.kept, {{'id': v.id, 'x': v.x, 'y': v.y, 'f': v.fuel}}) ELSE w.kept END
  FROM w JOIN v ON v.grp = w.grp AND v.i = w.i + 1, LATERAL (SELECT list_filter(w.kept, lambda k: k.f = v.fuel AND sqrt(power((v.x - k.x) * cos(radians(k.y)) * 111320.0, 2) + power((v.y - k.y) * 110540.0, 2)) <= 150)[1].id AS lead) c),
 g AS (SELECT w.grp, leader, arg_min(name, (-length(name), name)) AS name, list_sort(list_distinct(list(name))) AS names, array_to_string(list_sort(list_distinct(list(source))), '+') AS sources, count(*) AS n FROM w JOIN v USING (grp, id) GROUP BY ALL)
 SELECT grp, leader, name, list_filter(names, lambda x: x <> name) AS aliases, sources, n FROM g""")
def struct_collapse(spark, sf_dir):
    p = points(spark, sf_dir)
    r = p.select("grp", "id", (F.col("lon") / 50).alias("lon"), (F.col("lat") / 50 + 33).alias("lat"), F.concat(F.lit("Ramp "), (F.col("id") % 7).cast("string")).alias("name"), F.when(F.col("id") % 9 == 0, "fuel_dock").otherwise("boat_ramp").alias("kind"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    return structure.collapse(r, "grp", "id")


@query(f"""WITH RECURSIVE {POINTS}, v AS (SELECT grp, id, lon / 20 AS x, lat / 20 + 32 AS y, 'cove' || id % 5 AS n, row_number() OVER (PARTITION BY grp ORDER BY id) AS i FROM points),
 w AS (SELECT grp, i, id, [{{'x': x, 'y': y, 'n': n}}] AS kept, true AS new FROM v WHERE i = 1 UNION ALL SELECT v.grp, v.i, v.id, CASE WHEN c.new THEN list_append(w.kept, {{'x': v.x, 'y': v.y, 'n': v.n}}) ELSE w.kept END, c.new FROM w JOIN v ON v.grp = w.grp AND v.i = w.i + 1,
  LATERAL (SELECT len(list_filter(w.kept, lambda k: sqrt(power(v.y - k.y, 2) + power(v.x - k.x, 2)) < 0.006 OR (sqrt(power(v.y - k.y, 2) + power(v.x - k.x, 2)) < 0.02 AND k.n = v.n))) = 0 AS new) c) SELECT grp, id FROM w WHERE new""")
def struct_first_wins(spark, sf_dir):
    r = points(spark, sf_dir).select("grp", "id", (F.col("lon") / 20).alias("lon"), (F.col("lat") / 20 + 32).alias("lat"), F.concat(F.lit("Cove "), (F.col("id") % 5).cast("string"), F.lit(" Ramp")).alias("name"))
    return structure.first_wins(r, "grp", "id", structure.same_launch, ["lon", "lat", "name"], "grp int, id long, lon double, lat double, name string, leader long").where("id = leader").select("grp", "id")


LEAVE = [ARC.format(f"p.x{a}", f"p.y{a}", f"l.u{b}", f"l.v{b}") for b in (0, 1) for a in (0, 1)]


@query(f"""WITH RECURSIVE {LEGS}, l AS (SELECT grp, id, lon AS u0, lat AS v0, lon2 AS u1, lat2 AS v1, lon2 AS x0, lat2 AS y0, lon AS x1, lat AS y1, row_number() OVER (PARTITION BY grp ORDER BY id) AS i FROM legs),
 w AS (SELECT grp, i, {ARC.format('-81.0', '34.0', 'u0', 'v0')} AS c0, {ARC.format('-81.0', '34.0', 'u1', 'v1')} AS c1, [false] AS p0, [true] AS p1 FROM l WHERE i = 1
  UNION ALL SELECT grp, i, least(a, b), least(c, d), list_append(CASE WHEN a <= b THEN p0 ELSE p1 END, false), list_append(CASE WHEN c <= d THEN p0 ELSE p1 END, true) FROM (SELECT l.grp, l.i, w.p0, w.p1, w.c0 + {LEAVE[0]} AS a, w.c1 + {LEAVE[1]} AS b, w.c0 + {LEAVE[2]} AS c, w.c1 + {LEAVE[3]} AS d FROM w JOIN l ON l.grp = w.grp AND l.i = w.i + 1 JOIN l p ON p.grp = w.grp AND p.i = w.i)),
 e AS (SELECT w.grp, w.c0 + {ARC.format('x0', 'y0', '-81.0', '34.0')} AS a, w.c1 + {ARC.format('x1', 'y1', '-81.0', '34.0')} AS b, p0, p1 FROM w JOIN (SELECT grp, max(i) AS i FROM l GROUP BY grp) m USING (grp, i) JOIN l USING (grp, i))
 SELECT l.grp, l.id, CASE WHEN a <= b THEN p0[l.i] ELSE p1[l.i] END AS flipped, round(least(a, b), 3) AS total_m FROM l JOIN e USING (grp)""")
def plan_orient_legs(spark, sf_dir):
    leg = legs(spark, sf_dir).select("grp", "id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2", F.lit(-81.0).alias("launch_lon"), F.lit(34.0).alias("launch_lat"))
    return planning.orient_legs(leg, "grp", "id")


@query()
def plan_search_order(spark, sf_dir):
    kinds = F.filter(F.array(F.when(F.col("id") % 2 == 0, "dock"), F.when(F.col("id") % 3 == 0, "ledge"), F.when(F.col("id") % 5 == 0, "hump")), lambda k: k.isNotNull())
    return planning.search_order(points(spark, sf_dir).select("grp", "id", "depth", kinds.alias("kinds"), (F.col("depth") > 8).alias("relief")), "grp", "id")


@query()
def plan_tours(spark, sf_dir):
    p = points(spark, sf_dir).select("grp", "id", "lon", "lat", F.lit(-81.0).alias("home_lon"), F.lit(34.0).alias("home_lat"))
    return planning.tours(p, "grp", "id")


@query(f"""WITH RECURSIVE {POINTS}, v AS (SELECT grp, id, lon AS x, lat AS y, row_number() OVER (PARTITION BY grp ORDER BY depth DESC, id) AS i FROM points),
 w AS (SELECT grp, i, id, [{{'x': x, 'y': y}}] AS kept, true AS new FROM v WHERE i = 1 UNION ALL SELECT v.grp, v.i, v.id, CASE WHEN c.new THEN list_append(w.kept, {{'x': v.x, 'y': v.y}}) ELSE w.kept END, c.new FROM w JOIN v ON v.grp = w.grp AND v.i = w.i + 1,
  LATERAL (SELECT len(w.kept) < 10 AND len(list_filter(w.kept, lambda k: {ARC.format('k.x', 'k.y', 'v.x', 'v.y')} < 12000)) = 0 AS new) c) SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY i) AS rank FROM w WHERE new""")
def plan_spaced_picks(spark, sf_dir):
    return planning.spaced_picks(points(spark, sf_dir), "grp", "id", "depth", 12_000, 10)


@query(f"""WITH {LEGS}, d AS (SELECT grp, id, round({metres('lon', 'lat', 'lon2', 'lat2')}) AS m, 1.0 + id % 3 AS mph FROM legs)
 SELECT grp, id, round(sum(m) OVER w, 2) AS at_m, round(360 + sum(m / 1609.34 / mph * 60) OVER w, 4) AS done_minute, round(sum(5.0 * power(mph / 2.0, 1.756) * (m / 1609.34) / mph) OVER w, 5) AS amp_hours FROM d WINDOW w AS (PARTITION BY grp ORDER BY id ROWS UNBOUNDED PRECEDING)""")
def plan_running_clock(spark, sf_dir):
    from limnos.functions import geo

    leg = legs(spark, sf_dir).select("grp", "id", F.round(geo.equirect_m("lon", "lat", "lon2", "lat2")).alias("m"), (1.0 + F.col("id") % 3).alias("mph"))
    return planning.assemble(leg, "grp", "id", "m", "mph", 360).select("grp", "id", F.round("at_m", 2).alias("at_m"), F.round("done_minute", 4).alias("done_minute"), F.round("amp_hours", 5).alias("amp_hours"))


SUN = """o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, (o_orderkey % 24)::DOUBLE AS h FROM orders), a AS (SELECT *, date_diff('day', DATE '2000-01-01', day) - 0.5 + h / 24 AS d FROM o),
 b AS (SELECT *, radians(357.529 + 0.98560028 * d) AS g, radians(23.439 - 0.00000036 * d) AS e FROM a), c AS (SELECT *, radians(280.459 + 0.98564736 * d + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS l FROM b),
 s AS (SELECT *, asin(sin(e) * sin(l)) AS de, radians((fmod(18.697374558 + 24.06570982441908 * d, 24) + -81.0 / 15) * 15) - atan2(cos(e) * sin(l), cos(l)) AS ha FROM c)"""


@query(f"""WITH {SUN} SELECT o_orderkey, round(degrees(asin(sin(radians(34.0)) * sin(de) + cos(radians(34.0)) * cos(de) * cos(ha))), 4) AS elevation,
 round(fmod(degrees(atan2(sin(ha), cos(ha) * sin(radians(34.0)) - tan(de) * cos(radians(34.0)))) + 180, 360), 3) AS azimuth FROM s""")
def sun_position(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 24).cast("double").alias("h"))
    return o.select("o_orderkey", F.round(astro.sun_elevation("day", 34.0, -81.0, "h"), 4).alias("elevation"), F.round(astro.sun_azimuth("day", 34.0, -81.0, "h"), 3).alias("azimuth"))


@query("""WITH o AS (SELECT o_orderkey, date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS d FROM orders),
 a AS (SELECT *, fmod(218.316 + 13.176396 * d, 360) AS l0, radians(fmod(134.963 + 13.064993 * d, 360)) AS m, radians(fmod(93.272 + 13.229350 * d, 360)) AS f, radians(fmod(357.528 + 0.9856003 * d, 360)) AS sm FROM o),
 b AS (SELECT *, l0 + 6.289 * sin(m) - 1.274 * sin(2 * f - m) + 0.658 * sin(2 * f) AS lam, fmod(280.460 + 0.9856474 * d, 360) + 1.915 * sin(sm) + 0.020 * sin(2 * sm) AS sun FROM a),
 c AS (SELECT *, degrees(atan2(cos(radians(23.439)) * sin(radians(lam)), cos(radians(lam)))) AS ra, fmod(lam - sun + 1080, 360) AS ph FROM b),
 e AS (SELECT *, fmod(fmod(12 - fmod(fmod(280.46061837 + 360.98564736629 * d, 360) + -81.0 - ra + 360, 360) / 15 + 24, 24) + -5 + 48, 24) AS major FROM c)
 SELECT o_orderkey, round(major, 4) AS major1, round(fmod(major + 6, 24), 4) AS minor1, CAST(floor((1 - cos(radians(ph))) / 2 * 100 + 0.5) AS INTEGER) AS illumination,
 ['new','waxing crescent','first quarter','waxing gibbous','full','waning gibbous','last quarter','waning crescent'][CAST(floor((ph + 22.5) / 45) AS INTEGER) % 8 + 1] AS name FROM e""")
def moon_periods(spark, sf_dir):
    s = astro.solunar(F.col("o_orderdate").cast("date"), -81.0, -5)
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", F.round("s.major1", 4).alias("major1"), F.round("s.minor1", 4).alias("minor1"), "s.illumination", "s.name")


#: Loops about all points by the lake their group names, of a size and depth that follow from the id; a lake is the diamond about the middle of its points.
LOOPS = """r AS (SELECT id, grp, lon AS plon, lat, depth, 0.0015 + (id % 11) * 0.0008 AS h FROM points), l AS (SELECT *, plon - h / 5 AS lon FROM r), k AS (SELECT grp, round(avg(lon), 3) AS cx, round(avg(lat), 3) AS cy FROM points GROUP BY grp),
 s AS (SELECT l.*, 2 * h * h * 111320.0 * 111320.0 * cos(radians(lat)) / 4046.86 AS acres FROM l JOIN k USING (grp) WHERE abs(lon - cx) + abs(lat - cy) < 0.4000003)"""


@query(f"""WITH {POINTS}, {LOOPS}, o AS (SELECT * FROM s WHERE acres BETWEEN 0.4 AND 500), n AS (SELECT a.id, count(*) AS n, max(abs(b.depth - a.depth)) AS r FROM o a JOIN o b ON a.grp = b.grp AND a.id <> b.id AND abs(a.plon - b.lon) + abs(a.lat - b.lat) < a.h
  AND (b.h < a.h AND b.acres < a.acres OR b.acres < a.acres OR (b.acres = a.acres AND b.id > a.id)) GROUP BY a.id)
 SELECT o.grp, o.id, CAST(coalesce(n, 0) + 1 AS BIGINT) AS levels, round(coalesce(r, 0), 4) AS relief, round(acres, 1) AS acres FROM o LEFT JOIN n USING (id)""")
def struct_humps(spark, sf_dir):
    """High spots from closed loops, the lakes' shores given."""
    p = points(spark, sf_dir)
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    lon, lat = F.col("lon"), F.col("lat")
    h = 0.0015 + (F.col("id") % 11) * 0.0008
    diamond = lambda x, y, h: F.array(v(x - h, y + 0.0), v(x + 0.0, y - h), v(x + h, y + 0.0), v(x + 0.0, y + h))
    loops = p.select("grp", "id", "depth", diamond(lon, lat, h).alias("d")).select("grp", "id", "depth", F.concat("d", F.slice("d", 1, 1)).alias("ring"))
    lakes = p.groupBy("grp").agg(F.round(F.avg("lon"), 3).alias("cx"), F.round(F.avg("lat"), 3).alias("cy"))
    shores = lakes.select("grp", diamond(F.col("cx"), F.col("cy"), F.lit(0.4000003)).alias("ring"))
    humps = structure.find_humps(loops, "grp", "id", "depth", "ring", shores)
    return humps.select("grp", "id", "levels", F.round("relief", 4).alias("relief"), F.round("acres", 1).alias("acres"))
