"""Queries over legs of plans: ladders, slices, passed spots, energy, days, detours, cues and confidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from limnos.operators import legs as leg_ops
from limnos.plans.registry import query
from limnos.plans.surrogates import LEGS, POINTS, SERIES, legs, metres, points, series, table


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_size END AS lo, CASE WHEN p_size % 9 <> 0 THEN p_size + p_partkey % 15 END AS hi FROM part), l AS (SELECT *, greatest(2, floor((coalesce(lo, 6) - 8) / 2.0) * 2) AS f, ceil((coalesce(hi, 40) + 8) / 2.0) * 2 AS t FROM b)
 SELECT p_partkey, CAST(f AS BIGINT) AS first, CAST(t AS BIGINT) AS last, CAST((t - f) / 2 + 1 AS INTEGER) AS n FROM l""")
def plan_depth_ladder(spark, sf_dir):
    s = F.col("p_size")
    d = leg_ops.depth_ladder(F.when(s % 9 != 0, s), F.when(s % 9 != 0, s + F.col("p_partkey") % 15))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(d, 1).alias("first"), F.element_at(d, -1).alias("last"), F.size(d).alias("n"))


@query(f"""WITH {SERIES}, a AS (SELECT user_id, list(value ORDER BY event_id) FILTER (WHERE value >= 0 AND event_type = 'view') AS s, list(value + 3 ORDER BY event_id) FILTER (WHERE event_type = 'click') AS d FROM series GROUP BY 1),
 m AS (SELECT user_id, list_sort(s)[len(s) // 2 + 1] AS lo, list_sort(d)[len(d) // 2 + 1] AS hi FROM a) SELECT user_id, coalesce(greatest(0, coalesce(hi, lo) - lo), 0)::DOUBLE AS span, lo AS low, CASE WHEN lo IS NOT NULL THEN coalesce(hi, lo) END AS high FROM m""")
def plan_optionality(spark, sf_dir):
    of = lambda kind, x: F.collect_list(F.when(F.col("event_type") == kind, x))
    by = series(spark, sf_dir).groupBy("user_id").agg(of("view", F.col("value")).alias("s"), of("click", F.col("value") + 3).alias("d"))
    o = leg_ops.optionality(F.col("s"), F.col("d"))
    return by.select("user_id", o["span"].alias("span"), o["low"].alias("low"), o["high"].alias("high"))


@query(f"""WITH RECURSIVE {POINTS}, v AS (SELECT grp, id, lon, lat, row_number() OVER (PARTITION BY grp ORDER BY id) AS i FROM points), n AS (SELECT grp, arg_min(i, ({metres('-81.0::DOUBLE', '34.0::DOUBLE', 'lon', 'lat')}, id)) AS i0, max(i) AS top FROM v GROUP BY grp),
 w AS (SELECT n.grp, 1 AS side, i0, i0 AS i, 0.0::DOUBLE AS d FROM n UNION ALL SELECT grp, -1, i0, i0, 0.0::DOUBLE FROM n
  UNION ALL SELECT w.grp, side, i0, w.i + side, w.d + {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} FROM w JOIN v a ON a.grp = w.grp AND a.i = w.i JOIN v b ON b.grp = w.grp AND b.i = w.i + side WHERE w.d < 60000 AND w.d + {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 69000),
 f AS (SELECT grp, round(max(CASE WHEN side = 1 THEN d END)) AS fore, round(max(CASE WHEN side = -1 THEN d END)) AS back FROM w GROUP BY grp)
 SELECT DISTINCT w.grp, v.id, round(w.d, 3) AS at_m FROM w JOIN f ON f.grp = w.grp AND w.side = CASE WHEN fore >= back THEN 1 ELSE -1 END JOIN v ON v.grp = w.grp AND v.i = w.i""")
def plan_slice_runs(spark, sf_dir):
    """Each group's points as a run, sliced to some 60 km from the vertex nearest to a launch."""
    p = points(spark, sf_dir).select("grp", "id", "lon", "lat", F.lit(-81.0).alias("nlon"), F.lit(34.0).alias("nlat"))
    return leg_ops.slice_runs(p, "grp", "id", 60_000, ("nlon", "nlat")).select("grp", "id", F.round("at_m", 3).alias("at_m"))


@query(f"""WITH {POINTS}, s AS (SELECT grp, id % 4 AS kind, depth * 100 AS pos FROM points), l AS (SELECT DISTINCT grp, 200 + grp * 10 AS a, 1500 + grp * 20 AS b FROM points) SELECT grp, kind, count(*) AS n FROM s JOIN l USING (grp) WHERE pos BETWEEN a AND b GROUP BY ALL""")
def plan_passed(spark, sf_dir):
    p = points(spark, sf_dir)
    spots = p.select("grp", (F.col("id") % 4).alias("kind"), (F.col("depth") * 100).alias("at"))
    run = p.select("grp").distinct().select("grp", (200 + F.col("grp") * 10).alias("a"), (1500 + F.col("grp") * 20).alias("b"))
    return leg_ops.passed(spots, run, "grp", "at", "kind", "a", "b")


@query(f"""WITH {LEGS}, c AS (SELECT id, {metres('lon', 'lat', 'lon2', 'lat2')} AS m, degrees(atan2((lon2 - lon) * cos(radians(lat)), lat2 - lat)) AS course, depth FROM legs),
 h AS (SELECT *, depth * cos(radians(210.0 - course)) AS head, 0.5 * cos(radians(90.0 - course)) AS cur FROM c), t AS (SELECT *, greatest(0.1, 2.2 + cur + head * 0.03) AS mph FROM h)
 SELECT id, round(5.0 * power(mph / 2.0, 1.756) * (m / 1609.34) / mph, 5) AS ah, round(head, 1) AS head_mph, round(cur, 2) AS current_mph, round(mph, 2) AS through_mph FROM t""")
def plan_leg_energy(spark, sf_dir):
    from limnos.functions import geo

    leg = legs(spark, sf_dir).select("id", geo.equirect_m("lon", "lat", "lon2", "lat2").alias("m"), geo.planar_bearing("lat", "lon", "lat2", "lon2").alias("course"), "depth")
    e = leg_ops.leg_energy("m", F.lit(2.2), "course", F.lit(210.0), "depth", F.lit(90.0), F.lit(0.5))
    return leg.select("id", F.round(e["ah"], 5).alias("ah"), e["head_mph"].alias("head_mph"), e["current_mph"].alias("current_mph"), e["through_mph"].alias("through_mph"))


@query(f"""WITH {LEGS}, d AS (SELECT grp, id, {metres('lon', 'lat', 'lon2', 'lat2')} AS m, CASE WHEN lag(id) OVER w IS NULL THEN {metres('-81.0::DOUBLE', '34.0::DOUBLE', 'lon', 'lat')} ELSE {metres('lag(lon2) OVER w', 'lag(lat2) OVER w', 'lon', 'lat')} END AS hop, CASE WHEN lead(id) OVER w IS NULL THEN {metres('lon2', 'lat2', '-81.0::DOUBLE', '34.0::DOUBLE')} ELSE 0 END AS back FROM legs WINDOW w AS (PARTITION BY grp ORDER BY id)),
 s AS (SELECT grp, sum(m) AS t, sum(hop + back) AS v FROM d GROUP BY grp) SELECT grp, round(t, 3) AS troll_m, round(v, 3) AS move_m, round(t / 1609.34 / 2.0 * 60 + v / 1609.34 / 4.0 * 60, 5) AS minutes, round(5.0 * (t / 1609.34) / 2.0 + 5.0 * power(2.0::DOUBLE, 1.756) * (v / 1609.34) / 4.0, 5) AS ah FROM s""")
def plan_day_totals(spark, sf_dir):
    from limnos.functions import geo

    leg = legs(spark, sf_dir).select("grp", "id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2", geo.equirect_m("lon", "lat", "lon2", "lat2").alias("metres"), F.lit(-81.0).alias("home_lon"), F.lit(34.0).alias("home_lat"))
    out = leg_ops.day_totals(leg, "grp", "id", 2.0, 4.0)
    return out.select("grp", F.round("troll_m", 3).alias("troll_m"), F.round("move_m", 3).alias("move_m"), F.round("minutes", 5).alias("minutes"), F.round("ah", 5).alias("ah"))


SEG = "seg AS (SELECT id AS piece, lon AS ax, lat AS ay, lon + 0.004 AS bx, lat + 0.002 AS b_y FROM points WHERE grp >= 5)"


@query(f"""WITH {POINTS}, {SEG}, a AS (SELECT p.id, piece, (ax - lon) * cos(radians(lat)) * 111320.0 AS x0, (ay - lat) * 110540.0 AS y0, (bx - lon) * cos(radians(lat)) * 111320.0 AS x1, (b_y - lat) * 110540.0 AS y1 FROM points p, seg WHERE grp < 5 AND abs(lat - ay) < 0.05),
 t AS (SELECT *, least(1.0, greatest(0.0, (-x0 * (x1 - x0) - y0 * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM a), d AS (SELECT id, piece, sqrt(power(x0 + t * (x1 - x0), 2) + power(y0 + t * (y1 - y0), 2)) AS d FROM t),
 b AS (SELECT id, min(d) AS d, arg_min(piece, (d, piece)) AS piece FROM d WHERE d <= 4000 GROUP BY id)
 SELECT p.id, CASE WHEN d <= 50 THEN piece END AS piece, CAST(floor(d + 0.5) AS BIGINT) AS detour_m, coalesce(d <= 50, false) AS free FROM points p LEFT JOIN b USING (id) WHERE grp < 5""")
def plan_price_spots(spark, sf_dir):
    """The groups part all points into spots and pieces."""
    p = points(spark, sf_dir)
    seg = p.where("grp >= 5").select(F.col("id").alias("piece"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), (F.col("lon") + 0.004).alias("bx"), (F.col("lat") + 0.002).alias("by"))
    return leg_ops.price_spots(p.where("grp < 5"), seg, "id", "piece", 4000.0)


@query(f"""WITH RECURSIVE {SERIES}, e AS (SELECT user_id, event_id, CASE WHEN event_id % 6 = 0 THEN -1.0 ELSE value END AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM series), a AS (SELECT user_id, count(*) AS n, min(d) FILTER (WHERE d >= 0) AS low, list_sort(list(d) FILTER (WHERE d >= 0)) AS s FROM e GROUP BY 1),
 c AS (SELECT e.user_id, i, d, row_number() OVER (PARTITION BY e.user_id ORDER BY i) AS k FROM e JOIN a USING (user_id) WHERE n >= 3 AND low <= s[len(s) // 2 + 1] - 2 AND d >= 0 AND d <= low + 2),
 r AS (SELECT user_id, k, i, d, i AS fired, true AS due FROM c WHERE k = 1 UNION ALL SELECT c.user_id, c.k, c.i, c.d, CASE WHEN (c.i - r.fired) * 10 >= 81 THEN c.i ELSE r.fired END, (c.i - r.fired) * 10 >= 81 FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1)
 SELECT user_id, CAST(i AS INTEGER) AS place, d AS depth, (500 + greatest(0, i * 10 - 27))::DOUBLE AS at_m FROM r WHERE due""")
def plan_depth_cues(spark, sf_dir):
    item = F.struct("event_id", F.when(F.col("event_id") % 6 == 0, -1.0).otherwise(F.col("value")).alias("d"))
    by = series(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["d"]).alias("env"))
    out = leg_ops.depth_cues(by.select("user_id", "env", F.lit(10.0).alias("step"), F.lit(500.0).alias("start")), "user_id", "env", "step", "start")
    return out.select("user_id", "place", "depth", "at_m")


@query(f"""WITH {SERIES}, c AS (SELECT user_id, event_id AS ref, 'stop' AS kind, value * 10 AS at_m FROM series WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, 'change', value * 7 FROM series WHERE event_type = 'click') SELECT user_id, ref, kind, at_m, row_number() OVER (PARTITION BY user_id ORDER BY at_m, ref) AS place FROM c""")
def plan_cues(spark, sf_dir):
    """Stops and changes of each plan in the order of the way."""
    s = series(spark, sf_dir)
    one = lambda kind, name, k: s.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("ref"), F.lit(name).alias("kind"), (F.col("value") * k).alias("at_m"))
    cues = one("view", "stop", 10).unionByName(one("click", "change", 7))
    return cues.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("at_m", "ref")).cast("long"))


@query("""WITH s AS (SELECT o_custkey AS k, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS d, sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS s, count(*) AS n FROM orders GROUP BY 1),
 c AS (SELECT c_custkey AS k, coalesce(o, 0) AS o, coalesce(d, 0) AS d, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM customer LEFT JOIN s ON k = c_custkey), p AS (SELECT *, 30 * o + 20 * d + 15 * s + 5 * (n - o - d - s) + CASE WHEN o >= 3 THEN 20 WHEN o = 2 THEN 10 WHEN o = 1 AND s >= 1 THEN 8 ELSE 0 END + CASE WHEN n >= 3 THEN 10 WHEN n = 2 THEN 5 ELSE 0 END AS v FROM c),
 q AS (SELECT *, CASE WHEN k % 10 = 0 THEN 0 WHEN n = 0 THEN 45 WHEN o = 0 THEN least(99, greatest(10, v), CASE WHEN s = 0 THEN 65 ELSE 99 END, CASE WHEN d = 0 THEN 75 ELSE 99 END) ELSE least(99, greatest(10, v)) END AS p FROM p)
 SELECT k, CAST(p AS INTEGER) AS percent, CASE WHEN p = 0 THEN 'missing' WHEN n = 0 THEN 'low' WHEN p >= 95 THEN 'very high' WHEN p >= 85 THEN 'high' WHEN p >= 70 THEN 'medium' WHEN p >= 50 THEN 'low' ELSE 'needs review' END AS level FROM q""")
def conf_sections(spark, sf_dir):
    """Orders as a customer's sources, their priority as rank; every tenth has no data."""
    p = F.col("o_orderpriority")
    s = F.struct(F.when(p == "1-URGENT", "official").when(p == "2-HIGH", "derived").otherwise("other").alias("trust"), F.when(p == "3-MEDIUM", "a survey").otherwise("a note").alias("label"))
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(s).alias("s"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(by, "k", "left")
    out = leg_ops.section_confidence(F.coalesce("s", F.array().cast("array<struct<trust:string,label:string>>")), F.col("k") % 10 != 0)
    return c.select("k", out["percent"].alias("percent"), out["level"].alias("level"))


@query("""WITH f AS (SELECT p_partkey AS k, 60 + p_size AS raw, [p_partkey % 2 = 0, p_partkey % 3 = 0, p_partkey % 5 = 0, p_partkey % 7 = 0, p_size % 2 = 0, p_size % 3 = 0, p_partkey % 11 > 1 OR p_size % 13 = 0, p_size % 5 > 0] AS h FROM part),
 l AS (SELECT *, list_transform(h, lambda x: CASE WHEN x THEN 0 ELSE 1 END) AS m FROM f), p AS (SELECT *, raw - m[1] * 8 - m[2] * 6 - m[3] * 3 - m[4] * 3 - m[5] * 2 - m[6] * 2 - m[7] * 28 - m[8] * 18 AS v FROM l)
 SELECT k, CAST(greatest(30, least(99, v, CASE WHEN m[7] = 1 THEN 45 ELSE 99 END, CASE WHEN m[8] = 1 THEN 58 ELSE 99 END)) AS INTEGER) AS percent, CAST(list_sum(m) AS INTEGER) AS missing FROM p""")
def conf_overall(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    has = {"thermocline": k % 2 == 0, "oxygen": k % 3 == 0, "secchi": k % 5 == 0, "stockings": k % 7 == 0, "dam": s % 2 == 0, "impounded": s % 3 == 0, "predators": k % 11 > 1, "trolling": s % 5 > 0}
    out = leg_ops.overall_confidence(60 + s, has, {"predators": s % 13 == 0})
    return table(spark, sf_dir, "part").select(k.alias("k"), out["percent"].alias("percent"), F.size(out["missing"]).alias("missing"))


@query(f"""WITH {POINTS}, s AS (SELECT grp, id, CASE WHEN depth > 8 THEN 3.0 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1.5 ELSE 0 END + CASE WHEN lat > 34 THEN -1.0 ELSE 0 END AS score, concat_ws(',', CASE WHEN depth > 8 THEN 'deep' END, CASE WHEN id % 3 = 0 THEN 'docks' END, CASE WHEN lat > 34 THEN 'windy' END) AS reasons FROM points),
 k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS rank FROM s) SELECT grp, id, CAST(score AS DOUBLE) AS score, reasons, CAST(rank AS INTEGER) AS rank FROM k""")
def plan_offer(spark, sf_dir):
    rules = [("docks", F.col("id") % 3 == 0, 1.5), ("deep", F.col("depth") > 8, 3.0), ("windy", F.col("lat") > 34, -1.0)]
    return leg_ops.offer(points(spark, sf_dir), "grp", "id", rules).withColumn("reasons", F.array_join("reasons", ","))


#: Legs four by four are the days of a group; home is the first point's place, shifted; the wind comes from the legs' depths.
_HOP = "sqrt(power(({2} - {0}) * cos(radians(hlat)) * 111320.0, 2) + power(({3} - {1}) * 110570.0, 2))"


def _hop(*ends: str) -> str:
    return _HOP.format(*ends)


@query(f"""WITH RECURSIVE {LEGS}, n AS (SELECT *, grp * 10000 + (row_number() OVER (PARTITION BY grp ORDER BY id) - 1) // 4 AS plan, CAST((row_number() OVER (PARTITION BY grp ORDER BY id) - 1) % 4 AS INTEGER) AS k FROM legs),
 y AS (SELECT plan, arg_min(lon, id) + 0.01 AS hlon, arg_min(lat, id) - 0.01 AS hlat, count(*) AS legs, arg_max(depth, (depth, -id)) AS mph, arg_max(id % 360, (depth, -id))::DOUBLE AS wfrom FROM n GROUP BY plan),
 l AS (SELECT n.*, y.* EXCLUDE (plan), {metres('lon', 'lat', 'lon2', 'lat2')} AS m, degrees(atan2((lon2 - lon) * cos(radians(lat)), lat2 - lat)) AS course FROM n JOIN y USING (plan)),
 w(plan, done, x, y, hlon, hlat, m) AS (SELECT plan, 0, hlon, hlat, hlon, hlat, 0.0::DOUBLE FROM y UNION ALL
  SELECT w.plan, w.done + (1 << k), CASE WHEN f = 0 THEN lon2 ELSE lon END, CASE WHEN f = 0 THEN lat2 ELSE lat END, w.hlon, w.hlat, w.m + CASE WHEN f = 0 THEN {_hop('w.x', 'w.y', 'lon', 'lat').replace('hlat', 'w.hlat')} ELSE {_hop('w.x', 'w.y', 'lon2', 'lat2').replace('hlat', 'w.hlat')} END
  FROM w JOIN l ON l.plan = w.plan AND w.done & (1 << k) = 0, (VALUES (0), (1)) v(f)),
 b AS (SELECT w.plan, min(m + {_hop('x', 'w.y', 'w.hlon', 'w.hlat').replace('radians(hlat)', 'radians(w.hlat)')}) AS move FROM w JOIN y ON y.plan = w.plan AND w.done = (1 << y.legs) - 1 GROUP BY w.plan),
 e AS (SELECT plan, sum(m) AS troll, sum(5.0 * power(greatest(0.1, 2.0 + mph * cos(radians(wfrom - course)) * 0.03) / 2.0, 1.756) * (m / 1609.34) / greatest(0.1, 2.0 + mph * cos(radians(wfrom - course)) * 0.03)) AS ah, any_value(mph) AS mph FROM l GROUP BY plan),
 c AS (SELECT plan, move, troll, ah + 5.0 * power((3.0 + mph * 0.03) / 2.0, 1.756) * (move / 1609.34) / (3.0 + mph * 0.03) AS ah FROM b JOIN e USING (plan))
 SELECT plan, true AS exact, round(move, 3) AS move_m, round(troll, 3) AS troll_m, round(troll / 1609.34 / 2.0 * 60 + move / 1609.34 / 3.0 * 60, 4) AS minutes, round(ah, 5) AS ah, ah <= 60 AS fits FROM c""")
def plan_day_costs(spark, sf_dir):
    """Days of four legs in their best order, against the worst wind of their hours."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1
    leg = legs(spark, sf_dir).withColumn("plan", F.col("grp") * 10000 + F.floor(n / 4))
    picked = leg.select("plan", "id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2", geo_m("lon", "lat", "lon2", "lat2").alias("metres"))
    days = leg.groupBy("plan").agg((F.min_by("lon", "id") + 0.01).alias("home_lon"), (F.min_by("lat", "id") - 0.01).alias("home_lat"), F.lit(60.0).alias("usable_ah"))
    winds = leg.select("plan", F.col("id").alias("hour"), F.when(F.col("id") % 2 == 0, F.col("depth")).alias("gust_mph"), F.col("depth").alias("mph"), (F.col("id") % 360).alias("wind_from"))
    out = leg_ops.day_costs(picked, days, "plan", "id", 2.0, 3.0, leg_ops.worst_winds(winds, "plan", "hour"))
    return out.select("plan", "exact", F.round("move_m", 3).alias("move_m"), F.round("troll_m", 3).alias("troll_m"), F.round("minutes", 4).alias("minutes"), F.round("ah", 5).alias("ah"), "fits")


def geo_m(*ends):
    from limnos.functions import geo

    return geo.equirect_m(*ends)


@query(f"""WITH RECURSIVE {POINTS}, u AS (SELECT grp, id, lon, lat, row_number() OVER (PARTITION BY grp ORDER BY id) AS i, {metres('lag(lon) OVER q', 'lag(lat) OVER q', 'lon', 'lat')} AS m FROM points WINDOW q AS (PARTITION BY grp ORDER BY id)),
 v AS (SELECT *, sum(coalesce(m, 0)) OVER (PARTITION BY grp ORDER BY i) AS s FROM u),
 n AS (SELECT grp, CAST(CASE WHEN grp % 3 = 0 THEN arg_min(i, (abs(s - 250000), i)) ELSE arg_min(i, ({metres('-81.0::DOUBLE', '34.0::DOUBLE', 'lon', 'lat')}, i)) END AS BIGINT) AS i0, max(i) AS top, grp % 2 = 0 AS closed FROM v GROUP BY grp),
 w AS (SELECT n.grp, x.side, i0, top, closed, i0 AS i, 0.0::DOUBLE AS d FROM n, (VALUES (1), (-1)) x(side)
  UNION ALL SELECT w.grp, side, i0, top, closed, b.i, w.d + {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} FROM w JOIN v a ON a.grp = w.grp AND a.i = w.i JOIN v b ON b.grp = w.grp AND b.i = CASE WHEN closed THEN (w.i - 1 + side + top) % top + 1 ELSE w.i + side END
  WHERE b.i <> i0 AND w.d < 900000 AND w.d + {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1.15 * 900000),
 f AS (SELECT grp, round(max(CASE WHEN side = 1 THEN d END)) AS fore, round(max(CASE WHEN side = -1 THEN d END)) AS back FROM w GROUP BY grp)
 SELECT w.grp, v.id, w.side, round(w.d, 1) AS at_m FROM w JOIN f ON f.grp = w.grp AND w.side = CASE WHEN fore >= back THEN 1 ELSE -1 END JOIN v ON v.grp = w.grp AND v.i = w.i""")
def plan_slice_legs(spark, sf_dir):
    """Runs, every second one closed, sliced to some 900 km, a third of them from a distance along the run."""
    p = points(spark, sf_dir).select("grp", "id", "lon", "lat", F.lit(-81.0).alias("nlon"), F.lit(34.0).alias("nlat"), F.when(F.col("grp") % 3 == 0, 250_000.0).alias("from_s"), (F.col("grp") % 2 == 0).alias("closed"))
    return leg_ops.slice_legs(p, "grp", "id", 900_000, ("nlon", "nlat"), "from_s", "closed").select("grp", "id", "side", F.round("at_m", 1).alias("at_m"))
