"""Queries that bind feeds to waters, and over runs, rings and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import geo, numbers
from limnos.operators import binding, runs
from limnos.plans.q_spatial import BOXES, CELLS, boxes, cells, diamonds
from limnos.plans.registry import query
from limnos.plans.surrogates import LEGS, POINTS, SERIES, legs, metres, points, series, table

PAD = "padded AS (SELECT box, x0 - 300 / (111320.0 * cos(radians((y0 + y1) / 2))) AS x0, y0 - 300 / 110570.0 AS y0, x1 + 300 / (111320.0 * cos(radians((y0 + y1) / 2))) AS x1, y1 + 300 / 110570.0 AS y1 FROM boxes)"
TILES = "tiles AS (SELECT CAST(floor(lon / 0.1) AS BIGINT) * 100000 + CAST(floor(lat / 0.1) AS BIGINT) AS tile, min(floor(lon / 0.1)) * 0.1 AS tx0, min(floor(lat / 0.1)) * 0.1 AS ty0, min(floor(lon / 0.1)) * 0.1 + 0.1 AS tx1, min(floor(lat / 0.1)) * 0.1 + 0.1 AS ty1 FROM points GROUP BY 1)"


def tiles(spark, sf_dir):
    """The tenth-degree tiles that hold points."""
    i, j = F.floor(F.col("lon") / 0.1), F.floor(F.col("lat") / 0.1)
    t = points(spark, sf_dir).select(i.alias("i"), j.alias("j")).distinct()
    return t.select((F.col("i") * 100000 + F.col("j")).alias("tile"), (F.col("i") * 0.1).alias("tx0"), (F.col("j") * 0.1).alias("ty0"), (F.col("i") * 0.1 + 0.1).alias("tx1"), (F.col("j") * 0.1 + 0.1).alias("ty1"))


@query(f"""WITH {POINTS}, {BOXES}, {PAD}, q AS (SELECT id, lon + 0.3 AS lon, lat + 0.2 AS lat FROM points), k AS (SELECT id, box, row_number() OVER (PARTITION BY id ORDER BY (x1 - x0) * (y1 - y0), box) AS r FROM q JOIN padded ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1)
 SELECT q.id, box FROM q LEFT JOIN (SELECT * FROM k WHERE r = 1) USING (id)""")
def bind_owners(spark, sf_dir):
    p = points(spark, sf_dir).select("id", (F.col("lon") + 0.3).alias("lon"), (F.col("lat") + 0.2).alias("lat"))
    return binding.owners(p, boxes(spark, sf_dir), "id", "box", 300, 0.1)


@query(f"""WITH {POINTS}, {BOXES}, {TILES} SELECT box, count(tile) AS tiles, coalesce(string_agg(CAST(tile AS VARCHAR), ',' ORDER BY tile), '') AS tile_ids FROM boxes LEFT JOIN tiles ON x0 <= tx1 AND tx0 <= x1 AND y0 <= ty1 AND ty0 <= y1 GROUP BY box""")
def bind_tiles(spark, sf_dir):
    out = binding.claims(boxes(spark, sf_dir), tiles(spark, sf_dir), "box", "tile", 0.1)
    return out.withColumn("tile_ids", F.array_join(F.transform("tile_ids", lambda t: t.cast("string")), ","))


@query(f"""WITH {POINTS}, z AS (SELECT id AS zone, lon - 0.01 AS x0, lat - 0.01 AS y0, lon + 0.01 AS x1, lat + 0.01 AS y1 FROM points WHERE grp = 0), p AS (SELECT id, lon, lat FROM points WHERE grp > 0), lost AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM z WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1)),
 d AS (SELECT id, zone, {metres('lon', 'lat', '(x0 + x1) / 2', '(y0 + y1) / 2')} AS m FROM lost, z), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, zone) AS r FROM d WHERE m <= 9000) SELECT lost.id, zone, round(m, 2) AS distance_m FROM lost LEFT JOIN (SELECT * FROM k WHERE r = 1) k ON lost.id = k.id""")
def bind_misses(spark, sf_dir):
    """The groups part all points into zones and points."""
    p = points(spark, sf_dir)
    z = p.where("grp = 0").select(F.col("id").alias("zone"), (F.col("lon") - 0.01).alias("x0"), (F.col("lat") - 0.01).alias("y0"), (F.col("lon") + 0.01).alias("x1"), (F.col("lat") + 0.01).alias("y1"))
    return binding.misses(p.where("grp > 0").select("id", "lon", "lat"), z, "id", "zone", 0.05, 9000).withColumn("distance_m", F.round("distance_m", 2))


@query(f"""WITH RECURSIVE {CELLS}, t AS (SELECT DISTINCT CAST(floor(lon / 0.05) AS BIGINT) AS i, CAST(floor(lat / 0.05) AS BIGINT) AS j FROM points WHERE grp < 3), f AS (SELECT i, j, mean FROM cells ANTI JOIN t USING (i, j)),
 r(i, j, x, y) AS (SELECT i, j, i, j FROM f UNION SELECT r.i, r.j, f.i, f.j FROM r JOIN f ON abs(r.x - f.i) <= 1 AND abs(r.y - f.j) <= 1), c AS (SELECT i, j, min(x * 4294967296 + y + 2147483648) AS c FROM r GROUP BY i, j)
 SELECT count(*) AS n, round(avg(mean), 8) AS mean, min(i) AS i0, min(j) AS j0, max(i) AS i1, max(j) AS j1, round(count(*) / ((max(i) - min(i) + 1) * (max(j) - min(j) + 1)), 8) AS fill FROM f JOIN c USING (i, j) GROUP BY c HAVING count(*) >= 3""")
def bind_unclaimed(spark, sf_dir):
    c = geo.cell("lon", "lat", 0.05)
    taken = points(spark, sf_dir).where("grp < 3").select(c["i"].alias("i"), c["j"].alias("j"))
    out = binding.unclaimed(cells(spark, sf_dir), taken, 3, "mean").drop("component")
    return out.withColumn("mean", F.round("mean", 8)).withColumn("fill", F.round("fill", 8))


@query(f"""WITH {POINTS}, p AS (SELECT DISTINCT grp, CAST(floor(lon / 0.04) AS BIGINT) AS i, CAST(floor(lat / 0.04) AS BIGINT) AS j FROM points WHERE grp >= 4), c AS (SELECT DISTINCT grp AS owner, CAST(floor(lon / 0.04) AS BIGINT) AS i, CAST(floor(lat / 0.04) AS BIGINT) AS j FROM points WHERE grp < 4), u AS (SELECT DISTINCT i, j FROM c),
 s AS (SELECT p.grp, count(*) AS n, 1 - count(u.i) / count(*) AS outside FROM p LEFT JOIN u ON p.i = u.i AND p.j = u.j GROUP BY p.grp), w AS (SELECT * FROM s WHERE outside >= 0.3 AND n >= 3), o AS (SELECT unnest([-1, 0, 1]) AS d),
 a AS (SELECT DISTINCT p.grp, p.i + x.d AS i, p.j + y.d AS j FROM p SEMI JOIN w USING (grp), o x, o y WHERE x.d <> 0 OR y.d <> 0), v AS (SELECT a.grp, owner, count(*) AS n FROM a JOIN c USING (i, j) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, owner) AS r FROM v)
 SELECT w.grp, w.n, round(outside, 8) AS outside, owner FROM w LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON w.grp = b.grp""")
def bind_gaps(spark, sf_dir):
    """The groups part all points into polygons' cells and claimed ones."""
    c = geo.cell("lon", "lat", 0.04)
    p = points(spark, sf_dir).select("grp", c["i"].alias("i"), c["j"].alias("j"))
    return binding.gaps(p.where("grp >= 4"), p.where("grp < 4").withColumnRenamed("grp", "owner"), "grp", "owner", 0.3, 3).withColumn("outside", F.round("outside", 8))


@query(f"""WITH {SERIES}, l AS (SELECT user_id, event_id % 200 AS tile, CASE WHEN event_id % 3 = 0 THEN 'road' ELSE 'name ' || CAST(floor(value / 60) AS BIGINT) || '-' || event_id % 7 END AS label FROM series), d AS (SELECT label FROM l GROUP BY 1 HAVING count(DISTINCT tile) > 0.25 * (SELECT count(DISTINCT tile) FROM l)),
 c AS (SELECT user_id, label, count(*) AS n FROM l ANTI JOIN d USING (label) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) AS r FROM c) SELECT user_id, label, n FROM k WHERE r = 1""")
def bind_labels(spark, sf_dir):
    label = F.when(F.col("event_id") % 3 == 0, "road").otherwise(F.concat(F.lit("name "), F.floor(F.col("value") / 60).cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string")))
    l = series(spark, sf_dir).select("user_id", (F.col("event_id") % 200).alias("tile"), label.alias("label"))
    return binding.label_of(l, "user_id", "label", "tile", 0.25)


@query(f"""WITH {POINTS}, a AS (SELECT * FROM points WHERE grp % 2 = 0), b AS (SELECT * FROM points WHERE grp % 2 = 1), x AS (SELECT 'a' AS side, id, EXISTS (SELECT 1 FROM b WHERE {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1200) AS h FROM a UNION ALL SELECT 'b', id, EXISTS (SELECT 1 FROM a WHERE {metres('b.lon', 'b.lat', 'a.lon', 'a.lat')} <= 1200) FROM b)
 SELECT side, count(CASE WHEN h THEN 1 END) AS both, count(CASE WHEN NOT h THEN 1 END) AS alone FROM x GROUP BY side""")
def bind_agreement(spark, sf_dir):
    """The groups part all points into two sources."""
    p = points(spark, sf_dir)
    return binding.agreement(p.where("grp % 2 = 0"), p.where("grp % 2 = 1"), "id", 1200)


@query(f"""WITH {LEGS}, {BOXES}, s AS (SELECT CASE WHEN id % 6 > 0 THEN 'river ' || id % 6 END AS name, depth + 1 AS len, least(lon, lon2) AS tx0, least(lat, lat2) AS ty0, greatest(lon, lon2) AS tx1, greatest(lat, lat2) AS ty1 FROM legs),
 t AS (SELECT box, name, sum(len) AS length FROM boxes JOIN s ON name IS NOT NULL AND x0 <= tx1 AND tx0 <= x1 AND y0 <= ty1 AND ty0 <= y1 GROUP BY ALL), k AS (SELECT *, max(length) OVER (PARTITION BY box) AS top, row_number() OVER (PARTITION BY box ORDER BY length DESC, name) AS rank FROM t)
 SELECT box, name, round(length, 4) AS length, CAST(rank AS INTEGER) AS rank FROM k WHERE length >= 0.25 * top AND rank <= 3""")
def bind_rivers(spark, sf_dir):
    i = F.col("id") % 6
    s = legs(spark, sf_dir).select(F.when(i > 0, F.concat(F.lit("river "), i.cast("string"))).alias("name"), (F.col("depth") + 1).alias("len"), F.least("lon", "lon2").alias("tx0"), F.least("lat", "lat2").alias("ty0"), F.greatest("lon", "lon2").alias("tx1"), F.greatest("lat", "lat2").alias("ty1"))
    return binding.rivers_of(boxes(spark, sf_dir), s, "box", "name", "len", 0.2, 0.25, 3).withColumn("length", F.round("length", 4))


DAMS = "d AS (SELECT id AS dam, lon, lat, CASE WHEN id % 4 > 0 THEN depth * 10 END AS dr FROM points WHERE grp < 4), w AS (SELECT id AS water, lon AS wlon, lat AS wlat, CASE WHEN id % 5 > 0 THEN depth * 10 END AS wdr FROM points WHERE grp >= 4)"


@query(f"""WITH {POINTS}, {DAMS}, n AS (SELECT dam, water, {metres('lon', 'lat', 'wlon', 'wlat')} AS m, CASE WHEN dr > 0 AND wdr > 0 THEN abs(dr - wdr) / greatest(dr, wdr) END AS o FROM d, w), k AS (SELECT *, row_number() OVER (PARTITION BY dam ORDER BY o IS NULL, o, m, water) AS r FROM n WHERE m <= 7000)
 SELECT dam, water, CASE WHEN o IS NULL THEN 'position only' WHEN o <= 0.1 THEN 'confirmed' ELSE 'refused' END AS verdict, round(m / 1000, 3) AS km FROM k WHERE r = 1""")
def bind_dams(spark, sf_dir):
    """The groups part all points into dams and waters."""
    p = points(spark, sf_dir)
    d = p.where("grp < 4").select(F.col("id").alias("dam"), "lon", "lat", F.when(F.col("id") % 4 > 0, F.col("depth") * 10).alias("drainage"))
    w = p.where("grp >= 4").select(F.col("id").alias("water"), F.col("lon").alias("wlon"), F.col("lat").alias("wlat"), F.when(F.col("id") % 5 > 0, F.col("depth") * 10).alias("wdrainage"))
    return binding.bind_by_drainage(d, w, "dam", "water", 7000, 0.1)


def as_polygons(df):
    return df.withColumnsRenamed({"poly": "other", "rings": "prings", "x0": "tx0", "y0": "ty0", "x1": "tx1", "y1": "ty1"})


#: The exact shared part of two diamonds, by their turned coordinates.
SHARE = "greatest(0, 0.06 - abs((a.lon - b.lon) + (a.lat - b.lat))) * greatest(0, 0.06 - abs((a.lon - b.lon) - (a.lat - b.lat))) / (0.06 * 0.06)"


@query(f"""WITH {POINTS}, s AS (SELECT a.id AS poly, b.id AS other, 100 * {SHARE} AS s FROM points a JOIN points b ON a.grp < 5 AND b.grp >= 5 AND abs(a.lon - b.lon) <= 0.06 AND abs(a.lat - b.lat) <= 0.06), k AS (SELECT *, row_number() OVER (PARTITION BY poly ORDER BY round(s, 6) DESC, other) AS r FROM s WHERE s >= 20) SELECT poly, other, round(round(s, 6) + 1e-5, 3) AS share FROM k WHERE r = 1""")
def bind_best_overlap(spark, sf_dir):
    """The groups part all diamonds into waters and mapped polygons."""
    grp = points(spark, sf_dir).select(F.col("id").alias("poly"), "grp")
    d = diamonds(spark, sf_dir, 0.03).join(grp, "poly")
    return binding.match_by_overlap(d.where("grp < 5").drop("grp"), as_polygons(d.where("grp >= 5").drop("grp")), "poly", "other", 0.1, 20.0).withColumn("share", F.round(F.col("share") + 1e-5, 3))


@query(f"""WITH {POINTS}, h AS (SELECT q.grp, p.id AS poly, count(*) AS n FROM points p JOIN points q ON abs(q.lon - p.lon) + abs(q.lat - p.lat) < 0.04 - 1e-9 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, poly) AS r FROM h), t AS (SELECT grp, count(*) AS total FROM points GROUP BY 1)
 SELECT t.grp, poly, coalesce(n, 0) AS inside, total FROM t LEFT JOIN (SELECT * FROM k WHERE r = 1) k ON t.grp = k.grp""")
def bind_holds_most(spark, sf_dir):
    return binding.holds_most(points(spark, sf_dir), diamonds(spark, sf_dir, 0.04 - 1e-9), "grp", "poly", 0.05)


@query(f"""WITH {POINTS}, {BOXES}, h AS (SELECT box, id FROM boxes JOIN points ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) SELECT box, count(id) AS n, coalesce(array_to_string(list_slice(list_sort(list(id)), 1, 12), ','), '') AS first FROM boxes LEFT JOIN h USING (box) GROUP BY box""")
def bind_stations(spark, sf_dir):
    out = binding.stations_of(boxes(spark, sf_dir), points(spark, sf_dir), "box", "id", 0.1)
    return out.withColumn("first", F.array_join(F.transform("first", lambda x: x.cast("string")), ","))


@query(f"""WITH {POINTS}, n AS (SELECT id, 'cove ' || grp || CASE id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE 'yz' END AS name, lon, lat FROM points), r AS (SELECT CAST(grp AS BIGINT) AS row_id, 'cove ' || grp AS rname, min(lon) AS x0, min(lat) AS y0, (min(lon) + max(lon)) / 2 AS x1, max(lat) AS y1 FROM points GROUP BY grp),
 o AS (SELECT * FROM n WHERE name NOT IN (SELECT rname FROM r)), k AS (SELECT id, row_id, levenshtein(name, rname) AS edits FROM o JOIN r ON levenshtein(name, rname) BETWEEN 1 AND 2 AND lon BETWEEN x0 - 500 / (111320.0 * cos(radians((y0 + y1) / 2))) AND x1 + 500 / (111320.0 * cos(radians((y0 + y1) / 2))) AND lat BETWEEN y0 - 500 / 110570.0 AND y1 + 500 / 110570.0),
 f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edits, row_id) AS x FROM k) SELECT id, row_id, CAST(edits AS INTEGER) AS edits FROM f WHERE x = 1""")
def bind_suggested_aliases(spark, sf_dir):
    p, g = points(spark, sf_dir), F.col("grp").cast("string")
    n = p.select("id", F.concat(F.lit("cove "), g, F.when(F.col("id") % 4 == 0, "x").when(F.col("id") % 4 == 1, "").otherwise("yz")).alias("name"), "lon", "lat")
    r = p.groupBy("grp").agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), ((F.min("lon") + F.max("lon")) / 2).alias("x1"), F.max("lat").alias("y1")).select(F.col("grp").cast("long").alias("row_id"), F.concat(F.lit("cove "), g).alias("rname"), "x0", "y0", "x1", "y1")
    return binding.suggested_aliases(n, r, "id", "name", "row_id", "rname", 2, 500)


COURSE = "degrees(atan2(({2} - {0}) * cos(radians({1})), {3} - {1}))"


@query(f"""WITH {POINTS}, v AS (SELECT grp, id, lon, lat, lag(lon) OVER w AS pl, lag(lat) OVER w AS pa, lead(lon) OVER w AS nl, lead(lat) OVER w AS na FROM points WINDOW w AS (PARTITION BY grp ORDER BY id)),
 t AS (SELECT *, abs(fmod(fmod({COURSE.format('pl', 'pa', 'lon', 'lat')} - {COURSE.format('lon', 'lat', 'nl', 'na')} + 180, 360) + 360, 360) - 180) AS turn, coalesce({metres('lon', 'lat', 'nl', 'na')}, 0) AS ahead FROM v), l AS (SELECT *, sum(CASE WHEN turn > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY id ROWS UNBOUNDED PRECEDING) AS leg FROM t),
 m AS (SELECT *, sum(ahead) OVER (PARTITION BY grp, leg) AS leg_m FROM l) SELECT grp, id, CAST(leg AS BIGINT) AS leg, round(leg_m, 2) AS leg_m FROM m WHERE leg_m >= 9000""")
def run_split_corners(spark, sf_dir):
    out = runs.split_at_corners(points(spark, sf_dir).select("grp", "id", "lon", "lat"), "grp", "id", 120, 9000)
    return out.select("grp", "id", "leg", F.round("leg_m", 2).alias("leg_m"))


@query(f"""WITH {LEGS} SELECT grp, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS INTEGER) AS k, round(sum({metres('lon', 'lat', 'lon2', 'lat2')}) OVER (PARTITION BY grp ORDER BY id ROWS UNBOUNDED PRECEDING) - {metres('lon', 'lat', 'lon2', 'lat2')}, 2) AS s FROM legs""")
def run_segments(spark, sf_dir):
    """Each group's points as a line, and its segments."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("id", F.col("lon").alias("x"), F.col("lat").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["id"].alias("id")))
    by = points(spark, sf_dir).groupBy("grp").agg(line.alias("line"))
    ids = by.select("grp", F.posexplode("line").alias("k", "p")).select("grp", "k", F.col("p.id").alias("id"))
    return runs.segments(by, "grp", "line").join(ids, ["grp", "k"]).select("grp", "id", "k", F.round("s", 2).alias("s"))


@query(f"""WITH {POINTS}, g AS (SELECT id AS k, lon AS ax, lat AS ay, lon + 0.003 AS bx, lat + 0.001 AS b_y, depth * 50 AS s, {metres('lon', 'lat', 'lon + 0.003', 'lat + 0.001')} AS m FROM points WHERE grp >= 5),
 a AS (SELECT p.id, k, s, m, (ax - lon) * cos(radians(lat)) * 111320.0 AS x0, (ay - lat) * 110540.0 AS y0, (bx - lon) * cos(radians(lat)) * 111320.0 AS x1, (b_y - lat) * 110540.0 AS y1, (ax - lon) * cos(radians(lat)) AS u0, ay - lat AS v0, (bx - lon) * cos(radians(lat)) AS u1, b_y - lat AS v1 FROM points p, g WHERE grp < 5 AND abs(lat - ay) < 0.05),
 t AS (SELECT *, least(1.0, greatest(0.0, (-x0 * (x1 - x0) - y0 * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t, least(1.0, greatest(0.0, (-u0 * (u1 - u0) - v0 * (v1 - v0)) / ((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0)))) AS q FROM a),
 d AS (SELECT id, k, s + q * m AS s, sqrt(power(x0 + t * (x1 - x0), 2) + power(y0 + t * (y1 - y0), 2)) AS d FROM t) SELECT k % 3 AS run, id, round(min(d), 2) AS distance_m, round(arg_min(s, (d, k)), 1) AS s FROM d WHERE d <= 1500 GROUP BY ALL""")
def run_beside(spark, sf_dir):
    """The groups part all points into features and runs' segments."""
    p = points(spark, sf_dir)
    g = p.where("grp >= 5").select((F.col("id") % 3).alias("run"), F.col("id").alias("k"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), (F.col("lon") + 0.003).alias("bx"), (F.col("lat") + 0.001).alias("by"), (F.col("depth") * 50).alias("s"))
    g = g.withColumn("m", geo.equirect_m("ax", "ay", "bx", "by"))
    out = runs.beside(p.where("grp < 5"), g, "id", "run", 1500.0)
    return out.select("run", "id", numbers.round_scaled("distance_m", 2).alias("distance_m"), numbers.round_scaled("s", 1).alias("s"))


@query(f"""WITH {SERIES}, a AS (SELECT user_id, list(CASE WHEN event_id % 9 > 0 THEN value END ORDER BY event_id) AS d FROM series GROUP BY 1), k AS (SELECT user_id, d, list_filter(range(1, len(d) + 1), lambda i: NOT coalesce(d[i] >= 10, false)) AS bad FROM a)
 SELECT user_id, len(bad) = 0 AS clear, CAST(CASE WHEN len(bad) = 0 THEN len(d) ELSE bad[1] - 1 END AS INTEGER) AS reach FROM k""")
def run_clear_chords(spark, sf_dir):
    item = F.struct("event_id", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("v"))
    by = series(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("d"))
    return by.select("user_id", runs.chord_clear(F.col("d"), 10).alias("clear"), runs.longest_clear(F.col("d"), 10).alias("reach"))


@query(f"""WITH {LEGS} SELECT id, round_even(lon, 3) AS x0, round_even(lat, 3) AS y0, 2 AS n, round(2 * (depth * 100 + 1) / (depth + 7), 6) AS width, CASE WHEN 2 * (depth * 100 + 1) / (depth + 7) < 30 THEN 'sliver' ELSE 'lobe' END AS kind FROM legs""")
def run_coordinates(spark, sf_dir):
    """Positions with a depth, flattened and rounded; and shapes of areas and perimeters."""
    line = F.array(F.array("lon", "lat", "depth"), F.array("lon2", "lat2", "depth"))
    out = runs.rounded(runs.flat(line), 3)
    s = runs.shape_class(F.col("depth") * 100 + 1, F.col("depth") + 7)
    return legs(spark, sf_dir).select("id", out[0][0].alias("x0"), out[0][1].alias("y0"), F.size(out[0]).alias("n"), F.round(s["width"], 6).alias("width"), s["kind"].alias("kind"))


@query(f"""WITH {POINTS}, q AS (SELECT id, id // 4 AS g, id % 4 AS k, first_value(lon) OVER w AS lon, first_value(lat) OVER w AS lat FROM points WINDOW w AS (PARTITION BY id // 4 ORDER BY id)), b AS (SELECT *, CASE k WHEN 3 THEN lon + 1 ELSE lon END AS cx, 0.4 / (k + 1) AS h FROM q),
 p AS (SELECT a.id, count(b.id) AS depth, arg_min(b.id, (b.h, b.id)) AS parent FROM b a LEFT JOIN b b ON a.g = b.g AND a.id <> b.id AND a.k > b.k AND a.k < 3 GROUP BY a.id) SELECT id, depth, depth % 2 = 0 AS outer, CASE WHEN depth % 2 = 1 THEN parent END AS parent FROM p""")
def run_nested_rings(spark, sf_dir):
    """Every four points: three squares within each other about the first of them, and one apart."""
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("id")
    q = points(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 4)).withColumn("k", F.col("id") % 4).withColumn("cx", F.first("lon").over(w)).withColumn("cy", F.first("lat").over(w))
    q = q.withColumn("cx", F.when(F.col("k") == 3, F.col("cx") + 1).otherwise(F.col("cx"))).withColumn("h", 0.4 / (F.col("k") + 1))
    at = lambda a, b: F.struct((F.col("cx") + a * F.col("h")).alias("x"), (F.col("cy") + b * F.col("h")).alias("y"))
    rings = q.select("id", "g", (F.col("cx") + 0.9 * F.col("h")).alias("lon"), (F.col("cy") + 0.05 * F.col("h")).alias("lat"), F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)).alias("ring"), (F.col("cx") - F.col("h")).alias("x0"), (F.col("cy") - F.col("h")).alias("y0"), (F.col("cx") + F.col("h")).alias("x1"), (F.col("cy") + F.col("h")).alias("y1"))
    return runs.nested(rings, "id", "g", 0.5)


@query(f"""WITH {SERIES}, b AS (SELECT user_id, floor(value / 20) * 20 AS bin, list_sort(list(CAST(event_id % 97 AS DOUBLE))) AS v FROM series GROUP BY ALL), m AS (SELECT user_id, bin, v[len(v) // 2 + 1] AS v FROM b), f AS (SELECT *, CASE WHEN lead(bin) OVER w = bin + 20 THEN v - lead(v) OVER w END AS fall FROM m WINDOW w AS (PARTITION BY user_id ORDER BY bin)),
 k AS (SELECT user_id, arg_max(bin, (fall, -bin)) FILTER (WHERE fall IS NOT NULL) AS steepest, max(fall) AS fall FROM f GROUP BY 1) SELECT f.user_id, count(*) AS bins, CAST(min(CASE WHEN v < 30 THEN bin END) AS DOUBLE) AS first_below, CAST(any_value(k.steepest) AS DOUBLE) AS steepest, any_value(k.fall) AS fall FROM f JOIN k USING (user_id) GROUP BY 1""")
def run_profile(spark, sf_dir):
    """Values by depth, each user's as a station's profile."""
    s = series(spark, sf_dir).select("user_id", F.col("value").alias("depth"), (F.col("event_id") % 97).cast("double").alias("v"))
    return runs.profile(s, ["user_id"], "depth", "v", 30.0, 20.0)


@query(f"""WITH {LEGS}, s AS (SELECT CAST(round(lon * 100) AS BIGINT) AS a0, CAST(round(lat * 100) AS BIGINT) AS a1, CAST(round(lon2 * 100) AS BIGINT) AS b0, CAST(round(lat2 * 100) AS BIGINT) AS b1, {metres('lon', 'lat', 'lon2', 'lat2')} AS m FROM legs),
 e AS (SELECT CASE WHEN (a0, a1) <= (b0, b1) THEN a0 || ' ' || a1 || ' ' || b0 || ' ' || b1 ELSE b0 || ' ' || b1 || ' ' || a0 || ' ' || a1 END AS e, m FROM s WHERE a0 <> b0 OR a1 <> b1) SELECT count(DISTINCT e) AS edges, round(sum(w), 2) AS metres FROM (SELECT e, min(m) AS w FROM e GROUP BY e)""")
def run_mesh(spark, sf_dir):
    """Legs as lines on a mesh of hundredths of a degree."""
    v = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = legs(spark, sf_dir).select("id", F.array(v("lon", "lat"), v("lon2", "lat2")).alias("line"))
    return runs.mesh(lines, "id", "line", 2).agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 2).alias("metres"))


@query(f"""WITH {LEGS}, c AS (SELECT id, lon AS ax, lat AS ay, lon2 - lon AS dx, lat2 - lat AS dy, -81.0::DOUBLE AS x0, 33.95::DOUBLE AS y0, -80.9::DOUBLE AS x1, 34.05::DOUBLE AS y1 FROM legs),
 t AS (SELECT id, CASE WHEN dx = 0 THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 0 ELSE 2 END ELSE least((x0 - ax) / dx, (x1 - ax) / dx) END AS tx0, CASE WHEN dx = 0 THEN 1 ELSE greatest((x0 - ax) / dx, (x1 - ax) / dx) END AS tx1, CASE WHEN dy = 0 THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 0 ELSE 2 END ELSE least((y0 - ay) / dy, (y1 - ay) / dy) END AS ty0, CASE WHEN dy = 0 THEN 1 ELSE greatest((y0 - ay) / dy, (y1 - ay) / dy) END AS ty1 FROM c),
 s AS (SELECT id, greatest(0, least(1, tx1, ty1) - greatest(0, tx0, ty0)) AS inside FROM t) SELECT id, round(1 - inside, 6) AS outside FROM s WHERE inside < 1""")
def run_clip_lines(spark, sf_dir):
    """The share of every leg that lies outside an excluded square."""
    seg = legs(spark, sf_dir).select("id", F.lit(0).alias("k"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.col("lon2").alias("bx"), F.col("lat2").alias("by"))
    v = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    square = spark.range(1).select(F.array(F.array(v(-81.0, 33.95), v(-80.9, 33.95), v(-80.9, 34.05), v(-81.0, 34.05))).alias("rings"), F.lit(-81.0).alias("x0"), F.lit(33.95).alias("y0"), F.lit(-80.9).alias("x1"), F.lit(34.05).alias("y1"))
    out = runs.clip_lines(seg, square, "id", 0.05)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    whole = seg.select("id", length.alias("m"))
    return out.groupBy("id").agg(F.sum(length).alias("o")).join(whole, "id").select("id", F.round(F.col("o") / F.col("m"), 6).alias("outside"))


#: Small boxes about all points are polygons; deep ones are landings of the name their group gives, at themselves; a name's own box is that of its landings.
GROWN = """b AS (SELECT id AS node, lon - 0.03 AS x0, lat - 0.03 AS y0, lon + 0.03 AS x1, lat + 0.03 AS y1, id % 3 > 0 AS charted, CASE WHEN depth > 14 THEN grp % 4 END AS owner FROM points),
 e AS (SELECT a.node AS src, b.node AS dst, b.owner, b.charted, b.x0, b.y0, b.x1, b.y1 FROM b a JOIN b ON a.node <> b.node AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
 n AS (SELECT owner AS name, avg(x0) - 0.05 AS nx0, avg(y0) - 0.05 AS ny0, avg(x1) + 0.05 AS nx1, avg(y1) + 0.05 AS ny1 FROM b WHERE owner IS NOT NULL GROUP BY owner)"""


@query(f"""WITH RECURSIVE {POINTS}, {GROWN}, s AS (SELECT DISTINCT owner AS name, node FROM b WHERE owner IS NOT NULL),
 one(name, node) AS (SELECT name, node FROM s UNION SELECT one.name, dst FROM one JOIN e ON src = node JOIN n ON n.name = one.name WHERE (owner IS NULL OR owner = one.name) AND nx0 <= x1 AND x0 <= nx1 AND ny0 <= y1 AND y0 <= ny1),
 w AS (SELECT name, min(x0) - 0.02 AS wx0, min(y0) - 0.02 AS wy0, max(x1) + 0.02 AS wx1, max(y1) + 0.02 AS wy1 FROM one JOIN b USING (node) GROUP BY name),
 two(name, node) AS (SELECT DISTINCT one.name, one.node FROM one JOIN e ON src = node JOIN n ON n.name = one.name WHERE (owner IS NULL OR owner = one.name) AND NOT (nx0 <= x1 AND x0 <= nx1 AND ny0 <= y1 AND y0 <= ny1)
  UNION SELECT two.name, dst FROM two JOIN e ON src = node JOIN w ON w.name = two.name WHERE charted AND (owner IS NULL OR owner = two.name) AND wx0 <= x1 AND x0 <= wx1 AND wy0 <= y1 AND y0 <= wy1)
 SELECT name, node, 1 AS phase FROM one UNION ALL SELECT name, node, 2 FROM two WHERE (name, node) NOT IN (SELECT name, node FROM one)""")
def bind_grown_waters(spark, sf_dir):
    """Names grow from their landings' polygons over touching ones."""
    from limnos.operators import growth

    p = points(spark, sf_dir)
    nodes = p.select(F.col("id").alias("node"), *(e.alias(c) for c, e in zip(growth.BOX, (F.col("lon") - 0.03, F.col("lat") - 0.03, F.col("lon") + 0.03, F.col("lat") + 0.03), strict=True)), (F.col("id") % 3 > 0).alias("charted"), F.when(F.col("depth") > 14, F.col("grp") % 4).alias("name"))
    owner = growth.owners(nodes, "name", "node")
    mean = lambda k, c: (F.avg(c) - 0.05 if k < 2 else F.avg(c) + 0.05).alias(c)
    names = nodes.where("name is not null").groupBy("name").agg(*(mean(k, c) for k, c in enumerate(growth.BOX)))
    return growth.grow(nodes.where("name is not null").select("name", "node"), None, nodes.join(owner, "node", "left"), names, 0.02, 0.1)
