"""Queries over near names, merged places, best kinds, fringes and affine frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import geo, words
from limnos.operators import entity, ranking, raster
from limnos.plans.q_spatial import CELLS, cells, diamonds
from limnos.plans.registry import query
from limnos.plans.surrogates import POINTS, SERIES, metres, points, series, table


@query("""WITH a AS (SELECT p_partkey, p_name FROM part), b AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'x' || p_name WHEN 1 THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name END AS n FROM part WHERE p_partkey % 50 = 0)
 SELECT a.p_partkey, b.id, CAST(levenshtein(a.p_name, b.n) AS INTEGER) AS edits FROM a JOIN b ON levenshtein(a.p_name, b.n) BETWEEN 1 AND 2""")
def ent_near_names(spark, sf_dir):
    """Every fiftieth part's altered name is searched among all."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n = F.when(k % 4 == 0, F.concat(F.lit("x"), "p_name")).when(k % 4 == 1, F.expr("substr(p_name, 1, length(p_name) - 1)")).otherwise(F.col("p_name"))
    r = p.where(k % 50 == 0).select(k.alias("id"), n.alias("n"))
    return entity.near_names(p, r, "p_partkey", "p_name", "id", "n", 2)


@query(f"""WITH {POINTS}, a AS (SELECT id, lon, lat, 'Ramp ' || grp AS name, CASE WHEN id % 3 = 0 THEN NULL ELSE depth END AS v FROM points), b AS (SELECT id, lon + 0.00001 * (id % 100) - 0.0004 AS lon, lat, 'ramp-' || grp AS name, depth + 1 AS v FROM points),
 n AS (SELECT a.id AS i, b.id AS j, {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS m FROM a JOIN b ON replace(lower(b.name), '-', ' ') = lower(a.name) AND {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 50),
 p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY m, i) AS r FROM n) WHERE r = 1), p AS (SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY m, j) AS r FROM p1) WHERE r = 1)
 SELECT a.id, a.name, coalesce(a.v, b.v) AS v, CASE WHEN j IS NULL THEN 'left' ELSE 'both' END AS source FROM a LEFT JOIN p ON p.i = a.id LEFT JOIN b ON b.id = j UNION ALL SELECT id, name, v, 'right' FROM b WHERE id NOT IN (SELECT j FROM p)""")
def ent_merge_places(spark, sf_dir):
    p, g = points(spark, sf_dir), F.col("grp").cast("string")
    a = p.select("id", "lon", "lat", F.concat(F.lit("Ramp "), g).alias("name"), F.when(F.col("id") % 3 != 0, F.col("depth")).alias("v"))
    b = p.select("id", (F.col("lon") + 0.00001 * (F.col("id") % 100) - 0.0004).alias("lon"), "lat", F.concat(F.lit("ramp-"), g).alias("name"), (F.col("depth") + 1).alias("v"))
    return entity.merge_places(a, b, "id", "name", ["v"]).select("id", "name", "v", "source")


@query(f"""WITH {SERIES}, k AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM series WHERE value > 5),
 b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS slot FROM k WHERE r = 1) SELECT user_id, CAST(slot AS INTEGER) AS slot, event_id FROM b WHERE slot < 2""")
def rank_best_of_kinds(spark, sf_dir):
    return ranking.best_of_kinds(series(spark, sf_dir), ["user_id"], "event_type", "value", "event_id", 5.0)


@query(f"""WITH {CELLS}, o AS (SELECT unnest(range(-3, 4)) AS d), s AS (SELECT c.i + a.d AS i, c.j + b.d AS j, a.d * a.d + b.d * b.d AS q, c.i AS ci, c.j AS cj, c.low FROM cells c, o a, o b WHERE a.d * a.d + b.d * b.d <= 9),
 k AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY q, ci, cj) AS r FROM s) SELECT i, j, low, q > 0 AS filled FROM k WHERE r = 1""")
def raster_fill_fringe(spark, sf_dir):
    return raster.fill_fringe(cells(spark, sf_dir), [], "low", 3)


@query(f"""WITH {POINTS} SELECT id AS poly, round(lon, 6) AS x, round(lat, 6) AS y, 2.0::DOUBLE AS a, 0.0::DOUBLE AS b, 3.0::DOUBLE AS c, 1.0::DOUBLE AS d, 1.0::DOUBLE AS e, -1.0::DOUBLE AS f FROM points""")
def geo_affine(spark, sf_dir):
    """A point within each diamond, and the frame that maps (0,0), (1,0), (0,1) to (3,-1), (5,0), (3,0)."""
    m = geo.affine([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [(3.0, -1.0), (5.0, 0.0), (3.0, 0.0)])
    at = geo.inside_point(F.col("rings")[0])
    return diamonds(spark, sf_dir).select("poly", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"), *(F.round(m[k] + 0.0, 9).alias(k) for k in "abcdef"))


@query("""WITH s AS (SELECT p_partkey, (p_size % 20 + 1)::DOUBLE AS low, (p_size % 20 + 2 + p_partkey % 7)::DOUBLE AS high, p_partkey % 250 + 30 AS b, p_name FROM part)
 SELECT p_partkey, CASE WHEN b <= 200 THEN 2 ELSE 1 END AS n, low, high, 'fish' AS kind, CASE WHEN b <= 200 THEN 'water' END AS second, ' ' || p_name || ' ' AS part FROM s""")
def text_depth_ranges(spark, sf_dir):
    """Depths of fish and of the bottom in a sentence about every part; more than 200 feet are none."""
    k, s = F.col("p_partkey"), F.col("p_size") % 20 + 1
    t = F.concat(F.lit("Bass are holding "), s.cast("string"), F.lit("-"), (s + 1 + k % 7).cast("string"), F.lit(" feet. The bottom is at "), (k % 250 + 30).cast("string"), F.lit(" ft; a boat ran 900 feet "), F.col("p_name"))
    d = words.depth_ranges(t)
    part = words.between_markers(F.concat(F.lit("a [[1]] "), F.col("p_name"), F.lit(" [[2]] c")), r"\[\[1\]\]", r"\[\[2\]\]")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(d).alias("n"), d[0]["low"].alias("low"), d[0]["high"].alias("high"), d[0]["kind"].alias("kind"), F.get(d, 1)["kind"].alias("second"), part.alias("part"))


@query("""SELECT count(*) AS rows, count(CASE WHEN p_size > 25 THEN 1 END) AS large, count(CASE WHEN p_type = 'PROMO' THEN 1 END) AS promo FROM part""")
def agg_registry_counts(spark, sf_dir):
    return ranking.registry_counts(table(spark, sf_dir, "part"), {"large": F.col("p_size") > 25, "promo": F.col("p_type") == "PROMO"})
