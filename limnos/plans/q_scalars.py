"""Queries over scalar forms of texts, numbers and places, and over small joins of stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from limnos.functions import geo, numbers, words
from limnos.operators import binding, entity, lines, ranking
from limnos.plans.registry import query
from limnos.plans.surrogates import LEGS, POINTS, legs, points, table


@query("""WITH p AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 4 WHEN 0 THEN ' {"a": [' || p_size || ']} tail' WHEN 1 THEN ' <b>&"x"''' WHEN 2 THEN ' [1, 2' ELSE '' END AS t, CASE p_partkey % 5 WHEN 0 THEN ' yes ' WHEN 1 THEN 't' WHEN 2 THEN 'no' WHEN 3 THEN '  ' END AS flag FROM part)
 SELECT k, array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, nullif(regexp_extract(t, '(?s)(\\{.*\\}|\\[.*\\])', 1), '') AS json, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
 coalesce(upper(trim(flag)) IN ('Y', 'YES', 'TRUE', 'T', '1'), false) AS yes, coalesce(length(trim(flag)) > 0, false) AS told FROM p""")
def text_forms(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, F.concat(F.lit(' {"a": ['), F.col("p_size").cast("string"), F.lit("]} tail"))).when(k % 4 == 1, " <b>&\"x\"'").when(k % 4 == 2, " [1, 2").otherwise("")
    flag = F.when(k % 5 == 0, " yes ").when(k % 5 == 1, "t").when(k % 5 == 2, "no").when(k % 5 == 3, "  ")
    p = table(spark, sf_dir, "part").select(k.alias("k"), F.concat("p_name", tail).alias("t"), flag.alias("flag"))
    return p.select("k", words.title_case("t").alias("title"), words.embedded_json("t").alias("json"), words.escape_html("t").alias("html"), numbers.flag_is_yes("flag").alias("yes"), numbers.has_text("flag").alias("told"))


@query("""SELECT event_id AS k, round(CASE event_id % 4 WHEN 0 THEN value * 1000 WHEN 1 THEN value WHEN 2 THEN value * 35.3146667 END, 6) AS cfs, round(value * 1.8 + 32 + 1e-7, 1) AS deg_f, round(abs(value * sin(radians(200.0 - event_id % 360))), 6) AS across FROM events""")
def num_units(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").withColumn("unit", F.get(F.array(*map(F.lit, ("KCFS", "cfs", "cms", "ft"))), (k % 4).cast("int")))
    return e.select(k.alias("k"), F.round(numbers.to_cfs("value", "unit"), 6).alias("cfs"), numbers.c_to_f(F.col("value") + 1e-7 / 1.8).alias("deg_f"), F.round(geo.cross_wind(k % 360, F.lit(200.0), "value"), 6).alias("across"))


#: Feet between two points of a DuckDB row on the sphere.
FEET = "2 * 20902231.0 * asin(least(1.0, sqrt(power(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * power(sin(radians({2} - {0}) / 2), 2))))"


@query(f"""WITH {LEGS} SELECT id, round(sqrt(power(greatest(0, -81.05 - lon, lon + 80.95) * cos(radians(lat)) * 111320.0, 2) + power(greatest(0, 33.95 - lat, lat - 34.05) * 110570.0, 2)) / 1000, 6) AS outside_km,
 round(least({FEET.format('-81.0', '34.0', 'lon', 'lat')}, {FEET.format('-81.0', '34.0', 'lon2', 'lat2')}), 3) AS near_ft, abs(lon2 - lon) <= 0.1 AND abs(lat2 - lat) <= 0.1 AS fits, round(lon2, 3) AS x2 FROM legs""")
def geo_scalars(spark, sf_dir):
    v = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    d = legs(spark, sf_dir).withColumn("line", F.array(v("lon", "lat"), v("lon2", "lat2")))
    outside = geo.km_outside_box("lon", "lat", (-81.05, 33.95, -80.95, 34.05))
    near = geo.vertex_distance_ft(F.lit(34.0), F.lit(-81.0), "line")
    fits = ranking.span_within(F.col("line"), (0.0, 0.0, 0.1, 0.1))
    return d.select("id", F.round(outside, 6).alias("outside_km"), F.round(near, 3).alias("near_ft"), fits.alias("fits"), geo.rounded_line("line", 3)[1]["x"].alias("x2"))


@query(f"""WITH {POINTS}, t AS (SELECT id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(lon, 2) OVER w AS lon3, lead(lat, 2) OVER w AS lat3 FROM points WINDOW w AS (PARTITION BY grp ORDER BY id)),
 m AS (SELECT id, (lon2 - lon) * k AS qx, (lat2 - lat) * 110570.0 AS qy, (lon3 - lon) * k AS cx, (lat3 - lat) * 110570.0 AS cy FROM (SELECT *, 111320.0 * cos(radians((lat + lat2 + lat3) / 3)) AS k FROM t WHERE lon3 IS NOT NULL)),
 f AS (SELECT *, greatest(0, least(1, (qx * cx + qy * cy) / (cx * cx + cy * cy))) AS s FROM m) SELECT id, CASE WHEN sqrt(power(qx - s * cx, 2) + power(qy - s * cy, 2)) > 6000 THEN 3 ELSE 2 END AS kept FROM f""")
def lines_simplified(spark, sf_dir):
    """Lines of three points: the middle one stays if it stands off the chord by over 6 km."""
    w = Window.partitionBy("grp").orderBy("id")
    v = lambda k: F.struct(F.lead("lon", k).over(w).alias("x"), F.lead("lat", k).over(w).alias("y"))
    p = points(spark, sf_dir).select("id", F.array(v(0), v(1), v(2)).alias("line")).where("line[2].x is not null")
    return lines.simplified(p, "line", 6000.0, "less").select("id", F.size("less").alias("kept"))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), a AS (SELECT k, n, 'base' AS side FROM s UNION ALL SELECT k, n, 'more' FROM c WHERE k NOT IN (SELECT k FROM s)),
 d AS (SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT k FROM c WHERE n < 12) AND p_partkey NOT IN (SELECT k FROM s)) SELECT k, n, side FROM a UNION ALL SELECT k, NULL, 'default' FROM d""")
def store_missing(spark, sf_dir):
    """Suppliers and the customers whose keys they lack; parts as defaults that are neither saved nor seen."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.lit("base").alias("side"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.lit("more").alias("side"))
    fresh = entity.new_defaults(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), c.where("n < 12"), s, "k")
    return entity.append_missing(s, c, ["k"]).unionByName(fresh.withColumn("side", F.lit("default")), allowMissingColumns=True)


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS brand, p_type AS kind, p_name AS box, CASE WHEN p_size % 3 > 0 THEN 'confirmed' ELSE 'refused' END AS verdict FROM part),
 c AS (SELECT kind, count(DISTINCT box) AS n FROM p WHERE verdict = 'confirmed' GROUP BY kind HAVING count(DISTINCT box) > 1)
 SELECT k, nullif(lower(trim(regexp_replace('{' || upper(brand) || '} ', '[{}]', '', 'g'))), '') AS pid, list_has_all(string_split(lower(kind), ' '), string_split(lower(box), ' ')) OR list_has_all(string_split(lower(box), ' '), string_split(lower(kind), ' ')) AS holds, coalesce(n, 0) AS clashes FROM p LEFT JOIN c USING (kind)""")
def ent_forms(spark, sf_dir):
    """Ids without braces, token sets that hold each other, names that confirmed rows give to several."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand", F.col("p_type").alias("kind"), F.col("p_name").alias("box"), F.when(F.col("p_size") % 3 > 0, "confirmed").otherwise("refused").alias("verdict"))
    n = binding.clashes(p, F.col("kind"), "box").withColumnRenamed("alias", "kind")
    holds = entity.containment(F.split(F.lower("kind"), " "), F.split(F.lower("box"), " "))
    out = p.join(n, "kind", "left")
    return out.select("k", entity.pid(F.concat(F.lit("{"), F.upper("p_brand"), F.lit("} "))).alias("pid"), holds.alias("holds"), F.coalesce("n", F.lit(0).cast("long")).alias("clashes"))


PHRASES = ("Main lake points", "creek mouth", "Brush piles in timber", "current breaks", "lower lake", " ", "steep bluff walls", "flats by the bridge", "docks")
BASE = {"timber": 27, "attractor": 27, "point": 11, "creek_mouth": 10, "shallow": 8, "ledge": 4, "hump": 3, "pile": 3, "bridge": 0, "dock": 4}
RELIEF = {"channel_edge": 12, "break": 6, "flat": 8, "steep_bank": 4}


@query(f"""WITH p AS (SELECT p_partkey AS k, list_filter([{", ".join("'" + x + "'" for x in PHRASES)}], lambda x, i: (p_partkey >> i) % 2 = 1 AND trim(x) <> '') AS said FROM part),
 h AS (SELECT k, said, len(list_filter(said, lambda x: regexp_matches(x, '(?i)timber|laydown|stump|brush|wood|treetop'))) > 0 AS wood, len(list_filter(said, lambda x: regexp_matches(x, '(?i)attractor|fish habitat|reef ball|brush\\s*pile'))) > 0 AS pile,
  len(list_filter(said, lambda x: regexp_matches(x, '(?i)\\bpoint'))) > 0 AS point, len(list_filter(said, lambda x: regexp_matches(x, '(?i)break'))) > 0 AS brk, len(list_filter(said, lambda x: regexp_matches(x, '(?i)bridge|causeway|piling'))) > 0 AS bridge FROM p)
 SELECT k, CASE WHEN wood THEN 54.0::DOUBLE ELSE 27.0 END AS timber, CASE WHEN wood OR pile THEN 54.0::DOUBLE ELSE 27.0 END AS attractor, CASE WHEN pile OR bridge THEN 30.0::DOUBLE ELSE 3.0 END AS pile, 0.0::DOUBLE AS bridge, CASE WHEN point THEN 38.0::DOUBLE ELSE 11.0 END AS point,
 CASE WHEN brk THEN 33.0::DOUBLE ELSE 6.0 END AS brk, list_filter(said, lambda x: x IN ('lower lake', 'docks')) AS unmatched FROM h""")
def rank_structure_weights(spark, sf_dir):
    """Weights led by every set of phrases that a part's number picks."""
    said = F.filter(F.array(*map(F.lit, PHRASES)), lambda x, i: F.call_function("shiftright", F.col("p_partkey"), i + 1) % 2 == 1)
    w = ranking.structure_weights(said, BASE, RELIEF)
    out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), w.alias("w"))
    return out.select("k", *(F.col("w.weights")[t].alias(t) for t in ("timber", "attractor", "pile", "bridge", "point")), F.col("w.relief")["break"].alias("brk"), "w.unmatched")
