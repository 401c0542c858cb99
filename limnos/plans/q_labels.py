"""Queries over labels of features, names, catches and weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import labels
from limnos.operators import entity
from limnos.plans.registry import query
from limnos.plans.surrogates import POINTS, points, table

TAGS = """t AS (SELECT p_partkey, p_size AS s, CASE p_partkey % 8 WHEN 0 THEN 'waterway' WHEN 1 THEN 'man_made' WHEN 2 THEN 'leisure' WHEN 3 THEN 'natural' WHEN 4 THEN 'bridge' WHEN 5 THEN 'seamark:type' WHEN 6 THEN 'place' ELSE 'submerged' END AS k,
 CASE p_partkey % 8 WHEN 0 THEN ['dam','boat_slipway','dock','river'][p_size % 4 + 1] WHEN 1 THEN ['pier','groyne','buoy','jetty'][p_size % 4 + 1] WHEN 2 THEN ['slipway','marina','fishing','park'][p_size % 4 + 1] WHEN 3 THEN ['rock','reef','island','tree'][p_size % 4 + 1]
  WHEN 4 THEN 'yes' WHEN 5 THEN ['buoy_lateral','wreck','mooring','light'][p_size % 4 + 1] WHEN 6 THEN ['islet','town','island','city'][p_size % 4 + 1] ELSE ['yes','no','yes','maybe'][p_size % 4 + 1] END AS v,
 CASE p_size % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'primary' END AS hw FROM part)"""


def tagged(spark, sf_dir):
    """Parts as map features: one tag each by their key, and a highway for two thirds."""
    k, s = F.col("p_partkey"), F.col("p_size")
    names = F.array(*map(F.lit, ("waterway", "man_made", "leisure", "natural", "bridge", "seamark:type", "place", "submerged")))
    of = {0: "dam boat_slipway dock river", 1: "pier groyne buoy jetty", 2: "slipway marina fishing park", 3: "rock reef island tree", 4: "yes yes yes yes", 5: "buoy_lateral wreck mooring light", 6: "islet town island city", 7: "yes no yes maybe"}
    values = F.array(*(F.array(*map(F.lit, v.split())) for v in of.values()))
    value = F.get(F.get(values, (k % 8).cast("int")), (s % 4).cast("int"))
    road = F.when(s % 3 == 0, F.create_map(F.lit("highway"), F.lit("path"))).when(s % 3 == 1, F.create_map(F.lit("highway"), F.lit("primary"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.map_concat(F.create_map(F.get(names, (k % 8).cast("int")), value), road).alias("tags"))


@query(f"""WITH {TAGS} SELECT p_partkey, CASE WHEN k = 'waterway' AND v = 'dam' THEN 'DAM' WHEN v IN ('boat_slipway', 'slipway') THEN 'BOAT_RAMP' WHEN v IN ('dock', 'pier') THEN 'PIER' WHEN v = 'groyne' THEN 'GROYNE' WHEN v = 'buoy' THEN 'HAZARD_MARKER' WHEN v = 'rock' OR (k = 'submerged' AND v = 'yes') THEN 'HAZARD'
  WHEN k = 'bridge' THEN CASE hw WHEN 'path' THEN 'FOOT_BRIDGE' WHEN 'primary' THEN 'ROAD_BRIDGE' ELSE 'BRIDGE' END WHEN v IN ('island', 'islet') THEN 'ISLAND' ELSE 'OTHER' END AS kind,
 CASE WHEN k = 'waterway' AND v = 'dam' THEN 'DAM' WHEN v IN ('boat_slipway', 'slipway') THEN 'BOAT_RAMP' WHEN v IN ('dock', 'marina') THEN 'MARINA' WHEN v = 'pier' THEN 'PIER' WHEN v = 'jetty' THEN 'JETTY' WHEN v = 'groyne' THEN 'GROYNE' WHEN v IN ('buoy', 'buoy_lateral') THEN 'NAV_BUOY' WHEN v = 'light' THEN 'NAV_LIGHT' WHEN v = 'mooring' THEN 'MOORING' WHEN v = 'wreck' THEN 'HAZARD'
  WHEN v = 'reef' THEN 'REEF_SHOAL' WHEN v = 'rock' OR (k = 'submerged' AND v = 'yes') THEN 'HAZARD' WHEN v = 'fishing' THEN 'FISH_ATTRACTOR' WHEN k = 'natural' AND v = 'island' THEN 'SHORELINE' WHEN v IN ('island', 'islet') THEN 'ISLAND' WHEN k = 'bridge' THEN CASE hw WHEN 'path' THEN 'FOOT_BRIDGE' WHEN 'primary' THEN 'ROAD_BRIDGE' ELSE 'BRIDGE' END ELSE 'OTHER' END AS coastal,
 CASE WHEN k = 'bridge' THEN hw IS NOT NULL WHEN k = 'submerged' THEN v = 'yes' WHEN k = 'seamark:type' THEN true ELSE v NOT IN ('river', 'park', 'tree', 'town', 'city') END AS wanted FROM t""")
def label_tags(spark, sf_dir):
    return tagged(spark, sf_dir).select("p_partkey", labels.kind_of("tags").alias("kind"), labels.kind_of("tags", labels.COASTAL_KINDS).alias("coastal"), labels.worth_keeping("tags").alias("wanted"))


@query(f"""WITH {POINTS}, d AS (SELECT id, CASE WHEN id % 11 <> 0 THEN depth * 4 END AS d FROM points) SELECT id, CASE WHEN d <= 2 THEN '#b71c1c' WHEN d <= 4 THEN '#e63946' WHEN d <= 8 THEN '#f4795b' WHEN d <= 20 THEN '#f4a261' WHEN d <= 28 THEN '#e9c46a' WHEN d <= 36 THEN '#2a9d8f' WHEN d <= 45 THEN '#00e5ff' WHEN d <= 55 THEN '#0077b6' WHEN d <= 65 THEN '#7b2d8b' ELSE '#ffffff' END AS sounding,
 CASE WHEN coalesce(floor(d), 0) <= 10 THEN '#4dd0e1' WHEN floor(d) <= 20 THEN '#4db6ac' WHEN floor(d) <= 30 THEN '#66bb6a' WHEN floor(d) <= 50 THEN '#aed581' WHEN floor(d) <= 70 THEN '#fff176' WHEN floor(d) <= 90 THEN '#ffb74d' ELSE '#ef5350' END AS contour FROM d""")
def label_colours(spark, sf_dir):
    d = F.when(F.col("id") % 11 != 0, F.col("depth") * 4)
    return points(spark, sf_dir).select("id", labels.sounding_colour(d).alias("sounding"), labels.contour_colour(F.concat(F.lit("-"), F.floor(d).cast("string"), F.lit(" ft"))).alias("contour"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Elev' WHEN 1 THEN 'maxDepth' WHEN 2 THEN 'z' END AS name FROM part""")
def label_depth_property(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    m = F.when(k % 4 == 0, F.create_map(F.lit("maxDepth"), n, F.lit("Elev"), n)).when(k % 4 == 1, F.create_map(F.lit("depthNote"), F.lit("none"), F.lit("maxDepth"), n)).when(k % 4 == 2, F.create_map(F.lit("z"), n)).otherwise(F.create_map(F.lit("name"), n))
    return table(spark, sf_dir, "part").select("p_partkey", labels.depth_property(m).alias("name"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Live ' || p_name WHEN 1 THEN p_name || ' down-line' WHEN 2 THEN 'Widget Ramp (' || p_name || ')' WHEN 3 THEN '' ELSE p_name END AS n FROM part),
 w AS (SELECT *, list_filter(string_split_regex(lower(n), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('ramp', 'boat', 'widget', 'small')) AS w FROM n)
 SELECT p_partkey, contains(lower(n), 'live') OR contains(lower(n), 'down-line') AS live, CAST(len(w) > 0 AS INTEGER) AS named, CAST(len(w) AS INTEGER) AS words, CAST(n <> '' AND NOT contains(n, '(') AS INTEGER) AS tidy FROM w""")
def label_names(spark, sf_dir):
    k, p = F.col("p_partkey") % 5, F.col("p_name")
    n = F.when(k == 0, F.concat(F.lit("Live "), p)).when(k == 1, F.concat(p, F.lit(" down-line"))).when(k == 2, F.concat(F.lit("Widget Ramp ("), p, F.lit(")"))).when(k == 3, "").otherwise(p)
    q = labels.name_quality(n, ("ramp", "boat"), F.array(F.lit("widget"), F.lit("small")))
    return table(spark, sf_dir, "part").select("p_partkey", labels.live_bait(n).alias("live"), q["named"].alias("named"), q["words"].alias("words"), q["tidy"].alias("tidy"))


CATCH = """c AS (SELECT event_id, ['Striper', 'Mudfish', 'None', 'Unknown', 'Walleye', 'Black Bass'][event_id % 6 + 1] AS s, ['a striper today', 'nice redfish', 'nothing', 'two shellcracker and a gar', 'channel cat'][event_id % 5 + 1] AS n, value FROM events)"""


@query(f"""WITH {CATCH}, k AS (SELECT *, CASE s WHEN 'Striper' THEN 'Striped Bass' WHEN 'Mudfish' THEN 'Bowfin' WHEN 'None' THEN '' WHEN 'Black Bass' THEN 'Largemouth Bass' ELSE s END AS own, CASE event_id % 5 WHEN 0 THEN 'Striped Bass' WHEN 1 THEN 'Red Drum (Redfish)' WHEN 3 THEN 'Sunfish (Panfish)' WHEN 4 THEN 'Catfish' END AS told FROM c),
 f AS (SELECT *, own IN ('', 'Unknown') AND told IS NOT NULL AS inferred FROM k)
 SELECT event_id, CASE WHEN inferred THEN told ELSE own END AS species, inferred, CASE WHEN contains(lower(s || n), 'stripe') THEN 'Striped Bass' WHEN contains(lower(s || n), 'bass') THEN 'Largemouth Bass' WHEN contains(lower(s || n), 'red') THEN 'Redfish' ELSE 'Fish' END AS waypoint,
 CASE WHEN value = 0 THEN 'ok' WHEN value > CASE own WHEN 'Striped Bass' THEN 58 WHEN 'Bowfin' THEN 42.5 ELSE 60 END THEN 'too long' WHEN value < 3 THEN 'too short' ELSE 'ok' END AS length FROM f""")
def label_catches(spark, sf_dir):
    i = F.col("event_id")
    s = F.get(F.array(*map(F.lit, ("Striper", "Mudfish", "None", "Unknown", "Walleye", "Black Bass"))), (i % 6).cast("int"))
    n = F.get(F.array(*map(F.lit, ("a striper today", "nice redfish", "nothing", "two shellcracker and a gar", "channel cat"))), (i % 5).cast("int"))
    told = labels.species_or_inferred(s, n)
    return table(spark, sf_dir, "events").select(
        "event_id", told["species"].alias("species"), told["inferred"].alias("inferred"), labels.waypoint_species(s, n).alias("waypoint"), labels.plausible_length(labels.clean_species(s), "value", {"Striped Bass": 58, "Bowfin": 42.5}).alias("length")
    )


@query("""WITH w AS (SELECT event_id, ['Partly Cloudy', 'Overcast', 'Mostly Clear', '40', '0.3', 'windy', NULL][event_id % 7 + 1] AS w, event_id % 3 AS p, ts FROM events), c AS (SELECT *, CASE event_id % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 WHEN 2 THEN 0.2 WHEN 3 THEN 0.4 WHEN 4 THEN 0.3 END AS c, CASE p WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.25 END AS b FROM w)
 SELECT event_id, CAST(c AS DOUBLE) AS cloud, CAST(coalesce(floor(least(1.0, b::DOUBLE + c::DOUBLE * (1 - b::DOUBLE) * 0.6::DOUBLE) * 100 + 0.5) / 100, b) AS DOUBLE) AS light, strftime(ts, '%Y%m%d') AS day, date_trunc('minute', ts) AS at FROM c""")
def label_weather(spark, sf_dir):
    i, ts = F.col("event_id"), F.col("ts")
    w = F.get(F.array(*map(F.lit, ("Partly Cloudy", "Overcast", "Mostly Clear", "40", "0.3", "windy", None))), (i % 7).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", labels.cloud_share(w).alias("cloud"), labels.low_light(i % 3, w).alias("light"), labels.station_day(F.date_format(ts, "yyyy-MM-dd")).alias("day"), labels.station_time(F.date_format(ts, "yyyy-MM-dd HH:mm")).alias("at"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'bass|crappie' WHEN 1 THEN 'bass|gar|carp' WHEN 2 THEN '' ELSE 'x ' || c_custkey END AS species, CASE c_custkey % 4 WHEN 0 THEN 'bass|crappie' WHEN 1 THEN 'bass/gar and carp' WHEN 2 THEN '' ELSE 'x ' || c_custkey END AS stocked,
 CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a=1' ELSE 'a=1,b=' || c_custkey END AS kept, CASE c_custkey % 3 WHEN 0 THEN 'k.x=9' WHEN 1 THEN 'a=1,k.x=9' ELSE 'a=1,b=' || c_custkey || ',k.x=9' END AS placed FROM customer""")
def nested_coerced(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    v = F.when(k % 4 == 0, '["bass", " crappie ", ""]').when(k % 4 == 1, "bass/gar and carp").when(k % 4 == 3, F.concat(F.lit("x "), s))
    # Records of stockings, prose without commas, none, and one name.
    r = F.when(k % 4 == 0, '[{"species": "bass", "year": "1999"}, {"species": "crappie"}, {"year": "2001"}]').otherwise(v)
    m = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit(""))).when(k % 3 == 1, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), s))
    told = lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    base = F.coalesce(labels.kept_entries(m), F.create_map().cast("map<string,string>"))
    placed = labels.with_path(F.map_concat(base, F.create_map(F.lit("k"), F.lit("old"))), F.lit("k.x"), F.lit("9"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(labels.listed(v), "|").alias("species"), F.array_join(F.transform(labels.stockings(r), lambda x: x["species"]), "|").alias("stocked"), told(labels.kept_entries(m)).alias("kept"), told(placed).alias("placed"))


@query("""WITH q AS (SELECT DISTINCT o_custkey % 7 * 100 + o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT c_custkey, c_custkey % 7 * 100 + c_custkey NOT IN (SELECT k FROM q) AS served FROM customer""")
def store_quarantined(spark, sf_dir):
    """Documents are served unless their key was set aside."""
    key = lambda c: F.col(c) % 7 * 100 + F.col(c)
    aside = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(key("o_custkey").alias("k")).distinct()
    c = table(spark, sf_dir, "customer").select("c_custkey", key("c_custkey").alias("k"))
    return c.join(aside.withColumn("hit", F.lit(1)), "k", "left").select("c_custkey", F.col("hit").isNull().alias("served"))


@query("""SELECT s_nationkey AS water, s_suppkey AS cam, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) AS place FROM supplier""")
def ent_unique_by_name(spark, sf_dir):
    """Each camera of a water once, in the order of their names, whatever feeds repeat it."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("water"), F.col("s_suppkey").alias("cam"), F.col("s_name").alias("name"))
    once = entity.prefer(s.unionByName(s), ["water", "cam"], F.col("name"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("water").orderBy("name", "cam")).cast("long"))


@query(f"""WITH {CATCH}, k AS (SELECT *, CASE s WHEN 'Striper' THEN 'Striped Bass' WHEN 'Mudfish' THEN 'Bowfin' WHEN 'None' THEN '' WHEN 'Black Bass' THEN 'Largemouth Bass' ELSE s END AS own, CASE event_id % 5 WHEN 0 THEN 'Striped Bass' WHEN 1 THEN 'Red Drum (Redfish)' WHEN 3 THEN 'Sunfish (Panfish)' WHEN 4 THEN 'Catfish' END AS told FROM c),
 f AS (SELECT *, own IN ('', 'Unknown') AND told IS NOT NULL AS inf FROM k), g AS (SELECT *, CASE WHEN inf THEN told ELSE own END AS kind FROM f)
 SELECT event_id, concat_ws(',', CASE WHEN value < 20 THEN 'not_fish_or_rejected' END, CASE WHEN event_id % 3 = 0 THEN 'verify_board_length_from_photo' END, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'board_missing_length' END, CASE WHEN kind IN ('', 'Unknown') THEN 'species_needs_review' END, CASE WHEN inf THEN 'inferred_from_notes' END,
  CASE WHEN event_id % 4 = 0 THEN 'low_confidence' END, CASE WHEN own <> kind AND kind <> '' THEN 'species_normalized' END) AS flags FROM g""")
def label_review(spark, sf_dir):
    i = F.col("event_id")
    s = F.get(F.array(*map(F.lit, ("Striper", "Mudfish", "None", "Unknown", "Walleye", "Black Bass"))), (i % 6).cast("int"))
    n = F.get(F.array(*map(F.lit, ("a striper today", "nice redfish", "nothing", "two shellcracker and a gar", "channel cat"))), (i % 5).cast("int"))
    flags = labels.review_flags(F.col("value") >= 20, i % 3 == 0, F.when(i % 2 == 1, "12 in"), s, n, F.when(i % 4 == 0, "Low (0.3)").otherwise("high"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(flags, ",").alias("flags"))
