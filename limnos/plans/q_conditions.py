"""Queries over readings, names, rankings and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import words
from limnos.operators import conditions, ranking
from limnos.plans.registry import query
from limnos.plans.surrogates import POINTS, SERIES, metres, points, series, table


@query(f"""WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, value DESC) AS r FROM series)
 SELECT user_id, event_type, value, t, 1706745600 - t AS age_s, 1706745600 - t > 172800 AS stale FROM k WHERE r = 1""")
def cond_latest_reading(spark, sf_dir):
    return conditions.latest_reading(series(spark, sf_dir), ["user_id", "event_type"], "t", "value", F.lit(1706745600).cast("long"), 172800)


@query("""WITH p AS (SELECT DISTINCT o_custkey AS k, dayofyear(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'F'), v AS (SELECT k, d, (k * 31 + d * 7) % 100 AS v FROM p),
 s AS (SELECT k, d + x AS d, v FROM v, (SELECT unnest([-365, 0, 365]) AS x)), n AS (SELECT *, lead(d) OVER (PARTITION BY k ORDER BY d) AS nd, lead(v) OVER (PARTITION BY k ORDER BY d) AS nv FROM s),
 q AS (SELECT c_custkey AS k, c_custkey % 365 + 1 AS day FROM customer)
 SELECT q.k, CAST(q.day AS BIGINT) AS day, round(n.v + (q.day - n.d) * (n.nv - n.v) / (n.nd - n.d), 6) AS level FROM q JOIN n ON q.k = n.k AND n.d <= q.day AND q.day < n.nd""")
def cond_seasonal_level(spark, sf_dir):
    p = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.dayofyear("o_orderdate").alias("d")).distinct()
    p = p.withColumn("v", (F.col("k") * 31 + F.col("d") * 7) % 100)
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 365 + 1).alias("day"))
    out = conditions.seasonal_value(p, "k", "d", "v", q, "day", linear=True)
    return out.where("level is not null").withColumn("level", F.round("level", 6))


@query(f"""WITH {SERIES}, p AS (SELECT event_type, quantile_disc(value, 0.1) AS p10, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM series GROUP BY 1)
 SELECT event_id, CASE WHEN value < p10 THEN 'below the 10th percentile' WHEN value < p50 THEN 'between the 10th and 50th percentile' WHEN value < p90 THEN 'between the 50th and 90th percentile' ELSE 'above the 90th percentile' END AS band FROM series JOIN p USING (event_type)""")
def cond_stat_band(spark, sf_dir):
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    s = series(spark, sf_dir)
    p = s.groupBy("event_type").agg(disc(0.1).alias("p10"), disc(0.5).alias("p50"), disc(0.9).alias("p90"))
    return s.join(F.broadcast(p), "event_type").select("event_id", conditions.stat_band(F.col("value"), [(10, F.col("p10")), (50, F.col("p50")), (90, F.col("p90"))]).alias("band"))


@query(f"""WITH {SERIES}, e AS (SELECT user_id, t, min(CASE WHEN event_id % 2 = 0 THEN 'H' ELSE 'L' END) AS k FROM series WHERE event_type IN ('view','click') GROUP BY ALL), q AS (SELECT user_id, event_id, t FROM series WHERE event_type = 'purchase'),
 p AS (SELECT q.*, (SELECT max(e.t) FROM e WHERE e.user_id = q.user_id AND e.t <= q.t) AS pt, (SELECT min(e.t) FROM e WHERE e.user_id = q.user_id AND e.t > q.t) AS nt FROM q),
 x AS (SELECT p.*, a.k AS pk, b.k AS nk FROM p LEFT JOIN e a ON a.user_id = p.user_id AND a.t = pt LEFT JOIN e b ON b.user_id = p.user_id AND b.t = nt),
 c AS (SELECT *, CASE WHEN t - pt <= 2700 THEN pk WHEN nt - t <= 2700 THEN nk END AS ck FROM x)
 SELECT event_id, CASE WHEN ck = 'H' THEN 'high' WHEN ck = 'L' THEN 'low' WHEN coalesce(nk = 'H', pk <> 'H') THEN 'flood' WHEN NOT coalesce(nk = 'H', pk <> 'H') THEN 'ebb' END AS stage FROM c""")
def cond_tide_stage(spark, sf_dir):
    s = series(spark, sf_dir)
    e = s.where("event_type in ('view','click')").groupBy("user_id", "t").agg(F.min(F.when(F.col("event_id") % 2 == 0, "H").otherwise("L")).alias("k"))
    q = s.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t").alias("qt"))
    return conditions.tide_stage(e, "user_id", "t", "k", q, "qt").select("event_id", "stage")


@query(f"""WITH {SERIES}, h AS (SELECT user_id, t, value AS kmh, CASE WHEN event_id % 3 = 0 THEN value * 1.5 END AS gust, CAST(event_id % 100 AS INTEGER) AS code, event_id FROM series WHERE t BETWEEN 1704844800 AND 1705449600),
 m AS (SELECT *, CAST(floor(kmh * 0.621371::DOUBLE + 0.5) AS INTEGER) AS mph, CAST(floor(gust * 0.621371::DOUBLE + 0.5) AS INTEGER) AS g FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(g, mph) DESC, t, event_id) AS r FROM m)
 SELECT user_id, CAST(count(*) AS INTEGER) AS hours, CAST(max(CASE WHEN r = 1 THEN coalesce(g, mph) END) AS INTEGER) AS worst, max(CASE WHEN r = 1 THEN t END) AS worst_t, CAST(count(CASE WHEN code >= 95 THEN 1 END) AS INTEGER) AS thunder, CAST(count(CASE WHEN code BETWEEN 61 AND 67 OR code BETWEEN 80 AND 82 THEN 1 END) AS INTEGER) AS rain FROM k GROUP BY user_id""")
def cond_hourly_wind(spark, sf_dir):
    item = F.struct("t", "event_id", F.col("value").alias("kmh"), F.when(F.col("event_id") % 3 == 0, F.col("value") * 1.5).alias("gust"), (F.col("event_id") % 100).cast("int").alias("code"))
    by = series(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("h"))
    by = by.select("user_id", conditions.hourly_window(F.col("h"), F.lit(1704844800), F.lit(1705449600)).alias("w")).where("size(w) > 0")
    worst = conditions.worst_wind(F.col("w"))
    return by.select("user_id", F.size("w").alias("hours"), F.coalesce(worst["gust"], worst["mph"]).alias("worst"), worst["t"].alias("worst_t"), F.size(F.filter("w", lambda x: x["thunder"])).alias("thunder"), F.size(F.filter("w", lambda x: x["rain"])).alias("rain"))


@query(f"""WITH {SERIES}, m AS (SELECT user_id, avg(value) AS m FROM series GROUP BY 1), l AS (SELECT user_id, arg_max(value, event_id) AS c FROM series GROUP BY 1)
 SELECT user_id, round(least(1.0, greatest(0.0, (c / m - 1.3::DOUBLE) / (2.5::DOUBLE - 1.3::DOUBLE))), 3) AS severity FROM m JOIN l USING (user_id)""")
def cond_intrusion(spark, sf_dir):
    by = series(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("m"), F.max_by("value", "event_id").alias("c"))
    return by.select("user_id", conditions.severity_ramp(F.col("c"), F.col("m")).alias("severity"))


@query(f"""WITH {SERIES}, f AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN event_id END) AS v, min(CASE WHEN event_type = 'error' THEN event_id END) AS e FROM series GROUP BY 1)
 SELECT f.user_id, a.value AS temp, v AS temp_site, b.value AS salt, e AS salt_site FROM f LEFT JOIN series a ON a.event_id = v LEFT JOIN series b ON b.event_id = e""")
def cond_first_sites(spark, sf_dir):
    kind = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    s = series(spark, sf_dir).select("user_id", "event_id", kind("view").alias("temp"), kind("error").alias("salt"))
    return conditions.charge_first(s, ["user_id"], "event_id", ["temp", "salt"])


@query("""WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, 'saint ' || p_name AS base, ['SC', 'GA', 'TN'][p_size % 3 + 1] AS state, w[1] || ' ' || upper(w[2][1]) || w[2][2:] AS camel, p_name || '|' || p_brand AS forms, p_name || '|' || p_type || '|' || p_brand AS items, p_size::DOUBLE AS low, CAST(p_partkey % 9 + 1 AS INTEGER) AS creel,
 CASE p_partkey % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'academic' ELSE 'other' END AS auth, CASE WHEN p_partkey % 2 = 0 THEN 'Lake ' || w[1] END AS named, printf('%08x', list_reduce(list_transform(string_split(p_name, ''), lambda x: CAST(ord(x) AS UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS UBIGINT))) AS id FROM p""")
def text_scalars(spark, sf_dir):
    """Parts' names as waters' and species' names, their sizes and keys as limits."""
    k, name, brand, size = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    w = F.split(name, " ")
    host = F.when(k % 3 == 0, "dnr.sc.gov").when(k % 3 == 1, "x.edu").otherwise("y.com")
    state = F.get(F.array(*map(F.lit, ("sc", "GA", "tn"))), (F.col("p_size") % 3).cast("int"))
    body = F.concat(F.lit("fish in "), w[0], F.when(k % 2 == 0, " lake today").otherwise(" lake county"))
    rule = F.concat(size, F.lit(" inch minimum size, "), (k % 9 + 1).cast("string"), F.lit(" fish per person"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        words.base_name(F.concat(F.lit("Lk. St. "), name, F.lit(" ("), brand, F.lit("), "), state)).alias("base"),
        words.state_of(F.concat(name, F.lit(", "), state)).alias("state"),
        words.split_camel(F.concat(w[0], F.initcap(w[1]))).alias("camel"),
        F.array_join(words.name_forms(F.concat(name, F.lit(" ("), brand, F.lit(")"))), "|").alias("forms"),
        F.array_join(words.split_list(F.concat(name, F.lit(", "), F.col("p_type"), F.lit(" and "), brand)), "|").alias("items"),
        words.size_limit(rule)["min"].alias("low"),
        words.creel_limit(rule).alias("creel"),
        words.authority(F.concat(F.lit("https://"), host, F.lit("/"), size)).alias("auth"),
        words.names_water(body, F.array(F.concat(F.lit("Lake "), brand), F.concat(F.lit("Lake "), w[0]))).alias("named"),
        words.fnv1a(name).alias("id"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT)::VARCHAR AS k, value AS top, CASE WHEN 30 <= value THEN value + 10 ELSE least(value + 10, 30) END AS bottom, 30 <= value AS conflict FROM events""")
def nested_paths(spark, sf_dir):
    c = words.clamp_to_oxygen(F.col("value"), F.col("value") + 10, F.lit(30.0))
    return table(spark, sf_dir, "events").select("event_id", words.value_at("props", "k").alias("k"), c["top"].alias("top"), c["bottom"].alias("bottom"), c["conflict"].alias("conflict"))


@query("""WITH w AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 3.0 END AS acres, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 0.0 ELSE 0.5 END AS charted, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS open FROM part)
 SELECT p_partkey, (acres IS NULL OR acres >= 50) AND (charted IS NULL OR charted > 0) AS fishable, coalesce(charted > 0, false) AS charted_only, coalesce(open, true) AS is_open, NOT (coalesce(acres < 20, false) OR coalesce(charted = 0, false)) AS keep FROM w""")
def filter_presets(spark, sf_dir):
    s = F.col("p_size")
    w = table(spark, sf_dir, "part").select("p_partkey", F.when(s % 7 != 0, s * 3.0).alias("acres"), F.when(s % 5 == 1, 0.0).when(s % 5 != 0, 0.5).alias("charted"), F.when(s % 3 != 0, s % 3 == 1).alias("open"))
    cut = ranking.cut(w, [F.col("acres") < 20, F.col("charted") == 0])
    return cut.select("p_partkey", ranking.preset("fishable").alias("fishable"), ranking.preset("charted").alias("charted_only"), ranking.preset("open").alias("is_open"), "keep")


@query(f"""WITH {POINTS}, n AS (SELECT a.id, a.depth, {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS m, CASE b.id % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE -0.5 END AS w FROM points a JOIN points b ON a.grp < 3 AND b.grp >= 3 AND {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} < 4000),
 s AS (SELECT id, sum(CASE WHEN w > 0 THEN w * (1 - m / 4000) ELSE w END) AS v FROM n GROUP BY id)
 SELECT p.id, round(coalesce(v, 0) * (CASE WHEN depth > 8 THEN 1.0 ELSE 0.5 END) + 0.25, 3) AS score FROM points p LEFT JOIN s USING (id) WHERE grp < 3""")
def rank_spots(spark, sf_dir):
    """The groups part all points into spots and structures."""
    p = points(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("dock"), F.lit("hump"), F.lit("weed")), (F.col("id") % 3 + 1).cast("int"))
    s = p.where("grp >= 3").select(F.col("lon").alias("slon"), F.col("lat").alias("slat"), kind.alias("kind"))
    return ranking.score_spots(p.where("grp < 3"), s, "id", {"dock": 2.0, "hump": 1.0, "weed": -0.5}, 4000.0, F.when(F.col("depth") > 8, 1.0).otherwise(0.5), F.lit(0.25))


@query(f"""WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM series WHERE event_type <> 'click' AND (value > 90 OR 1706745600 - t <= 864000)) SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 4""")
def rank_feed_plan(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("published", F.when(F.col("value") <= 90, F.col("t")))
    return ranking.rss_plan(s, "user_id", "event_id", "published", F.col("event_type") == "click", F.lit(1706745600), 864000, 4).select("user_id", "event_id", "rank")


@query("""SELECT 'discount' AS rule, count(*) AS rows, count(CASE WHEN l_discount > 0.09 THEN 1 END) AS violators FROM lineitem UNION ALL SELECT 'tax', count(*), count(CASE WHEN l_tax > l_discount THEN 1 END) FROM lineitem UNION ALL
 SELECT 'quantity', count(*), count(CASE WHEN l_quantity <= 0 THEN 1 END) FROM lineitem""")
def audit_violations(spark, sf_dir):
    rules = {"discount": F.col("l_discount") > 0.09, "tax": F.col("l_tax") > F.col("l_discount"), "quantity": F.col("l_quantity") <= 0}
    return ranking.violations(table(spark, sf_dir, "lineitem"), rules)


@query("""SELECT p_partkey FROM part WHERE p_size % 2 = 1 OR p_partkey % 5 = 0""")
def build_stale_units(spark, sf_dir):
    """Units whose stamp changed, or that were never built."""
    p = table(spark, sf_dir, "part").withColumn("stamp", ranking.stamp(F.col("p_size"), F.lit("v1")))
    built = table(spark, sf_dir, "part").where("p_partkey % 5 != 0").withColumn("stamp", ranking.stamp(F.when(F.col("p_size") % 2 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")), F.lit("v1")))
    return ranking.stale_units(p, built, "p_partkey").select("p_partkey")


@query("""SELECT c_custkey AS k, CAST(coalesce(max(o_orderkey), 0) + 1 AS BIGINT) AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def build_next_version(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"))
    return ranking.next_version(old, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
