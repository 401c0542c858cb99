"""Queries over records: names, merges, upserts, change feeds, sets, top-k, parsing and nested values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from limnos.functions import numbers
from limnos.operators import entity
from limnos.plans.registry import query
from limnos.plans.surrogates import table

CLEAN = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"
TOKENS = f"list_filter(string_split({CLEAN}, ' '), lambda t: t <> '')"
PLAIN = CLEAN.format("regexp_replace(regexp_replace(name, '\\([^)]*\\)', ' ', 'g'), '(?s),.*$', '')")
STATES = "('al','ar','fl','ga','il','in','ky','la','mo','ms','nc','sc','tn','va','wv')"
STOP = "('lake','lakes','reservoir','rsvr','pond','millpond','mill','the','of','impoundment')"


@query(rf"""WITH p AS (SELECT p_partkey, [p_type || ' Lake #', 'Lake ' || p_type || ' River, SC ', 'The Mill Pond of (old) ', 'State Park Lakes B. 7 '][p_partkey % 4 + 1] || p_brand || ' of ' || p_name AS name FROM part),
 t AS (SELECT *, list_filter({TOKENS.format('name')}, lambda t: t NOT IN {STATES} AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$'))) AS tok FROM p), k AS (SELECT *, list_filter(tok, lambda t: t NOT IN {STOP}) AS core FROM t)
 SELECT p_partkey, {CLEAN.format('name')} AS clean, regexp_replace(regexp_replace({PLAIN}, '\b(lake|lakes|reservoir|pond|millpond|mill\s+pond|impoundment|sp|state\s+park|the)\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS loose,
 array_to_string(list_sort(CASE WHEN len(core) > 0 THEN core ELSE tok END), ' ') AS sorted, replace({CLEAN.format('name')}, ' ', '-') AS slug FROM k""")
def ent_keys(spark, sf_dir):
    kinds = F.array(F.concat("p_type", F.lit(" Lake #")), F.concat(F.lit("Lake "), "p_type", F.lit(" River, SC ")), F.lit("The Mill Pond of (old) "), F.lit("State Park Lakes B. 7 "))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.get(kinds, (F.col("p_partkey") % 4).cast("int")), "p_brand", F.lit(" of "), "p_name").alias("name"))
    return p.select("p_partkey", entity.clean("name").alias("clean"), entity.loose_key("name").alias("loose"), entity.sorted_key("name").alias("sorted"), entity.slug("name").alias("slug"))


@query("""WITH r AS (SELECT p_partkey, p_name, p_brand FROM part), q AS (SELECT s_suppkey, s_nationkey FROM supplier),
 x AS (SELECT s_suppkey, 'Brand#' || s_nationkey || '|' || p_name AS exact, p_name AS loose FROM q JOIN r ON p_partkey = s_suppkey),
 a AS (SELECT p_brand || '|' || p_name AS k, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1), b AS (SELECT p_name AS k, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1)
 SELECT s_suppkey, CAST(CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 END AS INTEGER) AS pass,
 CASE WHEN a.k IS NOT NULL THEN CASE WHEN a.n = 1 THEN a.id END WHEN b.n = 1 THEN b.id END AS p_partkey FROM x LEFT JOIN a ON a.k = exact LEFT JOIN b ON b.k = loose""")
def ent_resolve(spark, sf_dir):
    """Lookups in passes; an ambiguous pass ends the search without a row."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    q = table(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select("s_suppkey", F.concat(F.lit("Brand#"), "s_nationkey", F.lit("|"), "p_name").alias("exact"), F.col("p_name").alias("loose"))
    return entity.resolve(q, part, "s_suppkey", "p_partkey", [(F.col("exact"), F.concat_ws("|", "p_brand", "p_name")), (F.col("loose"), F.col("p_name"))])


@query(f"""WITH t AS (SELECT DISTINCT p_partkey, unnest({TOKENS.format("p_name || ' ' || p_type")}) AS token FROM part) SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= 40""")
def ent_weak_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return entity.weak_tokens(p, "name", 40)


@query("""WITH c AS (SELECT user_id, event_type, event_id, value, ts FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, value::BIGINT % 7 ORDER BY event_id DESC) AS r, value::BIGINT % 7 AS slot FROM c)
 SELECT user_id, CAST(slot AS BIGINT) AS slot, event_id, value FROM k WHERE r = 1 AND event_type <> 'error'""")
def ent_latest_wins(spark, sf_dir):
    """The last version of each key; an error is a tombstone."""
    e = table(spark, sf_dir, "events").select("user_id", F.pmod(F.rint("value").cast("long"), F.lit(7)).alias("slot"), "event_id", "value", (F.col("event_type") == "error").alias("gone"))
    return entity.latest_wins(e, ["user_id", "slot"], ["event_id"], "gone").drop("gone")


@query("""WITH k AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_id > 700 GROUP BY ALL) SELECT k.user_id, k.event_type, k.event_id, e.value FROM k JOIN events e USING (event_id) ORDER BY event_id LIMIT 500""")
def ent_change_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return entity.change_feed(e, ["user_id", "event_type"], "event_id", F.lit(700), 500)


@query("""WITH a AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS reg FROM nation WHERE n_nationkey < 18),
 b AS (SELECT n_nationkey AS k, lower(n_name) AS name, n_regionkey AS reg FROM nation WHERE n_nationkey > 6)
 SELECT k, coalesce(a.name, b.name) AS name, coalesce(a.reg, b.reg) AS reg, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'primary' ELSE 'other' END AS source FROM a FULL JOIN b USING (k)""")
def ent_fill(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.where("n_nationkey < 18").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("reg"))
    b = n.where("n_nationkey > 6").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("name"), F.col("n_regionkey").alias("reg"))
    return entity.fill(a, b, ["k"], ["name", "reg"])


@query("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
 SELECT k, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'lost' ELSE 'changed' END AS verdict FROM a FULL JOIN b USING (k) WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1""")
def ent_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return entity.compare(by("o_orderstatus = 'F'"), by("o_orderstatus != 'P'"), ["k"], "v", 1.0).select("k", "verdict")


@query("""WITH n AS (SELECT *, count(CASE WHEN p_size > 25 THEN 1 END) OVER (PARTITION BY p_name) AS c FROM part) SELECT p_partkey, CASE WHEN p_size > 25 AND c > 1 THEN p_name || ' (' || p_size || ' ac)' ELSE p_name END AS shown FROM n""")
def ent_disambiguate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return entity.disambiguate(p, "p_name", F.concat(F.col("p_size").cast("string"), F.lit(" ac")), F.col("p_size") > 25, "shown").select("p_partkey", "shown")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem)
 SELECT l_partkey, l_orderkey, l_linenumber FROM k WHERE r = 1""")
def ent_prefer_row(spark, sf_dir):
    order = (F.when(F.col("l_returnflag") == "R", 0).otherwise(1), F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"))
    return entity.prefer(table(spark, sf_dir, "lineitem"), ["l_partkey"], *order).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""SELECT c_custkey AS id, 'customer' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL
 SELECT s_suppkey, 'supplier' FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) UNION ALL
 (SELECT l_partkey, 'part' FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 EXCEPT SELECT l_partkey, 'part' FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 30)""")
def sets_semi_anti_union(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    a = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    b = table(spark, sf_dir, "supplier").join(line.where("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    part = lambda c: line.where(c).select(F.col("l_partkey").alias("id"), F.lit("part").alias("kind"))
    return a.unionByName(b).unionByName(part("l_returnflag = 'R' and l_quantity > 45").subtract(part("l_returnflag = 'A' and l_quantity > 30")))


@query("""WITH t AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red ring' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') THEN 2 END AS tier, p_size FROM part)
 SELECT p_partkey, p_name, CAST(tier AS INTEGER) AS tier FROM t WHERE tier IS NOT NULL ORDER BY tier, p_size DESC, p_partkey LIMIT 12""")
def topk_search_tiers(spark, sf_dir):
    """A name search: exact, prefix, contained; a tier's rows by rank; twelve rows."""
    name = F.lower("p_name")
    tier = F.when(name == "red ring", 0).when(name.startswith("red"), 1).when(name.contains("red") | name.contains("ring"), 2)
    return table(spark, sf_dir, "part").withColumn("tier", tier).where("tier is not null").orderBy("tier", F.desc("p_size"), "p_partkey").limit(12).select("p_partkey", "p_name", "tier")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS k FROM b WHERE k <= 3""")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "k")


NUMS = """n AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || l_quantity || ' ' WHEN 2 THEN '1,' || CAST(100 + l_linenumber AS VARCHAR) || '.5' WHEN 3 THEN CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_linenumber + 5 AS VARCHAR) ELSE 'about ' || l_quantity END AS s,
 CASE l_linenumber % 3 WHEN 0 THEN 'ft' WHEN 1 THEN 'm' ELSE 'x' END AS u, CASE WHEN l_linenumber % 4 = 0 THEN -999.0 ELSE l_quantity END AS v FROM lineitem)"""


@query(f"""WITH {NUMS} SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(trim(s), '') AS DOUBLE) AS plain, TRY_CAST(nullif(replace(trim(s), ',', ''), '') AS DOUBLE) AS grouped,
 CASE WHEN regexp_matches(trim(s), '^\\d+(\\.\\d+)?\\s*-\\s*\\d+(\\.\\d+)?$') THEN floor((TRY_CAST(regexp_extract(trim(s), '^(\\d+)', 1) AS DOUBLE) + TRY_CAST(regexp_extract(trim(s), '-\\s*(\\d+)', 1) AS DOUBLE)) / 2 + 0.5) ELSE TRY_CAST(nullif(regexp_extract(trim(s), '^([+-]?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) END AS leading,
 CASE WHEN v > -998 THEN v END AS seen, round(CASE u WHEN 'ft' THEN v WHEN 'm' THEN v / 0.3048 END, 4) AS feet, CASE WHEN v < 10 THEN 'clear' WHEN v < 30 THEN 'stained' ELSE 'muddy' END AS clarity FROM n""")
def parse_numbers(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    s = F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(F.lit(" "), q, F.lit(" "))).when(n % 5 == 2, F.concat(F.lit("1,"), (100 + n).cast("string"), F.lit(".5"))).when(n % 5 == 3, F.concat(n.cast("string"), F.lit("-"), (n + 5).cast("string"))).otherwise(F.concat(F.lit("about "), q))
    u = F.when(n % 3 == 0, "ft").when(n % 3 == 1, "m").otherwise("x")
    v = F.when(n % 4 == 0, -999.0).otherwise(F.col("l_quantity"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s"), u.alias("u"), v.alias("v"))
    return d.select(
        "l_orderkey", "l_linenumber", numbers.number_or_null("s").alias("plain"), numbers.grouped_number("s").alias("grouped"), numbers.leading_number("s").alias("leading"),
        numbers.observation("v").alias("seen"), F.round(numbers.to_feet("v", "u"), 4).alias("feet"), numbers.ladder("v", [(10, "clear"), (30, "stained")], "muddy").alias("clarity"),
    )


@query("""SELECT p_partkey, CAST(greatest(0, least(p_size + 10, 35) - greatest(p_size, 20)) AS DOUBLE) AS overlap, round(CASE WHEN p_size < 30 THEN 1 - p_size / 30.0 ELSE 0 END, 6) AS near,
 round(greatest(0, 1 - greatest(20 - p_size, p_size - 40, 0) / 2.0), 6) AS band, CASE WHEN p_size % 4 = 0 THEN 'unknown' WHEN p_size % 4 = 1 THEN 'no' ELSE 'yes' END AS charted, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS rounded FROM part""")
def score_scalars(spark, sf_dir):
    size = F.col("p_size")
    share = F.when(size % 4 == 0, F.lit(None)).when(size % 4 == 1, 0.0).otherwise(0.4)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(numbers.band_overlap(size, size + 10, 20, 35), 4).cast("double").alias("overlap"), F.round(numbers.proximity(size, 30), 6).alias("near"),
        F.round(numbers.band_factor(size, F.lit(20), F.lit(40)), 6).alias("band"), numbers.tri_state(share).alias("charted"), numbers.js_round("p_retailprice").alias("rounded"),
    )


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, sum(k) AS total, list_sort(list(k))[1:3] AS least, max(k) FILTER (event_type = 'purchase') AS best FROM e GROUP BY user_id""")
def nested_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.sum("k").alias("total"), F.slice(F.array_sort(F.collect_list("k")), 1, 3).alias("least"), F.max(F.when(F.col("event_type") == "purchase", F.col("k"))).alias("best"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT user_id, event_type, n * CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS score FROM c)
 SELECT user_id, CAST(sum(score) AS BIGINT) AS score, CAST(count(*) AS INTEGER) AS kinds FROM w GROUP BY user_id""")
def nested_merge_maps(spark, sf_dir):
    """Counts by kind merged with weights by kind, map to map."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    weights = F.create_map(F.lit("purchase"), F.lit(3), F.lit("click"), F.lit(2))
    scored = F.map_filter(F.map_zip_with("m", weights, lambda k, n, w: n * F.coalesce(w, F.lit(1))), lambda k, v: v.isNotNull())
    return counts.select("user_id", F.aggregate(F.map_values(scored), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"), F.size(scored).alias("kinds"))
