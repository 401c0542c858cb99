"""Queries over stitched lines, stretches, contours, reach and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import geo
from limnos.operators import entity, graph, lines
from limnos.plans.registry import query
from limnos.plans.surrogates import LEGS, SERIES, legs, metres, points, series, table


@query(f"""WITH {LEGS} SELECT grp, CAST(count(*) AS BIGINT) AS fragments, round(sum({metres('lon', 'lat', 'lon2', 'lat2')}), 1) AS length_m FROM legs GROUP BY grp""")
def lines_stitch(spark, sf_dir):
    """Every leg is a fragment; a group's fragments make one line of the same length."""
    v = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    f = legs(spark, sf_dir).select("grp", "id", F.array(v("lon", "lat"), v("lon2", "lat2")).alias("line"))
    return lines.stitch(f, "grp", "id", "line", 6).groupBy("grp").agg(F.max("fragments").alias("fragments"), F.round(F.sum(geo.line_length_m("line")), 1).alias("length_m"))


@query(f"""WITH {SERIES}, o AS (SELECT user_id, event_id, value BETWEEN 5 AND 60 AS ok FROM series), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, ok ORDER BY event_id) AS k FROM o)
 SELECT user_id, min(event_id) AS start_m, max(event_id) AS end_m, count(*) AS n FROM g WHERE ok GROUP BY user_id, k HAVING max(event_id) - min(event_id) >= 100""")
def lines_band_stretches(spark, sf_dir):
    return lines.band_stretches(series(spark, sf_dir), ["user_id"], "event_id", "value", 5, 60, 100)


@query()
def lines_contours_from_points(spark, sf_dir):
    return lines.contours_from_points(points(spark, sf_dir), 0.1, 0.05, [4.0, 8.0, 12.0])


@query(f"""WITH {SERIES}, v AS (SELECT user_id, event_id, value / 1000 - 81 AS lon, value / 2000 + 34 AS lat FROM series),
 m AS (SELECT *, (lag(lon, 2) OVER w + lead(lon, 2) OVER w) / 2 AS x, (lag(lat, 2) OVER w + lead(lat, 2) OVER w) / 2 AS y FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 b AS (SELECT *, {metres('lon', 'lat', 'x', 'y')} AS m FROM m), t AS (SELECT *, max(m) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, max(m) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before FROM b)
 SELECT event_id, round(m, 2) AS bulge_m FROM t WHERE m = top AND NOT coalesce(before >= m, false) AND m >= 500""")
def lines_bulges(spark, sf_dir):
    v = series(spark, sf_dir).select("user_id", "event_id", (F.col("value") / 1000 - 81).alias("lon"), (F.col("value") / 2000 + 34).alias("lat"))
    return lines.bulges(v, ["user_id"], "event_id", 2, 500.0).select("event_id", F.round("bulge_m", 2).alias("bulge_m"))


@query("""WITH RECURSIVE m AS (SELECT max(p_partkey) + 1 AS m FROM part), e AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 7 + l_suppkey) % m AS b FROM lineitem, m),
 r(start, node, hop) AS (SELECT DISTINCT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 50 = 0 UNION SELECT start, b, hop + 1 FROM r JOIN e ON node = a WHERE hop < 2 AND (hop = 0 OR node % 10 <> 3))
 SELECT start, node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY start, node""")
def graph_reachable(spark, sf_dir):
    """What every fiftieth part reaches in two hops over all parts' links; parts that end in 3 are not passed."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    m = p.agg(F.max("node")).first()[0] + 1
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % m).alias("dst"))
    return graph.reachable(e, p.where("node % 50 = 0"), p.where("node % 10 = 3"), 2)


@query("""SELECT count(CASE WHEN a.o_orderkey < b.o_orderkey THEN 1 END) > 100 * count(CASE WHEN a.o_orderkey > b.o_orderkey THEN 1 END) AS increasing FROM orders a JOIN (SELECT o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o_orderkey FROM orders) b ON a.o_orderkey = b.k""")
def graph_direction(spark, sf_dir):
    from limnos.plans.q_spatial import pointers

    return graph.dominant(pointers(spark, sf_dir).where("next is not null"), "id", "next").select((~F.col("decreasing")).alias("increasing"))


@query("""WITH old AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS p, max(o_orderkey) AS v FROM orders GROUP BY 1), new AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS p FROM customer)
 SELECT n.k, n.p AS print, CAST(coalesce(v, 0) + 1 AS BIGINT) AS version FROM new n LEFT JOIN old o USING (k) WHERE o.p IS NULL OR o.p <> n.p""")
def store_changed_documents(spark, sf_dir):
    store = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("print"), F.col("o_orderkey").alias("version"))
    k = F.col("c_custkey")
    fresh = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 5 == 0, "1-URGENT").when(k % 5 == 1, "2-HIGH").otherwise("5-LOW").alias("print"))
    return entity.changed_documents(store, fresh, "k", "print")


@query("""WITH s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), d AS (SELECT DISTINCT day FROM s ORDER BY day DESC LIMIT 10), live AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)
 SELECT user_id, max(day) AS day FROM s WHERE day IN (SELECT day FROM d) AND user_id NOT IN (SELECT user_id FROM live) GROUP BY user_id""")
def store_expired_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    snapshots = e.select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    return entity.first_sightings(snapshots, e.where("event_type = 'purchase' and value > 100").select("user_id").distinct(), "user_id", "day", 10)


@query("""SELECT c_custkey AS a, c_custkey + 1 AS b, CASE WHEN c_custkey % 3 = 0 THEN 'gone' ELSE 'keep' END AS name, 3 AS names, CASE WHEN c_custkey % 2 = 0 THEN 'k' ELSE 'g' END AS src FROM customer""")
def ent_merge_records(spark, sf_dir):
    k = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(
        k.alias("a"), (k + 1).alias("b"), F.when(k % 3 == 0, "").otherwise("keep").alias("keep_name"), F.lit("gone").alias("gone_name"),
        F.array(F.lit("x"), F.lit("y")).alias("keep_names"), F.array(F.lit("y"), F.lit("z")).alias("gone_names"),
        F.create_map(F.when(k % 2 == 0, "s").otherwise("t"), F.lit("k")).alias("keep_m"), F.create_map(F.lit("s"), F.lit("g")).alias("gone_m"),
    )
    out = entity.merge_records(pairs, "a", "b", ["names"], ["m"], ["name"])
    return out.select("a", "b", "name", F.size("names").alias("names"), F.col("m")["s"].alias("src"))
