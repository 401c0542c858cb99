"""Queries over ordered rows: islands, sessions, as-of, interpolation, trends, scores, the run query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from limnos.functions import numbers
from limnos.operators import sequence
from limnos.plans.registry import query
from limnos.plans.surrogates import SERIES, series, table


@query("""WITH r AS (SELECT l_orderkey AS run, round(sum(l_extendedprice), 2) AS length_m, CAST(max(l_quantity) AS INTEGER) AS depth,
  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_r, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS has_n FROM lineitem GROUP BY l_orderkey),
 q AS (SELECT r.*, round(o_totalprice, 2) AS far FROM r JOIN orders ON o_orderkey = run WHERE o_orderstatus <> 'P' AND length_m >= 50000 AND has_r = 1 AND has_n = 1),
 b AS (SELECT arg_min(depth, abs(depth - 33) * 1000 + depth) AS want FROM q)
 SELECT run, length_m, depth, far FROM q, b WHERE depth = want ORDER BY far, run LIMIT 50""")
def runs_query(spark, sf_dir):
    """The run query: routable runs long enough with all required kinds, at the charted depth nearest to the wanted one, nearest first."""
    flag = lambda k: F.max(F.when(F.col("l_returnflag") == k, 1).otherwise(0))
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.round(F.sum("l_extendedprice"), 2).alias("length_m"), F.max("l_quantity").cast("int").alias("depth"), flag("R").alias("r"), flag("N").alias("n"))
    runs = runs.where("length_m >= 50000 and r = 1 and n = 1")
    ask = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("run"), F.round("o_totalprice", 2).alias("far"))
    held = runs.join(ask, "run")
    want = held.agg(F.min_by("depth", F.struct(F.abs(F.col("depth") - 33).alias("a"), "depth")).alias("want"))
    return held.join(F.broadcast(want), F.col("depth") == F.col("want")).orderBy("far", "run").limit(50).select("run", "length_m", "depth", "far")


@query(f"""WITH {SERIES}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM series),
 k AS (SELECT *, a - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM o WHERE value >= 10),
 i AS (SELECT user_id, g, count(*) AS n FROM k GROUP BY ALL) SELECT user_id, max(n) AS longest, count(*) AS runs FROM i GROUP BY user_id""")
def seq_islands(spark, sf_dir):
    i = sequence.islands(series(spark, sf_dir), ["user_id"], "event_id", F.col("value") >= 10)
    return i.groupBy("user_id", "island").count().groupBy("user_id").agg(F.max("count").alias("longest"), F.count("*").alias("runs"))


@query(f"""WITH {SERIES}, d AS (SELECT unnest([5, 20, 50]) AS need), o AS (SELECT need, user_id, value, row_number() OVER (PARTITION BY need, user_id ORDER BY event_id) AS a, event_id FROM series, d),
 k AS (SELECT *, a - row_number() OVER (PARTITION BY need, user_id ORDER BY event_id) AS g FROM o WHERE value >= need),
 i AS (SELECT need, user_id, g, count(*) AS n FROM k GROUP BY ALL), x AS (SELECT need, user_id, max(n) AS n FROM i GROUP BY ALL),
 u AS (SELECT DISTINCT user_id, need FROM o) SELECT u.user_id, CAST(u.need AS INTEGER) AS need, CAST(coalesce(n, 0) AS INTEGER) AS steps FROM u LEFT JOIN x USING (user_id, need)""")
def seq_reach_curve(spark, sf_dir):
    """For each needed depth the longest run of an envelope at least that deep."""
    env = series(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("env"))
    return env.select("user_id", "env", F.explode(F.array(F.lit(5), F.lit(20), F.lit(50))).alias("need")).select("user_id", "need", sequence.longest_run("env", F.col("need")).alias("steps"))


@query(f"""WITH {SERIES}, g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 43200 THEN 1 ELSE 0 END AS b FROM series WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(t) AS first, max(t) AS last, round(sum(value), 2) AS total FROM s GROUP BY user_id, session""")
def seq_gap_sessions(spark, sf_dir):
    s = sequence.gap_sessions(series(spark, sf_dir), ["user_id"], "t", 43200, tie="event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {SERIES}, d AS (SELECT a.user_id, a.event_id, a.value, b.value AS v, abs(b.t - (a.t - 86400)) AS d, b.t FROM series a JOIN series b ON a.user_id = b.user_id AND abs(b.t - (a.t - 86400)) <= 7200),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, t, v) AS r FROM d)
 SELECT s.event_id, round(s.value - k.v, 2) AS change FROM series s LEFT JOIN k ON s.event_id = k.event_id AND r = 1""")
def seq_change_24h(spark, sf_dir):
    """Change against the value nearest to a day before, unknown where none is within two hours of it."""
    s = series(spark, sf_dir).withColumn("at", F.col("t") - 86400)
    out = sequence.nearest_as_of(s, series(spark, sf_dir), "user_id", "at", "t", "value", 7200, "before")
    return out.select("event_id", F.round(F.col("value") - F.col("before"), 2).alias("change"))


@query(f"""WITH {SERIES}, k AS (SELECT user_id, t, min(value) AS v FROM series GROUP BY ALL), q AS (SELECT DISTINCT user_id, CAST(floor(t / 86400) AS BIGINT) * 86400 + 43200 AS t FROM series),
 p AS (SELECT q.user_id, q.t, max(k.t) AS t0 FROM q JOIN k ON k.user_id = q.user_id AND k.t <= q.t GROUP BY ALL), n AS (SELECT q.user_id, q.t, min(k.t) AS t1 FROM q JOIN k ON k.user_id = q.user_id AND k.t >= q.t GROUP BY ALL)
 SELECT q.user_id, q.t AS t, round(CASE WHEN t1 > t0 THEN a.v + (q.t - t0) * (b.v - a.v) / (t1 - t0) ELSE a.v + 0 * b.v END, 4) AS level FROM q LEFT JOIN p USING (user_id, t) LEFT JOIN n USING (user_id, t)
 LEFT JOIN k a ON a.user_id = q.user_id AND a.t = t0 LEFT JOIN k b ON b.user_id = q.user_id AND b.t = t1""")
def seq_interpolate(spark, sf_dir):
    s = series(spark, sf_dir)
    q = s.select("user_id", (F.floor(F.col("t") / 86400) * 86400 + 43200).alias("t")).distinct()
    return sequence.interpolate(q, s.select("user_id", F.col("t").alias("kt"), "value"), "user_id", "t", "kt", "value", "level").withColumn("level", F.round("level", 4))


@query(f"""WITH {SERIES}, w AS (SELECT user_id, t, CAST(round(value) AS BIGINT) AS n FROM series), s AS (SELECT user_id, t, sum(n) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS weight FROM w),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, t) AS r FROM s) SELECT user_id, CAST(weight AS BIGINT) AS weight, t AS start FROM k WHERE r = 1""")
def seq_densest_window(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("n", F.round("value").cast("long"))
    return sequence.densest_window(s, ["user_id"], "t", "n", 86400)


@query(f"""WITH {SERIES}, x AS (SELECT *, 1705320000 AS now FROM series), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN t >= now THEN 0 ELSE 1 END, abs(t - now), t, event_id) AS r FROM x)
 SELECT user_id, event_id, t >= now AS ahead FROM k WHERE r = 1""")
def seq_next_or_last(spark, sf_dir):
    now = F.lit(1705320000).cast("long")
    s = series(spark, sf_dir).withColumn("t", F.col("t"))
    return sequence.next_or_last(s, ["user_id"], "t", now).select("user_id", "event_id", (F.col("t") >= now).alias("ahead"))


@query(f"""WITH {SERIES}, s AS (SELECT *, CASE WHEN value >= 60 THEN 1 WHEN value < 40 THEN 0 END AS st FROM series),
 l AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
 SELECT user_id, count(CASE WHEN value >= 60 AND coalesce(before, 0) = 0 THEN 1 END) AS alerts FROM l GROUP BY user_id""")
def seq_hysteresis(spark, sf_dir):
    return sequence.hysteresis(series(spark, sf_dir), ["user_id"], "event_id", "value", 60, 40).groupBy("user_id").agg(F.count(F.when(F.col("fires"), 1)).alias("alerts"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, dayofyear(o_orderdate) AS d, year(o_orderdate) AS y FROM orders)
 SELECT a.o_orderkey, count(b.o_orderkey) AS others, count(CASE WHEN b.o_totalprice < a.o_totalprice THEN 1 END) AS lower FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.y <> b.y
 AND CASE WHEN abs(a.d - b.d) > 182 THEN 365 - abs(a.d - b.d) ELSE abs(a.d - b.d) END <= 10 GROUP BY a.o_orderkey""")
def seq_same_season_rank(spark, sf_dir):
    """A value among those of other years within ten days of its day of the year."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.dayofyear("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"))
    b = o.select("o_custkey", *(F.col(c).alias(f"b_{c}") for c in ("o_orderkey", "o_totalprice", "d", "y")))
    near = o.join(b, "o_custkey").where((F.col("y") != F.col("b_y")) & (numbers.year_day_distance("d", "b_d") <= 10))
    return near.groupBy("o_orderkey").agg(F.count("*").alias("others"), F.count(F.when(F.col("b_o_totalprice") < F.col("o_totalprice"), 1)).alias("lower"))


@query(f"""WITH {SERIES}, w AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS k FROM series WHERE value < 100)
 SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END * (1 - value / 100 * 0.5)), 6) AS score FROM w WHERE k <= 3 GROUP BY user_id""")
def seq_window_score(spark, sf_dir):
    """A weighted, distance-decayed score of which each kind gives three entries at most."""
    weight = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    w = Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")
    s = series(spark, sf_dir).where("value < 100").withColumn("k", F.row_number().over(w)).where("k <= 3")
    return s.groupBy("user_id").agg(F.round(F.sum(weight * (1 - F.col("value") / 100 * 0.5)), 6).alias("score"))


@query(f"""WITH {SERIES}, b AS (SELECT event_type, CAST(floor(value / 2) * 2 AS BIGINT) AS bin, list_sort(list(value)) AS v FROM series GROUP BY ALL),
 m AS (SELECT event_type, bin, v[CAST(floor(len(v) / 2) AS BIGINT) + 1] AS med FROM b), g AS (SELECT *, abs(med - lag(med) OVER (PARTITION BY event_type ORDER BY bin)) / (bin - lag(bin) OVER (PARTITION BY event_type ORDER BY bin)) AS grad FROM m)
 SELECT event_type, count(*) AS bins, min(CASE WHEN med > 20 THEN bin END) AS first_over, round(max(grad), 4) AS steepest FROM g GROUP BY event_type""")
def agg_depth_bins(spark, sf_dir):
    """Bins of two, their upper medians, the first beyond a threshold and the steepest step between neighbours."""
    bins = series(spark, sf_dir).groupBy("event_type", (F.floor(F.col("value") / 2) * 2).alias("bin")).agg(numbers.upper_median(F.collect_list("value")).alias("med"))
    w = Window.partitionBy("event_type").orderBy("bin")
    bins = bins.withColumn("grad", F.abs(F.col("med") - F.lag("med").over(w)) / (F.col("bin") - F.lag("bin").over(w)))
    return bins.groupBy("event_type").agg(F.count("*").alias("bins"), F.min(F.when(F.col("med") > 20, F.col("bin"))).alias("first_over"), F.round(F.max("grad"), 4).alias("steepest"))


@query("""SELECT l_suppkey, round(sum(l_quantity * CASE WHEN l_linestatus = 'O' THEN l_discount * 100 ELSE (l_discount + l_tax) * 50 END) / sum(l_quantity), 4) AS mean_depth, max(l_tax) AS deepest,
 round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) / sum(l_quantity), 4) AS open_share, count(*) >= 3 AND sum(l_quantity) > 0 AS trusted FROM lineitem GROUP BY l_suppkey""")
def agg_area_weighted_depth(spark, sf_dir):
    """Mean of bands by area; an open band counts at its floor, and its share of the area is told."""
    q, open_ = F.col("l_quantity"), F.col("l_linestatus") == "O"
    mid = F.when(open_, F.col("l_discount") * 100).otherwise((F.col("l_discount") + F.col("l_tax")) * 50)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(q * mid) / F.sum(q), 4).alias("mean_depth"), F.max("l_tax").alias("deepest"), F.round(F.sum(F.when(open_, q).otherwise(0)) / F.sum(q), 4).alias("open_share"), ((F.count("*") >= 3) & (F.sum(q) > 0)).alias("trusted")
    )


@query("""WITH m AS (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS ms, max(p_retailprice) OVER (PARTITION BY p_brand) AS mp FROM part),
 s AS (SELECT p_partkey, p_brand, round(0.7 * p_size / ms + 0.3 * p_retailprice / mp, 6) AS score FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s)
 SELECT p_brand, p_partkey, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8""")
def agg_group_scores(spark, sf_dir):
    """Scores normalised by the group's greatest, the best eight of each."""
    w = Window.partitionBy("p_brand")
    s = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.round(0.7 * F.col("p_size") / F.max("p_size").over(w) + 0.3 * F.col("p_retailprice") / F.max("p_retailprice").over(w), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "p_partkey"))).where("rank <= 8")


@query("""SELECT n_name, count(*) AS rows, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS kept, count(CASE WHEN c_acctbal <= 0 THEN 1 END) AS filtered, count(DISTINCT c_mktsegment) AS segments,
 count(CASE WHEN c_acctbal > 0 THEN 1 END) = 0 AS rejected_all FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def agg_quality_counters(spark, sf_dir):
    """Grouped rows with counters of what a filter kept, and a flag where it rejected all."""
    keep = F.col("c_acctbal") > 0
    n = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count("*").alias("rows"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("filtered"), F.countDistinct("c_mktsegment").alias("segments"), (F.count_if(keep) == 0).alias("rejected_all")
    )


@query(f"""WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM series) SELECT user_id, event_id, value, event_type FROM k WHERE r = 1""")
def agg_worst_reading(spark, sf_dir):
    best = F.min_by(F.struct("event_id", "value", "event_type"), F.struct((-F.col("value")).alias("a"), "event_id"))
    return series(spark, sf_dir).groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders)
 SELECT o_orderkey, CASE WHEN month(day) IN (3,4,5) THEN 'spring' WHEN month(day) IN (6,7,8) THEN 'summer' WHEN month(day) IN (9,10,11) THEN 'fall' ELSE 'winter' END AS season,
 (month(day)*100 + day(day) >= 1115 OR month(day)*100 + day(day) <= 301) AS winter_window, CAST(date_diff('day', DATE '2000-01-01', day) + 2451545 AS INTEGER) AS julian,
 round(((date_diff('day', DATE '2000-01-01', day) + 2451545 - 2451550.1) / 29.530588853 - floor((date_diff('day', DATE '2000-01-01', day) + 2451545 - 2451550.1) / 29.530588853)) * 360.0, 4) AS moon,
 printf('%02d:%02d', CAST(floor((o_orderkey % 1440) / 60) AS INTEGER), CAST((o_orderkey % 1440) % 60 AS INTEGER)) AS clock FROM d""")
def time_scalars(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.select("o_orderkey", numbers.season("day").alias("season"), numbers.in_month_window("day", (11, 15), (3, 1)).alias("winter_window"), numbers.julian_day("day").alias("julian"), F.round(numbers.moon_phase("day"), 4).alias("moon"), numbers.clock_of(F.col("o_orderkey") % 1440).alias("clock"))
