"""Queries over audits of stores, scores of lures, reports and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import lures
from limnos.operators import audits, reports
from limnos.plans.registry import query
from limnos.plans.surrogates import SERIES, series, table


@query("""WITH r AS (SELECT o_custkey AS k, max(o_orderkey) AS n FROM orders GROUP BY 1), p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN (SELECT n FROM r WHERE r.k = c_custkey) ELSE c_nationkey END AS n FROM customer WHERE c_custkey % 7 > 0), d AS (SELECT DISTINCT s_suppkey * 3 AS k, (SELECT n FROM r WHERE r.k = s_suppkey * 3) AS n FROM supplier),
 w AS (SELECT k, max(CASE s WHEN 'r' THEN n END) AS remote, max(CASE s WHEN 'p' THEN n END) AS pack, max(CASE s WHEN 'd' THEN n END) AS drive FROM (SELECT k, n, 'r' AS s FROM r UNION ALL SELECT k, n, 'p' FROM p UNION ALL SELECT k, n, 'd' FROM d) GROUP BY k)
 SELECT k, remote, pack, drive, CASE WHEN remote IS NULL OR pack IS NULL OR drive IS NULL THEN 'not in ' || concat_ws(', ', CASE WHEN remote IS NULL THEN 'remote' END, CASE WHEN pack IS NULL THEN 'pack' END, CASE WHEN drive IS NULL THEN 'drive' END) WHEN least(remote, pack, drive) = greatest(remote, pack, drive) THEN 'same' ELSE 'sizes differ' END AS verdict FROM w""")
def audit_listings(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("n"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("k"), "c_nationkey").join(r, "k", "left")
    p = c.select("k", F.when(F.col("k") % 3 == 0, F.col("n")).otherwise(F.col("c_nationkey")).alias("n"))
    d = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k")).distinct().join(r, "k", "left")
    return audits.listings({"remote": r, "pack": p, "drive": d}, "k", "n")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0)""")
def audit_orphans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return audits.orphans(o, table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("k")), "k").select("o_orderkey")


GO = """o AS (SELECT o_orderkey, o_custkey AS g, ['a.json', 'b.json', 'c.bin', 'x.tmp'][o_orderkey % 4 + 1] AS f FROM orders), s AS (SELECT DISTINCT g, f FROM o WHERE o_orderkey % 3 > 0)"""


@query(f"""WITH {GO} SELECT o_orderkey, CASE WHEN g IN (1, 2) THEN 'skipped' WHEN f = 'b.json' THEN 'retired' WHEN s.f IS NULL AND o.f <> 'a.json' THEN NULL WHEN g NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0) AND o.f IN ('a.json', 'c.bin') THEN 'not offered' WHEN o.f = 'c.bin' THEN 'pipeline only' END AS reason FROM o LEFT JOIN s USING (g, f)""")
def audit_may_go(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("g"), F.get(F.array(*map(F.lit, ("a.json", "b.json", "c.bin", "x.tmp"))), (k % 4).cast("int")).alias("f"))
    offered = table(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("g"))
    out = audits.may_go(o, "g", "f", skipped=[1, 2], retired=["b.json"], known=["a.json", "c.bin"], pipeline=["c.bin"], regenerable=["a.json"], offered=offered, backed_up=o.where(k % 3 > 0))
    return out.select("o_orderkey", "reason")


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, NULL AS size FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS k, 'b ' || c_custkey AS name, c_nationkey AS size FROM customer WHERE c_custkey % 5 > 0), c AS (SELECT o_custkey AS k, max(o_orderkey) AS size FROM orders GROUP BY 1),
 u AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c)
 SELECT k, coalesce(a.name, b.name) AS name, coalesce(b.size, c.size) AS size, CASE WHEN a.name IS NOT NULL THEN 'index' WHEN b.name IS NOT NULL THEN 'state' END AS name_from, CASE WHEN b.size IS NOT NULL THEN 'state' WHEN c.size IS NOT NULL THEN 'orders' END AS size_from,
 concat_ws('+', CASE WHEN a.k IS NOT NULL THEN 'index' END, CASE WHEN c.k IS NOT NULL THEN 'orders' END, CASE WHEN b.k IS NOT NULL THEN 'state' END) AS sources FROM u LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)""")
def audit_fold(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    a = c.where("k % 3 > 0").select("k", F.when(F.col("k") % 2 == 0, F.col("c_name")).alias("name"))
    b = c.where("k % 5 > 0").select("k", F.concat(F.lit("b "), F.col("k").cast("string")).alias("name"), F.col("c_nationkey").cast("long").alias("size"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").cast("long").alias("size"))
    out = audits.fold([("index", a), ("state", b), ("orders", o)], ["k"], ["name", "size"])
    return out.select("k", "name", "size", F.col("from.name").alias("name_from"), F.col("from.size").alias("size_from"), "sources")


@query("""WITH m AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 9 = 0), g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 = 1)
 SELECT 'orders' AS tbl, coalesce(b, o_custkey) AS k, count(*) AS n FROM orders LEFT JOIN m ON a = o_custkey WHERE coalesce(b, o_custkey) NOT IN (SELECT k FROM g) GROUP BY 2 UNION ALL SELECT 'events', coalesce(b, user_id), count(*) FROM events LEFT JOIN m ON a = user_id WHERE coalesce(b, user_id) NOT IN (SELECT k FROM g) GROUP BY 2""")
def audit_merge_and_remove(spark, sf_dir):
    """Merged keys are renamed in every table, then removed ones' rows go."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    tables = {"orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("k")), "events": table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("k"))}
    merged = audits.retarget(tables, c.where("k % 9 = 0").select(F.col("k").alias("a"), (F.col("k") + 1).alias("b")), "k", "a", "b")
    left = audits.without(merged, c.where("k % 4 = 1"), "k")
    count = lambda n: left[n].groupBy("k").agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "k", "n")
    return count("orders").unionByName(count("events"))


@query("""WITH m AS (SELECT c_custkey AS k, c_custkey * 2 AS id FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders), s AS (SELECT s_suppkey AS k, s_name AS v FROM supplier), a AS (SELECT k, min(v) AS a FROM m JOIN d USING (id) GROUP BY 1), b AS (SELECT k, min(v) AS b FROM s GROUP BY 1)
 SELECT c_custkey AS k, coalesce(a, b) AS v, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'key' END AS path FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def audit_two_paths(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    direct = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    return audits.two_paths(c, direct, c.where("k % 3 = 0").select("k", (F.col("k") * 2).alias("id")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), "k", "v")


@query("""WITH o AS (SELECT p_partkey AS k, p_retailprice AS a, CASE WHEN p_size % 4 > 0 THEN p_size END AS b FROM part), n AS (SELECT p_partkey AS k, p_retailprice * CASE WHEN p_partkey % 3 = 0 THEN 1.05 ELSE 1.001 END AS a, CASE WHEN p_size % 6 > 0 THEN p_size + p_partkey % 2 END AS b FROM part),
 c AS (SELECT k, abs(n.a - o.a) > 0.02 * greatest(abs(n.a), abs(o.a)) AS ca, CASE WHEN (o.b IS NULL) <> (n.b IS NULL) THEN true ELSE coalesce(abs(n.b - o.b) > 0.02 * greatest(abs(n.b), abs(o.b)), false) END AS cb FROM o JOIN n USING (k)) SELECT k, concat_ws(',', CASE WHEN ca THEN 'a' END, CASE WHEN cb THEN 'b' END) AS changed FROM c WHERE ca OR cb""")
def audit_remeasured(spark, sf_dir):
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    old = p.select(k.alias("k"), F.col("p_retailprice").alias("a"), F.when(s % 4 > 0, s).alias("b"))
    new = p.select(k.alias("k"), (F.col("p_retailprice") * F.when(k % 3 == 0, 1.05).otherwise(1.001)).alias("a"), F.when(s % 6 > 0, s + k % 2).alias("b"))
    return audits.remeasured(old, new, "k", ["a", "b"], 0.02).withColumn("changed", F.array_join("changed", ","))


@query("""SELECT 'orders' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'customers with orders', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'largest part', max(p_size) FROM part UNION ALL SELECT 'late events', count(*) FROM events WHERE value > 100""")
def audit_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return audits.snapshot({"orders": (o, F.count("*")), "customers with orders": (o, F.count_distinct("o_custkey")), "largest part": (table(spark, sf_dir, "part"), F.max("p_size")), "late events": (table(spark, sf_dir, "events").where("value > 100"), F.count("*"))})


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN 'small' WHEN p_retailprice > 1200 THEN 'dear' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'fine' END AS bucket FROM part) SELECT bucket, count(*) AS n, array_to_string(list_slice(list_sort(list(p_partkey)), 1, 5), ',') AS first FROM b GROUP BY bucket""")
def audit_triage(spark, sf_dir):
    out = audits.triage(table(spark, sf_dir, "part"), [("small", F.col("p_size") < 5), ("dear", F.col("p_retailprice") > 1200), ("promo", F.col("p_type") == "PROMO")], "p_partkey")
    return out.withColumn("first", F.array_join(F.transform("first", lambda x: x.cast("string")), ","))


@query(f"""WITH {SERIES}, c AS (SELECT event_id, value AS t, CASE WHEN event_id % 3 = 0 THEN 5 END AS lo, CASE WHEN event_id % 3 = 0 THEN 40 END AS hi, CASE WHEN event_id % 3 = 1 THEN 20.0 END AS ideal, event_id % 11 AS sp, CASE WHEN event_id % 4 > 0 THEN event_id % 9 END AS se, event_id % 8 AS cl, CASE WHEN event_id % 5 > 0 THEN event_id % 5 - 2 END AS p, 1.5 + event_id % 10 / 4.0 AS v, event_id % 5 AS m, event_id % 20 - 5 AS pr FROM series),
 s AS (SELECT *, 3 * sp + 1.5 * coalesce(se, 5) + cl + CASE WHEN lo IS NULL AND ideal IS NOT NULL THEN greatest(0, 10 - abs(ideal - t) * 0.8) ELSE 0 END + CASE WHEN p IS NULL THEN 0 WHEN p < 0 THEN 2 WHEN p = 0 THEN 20 WHEN p = 1 THEN 15 WHEN p = 2 THEN 10 ELSE greatest(0, 8 - p) END
  + CASE WHEN v BETWEEN 1.8 AND 3.2 THEN greatest(0, 5 - abs(v - 2.5) * 2) ELSE -5 END + least(6, 2 * m) + pr AS s, coalesce(t < lo OR t > hi, false) AS un FROM c)
 SELECT event_id, round(CASE WHEN un THEN -999 ELSE s END, 6) AS score, NOT un AS fit, CASE WHEN event_id % 4 = 0 THEN 80 ELSE CAST(floor(CASE WHEN event_id % 4 = 1 THEN least(t, 25) ELSE t END * 3.5 * 1.2 + 0.5) AS BIGINT) END AS lead,
 CASE WHEN event_id % 7 = 0 AND v > 3 THEN 'speed' WHEN event_id % 4 = 0 AND t > 2 THEN 'surface' WHEN event_id % 4 = 1 AND NOT t BETWEEN 5 AND 25 THEN 'rating' WHEN event_id % 4 > 1 AND floor(t * 3.5 * 1.2 + 0.5) > 150 THEN 'lead' END AS limited_by FROM s""")
def score_lures(spark, sf_dir):
    """Events as situations with a lure at hand."""
    i, t = F.col("event_id"), F.col("value")
    r = i % 3
    f = lures.fitness(target=t, rated_low=F.when(r == 0, 5), rated_high=F.when(r == 0, 40), ideal=F.when(r == 1, 20.0), species=i % 11, season=F.when(i % 4 > 0, i % 9), clarity=i % 8, preference=F.when(i % 5 > 0, i % 5 - 2), mph=1.5 + i % 10 / 4.0, mph_low=F.lit(1.8), mph_ideal=F.lit(2.5), mph_high=F.lit(3.2), structures=i % 5, presentation=i % 20 - 5)
    mode = F.when(i % 4 == 0, "surface").when(i % 4 == 1, "rated").otherwise("lead")
    lead = lures.lead_feet(t, mode, F.lit(25), F.lit(3.5), F.lit(1.2))
    reach = lures.reach(t, mode, F.lit(5), F.lit(25), F.lit(3.5), F.lit(1.2), 1.5 + i % 10 / 4.0, F.when(i % 7 == 0, 3.0), F.lit(150))
    return series(spark, sf_dir).select("event_id", F.round(f["score"], 6).alias("score"), f["fit"].alias("fit"), lead.alias("lead"), reach["limited_by"].alias("limited_by"))


@query("""WITH e AS (SELECT p_partkey AS k, 'Water ' || ['One', 'Two', 'Three'][p_partkey % 3 + 1] AS w, CASE WHEN p_partkey % 5 > 0 THEN DATE '2024-01-01' + CAST(p_size AS INTEGER) END AS d, p_name AS b FROM part)
 SELECT k, 1 AS pos, w AS water, d AS published, b || ' biting' AS body FROM e UNION ALL SELECT k, 2, 'Ft Hill', DATE '2023-05-06', 'slow & steady' FROM e""")
def report_entries(spark, sf_dir):
    """Two entries a page: a date of two-digit year, one of four, and for every fifth page one that is none."""
    k = F.col("p_partkey")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.col("p_size").cast("int"))
    name = F.get(F.array(*map(F.lit, ("One", "Two", "Three"))), (k % 3).cast("int"))
    when = F.when(k % 5 > 0, F.date_format(day, "M/d/yy")).otherwise("13/40/2024")
    html = F.concat(F.lit("<div>Updated</div><h2>Water "), name, F.lit(" &ndash; "), when, F.lit("</h2><p><b>"), F.col("p_name"), F.lit("</b> biting</p><script>x</script><h3>Ft Hill - 5/6/2023</h3><p>slow &amp;  steady</p>"))
    pages = table(spark, sf_dir, "part").select(k.alias("k"), html.alias("html"))
    return reports.dated_entries(pages, "k", "html")


WATERS = "w AS (SELECT conv_id AS water, regexp_extract_all(lower(text), '[a-z0-9]+')[1:2] AS t FROM conversations WHERE turn = 0)"


#: A water's tokens, and a text's words but those that County follows.
TOKENS_OF = "list_distinct(list_transform(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x NOT IN ('', 'lake', 'lakes', 'reservoir', 'res', 'the', 'a', 'of', 'at', 'near', 'on')), lambda x: CASE x WHEN 'ft' THEN 'fort' WHEN 'mt' THEN 'mount' ELSE x END))"
SAID = r"list_filter(list_transform(range(1, len(regexp_extract_all({0}, '[a-z0-9_]+')) + 1), lambda i: CASE WHEN coalesce(regexp_extract_all({0}, '[a-z0-9_]+')[i + 1] IN ('county', 'counties'), false) AND regexp_full_match(regexp_extract_all({0}, '[a-z0-9_]+([^a-z0-9_]*)', 1)[i], '[\s\-]+') THEN NULL ELSE regexp_extract_all({0}, '[a-z0-9_]+')[i] END), lambda x: x IS NOT NULL)"


@query(rf"""WITH n AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[a-z0-9]+')[1:2] AS t FROM conversations), i AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN t[1] || ' County: ' || text[length(t[1]) + 1:] ELSE text END AS e, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM n),
 w AS (SELECT conv_id AS water, {TOKENS_OF.format("array_to_string(t, ' ')")} AS t FROM n WHERE turn = 0), s AS (SELECT conv_id, turn, {SAID.format('lower(e)')} AS e, {SAID.format("lower(coalesce(a, ''))")} AS a FROM i)
 SELECT conv_id, turn, water, CASE WHEN list_has_all(e, t) THEN 'excerpt' ELSE 'article' END AS matched_in FROM s, w WHERE len(t) > 0 AND (list_has_all(e, t) OR list_has_all(a, t))""")
def report_matches(spark, sf_dir):
    """Turns as items, the next turn as the article; waters are named by the first two words of each conversation, which stand as a county in a third of them."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    first = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 2)
    county = F.concat(first[0], F.lit(" County: "), F.substring("text", F.length(first[0]) + 1, F.length("text")))
    items = c.select(F.struct("conv_id", "turn").alias("item"), F.when(F.col("conv_id") % 3 == 0, county).otherwise(F.col("text")).alias("excerpt"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("article"), F.col("turn").alias("published"))
    waters = c.where("turn = 0").select(F.col("conv_id").alias("water"), F.array_join(first, " ").alias("name"))
    return reports.matched_reports(items, waters, "item", "water", "name").select("item.conv_id", "item.turn", "water", "matched_in")


@query(rf"""WITH s AS (SELECT s_suppkey AS k, {TOKENS_OF.format("['Norris Tailwater', 'Ft. Loudoun Reservoir', 'santee cooper lake marion lake moultrie', 'charleston', 'Wateree', 'Lake on the'][s_suppkey % 6 + 1] || CASE WHEN s_nationkey % 3 = 0 THEN ' ' || s_nationkey ELSE '' END")} AS a FROM supplier),
 w AS (SELECT c_custkey AS water, {TOKENS_OF.format("['Norris Lake', 'Fort Loudoun Lake', 'Lake Marion', 'Lake Moultrie', 'Charleston Harbor', 'Wateree River', 'Lake Wateree'][c_custkey % 7 + 1] || CASE WHEN c_nationkey % 3 = 0 THEN ' ' || c_nationkey ELSE '' END")} AS b FROM customer),
 p AS (SELECT k, water, a, b, len(list_intersect(a, b)) AS n FROM s, w WHERE len(a) > 0 AND len(b) > 0 AND (list_has_all(b, a) OR list_has_all(a, b))),
 f AS (SELECT *, CASE WHEN n = len(a) THEN list_filter(b, lambda x: NOT list_contains(a, x)) ELSE list_filter(a, lambda x: NOT list_contains(b, x)) END AS extra FROM p)
 SELECT k, water, CAST(n AS INTEGER) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, water) AS r FROM f WHERE NOT list_has_any(extra, ['river', 'creek', 'canal', 'branch', 'run', 'fork', 'swamp', 'slough', 'tailwater', 'tailrace'])) WHERE r = 1""")
def report_names(spark, sf_dir):
    """Names as sources write them against names as a registry does."""
    pick = lambda words, c, n: F.get(F.array(*map(F.lit, words)), (F.col(c) % n).cast("int"))
    tail = lambda c: F.when(F.col(c) % 3 == 0, F.concat(F.lit(" "), F.col(c).cast("string"))).otherwise("")
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(pick(("Norris Tailwater", "Ft. Loudoun Reservoir", "santee cooper lake marion lake moultrie", "charleston", "Wateree", "Lake on the"), "s_suppkey", 6), tail("s_nationkey")).alias("name"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("water"), F.concat(pick(("Norris Lake", "Fort Loudoun Lake", "Lake Marion", "Lake Moultrie", "Charleston Harbor", "Wateree River", "Lake Wateree"), "c_custkey", 7), tail("c_nationkey")).alias("wname"))
    return reports.matched_names(a, b, "k", "name", "water", "wname")


@query("""WITH f AS (SELECT event_id AS k, lower(['Stripers suspend over the channel', 'Largemouth on the bottom in ', 'Catfish schooling', 'Anchor tight in ', 'clear water', 'ok'][event_id % 6 + 1] || [' in july', ' in March', '', ' every autumn'][event_id % 4 + 1]) AS t FROM events),
 b AS (SELECT k, CASE WHEN contains(t, 'striper') THEN 'Striped Bass' WHEN contains(t, 'largemouth') THEN 'Largemouth Bass' WHEN contains(t, 'catfish') THEN 'Catfish' END AS species, CASE WHEN contains(t, 'march') THEN 'spring' WHEN contains(t, 'july') THEN 'summer' WHEN contains(t, 'autumn') THEN 'fall' END AS season,
  CASE WHEN contains(t, 'bottom') OR contains(t, 'anchor') THEN 'bottom' WHEN contains(t, 'suspend') OR contains(t, 'schooling') THEN 'suspended' END AS holding, length(trim(t)) AS n FROM f) SELECT k, species, season, holding FROM b WHERE n >= 12 AND (species IS NOT NULL OR season IS NOT NULL OR holding IS NOT NULL)""")
def fact_behaviour(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (i % n).cast("int"))
    t = F.concat(pick(("Stripers suspend over the channel", "Largemouth on the bottom in ", "Catfish schooling", "Anchor tight in ", "clear water", "ok"), 6), pick((" in july", " in March", "", " every autumn"), 4))
    facts = table(spark, sf_dir, "events").select(i.alias("k"), t.alias("t"))
    return reports.behaviour(facts, "k", "t", [("Striped Bass", r"strip\w*\s*bass|striper"), ("Largemouth Bass", "largemouth"), ("Catfish", r"\bcat(?:fish|s)\b")])


@query("""WITH w AS (SELECT c_custkey AS water, 'Lake ' || ['Ft Mill', 'Blue Water', 'Red (upper), SC'][c_custkey % 3 + 1] AS name, c_nationkey % 2 AS st, ['fort mill', 'blue water', 'red'][c_custkey % 3 + 1] AS k FROM customer), r AS (SELECT s_suppkey AS rule, ['Mill, Fort', 'Water Blue Lake', NULL][s_suppkey % 3 + 1] AS name, ['fort mill', 'blue water', NULL][s_suppkey % 3 + 1] AS k, s_nationkey % 2 AS st FROM supplier),
 o AS (SELECT water, rule FROM w JOIN r USING (st, k)) SELECT water, rule, 'water' AS scope FROM o UNION ALL SELECT water, rule, 'state' FROM w JOIN r USING (st) WHERE r.k IS NULL AND water NOT IN (SELECT water FROM o)""")
def report_regulations(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (n % 3).cast("int"))
    w = table(spark, sf_dir, "customer").select(k.alias("water"), F.concat(F.lit("Lake "), pick(("Ft Mill", "Blue Water", "Red (upper), SC"), k)).alias("name"), (F.col("c_nationkey") % 2).alias("st"))
    r = table(spark, sf_dir, "supplier").select(s.alias("rule"), pick(("Mill, Fort", "Water Blue Lake", None), s).alias("rname"), (F.col("s_nationkey") % 2).alias("st"))
    return reports.regulation_of(w, r, "water", "name", "rule", "rname", "st")


@query("""SELECT p_partkey AS k, 1 AS pos, p_name AS species, CAST(p_size AS BIGINT) AS creel, 14.0::DOUBLE AS low, NULL::DOUBLE AS high FROM part UNION ALL SELECT p_partkey, 3, 'Gar', NULL, NULL, 40.0 FROM part""")
def report_limits(spark, sf_dir):
    """A table of rules a page: a heading, a limit in number and length, a row that tells none, and one of a greatest length."""
    p = table(spark, sf_dir, "part")
    html = F.concat(
        F.lit("<table><tr><th>Species</th><th>Rule</th></tr><tr><td>"), F.col("p_name"), F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit(" fish per person</td><td>14 inch minimum</td></tr><tr><td>Carp</td><td>none</td></tr><tr><td>Gar</td><td>maximum 40 inches</td></tr></table>")
    )
    out = reports.limit_rows(p.select(F.col("p_partkey").alias("k"), html.alias("html")), "k", "html")
    return out.withColumn("creel", F.col("creel").cast("long"))
