"""Streaming queries, each run over all its source holds and read back from its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from limnos.plans.registry import query
from limnos.sources.shared import shared_dir
from limnos.streaming import feeds


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = f"{shared_dir(spark)}/limnos/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*events*" if not path.endswith("/") else "*").parquet(sf_dir)
    return source.withColumn("ts", F.col("ts").cast("timestamp")), out


@query("""WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS d, value FROM events), m AS (SELECT max(ts) AS m FROM events)
 SELECT user_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, d, count(*) AS n FROM w, m GROUP BY user_id, d) GROUP BY user_id""")
def stream_daily_windows(spark, sf_dir):
    """Tumbling days by user. The complete table is kept, so no watermark cuts the last day off."""
    source, out = _stream(spark, sf_dir)
    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/daily")

    feeds.run_to_end(feeds.windowed(source, "user_id", "ts", "value", "1 day", "2 days"), out, f"{out}-c", "complete", keep)
    return spark.read.parquet(f"{out}/daily").groupBy("user_id").agg(F.count("*").alias("days"), F.sum("n").alias("n"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM k WHERE r = 1""")
def stream_upsert(spark, sf_dir):
    source, out = _stream(spark, sf_dir)
    rows = source.select("user_id", "event_type", "event_id", "value")
    feeds.run_to_end(rows, out, f"{out}-c", "append", feeds.upsert_into(out, ["user_id", "event_type"], ["event_id"]))
    return feeds.current(spark, out)


@query("""WITH s AS (SELECT user_id, event_id, value, CASE WHEN value >= 60 THEN 1 WHEN value < 40 THEN 0 END AS st FROM events),
 l AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) SELECT user_id, event_id, value FROM l WHERE value >= 60 AND coalesce(before, 0) = 0""")
def stream_hysteresis(spark, sf_dir):
    source, out = _stream(spark, sf_dir)
    feeds.run_to_end(feeds.hysteresis(source, "user_id", "event_id", "value", 60, 40), out, f"{out}-c")
    return spark.read.schema("user_id long, event_id long, value double").parquet(out)


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_first_sightings(spark, sf_dir):
    source, out = _stream(spark, sf_dir)
    feeds.run_to_end(feeds.first_sightings(source, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), out, f"{out}-c")
    return spark.read.schema("user_id long, event_type string").parquet(out)


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """Gap sessions by user. The complete table is kept, so no watermark holds the last ones back."""
    source, out = _stream(spark, sf_dir)
    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/sessions")

    feeds.run_to_end(feeds.sessions(source, "user_id", "ts", "12 hours", "1 hour"), out, f"{out}-c", "complete", keep)
    return spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{out}/sessions")
