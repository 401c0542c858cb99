"""Points, runs and series derived from the star tables, in Spark and in DuckDB by the same formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("grp"), F.round(-81.0 + e(0), 6).alias("lon"), F.round(34.0 + e(1), 6).alias("lat"), F.round(F.abs(e(2)) * 100, 4).alias("depth")
    )


POINTS = """points AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS grp, round(-81.0 + embedding[1]::DOUBLE, 6) AS lon,
  round(34.0 + embedding[2]::DOUBLE, 6) AS lat, round(abs(embedding[3]::DOUBLE) * 100, 4) AS depth FROM embeddings)"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with the next of its group by id."""
    from pyspark.sql import Window

    w = Window.partitionBy("grp").orderBy("id")
    return points(spark, sf_dir).withColumn("lon2", F.lead("lon").over(w)).withColumn("lat2", F.lead("lat").over(w)).where("lon2 is not null")


LEGS = (
    POINTS
    + """, legs AS (SELECT * FROM (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM points
  WINDOW w AS (PARTITION BY grp ORDER BY id)) WHERE lon2 IS NOT NULL)"""
)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time in whole seconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("t"))


SERIES = "series AS (SELECT event_id, user_id, event_type, value, ts, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM events)"

#: Metres between two points of a DuckDB row, as the library's flat distance.
METRES = "sqrt(power(({2} - {0}) * cos(radians(({1} + {3}) / 2)) * 111320.0, 2) + power(({3} - {1}) * 110570.0, 2))"


def metres(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return METRES.format(lon1, lat1, lon2, lat2)
