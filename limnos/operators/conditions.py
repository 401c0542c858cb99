"""Readings: latest with age, seasonal levels, percentile bands, tide stages, hourly windows, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_reading(readings: DataFrame, keys: list[str], at: str, value: str, now: Column, stale_s: float) -> DataFrame:
    """keys, value, at, age_s and whether it is stale; stale readings are told, not dropped. Unknown values are no readings."""
    last = readings.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(value, at), F.struct(at, value)).alias("_l"))
    age = now - F.col(f"_l.{at}")
    return last.select(*keys, F.col(f"_l.{value}").alias(value), F.col(f"_l.{at}").alias(at), age.alias("age_s"), (age > stale_s).alias("stale"))


def seasonal_value(points: DataFrame, key: str, year_day: str, value: str, at: DataFrame, at_day: str, linear: bool = False) -> DataFrame:
    """at with `level`: the yearly curve's value on a day of the year (held from the last point, or interpolated). The curve repeats: its points stand in the year before and after too."""
    shifted = points.select(key, F.explode(F.array(F.lit(-365), F.lit(0), F.lit(365))).alias("_s"), (F.col(year_day) + F.col("_s")).alias("_d"), F.col(value).alias("_v"))
    # A leap year's day 366 and the next day 1 fall together: each day's own point counts from there on, and the year's own last one up to it.
    w = Window.partitionBy(key).orderBy("_d", "_s")
    span = shifted.withColumn("_n", F.lead("_d").over(w)).withColumn("_nv", F.lead("_v").over(w))
    hit = at.join(span, key, "left").where(F.col("_d").isNull() | ((F.col("_d") <= F.col(at_day)) & (F.col(at_day) < F.coalesce("_n", F.lit(1e9)))))
    line = F.col("_v") + (F.col(at_day) - F.col("_d")) * (F.col("_nv") - F.col("_v")) / F.nullif(F.col("_n") - F.col("_d"), F.lit(0))
    return hit.select(*at.columns, (F.coalesce(line, F.col("_v")) if linear else F.col("_v")).alias("level"))


def stat_band(value: Column, percentiles: list[tuple[int, Column]]) -> Column:
    """Between which published percentiles a value lies, in words; unknown percentiles are passed over, and without any, or a value, it is null."""
    known = F.filter(F.array(*(F.struct(F.lit(p).alias("p"), c.cast("double").alias("v")) for p, c in percentiles)), lambda x: x["v"].isNotNull())
    below = F.filter(known, lambda x: x["v"] <= value)
    above = F.filter(known, lambda x: x["v"] > value)
    low, high = F.try_element_at(below, F.lit(-1))["p"], F.get(above, F.lit(0))["p"]
    name = F.when(F.size(below) == 0, F.format_string("below the %dth percentile", high)).when(F.size(above) == 0, F.format_string("above the %dth percentile", low)).otherwise(F.format_string("between the %dth and %dth percentile", low, high))
    return F.when(value.isNotNull() & (F.size(known) > 0), name)


def tide_stage(events: DataFrame, key: str, at: str, kind: str, queries: DataFrame, query_at: str, slack_s: float = 2700) -> DataFrame:
    """queries with `stage`: high or low within the slack of such an event (of two the earlier), else flood or ebb by the next one, or past the last by that; null without any."""
    w = Window.partitionBy(key).orderBy("_t", "_e")
    e = events.select(key, F.col(at).alias("_t"), F.col(kind).alias("_k"), F.lit(0).alias("_e"))
    q = queries.withColumn("_t", F.col(query_at)).withColumn("_e", F.lit(1))
    both = q.unionByName(e, allowMissingColumns=True)
    event = F.when(F.col("_e") == 0, F.struct("_t", "_k"))
    both = both.withColumn("_p", F.last(event, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(event, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    before, ahead = F.col("_t") - F.col("_p._t"), F.col("_n._t") - F.col("_t")
    close = F.when(before <= slack_s, F.col("_p._k")).when(ahead <= slack_s, F.col("_n._k"))
    rising = F.coalesce(F.col("_n._k") == "H", F.col("_p._k") != "H")
    stage = F.when(close == "H", "high").when(close == "L", "low").when(rising, "flood").when(~rising, "ebb")
    return both.where("_e = 1").select(*queries.columns, stage.alias("stage"))


def hourly_window(hourly: Column, start: Column, end: Column) -> Column:
    """Of array<struct<t,kmh,gust,code>> the hours within [start, end] with whole mph, and thunder and rain flags by code."""
    inside = F.filter(hourly, lambda h: (h["t"] >= start) & (h["t"] <= end))
    mph = lambda v: F.floor(v * 0.621371 + 0.5).cast("int")
    rain = lambda c: c.between(61, 67) | c.between(80, 82)
    return F.transform(inside, lambda h: F.struct(h["t"].alias("t"), mph(h["kmh"]).alias("mph"), mph(h["gust"]).alias("gust"), (h["code"] >= 95).alias("thunder"), rain(h["code"]).alias("rain")))


def worst_wind(hours: Column) -> Column:
    """The hour of the greatest gust (else mean), the first of equal ones."""
    rank = lambda h: F.coalesce(h["gust"], h["mph"])
    return F.aggregate(hours, F.get(hours, F.lit(0)), lambda best, h: F.when(rank(h) > rank(best), h).otherwise(best))


def charge_first(sites: DataFrame, keys: list[str], place: str, wanted: list[str]) -> DataFrame:
    """For each wanted reading the first site in order that has it: keys, and <reading>, <reading>_site."""
    aggs = []
    for c in wanted:
        first = F.min_by(F.struct(F.col(c).alias("v"), F.col(place).alias("s")), F.when(F.col(c).isNotNull(), F.col(place)))
        aggs += [first["v"].alias(c), first["s"].alias(f"{c}_site")]
    return sites.groupBy(*keys).agg(*aggs)


#: A flow over so many times its monthly mean freshens an inlet; at the second the effect is whole.
INTRUSION_FROM, INTRUSION_WHOLE = 1.3, 2.5


def severity_ramp(current: Column, mean: Column) -> Column:
    """0 to 1 by the ratio of a flow to its monthly mean, three places; 0 up to the threshold and where either is unknown or the mean is not positive."""
    r = current / F.when(mean > 0, mean)
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (r - INTRUSION_FROM) / (INTRUSION_WHOLE - INTRUSION_FROM)))
    return F.round(F.coalesce(F.when(~F.isnan(ramp), ramp), F.lit(0.0)), 3)
