"""Ordered rows: islands, gap sessions, nearest as-of, interpolation, trends, windows along a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: str, holds: Column, name: str = "island") -> DataFrame:
    """Rows where `holds`, numbered by their run of neighbours in order: a row that does not hold, or is unknown, breaks a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    ok = F.coalesce(holds, F.lit(False))
    starts = ok & ~F.coalesce(F.lag(ok).over(w), F.lit(False))
    return df.withColumn(name, F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_ok", ok).where("_ok").drop("_ok")


def longest_run(values: Column | str, needed: Column) -> Column:
    """Length of the longest run of array elements >= needed, in one pass over the array; null, NaN and negative elements break it."""
    step = lambda s, v: F.struct(
        F.when((v >= needed) & (v >= 0) & ~F.isnan(v), s["run"] + 1).otherwise(F.lit(0)).alias("run"),
        F.greatest(s["best"], F.when((v >= needed) & (v >= 0) & ~F.isnan(v), s["run"] + 1).otherwise(F.lit(0))).alias("best"),
    )
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(values, zero, step, lambda s: s["best"])


def gap_sessions(df: DataFrame, keys: list[str], order: str, gap: float, name: str = "session", tie: str | None = None) -> DataFrame:
    """Numbers a key's rows by session: a new one where the distance to the last row exceeds gap. A null order value stands alone."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), *([tie] if tie else []))
    before = F.lag(order).over(w)
    new = before.isNull() | F.col(order).isNull() | (F.col(order) - before > gap)
    return df.withColumn(name, F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def nearest_as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str, tolerance: float, out: str) -> DataFrame:
    """left with the right value nearest in time within tolerance (either side; of equal ones the earlier), else null.

    Times are numbers. Rows are bucketed by tolerance, so each meets three buckets, not a key's whole series.
    left's (key, at) pairs should be distinct; equal ones share a value.
    """
    a = left.select(key, at).distinct().withColumn("_b", F.explode(F.array(*((F.floor(F.col(at) / tolerance) + d).cast("long") for d in (-1, 0, 1)))))
    b = right.where(F.col(right_at).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.col(value).alias("_v"), F.floor(F.col(right_at) / tolerance).cast("long").alias("_rb"))
    near = a.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_rb"))).withColumn("_d", F.abs(F.col(at) - F.col("_t"))).where(F.col("_d") <= tolerance)
    best = near.groupBy(key, at).agg(F.min_by("_v", F.struct("_d", "_t", "_v")).alias(out))
    return left.join(best, [key, at], "left")


def interpolate(queries: DataFrame, knots: DataFrame, key: str, at: str, knot_at: str, value: str, out: str) -> DataFrame:
    """queries with the value linearly interpolated between the bracketing knots of their key; null outside the knots.

    One pass: queries and knots are ordered together, and each query sees the last knot before and the first after.
    """
    q = queries.select("*", F.col(at).cast("double").alias("_at"), F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_q"))
    k = knots.where(F.col(value).isNotNull()).groupBy(key, F.col(knot_at).cast("double").alias("_at")).agg(F.min(F.col(value).cast("double")).alias("_v")).withColumn("_q", F.lit(False))
    both = q.unionByName(k, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at")
    knot = F.when(F.col("_v").isNotNull(), F.struct("_at", "_v"))
    both = both.withColumn("_p", F.last(knot, True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(knot, True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    t = (F.col("_at") - F.col("_p._at")) / F.when(F.col("_n._at") > F.col("_p._at"), F.col("_n._at") - F.col("_p._at"))
    line = F.when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), F.col("_p._v") + F.coalesce(t, F.lit(0.0)) * (F.col("_n._v") - F.col("_p._v")))
    return both.where("_q").select(*queries.columns, line.alias(out))


def knots_value(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear over fixed knots, held at the ends."""
    knots = sorted(knots)
    out = F.when(x <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.when(x.isNotNull(), knots[-1][1]))


def densest_window(df: DataFrame, keys: list[str], order: str, weight: str, width: float) -> DataFrame:
    """Per key the start and sum of the window [start, start + width] with the greatest weight; the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(0, int(width))
    return df.withColumn("_s", F.sum(weight).over(w)).groupBy(*keys).agg(F.max("_s").alias("weight"), F.min_by(order, F.struct((-F.col("_s")).alias("a"), F.col(order).alias("b"))).alias("start"))


def next_or_last(df: DataFrame, keys: list[str], at: str, now: Column) -> DataFrame:
    """Per key the earliest row after now, else the latest before it."""
    ahead = F.col(at) >= now
    rank = F.struct(F.when(ahead, 0).otherwise(1).alias("a"), F.when(ahead, F.col(at) - now).otherwise(now - F.col(at)).alias("b"))
    w = Window.partitionBy(*keys).orderBy(rank, at)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def turns(df: DataFrame, keys: list[str], order: str, heading: str, out: str = "turn") -> DataFrame:
    """Unsigned change of heading since the row before."""
    from limnos.functions.geo import angle_between

    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, angle_between(F.col(heading), F.lag(heading).over(w)))


def hysteresis(df: DataFrame, keys: list[str], order: str, value: str, fire: float, rearm: float, out: str = "fires") -> DataFrame:
    """Whether a row sets off an alert: at or above `fire`, unless one is on since the value was last below `rearm`."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    # Rows that set or clear the alert decide; a row fires if it sets it and the last deciding row before cleared it, or there is none.
    state = F.when(v >= fire, True).when(v < rearm, False)
    df = df.withColumn("_s", state).withColumn("_l", F.last(F.col("_s"), True).over(upto))
    return df.withColumn(out, F.coalesce((v >= fire) & ~F.coalesce(F.lag("_l").over(w), F.lit(False)), F.lit(False))).drop("_s", "_l")
