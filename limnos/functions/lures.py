"""Scores of lures for a situation, and how deep they run, as Columns over rows that hold both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _col

#: Score of what cannot reach the depth at all.
UNFIT = -999.0


def fitness(*, target, rated_low, rated_high, ideal, species, season, clarity, preference, mph, mph_low, mph_ideal, mph_high, structures, presentation) -> Column:
    """struct<score,confidence,fit>. A rated depth is a gate; the rest adds up: species (of 10, thrice), season (one and a half times), clarity, nearness to the ideal depth where none is rated,
    place in the preferred types (from 0; null where none are told, -1 outside them), speed within its range, up to three shared structures, and points of presentation."""
    t, lo, hi = _col(target), _col(rated_low), _col(rated_high)
    unfit = F.coalesce((t < lo) | (t > hi), F.lit(False))
    score = 3 * F.coalesce(_col(species), F.lit(5)) + 1.5 * F.coalesce(_col(season), F.lit(5)) + F.coalesce(_col(clarity), F.lit(5))
    score = score + F.when(lo.isNull() & _col(ideal).isNotNull() & t.isNotNull(), F.greatest(F.lit(0.0), 10 - F.abs(_col(ideal) - t) * 0.8)).otherwise(0.0)
    p = _col(preference)
    score = score + F.when(p.isNull(), 0).when(p < 0, 2).when(p == 0, 20).when(p == 1, 15).when(p == 2, 10).otherwise(F.greatest(F.lit(0), 8 - p))
    v = _col(mph)
    score = score + F.when(v.isNull() | _col(mph_low).isNull(), 0.0).when(v.between(_col(mph_low), _col(mph_high)), F.greatest(F.lit(0.0), 5 - F.abs(v - _col(mph_ideal)) * 2)).otherwise(-5.0)
    score = score + F.least(F.lit(6), 2 * F.coalesce(_col(structures), F.lit(0))) + F.coalesce(_col(presentation), F.lit(0))
    confidence = F.least(F.lit(0.97), F.greatest(F.lit(0.30), score / 75))
    return F.struct(F.when(unfit, UNFIT).otherwise(score).alias("score"), F.when(unfit, 0.0).otherwise(F.floor(confidence * 100 + 0.5) / 100).alias("confidence"), (~unfit).alias("fit"))


def lead_feet(target, mode, rated_high, ratio, speed_factor) -> Column:
    """Feet of line behind the boat: 80 for surface lures, else the depth (no deeper than rated) times the ratio and, where speed matters, its factor."""
    depth = F.when(_col(mode) == "rated", F.least(_col(target), F.coalesce(_col(rated_high), _col(target)))).otherwise(_col(target))
    return F.when(_col(mode) == "surface", F.lit(80).cast("long")).otherwise(F.floor(depth * F.coalesce(_col(ratio), F.lit(4.0)) * F.coalesce(_col(speed_factor), F.lit(1.0)) + 0.5).cast("long"))


def reach(target, mode, rated_low, rated_high, ratio, speed_factor, mph, mph_limit, longest) -> Column:
    """struct<ok,limited_by>: what keeps a lure from a depth: speed beyond a hard limit, its rating, or more lead than there is."""
    d = _col(target)
    lead = lead_feet(target, mode, rated_high, ratio, speed_factor)
    limit = (
        F.when(_col(mph_limit).isNotNull() & (_col(mph) > _col(mph_limit)), "speed")
        .when((_col(mode) == "surface") & (d > 2), "surface")
        .when((_col(mode) == "rated") & ~F.coalesce(d.between(_col(rated_low), _col(rated_high)), F.lit(False)), "rating")
        .when((_col(mode) == "lead") & _col(longest).isNotNull() & (lead > _col(longest)), "lead")
    )
    return F.struct(limit.isNull().alias("ok"), limit.alias("limited_by"))
