"""Bottom structure and shoreline features: ledges, high spots, dock groups, collapsed records."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import geo
from limnos.operators import polygons, sequence, spatial
from limnos.sources.shared import cut

# Feet of drop between compared levels, metres of run at most and at least, degrees of a result cell.
DROP_FT, MAX_RUN_M, MIN_RUN_M, RESULT_CELL = 5.0, 400.0, 5.0, 0.0008
#: Acres of a high spot's loop, at least and at most; metres off the shore's vertices, at least.
HUMP_ACRES, OFFSHORE_M = (0.4, 500.0), 0.0012 * 111320.0
#: Gap that parts dock groups, length and count that make a line of them.
DOCK_GAP_M, DOCK_LINE_M, DOCK_LINE_MIN = 120.0, 250.0, 4
#: Metres within which records of one place collapse.
COLLAPSE_M = 150.0


def ledges(points: DataFrame, key: str, level: str, lon: str = "lon", lat: str = "lat", cell: float = RESULT_CELL) -> DataFrame:
    """key, i, j, slope (ft per 100 ft), drop, run_m, depth: per cell the steepest way from a level's point to the nearest point of the
    next level that is at least DROP_FT deeper. Levels are matched by a window over the distinct ones, points by key, level and cells of the run's reach."""
    levels = points.select(key, F.col(level).alias("d1")).distinct()
    deeper = F.first("d1").over(Window.partitionBy(key).orderBy("d1").rangeBetween(int(DROP_FT), Window.unboundedFollowing))
    step = levels.withColumn("d2", deeper).where("d2 is not null")
    a = points.select(key, F.col(level).alias("d1"), F.col(lon).alias("alon"), F.col(lat).alias("alat")).join(step, [key, "d1"])
    b = points.select(F.col(key).alias("_k"), F.col(level).alias("_d"), F.col(lon).alias("blon"), F.col(lat).alias("blat"))
    near = spatial.radius_join(a, b, ("alon", "alat"), ("blon", "blat"), MAX_RUN_M, [(key, "_k"), ("d2", "_d")])
    run = near.groupBy(key, "d1", "d2", "alon", "alat").agg(F.min("distance_m").alias("m"))
    slope = (F.col("d2") - F.col("d1")) / (F.greatest(F.col("m"), F.lit(MIN_RUN_M)) / 30.48)
    at = geo.cell("alon", "alat", cell, "trunc")
    best = F.max(F.struct(slope.alias("slope"), (F.col("d2") - F.col("d1")).alias("drop"), F.greatest(F.col("m"), F.lit(MIN_RUN_M)).alias("run_m"), F.col("d2").alias("depth")))
    return run.groupBy(key, at["i"].alias("i"), at["j"].alias("j")).agg(best.alias("_b")).select(key, "i", "j", "_b.*")


def find_humps(loops: DataFrame, lake: str, loop: str, depth: str, ring: str, shores: DataFrame | None = None, cell: float = 0.02) -> DataFrame:
    """lake, loop, lon, lat, acres, depth, levels, relief: closed contours of fitting area whose middle lies in the lake and off its shore, with how many smaller ones' middles they hold (themselves included) and the greatest difference
    of depth to those. ring: array of x, y; shores: lake, ring (of the lake). Loops are looked up by the index of polygons, so a loop meets those in its cells alone; equal areas count by id. Rings that aren't closed are left out."""
    r = F.col(ring)
    first, last = F.element_at(r, 1), F.element_at(r, -1)
    shut = loops.where((F.size(r) >= 4) & (F.abs(first["x"] - last["x"]) < 1e-9) & (F.abs(first["y"] - last["y"]) < 1e-9))
    middle = geo.vertex_mean(ring)
    acres = F.abs(geo.shoelace(ring)) * (geo.M_LON * geo.M_LON) * F.cos(F.radians(middle["y"])) / 4046.86
    sized = shut.select(lake, F.col(loop).alias("loop"), F.col(depth).cast("double").alias("depth"), middle["x"].alias("lon"), middle["y"].alias("lat"), acres.alias("acres"), r.alias("_ring"))
    h = sized.where(F.col("acres").between(*HUMP_ACRES))
    if shores is not None:
        within = polygons.inside(h.select(lake, "loop", "lon", "lat"), shores.select(lake, F.array("ring").alias("_rings")), ("lon", "lat"), "_rings", cell, (lake,))
        h = h.join(within.select(lake, "loop").distinct(), [lake, "loop"])
    h = cut(h)
    about = h.select(lake, F.col("loop").alias("outer"), F.col("depth").alias("_d"), F.col("acres").alias("_a"), F.array("_ring").alias("_rings"))
    hit = polygons.inside(h.select(lake, "loop", "lon", "lat", "depth", "acres"), about, ("lon", "lat"), "_rings", cell, (lake,))
    hit = hit.where((F.col("acres") < F.col("_a")) | ((F.col("acres") == F.col("_a")) & (F.col("loop") > F.col("outer"))))
    nested = hit.groupBy(lake, F.col("outer").alias("loop")).agg(F.count("*").alias("_n"), F.max(F.abs(F.col("depth") - F.col("_d"))).alias("_r"))
    out = h.join(nested, [lake, "loop"], "left").select(lake, "loop", "lon", "lat", "acres", "depth", (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("levels"), F.coalesce("_r", F.lit(0.0)).alias("relief"))
    if shores is not None:
        spots = shores.select(F.col(lake).alias("_k"), F.explode("ring").alias("p")).select("_k", F.col("p.x").alias("_x"), F.col("p.y").alias("_y"))
        near = spatial.radius_join(out.select(lake, "loop", "lon", "lat"), spots, ("lon", "lat"), ("_x", "_y"), OFFSHORE_M, [(lake, "_k")])
        out = out.join(near.where(F.col("distance_m") < OFFSHORE_M).select(lake, "loop").distinct(), [lake, "loop"], "left_anti")
    return out.withColumnRenamed("loop", loop) if loop != "loop" else out


def score_humps(humps: DataFrame, key: str) -> DataFrame:
    """Relief, nesting and size over the group's greatest, weighted .45, .35 and .20, of 100."""
    w = Window.partitionBy(key)
    part = lambda c: F.col(c) / F.coalesce(F.nullif(F.max(c).over(w), F.lit(0)), F.lit(1))
    return humps.withColumn("score", F.round(100 * (0.45 * part("relief") + 0.35 * part("levels") + 0.20 * part("acres")), 1))


def dock_groups(hits: DataFrame, key: str, s: str, d: str) -> DataFrame:
    """key, s, kind, d, n, span_m of docks along a line: parted by gaps; a long row is a line placed at its start, several are a cluster and one a dock, placed in the middle."""
    g = sequence.gap_sessions(hits, [key], s, DOCK_GAP_M, "_g").groupBy(key, "_g").agg(F.min(s).alias("a"), F.max(s).alias("b"), F.min(d).alias("d"), F.count("*").alias("n"))
    span = F.col("b") - F.col("a")
    kind = F.when((span >= DOCK_LINE_M) & (F.col("n") >= DOCK_LINE_MIN), "dock_line").when(F.col("n") > 1, "dock_cluster").otherwise("dock")
    g = g.withColumn("kind", kind)
    place = F.when(F.col("kind") == "dock_line", F.col("a")).otherwise((F.col("a") + F.col("b")) / 2)
    return g.select(key, place.alias("s"), "kind", "d", "n", F.floor(span + 0.5).cast("long").alias("span_m"))


def classify_edge(own, deepest, shallowest):
    """Rungs in order: channel edge, flat, steep bank, break."""
    drop = deepest - own
    return F.when(drop >= 15, "channel_edge").when(deepest - shallowest <= 4, "flat").when((shallowest <= 2) & (deepest - shallowest >= 8), "steep_bank").otherwise("break")


def first_wins(df: DataFrame, group: str, order: str, close, fields: list[str], schema: str) -> DataFrame:
    """Greedy in order: a row joins the first kept row that `close(kept, row)` accepts, else is kept. Adds `leader`, the kept row's order value.
    Order decides, so this is no component search; a group (one water's records) is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept: list[dict] = []
        leaders = []
        for row in pdf.to_dict("records"):
            lead = next((k for k in kept if close(k, row)), None)
            if lead is None:
                kept.append(row)
            leaders.append((lead or row)[order])
        return pdf.assign(leader=leaders)

    return df.select(group, order, *fields).groupBy(group).applyInPandas(run, schema)


def metres_apart(a: dict, b: dict) -> float:
    return float(np.hypot((b["lon"] - a["lon"]) * np.cos(np.radians(a["lat"])) * geo.M_LON, (b["lat"] - a["lat"]) * geo.M_LAT_SEGMENT))


# Words without identity in a launch's name.
_LAUNCH_WORDS = re.compile("ramp|launch|landing|boatingaccess|marina|park|facility|area")


def same_launch(a: dict, b: dict) -> bool:
    """Within 0.006 degrees, or within 0.02 where one plain name (four letters or more) holds the other."""
    d = float(np.hypot(a["lat"] - b["lat"], a["lon"] - b["lon"]))
    names = [_LAUNCH_WORDS.sub("", re.sub("[^a-z0-9]", "", (x["name"] or "").lower())) for x in (a, b)]
    return d < 0.006 or (len(names[1]) >= 4 and d < 0.02 and (names[0] in names[1] or names[1] in names[0]))


def collapse(records: DataFrame, group: str, order: str, metres: float = COLLAPSE_M) -> DataFrame:
    """group, leader, name (the longest, then least, of those merged), aliases, sources, n of records at one place, fuel docks apart. records: lon, lat, name, kind, source."""
    kinds = dict(records.dtypes)
    schema = f"{group} {kinds[group]}, {order} {kinds[order]}, lon double, lat double, name string, kind string, source string, leader {kinds[order]}"
    close = lambda a, b: (a["kind"] == "fuel_dock") == (b["kind"] == "fuel_dock") and metres_apart(a, b) <= metres
    led = first_wins(records, group, order, close, ["lon", "lat", "name", "kind", "source"], schema)
    best = F.min_by("name", F.struct((-F.length("name")).alias("a"), F.col("name").alias("b")))
    out = led.groupBy(group, "leader").agg(best.alias("name"), F.array_sort(F.collect_set("name")).alias("names"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.count("*").alias("n"))
    return out.select(group, "leader", "name", F.array_remove("names", F.col("name")).alias("aliases"), "sources", "n")
