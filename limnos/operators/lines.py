"""Lines at scale: stitching fragments, stretches within a depth band, contours from loose points, shore points and coves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import geo, kernels
from limnos.operators import graph, raster

LINE = "array<struct<x:double,y:double>>"


def stitch(lines: DataFrame, key: str, line_id: str, line: str, places: int = 5) -> DataFrame:
    """key, run (the least fragment's id), fragments, closed, line: fragments joined at equal rounded ends into maximal lines. A key's levels don't mix.

    At each spot ends are tied in pairs, in order of their fragments' ids, so of an odd number one stays loose. Lines follow by ranking: a fragment is
    a link in either direction, and of a line's two directions the one in which its least fragment runs as drawn is kept. No line's fragments meet in
    a task before they are put together as one. line_id: whole numbers. Fragments of fewer than two points are left out.
    """
    pieces = lines.where(F.size(line) > 1).select(key, F.col(line_id).cast("long").alias("id"), F.col(line).alias("_line"))
    spot = lambda p: F.struct((F.round(p["x"], places) + 0.0).alias("x"), (F.round(p["y"], places) + 0.0).alias("y"))
    ends = F.array(*(F.struct(F.lit(side).alias("side"), spot(F.element_at("_line", 1 if side == 0 else -1)).alias("spot")) for side in (0, 1)))
    # A port is a fragment's beginning (even) or end (odd); neighbours in order at a spot are tied two by two.
    ports = pieces.select(key, "id", F.explode(ends).alias("e")).select(key, "e.spot", (F.col("id") * 2 + F.col("e.side")).alias("port"))
    met = Window.partitionBy(key, "spot").orderBy("port")
    n = F.row_number().over(met)
    partner = F.when(n % 2 == 1, F.lead("port").over(met)).otherwise(F.lag("port").over(met))
    tied = ports.withColumn("partner", partner)
    # As drawn a fragment (2 id) leaves by its end and goes on by what is tied there: as drawn from a beginning, against it from an end. Against, it leaves by its beginning.
    links = tied.select((F.col("port").bitwiseXOR(1)).alias("link"), F.col("partner").alias("next"))
    ranked = graph.ranked(links, "link", "next").where(F.col("list") % 2 == 0)
    placed = ranked.select(F.floor(F.col("link") / 2).alias("id"), (F.col("link") % 2 == 1).alias("back"), "list", "rank", "closed").join(graph.by_keys(pieces), "id")
    drawn = F.when(F.col("back"), F.reverse("_line")).otherwise(F.col("_line"))
    part = F.struct("rank", F.when(F.col("rank") == 0, drawn).otherwise(F.slice(drawn, 2, F.size("_line") - 1)).alias("points"))
    whole = placed.groupBy(key, "list", "closed").agg(F.count("*").alias("fragments"), F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select(key, F.floor(F.col("list") / 2).alias("run"), "fragments", "closed", F.flatten(F.transform("parts", lambda x: x["points"])).cast(LINE).alias("line"))


def band_stretches(samples: DataFrame, keys: list[str], at_m: str, depth: str, low: float, high: float, least_m: float) -> DataFrame:
    """keys, start_m, end_m, n of the stretches of a sampled line that stay within a band, unknown depths breaking them, of at least so many metres."""
    from limnos.operators import sequence

    inside = F.col(depth).between(low, high)
    runs = sequence.islands(samples, keys, at_m, inside).groupBy(*keys, "island").agg(F.min(at_m).alias("start_m"), F.max(at_m).alias("end_m"), F.count("*").alias("n"))
    return runs.where(F.col("end_m") - F.col("start_m") >= least_m).drop("island")


def contours_from_points(points: DataFrame, link_deg: float, cell_deg: float, levels: list[float], least: int = 1, lon: str = "lon", lat: str = "lat", value: str = "depth") -> DataFrame:
    """cluster, level, segments, lines, length: loose soundings fall into clusters of touching cells; each cluster is gridded,
    smoothed over 3x3 cells, and contoured as one group."""
    c = geo.cell(lon, lat, link_deg)
    placed = points.withColumn("_i", c["i"]).withColumn("_j", c["j"])
    found = graph.cell_components(placed.select("_i", "_j"), "_i", "_j").withColumnRenamed("component", "cluster")
    cells = raster.rasterize(placed.join(found, ["_i", "_j"]), ["cluster"], lon, lat, value, cell_deg, least)
    smooth = raster.neighbourhood(cells, ["cluster"], "mean")
    return raster.contours(smooth, "cluster", "mean", levels)


def bulges(vertices: DataFrame, keys: list[str], order: str, reach: int, least_m: float) -> DataFrame:
    """vertices with `bulge_m`: how far a shore vertex stands off the middle of the chord between the vertices `reach` before and after it, where at least least_m; and whether no vertex within reach stands off more (the first of equal ones)."""
    w = Window.partitionBy(*keys).orderBy(order)
    mid = lambda c: (F.lag(c, reach).over(w) + F.lead(c, reach).over(w)) / 2
    out = vertices.withColumn("_x", mid("lon")).withColumn("_y", mid("lat")).withColumn("bulge_m", geo.equirect_m("lon", "lat", "_x", "_y"))
    near = w.rowsBetween(-reach, reach)
    before = F.max("bulge_m").over(w.rowsBetween(-reach, -1))
    out = out.withColumn("_top", (F.col("bulge_m") == F.max("bulge_m").over(near)) & ~F.coalesce(before >= F.col("bulge_m"), F.lit(False)))
    return out.where(F.col("_top") & (F.col("bulge_m") >= least_m)).drop("_x", "_y", "_top")


def simplified(lines: DataFrame, line: str, metres: float, out: str = "line") -> DataFrame:
    """Douglas-Peucker in metres about each line's mean latitude."""

    @F.pandas_udf(LINE)
    def run(batch: pd.Series) -> pd.Series:
        rows = []
        for one in batch:
            xy = np.array([(p["x"], p["y"]) for p in one], float).reshape(-1, 2)
            if len(xy) > 2:
                xy = xy[kernels.rdp_keep(kernels.to_metres(xy, float(xy[:, 1].mean())), metres)]
            rows.append([{"x": float(x), "y": float(y)} for x, y in xy])
        return pd.Series(rows, dtype=object)

    return lines.withColumn(out, run(line))
