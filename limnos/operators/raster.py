"""Grids as cell tables: coverage, dilation, erosion, smoothing, run masks; contours tile by tile in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import geo, kernels
from limnos.operators import graph
from limnos.sources.shared import cut

#: Cells of a tile's side, which bounds what one task holds of a grid.
TILE = 256


def rasterize(points: DataFrame, keys: list[str], x: str, y: str, value: str, size: float, least: int = 1) -> DataFrame:
    """keys, i, j, mean, low, high, n of each cell with enough points."""
    c = geo.cell(x, y, size)
    by = points.groupBy(*keys, c["i"].alias("i"), c["j"].alias("j"))
    return by.agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).where(F.col("n") >= least)


def _offsets(n: int):
    return F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-n, n + 1) for b in range(-n, n + 1)))


def neighbourhood(cells: DataFrame, keys: list[str], value: str, n: int = 1) -> DataFrame:
    """keys, i, j, mean, low, count over each occupied cell's (2n+1)² block: cells send their value around, and sums combine map-side."""
    sent = cells.select(*keys, "i", "j", value, F.explode(_offsets(n)).alias("_o"))
    own = F.max((F.col("_o.a") == 0) & (F.col("_o.b") == 0))
    got = sent.groupBy(*keys, (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j"))
    return got.agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.count("*").alias("count"), own.alias("_own")).where("_own").drop("_own")


def dilate(cells: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    return cells.select(*keys, "i", "j", F.explode(_offsets(n)).alias("_o")).select(*keys, (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j")).distinct()


def erode(cells: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """Cells whose whole block is occupied."""
    return neighbourhood(cells.withColumn("_v", F.lit(1)), keys, "_v", n).where(F.col("count") == (2 * n + 1) ** 2).select(*keys, "i", "j")


def to_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, j, first, last: each row's maximal runs of cells."""
    w = Window.partitionBy(*keys, "j").orderBy("i")
    d = cells.select(*keys, "i", "j").distinct()
    return d.withColumn("_g", F.col("i") - F.row_number().over(w)).groupBy(*keys, "j", "_g").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("_g")


def merge_runs(runs: DataFrame, keys: list[str], first: str = "first", last: str = "last") -> DataFrame:
    """Overlapping or adjoining intervals merged: a new one starts beyond the running maximum of the ends."""
    w = Window.partitionBy(*keys).orderBy(first, last)
    before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | (F.col(first) > before + 1)
    g = runs.withColumn("_g", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "_g").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_g")


def charted_share(area: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the covered share of distinct cells; 0 where nothing is."""
    hit = covered.select(*keys, "i", "j").distinct().withColumn("_h", F.lit(1))
    return area.select(*keys, "i", "j").distinct().join(hit, [*keys, "i", "j"], "left").groupBy(*keys).agg((F.count("_h") / F.count("*")).alias("share"))


def contours(cells: DataFrame, key: str, value: str, levels: list[float], tile: int = TILE) -> DataFrame:
    """key, level, segments, lines, length (in cells) of iso-lines over each key's grid; levels that no cell crosses are 0.

    Tiles overlap by one cell, and each block of four cells is its least corner's tile's. A tile's segments are chained in numpy; chains that
    end on a tile's border are tied to their neighbours' by equal ends, and lines are the components.
    """
    size = F.lit(tile)
    tiles = F.array_compact(F.array(*(F.when((F.lit(a == 0) | (F.pmod("i", size) == 0)) & (F.lit(b == 0) | (F.pmod("j", size) == 0)), F.struct((F.floor(F.col("i") / size) - a).alias("ti"), (F.floor(F.col("j") / size) - b).alias("tj"))) for a in (0, 1) for b in (0, 1))))
    sent = cells.select(key, "i", "j", value, F.explode(tiles).alias("_t")).select(key, "i", "j", value, "_t.ti", "_t.tj")

    def trace(k, pdf: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = pdf["i"].min(), pdf["j"].min()
        grid = np.full((int(pdf["j"].max() - j0) + 1, int(pdf["i"].max() - i0) + 1), np.nan)
        grid[(pdf["j"] - j0).astype(int), (pdf["i"] - i0).astype(int)] = pdf[value]
        spot = lambda p: f"{round((p[0] + i0) * 1e5)},{round((p[1] + j0) * 1e5)}"
        rows = []
        for level in levels:
            for n, line in enumerate(kernels.chain_lines([list(s) for s in kernels.iso_segments(grid, level)])):
                length = float(np.hypot(*np.diff(np.array(line), axis=0).T).sum())
                rows.append((k[0], float(level), f"{k[1]},{k[2]},{n}", len(line) - 1, length, spot(line[0]), spot(line[-1])))
        return pd.DataFrame(rows, columns=[key, "level", "part", "segments", "length", "start", "end"])

    kind = dict(cells.dtypes)[key]
    parts = cut(sent.groupBy(key, "ti", "tj").applyInPandas(trace, f"{key} {kind}, level double, part string, segments long, length double, start string, end string"))
    name = F.concat_ws("|", F.col(key).cast("string"), F.col("level").cast("string"), "part")
    open_ = parts.where("start != end").select(name.alias("name"), F.explode(F.array("start", "end")).alias("spot"), key, "level")
    first = open_.groupBy(key, "level", "spot").agg(F.min("name").alias("first"))
    tied = open_.join(first, [key, "level", "spot"]).where("name != first").select("name", "first")
    found = graph.components(tied, "name", "first")
    lines = parts.join(found, name == found["node"], "left").groupBy(key, "level").agg(F.sum("segments").alias("segments"), F.count_distinct(F.coalesce("component", name)).alias("lines"), F.round(F.sum("length"), 6).alias("length"))
    every = cells.select(key).distinct().select(key, F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("level"))
    none = F.lit(0).cast("long")
    return every.join(lines, [key, "level"], "left").select(key, "level", F.coalesce("segments", none).alias("segments"), F.coalesce("lines", none).alias("lines"), F.coalesce("length", F.lit(0.0)).alias("length"))


def fill_fringe(cells: DataFrame, keys: list[str], value: str, reach: int = 3) -> DataFrame:
    """cells and the empty cells within reach of one, with the value of the nearest (of equal ones the least cell); `filled` marks them."""
    sent = cells.select(*keys, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col(value).alias("_v"), F.explode(_offsets(reach)).alias("_o"))
    near = F.min(F.struct((F.col("_o.a") * F.col("_o.a") + F.col("_o.b") * F.col("_o.b")).alias("d"), F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("_v").alias("v")))
    out = sent.groupBy(*keys, (F.col("_i") + F.col("_o.a")).alias("i"), (F.col("_j") + F.col("_o.b")).alias("j")).agg(near.alias("_n"))
    return out.where(F.col("_n.d") <= reach * reach).select(*keys, "i", "j", F.col("_n.v").alias(value), (F.col("_n.d") > 0).alias("filled"))
