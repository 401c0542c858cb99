"""Queries over the depth raster and runs fitted to it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from limnos.operators import fitting
from limnos.plans.q_polygons import _diamond
from limnos.plans.registry import query
from limnos.plans.surrogates import POINTS, points

SIZE = 0.01


def _areas(spark, sf_dir):
    """A charted band about every point; its half-width keeps cells' centres off its edges."""
    return points(spark, sf_dir).select("grp", "depth", _diamond("lon", "lat", 0.0500003).alias("rings"))


def _runs(spark, sf_dir):
    """Lines of forty points of a group, from west to east."""
    w = Window.partitionBy("grp").orderBy("lon", "id")
    p = points(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1).withColumn("run", F.floor(F.col("n") / 40))
    line = F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("lon").alias("x"), F.col("lat").alias("y")))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    runs = p.groupBy("grp", "run").agg(line.alias("line"), F.avg("depth").alias("target"))
    tiles = fitting.depth_tiles(fitting.depth_cells(_areas(spark, sf_dir), "grp", "depth", "rings", SIZE), "grp")
    return fitting.with_tiles(runs, tiles, "grp", "run", "line", SIZE, 0.1)


@query(f"""WITH {POINTS}, c AS (SELECT grp, depth, i, j FROM (SELECT *, unnest(range(CAST(floor(lon / 0.01) AS BIGINT) - 6, CAST(floor(lon / 0.01) AS BIGINT) + 7)) AS i FROM points) t1,
 LATERAL (SELECT unnest(range(CAST(floor(lat / 0.01) AS BIGINT) - 6, CAST(floor(lat / 0.01) AS BIGINT) + 7)) AS j) WHERE abs((i + 0.5) * 0.01 - lon) + abs((j + 0.5) * 0.01 - lat) < 0.0500003),
 d AS (SELECT grp, i, j, min(depth) AS depth FROM c GROUP BY ALL), w AS (SELECT a.grp, a.i, a.j, min(b.depth) AS thin FROM d a JOIN d b ON a.grp = b.grp AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL)
 SELECT grp, i, j, depth, thin FROM d JOIN w USING (grp, i, j)""")
def fit_depth_cells(spark, sf_dir):
    """The shallowest band of every cell, and that of the cells about it."""
    cells = fitting.depth_cells(_areas(spark, sf_dir), "grp", "depth", "rings", SIZE)
    return cells.join(fitting.widened(cells, "grp").withColumnRenamed("depth", "thin"), ["grp", "i", "j"])


@query()
def fit_steered(spark, sf_dir):
    """Runs by their farthest legal chords; tests hold every chord by brute force."""
    out = fitting.steered(_runs(spark, sf_dir).withColumn("floor", F.col("target") / 4), "line", "floor", SIZE, 15000.0, 60.0)
    return out.select("grp", "run", F.size("line").alias("vertices"), F.size("steered").alias("kept"), "steered")


@query()
def fit_runs(spark, sf_dir):
    """Runs stepped to their deeper side and relaxed, once and again: the second pass changes nothing."""
    once = fitting.fitted(_runs(spark, sf_dir), "line", "target", SIZE, 6.0, 2000.0, 250.0)
    return fitting.fitted(once, "line", "target", SIZE, 6.0, 2000.0, 250.0).select("grp", "run", "fitted", "line")
