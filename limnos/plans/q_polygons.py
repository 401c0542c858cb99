"""Queries over polygons by cells: masks, differences, common parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators import polygons
from limnos.plans.registry import query
from limnos.plans.surrogates import LEGS, POINTS, legs

#: Half the width of a mask's diamond: no centre of a cell lies on its edge, as points have six places.
HALF = 0.1500003


def _diamond(x: str, y: str, half: float):
    v = lambda dx, dy: F.struct((F.col(x) + dx).alias("x"), (F.col(y) + dy).alias("y"))
    return F.array(F.array(v(-half, 0.0), v(0.0, -half), v(half, 0.0), v(0.0, half)))


@query(f"""WITH {POINTS}, c AS (SELECT id, i, j FROM (SELECT id, lon, lat, unnest(range(CAST(floor(lon / 0.02) AS BIGINT) - 9, CAST(floor(lon / 0.02) AS BIGINT) + 10)) AS i FROM points) t1,
 LATERAL (SELECT unnest(range(CAST(floor(lat / 0.02) AS BIGINT) - 9, CAST(floor(lat / 0.02) AS BIGINT) + 10)) AS j) WHERE abs((i + 0.5) * 0.02 - lon) + abs((j + 0.5) * 0.02 - lat) < {HALF}),
 n AS (SELECT DISTINCT id, i + di AS i, j + dj AS j FROM c, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(di, dj)),
 k AS (SELECT id, count(*) AS cells, CAST(sum(i * 31 + j) AS BIGINT) AS mark FROM c GROUP BY id), m AS (SELECT id, count(*) AS widened FROM n GROUP BY id)
 SELECT id, cells, mark, widened FROM k JOIN m USING (id)""")
def poly_masks(spark, sf_dir):
    """Cells whose centre a diamond about a point holds, and those beside them."""
    from limnos.plans.surrogates import points

    shapes = points(spark, sf_dir).select("id", _diamond("lon", "lat", HALF).alias("rings"))
    cells = polygons.mask(shapes, "id", "rings", 0.02).groupBy("id").agg(F.count("*").alias("cells"), F.sum(F.col("i") * 31 + F.col("j")).alias("mark"))
    return cells.join(polygons.mask(shapes, "id", "rings", 0.02, 1).groupBy("id").agg(F.count("*").alias("widened")), "id")


#: What two diamonds of half-width 0.06 share, by their turned coordinates.
COMMON = "greatest(0, 0.12 - abs((lon - lon2) + (lat - lat2))) * greatest(0, 0.12 - abs((lon - lon2) - (lat - lat2))) / 2"


def _sides(spark, sf_dir):
    """A diamond about each point, and as its cutter the one about the next point of its group."""
    rows = legs(spark, sf_dir)
    return rows.select("id", _diamond("lon", "lat", 0.06).alias("rings")), rows.select("id", F.col("id").alias("cutter"), _diamond("lon2", "lat2", 0.06).alias("rings"))


@query(f"""WITH {LEGS} SELECT id, round(0.0072 - {COMMON}, 7) AS area FROM legs WHERE round(0.0072 - {COMMON}, 7) > 0""")
def poly_difference(spark, sf_dir):
    """Each point's diamond without the next one's."""
    a, b = _sides(spark, sf_dir)
    parts = polygons.overlay(a, b, "id", "cutter", 0.25, "id", places=12)
    return parts.groupBy("id").agg(F.round(F.sum(polygons.area(F.col("rings"))), 7).alias("area")).where("area > 0")


@query(f"""WITH {LEGS} SELECT id, 1::BIGINT AS parts, round({COMMON}, 7) AS area FROM legs WHERE round({COMMON}, 7) > 0""")
def poly_common(spark, sf_dir):
    """What each point's diamond has in common with the next one's."""
    a, b = _sides(spark, sf_dir)
    parts = polygons.overlay(a, b, "id", "cutter", 0.25, "id", common=True, places=12)
    return parts.groupBy("id").agg(F.count("*").alias("parts"), F.round(F.sum(polygons.area(F.col("rings"))), 7).alias("area")).where("area > 0")


@query(f"""WITH {POINTS} SELECT id, 1::BIGINT AS parts, round(0.0072::DOUBLE, 7) AS area FROM points""")
def poly_dissolve(spark, sf_dir):
    """Diamonds about all points, cut by tiles of a tenth of a degree, are one part each again."""
    from limnos.plans.surrogates import points

    p = points(spark, sf_dir).select("id", "lon", "lat", _diamond("lon", "lat", 0.06).alias("rings"))
    span = lambda c: F.sequence(F.floor((F.col(c) - 0.06) * 10), F.floor((F.col(c) + 0.06) * 10))
    tiles = p.withColumn("i", F.explode(span("lon"))).withColumn("j", F.explode(span("lat"))).withColumn("piece", F.struct("id", "i", "j"))
    corner = lambda i, j: F.struct((i / 10.0).alias("x"), (j / 10.0).alias("y"))
    i, j = F.col("i"), F.col("j")
    square = F.array(F.array(corner(i, j), corner(i + 1, j), corner(i + 1, j + 1), corner(i, j + 1)))
    cut = polygons.overlay(tiles.select("piece", "rings"), tiles.select("piece", F.col("piece").alias("tile"), square.alias("rings")), "piece", "tile", 0.25, "piece", common=True, places=12)
    box = cut.select(F.col("piece.id").alias("id"), "rings", *((F.col(f"piece.{c}") + k).cast("double") / 10.0 for c, k in (("i", 0), ("j", 0), ("i", 1), ("j", 1)))).toDF("id", "rings", "x0", "y0", "x1", "y1")
    whole = polygons.dissolve(box, "id", ("x0", "y0", "x1", "y1"), 0.25, places=12)
    return whole.groupBy("id").agg(F.count("*").alias("parts"), F.round(F.sum(polygons.area(F.col("rings"))), 7).alias("area"))
