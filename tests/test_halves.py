"""Halves and edges at which Spark and the queries' SQL could part."""

import pytest
from pyspark.sql import functions as F

from limnos.functions import numbers
from limnos.operators import runs
from limnos.plans import registry


@pytest.mark.parametrize(("value", "places", "want"), [(9.661 * 50, 1, 483.1), (483.04999999999995, 1, 483.1), (-483.04999999999995, 1, -483.1), (0.25, 1, 0.3), (-0.04, 1, 0.0), (2.0**60, 2, 2.0**60), (1.005, 2, 1.0), (None, 2, None)])
def test_halves_are_told_on_the_scaled_double(spark, value, places, want):
    assert spark.createDataFrame([(value,)], "v double").select(numbers.round_scaled("v", places)).first()[0] == want


def test_a_mesh_rounds_its_ends_as_scaled_doubles(spark):
    # 1.005 * 100 is 100.49999999999999, so its end is 1.0.
    lines = spark.createDataFrame([(1, [(1.005, 2.0), (3.0, 4.0)]), (2, [(1.0, 2.0), (3.0, 4.0)])], "id int, line array<struct<x:double,y:double>>")
    assert [tuple(r) for r in runs.mesh(lines, "id", "line", 2).select("src", "dst").collect()] == [("1.0,2.0", "3.0,4.0")]


def points_of(spark, tmp_path, rows):
    spark.createDataFrame([(i, [x, y, z], 0) for i, (x, y, z) in enumerate(rows)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_points_on_an_edge_are_outside(spark, tmp_path):
    # Offsets of 0.05 and 0.1 in every direction stand on the diamond's edges, those of a millionth less within.
    edge = [(s * 0.05, t * 0.1, 0.01) for s in (-1, 1) for t in (-1, 1)]
    near = [(s * 0.05, t * 0.099999, 0.02) for s in (-1, 1) for t in (-1, 1)]
    d = points_of(spark, tmp_path, [(0.0, 0.0, 0.5), *edge, *near])
    got = registry.QUERIES["spatial_polygon_join"](spark, d).where(F.col("poly") == 0).first()
    assert (got["inside"], got["shallowest"]) == (5, 2.0)


def test_the_days_of_a_leap_years_end(spark):
    from limnos.operators import conditions

    # Shuffled: 366 falls together with 1, and each day's own value counts.
    points = spark.createDataFrame([(k, d, v) for k in range(50) for d, v in sorted([(1, 10.0), (366, 90.0), (11, 20.0)], key=lambda x: (x[0] * 7 + k) % 3)], "k int, d int, v double").repartition(7)
    at = spark.createDataFrame([(k, day) for k in range(50) for day in (1, 6, 365)], "k int, day int")
    got = {(r["day"], round(r["level"], 6)) for r in conditions.seasonal_value(points, "k", "d", "v", at, "day", linear=True).collect()}
    assert got == {(1, 10.0), (6, 15.0), (365, round(20 + 354 * 70 / 355, 6))}
