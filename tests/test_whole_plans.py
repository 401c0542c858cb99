"""Plans without SQL take all points and legs."""

from limnos.plans import registry
from limnos.plans.surrogates import legs, points

SF = "/root/testdata/sf0.001"


def test_plans_take_all_points(spark):
    for name, rows in (("plan_tours", points(spark, SF)), ("plan_orient_legs", legs(spark, SF))):
        got = registry.QUERIES[name](spark, SF)
        assert sorted(r["id"] for r in got.select("id").collect()) == sorted(r["id"] for r in rows.select("id").collect()), name
