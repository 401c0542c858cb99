"""A round's joins go by shuffles: small tables would be gathered at the driver to be sent out."""

from limnos.operators import graph


def test_rounds_joins_are_not_broadcast(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (5, 6), (6, 5)], "id long, next long")
    out = graph.ranked(links)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, False), (2, 1, 1, False), (3, 1, 2, False), (5, 5, 0, True), (6, 5, 1, True)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
