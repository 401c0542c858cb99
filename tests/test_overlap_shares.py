"""Outlines that overlap are measured in the tasks that make their pairs, against plain Python."""

import numpy as np
import pytest

from limnos.functions import kernels
from limnos.operators import spatial
from limnos.plans import registry


def outlines(spark, n):
    rng = np.random.default_rng(4)
    rows = []
    for k, (x, y, a) in enumerate(np.column_stack([rng.uniform(0, 0.4, (n, 2)), rng.uniform(0.02, 0.06, n)]).round(4).tolist()):
        ring = [(x - a, y), (x, y - a), (x + a, y), (x, y + a)] if k % 3 else [(x - a, y - a), (x + a, y - a / 2), (x, y + a)]
        rows.append((k, [ring, [(x - a / 9, y - a / 9), (x + a / 9, y - a / 9), (x, y + a / 9)]] if k % 5 == 0 else [ring], x - a, y - a, x + a, y + a))
    return rows, spark.createDataFrame(rows, "k long, rings array<array<struct<x:double,y:double>>>, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize("part", [3, 1000])
def test_shares_are_those_of_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(spatial, "PART", part)
    rows, df = outlines(spark, 120)
    got = {(r["a"], r["b"]): (r["a_in_b"], r["b_in_a"], r["ratio"]) for r in spatial.overlap_shares(df, "k", "rings", ("x0", "y0", "x1", "y1"), 0.1, 1.0).collect()}
    arrays = lambda rings: [np.array(r) for r in rings]
    want = {}
    for p in rows:
        for q in rows[p[0] + 1 :]:
            a, b, both = kernels.exact_overlap(arrays(p[1]), arrays(q[1]))
            if 100 * both / a > 1:
                want[p[0], q[0]] = (100 * both / a, 100 * both / b, min(a, b) / max(a, b))
    assert got.keys() == want.keys() and len(got) > 500
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in got)


def test_the_query_joins_no_outlines(spark, monkeypatch):
    monkeypatch.delattr(spatial, "box_pairs")
    monkeypatch.delattr(spatial, "exact_overlaps")
    assert registry.QUERIES["spatial_overlap_verdicts"](spark, "/root/testdata/sf0.001").count() > 0


def test_copies_of_a_box_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PART", 1)
    rows, df = outlines(spark, 600)
    seen = []
    dealt = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: seen.append(self) or dealt(self, *a))
    got = spatial.overlapping(df, "k", ("x0", "y0", "x1", "y1"), 1.0).count()
    box = np.array([r[2:] for r in rows])
    hit = (box[:, None, 0] <= box[:, 2]) & (box[:, 0] <= box[:, None, 2]) & (box[:, None, 1] <= box[:, 3]) & (box[:, 1] <= box[:, None, 3])
    assert got == np.triu(hit, 1).sum()
    cells = spatial.box_cells(("x0", "y0", "x1", "y1"), 1.0)
    assert seen[0].count() <= spatial.COPIES * df.selectExpr("*").withColumn("c", cells).selectExpr("sum(size(c))").first()[0]
