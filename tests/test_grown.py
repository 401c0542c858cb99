"""Waters grown over boxes that touch: told from places, the same as from a table of pairs."""

import numpy as np
from pyspark.sql import functions as F

from limnos.functions import blocks
from limnos.operators import growth, spatial


def test_boxes_need_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(k, float(x), float(y), float(x + w), float(y + w), bool(rng.random() < 0.7), ("a", "b", None, None, None, None)[rng.integers(6)]) for k, (x, y, w) in enumerate(np.c_[rng.normal(0, 0.3, 220), rng.normal(0, 0.3, 220), rng.uniform(0.01, 0.15, 220)])]
    rows.append((999, 5.0, 5.0, 5.1, 5.1, True, "a"))  # a seed outside its name's box, beside nothing
    nodes = spark.createDataFrame(rows, "node long, x0 double, y0 double, x1 double, y1 double, charted boolean, owner string")
    names = spark.createDataFrame([("a", -0.3, -0.3, 0.1, 0.1), ("b", 0.0, 0.0, 0.2, 0.2)], "name string, x0 double, y0 double, x1 double, y1 double")
    seeds = nodes.where("owner is not null and node % 4 = 3").select(F.col("owner").alias("name"), "node")
    other = nodes.select(F.col("node").alias("dst"), *(F.col(c).alias(f"_{c}") for c in growth.BOX))
    near = spatial.box_pairs(nodes.withColumnRenamed("node", "src"), other, growth.BOX, ("_x0", "_y0", "_x1", "_y1"), 0.1).where("src < dst")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    want = told(growth.grow(seeds, near, nodes, names, 0.05))
    assert {p for _, _, p in want} == {1, 2} and told(growth.grow(seeds, None, nodes, names, 0.05, 0.1)) == want
