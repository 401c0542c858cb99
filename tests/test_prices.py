"""Spots and the pieces about them, met in tasks, against all pairs at once."""

import numpy as np

from limnos.functions import blocks, kernels
from limnos.operators import legs


def test_spots_are_priced_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(7)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.06, (200, 2)).round(3) + (-81, 34))] + [(900, None, 34.0), (901, -80.0, 34.0)]
    at = rng.normal(0, 0.06, (150, 2)).round(3) + (-81, 34)
    ends = at + rng.uniform(-0.01, 0.01, (150, 2)).round(3)
    ends[5] = at[5]  # without length
    at[7], ends[7] = at[6], ends[6]  # equally far
    near = legs.price_spots(spark.createDataFrame(spots, "id long, lon double, lat double"), spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(at, ends, strict=True))], "piece int, ax double, ay double, bx double, by double"), "id", "piece", 4000.0, 300.0)
    got = {r["id"]: (r["piece"], r["detour_m"], r["free"]) for r in near.collect()}
    x, y = np.array([s[1:] for s in spots[:200]]).T
    d = kernels.to_segments_m(x, y, *at.T, *ends.T)
    for k in range(200):
        best = d[k].min()
        on = best <= 300
        assert got[k] == ((int(d[k].argmin()) if on else None), (int(np.floor(best + 0.5)) if best <= 4000 else None), bool(on))
    assert got[900] == got[901] == (None, None, False) and 20 < sum(v[2] for v in got.values()) < 200
