"""The outline that covers most of another, found in blocks, against all pairs at once."""

import numpy as np

from limnos.functions import blocks, kernels
from limnos.operators import binding, spatial
from limnos.plans import registry


def test_best_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(spatial, "OUTLINE_PART", 30)
    rng = np.random.default_rng(9)

    def outline(k, x, y, a):
        ring = [(x - a, y), (x, y - a), (x + a, y), (x, y + a)] if k % 3 else [(x - a, y - a), (x + a, y - a / 2), (x, y + a)]
        hole = [[(x - a / 9, y - a / 9), (x + a / 9, y - a / 9), (x, y + a / 9)]] if k % 5 == 0 else []
        return [ring, *hole]

    def side(n):
        out = [outline(k, *v) for k, v in enumerate(np.column_stack([rng.uniform(0, 0.5, (n, 2)), rng.uniform(0.02, 0.06, n)]).round(4).tolist())]
        out[3] = out[2]  # equally good
        return out

    def frame(rows, key, rings, names):
        box = lambda r: [f(p[c] for p in r[0]) for f, c in ((min, 0), (min, 1), (max, 0), (max, 1))]
        return spark.createDataFrame([(k, r, *box(r)) for k, r in enumerate(rows)], f"{key} long, {rings} array<array<struct<x:double,y:double>>>, " + ", ".join(f"{n} double" for n in names))

    a, b = side(90), side(110)
    got = {r["w"]: (r["p"], r["share"]) for r in binding.match_by_overlap(frame(a, "w", "rings", ("x0", "y0", "x1", "y1")), frame(b, "p", "prings", ("tx0", "ty0", "tx1", "ty1")), "w", "p", 0.1, 20.0).collect()}
    arrays = lambda rings: [np.array(r) for r in rings]
    want = {}
    for k, one in enumerate(a):
        shares = [kernels.exact_overlap(arrays(one), arrays(two)) for two in b]
        s = [np.floor(100 * both / own * 1e6 + 0.5) / 1e6 if own else 0 for own, _, both in shares]
        if max(s) >= 20:
            want[k] = (int(np.argmax(s)), max(s))
    assert got.keys() == want.keys() and 40 < len(got) < 90
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in got)
    # The query measures no pairs as rows.
    monkeypatch.delattr(spatial, "exact_overlaps")
    assert registry.QUERIES["bind_best_overlap"](spark, "/root/testdata/sf0.001").count() > 0
