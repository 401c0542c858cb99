"""Lines stitched by ranking: long chains in any drawing direction, closed ones, junctions."""

import math
import random

from limnos.operators import lines


def frame(spark, rows):
    return spark.createDataFrame([(k, i, [{"x": float(x), "y": float(y)} for x, y in p]) for k, i, p in rows], "grp int, id long, line array<struct<x: double, y: double>>").repartition(3)


def length(p):
    return sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False))


def test_chains_become_one_line(spark):
    rng = random.Random(6)
    rows, want, nxt = [], {}, 0
    for grp, (n, closed) in enumerate(((1, False), (2, False), (3, True), (40, False), (500, True), (1200, False))):
        spots = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(n + (not closed))]
        if closed:
            spots.append(spots[0])
        ids = list(range(nxt, nxt + n))
        nxt += n
        rng.shuffle(ids)
        for i, a, b in zip(ids, spots, spots[1:], strict=False):
            mid = ((a[0] + b[0]) / 2, a[1])
            rows.append((grp, i, [a, mid, b] if rng.random() < 0.5 else [b, mid, a]))
        want[grp] = (min(ids), n, closed, spots)
    got = {}
    for r in lines.stitch(frame(spark, rows), "grp", "id", "line", 6).collect():
        assert r["grp"] not in got
        got[r["grp"]] = r
    drawn = {i: p for _, i, p in rows}
    for grp, (least, n, closed, spots) in want.items():
        r = got[grp]
        line = [(p["x"], p["y"]) for p in r["line"]]
        assert (r["run"], r["fragments"], r["closed"], len(line)) == (least, n, closed, 2 * n + 1)
        even = line[::2]
        if closed:
            k = spots.index(even[0])
            ring = spots[:-1]
            turned = ring[k:] + ring[:k]
            assert even[:-1] in (turned, [turned[0], *turned[:0:-1]]) and even[0] == even[-1]
        else:
            assert even in (spots, spots[::-1])
        at = line.index(drawn[least][1])  # the least fragment runs as drawn
        assert line[at - 1] == drawn[least][0] and line[at + 1] == drawn[least][2]


def test_junctions_pair_in_order_and_levels_stay_apart(spark):
    star = [(1, i, [(0, 0), (math.cos(i), math.sin(i))]) for i in range(5)]
    same = [(2, 10, [(0, 0), (1, 1)]), (3, 11, [(1, 1), (2, 2)]), (3, 12, [(5, 5)]), (3, 13, [(7, 7), (8, 8), (7, 7)])]
    out = {(r["grp"], r["run"]): r for r in lines.stitch(frame(spark, star + same), "grp", "id", "line", 6).collect()}
    assert {k: r["fragments"] for k, r in out.items()} == {(1, 0): 2, (1, 2): 2, (1, 4): 1, (2, 10): 1, (3, 11): 1, (3, 13): 1}
    assert out[3, 13]["closed"] and sum(length([(p["x"], p["y"]) for p in r["line"]]) for k, r in out.items() if k[0] == 1) == 5.0
    assert lines.stitch(frame(spark, star).limit(0), "grp", "id", "line").count() == 0
