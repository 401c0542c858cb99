"""Days of legs: the least order of all by permutations, worst winds, energy against the battery."""

import itertools
import math

import numpy as np

from limnos.functions import kernels
from limnos.operators import legs


def length(home, ends, order, flips):
    at, m = home, 0.0
    for i, f in zip(order, flips, strict=True):
        a, b = (ends[i][1], ends[i][0]) if f else (ends[i][0], ends[i][1])
        m, at = m + math.dist(at, a), b
    return m + math.dist(at, home)


def test_the_order_is_the_least_of_all():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5):
        for _ in range(4):
            home, ends = rng.uniform(-5, 5, 2), rng.uniform(-5, 5, (n, 2, 2))
            if n > 2:
                ends[1] = ends[0]  # a leg twice
            best, order, flips = kernels.best_order(home, ends)
            want = min((length(home, ends, p, f) for p in itertools.permutations(range(n)) for f in itertools.product((False, True), repeat=n)))
            assert sorted(order) == list(range(n)) and math.isclose(best, want, abs_tol=1e-9)
            assert math.isclose(length(home, ends, order, flips), best, abs_tol=1e-9)


def test_eight_legs_are_exact_and_more_are_walked():
    rng = np.random.default_rng(2)
    home, ends = rng.uniform(-5, 5, 2), rng.uniform(-5000, 5000, (8, 2, 2))
    exact, _, _ = kernels.best_order(home, ends)
    good, order, flips = kernels.good_order(home, ends)
    assert good >= exact - 1e-6 and sorted(order) == list(range(8)) and math.isclose(length(home, ends, order, flips), good, rel_tol=1e-9)
    # Direction taken greedily within each order is what permutations alone would give: never less than the least.
    assert exact <= min(length(home, ends, p, [math.dist(a, b) > 1e9 for a, b in ends]) for p in itertools.islice(itertools.permutations(range(8)), 500))


def test_days_cost_and_fit(spark):
    picked = [(1, 10, -81.0, 34.0, -81.0, 34.01, 1200.0), (1, 11, -81.0, 34.02, -81.0, 34.01, 1100.0)] + [(2, 100 + k, -81.0 + k / 500, 34.0, -81.0 + k / 500, 34.001, 120.0) for k in range(11)]
    p = spark.createDataFrame(picked, "plan int, leg int, lon1 double, lat1 double, lon2 double, lat2 double, metres double")
    d = spark.createDataFrame([(1, -81.0, 34.0, 8.0), (2, -81.0, 34.0, 0.0), (3, -81.0, 34.0, None), (4, -81.0, 34.0, 1.0)], "plan int, home_lon double, home_lat double, usable_ah double")
    w = spark.createDataFrame([(1, 6, 2.0, None, 90), (1, 7, 3.0, 20.0, 0), (1, 8, 20.0, None, 180), (2, 6, None, None, 5)], "plan int, hour int, mph double, gust_mph double, wind_from int")
    worst = {r["plan"]: (r["wind_mph"], r["wind_from"]) for r in legs.worst_winds(w, "plan", "hour").collect()}
    assert worst == {1: (20.0, 0.0)}
    out = {r["plan"]: r for r in legs.day_costs(p, d, "plan", "leg", 2.0, 3.0, legs.worst_winds(w, "plan", "hour")).collect()}
    one = out[1]
    assert (list(one["order"]), list(one["flips"])) in (([10, 11], [False, True]), ([11, 10], [False, True])) and one["exact"]
    assert math.isclose(one["move_m"], 0.02 * 110570.0, rel_tol=1e-6) and one["troll_m"] == 2300.0
    # Northward legs meet the north wind's drift, southward ones have it behind.
    amps = lambda v: 5.0 * (v / 2.0) ** 1.756
    want = amps(2.6) * 1200 / 1609.34 / 2.6 + amps(1.4) * 1100 / 1609.34 / 1.4 + amps(3.6) * one["move_m"] / 1609.34 / 3.6
    assert math.isclose(one["ah"], want, rel_tol=1e-6) and one["fits"] == (want <= 8.0)
    assert not out[2]["exact"] and sorted(out[2]["order"]) == list(range(100, 111)) and out[2]["fits"]
    assert (out[3]["ah"], list(out[3]["order"]), out[3]["fits"]) == (0.0, [], True) and out[4]["fits"]
