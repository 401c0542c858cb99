"""Streaming sessions against sessions of the whole table."""

from collections import Counter
from datetime import timedelta

from limnos.plans import registry

SF = "/root/testdata/sf0.001"


def test_stream_sessions_equal_batch(spark):
    by, want = {}, Counter()
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "cast(ts as timestamp) as ts").collect():
        by.setdefault(r["user_id"], []).append(r["ts"])
    gap = timedelta(hours=12)
    for user, times in by.items():
        times.sort()
        start, last, n = times[0], times[0], 0
        for t in times:
            if t >= last + gap:
                want[user, start, last + gap, n] += 1
                start, n = t, 0
            last, n = t, n + 1
        want[user, start, last + gap, n] += 1
    got = Counter((r["user_id"], r["start"], r["end"], r["n"]) for r in registry.QUERIES["stream_sessions"](spark, SF).collect())
    assert got == want
