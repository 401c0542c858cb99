"""Shortest ways between points that lie within a leg's reach of each other, without a table of legs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.blocks import apart, blocks, boxed, flat
from limnos.operators.spatial import around, known_place, place_of
from limnos.sources.shared import cut, cut_and_tell, discard

def nearer(x, y, m, fx, fy, fm, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point the least of its way so far (m) and of ways over a leg from a front point, and that front point (-1: none is shorter; of equal ones the first).
    Blocks are held against each other from the least possible way up, and not at all where no way can be shorter."""
    best, by = m.copy(), np.full(len(m), -1)
    parts = blocks(fx, fy)
    boxes, least = boxed(fx, fy, parts), np.array([fm[p].min() for p in parts])
    for mine in blocks(x, y):
        gap = apart(boxed(x, y, [mine])[0], boxes)
        bound = np.where(gap <= metres, least + gap, np.inf)
        for k in np.argsort(bound, kind="stable"):
            if not bound[k] <= best[mine].max() or bound[k] == np.inf:
                break
            p = parts[k]
            d = flat(x[mine], y[mine], fx[p], fy[p])
            way = np.where(d <= metres, fm[p] + d, np.inf)
            at = way.argmin(1)
            w = way[np.arange(len(mine)), at]
            take = (w < best[mine]) | ((w == best[mine]) & (by[mine] > p[at]))
            best[mine[take]], by[mine[take]] = w[take], p[at][take]
    return best, by


def tree(points: DataFrame, starts: DataFrame, group: str, metres: float) -> DataFrame:
    """group, a, floor, id, m (metres, infinite where there is no way), hops, prev: the shortest ways from each start to all points of its group, over legs of at most so many metres.

    points: group, id, lon, lat, depth; starts: group, a (an id), floor. A point shallower than the floor is reached, and not passed; one of unknown depth is.
    Ways grow a leg a round from the points that the round before brought nearer. A round joins these with all points of a start by cells, and a task takes a cell's: legs are told from the coordinates, so none is ever a row.
    """
    own = ["a", "floor", group]
    i, j = place_of("x", "y", metres)
    at = points.where(known_place("lon", "lat")).select(group, "id", F.col("lon").alias("x"), F.col("lat").alias("y"), "depth").join(starts.select(*own).distinct(), group)
    first = F.col("id") == F.col("a")
    begin = at.select(
        *own,
        "id",
        "x",
        "y",
        i.alias("i"),
        j.alias("j"),
        (F.col("depth").isNull() | (F.col("depth") >= F.col("floor"))).alias("deep"),
        F.when(first, 0.0).otherwise(float("inf")).alias("m"),
        F.lit(0).alias("hops"),
        F.lit(None).cast(points.schema["id"].dataType).alias("prev"),
        first.alias("new"),
    )
    state, (live,) = cut_and_tell(begin, F.count_if("new"))

    def leg(held: pa.Table, front: pa.Table) -> pa.Table:
        names = held.column_names
        if held.num_rows == 0 or front.num_rows == 0:
            return held.set_column(names.index("new"), "new", pa.array(np.zeros(held.num_rows, bool)))
        front = front.sort_by([("fhops", "ascending"), ("fid", "ascending")])
        num = lambda t, c: t[c].to_numpy(zero_copy_only=False) if isinstance(t[c], pa.Array) else t[c].combine_chunks().to_numpy(zero_copy_only=False)
        m, by = nearer(num(held, "x"), num(held, "y"), num(held, "m"), num(front, "fx"), num(front, "fy"), num(front, "fm"), metres)
        moved = pa.array(by >= 0)
        source = pa.array(np.maximum(by, 0))
        new = {"m": pa.array(m), "hops": pc.if_else(moved, pc.add(front["fhops"].take(source), pa.scalar(1, pa.int32())), held["hops"]), "prev": pc.if_else(moved, front["fid"].take(source), held["prev"]), "new": moved}
        for c, values in new.items():
            held = held.set_column(names.index(c), c, values)
        return held

    keys = [*own, "i", "j"]
    while live:
        # A point too shallow is passed by none; the start itself is.
        front = state.where("new and (deep or id = a)").select(*own, F.col("id").alias("fid"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("m").alias("fm"), F.col("hops").alias("fhops"), F.explode(around("x", "y", metres)).alias("c"))
        front = front.select(*own, "fid", "fx", "fy", "fm", "fhops", "c.i", "c.j")
        after, (live,) = cut_and_tell(state.groupBy(*keys).cogroup(front.groupBy(*keys)).applyInArrow(leg, state.schema), F.count_if("new"))
        discard(state)
        state = after
    return state.select(*own, "id", "m", "hops", "prev")


def lengths(found: DataFrame, requests: DataFrame, group: str) -> DataFrame:
    """requests (group, request, a, b, floor) with length and hops out of `tree`; null where there is no way."""
    ends = found.where("m < double('infinity')").select(group, "a", "floor", F.col("id").alias("b"), F.col("m").alias("length"), "hops")
    return requests.join(ends, [group, "a", "floor", "b"], "left")


def paths(found: DataFrame, met: DataFrame, group: str) -> DataFrame:
    """group, request, path: the points from a to b of ways that `lengths` found, followed back a round a leg."""
    back = found.where("prev is not null").select(group, "a", "floor", F.col("id").alias("n"), "prev")
    step, (live,) = cut_and_tell(met.where("length is not null").select(group, "request", "a", "floor", F.col("b").alias("n"), F.lit(0).alias("k")), F.count("*"))
    whole = step
    while live:
        up = step.join(back, [group, "a", "floor", "n"]).select(group, "request", "a", "floor", F.col("prev").alias("n"), (F.col("k") + 1).alias("k"))
        step, (live,) = cut_and_tell(up, F.count("*"))
        whole = whole.unionByName(step)
    return whole.groupBy(group, "request").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "n"))).alias("p")).select(group, "request", F.transform("p", lambda x: x["n"]).alias("path"))


def routes(points: DataFrame, requests: DataFrame, group: str, metres: float) -> DataFrame:
    """group, request, length, path, depth_held: a shortest way for each request (group, request, a, b, min_depth) over legs of at most so many metres between points of its group.
    The way over deep points is tried first; where there is none the limit is dropped and depth_held is false. What one start reaches is as large as its group, and in no task at once."""
    asks = cut(requests.select(group, "request", "a", "b", F.col("min_depth").cast("double").alias("floor")))
    deep = tree(points, asks, group, metres)
    first = cut(lengths(deep, asks, group))
    rest = first.where("length is null").select(group, "request", "a", "b", F.lit(float("-inf")).alias("floor"))
    free = tree(points, rest, group, metres)
    second = cut(lengths(free, rest, group))
    told = first.where("length is not null").withColumn("depth_held", F.lit(True)).unionByName(second.withColumn("depth_held", F.lit(False)))
    ways = paths(deep, first, group).unionByName(paths(free, second, group))
    return told.join(ways, [group, "request"], "left").select(group, "request", F.round("length", 6).alias("length"), "path", "depth_held")
