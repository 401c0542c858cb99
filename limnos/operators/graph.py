"""Graphs as edge tables: components, pointer chases, propagation to a fixpoint; path kernels run on one graph a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import kernels
from limnos.sources.shared import cut, cut_and_tell, discard


def by_keys(df: DataFrame) -> DataFrame:
    """A join's side that is shuffled to its keys, however small it is: a round's tables would be sent to all executors through the driver, which in many rounds adds up there."""
    return df.hint("merge")


def components(edges: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """node, component (its least node), for all nodes that an edge ties to another.

    Edges point from the greater to the lesser node. In turn, a node's greater neighbours are tied to the least of its neighbours, and its lesser
    ones to the least of them, until edges are stars. Every step joins edges with one row a node, so no node's neighbours meet in a task,
    and rounds grow with the logarithm of the longest chain. Every round's table is cut from its lineage.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    marks = (F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20)))
    e, mark = cut_and_tell(e, *marks)
    before = None
    while mark[0] and mark != before:
        least = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        wide = e.join(by_keys(least), e["b"] == least["n"]).select("a", F.col("m").alias("b"))
        own = e.join(by_keys(least), e["a"] == least["n"]).select("a", F.col("m").alias("b"))
        wide = wide.unionByName(own).where("a != b").distinct()
        low = wide.groupBy("a").agg(F.min("b").alias("m"))
        tied = wide.join(by_keys(low), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = mark
        after, mark = cut_and_tell(tied.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), *marks)
        discard(e)
        e = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def cell_components(cells: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """i, j, component of distinct grid cells that touch, corners included; the component is the least cell's `i:j` number."""
    code = F.col(i).cast("long") * 4294967296 + F.col(j).cast("long") + 2147483648
    c = cut(cells.select(i, j, code.alias("n")).distinct())
    around = F.array(*(F.lit(a * 4294967296 + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) > (0, 0)))
    pairs = c.select("n", F.explode(F.transform(around, lambda d: F.col("n") + d)).alias("m")).join(c.select(F.col("n").alias("m")), "m")
    found = components(pairs, "n", "m")
    return c.join(found, c["n"] == found["node"], "left").select(i, j, F.coalesce("component", "n").alias("component"))


def chase(pointers: DataFrame, key: str = "id", to: str = "next") -> DataFrame:
    """key, end (the last of its chain) and steps, by pointer doubling: rounds grow with the logarithm of the chain. Nodes that lead into a cycle have a null end.
    A round reads what is resolved and writes only what was not; a pointer to a node that is no key ends there."""
    none = F.lit(None).cast(pointers.schema[key].dataType)
    ends_here = F.col(to).isNull()
    rows = pointers.select(F.col(key).alias("k"), F.col(to).alias("t"), F.when(ends_here, 0).otherwise(1).cast("long").alias("n"), F.when(ends_here, F.col(key)).otherwise(none).alias("end"))
    state, (size, live) = cut_and_tell(rows, F.count("*"), F.count_if(F.col("end").isNull()))
    parts, done = [state.where("end is not null")], 1
    rest = state.where("end is null")
    while live:
        # A pointer past the table's rows runs in a cycle.
        if done > 2 * size:
            parts.append(rest.withColumn("n", F.lit(None).cast("long")))
            break
        known = rest
        for p in parts:
            known = known.unionByName(p)
        known = known.select(F.col("k").alias("t"), F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("end").alias("end2"), F.lit(1).alias("hit"))
        met = rest.drop("end").join(by_keys(known), "t", "left")
        moved = met.select("k", F.when(F.col("end2").isNull(), F.coalesce("t2", "t")).otherwise(F.col("t")).alias("t"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.when(F.col("hit").isNull(), F.col("t")).otherwise(F.col("end2")).alias("end"))
        state, (live,) = cut_and_tell(moved, F.count_if(F.col("end").isNull()))
        parts.append(state.where("end is not null"))
        rest, done = state.where("end is null"), 2 * done
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("k").alias(key), "end", F.col("n").alias("steps"))


def ranked(links: DataFrame, key: str = "id", to: str = "next") -> DataFrame:
    """key, list (its least key), rank (from 0) and closed, for keys in lists: each has one key after it, or none at the end of its list, and at most one before it.
    A closed list, where the last leads to the first, begins at its least key. All of it is done in rounds that grow with the logarithm of the longest list; no list meets in a task."""
    rows = links.select(F.col(key).alias("k"), F.col(to).alias("t"))
    found = components(rows, "k", "t")
    # A key that leads to itself or nowhere, and that none leads to, is in no edge.
    named = cut(rows.join(by_keys(found), rows["k"] == found["node"], "left").select("k", "t", F.coalesce("component", "k").alias("list")))
    shut = named.groupBy("list").agg(F.min(F.col("t").isNotNull()).alias("closed"))
    opened = named.join(by_keys(shut), "list").select("k", "list", "closed", F.when(~(F.col("closed") & (F.col("t") == F.col("list"))), F.col("t")).alias("t"))
    steps = cut(opened.join(by_keys(chase(opened, "k", "t").select("k", "steps")), "k").select("k", "list", "closed", "steps"))
    last = steps.groupBy("list").agg(F.max("steps").alias("most"))
    discard(named)
    return steps.join(by_keys(last), "list").select(F.col("k").alias(key), "list", (F.col("most") - F.col("steps")).alias("rank"), "closed")


def accumulate(links: DataFrame, own: DataFrame, key: str, to: str, value: str) -> DataFrame:
    """key and the sum of value over itself and all that lead into it, through a forest of links (each key has one `to` at most).
    After k rounds a key holds what lies within 2**k steps; pointers double with it, so rounds grow with the logarithm of the longest chain.
    Links that run in a cycle never end: keep them out (`chase` finds them)."""
    total = cut(own.select(F.col(key).alias("k"), F.col(value).alias("v")))
    step, (left,) = cut_and_tell(links.select(F.col(key).alias("k"), F.col(to).alias("t")).where("k is not null and t is not null"), F.count("*"))
    while left:
        moved = total.join(step, "k").select(F.col("t").alias("k"), "v")
        after = cut(total.unionByName(moved).groupBy("k").agg(F.sum("v").alias("v")))
        further, (left,) = cut_and_tell(step.join(step.select(F.col("k").alias("t"), F.col("t").alias("u")), "t").select("k", F.col("u").alias("t")), F.count("*"))
        discard(total, step)
        total, step = after, further
    return total.select(F.col("k").alias(key), F.col("v").alias(value))


def health(edges: DataFrame, graph: str, u: str = "src", v: str = "dst", counts: DataFrame | None = None) -> DataFrame:
    """graph, nodes, edges and the share of nodes outside the largest component. Where the edges are only ties that leave the same components, counts (graph, edges) tells how many there are."""
    name = lambda c: F.struct(F.col(graph).alias("g"), F.col(c).alias("n"))
    e = edges.select(name(u).alias("a"), name(v).alias("b"))
    sizes = components(e, "a", "b").groupBy("component").agg(F.count("*").alias("n"))
    by = sizes.groupBy(F.col("component.g").alias(graph)).agg(F.sum("n").alias("nodes"), F.max("n").alias("largest"))
    if counts is None:
        counts = edges.groupBy(graph).agg(F.count("*").alias("edges"))
    return by.join(counts, graph).select(graph, "nodes", "edges", F.round(1 - F.col("largest") / F.col("nodes"), 6).alias("orphan_share"))


def routes(edges: DataFrame, requests: DataFrame, graph: str) -> DataFrame:
    """A shortest path for each request on its own graph. edges: graph, src, dst, weight, depth (of dst's node, symmetrical where both are listed).
    requests: graph, request, a, b, min_depth. The constrained path is tried first; where there is none the limit is dropped and depth_held is false.
    One graph is one group: a graph must fit a task, as one water's does."""

    def solve(key, e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names = pd.unique(np.concatenate([e["src"], e["dst"], q["a"], q["b"]]))
        number = {n: i for i, n in enumerate(names)}
        depth = np.full(len(names), np.nan)
        depth[[number[d] for d in e["dst"]]] = e["depth"]
        arcs = [(number[a], number[b], w) for a, b, w in zip(e["src"], e["dst"], e["weight"], strict=True)]
        rows = []
        for r in q.itertuples():
            ok = np.isnan(depth) | (depth >= r.min_depth)
            got = kernels.shortest_path(len(names), arcs, number[r.a], number[r.b], ok)
            held = got is not None
            got = got or kernels.shortest_path(len(names), arcs, number[r.a], number[r.b])
            rows.append((key[0], r.request, round(got[0], 6) if got else None, [int(names[i]) for i in got[1]] if got else None, held))
        return pd.DataFrame(rows, columns=[graph, "request", "length", "path", "depth_held"])

    kind = dict(edges.dtypes)[graph]
    requests = requests.select(*(F.col(c).alias(c) for c in requests.columns))  # of a lineage apart from the edges'
    return edges.groupBy(graph).cogroup(requests.groupBy(graph)).applyInPandas(solve, f"{graph} {kind}, request long, length double, path array<long>, depth_held boolean")


def reachable(edges: DataFrame, starts: DataFrame, stops: DataFrame | None, hops: int, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """start, node, hop: what each start reaches along the edges within so many hops, at the fewest; a stop node is reached, and not passed."""
    e = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct())
    seen = cut(starts.select(F.col(node).alias("start"), F.col(node).alias("node"), F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in range(1, hops + 1):
        open_ = front if stops is None or hop == 1 else front.join(stops.select(F.col(node).alias("node")), "node", "left_anti")
        new = open_.join(e, open_["node"] == e["a"]).select("start", F.col("b").alias("node"), F.lit(hop).alias("hop")).distinct()
        front, (n,) = cut_and_tell(new.join(seen.select("start", "node"), ["start", "node"], "left_anti"), F.count("*"))
        if not n:
            break
        seen = seen.unionByName(front)  # a part a hop
    return seen


def dominant(pairs: DataFrame, a: str, b: str, share: float = 100.0):
    """Whether first values of pairs are greater (true) or less (false) than second ones by so many to one; null where neither is."""
    n = pairs.agg(F.count_if(F.col(a) > F.col(b)).alias("down"), F.count_if(F.col(a) < F.col(b)).alias("up"))
    return n.select(F.when(F.col("down") > share * F.col("up"), True).when(F.col("up") > share * F.col("down"), False).alias("decreasing"), "down", "up")


def shortest(edges: DataFrame, requests: DataFrame, u: str = "src", v: str = "dst", weight: str = "weight") -> DataFrame:
    """requests (request, a, b) with length, hops and path (nodes from a to b) of a least way over directed edges; null where there is none. For a graph of any size and any number of pairs on it.

    Ways grow from each distinct start, a round a hop, over the nodes that the round before brought nearer, and no farther than the farthest end that the start still has to reach, once a way to all of its ends is known.
    Of equal ways one is told. Weights are not negative; edges without one, or with an unknown end, don't exist. Paths are followed back by the nodes before, a round a hop; nothing but a path is one row.
    """
    e = cut(edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(weight) >= 0)).groupBy(F.col(u).alias("_u"), F.col(v).alias("_v")).agg(F.min(weight).cast("double").alias("_w")))
    asks = cut(requests.select("request", "a", "b"))
    start = asks.where("a is not null").select(F.col("a").alias("s"), F.col("a").alias("n")).distinct()
    best = cut(start.select("s", "n", F.lit(0.0).alias("m"), F.lit(None).cast(start.schema["n"].dataType).alias("prev"), F.lit(0).alias("hops")))
    front, live = best, 1
    while live:
        due = asks.join(best.select(F.col("s").alias("a"), F.col("n").alias("b"), "m"), ["a", "b"], "left").groupBy(F.col("a").alias("s")).agg(F.max(F.coalesce("m", F.lit(float("inf")))).alias("due"))
        near = front.join(e, front["n"] == e["_u"]).select("s", F.col("_v").alias("n"), (F.col("m") + F.col("_w")).alias("m"), F.col("n").alias("prev"), (F.col("hops") + 1).alias("hops"))
        near = near.join(due, "s").where("m < due").groupBy("s", "n").agg(F.min(F.struct("m", "hops", "prev")).alias("x"))
        known = best.select("s", "n", F.col("m").alias("_m"))
        nearer = near.join(known, ["s", "n"], "left").where(F.col("_m").isNull() | (F.col("x.m") < F.col("_m"))).select("s", "n", "x.m", "x.prev", "x.hops")
        after, (live,) = cut_and_tell(nearer, F.count("*"))
        if live:
            merged = cut(best.join(after.select("s", "n"), ["s", "n"], "left_anti").unionByName(after))
            discard(best)
            best = merged
        if front is not best:
            discard(front)
        front = after
    met = asks.join(best.select(F.col("s").alias("a"), F.col("n").alias("b"), "m", "hops"), ["a", "b"], "left").select("request", "a", "b", F.col("m").alias("length"), "hops")
    back = best.select("s", "n", "prev")
    step, (live,) = cut_and_tell(met.where("length is not null").select("request", F.col("a").alias("s"), F.col("b").alias("n"), F.lit(0).alias("k")), F.count("*"))
    steps = [step]
    while live:
        up = steps[-1].join(back, ["s", "n"]).where("prev is not null").select("request", "s", F.col("prev").alias("n"), (F.col("k") + 1).alias("k"))
        step, (live,) = cut_and_tell(up, F.count("*"))
        steps.append(step)
    whole = steps[0]
    for s in steps[1:]:
        whole = whole.unionByName(s)
    paths = whole.groupBy("request").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "n"))).alias("p")).select("request", F.transform("p", lambda x: x["n"]).alias("path"))
    return met.join(paths, "request", "left")
