"""Waters grown from landings over touching polygons: who owns a polygon, how far each name reaches, and where another's water stops it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions import blocks, geo
from limnos.operators.spatial import box_cells
from limnos.sources.shared import cut, cut_and_tell, discard

BOX = ("x0", "y0", "x1", "y1")


def owners(landings: DataFrame, name: str, node: str) -> DataFrame:
    """node, owner: of the names with landings at a polygon the one with most there; of equal ones the one with most in all, then the least. Rows without a name or node count for none."""
    known = landings.where(F.col(name).isNotNull() & F.col(node).isNotNull())
    here = known.groupBy(node, name).agg(F.count("*").alias("_n"))
    total = known.groupBy(name).agg(F.count("*").alias("_t"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), (-F.col("_t")).alias("t"), F.col(name).alias("owner")))
    return here.join(total, name).groupBy(node).agg(best.alias("_b")).select(node, F.col("_b.owner").alias("owner"))


def _spread(start: DataFrame, held: DataFrame, step) -> DataFrame:
    """name, node: what `step` (of a frontier: name, node) leads to from start, round by round, that is not held already; each round's frontier is cut from its lineage."""
    found = cut(held)
    frontier, (live,) = cut_and_tell(start.select("name", "node").distinct(), F.count("*"))
    grown = [frontier.join(found, ["name", "node"], "left_anti")]
    while live:
        new = step(frontier).select("name", "node").distinct().join(found, ["name", "node"], "left_anti")
        for g in grown:
            new = new.join(g, ["name", "node"], "left_anti")
        frontier, (live,) = cut_and_tell(new, F.count("*"))
        grown.append(frontier)
        if len(grown) > 8:
            whole = cut(_union(grown))
            grown = [whole]
    return cut(_union(grown))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def touched(asks: DataFrame, by: DataFrame) -> DataFrame:
    """name, node of the asks whose box overlaps one of `by` of the same name and another node. Both: name, node, x0 to y1, a row a cell (c) that the box covers. Pairs are met in tasks, a cell at a time, by blocks of near boxes, and never made rows."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return a.select(["name", "node"]).slice(0, 0)
        box = lambda t: np.column_stack([t[c].to_numpy() for c in BOX])
        return a.select(["name", "node"]).filter(pa.array(blocks.overlapped(box(a), a["node"].to_numpy(), box(b), b["node"].to_numpy())))

    own = lambda t: t.select(*(F.col(c).alias(c.split(".")[-1]) for c in ("name", "node", *BOX, "c.i", "c.j"))).groupBy("name", "i", "j")  # noqa: E731; of lineages apart
    return own(asks).cogroup(own(by)).applyInArrow(meet, asks.select("name", "node").schema).distinct()


def grow(seeds: DataFrame, near: DataFrame | None, nodes: DataFrame, names: DataFrame, reach: Column | float | None = None, cell: float | None = None) -> DataFrame:
    """name, node, phase: the polygons that each name's water takes in.

    In phase 1 it grows from its seeds over touching polygons whose box meets the name's own (what its landings reach), and never into one that another name owns.
    In phase 2, if `reach` is given, it goes on from where only the box stopped it, over charted polygons within `reach` of what it holds by then. A polygon that nobody owns may go to several
    names. Each hop is a round over the frontier alone, and every table is cut from its lineage.
    seeds: name, node; near: src, dst, each pair once, either way round; nodes: node, owner (null: nobody's), charted, x0 to y1; names: name, x0 to y1. A seed stands whatever its box or owner.
    Without `near` polygons touch where their boxes overlap, and what a frontier touches is found by cells of the size `cell`, without a table of pairs.
    """
    own = names.select("name", *(F.col(c).alias(f"n{c}") for c in BOX))
    n_box, d_box = tuple(f"n{c}" for c in BOX), tuple(f"_{c}" for c in BOX)
    free = F.col("owner").isNull() | (F.col("owner") == F.col("name"))
    to = nodes.select(F.col("node").alias("dst"), "owner", "charted", *(F.col(c).alias(f"_{c}") for c in BOX))
    inside = geo.boxes_overlap(n_box, d_box)
    if near is not None:
        both = near.select("src", "dst").unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()
        held = [cut(both.join(to, "dst"))]

        def beside(frontier: DataFrame) -> DataFrame:
            return frontier.withColumnRenamed("node", "src").join(held[0], "src").where(free).join(own, "name")

        def step(frontier: DataFrame, fits) -> DataFrame:
            return fits(beside(frontier)).select("name", F.col("dst").alias("node"))

        def stopped(frontier: DataFrame) -> DataFrame:
            return beside(frontier).where(~inside).select("name", F.col("src").alias("node"))

    else:
        at = cut(nodes.select("node", *BOX))
        held = [at, cut(to.withColumn("c", F.explode(box_cells(d_box, cell))))]

        def sides(frontier: DataFrame, fits) -> tuple[DataFrame, DataFrame]:
            """A row a cell: the frontier's boxes, and those of the free polygons in its cells."""
            front = cut(frontier.select("name", "node").join(at, "node").withColumn("c", F.explode(box_cells(BOX, cell))))
            beside = front.select("name", "c").distinct().join(held[1], "c").where(free).join(own, "name")
            return front, fits(beside).select("name", F.col("dst").alias("node"), *(F.col(f"_{c}").alias(c) for c in BOX), "c")

        def step(frontier: DataFrame, fits) -> DataFrame:
            front, beside = sides(frontier, fits)
            return touched(beside, front)

        def stopped(frontier: DataFrame) -> DataFrame:
            return touched(*sides(frontier, lambda b: b.where(~inside)))

    first = _spread(seeds, seeds.select("name", "node").limit(0), lambda f: step(f, lambda b: b.where(inside)))
    out = first.withColumn("phase", F.lit(1))
    if reach is not None:
        core = first.join(nodes.select("node", *BOX), "node").groupBy("name").agg(*((F.min(c) if k < 2 else F.max(c)).alias(c) for k, c in enumerate(BOX)))
        wide = cut(core.select("name", *((F.col(c) - reach if k < 2 else F.col(c) + reach).alias(f"w{c}") for k, c in enumerate(BOX))))
        w_box = tuple(f"w{c}" for c in BOX)
        further = lambda b: b.where("charted").join(wide, "name").where(geo.boxes_overlap(w_box, d_box))
        out = out.unionByName(_spread(stopped(first), first, lambda f: step(f, further)).withColumn("phase", F.lit(2)))
    out = cut(out)
    discard(*held, first)
    return out
