"""Polygons by cells: an index of inner and border cells, masks on it, and differences and intersections put together from pieces of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import geo
from limnos.sources.shared import cut, cut_and_tell, discard

#: Share of a cell by which an edge's part in a row of cells is widened before it is dealt to cells, so that rounding never puts it beside its own.
SLACK = 1e-7
CELLS = "i long, j long, odd int, flips array<double>, edges array<struct<ax: double, ay: double, bx: double, by: double>>"
RINGS = "array<array<struct<x: double, y: double>>>"
#: Pieces of a polygon up to which its rings are tied in one task; a polygon of more is ranked in rounds.
TIED = 4096


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the whole numbers first to last: rows' numbers and the numbers."""
    n = np.maximum(0, last - first + 1)
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[rows]


def _edges(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All edges of a batch of polygons, ring by ring, closed: polygon (row), begin, end, and the edge that ends where each begins."""
    per_polygon = np.diff(rings.offsets.to_numpy())
    flat = rings.flatten()
    sizes = np.diff(flat.offsets.to_numpy())
    points = flat.flatten()
    xy = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1).astype(float).reshape(-1, 2)
    ends = np.cumsum(sizes)
    after = np.arange(len(xy)) + 1
    after[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    before = np.empty(len(xy), np.int64)
    before[after] = np.arange(len(xy))
    return np.repeat(np.repeat(np.arange(len(per_polygon)), per_polygon), sizes), xy, xy[after], before


def cells_of(rings: pa.ListArray, size: float) -> tuple[np.ndarray, list[pa.Array]]:
    """polygon (row), and i, j, odd, flips, edges of the cells that polygons cover, whole or in part.

    A point of a cell is inside if `odd`, plus the flips above the point, plus the cell's edges to its right, is an odd number. The cell's edges are
    those whose part in its row of cells meets it. An edge whose part lies wholly right of it counts by its ends: a point is right or left of it as one
    end is above the point and the other isn't, and an end that two such edges share counts twice. What is left are ends above the row, alike for
    all its points (`odd`), and ends that adjoin an edge of the cell (`flips`).
    """
    polygon, a, b, before = _edges(rings)
    if not len(a):
        none = pa.array([], pa.int64())
        return np.zeros(0, np.int64), [none, none, pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64())), pa.array([], pa.list_(pa.struct([(k, pa.float64()) for k in ("ax", "ay", "bx", "by")])))]
    row_a, row_b = (np.floor(p[:, 1] / size).astype(np.int64) for p in (a, b))
    low = np.minimum(row_a, row_b)
    edge, j = _spans(low, np.maximum(row_a, row_b))
    first_part = np.searchsorted(edge, np.arange(len(a)))
    (ax, ay), (bx, by) = a[edge].T, b[edge].T
    level = ay == by
    slope = (bx - ax) / np.where(level, 1.0, by - ay)

    def at(y: np.ndarray) -> np.ndarray:
        return ax + (np.clip(y, np.minimum(ay, by), np.maximum(ay, by)) - ay) * slope

    x0, x1 = np.where(level, ax, at(j * size)), np.where(level, bx, at((j + 1) * size))
    i0 = np.floor(np.minimum(x0, x1) / size - SLACK).astype(np.int64)
    i1 = np.floor(np.maximum(x0, x1) / size + SLACK).astype(np.int64)
    rows, row_of = np.unique(np.stack([polygon[edge], j], 1), axis=0, return_inverse=True)
    row_of, least = row_of.ravel(), i0.min()
    width = i1.max() - least + 2
    # Border cells, by row and place, and their edges.
    part, i = _spans(i0, i1)
    codes, own = np.unique(row_of[part] * width + i - least, return_inverse=True)
    own = own.ravel()
    mine = edge[part[np.argsort(own, kind="stable")]]
    edge_ends = np.cumsum(np.bincount(own, minlength=len(codes)))
    # Parts that begin right of a cell, by their ends above the row.
    bit = ((row_a[edge] > j).astype(np.int64) + (row_b[edge] > j)) % 2
    place = row_of * width + i0 - least
    order = np.argsort(place, kind="stable")
    place, upto = place[order], np.append(0, np.cumsum(bit[order]))
    odd = (upto[np.searchsorted(place, (codes // width + 1) * width)] - upto[np.searchsorted(place, codes, "right")]) % 2
    # An end is left over for the cells between the beginnings of its two edges' parts, all of them cells of the one that begins first.
    v = np.arange(len(a))
    begin = np.stack([i0[first_part[e] + row_a - low[e]] for e in (v, before)])
    c0, c1 = begin.min(0), begin.max(0) - 1
    of_row = row_of[first_part + row_a - low]
    end, at_i = _spans(c0, c1)
    cell = np.searchsorted(codes, of_row[end] * width + at_i - least)
    flips = a[end[np.argsort(cell, kind="stable")], 1]
    flip_ends = np.cumsum(np.bincount(cell, minlength=len(codes)))
    # Cells between border cells of a row are inner ones where an odd number of parts begins right of them.
    gap = np.flatnonzero((np.diff(codes) > 1) & (np.diff(codes // width) == 0) & (odd[:-1] == 1))
    fill, fill_i = _spans(codes[gap] + 1, codes[gap + 1] - 1)
    codes, odd = np.append(codes, fill_i), np.append(odd, np.ones(len(fill), np.int64))
    lists = []
    for values, ends in ((pa.array(flips), flip_ends), (pa.StructArray.from_arrays([pa.array(x) for x in (a[mine, 0], a[mine, 1], b[mine, 0], b[mine, 1])], ["ax", "ay", "bx", "by"]), edge_ends)):
        lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends, np.full(len(fill), len(values))]).astype(np.int32)), values))
    return rows[codes // width, 0], [pa.array(codes % width + least), pa.array(rows[codes // width, 1]), pa.array(odd.astype(np.int32)), *lists]


def index(polygons: DataFrame, rings: str, size: float) -> DataFrame:
    """polygons' other columns once for each cell that a polygon covers, with i, j, odd, flips and edges: inner cells have no edges, border cells those that cross them and no more.

    rings: the outer ring and its holes, in any direction, closed or not; holes lie within. Null or empty rings cover nothing.
    """
    others = [c for c in polygons.columns if c != rings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                rows, cells = cells_of(some.column(0).fill_null([]), size)
                taken = some.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in others), *cells], names=[*others, "i", "j", "odd", "flips", "edges"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in polygons.schema if f.name != rings)
    # A polygon may cover any number of cells: they are dealt anew before they meet anything.
    return polygons.select(F.col(rings).cast(RINGS).alias(rings), *others).mapInArrow(run, f"{fields}, {CELLS}" if others else CELLS)


def arrays(cells: pa.Table) -> tuple:
    """odd, flips and edges of rows of `index`, as `blocks.counted` takes them."""
    f, e = (cells[k].combine_chunks() for k in ("flips", "edges"))
    ends = lambda x: np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))
    edges = np.stack([e.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4)], 1).reshape(-1, 4)
    return cells["odd"].to_numpy(), (f.flatten().to_numpy(zero_copy_only=False), ends(f)), (edges, ends(e))


def holds(x: Column, y: Column) -> Column:
    """Whether the polygon of a row of `index` holds a point of that row's cell."""

    def right(e: Column) -> Column:
        at = e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    count = F.col("odd") + F.size(F.filter("flips", lambda v: v > y)) + F.size(F.filter("edges", right))
    return F.when(F.size("edges") == 0, F.lit(True)).otherwise(count % 2 == 1)


def inside(points: DataFrame, polygons: DataFrame, xy: tuple[str, str], rings: str, size: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Points with every polygon that holds them: the columns of both, rings aside. on: columns that must be equal. Names of the two sides must differ, but for those."""
    cells = index(polygons, rings, size).withColumnsRenamed({"i": "_i", "j": "_j"})
    c = geo.cell(*xy, size)
    met = points.withColumn("_i", c["i"]).withColumn("_j", c["j"]).join(cells, [*on, "_i", "_j"])
    return met.where(holds(F.col(xy[0]), F.col(xy[1]))).drop("_i", "_j", "odd", "flips", "edges")


def mask(polygons: DataFrame, key: str, rings: str, size: float, reach: int = 0) -> DataFrame:
    """key, i, j of the cells whose centre a polygon holds, and of those within `reach` cells of one, round about."""
    cells = index(polygons.select(key, rings), rings, size)
    centre = lambda c: (F.col(c) + 0.5) * size
    filled = cells.where(holds(centre("i"), centre("j"))).select(key, "i", "j")
    if not reach:
        return filled
    near = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= reach * reach]
    around = F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in near))).alias("c")
    return filled.select(key, around).select(key, "c.i", "c.j").distinct()


def oriented(rings: Column, places: int) -> Column:
    """Rings with rounded vertices, the outer one counter-clockwise and holes clockwise, so that the inside is on the left of every edge."""
    snap = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((F.bround(p["x"], places) + 0.0).alias("x"), (F.bround(p["y"], places) + 0.0).alias("y"))))
    return F.transform(snap, lambda r, k: F.when((geo.shoelace(r) > 0) == (k == 0), r).otherwise(F.reverse(r)))


def _ring_edges(polygons: DataFrame, keep: list[str]) -> DataFrame:
    """keep, ax, ay, bx, by."""
    r = F.col("_ring")
    pairs = F.transform(r, lambda p, k: F.struct(p.alias("p"), F.get(r, F.pmod(k + 1, F.size(r))).alias("q")))
    ring = polygons.select(*keep, F.explode("rings").alias("_ring"))
    edge = ring.select(*keep, F.explode(pairs).alias("_e"))
    return edge.select(*keep, F.col("_e.p.x").alias("ax"), F.col("_e.p.y").alias("ay"), F.col("_e.q.x").alias("bx"), F.col("_e.q.y").alias("by")).where("ax != bx or ay != by")


def _split_points(met: DataFrame, keep: list[str], tol: float, places: int) -> DataFrame:
    """keep, p: where an edge a-b is to be cut for another, p-q: that one's ends on it, or the proper crossing, as structs of t, x, y.

    Told in steps, each a select over the columns of the one before: as one expression every step would hold copies of those before it.
    """
    ends = ("ax", "ay", "bx", "by", "px", "py", "qx", "qy")
    ax, ay, bx, by, px, py, qx, qy = map(F.col, ends)
    near = lambda x, y, u, v: F.hypot(x - u, y - v) <= tol

    def step(df: DataFrame, **more: Column) -> DataFrame:
        return df.select("*", *(c.alias(k) for k, c in more.items()))

    def touching(x: Column, y: Column, t: Column, off: Column) -> Column:
        return F.when((off <= tol) & (t > 0) & (t < 1) & ~near(x, y, ax, ay) & ~near(x, y, bx, by), F.struct(t.alias("t"), x.alias("x"), y.alias("y")))

    one = step(met.select(*dict.fromkeys((*keep, *ends))), _u=bx - ax, _v=by - ay, _first=F.struct(ax, ay, bx, by) < F.struct(px, py, qx, qy))
    u, v, first = F.col("_u"), F.col("_v"), F.col("_first")
    # Both edges of a pair compute the crossing alike: in order of their ends.
    c = {f"_c{k}": F.when(first, F.col(m)).otherwise(F.col(n)) for k, (m, n) in enumerate(zip(ends, (*ends[4:], *ends[:4]), strict=True))}
    two = step(one, _l2=u * u + v * v, **c)
    c = [F.col(k) for k in c]
    three = step(two, _rx=c[2] - c[0], _ry=c[3] - c[1], _sx=c[6] - c[4], _sy=c[7] - c[5], _tp=((px - ax) * u + (py - ay) * v) / F.col("_l2"), _tq=((qx - ax) * u + (qy - ay) * v) / F.col("_l2"), _len=F.sqrt("_l2"))
    rx, ry, sx, sy = map(F.col, ("_rx", "_ry", "_sx", "_sy"))
    off = lambda x, y: F.abs((x - ax) * v - (y - ay) * u) / F.col("_len")
    four = step(three, _den=F.nullif(rx * sy - ry * sx, F.lit(0.0)), _op=off(px, py), _oq=off(qx, qy))
    five = step(four, _t1=((c[4] - c[0]) * sy - (c[5] - c[1]) * sx) / F.col("_den"), _t2=((c[4] - c[0]) * ry - (c[5] - c[1]) * rx) / F.col("_den"))
    t1, t2 = F.col("_t1"), F.col("_t2")
    six = step(five, _within=(t1 > 0) & (t1 < 1) & (t2 > 0) & (t2 < 1))
    # Few pairs cross, and rounding is dear.
    at = lambda a, r: F.when(F.col("_within"), F.bround(a + r * t1, places) + 0.0)
    seven = step(six, _x=at(c[0], rx), _y=at(c[1], ry))
    x, y = F.col("_x"), F.col("_y")
    clear = ~(near(x, y, ax, ay) | near(x, y, bx, by) | near(x, y, px, py) | near(x, y, qx, qy))
    cross = F.when(F.col("_within") & clear, F.struct(F.when(first, t1).otherwise(t2).alias("t"), x.alias("x"), y.alias("y")))
    told = seven.select(*keep, touching(px, py, F.col("_tp"), F.col("_op")).alias("_p"), touching(qx, qy, F.col("_tq"), F.col("_oq")).alias("_q"), cross.alias("_c"))
    return told.select(*keep, F.explode(F.array("_p", "_q", "_c")).alias("p")).where("p is not null")


def _pieces(edges: DataFrame, size: float, places: int) -> DataFrame:
    """kind, owner, grp, ax, ay, bx, by: all edges (numbered by e) cut where edges of other polygons of their group meet them; edges of kind 0 don't cut each other."""
    from limnos.operators import spatial

    box = ("_x0", "_y0", "_x1", "_y1")
    ends = [F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")]
    pad = 2.0 * 10.0**-places
    boxed = edges.select("*", *((e - pad if k < 2 else e + pad).alias(c) for k, (c, e) in enumerate(zip(box, ends, strict=True))))
    # A group may be a struct: rows are sorted by a whole number before it.
    dealt = boxed.withColumn("_c", F.explode(spatial.box_cells(box, size))).withColumn("_h", F.xxhash64("grp", "_c"))
    other = dealt.select("_h", "grp", "_c", F.col("kind").alias("k2"), F.col("owner").alias("o2"), F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("bx").alias("qx"), F.col("by").alias("qy"), *(F.col(c).alias(f"o{c}") for c in box))
    met = dealt.join(other, ["_h", "grp", "_c"]).where(((F.col("kind") != F.col("k2")) | ((F.col("kind") == 1) & (F.col("owner") != F.col("o2")))) & geo.boxes_overlap(box, tuple(f"o{c}" for c in box)))
    points = _split_points(met, ["e"], 1.5 * 10.0**-places, places).groupBy("e").agg(F.array_sort(F.collect_set("p")).alias("cuts"))
    whole = edges.join(points, "e", "left")
    spot = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    stops = F.concat(F.array(spot("ax", "ay")), F.transform(F.coalesce("cuts", F.array().cast("array<struct<t: double, x: double, y: double>>")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array(spot("bx", "by")))
    parts = whole.withColumn("_s", stops).select("kind", "owner", "grp", F.explode(F.transform(F.slice("_s", 1, F.size("_s") - 1), lambda p, k: F.struct(p.alias("p"), F.get("_s", k + 1).alias("q")))).alias("s"))
    out = parts.select("kind", "owner", "grp", F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by"))
    return out.where("ax != bx or ay != by")


def _kept(pieces: DataFrame, a: DataFrame, b: DataFrame, size: float, common: bool) -> DataFrame:
    """owner (of kind 0), ax, ay, bx, by: pieces that bound what is left of a without b, or what both hold (common), the inside on their left."""
    forward = F.struct("ax", "ay") < F.struct("bx", "by")
    end = lambda first: F.when(forward if first else ~forward, F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))).otherwise(F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    rows = pieces.select("*", F.xxhash64("grp").alias("_g"), end(True).alias("lo"), end(False).alias("hi"), forward.alias("way"), ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"), F.monotonically_increasing_id().alias("piece"))
    rows = cut(rows.withColumn("_h", F.xxhash64("grp", "lo", "hi")))
    # Pieces on top of each other, by the polygons they are of.
    same = rows.select("_h", "grp", "lo", "hi", F.col("kind").alias("k2"), F.col("owner").alias("o2"), F.col("way").alias("w2"))
    on_top = rows.select("piece", "kind", "owner", "_h", "grp", "lo", "hi", "way").join(same, ["_h", "grp", "lo", "hi"]).where("kind != k2 or owner != o2")
    on_top = cut(on_top.select("piece", "k2", "o2", (F.col("way") == F.col("w2")).alias("along")))
    tops = on_top.select("piece", "k2", "o2").distinct()

    def within(points: DataFrame, polygons: DataFrame, kind: int) -> DataFrame:
        of = polygons.select(F.col("owner").alias("o2"), F.col("grp").cast(rows.schema["grp"].dataType).alias("grp"), "rings").withColumn("_g", F.xxhash64("grp"))
        hit = inside(points.select("piece", "_g", "grp", "mx", "my", "kind", F.col("owner").alias("own")), of, ("mx", "my"), "rings", size, ("_g", "grp"))
        hit = hit.where((F.col("kind") != kind) | (F.col("own") != F.col("o2"))).select("piece", "o2", F.lit(kind).alias("k2"))
        return hit.join(tops, ["piece", "k2", "o2"], "left_anti")

    # Kind 0 by the cutters about it and those along it.
    about = within(rows, b, 1).select("piece").distinct().withColumn("about", F.lit(True))
    seams = on_top.where("k2 = 1").groupBy("piece").agg(F.max("along").alias("along"), F.max(~F.col("along")).alias("against"), F.min(F.when(F.col("along"), F.col("o2"))).alias("least"))
    told = rows.join(about, "piece", "left").join(seams, "piece", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("about", "along", "against")})
    of_a = told.where("kind = 0").where(F.col("about") | F.col("along") if common else ~F.col("about") & ~F.col("along")).select("owner", "ax", "ay", "bx", "by")
    of_b = told.where("kind = 1 and not about and not against and (least is null or least > owner)")
    # A cutter's piece is a boundary in every polygon that holds it; on the polygon's own boundary that one's pieces decide.
    of_b = of_b.select("piece", "ax", "ay", "bx", "by").join(within(rows.where("kind = 1"), a, 0).select("piece", F.col("o2").alias("owner")), "piece")
    turned = of_b.select("owner", "ax", "ay", "bx", "by") if common else of_b.select("owner", F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    return of_a.unionByName(turned)


def _doubled(to: np.ndarray, value: np.ndarray, join, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """After so many rounds of doubling: where 2**rounds steps lead, and what values on the way are joined to. The last place leads to itself."""
    for _ in range(rounds):
        value, to = join(value, value[to]), to[to]
    return to, value


def tied(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings of directed pieces a-b of owners (numbers, in order) by the rule of `rings_of`: the pieces that are of rings, ring by ring from its first piece on, and how many each ring has."""
    n = len(owner)
    spots = np.concatenate([np.column_stack([owner, p]) for p in (a, b)])
    order = np.lexsort(spots.T[::-1])
    new = np.append(False, (spots[order[1:]] != spots[order[:-1]]).any(1))
    code = np.empty(2 * n, np.int64)
    code[order] = np.cumsum(new)
    begins, ends = code[:n], code[n:]
    by_begin = np.argsort(begins, kind="stable")
    first, last = (np.searchsorted(begins[by_begin], ends, side) for side in ("left", "right"))
    piece, at = _spans(first, last - 1)
    to = by_begin[at]
    (bx, by), (ox, oy) = (a - b)[piece].T, (b - a)[to].T
    turn = np.mod(np.arctan2(by, bx) - np.arctan2(oy, ox), 2 * np.pi)
    best = np.lexsort((to, np.where(turn < 1e-12, 7.0, turn), piece))
    best = best[np.append(True, np.diff(piece[best]) > 0)] if len(best) else best
    nxt = np.full(n + 1, n)
    nxt[piece[best]] = to[best]
    rounds = int(np.bincount(owner.astype(np.int64), minlength=1).max()).bit_length() if n else 0
    # What so many steps lead to is of rings, and so is all of a ring.
    far, least = _doubled(nxt, np.arange(n + 1), np.minimum, rounds)
    closed = np.zeros(n + 1, bool)
    closed[far] = True
    closed[n] = False
    _, steps = _doubled(open_ := np.where(nxt == least, n, nxt), (open_ != n).astype(np.int64), np.add, rounds)
    mine = np.flatnonzero(closed)
    mine = mine[np.lexsort((-steps[mine], least[mine]))]
    return mine, np.unique(least[mine], return_counts=True)[1]


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, e (its pieces) to key, ring, points."""
    for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
        keys, lists = batch.columns
        sizes = np.diff(lists.offsets.to_numpy())
        ax, ay, bx, by = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mine, counts = tied(owner, np.stack([ax, ay], 1), np.stack([bx, by], 1))
        ends = np.append(0, np.cumsum(counts))
        points = pa.StructArray.from_arrays([pa.array(ax[mine]), pa.array(ay[mine])], ["x", "y"])
        of = owner[mine[ends[:-1]]]
        ring = mine[ends[:-1]] - (np.cumsum(sizes) - sizes)[of]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(ring), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), points)], names=["key", "ring", "points"])


def rings_of(pieces: DataFrame, key: str = "owner", most: int | None = None) -> DataFrame:
    """key, ring (a number), points: directed pieces tied into rings at equal ends. Where several go on from a point, the first one clockwise from the way back does, so rings touch and don't cross.

    Rings of a key of at most `most` pieces (TIED) are tied in a task, a batch of keys at once; those of others are ranked in rounds, and no such key's pieces meet before its rings are put together. pieces: a table that was cut.
    """
    most = TIED if most is None else most
    large, (many,) = cut_and_tell(pieces.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key), F.count("*"))
    small = pieces.where(F.col(key).isNotNull())
    if many:
        small = small.join(large, key, "left_anti")
    # Pieces in an order of their own: rings and their numbers are the same in every run.
    lists = small.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct("ax", "ay", "bx", "by"))).alias("e"))
    kind = pieces.schema[key].dataType.simpleString()
    out = lists.mapInArrow(_tie, f"key {kind}, ring long, points array<struct<x: double, y: double>>").withColumnRenamed("key", key)
    return out.unionByName(_ranked_rings(pieces.join(large, key, "left_semi"), key)) if many else out


def _ranked_rings(pieces: DataFrame, key: str) -> DataFrame:
    """As rings_of, in rounds."""
    from limnos.operators import graph

    p = cut(pieces.select(key, "ax", "ay", "bx", "by", F.monotonically_increasing_id().alias("id")))
    nxt = p.select(key, F.col("id").alias("next"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("out"))
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    turn = F.pmod(back - F.col("out"), F.lit(2 * np.pi))
    # The way back itself comes last.
    links = p.join(nxt, [key, "bx", "by"]).withColumn("turn", F.when(turn < 1e-12, 7.0).otherwise(turn)).groupBy("id").agg(F.min_by("next", F.struct("turn", "next")).alias("next"))
    ranked = graph.ranked(links, "id", "next")
    out = p.join(ranked.where("closed"), "id").groupBy(key, F.col("list").alias("ring")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("ax").alias("x"), F.col("ay").alias("y")))).alias("r"))
    return out.select(key, "ring", F.transform("r", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("points"))


def with_holes(rings: DataFrame, size: float, key: str = "owner", least: float = 1e-15) -> DataFrame:
    """key, part (from 0, by the first ring's number), rings: counter-clockwise rings with the clockwise ones within them; of several about a hole the smallest. Rings of at most `least` square units are left out."""
    sized, (many,) = cut_and_tell(rings.withColumn("area", geo.shoelace("points")).where(F.abs("area") > least), F.count_if(F.col("area") < 0))
    outer = sized.where("area > 0").select(key, F.col("ring").alias("outer"), F.col("area").alias("size"), F.array("points").alias("rings"))
    part = (F.row_number().over(Window.partitionBy(key).orderBy("outer")) - 1).alias("part")
    if not many:
        return outer.select(key, part, "rings")
    spot = geo.inside_point("points")
    holes = sized.where("area < 0").select(key, "ring", "points", spot["x"].alias("hx"), spot["y"].alias("hy"))
    holed = outer.join(holes.select(key).distinct(), key, "left_semi")
    hit = inside(holes.select(key, "ring", "hx", "hy"), holed, ("hx", "hy"), "rings", size, (key,))
    of = hit.groupBy(key, "ring").agg(F.min_by("outer", F.struct("size", "outer")).alias("outer"))
    grouped = holes.join(of, [key, "ring"]).groupBy(key, "outer").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda h: h["points"]).alias("holes"))
    whole = outer.join(grouped, [key, "outer"], "left").select(key, "outer", F.concat("rings", F.coalesce("holes", F.array().cast(RINGS))).alias("rings"))
    return whole.select(key, part, "rings")


def overlay(polygons: DataFrame, cutters: DataFrame, key: str, cutter: str, size: float, on: str | None = None, common: bool = False, places: int = 9) -> DataFrame:
    """key, part, rings: what is left of each polygon without all cutters of its group, or what it has in common with them.

    Edges are cut where edges of the other side, or of other cutters, cross or touch them; a piece is kept by the side it lies on, told by its middle, or by its direction where edges lie on top
    of each other; pieces are tied into rings by ranking. Vertices are rounded to `places`. polygons: key, rings (outer, then holes) and `on`, if given; cutters: cutter, rings and `on`.
    A polygon that no cutter's box meets stays as it is, one that nothing is left of has no row. Cutters may overlap, touch or repeat each other; rings don't cross themselves.
    """
    from limnos.operators import spatial

    group = F.col(on) if on else F.lit(0)
    shape = lambda df, name: df.where("rings is not null and size(rings) > 0").select(F.col(name).alias("owner"), group.alias("grp"), oriented(F.col("rings"), places).alias("rings"))
    a, b = cut(shape(polygons, key)), cut(shape(cutters, cutter))
    bounds = lambda df, p: df.select("owner", "grp", geo.bounds(F.get("rings", F.lit(0))).alias("_b")).select("owner", "grp", *(F.col(f"_b.{c}").alias(f"{p}{d}") for c, d in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))))
    ba, bb = bounds(a, "_a"), bounds(b, "_o").select("grp", "_ox0", "_oy0", "_ox1", "_oy1")
    dealt = ba.withColumn("_c", F.explode(spatial.box_cells(("_ax0", "_ay0", "_ax1", "_ay1"), size)))
    met = dealt.join(bb.withColumn("_c", F.explode(spatial.box_cells(("_ox0", "_oy0", "_ox1", "_oy1"), size))), ["grp", "_c"])
    met = cut(met.where(geo.boxes_overlap(("_ax0", "_ay0", "_ax1", "_ay1"), ("_ox0", "_oy0", "_ox1", "_oy1"))).select("owner").distinct())
    touched = cut(a.join(met, "owner"))
    edges = _ring_edges(touched.withColumn("kind", F.lit(0)), ["kind", "owner", "grp"]).unionByName(_ring_edges(b.withColumn("kind", F.lit(1)), ["kind", "owner", "grp"]))
    edges = cut(edges.withColumn("e", F.monotonically_increasing_id()))
    kept = cut(_kept(_pieces(edges, size, places), touched, b, size, common))
    out = with_holes(rings_of(kept), size)
    if not common:
        out = out.unionByName(a.join(met, "owner", "left_anti").select("owner", F.lit(0).alias("part"), "rings"))
    out = cut(out)
    discard(a, b, met, touched, edges, kept)
    return out.withColumnRenamed("owner", key)


def dissolve(tiles: DataFrame, key: str, box: tuple[str, str, str, str], size: float, places: int = 9) -> DataFrame:
    """key, part, rings: polygons that were cut at the borders of tiles, put together again. tiles: key (of the whole), rings (what lies in a tile), box (the tile's).

    Edges that run along a border of their tile are seams and go; what is left is tied into rings at equal rounded ends, across any number of tiles. A piece whose ring stays
    open, as what lies beyond the border isn't there, keeps its seams, and so do those it is tied to: they are parts as they came. Null and empty rings are left out.
    """
    from limnos.operators import graph

    x0, y0, x1, y1 = (F.bround(c, places) for c in box)
    shaped = cut(tiles.where("rings is not null and size(rings) > 0").select(F.col(key).alias("owner"), F.monotonically_increasing_id().alias("tile"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), oriented(F.col("rings"), places).alias("rings")))
    tol = 1.5 * 10.0**-places
    along = lambda a, b, lines: F.greatest(*(F.abs(F.col(a) - F.col(v)) <= tol for v in lines)) & (F.abs(F.col(a) - F.col(b)) <= tol)
    edges = cut(_ring_edges(shaped, ["owner", "tile", "x0", "y0", "x1", "y1"]).withColumn("seam", along("ax", "bx", ("x0", "x1")) | along("ay", "by", ("y0", "y1"))))
    inner = edges.where("not seam")
    # Pieces with an end where none begins, or a beginning where none ends, are open, and so is what they are tied to.
    ends = inner.select("owner", "tile", F.inline(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(1).alias("d")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(-1).alias("d")))))
    loose = cut(ends.groupBy("owner", "x", "y").agg(F.sum("d").alias("d")).where("d != 0").select("owner", "x", "y"))
    bare, (some,) = cut_and_tell(ends.join(loose, ["owner", "x", "y"]).select("owner", "tile").distinct(), F.count("*"))
    kept = inner.select("owner", "ax", "ay", "bx", "by")
    if some:
        # Only wholes that have an open piece are looked through for what it is tied to.
        open_ends = ends.join(bare.select("owner").distinct(), "owner", "left_semi")
        go_on = open_ends.where("d = -1").select("owner", "x", "y", F.col("tile").alias("from")).join(open_ends.where("d = 1").select("owner", "x", "y", F.col("tile").alias("to")), ["owner", "x", "y"])
        of = cut(graph.components(go_on.where("from != to"), "from", "to"))
        spoilt = of.join(bare, of["node"] == bare["tile"]).select("component").distinct()
        open_tiles = cut(bare.select("tile").unionByName(of.join(spoilt, "component").select(F.col("node").alias("tile"))).distinct())
        kept = inner.join(open_tiles, "tile", "left_anti").unionByName(edges.join(open_tiles, "tile", "left_semi")).select("owner", "ax", "ay", "bx", "by")
        kept = cut(kept)
        discard(of, open_tiles)
    out = cut(with_holes(rings_of(kept), size))
    discard(shaped, edges, loose, bare, kept)
    return out.withColumnRenamed("owner", key)


def area(rings: Column) -> Column:
    """Square units within the outer ring, less its holes."""
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s - F.abs(geo.shoelace(r))) + 2 * F.abs(geo.shoelace(F.get(rings, F.lit(0))))
