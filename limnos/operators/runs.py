"""Runs: segments, corners, chords, what stands beside them; rings, shapes and coordinates; profiles of depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import geo, numbers
from limnos.operators import spatial


def segments(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, k, ax, ay, bx, by, s (metres along before it), m (its length)."""
    at = lines.select(key, F.posexplode(line).alias("k", "p"))
    w = Window.partitionBy(key).orderBy("k")
    nxt = F.lead("p").over(w)
    seg = at.select(key, "k", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), nxt["x"].alias("bx"), nxt["y"].alias("by")).where("bx is not null")
    seg = seg.withColumn("m", geo.equirect_m("ax", "ay", "bx", "by"))
    return seg.withColumn("s", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def split_at_corners(vertices: DataFrame, run: str, order: str, max_turn: float, least_m: float) -> DataFrame:
    """vertices with `leg`: a new leg begins at a vertex where the run turns by more than max_turn degrees (the vertex ends one leg and begins the next: it belongs to the later).
    Legs shorter than least_m are left out."""
    w = Window.partitionBy(run).orderBy(order)
    into = geo.planar_bearing(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    out = geo.planar_bearing("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w))
    v = vertices.withColumn("_i", into).withColumn("_o", out).withColumn("_c", (F.coalesce(geo.angle_between("_i", "_o"), F.lit(0.0)) > max_turn).cast("long"))
    v = v.withColumn("leg", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = Window.partitionBy(run, "leg")
    step = F.coalesce(geo.equirect_m(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"), F.lit(0.0))
    # A leg's length runs to the corner that ends it.
    v = v.withColumn("_m", step).withColumn("_ahead", F.coalesce(F.lead("_m").over(w), F.lit(0.0)))
    return v.withColumn("leg_m", F.sum("_ahead").over(by)).where(F.col("leg_m") >= least_m).drop("_i", "_o", "_c", "_m", "_ahead")


def chord_clear(samples: Column, floor, tolerance: float = 0.0) -> Column:
    """Whether every sounding along a chord is known and deep enough."""
    return F.forall(samples, lambda d: F.coalesce(d >= geo._col(floor) - tolerance, F.lit(False)))


def longest_clear(depths: Column, floor) -> Column:
    """How many of an array's samples from its start on are deep enough: as far as a chord may reach."""
    bad = F.filter(F.transform(depths, lambda d, i: F.when(F.coalesce(d >= geo._col(floor), F.lit(False)), F.lit(None).cast("int")).otherwise(i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(bad, 0), F.size(depths))


def beside(features: DataFrame, segs: DataFrame, key: str, run: str, metres: float) -> DataFrame:
    """run, key, s (metres along the run), distance_m: every feature within reach of a run, at the nearest place of it. features: lon, lat; segs: as `segments` gives them, each no longer than twice the reach."""
    mid = segs.select(run, "k", "ax", "ay", "bx", "by", "s", "m", ((F.col("ax") + F.col("bx")) / 2).alias("_mx"), ((F.col("ay") + F.col("by")) / 2).alias("_my"))
    near = spatial.radius_join(features.select(key, "lon", "lat"), mid, ("lon", "lat"), ("_mx", "_my"), 2 * metres)
    d = geo.point_segment_m("lon", "lat", "ax", "ay", "bx", "by")
    scale = F.cos(F.radians("lat"))
    t = geo.segment_position(F.col("lon") * scale, F.col("lat"), F.col("ax") * scale, F.col("ay"), F.col("bx") * scale, F.col("by"))
    best = near.withColumn("_d", d).where(F.col("_d") <= metres).groupBy(run, key).agg(F.min(F.struct("_d", "k", (F.col("s") + t * F.col("m")).alias("s"))).alias("_b"))
    return best.select(run, key, F.col("_b.s").alias("s"), F.col("_b._d").alias("distance_m"))


def flat(line: Column) -> Column:
    """Positions without their third number."""
    return F.transform(line, lambda p: F.slice(p, 1, 2))


def rounded(line: Column, places: int = 5) -> Column:
    """Coordinates rounded half to even."""
    return F.transform(line, lambda p: F.transform(p, lambda v: F.bround(v, places)))


def shape_class(area_m2, perimeter_m, sliver_m: float = 30.0) -> Column:
    """struct<width,kind>: mean width as twice the area over the perimeter; a part narrower than sliver_m is a sliver, else a lobe."""
    width = 2 * geo._col(area_m2) / F.nullif(geo._col(perimeter_m), F.lit(0.0))
    return F.struct(width.alias("width"), F.when(width < sliver_m, "sliver").otherwise("lobe").alias("kind"))


def nested(rings: DataFrame, key: str, group: str, cell: float) -> DataFrame:
    """key, depth, outer, parent: a ring that an even number of its group's rings hold is an outer one, and a hole's parent is the smallest ring about it.
    rings: lon, lat of a point within, ring, x0 to y1."""
    outer = rings.select(F.col(key).alias("_o"), F.col(group).alias("_g"), F.array("ring").alias("_rings"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = spatial.polygon_join(rings.select(key, group, "lon", "lat"), outer, ("lon", "lat"), "_rings", ("_x0", "_y0", "_x1", "_y1"), cell).where((F.col(group) == F.col("_g")) & (F.col(key) != F.col("_o")))
    area = (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    by = hit.groupBy(key).agg(F.count("*").alias("depth"), F.min(F.struct(area.alias("a"), F.col("_o").alias("o"))).alias("_p"))
    out = rings.select(key).join(by, key, "left").select(key, F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.col("_p.o").alias("_q"))
    return out.select(key, "depth", (F.col("depth") % 2 == 0).alias("outer"), F.when(F.col("depth") % 2 == 1, F.col("_q")).alias("parent"))


def profile(samples: DataFrame, keys: list[str], depth: str, value: str, floor: float, step: float = 2.0) -> DataFrame:
    """keys, bins, first_below (the shallowest bin whose upper median is under the floor), steepest (the upper bin of the greatest fall between adjacent bins), fall."""
    bin_ = (F.floor(F.col(depth) / step) * step).alias("_bin")
    bins = samples.where(F.col(value).isNotNull()).groupBy(*keys, bin_).agg(numbers.upper_median(F.collect_list(value)).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    fall = F.when(F.lead("_bin").over(w) == F.col("_bin") + step, F.col("_v") - F.lead("_v").over(w))
    b = bins.withColumn("_f", fall)
    best = F.max(F.when(F.col("_f").isNotNull(), F.struct("_f", (-F.col("_bin")).alias("n"))))
    return b.groupBy(*keys).agg(F.count("*").alias("bins"), F.min(F.when(F.col("_v") < floor, F.col("_bin"))).alias("first_below"), best.alias("_b")).select(*keys, "bins", "first_below", (-F.col("_b.n")).alias("steepest"), F.col("_b._f").alias("fall"))


def mesh(lines: DataFrame, key: str, line: str, places: int = 5) -> DataFrame:
    """src, dst, weight: the segments of lines as edges between their rounded ends, each pair of ends once, at its least length; ends are named lon,lat."""
    seg = segments(lines, key, line)
    name = lambda x, y: F.concat_ws(",", numbers.round_scaled(x, places).cast("string"), numbers.round_scaled(y, places).cast("string"))
    a, b = name("ax", "ay"), name("bx", "by")
    return seg.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "m").where("src != dst").groupBy("src", "dst").agg(F.min("m").alias("weight"))


def clip_lines(segs: DataFrame, polygons: DataFrame, key: str, cell: float) -> DataFrame:
    """key, k, piece, ax, ay, bx, by: what of lines' segments lies outside all polygons. Segments are cut where they cross an edge, and a piece goes if a polygon holds its middle.
    Segments and edges meet by the cells of their boxes. polygons: rings (outer, then holes), x0 to y1."""
    ring = polygons.select(F.explode("rings").alias("r")).select(F.transform("r", lambda p, i: F.struct(p.alias("p"), F.get(F.col("r"), F.pmod(i + 1, F.size("r"))).alias("q"))).alias("e"))
    edge = ring.select(F.explode("e").alias("e")).select(F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), F.col("e.q.x").alias("qx"), F.col("e.q.y").alias("qy"))
    edge = edge.select("*", F.least("px", "qx").alias("_ex0"), F.least("py", "qy").alias("_ey0"), F.greatest("px", "qx").alias("_ex1"), F.greatest("py", "qy").alias("_ey1"))
    boxed = segs.select(key, "k", "ax", "ay", "bx", "by", F.least("ax", "bx").alias("_sx0"), F.least("ay", "by").alias("_sy0"), F.greatest("ax", "bx").alias("_sx1"), F.greatest("ay", "by").alias("_sy1"))
    met = spatial.box_pairs(boxed, edge, ("_sx0", "_sy0", "_sx1", "_sy1"), ("_ex0", "_ey0", "_ex1", "_ey1"), cell)
    rx, ry, sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    dx, dy, den = F.col("px") - F.col("ax"), F.col("py") - F.col("ay"), F.nullif(rx * sy - ry * sx, F.lit(0.0))
    t, u = (dx * sy - dy * sx) / den, (dx * ry - dy * rx) / den
    cuts = met.withColumn("_t", t).withColumn("_u", u).where("_t > 0 and _t < 1 and _u >= 0 and _u <= 1").groupBy(key, "k").agg(F.array_sort(F.collect_set("_t")).alias("_t"))
    whole = boxed.join(cuts, [key, "k"], "left").withColumn("_t", F.concat(F.array(F.lit(0.0)), F.coalesce("_t", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    part = F.transform(F.slice("_t", 2, F.size("_t") - 1), lambda x, i: F.struct(F.get(F.col("_t"), i).alias("a"), x.alias("b")))
    pieces = whole.select(key, "k", "ax", "ay", "bx", "by", F.posexplode(part).alias("piece", "_p"))
    at = lambda a, b, s: F.col(a) + (F.col(b) - F.col(a)) * F.col(s)
    pieces = pieces.select(key, "k", "piece", at("ax", "bx", "_p.a").alias("ax"), at("ay", "by", "_p.a").alias("ay"), at("ax", "bx", "_p.b").alias("bx"), at("ay", "by", "_p.b").alias("by"))
    middle = pieces.select(key, "k", "piece", ((F.col("ax") + F.col("bx")) / 2).alias("lon"), ((F.col("ay") + F.col("by")) / 2).alias("lat"))
    inside = spatial.polygon_join(middle, polygons.select("rings", "x0", "y0", "x1", "y1"), ("lon", "lat"), "rings", ("x0", "y0", "x1", "y1"), cell).select(key, "k", "piece").distinct()
    return pieces.join(inside, [key, "k", "piece"], "left_anti")
