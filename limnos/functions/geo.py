"""Coordinate arithmetic as Column expressions. Angles are degrees; lines and rings are array<struct<x,y>> (lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii and metres or feet of a degree, which differ by the place of use.
EARTH_FT, EARTH_KM, EARTH_M = 20_902_231.0, 6371.0, 6_371_000.0
FT_PER_DEG = 364_000.0
M_LON, M_LAT_POINT, M_LAT_SEGMENT = 111_320.0, 110_570.0, 110_540.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int | float) else F.col(x)


def _sin2(x: Column) -> Column:
    return F.pow(F.sin(x / 2), F.lit(2.0))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_FT) -> Column:
    """Great-circle distance in the radius's unit."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    h = _sin2(F.radians(lat2 - lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * _sin2(F.radians(lon2 - lon1))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_or_inf(lat1, lon1, lat2, lon2, radius: float = EARTH_FT) -> Column:
    """As haversine; infinity where an input is null, NaN or infinite."""
    inputs = [_col(c) for c in (lat1, lon1, lat2, lon2)]
    bad = F.lit(False)
    for c in inputs:
        bad = bad | c.isNull() | F.isnan(c.cast("double")) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(float("inf"))).otherwise(haversine(*inputs, radius))


def miles(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2) / 5280.0


def equirect_m(lon1, lat1, lon2, lat2, cos_at: str = "middle", m_lat: float = M_LAT_POINT) -> Column:
    """Flat distance in metres; the cosine is taken at the middle latitude, or at the first point's."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    at = (lat1 + lat2) / 2 if cos_at == "middle" else lat1
    return F.hypot((lon2 - lon1) * F.cos(F.radians(at)) * M_LON, (lat2 - lat1) * m_lat)


def planar_bearing(lat1, lon1, lat2, lon2) -> Column:
    """-180 to 180, on a plane scaled at the first latitude."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    return F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1))


def true_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    a, b = F.radians(_col(lat1)), F.radians(_col(lat2))
    d = F.radians(_col(lon2) - _col(lon1))
    turned = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(turned + 360.0, F.lit(360.0))


def angle_between(a, b) -> Column:
    """Unsigned angle of two bearings, 0 to 180."""
    return F.abs(F.pmod(_col(a) - _col(b) + 180.0, F.lit(360.0)) - 180.0)


def destination(lat, lon, bearing, distance, radius: float = EARTH_FT) -> Column:
    """struct<lat,lon>: the point at a distance along a bearing on the sphere."""
    a, d, t = F.radians(_col(lat)), _col(distance) / radius, F.radians(_col(bearing))
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = F.radians(_col(lon)) + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), F.degrees(lon2).alias("lon"))


def ft_to_deg_lat(ft) -> Column:
    return _col(ft) / FT_PER_DEG


def ft_to_deg_lon(ft, lat) -> Column:
    return _col(ft) / (FT_PER_DEG * F.cos(F.radians(_col(lat))))


def segment_position(px, py, ax, ay, bx, by) -> Column:
    """Share of a segment, 0 to 1, at which the foot of a point stands (planar units); 0 on a segment without length."""
    px, py, ax, ay, bx, by = map(_col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.when(length2 > 0, length2)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)), F.lit(0.0))


def point_segment_m(lon, lat, alon, alat, blon, blat, m_lat: float = M_LAT_SEGMENT) -> Column:
    """Metres from a point to a segment in the plane about the point."""
    lon, lat, alon, alat, blon, blat = map(_col, (lon, lat, alon, alat, blon, blat))
    k = F.cos(F.radians(lat)) * M_LON
    ax, ay, bx, by = (alon - lon) * k, (alat - lat) * m_lat, (blon - lon) * k, (blat - lat) * m_lat
    t = segment_position(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)
    return F.hypot(ax + t * (bx - ax), ay + t * (by - ay))


def head_wind(course, wind, speed) -> Column:
    """Wind against the course (positive ahead); 0 where an input is missing."""
    out = _col(speed) * F.cos(F.radians(_col(wind) - _col(course)))
    return F.when(F.isnan(out) | out.isNull(), F.lit(0.0)).otherwise(out)


def cross_wind(course, wind, speed) -> Column:
    out = F.abs(_col(speed) * F.sin(F.radians(_col(wind) - _col(course))))
    return F.when(F.isnan(out) | out.isNull(), F.lit(0.0)).otherwise(out)


def web_mercator(lon, lat) -> Column:
    r = 6_378_137.0
    y = r * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(_col(lat)) / 2))
    return F.struct((F.radians(_col(lon)) * r).alias("x"), y.alias("y"))


def albers(lon, lat, lat0: float = 23.0, lon0: float = -96.0, lat1: float = 29.5, lat2: float = 45.5) -> Column:
    """Albers equal-area conic on the GRS80 ellipsoid, in metres."""
    import math

    a, f = 6_378_137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)

    def q(s: float) -> float:
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    p0, p1, p2 = (math.radians(x) for x in (lat0, lat1, lat2))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(math.sin(p2)) - q(math.sin(p1)))
    c = m(p1) ** 2 + n * q(math.sin(p1))
    rho0 = a * math.sqrt(c - n * q(math.sin(p0))) / n
    s = F.sin(F.radians(_col(lat)))
    qq = (1 - e * e) * (s / (1 - (e * s) * (e * s)) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = a * F.sqrt(c - n * qq) / n
    theta = n * F.radians(_col(lon) - lon0)
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


# Bounding boxes: xmin, ymin, xmax, ymax.


def boxes_overlap(a: tuple, b: tuple) -> Column:
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = map(_col, (*a, *b))
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def box_overlap_share(a: tuple, b: tuple) -> Column:
    """Intersection over the smaller box; 0 where disjoint or flat."""
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = map(_col, (*a, *b))
    w = F.least(ax1, bx1) - F.greatest(ax0, bx0)
    h = F.least(ay1, by1) - F.greatest(ay0, by0)
    small = F.least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0))
    return F.when((w > 0) & (h > 0) & (small > 0), w * h / small).otherwise(F.lit(0.0))


def in_padded_box(lon, lat, box: tuple, pad=0.0) -> Column:
    x0, y0, x1, y1 = map(_col, box)
    return _col(lon).between(x0 - _col(pad), x1 + _col(pad)) & _col(lat).between(y0 - _col(pad), y1 + _col(pad))


def km_outside_box(lon, lat, box: tuple) -> Column:
    """0 within the box, else flat km to its edge."""
    x0, y0, x1, y1 = map(_col, box)
    lon, lat = _col(lon), _col(lat)
    zero = F.lit(0.0)
    dx = F.greatest(zero, x0 - lon, lon - x1) * F.cos(F.radians(lat)) * M_LON
    dy = F.greatest(zero, y0 - lat, lat - y1) * M_LAT_POINT
    return F.hypot(dx, dy) / 1000.0


# Lines and rings.


def _pairs(line) -> Column:
    """array<struct<a,b>> of a line's neighbouring points."""
    line = _col(line)
    n = F.greatest(F.lit(0), F.size(line) - 1)
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, p: s + value(p))


def line_length_m(line) -> Column:
    return _total(_pairs(line), lambda p: equirect_m(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))


def longest_segment_m(line) -> Column:
    d = F.transform(_pairs(line), lambda p: equirect_m(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))
    return F.coalesce(F.array_max(d), F.lit(0.0))


def cumulative_m(line) -> Column:
    """Running length at each vertex, from 0."""
    steps = F.transform(_pairs(line), lambda p: equirect_m(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))
    return F.transform(F.sequence(F.lit(0), F.size(_col(line)) - 1), lambda i: F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0.0), lambda s, x: s + x))


def point_at(line, cumulative, m) -> Column:
    """The point at m along a line, ends held."""
    line, cum = _col(line), _col(cumulative)
    m = F.least(F.greatest(_col(m), F.lit(0.0)), F.element_at(cum, -1))
    i = F.greatest(F.lit(1), F.least(F.size(line) - 1, F.size(F.filter(cum, lambda c: c <= m))))
    a, b, ca, cb = F.element_at(line, i), F.element_at(line, i + 1), F.element_at(cum, i), F.element_at(cum, i + 1)
    t = F.coalesce((m - ca) / F.when(cb > ca, cb - ca), F.lit(0.0))
    return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))


def vertex_mean(line) -> Column:
    line = _col(line)
    n = F.when(F.size(line) > 0, F.size(line))
    return F.struct((_total(line, lambda p: p["x"]) / n).alias("x"), (_total(line, lambda p: p["y"]) / n).alias("y"))


def bounds(line) -> Column:
    xs, ys = F.transform(_col(line), lambda p: p["x"]), F.transform(_col(line), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def _closed(ring) -> Column:
    """A ring's edges, the closing one included."""
    ring = _col(ring)
    return _pairs(F.concat(ring, F.slice(ring, 1, 1)))


def shoelace(ring) -> Column:
    """Signed area in square units of the coordinates."""
    return _total(_closed(ring), lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2


def ring_area_m2(ring) -> Column:
    """Area on the plane scaled at the ring's mean latitude."""
    k = M_LON * M_LAT_POINT * F.cos(F.radians(vertex_mean(ring)["y"]))
    return F.abs(shoelace(ring)) * k


def ring_area_acres(ring) -> Column:
    return ring_area_m2(ring) / 4046.8564224


def spherical_area_km2(ring, radius_km: float = EARTH_KM) -> Column:
    """Area between the edges and the equator on a sphere, summed with sign."""
    part = _total(_closed(ring), lambda p: F.radians(p["b"]["x"] - p["a"]["x"]) * (2 + F.sin(F.radians(p["a"]["y"])) + F.sin(F.radians(p["b"]["y"]))))
    return F.abs(part) * radius_km * radius_km / 2


def area_centroid(ring) -> Column:
    """struct<area,x,y>: area-weighted centroid; the vertex mean of a ring without area."""
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    area = shoelace(ring)
    safe, mean = F.when(area != 0, 6 * area), vertex_mean(ring)
    x = _total(_closed(ring), lambda p: (p["a"]["x"] + p["b"]["x"]) * cross(p)) / safe
    y = _total(_closed(ring), lambda p: (p["a"]["y"] + p["b"]["y"]) * cross(p)) / safe
    return F.struct(F.abs(area).alias("area"), F.coalesce(x, mean["x"]).alias("x"), F.coalesce(y, mean["y"]).alias("y"))


def in_ring(x, y, ring) -> Column:
    """Even-odd crossing test."""
    x, y = _col(x), _col(y)

    def crosses(p: Column) -> Column:
        a, b = p["a"], p["b"]
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] != a["y"], b["y"] - a["y"])
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(_closed(ring), F.lit(0), lambda s, p: s + crosses(p)) % 2 == 1


def in_polygon(x, y, rings) -> Column:
    """Within the first ring and no other: holes follow the outer ring."""
    rings = _col(rings)
    holes = F.slice(rings, 2, F.greatest(F.lit(0), F.size(rings) - 1))
    return in_ring(x, y, F.element_at(rings, 1)) & ~F.exists(holes, lambda h: in_ring(x, y, h))


def vertex_distance_ft(lat, lon, ring) -> Column:
    return F.array_min(F.transform(_col(ring), lambda p: haversine(lat, lon, p["y"], p["x"])))


def rounded_line(line, places: int = 6) -> Column:
    """Coordinates rounded half to even."""
    return F.transform(_col(line), lambda p: F.struct(F.bround(p["x"], places).alias("x"), F.bround(p["y"], places).alias("y")))


def parse_coordinate(text) -> Column:
    """Decimal, degrees-minutes-seconds or lettered coordinate text as degrees; NaN where there is none. S and W, or a leading minus, are negative."""
    text = F.upper(F.trim(_col(text)))
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    n = F.size(parts)
    value = F.when(n >= 3, F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60 + F.get(parts, F.lit(2)) / 3600).when(n == 2, F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60).when(n == 1, F.get(parts, F.lit(0)))
    sign = F.when(text.rlike("[SW]") | text.startswith("-"), -1.0).otherwise(1.0)
    return F.coalesce(value * sign, F.lit(float("nan")))


def cell(lon, lat, size: float, how: str = "floor") -> Column:
    """struct<i,j> of a grid cell: floor, truncation toward zero, or JavaScript's rounding."""
    one = {"floor": lambda v: F.floor(v), "trunc": lambda v: v.cast("long"), "round": lambda v: F.floor(v + 0.5)}[how]
    return F.struct(one(_col(lon) / size).cast("long").alias("i"), one(_col(lat) / size).cast("long").alias("j"))


def affine(src: list[tuple], dst: list[tuple]) -> Column:
    """struct<a,b,c,d,e,f> with x' = a x + b y + c, y' = d x + e y + f through three point pairs; null where the points lie on a line."""
    (x1, y1), (x2, y2), (x3, y3) = [(_col(x), _col(y)) for x, y in src]
    det = x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2)
    safe = F.when(F.abs(det) > 1e-12, det)

    def row(u1, u2, u3) -> tuple[Column, Column, Column]:
        u1, u2, u3 = map(_col, (u1, u2, u3))
        return (
            (u1 * (y2 - y3) + u2 * (y3 - y1) + u3 * (y1 - y2)) / safe,
            (u1 * (x3 - x2) + u2 * (x1 - x3) + u3 * (x2 - x1)) / safe,
            (u1 * (x2 * y3 - x3 * y2) + u2 * (x3 * y1 - x1 * y3) + u3 * (x1 * y2 - x2 * y1)) / safe,
        )

    names = iter("abcdef")
    parts = [p.alias(next(names)) for k in (0, 1) for p in row(*(d[k] for d in dst))]
    return F.when(safe.isNotNull(), F.struct(*parts))


def inside_point(ring) -> Column:
    """The middle of the first two crossings of a ring by its box's middle latitude; the box's centre where there are none."""
    b = bounds(ring)
    y = (b["ymin"] + b["ymax"]) / 2
    hits = F.filter(_closed(ring), lambda p: (p["a"]["y"] > y) != (p["b"]["y"] > y))
    xs = F.array_sort(F.transform(hits, lambda p: p["a"]["x"] + (y - p["a"]["y"]) * (p["b"]["x"] - p["a"]["x"]) / (p["b"]["y"] - p["a"]["y"])))
    x = F.when(F.size(xs) >= 2, (F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2).otherwise((b["xmin"] + b["xmax"]) / 2)
    return F.struct(x.alias("x"), y.alias("y"))


def inverse_albers(x, y, lat0: float = 23.0, lon0: float = -96.0, lat1: float = 29.5, lat2: float = 45.5) -> Column:
    """struct<lon,lat> of `albers`' plane, by the series from the authalic latitude."""
    import math

    a, f = 6_378_137.0, 1 / 298.257222101
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q(s: float) -> float:
        return (1 - e2) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(math.sin(p2)) - q(math.sin(p1)))
    c = m(p1) ** 2 + n * q(math.sin(p1))
    rho0 = a * math.sqrt(c - n * q(math.sin(p0))) / n
    dy = rho0 - _col(y)
    rho = F.hypot(_col(x), dy)
    beta = F.asin((c - F.pow(rho * n / a, F.lit(2.0))) / n / q(1.0))
    terms = [(2, e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040), (4, 23 * e2**2 / 360 + 251 * e2**3 / 3780), (6, 761 * e2**3 / 45360)]
    lat = beta
    for k, v in terms:
        lat = lat + v * F.sin(k * beta)
    return F.struct((F.lit(lon0) + F.degrees(F.atan2(_col(x), dy)) / n).alias("lon"), F.degrees(lat).alias("lat"))
