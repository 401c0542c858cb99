"""numpy kernels on one line, ring or grid, for what columns can't express; wrapped as pandas UDFs in `operators`."""

from __future__ import annotations

import heapq
import math

import numpy as np

from .geo import M_LAT_POINT, M_LAT_SEGMENT, M_LON


def rdp_keep(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices Ramer-Douglas-Peucker keeps, with a stack in place of recursion."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = xy[b] - xy[a]
        rel = xy[a + 1 : b] - xy[a]
        t = np.clip((rel @ d) / max(d @ d, 1e-300), 0, 1)
        off = np.hypot(*(rel - t[:, None] * d).T)
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def resample(xy: np.ndarray, n: int) -> np.ndarray:
    """n points at equal arc length."""
    s = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])
    at = np.linspace(0, s[-1], n)
    return np.stack([np.interp(at, s, xy[:, k]) for k in (0, 1)], 1)


def moving_average(xy: np.ndarray, window: int) -> np.ndarray:
    """Centred box mean; windows shrink at the ends."""
    if window < 2 or len(xy) < 3:
        return xy
    h = window // 2
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(xy, 0)])
    i = np.arange(len(xy))
    a, b = np.maximum(0, i - h), np.minimum(len(xy), i + h + 1)
    return (sums[b] - sums[a]) / (b - a)[:, None]


def to_metres(lonlat: np.ndarray, lat0: float) -> np.ndarray:
    return lonlat * [M_LON * np.cos(np.radians(lat0)), M_LAT_POINT]


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd test of many points against an outer ring and its holes, in blocks of points."""
    out = np.zeros(len(points), bool)
    for n, ring in enumerate(rings):
        a, b = ring, np.roll(ring, -1, axis=0)
        for i in range(0, len(points), 512):
            x, y = points[i : i + 512, 0, None], points[i : i + 512, 1, None]
            straddles = (a[:, 1] > y) != (b[:, 1] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
            odd = ((straddles & (x < at)).sum(1) % 2).astype(bool)
            out[i : i + 512] = odd if n == 0 else out[i : i + 512] & ~odd
    return out


def sampled_overlap(a: list[np.ndarray], b: list[np.ndarray], sample: int = 400) -> tuple[float, float, float]:
    """Shares of a in b and of b in a, in percent, on a grid over the joint box, and the smaller over the larger area."""
    low = np.minimum(a[0].min(0), b[0].min(0))
    high = np.maximum(a[0].max(0), b[0].max(0))
    n = int(min(96, max(16, 3 * np.sqrt(sample))))
    grid = np.stack(np.meshgrid(*(low[k] + (np.arange(n) + 0.5) * (high[k] - low[k]) / n for k in (0, 1))), -1).reshape(-1, 2)
    ia, ib = inside(grid, a), inside(grid, b)
    both, na, nb = (ia & ib).sum(), ia.sum(), ib.sum()
    return (100 * both / na if na else 0.0, 100 * both / nb if nb else 0.0, min(na, nb) / max(na, nb) if max(na, nb) else 0.0)


def scanline_runs(rings: list[np.ndarray], cell: float) -> list[tuple[int, int, int]]:
    """Even-odd fill at cell centres as inclusive runs (row, first, last)."""
    edges = np.concatenate([np.stack([r, np.roll(r, -1, axis=0)], 1) for r in rings])
    out = []
    lo, hi = edges[..., 1].min(), edges[..., 1].max()
    for j in range(int(np.floor(lo / cell)), int(np.floor(hi / cell)) + 1):
        y = (j + 0.5) * cell
        a, b = edges[:, 0], edges[:, 1]
        hit = (a[:, 1] > y) != (b[:, 1] > y)
        xs = np.sort(a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
        for x0, x1 in zip(xs[::2], xs[1::2], strict=True):
            first, last = int(np.ceil(x0 / cell - 0.5)), int(np.ceil(x1 / cell - 0.5)) - 1
            if first <= last:
                out.append((j, first, last))
    return out


def shortest_path(n: int, edges: list[tuple[int, int, float]], start: int, goal: int, allowed=None) -> tuple[float, list[int]] | None:
    """Dijkstra over an undirected graph; allowed: which nodes may be entered."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    best, before, queue = {start: 0.0}, {}, [(0.0, start)]
    while queue:
        d, u = heapq.heappop(queue)
        if u == goal:
            path = [u]
            while path[-1] != start:
                path.append(before[path[-1]])
            return d, path[::-1]
        if d > best[u]:
            continue
        for v, w in near[u]:
            if (allowed is None or allowed[v] or v == goal) and d + w < best.get(v, np.inf):
                best[v], before[v] = d + w, u
                heapq.heappush(queue, (d + w, v))
    return None


def iso_segments(grid: np.ndarray, level: float) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """Marching squares: the level's segments in cell units, by rows; cells with an unknown corner have none, saddles are cut by their mean."""
    if min(grid.shape) < 2:
        return []
    v = np.stack([grid[:-1, :-1], grid[:-1, 1:], grid[1:, 1:], grid[1:, :-1]])  # corners in turn
    j, i = np.nonzero(~np.isnan(v).any(0))
    v = v[:, j, i]
    corner = np.stack([np.stack([i, j], 1), np.stack([i + 1, j], 1), np.stack([i + 1, j + 1], 1), np.stack([i, j + 1], 1)]).astype(float)
    nxt, to = np.roll(v, -1, 0), np.roll(corner, -1, 0)
    crossed = (v >= level) != (nxt >= level)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = corner + ((level - v) / (nxt - v))[..., None] * (to - corner)
    n = crossed.sum(0)
    two, four = np.flatnonzero(n == 2), np.flatnonzero(n == 4)
    first, last = crossed[:, two].argmax(0), 3 - crossed[::-1, two].argmax(0)
    turn = (v[:, four].mean(0) >= level) == (v[0, four] >= level)
    sides = np.where(turn[:, None, None], np.array([[0, 1], [2, 3]]), np.array([[3, 0], [1, 2]]))
    block = np.concatenate([two, np.repeat(four, 2)])
    ends = np.concatenate([np.stack([first, last], 1), sides.reshape(-1, 2)])
    order = np.argsort(block, kind="stable")
    a, b = cut[ends[order, 0], block[order]], cut[ends[order, 1], block[order]]
    return [(tuple(p), tuple(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]


def chain_lines(lines: list[list[tuple[float, float]]], places: int = 5) -> list[list[tuple[float, float]]]:
    """Fragments joined at equal rounded ends into maximal lines, each grown at its tail, then at its head, by the lowest-numbered fragment left."""
    key = lambda p: (round(p[0], places), round(p[1], places))
    ends: dict[tuple, list[int]] = {}
    for n, line in enumerate(lines):
        for p in (line[0], line[-1]):
            ends.setdefault(key(p), []).append(n)
    used, out = set(), []
    for n, line in enumerate(lines):
        if n in used:
            continue
        used.add(n)
        run = list(line)
        for _ in range(2):
            while (nxt := next((m for m in ends[key(run[-1])] if m not in used), None)) is not None:
                used.add(nxt)
                piece = lines[nxt] if key(lines[nxt][0]) == key(run[-1]) else lines[nxt][::-1]
                run += piece[1:]
            run.reverse()
        out.append(run)
    return out


def _crossings(edges: np.ndarray, y: float) -> np.ndarray:
    """Sorted x at which a polygon's edges (n, 2, 2) cross a level; pairs of them are its inside."""
    a, b = edges[:, 0], edges[:, 1]
    hit = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[hit], b[hit]
    return np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))


def _meets(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Levels at which edges of two sets cross each other."""
    p, r = e[:, None, 0], e[:, None, 1] - e[:, None, 0]
    q, s = f[None, :, 0], f[None, :, 1] - f[None, :, 0]
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((q - p)[..., 0] * s[..., 1] - (q - p)[..., 1] * s[..., 0]) / cross
        u = ((q - p)[..., 0] * r[..., 1] - (q - p)[..., 1] * r[..., 0]) / cross
    at = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return (p[..., 1] + t * r[..., 1])[at]


def exact_overlap(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, float, float]:
    """Areas of two polygons (outer rings and holes, even-odd) and of their intersection. Between neighbouring levels of vertices and crossings
    all edges are straight and apart, so a slab's overlap is its height times the overlap at its middle."""
    edges = [np.concatenate([np.stack([r, np.roll(r, -1, axis=0)], 1) for r in rings]) for rings in (a, b)]
    levels = np.unique(np.concatenate([edges[0][:, 0, 1], edges[1][:, 0, 1], _meets(*edges)]))
    areas = np.zeros(3)
    for lo, hi in zip(levels, levels[1:], strict=False):
        xs = [_crossings(e, (lo + hi) / 2) for e in edges]
        spans = [x.reshape(-1, 2) for x in xs]
        both = sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in spans[0] for q in spans[1])
        areas += (hi - lo) * np.array([(s[:, 1] - s[:, 0]).sum() for s in spans] + [both])
    return tuple(float(x) for x in areas)


def pull_string(path: np.ndarray, clear, step: float) -> list[int]:
    """Indices of a path's vertices kept by always going on to the farthest one in sight: every sample of the chord, `step` apart, must be clear."""
    keep = [0]
    while keep[-1] < len(path) - 1:
        at = keep[-1]
        for to in range(len(path) - 1, at, -1):
            n = max(2, int(np.hypot(*(path[to] - path[at])) / step) + 1)
            if to == at + 1 or all(clear(p) for p in path[at] + np.linspace(0, 1, n)[:, None] * (path[to] - path[at])):
                keep.append(to)
                break
    return keep


def best_order(home: np.ndarray, ends: np.ndarray) -> tuple[float, list[int], list[bool]]:
    """The least way from home over all legs and back: its length between legs, their order, and which are run from their second end.

    A program over subsets: the least way to have run a set of legs and stand at an end of one of them. 2^n * 4 n^2 steps, in vectors over the last legs; ends: (n, 2, 2), in a plane.
    """
    n = len(ends)
    if not n:
        return 0.0, [], []
    apart = lambda a, b: np.hypot(*(a - b).T)
    entry = ends.reshape(-1, 2)  # place 2 i + f: leg i is entered at its end f and left at the other
    left = ends[:, ::-1].reshape(-1, 2)
    hop = np.hypot(left[:, None, 0] - entry[None, :, 0], left[:, None, 1] - entry[None, :, 1])
    cost = np.full((1 << n, 2 * n), np.inf)
    back = np.full((1 << n, 2 * n), -1)
    place = np.arange(2 * n)
    cost[1 << (place // 2), place] = apart(entry, home)
    for done in range(1, 1 << n):
        here = cost[done]
        on = np.flatnonzero(np.isfinite(here))
        for i in range(n):
            if done >> i & 1:
                continue
            for f in (0, 1):
                ways = here[on] + hop[on, 2 * i + f]
                k = int(ways.argmin())
                if ways[k] < cost[done | 1 << i, 2 * i + f]:
                    cost[done | 1 << i, 2 * i + f], back[done | 1 << i, 2 * i + f] = ways[k], on[k]
    done = (1 << n) - 1
    total = cost[done] + apart(left, home)
    at = int(total.argmin())
    best, order = float(total[at]), []
    while at >= 0:
        order.append(at)
        done, at = done & ~(1 << at // 2), int(back[done, at])
    order.reverse()
    return best, [p // 2 for p in order], [bool(p % 2) for p in order]


def good_order(home: np.ndarray, ends: np.ndarray) -> tuple[float, list[int], list[bool]]:
    """As best_order, for more legs: the nearer end of the nearest leg each time, then stretches turned round as long as that saves more than a metre. No claim to be the least."""

    def walk(order: list[int]) -> tuple[float, list[bool]]:
        at, m, flips = home, 0.0, []
        for i in order:
            a, b = np.hypot(*(ends[i, 0] - at)), np.hypot(*(ends[i, 1] - at))
            flips.append(bool(b < a))
            m, at = m + min(a, b), ends[i, 0] if b < a else ends[i, 1]
        return m + float(np.hypot(*(home - at))), flips

    rest, order, at = list(range(len(ends))), [], home
    while rest:
        gap = np.hypot(ends[rest, :, 0] - at[0], ends[rest, :, 1] - at[1])
        k = int(gap.min(1).argmin())
        order.append(rest.pop(k))
        at = ends[order[-1], 1 if gap[k, 0] <= gap[k, 1] else 0]
    best, flips = walk(order)
    better = True
    while better:
        better = False
        for i in range(len(order) - 1):
            for j in range(i + 1, len(order)):
                turned = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                m, f = walk(turned)
                if m < best - 1:
                    order, best, flips, better = turned, m, f, True
    return best, order, flips


def exact_overlap_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As exact_overlap for many pairs at once: edges of both (n, edges, 2, 2), areas (n, 3). Levels are taken in turn over all pairs."""
    p, r = a[:, :, None, 0], a[:, :, None, 1] - a[:, :, None, 0]
    q, s = b[:, None, :, 0], b[:, None, :, 1] - b[:, None, :, 0]
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((q - p)[..., 0] * s[..., 1] - (q - p)[..., 1] * s[..., 0]) / cross
        u = ((q - p)[..., 0] * r[..., 1] - (q - p)[..., 1] * r[..., 0]) / cross
        meets = np.where((cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), p[..., 1] + t * r[..., 1], np.inf)
    levels = np.sort(np.concatenate([a[:, :, 0, 1], b[:, :, 0, 1], meets.reshape(len(a), -1)], 1), axis=1)
    levels = levels[:, : int(np.isfinite(levels).sum(1).max(initial=0))]
    # Where a pair has fewer levels than others, its last one repeats, with slabs of no height.
    levels = np.where(np.isfinite(levels), levels, np.where(np.isfinite(levels), levels, -np.inf).max(1, keepdims=True, initial=-np.inf))

    def spans(e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x0, y0), (x1, y1) = (e[:, :, 0, 0], e[:, :, 0, 1]), (e[:, :, 1, 0], e[:, :, 1, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.sort(np.where((y0 > y) != (y1 > y), x0 + (y - y0) * (x1 - x0) / (y1 - y0), np.inf), axis=1)
        lo, hi = x[:, 0 : x.shape[1] // 2 * 2 : 2], x[:, 1::2]
        return lo, np.where(np.isfinite(lo), hi, -np.inf)

    areas = np.zeros((len(a), 3))
    for k in range(levels.shape[1] - 1):
        height = levels[:, k + 1] - levels[:, k]
        y = ((levels[:, k] + levels[:, k + 1]) / 2)[:, None]
        (p0, p1), (q0, q1) = spans(a, y), spans(b, y)
        both = np.maximum(0.0, np.minimum(p1[:, :, None], q1[:, None]) - np.maximum(p0[:, :, None], q0[:, None])).sum((1, 2))
        areas += height[:, None] * np.stack([np.maximum(0.0, p1 - p0).sum(1), np.maximum(0.0, q1 - q0).sum(1), both], 1)
    return areas


def to_segments_m(x, y, ax, ay, bx, by) -> np.ndarray:
    """Metres from each point to each segment in the plane about the point, as `geo.point_segment_m`. Of equally far segments the last bits decide: a point's least distances have those of the C library, the steps in SQL's order."""
    k = np.array([math.cos(r) for r in np.radians(y)]).reshape(-1, 1)
    ux, uy, vx, vy = (ax - x[:, None]) * k * M_LON, (ay - y[:, None]) * M_LAT_SEGMENT, (bx - x[:, None]) * k * M_LON, (by - y[:, None]) * M_LAT_SEGMENT
    dx, dy = vx - ux, vy - uy
    square = dx * dx + dy * dy
    t = np.clip(np.divide(-ux * dx - uy * dy, square, out=np.zeros_like(square), where=square > 0), 0.0, 1.0)
    px, py = ux + t * dx, uy + t * dy
    far = np.sqrt(px * px + py * py)
    if far.size:
        least = far <= far.min(1, keepdims=True) * (1 + 1e-12)
        # A power of the C library is not always the rounded square.
        far[least] = np.sqrt([math.pow(a, 2.0) + math.pow(b, 2.0) for a, b in zip(px[least], py[least], strict=True)])
    return far
