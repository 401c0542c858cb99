"""Numpy kernels on blocks of near points or boxes: two blocks are held against each other row by row, or not at all."""

from __future__ import annotations

import numpy as np

from limnos.functions import geo

#: Points of a block: two blocks are held against each other point by point, or not at all.
BLOCK = 256


def blocks(x: np.ndarray, y: np.ndarray, size: int | None = None) -> list[np.ndarray]:
    """Places of the points by compact blocks: strips of x, cut along y; within a block they stay in order."""
    size = size or BLOCK
    strips = max(1, round(np.sqrt(len(x) / size)))
    out = []
    for s in np.array_split(np.argsort(x, kind="stable"), strips):
        out += np.array_split(s[np.argsort(y[s], kind="stable")], max(1, -(-len(s) // size)))
    return [np.sort(b) for b in out if len(b)]


def flat(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Flat metres from each of the first points to each of the second ones, the cosine at the middle latitude."""
    a, b = np.radians(y) / 2, np.radians(v) / 2
    cos = np.cos(a)[:, None] * np.cos(b) - np.sin(a)[:, None] * np.sin(b)
    return np.sqrt(((u - x[:, None]) * cos * geo.M_LON) ** 2 + ((v - y[:, None]) * geo.M_LAT_POINT) ** 2)


def boxed(x: np.ndarray, y: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """x0, y0, x1, y1 of each block."""
    return np.array([(x[b].min(), y[b].min(), x[b].max(), y[b].max()) for b in parts]).reshape(-1, 4)


def apart(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """No more than the flat metres between any point of a box and any of each other box."""
    dx = np.maximum(0, np.maximum(boxes[:, 0] - box[2], box[0] - boxes[:, 2]))
    dy = np.maximum(0, np.maximum(boxes[:, 1] - box[3], box[1] - boxes[:, 3]))
    top = np.maximum(np.abs(boxes[:, [1, 3]]).max(1), np.abs(box[[1, 3]]).max())
    return np.hypot(dx * np.maximum(0, np.cos(np.radians(top))) * geo.M_LON, dy * geo.M_LAT_POINT) * (1 - 1e-9)


def reach(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """No less than the flat metres between any point of a box and any of each other box."""
    dx = np.maximum(boxes[:, 2] - box[0], box[2] - boxes[:, 0])
    dy = np.maximum(boxes[:, 3] - box[1], box[3] - boxes[:, 1])
    low, high = np.minimum(boxes[:, 1], box[1]), np.maximum(boxes[:, 3], box[3])
    least = np.where((low <= 0) & (high >= 0), 0.0, np.minimum(np.abs(low), np.abs(high)))
    return np.hypot(dx * np.cos(np.radians(least)) * geo.M_LON, dy * geo.M_LAT_POINT) * (1 + 1e-9)


def count_within(x, y, u, v, metres: float) -> int:
    """Pairs of a first and a second point within flat metres; blocks that are wholly near or far are not looked at point by point."""
    parts, n = blocks(u, v), 0
    boxes, size = boxed(u, v, parts), np.array([len(p) for p in parts])
    for mine in blocks(x, y):
        box = boxed(x, y, [mine])[0]
        whole = reach(box, boxes) <= metres
        n += len(mine) * int(size[whole].sum())
        for k in np.flatnonzero(~whole & (apart(box, boxes) <= metres)):
            n += int((flat(x[mine], y[mine], u[parts[k]], v[parts[k]]) <= metres).sum())
    return n


def overlapped(boxes: np.ndarray, ids, others: np.ndarray, other_ids) -> np.ndarray:
    """Which boxes (x0, y0, x1, y1) overlap one of the others, edges counted, that is not of the same id. A block is done once all its boxes have met one."""
    hit = np.zeros(len(boxes), bool)
    middle = lambda b: ((b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2)
    hull = lambda b, parts: np.array([(*b[p, :2].min(0), *b[p, 2:].max(0)) for p in parts]).reshape(-1, 4)
    parts = blocks(*middle(others))
    hulls = hull(others, parts)
    for mine in blocks(*middle(boxes)):
        h = hull(boxes, [mine])[0]
        near = np.flatnonzero((hulls[:, 0] <= h[2]) & (h[0] <= hulls[:, 2]) & (hulls[:, 1] <= h[3]) & (h[1] <= hulls[:, 3]))
        for k in near[np.argsort(np.abs(hulls[near] - h).sum(1), kind="stable")]:
            left, p = mine[~hit[mine]], parts[k]
            if not len(left):
                break
            a, b = boxes[left], others[p]
            meet = (a[:, None, 0] <= b[:, 2]) & (b[:, 0] <= a[:, None, 2]) & (a[:, None, 1] <= b[:, 3]) & (b[:, 1] <= a[:, None, 3]) & (ids[left][:, None] != other_ids[p])
            hit[left] = meet.any(1)
    return hit


def by_value(values: np.ndarray, size: int | None = None) -> list[np.ndarray]:
    """Places by blocks of like values; within a block they stay in order."""
    order = np.argsort(values, kind="stable")
    return [np.sort(b) for b in np.array_split(order, max(1, -(-len(order) // (size or BLOCK)))) if len(b)]


def least(n: int, mine: list[np.ndarray], parts: list[np.ndarray], bound, score) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n asks the first score, the second one and the place of its best other row (infinite and -1 without one): the least by both scores, of equal ones the first.
    bound(block): no more than the first score of any of its asks with each other block; score(block, part): both scores of all its asks with the part's rows. Parts are looked at from the least bound up, until none can be better."""
    first, second, at = np.full(n, np.inf), np.full(n, np.inf), np.full(n, -1)
    for m in mine:
        low = bound(m)
        for k in np.argsort(low, kind="stable"):
            if low[k] == np.inf or low[k] > first[m].max():
                break
            a, b = score(m, parts[k])
            best = a.min(1)
            b = np.where(a == best[:, None], b, np.inf)
            i = b.argmin(1)
            second_best, place = b[np.arange(len(m)), i], parts[k][i]
            better = (best < first[m]) | ((best == first[m]) & (best < np.inf) & ((second_best < second[m]) | ((second_best == second[m]) & (place < at[m]))))
            first[m[better]], second[m[better]], at[m[better]] = best[better], second_best[better], place[better]
    return first, second, at


def held(boxes: np.ndarray, x: np.ndarray, y: np.ndarray, show: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many points each box holds, edges counted, and the places of the first so many. Blocks that are wholly inside or outside are not looked at point by point."""
    n, firsts = np.zeros(len(boxes), np.int64), [np.zeros(0, int)] * len(boxes)
    parts = blocks(x, y)
    hulls, size = boxed(x, y, parts), np.array([len(p) for p in parts])
    within = lambda b, p: (b[:, None, 0] <= x[p]) & (x[p] <= b[:, None, 2]) & (b[:, None, 1] <= y[p]) & (y[p] <= b[:, None, 3])
    for m in blocks((boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2):
        b = boxes[m]
        meet = (b[:, None, 0] <= hulls[:, 2]) & (hulls[:, 0] <= b[:, None, 2]) & (b[:, None, 1] <= hulls[:, 3]) & (hulls[:, 1] <= b[:, None, 3])
        whole = (b[:, None, 0] <= hulls[:, 0]) & (hulls[:, 2] <= b[:, None, 2]) & (b[:, None, 1] <= hulls[:, 1]) & (hulls[:, 3] <= b[:, None, 3])
        n[m] += whole @ size
        for k in np.flatnonzero((meet & ~whole).any(0)):
            rows = np.flatnonzero(meet[:, k] & ~whole[:, k])
            n[m[rows]] += within(b[rows], parts[k]).sum(1)
        todo, start, step = m[n[m] > 0], 0, 64
        while len(todo) and start < len(x):
            p = np.arange(start, min(len(x), start + step))
            for row, hit in zip(todo, within(boxes[todo], p), strict=True):
                if hit.any():
                    firsts[row] = np.concatenate([firsts[row], p[hit]])[:show]
            todo = todo[[len(firsts[t]) < min(show, n[t]) for t in todo]]
            start, step = start + step, min(4096, 2 * step)
    return n, firsts


def counted(odd: np.ndarray, flips: tuple[np.ndarray, np.ndarray], edges: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, group: np.ndarray, groups: int, size: int = 64, values: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """How many points of each group every row of `polygons.index` of a cell holds (rows, groups), by the rule of `polygons.holds`; with values also the least value each row holds (else infinite). flips, edges: values of all rows, and where each row's end.
    Within a block that none of a row's edges comes near all points lie on one side, told at one of them; only the others are looked at point by point."""
    (f, f_ends), (e, e_ends) = flips, edges
    out, low_value = np.zeros((len(odd), groups), np.int64), np.full(len(odd), np.inf)
    parts = blocks(x, y, size)
    if not len(odd) or not len(parts):
        return out if values is None else (out, low_value)
    inner = np.diff(e_ends, prepend=0) == 0
    out[inner] = np.bincount(group, minlength=groups)
    if values is not None:
        low_value[inner] = values.min()
        least_of = np.array([values[p].min() for p in parts])
    hulls, first = boxed(x, y, parts), np.array([p[0] for p in parts])
    width = max(map(len, parts))
    at = np.array([np.pad(p, (0, width - len(p)), constant_values=-1) for p in parts])
    by = np.zeros((len(parts), groups))
    np.add.at(by, (np.repeat(np.arange(len(parts)), [len(p) for p in parts]), group[np.concatenate(parts)]), 1)
    corners = hulls[:, [[0, 1], [2, 1], [2, 3], [0, 3]]]

    def right(k, u, v):
        ax, ay, bx, by_ = (e[k, c][:, None] for c in range(4))
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((ay > v) != (by_ > v)) & (u < ax + (v - ay) * (bx - ax) / (by_ - ay))

    spread = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    begin_e, begin_f = np.append(0, e_ends[:-1]), np.append(0, f_ends[:-1])
    n_e, n_f = e_ends - begin_e, f_ends - begin_f
    border = np.flatnonzero(~inner)
    step = max(1, 2_000_000 // (len(parts) * 4 + groups))
    for s in range(0, len(border), step):
        rows = border[s : s + step]
        row_e, k = spread(n_e[rows])
        k += begin_e[rows][row_e]
        row_f, m = spread(n_f[rows])
        m += begin_f[rows][row_f]
        a, b = e[k, :2], e[k, 2:]
        low, high = np.minimum(a, b) - 1e-9, np.maximum(a, b) + 1e-9
        near = (low[:, None, 0] <= hulls[:, 2]) & (hulls[:, 0] <= high[:, None, 0]) & (low[:, None, 1] <= hulls[:, 3]) & (hulls[:, 1] <= high[:, None, 1])
        d = b - a
        side = [(corners[:, c, 1] - a[:, None, 1]) * d[:, None, 0] - (corners[:, c, 0] - a[:, None, 0]) * d[:, None, 1] for c in range(4)]
        slack = 1e-9 * (np.abs(d).sum(1)[:, None] + 1e-9)
        near &= (np.minimum.reduce(side) <= slack) & (np.maximum.reduce(side) >= -slack)
        begins = np.cumsum(n_e[rows]) - n_e[rows]
        close = np.logical_or.reduceat(near, begins, axis=0)
        count = np.add.reduceat(right(k, x[first], y[first]).astype(np.int64), begins, axis=0) + odd[rows, None]
        np.add.at(count, row_f, f[m][:, None] > y[first])
        whole = (count % 2 == 1) & ~close
        out[rows] += (whole.astype(float) @ by).astype(np.int64)
        if values is not None:
            low_value[rows] = np.where(whole, least_of, np.inf).min(1)
        pair_row, pair_part = np.nonzero(close)
        most = max(1, 1_000_000 // (width * max(1, int(n_e[rows].max()))))
        for t in range(0, len(pair_row), most):
            r, p = rows[pair_row[t : t + most]], at[pair_part[t : t + most]]
            u, v = x[p], y[p]
            pair, k = spread(n_e[r])
            count = np.add.reduceat(right(k + begin_e[r][pair], u[pair], v[pair]).astype(np.int64), np.cumsum(n_e[r]) - n_e[r], axis=0) + odd[r, None]
            pair, m = spread(n_f[r])
            np.add.at(count, pair, f[m + begin_f[r][pair]][:, None] > v[pair])
            hit, place = np.nonzero((count % 2 == 1) & (p >= 0))
            np.add.at(out, (r[hit], group[p[hit, place]]), 1)
            if values is not None:
                np.minimum.at(low_value, r[hit], values[p[hit, place]])
    return out if values is None else (out, low_value)
