"""Sums over the boxes that boxes overlap, told by ranks: no pair of boxes is looked at where there are many."""

from __future__ import annotations

import numpy as np

#: So many boxes or fewer are held against the others one by one.
FEW = 48


def _below(x: np.ndarray, y: np.ndarray, weights: np.ndarray, u: np.ndarray, v: np.ndarray, sides: tuple[str, str]) -> np.ndarray:
    """For each ask (u, v) how many points (x, y) lie at or below it in both, and the sums of their weights (whole numbers, a row each). sides: 'right' counts equal ones, 'left' doesn't.
    Points in order of x are sorted by y within blocks of every power of two; an ask takes the blocks that its place is the sum of."""
    order = np.argsort(x, kind="stable")
    k = np.searchsorted(x[order], u, sides[0])
    by_y = np.argsort(y[order], kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[by_y] = np.arange(len(x))
    r = np.searchsorted(y[order][by_y], v, sides[1])
    levels = int(len(x)).bit_length()
    size = 1 << levels
    rank = np.concatenate([rank, np.arange(len(x), size)])
    padded = np.zeros((len(weights), size), np.int64)
    padded[:, : len(x)] = weights[:, order]
    out = np.zeros((len(weights) + 1, len(u)), np.int64)
    # Places in order of rank, to be sorted stably into blocks: from there on no level sorts by value.
    at = np.argsort(rank)
    for b in range(levels):
        some = np.flatnonzero((k >> b) & 1)
        if not len(some):
            continue
        placed = at[np.argsort(at >> b, kind="stable")]
        keys = (placed >> b) * size + rank[placed]
        upto = np.zeros((len(weights), size + 1), np.int64)
        np.cumsum(padded[:, placed], axis=1, out=upto[:, 1:])
        start = (k[some] >> (b + 1)) << (b + 1)
        end = np.searchsorted(keys, (start >> b) * size + r[some])
        out[0, some] += end - start
        out[1:, some] += upto[:, end] - upto[:, start]
    return out


def overlap_sums(boxes: np.ndarray, others: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each box (x0, y0, x1, y1, sides in order) how many others it overlaps, edges counted, and the sums of their weights (whole numbers, a row each).
    Others that begin at or before a box's end and don't end before its beginning, in x and y: four counts below a corner."""
    out = np.zeros((len(weights) + 1, len(boxes)), np.int64)
    if not len(boxes) or not len(others):
        return out
    hull = (*others[:, :2].min(0), *others[:, 2:].max(0))
    near = np.flatnonzero((boxes[:, 0] <= hull[2]) & (hull[0] <= boxes[:, 2]) & (boxes[:, 1] <= hull[3]) & (hull[1] <= boxes[:, 3]))
    b = boxes[near]
    if len(others) <= FEW or len(near) <= FEW:
        step = max(1, 2_000_000 // len(others))
        for k in range(0, len(near), step):
            a = b[k : k + step, None]
            hit = (a[..., 0] <= others[:, 2]) & (others[:, 0] <= a[..., 2]) & (a[..., 1] <= others[:, 3]) & (others[:, 1] <= a[..., 3])
            out[0, near[k : k + step]] = hit.sum(1)
            out[1:, near[k : k + step]] = weights @ hit.T.astype(np.int64)
        return out
    for sign, x, y in ((1, (0, 2, "right"), (1, 3, "right")), (-1, (0, 2, "right"), (3, 1, "left")), (-1, (2, 0, "left"), (1, 3, "right")), (1, (2, 0, "left"), (3, 1, "left"))):
        out[:, near] += sign * _below(others[:, x[0]], others[:, y[0]], weights, b[:, x[1]], b[:, y[1]], (x[2], y[2]))
    return out
