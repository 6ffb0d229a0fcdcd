"""Outlines of rings: octagons around and inside them, over Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Factors of longitude and latitude in the directions that bound an outline.
DIRECTIONS = ((1, 0), (0, 1), (1, 1), (1, -1))
#: Degrees that an octagon inside a ring keeps from it.
INNER = 2e-9
TOLD = ("low2", "low3", "high2", "high3", "mid0", "mid1", "drawn")


def told(rings: pa.Array, turns: pa.Array, west: pa.Array, south: pa.Array, east: pa.Array, north: pa.Array) -> pa.Array:
    """TOLD of each ring of [lon, lat] points, longitudes moved by `turns` and the box around it given: bounds along the two diagonals, a middle,
    and how far the outer octagon can be drawn to it without touching the ring; -1 if the middle is not inside. Null rings, those with null places and with under three points are told nothing."""
    n = rings.value_lengths().fill_null(0).to_numpy()
    points = rings.flatten()
    width = points.value_lengths().fill_null(0).to_numpy()
    flat = np.append(points.flatten().to_numpy(zero_copy_only=False), [np.nan, np.nan])
    start = np.where(width >= 2, np.cumsum(width) - width, len(flat) - 2)
    known = np.flatnonzero(n >= 3)
    own = np.repeat(np.where(n >= 3, np.cumsum(n >= 3) - 1, -1), n)
    start, own = start[own >= 0], own[own >= 0]
    if not len(known):
        return pa.nulls(len(rings), pa.struct([(c, pa.float64()) for c in TOLD]))
    n = n[known]
    first = np.cumsum(n) - n
    following = np.arange(1, len(own) + 1)
    following[first + n - 1] = first
    lon, anchor = flat[start], flat[start][first][own]
    x = np.where(lon - anchor > 180, lon - 360, np.where(lon - anchor < -180, lon + 360, lon)) + turns.to_numpy(zero_copy_only=False)[known][own]
    y = flat[start + 1]
    least, most, total = (lambda a: np.minimum.reduceat(a, first)), (lambda a: np.maximum.reduceat(a, first)), (lambda a: np.add.reduceat(a, first))
    along = [fx * x + fy * y for fx, fy in DIRECTIONS]
    box = [a.to_numpy(zero_copy_only=False)[known] for a in (west, south, east, north)]
    low, high = [box[0], box[1], *map(least, along[2:])], [box[2], box[3], *map(most, along[2:])]
    mx, my = total(x) / n, total(y) / n
    mid = [fx * mx + fy * my for fx, fy in DIRECTIONS]
    room = np.min([*(m - a for m, a in zip(mid, low, strict=True)), *(a - m for m, a in zip(mid, high, strict=True))], axis=0)
    with np.errstate(all="ignore"):
        # an edge stays out of the octagon that is drawn so far that both its ends lie beyond one of the sides
        beyond = np.full(len(x), -np.inf)
        for p, m, a, b in zip(along, mid, low, high, strict=True):
            q = p[following]
            beyond = np.maximum(beyond, np.maximum((np.minimum(p, q) - m[own]) / (b - m)[own], (m[own] - np.maximum(p, q)) / (m - a)[own]))
        drawn = least(beyond) * (1 - 1e-6) - INNER / room
        px, py, at = x[following], y[following], my[own]
        odd = total((((py > at) != (y > at)) & (mx[own] < px + (at - py) / (y - py) * (x - px))).astype(int)) % 2 == 1
        drawn = np.where((room > 4 * INNER) & (drawn > 0) & odd, drawn, -1.0)
    found = np.full((len(TOLD), len(rings)), np.nan)
    found[:, known] = [*low[2:], *high[2:], mx, my, drawn]
    gone = ~np.isfinite(found).all(axis=0)
    return pa.StructArray.from_arrays([pa.array(c) for c in found], names=list(TOLD), mask=pa.array(gone))
