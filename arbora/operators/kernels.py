"""Numeric kernels over one dense block, and their grouped forms: one task a (case, component).

They are what joins and windows can't express well: distance transforms, arrival times, descents and splines.  A group is
one body's bounding box, not a case's volume, so its size is bounded by the body; bodies run in parallel.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

AXES = ["x", "y", "z"]


def squared_distance_line(f: np.ndarray, spacing: float) -> np.ndarray:
    """Along the last axis, min over q of f(q) + (spacing * (p - q))**2: lower envelopes of parabolas, all lines at once."""
    n = f.shape[-1]
    out = np.full(f.shape, np.inf)
    at = np.arange(n) * spacing
    for q in range(n):
        np.minimum(out, f[..., q : q + 1] + (at - at[q]) ** 2, out=out)
    return out


def distance_map(mask: np.ndarray, spacing: tuple = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Exact Euclidean distance of each inside voxel to the nearest outside one; 0 outside.  What lies beyond the block
    counts as inside, so a block should have a margin."""
    f = np.where(mask, np.inf, 0.0)
    for axis, s in enumerate(spacing):
        f = np.moveaxis(squared_distance_line(np.moveaxis(f, axis, -1), s), -1, axis)
    return np.sqrt(f)


def signed_distance_map(mask: np.ndarray, spacing: tuple = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Distance to the boundary voxels of the other kind, positive inside and negative outside."""
    return distance_map(mask, spacing) - distance_map(~mask, spacing)


def arrival_times(speed: np.ndarray, seeds: list[tuple[int, int, int]], spacing: tuple = (1.0, 1.0, 1.0), stop: float = 1000.0) -> np.ndarray:
    """First-order fast marching: the time at which a front from the seeds reaches each voxel; inf where it doesn't, or
    after ``stop``.  Voxels of speed 0 are walls."""
    times, done = np.full(speed.shape, np.inf), np.zeros(speed.shape, bool)
    heap = []
    for s in seeds:
        if speed[s] > 0:
            times[s] = 0.0
            heap.append((0.0, s))
    heapq.heapify(heap)
    shape = speed.shape
    while heap:
        t, p = heapq.heappop(heap)
        if done[p] or t > stop:
            continue
        done[p] = True
        for axis in range(3):
            for d in (-1, 1):
                q = list(p)
                q[axis] += d
                if not 0 <= q[axis] < shape[axis]:
                    continue
                q = tuple(q)
                if done[q] or speed[q] <= 0:
                    continue
                new = _eikonal(times, q, 1.0 / speed[q], spacing, shape)
                if new < times[q]:
                    times[q] = new
                    heapq.heappush(heap, (new, q))
    times[times > stop] = np.inf
    return times


def _eikonal(times, q, slowness, spacing, shape) -> float:
    """The time at ``q`` from its earlier neighbours: as many axes as keep the root real and causal."""
    low = []
    for axis in range(3):
        best = np.inf
        for d in (-1, 1):
            c = q[axis] + d
            if 0 <= c < shape[axis]:
                p = (*q[:axis], c, *q[axis + 1 :])
                best = min(best, times[p])
        if best < np.inf:
            low.append((best, spacing[axis]))
    low.sort()
    t = np.inf
    a = b = c = 0.0
    for value, h in low:
        if value >= t:
            break
        w = 1.0 / (h * h)
        a, b, c = a + w, b + w * value, c + w * value * value
        root = b * b - a * (c - slowness * slowness)
        if root < 0:
            break
        t = (b + np.sqrt(root)) / a
    return t


def trilinear(field: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Values of a field (x, y, z, ...) at index coordinates, clamped to the block."""
    top = np.array(field.shape[:3]) - 1
    p = np.clip(np.asarray(p, float), 0, top)
    i = np.minimum(np.floor(p).astype(int), np.maximum(top - 1, 0))
    f, j = p - i, np.minimum(i + 1, top)
    out = 0.0
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                w = (f[0] if a else 1 - f[0]) * (f[1] if b else 1 - f[1]) * (f[2] if c else 1 - f[2])
                out = out + w * field[j[0] if a else i[0], j[1] if b else i[1], j[2] if c else i[2]]
    return out


def descent(times: np.ndarray, target: tuple, tolerance: float = 1.0, step: float = 0.25, most: int = 100_000) -> tuple[np.ndarray, bool]:
    """The path down the arrival times from ``target`` to a seed: (points, whether it came within ``tolerance``).

    Walls are lifted to the largest time, so that slopes near them point inward; where the slope vanishes the path takes
    the lowest neighbour.
    """
    field = np.where(np.isfinite(times), times, np.nanmax(np.where(np.isfinite(times), times, np.nan)) + 1.0)
    slope = np.stack(np.gradient(field), -1)
    seed = np.array(np.unravel_index(int(np.argmin(times)), times.shape), float)
    p = np.array(target, float)
    path = [p.copy()]
    for _ in range(most):
        if np.linalg.norm(p - seed) <= tolerance:
            path.append(seed)
            return np.array(path), True
        g = trilinear(slope, p)
        n = np.linalg.norm(g)
        q = p - step * g / n if n > 1e-12 else p
        if n <= 1e-12 or trilinear(field, q) >= trilinear(field, p):
            at = np.rint(p).astype(int)
            q = _lowest(field, at).astype(float)
            if field[tuple(q.astype(int))] >= field[tuple(at)]:
                return np.array(path), False
        p = np.clip(q, 0, np.array(times.shape) - 1)
        path.append(p.copy())
    return np.array(path), False


def _lowest(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(at - 1, 0), np.minimum(at + 2, field.shape)
    box = field[lo[0] : hi[0], lo[1] : hi[1], lo[2] : hi[2]]
    return lo + np.array(np.unravel_index(int(np.argmin(box)), box.shape))


def cardinal_spline(points: np.ndarray, samples: int, closed: bool = False, tension: float = 0.0) -> np.ndarray:
    """``samples`` points of a cardinal spline through ``points``, even in the parameter; ends have one-sided slopes."""
    p = np.asarray(points, float)
    n = len(p)
    if n < 2:
        raise ValueError("a spline needs two points")
    segments = n if closed else n - 1
    u = np.linspace(0, segments, samples, endpoint=not closed)
    k = np.minimum(u.astype(int), segments - 1)
    t = (u - k)[:, None]
    at = lambda i: p[i % n] if closed else p[np.clip(i, 0, n - 1)]
    a, b = at(k), at(k + 1)
    scale = (1 - tension) / 2
    one, two = (np.ones((len(k), 1)),) * 2 if closed else (np.where(k == 0, 2.0, 1.0)[:, None], np.where(k + 1 == n - 1, 2.0, 1.0)[:, None])
    ma, mb = scale * one * (at(k + 1) - at(k - 1)), scale * two * (at(k + 2) - at(k))
    return (2 * t**3 - 3 * t**2 + 1) * a + (t**3 - 2 * t**2 + t) * ma + (-2 * t**3 + 3 * t**2) * b + (t**3 - t**2) * mb


def plane_samples(volume: np.ndarray, centre: np.ndarray, u: np.ndarray, v: np.ndarray, half: float, pitch: float) -> np.ndarray:
    """An oblique slice through index point ``centre`` along unit vectors u and v; 0 outside the block."""
    r = np.arange(-half, half + pitch / 2, pitch)
    out = np.zeros((len(r), len(r)))
    for i, a in enumerate(r):
        for j, b in enumerate(r):
            p = centre + a * u + b * v
            if np.all(p >= 0) and np.all(p <= np.array(volume.shape) - 1):
                out[i, j] = trilinear(volume, p)
    return out


def iso_loops(image: np.ndarray, value: float) -> list[np.ndarray]:
    """Closed iso-lines of an image by marching squares, as index points; lines that leave the image stay open."""
    edges: dict[tuple, list[tuple]] = {}

    def cross(a, b):
        va, vb = image[a], image[b]
        t = (value - va) / (vb - va)
        return (round(a[0] + t * (b[0] - a[0]), 9), round(a[1] + t * (b[1] - a[1]), 9))

    for i in range(image.shape[0] - 1):
        for j in range(image.shape[1] - 1):
            ring = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            cut = [cross(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if (image[a] >= value) != (image[b] >= value)]
            for a, b in zip(cut[::2], cut[1::2], strict=True):
                if a != b:
                    edges.setdefault(a, []).append(b)
                    edges.setdefault(b, []).append(a)
    loops = []
    while edges:
        start = next((p for p, q in edges.items() if len(q) == 1), next(iter(edges)))
        loop, at = [start], start
        while edges.get(at):
            to = edges[at].pop()
            edges[to].remove(at)
            if not edges[at]:
                del edges[at]
            at = to
            loop.append(at)
        edges.pop(at, None)
        loops.append(np.array(loop))
    return loops


# grouped forms


def _block(rows: pd.DataFrame, value: str = "v", margin: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(dense block of the rows with a margin of zeros, its first index)."""
    p = rows[AXES].to_numpy(int)
    first = p.min(0) - margin
    block = np.zeros(p.max(0) - first + 1 + margin)
    block[tuple((p - first).T)] = rows[value].to_numpy(float)
    return block, first


def distance_maps(mask: DataFrame, by: list[str], spacing: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """The mask's voxels with ``depth``, their distance to the outside, a group at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, first = _block(rows)
        depth = distance_map(block > 0, spacing)
        return rows[[*by, *AXES]].assign(depth=depth[tuple((rows[AXES].to_numpy(int) - first).T)])

    kinds = dict(mask.dtypes)
    return mask.filter("v > 0").groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "x int, y int, z int, depth double"]))


def arrival_maps(depths: DataFrame, by: list[str], spacing: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """The voxels with ``time``: a front starts at each group's deepest voxel (the first in scan order) and runs at the
    square root of the depth over the largest depth."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(AXES, kind="stable")
        block, first = _block(rows, "depth")
        seed = tuple(rows[AXES].to_numpy(int)[int(np.argmax(rows["depth"].to_numpy()))] - first)
        times = arrival_times(np.sqrt(block / block.max()), [seed], spacing)
        return rows[[*by, *AXES, "depth"]].assign(time=times[tuple((rows[AXES].to_numpy(int) - first).T)])

    kinds = dict(depths.dtypes)
    return depths.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "x int, y int, z int, depth double, time double"]))


def bucket_width(largest: float) -> int:
    """Arrival times a bucket: coarser the longer the front ran."""
    return next((w for limit, w in ((100, 10), (50, 5), (20, 3), (10, 2)) if largest > limit), 1)
