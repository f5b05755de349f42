"""Samples of volumes: look-ups, boxes, seeds, and paths and contours through them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import AXES


def looked_up(points: DataFrame, volume: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Points with ``v`` of their nearest voxel (half to even); 0 outside the volume."""
    keys = keys or []
    near = points.select("*", *[F.rint(c).cast("int").alias(f"n{c}") for c in AXES])
    own = volume.select(*keys, *[F.col(c).alias(f"n{c}") for c in AXES], F.col("v").cast("double").alias("v"))
    return near.join(own, [*keys, *[f"n{c}" for c in AXES]], "left").withColumn("v", F.coalesce("v", F.lit(0.0))).drop(*[f"n{c}" for c in AXES])


def inside(points: DataFrame, volume: DataFrame, cut: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Points with ``inside``: their voxel is over ``cut``; outside the volume it's false."""
    return looked_up(points, volume, keys).withColumn("inside", F.col("v") > cut).drop("v")


def outer_caps(caps: DataFrame, volume: DataFrame) -> DataFrame:
    """The caps that the assembled volume doesn't cover."""
    return inside(caps, volume).filter("not inside").drop("inside")


def union_box(crops: DataFrame, by: list[str]) -> DataFrame:
    """The box around crops (ix .. iz, sx .. sz) of each key: ix .. iz, sx .. sz."""
    low = [F.min(f"i{c}").alias(f"i{c}") for c in AXES]
    high = [(F.max(F.col(f"i{c}") + F.col(f"s{c}")) - F.min(f"i{c}")).cast("int").alias(f"s{c}") for c in AXES]
    return crops.groupBy(*by).agg(*low, *high)


def oriented_boxes(ends: DataFrame, scale: float = 4.0) -> DataFrame:
    """Boxes in front of line ends (x, y, z, tx, ty, tz, radius): their middles cx, cy, cz and side."""
    half = F.lit(0.5 * scale) * F.col("radius")
    return ends.select("*", *[(F.col(c) + half * F.col(f"t{c}")).alias(f"c{c}") for c in AXES], (F.lit(scale) * F.col("radius")).alias("side"))


def outside_boxes(mask: DataFrame, boxes: DataFrame, limit: int = 10_000) -> DataFrame:
    """The mask without voxels in any oriented box.  Boxes are line ends; over ``limit`` of them raise, so that the
    broadcast stays small, and the caller splits them by case."""
    if boxes.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} boxes: split them by case")
    d = [F.col(c) - F.col(f"c{c}") for c in AXES]
    t = [F.col(f"t{c}") for c in AXES]
    forward = sum((a * b for a, b in zip(d, t, strict=True)), F.lit(0.0))
    aside = sum((a * a for a in d), F.lit(0.0)) - forward * forward
    inside_ = (F.abs(forward) <= F.col("side") / 2) & (aside <= F.col("side") * F.col("side") / 2)
    return mask.join(F.broadcast(boxes.select("side", *[f"c{c}" for c in AXES], *[f"t{c}" for c in AXES])), inside_, "left_anti")


def random_voxels(mask: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` voxels of the mask, the same for one seed: those with the smallest hashes."""
    return mask.filter("v > 0").orderBy(F.xxhash64(*AXES, F.lit(seed)), *AXES).limit(n)


def every_nth(mask: DataFrame, every: int, size: tuple, value: float = 0.0) -> DataFrame:
    """Each ``every``-th voxel of the grid, in scan order, of those over ``value``."""
    _, ny, nz = size
    place: Column = (F.col("x").cast("long") * ny + F.col("y")) * nz + F.col("z")
    return mask.filter((place % every == 0) & (F.col("v") > value))


def covered_by(mask: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Per centre (centre_id, x, y, z), how many voxels of the mask lie within ``radius``."""
    from .spatial import within

    points = mask.filter("v > 0").select(F.monotonically_increasing_id().alias("point_id"), *[F.col(c).cast("double").alias(c) for c in AXES])
    hit = within(centres.withColumnRenamed("centre_id", "query_id"), points, radius)
    counts = hit.groupBy(F.col("query_id").alias("centre_id")).agg(F.count(F.lit(1)).alias("voxels"))
    return centres.select("centre_id").join(counts, "centre_id", "left").na.fill({"voxels": 0})


def sampled_paths(controls: DataFrame, per_segment: int = 4, low: int = 8, high: int = 100, by: str = "path_id", order: str = "seq") -> DataFrame:
    """Samples of a spline through each path's control points, with unit tangents and a rotation at a right angle:
    path_id, id, x .. rz.  A path of one point gives none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = [by, "id", *AXES, "tx", "ty", "tz", "rx", "ry", "rz"]
        p = rows.sort_values(order, kind="stable")[AXES].to_numpy(float)
        p = p[np.concatenate(([True], np.any(np.diff(p, axis=0) != 0, axis=1)))]
        if len(p) < 2:
            return pd.DataFrame(columns=names)
        n = min(max(per_segment * (len(p) - 1) + 1, low), high)
        s = kernels.cardinal_spline(p, n)
        t = np.gradient(s, axis=0)
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        axis = np.eye(3)[np.argmin(np.abs(t), axis=1)]
        r = np.cross(t, axis)
        r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame(np.column_stack((s, t, r)), columns=names[2:]).assign(**{by: rows[by].iloc[0], "id": np.arange(n)})[names]

    kind = dict(controls.dtypes)[by]
    return controls.groupBy(by).applyInPandas(run, f"{by} {kind}, id int, x double, y double, z double, tx double, ty double, tz double, rx double, ry double, rz double")


def contours(mask: DataFrame, samples: DataFrame, stride: int = 1, value: float = 0.5, half: float = 8.0, pitch: float = 0.5) -> DataFrame:
    """Closed outlines of a case's volume in planes across a path: case, path_id, id, seq, x, y, z.

    ``mask``: case, x, y, z, v (only voxels near the path need be given); ``samples``: case and what ``sampled_paths``
    returns.  Of each plane's outlines, the one nearest to the path is taken; open ones and planes without any give no
    rows.  A task holds one case's block.
    """
    names = ["case", "path_id", "id", "seq", *AXES]

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(own):
            block, first = kernels._block(rows)
            for s in own[own["id"] % stride == 0].itertuples():
                p, u = np.array([s.x, s.y, s.z]), np.array([s.rx, s.ry, s.rz])
                v = np.cross([s.tx, s.ty, s.tz], u)
                image = kernels.plane_samples(block, p - first, u, v, half, pitch)
                loops = [q for q in kernels.iso_loops(image, value) if len(q) > 3 and np.allclose(q[0], q[-1])]
                if not loops:
                    continue
                middle = half / pitch
                loop = min(loops, key=lambda q: np.linalg.norm(q.mean(0) - middle))[:-1]
                world = p + ((loop[:, :1] - middle) * u + (loop[:, 1:] - middle) * v) * pitch
                out += [(s.case, s.path_id, s.id, k, *w) for k, w in enumerate(world)]
        return pd.DataFrame(out, columns=names)

    return mask.filter("v > 0").select("case", *AXES, "v").groupBy("case").cogroup(samples.groupBy("case")).applyInPandas(run, "case string, path_id int, id int, seq int, x double, y double, z double")


def merged_lines(lines: DataFrame, by: str, factor: float = 1.0, least: float = 0.5) -> DataFrame:
    """Lines of each ``by`` joined into a tree: the longest stays whole; each other one, walked from its far end (its
    last point), ends at the first point that is within ``factor`` radii (``least`` at least) of the tree so far.

    ``lines``: by, line_id, seq, x, y, z, radius.  Adds ``parent_line`` and ``parent_seq``, where the kept part attaches
    (null for the first line and lines that meet nothing).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups = {k: g.sort_values("seq") for k, g in rows.groupby("line_id")}
        length = {k: np.linalg.norm(np.diff(g[AXES].to_numpy(float), axis=0), axis=1).sum() for k, g in groups.items()}
        tree_p, tree_at, out = np.zeros((0, 3)), [], []
        for k in sorted(groups, key=lambda k: (-length[k], k)):
            g = groups[k]
            p, r = g[AXES].to_numpy(float), g["radius"].to_numpy(float)
            keep, parent = 0, (None, None)
            if len(tree_p):
                for i in range(len(p) - 1, -1, -1):
                    d = np.linalg.norm(tree_p - p[i], axis=1)
                    j = int(np.argmin(d))
                    if d[j] <= max(least, factor * r[i]):
                        keep, parent = i, tree_at[j]
                        break
            part = g.iloc[keep:].assign(parent_line=parent[0], parent_seq=parent[1])
            out.append(part)
            tree_p = np.concatenate((tree_p, p[keep:]))
            tree_at += [(k, s) for s in part["seq"]]
        done = pd.concat(out)
        return done.astype({"parent_line": "Int32", "parent_seq": "Int32"})[[by, "line_id", "seq", *AXES, "radius", "parent_line", "parent_seq"]]

    kind = dict(lines.dtypes)
    return lines.groupBy(by).applyInPandas(run, f"{by} {kind[by]}, line_id {kind['line_id']}, seq int, x double, y double, z double, radius double, parent_line int, parent_seq int")
