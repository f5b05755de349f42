"""Tracing vessels step by step from seeds through a mask, without a trained model.

A tree is traced in sequence, because each step reads what the steps before it have covered; cases are independent and
run in parallel, one task a case, over the case's mask alone.  What crops find is returned as tables: steps, branches,
and, through ``assembled_trace``, the assembled volume as one weighted aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels
from .config import TraceConfig

AXES = ["x", "y", "z"]
STEPS = "case string, branch_id int, pos int, step_id int, x double, y double, z double, tx double, ty double, tz double, radius double, chances int, status string"


def crop_box(point: np.ndarray, radius: float, ratio: float, shape: tuple, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, size) of the crop around a point in index units, within the volume."""
    wide = max(int(np.ceil(2 * radius * ratio)), least)
    first = np.rint(point - wide / 2).astype(int)
    low, high = np.maximum(first, 0), np.minimum(first + wide, shape)
    return low, np.maximum(high - low, 0)


def centre_component(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The component (face neighbours) of a block's mask that is nearest to ``at``."""
    own = np.argwhere(mask)
    if not len(own):
        return np.zeros_like(mask)
    seed = own[int(np.argmin(((own - at) ** 2).sum(1)))]
    out = np.zeros_like(mask)
    out[tuple(seed)] = True
    while True:
        grown = out.copy()
        for axis in range(3):
            for shift in (1, -1):
                moved = np.roll(out, shift, axis)
                edge = [slice(None)] * 3
                edge[axis] = 0 if shift == 1 else -1
                moved[tuple(edge)] = False
                grown |= moved
        grown &= mask
        if (grown == out).all():
            return out
        out = grown


def face_caps(block: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """(middle, radius) of each connected patch of a block's mask on the block's faces: where the vessel leaves it."""
    out = []
    for axis in range(3):
        for side in (0, block.shape[axis] - 1):
            face = np.take(block, side, axis)
            left = face.copy()
            while left.any():
                patch = centre_component(left[:, :, None], np.array([*np.argwhere(left)[0], 0]))[:, :, 0]
                left &= ~patch
                middle = np.insert(np.argwhere(patch).mean(0), axis, side)
                out.append((middle, float(np.sqrt(patch.sum() / np.pi))))
    return out


def next_points(caps: list, here: np.ndarray, tangent: np.ndarray, radius: float, turn: float, least: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(point, tangent, radius) of the caps ahead, the straightest first: those within ``turn`` of the direction so far; a
    new radius is two thirds the cap's and one third the last one."""
    out = []
    for middle, r in caps:
        d = middle - here
        n = np.linalg.norm(d)
        if n < 1e-9 or np.arccos(np.clip(d @ tangent / n, -1, 1)) >= turn:
            continue
        out.append((middle, d / n, max(least, 2 / 3 * r + 1 / 3 * radius)))
    return sorted(out, key=lambda p: -float(p[1] @ tangent))


def trace_block(mask: np.ndarray, seeds: list[tuple[np.ndarray, np.ndarray, float]], config: TraceConfig) -> list[dict]:
    """The steps of one case's trees.  ``seeds``: (old point, point, radius) in index units."""
    covered = np.zeros(mask.shape, bool)
    steps: list[dict] = []
    queue = [{"point": p, "tangent": _unit(p - o), "radius": r, "from": None} for o, p, r in seeds]
    branch = 0
    while queue and branch < config.max_branches and len(steps) < config.max_steps:
        queue.sort(key=lambda q: -q["radius"])
        head = queue.pop(0)
        if head["from"] is not None and config.prevent_retrace and covered[tuple(np.clip(np.rint(head["point"]).astype(int), 0, np.array(mask.shape) - 1))]:
            continue
        last = head["point"]
        own, here, tangent, radius, chances, inside = [], head["point"], head["tangent"], head["radius"], 0, 0
        if head["from"] is not None:
            own.append({**steps[head["from"]], "pos": 0, "status": "connector"})
        status = "end"
        while len(own) < config.max_branch_steps and len(steps) < config.max_steps:
            if radius < config.stop_radius:
                status = "narrow"
                break
            at = np.clip(np.rint(here).astype(int), 0, np.array(mask.shape) - 1)
            if config.prevent_retrace and covered[tuple(at)]:
                inside += 1
                if inside >= config.retrace_steps:
                    status = "inside"
                    break
            low, size = crop_box(here, (radius + config.add_radius) * config.magnify_radius, config.volume_size_ratio / 2, mask.shape, config.min_resolution)
            box = tuple(slice(a, a + n) for a, n in zip(low, size, strict=True))
            block = centre_component(mask[box], here - low) if size.all() else np.zeros((0, 0, 0), bool)
            caps = [(m + low, r) for m, r in face_caps(block)] if block.any() else []
            ahead = next_points(caps, here, tangent, radius, np.radians(config.turn_degrees), config.min_radius)
            seen = lambda p: config.prevent_retrace and covered[tuple(np.clip(np.rint(p).astype(int), 0, np.array(mask.shape) - 1))]
            ahead = [a for a in ahead if np.linalg.norm(a[0] - here) > 0.5 * radius and not seen(a[0])]
            if not ahead:
                if chances >= config.chances:
                    status = "lost"
                    break
                chances += 1
                here = here + radius * tangent
                continue
            step = {"step_id": len(steps), "branch_id": branch, "pos": len(own) + (head["from"] is None), "p": here, "t": tangent, "radius": radius, "chances": chances, "status": "ok", "low": low, "size": size}
            steps.append(step)
            own.append(step)
            stride = min(np.linalg.norm(ahead[0][0] - here), config.step_factor * max(radius, 1.0) * 2)
            covered[box] |= block & (_from_segment(block.shape, last - low, here - low) <= 1.3 * radius)
            last = here
            for p, t, r in ahead[1:]:
                queue.append({"point": p, "tangent": t, "radius": r, "from": step["step_id"]})
            tangent, radius, chances = ahead[0][1], ahead[0][2], 0
            here = here + stride * tangent
            if np.any(here < 0) or np.any(here > np.array(mask.shape) - 1):
                status = "border"
                break
        made = [s for s in own if s["status"] != "connector"]
        if made and not (branch and len(made) <= 1 and config.restart_branch and status in ("inside", "lost")):
            made[-1]["status"] = status
            if head["from"] is not None:
                made[0]["connector"] = {**own[0], "branch_id": branch, "pos": 0}
            branch += 1
        elif made:  # a short branch that led nowhere is taken back
            for s in made:
                s["status"] = "dropped"
    return steps


def _from_segment(shape: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each voxel of a block from the segment ab."""
    p = np.stack(np.indices(shape), -1) - a
    d = b - a
    t = np.clip(p @ d / max(float(d @ d), 1e-12), 0, 1)
    return np.linalg.norm(p - t[..., None] * d, axis=-1)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-12 else np.array([0.0, 0.0, 1.0])


def trace(mask: DataFrame, seeds: DataFrame, size: tuple, config: TraceConfig) -> DataFrame:
    """Steps of all cases.  ``mask``: case, x, y, z, v; ``seeds``: case, old_x .. old_z, x, y, z, radius (index units).

    Rows of position 0 repeat the step on the mother branch that a branch begins at.
    """
    columns = [c.split()[0] for c in STEPS.split(", ")]

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return pd.DataFrame(columns=columns)
        block = np.zeros(size, bool)
        block[tuple(rows[AXES].to_numpy(int).T)] = rows["v"].to_numpy() > 0
        start = [(s[:3], s[3:6], s[6]) for s in own[["old_x", "old_y", "old_z", *AXES, "radius"]].to_numpy(float)]
        out = []
        for s in trace_block(block, start, config):
            if s["status"] == "dropped":
                continue
            for r in ([s["connector"]] if "connector" in s else []) + [s]:
                out.append((own["case"].iloc[0], r["branch_id"], r["pos"], r["step_id"], *r["p"], *r["t"], r["radius"], r["chances"], "connector" if r["pos"] == 0 else r["status"]))
        return pd.DataFrame(out, columns=columns)

    return mask.filter("v > 0").select("case", *AXES, "v").groupBy("case").cogroup(seeds.groupBy("case")).applyInPandas(run, STEPS)


def seeds_of_bodies(mask: DataFrame, size: tuple, bodies: int = 3) -> DataFrame:
    """A seed in each of the largest bodies of a mask: body, x, y, z, depth; the deepest voxel, the first among equals."""
    from ..operators import graph, volume

    labelled = graph.stored(graph.voxel_components(mask, size, 26), "bodies")
    largest = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(bodies).select("label")
    own = labelled.join(F.broadcast(largest), "label", "left_semi")  # a few rows
    depth = kernels.distance_maps(own, ["label"])
    return volume.deepest_voxel(depth.withColumnRenamed("depth", "v")).withColumnRenamed("label", "body")


def assembled_trace(steps: DataFrame, mask: DataFrame, ratio: float = 2.0) -> DataFrame:
    """The part of the mask that the steps' crops cover, with how many crops covered each voxel.

    Voxels are found by an equality join on cubes of 8, so the work follows the crops' sizes.
    """
    width = 8
    cube = lambda c: F.floor(c / width).cast("long")
    box = steps.filter("pos > 0").withColumn("reach", F.ceil(F.col("radius") * ratio))
    for c in AXES:
        box = box.withColumn(f"b{c}", F.explode(F.sequence(cube(F.col(c) - F.col("reach")), cube(F.col(c) + F.col("reach")))))
    box = box.select("case", "step_id", "reach", *[F.col(c).alias(f"s{c}") for c in AXES], *[f"b{c}" for c in AXES])
    own = mask.filter("v > 0").select("case", *AXES, *[cube(F.col(c)).alias(f"b{c}") for c in AXES])
    near = own.join(box, ["case", *[f"b{c}" for c in AXES]])
    for c in AXES:
        near = near.filter(F.abs(F.col(c) - F.col(f"s{c}")) <= F.col("reach"))
    return near.groupBy("case", *AXES).agg(F.count_distinct("step_id").alias("n_updates"))
