"""From a mask to a centerline tree: bodies, depths, arrival times, clusters, ends, descents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, kernels
from ..operators.kernels import AXES

#: Voxels of the smallest cluster that may be an end.
LEAST_CLUSTER = 5


def clusters(arrivals: DataFrame, size: tuple) -> DataFrame:
    """Voxels with ``label``: components (26 neighbours) of voxels whose arrival falls into one bucket, small ones dropped."""
    top = arrivals.groupBy("body").agg(F.max("time").alias("top"))
    width = F.when(F.col("top") > 100, 10).when(F.col("top") > 50, 5).when(F.col("top") > 20, 3).when(F.col("top") > 10, 2).otherwise(1)
    rows = arrivals.filter(F.col("time") < float("inf")).join(F.broadcast(top), "body")  # one row a body of a case
    rows = rows.withColumn("bucket", (F.floor(F.col("time") / width) + 1).cast("long")).withColumn("v", F.lit(1.0))
    rows = rows.withColumn("group", F.xxhash64("body", "bucket"))
    out = graph.voxel_components(rows, size, 26, same="group")
    big = out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_CLUSTER)
    return out.join(big.select("label"), "label", "left_semi").select("body", *AXES, "depth", "time", "label")


def end_points(clustered: DataFrame) -> DataFrame:
    """The deepest voxel of every cluster that touches exactly one other."""
    from ..operators.volume import deepest_voxel

    shifted = clustered.withColumn("label", F.col("label") + 1)
    ends = graph.end_clusters(shifted)
    best = deepest_voxel(shifted.join(ends, "label", "left_semi"), "depth")
    return best.join(shifted.select(*AXES, "body"), AXES).select("body", *AXES, "depth")


def centerlines(mask: DataFrame, size: tuple, spacing: tuple = (1.0, 1.0, 1.0), bodies: int = 3) -> DataFrame:
    """Polylines of the ``bodies`` largest bodies: body, line_id, seq, x, y, z, radius, reached.

    Each line runs from the body's deepest voxel to an end; its radius is the depth there, the largest spacing at least.
    """
    labelled = graph.stored(graph.voxel_components(mask, size, 26), "bodies")
    largest = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(bodies).select("label")
    body = labelled.join(F.broadcast(largest), "label", "left_semi").withColumnRenamed("label", "body")  # a few rows
    depth = graph.stored(kernels.distance_maps(body, ["body"], spacing), "depth")
    arrival = graph.stored(kernels.arrival_maps(depth, ["body"], spacing), "arrival")
    ends = end_points(graph.stored(clusters(arrival, size), "clusters"))
    least = max(spacing)

    def run(rows: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["body", "line_id", "seq", "x", "y", "z", "radius", "reached"])
        times, first = kernels._block(rows.assign(time1=rows["time"].replace(np.inf, -1.0) + 1.0), "time1")
        depths, _ = kernels._block(rows, "depth")
        times = np.where(times > 0, times - 1.0, np.inf)
        out = []
        for n, t in enumerate(targets.sort_values(AXES)[AXES].to_numpy(int)):
            path, ok = kernels.descent(times, tuple(t - first))
            path = path[::-1]
            radius = np.maximum([float(kernels.trilinear(depths, p)) for p in path], least)
            world = (path + first) * np.array(spacing)
            out.append(pd.DataFrame({"body": rows["body"].iloc[0], "line_id": n, "seq": np.arange(len(path)), "x": world[:, 0], "y": world[:, 1], "z": world[:, 2], "radius": radius, "reached": ok}))
        return pd.concat(out) if out else pd.DataFrame(columns=["body", "line_id", "seq", "x", "y", "z", "radius", "reached"])

    schema = "body long, line_id int, seq int, x double, y double, z double, radius double, reached boolean"
    return arrival.groupBy("body").cogroup(ends.groupBy("body")).applyInPandas(run, schema)
