"""Streaming forms of the operators that merge in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import gaussian_weight


def assembled_stream(voxels: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the gaussian-weighted mean of patches as they come: rows of x, y, z, i, j, k, sx, sy, sz, v.

    Sums of weights and of weighted values are the state, so late and reordered patches give the same volume.
    """
    w = gaussian_weight((F.col("i"), F.col("j"), F.col("k")), (F.col("sx"), F.col("sy"), F.col("sz")))
    out = voxels.withColumn("w", w).groupBy("x", "y", "z").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"), F.count(F.lit(1)).alias("n_updates"))
    return out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def path_lengths_stream(points: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Points per user and session, sessions ending after ``gap``; events later than ``late`` are dropped."""
    return points.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("total"))
