"""The flagship plan: overlapping patch predictions to one mask and its figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import volume


def assembly_summary(patches: DataFrame, voxels: DataFrame, cut: float = 0.5, mode: str = "gaussian") -> DataFrame:
    """Voxels and mean value of the assembled probability by number of merged patches, and how many pass ``cut``."""
    out = volume.assembled(patches, voxels, mode)
    return out.groupBy("n_updates").agg(F.count(F.lit(1)).alias("voxels"), F.sum((F.col("v") >= cut).cast("long")).alias("foreground"), F.round(F.avg("v"), 6).alias("mean_v"))


def segmentation(patches: DataFrame, voxels: DataFrame, seeds: DataFrame, size: tuple, cut: float = 0.5, mode: str = "gaussian") -> DataFrame:
    """The assembled mask's components that hold a seed: assembly, threshold, components, seed filter."""
    from ..operators import graph

    mask = volume.threshold(volume.assembled(patches, voxels, mode), cut)
    return graph.components_of_seeds(graph.voxel_components(mask, size, 6), seeds)
