"""Synthetic volumes, patches and trees with known answers, generated in parallel from ``range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """All voxels x, y, z of a box, x fastest."""
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx).cast("int").alias("x"), (F.floor(i / nx) % ny).cast("int").alias("y"), F.floor(i / (nx * ny)).cast("int").alias("z"))


def tube(spark: SparkSession, nx: int = 24, ny: int = 12, nz: int = 12, r2: int = 9) -> DataFrame:
    """A straight tube along x through the middle: v is 1.0 inside, else 0.0."""
    inside: Column = F.pow(F.col("y") - ny // 2, 2) + F.pow(F.col("z") - nz // 2, 2) <= r2
    return grid(spark, nx, ny, nz).withColumn("v", inside.cast("double"))


def blobs(spark: SparkSession, n: int = 12) -> DataFrame:
    """Two boxes that touch at one corner, and a third one apart: joined under 26 neighbours, separate under 6."""

    def box(a: int, b: int) -> Column:
        inside = F.lit(True)
        for c in ("x", "y", "z"):
            inside = inside & F.col(c).between(a, b)
        return inside

    return grid(spark, n, n, n).withColumn("v", (box(1, 3) | box(4, 6) | box(9, 10)).cast("double"))


def y_shape(spark: SparkSession, n: int = 40, width: int = 24, depth: int = 12) -> DataFrame:
    """A trunk along x that parts into two arms halfway: v is 1.0 inside, else 0.0."""
    x, y, z = F.col("x"), F.col("y"), F.col("z") - depth // 2
    half, mid = n // 2, width // 2
    off = F.greatest(x - half, F.lit(0)) * 0.4
    arm = lambda s: F.pow(y - (F.lit(mid) + off * s), 2) + F.pow(z, 2) <= 6.5
    return grid(spark, n, width, depth).withColumn("v", (arm(1) | arm(-1)).cast("double"))


def tube_patches(spark: SparkSession, steps: int = 6, size: int = 8, stride: int = 3) -> DataFrame:
    """Overlapping crops along the tube: step_id, first index ix, iy, iz, sizes sx, sy, sz, radius."""
    i = F.col("id").cast("int")
    fixed = [F.lit(2).alias("iy"), F.lit(2).alias("iz"), F.lit(size).alias("sx"), F.lit(size).alias("sy"), F.lit(size).alias("sz")]
    return spark.range(steps).select(i.alias("step_id"), (i * stride).alias("ix"), *fixed, (F.lit(2.0) + F.lit(0.25) * i).alias("radius"))


def patch_voxels(patches: DataFrame, noise: int = 7) -> DataFrame:
    """The voxels step_id, i, j, k, v of patches: the tube's value, off by a known pattern so that crops disagree."""
    cells = patches.select("*", F.explode(F.sequence(F.lit(0), F.col("sx") * F.col("sy") * F.col("sz") - 1)).alias("c"))
    i, j, k = F.col("c") % F.col("sx"), F.floor(F.col("c") / F.col("sx")) % F.col("sy"), F.floor(F.col("c") / (F.col("sx") * F.col("sy")))
    cells = cells.select("step_id", i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), "iy", "iz")
    inside = F.pow(F.col("j") + F.col("iy") - 6, 2) + F.pow(F.col("k") + F.col("iz") - 6, 2) <= 9
    wave = ((F.col("i") * 3 + F.col("j") * 5 + F.col("k") * 2 + F.col("step_id")) % noise) / F.lit(10.0 * noise)
    return cells.select("step_id", "i", "j", "k", (inside.cast("double") * 0.9 + wave).alias("v"))


def forest(spark: SparkSession, branches: int = 9, length: int = 5) -> DataFrame:
    """A tree of branches: branch_id, pos, step_id, radius; position 0 is the step on the mother branch."""
    cells = spark.range(branches * (length + 1)).select((F.col("id") / (length + 1)).cast("int").alias("branch_id"), (F.col("id") % (length + 1)).cast("int").alias("pos"))
    mother = F.floor((F.col("branch_id") - 1) / 2).cast("int")
    step = F.when(F.col("pos") > 0, F.col("branch_id") * length + F.col("pos")).when(F.col("branch_id") == 0, F.lit(0)).otherwise(mother * length + 2 + F.col("branch_id") % 3)
    return cells.select("branch_id", "pos", step.cast("int").alias("step_id"), (F.lit(4.0) / (F.col("branch_id") + 1) + F.lit(0.1) * F.col("pos")).alias("radius"))
