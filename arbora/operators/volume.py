"""Voxel algebra: a volume is a DataFrame of x, y, z, v (and, for many volumes at once, key columns before them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import gaussian_weight

AXES = ("x", "y", "z")


def crop(volume: DataFrame, index: tuple, size: tuple) -> DataFrame:
    """The voxels of a box; the range filters reach the scan."""
    for c, i, n in zip(AXES, index, size, strict=True):
        volume = volume.filter(F.col(c).between(i, i + n - 1))
    return volume


def shifted(volume: DataFrame, index: tuple) -> DataFrame:
    """Global to local indices of a crop."""
    return volume.select(*[F.col(c) if c not in AXES else (F.col(c) - index[AXES.index(c)]).alias(c) for c in volume.columns])


def threshold(volume: DataFrame, low: float, high: float = float("inf")) -> DataFrame:
    """v becomes 1 within [low, high], else 0."""
    return volume.withColumn("v", F.col("v").between(low, high).cast("int"))


def mask_and(a: DataFrame, b: DataFrame, keys: tuple = AXES) -> DataFrame:
    """The voxels that both masks have."""
    return a.filter("v > 0").join(b.filter("v > 0").select(*keys), list(keys), "left_semi")


def bounding_box(mask: DataFrame, by: list[str] | None = None, pad: int = 0, size: tuple | None = None) -> DataFrame:
    """First and last index of the mask on each axis, padded within the volume."""
    out = []
    for k, c in enumerate(AXES):
        low, high = F.min(c) - pad, F.max(c) + pad
        if size:
            low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(size[k] - 1))
        out += [low.alias(f"{c}_min"), high.alias(f"{c}_max")]
    return mask.filter("v > 0").groupBy(*(by or [])).agg(*out)


def assembled(patches: DataFrame, voxels: DataFrame, mode: str = "gaussian", keys: list[str] | None = None, patch_limit: int = 100_000) -> DataFrame:
    """The weighted mean of overlapping patches: x, y, z, v, n_updates.

    A running mean with weights is the weighted sum over the sum of weights, whatever the order, so it is one aggregation
    with partial sums on the map side.  ``mode``: plain (weights 1), radius, inverse_square (of the radius) or gaussian.
    Patch descriptions are broadcast only if there are at most ``patch_limit`` of them; beyond, the join is shuffled.
    """
    keys = keys or []
    side = F.broadcast(patches) if patches.limit(patch_limit + 1).count() <= patch_limit else patches
    rows = voxels.join(side, [*keys, "step_id"])
    local, size = (F.col("i"), F.col("j"), F.col("k")), (F.col("sx"), F.col("sy"), F.col("sz"))
    weight = {"plain": lambda: F.lit(1.0), "radius": lambda: F.col("radius"), "inverse_square": lambda: F.lit(1.0) / (F.col("radius") * F.col("radius")), "gaussian": lambda: gaussian_weight(local, size)}[mode]()
    rows = rows.select(*keys, *[(F.col(a) + F.col(b)).alias(c) for a, b, c in zip("ijk", ("ix", "iy", "iz"), AXES, strict=True)], "v", weight.alias("w"))
    return rows.groupBy(*keys, *AXES).agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("v"), F.count(F.lit(1)).alias("n_updates"))


def touched_ratio(assembly: DataFrame, size: tuple) -> DataFrame:
    """The part of a volume's voxels that any patch touched."""
    return assembly.agg((F.count(F.lit(1)) / F.lit(float(size[0] * size[1] * size[2]))).alias("ratio"))


def gradient(volume: DataFrame, by: list[str] | None = None, spacing: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """Central differences gx, gy, gz, one-sided at the borders.  Each axis is a window over its own lines of voxels."""
    out = volume
    for c, s in zip(AXES, spacing, strict=True):
        others = [a for a in AXES if a != c]
        w = Window.partitionBy(*(by or []), *others).orderBy(c)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        g = F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2.0)
        out = out.withColumn(f"g{c}", g / F.lit(float(s)))
    return out


def second_differences(volume: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hxx, hyy, hzz: the gradient's gradient along the same axis."""
    out = gradient(volume, by)
    for c in AXES:
        w = Window.partitionBy(*(by or []), *[a for a in AXES if a != c]).orderBy(c)
        g, before, after = F.col(f"g{c}"), F.lag(f"g{c}").over(w), F.lead(f"g{c}").over(w)
        out = out.withColumn(f"h{c}{c}", F.when(before.isNull(), after - g).when(after.isNull(), g - before).otherwise((after - before) / 2.0))
    return out


def resampled_size(n: int, spacing: float, new_spacing: float) -> int:
    """Voxels of an axis at another spacing: rounded half to even, one at least."""
    return max(1, round(n * spacing / new_spacing))


def resample_nearest(volume: DataFrame, size: tuple, spacing: tuple, new_spacing: tuple) -> DataFrame:
    """A label volume at another spacing: each old voxel is copied to the new ones whose centres are nearest to it."""
    out = volume
    for c, n, s, t in zip(AXES, size, spacing, new_spacing, strict=True):
        m = resampled_size(n, s, t)
        ratio = t / s
        old = F.least(F.floor(F.col("m") * F.lit(ratio) + 0.5), F.lit(n - 1))
        table = out.sparkSession.range(m).select(F.col("id").cast("int").alias("m")).select(F.col("m").alias(f"new_{c}"), old.cast("int").alias(c))
        out = out.join(F.broadcast(table), c).drop(c).withColumnRenamed(f"new_{c}", c)  # one row a voxel of an axis
    return out.select(*[c for c in volume.columns])


def resample_linear(volume: DataFrame, size: tuple, spacing: tuple, new_spacing: tuple) -> DataFrame:
    """A scalar volume at another spacing by trilinear interpolation, an axis at a time."""
    keys = [c for c in volume.columns if c not in (*AXES, "v")]
    out = volume
    for c, n, s, t in zip(AXES, size, spacing, new_spacing, strict=True):
        m, ratio = resampled_size(n, s, t), t / s
        place = F.least(F.col("m") * F.lit(ratio), F.lit(float(n - 1)))
        low = F.floor(place)
        ends = F.array(F.struct(low.cast("int").alias(c), (F.lit(1.0) - (place - low)).alias("w")), F.struct((low + 1).cast("int").alias(c), (place - low).alias("w")))
        table = out.sparkSession.range(m).select(F.col("id").cast("int").alias("m")).select(F.col("m").alias(f"new_{c}"), F.inline(ends)).filter("w > 0")
        others = [a for a in AXES if a != c]
        part = out.join(F.broadcast(table), c).groupBy(*keys, *others, f"new_{c}").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        out = part.withColumnRenamed(f"new_{c}", c)
    return out.select(*volume.columns)


def rescaled_ct(volume: DataFrame, limits: tuple = (-800.0, 800.0)) -> DataFrame:
    """Intensities clipped to ``limits`` and brought to their half range; other units stay."""
    low, high = limits
    return volume.withColumn("v", F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high)) / F.lit((high - low) / 2.0))


def rescaled_mr(volume: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Intensities clipped to their 20th to 99th percentiles and brought to -1 .. 1 (one where they don't differ)."""
    ends = volume.groupBy(*(by or [])).agg(F.percentile("v", F.lit(0.2)).alias("lo"), F.percentile("v", F.lit(0.99)).alias("hi"))
    rows = volume.join(F.broadcast(ends), by) if by else volume.crossJoin(F.broadcast(ends))  # one row a volume
    v = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi")) - F.col("lo").cast("int")
    return rows.withColumn("v", F.coalesce(F.try_divide(v * 2.0, F.col("hi") - F.col("lo")), F.lit(2.0)) - 1.0).drop("lo", "hi")


def border_faces(mask: DataFrame, index: tuple, size: tuple, volume_size: tuple) -> DataFrame:
    """For each face of a crop that lies on the volume's border, whether foreground touches it: face, touches."""
    faces: list[Column] = []
    for c, i, n, m in zip(AXES, index, size, volume_size, strict=True):
        if i == 0:
            faces.append(F.when(F.col(c) == 0, F.lit(f"{c}_low")))
        if i + n >= m:
            faces.append(F.when(F.col(c) == n - 1, F.lit(f"{c}_high")))
    names = [f"{c}_low" for c, i in zip(AXES, index, strict=True) if i == 0] + [f"{c}_high" for c, i, n, m in zip(AXES, index, size, volume_size, strict=True) if i + n >= m]
    hit = mask.filter("v > 0").select(F.explode(F.array_compact(F.array(*faces) if faces else F.array().cast("array<string>"))).alias("face")).distinct().withColumn("hit", F.lit(True))
    every = mask.sparkSession.createDataFrame([(n,) for n in sorted(names)], "face string")
    return every.join(F.broadcast(hit), "face", "left").select("face", F.coalesce("hit", F.lit(False)).alias("touches"))  # six faces


def component_statistics(labelled: DataFrame, spacing: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """Per label: voxels, physical size, mean value."""
    unit = float(spacing[0] * spacing[1] * spacing[2])
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("voxels"), (F.count(F.lit(1)) * F.lit(unit)).alias("physical_size"), F.avg("v").alias("mean_v"))


def deepest_voxel(labelled: DataFrame, depth: str = "v") -> DataFrame:
    """Per label, the voxel of the largest ``depth``, the first in scan order (x, y, z) among equals; labels whose largest
    is not positive give nothing."""
    best = F.max_by(F.struct(*AXES), F.struct(F.col(depth), *[(-F.col(c)).alias(f"m{c}") for c in AXES]))
    return labelled.groupBy("label").agg(best.alias("p"), F.max(depth).alias("depth")).filter("depth > 0").select("label", "p.*", "depth")
