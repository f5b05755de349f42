"""Seeds of traces: from points and directions, from centerlines, checked against the volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point, unit
from ..operators import polyline

AXES = ("x", "y", "z")


def seeds_at_points(points: DataFrame, step: float = 1.0) -> DataFrame:
    """Points (x, y, z, radius and, if known, tx, ty, tz) as seeds: the old point lies ``step`` before them against their
    unit direction, +Z where there's none."""
    rows = points
    for c in AXES:
        if f"t{c}" not in rows.columns:
            rows = rows.withColumn(f"t{c}", F.lit(0.0))
    t = unit(point("t"))
    rows = rows.select("*", *[v.alias(f"u{c}") for v, c in zip(t, AXES, strict=True)])
    return rows.select(*points.columns, *[(F.col(c) - F.lit(step) * F.col(f"u{c}")).alias(f"old_{c}") for c in AXES])


def seeds_on_longest(lines: DataFrame, branches: int, place: int, from_end: bool = False, gap: int = 2) -> DataFrame:
    """A seed on each of the ``branches`` longest lines: its ``place``-th point (from the end, if so asked) is the old
    point and the point ``gap`` further on the new one, whose radius it takes; shorter lines use their last points."""
    rank = polyline.longest_first(lines).filter(F.col("rank") <= branches).select("line_id", "rank")
    w = Window.partitionBy("line_id").orderBy(F.desc("seq") if from_end else F.asc("seq"))
    rows = lines.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("line_id")))
    at = rows.join(F.broadcast(rank), "line_id")  # ``branches`` rows
    new = F.least(F.lit(place + gap), F.col("_n") - 1)
    old = F.greatest(new - gap, F.lit(0))
    one = at.filter(F.col("_p") == old).select("line_id", "rank", *[F.col(c).alias(f"old_{c}") for c in AXES])
    two = at.filter(F.col("_p") == new).select("line_id", *AXES, "radius")
    return one.join(two, "line_id")


def outside_volume(seeds: DataFrame, size: tuple, spacing: tuple = (1.0, 1.0, 1.0), origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """The seeds of which a point's nearest voxel isn't in the volume."""
    bad = F.lit(False)
    for p in ("", "old_"):
        for c, n, s, o in zip(AXES, size, spacing, origin, strict=True):
            i = F.rint((F.col(f"{p}{c}") - o) / s)
            bad = bad | (i < 0) | (i > n - 1) | i.isNull()
    return seeds.filter(bad)


def checked(seeds: DataFrame, size: tuple, spacing: tuple = (1.0, 1.0, 1.0), origin: tuple = (0.0, 0.0, 0.0), shown: int = 20) -> DataFrame:
    """``seeds`` if all lie in the volume; else a ValueError that says how many don't, and lists the first of them."""
    bad = outside_volume(seeds, size, spacing, origin)
    n = bad.count()
    if n:
        raise ValueError(f"{n} seeds lie outside the volume: " + "; ".join(str(r.asDict()) for r in bad.limit(shown).collect()))
    return seeds
