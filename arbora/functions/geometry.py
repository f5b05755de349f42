"""Column builders for points, frames and crops.  A point is three columns; all angles are in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(prefix: str = "") -> Point:
    """The columns x, y and z with a prefix."""
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def plus_scaled(a: Point, b: Point, t: Column) -> Point:
    return a[0] + t * b[0], a[1] + t * b[1], a[2] + t * b[2]


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    return norm(minus(a, b))


def unit(a: Point, eps: float = 1e-12) -> Point:
    """``a`` at length one; +Z where it is shorter than ``eps``."""
    n = norm(a)
    ok = n >= eps
    return F.when(ok, F.try_divide(a[0], n)).otherwise(0.0), F.when(ok, F.try_divide(a[1], n)).otherwise(0.0), F.when(ok, F.try_divide(a[2], n)).otherwise(1.0)


def clamped_acos(c: Column) -> Column:
    """acos with its argument clamped to [-1, 1], so that rounding never gives NaN."""
    return F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def angle(a: Point, b: Point) -> Column:
    """The angle between two directions; null where one has no length."""
    return clamped_acos(F.try_divide(dot(a, b), norm(a) * norm(b)))


def perpendicular(t: Point) -> Point:
    """A unit vector at a right angle to ``t``: its product with the axis it is least along; +Y for no direction."""
    x, y, z = (F.abs(c) for c in t)
    axis = (
        F.when((x <= y) & (x <= z), 1.0).otherwise(0.0),
        F.when((y < x) & (y <= z), 1.0).otherwise(0.0),
        F.when((z < x) & (z < y), 1.0).otherwise(0.0),
    )
    c = cross(t, axis)
    n = norm(c)
    ok = n > 1e-12
    return F.when(ok, F.try_divide(c[0], n)).otherwise(0.0), F.when(ok, F.try_divide(c[1], n)).otherwise(1.0), F.when(ok, F.try_divide(c[2], n)).otherwise(0.0)


def segment_projection(p: Point, a: Point, b: Point) -> tuple[Column, Column]:
    """(distance from ``p`` to the segment ab, position of the foot from 0 to 1); a segment without length is ``a``."""
    ab = minus(b, a)
    size = dot(ab, ab)
    t = F.when(size < 1e-30, 0.0).otherwise(F.least(F.greatest(F.try_divide(dot(minus(p, a), ab), size), F.lit(0.0)), F.lit(1.0)))
    return distance(p, plus_scaled(a, ab, t)), t


def index_to_world(index: Point, spacing: tuple, origin: tuple, direction: tuple = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> Point:
    """origin + direction * (spacing * index); direction is row-major."""
    s = [i * F.lit(float(k)) for i, k in zip(index, spacing, strict=True)]
    return tuple(F.lit(float(origin[r])) + sum(s[c] * float(direction[3 * r + c]) for c in range(3)) for r in range(3))  # type: ignore[return-value]


def world_to_index(p: Point, spacing: tuple, origin: tuple, direction: tuple = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> Point:
    """The inverse of ``index_to_world``; direction must be a rotation."""
    d = [p[r] - F.lit(float(origin[r])) for r in range(3)]
    return tuple(sum(d[r] * float(direction[3 * r + c]) for r in range(3)) / F.lit(float(spacing[c])) for c in range(3))  # type: ignore[return-value]


def gaussian_axis(i: Column, n: Column, width: float = 0.25) -> Column:
    """The exponent of one axis of a patch's weight: half the squared place between -1 and 1 over ``width``, negative."""
    u = F.when(n > 1, F.lit(-1.0) + F.lit(2.0) * F.try_divide(i.cast("double"), (n - 1).cast("double"))).otherwise(-1.0)
    return F.lit(-0.5) * u * u / F.lit(width)


def gaussian_weight(local: Point, size: Point, width: float = 0.25) -> Column:
    return F.exp(sum((gaussian_axis(i, n, width) for i, n in zip(local, size, strict=True)), F.lit(0.0)))


def to_units(mm: Column | float, unit_name: str) -> Column:
    """A length in millimetres in the image's unit, mm or cm; other units and lengths that aren't positive raise."""
    if unit_name not in ("mm", "cm"):
        raise ValueError(f"unknown unit {unit_name!r}")
    c = mm if isinstance(mm, Column) else F.lit(float(mm))
    checked = F.when(c > 0, c).otherwise(F.raise_error(F.lit("a length must be positive")).cast("double"))
    return checked * F.lit(1.0 if unit_name == "mm" else 0.1)


def capped_spacing(spacing: Column, cap: Column) -> Column:
    """An array of spacings with each limited to ``cap``; null if none is over it."""
    out = F.transform(spacing, lambda s: F.least(s, cap))
    return F.when(out != spacing, out)


def crop_axis(centre: Column, radius: Column, ratio: Column, spacing: float, origin: float, size: int, least: int = 5, grow: float = 1.05) -> tuple[Column, Column, Column]:
    """(first index, size, outside) of one axis of the crop around a point.

    The crop is ``2 * radius * ratio`` wide, rounded up to voxels and grown by steps of ``grow`` to ``least``; what lies
    beyond the volume is cut off.  ``outside`` says that over a third of it did.
    """
    raw = F.ceil(F.lit(2.0) * radius * ratio / F.lit(spacing))
    steps = F.greatest(F.lit(0.0), F.ceil(F.log(F.lit(float(least)) / raw) / F.lit(math.log(grow))))
    wide = F.greatest(raw, F.when(raw < least, F.ceil(raw * F.pow(F.lit(grow), steps))).otherwise(raw)).cast("int")
    first = F.rint((centre - F.lit(origin)) / F.lit(spacing) - wide / F.lit(2.0)).cast("int")
    low = F.greatest(first, F.lit(0))
    high = F.least(first + wide, F.lit(size))
    kept = F.greatest(high - low, F.lit(0))
    return low, kept, (wide - kept) > wide / F.lit(3.0)


def calculation_number(n: Column, per_segment: int = 4, low: int = 8, high: int = 100) -> Column:
    """Samples of a path with ``n`` control points: ``per_segment`` for each segment and one more, within limits."""
    return F.when(n < 2, F.lit(high)).otherwise(F.least(F.greatest(n * per_segment - per_segment + 1, F.lit(low)), F.lit(high)))
