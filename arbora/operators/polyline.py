"""Ordered polylines: rows of a line key, an order column and x, y, z.  Every operator is windows over one line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import distance, minus, point, unit

AXES = ("x", "y", "z")


def along(line: str, order: str) -> WindowSpec:
    return Window.partitionBy(line).orderBy(order)


def _moved(w: WindowSpec, by: int) -> tuple[Column, Column, Column]:
    return tuple((F.lag(c, by) if by > 0 else F.lead(c, -by)).over(w) for c in AXES)  # type: ignore[return-value]


def arc_length(points: DataFrame, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Adds ``step`` (distance to the point before, 0 at the first) and ``arc`` (distance along the line)."""
    w = along(line, order)
    step = F.coalesce(distance(point(), _moved(w, 1)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("arc", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def lengths(points: DataFrame, line: str = "line_id", order: str = "seq", closed: bool = False) -> DataFrame:
    """Per line: points and length; a closed line counts the way back to its first point."""
    rows = arc_length(points, line, order)
    out = rows.groupBy(line).agg(F.count(F.lit(1)).alias("points"), F.sum("step").alias("length"), F.min_by(F.struct(*AXES), order).alias("first"), F.max_by(F.struct(*AXES), order).alias("last"))
    if closed:
        back = F.sqrt(sum((F.pow(F.col(f"first.{c}") - F.col(f"last.{c}"), 2) for c in AXES), F.lit(0.0)))
        out = out.withColumn("length", F.col("length") + back)
    return out.drop("first", "last")


def longest_first(points: DataFrame, line: str = "line_id", order: str = "seq", places: int | None = None) -> DataFrame:
    """Per line its length (rounded to ``places``, if given) and rank, the longest first, ties to the smaller line.  Lines
    whose rounded lengths agree tie.  The rank is over one row a line."""
    out = lengths(points, line, order)
    if places is not None:
        out = out.withColumn("length", F.round("length", places))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("length"), line)))


def tangents(points: DataFrame, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Adds the unit direction tx, ty, tz: central differences, one-sided at the ends, +Z where points coincide."""
    w = along(line, order)
    before, after = _moved(w, 1), _moved(w, -1)
    here = point()
    d = minus(tuple(F.coalesce(a, h) for a, h in zip(after, here, strict=True)), tuple(F.coalesce(b, h) for b, h in zip(before, here, strict=True)))  # type: ignore[arg-type]
    out = points
    for c, t in zip(AXES, unit(d), strict=True):
        out = out.withColumn(f"t{c}", t)
    return out


def without_repeats(points: DataFrame, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Each place of a line once, where it comes first."""
    w = Window.partitionBy(line, *AXES).orderBy(order)
    return points.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resample(points: DataFrame, count: int, line: str = "line_id", order: str = "seq", also: tuple = ("radius",)) -> DataFrame:
    """``count`` points evenly spaced along each line, and the columns ``also``, by linear interpolation.

    Each stretch between two points makes the samples that fall into it, so a line never gathers in one place.
    """
    if count < 2:
        raise ValueError("two samples at least")
    extra = [c for c in also if c in points.columns]
    w = along(line, order)
    rows = arc_length(points, line, order)
    total = F.max("arc").over(Window.partitionBy(line))
    rows = rows.withColumn("total", total).withColumn("next_arc", F.lead("arc").over(w))
    for c in (*AXES, *extra):
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(w))
    gap = F.try_divide(F.col("total"), F.lit(float(count - 1)))
    first = F.when(F.col("arc") == 0, F.lit(0)).otherwise(F.floor(F.try_divide(F.col("arc"), gap) + 1e-9).cast("int") + 1)
    last = F.when(F.col("next_arc") >= F.col("total"), F.lit(count - 1)).otherwise(F.floor(F.try_divide(F.col("next_arc"), gap) + 1e-9).cast("int"))
    pieces = rows.filter("next_arc > arc").withColumn("sample", F.explode(F.when(last >= first, F.sequence(first, last))))
    t = F.try_divide(F.col("sample") * gap - F.col("arc"), F.col("next_arc") - F.col("arc"))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return pieces.select(line, "sample", *[(F.col(c) + t * (F.col(f"next_{c}") - F.col(c))).alias(c) for c in (*AXES, *extra)])


def wide_end_first(points: DataFrame, line: str = "line_id", order: str = "seq", radius: str = "radius") -> DataFrame:
    """Lines turned so that the first radius isn't under the last; the order is renumbered from 0."""
    w = along(line, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.first(radius).over(w) < F.last(radius).over(w)
    place = F.row_number().over(along(line, order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(line))
    return points.withColumn("_t", turn).withColumn("_p", place).withColumn("_n", n).withColumn(order, F.when(F.col("_t"), F.col("_n") - 1 - F.col("_p")).otherwise(F.col("_p")).cast("int")).drop("_t", "_p", "_n")


def evenly_placed(points: DataFrame, positions: int, line: str = "line_id", order: str = "seq") -> DataFrame:
    """The points at ``positions`` even places of each line, by index: line, position, order and coordinates."""
    n = F.count(F.lit(1)).over(Window.partitionBy(line))
    rows = points.withColumn("_p", F.row_number().over(along(line, order)) - 1).withColumn("_n", n)
    marks = F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda k: F.struct(k.alias("position"), F.floor(k * (F.col("_n") - 1) / F.lit(max(positions - 1, 1))).cast("int").alias("at")))
    hit = rows.withColumn("_m", F.explode(F.filter(marks, lambda m: m["at"] == F.col("_p"))))
    return hit.select(line, F.col("_m.position").alias("position"), order, *AXES)


def moving_average(points: DataFrame, reach: int = 1, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Coordinates averaged over ``reach`` points each way; the ends stay."""
    w = along(line, order)
    span = w.rowsBetween(-reach, reach)
    ends = F.lag("x").over(w).isNull() | F.lead("x").over(w).isNull()
    return points.select(*[F.when(ends, F.col(c)).otherwise(F.avg(c).over(span)).alias(c) if c in AXES else F.col(c) for c in points.columns])


def smooth_closed(points: DataFrame, passes: int = 12, relaxation: float = 0.2, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Closed loops after cyclic Laplacian passes: each point moves to its neighbours' middle by ``relaxation`` (0.5 at
    most).  Passes depend on each other, so a loop, which is one contour, is smoothed in one piece."""
    a = min(relaxation, 0.5)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        p = rows[list(AXES)].to_numpy(float)
        for _ in range(passes):
            p = p + a * ((np.roll(p, 1, 0) + np.roll(p, -1, 0)) / 2 - p)
        return rows[[line, order]].assign(x=p[:, 0], y=p[:, 1], z=p[:, 2])

    kinds = dict(points.dtypes)
    return points.select(line, order, *AXES).groupBy(line).applyInPandas(run, f"{line} {kinds[line]}, {order} {kinds[order]}, x double, y double, z double")


def rotated_to(points: DataFrame, anchor: tuple, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Closed loops renumbered from the point nearest to ``anchor``."""
    d = distance(point(), tuple(F.lit(float(c)) for c in anchor))  # type: ignore[arg-type]
    place, n = F.row_number().over(along(line, order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(line))
    rows = points.withColumn("_p", place).withColumn("_n", n).withColumn("_d", d)
    start = F.min_by("_p", F.struct("_d", "_p")).over(Window.partitionBy(line))
    return rows.withColumn(order, F.pmod(F.col("_p") - start, F.col("_n")).cast("int")).drop("_p", "_n", "_d")
