"""Spatial joins by binning: points within a radius, nearest points, nearest segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle, distance, minus, point, segment_projection
from .graph import stored

AXES = ("x", "y", "z")


def _bin(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width))).cast("long")


def within(queries: DataFrame, points: DataFrame, radius: float, query_id: str = "query_id", point_id: str = "point_id") -> DataFrame:
    """All pairs (query_id, point_id, distance) within ``radius``.

    Both sides are keyed by cubes of the radius' size; a query asks its cube and the 26 around it, so the join is on
    equality and its work follows the number of near pairs, not the product of the sides.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    own = points.select(F.col(point_id), *[F.col(c).alias(f"p_{c}") for c in AXES], *[_bin(F.col(c), radius).alias(f"b{c}") for c in AXES])
    around = [F.explode(F.sequence(_bin(F.col(c), radius) - 1, _bin(F.col(c), radius) + 1)).alias(f"b{c}") for c in AXES]
    asked = queries.select(query_id, *AXES)
    for a, c in zip(around, AXES, strict=True):
        asked = asked.select("*", a) if c == "x" else asked.select("*", a)
    d = distance(point(), point("p_"))
    return asked.join(own, [f"b{c}" for c in AXES]).withColumn("distance", d).filter(F.col("distance") <= radius).select(query_id, point_id, "distance")


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, start: float = 1.0, query_id: str = "query_id", point_id: str = "point_id", most_rounds: int = 24) -> DataFrame:
    """The ``k`` nearest points of every query: query_id, rank, point_id, distance; ties to the smaller point.

    Radii double from ``start``; a query is done once k points are within the radius, and only open queries go on, so
    sparse regions don't widen the search of dense ones.
    """
    n = points.count()
    need, open_, out, radius = min(k, n), queries, None, start
    w = Window.partitionBy(query_id).orderBy("distance", point_id)
    for _ in range(most_rounds):
        if need == 0:
            break
        near = within(open_, points, radius, query_id, point_id).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        enough = near.filter(F.col("rank") == need).select(query_id)
        done = near.join(enough, query_id, "left_semi")
        out = done if out is None else out.unionByName(done)
        open_ = open_.join(enough, query_id, "left_anti")
        if open_.isEmpty():
            break
        radius *= 2
    if out is None:
        return queries.sparkSession.createDataFrame([], f"{query_id} long, rank int, {point_id} long, distance double")
    return out.select(query_id, "rank", point_id, "distance")


def _cubes(at: tuple, radius: float | Column) -> list[Column]:
    """The cube of a place, of 1.6 radii: places within 1.5 radii on an axis are in the same or neighbouring cubes."""
    edge = F.lit(1.6) * radius
    return [F.floor(F.least(F.greatest(c / edge, F.lit(-4e18)), F.lit(4e18))) for c in at]


def _along_segment(f: Column) -> tuple:
    return tuple(F.col(f"a{c}") + f * (F.col(f"b{c}") - F.col(f"a{c}")) for c in AXES)


def _segment_radii(queries: DataFrame, segments: DataFrame, radius: float, most_levels: int = 13) -> list[float]:
    """Radii to search by in turn, four times the one before each and ``radius`` last.

    The first is the widest of radius / 4^k whose work is at most 64 rows a query and segment, or that with the least
    work.  Work is counted over all rows: pieces of segments, and queries times pieces in their cube.
    """
    size = distance(tuple(F.col(f"a{c}") for c in AXES), tuple(F.col(f"b{c}") for c in AXES))  # type: ignore[arg-type]
    asked = queries.select(*AXES, F.lit(1.0).alias("q"), F.lit(0.0).alias("n"), F.lit(0.0).alias("len"))
    cut = segments.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in (0.125, 0.375, 0.625, 0.875)])))
    cut = cut.select(*[v.alias(c) for v, c in zip(_along_segment(F.col("_f")), AXES, strict=True)], F.lit(0.0).alias("q"), F.lit(0.25).alias("n"), (size / 4).alias("len"))
    rows = asked.unionByName(cut).withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(most_levels)])))
    rows = rows.withColumn("r", F.lit(float(radius)) / F.pow(F.lit(4.0), F.col("level")))
    far = F.greatest(*[F.abs(F.col(c)) for c in AXES])
    cells = rows.groupBy("level", F.xxhash64(*_cubes(point(), F.col("r"))).alias("cube")).agg(F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum("len").alias("len"), F.max("r").alias("r"), F.max(far).alias("far"))
    cells = cells.groupBy("level").agg(F.max("r").alias("r"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum("len").alias("len"), F.max("far").alias("far"), F.sum(F.col("q") * (F.col("n") + F.col("len") / F.col("r"))).alias("pairs"))
    # too narrow a radius would drown in the rounding of coordinates
    levels = [x for x in cells.orderBy("level").collect() if x.level == 0 or x.r > max(1e-9, 1e-12 * x.far)]
    if not levels:
        return [float(radius)]
    work = [x.n + x.len / x.r + 27 * x.pairs for x in levels]
    enough = max(min(work), 64 * (levels[0].q + levels[0].n))
    first = next(k for k, w in enumerate(work) if w <= enough)
    return [float(radius) / 4**k for k in range(first, -1, -1)]


def nearest_segment(queries: DataFrame, segments: DataFrame, radius: float, query_id: str = "query_id", segment_id: str = "segment_id") -> DataFrame:
    """The nearest segment (ax .. bz) within ``radius`` of every query: query_id, segment_id, distance, t; the smaller
    segment where distances agree to 12 places.

    Narrow radii come first: a query is done once a segment is within the radius, and only open queries go on.  The
    first radius follows from how dense queries and segments are.  A segment is put into every cube along it, so long
    segments cost rows in proportion to their length.  Queries of one place and segments of the same ends count once.
    Coordinates that are null or not finite are near nothing.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    ends = [f"{e}{c}" for e in "ab" for c in AXES]

    def finite(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.filter(" AND ".join(f"abs(`{c}`) < double('Infinity')" for c in columns))

    d64 = lambda columns: [F.col(c).cast("double").alias(c) for c in columns]
    every = stored(finite(queries.select(F.col(query_id).alias("query"), *d64(AXES)), list(AXES)), "queries")
    lines = finite(segments.select(F.col(segment_id).alias("segment"), *d64(ends)), ends)
    lines = stored(lines.groupBy(*ends).agg(F.min("segment").alias("segment")), "segments")
    open_ = every.select(*AXES).distinct()
    radii = _segment_radii(every, lines, radius)
    size = distance(tuple(F.col(f"a{c}") for c in AXES), tuple(F.col(f"b{c}") for c in AXES))  # type: ignore[arg-type]
    d, t = segment_projection(point(), tuple(F.col(f"a{c}") for c in AXES), tuple(F.col(f"b{c}") for c in AXES))  # type: ignore[arg-type]
    cube = [f"_{c}" for c in AXES]
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    out = None
    for r in radii:
        # places along a segment are a radius apart at most, so one of them is within 1.5 radii of any query that is near
        steps = F.greatest(F.ceil(size / F.lit(r)).cast("int"), F.lit(1))
        cut = lines.withColumn("_n", steps).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n"))))
        here, before = (_cubes(_along_segment((F.col("_t") - k) / F.col("_n")), F.lit(r)) for k in (0, 1))
        cut = cut.filter((F.col("_t") == 0) | ~(F.struct(*here) == F.struct(*before)))
        cut = cut.select("segment", *ends, F.xxhash64(*here).alias("_cube"))
        asked = open_.select(*AXES, *[v.alias(c) for v, c in zip(_cubes(point(), F.lit(r)), cube, strict=True)])
        for c in cube:
            asked = asked.withColumn(f"{c}k", F.explode(around)).withColumn(c, F.col(c) + F.col(f"{c}k")).drop(f"{c}k")
        asked = asked.select(*AXES, F.xxhash64(*cube).alias("_cube"))
        hit = asked.join(cut.hint("merge"), "_cube").select(*AXES, "segment", d.alias("distance"), t.alias("t")).filter(F.col("distance") <= r)
        best = hit.groupBy(*AXES).agg(F.min_by(F.struct("segment", "distance", "t"), F.struct(F.round("distance", 12), "segment")).alias("s"))
        if r == radii[-1]:
            found = best
        else:
            # just under the radius, another segment may be as near in 12 places and over it
            near = stored(best.filter(F.col("s.distance") <= r * (1 - 1e-9) - 2e-12), "near")
            open_ = stored(open_.join(near, list(AXES), "left_anti"), "open")
            found = near
        out = found if out is None else out.unionByName(found)
        if r != radii[-1] and open_.isEmpty():
            break
    rows = every.join(out, list(AXES)).groupBy("query").agg(F.min_by("s", F.struct(F.round("s.distance", 12), "s.segment")).alias("s"))
    return rows.select(F.col("query").alias(query_id), F.col("s.segment").alias(segment_id), "s.distance", "s.t")


def inverse_radius_bins(radius: float, spacing: float) -> int:
    """Cubes of ``spacing`` that a radius spans, rounded up."""
    return math.ceil(radius / spacing)


def oriented_caps(caps: DataFrame, old: tuple, direction: tuple, by: str = "case") -> DataFrame:
    """Caps in order: the source (nearest to the old point) first, the others by their angle to ``direction``."""
    here = tuple(F.lit(float(c)) for c in old)
    way = tuple(F.lit(float(c)) for c in direction)
    rows = caps.withColumn("distance", distance(point(), here)).withColumn("angle", angle(minus(point(), here), way))  # type: ignore[arg-type]
    near = F.row_number().over(Window.partitionBy(by).orderBy("distance", "cap_id"))
    rows = rows.withColumn("source", near == 1)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("source"), F.asc_nulls_last("angle"), "cap_id"))
    return rows.withColumn("place", place)
