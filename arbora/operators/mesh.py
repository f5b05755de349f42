"""Surface meshes as tables: points (pid, x, y, z) and triangles (cid, a, b, c); ``mesh`` columns may stand before them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cross, dot, minus, norm, point, unit
from .graph import label_components, stored

AXES = ("x", "y", "z")


def triangles(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Triangles with their corners' coordinates a_x .. c_z."""
    out = cells
    for k in "abc":
        corner = points.select(F.col("pid").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in AXES])
        out = out.join(corner, k)
    return out


def _normal() -> tuple[Column, Column, Column]:
    return cross(minus(point("b_"), point("a_")), minus(point("c_"), point("a_")))


def edges(cells: DataFrame) -> DataFrame:
    """The edges u < v of all triangles and how many triangles have them."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])
    return cells.select(F.inline(pairs)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("cells"))


def boundary_edges(cells: DataFrame) -> DataFrame:
    """Edges of one triangle only."""
    return edges(cells).filter("cells = 1").select("u", "v")


def boundary_faces(tetrahedra: DataFrame) -> DataFrame:
    """The triangles that only one of the tetrahedra (a, b, c, d) has, by sorted corners."""
    face = lambda *k: F.sort_array(F.array(*k)).alias("f")
    rows = tetrahedra.select(F.explode(F.array(face("a", "b", "c"), face("a", "b", "d"), face("a", "c", "d"), face("b", "c", "d"))).alias("f"))
    return rows.groupBy("f").count().filter("count = 1").select(*[F.col("f")[i].alias(c) for i, c in enumerate("abc")])


def caps(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Each open boundary loop: cap (its smallest point), its number of points and their middle."""
    rim = stored(boundary_edges(cells), "rim")
    nodes = rim.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    loops = label_components(nodes, rim.select(F.col("u").alias("a"), F.col("v").alias("b")))
    at = loops.join(points.withColumnRenamed("pid", "node"), "node")
    return at.groupBy(F.col("component").alias("cap")).agg(F.count(F.lit(1)).alias("points"), *[F.avg(c).alias(c) for c in AXES])


def regions(points: DataFrame, cells: DataFrame) -> DataFrame:
    """The points with ``region``, the smallest point that triangles connect them to."""
    e = edges(cells)
    return label_components(points.select(F.col("pid").alias("node")), e.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("pid"), F.col("component").alias("region"))


def largest_region(points: DataFrame, cells: DataFrame) -> DataFrame:
    """The points of the region with most points, the smaller region among equals."""
    r = stored(regions(points, cells), "regions")
    best = r.groupBy("region").count().agg(F.max_by("region", F.struct("count", -F.col("region"))).alias("region"))
    return points.join(r.join(F.broadcast(best), "region", "left_semi"), "pid")  # one row


def nearest_region(points: DataFrame, cells: DataFrame, origin: tuple) -> DataFrame:
    """The points of the region that has the point nearest to ``origin``."""
    r = stored(regions(points, cells), "regions")
    d = sum((F.pow(F.col(c) - o, 2) for c, o in zip(AXES, origin, strict=True)), F.lit(0.0))
    best = points.join(r, "pid").agg(F.min_by("region", F.struct(d.alias("d"), "pid")).alias("region"))
    return points.join(r.join(F.broadcast(best), "region", "left_semi"), "pid")  # one row


def areas(points: DataFrame, cells: DataFrame) -> DataFrame:
    return triangles(points, cells).select("cid", (norm(_normal()) / 2.0).alias("area"))


def centroids(points: DataFrame, cells: DataFrame) -> DataFrame:
    return triangles(points, cells).select("cid", *[((F.col(f"a_{c}") + F.col(f"b_{c}") + F.col(f"c_{c}")) / 3.0).alias(c) for c in AXES])


def enclosed_volume(points: DataFrame, cells: DataFrame) -> DataFrame:
    """The volume inside a closed mesh, positive where its triangles turn outward."""
    return triangles(points, cells).agg((F.sum(dot(point("a_"), cross(point("b_"), point("c_")))) / 6.0).alias("volume"))


def point_normals(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Unit normals nx, ny, nz at the points: their triangles' normals, weighted by area."""
    n = _normal()
    rows = triangles(points, cells).select(F.explode(F.array("a", "b", "c")).alias("pid"), *[v.alias(f"n{c}") for v, c in zip(n, AXES, strict=True)])
    total = rows.groupBy("pid").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in AXES])
    return total.select("pid", *[v.alias(f"n{c}") for v, c in zip(unit(point("n")), AXES, strict=True)])


def cut_plane(points: DataFrame, cells: DataFrame, origin: tuple, normal: tuple) -> DataFrame:
    """The segments cid, p_x .. q_z in which triangles meet a plane; a triangle that only touches it gives none."""
    o, n = tuple(F.lit(float(c)) for c in origin), tuple(F.lit(float(c)) for c in normal)
    rows = triangles(points, cells)
    for k in "abc":
        rows = rows.withColumn(f"s{k}", dot(minus(point(f"{k}_"), o), n))  # type: ignore[arg-type]

    def meet(p: str, q: str) -> Column:
        t = F.try_divide(F.col(f"s{p}"), F.col(f"s{p}") - F.col(f"s{q}"))
        hit = (F.col(f"s{p}") >= 0) != (F.col(f"s{q}") >= 0)
        return F.when(hit, F.struct(*[(F.col(f"{p}_{c}") + t * (F.col(f"{q}_{c}") - F.col(f"{p}_{c}"))).alias(c) for c in AXES]))

    rows = rows.withColumn("m", F.array_compact(F.array(meet("a", "b"), meet("b", "c"), meet("a", "c")))).filter(F.size("m") == 2)
    return rows.select("cid", *[F.col("m")[i][c].alias(f"{e}_{c}") for i, e in enumerate("pq") for c in AXES])


def clipped_to_box(points: DataFrame, cells: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """The triangles whose corners are all inside a box."""
    inside = points
    for c, a, b in zip(AXES, low, high, strict=True):
        inside = inside.filter(F.col(c).between(a, b))
    return _with_all_corners(inside, cells)


def clipped_to_sphere(points: DataFrame, cells: DataFrame, centre: tuple, radius: float) -> DataFrame:
    """The triangles whose corners are all inside a sphere."""
    d = sum((F.pow(F.col(c) - o, 2) for c, o in zip(AXES, centre, strict=True)), F.lit(0.0))
    return _with_all_corners(points.filter(d <= radius * radius), cells)


def _with_all_corners(points: DataFrame, cells: DataFrame) -> DataFrame:
    ids = points.select("pid")
    for k in "abc":
        cells = cells.join(ids.withColumnRenamed("pid", k), k, "left_semi")
    return cells.select("cid", "a", "b", "c")


def appended(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One mesh of several, ids moved up behind those before."""
    points = cells = None
    next_p = next_c = 0
    for p, c in parts:
        p2 = p.withColumn("pid", F.col("pid") + F.lit(next_p))
        c2 = c.select((F.col("cid") + F.lit(next_c)).alias("cid"), *[(F.col(k) + F.lit(next_p)).alias(k) for k in "abc"])
        points, cells = (p2, c2) if points is None else (points.unionByName(p2), cells.unionByName(c2))
        next_p += (p.agg(F.max("pid")).first()[0] or 0) + 1
        next_c += (c.agg(F.max("cid")).first()[0] or 0) + 1
    return points, cells


def cleaned(points: DataFrame, cells: DataFrame, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """A mesh in which each place is one point (the smallest id) and no triangle has a corner twice."""
    key = [F.round(c, digits).alias(f"k{c}") for c in AXES]
    keyed = points.select("pid", *AXES, *key)
    first = keyed.groupBy("kx", "ky", "kz").agg(F.min("pid").alias("to"))
    to = stored(keyed.join(first, ["kx", "ky", "kz"]).select("pid", "to"), "merged")
    for k in "abc":
        cells = cells.join(to.select(F.col("pid").alias(k), F.col("to").alias(f"{k}2")), k).drop(k).withColumnRenamed(f"{k}2", k)
    cells = cells.filter("a <> b and b <> c and a <> c").select("cid", "a", "b", "c")
    return points.join(to.filter("pid = to").select("pid"), "pid", "left_semi"), cells


def taubin(points: DataFrame, cells: DataFrame, rounds: int = 10, shrink: float = 0.5, inflate: float = -0.51, store_every: int = 1) -> DataFrame:
    """Points after Taubin smoothing: each round moves them to their neighbours' mean by ``shrink``, then by ``inflate``.

    A round is two aggregations over the edges; the points are written to the shared folder every few rounds, so the
    plan stays short however many there are.
    """
    e = edges(cells)
    ring = stored(e.select(F.col("u").alias("pid"), F.col("v").alias("to")).unionByName(e.select(F.col("v").alias("pid"), F.col("u").alias("to"))), "ring")
    now = points.select("pid", *AXES)
    for r in range(rounds):
        for step in (shrink, inflate):
            mean = ring.join(now.withColumnRenamed("pid", "to"), "to").groupBy("pid").agg(*[F.avg(c).alias(f"m{c}") for c in AXES])
            now = now.join(mean, "pid", "left").select("pid", *[(F.col(c) + step * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in AXES])
        if (r + 1) % store_every == 0 or r + 1 == rounds:
            now = stored(now, "smooth")
    return now


def cotangent_weights(points: DataFrame, cells: DataFrame) -> DataFrame:
    """The weights u, v, w of the cotangent Laplacian: half the sum of the cotangents of the angles opposite each edge."""
    t = triangles(points, cells)
    parts = []
    for o, p, q in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b")):
        s, r = minus(point(f"{p}_"), point(f"{o}_")), minus(point(f"{q}_"), point(f"{o}_"))
        parts.append(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.try_divide(dot(s, r), norm(cross(s, r)) * 2.0).alias("w")))
    return t.select(F.inline(F.array(*parts))).groupBy("u", "v").agg(F.sum("w").alias("w"))


def voxel_surface(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The faces between foreground and background voxels: x, y, z, axis, side.  A mask's boundary without a kernel."""
    by = by or []
    own = mask.filter("v > 0").select(*by, "x", "y", "z")
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side"), *[(F.col(c) + (s if c == a else 0)).alias(f"n{c}") for c in AXES]) for a in AXES for s in (-1, 1)])
    faces = own.select("*", F.inline(sides))
    other = own.select(*by, *[F.col(c).alias(f"n{c}") for c in AXES])
    return faces.join(other, [*by, "nx", "ny", "nz"], "left_anti").select(*by, "x", "y", "z", "axis", "side")


def inside_closed_mesh(queries: DataFrame, points: DataFrame, cells: DataFrame, width: float) -> DataFrame:
    """Query points with ``inside``: the ray along +z crosses the mesh an odd number of times.  Triangles are put into
    the x, y squares that they cover, so the join is on equality."""
    t = triangles(points, cells)
    lo = lambda c: F.floor(F.least(*[f"{k}_{c}" for k in "abc"]) / width).cast("long")
    hi = lambda c: F.floor(F.greatest(*[f"{k}_{c}" for k in "abc"]) / width).cast("long")
    t = t.withColumn("bx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("by", F.explode(F.sequence(lo("y"), hi("y"))))
    asked = queries.withColumn("bx", F.floor(F.col("x") / width).cast("long")).withColumn("by", F.floor(F.col("y") / width).cast("long"))
    side = lambda p, q: (F.col(f"{q}_x") - F.col(f"{p}_x")) * (F.col("y") - F.col(f"{p}_y")) - (F.col(f"{q}_y") - F.col(f"{p}_y")) * (F.col("x") - F.col(f"{p}_x"))
    u, v, w = side("b", "c"), side("c", "a"), side("a", "b")
    area = u + v + w
    height = F.try_divide(u * F.col("a_z") + v * F.col("b_z") + w * F.col("c_z"), area)
    over = ((u >= 0) & (v >= 0) & (w >= 0) | (u <= 0) & (v <= 0) & (w <= 0)) & (area != 0) & (height > F.col("z"))
    hits = asked.join(t, ["bx", "by"]).filter(over).groupBy("query_id").agg(F.count_distinct("cid").alias("hits"))
    return queries.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) % 2 == 1).alias("inside"))


def sphere(level: int = 8) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A closed unit sphere of rings and sectors for tests: (points, triangles), outward."""
    rings, sectors = level, 2 * level
    rows = [(0.0, 0.0, 1.0)]
    for i in range(1, rings):
        for j in range(sectors):
            a, b = np.pi * i / rings, 2 * np.pi * j / sectors
            rows.append((np.sin(a) * np.cos(b), np.sin(a) * np.sin(b), np.cos(a)))
    rows.append((0.0, 0.0, -1.0))
    at = lambda i, j: 1 + (i - 1) * sectors + j % sectors
    tri = [(0, at(1, j), at(1, j + 1)) for j in range(sectors)]
    for i in range(1, rings - 1):
        for j in range(sectors):
            tri += [(at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1))]
    tri += [(len(rows) - 1, at(rings - 1, j + 1), at(rings - 1, j)) for j in range(sectors)]
    points = pd.DataFrame(rows, columns=["x", "y", "z"]).assign(pid=np.arange(len(rows)))
    cells = pd.DataFrame(tri, columns=["a", "b", "c"]).assign(cid=np.arange(len(tri)))
    return points[["pid", "x", "y", "z"]], cells[["cid", "a", "b", "c"]]
