"""Registered queries of the library's own operators, each with its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import naming
from .operators import graph, kernels, mesh, metrics, polyline, sampling, spatial, tree, volume
from .plans import assembly, centerline, seeds, tracing
from .plans.config import preset
from .sources import phantoms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Inputs as SQL.
TUBE = "tube AS (SELECT (range % 24)::INT x, ((range // 24) % 12)::INT y, (range // 288)::INT z, CASE WHEN ((range // 24) % 12 - 6)^2 + (range // 288 - 6)^2 <= 9 THEN 1.0 ELSE 0.0 END::DOUBLE v FROM range(3456))"
PATCHES = "patches AS (SELECT range::INT step_id, (range * 3)::INT ix, 2 iy, 2 iz, 8 sx, 8 sy, 8 sz, 2.0::DOUBLE + 0.25::DOUBLE * range radius FROM range(6))"
PVOX = PATCHES + ", pvox AS (SELECT *, (CASE WHEN (j + iy - 6)^2 + (k + iz - 6)^2 <= 9 THEN 0.9::DOUBLE ELSE 0 END) + ((i * 3 + j * 5 + k * 2 + step_id) % 7) / 70.0::DOUBLE v FROM (SELECT *, (c % 8)::INT i, ((c // 8) % 8)::INT j, (c // 64)::INT k FROM patches, (SELECT range c FROM range(512))))"
BLOBS = "blobs AS (SELECT x, y, z, CASE WHEN least(x, y, z) >= 1 AND greatest(x, y, z) <= 3 THEN 1 WHEN least(x, y, z) >= 4 AND greatest(x, y, z) <= 6 THEN 2 WHEN least(x, y, z) >= 9 AND greatest(x, y, z) <= 10 THEN 3 ELSE 0 END b FROM (SELECT (range % 12)::INT x, ((range // 12) % 12)::INT y, (range // 144)::INT z FROM range(1728)))"
LINES = "lines AS (SELECT user_id line_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT seq, value::DOUBLE x, (event_id % 97)::DOUBLE y, (user_id % 13)::DOUBLE z, (1 + event_id % 5)::DOUBLE radius FROM events)"
FOREST = "forest AS (SELECT b branch_id, p pos, (CASE WHEN p > 0 THEN b * 5 + p WHEN b = 0 THEN 0 ELSE ((b - 1) // 2) * 5 + 2 + b % 3 END)::INT step_id, 4.0::DOUBLE / (b + 1) + 0.1::DOUBLE * p radius FROM (SELECT (range // 6)::INT b, (range % 6)::INT p FROM range(54)))"
EDGES = FOREST + ", edges AS (SELECT DISTINCT branch_id, parent, child FROM (SELECT branch_id, step_id parent, lead(step_id) OVER (PARTITION BY branch_id ORDER BY pos) child FROM forest) WHERE child IS NOT NULL AND child <> parent)"
POINTS = "pts AS (SELECT vec_id point_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z FROM embeddings)"
TORUS_N, TORUS_M = 24, 12
TORUS = f"""mp AS (SELECT range pid, (2 + cos(2 * pi() * (range % {TORUS_M}) / {TORUS_M})) * cos(2 * pi() * (range // {TORUS_M}) / {TORUS_N}) x, (2 + cos(2 * pi() * (range % {TORUS_M}) / {TORUS_M})) * sin(2 * pi() * (range // {TORUS_M}) / {TORUS_N}) y, sin(2 * pi() * (range % {TORUS_M}) / {TORUS_M}) z FROM range({TORUS_N * TORUS_M})),
 q AS (SELECT range r, (range // {TORUS_M}) * {TORUS_M} + range % {TORUS_M} p00, ((range // {TORUS_M} + 1) % {TORUS_N}) * {TORUS_M} + range % {TORUS_M} p10, (range // {TORUS_M}) * {TORUS_M} + (range + 1) % {TORUS_M} p01, ((range // {TORUS_M} + 1) % {TORUS_N}) * {TORUS_M} + (range + 1) % {TORUS_M} p11 FROM range({TORUS_N * TORUS_M})),
 mc AS (SELECT 2 * r cid, p00 a, p10 b, p11 c FROM q UNION ALL SELECT 2 * r + 1, p00, p11, p01 FROM q),
 t AS (SELECT cid, a, b, c, A.x ax, A.y ay, A.z az, B.x bx, B.y byy, B.z bz, C.x cx, C.y cy, C.z cz FROM mc JOIN mp A ON A.pid = a JOIN mp B ON B.pid = b JOIN mp C ON C.pid = c)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a polyline in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = lambda c: c.cast("double")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("line_id"), (F.row_number().over(w) - 1).alias("seq"), d(F.col("value")).alias("x"), d(F.col("event_id") % 97).alias("y"), d(F.col("user_id") % 13).alias("z"), d(1 + F.col("event_id") % 5).alias("radius"))


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of the embeddings as points."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def torus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    n, m = TORUS_N, TORUS_M
    i, j = F.floor(F.col("id") / m), F.col("id") % m
    a, b = 2 * F.pi() * j / m, 2 * F.pi() * i / n
    points = spark.range(n * m).select(F.col("id").alias("pid"), ((2 + F.cos(a)) * F.cos(b)).alias("x"), ((2 + F.cos(a)) * F.sin(b)).alias("y"), F.sin(a).alias("z"))
    at = lambda p, q: ((i + p) % n) * m + (F.col("id") + q) % m
    tri = lambda k, *c: F.struct((F.col("id") * 2 + k).alias("cid"), *[v.cast("long").alias(name) for v, name in zip(c, "abc", strict=True)])
    cells = spark.range(n * m).select(F.inline(F.array(tri(0, at(0, 0), at(1, 0), at(1, 1)), tri(1, at(0, 0), at(1, 1), at(0, 1)))))
    return points, cells


def r6(c):
    return F.round(c, 6)


# volumes


@query(f"WITH {TUBE} SELECT x, count(*) voxels, sum(v) inside FROM tube GROUP BY x")
def vol_tube_profile(spark, sf_dir):
    return phantoms.tube(spark).groupBy("x").agg(F.count(F.lit(1)).alias("voxels"), F.sum("v").alias("inside"))


@query(f"WITH {TUBE} SELECT (x - 3)::INT x, (y - 2)::INT y, (z - 4)::INT z, v FROM tube WHERE x BETWEEN 3 AND 10 AND y BETWEEN 2 AND 8 AND z BETWEEN 4 AND 8")
def vol_crop(spark, sf_dir):
    return volume.shifted(volume.crop(phantoms.tube(spark), (3, 2, 4), (8, 7, 5)), (3, 2, 4))


@query(f"WITH {PVOX}, a AS (SELECT i + ix x, j + iy y, k + iz z, sum(v) / count(*) v FROM pvox GROUP BY ALL) SELECT (v >= 0.5)::INT v, count(*) n FROM a GROUP BY 1")
def vol_threshold(spark, sf_dir):
    p = phantoms.tube_patches(spark)
    a = volume.assembled(p, phantoms.patch_voxels(p), "plain")
    return volume.threshold(a, 0.5).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def _assembly(mode: str):
    def run(spark, sf_dir):
        p = phantoms.tube_patches(spark)
        a = volume.assembled(p, phantoms.patch_voxels(p), mode)
        return a.select("x", "y", "z", r6("v").alias("v"), "n_updates")

    run.__name__ = f"vol_assembly_{mode}"
    w = {"plain": "1.0", "radius": "radius", "inverse_square": "1.0 / (radius * radius)", "gaussian": "exp(-0.5 * (((2.0 * i / 7 - 1)^2 + (2.0 * j / 7 - 1)^2 + (2.0 * k / 7 - 1)^2) / 0.25))"}[mode]
    query(f"WITH {PVOX}, w AS (SELECT *, ({w})::DOUBLE w FROM pvox) SELECT (i + ix)::INT x, (j + iy)::INT y, (k + iz)::INT z, round(sum(w * v) / sum(w), 6) v, count(*) n_updates FROM w GROUP BY 1, 2, 3")(run)


for _mode in ("plain", "radius", "inverse_square", "gaussian"):
    _assembly(_mode)


@query(f"WITH {PVOX}, w AS (SELECT *, exp(-0.5 * (((2.0 * i / 7 - 1)^2 + (2.0 * j / 7 - 1)^2 + (2.0 * k / 7 - 1)^2) / 0.25)) w FROM pvox), a AS (SELECT i + ix x, j + iy y, k + iz z, sum(w * v) / sum(w) v, count(*) n_updates FROM w GROUP BY 1, 2, 3) SELECT n_updates, count(*) voxels, sum((v >= 0.5)::BIGINT)::BIGINT foreground, round(avg(v), 6) mean_v FROM a GROUP BY 1")
def vol_assembly_summary(spark, sf_dir):
    p = phantoms.tube_patches(spark)
    return assembly.assembly_summary(p, phantoms.patch_voxels(p))


@query(f"WITH {PVOX} SELECT count(DISTINCT (i + ix, j + iy, k + iz)) / 3456.0::DOUBLE ratio FROM pvox")
def vol_touched_ratio(spark, sf_dir):
    p = phantoms.tube_patches(spark)
    return volume.touched_ratio(volume.assembled(p, phantoms.patch_voxels(p), "plain"), (24, 12, 12))


@query(f"WITH {TUBE} SELECT greatest(min(x) - 2, 0)::INT x_min, least(max(x) + 2, 23)::INT x_max, greatest(min(y) - 2, 0)::INT y_min, least(max(y) + 2, 11)::INT y_max, greatest(min(z) - 2, 0)::INT z_min, least(max(z) + 2, 11)::INT z_max FROM tube WHERE v > 0")
def vol_bounding_box(spark, sf_dir):
    return volume.bounding_box(phantoms.tube(spark), pad=2, size=(24, 12, 12))


@query(f"WITH {TUBE} SELECT x, y, z, v FROM tube WHERE v > 0 AND (x + y + z) % 3 = 0")
def vol_mask_and(spark, sf_dir):
    t = phantoms.tube(spark)
    return volume.mask_and(t, t.withColumn("v", ((F.col("x") + F.col("y") + F.col("z")) % 3 == 0).cast("double")))


_WAVE = "w AS (SELECT x, y, z, v + (x * x + 2 * y * z) / 100.0::DOUBLE v FROM tube)"


def _wave(spark):
    return phantoms.tube(spark).withColumn("v", F.col("v") + (F.col("x") * F.col("x") + 2 * F.col("y") * F.col("z")) / 100.0)


def _diff(a: str) -> str:
    others = ", ".join(c for c in "xyz" if c != a)
    w = f"OVER (PARTITION BY {others} ORDER BY {a})"
    return f"CASE WHEN lag(v) {w} IS NULL THEN lead(v) {w} - v WHEN lead(v) {w} IS NULL THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END"


@query(f"WITH {TUBE}, {_WAVE} SELECT x, y, z, round({_diff('x')}, 6) gx, round({_diff('y')} / 2, 6) gy, round({_diff('z')}, 6) gz FROM w")
def vol_gradient(spark, sf_dir):
    out = volume.gradient(_wave(spark), spacing=(1.0, 2.0, 1.0))
    return out.select("x", "y", "z", *[r6(c).alias(c) for c in ("gx", "gy", "gz")])


@query()
def vol_second_differences(spark, sf_dir):
    return volume.second_differences(_wave(spark)).groupBy("x").agg(F.round(F.sum("hxx"), 5).alias("hxx"), F.round(F.sum("hyy"), 5).alias("hyy"), F.round(F.sum("hzz"), 5).alias("hzz"))


@query(f"WITH {TUBE}, n AS (SELECT (range % 16)::INT x, ((range // 16) % 8)::INT y, (range // 128)::INT z FROM range(1024)) SELECT n.x, n.y, n.z, t.v FROM n JOIN tube t ON t.x = least(floor(n.x * 1.5 + 0.5), 23) AND t.y = least(floor(n.y * 1.5 + 0.5), 11) AND t.z = least(floor(n.z * 1.5 + 0.5), 11)")
def vol_resample_nearest(spark, sf_dir):
    return volume.resample_nearest(phantoms.tube(spark), (24, 12, 12), (1.0, 1.0, 1.0), (1.5, 1.5, 1.5))


@query(f"""WITH {TUBE}, {_WAVE}, n AS (SELECT (range % 16)::INT x, ((range // 16) % 8)::INT y, (range // 128)::INT z FROM range(1024)),
 p AS (SELECT x, y, z, least(x * 1.5::DOUBLE, 23.0) px, least(y * 1.5::DOUBLE, 11.0) py, least(z * 1.5::DOUBLE, 11.0) pz FROM n)
 SELECT p.x, p.y, p.z, round(sum(w.v * (1 - abs(px - w.x)) * (1 - abs(py - w.y)) * (1 - abs(pz - w.z))), 6) v
 FROM p JOIN w ON w.x IN (floor(px), floor(px) + 1) AND w.y IN (floor(py), floor(py) + 1) AND w.z IN (floor(pz), floor(pz) + 1) GROUP BY 1, 2, 3""")
def vol_resample_linear(spark, sf_dir):
    out = volume.resample_linear(_wave(spark), (24, 12, 12), (1.0, 1.0, 1.0), (1.5, 1.5, 1.5))
    return out.select("x", "y", "z", r6("v").alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest(l_extendedprice::DOUBLE, 2000.0), 60000.0) / 29000.0, 6) v FROM lineitem")
def vol_rescaled_ct(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice").cast("double"))
    return volume.rescaled_ct(rows, (2000.0, 60000.0)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("v").alias("v"))


@query("WITH e AS (SELECT event_type, quantile_cont(value::DOUBLE, 0.2) lo, quantile_cont(value::DOUBLE, 0.99) hi FROM events GROUP BY 1) SELECT event_id, round((least(greatest(value::DOUBLE, lo), hi) - trunc(lo)) * 2.0 / (hi - lo) - 1.0, 6) v FROM events JOIN e USING (event_type)")
def vol_rescaled_mr(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("double"))
    return volume.rescaled_mr(rows, ["event_type"]).select("event_id", r6("v").alias("v"))


@query(f"WITH {TUBE} SELECT 'x_high' face, bool_or(v > 0 AND x = 23) touches FROM tube UNION ALL SELECT 'x_low', bool_or(v > 0 AND x = 0) FROM tube UNION ALL SELECT 'y_high', bool_or(v > 0 AND y = 11) FROM tube UNION ALL SELECT 'y_low', bool_or(v > 0 AND y = 0) FROM tube UNION ALL SELECT 'z_high', bool_or(v > 0 AND z = 11) FROM tube UNION ALL SELECT 'z_low', bool_or(v > 0 AND z = 0) FROM tube")
def vol_border_faces(spark, sf_dir):
    return volume.border_faces(phantoms.tube(spark), (0, 0, 0), (24, 12, 12), (24, 12, 12))


@query(f"WITH {TUBE}, f AS (SELECT x, y, z FROM tube WHERE v > 0), s AS (SELECT * FROM (VALUES ('x', -1), ('x', 1), ('y', -1), ('y', 1), ('z', -1), ('z', 1)) AS s(axis, side)) SELECT f.x, f.y, f.z, axis, side FROM f, s WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.x = f.x + CASE WHEN axis = 'x' THEN side ELSE 0 END AND g.y = f.y + CASE WHEN axis = 'y' THEN side ELSE 0 END AND g.z = f.z + CASE WHEN axis = 'z' THEN side ELSE 0 END)")
def vol_surface_faces(spark, sf_dir):
    return mesh.voxel_surface(phantoms.tube(spark))


@query(f"WITH {TUBE}, f AS (SELECT x, y, z FROM tube WHERE v > 0), o AS (SELECT x, y, z FROM tube WHERE NOT v > 0 UNION ALL SELECT e, y, z FROM tube, (SELECT unnest([-1, 24]) e) WHERE x = 0) SELECT f.x, f.y, f.z, round(min(sqrt(((f.x - o.x)^2 + (f.y - o.y)^2 + (2 * (f.z - o.z))^2)::DOUBLE)), 6) depth FROM f, o GROUP BY 1, 2, 3")
def kernel_distance_map(spark, sf_dir):
    piece = phantoms.tube(spark).withColumn("case", F.lit(1))
    return kernels.distance_maps(piece, ["case"], (1.0, 1.0, 2.0)).select("x", "y", "z", r6("depth").alias("depth"))


@query()
def kernel_arrival_times(spark, sf_dir):
    piece = phantoms.tube(spark).withColumn("case", F.lit(1))
    out = kernels.arrival_maps(kernels.distance_maps(piece, ["case"]), ["case"])
    return out.groupBy("x").agg(F.count(F.lit(1)).alias("voxels"), F.round(F.min("time"), 4).alias("first_time"))


@query()
def plan_centerlines(spark, sf_dir):
    out = centerline.centerlines(phantoms.y_shape(spark), (40, 24, 12))
    return out.groupBy("body", "line_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.max("radius"), 4).alias("max_radius"), F.bool_and("reached").alias("reached"))


@query(f"WITH {PVOX}, w AS (SELECT *, exp(-0.5 * (((2.0 * i / 7 - 1)^2 + (2.0 * j / 7 - 1)^2 + (2.0 * k / 7 - 1)^2) / 0.25)) w FROM pvox), a AS (SELECT (i + ix)::INT x, (j + iy)::INT y, (k + iz)::INT z, sum(w * v) / sum(w) v FROM w GROUP BY 1, 2, 3) SELECT x, y, z FROM a WHERE v >= 0.5")
def plan_segmentation(spark, sf_dir):
    p = phantoms.tube_patches(spark)
    seeds = spark.createDataFrame([(5, 6, 6)], "x int, y int, z int")
    return assembly.segmentation(p, phantoms.patch_voxels(p), seeds, (24, 12, 12)).select("x", "y", "z")


@query("WITH g AS (SELECT (range % 40)::INT x, ((range // 40) % 24)::INT y, (range // 960)::INT z FROM range(11520)), o AS (SELECT *, greatest(x - 20, 0) * 0.4::DOUBLE f FROM g) SELECT x, y, z FROM o WHERE (y - (12 + f))^2 + (z - 6)^2 <= 6.5 OR (y - (12 - f))^2 + (z - 6)^2 <= 6.5")
def plan_trace_covers(spark, sf_dir):
    """The voxels that a trace from one seed covers: all of the Y."""
    mask = phantoms.y_shape(spark).withColumn("case", F.lit("y"))
    seed = spark.createDataFrame([("y", 0.0, 12.0, 6.0, 2.0, 12.0, 6.0, 2.5)], "case string, old_x double, old_y double, old_z double, x double, y double, z double, radius double")
    steps = graph.stored(tracing.trace(mask, seed, (40, 24, 12), preset("global_seg")), "steps")
    return tracing.assembled_trace(steps, mask).select("x", "y", "z")


@query()
def plan_trace_steps(spark, sf_dir):
    mask = phantoms.y_shape(spark).withColumn("case", F.lit("y"))
    seed = spark.createDataFrame([("y", 0.0, 12.0, 6.0, 2.0, 12.0, 6.0, 2.5)], "case string, old_x double, old_y double, old_z double, x double, y double, z double, radius double")
    return tracing.trace(mask, seed, (40, 24, 12), preset("global_seg"))


@query()
def plan_seeds_of_bodies(spark, sf_dir):
    return tracing.seeds_of_bodies(phantoms.blobs(spark), (12, 12, 12))


# components


@query(f"WITH {BLOBS} SELECT min((x * 12 + y) * 12 + z)::BIGINT AS label, count(*) voxels FROM blobs WHERE b > 0 GROUP BY b")
def cc_faces(spark, sf_dir):
    out = graph.voxel_components(phantoms.blobs(spark), (12, 12, 12), 6)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("voxels"))


@query(f"WITH {BLOBS} SELECT min((x * 12 + y) * 12 + z)::BIGINT AS label, count(*) voxels FROM blobs WHERE b > 0 GROUP BY b = 3")
def cc_all_neighbours(spark, sf_dir):
    out = graph.voxel_components(phantoms.blobs(spark), (12, 12, 12), 26)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("voxels"))


@query(f"WITH {BLOBS} SELECT x, y, z FROM blobs WHERE b = 3")
def cc_of_seed(spark, sf_dir):
    labelled = graph.voxel_components(phantoms.blobs(spark), (12, 12, 12), 26)
    return graph.components_of_seeds(labelled, spark.createDataFrame([(9, 10, 9), (0, 0, 0)], "x int, y int, z int")).select("x", "y", "z")


@query(f"WITH {BLOBS} SELECT x, y, z FROM blobs WHERE b IN (1, 2)")
def cc_largest(spark, sf_dir):
    return graph.largest_component(graph.voxel_components(phantoms.blobs(spark), (12, 12, 12), 26)).select("x", "y", "z")


@query(f"WITH {BLOBS} SELECT min((x * 12 + y) * 12 + z)::BIGINT AS label, count(*) voxels, count(*) * 0.5::DOUBLE physical_size, avg(1.0::DOUBLE) mean_v FROM blobs WHERE b > 0 GROUP BY b")
def cc_statistics(spark, sf_dir):
    return volume.component_statistics(graph.voxel_components(phantoms.blobs(spark), (12, 12, 12), 6), (1.0, 0.5, 1.0))


_LABELS = "lab AS (SELECT (range % 10)::INT x, ((range // 10) % 6)::INT y, (range // 60)::INT z, ((range % 10) // 2 + CASE WHEN (range // 10) % 6 >= 4 AND range % 10 >= 6 THEN 5 ELSE 0 END)::BIGINT AS label, (((range % 10) * 7 + ((range // 10) % 6) * 3 + range // 60) % 11 - 1)::DOUBLE v FROM range(240))"


def _labels(spark):
    x, y = F.col("x"), F.col("y")
    lab = F.floor(x / 2) + F.when((y >= 4) & (x >= 6), 5).otherwise(0)
    return phantoms.grid(spark, 10, 6, 4).select("x", "y", "z", lab.cast("long").alias("label"), ((x * 7 + y * 3 + F.col("z")) % 11 - 1).cast("double").alias("v"))


_TOUCH = "touch AS (SELECT DISTINCT p.label a, q.label b FROM lab p JOIN lab q ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1 WHERE p.label > 0 AND q.label > 0 AND p.label <> q.label)"


@query(f"WITH {_LABELS}, {_TOUCH} SELECT a, b FROM touch")
def cc_label_neighbours(spark, sf_dir):
    return graph.label_neighbours(_labels(spark))


@query(f"WITH {_LABELS}, {_TOUCH} SELECT a AS label FROM touch GROUP BY a HAVING count(*) = 1")
def cc_end_clusters(spark, sf_dir):
    return graph.end_clusters(_labels(spark))


@query(f"WITH {_LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, x, y, z) n FROM lab) SELECT label, x, y, z, v depth FROM r WHERE n = 1 AND v > 0")
def cc_deepest_voxel(spark, sf_dir):
    return volume.deepest_voxel(_labels(spark))


@query(f"WITH RECURSIVE {EDGES}, u AS (SELECT parent a, child b FROM edges UNION SELECT child, parent FROM edges), g AS (SELECT 12 AS node, 0 AS step UNION SELECT u.b, g.step + 1 FROM g JOIN u ON u.a = g.node WHERE g.step < 4) SELECT node::INT node, min(step)::INT step FROM g GROUP BY node")
def cc_region_grow(spark, sf_dir):
    e = tree.tree_edges(phantoms.forest(spark)).select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return graph.grown(e, spark.createDataFrame([(12, 1)], "node int, seed int"), 4).select("node", "step")


# polylines

_STEP = LINES + ", st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)^2 + (y - lag(y) OVER w)^2 + (z - lag(z) OVER w)^2), 0) step FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)), ar AS (SELECT *, sum(step) OVER (PARTITION BY line_id ORDER BY seq) arc FROM st)"


@query(f"WITH {_STEP} SELECT line_id, seq, round(step, 4) step, round(arc, 4) arc FROM ar")
def line_arc_length(spark, sf_dir):
    return polyline.arc_length(event_lines(spark, sf_dir)).select("line_id", "seq", F.round("step", 4).alias("step"), F.round("arc", 4).alias("arc"))


@query(f"WITH {_STEP} SELECT line_id, count(*) points, round(sum(step), 4) length FROM ar GROUP BY 1")
def line_lengths(spark, sf_dir):
    return polyline.lengths(event_lines(spark, sf_dir)).select("line_id", "points", F.round("length", 4).alias("length"))


@query(f"WITH {_STEP} SELECT line_id, count(*) points, round(sum(step) + sqrt((arg_min(x, seq) - arg_max(x, seq))^2 + (arg_min(y, seq) - arg_max(y, seq))^2 + (arg_min(z, seq) - arg_max(z, seq))^2), 4) length FROM ar GROUP BY 1")
def line_closed_lengths(spark, sf_dir):
    return polyline.lengths(event_lines(spark, sf_dir), closed=True).select("line_id", "points", F.round("length", 4).alias("length"))


@query(f"WITH {_STEP}, l AS (SELECT line_id, round(sum(step), 4) length FROM ar GROUP BY 1) SELECT line_id, length, (row_number() OVER (ORDER BY length DESC, line_id))::INT rank FROM l")
def line_longest_first(spark, sf_dir):
    return polyline.longest_first(event_lines(spark, sf_dir), places=4).select("line_id", "length", "rank")


@query(f"WITH {LINES}, d AS (SELECT line_id, seq, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) dy, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) dz FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)), n AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) n FROM d) SELECT line_id, seq, CASE WHEN n >= 1e-12 THEN round(dx / n, 6) ELSE 0 END + 0.0 tx, CASE WHEN n >= 1e-12 THEN round(dy / n, 6) ELSE 0 END + 0.0 ty, CASE WHEN n >= 1e-12 THEN round(dz / n, 6) ELSE 1 END + 0.0 tz FROM n")
def line_tangents(spark, sf_dir):
    out = polyline.tangents(event_lines(spark, sf_dir))
    return out.select("line_id", "seq", *[(r6(c) + 0.0).alias(c) for c in ("tx", "ty", "tz")])


@query(f"WITH {LINES} SELECT line_id, y, min(seq)::INT seq FROM (SELECT line_id, y, seq FROM lines) GROUP BY 1, 2")
def line_without_repeats(spark, sf_dir):
    rows = event_lines(spark, sf_dir).withColumn("x", F.lit(0.0)).withColumn("z", F.lit(0.0))
    return polyline.without_repeats(rows).select("line_id", "y", "seq")


@query(f"""WITH {_STEP}, t AS (SELECT *, max(arc) OVER (PARTITION BY line_id) total, lead(arc) OVER w narc, lead(x) OVER w nx, lead(y) OVER w ny, lead(radius) OVER w nr FROM ar WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
 s AS (SELECT *, range::INT sample, range * total / 8 pos FROM t, range(9) WHERE total > 0 AND narc > arc AND ((range * total / 8 > arc + 1e-9 * total OR (range = 0 AND arc = 0)) AND (range * total / 8 <= narc + 1e-9 * total)))
 SELECT line_id, sample, round(x + (nx - x) * least(greatest((pos - arc) / (narc - arc), 0), 1), 3) x, round(y + (ny - y) * least(greatest((pos - arc) / (narc - arc), 0), 1), 3) y, round(radius + (nr - radius) * least(greatest((pos - arc) / (narc - arc), 0), 1), 3) radius FROM s""")
def line_resample(spark, sf_dir):
    out = polyline.resample(event_lines(spark, sf_dir), 9)
    return out.select("line_id", "sample", *[F.round(c, 3).alias(c) for c in ("x", "y", "radius")])


@query(f"WITH {LINES}, f AS (SELECT *, count(*) OVER (PARTITION BY line_id) n, first(radius) OVER w < last(radius) OVER w turn FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT line_id, (CASE WHEN turn THEN n - 1 - seq ELSE seq END)::INT seq, radius FROM f")
def line_wide_end_first(spark, sf_dir):
    return polyline.wide_end_first(event_lines(spark, sf_dir)).select("line_id", "seq", "radius")


@query(f"WITH {LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY line_id) n FROM lines) SELECT line_id, range::INT position, seq, x FROM n, range(5) WHERE seq = (range * (n - 1)) // 4")
def line_evenly_placed(spark, sf_dir):
    return polyline.evenly_placed(event_lines(spark, sf_dir), 5).select("line_id", "position", "seq", "x")


@query(f"WITH {LINES} SELECT line_id, seq, round(CASE WHEN lag(x) OVER w IS NULL OR lead(x) OVER w IS NULL THEN x ELSE avg(x) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 5) x FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)")
def line_moving_average(spark, sf_dir):
    return polyline.moving_average(event_lines(spark, sf_dir), 2).select("line_id", "seq", F.round("x", 5).alias("x"))


@query(f"WITH {LINES}, d AS (SELECT *, (x - 50)^2 + (y - 40)^2 + (z - 3)^2 d, count(*) OVER (PARTITION BY line_id) n FROM lines), s AS (SELECT *, first(seq) OVER (PARTITION BY line_id ORDER BY d, seq) s FROM d) SELECT line_id, ((seq - s + n) % n)::INT seq, x FROM s")
def line_rotated(spark, sf_dir):
    return polyline.rotated_to(event_lines(spark, sf_dir), (50.0, 40.0, 3.0)).select("line_id", "seq", "x")


@query()
def line_smooth_closed(spark, sf_dir):
    out = polyline.smooth_closed(event_lines(spark, sf_dir), passes=3)
    return out.select("line_id", "seq", *[F.round(c, 5).alias(c) for c in "xyz"])


# spatial joins


@query(f"WITH {POINTS} SELECT a.point_id query_id, b.point_id, round(sqrt((a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2), 6) distance FROM pts a, pts b WHERE (a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2 <= 0.0025")
def spatial_within(spark, sf_dir):
    p = vector_points(spark, sf_dir)
    out = spatial.within(p.withColumnRenamed("point_id", "query_id"), p, 0.05)
    return out.select("query_id", "point_id", r6("distance").alias("distance"))


@query(f"WITH {POINTS}, d AS (SELECT a.point_id query_id, b.point_id, sqrt((a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2) d FROM pts a, pts b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, point_id) n FROM d) SELECT query_id, n::INT rank, point_id, round(d, 6) distance FROM r WHERE n <= 3")
def spatial_nearest(spark, sf_dir):
    p = vector_points(spark, sf_dir)
    out = spatial.nearest(p.withColumnRenamed("point_id", "query_id"), p, 3, start=0.05)
    return out.select("query_id", "rank", "point_id", r6("distance").alias("distance"))


@query(f"""WITH {POINTS}, s AS (SELECT a.point_id segment_id, a.x ax, a.y ay, a.z az, b.x bx, b.y byy, b.z bz FROM pts a JOIN pts b ON b.point_id = a.point_id + 1),
 d AS (SELECT q.point_id query_id, segment_id, q.x, q.y, q.z, ax, ay, az, bx, byy, bz, CASE WHEN (bx-ax)^2+(byy-ay)^2+(bz-az)^2 < 1e-30 THEN 0 ELSE least(greatest(((q.x-ax)*(bx-ax)+(q.y-ay)*(byy-ay)+(q.z-az)*(bz-az)) / ((bx-ax)^2+(byy-ay)^2+(bz-az)^2), 0), 1) END t FROM pts q, s),
 e AS (SELECT query_id, segment_id, t, sqrt((x-ax-t*(bx-ax))^2+(y-ay-t*(byy-ay))^2+(z-az-t*(bz-az))^2) d FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), segment_id) n FROM e WHERE d <= 0.15) SELECT query_id, segment_id, round(d, 6) distance, round(t, 5) + 0.0 t FROM r WHERE n = 1""")
def spatial_nearest_segment(spark, sf_dir):
    p = vector_points(spark, sf_dir)
    a = p.select(F.col("point_id").alias("segment_id"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = p.select((F.col("point_id") - 1).alias("segment_id"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    out = spatial.nearest_segment(p.withColumnRenamed("point_id", "query_id"), a.join(b, "segment_id"), 0.15)
    return out.select("query_id", "segment_id", r6("distance").alias("distance"), (F.round("t", 5) + 0.0).alias("t"))


@query(f"WITH {POINTS}, d AS (SELECT point_id % 7 AS \"case\", point_id cap_id, sqrt((x - 0.1)^2 + y^2 + (z + 0.1)^2) d, acos(least(greatest((y) / sqrt((x - 0.1)^2 + y^2 + (z + 0.1)^2), -1), 1)) a FROM pts), s AS (SELECT *, row_number() OVER (PARTITION BY \"case\" ORDER BY d, cap_id) = 1 src FROM d) SELECT \"case\", cap_id, (row_number() OVER (PARTITION BY \"case\" ORDER BY src DESC, a, cap_id))::INT place FROM s")
def spatial_oriented_caps(spark, sf_dir):
    p = vector_points(spark, sf_dir).withColumn("case", F.col("point_id") % 7).withColumnRenamed("point_id", "cap_id")
    return spatial.oriented_caps(p, (0.1, 0.0, -0.1), (0.0, 1.0, 0.0)).select("case", "cap_id", "place")


# trees


@query(f"WITH {EDGES} SELECT branch_id, parent, child FROM edges")
def tree_edges(spark, sf_dir):
    return tree.tree_edges(phantoms.forest(spark))


@query(f"WITH {EDGES}, e AS (SELECT DISTINCT parent, child FROM edges) SELECT s step_id, sum(i)::BIGINT n_in, sum(o)::BIGINT n_out FROM (SELECT parent s, 0 i, 1 o FROM e UNION ALL SELECT child, 1, 0 FROM e) GROUP BY 1")
def tree_degrees(spark, sf_dir):
    return tree.degrees(tree.tree_edges(phantoms.forest(spark)).select("parent", "child").distinct())


@query(f"WITH {EDGES}, e AS (SELECT DISTINCT parent, child FROM edges) SELECT parent step_id FROM e GROUP BY 1 HAVING count(*) > 1")
def tree_bifurcations(spark, sf_dir):
    return tree.bifurcations(tree.tree_edges(phantoms.forest(spark)).select("parent", "child").distinct())


@query(f"WITH RECURSIVE {EDGES}, d AS (SELECT DISTINCT parent step_id, parent root, 0::BIGINT AS depth FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION ALL SELECT e.child, d.root, d.depth + 1 FROM d JOIN (SELECT DISTINCT parent, child FROM edges) e ON e.parent = d.step_id) SELECT step_id, root, depth FROM d")
def tree_depths(spark, sf_dir):
    return tree.depths(tree.tree_edges(phantoms.forest(spark)).select("parent", "child").distinct())


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT parent, child FROM edges), g AS (SELECT s FROM (SELECT parent s, 0 i, 1 o FROM e UNION ALL SELECT child, 1, 0 FROM e) GROUP BY s HAVING sum(i) = 1 AND sum(o) = 1),
 p AS (SELECT parent, child, 1::BIGINT AS steps FROM e WHERE child NOT IN (SELECT s FROM g) UNION ALL SELECT e.parent, p.child, p.steps + 1 FROM p JOIN e ON e.child = p.parent WHERE p.parent IN (SELECT s FROM g)) SELECT parent, child, steps FROM p WHERE parent NOT IN (SELECT s FROM g)""")
def tree_contracted(spark, sf_dir):
    return tree.contracted(tree.tree_edges(phantoms.forest(spark)).select("parent", "child").distinct())


@query(f"WITH {FOREST}, r AS (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY pos DESC) b FROM forest WHERE pos > 0 AND step_id <> 0) SELECT branch_id, b::INT back, step_id FROM r WHERE b <= 3")
def tree_last_steps(spark, sf_dir):
    return tree.last_steps(phantoms.forest(spark), 3)


@query(f"WITH {FOREST}, p AS (SELECT branch_id, step_id, lag(step_id) OVER (PARTITION BY branch_id ORDER BY pos) previous FROM forest) SELECT step_id, arg_max(previous, branch_id) previous FROM p WHERE previous IS NOT NULL GROUP BY 1")
def tree_previous_steps(spark, sf_dir):
    return tree.previous_steps(phantoms.forest(spark))


@query(f"WITH {FOREST} SELECT branch_id, arg_max(step_id, pos) step_id, max(pos)::INT steps FROM forest GROUP BY 1")
def tree_branch_ends(spark, sf_dir):
    return tree.branch_ends(phantoms.forest(spark))


@query(f"WITH {FOREST} SELECT branch_id, pos, (CASE WHEN pos = 0 AND step_id IN (SELECT step_id FROM forest WHERE branch_id = 1 AND pos > 0) THEN (SELECT step_id FROM forest WHERE branch_id = 1 AND pos = 0) ELSE step_id END)::INT step_id FROM forest WHERE branch_id <> 1")
def tree_restarted(spark, sf_dir):
    return tree.restarted(phantoms.forest(spark), 1).select("branch_id", "pos", "step_id")


@query(f"WITH {FOREST} SELECT branch_id % 2 AS \"case\", step_id seq, (row_number() OVER (PARTITION BY branch_id % 2 ORDER BY radius DESC, step_id))::INT place FROM forest WHERE pos > 0")
def tree_queue(spark, sf_dir):
    rows = phantoms.forest(spark).filter("pos > 0").select((F.col("branch_id") % 2).alias("case"), F.col("step_id").alias("seq"), "radius")
    return tree.queue_order(rows).select("case", "seq", "place")


@query("WITH RECURSIVE p AS (SELECT range i, (range % 10) * 0.4::DOUBLE x FROM range(10)), k AS (SELECT 0::BIGINT AS i UNION ALL SELECT (SELECT min(q.i) FROM p q, p r WHERE r.i = k.i AND q.i > k.i AND q.x - r.x >= 1.0) FROM k WHERE k.i IS NOT NULL) SELECT i::INT seq FROM k WHERE i IS NOT NULL")
def tree_merged_potentials(spark, sf_dir):
    i = F.col("id").cast("int")
    rows = spark.range(10).select(F.lit(1).alias("case"), i.alias("seq"), (i * 0.4).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(1.0).alias("tz"), F.lit(0.5).alias("radius"))
    return tree.merged_potentials(rows).select("seq")


# metrics

_PAIRS = "pairs AS (SELECT l_orderkey x, l_linenumber y, l_partkey z, (l_suppkey % 4)::INT p, (CASE WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 7 = 0 THEN (l_suppkey + 1) % 4 ELSE l_suppkey % 4 END)::INT t FROM lineitem)"


def _pairs(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    p = (F.col("l_suppkey") % 4).cast("int")
    return li.select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("z"), p.alias("p"), F.when(F.col("l_partkey") % 5 == 0, 0).when(F.col("l_partkey") % 7 == 0, ((F.col("l_suppkey") + 1) % 4).cast("int")).otherwise(p).alias("t"))


_DICE = "SELECT 0 AS class, round(2.0 * sum((p > 0 AND p = t)::INT) / (sum((p > 0)::INT) + sum((t > 0)::INT)), 6)::DOUBLE dice FROM {0} UNION ALL SELECT c::INT, round(2.0 * sum((p = c AND t = c)::INT) / (sum((p = c)::INT) + sum((t = c)::INT)), 6)::DOUBLE FROM {0}, (SELECT unnest([1, 2, 3]) c) GROUP BY c"


@query(f"WITH {_PAIRS} " + _DICE.format("pairs"))
def metric_dice(spark, sf_dir):
    return metrics.dice_scores(_pairs(spark, sf_dir)).select("class", r6("dice").alias("dice"))


@query(f"WITH {_PAIRS}, m AS (SELECT x, y, z, CASE WHEN x % 3 = 0 THEN p ELSE 0 END p, t FROM pairs) " + _DICE.format("m"))
def metric_masked_dice(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return metrics.masked_dice(p, p.filter("x % 3 = 0")).select("class", r6("dice").alias("dice"))


@query(f"WITH {_PAIRS}, c AS (SELECT sum((p > 0 AND t > 0)::INT)::BIGINT tp, sum((p = 0 AND t = 0)::INT)::BIGINT tn, sum((p > 0 AND t = 0)::INT)::BIGINT fp, sum((p = 0 AND t > 0)::INT)::BIGINT fn FROM pairs) SELECT *, round(tp / (tp + fn), 6) sensitivity, round(tn / (tn + fp), 6) specificity FROM c")
def metric_confusion(spark, sf_dir):
    out = metrics.confusion(_pairs(spark, sf_dir))
    return out.withColumn("sensitivity", r6("sensitivity")).withColumn("specificity", r6("specificity"))


@query(f"WITH {_STEP}, c AS (SELECT line_id, max(arc) length, greatest(min(CASE WHEN NOT (y < 90) THEN arc - 0.1 * radius END), 0) miss FROM ar GROUP BY 1) SELECT line_id, round(length, 4) length, round(coalesce(miss, length), 4) reached FROM c")
def metric_branch_coverage(spark, sf_dir):
    rows = polyline.arc_length(event_lines(spark, sf_dir))
    out = metrics.branch_coverage(rows, rows.filter("y < 90"))
    return out.select("line_id", F.round("length", 4).alias("length"), F.round("reached", 4).alias("reached"))


@query(f"WITH {FOREST} SELECT round(avg(radius), 6) mean_radius FROM forest WHERE step_id > 0")
def metric_mean_of_timed(spark, sf_dir):
    return metrics.mean_of_timed(phantoms.forest(spark), "radius").select(r6("mean_radius").alias("mean_radius"))


# meshes


@query(f"WITH {TORUS}, e AS (SELECT least(a, b) u, greatest(a, b) v FROM mc UNION ALL SELECT least(b, c), greatest(b, c) FROM mc UNION ALL SELECT least(a, c), greatest(a, c) FROM mc) SELECT u, v, count(*) cells FROM e GROUP BY 1, 2")
def mesh_edges(spark, sf_dir):
    return mesh.edges(torus(spark)[1])


_N = "(byy-ay)*(cz-az)-(bz-az)*(cy-ay) nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) ny, (bx-ax)*(cy-ay)-(byy-ay)*(cx-ax) nz"


@query(f"WITH {TORUS}, n AS (SELECT *, {_N} FROM t) SELECT cid, round(sqrt(nx*nx+ny*ny+nz*nz)/2, 6) area FROM n")
def mesh_areas(spark, sf_dir):
    return mesh.areas(*torus(spark)).select("cid", r6("area").alias("area"))


@query(f"WITH {TORUS} SELECT cid, round((ax+bx+cx)/3, 6) + 0.0 x, round((ay+byy+cy)/3, 6) + 0.0 y, round((az+bz+cz)/3, 6) + 0.0 z FROM t")
def mesh_centroids(spark, sf_dir):
    return mesh.centroids(*torus(spark)).select("cid", *[(r6(c) + 0.0).alias(c) for c in "xyz"])


@query(f"WITH {TORUS} SELECT round(sum(ax*(byy*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-byy*cx))/6, 6) volume FROM t")
def mesh_volume(spark, sf_dir):
    return mesh.enclosed_volume(*torus(spark)).select(r6("volume").alias("volume"))


@query(f"WITH {TORUS}, n AS (SELECT *, {_N} FROM t), s AS (SELECT pid, sum(nx) nx, sum(ny) ny, sum(nz) nz FROM (SELECT a pid, nx, ny, nz FROM n UNION ALL SELECT b, nx, ny, nz FROM n UNION ALL SELECT c, nx, ny, nz FROM n) GROUP BY 1) SELECT pid, round(nx/sqrt(nx*nx+ny*ny+nz*nz), 5) + 0.0 nx, round(ny/sqrt(nx*nx+ny*ny+nz*nz), 5) + 0.0 ny, round(nz/sqrt(nx*nx+ny*ny+nz*nz), 5) + 0.0 nz FROM s")
def mesh_point_normals(spark, sf_dir):
    return mesh.point_normals(*torus(spark)).select("pid", *[(F.round(c, 5) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@query(f"WITH {TORUS}, s AS (SELECT cid, (ax-0.3) sa, (bx-0.3) sb, (cx-0.3) sc FROM t) SELECT cid FROM s WHERE ((sa >= 0) <> (sb >= 0))::INT + ((sb >= 0) <> (sc >= 0))::INT + ((sa >= 0) <> (sc >= 0))::INT = 2")
def mesh_cut_plane(spark, sf_dir):
    return mesh.cut_plane(*torus(spark), (0.3, 0.0, 0.0), (1.0, 0.0, 0.0)).select("cid")


@query(f"WITH {TORUS}, o AS (SELECT * FROM mc WHERE cid >= 48), e AS (SELECT least(a, b) u, greatest(a, b) v FROM o UNION ALL SELECT least(b, c), greatest(b, c) FROM o UNION ALL SELECT least(a, c), greatest(a, c) FROM o), r AS (SELECT u, v FROM e GROUP BY 1, 2 HAVING count(*) = 1), n AS (SELECT DISTINCT pid FROM (SELECT u pid FROM r UNION ALL SELECT v FROM r)), l AS (SELECT pid, pid // 12 ring FROM n) SELECT min(l.pid) cap, count(*) points, round(avg(x), 6) + 0.0 x, round(avg(y), 6) + 0.0 y FROM l JOIN mp ON mp.pid = l.pid GROUP BY ring")
def mesh_caps(spark, sf_dir):
    p, c = torus(spark)
    return mesh.caps(p, c.filter("cid >= 48")).select("cap", "points", (r6("x") + 0.0).alias("x"), (r6("y") + 0.0).alias("y"))


@query(f"WITH {TORUS} SELECT cid, a, b, c FROM t WHERE least(ax, bx, cx) >= 0 AND greatest(ax, bx, cx) <= 5 AND least(ay, byy, cy) >= -1 AND greatest(ay, byy, cy) <= 2.5 AND least(az, bz, cz) >= -2 AND greatest(az, bz, cz) <= 2")
def mesh_clipped(spark, sf_dir):
    return mesh.clipped_to_box(*torus(spark), (0.0, -1.0, -2.0), (5.0, 2.5, 2.0))


@query(f"WITH {TORUS} SELECT count(*) points, count(DISTINCT r) regions FROM (SELECT 0 r, pid FROM mp UNION ALL SELECT 288 r, pid FROM mp)")
def mesh_regions(spark, sf_dir):
    both = mesh.appended([torus(spark), torus(spark)])
    return mesh.regions(*both).agg(F.count(F.lit(1)).alias("points"), F.count_distinct("region").alias("regions"))


@query()
def mesh_taubin(spark, sf_dir):
    out = mesh.taubin(*torus(spark), rounds=5)
    return out.select("pid", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query(f"WITH {TORUS}, o AS (SELECT a o, b p, c q FROM mc UNION ALL SELECT b, a, c FROM mc UNION ALL SELECT c, a, b FROM mc), d AS (SELECT least(p, q) u, greatest(p, q) v, P.x-O.x sx, P.y-O.y sy, P.z-O.z sz, Q.x-O.x rx, Q.y-O.y ry, Q.z-O.z rz FROM o JOIN mp O ON O.pid = o JOIN mp P ON P.pid = p JOIN mp Q ON Q.pid = q) SELECT u, v, round(sum((sx*rx+sy*ry+sz*rz)/(2*sqrt((sy*rz-sz*ry)^2+(sz*rx-sx*rz)^2+(sx*ry-sy*rx)^2))), 5) + 0.0 w FROM d GROUP BY 1, 2")
def mesh_cotangent_weights(spark, sf_dir):
    return mesh.cotangent_weights(*torus(spark)).select("u", "v", (F.round("w", 5) + 0.0).alias("w"))


# scalars


@query("SELECT p_partkey, round(acos(least(greatest((p_size * 1.0 + 2.0 * (p_partkey % 7)) / (sqrt(p_size^2 + (p_partkey % 7)^2 + 1) * sqrt(5.0)), -1), 1)), 6) angle FROM part")
def geom_angle(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    a = (F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"), F.lit(1.0))
    return p.select("p_partkey", r6(g.angle(a, (F.lit(1.0), F.lit(2.0), F.lit(0.0)))).alias("angle"))


@query("SELECT p_partkey, round(10 + 2.0 * (0.5 * p_size), 6)::DOUBLE x, round(20 - 0.5 * (p_partkey % 9), 6)::DOUBLE y, round(30 + 1.0 * (p_partkey % 4), 6)::DOUBLE z FROM part")
def geom_index_to_world(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    world = g.index_to_world((F.col("p_partkey") % 9, F.col("p_size"), F.col("p_partkey") % 4), (0.5, 1.0, 1.0), (10.0, 20.0, 30.0), (0, 1, 0, -1, 0, 0, 0, 0, 1))
    return p.select("p_partkey", *[r6(c).alias(n) for c, n in zip(world, "xyz", strict=True)])


@query("WITH r AS (SELECT p_partkey, ceil(2.0 * (1 + p_size / 10.0) * 4.0 / 0.5)::INT w, rint(((p_partkey % 50) - 1.0) / 0.5 - ceil(2.0 * (1 + p_size / 10.0) * 4.0 / 0.5) / 2.0)::INT f FROM (SELECT p_partkey, p_size::DOUBLE p_size FROM part)) SELECT p_partkey, greatest(f, 0)::INT first_index, greatest(least(f + w, 90) - greatest(f, 0), 0)::INT size FROM r".replace("rint(", "round_even(").replace(")::INT f", ", 0)::INT f"))
def geom_crop(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    low, kept, _ = g.crop_axis((F.col("p_partkey") % 50).cast("double"), 1 + F.col("p_size") / 10.0, F.lit(4.0), 0.5, 1.0, 90)
    return p.select("p_partkey", low.alias("first_index"), kept.alias("size"))


@query("SELECT s_suppkey, CASE WHEN (s_suppkey % 5 + 1) * 0.25::DOUBLE > 0.8::DOUBLE OR (s_suppkey % 3 + 1) * 0.5::DOUBLE > 0.8::DOUBLE THEN round(least((s_suppkey % 5 + 1) * 0.25::DOUBLE, 0.8::DOUBLE) + least((s_suppkey % 3 + 1) * 0.5::DOUBLE, 0.8::DOUBLE), 6) END spacing FROM supplier")
def geom_capped_spacing(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    c = g.capped_spacing(F.array((F.col("s_suppkey") % 5 + 1) * 0.25, (F.col("s_suppkey") % 3 + 1) * 0.5), F.lit(0.8))
    return s.select("s_suppkey", r6(c[0] + c[1]).alias("spacing"))


@query("SELECT s_suppkey, (CASE WHEN s_suppkey % 40 < 2 THEN 100 ELSE least(greatest((s_suppkey % 40) * 4 - 3, 8), 100) END)::BIGINT samples FROM supplier")
def geom_calculation_number(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select("s_suppkey", g.calculation_number(F.col("s_suppkey") % 40).cast("long").alias("samples"))


@query("SELECT p_partkey, 'Dataset' || lpad((p_partkey % 1000)::VARCHAR, 4, '0') || '_' || p_brand || upper('ct') AS name, (p_partkey % 1000)::INT number FROM part")
def name_dataset(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    name = naming.dataset_name(F.col("p_brand"), F.col("p_partkey") % 1000, F.lit("ct"))
    return p.select("p_partkey", name.alias("name"), naming.dataset_number(name).alias("number"))


@query("SELECT page_id, regexp_replace(regexp_extract(u, '([^/]+)$', 1), '(\\.nii\\.gz|\\.[^.]+)$', '') stem, split_part(regexp_replace(regexp_extract(u, '([^/]+)$', 1), '(\\.nii\\.gz|\\.[^.]+)$', ''), '_segmentation_', 1) \"case\" FROM (SELECT page_id, '/d/case' || page_id || '_segmentation_' || (page_id % 7) || CASE WHEN page_id % 2 = 0 THEN '.nii.gz' ELSE '.mha' END u FROM pages)")
def name_case(spark, sf_dir):
    i = F.col("page_id")
    u = F.concat(F.lit("/d/case"), i, F.lit("_segmentation_"), i % 7, F.when(i % 2 == 0, ".nii.gz").otherwise(".mha"))
    return _table(spark, sf_dir, "pages").select("page_id", naming.file_stem(u).alias("stem"), naming.case_of_segmentation(u).alias("case"))


@query("SELECT s_suppkey, greatest(1, round_even((s_suppkey % 90) / (1 + s_suppkey % 4)::DOUBLE, 0))::INT stride, CASE WHEN s_suppkey % 2 = 0 THEN '50' ELSE '5' END reslice, (CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 0.1 END)::DOUBLE scale FROM supplier")
def name_display(spark, sf_dir):
    i = F.col("s_suppkey")
    unit_name = F.when(i % 2 == 0, "mm").otherwise("cm")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", naming.contour_stride(i % 90, 1 + i % 4).alias("stride"), naming.reslice_size(unit_name).alias("reslice"), naming.unit_scale(unit_name).alias("scale"))


@query(f"WITH {TUBE}, p AS (SELECT range i, (range % 30)::DOUBLE - 2.4 x, 6.3::DOUBLE y, (range % 12)::DOUBLE + 0.5 z FROM range(200)) SELECT i, coalesce(v > 0.5, false) inside FROM p LEFT JOIN tube t ON t.x = round_even(p.x, 0) AND t.y = round_even(p.y, 0) AND t.z = round_even(p.z, 0)")
def sample_inside(spark, sf_dir):
    i = F.col("id")
    points = spark.range(200).select(i.alias("i"), ((i % 30).cast("double") - 2.4).alias("x"), F.lit(6.3).alias("y"), ((i % 12).cast("double") + 0.5).alias("z"))
    return sampling.inside(points, phantoms.tube(spark)).select("i", "inside")


@query(f"WITH {PATCHES} SELECT step_id % 2 AS grp, min(ix)::INT ix, min(iy)::INT iy, min(iz)::INT iz, (max(ix + sx) - min(ix))::INT sx, (max(iy + sy) - min(iy))::INT sy, (max(iz + sz) - min(iz))::INT sz FROM patches GROUP BY 1")
def sample_union_box(spark, sf_dir):
    return sampling.union_box(phantoms.tube_patches(spark).withColumn("grp", F.col("step_id") % 2), ["grp"])


@query(f"WITH {TUBE} SELECT x, y, z FROM tube WHERE v > 0 AND NOT (abs(x - 24) <= 4 AND (y - 6)^2 + (z - 6)^2 <= 32) AND NOT (abs(x + 1) <= 4 AND (y - 6)^2 + (z - 6)^2 <= 32)")
def sample_outside_boxes(spark, sf_dir):
    ends = spark.createDataFrame([(20.0, 6.0, 6.0, 1.0, 0.0, 0.0, 2.0), (3.0, 6.0, 6.0, -1.0, 0.0, 0.0, 2.0)], "x double, y double, z double, tx double, ty double, tz double, radius double")
    return sampling.outside_boxes(phantoms.tube(spark).filter("v > 0"), sampling.oriented_boxes(ends)).select("x", "y", "z")


@query(f"WITH {TUBE} SELECT x, y, z FROM tube WHERE v > 0 AND ((x * 12 + y) * 12 + z) % 5 = 0")
def sample_every_nth(spark, sf_dir):
    return sampling.every_nth(phantoms.tube(spark), 5, (24, 12, 12)).select("x", "y", "z")


@query(f"WITH {TUBE}, c AS (SELECT range centre_id, (range * 4)::DOUBLE x, 6.0::DOUBLE y, (4 + range)::DOUBLE z FROM range(5)) SELECT centre_id, count(t.x) voxels FROM c LEFT JOIN tube t ON v > 0 AND (t.x - c.x)^2 + (t.y - c.y)^2 + (t.z - c.z)^2 <= 6.25 GROUP BY 1")
def sample_covered(spark, sf_dir):
    i = F.col("id")
    centres = spark.range(5).select(i.alias("centre_id"), (i * 4).cast("double").alias("x"), F.lit(6.0).alias("y"), (4 + i).cast("double").alias("z"))
    return sampling.covered_by(phantoms.tube(spark), centres, 2.5)


def _tube_path(spark):
    return sampling.sampled_paths(spark.createDataFrame([(1, 0, 2.0, 6.0, 6.0), (1, 1, 12.0, 6.0, 6.0), (1, 2, 21.0, 6.0, 6.0)], "path_id int, seq int, x double, y double, z double")).withColumn("case", F.lit("t"))


@query()
def sample_paths(spark, sf_dir):
    return _tube_path(spark).select("path_id", "id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "tx", "ry", "rz")])


@query()
def sample_contours(spark, sf_dir):
    out = sampling.contours(phantoms.tube(spark).withColumn("case", F.lit("t")), _tube_path(spark), stride=2)
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg(F.sqrt(F.pow(F.col("y") - 6, 2) + F.pow(F.col("z") - 6, 2))), 4).alias("mean_radius"))


@query()
def sample_merged_lines(spark, sf_dir):
    i = F.col("id")
    one = spark.range(21).select(F.lit(1).alias("body"), F.lit(0).alias("line_id"), i.cast("int").alias("seq"), i.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("radius"))
    two = spark.range(16).select(F.lit(1).alias("body"), F.lit(1).alias("line_id"), i.cast("int").alias("seq"), i.cast("double").alias("x"), F.greatest(i - 9, F.lit(0)).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("radius"))
    return sampling.merged_lines(one.unionByName(two), "body")


@query(f"WITH {LINES}, d AS (SELECT *, CASE WHEN y % 5 = 0 THEN 0 ELSE y END ty FROM lines) SELECT line_id, seq, x old_x, CASE WHEN ty = 0 THEN y ELSE y - 2 END old_y, CASE WHEN ty = 0 THEN z - 2 ELSE z END old_z FROM d")
def seed_at_points(spark, sf_dir):
    rows = event_lines(spark, sf_dir).withColumn("tx", F.lit(0.0)).withColumn("ty", F.when(F.col("y") % 5 == 0, 0.0).otherwise(F.col("y"))).withColumn("tz", F.lit(0.0))
    return seeds.seeds_at_points(rows, 2.0).select("line_id", "seq", "old_x", "old_y", "old_z")


@query(f"WITH {_STEP}, l AS (SELECT line_id, row_number() OVER (ORDER BY sum(step) DESC, line_id) rank FROM ar GROUP BY 1), p AS (SELECT lines.*, rank, row_number() OVER (PARTITION BY line_id ORDER BY seq DESC) - 1 p, count(*) OVER (PARTITION BY line_id) n FROM lines JOIN l USING (line_id) WHERE rank <= 10) SELECT a.line_id, a.rank::INT rank, a.x old_x, b.x x, b.radius radius FROM p a JOIN p b ON a.line_id = b.line_id AND b.p = least(7, b.n - 1) AND a.p = greatest(least(7, a.n - 1) - 2, 0)")
def seed_on_longest(spark, sf_dir):
    return seeds.seeds_on_longest(event_lines(spark, sf_dir), 10, 5, from_end=True).select("line_id", "rank", "old_x", "x", "radius")


@query(f"WITH {LINES} SELECT line_id, seq FROM lines WHERE round_even(x / 2, 0) NOT BETWEEN 0 AND 99 OR round_even(y, 0) NOT BETWEEN 0 AND 89 OR round_even(z - 1, 0) NOT BETWEEN 0 AND 9 OR round_even((x - 5) / 2, 0) NOT BETWEEN 0 AND 99")
def seed_outside_volume(spark, sf_dir):
    rows = event_lines(spark, sf_dir).withColumns({"old_x": F.col("x") - 5, "old_y": F.col("y"), "old_z": F.col("z")})
    return seeds.outside_volume(rows, (100, 90, 10), (2.0, 1.0, 1.0), (0.0, 0.0, 1.0)).select("line_id", "seq")
