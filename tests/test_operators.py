"""Operators without SQL, kernels with closed forms, and edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.operators import graph, kernels, mesh, polyline, spatial, tree, volume
from arbora.plans import centerline
from arbora.sources import files, phantoms
from arbora.streaming import assembled_stream


def test_distance_map_is_the_least_distance():
    rng = np.random.default_rng(0)
    mask = rng.random((7, 6, 5)) < 0.8
    mask[0, 0, 0] = False
    s = (1.0, 0.5, 2.0)
    out = np.argwhere(~mask) * s
    want = [min(np.linalg.norm(np.array(p) * s - o) for o in out) for p in np.argwhere(mask)]
    np.testing.assert_allclose(kernels.distance_map(mask, s)[mask], want)


def test_front_runs_straight_in_the_open():
    times = kernels.arrival_times(np.ones((21, 3, 3)), [(0, 1, 1)])
    np.testing.assert_allclose(times[:, 1, 1], np.arange(21), atol=1e-9)
    wall = np.ones((9, 3, 3))
    wall[4] = 0
    assert np.isinf(kernels.arrival_times(wall, [(0, 1, 1)])[5:]).all()


def test_descent_returns_to_the_seed():
    speed = np.zeros((30, 9, 9))
    speed[:, 2:7, 2:7] = 1.0
    path, ok = kernels.descent(kernels.arrival_times(speed, [(1, 4, 4)]), (28, 5, 3))
    assert ok and np.linalg.norm(path[-1] - (1, 4, 4)) < 1e-9


def test_spline_passes_its_points_and_loops_close():
    p = np.array([[0, 0, 0], [1, 2, 0], [3, 1, 1], [4, 4, 4.0]])
    np.testing.assert_allclose(kernels.cardinal_spline(p, 4), p, atol=1e-12)
    line = np.column_stack((np.arange(5.0), np.zeros(5), np.zeros(5)))
    np.testing.assert_allclose(kernels.cardinal_spline(line, 9)[:, 0], np.linspace(0, 4, 9), atol=1e-12)
    y, x = np.indices((21, 21)) - 10.0
    loops = kernels.iso_loops(-(x**2 + y**2), -36.0)
    assert len(loops) == 1 and np.allclose(loops[0][0], loops[0][-1])
    assert np.allclose(np.linalg.norm(loops[0] - 10, axis=1), 6, atol=0.1)


def test_y_has_three_lines_to_its_ends(spark):
    lines = centerline.centerlines(phantoms.y_shape(spark), (40, 24, 12)).toPandas()
    assert lines["reached"].all() and lines.groupby(["body", "line_id"]).ngroups == 3
    tips = lines.sort_values("seq").groupby("line_id").last()
    assert (tips["x"] > 36).sum() == 2 and (tips["x"] < 3).sum() == 1


def test_assembly_order_does_not_matter(spark):
    p = phantoms.tube_patches(spark)
    v = phantoms.patch_voxels(p)
    one = volume.assembled(p, v).toPandas().sort_values(["x", "y", "z"])
    two = volume.assembled(p, v.orderBy(F.desc("step_id")), patch_limit=0).toPandas().sort_values(["x", "y", "z"])
    np.testing.assert_allclose(one["v"], two["v"])


def test_components_of_a_long_path_and_of_nothing(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = graph.label_components(spark.range(n + 1).withColumnRenamed("id", "node"), edges).toPandas().set_index("node")["component"].sort_index()
    assert (out.loc[: n - 1] == 0).all() and out.loc[n] == n
    assert graph.label_components(spark.range(2).withColumnRenamed("id", "node"), edges.limit(0)).count() == 2
    with pytest.raises(ValueError):
        graph.voxel_components(phantoms.blobs(spark), (12, 12, 12), 18)


def test_seeds_outside_fall_back_to_the_largest(spark):
    labelled = graph.voxel_components(phantoms.blobs(spark), (12, 12, 12), 26)
    out = graph.components_of_seeds(labelled, spark.createDataFrame([(0, 0, 0)], "x int, y int, z int"))
    assert out.count() == 54


def test_smoothing_keeps_a_torus_and_its_volume(spark):
    from arbora.queries import torus

    points, cells = torus(spark)
    before = mesh.enclosed_volume(points, cells).first()[0]
    after = mesh.enclosed_volume(mesh.taubin(points, cells, rounds=2), cells).first()[0]
    assert abs(after / before - 1) < 0.05
    p, c = (spark.createDataFrame(t) for t in mesh.sphere(12))
    assert abs(mesh.enclosed_volume(p, c).first()[0] - 4.1) < 0.1
    q = spark.createDataFrame([(0, 0.1, 0.2, 0.0), (1, 2.0, 0.0, 0.0)], "query_id int, x double, y double, z double")
    assert {r.query_id: r.inside for r in mesh.inside_closed_mesh(q, p, c, 0.3).collect()} == {0: True, 1: False}
    assert mesh.caps(p, c).count() == 0
    twice = mesh.appended([(p, c), (p, c)])
    assert mesh.cleaned(*twice)[0].count() == p.count()


def test_loop_smoothing_is_cyclic(spark):
    rows = pd.DataFrame({"line_id": 1, "seq": range(8), "x": np.cos(np.arange(8) * np.pi / 4), "y": np.sin(np.arange(8) * np.pi / 4), "z": 0.0})
    out = polyline.smooth_closed(spark.createDataFrame(rows), passes=1).toPandas()
    assert np.allclose(np.hypot(out["x"], out["y"]), 1 - 0.2 * (1 - np.cos(np.pi / 4)))


def test_lines_of_one_point_and_repeated_points(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 0, 1.0, 1.0, 1.0), (2, 1, 1.0, 1.0, 1.0)], "line_id int, seq int, x double, y double, z double")
    assert {r.line_id: r.length for r in polyline.lengths(rows).collect()} == {1: 0.0, 2: 0.0}
    assert polyline.resample(rows, 5).count() == 0
    assert all((r.tx, r.ty, r.tz) == (0, 0, 1) for r in polyline.tangents(rows).collect())
    with pytest.raises(ValueError):
        polyline.resample(rows, 1)


def test_lengths_that_round_alike_tie(spark, tmp_path):
    import duckdb

    from arbora import queries

    rows = pd.DataFrame([(i, 97 * i, 13 * u, float(v)) for i, (u, v) in enumerate([(1, 0), (1, 1.00001), (2, 0), (2, 1.00002), (3, 0), (3, 2)])], columns=["ts", "event_id", "user_id", "value"])
    rows.to_parquet(tmp_path / "events.parquet")
    got = queries.QUERIES["line_longest_first"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(queries.ORACLES["line_longest_first"]).df()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, want.to_numpy())) == [(13, 1.0, 2), (26, 1.0, 3), (39, 2.0, 1)]
    lines = spark.createDataFrame([(u, i, v, 0.0, 0.0) for u, w in ((1, 1.00001), (2, 1.00002)) for i, v in enumerate((0.0, w))], "line_id int, seq int, x double, y double, z double")
    assert {r.line_id: r["rank"] for r in polyline.longest_first(lines).collect()} == {1: 2, 2: 1}


def _nearest_segments(q, s, radius):
    """By brute force: query -> (segment, distance)."""
    a, b = s[:, :3], s[:, 3:]
    ab = b - a
    size = (ab * ab).sum(1)
    out = {}
    for i, p in enumerate(q):
        t = np.where(size < 1e-30, 0, np.clip(((p - a) * ab).sum(1) / np.where(size < 1e-30, 1, size), 0, 1))
        d = np.sqrt(((p - a - t[:, None] * ab) ** 2).sum(1))
        k = min(range(len(d)), key=lambda j: (round(d[j], 12), j))
        if d[k] <= radius:
            out[i] = (k, d[k])
    return out


def test_nearest_segments_of_dense_sparse_and_odd_places(spark):
    rng = np.random.default_rng(5)
    q = np.vstack([rng.normal(0, 0.02, (900, 3)), rng.uniform(-2, 2, (60, 3)), [[0.5, 0.5, 0.5]] * 40, [[50.0, 0, 0]]])
    a = np.vstack([rng.normal(0, 0.02, (900, 3)), rng.uniform(-2, 2, (30, 3)), [[0.5, 0.5, 0.25]] * 30])
    b = np.vstack([rng.normal(0, 0.02, (900, 3)), rng.uniform(-2, 2, (30, 3)), [[0.5, 0.25, 0.5]] * 20, [[0.5, 0.5, 0.25]] * 10])
    s = np.hstack([a, b])
    queries = pd.DataFrame(q, columns=list("xyz")).assign(query_id=range(len(q)))
    segments = pd.DataFrame(s, columns=["ax", "ay", "az", "bx", "by", "bz"]).assign(segment_id=range(len(s)))
    radii = spatial._segment_radii(spark.createDataFrame(queries), spark.createDataFrame(segments), 1.0)
    assert len(radii) > 1 and radii[-1] == 1.0  # the dense part isn't searched with the whole radius
    odd = pd.DataFrame([(np.nan, 0.0, 0.0, 5001), (np.inf, 0.0, 0.0, 5002), (0.0, -np.inf, 0.0, 5003)], columns=["x", "y", "z", "query_id"])
    ends = pd.DataFrame([(np.inf, 0.0, 0.0, 0.0, 0.0, 0.0, 5001), (0.0, 0.0, np.nan, 0.0, 0.0, 0.0, 5002)], columns=segments.columns)
    for radius in (1.0, 0.01):
        got = spatial.nearest_segment(spark.createDataFrame(pd.concat([queries, odd])), spark.createDataFrame(pd.concat([segments, ends])), radius).collect()
        want = _nearest_segments(q, s, radius)
        assert {r.query_id: r.segment_id for r in got} == {i: k for i, (k, _) in want.items()} and len(got) == len(want)
        assert all(abs(r.distance - want[r.query_id][1]) < 1e-12 for r in got)
    none = spark.createDataFrame(segments).limit(0)
    assert spatial.nearest_segment(spark.createDataFrame(queries), none, 1.0).count() == 0
    assert spatial.nearest_segment(spark.createDataFrame(queries).limit(0), spark.createDataFrame(segments), 1.0).count() == 0


def test_nearest_without_points(spark):
    none = spark.createDataFrame([], "point_id long, x double, y double, z double")
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "query_id long, x double, y double, z double")
    assert spatial.nearest(one, none).count() == 0
    with pytest.raises(ValueError):
        spatial.within(one, none, 0.0)


def test_greedy_merge_is_in_order(spark):
    rows = pd.DataFrame({"case": 1, "seq": [0, 1, 2, 3], "x": [0, 0.5, 1.2, 0.1], "y": 0.0, "z": 0.0, "tx": [0, 0, 0, 1.0], "ty": 0.0, "tz": [1.0, 1.0, 1.0, 0], "radius": 0.5})
    assert sorted(r.seq for r in tree.merged_potentials(spark.createDataFrame(rows)).collect()) == [0, 2, 3]


def test_files_round_trip(spark, tmp_path):
    block = (np.arange(60).reshape(5, 4, 3) % 7).astype("i2")
    (tmp_path / "a.mha").write_bytes(files.meta_image(block, (1.0, 2.0, 0.5), (3.0, 0.0, -1.0)))
    got = files.read_volumes(spark, str(tmp_path / "a.mha")).toPandas()
    assert (got["v"].to_numpy() == block[tuple(got[["x", "y", "z"]].to_numpy().T)]).all() and len(got) == 60
    assert files.read_volumes(spark, str(tmp_path / "a.mha"), True).count() == (block != 0).sum()
    (tmp_path / "s.json").write_text('[{"name": "c1", "seeds": [[[0,0,0],[1,2,3],4]]}]')
    assert [(r.case, r.x, r.radius) for r in files.read_seeds(spark, str(tmp_path / "s.json")).collect()] == [("c1", 1.0, 4.0)]
    names = ["id", "x", "y", "z", "tx", "ty", "tz", "rx", "ry", "rz"]
    samples = pd.DataFrame([[i, i * 0.1, 0, 1 / 3, 0, 0, 1, 1, 0, 0] for i in range(4)], columns=names)
    (tmp_path / "p.pth").write_text(files.path_document(samples, 7))
    back = files.read_paths(spark, str(tmp_path / "p.pth")).toPandas().sort_values("id")
    assert (back["path_id"] == 7).all() and np.allclose(back[names[1:]], samples[names[1:]])
    with pytest.raises(ValueError):
        files.contour_document("p", 1, [np.zeros((2, 3))], samples[:1])


def test_stream_equals_batch(spark, tmp_path):
    p = phantoms.tube_patches(spark)
    rows = phantoms.patch_voxels(p).join(p, "step_id").select((F.col("i") + F.col("ix")).alias("x"), (F.col("j") + F.col("iy")).alias("y"), (F.col("k") + F.col("iz")).alias("z"), "i", "j", "k", "sx", "sy", "sz", "v")
    rows.write.parquet(str(tmp_path / "in"))
    q = assembled_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "assembled", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = spark.table("assembled").toPandas().sort_values(["x", "y", "z"])
    want = volume.assembled(p, phantoms.patch_voxels(p)).toPandas().sort_values(["x", "y", "z"])
    np.testing.assert_allclose(got["v"], want["v"])


def test_trace_finds_one_fork_and_both_arms(spark):
    from arbora.queries import QUERIES

    steps = QUERIES["plan_trace_steps"](spark, "").toPandas()
    assert steps["branch_id"].nunique() == 2 and (steps["pos"] == 0).sum() == 1
    own = steps[steps["pos"] > 0]
    assert own["step_id"].is_unique and own.groupby("branch_id")["x"].max().min() > 33
    ends = own.sort_values("pos").groupby("branch_id").last()["y"]
    assert ends.min() < 8 and ends.max() > 16


def test_presets():
    from arbora.plans.config import PRESETS, preset

    assert preset("global_coro").stop_radius == 0.4 and not preset("global_coro").prevent_retrace
    assert all(preset(n).as_dict()["add_radius"] >= 0 for n in PRESETS)
    base = preset()
    assert (base.min_radius, base.min_resolution, base.max_foreground, base.stop_radius) == (0.3, 6, 0.3, 0.46)
    assert (base.assembly_every, base.assembly_buffer, base.max_branch_steps) == (20, 20, 1000)
    assert {n for n in PRESETS if not preset(n).restart_branch} == {"global_default", "global_pulm"}
    assert {n for n in PRESETS if preset(n).chances == 3} == {"aorta_tutorial", "global_aorta", "global_coro", "global_cereb"}
    assert {n for n in PRESETS if preset(n).max_branch_steps == 100} == {"global_coro", "global_cereb", "global_pulm", "global_default"}
    with pytest.raises(FileNotFoundError):
        preset("none")


def test_contours_of_a_tube_have_its_radius(spark):
    from arbora.queries import QUERIES

    out = QUERIES["sample_contours"](spark, "").toPandas()
    assert len(out) >= 4 and (abs(out["mean_radius"] - 3.4) < 0.4).all() and (out["points"] > 12).all()


def test_second_line_ends_where_it_meets_the_first(spark):
    from arbora.queries import QUERIES

    out = QUERIES["sample_merged_lines"](spark, "").toPandas()
    branch = out[out["line_id"] == 1]
    assert len(out[out["line_id"] == 0]) == 21 and branch["seq"].min() == 10
    assert (branch["parent_line"] == 0).all() and (branch["parent_seq"] == 10).all()


def test_seeded_voxels_are_the_same(spark):
    from arbora.operators import sampling

    t = phantoms.tube(spark)
    one = sampling.random_voxels(t, 20, 3).toPandas()
    assert one.equals(sampling.random_voxels(t.repartition(5), 20, 3).toPandas()) and (one["v"] > 0).all() and len(one) == 20
    with pytest.raises(ValueError):
        sampling.outside_boxes(t, t.withColumn("side", F.lit(1.0)), limit=10)


def test_seeds_outside_raise_with_all_of_them(spark):
    from arbora.plans import seeds

    rows = seeds.seeds_at_points(spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (9.0, 1.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0)], "x double, y double, z double, radius double"))
    assert rows.count() == 3 and seeds.checked(rows.limit(1), (5, 5, 5)).count() == 1
    with pytest.raises(ValueError, match="^2 seeds"):
        seeds.checked(rows, (5, 5, 5))
