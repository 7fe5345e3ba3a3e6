"""Rules that have to be the reference's, on small cases worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import expr
from fieldloom.operators import geometry, graph, motion, reports, rigs, robust, scene, select, spatial
from fieldloom.plans.stages import Plan, Run, Stage


def test_numbered_keeps_every_row_at_size(spark):
    n = 2_000_000
    df = spark.range(n).select(F.pmod(F.col("id") * 7919 + 13, F.lit(n)).alias("k"), F.repeat(F.lit("x"), 120).alias("wide"), F.rand(1).alias("noise"))
    got = spatial.numbered(df, ["k"]).agg(F.count("*"), F.sum((F.col("__at") == F.col("k")).cast("long")), F.count_distinct("__at")).first()
    assert tuple(got) == (n, n, n)


def test_mode_is_the_fullest_bin_of_its_own(spark):
    # Bins 0 (10), 1 (10), 2 (10) have more support together; bin 9 alone is the fullest.
    rows = [(0, float(b) + 0.5, 10, k) for k, b in enumerate((0, 1, 2))] + [(0, 9.5, 1, 10 + k) for k in range(40)]
    s = robust.dominant_offset(spark.createDataFrame(rows, "g int, off double, w int, ord int"), ["g"], "off", "w", "ord").first()
    assert (s.n, s.support, s.second, s.accepted, s.centre) == (43, 40.0, 30.0, True, 9.5)


def test_outliers_are_shared_captures_else_the_later_end(spark):
    of = lambda e: {r[0] for r in graph.outlier_captures(spark.createDataFrame(e, "a int, b int")).collect()}
    assert of([(4, 5), (5, 6)]) == {5} and of([(10, 11)]) == {11} and of([(1, 2), (1, 2)]) == {2} and of([(1, 2), (2, 3), (3, 4)]) == {2, 3}


def test_bridges_by_policy():
    at = lambda t, p, q: {"t": int(t * 1e6), "position": p, "quality": q, "valid": True, "bridgeable": True}
    frames = [at(0, 0, 1), at(1, 3.0, 9), at(2, 8.0, 5), at(2.5, 10.5, 3), at(3, 30.0, 4), at(4, 40.0, 1)]
    go = lambda policy, most=0, gap=3.5: select.bridge(frames, [0, 5], gap, most, policy, 10.0)
    assert go("quality")[0] == [0, 2, 5]  # the best of the later half
    assert go("parallax")[0] == [0, 3, 5]  # nearest to the target
    assert go("balanced")[0] == [0, 2, 5]  # the best of those within 1.5 targets
    assert go("quality", most=2) == ([0, 5], 1) and go("quality", gap=0) == ([0, 5], 0)
    ties = [at(0, 0, 1), at(2, 8, 5), at(3, 8, 5), at(4, 9, 1)]
    assert select.bridge(ties, [0, 3], 3.5, 0)[0] == [0, 2, 3]  # of equal ones the later


def test_unmeasured_frames_move_too(spark):
    s, f = spark.createDataFrame([(1, 10), (1, 50)], "g int, at int"), spark.createDataFrame([(1, 9, 0.1), (1, 11, 9.0)], "g int, at int, m double")
    assert {r.chosen: r.frame for r in select.nudged(s, f, "g", "at", "m", 1.0, 2).collect()} == {10: 9, 50: 50}


def test_thin_prism_terms_are_of_the_undistorted_point():
    p = [100.0, 110.0, 50.0, 60.0, 0.1, -0.02, 0.01, -0.015, 0.003, 0.001, 0.004, -0.006]
    ray = np.array([[0.3, -0.2, 0.9]])
    r = np.hypot(0.3, 0.2)
    t = np.arctan2(r, 0.9)
    x, y = 0.3 * t / r, -0.2 * t / r
    f = 1 + 0.1 * t**2 - 0.02 * t**4 + 0.003 * t**6 + 0.001 * t**8
    u = x * f + 2 * 0.01 * x * y - 0.015 * (t * t + 2 * x * x) + 0.004 * t * t
    v = y * f - 2 * 0.015 * x * y + 0.01 * (t * t + 2 * y * y) - 0.006 * t * t
    got = geometry.ray_to_pixel("THIN_PRISM_FISHEYE", p, ray)
    assert np.allclose(got, [[100 * u + 50, 110 * v + 60]])
    assert np.allclose(geometry.pixel_to_ray("THIN_PRISM_FISHEYE", p, got), ray / np.linalg.norm(ray), atol=1e-9)
    behind = geometry.ray_to_pixel("OPENCV_FISHEYE", [1.0, 1, 0, 0, 0, 0, 0, 0], np.array([[1.0, 0, -1]]))
    assert np.allclose(behind, [[np.pi * 3 / 4, 0]])


def test_classes_and_advice(spark):
    rows = spark.createDataFrame([(["SPHERICAL"],), (["PINHOLE", "OPENCV_FISHEYE"],), (["SIMPLE_RADIAL"],), (["SIMPLE_PINHOLE"],), (["X"],)], "m array<string>")
    assert [r[0] for r in rows.select(expr.camera_class(F.col("m"))).collect()] == ["equirect", "fisheye", "distorted_pinhole", "pinhole", "other"]
    a = expr.training_advice(F.col("n"), F.col("e"), F.col("p"), F.col("m"))
    got = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (50, 2.0, 9.0, 1.0)], "n long, e double, p double, m double").select(a["cap"], a["warnings"]).collect()
    assert [tuple(r) for r in got] == [(1_000_000, []), (1_000_000, ["high_reproj_error", "sparse_point_cloud", "wide_sparse_point_distribution"])]


def test_settings_of_resolution(spark):
    s = spark.createDataFrame([("equirectangular", 7680, 3840, True), ("dual_fisheye", 3000, 3000, True), ("perspective", 9000, 9000, True), ("equirectangular", 99999, 9, False), ("perspective", None, 5, True)], "k string, w int, h int, on boolean")
    assert tuple(reports.resolution_needs(s, "k", "w", "h", "on").first()) == (7680, 32768, 4096, 2048)
    assert tuple(reports.resolution_needs(s, "k", "w", "h", "on", rig=True).first()) == (2048, 8192, 2048, 2048)
    assert tuple(reports.resolution_needs(s.limit(0), "k", "w", "h", "on").first()) == (2048, 8192, 2048, 1024)


def test_scale_needs_stereo(spark):
    r = spark.createDataFrame([(g, 2.0 + 0.001 * (k % 3)) for g in (1, 2, 3) for k in range(5 if g == 3 else 20)], "g int, r double")
    seen = spark.createDataFrame([(1, p, c, s) for p in range(9) for c in range(9) for s in (0, 1)] + [(2, p, c, 0) for p in range(9) for c in range(9)], "g int, p int, c int, s int")
    got = {x.g: x for x in robust.metric_scale(r, ["g"], "r", robust.stereo_observability(seen, ["g"], "p", "c", "s")).collect()}
    assert got[1].metric and got[1].applied and abs(got[1].scale - 1 / 2.001) < 1e-6 and (got[1].stereo_points, got[1].stereo_captures) == (9, 9)
    assert (got[2].reason, got[2].scale, got[3].reason) == ("rig_baseline_not_observable", None, "too_few_registered_rig_baselines")


def test_local_motion_finds_the_jump(spark):
    rows = [("s", k, 0.5 * k, float(k), 0.0 if k != 20 else 9.0, 0.0) for k in range(40) if k != 30] + [("few", k, float(k), 0.0, 0.0, 0.0) for k in range(6)]
    d = {r["k"]: r for r in motion.local_motion(spark.createDataFrame(rows, "src string, k long, t double, x double, y double, z double"), "src", "k", "t", ["x", "y", "z"], "k").collect()}
    assert [k for k, r in d.items() if r.suspect] == [20] and abs(d[20].innovation - 9) < 1e-6 and 30 not in d and 20 not in d[22].neighbours
    assert 0 not in d and 1 not in d and 2 in d and abs(d[10].step - 1) < 1e-9


def test_timed_gravity_finds_offset_and_mounting(spark):
    r = np.random.default_rng(2)
    mount, up, off = motion.mountings()[7], np.array([0.0, -1.0, 0.0]), 0.1
    q = r.standard_normal((30, 4)) * [0.2, 1, 1, 1] + [2, 0, 0, 0]
    q /= np.linalg.norm(q, axis=1)[:, None]
    w, x, y, z = q.T
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]).transpose(2, 0, 1)
    frames = spark.createDataFrame([("a", float(k), [float(v) for v in q[k]]) for k in range(30)], "src string, t double, q array<double>")
    acc = [("a", k + off + d, [float(v) for v in mount.T @ turn[k] @ up * 9.81]) for k in range(30) for d in (-0.01, 0.0, 0.01)]
    g = motion.timed_gravity(frames, spark.createDataFrame(acc, "src string, t double, acceleration array<double>"), "src").first()
    assert g.reason is None and abs(g.offset - off) <= 0.036 and np.allclose(np.array(g.mounting).reshape(3, 3), mount) and np.allclose(g.up, up, atol=1e-6) and g.inliers == 30
    assert motion.timed_gravity(frames.limit(3), spark.createDataFrame(acc, "src string, t double, acceleration array<double>"), "src").first().reason == "too_few_timed_front_images"


def test_planes_and_exact_alignment():
    planes = np.array([(5, 0.0, 1.0), (9, 0.01, 1.1), (4, 1.5, 1.0), (3, 3.14, 1.05)])
    assert planes[scene.distinct_planes(*planes.T, 0.1), 0].tolist() == [9, 4]
    a = np.random.default_rng(1).standard_normal((5, 3))
    scale, r, t = motion.exact_alignment(a, 2 * a + 1)
    assert abs(scale - 2) < 1e-9 and np.allclose(r, np.eye(3)) and np.allclose(t, 1)


def test_migrated_strokes_and_fisheye_region(spark):
    old = spark.createDataFrame([(1, "lens0", 0.9, 2, [(None,), (4,), (None,)]), (2, "lens0", 0.001, 3, None)], "id int, view string, r double, coordinate_version int, operations array<struct<stroke_id:int>>")
    got = {m.id: m for m in rigs.migrated_regions(old, spark.createDataFrame([], "id int")).collect()}
    assert (got[1].r, got[1].capped, got[1].needs_review, [o.stroke_id for o in got[1].operations]) == (0.5, True, True, [5, 4, 6])
    assert (got[2].r, got[2].capped, got[2].needs_review) == (0.01, False, False)
    i = spark.createDataFrame([(1, 8, 8, "fisheye", 0.5, 0.5, 0.5, [], "OPENCV_FISHEYE", [4.0, 4.0, 4.0, 4.0, 0.0, 0.0, 0.0, 0.0], 0.7)], "id int, width int, height int, kind string, cx double, cy double, r double, operations array<struct<mode:string,x:double,y:double,r:double>>, model string, params array<double>, most double")
    b = rigs.pixel_bounds(rigs.region_pixels(i, "id", theta="most"), "id").first()
    assert tuple(b)[1:] == (1.0, 1.0, 7.0, 7.0)
    assert not rigs.is_monotone([1, 1, 0, 0, -0.5, 0, 0, 0], "OPENCV_FISHEYE", 1.2) and rigs.is_monotone([1, 1, 0, 0, 0.1, 0, 0, 0], "OPENCV_FISHEYE", 1.5)


def test_a_result_moved_aside_comes_back(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(5).write.parquet(str(src))
    run = Run(spark, Plan([Stage("double", ("src",), lambda t, p: t["src"].selectExpr("id * 2 AS v"))]), str(tmp_path / "out"), {"src": spark.read.parquet(str(src))})
    assert run.stage("double") == "made"
    (tmp_path / "out" / "double").rename(tmp_path / "out" / "double.old")
    run.restored("double")
    assert run.table("double").count() == 5 and not (tmp_path / "out" / "double.old").exists()


def test_jacobian_is_the_slope_of_the_projection(spark):
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    jac = np.array([[25, 0, -6.25], [0, 30, -15]]) @ turn
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([1.0, 2.0, -4.0],)], "local array<double>").withColumns({"rotation": F.array(*(F.lit(float(v)) for v in turn.ravel())), "model": F.lit("PINHOLE"), "params": F.array(*(F.lit(float(v)) for v in (100, 120, 5, 6)))})
    got = geometry.jacobians(df, "local", "rotation").collect()
    assert np.allclose(got[0].pixel, [30, 66]) and np.allclose(got[0].jacobian, jac.ravel(), atol=1e-6) and got[1].pixel is None


def test_match_tables_and_readers(spark, tmp_path):
    from fieldloom.sources import model_files as m

    pairs = spark.createDataFrame([(1, 2, bytearray(np.array([[3, 4], [5, 6]], "<u4").tobytes())), (1, 3, None), (2, 3, bytearray(np.array([[7, 8]], "<u4").tobytes()))], "a long, b long, data binary").select(expr.pair_id("a", "b").alias("pair_id"), "data")
    rows = m.match_rows(pairs)
    assert {tuple(r) for r in rows.collect()} == {(1, 2, 3, 4), (1, 2, 5, 6), (2, 3, 7, 8)}
    keys = m.keypoint_rows(spark.createDataFrame([(9, 4, bytearray(np.arange(8, dtype="<f4").tobytes()))], "image_id long, cols int, data binary"))
    assert [tuple(r) for r in keys.orderBy("point2d_idx").collect()] == [(9, 0, 0.0, 1.0), (9, 1, 4.0, 5.0)]
    images = spark.createDataFrame([(1, True, "a", 0), (2, False, "a", 1), (3, False, "b", 0)], "image_id long, held_out boolean, source_id string, capture_index int")
    links, eligible = m.heldout_links(rows.unionByName(spark.createDataFrame([(1, 3, 3, 1)], rows.schema)), images)
    assert links.count() == 3 and [tuple(r) for r in eligible.collect()] == [(1, 3)]
    (tmp_path / "t.jsonl").write_text('{"t": 1.0, "gpu_memory_mib": 5}\n')
    assert tuple(m.read("telemetry", spark, str(tmp_path / "t.jsonl")).first()) == (1.0, 5.0, None)
