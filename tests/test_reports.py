"""Reports, camera groups, frames and the smaller rewrites."""

from pyspark.sql import functions as F

from fieldloom.functions import expr
from fieldloom.operators import graph, reports


def test_policies(spark):
    df = spark.createDataFrame([(1, True, False), (1, True, False), (2, True, True), (3, True, False), (3, False, False)], "c int, p boolean, r boolean")
    got = {r.c: (r.consistent, r.fixed) for r in reports.camera_policy(df, "c", "p", "r").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_first_existing(spark):
    there = spark.createDataFrame([("b1",), ("c1",), ("c2",)], "path string")
    got = reports.first_existing(spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k", [F.concat(F.lit(x), F.col("k").cast("string")) for x in "abc"], there, "path")
    assert {r.k: r.path for r in got.collect()} == {1: "b1", 2: "c2", 3: None}


def test_frames(spark):
    f = spark.createDataFrame([(1, 0, 10), (1, 9, 77), (2, 0, 11), (2, 9, 78), (3, 0, 12), (3, 0, 10)], "frame_id int, sensor_type int, data_id long")
    left = reports.frames_without(f, spark.createDataFrame([(11,)], "image_id long"), 0)
    assert sorted((r.frame_id, r.data_id) for r in left.collect()) == [(1, 10), (1, 77), (3, 10), (3, 12)]
    assert {r.problem: r.n for r in reports.frame_problems(f, spark.createDataFrame([(10,), (11,)], "image_id long"), 0).collect()} == {"image_in_several_frames": 1, "unknown_image": 1}


def test_groups_are_numbered_as_they_appear(spark):
    df = spark.createDataFrame([(0, "b", None), (1, "a", 1), (2, "b", None), (3, "a", 2)], "i int, m string, f int")
    assert {r.i: r.group for r in reports.camera_groups(df, ["m", "f"], "i").collect()} == {0: 0, 1: 1, 2: 0, 3: 2}


def test_appended_points(spark):
    p = spark.createDataFrame([(5, 1.0)], "point3d_id long, error double")
    o = spark.createDataFrame([(1, 0, 0.0, 0.0, 5)], "image_id int, point2d_idx int, x double, y double, point3d_id long")
    new = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "n string, error double")
    seen = spark.createDataFrame([("a", 1, 1.0, 1.0), ("b", 1, 2.0, 2.0), ("b", 2, 3.0, 3.0)], "n string, image_id int, x double, y double")
    points, obs = reports.appended_points(p, o, new, seen, "n")
    assert sorted(r.point3d_id for r in points.collect()) == [5, 6, 7]
    assert sorted((r.image_id, r.point2d_idx, r.point3d_id) for r in obs.collect()) == [(1, 0, 5), (1, 1, 6), (1, 2, 7), (2, 0, 7)]


def test_gates_and_best_model(spark):
    m = spark.createDataFrame([(1, 9, 10, 500, 0, False), (2, 9, 10, 50, 0, False), (3, 5, 10, 500, 0, False), (4, 9, 10, 500, 1, False), (5, 9, 10, 500, 0, True)], "i int, r int, t int, p int, u int, b boolean")
    assert [x.failed for x in reports.reconstruction_gate(m, "r", "t", "p", "u", "b", 0.8, 100).orderBy("i").collect()] == [None, "min_points3D", "registered_ratio", "unsupported_frames", "continuity"]
    runs = spark.createDataFrame([("g", False, 99, 9, 9, "x"), ("g", True, 5, 9, 9, "y"), ("g", True, 5, 10, 1, "z")], "g string, ok boolean, r int, p int, n int, id string")
    assert reports.best_model(runs, ["g"], "ok", "r", "p", "n", "id").first().best == "z"


def test_masked_psnr_and_widest_angle(spark):
    px = spark.createDataFrame([("a", 0.5, 0.4, True), ("a", 0.9, 0.0, False), ("b", 0.5, 0.5, True)], "v string, x double, y double, m boolean")
    got = {r.v: r.psnr for r in reports.masked_psnr(px, ["v"], "x", "y", "m").collect()}
    assert abs(got["a"] - 20) < 1e-9 and got["b"] is None
    rays = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0]), (1, 1, [-0.5, 3**0.5 / 2, 0.0])], "t int, i int, r array<double>")
    assert abs(reports.widest_angles(rays, "t", "i", "r").first().angle - 60) < 1e-9


def test_maps_and_sizes(spark):
    row = spark.createDataFrame([({"a_m": 1.0, "b": 2.0}, {"b": 3.0}, 101, 51)], "m map<string,double>, n map<string,double>, w int, h int")
    r = row.select(expr.relabelled(F.col("m"), F.lit(False)), expr.patched(F.col("m"), F.col("n")), *expr.shrunk(F.col("w"), F.col("h"), 50)).first()
    assert r[0] == {"a_model_units": 1.0, "b": 2.0} and r[1] == {"a_m": 1.0, "b": 3.0} and (r[2], r[3]) == (50, 25)
    edges = expr.crop_edges(*(F.lit(v) for v in (3, 5, 17, 30)), F.lit(20), F.lit(32), 8)
    assert list(spark.range(1).select(*edges).first()) == [0, 0, 20, 32]


def test_smallest_rotation(spark):
    for a, b in (((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)), ((0.6, 0.8, 0.0), (0.6, 0.8, 0.0)), ((0.0, 0.0, 1.0), (0.0, 0.0, -1.0)), ((1.0, 0.0, 0.0), (-1.0, 0.0, 0.0))):
        r = expr.turning([F.lit(v) for v in a], [F.lit(v) for v in b])
        turned = spark.range(1).select(*(sum((r[i][j] * a[j] for j in range(3)), F.lit(0.0)) for i in range(3))).first()
        assert all(abs(x - y) < 1e-9 for x, y in zip(turned, b, strict=True))


def test_prefixes_support_and_change(spark):
    n = spark.createDataFrame([("a/b/1",), ("a/2",), ("z",)], "name string")
    p = spark.createDataFrame([("a/", 1), ("a/b/", 2)], "prefix string, v int")
    assert {r.name: r.v for r in graph.longest_prefix(n, "name", p, "prefix", ["v"]).collect()} == {"a/b/1": 2, "a/2": 1, "z": None}
    q = spark.createDataFrame([("q", [1, 2]), ("q", [1, 1])], "q string, anchors array<int>")
    assert [(r.anchor, r.inliers) for r in graph.anchor_support(q, "q", "anchors", 2).collect()] == [(1, 2)]
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(1, 1.5), (3, 2.0)], "k int, v double")
    assert tuple(graph.largest_change(a, b, "k", ["v"]).first()) == (2, 0.5)
    ok, no = F.lit(True), F.lit(False)
    assert spark.range(1).select(expr.match_reason(ok, F.lit(0.5), ok, no, no, ok, ok), expr.match_reason(ok, F.lit(0.2), ok, ok, ok, ok, ok)).first()[:2] == ("mask_a", None)
