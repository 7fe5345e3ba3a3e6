"""Scenarios of single operators on small data made here."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import expr
from fieldloom.operators import geometry, graph, robust, select, spatial, temporal
from fieldloom.plans.stages import Plan, Run, Stage
from fieldloom.sources import model_files
from fieldloom.streaming import events


def test_pair_ids_come_back(spark):
    r = spark.createDataFrame([(7, 3), (3, 7), (1, 2**31 - 2)], "a long, b long").withColumn("p", expr.pair_id("a", "b"))
    assert [tuple(x) for x in r.select(expr.pair_low("p"), expr.pair_high("p")).collect()] == [(3, 7), (3, 7), (1, 2**31 - 2)]


def test_rotation_and_back(spark):
    q = [0.8, 0.1, -0.5, 0.3]
    n = math.sqrt(sum(x * x for x in q))
    back = expr.quaternion(expr.rotation([F.lit(x / n) for x in q]))
    assert np.allclose(list(spark.range(1).select(*back).first()), [x / n for x in q])
    turn = expr.quaternion(expr.rotation([F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)]))
    assert np.allclose(np.abs(list(spark.range(1).select(*turn).first())), [0, 0, 1, 0])


def test_triangulation_of_two_rays(spark):
    v = lambda *x: [F.lit(float(k)) for k in x]
    t = expr.triangulated(v(0, 0, 0), v(0, 0, 1), v(1, 0, 0), v(-1, 0, 1))
    r = spark.range(1).select(*(c.alias(k) for k, c in t.items())).first()
    assert np.allclose([r.x, r.y, r.z, r.gap, r.parallax], [0, 0, 1, 0, 45])
    p = expr.triangulated(v(0, 0, 0), v(0, 0, 1), v(1, 0, 0), v(0, 0, 1))
    assert math.isnan(spark.range(1).select(p["depth_1"]).first()[0])


def test_path_rules(spark):
    names = ["a/b", "/a", "../a", "a/../b", "", "C:\\x", "a\\b", None]
    r = spark.createDataFrame([(n,) for n in names], "n string").select(expr.safe_path(F.col("n"))).collect()
    assert [x[0] for x in r] == [True, False, False, False, False, False, True, False]


def test_trajectory_jump_is_found(spark):
    rows = [("a", k, 0.8 * k + (40 if k == 25 else 0)) for k in range(50)] + [("b", k, 0.8 * k) for k in range(50)]
    steps = robust.trajectory_steps(spark.createDataFrame(rows, "source string, capture int, x double"), "source", "capture", ["x"])
    g = {r.source: r for r in robust.trajectory_gate(steps, "source").collect()}
    assert g["b"].passed and abs(g["b"].median - 0.8) < 1e-9 and not g["a"].passed and g["a"].jumps == 2


def test_gap_in_captures_makes_no_step(spark):
    steps = robust.trajectory_steps(spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("a", 4, 9.0)], "source string, capture int, x double"), "source", "capture", ["x"])
    assert [r.step for r in steps.collect()] == [1.0]


def test_dominant_offset_accepts_a_mode_and_rejects_noise(spark):
    rows = [("a", 5.0 + k / 100, 3, k) for k in range(30)] + [("a", 40.0, 1, 99)] + [("b", 10.0 * k, 1, k) for k in range(30)] + [("c", 1.0, 1, 1)]
    r = {x.g: x for x in robust.dominant_offset(spark.createDataFrame(rows, "g string, off double, w int, ord int"), ["g"], "off", "w", "ord").collect()}
    assert r["a"].accepted and abs(r["a"].centre - 5.14) < 0.02
    assert not r["b"].accepted and r["b"].centre is None and not r["c"].accepted


def test_asof_ties_and_buckets(spark):
    p = spark.createDataFrame([(1, "k", 10.0), (2, "k", 95.0), (3, "z", 1.0), (4, "k", 500.0)], "id long, k string, t double")
    b = spark.createDataFrame([("k", 8.0, "x"), ("k", 12.0, "y"), ("k", 300.0, "w")], "k string, t double, v string")
    near = {r.id: r.m_v for r in temporal.asof(p, b, "k", "t", ["v"], bucket=50.0).collect()}
    assert near == {1: "x", 2: "y", 3: None, 4: "w"}
    ahead = {r.id: r.m_v for r in temporal.asof(p, b, "k", "t", ["v"], "forward", 50.0).collect()}
    assert ahead == {1: "y", 2: "w", 3: None, 4: "w"}
    back = {r.id: r.m_v for r in temporal.asof(p, b, "k", "t", ["v"], "backward", 50.0).collect()}
    assert back == {1: "x", 2: "y", 3: None, 4: "w"}


def test_time_gap_never_takes_null_times(spark):
    r = spark.createDataFrame([("a", "a", 0.0, 99.0), ("a", "a", None, 99.0), ("a", "b", 0.0, 99.0), ("a", "a", 0.0, 1.0)], "source_a string, source_b string, t_a double, t_b double")
    assert [x[0] for x in r.select(temporal.too_far_in_time(r, 10.0)).collect()] == [True, False, False, False]
    assert not any(x[0] for x in r.select(temporal.too_far_in_time(r, 0)).collect())
    with pytest.raises(ValueError):
        temporal.too_far_in_time(r, -1)


def test_tried_pairs_are_not_missing(spark):
    images = spark.createDataFrame([(k, "s", k) for k in range(1, 5)], "id long, s string, c int")
    tried = spark.createDataFrame([(1, 2), (4, 3)], "a long, b long")
    m = temporal.missing_neighbours(images, ["s"], "c", "id", 2, tried)
    assert {tuple(r) for r in m.collect()} == {(2, 3), (1, 3), (2, 4)}


def test_gate_takes_the_first_reason(spark):
    r = spark.createDataFrame([(1.0, False, 0, 9.0), (50.0, False, 0, 9.0), (50.0, True, 0, 9.0), (50.0, True, 9, 9.0), (50.0, True, 9, 1.0)], "s double, e boolean, f int, m double")
    got = r.select(select.reject_reason(F.col("s"), F.col("e"), F.col("f"), F.col("m"), 10, 5, 5.0)).collect()
    assert [x[0] for x in got] == ["blur", "exposure", "few_features", "rolling_shutter", None]


def test_selection_clears_its_window_and_keeps_both_ends():
    f = [{"position": float(p), "quality": q, "valid": True} for p, q in ((0, 1), (8, 9), (10, 1), (11, 99), (19, 1), (30, 1))]
    # 8 wins at 10 (at least 7 away, better); 11, the best of all, is then only 3 away from it, and 19 ends the next window.
    assert select.choose_spatially(f, 10, 99) == [0, 1, 4, 5]
    assert select.choose_spatially(f, 10, 2) == [0, 5]
    assert select.choose_spatially([], 10, 2) == []


def test_bridges_close_gaps():
    f = [{"t": int(k * 5e5), "position": k, "quality": 1, "bridgeable": True} for k in range(9)]
    got, left = select.bridge(f, [0, 8], 1.5, 99)
    assert left == 0 and all(f[b]["t"] - f[a]["t"] <= 1_500_000 for a, b in zip(got, got[1:]))
    assert select.bridge(f, [0, 8], 1.5, 2) == ([0, 8], 1)


def test_thinning_rules_differ(spark):
    df = spark.range(10)
    take = lambda rule: sorted(r.id for r in spatial.thinned(df, ["id"], 4, rule).collect())
    assert take("stride") == [0, 2, 5, 7] and take("floor") == [0, 3, 6, 9] and take("round") == [0, 3, 6, 9]
    assert select.spread_places(6, 3) == [0, 2, 5]


def test_runs_of_numbers():
    assert select.arithmetic_runs([1, 2, 3, 10, 12, 14, 99]) == [(1, 3, 1), (10, 14, 2), (99, 99, 0)]
    assert all(sum(map(len, p)) + len(p) - 1 <= 10 for p in select.halved(["abc"] * 9, 10))


def test_mutual_best_drops_ties(spark):
    v = spark.createDataFrame([(1, 10, 5), (1, 11, 3), (2, 10, 5), (3, 12, 4), (3, 13, 4), (4, 14, 2)], "q int, p int, votes int")
    assert {tuple(r) for r in graph.mutual_best(v, "q", "p").collect()} == {(4, 14, 2)}


def test_conflicts_are_resolved_in_order(spark):
    c = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 3, 1), (3, 3, 1), (4, 9, 9)], "id long, image long, idx long")
    taken = spark.createDataFrame([(9, 9)], "image long, idx long")
    assert sorted(r.id for r in select.conflict_free(c, taken, "id", "image", "idx").collect()) == [1, 3]


def test_strict_join_raises(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no single match"):
        graph.strict(left, right, "k").collect()


def test_integrity_and_cascade(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    obs = spark.createDataFrame([(1, 0, 0.0, 0.0, 7), (2, 0, 0.0, 0.0, 7), (3, 0, 0.0, 0.0, 7), (3, 1, 0.0, 0.0, None)], "image_id int, point2d_idx int, x double, y double, point3d_id long")
    tracks = spark.createDataFrame([(7, 1, 0), (7, 2, 0), (7, 3, 0)], "point3d_id long, image_id int, point2d_idx int")
    assert graph.integrity(images, obs, tracks).count() == 0
    gone = spark.createDataFrame([(1,), (2,)], "image_id int")
    i, o, t = graph.without_images(gone, images, obs, tracks)
    assert i.count() == 1 and t.count() == 0 and o.where("point3d_id IS NOT NULL").count() == 0 and o.count() == 2
    broken = tracks.where("image_id <> 2")
    assert {r.problem for r in graph.integrity(images, obs, broken).collect()} == {"observation_without_track"}


@pytest.mark.parametrize(("model", "params"), [("SIMPLE_PINHOLE", [500, 320, 240]), ("PINHOLE", [500, 510, 320, 240]), ("SIMPLE_RADIAL", [500, 320, 240, 0.05]), ("RADIAL", [500, 320, 240, 0.05, -0.01]), ("OPENCV_FISHEYE", [300, 300, 320, 240, 0.02, -0.01, 0.001, 0]), ("THIN_PRISM_FISHEYE", [300, 300, 320, 240, 0.02, -0.01, 0.001, 0.001, 0.0, 0.0, 0.0005, 0.0003])])
def test_cameras_undo_themselves(model, params):
    pixels = np.array([[320.0, 240.0], [400, 300], [100, 50], [500, 400]])
    assert np.allclose(geometry.ray_to_pixel(model, params, geometry.pixel_to_ray(model, params, pixels)), pixels, atol=1e-4)


def _track(n, point, noise=0.0):
    o = np.column_stack([np.linspace(-3, 3, n), np.zeros(n), np.zeros(n)])
    d = point - o + noise
    return o, d / np.linalg.norm(d, axis=1)[:, None]


def test_triangulation():
    near = np.array([0.0, 0, 10])
    assert np.allclose(geometry.triangulate(*_track(6, near)), near)


def test_split_stability(spark):
    near = np.array([0.0, 0, 10])
    o, d = _track(8, near)
    bent = d.copy()
    bent[4:] = (near + [0, 0, 2]) - o[4:]
    bent /= np.linalg.norm(bent, axis=1)[:, None]
    rows = [(1, o[k].tolist(), d[k].tolist(), k) for k in range(8)] + [(2, o[k].tolist(), bent[k].tolist(), k) for k in range(8)] + [(3, o[0].tolist(), d[0].tolist(), 0)]
    got = {r.point3d_id: r.disagreement for r in geometry.split_stability(spark.createDataFrame(rows, "point3d_id long, origin array<double>, direction array<double>, capture long")).collect()}
    assert set(got) == {1, 2} and got[1] < 1e-9 and got[2] > 0.1


def test_similarity_with_outliers():
    r = np.random.default_rng(1)
    a = r.standard_normal((30, 3))
    c = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    b = 2.5 * a @ c.T + [1, 2, 3]
    b[:6] += 5
    scale, rotation, shift, inliers = geometry.robust_similarity(a, b, 0.01, 200)
    assert abs(scale - 2.5) < 1e-9 and np.allclose(rotation, c) and np.allclose(shift, [1, 2, 3]) and inliers.sum() == 24
    assert geometry.similarity_fit(np.outer(np.arange(5.0), [1, 1, 1]), a[:5]) is None


def test_model_files_round_trip(spark, tmp_path):
    folder = tmp_path / "scene"
    folder.mkdir()
    obs = [{"point2d_idx": 0, "x": 1.5, "y": 2.5, "point3d_id": 9}, {"point2d_idx": 1, "x": 3.0, "y": 4.0, "point3d_id": None}]
    cam = [{"camera_id": 2, "model_id": 5, "width": 640, "height": 480, "params": [1.0] * 8}, {"camera_id": 1, "model_id": 1, "width": 64, "height": 48, "params": [1.0] * 4}]
    img = [{"ord": k, "image_id": i, "qvec": [1.0, 0, 0, 0], "tvec": [0.0, 0, k], "camera_id": 1, "name": f"ü{i}.jpg", "observations": obs} for k, i in enumerate((5, 3))]
    pts = [{"point3d_id": 9, "xyz": [1.0, 2, 3], "rgb": [255, 0, 7], "error": 0.5, "track": [{"image_id": 3, "point2d_idx": 0}, {"image_id": 5, "point2d_idx": 0}]}]
    made = {"cameras.bin": model_files.camera_bytes(cam), "images.bin": model_files.image_bytes(img), "points3D.bin": model_files.point_bytes(pts)}
    for name, data in made.items():
        (folder / name).write_bytes(data)
    model = model_files.read_model(spark, str(folder))
    assert [r.image_id for r in model["images"].orderBy("ord").collect()] == [5, 3]
    assert model["observations"].where("point3d_id IS NULL").count() == 2 and model["tracks"].count() == 2
    assert model["cameras"].where("model = 'OPENCV_FISHEYE'").first().camera_id == 2 and model["points"].first().rgb == [255, 0, 7]
    assert {r.file: bytes(r.content) for r in model_files.model_files(model).collect()} == made
    with pytest.raises(ValueError, match="unknown camera model"):
        list(model_files.parse_cameras(struct.pack("<QiiQQ", 1, 1, 77, 1, 1)))


def test_partial_lines_wait_for_their_end(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3')
    assert sorted(r.a for r in model_files.partial_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]


def test_boxes_and_imu():
    data = struct.pack(">I4s", 16, b"ftyp") + b"\0" * 8 + struct.pack(">I4sQ", 1, b"mdat", 20) + b"\0" * 4 + struct.pack(">I4s", 0, b"moov") + b"xx"
    assert model_files.boxes(data) == [("ftyp", 0, 8, 16), ("mdat", 16, 16, 20), ("moov", 36, 8, 10)]
    assert model_files.imu_samples(struct.pack("<Q6H", 5, 32768, 32769, 32767, 0, 0, 0), True) == [(5, 0.0, 1.0, -1.0, -32768.0, -32768.0, -32768.0)]


def test_plan_caches_and_invalidates(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(5).write.parquet(str(src))
    plan = Plan([Stage("double", ("src",), lambda t, p: t["src"].selectExpr(f"id * {p.get('by', 2)} AS id")), Stage("total", ("double",), lambda t, p: t["double"].groupBy().sum("id"))])
    assert plan.order == ["double", "total"] and plan.downstream("double") == ["total"] and plan.prerequisites("total") == ["double"]
    run = Run(spark, plan, str(tmp_path / "out"), {"src": spark.read.parquet(str(src))})
    assert run.all() == {"double": "made", "total": "made"} and run.all() == {"double": "cached", "total": "cached"}
    assert run.table("total").first()[0] == 20 and run.state() == "total"
    assert run.stage("double", {"by": 3}) == "made" and run.manifest("total") is None and run.stage("total") == "made"
    assert run.table("total").first()[0] == 30
    with pytest.raises(ValueError):
        Plan([Stage("a", ("b",), None), Stage("b", ("a",), None)])


def test_throttle():
    last = {}
    rows = [(0.0, 0.0, "progress"), (0.05, 0.5, "progress"), (0.2, 0.501, "progress"), (0.21, 0.502, "activity"), (0.25, 0.502, "activity"), (0.3, 1.0, "progress")]
    assert events.admitted(rows, last) == [rows[0], *rows[2:]]  # only events of kind progress are throttled
    with pytest.raises(ValueError):
        events.admitted([(1.0, 0.3, "progress")], last)
    silent = [(0.0, None, "progress"), (0.05, None, "progress"), (0.1, None, "progress"), (0.11, 0.5, "progress"), (0.12, 0.5 - 1e-10, "info")]
    assert events.admitted(silent, {}) == [silent[0], *silent[2:]]


def test_tail_goes_on_from_its_checkpoint(spark, tmp_path):
    seen, folder = [], tmp_path / "in"
    folder.mkdir()
    go = lambda: events.tail(spark, str(folder), "id long, job string", lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp"), job="a").awaitTermination()
    (folder / "1.json").write_text('{"id": 1, "job": "a"}\n{"id": 2, "job": "b"}\n')
    go()
    (folder / "2.json").write_text('{"id": 3, "job": "a"}\n')
    go()
    assert seen == [1, 3]


def test_heldout_report_counts_sole_proposals_of_all_eligible(spark):
    rows = [(1, 10, 1, 0.5, 2.0), (1, 10, 2, 0.5, 2.0), (1, 10, 2, 0.5, 2.0), (2, 20, 1, 0.5, 2.0), (2, 20, 2, 0.5, 2.0), (2, 21, 1, 1.5, 3.0), (2, 21, 3, 1.5, 3.0), (3, 30, 1, 0.1, 1.0)]
    rows += [(4, 40, c, None, 1.0) for c in (1, 2)] + [(5, 50, c, 3.0, 1.0) for c in (1, 2)] + [(6, 60 + p, c, 1.0, 1.0 + p * 0.05) for p in (0, 1) for c in (1, 2)] + [(9, 90, c, 0.0, 1.0) for c in (1, 2)]
    df = spark.createDataFrame(rows, "q int, p int, c int, e double, d double")
    eligible = spark.createDataFrame([(k,) for k in range(1, 9)], "q int")
    r = graph.heldout_report(df, eligible, "q", "p", "c", "e", "d").first()
    assert (r.eligible, r.predicted, r.ambiguous, r.invalid, r.unsupported_or_ambiguous, r.coverage) == (8, 3, 2, 1, 5, 3 / 8)
    assert (r.within_1, r.within_2, r.within_4, r.within_8, r.ratio_within_1, r.ratio_within_4) == (1, 1, 2, 2, 1 / 8, 2 / 8)
    assert (r.contested, r.over_10pct, r.over_25pct) == (2, 1, 1) and abs(r.ratio_max - 1.5) < 1e-12 and abs(r.ratio_p50 - 1.275) < 1e-12
    none = graph.heldout_report(df.limit(0), eligible.limit(0), "q", "p", "c", "e", "d").first()
    assert (none.eligible, none.predicted, none.coverage) == (0, 0, None)


def test_throttled_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("".join(f'{{"job": "j", "t": {t}, "progress": {p}, "kind": "progress"}}\n' for t, p in ((0.0, 0.0), (0.01, 0.2), (0.5, 0.4), (0.6, 1.0))))
    stream = spark.readStream.schema("job string, t double, progress double, kind string").json(str(tmp_path / "in"))
    q = events.throttled(stream).writeStream.format("memory").queryName("passed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.progress for r in spark.table("passed").collect()) == [0.0, 0.4, 1.0]
