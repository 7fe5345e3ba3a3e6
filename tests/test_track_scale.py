"""Tracks at size: what leaving captures out holds in memory, its fits, and where sightings are made."""

import tracemalloc

import numpy as np

from fieldloom.operators import tracks
from fieldloom.operators.geometry import ray_to_pixel

PARAMS = [900.0, 880.0, 640.0, 480.0]


def a_batch(sizes, captures):
    """Tracks of pinhole cameras that look along z; sizes: observations of each, captures: which of them share one."""
    r = np.random.default_rng(5)
    n = sum(sizes)
    start = np.concatenate([[0], np.cumsum(sizes)])
    xyz = np.column_stack([r.uniform(-1, 1, (len(sizes), 2)), r.uniform(6, 9, len(sizes))])
    centre = r.uniform(-2, 2, (n, 3)) * [1, 1, 0.2]
    pixel = ray_to_pixel("PINHOLE", PARAMS, np.repeat(xyz, sizes, axis=0) - centre) + r.normal(0, 0.3, (n, 2))
    return tracks.Tracks(xyz, start, centre, np.tile(np.eye(3), (n, 1, 1)), pixel, np.zeros(n, int), [("PINHOLE", PARAMS)], np.zeros(n, int), np.asarray(captures))


def test_fits_without_each_capture_equal_those_made_one_by_one(monkeypatch):
    sizes = [3, 5, 8, 9, 30, 31]
    captures = np.concatenate([np.arange(k) // (2 if k > 8 else 1) for k in sizes])
    t = a_batch(sizes, captures)
    for piece in (200_000, 40):  # whole tracks at once, and a few captures of one at a time
        monkeypatch.setattr(tracks, "PIECE", piece)
        a = tracks.Assessment(t, t.xyz, "full_track", 0.02, 1.0, 2.0)
        got, fits = a._fits_without(np.arange(len(sizes)))
        at = 0
        for k in range(len(sizes)):
            own = np.arange(t.start[k], t.start[k + 1])
            for c in range(t.captures[k]):
                rest = own[t.capture[own] != c]
                want, ok = tracks.triangulated(t.centre[rest], t.direction[rest], np.array([0, len(rest)]))
                assert fits[at] == ok[0] and np.allclose(got[at], want[0], rtol=1e-10, atol=1e-10)
                at += 1


def test_a_track_of_many_captures_is_left_out_in_bounded_pieces():
    t = a_batch([1500], np.arange(1500))
    tracemalloc.start()
    a = tracks.Assessment(t, t.xyz, "full_track", 0.02, 1.0, 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert a.reason.tolist() == ["keep"] and peak < 60e6


def test_parallel_rays_fix_no_point():
    d = np.tile([0.0, 0.0, 1.0], (4, 1))
    c = np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]])
    assert not tracks.triangulated(c, d, np.array([0, 4]))[1][0]


def test_sightings_are_made_where_the_rows_are_read(spark, tmp_path):
    """A small shuffle before them would be put together into few tasks, and they would all be made there."""
    from fieldloom.plans import camera_queries

    rows = [(k, k % 7, k % 5, 1) for k in range(50)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, _ = camera_queries._sightings(spark, str(tmp_path))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_the_model_of_the_sightings_is_made_once(spark, tmp_path):
    """The repair reads its tables a dozen times: none of them may make the pixels anew."""
    from fieldloom.plans import camera_queries

    rows = [(k, k % 7, k % 5, 1) for k in range(50)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    m = camera_queries._as_model(spark, str(tmp_path))
    for df in (m.images, m.observations, m.points):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "Exchange" not in plan and df.count()


def test_widest_angle_by_blocks_equals_all_pairs(spark):
    """Blocks of few rays, a track of one ray, repeated idents, nulls; rays are not joined with rays."""
    from fieldloom.operators import reports

    r = np.random.default_rng(2)
    rays = [(t, i, (v / np.linalg.norm(v)).tolist()) for t, n in ((1, 40), (2, 7), (3, 1), (4, 2)) for i, v in enumerate(r.normal(0, 1, (n, 3)) * [1, 1, 0.2] + [0, 0, 2])]
    rays += [(5, 7, [1.0, 0.0, 0.0]), (5, 7, [0.0, 1.0, 0.0]), (6, 1, None), (6, 2, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (None, 2, [0.0, 1.0, 0.0]), (1, 90, None)]
    df = spark.createDataFrame(rays, "t int, i int, r array<double>")
    want = {}
    for t, i, a in rays:
        for u, j, b in rays:
            if t is not None and t == u and i < j:
                want[t] = max(want.get(t, 0.0), 0.0 if a is None or b is None else float(np.degrees(np.arccos(min(1.0, abs(np.dot(a, b)))))))
    for block in (3, 2048):
        out = reports.widest_angles(df, "t", "i", "r", block)
        got = {x.t: x.angle for x in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-6 for t in want)


def test_thinned_numbers_the_order_only(spark, monkeypatch):
    """The places are those of the order's columns alone; rows that it does not tell apart count singly."""
    from fieldloom.operators import spatial

    asked = []
    numbered = spatial.numbered
    monkeypatch.setattr(spatial, "numbered", lambda df, order: asked.append(df.columns) or numbered(df, order))
    df = spark.createDataFrame([(k // 2, k, 0.5) for k in range(100)], "id long, v long, w double")
    got = [r.id for r in spatial.thinned(df, ["id"], 10, "floor").orderBy("id").collect()]
    assert got == [int(np.floor(k * 11.0)) // 2 for k in range(10)] and asked == [["id"]]
    assert sorted(r.id for r in spatial.thinned(df, ["id"], 70, "floor").collect()) == [int(np.floor(k * (99 / 69))) // 2 for k in range(70)]
