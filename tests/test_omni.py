"""Omnidirectional cameras against a scalar solver, and fits with planted parameters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import omni

PLAIN = (-0.12, 0.02, -0.002, 0.0005, -0.0007)
RICH = (-0.1, 0.02, -0.003, 0.0004, 0.0001, 0.001, -0.0008, 0.0003, 0.0002, 0.0005, -0.0004, 0.0001, 0.0002)


def bend(x, y, p):
    """Distortion of one point, written out by model."""
    r = x * x + y * y
    if len(p) == 5:
        k1, k2, k3, p1, p2 = p
        g = 1 + k1 * r + k2 * r**2 + k3 * r**3
        return x * g + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * g + p1 * (r + 2 * y * y) + 2 * p2 * x * y
    g = 1 + sum(k * r ** (n + 1) for n, k in enumerate(p[:5]))
    a, b = p[5] + p[7] * r, p[6] + p[8] * r
    return x * g + (r + 2 * x * x) * a + 2 * x * y * b + p[9] * r + p[11] * r * r, y * g + 2 * x * y * a + (r + 2 * y * y) * b + p[10] * r + p[12] * r * r


def solve(u, v, xi, fx, fy, cx, cy, p):
    """One pixel's ray by damped Newton steps with differences for slopes."""
    d = ((u - cx) / fx, (v - cy) / fy)
    x, y = d
    r = math.hypot(x, y)
    if r > 1 / xi:
        x, y = x / r / xi, y / r / xi
    for _ in range(200):
        h = 1e-7
        f = [b - c for b, c in zip(bend(x, y, p), d, strict=True)]
        j = [[(s - t) / (2 * h) for s, t in zip(bend(x + h * (k == 0), y + h * (k == 1), p), bend(x - h * (k == 0), y - h * (k == 1), p), strict=True)] for k in (0, 1)]
        det = j[0][0] * j[1][1] - j[1][0] * j[0][1]
        s, t = (f[0] * j[1][1] - f[1] * j[1][0]) / det, (f[1] * j[0][0] - f[0] * j[0][1]) / det
        long = max(1.0, math.hypot(s, t) / 0.1)
        x, y = x - s / long, y - t / long
    r = x * x + y * y
    k = (xi + math.sqrt(1 + (1 - xi * xi) * r)) / (1 + r)
    return k * x, k * y, k - xi


@pytest.fixture(scope="module")
def rays(spark):
    r = np.random.default_rng(7)
    rows = []
    for i in range(10_000):
        x, y, z = r.normal(size=3)
        m, p = ("radtan", PLAIN) if i % 2 else ("radtan_pro", RICH)
        rows.append((i, float(x), float(y), abs(float(z)), (1600, 1500, 1.0 + i % 5 / 10, 800.0 + i % 7, 790.0, 798.5, 751.25, m, list(p))))
    return spark.createDataFrame(rows, f"id long, x double, y double, z double, camera {omni.CAMERA}")


def test_round_trip_and_scalar_solver(rays):
    got = omni.unprojected(omni.projected(rays, ["x", "y", "z"]))
    again = omni.projected(got.where("ray_valid").withColumns({f"b{k}": F.get("ray", F.lit(k)) for k in range(3)}).withColumnsRenamed({"u": "u0", "v": "v0", "valid": "valid0"}), ["b0", "b1", "b2"])
    assert again.agg(F.max(F.hypot(F.col("u") - F.col("u0"), F.col("v") - F.col("v0")))).first()[0] < 1e-9
    out = got.collect()
    assert sum(r["ray_valid"] for r in out) > 8000
    for r in out[:10_000]:
        c = r["camera"]
        n = math.sqrt(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2)
        depth = r["z"] / n + c["xi"]
        a, b = bend(r["x"] / n / depth, r["y"] / n / depth, c["distortion_parameters"])
        assert r["u"] == pytest.approx(c["fx"] * a + c["cx"], abs=1e-9) and r["v"] == pytest.approx(c["fy"] * b + c["cy"], abs=1e-9)
        assert r["valid"] == (0 <= r["u"] <= 1599 and 0 <= r["v"] <= 1499)
        if r["valid"]:
            assert r["ray_valid"] and r["ray"] == pytest.approx([r["x"] / n, r["y"] / n, r["z"] / n], abs=1e-9)
    for r in out[:300]:
        if r["valid"]:
            c = r["camera"]
            assert r["ray"] == pytest.approx(solve(r["u"], r["v"], c["xi"], c["fx"], c["fy"], c["cx"], c["cy"], c["distortion_parameters"]), abs=1e-9)


def test_rows_that_cannot_be_projected_or_taken_back(spark):
    good = (1600, 1500, 1.1, 800.0, 800.0, 800.0, 750.0, "radtan", list(PLAIN))
    bad = [(0, *good[1:]), (*good[:2], -1.0, *good[3:]), (*good[:8], [0.1]), (*good[:7], "other", list(PLAIN)), (*good[:2], float("nan"), *good[3:])]
    df = spark.createDataFrame([(0, None, 0.0, 1.0, good), (1, 0.0, 0.0, 0.0, good), (2, 0.0, 0.0, -1.0, (*good[:2], 0.5, *good[3:])), (3, 0.1, 0.0, 1.0, None), *((10 + k, 0.1, 0.1, 1.0, c) for k, c in enumerate(bad))], f"id int, x double, y double, z double, camera {omni.CAMERA}")
    out = {r["id"]: r for r in omni.unprojected(omni.projected(df, ["x", "y", "z"])).collect()}
    assert out[0]["u"] is None and out[0]["ray"] is None
    assert (out[1]["u"], out[1]["v"]) == (800.0, 750.0)
    assert out[2]["valid"] is False
    assert out[3]["u"] is None and out[3]["ray_valid"] is None
    assert not any(out[10 + k]["valid"] or out[10 + k]["ray_valid"] for k in range(len(bad)))
    outside = spark.createDataFrame([(-0.5, 10.0, good), (1599.5, 10.0, good), (800.0, 750.0, good)], f"u double, v double, camera {omni.CAMERA}")
    assert [r["ray_valid"] for r in omni.unprojected(outside).collect()] == [False, False, True]
    assert omni.unprojected(outside.limit(0)).collect() == []


def test_slopes_are_the_derivatives():
    r = np.random.default_rng(1)
    p, t, h = r.uniform(-0.6, 0.6, (500, 2)), np.array(RICH), 1e-6
    for k in (0, 1):
        e = np.eye(2)[k] * h
        assert np.abs((omni.distorted(p + e, t) - omni.distorted(p - e, t)) / (2 * h) - omni.slopes(p, t)[:, :, k]).max() < 1e-8


def test_fits_recover_planted_parameters():
    theta, around = omni.hemisphere()
    planted = np.array([770.0, 775.0, 800.0, 750.0, 0.04, 0.002, -0.0015, 0.0002])
    uv = omni.fisheye_pixels(planted, theta, around)
    assert omni.equidistant_fit(theta, around, uv, planted[2:4]) == pytest.approx(planted, abs=1e-8)
    # without tangential and prism terms both readings are one, so the camera can be met exactly
    prism = np.array([770.0, 775.0, 800.5, 749.0, 0.04, 0.002, 0.0, 0.0, -0.0015, 0.0002, 0.0, 0.0])
    uv = omni.thin_prism_pixels(prism, theta, around, False)
    assert omni.thin_prism_fit(theta, around, uv, np.array([800.0, 750.0])) == pytest.approx(prism, abs=1e-6)


def test_fits_of_cameras_that_no_model_meets(spark, rays):
    cameras = rays.select("id", "camera").where("id < 20").unionByName(spark.createDataFrame([(100, (0, 0, 1.0, 1.0, 1.0, 0.0, 0.0, "radtan", list(PLAIN))), (101, None)], f"id long, camera {omni.CAMERA}"))
    fisheye = {r["id"]: r["fit"] for r in omni.fitted(cameras, "OPENCV_FISHEYE").collect()}
    prism = {r["id"]: r["fit"] for r in omni.fitted(cameras, "THIN_PRISM_FISHEYE").collect()}
    assert len(fisheye) == 22 and fisheye[100] is None and fisheye[101] is None
    for i in range(20):
        a, b = fisheye[i], prism[i]
        assert 0 < a["rms"] <= a["most"] and b["rms"] == max(b["rms_at_once"], b["rms_after"]) < a["rms"] and b["most"] == max(b["most_at_once"], b["most_after"])
    # the errors are those of a denser grid too
    cam = rays.where("id = 0").select("camera").first()["camera"]
    theta, around = omni.hemisphere(rings=333, spokes=77)
    p = np.array(fisheye[0]["params"])
    xyz = np.column_stack([np.sin(theta) * np.cos(around), np.sin(theta) * np.sin(around), np.cos(theta)])
    uv = np.array([bend(x / (z + cam["xi"]), y / (z + cam["xi"]), cam["distortion_parameters"]) for x, y, z in xyz]) * [cam["fx"], cam["fy"]] + [cam["cx"], cam["cy"]]
    off = np.linalg.norm(omni.fisheye_pixels(p, theta, around) - uv, axis=1)
    assert off.max() == pytest.approx(fisheye[0]["most"], rel=0.02) and np.sqrt((off**2).mean()) == pytest.approx(fisheye[0]["rms"], rel=0.05)


def test_rescaled_camera(spark, rays):
    df = omni.projected(rays.limit(50), ["x", "y", "z"]).withColumnsRenamed({"u": "u0", "v": "v0", "valid": "f0"})
    half = df.withColumn("camera", omni.rescaled(F.col("camera"), F.lit(800), F.lit(750)))
    for r in omni.projected(half, ["x", "y", "z"]).collect():
        assert (r["u"], r["v"]) == pytest.approx((r["u0"] / 2, r["v0"] / 2), abs=1e-9)
