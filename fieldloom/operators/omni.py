"""Unified omnidirectional cameras: projection, its inverse, and the fisheye models that come nearest to them.

A camera is a struct of width, height, xi, fx, fy, cx, cy, distortion_model (radtan or radtan_pro) and
distortion_parameters (5 or 13). Both models are one family: with p the point, r2 its squared length,

    D(p) = p * radial(r2) + r2 * T + 2 * p * (T . p) + S,   T = t0 + t1 * r2,   S = s0 * r2 + s1 * r2 * r2,

of which radtan has no t1 and no S. `terms` brings either list of parameters into the order radial (5), t0, t1,
s0, s1. Projection is a column expression; its inverse is implicit and solved by damped Newton steps for all rows
of an Arrow batch at once, whatever their cameras. Fits are made once for each distinct camera.

Null rays, pixels or cameras give null; cameras that `sound` refuses give pixels and rays that are not valid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.geometry import _bent

CAMERA = "struct<width int, height int, xi double, fx double, fy double, cx double, cy double, distortion_model string, distortion_parameters array<double>>"
#: How many parameters each model has, and where `terms` finds its own among them (-1: none).
PARAMETERS = {"radtan": 5, "radtan_pro": 13}
PLACES = {"radtan": (0, 1, 2, -1, -1, 4, 3, -1, -1, -1, -1, -1, -1), "radtan_pro": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)}
#: Fixed values of the inverse: steps, the longest step, and the error up to which it counts as found.
STEPS, LONGEST, FOUND = 20, 0.1, 1e-6


def sound(camera: Column) -> Column:
    """Whether a camera's numbers can be used: positive sizes, xi and focal lengths, as many parameters as its model has, all finite."""
    numbers = F.concat(F.array(*(camera[c] for c in ("xi", "fx", "fy", "cx", "cy"))), camera["distortion_parameters"])
    finite = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    model, n = camera["distortion_model"], F.size(camera["distortion_parameters"])
    sized = F.lit(False)
    for name, count in PARAMETERS.items():
        sized = sized | ((model == name) & (n == count))
    return F.coalesce(sized & finite & (F.least(*(camera[c] for c in ("width", "height", "xi", "fx", "fy"))) > 0), F.lit(False))


def terms(camera: Column) -> Column:
    """The 13 coefficients of D: radial (5), t0 (x, y), t1 (x, y), s0 (x, y), s1 (x, y)."""
    p = camera["distortion_parameters"]
    lists = {model: F.array(*(F.lit(0.0) if k < 0 else F.get(p, F.lit(k)) for k in at)) for model, at in PLACES.items()}
    return F.when(camera["distortion_model"] == "radtan", lists["radtan"]).otherwise(lists["radtan_pro"])


def rescaled(camera: Column, width: Column, height: Column) -> Column:
    """The camera of the same image at another size."""
    sx, sy = width / camera["width"], height / camera["height"]
    return F.struct(
        width.cast("int").alias("width"), height.cast("int").alias("height"), camera["xi"].alias("xi"), (camera["fx"] * sx).alias("fx"), (camera["fy"] * sy).alias("fy"),
        (camera["cx"] * sx).alias("cx"), (camera["cy"] * sy).alias("cy"), camera["distortion_model"].alias("distortion_model"), camera["distortion_parameters"].alias("distortion_parameters"),
    )


def within(camera: Column, u: Column, v: Column) -> Column:
    return (u >= 0) & (u <= camera["width"] - 1) & (v >= 0) & (v <= camera["height"] - 1)


def projected(df: DataFrame, xyz: list[str], camera: str = "camera") -> DataFrame:
    """Adds u, v and valid (before the sphere's back, and inside the image). Behind it the pixel is that of the ray without its distance."""
    cam = F.col(camera)
    x, y, z = (F.col(c).cast("double") for c in xyz)
    length = F.sqrt(x * x + y * y + z * z)
    length = F.when(length == 0, 1.0).otherwise(length)
    made = df.withColumns({"__d": z / length + cam["xi"], "__t": terms(cam)})
    front = F.col("__d") > 1e-9
    made = made.withColumns({"__x": x / length / F.when(front, F.col("__d")).otherwise(1.0), "__y": y / length / F.when(front, F.col("__d")).otherwise(1.0)})
    px, py = F.col("__x"), F.col("__y")
    r2, t = px * px + py * py, [F.get("__t", F.lit(k)) for k in range(13)]
    made = made.withColumn("__r", r2)
    r2 = F.col("__r")
    radial = 1 + r2 * (t[0] + r2 * (t[1] + r2 * (t[2] + r2 * (t[3] + r2 * t[4]))))
    tx, ty = t[5] + t[7] * r2, t[6] + t[8] * r2
    made = made.withColumns({"__g": radial + 2 * (tx * px + ty * py), "__sx": r2 * (tx + t[9] + t[11] * r2), "__sy": r2 * (ty + t[10] + t[12] * r2)})
    u, v = cam["fx"] * (px * F.col("__g") + F.col("__sx")) + cam["cx"], cam["fy"] * (py * F.col("__g") + F.col("__sy")) + cam["cy"]
    made = made.withColumns({"u": u, "v": v})
    return made.withColumn("valid", front & within(cam, F.col("u"), F.col("v")) & sound(cam)).drop("__d", "__t", "__x", "__y", "__r", "__g", "__sx", "__sy")


# --- the inverse ----------------------------------------------------------------------------


def distorted(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """D of points (n by 2) for coefficients (13, or n by 13)."""
    t = np.broadcast_to(t, (len(p), 13))
    r2 = (p * p).sum(1, keepdims=True)
    radial = 1 + r2[:, 0] * _poly(t[:, :5], r2[:, 0])
    around = t[:, 5:7] + t[:, 7:9] * r2
    return p * (radial + 2 * (around * p).sum(1))[:, None] + r2 * (around + t[:, 9:11] + t[:, 11:13] * r2)


def _poly(c: np.ndarray, r2: np.ndarray) -> np.ndarray:
    out = np.zeros_like(r2)
    for k in range(c.shape[1] - 1, -1, -1):
        out = out * r2 + c[:, k]
    return out


def slopes(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The Jacobian of D (n by 2 by 2): with its parts as outer products with p."""
    t = np.broadcast_to(t, (len(p), 13))
    r2 = (p * p).sum(1)
    around, more = t[:, 5:7] + t[:, 7:9] * r2[:, None], t[:, 7:9]
    even = 1 + r2 * _poly(t[:, :5], r2) + 2 * (around * p).sum(1)
    rise = _poly(t[:, :5] * np.arange(1, 6), r2)  # the derivative of radial by r2
    left = rise[:, None] * p + around + more * r2[:, None] + t[:, 9:11] + 2 * t[:, 11:13] * r2[:, None]
    right = around + 2 * (more * p).sum(1, keepdims=True) * p
    return even[:, None, None] * np.eye(2) + 2 * left[:, :, None] * p[:, None, :] + 2 * p[:, :, None] * right[:, None, :]


def _drawn_in(p: np.ndarray, most: np.ndarray) -> np.ndarray:
    r = np.hypot(p[:, 0], p[:, 1])
    return p * np.where(r > 1e-12, np.minimum(r, most) / np.maximum(r, 1e-300), 1.0)[:, None]


def undistorted(d: np.ndarray, t: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """The points whose D is d: Newton steps of at most LONGEST within the radius 1 / xi. Rows that no longer move are left alone."""
    t, most = np.broadcast_to(t, (len(d), 13)), np.broadcast_to(1 / xi, len(d))
    p = _drawn_in(d.astype(float), most)
    todo = np.flatnonzero(np.isfinite(p).all(1))
    for _ in range(STEPS):
        if not len(todo):
            break
        now, own = p[todo], t[todo]
        j, rest = slopes(now, own), distorted(now, own) - d[todo]
        det = j[:, 0, 0] * j[:, 1, 1] - j[:, 0, 1] * j[:, 1, 0]
        adjoint = np.stack([j[:, 1, 1] * rest[:, 0] - j[:, 0, 1] * rest[:, 1], j[:, 0, 0] * rest[:, 1] - j[:, 1, 0] * rest[:, 0]], axis=1)
        step = np.where(np.abs(det) > 1e-12, 1 / np.where(np.abs(det) > 1e-12, det, 1), 0)[:, None] * adjoint
        long = np.hypot(step[:, 0], step[:, 1])
        new = _drawn_in(now - step * np.minimum(1, LONGEST / np.maximum(long, 1e-12))[:, None], most[todo])
        p[todo] = new
        todo = todo[(new != now).any(1)]
    return p


def unprojected_rays(uv: np.ndarray, size: np.ndarray, lens: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rays and validity of pixels. size: width, height; lens: xi, fx, fy, cx, cy; all by row."""
    xi = lens[:, 0]
    d = (uv - lens[:, 3:5]) / lens[:, 1:3]
    p = undistorted(d, t, xi)
    miss = np.linalg.norm(distorted(p, t) - d, axis=1)
    r2 = (p * p).sum(1)
    under = 1 + (1 - xi * xi) * r2
    scale = (xi + np.sqrt(np.maximum(under, 0))) / (1 + r2)
    rays = np.column_stack([p * scale[:, None], scale - xi])
    long = np.linalg.norm(rays, axis=1)
    rays = np.where(long[:, None] > 1e-12, rays / np.maximum(long, 1e-300)[:, None], 0.0)
    inside = ((uv >= 0) & (uv <= size - 1)).all(1)
    return rays, (under >= 0) & (rays[:, 2] >= -1e-9) & (miss < FOUND) & inside


def unprojected(df: DataFrame, u: str = "u", v: str = "v", camera: str = "camera") -> DataFrame:
    """Adds ray (x, y, z) and ray_valid: found, in the front half, and from inside the image."""
    cam = F.col(camera)
    given = F.array(*(F.col(c).cast("double") for c in (u, v)), *(cam[c].cast("double") for c in ("width", "height", "xi", "fx", "fy", "cx", "cy")))

    @F.pandas_udf("x double, y double, z double, valid boolean")
    def back(numbers: pd.Series, coefficients: pd.Series) -> pd.DataFrame:
        if not len(numbers):
            return pd.DataFrame({"x": [], "y": [], "z": [], "valid": []}).astype({"valid": bool})
        m = np.stack(numbers.to_numpy()).astype(float)
        with np.errstate(all="ignore"):
            rays, valid = unprojected_rays(m[:, :2], m[:, 2:4], m[:, 4:9], np.stack(coefficients.to_numpy()).astype(float))
        return pd.DataFrame({"x": rays[:, 0], "y": rays[:, 1], "z": rays[:, 2], "valid": valid})

    whole = F.col(u).isNotNull() & F.col(v).isNotNull() & cam.isNotNull()
    usable = whole & sound(cam)
    blank = lambda a, n: F.when(usable, a).otherwise(F.array(*[F.lit(float("nan"))] * n))
    made = df.withColumn("__ray", back(blank(given, 9), blank(terms(cam), 13)))
    return made.withColumns({"ray": F.when(whole, F.when(usable, F.array(*(F.col(f"__ray.{c}") for c in "xyz")))), "ray_valid": F.when(whole, usable & F.col("__ray.valid"))}).drop("__ray")


# --- fits by fisheye models -------------------------------------------------------------------


def hemisphere(widest: float = np.pi / 2, rings: int = 120, spokes: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Angles from the axis and around it, ring after ring."""
    if not 0 < widest <= np.pi / 2:
        raise ValueError("a fit must stay within the forward hemisphere")
    theta, around = np.meshgrid(np.linspace(1e-4, widest, rings), np.linspace(0, 2 * np.pi, spokes, endpoint=False), indexing="ij")
    return theta.ravel(), around.ravel()


def equidistant_fit(theta: np.ndarray, around: np.ndarray, uv: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """fx, fy, cx, cy, k1 to k4 with the centre given: each axis by linear least squares in odd powers of theta, their coefficients averaged."""
    powers = theta[:, None] ** np.arange(1, 10, 2)
    by_axis = [np.linalg.lstsq(f[:, None] * powers, uv[:, k] - centre[k], rcond=None)[0] for k, f in enumerate((np.cos(around), np.sin(around)))]
    return np.array([by_axis[0][0], by_axis[1][0], *centre, *np.mean([a[1:] / a[0] for a in by_axis], axis=0)])


def fisheye_pixels(p: np.ndarray, theta: np.ndarray, around: np.ndarray) -> np.ndarray:
    x, y = _bent("OPENCV_FISHEYE", p[4:], theta * np.cos(around), theta * np.sin(around))
    return np.column_stack([p[0] * x + p[2], p[1] * y + p[3]])


def thin_prism_pixels(p: np.ndarray, theta: np.ndarray, around: np.ndarray, after: bool) -> np.ndarray:
    """Pixels of fx, fy, cx, cy, k1, k2, p1, p2, k3, k4, sx1, sy1. Programs read these in two ways: all terms at once on the equidistant point, or (`after`) the others on the radially bent one."""
    x, y, k = theta * np.cos(around), theta * np.sin(around), p[4:]
    if after:
        x, y = _bent("OPENCV_FISHEYE", k[[0, 1, 4, 5]], x, y)
        k = k * np.array([0, 0, 1, 1, 0, 0, 1, 1])
    x, y = _bent("THIN_PRISM_FISHEYE", k, x, y)
    return np.column_stack([p[0] * x + p[2], p[1] * y + p[3]])


def gauss_newton(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, nudges: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Least squares from a start: slopes by differences, steps halved up to three times until they help, ended when none does."""
    x, r = start.astype(float), residual(start)
    for _ in range(rounds):
        j = np.column_stack([(residual(x + e) - r) / n for e, n in zip(np.diag(nudges), nudges, strict=True)])
        step = np.linalg.lstsq(j, -r, rcond=None)[0]
        for share in (1, 0.5, 0.25, 0.125):
            new = residual(x + share * step)
            if new @ new < r @ r:
                x, r = x + share * step, new
                break
        else:
            return x
        if np.linalg.norm(step) < 1e-10:
            return x
    return x


def thin_prism_fit(theta: np.ndarray, around: np.ndarray, uv: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The twelve parameters that serve both readings best: linear first (radial part, then the others on top), then Gauss-Newton on both at once."""
    first = equidistant_fit(theta, around, uv, centre)
    x, y = _bent("OPENCV_FISHEYE", first[4:], theta * np.cos(around), theta * np.sin(around))
    r2, none = x * x + y * y, np.zeros(len(x))
    (fx, fy), one = first[:2], np.ones(len(x))
    wide = np.column_stack([one, none, 2 * fx * x * y, fx * (r2 + 2 * x * x), fx * r2, none])
    high = np.column_stack([none, one, fy * (r2 + 2 * y * y), 2 * fy * x * y, none, fy * r2])
    cx, cy, p1, p2, sx, sy = np.linalg.lstsq(np.vstack([wide, high]), np.concatenate([uv[:, 0] - fx * x, uv[:, 1] - fy * y]), rcond=None)[0]
    start = np.array([fx, fy, cx, cy, *first[4:6], p1, p2, *first[6:8], sx, sy])
    both = lambda p: np.concatenate([(thin_prism_pixels(p, theta, around, after) - uv).ravel() for after in (False, True)])
    return gauss_newton(both, start, np.array([1e-3] * 4 + [1e-7] * 8))


def fit(kind: str, size: np.ndarray, lens: np.ndarray, t: np.ndarray, widest: float = np.pi / 2) -> dict | None:
    """Parameters and errors of a camera's fit by OPENCV_FISHEYE or THIN_PRISM_FISHEYE; None if its rays don't project.

    Errors by reading (at once, and after the radial part), and the worse of the two; radius: of the widest ring."""
    theta, around = hemisphere(widest)
    rays = np.column_stack([np.sin(theta) * np.cos(around), np.sin(theta) * np.sin(around), np.cos(theta)])
    with np.errstate(all="ignore"):
        depth = rays[:, 2] + lens[0]
        uv = lens[1:3] * distorted(rays[:, :2] / np.where(depth > 1e-9, depth, 1)[:, None], t) + lens[3:5]
    if not np.isfinite(uv).all():
        return None
    if kind == "OPENCV_FISHEYE":
        p = equidistant_fit(theta, around, uv, lens[3:5])
        off = [np.linalg.norm(fisheye_pixels(p, theta, around) - uv, axis=1)] * 2
        radius = float(min(p[:2]) * widest * (1 + sum(k * widest ** (2 * n) for n, k in enumerate(p[4:], 1))))
    else:
        p = thin_prism_fit(theta, around, uv, lens[3:5])
        off = [np.linalg.norm(thin_prism_pixels(p, theta, around, after) - uv, axis=1) for after in (False, True)]
        ring = thin_prism_pixels(p, theta, around, False)[theta == theta.max()] - p[2:4]
        radius = float(np.median(np.linalg.norm(ring, axis=1)))
    rms, most = [float(np.sqrt((e * e).mean())) for e in off], [float(e.max()) for e in off]
    return {"params": p.tolist(), "rms": max(rms), "most": max(most), "rms_at_once": rms[0], "most_at_once": most[0], "rms_after": rms[1], "most_after": most[1], "radius": radius}


FIT = "struct<params array<double>, rms double, most double, rms_at_once double, most_at_once double, rms_after double, most_after double, radius double>"


def fitted(df: DataFrame, kind: str, camera: str = "camera", widest: float = np.pi / 2) -> DataFrame:
    """Adds fit (FIT) of each row's camera, made once for each distinct camera and joined back; null for cameras that are not sound or do not project."""
    if kind not in ("OPENCV_FISHEYE", "THIN_PRISM_FISHEYE"):
        raise ValueError(f"no fit by {kind}")
    cam = F.col(camera)
    key = df.withColumn("__key", F.xxhash64(F.to_json(cam)))
    numbers = F.array(*(cam[c].cast("double") for c in ("width", "height", "xi", "fx", "fy", "cx", "cy")))
    distinct = key.where(sound(cam)).groupBy("__key", F.to_json(cam).alias("__json")).agg(F.first(numbers).alias("numbers"), F.first(terms(cam)).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("__key", pa.int64()), ("__json", pa.string()), ("fit", pa.struct([("params", pa.list_(pa.float64())), *((c, pa.float64()) for c in ("rms", "most", "rms_at_once", "most_at_once", "rms_after", "most_after", "radius"))]))])
        for batch in batches:
            m, t = np.array(batch.column("numbers").to_pylist(), float), np.array(batch.column("terms").to_pylist(), float)
            fits = [fit(kind, a[:2], a[2:], b, widest) for a, b in zip(m, t, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__json"), pa.array(fits, schema.field("fit").type)], schema=schema)

    made = distinct.repartition(df.sparkSession.sparkContext.defaultParallelism, "__key").mapInArrow(run, f"__key long, __json string, fit {FIT}")
    return key.withColumn("__json", F.to_json(cam)).join(made, ["__key", "__json"], "left").drop("__key", "__json")
