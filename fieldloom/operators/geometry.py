"""Geometry that needs linear algebra: camera models, triangulation of tracks, track assessment, similarity fits.

Columns go to numpy in Arrow batches; tracks are grouped by point, so the work grows with the longest
track and not with the model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --- camera models: arrays of points in, arrays out ------------------------------------------


def _radial(model: str, p: np.ndarray) -> tuple[float, float, float, float, np.ndarray]:
    """fx, fy, cx, cy and the distortion terms of a model's parameters."""
    if model in ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL"):
        return p[0], p[0], p[1], p[2], p[3:]
    return p[0], p[1], p[2], p[3], p[4:]


def _factor(model: str, k: np.ndarray, r2: np.ndarray) -> np.ndarray:
    return 1 + (k[0] * r2 if model == "SIMPLE_RADIAL" else k[0] * r2 + k[1] * r2 * r2 if model == "RADIAL" else 0 * r2)


def _theta_distorted(k: np.ndarray, t: np.ndarray) -> np.ndarray:
    t2 = t * t
    return t * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))


def _bent(model: str, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equidistant points with their distortion: radial, and for thin prisms the other terms of the point as it was before, added."""
    thin = model == "THIN_PRISM_FISHEYE"
    radial = np.array([k[0], k[1], k[4], k[5]]) if thin else k[:4]
    r = np.hypot(x, y)
    f = np.where(r > 1e-12, _theta_distorted(radial, r) / np.maximum(r, 1e-300), 1.0)
    if not thin:
        return x * f, y * f
    r2 = r * r
    return x * f + 2 * k[2] * x * y + k[3] * (r2 + 2 * x * x) + k[6] * r2, y * f + 2 * k[3] * x * y + k[2] * (r2 + 2 * y * y) + k[7] * r2


def _within(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equidistant points drawn in to a right angle."""
    r = np.hypot(x, y)
    f = np.where(r > 1e-12, np.minimum(r, np.pi / 2) / np.maximum(r, 1e-300), 1.0)
    return x * f, y * f


def ray_to_pixel(model: str, params: list[float], rays: np.ndarray) -> np.ndarray:
    """Pixels of rays (n by 3); NaN behind the camera, except for fisheye models."""
    fx, fy, cx, cy, k = _radial(model, np.asarray(params, float))
    x, y, z = rays.T
    with np.errstate(all="ignore"):
        if model in ("OPENCV_FISHEYE", "THIN_PRISM_FISHEYE"):
            r = np.hypot(x, y)
            theta = np.arctan2(r, z)
            scale = np.where(r > 1e-12, theta / np.maximum(r, 1e-300), 1.0)
            u, v = _bent(model, k, x * scale, y * scale)
        else:
            u, v = np.where(z > 0, x / z, np.nan), np.where(z > 0, y / z, np.nan)
            f = _factor(model, k, u * u + v * v)
            u, v = u * f, v * f
    return np.column_stack([fx * u + cx, fy * v + cy])


def pixel_to_ray(model: str, params: list[float], pixels: np.ndarray) -> np.ndarray:
    """Unit rays of pixels (n by 2); the distortion is undone by Newton steps, tangential parts by fixed-point steps."""
    fx, fy, cx, cy, k = _radial(model, np.asarray(params, float))
    u, v = (pixels[:, 0] - cx) / fx, (pixels[:, 1] - cy) / fy
    if model in ("OPENCV_FISHEYE", "THIN_PRISM_FISHEYE"):
        if model == "THIN_PRISM_FISHEYE":
            a, b = _within(u, v)
            for _ in range(20):
                c, e = _bent(model, k, a, b)
                a, b = _within(a + u - c, b + v - e)
            d = t = np.hypot(a, b)
        else:
            a, b, d = u, v, np.hypot(u, v)
            t = np.clip(d, 0, np.pi / 2)
            for _ in range(15):
                t2 = t * t
                slope = 1 + t2 * (3 * k[0] + t2 * (5 * k[1] + t2 * (7 * k[2] + t2 * 9 * k[3])))
                t = np.clip(t - (_theta_distorted(k, t) - d) / np.where(np.abs(slope) > 1e-12, slope, np.inf), 0, np.pi / 2)
        s = np.where(d > 1e-12, np.sin(t) / np.maximum(d, 1e-300), 1.0)
        rays = np.column_stack([a * s, b * s, np.cos(t)])
    else:
        d = np.hypot(u, v)
        r = d.copy()
        for _ in range(10):
            r2 = r * r
            slope = 1 + (3 * k[0] * r2 if model == "SIMPLE_RADIAL" else 3 * k[0] * r2 + 5 * k[1] * r2 * r2 if model == "RADIAL" else 0)
            r = r - (r * _factor(model, k, r2) - d) / slope
        s = np.where(d > 1e-12, r / np.maximum(d, 1e-300), 1.0)
        rays = np.column_stack([u * s, v * s, np.ones_like(u)])
    return rays / np.linalg.norm(rays, axis=1)[:, None]


def rays(df: DataFrame, x: str = "x", y: str = "y", model: str = "model", params: str = "params", as_: str = "ray") -> DataFrame:
    """Adds the unit ray of each observation's pixel."""

    @F.pandas_udf("array<double>")
    def ray(xs: pd.Series, ys: pd.Series, models: pd.Series, ps: pd.Series) -> pd.Series:
        out = np.empty((len(xs), 3))
        keys = pd.Series(list(zip(models, map(tuple, ps), strict=True)))
        for (m, p), at in keys.groupby(keys).groups.items():
            out[at] = pixel_to_ray(m, list(p), np.column_stack([xs.iloc[at], ys.iloc[at]]).astype(float))
        return pd.Series(list(out))

    return df.withColumn(as_, ray(x, y, model, params))


def numbers(lists: pa.Array, width: int) -> np.ndarray:
    """A column of lists of `width` numbers; NaN for nulls and lists of another length."""
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = np.full((len(lists), width), np.nan)
    out[size == width] = lists.filter(pa.array(size == width)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def cameras_of(models: pa.Array, params: pa.Array) -> tuple[np.ndarray, list[tuple[str, list[float]]]]:
    """The number of each row's camera, and the cameras: rows of one model and the same parameters share one."""
    named = models.dictionary_encode()
    size = pa.compute.fill_null(pa.compute.list_value_length(params), 0).to_numpy(zero_copy_only=False)
    flat = params.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    most = int(size.max(initial=0))
    rows = np.zeros((len(models), 2 + most))
    rows[:, 0], rows[:, 1] = pa.compute.fill_null(named.indices, -1).to_numpy(zero_copy_only=False), size
    rows[:, 2:][np.arange(most) < size[:, None]] = flat
    codes = pa.Array.from_buffers(pa.binary(rows.shape[1] * 8), len(rows), [None, pa.py_buffer(rows)]).dictionary_encode()
    names = named.dictionary.to_pylist()
    found = [np.frombuffer(c) for c in codes.dictionary.to_pylist()]
    return codes.indices.to_numpy(), [(names[int(c[0])] if c[0] >= 0 else None, c[2 : 2 + int(c[1])].tolist()) for c in found]


def pixels(df: DataFrame, local: str, model: str = "model", params: str = "params", as_: str = "pixel") -> DataFrame:
    """Adds the pixel (array of two) of each place in its camera's axes (array of three); null where it is not seen."""

    @F.arrow_udf("array<double>")
    def pixel(xs: pa.Array, models: pa.Array, ps: pa.Array) -> pa.Array:
        x, out = numbers(xs, 3), np.full((len(xs), 2), np.nan)
        codes, cameras = cameras_of(models, ps)
        for k, (m, p) in enumerate(cameras):
            at = np.flatnonzero(codes == k)
            out[at] = ray_to_pixel(m, p, x[at])
        seen = np.isfinite(out).all(1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], 2 * np.cumsum(seen)]), pa.int32()), pa.array(out[seen].ravel()), mask=pa.array(~seen))

    return df.withColumn(as_, pixel(local, model, params))


def _by_camera(models: pd.Series, params: pd.Series):
    keys = pd.Series(list(zip(models, map(tuple, params), strict=True)))
    return keys.groupby(keys).groups.items()


# --- tracks ------------------------------------------------------------------------------


def triangulate(origins: np.ndarray, directions: np.ndarray, rounds: int = 4) -> np.ndarray | None:
    """The point nearest to all rays, weighted by inverse squared distance; None if they don't fix it, or it is behind one."""
    centre = origins.mean(0)
    o = origins - centre
    across = np.eye(3) - directions[:, :, None] * directions[:, None, :]
    w, x = np.ones(len(o)), None
    for _ in range(rounds):
        a = (w[:, None, None] * across).sum(0)
        values = np.linalg.eigvalsh(a)
        if not np.isfinite(values).all() or values[0] <= values[-1] * 1e-10:
            return None
        x = np.linalg.solve(a, (w[:, None] * np.einsum("nij,nj->ni", across, o)).sum(0))
        w = 1 / np.maximum(((x - o) ** 2).sum(1), 1e-24)
    return None if (((x - o) * directions).sum(1) <= 0).any() else x + centre


def halves(captures: np.ndarray, along: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two ways to split a track by captures: early and late along an order, and every other capture."""
    names = sorted(set(captures.tolist()), key=lambda n: (along[captures == n].min(), str(n)))
    middle = (len(names) + 1) // 2
    early, other = np.isin(captures, names[:middle]), np.isin(captures, names[::2])
    return [(early, ~early), (other, ~other)]


def split_stability(rows: DataFrame, point: str = "point3d_id") -> DataFrame:
    """Per point with four captures or more: the distance of the early from the late half's triangulation, over the distance of the cameras; null if one fails.

    rows: point, origin, direction (arrays of three), capture."""

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        o, d, c = np.stack(group["origin"]).astype(float), np.stack(group["direction"]).astype(float), group["capture"].to_numpy()
        if len(np.unique(c)) < 4:
            return pd.DataFrame({point: [], "disagreement": []})
        early, late = halves(c, np.unique(c, return_inverse=True)[1].astype(float))[0]
        a, b = triangulate(o[early], d[early]), triangulate(o[late], d[late])
        both = None if a is None or b is None else float(np.linalg.norm(a - b) / np.median(np.linalg.norm((a + b) / 2 - o, axis=1)))
        return pd.DataFrame({point: [key[0]], "disagreement": pd.array([both], "Float64")})

    return rows.groupBy(point).applyInPandas(one, f"{point} long, disagreement double")


def similarity_fit(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Scale, rotation and shift that map source points onto target points best; None for points on a line."""
    a, b = source - source.mean(0), target - target.mean(0)
    s = np.linalg.svd(a, compute_uv=False)
    if len(source) < 3 or s[1] <= s[0] * 1e-9:
        return None
    u, d, vt = np.linalg.svd(b.T @ a)
    sign = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r = u @ sign @ vt
    scale = float((d * np.diag(sign)).sum() / (a * a).sum())
    return scale, r, target.mean(0) - scale * r @ source.mean(0)


def robust_similarity(source: np.ndarray, target: np.ndarray, limit: float, trials: int = 1500, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
    """The fit with most points within the limit, over trials of four points; refined up to five times. Needs max(8, n / 2 + 1) of them."""
    r, best, n = np.random.default_rng(seed), None, len(source)
    error = lambda f: np.linalg.norm(f[0] * source @ f[1].T + f[2] - target, axis=1)
    if n < 4:
        return None
    for _ in range(trials):
        pick = r.choice(n, 4, replace=False)
        f = similarity_fit(source[pick], target[pick])
        if f and (best is None or (error(f) <= limit).sum() > best.sum()):
            best = error(f) <= limit
    for _ in range(5):
        f = similarity_fit(source[best], target[best]) if best is not None else None
        if f is None:
            return None
        new = error(f) <= limit
        if (new == best).all():
            break
        best = new
    return (*f, best) if best.sum() >= max(8, n // 2 + 1) else None


def fit_groups(pairs: DataFrame, by: str, limit: float, trials: int = 1500) -> DataFrame:
    """Per group of matched camera centres (source and target, arrays of three): scale, rotation (nine numbers), shift, inliers. Groups without a fit are left out."""

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        f = robust_similarity(np.stack(group["source"]).astype(float), np.stack(group["target"]).astype(float), limit, trials)
        return pd.DataFrame({by: [key[0]], "scale": [f[0]], "rotation": [f[1].ravel()], "shift": [f[2]], "inliers": [int(f[3].sum())]}) if f else pd.DataFrame(columns=[by, "scale", "rotation", "shift", "inliers"])

    return pairs.groupBy(by).applyInPandas(one, f"{by} {pairs.schema[by].dataType.simpleString()}, scale double, rotation array<double>, shift array<double>, inliers int")


#: Fixed value: the step of the differences, as a share of the distance.
STEP = 1e-5


def jacobians(points: DataFrame, local: str, rotation: str, model: str = "model", params: str = "params") -> DataFrame:
    """Adds pixel (array of two) and jacobian (six numbers, by rows) of each observation: how the pixel changes with the point's world place, by central differences.

    Null where the point is not in front of the camera or a number is not finite. local: the point in the camera's axes; rotation: world to camera, nine numbers."""

    @F.pandas_udf("pixel array<double>, jacobian array<double>")
    def slopes(xs: pd.Series, rs: pd.Series, models: pd.Series, ps: pd.Series) -> pd.DataFrame:
        whole = np.full((len(xs), 8), np.nan)
        for (m, p), at in _by_camera(models, ps):
            x, r = np.stack(xs.iloc[at].to_numpy()).astype(float), np.stack(rs.iloc[at].to_numpy()).astype(float).reshape(-1, 3, 3)
            size = np.linalg.norm(x, axis=1)[:, None] * STEP
            with np.errstate(all="ignore"):
                ends = [[ray_to_pixel(m, list(p), x + sign * size * e) for sign in (1, -1)] for e in np.eye(3)]
                j = np.stack([(ahead - back) / (2 * size) for ahead, back in ends], axis=2) @ r
                seen = (x[:, 2] > 0)[:, None]
                whole[at] = np.where(seen, np.column_stack([ray_to_pixel(m, list(p), x), j.reshape(-1, 6)]), np.nan)
        good = np.isfinite(whole).all(1)
        return pd.DataFrame({"pixel": [w[:2] if g else None for w, g in zip(whole, good, strict=True)], "jacobian": [w[2:] if g else None for w, g in zip(whole, good, strict=True)]})

    return points.withColumn("__s", slopes(local, rotation, model, params)).withColumns({"pixel": F.col("__s.pixel"), "jacobian": F.col("__s.jacobian")}).drop("__s")
