"""Assessment and refit of tracks on their cameras' models, many tracks in one Arrow batch.

A track is a row: its point, its place (three numbers) and its observations in the order of source and
capture, each with the camera's centre and rotation (nine numbers, world to camera), its model and
parameters, and the pixel. `gathered` makes such rows. In a batch the observations of all tracks are flat
arrays, track after track; triangulation, projection and uncertainty are sums and small matrices per stretch
of them. Leaving captures out, or halving a track, only makes more and shorter stretches, so these go
through the same functions, in pieces of at most PIECE observations or one track.

Verdicts (their names are fixed values) are the first reason that holds, in the order of the checks. A track must fit in one row, as the
point's place depends on all its observations; leaving out each of c captures costs c times the track.
Tracks without observations do not occur: `gathered` starts from the observations. Null numbers count as
not finite. A camera of an unknown model, or with numbers that are not finite, is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.geometry import numbers, pixel_to_ray, pixels, ray_to_pixel

#: Fixed values of the rule: the 95 % radius of three normal coordinates, and the least ratio of singular values.
RADIUS_95, ILL = 2.7954834829151074, 1e-10
MODELS = {"PINHOLE", "SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV_FISHEYE", "THIN_PRISM_FISHEYE"}
#: What is reported of a track under each policy.
METRICS = {
    "split": ("captures", "split_relative_difference", "original_relative_difference", "cross_p95_px", "cross_max_px", "conditional_radius95_relative", "original_p95_px", "original_max_px"),
    "full_track": ("captures", "full_fit_relative_difference", "loo_relative_difference", "cross_p95_px", "cross_max_px", "conditional_radius95_relative", "original_p95_px", "original_max_px"),
}
PIECE = 200_000


# --- stretches of flat arrays -------------------------------------------------------------------


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, size numbers for each."""
    stop = np.cumsum(size)
    return np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


def percentiles(v: np.ndarray, start: np.ndarray, q: float) -> np.ndarray:
    """Of each stretch, interpolated; NaN where one is NaN."""
    size = np.diff(start)
    v = v[np.lexsort((v, np.repeat(np.arange(len(size)), size)))]
    at = (size - 1) * q
    low, high = v[start[:-1] + np.floor(at).astype(int)], v[start[:-1] + np.ceil(at).astype(int)]
    t = at - np.floor(at)
    with np.errstate(invalid="ignore"):
        out = np.where(low == high, low, np.where(t < 0.5, low + (high - low) * t, high - (high - low) * (1 - t)))
    return np.where(np.isnan(v[start[1:] - 1]), np.nan, out)


def every(ok: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.logical_and.reduceat(ok, start[:-1])


def _terms(o: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of rays from o along unit vectors d (three rows each): the six numbers of I - dd', and its product with o."""
    (x, y, z), along = d, (o * d).sum(0)
    return np.stack([1 - x * x, -x * y, -x * z, 1 - y * y, -y * z, 1 - z * z, *(o - along * d)])


def solved(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (three rows) of many symmetric 3 by 3 systems, the rows of s as in `_terms`, and whether each fixes its x.

    By cofactors where the determinant is far from nothing against the trace, which rules a small ratio of eigenvalues out; the others by their eigenvalues."""
    xx, xy, xz, yy, yz, zz, *b = s
    c = [yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy]
    det = xx * c[0] + xy * c[1] + xz * c[2]
    good = 4 * det > 1e-4 * (xx + yy + zz) ** 3
    x = np.stack([c[i] * b[0] + c[j] * b[1] + c[k] * b[2] for i, j, k in ((0, 1, 2), (1, 3, 4), (2, 4, 5))]) / np.where(good, det, 1)
    rest = np.flatnonzero(~good)
    if len(rest):
        a = s[[0, 1, 2, 1, 3, 4, 2, 4, 5]][:, rest].T.reshape(-1, 3, 3)
        finite = np.isfinite(a).all((1, 2))
        values = np.linalg.eigvalsh(np.where(finite[:, None, None], a, np.eye(3)))
        fixed = finite & (values[:, 0] > values[:, 2] * ILL)
        x[:, rest] = np.linalg.solve(np.where(fixed[:, None, None], a, np.eye(3)), s[6:, rest].T[:, :, None])[:, :, 0].T
        good[rest] = fixed
    return x, good


def triangulated(centre: np.ndarray, direction: np.ndarray, start: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The point nearest to the rays of each stretch, weighted by inverse squared distance, and whether there is one: rays that fix it, in front of all."""
    size = np.diff(start)
    of, sums = np.repeat(np.arange(len(size)), size), lambda a: np.add.reduceat(a, start[:-1], axis=-1)
    ok = every(np.isfinite(centre).all(1) & np.isfinite(direction).all(1), start)
    c, d = (np.where(ok[of], a.T, 0) for a in (centre, direction))
    middle = sums(c) / size
    o = c - middle[:, of]
    terms, w = _terms(o, d), np.ones(len(of))
    for _ in range(rounds):
        x, good = solved(sums(w * terms))
        off = x[:, of] - o
        far = (off * off).sum(0)
        apart = far > 1e-24
        ok &= good & every(apart, start)
        w = 1 / np.where(apart, far, 1)
        w /= np.maximum.reduceat(w, start[:-1])[of]
    x = x + middle
    return x.T, ok & every(((x[:, of] - c) * d).sum(0) > 0, start)


def triangulated_linear(centre: np.ndarray, rotation: np.ndarray, ray: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point whose homogeneous coordinates miss the normalised rays (in the cameras' axes) least, by stretch, and whether it is finite."""
    ok = every(np.isfinite(centre).all(1) & np.isfinite(rotation).all((1, 2)) & np.isfinite(ray).all(1), start)
    of = np.repeat(np.arange(len(ok)), np.diff(start))
    pose = np.concatenate([rotation, -np.einsum("nij,nj->ni", rotation, centre)[:, :, None]], axis=2)
    term = pose - ray[:, :, None] * np.einsum("ni,nij->nj", ray, pose)[:, None, :]
    term = np.where(ok[of, None, None], term, 0)
    least = np.linalg.eigh(np.add.reduceat(np.einsum("nki,nkj->nij", term, term), start[:-1]))[1][:, :, 0]
    with np.errstate(all="ignore"):
        x = least[:, :3] / least[:, 3:]
    return x, ok & np.isfinite(x).all(1)


def radii(jacobian: np.ndarray, start: np.ndarray, sigma: float, distance: np.ndarray) -> np.ndarray:
    """The 95 % radius over the distance for pixel noise sigma, by stretch: from the least singular value of its stacked Jacobians; infinite if they fix no point."""
    size, out = np.diff(start), np.full(len(start) - 1, np.inf)
    step = np.maximum(1, np.ceil(np.log2(size))).astype(int)
    for k in np.unique(step):  # stretches of like length together, filled up with zeros
        at = np.flatnonzero(step == k)
        stack = np.zeros((len(at), 2**k, 2, 3))
        inner = spread(np.zeros(len(at), int), size[at])
        stack[np.repeat(np.arange(len(at)), size[at]), inner] = jacobian[spread(start[at], size[at])]
        s = np.linalg.svd(np.nan_to_num(stack.reshape(len(at), -1, 3)), compute_uv=False)
        good = s[:, 2] > s[:, 0] * ILL
        out[at[good]] = RADIUS_95 * sigma / s[good, 2] / distance[at[good]]
    return out


class Tracks:
    """A batch of tracks. `start`: where each track's observations begin (and the last ends)."""

    def __init__(self, xyz: np.ndarray, start: np.ndarray, centre: np.ndarray, rotation: np.ndarray, pixel: np.ndarray, camera: np.ndarray, cameras: list[tuple[str, list[float]]], source: np.ndarray, capture: np.ndarray):
        self.xyz, self.start, self.centre, self.rotation, self.pixel, self.camera, self.cameras = xyz, start, centre, rotation, pixel, camera, cameras
        self.size, self.source = np.diff(start), source
        self.of = np.repeat(np.arange(len(xyz)), self.size)
        for model, params in cameras:
            if model not in MODELS:
                raise ValueError(f"tracks cannot be assessed on the camera model {model}")
            if not np.isfinite(params).all():
                raise ValueError(f"a camera's parameters must be finite: {model} {params}")
        self.ray = np.full((len(pixel), 3), np.nan)
        with np.errstate(all="ignore"):
            for k, (model, params) in enumerate(cameras):
                at = np.flatnonzero(camera == k)
                self.ray[at] = pixel_to_ray(model, params, pixel[at])
        self.direction = np.einsum("nji,nj->ni", rotation, self.ray)
        new = np.ones(len(pixel), bool)
        new[1:] = (self.of[1:] != self.of[:-1]) | (source[1:] != source[:-1]) | (capture[1:] != capture[:-1])
        ordinal = np.cumsum(new) - 1
        self.capture = ordinal - ordinal[start[:-1]][self.of] if len(pixel) else ordinal
        self.captures = np.add.reduceat(new, start[:-1]).astype(int) if len(xyz) else np.zeros(0, int)

    def pixels(self, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pixels of places x in the views of the observations `rows`, and whether they lie in front."""
        local = np.einsum("nij,nj->ni", self.rotation[rows], x - self.centre[rows])
        return self._seen(local, rows), np.isfinite(local).all(1) & (local[:, 2] > 0)

    def _seen(self, local: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out, of = np.full((len(rows), 2), np.nan), self.camera[rows]
        with np.errstate(all="ignore"):
            for k in np.unique(of):
                at = np.flatnonzero(of == k)
                out[at] = ray_to_pixel(*self.cameras[k], local[at])
        return out

    def views(self, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pixels, their slopes by the world place (2 by 3, central differences of 1e-5 of the distance), and whether both are there."""
        local = np.einsum("nij,nj->ni", self.rotation[rows], x - self.centre[rows])
        step = np.linalg.norm(local, axis=1) * 1e-5
        ok = np.isfinite(local).all(1) & (local[:, 2] > 0) & (step > 0)
        pixels, slopes = self._seen(local, rows), np.empty((len(rows), 2, 3))
        with np.errstate(all="ignore"):
            for k, e in enumerate(np.eye(3)):
                ahead, back = (self._seen(local + s * step[:, None] * e, rows) for s in (1, -1))
                slopes[:, :, k] = (ahead - back) / (2 * step[:, None])
            slopes = slopes @ self.rotation[rows]
        return pixels, slopes, ok & np.isfinite(pixels).all(1) & np.isfinite(slopes).all((1, 2))

    def polished(self, x: np.ndarray, steps: int) -> np.ndarray:
        """Gauss-Newton steps on the squared pixel errors of each track; a step that does not lower them, or cannot be made, is not taken."""
        rows = np.arange(len(self.pixel))
        for _ in range(steps):
            pixels, slopes, ok = self.views(x[self.of], rows)
            miss = self.pixel - pixels
            good = every(ok, self.start)
            h = np.add.reduceat(np.einsum("nki,nkj->nij", slopes, slopes), self.start[:-1])
            g = np.add.reduceat(np.einsum("nki,nk->ni", slopes, miss), self.start[:-1])
            values = np.linalg.eigvalsh(np.where(good[:, None, None], h, np.eye(3)))
            good &= values[:, 0] > values[:, 2] * 1e-14
            new = x + np.linalg.solve(np.where(good[:, None, None], h, np.eye(3)), np.where(good[:, None], g, 0)[:, :, None])[:, :, 0]
            cost = np.add.reduceat((miss**2).sum(1), self.start[:-1])
            after, front = self.pixels(new[self.of], rows)
            better = good & every(front, self.start) & (np.add.reduceat(((self.pixel - after) ** 2).sum(1), self.start[:-1]) < cost)
            if not better.any():
                break
            x = np.where(better[:, None], new, x)
        return x


def _pieces(size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of consecutive items whose sizes add up to PIECE, or one item."""
    total, first = 0, 0
    for k, n in enumerate(size.tolist()):
        if total and total + n > PIECE:
            yield np.arange(first, k)
            total, first = 0, k
        total += n
    if len(size) > first:
        yield np.arange(first, len(size))


class Assessment:
    """Verdicts on a batch: `reason` and `values` (as METRICS names them; NaN: not reached) of each track."""

    def __init__(self, t: Tracks, xyz: np.ndarray, policy: str, relative: float, sigma: float, limit: float):
        self.t, self.xyz, self.relative, self.sigma, self.limit = t, xyz, relative, sigma, limit
        n = len(xyz)
        self.reason, self.values = np.full(n, None, object), np.full((n, 8), np.nan)
        if not n:
            return
        self.values[:, 0] = t.captures
        self._say(t.captures < (4 if policy == "split" else 3), "insufficient_captures")
        with np.errstate(all="ignore"):
            self.distance = percentiles(np.linalg.norm(xyz[t.of] - t.centre, axis=1), t.start, 0.5)
            self._say(~np.isfinite(self.distance) | (self.distance <= 0), "invalid_geometry")
            pixels, self.slopes, ok = t.views(xyz[t.of], np.arange(len(t.of)))
            self._say(~every(ok, t.start), "invalid_original_projection")
            miss = np.linalg.norm(pixels - t.pixel, axis=1)
            self._put(6, percentiles(miss, t.start, 0.95))
            self._put(7, np.maximum.reduceat(miss, t.start[:-1]))
            self._say((self.values[:, 6] > limit) | (self.values[:, 7] > 2 * limit), "original_reprojection")
            (self._split if policy == "split" else self._full)()
        self._say(np.ones(n, bool), "keep")

    def _open(self) -> np.ndarray:
        return np.array([r is None for r in self.reason])

    def _say(self, where: np.ndarray, reason: str) -> None:
        self.reason[where & self._open()] = reason

    def _put(self, k: int, v: np.ndarray) -> None:
        self.values[self._open(), k] = v[self._open()]

    def _relative_shift(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.linalg.norm(x - self.xyz[of], axis=1) / self.distance[of]

    def _full(self) -> None:
        t = self.t
        self._put(5, radii(self.slopes, t.start, self.sigma, self.distance))
        self._say(self.values[:, 5] > self.relative, "conditional_uncertainty")
        x, ok = triangulated(t.centre, t.direction, t.start)
        self._say(~ok, "degenerate_full_track")
        self._put(1, self._relative_shift(x, np.arange(len(x))))
        self._say(self.values[:, 1] > self.relative, "full_fit_disagreement")
        self._left_out(np.flatnonzero(self._open()))
        self._say((self.values[:, 3] > self.limit) | (self.values[:, 4] > 2 * self.limit), "cross_reprojection")

    def _fits_without(self, tracks: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """As `triangulated`, for each capture of these tracks the fit of all others.

        Tracks of about one size are worked on together, PIECE pairs of a capture and an observation at a time: the sums over observations are products with the weights of all captures."""
        t = self.t
        size, k = t.size[tracks], t.captures[tracks]
        cases = np.cumsum(k) - k
        places, fits = np.empty((k.sum(), 3)), np.empty(k.sum(), bool)
        wide = -(-size // 4) * 4
        for n in np.unique(wide).tolist():
            alike = np.flatnonzero(wide == n)
            for at in range(0, len(alike), max(1, PIECE // (n * n))):
                some = alike[at : at + max(1, PIECE // (n * n))]
                there = np.arange(n) < size[some, None]
                rows = t.start[tracks[some], None] + np.where(there, np.arange(n), 0)
                c, d = t.centre[rows], t.direction[rows]
                middle = (c * there[:, :, None]).sum(1) / size[some, None]
                o = c - middle[:, None]
                ox, oy, oz = (np.ascontiguousarray(o[:, None, :, axis]) for axis in range(3))
                terms = np.ascontiguousarray(_terms(o.reshape(-1, 3).T, d.reshape(-1, 3).T).T).reshape(len(some), n, 9)
                across, along = np.ascontiguousarray(d.transpose(0, 2, 1)), (o * d).sum(-1)[:, None]
                capture, most = np.where(there, t.capture[rows], -1), int(k[some].max())
                step = max(1, PIECE // (len(some) * n))
                for low in range(0, most, step):
                    left = np.arange(low, min(low + step, most))
                    stay = there[:, None] & (capture[:, None] != left[:, None])
                    w, ok = stay.astype(float), np.ones((len(some), len(left)), bool)
                    for _ in range(rounds):
                        x, good = solved(np.moveaxis(w @ terms, -1, 0).reshape(9, -1))
                        x = x.reshape(3, len(some), len(left), 1)
                        far, more = x[0] - ox, x[1] - oy
                        far *= far
                        more *= more
                        far += more
                        np.subtract(x[2], oz, out=more)
                        more *= more
                        far += more
                        apart = far > 1e-24
                        ok &= good.reshape(ok.shape) & (apart | ~stay).all(-1)
                        w = np.divide(stay, far, out=np.zeros_like(far), where=apart)
                    x = x[..., 0].transpose(1, 2, 0)
                    ok &= ((x @ across - along > 0) | ~stay).all(-1)
                    has = left < k[some, None]
                    to = (cases[some, None] + left)[has]
                    places[to], fits[to] = (x + middle[:, None])[has], ok[has]
        return places, fits

    def _left_out(self, tracks: np.ndarray) -> None:
        """Each capture against the fit of all others."""
        if not len(tracks):
            return
        t = self.t
        k = t.captures[tracks]
        of = np.repeat(tracks, k)  # a case for each capture
        cases = np.concatenate([[0], np.cumsum(k)])
        x, fits = self._fits_without(tracks)
        out = spread(t.start[tracks], t.size[tracks])  # captures stand in their order
        case = np.repeat(cases[:-1], t.size[tracks]) + t.capture[out]
        pixels, front = t.pixels(x[case], out)
        seen = np.concatenate([[0], np.cumsum(np.bincount(case, minlength=len(of)))])
        fault = np.where(~fits, 1, np.where(~every(front, seen), 2, 0))
        first = np.minimum.reduceat(np.where(fault > 0, np.arange(len(of)), len(of)), cases[:-1])
        kind = np.append(fault, 0)[first]
        self.reason[tracks[kind == 1]], self.reason[tracks[kind == 2]] = "degenerate_leave_one_out", "invalid_leave_one_out_projection"
        good = tracks[kind == 0]
        miss = np.linalg.norm(pixels - t.pixel[out], axis=1)
        whole = np.concatenate([[0], np.cumsum(t.size[tracks])])
        found = np.column_stack([np.maximum.reduceat(self._relative_shift(x, of), cases[:-1]), percentiles(miss, whole, 0.95), np.maximum.reduceat(miss, whole[:-1])])
        self.values[good, 2:5] = found[kind == 0]
        self.reason[good[~np.isfinite(self.values[good]).all(1)]] = "invalid_leave_one_out_projection"

    def _split(self) -> None:
        left = np.flatnonzero(self._open())
        for piece in _pieces(4 * self.t.size[left]):
            self._halved(left[piece])
        self._say((self.values[:, 1] > self.relative) | (self.values[:, 2] > self.relative), "split_disagreement")
        self._say((self.values[:, 3] > self.limit) | (self.values[:, 4] > 2 * self.limit), "cross_reprojection")
        self._say(self.values[:, 5] > self.relative, "conditional_uncertainty")

    def _order(self, tracks: np.ndarray) -> np.ndarray:
        """The captures' places in their order, for the observations of these tracks: as they stand; along the centres' main axis where they are of several sources."""
        t, k, size = self.t, self.t.captures[tracks], self.t.size[tracks]
        rows, first, stop = spread(t.start[tracks], size), np.cumsum(k) - k, np.cumsum(size)
        at = np.repeat(first, size) + t.capture[rows]
        centres = np.column_stack([np.bincount(at, t.centre[rows, c]) for c in range(3)]) / np.bincount(at)[:, None]
        mixed = ~every(t.source[rows] == np.repeat(t.source[t.start[tracks]], size), np.append(0, stop))
        place = spread(np.zeros(len(tracks), int), k)
        for n in np.unique(k[mixed]).tolist():  # tracks of as many captures together
            own = first[mixed & (k == n), None] + np.arange(n)
            around = centres[own] - centres[own].mean(axis=1, keepdims=True)
            along = (around @ np.linalg.svd(around, full_matrices=False)[2][:, 0, :, None])[:, :, 0]
            place[own] = np.argsort(np.argsort(along, axis=1, kind="stable"), axis=1)
        return place[at]

    def _halved(self, tracks: np.ndarray) -> None:
        """Early against late captures, then even against odd ones: each half's fit on the other half."""
        t = self.t
        size, n = t.size[tracks], len(tracks)
        rows, place = spread(t.start[tracks], size), self._order(tracks)
        of = np.repeat(np.arange(n), size)
        early, even = place < (t.captures[tracks] // 2)[of], place % 2 == 0
        whole = np.concatenate([[0], np.cumsum(size)])
        fault = np.zeros((6, n), bool)  # by split: no fit, then the first and the second half's projection
        apart, shift, radius, misses, fits = np.zeros(n), np.zeros(n), np.zeros(n), [], []
        for s, first in enumerate((early, even)):
            for mask in (first, ~first):
                cut = np.concatenate([[0], np.cumsum(np.bincount(of[mask], minlength=n))])
                x, ok = triangulated(t.centre[rows[mask]], t.direction[rows[mask]], cut)
                pixels, slopes, seen = t.views(x[of], rows)
                fits.append(x)
                fault[3 * s] |= ~ok
                fault[3 * s + 1 + (mask is not first)] = ~every(seen, whole)
                shift = np.maximum(shift, self._relative_shift(x, tracks))
                radius = np.maximum(radius, radii(slopes[mask], cut, self.sigma, self.distance[tracks]))
                misses.append(np.where(mask, np.nan, np.linalg.norm(pixels - t.pixel[rows], axis=1)))
            apart = np.maximum(apart, np.linalg.norm(fits[-2] - fits[-1], axis=1) / self.distance[tracks])
        bad = fault.any(0)
        self.reason[tracks[bad]] = np.where(np.argmax(fault, axis=0) % 3 == 0, "degenerate_split", "invalid_projection")[bad]
        both = [np.where(np.isnan(a), b, a) for a, b in (misses[:2], misses[2:])]
        merged = np.concatenate(both)[np.argsort(np.concatenate([of, of]), kind="stable")]
        cut = 2 * whole
        self.values[tracks[~bad], 1:6] = np.column_stack([apart, shift, percentiles(merged, cut, 0.95), np.maximum.reduceat(merged, cut[:-1]), radius])[~bad]


# --- tracks in Spark --------------------------------------------------------------------------


def gathered(observations: DataFrame, points: DataFrame, point: str = "point3d_id") -> DataFrame:
    """A row for each point that has observations: point, xyz (null: none known) and its observations in order.

    observations: point, source, capture, centre (array of 3), rotation (of 9), model, params, x, y; points: point, xyz."""
    camera = F.to_json(F.struct("model", "params")).alias("camera")
    seen = F.struct(F.col("source").cast("string").alias("source"), F.col("capture").cast("long").alias("capture"), "centre", "rotation", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), camera)
    rows = observations.groupBy(point).agg(F.sort_array(F.collect_list(seen)).alias("seen"))
    return rows.join(points.select(point, "xyz"), point, "left")


def _tracks(batch: pa.RecordBatch) -> Tracks:
    lists = batch.column("seen")
    flat = lists.flatten()
    start = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())]).astype(np.int64)
    codes = flat.field("camera").dictionary_encode()
    cameras = [(c["model"], [float(p) for p in c["params"]]) for c in map(json.loads, codes.dictionary.to_pylist())]
    column = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
    source = flat.field("source").fill_null("").dictionary_encode().indices.to_numpy()
    capture = flat.field("capture").fill_null(-1).to_numpy()
    return Tracks(numbers(batch.column("xyz"), 3), start, numbers(flat.field("centre"), 3), numbers(flat.field("rotation"), 9).reshape(-1, 3, 3), np.column_stack([column("x"), column("y")]), codes.indices.to_numpy(), cameras, source, capture)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pa.compute.list_value_length(batch.column("seen")).to_numpy() if batch.num_rows else np.zeros(0, int)
        for piece in _pieces(size):
            yield batch.slice(int(piece[0]), len(piece))


def _reported(batch: pa.RecordBatch, point: str, a: Assessment, policy: str, xyz: np.ndarray | None, schema: pa.Schema) -> pa.RecordBatch:
    values = [pa.array(a.values[:, k], from_pandas=True) for k in range(8)]  # NaN: null
    values[0] = values[0].cast(pa.int64())
    more = [] if xyz is None else [pa.array([x.tolist() if np.isfinite(x).all() else None for x in xyz], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([batch.column(point), pa.array(a.reason.tolist(), pa.string()), *values, *more], schema=schema)


def _schema(tracks: DataFrame, point: str, policy: str, more: str = "") -> tuple[str, pa.Schema]:
    if policy not in METRICS:
        raise ValueError(f"no assessment by {policy}")
    kind = tracks.schema[point].dataType.simpleString()
    text = f"{point} {kind}, reason string, captures long, {', '.join(f'{c} double' for c in METRICS[policy][1:])}{more}"
    arrow = [(point, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("reason", pa.string()), ("captures", pa.int64()), *((c, pa.float64()) for c in METRICS[policy][1:])]
    return text, pa.schema(arrow + ([("xyz", pa.list_(pa.float64()))] if more else []))


def assessed(tracks: DataFrame, policy: str = "full_track", point: str = "point3d_id", relative: float = 0.02, sigma: float = 1.0, limit: float = 2.0) -> DataFrame:
    """point, reason and the policy's METRICS of tracks as `gathered` makes them.

    full_track: three captures or more, the place against the fit of all observations and each capture against the fit of the others. split: four or more, halves against each other."""
    text, schema = _schema(tracks, point, policy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            t = _tracks(batch)
            yield _reported(batch, point, Assessment(t, t.xyz, policy, relative, sigma, limit), policy, None, schema)

    return tracks.select(point, "xyz", "seen").mapInArrow(run, text)


def refitted(tracks: DataFrame, policy: str = "full_track", point: str = "point3d_id", relative: float = 0.02, sigma: float = 1.0, limit: float = 2.0, steps: int = 0, linear: bool = False) -> DataFrame:
    """point, reason, METRICS and xyz (null: none) of tracks placed anew by triangulation, by `steps` of Gauss-Newton on pixel errors after it, and assessed there.

    linear: by homogeneous least squares in place of weighted rays. Tracks of fewer than three captures are not fitted; a fit that fails is degenerate_triangulation."""
    text, schema = _schema(tracks, point, policy, ", xyz array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            t = _tracks(batch)
            x, ok = triangulated_linear(t.centre, t.rotation, t.ray, t.start) if linear else triangulated(t.centre, t.direction, t.start)
            few = t.captures < 3
            x = np.where((ok & ~few)[:, None], t.polished(x, steps) if steps else x, np.nan)
            a = Assessment(t, x, policy, relative, sigma, limit)
            a.reason[~ok & ~few] = "degenerate_triangulation"
            yield _reported(batch, point, a, policy, x, schema)

    return tracks.select(point, "xyz", "seen").mapInArrow(run, text)


def placed(tracks: DataFrame, point: str = "point3d_id", linear: bool = False) -> DataFrame:
    """point, captures and xyz (null: none) of tracks by triangulation alone, as in `refitted`."""
    kind = tracks.schema[point].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            t = _tracks(batch)
            x, ok = triangulated_linear(t.centre, t.rotation, t.ray, t.start) if linear else triangulated(t.centre, t.direction, t.start)
            yield pa.RecordBatch.from_arrays([batch.column(point), pa.array(t.captures, pa.int64()), pa.array([p.tolist() if k else None for p, k in zip(x, ok, strict=True)], pa.list_(pa.float64()))], [point, "captures", "xyz"])

    return tracks.select(point, "xyz", "seen").mapInArrow(run, f"{point} {kind}, captures long, xyz array<double>")


def kept(reason: str = "reason") -> Column:
    return F.col(reason) == "keep"


def with_errors(observations: DataFrame, points: DataFrame, point: str = "point3d_id") -> DataFrame:
    """Adds error: pixels between an observation and its point's place in the view; infinite behind the camera. Observations without a placed point are left out."""
    r, c, x = (lambda k: F.get("rotation", F.lit(k))), (lambda k: F.get("centre", F.lit(k))), (lambda k: F.get("xyz", F.lit(k)))
    local = F.array(*(sum((r(3 * i + k) * (x(k) - c(k)) for k in range(3)), F.lit(0.0)) for i in range(3)))
    met = pixels(observations.join(points.select(point, "xyz"), point).withColumn("__local", local), "__local", as_="__pixel")
    off = F.sqrt((F.get("__pixel", F.lit(0)) - F.col("x")) ** 2 + (F.get("__pixel", F.lit(1)) - F.col("y")) ** 2)
    front = F.get("__local", F.lit(2)) > 0
    return met.withColumn("error", F.coalesce(F.when(front, off), F.lit(float("inf")))).drop("__local", "__pixel", "xyz")
