"""Column functions of the capture-graph model: pair ids, rotations, cameras, scores. No UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the radix of pair ids.
PAIR_RADIX = 2**31 - 1


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- pair ids -----------------------------------------------------------------------------


def pair_id(a: Column | str, b: Column | str) -> Column:
    """The id of an unordered pair of image ids."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.least(a, b) * PAIR_RADIX + F.greatest(a, b)


def pair_high(pair: Column | str) -> Column:
    return F.pmod(col(pair), F.lit(PAIR_RADIX))


def pair_low(pair: Column | str) -> Column:
    """By whole-number division: quotients of doubles are off from 2**53 on, ids of about four million."""
    return F.call_function("div", col(pair) - pair_high(pair), F.lit(PAIR_RADIX))


# --- vectors and rotations; a vector is a list of three columns -----------------------------


def dot(a: list[Column], b: list[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def rotation(q: list[Column]) -> list[list[Column]]:
    """Rows of the rotation of a unit quaternion w, x, y, z."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def unit(q: list[Column]) -> list[Column]:
    """Scaled to length one; null if zero or not finite."""
    n = norm(q)
    good = (n > 0) & (n < float("inf")) & ~F.isnan(n)
    return [F.when(good, x / n) for x in q]


def camera_centre(q: list[Column], t: list[Column]) -> list[Column]:
    """Where a camera with world-to-camera pose (q, t) stands."""
    r = rotation(q)
    return [-(r[0][k] * t[0] + r[1][k] * t[1] + r[2][k] * t[2]) for k in range(3)]


def ray_to_world(ray: list[Column], q: list[Column]) -> list[Column]:
    r = rotation(q)
    return [ray[0] * r[0][k] + ray[1] * r[1][k] + ray[2] * r[2][k] for k in range(3)]


def optical_axis(q: list[Column]) -> list[Column]:
    """The viewing direction in the rig: the last row of the rotation of the normalised quaternion."""
    return rotation(unit(q))[2]


def quaternion(r: list[list[Column]]) -> list[Column]:
    """w, x, y, z of a rotation matrix; computed from its largest component, w not negative."""
    trace = r[0][0] + r[1][1] + r[2][2]
    s = [1 + trace, 1 + r[0][0] - r[1][1] - r[2][2], 1 - r[0][0] + r[1][1] - r[2][2], 1 - r[0][0] - r[1][1] + r[2][2]]
    top = F.greatest(*s)
    h = 2 * F.sqrt(top)
    wx, wy, wz = (r[2][1] - r[1][2]) / h, (r[0][2] - r[2][0]) / h, (r[1][0] - r[0][1]) / h
    xy, xz, yz = (r[0][1] + r[1][0]) / h, (r[0][2] + r[2][0]) / h, (r[1][2] + r[2][1]) / h
    by = [[h / 4, wx, wy, wz], [wx, h / 4, xy, xz], [wy, xy, h / 4, yz], [wz, xz, yz, h / 4]]
    q = [F.when(s[0] == top, by[0][k]).when(s[1] == top, by[1][k]).when(s[2] == top, by[2][k]).otherwise(by[3][k]) for k in range(4)]
    return [F.when(q[0] < 0, -x).otherwise(x) for x in q]


def rotation_degrees(p: list[Column], q: list[Column]) -> Column:
    """The angle between two orientations, whatever the quaternions' signs."""
    return F.degrees(2 * F.acos(F.least(F.abs(dot(p, q)), F.lit(1.0))))


def view_rotation(yaw: float, pitch: float) -> list[list[float]]:
    """Pitch after yaw, in degrees, as numbers."""
    import math

    a, b = math.radians(yaw), math.radians(pitch)
    return [
        [math.cos(a), 0.0, -math.sin(a)],
        [math.sin(b) * math.sin(a), math.cos(b), math.sin(b) * math.cos(a)],
        [math.cos(b) * math.sin(a), -math.sin(b), math.cos(b) * math.cos(a)],
    ]


def view_focal(width: Column, fov_degrees: float) -> Column:
    return width / 2 / F.tan(F.radians(F.lit(fov_degrees / 2)))


def similarity(x: list[Column], scale: float, r: list[list[float]], t: list[float]) -> list[Column]:
    """scale * R x + t with numbers for the transform."""
    return [scale * (x[0] * r[k][0] + x[1] * r[k][1] + x[2] * r[k][2]) + t[k] for k in range(3)]


def triangulated(o1: list[Column], d1: list[Column], o2: list[Column], d2: list[Column]) -> dict[str, Column]:
    """Two rays: midpoint x, y, z of the shortest connection, depths, gap, parallax in degrees; NaN where they are parallel."""
    w = [a - b for a, b in zip(o1, o2, strict=True)]
    a, b, c, d, e = dot(d1, d1), dot(d1, d2), dot(d2, d2), dot(d1, w), dot(d2, w)
    below = a * c - b * b
    fine = F.abs(below) > 1e-10
    nan = F.lit(float("nan"))
    s, t = F.when(fine, (b * e - c * d) / below).otherwise(nan), F.when(fine, (a * e - b * d) / below).otherwise(nan)
    p, q = [o + s * k for o, k in zip(o1, d1, strict=True)], [o + t * k for o, k in zip(o2, d2, strict=True)]
    gap = norm([x - y for x, y in zip(p, q, strict=True)])
    cosine = F.greatest(F.least(b / F.sqrt(a * c), F.lit(1.0)), F.lit(-1.0))
    middle = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return {"x": middle[0], "y": middle[1], "z": middle[2], "depth_1": s, "depth_2": t, "gap": gap, "parallax": F.degrees(F.acos(cosine))}


# --- cameras --------------------------------------------------------------------------------


def pinhole(x: list[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Pixel of a point in the camera's frame; null behind the camera."""
    ahead = x[2] > 0
    return [F.when(ahead, fx * x[0] / x[2] + cx), F.when(ahead, fy * x[1] / x[2] + cy)]


def pinhole_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    ray = [(u - cx) / fx, (v - cy) / fy, F.lit(1.0)]
    n = norm(ray)
    return [x / n for x in ray]


def inside(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x < width) & (y < height)


def focal_guess(width: Column, height: Column, f35: Column) -> tuple[Column, Column]:
    """Focal length in pixels from the 35 mm equivalent, else a guess; and whether it is known."""
    known = f35.isNotNull() & (f35 > 0)
    diagonal = F.hypot(width.cast("double"), height.cast("double")) * f35 / F.hypot(F.lit(36.0), F.lit(24.0))
    return F.when(known, diagonal).otherwise(1.2 * F.greatest(width, height)), F.coalesce(known, F.lit(False))


def rescaled(fx: Column, fy: Column, cx: Column, cy: Column, old: tuple[Column, Column], new: tuple[Column, Column]) -> list[Column]:
    sx, sy = new[0] / old[0], new[1] / old[1]
    return [fx * sx, fy * sy, cx * sx, cy * sy]


def camera_class(models: Column) -> Column:
    """Of an array of camera model names: the hardest class present. Names and classes are fixed values."""
    has = lambda *parts: F.exists(models, lambda m: reduce(lambda a, b: a | b, (F.contains(m, F.lit(p)) for p in parts)))
    flat = F.exists(models, lambda m: m.isin("PINHOLE", "SIMPLE_PINHOLE"))
    return F.when(has("EQUIRECTANGULAR", "SPHERICAL"), "equirect").when(has("FISHEYE"), "fisheye").when(has("OPENCV", "RADIAL", "THIN_PRISM"), "distorted_pinhole").when(flat, "pinhole").otherwise("other")


def shrunk(width: Column, height: Column, longest: int) -> list[Column]:
    """Size with the long edge capped and the aspect kept; rounds halves to even."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return [F.greatest(F.bround(side * scale).cast("int"), F.lit(1)) for side in (width, height)]


def crop_edges(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, step: int) -> list[Column]:
    """A rectangle widened to multiples of `step` and cut at the image."""
    down = lambda x: F.greatest(F.floor(x / step) * step, F.lit(0))
    up = lambda x, most: F.least(F.ceil(x / step) * step, most)
    return [down(left), down(top), up(right, width), up(bottom, height)]


# --- scores and texts -----------------------------------------------------------------------


def candidate_quality(sharpness: Column, features: Column) -> Column:
    return sharpness * (1 + features)


def sigmoid(x: Column) -> Column:
    """Without overflow for either sign."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def psnr(mse: Column) -> Column:
    """Decibels; null where the error is zero."""
    return F.when(mse > 0, -10 * F.log10(mse))


def slashes(name: Column) -> Column:
    return F.replace(name, F.lit("\\"), F.lit("/"))


def safe_path(name: Column) -> Column:
    """Whether a path stays inside its folder: relative, not empty, and without .. parts."""
    n = slashes(name)
    return F.coalesce((n != "") & ~n.rlike("^(/|[A-Za-z]:)") & ~n.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def trajectory_name(name: Column) -> Column:
    return F.lower(name).rlike(r"(frame|image|img)[_-]?\d+")


def row_digest(*columns: str) -> Column:
    """SHA-256 of the row as JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def relabelled(values: Column, known_scale: Column) -> Column:
    """Map keys that end in _m become _model_units where the scale is unknown."""
    return F.when(known_scale, values).otherwise(F.transform_keys(values, lambda k, _: F.regexp_replace(k, "_m$", "_model_units")))


def patched(base: Column, change: Column) -> Column:
    """A map with the changed keys in place of the old ones."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(change, k))
    return F.when(change.isNull(), base).when(base.isNull(), change).otherwise(F.map_concat(kept, change))


def training_advice(points: Column, reprojection: Column, p99: Column, median: Column) -> dict[str, Column]:
    """Point budget and warnings for a trainer; no points, no warning of few. 6 a point within 1 to 2 million, 1.5 px, 10 000 points, ratio 5, and the names."""
    warn = F.array_compact(F.array(F.when(reprojection > 1.5, "high_reproj_error"), F.when((points > 0) & (points < 10_000), "sparse_point_cloud"), F.when(p99 > 5 * median, "wide_sparse_point_distribution")))
    return {"cap": F.greatest(F.least(points * 6, F.lit(2_000_000)), F.lit(1_000_000)), "warnings": warn}


def turning(a: list[Column], b: list[Column]) -> list[list[Column]]:
    """The smallest rotation that takes unit vector a to unit vector b; for opposite ones, half a turn about an axis across."""
    c = dot(a, b)
    v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    cross = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
    across = [F.when(F.abs(a[0]) < 0.9, x).otherwise(y) for x, y in zip((F.lit(0.0), a[2], -a[1]), (-a[2], F.lit(0.0), a[0]), strict=True)]
    n = norm(across)
    u = [x / n for x in across]
    opposite = c < -1 + 1e-12
    one = lambda i, j: F.lit(1.0 if i == j else 0.0)
    square = [[v[i] * v[j] - one(i, j) * dot(v, v) for j in range(3)] for i in range(3)]
    return [[F.when(opposite, 2 * u[i] * u[j] - one(i, j)).otherwise(one(i, j) + cross[i][j] + square[i][j] / (1 + c)) for j in range(3)] for i in range(3)]


def shifted(x: Column, y: Column, left: Column, top: Column) -> list[Column]:
    """Pixels, or a principal point, after a crop."""
    return [x - left, y - top]


def match_reason(finite: Column, confidence: Column, inside_: Column, mask_a: Column, mask_b: Column, view_a: Column, view_b: Column, least: float = 0.2) -> Column:
    """The first reason against a dense match, null if none: every rejection counts at its own step only."""
    checks = (("not_finite", finite), ("low_confidence", confidence >= least), ("outside", inside_), ("mask_a", mask_a), ("mask_b", mask_b), ("view_a", view_a), ("view_b", view_b))
    out = None
    for name, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def sound_geometry(depth_1: Column, depth_2: Column, parallax: Column, gap: Column, error: Column, scale: Column) -> Column:
    """In front of both, parallax 0.5 degrees, gap within 0.002 of the scene, 1.5 pixels."""
    return F.coalesce((depth_1 > 0) & (depth_2 > 0) & (parallax >= 0.5) & (gap <= 0.002 * scale) & (error <= 1.5), F.lit(False))
