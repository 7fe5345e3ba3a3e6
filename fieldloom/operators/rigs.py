"""Rigs of several sensors, calibration records and valid regions, as column expressions and small joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import expr
from fieldloom.operators.geometry import pixel_to_ray, ray_to_pixel

#: Distortion terms by version of a calibration record; bounds of a circle's radius; regions by projection.
DISTORTION = {3: 5, 6: 13}
LEAST_RADIUS, MOST_RADIUS, USUAL_RADIUS = 0.01, 0.5, 0.5
LENS = ("xi", "fx", "fy", "cx", "cy", "yaw", "pitch", "roll", "tx", "ty", "tz")
TRAILER = ("ref_width", "ref_height", "lens_flags")


def imu_seconds(stamp: Column, first: Column, gyro: Column, raw: Column) -> Column:
    """Seconds since the first frame: raw stamps are microseconds, others milliseconds; less the gyro's own offset (milliseconds), if there is one. Without metadata (null) it is an error."""
    t = F.when(raw, (stamp - first) / 1e6).otherwise((stamp - first) / 1e3) - F.coalesce(gyro / 1e3, F.lit(0.0))
    return F.when(raw.isNull() | first.isNull(), F.raise_error("IMU samples need metadata").cast("double")).otherwise(t)


def frame_seconds(index: Column, fps: float) -> Column:
    """The time of a frame of constant rate."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    return index / fps


def calibrations(records: DataFrame, values: str, version: str) -> DataFrame:
    """One row a lens of each supported record, with its common terms, distortion and trailer.

    A record is the number of lenses, two, then for each 11 common terms, 5 or 13 of distortion (versions 3 and 6) and 3 more, and a last value."""
    v, size = F.col(values), F.when(F.col(version) == 3, 14 + DISTORTION[3]).when(F.col(version) == 6, 14 + DISTORTION[6])
    fits = (F.size(v) >= 2) & (F.floor(v[0]) == 2) & (F.size(v) == 2 + 2 * size)
    lens = records.where(fits).withColumn("__n", size).withColumn("lens", F.explode(F.array(F.lit(0), F.lit(1))))
    at = F.col("lens") * F.col("__n") + 1
    distortion = F.slice(F.col(values), at + 12, F.col("__n") - 14)
    out = lens.withColumns({**{c: F.col(values)[(at + k).cast("int")] for k, c in enumerate(LENS)}, "distortion": distortion, **{c: F.col(values)[(at + F.col("__n") - 3 + k).cast("int")].cast("int") for k, c in enumerate(TRAILER)}})
    return out.withColumn("distortion_model", F.when(F.col(version) == 3, "RADTAN").otherwise("RADTAN_PRO")).drop("__n", values)


def best_calibration(records: DataFrame, by: list[str], version: str, place: str) -> DataFrame:
    """Of each recording's supported records that of the newest version, of equal ones that at the highest place."""
    row = F.struct(*records.columns)
    return records.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.max_by(row, F.struct(version, place)).alias("__r")).select("__r.*")


def rig_cameras(sensors: DataFrame, extrinsics: DataFrame, by: str, sensor: str, order: str, prefix: Column) -> DataFrame:
    """One row a sensor of each rig: its prefix, whether it is the reference (the first), and rotation and translation of all others.

    A sensor without extrinsics, or extrinsics without a sensor, is an error."""
    both = sensors.join(extrinsics, [by, sensor], "full")
    checked = both.withColumn(sensor, F.when(F.col("params").isNull() | F.col("rotation").isNull(), F.raise_error("sensors and extrinsics differ").cast(extrinsics.schema[sensor].dataType)).otherwise(F.col(sensor)))
    first = F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1
    other = lambda c: F.when(~F.col("ref_sensor"), F.col(c)).alias(c)
    return checked.withColumn("ref_sensor", first).select(by, sensor, F.concat(prefix, F.col(sensor).cast("string"), F.lit("/")).alias("image_prefix"), "params", "ref_sensor", other("rotation"), other("translation"))


def virtual_rig(views: DataFrame, lenses: DataFrame, view: str, lens: int) -> DataFrame:
    """Every view of every lens: prefix, quaternion, translation -R c, and the one reference. views: name, yaw, pitch (degrees); lenses: index, x, y, z. A rig has a few of each."""
    y, p = F.radians("yaw"), F.radians("pitch")
    zero = F.lit(0.0)
    turn = [[F.cos(y), zero, -F.sin(y)], [F.sin(p) * F.sin(y), F.cos(p), F.sin(p) * F.cos(y)], [F.cos(p) * F.sin(y), -F.sin(p), F.cos(p) * F.cos(y)]]
    c = [F.col("x"), F.col("y"), F.col("z")]
    rows = views.join(F.broadcast(lenses.limit(1000)), F.lit(True))
    return rows.select(
        F.concat("name", F.lit("_lens"), F.col("index").cast("string"), F.lit("/")).alias("image_prefix"), ((F.col("name") == view) & (F.col("index") == lens)).alias("ref_sensor"),
        F.array(*expr.quaternion(turn)).alias("rotation"), F.array(*(-expr.dot(r, c) for r in turn)).alias("translation"),
    )


def sensor_centres(rigs: DataFrame, prefix: str = "image_prefix", rotation: str = "rotation", translation: str = "translation") -> DataFrame:
    """prefix and centre -R't of each sensor of a rig; the reference, without rotation and translation, is at 0."""
    q = [F.coalesce(F.col(rotation)[k], F.lit(float(k == 0))) for k in range(4)]
    t = [F.coalesce(F.col(translation)[k], F.lit(0.0)) for k in range(3)]
    return rigs.select(expr.slashes(F.col(prefix)).alias(prefix), F.array(*expr.camera_centre(q, t)).alias("centre"))


def sensor_axes(rigs: DataFrame, prefix: str = "image_prefix", rotation: str = "rotation") -> DataFrame:
    """prefix and optical axis in the rig; the reference looks ahead."""
    q = [F.when(F.col("ref_sensor"), float(k == 0)).otherwise(F.col(rotation)[k]) for k in range(4)]
    return rigs.select(expr.slashes(F.col(prefix)).alias(prefix), F.array(*expr.optical_axis(q)).alias("axis"))


def largest_theta(kind: Column, theta: Column) -> Column:
    """The angle up to which a fisheye image is valid; null for other kinds. Outside 0 to pi it is an error."""
    bad = (kind == "fisheye") & ~((theta > 0) & (theta < float(np.pi)))
    return F.when(bad, F.raise_error("invalid visibility angle").cast("double")).when(kind == "fisheye", theta)


def mask_purpose(feature: Column, training: Column) -> Column:
    return F.when(training, "training").when(feature, "feature")


# --- valid regions -------------------------------------------------------------------------


def regions(sources: DataFrame, saved: DataFrame) -> DataFrame:
    """One row a view of each source: what is saved, else the default of its projection (a circle for each lens, or all of one image). saved_region: whether it was.

    sources: id, projection; saved: id, view, kind, cx, cy, r, needs_review. Views and kinds other than the projection's are an error."""
    twin = F.col("projection") == "dual_fisheye"
    views = sources.select("id", F.explode(F.when(twin, F.array(F.lit("lens0"), F.lit("lens1"))).otherwise(F.array(F.lit("main")))).alias("view"), F.when(twin, "circle").otherwise("full").alias("wanted"))
    both = views.join(saved, ["id", "view"], "full")
    odd = F.col("wanted").isNull() | (F.col("kind").isNotNull() & (F.col("kind") != F.col("wanted")))
    kind = F.when(odd, F.raise_error("a region does not fit its projection").cast("string")).otherwise(F.coalesce("kind", "wanted"))
    part = lambda c, usual: F.when(kind == "circle", F.coalesce(c, F.lit(usual))).alias(c)
    return both.select("id", "view", kind.alias("kind"), part("cx", 0.5), part("cy", 0.5), part("r", USUAL_RADIUS), F.col("kind").isNotNull().alias("saved_region"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"))


def migrated_regions(old: DataFrame, taken: DataFrame) -> DataFrame:
    """Circles of an older format: radius within its bounds, missing stroke numbers given out behind the largest there is, and a mark where coordinates must be looked at.

    old: id, view, r, coordinate_version, operations (array of structs with stroke_id); taken: ids that have regions already. capped: whether the radius was too large."""
    r = F.coalesce("r", F.lit(USUAL_RADIUS))
    ops = F.coalesce("operations", F.array().cast(old.schema["operations"].dataType))
    largest = F.coalesce(F.array_max(F.transform(ops, lambda o: F.coalesce(o["stroke_id"], F.lit(0)))), F.lit(0))
    number = lambda o, i: F.coalesce(o["stroke_id"], largest + F.size(F.filter(F.slice(ops, 1, i + 1), lambda p: p["stroke_id"].isNull()))).cast("int")
    return old.join(taken.select("id").distinct(), "id", "left_anti").select(
        "id", "view", F.greatest(F.lit(LEAST_RADIUS), F.least(F.lit(MOST_RADIUS), r)).alias("r"), (r > MOST_RADIUS).alias("capped"),
        F.transform(ops, lambda o, i: o.withField("stroke_id", number(o, i))).alias("operations"), (~F.col("coordinate_version").eqNullSafe(F.lit(3))).alias("needs_review"),
    )


def _inside_circle(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def region_pixels(images: DataFrame, ident: str, theta: str | None = None) -> DataFrame:
    """ident, px, py, valid: every pixel of each image. One row a pixel, made where it is used.

    images: ident, width, height, kind (full, circle, fisheye), cx, cy, r (shares of width and height, r of the width), operations (mode add or subtract, x, y, r; applied in
    order to the full image or the circle). A fisheye region needs model, params and `theta`, the angle below which pixels are valid."""
    rows = images.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("px", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    x, y, w, h = F.col("px") + 0.5, F.col("py") + 0.5, F.col("width"), F.col("height")
    base = F.when(F.col("kind") == "circle", _inside_circle(x, y, F.col("cx") * w, F.col("cy") * h, F.col("r") * w)).otherwise(F.lit(True))
    step = lambda on, o: F.when(_inside_circle(x, y, o["x"] * w, o["y"] * h, o["r"] * w), o["mode"] == "add").otherwise(on)
    drawn = F.aggregate(F.coalesce("operations", F.array().cast(images.schema["operations"].dataType)), base, step)
    if theta is None:
        return rows.select(ident, "px", "py", drawn.alias("valid"))

    @F.pandas_udf("double")
    def angle(xs: pd.Series, ys: pd.Series, models: pd.Series, ps: pd.Series) -> pd.Series:
        out = np.full(len(xs), np.nan)
        keys = pd.Series(list(zip(models, map(tuple, ps), strict=True)))
        for (m, p), at in keys.groupby(keys).groups.items():
            out[at] = np.arccos(np.clip(pixel_to_ray(m, list(p), np.column_stack([xs.iloc[at], ys.iloc[at]]).astype(float))[:, 2], -1, 1))
        return pd.Series(out)

    return rows.withColumn("__angle", angle(x, y, "model", "params")).select(ident, "px", "py", (drawn & (F.col("__angle") < F.col(theta))).alias("valid"))


def region_keys(images: DataFrame, ident: str) -> DataFrame:
    """images with key: the SHA-256 of all columns but `ident`, so of what a region is made of. Images of equal keys have equal regions, to be drawn once (see distinct_regions)."""
    return images.withColumn("key", F.sha2(F.to_json(F.struct(*(c for c in images.columns if c != ident))), 256))


def distinct_regions(keyed: DataFrame, ident: str) -> DataFrame:
    """One row for each key of region_keys, as region_pixels takes it by `key`."""
    return keyed.drop(ident).dropDuplicates(["key"])


def bitmap_pixels(pixels: DataFrame, ident: str, grey: str) -> DataFrame:
    """The same from a mask's grey values: valid above 127."""
    return pixels.select(ident, "px", "py", (F.col(grey) > 127).alias("valid"))


def pixel_bounds(pixels: DataFrame, ident: str) -> DataFrame:
    """The edges around each image's valid pixels. An image without any is an error."""
    on = F.col("valid")
    edge = lambda f, c, more: (f(F.when(on, F.col(c))) + more).cast("double")
    b = pixels.groupBy(ident).agg(edge(F.min, "px", 0).alias("left"), edge(F.min, "py", 0).alias("top"), edge(F.max, "px", 1).alias("right"), edge(F.max, "py", 1).alias("bottom"))
    return b.withColumn("left", F.coalesce("left", F.raise_error("a valid region has no pixels").cast("double")))


def composed_masks(pixels: DataFrame, ident: str, excluded: str) -> DataFrame:
    """ident, kept, coverage: valid pixels that nothing dynamic covers, and the share of valid pixels that it does."""
    covered = F.count_if(F.col("valid") & F.col(excluded))
    return pixels.groupBy(ident).agg(F.count_if(F.col("valid") & ~F.col(excluded)).alias("kept"), (covered / F.greatest(F.count_if("valid"), F.lit(1))).alias("coverage"))


# --- cameras -------------------------------------------------------------------------------


def is_monotone(params: list[float], model: str, theta: float) -> bool:
    """Whether a fisheye model's distorted radius grows all the way to the angle: its slope, at its ends and where it turns, is above 1e-10, and the radius there is finite and positive."""
    k = np.asarray(params, float)[4:]
    k = np.array([k[0], k[1], k[4], k[5]]) if model == "THIN_PRISM_FISHEYE" else k[:4]
    slope = np.polynomial.Polynomial([1, *(np.array([3, 5, 7, 9]) * k)])  # in theta squared
    turns = slope.deriv().trim().roots() if np.any(k) else np.zeros(0)
    real = turns.real[np.abs(turns.imag) <= 1e-10 * (1 + np.abs(turns.real))]
    at = np.array([0.0, theta**2, *real[(real > 0) & (real < theta**2)]])
    end = theta * np.polynomial.Polynomial([1, *k])(theta**2)
    return bool((slope(at) > 1e-10).all() and np.isfinite(end) and end > 0)


def monotone(cameras: DataFrame, theta: str, as_: str = "monotone") -> DataFrame:
    """cameras: model, params, and the valid angle. Many cameras are of one make, so a task solves each distinct one once, of up to 100,000."""

    @F.pandas_udf("boolean")
    def check(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple, bool] = {}
        for models, params, thetas in batches:
            keys = list(zip(models, map(tuple, params), thetas, strict=True))
            if len(known) > 100_000:
                known.clear()
            for m, p, t in set(keys) - known.keys():
                known[m, p, t] = is_monotone(list(p), m, t)
            yield pd.Series([known[k] for k in keys], dtype=bool)

    return cameras.withColumn(as_, check("model", "params", theta))


def projected(points: DataFrame, xyz: list[str], rotation: str = "q", translation: str = "t", model: str = "model", params: str = "params") -> DataFrame:
    """World points with the pixel that a camera (quaternion, translation) sees them at, u and v, and their depth."""
    turned = expr.rotation([F.col(rotation)[k] for k in range(4)])
    x = [F.col(c) for c in xyz]
    local = points.withColumn("__local", F.array(*(expr.dot(r, x) + F.col(translation)[k] for k, r in enumerate(turned))))

    @F.pandas_udf("array<double>")
    def pixel(rays: pd.Series, models: pd.Series, ps: pd.Series) -> pd.Series:
        out = np.empty((len(rays), 2))
        keys = pd.Series(list(zip(models, map(tuple, ps), strict=True)))
        for (m, p), at in keys.groupby(keys).groups.items():
            out[at] = ray_to_pixel(m, list(p), np.stack(rays.iloc[at]).astype(float))
        return pd.Series(list(out))

    return local.withColumn("__uv", pixel("__local", model, params)).withColumns({"u": F.col("__uv")[0], "v": F.col("__uv")[1], "depth": F.col("__local")[2]}).drop("__uv", "__local")


def within_view(rays: DataFrame, model: str, ray: str, most: float = 85.0) -> DataFrame:
    """Observations whose ray (see geometry.rays) lies within `most` degrees of a fisheye camera's axis; of other cameras all."""
    r = F.col(ray)
    finite = reduce(lambda a, b: a & b, (~F.isnan(r[k]) & (F.abs(r[k]) < float("inf")) for k in range(3)))
    near = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r[2])))) <= most
    return rays.where(~F.col(model).isin("OPENCV_FISHEYE", "THIN_PRISM_FISHEYE") | F.coalesce(finite & near, F.lit(False)))


# --- camera systems of two lenses --------------------------------------------------------------


def _times(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[reduce(lambda x, y: x + y, (a[i][k] * b[k][j] for k in range(3))) for j in range(3)] for i in range(3)]


def lens_rotation(yaw: Column, pitch: Column, roll: Column, first: bool) -> list[list[Column]]:
    """Of a calibrated lens (degrees): about x by roll, z by yaw, then y by a right angle and pitch. The first lens's axes are turned about z by half a turn before."""
    (ca, sa), (cy, sy), (cr, sr) = ((F.cos(x), F.sin(x)) for x in (F.lit(float(np.pi) / 2) + F.radians(pitch), F.radians(yaw), F.radians(roll)))
    zero, one = F.lit(0.0), F.lit(1.0)
    r = _times(_times([[ca, zero, sa], [zero, one, zero], [-sa, zero, ca]], [[cy, -sy, zero], [sy, cy, zero], [zero, zero, one]]), [[one, zero, zero], [zero, cr, -sr], [zero, sr, cr]])
    return [[-row[0], -row[1], row[2]] for row in r] if first else r


def camera_systems(lenses: DataFrame, by: list[str], crops: DataFrame | None = None) -> DataFrame:
    """A row for each lens of each calibrated pair: by, lens, width, height, xi, fx, fy, cx, cy, distortion_model, distortion, rotation (nine numbers) and translation from the first lens.

    lenses: by, lens (0 and 1), LENS terms, ref_width, ref_height, distortion, distortion_model, as `calibrations` gives them. The reference canvas holds both lenses side by side and is split;
    crops (by, source_width, source_height, cropped_width, cropped_height) cut the middle out of each half. A record without just these two lenses, with a canvas that cannot be halved or
    that the lenses do not share, or with a crop of another size than the half, is an error."""
    row = F.struct(*LENS, "ref_width", "ref_height", "distortion", "distortion_model")
    pair = lenses.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *(F.max(F.when(F.col("lens") == k, row)).alias(f"__{k}") for k in (0, 1)))
    of = lambda k, c: F.col(f"__{k}.{c}")
    same = (F.col("__n") == 2) & F.col("__0").isNotNull() & F.col("__1").isNotNull() & (of(0, "ref_width") == of(1, "ref_width")) & (of(0, "ref_height") == of(1, "ref_height"))
    even = (of(0, "ref_width") > 0) & (of(0, "ref_height") > 0) & (of(0, "ref_width") % 2 == 0)
    half, high = F.floor(of(0, "ref_width") / 2).cast("int"), of(0, "ref_height").cast("int")
    fault = F.when(~F.coalesce(same, F.lit(False)), "a camera system needs two lenses of one reference size").when(~F.coalesce(even, F.lit(False)), "the reference canvas cannot be halved")
    if crops is not None:
        pair = pair.join(crops, by, "left")
        cut = F.col("source_width").isNotNull()
        fault = fault.when(cut & ((F.col("source_width") != half) | (F.col("source_height") != high)), "the crop was made from another size than the calibration's")
        wide, tall = F.coalesce("cropped_width", half), F.coalesce("cropped_height", high)
    else:
        wide, tall = half, high
    left, top = (half - wide) / 2, (high - tall) / 2
    # Step by step, so that each number is computed once and the generated code stays small.
    turned = pair.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True)))
    turned = turned.withColumns({f"__r{k}": F.array(*(c for r in lens_rotation(of(k, "yaw"), of(k, "pitch"), of(k, "roll"), k == 0) for c in r)) for k in (0, 1)})
    at = lambda name: [[F.get(name, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    first = at("__r0")
    turned = turned.withColumn("__turn", F.array(*(c for r in _times(at("__r1"), [[first[j][i] for j in range(3)] for i in range(3)]) for c in r)))
    place = [[of(k, c) for c in ("tx", "ty", "tz")] for k in (0, 1)]
    shift = [place[1][i] - expr.dot(at("__turn")[i], place[0]) for i in range(3)]
    still = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    sensor = lambda k: F.struct(
        F.lit(k).alias("lens"), wide.cast("int").alias("width"), tall.cast("int").alias("height"), *(of(k, c).alias(c) for c in ("xi", "fx", "fy")), (of(k, "cx") - k * half - left).alias("cx"), (of(k, "cy") - top).alias("cy"),
        of(k, "distortion_model").alias("distortion_model"), of(k, "distortion").alias("distortion"),
        (F.col("__turn") if k else still).alias("rotation"), (F.array(*shift) if k else F.array(*[F.lit(0.0)] * 3)).alias("translation"),
    )
    return turned.select(*by, F.inline(F.array(sensor(0), sensor(1))))


# --- masks that several images share -------------------------------------------------------------


def mask_keys(images: DataFrame, records: DataFrame, name: str = "name") -> DataFrame:
    """name, key and what a mask is made of: width, height, region (kind: full or circle; cx, cy, radius in pixels) and crop (left, top, width, height; null: none). Every image must have a record.

    key: the SHA-256 of these; images of equal keys have equal masks."""
    met = images.select(name).distinct().join(records.select(name, "width", "height", "region", "crop"), name, "left")
    known = met.withColumn(name, F.when(F.col("width").isNull(), F.raise_error(F.concat(F.lit("no record of the image "), F.col(name))).cast("string")).otherwise(F.col(name)))
    return known.withColumn("key", F.sha2(F.to_json(F.struct("width", "height", "region", "crop")), 256))


def mask_rows(keyed: DataFrame) -> DataFrame:
    """key, y, left, right (exclusive): the valid stretch of each row of each distinct mask, within its crop and counted from its corner. Made once a key; empty rows are left out."""
    once = keyed.groupBy("key").agg(*(F.first(c).alias(c) for c in ("width", "height", "region", "crop")))
    left, top = F.coalesce("crop.left", F.lit(0)), F.coalesce("crop.top", F.lit(0))
    wide, tall = F.coalesce("crop.width", F.col("width")), F.coalesce("crop.height", F.col("height"))
    rows = once.select("key", "width", "region", left.alias("x0"), top.alias("y0"), wide.alias("wide"), F.explode(F.when(tall > 0, F.sequence(F.lit(0), tall - 1))).alias("y"))
    down = F.col("y") + F.col("y0") - F.col("region.cy")
    reach = F.sqrt(F.col("region.radius") * F.col("region.radius") - down * down)  # NaN beyond the circle
    circle = F.col("region.kind") == "circle"
    first = F.when(circle, F.ceil(F.col("region.cx") - reach)).otherwise(0)
    last = F.when(circle, F.floor(F.col("region.cx") + reach) + 1).otherwise(F.col("width"))
    inside = rows.where(~circle | (F.abs(down) <= F.col("region.radius")))
    cut = lambda x: F.least(F.greatest(x - F.col("x0"), F.lit(0)), F.col("wide")).cast("int")
    return inside.select("key", "y", cut(first).alias("left"), cut(last).alias("right")).where(F.col("left") < F.col("right"))


def shared_masks(images: DataFrame, records: DataFrame, name: str = "name") -> DataFrame:
    """name, key, width, height of the mask and pixels, the valid ones: rendered once for each distinct key and joined back to all images."""
    keyed = mask_keys(images, records, name)
    area = mask_rows(keyed).groupBy("key").agg(F.sum(F.col("right") - F.col("left")).alias("pixels"))
    sized = keyed.select(name, "key", F.coalesce("crop.width", F.col("width")).alias("width"), F.coalesce("crop.height", F.col("height")).alias("height"))
    return sized.join(area, "key", "left").select(name, "key", "width", "height", F.coalesce("pixels", F.lit(0)).cast("long").alias("pixels"))
