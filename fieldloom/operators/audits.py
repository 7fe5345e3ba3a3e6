"""Reports and checks over models, images and runs: one row, or one row a group; and the small filters they stand on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.robust import quantile, with_mad
from fieldloom.operators.spatial import nearest
from fieldloom.operators.work import stored

#: The quantiles of a report, and the codes of a data set's errors in their order.
QUANTILES = {"median": 0.5, "p95": 0.95, "p99": 0.99, "maximum": 1.0}
ERRORS = ("unsupported_camera_models", "invalid_image_paths", "missing_camera_references", "missing_images", "corrupt_images", "image_size_mismatches", "corrupt_masks", "mask_size_mismatches")


def distance(a: list[str], b: list[str]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, ((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b, strict=True))))


def feature_summary(keypoints: DataFrame, descriptors: DataFrame, rows: str = "rows") -> DataFrame:
    """One row: images with keypoints, the least, mean and most of them, and images with descriptors. keypoints: one row an image."""
    least, mean, most = (F.coalesce(f(rows), F.lit(0)) for f in (F.min, F.avg, F.max))
    k = keypoints.agg(F.count(F.lit(1)).alias("images"), least.alias("minimum_keypoints"), mean.cast("double").alias("average_keypoints"), most.alias("maximum_keypoints"))
    return k.crossJoin(descriptors.agg(F.count(F.lit(1)).alias("descriptor_images")))  # one row each


def capture_count(images: DataFrame, source: str, capture: str) -> DataFrame:
    """One row: the captures, counted as sources' numbers, not as images."""
    return images.agg(F.count_distinct(F.struct(source, capture)).alias("frame_count"))


def path_consistency(centres: DataFrame, source: str, capture: str, xyz: list[str], primary: object, supplemental: object, least: int = 20, sigma: float = 8.0, radii: float = 2.0, steps: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """How far a supplemental source's captures lie from the primary one's path: one row of figures, and capture, distance of the outliers.

    centres: images; the mean of a capture's images is its place. The threshold is the median distance and `sigma` robust deviations, at least
    `steps` times the 95th percentile of the primary's steps between consecutive captures, at most `radii` times the 95th percentile of its radius (if that is
    above 0). With fewer than `least` captures on either side nothing is judged: available is false and passed true."""
    places = centres.groupBy(source, capture).agg(*(F.avg(c).alias(c) for c in xyz))
    p = stored(places.where(F.col(source) == F.lit(primary)).select(capture, *xyz), "primary")
    s = stored(places.where(F.col(source) == F.lit(supplemental)).select(capture, *xyz), "supplemental")
    n_p, n_s = p.count(), s.count()
    counts = [F.lit(n_p).cast("long").alias("primary_captures"), F.lit(n_s).cast("long").alias("supplemental_captures")]
    names = ("radius_p95", "step_p95", "median", "mad", "p95", "largest", "threshold")
    if n_p < least or n_s < least:
        row = p.sparkSession.range(1).select(F.lit(False).alias("available"), F.lit(True).alias("passed"), *counts, *(F.lit(None).cast("double").alias(c) for c in names), F.lit(0).cast("long").alias("outliers"))
        return row, s.select(capture, F.lit(0.0).alias("distance")).limit(0)
    middle = p.agg(*(quantile(c, 0.5).alias(f"m_{c}") for c in xyz))
    radius = p.crossJoin(middle).agg(quantile(distance(xyz, [f"m_{c}" for c in xyz]), 0.95).alias("radius_p95"))  # middle: one row
    after = p.select((F.col(capture) - 1).alias(capture), *(F.col(c).alias(f"n_{c}") for c in xyz))
    step = p.join(after, capture).agg(F.coalesce(quantile(distance(xyz, [f"n_{c}" for c in xyz]), 0.95), F.lit(0.0)).alias("step_p95"))
    near = stored(nearest(s, p.withColumnRenamed(capture, "__p"), xyz, capture, "__p").select(capture, "distance"), "distances")
    d = with_mad(near.withColumn("__all", F.lit(0)), ["__all"], "distance").select("median", "mad").crossJoin(near.agg(quantile("distance", 0.95).alias("p95"), F.max("distance").alias("largest")))
    envelope = radii * F.col("radius_p95")
    high = F.greatest(F.col("median") + sigma * 1.4826 * F.col("mad"), steps * F.col("step_p95"), F.lit(1e-9))
    figures = stored(d.crossJoin(radius).crossJoin(step).withColumn("threshold", F.when(envelope > 0, F.least(high, envelope)).otherwise(high)), "figures")  # one row
    far = near.crossJoin(F.broadcast(figures.select("threshold"))).where("distance > threshold").select(capture, "distance")
    row = figures.crossJoin(far.agg(F.count(F.lit(1)).alias("outliers"))).select(F.lit(True).alias("available"), (F.col("outliers") == 0).alias("passed"), *counts, *names, "outliers")
    return row, far


def gaussian_summary(splats: DataFrame, xyz: list[str], log_scales: list[str], logit: str) -> DataFrame:
    """One row on splats: rows, finite ones, the median centre, and quantiles of radius, largest scale, that over the radius' 95th percentile, and opacity; counts beyond 0.2, 0.5 and half."""
    whole = reduce(lambda a, b: a & b, (F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in (*xyz, *log_scales)))
    rows = splats.count()
    x = stored(splats.where(whole).select(*(F.col(c).cast("double").alias(c) for c in xyz), F.exp(F.greatest(*log_scales).cast("double")).alias("scale"), (1 / (1 + F.exp(-F.col(logit).cast("double")))).alias("opacity")), "splats")
    middle = x.agg(*(quantile(c, 0.5).alias(f"centre_{c}") for c in xyz))
    x = stored(x.crossJoin(F.broadcast(middle)).withColumn("radius", distance(xyz, [f"centre_{c}" for c in xyz])), "radii")  # middle: one row
    p95 = x.agg(quantile("radius", 0.95).alias("scene_radius_p95"))
    x = x.crossJoin(F.broadcast(p95)).withColumn("relative", F.col("scale") / F.col("scene_radius_p95"))
    spread = [quantile(c, f).alias(f"{c}_{n}") for c in ("radius", "scale", "relative", "opacity") for n, f in QUANTILES.items()]
    over = [F.count_if(F.col(c) > v).alias(n) for c, v, n in (("relative", 0.2, "relative_over_0_2"), ("relative", 0.5, "relative_over_0_5"), ("opacity", 0.5, "opacity_over_0_5"))]
    return x.agg(F.lit(rows).cast("long").alias("vertices"), F.count(F.lit(1)).alias("finite_vertices"), *(F.first(f"centre_{c}").alias(f"centre_{c}") for c in xyz), F.first("scene_radius_p95").alias("scene_radius_p95"), *spread, *over)


def median_step(centres: DataFrame, source: str, capture: str, xyz: list[str]) -> DataFrame:
    """Per source the median of the steps above 1e-10 from each of its captures to the next there is; sources that do not move are left out."""
    places = centres.groupBy(source, capture).agg(*(F.avg(c).alias(c) for c in xyz))
    w = Window.partitionBy(source).orderBy(capture)
    steps = places.select(source, *xyz, *(F.lag(c).over(w).alias(f"l_{c}") for c in xyz)).withColumn("step", distance(xyz, [f"l_{c}" for c in xyz]))
    return steps.where("step > 1e-10").groupBy(source).agg(quantile("step", 0.5).alias("median_step"))


def trajectory_extent(centres: DataFrame, xyz: list[str]) -> DataFrame:
    """One row: the diagonal of the box around the centres (0 for fewer than two), and how many differ after rounding to 6 places."""
    diagonal = F.sqrt(reduce(lambda a, b: a + b, ((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in xyz)))
    return centres.agg(F.coalesce(diagonal, F.lit(0.0)).alias("diameter"), F.count_distinct(F.struct(*(F.round(c, 6).alias(c) for c in xyz))).alias("unique_centres"), F.count(F.lit(1)).alias("centres"))


def dataset_images(images: DataFrame, cameras: DataFrame, files: DataFrame, masks: DataFrame, safe: Column) -> DataFrame:
    """image_id, name, image_state, mask_state: what is first found wrong with each image and, where that is nothing, with its mask.

    images: image_id, name, camera_id; cameras: camera_id, width, height; files and masks: name, width, height of those there are (sizes null: unreadable)."""
    size = lambda t, p: t.select("name", F.col("width").alias(f"{p}_w"), F.col("height").alias(f"{p}_h"), F.lit(True).alias(f"{p}_there"))
    cam = cameras.select("camera_id", F.col("width").alias("c_w"), F.col("height").alias("c_h"), F.lit(True).alias("c_there"))
    rows = images.select("image_id", "name", "camera_id", safe.alias("__safe")).join(cam, "camera_id", "left").join(size(files, "f"), "name", "left").join(size(masks, "m"), "name", "left")
    lost, odd = (lambda p: F.col(f"{p}_there").isNull()), (lambda p: F.col(f"{p}_w").isNull() | F.col(f"{p}_h").isNull())
    differ = lambda p, q: (F.col(f"{p}_w") != F.col(f"{q}_w")) | (F.col(f"{p}_h") != F.col(f"{q}_h"))
    image = F.when(~F.coalesce("__safe", F.lit(False)), "invalid_image_paths").when(lost("f"), "missing_images").when(lost("c"), "missing_camera_references").when(odd("f"), "corrupt_images").when(differ("f", "c"), "image_size_mismatches").otherwise("valid")
    mask = F.when(lost("m"), "missing_masks").when(odd("m"), "corrupt_masks").when(differ("m", "f"), "mask_size_mismatches").otherwise("matched")
    return rows.select("image_id", "name", image.alias("image_state"), F.when(image == "valid", mask).alias("mask_state"))


def dataset_report(judged: DataFrame, cameras: DataFrame, supported: Column, mask_files: DataFrame, reference: DataFrame, xyz: list[str]) -> DataFrame:
    """One row: counts of every state, errors and warnings, whether the data set loads and whether a trainer may have it.

    judged: see dataset_images; cameras: those that are used; reference: the centres of the reference camera."""
    states = ["invalid_image_paths", "missing_images", "missing_camera_references", "corrupt_images", "image_size_mismatches"], ["missing_masks", "corrupt_masks", "mask_size_mismatches", "matched"]
    counted = judged.agg(F.count(F.lit(1)).alias("images"), *(F.count_if(F.col("image_state") == s).alias(s) for s in states[0]), *(F.count_if(F.col("mask_state") == s).alias(s) for s in states[1]))
    one = counted.crossJoin(cameras.agg(F.count_if(~supported).alias("unsupported_camera_models"))).crossJoin(mask_files.agg(F.count(F.lit(1)).alias("mask_files"))).crossJoin(trajectory_extent(reference, xyz))  # one row each
    collapsed = (F.col("diameter") < 1e-4) & (F.col("centres") > 1)
    errors = F.array_compact(F.array(*(F.when(F.col(c) > 0, c) for c in ERRORS)))
    warnings = F.array_compact(F.array(F.when(collapsed, "collapsed_reference_camera_trajectory"), F.when((F.col("matched") > 0) & (F.col("matched") < F.col("images")), "partial_registered_masks"), F.when(F.col("mask_files") > F.col("matched"), "unmatched_mask_files")))
    return one.withColumns({"errors": errors, "warnings": warnings, "loadable": F.size(errors) == 0, "training_ready": (F.size(errors) == 0) & ~collapsed})


def angular_audit(keypoints: DataFrame, by: list[str], image: str, theta: str, most: str) -> DataFrame:
    """Per group: images, keypoints, those at a right angle or more, those at the valid angle or more, and the largest angle in degrees. theta, most: radians."""
    t = F.col(theta)
    return keypoints.groupBy(*by).agg(
        F.count_distinct(image).alias("images"), F.count(F.lit(1)).alias("keypoints"), F.count_if(t >= F.acos(F.lit(0.0))).alias("outside_hemisphere"), F.count_if(t >= F.col(most)).alias("outside_valid_angle"),
        F.degrees(F.max(t)).alias("maximum_angle_deg"), F.degrees(F.max(most)).alias("valid_angle_deg"),
    )


def busy(projects: DataFrame, jobs: DataFrame, project: str = "id") -> DataFrame:
    """project, busy: whether a job of it is queued or runs."""
    active = jobs.where(F.col("status").isin("queued", "running")).select(F.col("project_id").alias(project)).distinct().withColumn("__busy", F.lit(True))
    return projects.select(project).join(active, project, "left").select(project, F.coalesce("__busy", F.lit(False)).alias("busy"))


def subset_coverage(observations: DataFrame, images: DataFrame, subsets: dict[str, DataFrame | None], n: int = 16, least: int = 3) -> DataFrame:
    """name, label, points, cells: of each image the observations of a subset's points, and the grid cells with at least `least` of them. Images without any have 0.

    observations: name, point, x, y (shares of the image's size); subsets: label to points, or None for all."""
    cell = lambda c: F.floor(F.col(c) * n)
    out = None
    for label, points in subsets.items():
        chosen = observations if points is None else observations.join(points.select("point").distinct(), "point", "left_semi")
        cells = chosen.groupBy("name", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count(F.lit(1)).alias("k"))
        inner = F.col("cx").between(0, n - 1) & F.col("cy").between(0, n - 1)
        seen = cells.groupBy("name").agg(F.sum("k").alias("points"), F.count_if(inner & (F.col("k") >= least)).alias("cells"))
        rows = images.select("name", "role").join(seen, "name", "left").select("name", "role", F.lit(label).alias("label"), F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("cells", F.lit(0)).alias("cells"))
        out = rows if out is None else out.unionByName(rows)
    return out


def coverage_by_role(coverage: DataFrame) -> DataFrame:
    """role, label, images, zero_images, under_10_images, observations of subset_coverage's rows."""
    return coverage.groupBy("role", "label").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("points") == 0).alias("zero_images"), F.count_if(F.col("points") < 10).alias("under_10_images"), F.sum("points").alias("observations"))


def retention_quantiles(retained: DataFrame, by: list[str], retention: str = "retention") -> DataFrame:
    """Per group the 5th, 50th and 95th percentile of the share of cells that images retain; images without cells are left out."""
    return retained.groupBy(*by).agg(*(quantile(retention, f).alias(n) for n, f in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))))


def worst(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in the order; a report's length."""
    return rows.orderBy(*order).limit(n)


def in_project_order(sources: DataFrame) -> DataFrame:
    """Enabled sources by ordinal, time of creation and id."""
    return sources.where("enabled").orderBy("ordinal", "created_at", "id")


def by_name(rows: DataFrame, name: str, newest: str | None = None) -> DataFrame:
    """Rows by name whatever its case, or newest first."""
    return rows.orderBy(F.desc(newest), name) if newest else rows.orderBy(F.lower(name), name)


def sampled(rows: DataFrame, n: int, order: list[str], seed: int = 0) -> DataFrame:
    """n rows chosen without replacement by a hash of their key `order`, in that order; all if there are no more. A random generator's choice cannot be repeated over partitions; this one is the same for any."""
    h = F.xxhash64(F.lit(seed), *order)
    return rows.withColumn("__h", h).orderBy("__h", *order).limit(n).drop("__h").orderBy(*order)


def wins(rows: DataFrame, key: list[str], order: list[str], last: bool = True) -> DataFrame:
    """Of rows with equal keys the last (or the first) in the order."""
    row = F.struct(*rows.columns)
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(pick(row, F.struct(*order)).alias("__row")).select("__row.*")


def track_captures(observations: DataFrame, point: str, order: str, capture: str) -> DataFrame:
    """point, captures: the captures of each track, each once, in the order in which it is first seen. A track is short."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct(order, capture))), lambda s: s[capture])
    return observations.groupBy(point).agg(F.array_distinct(seen).alias("captures"))


def assembled_tracks(observations: DataFrame, point: str, source: str, capture: str, values: list[str]) -> DataFrame:
    """Per point its observations as arrays, sorted by source and capture: captures (structs) and one array for each of `values`. A track is short."""
    rows = F.array_sort(F.collect_list(F.struct(source, capture, *values)))
    track = observations.groupBy(point).agg(rows.alias("__t"))
    return track.select(point, F.transform("__t", lambda s: F.struct(s[source].alias(source), s[capture].alias(capture))).alias("captures"), *(F.col("__t")[v].alias(v) for v in values))


def frame_name(place: Column) -> Column:
    return F.format_string("frame_%06d", place)


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def pairing(requested: Column, sources: Column, images: Column, features: Column, tree: Column) -> Column:
    """The pairing strategy: what is asked for; else sequential for one source, exhaustive up to 500 images, the vocabulary tree if there is one for these features; else null, which is an error."""
    return F.when(requested != "auto", requested).when(sources <= 1, "sequential").when(images <= 500, "exhaustive").when(F.startswith(features, F.lit("SIFT")) & tree, "vocab_tree")


def colours_completed(before: DataFrame, after: DataFrame, counts: list[str], metrics: list[str], black: str) -> DataFrame:
    """One row of two models' summaries (one row each): whether counts are equal and metrics equal to 1e-12, and the black points before, after, and resolved."""
    b = after.select(*(F.col(c).alias(f"after_{c}") for c in (*counts, *metrics, black)))
    close = lambda m: (F.col(m).isNull() | F.col(f"after_{m}").isNull()) | (F.abs(F.col(m) - F.col(f"after_{m}")) <= F.greatest(1e-12 * F.greatest(F.abs(m), F.abs(f"after_{m}")), F.lit(1e-12)))
    same = reduce(lambda x, y: x & y, [*(F.col(c).eqNullSafe(F.col(f"after_{c}")) for c in counts), *map(close, metrics)], F.lit(True))
    return before.crossJoin(b).select(same.alias("unchanged"), F.col(black).alias("black_before"), F.col(f"after_{black}").alias("black_after"), F.greatest(F.lit(0), F.col(black) - F.col(f"after_{black}")).alias("resolved"))


def correspondence_scores(rows: DataFrame, by: list[str], error: str, x: str, y: str, width: str, height: str) -> DataFrame:
    """Per image: count, inliers (within 4 px), their ratio, the share of width and height they span, the mean error cut at 4, and whether that is support.

    Fixed values: at least 20 inliers, a quarter of all, 15 % of width and height."""
    good = F.coalesce(F.col(error) <= 4, F.lit(False))
    span = lambda c, size: F.coalesce((F.max(F.when(good, F.col(c))) - F.min(F.when(good, F.col(c)))) / F.max(size), F.lit(0.0))
    cut = F.when(F.col(error).isNull() | F.isnan(error), 4.0).otherwise(F.least(F.col(error), F.lit(4.0)))
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.count_if(good).alias("inliers"), span(x, width).alias("coverage_x"), span(y, height).alias("coverage_y"), F.avg(cut).alias("clipped_error"))
    ratio = F.col("inliers") / F.col("count")
    return s.withColumn("ratio", ratio).withColumn("supported", (F.col("inliers") >= 20) & (ratio >= 0.25) & (F.least("coverage_x", "coverage_y") >= 0.15))


def mixed_report(baseline: DataFrame, candidate: DataFrame, by: str, image: str) -> DataFrame:
    """Per source: images of the baseline, those the candidate has too, and over these the supported images and the inliers of both. Images that the candidate lacks stay counted."""
    c = candidate.select(image, F.lit(True).alias("__there"), F.col("supported").alias("__supported"), F.col("inliers").alias("__inliers"))
    rows = baseline.join(c, image, "left").withColumn("__both", F.coalesce("__there", F.lit(False)))
    total = lambda x: F.coalesce(F.sum(F.when(F.col("__both"), x)), F.lit(0)).cast("long")
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("baseline_images"), F.count_if("__both").alias("candidate_images"), F.count_if(F.col("__both") & F.col("supported")).alias("baseline_supported"), total(F.col("inliers")).alias("baseline_inliers"),
        F.count_if(F.col("__both") & F.col("__supported")).alias("candidate_supported"), total(F.col("__inliers")).alias("candidate_inliers"),
    )


def support_report(scores: DataFrame, source: str, version: str) -> DataFrame:
    """source, version, images, supported, correspondences, inliers of pose_support's or correspondence_scores' rows."""
    n = "matches" if "matches" in scores.columns else "count"
    return scores.groupBy(source, version).agg(F.count(F.lit(1)).alias("images"), F.count_if("supported").alias("supported"), F.sum(n).alias("correspondences"), F.sum("inliers").alias("inliers"))


def unique_predictions(rows: DataFrame, key: list[str], error: str) -> DataFrame:
    """The rows, once it is sure that every key is there once and has an error; otherwise an error."""
    bad = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(error).alias("e")).where("n <> 1 OR e <> 1")
    if not bad.isEmpty():
        raise ValueError("every image and keypoint must have one error")
    return rows


def initial_pair(images: DataFrame, primary: object, first: int, second: int) -> tuple[int, int] | None:
    """The two images asked for, or None if none are (0). Both must be given, and both must be of the primary source. images: image_id, source_id."""
    if (first > 0) != (second > 0):
        raise ValueError("both initial images must be given, or none")
    if first <= 0:
        return None
    found = images.where(F.col("image_id").isin(first, second) & (F.col("source_id") == F.lit(primary))).select("image_id").distinct().count()
    if found < len({first, second}):
        raise ValueError("initial images must be of the primary source")
    return first, second


def anchor_primary(images: DataFrame, groups: DataFrame, primary: object) -> DataFrame:
    """One row: sources, the primary's captures, and whether the primary source is solved first: several sources, calibration that is mixed, all of the primary's fixed, and two captures.

    images: source_id, capture_index; groups: source_id, refine_intrinsics."""
    mine = F.col("source_id") == F.lit(primary)
    i = images.agg(F.count_distinct("source_id").alias("sources"), F.count_distinct(F.when(mine, F.col("capture_index"))).alias("captures"))
    fixed = F.count_if(mine & ~F.col("refine_intrinsics"))
    g = groups.agg(F.coalesce(F.bool_or("refine_intrinsics") & F.bool_or(~F.col("refine_intrinsics")), F.lit(False)).alias("mixed"), ((F.count_if(mine) > 0) & (fixed == F.count_if(mine))).alias("fixed"))
    return i.crossJoin(g).withColumn("anchored", (F.col("sources") > 1) & F.col("mixed") & F.col("fixed") & (F.col("captures") >= 2))  # one row each


def primary_only(images: DataFrame, primary: object) -> tuple[DataFrame, DataFrame]:
    """The images of the primary source, and the counts that the input then has."""
    mine = images.where(F.col("source_id") == F.lit(primary))
    return mine, mine.agg(F.count(F.lit(1)).alias("image_count"), F.lit(1).alias("source_count"))


def with_prior(groups: DataFrame) -> DataFrame:
    """Camera groups with has_prior_focal_length filled in where older catalogs lack it: what is refined has none."""
    had = F.col("has_prior_focal_length") if "has_prior_focal_length" in groups.columns else F.lit(None).cast("boolean")
    return groups.withColumn("has_prior_focal_length", F.coalesce(had, ~F.col("refine_intrinsics")))


def frame_path(image: Column, source: Column, folder: str) -> Column:
    """A frame's own image in the project folder, else the one it came from; null is an error."""
    return F.coalesce(F.concat(F.lit(folder.rstrip("/") + "/"), image), source)


def materialised(frames: DataFrame, by: list[str], order: str, sensors: list[str]) -> DataFrame:
    """Chosen source frames with their output number from 0 and the output name for each sensor."""
    at = frames.withColumn("output_index", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("int"))
    name = lambda s: F.concat(F.lit(f"{s}/{s}_"), F.format_string("%06d", "output_index"), F.lit(".jpg"))
    return at.withColumns({f"{s}_name": name(s) for s in sensors})


def source_documents(frames: DataFrame, source: str, order: str, columns: list[str], most: int = 100_000) -> DataFrame:
    """One nested row a source: its frames as an array in their order. A document's frames are a recording's; sources with more than `most` frames are an error."""
    doc = frames.groupBy(source).agg(F.count(F.lit(1)).alias("frames_total"), F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order)))).alias("frames"))
    return doc.withColumn("frames", F.when(F.col("frames_total") > most, F.raise_error("too many frames for one document")).otherwise(F.col("frames")))


def dense_views(images: DataFrame, catalog: DataFrame, cameras: DataFrame, paths: DataFrame, masks: DataFrame) -> DataFrame:
    """Views for densification: images that the catalog knows, with camera and mask (or null). An image whose file is missing is an error.

    images: name, camera_id; catalog: name, source_id; paths: name, path; masks: name, mask."""
    rows = images.join(catalog, "name").join(cameras, "camera_id").join(paths.select("name", "path"), "name", "left").join(masks.select("name", "mask"), "name", "left")
    return rows.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no image file for "), "name")).cast("string")))


def sampled_pixels(points: DataFrame, pixels: DataFrame, image: str, x: str, y: str, width: str, height: str, values: list[str]) -> DataFrame:
    """Points with the values of the pixel they fall on, rounded halves to even and kept within the image. pixels: image, px, py, values."""
    at = lambda c, size: F.greatest(F.lit(0), F.least(F.bround(F.col(c)).cast("int"), F.col(size).cast("int") - 1))
    return points.withColumns({"px": at(x, width), "py": at(y, height)}).join(pixels.select(image, "px", "py", *values), [image, "px", "py"], "left")
