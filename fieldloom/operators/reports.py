"""Reports and checks over catalogs, cameras, masks and models; and small table rewrites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.expr import norm, rotation_degrees, unit
from fieldloom.operators.robust import quantile
from fieldloom.operators.work import stored


def camera_policy(images: DataFrame, camera: str, prior: str, refine: str) -> DataFrame:
    """Per camera its policy, whether its images agree on it, and whether it is fixed (known and not refined)."""
    one = images.groupBy(camera).agg(F.count_distinct(F.struct(prior, refine)).alias("policies"), F.max(prior).alias("prior"), F.max(refine).alias("refine"), F.count(F.lit(1)).alias("images"))
    return one.select(camera, "images", (F.col("policies") == 1).alias("consistent"), (F.col("prior") & ~F.col("refine") & (F.col("policies") == 1)).alias("fixed"))


def mask_statistics(masks: DataFrame, by: list[str], coverage: str, by_prompt: str, warning: str) -> tuple[DataFrame, DataFrame]:
    """Mean and largest coverage and warnings per group; and the mean coverage of each prompt (a map's keys)."""
    total = masks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(coverage).alias("mean"), F.max(coverage).alias("largest"), F.count_if(F.col(warning)).alias("warnings"))
    prompts = masks.select(*by, F.explode(by_prompt).alias("prompt", "share")).groupBy(*by, "prompt").agg(F.avg("share").alias("mean"), F.count(F.lit(1)).alias("n"))
    return total, prompts


def first_existing(wanted: DataFrame, key: str, candidates: list[Column], existing: DataFrame, path: str) -> DataFrame:
    """For each key the first of its candidate paths that exists, or null."""
    tried = wanted.select(key, F.posexplode(F.array(*candidates)).alias("place", path))
    found = tried.join(existing.select(path).distinct(), path, "left_semi").groupBy(key).agg(F.min_by(path, "place").alias(path))
    return wanted.select(key).join(found, key, "left")


def resolution_needs(sources: DataFrame, projection: str, width: str, height: str, enabled: str, rig: bool = False) -> DataFrame:
    """One row: what the enabled sources with a size need of four settings. rig: whether spherical sources are cut into flat views.

    Fixed values: the least of each setting, steps of 256, and the bounds of flat views and masks by projection."""
    up = lambda x: F.ceil(x / 256.0) * 256
    w, edge, kind = F.col(width), F.greatest(width, height), F.col(projection)
    sphere, twin, flat = kind == "equirectangular", kind == "dual_fisheye", kind == "perspective"
    view = F.when(sphere, up(w / 4)).when(twin, up(edge / 2)).otherwise(0)
    cut = F.greatest(F.lit(1024), F.least(F.lit(4096), view))
    size = F.when(flat, 2048).otherwise(F.greatest(F.lit(2048), cut if rig else F.when(sphere, up(w)).otherwise(up(edge))))
    count = F.lit(8192) if rig else F.when(flat, 8192).when(sphere, 32768).otherwise(16384)
    whole = F.when(sphere, F.least(F.lit(4096), up(w))).when(twin, F.least(F.lit(3072), up(edge))).otherwise(2048)
    mask = F.greatest(F.lit(2048), F.when(flat, 2048).otherwise(F.least(F.lit(3072), view)) if rig else whole)
    used = sources.where(F.col(enabled) & (F.coalesce(w, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0))
    most = lambda x, least: F.greatest(F.lit(least), F.coalesce(F.max(x), F.lit(least))).cast("long")
    return used.agg(most(size, 2048).alias("feature_size"), most(count, 8192).alias("feature_count"), most(mask, 2048).alias("mask_size"), most(F.when(view > 0, cut), 1024).alias("view_size"))


def block_split(capture: Column, size: int = 20) -> Column:
    """fit or heldout, by blocks of captures in turn."""
    return F.when(F.floor(capture / size) % 2 == 0, "fit").otherwise("heldout")


def is_holdout(capture: Column) -> Column:
    """Every fifth capture, from the third on; all its sensors together."""
    return F.pmod(capture, F.lit(5)) == 2


def reference_camera(images: DataFrame, camera: str, named: Column) -> DataFrame:
    """One row: the camera with most images among those named; if none is named, among all; ties to the lowest id."""
    counts = images.groupBy(camera).agg(F.count(F.lit(1)).alias("n"), F.count_if(named).alias("named"))
    return counts.agg(F.min_by(camera, F.struct(-F.col("named"), -F.col("n"), F.col(camera))).alias(camera))


def camera_groups(images: DataFrame, signature: list[str], order: str) -> DataFrame:
    """Images with the number of their signature's group, in the order in which signatures first appear; nulls are values."""
    first = images.groupBy(*signature).agg(F.min(order).alias("__first"))
    numbers = first.withColumn("group", F.row_number().over(Window.orderBy("__first")) - 1).drop("__first")  # one row a signature
    same = [images[c].eqNullSafe(numbers[c]) for c in signature]
    return images.join(F.broadcast(numbers) if numbers.count() <= 10_000 else numbers, same).select(images["*"], numbers["group"])


def frames_without(frames: DataFrame, gone: DataFrame, image_kind: int) -> DataFrame:
    """Frame references less those to images that are gone; frames that keep no image go whole.

    frames: frame_id, sensor_type, data_id. References of other kinds stay with their frame."""
    is_image = F.col("sensor_type") == image_kind
    marked = frames.join(gone.select(F.col("image_id").alias("data_id"), F.lit(True).alias("__gone")), "data_id", "left")
    kept = marked.where(~(is_image & F.coalesce("__gone", F.lit(False)))).drop("__gone")
    alive = kept.where(is_image).select("frame_id").distinct()
    return kept.join(alive, "frame_id", "left_semi")


def frame_problems(frames: DataFrame, images: DataFrame, image_kind: int) -> DataFrame:
    """problem, n: images in several frames, in one twice, or unknown."""
    refs = frames.where(F.col("sensor_type") == image_kind)
    several = refs.groupBy("data_id").agg(F.count_distinct("frame_id").alias("f"), F.count(F.lit(1)).alias("n"))
    odd = several.select(F.when(F.col("f") > 1, "image_in_several_frames").when(F.col("n") > 1, "image_repeated").alias("problem")).where("problem IS NOT NULL")
    unknown = refs.join(images.select(F.col("image_id").alias("data_id")), "data_id", "left_anti").select(F.lit("unknown_image").alias("problem"))
    return odd.union(unknown).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def pose_support(votes: DataFrame, by: list[str], error: str, x: str, y: str, width: str, height: str, capture: str, most: float = 4.0, least: int = 10) -> DataFrame:
    """Per query image: matches, inliers, their ratio, the share of the image they span, captures with enough inliers, and whether that is support.

    Supported: at least 20 inliers, a quarter of all, 15 % of width and height, and two captures."""
    good = F.col(error) <= most
    per = votes.groupBy(*by, capture).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("inner"), F.min(F.when(good, F.col(x) / F.col(width))).alias("x0"), F.max(F.when(good, F.col(x) / F.col(width))).alias("x1"),
        F.min(F.when(good, F.col(y) / F.col(height))).alias("y0"), F.max(F.when(good, F.col(y) / F.col(height))).alias("y1"),
    )
    out = per.groupBy(*by).agg(F.sum("n").alias("matches"), F.sum("inner").alias("inliers"), (F.max("x1") - F.min("x0")).alias("span_x"), (F.max("y1") - F.min("y0")).alias("span_y"), F.count_if(F.col("inner") >= least).alias("captures"))
    ok = (F.col("inliers") >= 20) & (F.col("inliers") >= 0.25 * F.col("matches")) & (F.least("span_x", "span_y") >= 0.15) & (F.col("captures") >= 2)
    return out.withColumn("supported", F.coalesce(ok, F.lit(False)))


def widest_angles(rays: DataFrame, by: str, ident: str, ray: str, block: int = 2048) -> DataFrame:
    """Per track the largest angle between two of its rays, in degrees, folded to 90; rays are arrays of three. Exact, so the work grows with the square of a track.

    Rays are dealt by ident into blocks of about `block` rows; pairs of blocks are spread over the tasks, and a task holds the products of one pair of blocks at a time."""
    r = lambda k: F.get(ray, F.lit(k)).cast("double")
    three = F.coalesce(F.size(ray) == 3, F.lit(False))
    sound = rays.where(F.col(by).isNotNull() & F.col(ident).isNotNull()).select(by, F.col(ident).alias("id"), *(F.when(three, r(k)).alias(f"r{k}") for k in range(3)))
    blocks = sound.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = sound.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    whole = stored(dealt.groupBy(by, "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("id", *(F.coalesce(f"r{k}", F.lit(float("nan"))).alias(f"r{k}") for k in range(3)))).alias("rows")), "ray-blocks")
    pairs = whole.select(by, "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    spread = max(1, -(-pairs.count() // 8))
    one, two = whole.select(by, "block", F.col("rows").alias("a")), whole.select(by, F.col("block").alias("other"), F.col("rows").alias("b"))
    met = pairs.join(one, [by, "block"]).join(two, [by, "other"]).select(by, (F.col("block") == F.col("other")).alias("own"), "a", "b").repartition(spread)
    kind = rays.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, a, b in zip(batch.column("own").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.stack([v.values.field(f"r{k}").to_numpy(zero_copy_only=False) for k in range(3)]) for v in (a, b))
                same = a.values.field("id").dictionary_encode().indices.to_numpy() if own else None
                least, any_ = np.inf, not own or bool((same != same[0]).any())
                for at in range(0, x.shape[1], 256):
                    with np.errstate(all="ignore"):
                        dot = np.abs(x[:, at : at + 256].T @ y)
                    if own:
                        dot[same[at : at + 256, None] == same] = np.inf
                    found = dot.min()
                    least = min(least, np.fmin.reduce(dot, axis=None) if np.isnan(found) else found)
                out.append((min(least, 1.0) if least == least else 1.0) if any_ else None)
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(out, pa.float64())], [by, "least"])

    least = met.mapInArrow(run, f"{by} {kind}, least double").where("least IS NOT NULL")
    return least.groupBy(by).agg(F.degrees(F.acos(F.min("least"))).alias("angle"))


def appended_points(points: DataFrame, observations: DataFrame, new: DataFrame, seen: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Points and observations with new ones behind: ids go on from the largest, observation numbers from each image's count.

    new: order and the points' columns less the id. seen: order, image_id, x, y."""
    from fieldloom.operators.spatial import numbered

    top = points.agg(F.coalesce(F.max("point3d_id"), F.lit(0))).first()[0]
    added = numbered(new, [order]).withColumn("point3d_id", F.col("__at") + top + 1).drop("__at")
    counts = observations.groupBy("image_id").agg(F.count(F.lit(1)).alias("__n"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(order)) - 1
    more = seen.join(added.select(order, "point3d_id"), order).join(counts, "image_id", "left").withColumn("point2d_idx", (F.coalesce("__n", F.lit(0)) + place).cast("int"))
    return points.unionByName(added.select(*points.columns)), observations.unionByName(more.select(*observations.columns))


def masked_psnr(pixels: DataFrame, by: list[str], a: str, b: str, mask: str) -> DataFrame:
    """Mean squared error over the pixels that the mask leaves, and its PSNR (null at zero)."""
    from fieldloom.functions.expr import psnr

    d = F.col(a) - F.col(b)
    return pixels.where(F.col(mask)).groupBy(*by).agg(F.avg(d * d).alias("mse"), F.count(F.lit(1)).alias("pixels")).withColumn("psnr", psnr(F.col("mse")))


def texture_grid(points: DataFrame, texture: str, angle: str, captures: str) -> DataFrame:
    """How many points pass each filter: all or weak texture (lowest fifth), captures 3 or 4, angles 6, 8, 10 degrees."""
    cut = points.agg(quantile(texture, 0.2)).first()[0]
    weak = F.lit(False) if cut is None else F.col(texture) <= cut
    cells = [(s, c, d) for s in ("all", "weak") for c in (3, 4) for d in (6, 8, 10)]
    counts = [F.struct(F.lit(s).alias("subset"), F.lit(c).alias("captures"), F.lit(d).alias("angle"), F.count_if((weak if s == "weak" else F.lit(True)) & (F.col(captures) >= c) & (F.col(angle) >= d)).alias("n")) for s, c, d in cells]
    return points.agg(F.array(*counts).alias("cells")).select(F.inline("cells"))


def ground_per_camera(rows: DataFrame, camera: str, y: str, height: str, least: int = 3) -> DataFrame:
    """Per camera with enough ground points: their median y, and the median height above."""
    return rows.groupBy(camera).agg(F.count(F.lit(1)).alias("n"), quantile(y, 0.5).alias("ground"), quantile(height, 0.5).alias("height")).where(F.col("n") >= least)


def reconstruction_gate(model: DataFrame, registered: str, total: str, points: str, unsupported: str, broken: str, min_ratio: float, min_points: int) -> DataFrame:
    """The first gate that a model fails: registered_ratio, min_points3D, unsupported_frames, continuity; null if none."""
    fail = F.when(F.col(registered) < min_ratio * F.col(total), "registered_ratio").when(F.col(points) < min_points, "min_points3D").when(F.col(unsupported) > 0, "unsupported_frames").when(F.col(broken), "continuity")
    return model.withColumn("failed", fail)


def best_model(models: DataFrame, by: list[str], passed: str, registered: str, points: str, images: str, ident: str) -> DataFrame:
    """Per group the best run: passed, then most registered, most points, most images."""
    return models.groupBy(*by).agg(F.max_by(ident, F.struct(F.col(passed).cast("int"), registered, points, images)).alias("best"))


def trajectory_steps(models: DataFrame, expected: DataFrame) -> DataFrame:
    """source, model, a, b (capture numbers), distance and rotation_degrees of the steps between neighbouring expected captures that every model has: for comparing trajectories of one input.

    models: model, source, capture, centre (array of three), q (orientation: w, x, y, z); expected: source, capture. A source with a capture twice, or with fewer than two, is an error."""
    counts = expected.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("capture").alias("d"))
    checked = expected.join(counts, "source").where(F.when((F.col("n") < 2) | (F.col("n") != F.col("d")), F.raise_error("an ordered source needs two captures or more, one image each").cast("boolean")).otherwise(F.lit(True)))
    steps = checked.select("source", F.lag("capture").over(Window.partitionBy("source").orderBy("capture")).alias("a"), F.col("capture").alias("b")).where("a IS NOT NULL")
    all_models = models.agg(F.count_distinct("model").alias("all"))
    end = lambda s: models.select("model", "source", F.col("capture").alias(s), F.col("centre").alias(f"c_{s}"), F.col("q").alias(f"q_{s}"))
    met = steps.join(end("a"), ["source", "a"]).join(end("b"), ["source", "b", "model"])
    whole = met.groupBy("source", "a").agg(F.count_distinct("model").alias("n")).join(F.broadcast(all_models), F.col("n") == F.col("all")).select("source", "a")  # all_models: one row
    part = lambda c, n: [F.get(c, F.lit(k)) for k in range(n)]
    apart = [x - y for x, y in zip(part("c_a", 3), part("c_b", 3), strict=True)]
    return met.join(whole, ["source", "a"], "left_semi").select("source", "model", "a", "b", norm(apart).alias("distance"), rotation_degrees(unit(part("q_a", 4)), unit(part("q_b", 4))).alias("rotation_degrees"))


def largest_steps(steps: DataFrame, most: int = 30) -> DataFrame:
    """Of each source and model the steps of largest distance (ties: the earlier first), with their place from 1."""
    place = F.row_number().over(Window.partitionBy("source", "model").orderBy(F.desc("distance"), "a"))
    return steps.withColumn("place", place).where(F.col("place") <= most)


def common_steps(models: DataFrame, model: str, order: str, position: list[str]) -> DataFrame:
    """Distances between neighbours (by expected order) that all models have: model, order, step. For comparing trajectories."""
    from functools import reduce

    nxt = models.select(model, (F.col(order) + 1).alias(order), *(F.col(p).alias(f"b_{p}") for p in position))
    d = F.sqrt(reduce(lambda a, b: a + b, ((F.col(p) - F.col(f"b_{p}")) * (F.col(p) - F.col(f"b_{p}")) for p in position)))
    steps = models.join(nxt, [model, order]).select(model, order, d.alias("step"))
    n = models.select(model).distinct().count()
    return steps.join(steps.groupBy(order).agg(F.count_distinct(model).alias("__n")).where(F.col("__n") == n).select(order), order, "left_semi")


def crop_plan(regions: DataFrame, camera: str, rect: list[str], step: int) -> DataFrame:
    """Per camera the common crop, aligned; `consistent` is false where its images have different regions. Columns of size: width, height."""
    from fieldloom.functions.expr import crop_edges

    one = regions.groupBy(camera).agg(F.count_distinct(F.struct(*rect)).alias("regions"), *(F.min(c).alias(c) for c in rect), F.max("width").alias("width"), F.max("height").alias("height"))
    edges = crop_edges(*(F.col(c) for c in rect), F.col("width"), F.col("height"), step)
    return one.select(camera, (F.col("regions") == 1).alias("consistent"), *(e.alias(c) for e, c in zip(edges, rect, strict=True)))
