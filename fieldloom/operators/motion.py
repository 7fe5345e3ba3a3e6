"""Motion: local checks of a trajectory, a solver's progress from its log, and alignment to gravity. The names of reasons are fixed values."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import expr
from fieldloom.operators.robust import quantile
from fieldloom.operators.work import stored

#: How a solver's log says what happened.
LINES = {"registration": r"(?i)Registering image #\d+ \(num_reg_frames=(\d+)\)", "failure": r"(?i)Could not register, trying another image", "refinement": r"(?i)Retriangulation and Global bundle adjustment", "success": r"(?i)Keeping successful reconstruction"}


def local_motion(samples: DataFrame, by: str, rank: str, t: str, xyz: list[str], ident: str, radius: int = 8) -> DataFrame:
    """Per sample how far it lies from where its neighbours' motion puts it: by, ident, innovation, step, scatter, threshold, suspect, ambiguous, neighbours.

    Neighbours are the samples within `radius` ranks, at least six, two of them on either side, with at least four intervals between consecutive ranks around; other samples
    are left out. Of the lines through one neighbour before and one behind, that with the least median residual counts; neighbours near it give the line anew by least squares.
    Another line that is as good but puts the sample elsewhere makes it ambiguous. Sources of fewer than seven samples, or that do not move, are left out.
    Ranks are unique within a source; a sample meets 2 * radius others at most, whatever the source's length."""
    if radius < 3:
        raise ValueError("radius must be at least three")
    order = Window.partitionBy(by).orderBy("rank")
    rows = samples.select(by, ident, F.col(rank).cast("long").alias("rank"), F.col(t).cast("double").alias("t"), F.array(*(F.col(c).cast("double") for c in xyz)).alias("at"))
    after = F.lead("rank").over(order) == F.col("rank") + 1
    gap = F.sqrt(F.aggregate(F.zip_with("at", F.lead("at").over(order), lambda a, b: (b - a) * (b - a)), F.lit(0.0), lambda s, v: s + v))
    steps = rows.withColumn("gap", F.when(after, gap))
    whole = steps.groupBy(by).agg(quantile("gap", 0.5).alias("scene"), F.count(F.lit(1)).alias("n")).where("n >= 7 AND scene > 1e-12")
    near = F.collect_list(F.struct("rank", "t", "at", ident, "gap")).over(order.rangeBetween(-radius, radius))
    wide = steps.withColumn("near", near).join(whole.select(by, "scene"), by)
    kind = samples.schema[ident].dataType.simpleString()

    number = pa.float64()
    columns = {"innovation": number, "step": number, "scatter": number, "threshold": number, "suspect": pa.bool_(), "ambiguous": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = batch.column("near")
            flat, size = near.flatten(), pc.list_value_length(near).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            place = flat.field("rank").to_numpy() - batch.column("rank").to_numpy()[row] + radius
            w = _Windows(row, place, flat.field("t").to_numpy(zero_copy_only=False), flat.field("at").flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1), flat.field("gap").to_numpy(zero_copy_only=False), batch.column("scene").to_numpy(), radius)
            found, values, trusted = w.diagnosed()
            where = np.full((batch.num_rows, 2 * radius + 1), -1)
            where[row, place] = np.arange(len(row))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(trusted.sum(1))]), pa.int32()), flat.field(ident).take(pa.array(where[found][trusted])))
            kept = pa.array(found)
            yield pa.RecordBatch.from_arrays([batch.column(by).take(kept), batch.column(ident).take(kept), *(pa.array(v, columns[c]) for c, v in zip(columns, values, strict=True)), ids], [by, ident, *columns, "neighbours"])

    schema = f"{by} {samples.schema[by].dataType.simpleString()}, {ident} {kind}, innovation double, step double, scatter double, threshold double, suspect boolean, ambiguous boolean, neighbours array<{kind}>"
    return wide.select(by, ident, "rank", "t", "at", "near", "scene").mapInArrow(run, schema)


class _Windows:
    """Samples with their surroundings as arrays: a row a sample, a column a rank from `radius` before to `radius` behind; NaN where there is none."""

    def __init__(self, row: np.ndarray, place: np.ndarray, t: np.ndarray, at: np.ndarray, gap: np.ndarray, scene: np.ndarray, radius: int):
        n, wide = len(scene), 2 * radius + 1
        order = np.lexsort((place, row))
        if not np.isfinite(t).all() or (np.diff(t[order])[np.diff(row[order]) == 0] <= 0).any():
            raise ValueError("samples need finite, rising times")
        self.t, self.gap, self.at = np.full((n, wide), np.nan), np.full((n, wide), np.nan), np.full((n, wide, at.shape[1]), np.nan)
        self.t[row, place], self.gap[row, place], self.at[row, place] = t, gap, at
        self.scene, self.radius = scene, radius

    def diagnosed(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Numbers of the samples with enough around them; their innovation, step, scatter, threshold, suspect, ambiguous; and which columns are trusted."""
        r = self.radius
        there = ~np.isnan(self.t)
        between = np.diff(self.t, axis=1)  # NaN unless both ranks are there
        speed = np.where(np.isfinite(self.gap[:, :-1]), self.gap[:, :-1] / between, np.nan)
        enough = (there[:, :r].sum(1) >= 2) & (there[:, r + 1 :].sum(1) >= 2) & (there.sum(1) >= 7) & (np.isfinite(speed).sum(1) >= 4)
        k = np.flatnonzero(enough)
        if not len(k):
            return k, [np.zeros(0)] * 4 + [np.zeros(0, bool)] * 2, np.zeros((0, 2 * r + 1), bool)
        speed, own = speed[k], self.at[k, r]
        step = np.maximum(np.nanmedian(speed, axis=1) * np.nanmedian(np.where(np.isnan(speed), np.nan, between[k]), axis=1), self.scene[k] / 4)
        off, at = self.t[k] - self.t[k, r][:, None], self.at[k]
        off[:, r], at[:, r] = np.nan, np.nan  # the sample itself has no say
        before, behind = (x.ravel() for x in np.meshgrid(np.arange(r), np.arange(r + 1, 2 * r + 1), indexing="ij"))
        rate = (at[:, behind] - at[:, before]) / (off[:, behind] - off[:, before])[:, :, None]
        start = at[:, before] - off[:, before, None] * rate
        rows = np.arange(len(k))
        score = np.full((len(k), len(before)), np.inf)
        for line in range(len(before)):  # a line at a time: one residual for each sample and neighbour
            miss = np.linalg.norm(at - start[:, line, None] - off[:, :, None] * rate[:, line, None], axis=2)
            use = ~np.isnan(start[:, line, 0])
            score[use, line] = np.nanmedian(miss[use], axis=1)
        best = np.argmin(score, axis=1)
        least = score[rows, best]
        miss = np.linalg.norm(at - start[rows, best][:, None] - off[:, :, None] * rate[rows, best][:, None], axis=2)
        use = (miss <= np.maximum(3 * least, step / 2)[:, None]).astype(float)
        x, y = np.nan_to_num(off), np.nan_to_num(at)
        mean_x, mean_y = (use * x).sum(1) / use.sum(1), (use[:, :, None] * y).sum(1) / use.sum(1)[:, None]
        dx = use * (x - mean_x[:, None])
        rise = (dx[:, :, None] * (y - mean_y[:, None])).sum(1) / (dx * dx).sum(1)[:, None]
        origin = mean_y - mean_x[:, None] * rise
        rival = (score <= np.maximum(least * 1.1, step / 10)[:, None]) & (np.linalg.norm(start - origin[:, None], axis=2) > 2 * step[:, None])
        apart = np.linalg.norm(at - origin[:, None] - off[:, :, None] * rise[:, None], axis=2)
        scatter = np.nanmedian(apart, axis=1)
        threshold, innovation = np.maximum(3 * step, 6 * scatter), np.linalg.norm(own - origin, axis=1)
        return k, [innovation, step, scatter, threshold, innovation > threshold, rival.any(1)], apart <= np.maximum(step, 3 * scatter)[:, None]


# --- a solver's log ------------------------------------------------------------------------


def log_events(lines: DataFrame, line: str) -> DataFrame:
    """Lines that say something of registrations, with their kind, and the number that a registration names."""
    kind = F.coalesce(*(F.when(F.col(line).rlike(p), k) for k, p in LINES.items()))
    n = F.regexp_extract(line, LINES["registration"], 1)
    return lines.withColumn("kind", kind).withColumn("n", F.nullif(n, F.lit("")).cast("int")).where("kind IS NOT NULL")


def solver_progress(lines: DataFrame, by: str, order: str, line: str, total: str, low: float = 0.1, high: float = 0.95) -> DataFrame:
    """by, order, kind, registered, refinements, progress behind each line that matters.

    A registration names how many frames were registered before it, and adds one once a refinement or a success follows it before any
    failure or other registration. So, with s the number of those confirmed so far, the count is the largest n - s of any registration, plus s, and at most the total."""
    e = log_events(lines, line)
    w = Window.partitionBy(by).orderBy(order)
    e = e.withColumn("__confirmed", (F.col("kind").isin("refinement", "success") & (F.lag("kind").over(w) == "registration")).cast("int"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("__s", F.coalesce(F.sum("__confirmed").over(so_far), F.lit(0)))
    base = F.greatest(F.lit(0), F.coalesce(F.max(F.when(F.col("kind") == "registration", F.col("n") - F.col("__s"))).over(so_far), F.lit(0)))
    e = e.withColumn("__base", base)
    registered = F.greatest(F.least(F.col(total), F.col("__base") + F.col("__s")), F.coalesce(F.max("n").over(so_far), F.lit(0))).cast("int")
    share = F.least(F.lit(1.0), registered / F.greatest(F.lit(1), F.col(total)))
    return e.select(by, order, "kind", registered.alias("registered"), F.sum((F.col("kind") == "refinement").cast("int")).over(so_far).cast("int").alias("refinements"), (low + (high - low) * share).alias("progress"))


# --- gravity -------------------------------------------------------------------------------


def gravity_up(images: DataFrame, by: str, q: str, gravity: str) -> DataFrame:
    """by, images, up (array), spread, reason: the mean up direction in the world of images (quaternion q) that saw gravity (array, in the camera's axes), and the median angle to it in degrees.

    reason: too_few_front_images (fewer than two), inconsistent_up, up_spread_too_large (over 20 degrees); null: align by it."""
    r = expr.rotation([F.col(q)[k] for k in range(4)])
    g = [F.col(gravity)[k].cast("double") for k in range(3)]
    up = [expr.dot([row[k] for row in r], g) for k in range(3)]
    u = images.select(by, *(c.alias(f"u{k}") for k, c in enumerate(up)))
    n = F.sqrt(F.col("u0") * F.col("u0") + F.col("u1") * F.col("u1") + F.col("u2") * F.col("u2"))
    u = u.withColumn("n", n).where("n > 1e-9").select(by, *((F.col(f"u{k}") / F.col("n")).alias(f"u{k}") for k in range(3)))
    mean = u.groupBy(by).agg(F.count(F.lit(1)).alias("images"), *(F.avg(f"u{k}").alias(f"m{k}") for k in range(3)))
    size = F.sqrt(F.col("m0") * F.col("m0") + F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2"))
    mean = mean.withColumn("size", size)
    cosine = (F.col("u0") * F.col("m0") + F.col("u1") * F.col("m1") + F.col("u2") * F.col("m2")) / F.col("size")
    apart = u.join(mean.where("size >= 1e-6"), by).groupBy(by).agg(quantile(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), 0.5).alias("spread"))
    reason = F.when(F.col("images") < 2, "too_few_front_images").when(F.col("size") < 1e-6, "inconsistent_up").when(F.col("spread") > 20, "up_spread_too_large")
    return mean.join(apart, by, "left").select(by, "images", F.when(F.col("size") >= 1e-6, F.array(*(F.col(f"m{k}") / F.col("size") for k in range(3)))).alias("up"), "spread", reason.alias("reason"))


def mountings() -> list[np.ndarray]:
    """The 24 right-handed ways to name a sensor's axes."""
    all_ = (np.eye(3)[list(p)] * np.array(s)[:, None] for p in permutations(range(3)) for s in product((-1.0, 1.0), repeat=3))
    return [m for m in all_ if np.linalg.det(m) > 0]


def consensus(ups: np.ndarray) -> dict:
    """The mean of unit vectors (n by 3) without those far from it: up, spread (median angle), p90, inliers, score."""
    inside = np.ones(len(ups), bool)

    def angles(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up = ups[chosen].mean(0)
        up /= np.linalg.norm(up)
        return up, np.degrees(np.arccos(np.clip(ups @ up, -1, 1)))

    for _ in range(10):
        _, a = angles(inside)
        middle = np.median(a)
        new = a <= max(8.0, middle + 2.5 * np.median(np.abs(a - middle)))
        if (new == inside).all() or new.sum() < 4:
            break
        inside = new
    up, a = angles(inside)
    spread, p90 = float(np.median(a[inside])), float(np.percentile(a[inside], 90))
    return {"up": up, "spread": spread, "p90": p90, "inliers": int(inside.sum()), "score": spread + p90 / 10 + 10 * (1 - inside.mean())}


def timed_gravity(frames: DataFrame, samples: DataFrame, by: str, low: float = -0.5, high: float = 0.5, step: float = 0.02, window: float = 0.025) -> DataFrame:
    """Per recording the offset between video and IMU, the IMU's mounting and the up direction that agree best: by, frames, offset, mounting (nine numbers), up, spread, p90, inliers, score, reason.

    frames: by, t (seconds), q; samples: by, t, acceleration (array). At each offset of a grid a frame has the componentwise median of the samples within `window` of its time; every mounting
    is tried at every offset; then offsets a quarter as far apart around the best. Samples meet offsets and frames in buckets of time, so no frame sees more than its window.
    reason: too_few_timed_front_images, imu_time_range_mismatch, too_few_gravity_inliers (under 60 %, at least four), gravity_residual_too_large (spread over 10 or p90 over 20 degrees); null: align by it."""
    named = stored(frames.select(by, F.monotonically_increasing_id().alias("frame"), "t", "q"), "frames")
    counts = named.groupBy(by).agg(F.count(F.lit(1)).alias("frames"))
    count = int(round((high - low) / step)) + 1
    coarse = named.join(counts.where("frames >= 4").select(by), by).withColumn("offset", F.explode(F.array(*(F.lit(low + k * step) for k in range(count)))))
    first = _best_offsets(coarse, samples, counts, by, window)
    near = named.join(first.select(by, F.col("offset").alias("__at")), by).withColumn("offset", F.explode(F.array(*(F.col("__at") + (k - 4) * step / 4 for k in range(9))))).drop("__at")
    best = _best_offsets(near, samples, counts, by, window)
    chosen = best.unionByName(first.join(best.select(by), by, "left_anti"))
    needed = F.greatest(F.lit(4), F.bround(F.col("frames") * 0.6))
    reason = F.when(F.col("frames") < 4, "too_few_timed_front_images").when(F.col("score").isNull(), "imu_time_range_mismatch").when(F.col("inliers") < needed, "too_few_gravity_inliers").when((F.col("spread") > 10) | (F.col("p90") > 20), "gravity_residual_too_large")
    return counts.join(chosen, by, "left").withColumn("reason", reason)


def _best_offsets(tried: DataFrame, samples: DataFrame, counts: DataFrame, by: str, window: float) -> DataFrame:
    """tried: by, frame, t, q, offset. Of each recording the offset and mounting of least score."""
    width = 2 * window
    bucket = lambda c: F.floor(c / width).cast("long")
    at = F.col("t") + F.col("offset")
    wide = tried.withColumn("at", at).withColumn("cell", F.explode(F.array(bucket(at - window), bucket(at + window)))).dropDuplicates([by, "frame", "offset", "cell"])
    s = samples.select(by, F.col("t").alias("s_t"), "acceleration", bucket(F.col("t")).alias("cell"))
    met = wide.join(s, [by, "cell"]).where((F.col("s_t") >= F.col("at") - window) & (F.col("s_t") <= F.col("at") + window))
    g = met.groupBy(by, "offset", "frame").agg(F.first("q").alias("q"), *(quantile(F.col("acceleration")[k], 0.5).alias(f"g{k}") for k in range(3)))
    g = g.join(counts, by)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names = [by, "offset", "mounting", "up", "spread", "p90", "inliers", "score"]
        a = group[["g0", "g1", "g2"]].to_numpy(float)
        size = np.linalg.norm(a, axis=1)
        group, a = group[size > 1e-9], a[size > 1e-9] / size[size > 1e-9, None]
        if len(group) < 4:
            return pd.DataFrame(columns=names)
        w, x, y, z = (np.stack(group["q"]).astype(float) / np.linalg.norm(np.stack(group["q"]).astype(float), axis=1)[:, None]).T
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        found = [(consensus(np.einsum("ijn,nj->ni", turn.transpose(1, 0, 2), a @ m.T)), m) for m in mountings()]
        c, m = min(found, key=lambda f: f[0]["score"])
        missing = 1 - len(group) / group["frames"].iloc[0]
        return pd.DataFrame([(key[0], key[1], m.ravel(), c["up"], c["spread"], c["p90"], c["inliers"], c["score"] + 10 * missing)], columns=names)

    kind = tried.schema[by].dataType.simpleString()
    each = g.groupBy(by, "offset").applyInPandas(run, f"{by} {kind}, offset double, mounting array<double>, up array<double>, spread double, p90 double, inliers int, score double")
    row = F.struct("offset", "mounting", "up", "spread", "p90", "inliers", "score")
    return each.groupBy(by).agg(F.min_by(row, F.struct("score", "offset")).alias("__b")).select(by, "__b.*")


# --- a scene's main direction ---------------------------------------------------------------


def yaw_rotation(yaw: Column) -> list[list[Column]]:
    c, s, zero, one = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    return [[c, zero, s], [zero, one, zero], [-s, zero, c]]


def turned_apart(a: Column, b: Column) -> Column:
    """The angle between two directions of lines, up to a right angle."""
    half = float(np.pi) / 2
    return F.abs(F.pmod(a - b + half, F.lit(float(np.pi))) - half)


def exact_alignment(source: np.ndarray, target: np.ndarray, atol: float = 1e-7) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift that take source centres (n by 3) to target ones; an error where they are on a line, fewer than three, or do not fall on each other."""
    from fieldloom.operators.geometry import similarity_fit

    fit = similarity_fit(source, target)
    if fit is None:
        raise ValueError("alignment needs three centres that are not on a line")
    scale, r, t = fit
    if not np.allclose(scale * source @ r.T + t, target, atol=atol, rtol=0):
        raise ValueError("the models do not share the trajectory")
    return fit


def _context(log: str, order: str, line: str) -> Column:
    """What the last registration (phase local, with its image and count) or global refinement of the log said, up to this line; before any it is initialization."""
    w = Window.partitionBy(log).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hit = lambda k: F.nullif(F.regexp_extract(line, r"Registering image #(\d+) \(num_reg_frames=(\d+)\)", k), F.lit("")).cast("int")
    none = F.lit(None).cast("int")
    phase = lambda name, image=none, frames=none: F.struct(F.lit(name).alias("phase"), image.alias("image_id"), frames.alias("registered_frames"))
    said = F.when(hit(1).isNotNull(), phase("local", hit(1), hit(2))).when(F.contains(line, F.lit("Global bundle adjustment")), phase("global"))
    return F.coalesce(F.last(said, ignorenulls=True).over(w), phase("initialization"))


def terminated_adjustments(lines: DataFrame, log: str, order: str, line: str) -> DataFrame:
    """log, order, phase, image_id, registered_frames, message: bundle adjustments that ended in failure, with the context they ended in (see solver_failures)."""
    ended = lines.withColumn("__c", _context(log, order, line)).where(F.contains(line, F.lit("Bundle adjustment failed:")))
    return ended.select(log, order, "__c.*", F.trim(F.col(line)).alias("message"))


def solver_failures(lines: DataFrame, log: str, order: str, line: str) -> DataFrame:
    """log, run, phase, image_id, registered_frames, failed_steps: linear-solver failures of each log in runs of one context.

    The context is what the last registration (phase local, with its image and count) or global refinement said; before any it is initialization. A failure of the same context
    as the one before joins its run."""
    w = Window.partitionBy(log).orderBy(order)
    failed = lines.withColumn("__c", _context(log, order, line)).where(F.contains(line, F.lit("Linear solver failure"))).select(log, order, "__c")
    new = (~F.col("__c").eqNullSafe(F.lag("__c").over(w))).cast("int")
    runs = failed.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(log, "run").agg(F.first("__c").alias("__c"), F.count(F.lit(1)).alias("failed_steps")).select(log, F.col("run").cast("int").alias("run"), "__c.*", "failed_steps")
