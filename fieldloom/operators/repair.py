"""Repair of a model by verified poses and tracks: poses are replaced, the tracks they touch refitted, lost tracks restored.

A model is four tables: images (image_id, source, capture, frame_id, model, params, rotation: nine numbers, translation: three),
observations (image_id, idx, x, y, point3d_id: null where it has none), points (point3d_id, xyz, rgb) and nothing else. What must hold is
found by joins and reported as rows (rule, item); `repaired` raises on the first of them and changes nothing then.
Only tracks with a changed image move: all other points and poses are taken over as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import tracks
from fieldloom.operators.spatial import numbered
from fieldloom.operators.work import likely, stored

#: How far the pose a correction was made for, and its rotation, may be off.
SAME = 1e-8


@dataclass(frozen=True)
class Model:
    images: DataFrame
    observations: DataFrame
    points: DataFrame


@dataclass(frozen=True)
class Repaired:
    """The model after it, and what became of points: point3d_id, status (refit, deleted, restored), reason, moved; unchanged ones are not listed."""

    model: Model
    changes: DataFrame


def centre(rotation: str = "rotation", translation: str = "translation") -> Column:
    """The camera's place: -R' t."""
    r, t = (lambda k: F.get(rotation, F.lit(k))), (lambda k: F.get(translation, F.lit(k)))
    return F.array(*(-(r(c) * t(0) + r(3 + c) * t(1) + r(6 + c) * t(2)) for c in range(3)))


def _finite(c: str, n: int) -> Column:
    return F.coalesce((F.size(c) == n) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _far(a: str, b: str) -> Column:
    """Whether two lists of numbers differ by more than SAME, or one is missing."""
    return F.coalesce((F.size(a) != F.size(b)) | F.exists(F.zip_with(a, b, lambda x, y: ~F.coalesce(F.abs(x - y) <= SAME, F.lit(False))), lambda v: v), F.lit(True))


def _turned(c: str) -> Column:
    """Whether nine numbers are a rotation."""
    r = [[F.get(c, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    dots = [F.abs(sum((r[k][i] * r[k][j] for k in range(3)), F.lit(0.0)) - float(i == j)) <= SAME for i in range(3) for j in range(i, 3)]
    det = r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    return F.coalesce(reduce(lambda a, b: a & b, dots) & (F.abs(det - 1) <= SAME), F.lit(False))


def _said(df: DataFrame, rule: str, item: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"))


def pose_faults(images: DataFrame, corrections: DataFrame, primary: str) -> DataFrame:
    """rule, item: what forbids corrections (image_id, old_rotation, old_translation, rotation, translation)."""
    now = images.select("image_id", "source", "frame_id", F.col("rotation").alias("now_rotation"), F.col("translation").alias("now_translation"))
    met = stored(corrections.join(now, "image_id", "left"), "corrections")  # every rule below reads it
    known = met.where("now_rotation IS NOT NULL")
    shared = images.join(known.select("frame_id").distinct(), "frame_id").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = [
        _said(corrections.groupBy("image_id").count().where("count > 1"), "duplicate pose correction", "image_id"),
        _said(met.where("now_rotation IS NULL"), "correction of an unknown image", "image_id"),
        _said(known.where(F.col("source") == primary), "a primary camera cannot be changed", "image_id"),
        _said(known.where(_far("old_rotation", "now_rotation") | _far("old_translation", "now_translation")), "the evidence belongs to another model", "image_id"),
        _said(known.where(~_finite("rotation", 9) | ~_finite("translation", 3) | ~_turned("rotation")), "invalid corrected pose", "image_id"),
        _said(known.join(shared, "frame_id"), "a pose correction needs a frame of one image", "image_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def track_faults(images: DataFrame, observations: DataFrame, entries: DataFrame, recovered: DataFrame, primary: str) -> DataFrame:
    """rule, item: what forbids recovered tracks. entries: old_id, image_id, idx; recovered: old_id, rgb."""
    named = _named(observations, entries, "image_id", "idx").select("image_id", "idx", "point3d_id", F.lit(True).alias("there"))
    met = stored(entries.join(_named(images, entries, "image_id").select("image_id", "source"), "image_id", "left").join(named, ["image_id", "idx"], "left"), "entries")  # three rules read it
    colours = F.coalesce((F.size("rgb") == 3) & F.forall("rgb", lambda v: v.isNotNull() & v.between(0, 255)), F.lit(False))
    found = [
        _said(entries.groupBy("old_id", "image_id", "idx").count().where("count > 1"), "duplicate recovered observation", "old_id"),
        _said(recovered.groupBy("old_id").count().where("count > 1"), "duplicate recovered track", "old_id"),
        _said(recovered.where(~colours), "invalid colour of a recovered point", "old_id"),
        _said(met.where(~F.col("source").eqNullSafe(primary)), "a recovered track may use primary observations only", "old_id"),
        _said(met.where("there IS NULL"), "recovered observation that does not exist", "old_id"),
        _said(met.where("point3d_id IS NOT NULL"), "recovered observation already belongs to a point", "old_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def _named(rows: DataFrame, entries: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur in entries, of which there are few: where they can be broadcast, rows are not moved."""
    return rows.join(entries.select(*keys).distinct(), [*keys], "left_semi")


def _must_be_none(faults: DataFrame) -> None:
    found = faults.limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['item']}" for r in found))


def seen_by(images: DataFrame, observations: DataFrame, *keys: str) -> DataFrame:
    """Observations (image_id, x, y and keys) with what `tracks.gathered` asks of their images; those of other images are left out."""
    views = images.select("image_id", "source", "capture", "rotation", "model", "params", centre().alias("centre"))
    return observations.select(*keys, "image_id", "x", "y").join(views, "image_id")


def repaired(model: Model, corrections: DataFrame, recovered: DataFrame, primary: str, **limits: float) -> Repaired:
    """The repaired model. recovered: old_id, rgb, track (image_id, idx); its points get new ids behind the largest, in the order of old_id.

    A touched track that is not kept loses its point. A recovered track that is not kept is an error. limits: those of tracks.refitted."""
    _must_be_none(pose_faults(model.images, corrections, primary))
    entries = stored(recovered.select("old_id", F.explode("track").alias("e")).select("old_id", "e.image_id", "e.idx"), "named")
    _must_be_none(track_faults(model.images, model.observations, entries, recovered, primary))

    new = corrections.select("image_id", F.col("rotation").alias("__r"), F.col("translation").alias("__t"))
    images = model.images.join(new, "image_id", "left").withColumns({"rotation": F.coalesce("__r", "rotation"), "translation": F.coalesce("__t", "translation")}).select(*model.images.columns)

    held = model.observations.where("point3d_id IS NOT NULL")
    touched = stored(held.join(corrections.select("image_id"), "image_id", "left_semi").select("point3d_id").distinct(), "touched")
    seen = seen_by(images, likely(held, touched, "point3d_id"), "point3d_id")  # a track passes with all its observations or with none
    old = tracks.gathered(seen, model.points).join(touched, "point3d_id", "left_semi")
    fitted = tracks.refitted(old, **limits).select("point3d_id", "reason", F.col("xyz").alias("new"))
    moved = F.sqrt(F.aggregate(F.zip_with("new", "xyz", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    status = F.when(tracks.kept(), "refit").otherwise("deleted")
    refit = stored(fitted.join(model.points.select("point3d_id", "xyz"), "point3d_id").select("point3d_id", status.alias("status"), "reason", F.when(tracks.kept(), moved).alias("moved"), F.when(tracks.kept(), F.col("new")).alias("new")), "refit")

    primary_seen = entries.join(_named(model.observations, entries, "image_id", "idx").select("image_id", "idx", "x", "y"), ["image_id", "idx"])
    lost = tracks.gathered(seen_by(_named(images, entries, "image_id"), primary_seen, "old_id"), recovered.select("old_id", F.lit(None).cast("array<double>").alias("xyz")), "old_id")
    back = stored(tracks.refitted(lost, point="old_id", **limits).select("old_id", "reason", "xyz"), "restored")
    _must_be_none(_said(back.where(~tracks.kept()), "a recovered point does not pass", "old_id"))
    last = model.points.agg(F.max("point3d_id")).first()[0] or 0
    ids = stored(numbered(back, ["old_id"]).select((F.col("__at") + last + 1).alias("point3d_id"), "old_id", "xyz", "reason"), "ids")

    kind = dict(model.points.dtypes)
    stay = model.points.join(refit.select("point3d_id", "status", "new"), "point3d_id", "left").where("status IS NULL OR status = 'refit'").withColumn("xyz", F.coalesce("new", "xyz"))
    points = stay.select("point3d_id", "xyz", "rgb").unionByName(ids.join(recovered, "old_id").select("point3d_id", "xyz", F.col("rgb").cast(kind["rgb"]).alias("rgb")))
    gone = refit.where("status = 'deleted'").select("point3d_id", F.lit(True).alias("__gone"))
    own = entries.join(ids.select("old_id", F.col("point3d_id").alias("__new")), "old_id").select("image_id", "idx", "__new")
    freed = model.observations.join(gone, "point3d_id", "left").join(own, ["image_id", "idx"], "left")
    observations = freed.withColumn("point3d_id", F.when(F.col("__gone"), None).otherwise(F.coalesce("__new", "point3d_id"))).select(*model.observations.columns)
    changes = refit.select("point3d_id", "status", "reason", "moved").unionByName(ids.select("point3d_id", F.lit("restored").alias("status"), "reason", F.lit(None).cast("double").alias("moved")))
    return Repaired(Model(images, observations, points), changes)


def report(changes: DataFrame) -> DataFrame:
    """One row: how many points were refitted, deleted and restored, and of the moved ones' displacements the least, median, 95 % and most."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return changes.agg(n("refit"), n("deleted"), n("restored"), *(F.percentile("moved", q).alias(f"moved_{name}") for name, q in (("least", 0.0), ("median", 0.5), ("p95", 0.95), ("most", 1.0))))


def reasons(changes: DataFrame) -> DataFrame:
    """How often each verdict fell on a touched track."""
    return changes.where("status <> 'restored'").groupBy("reason").agg(F.count(F.lit(1)).alias("points"))


def primary_only(model: Model, primary: str, limit: float = 2.0, **limits: float) -> Repaired:
    """The model of the primary source alone (G10): its images, its tracks placed anew, filtered and assessed.

    Frames of other sources go, and may hold no primary image. Tracks seen in fewer than three primary captures, or that triangulation does not place, go; then observations
    with an error above `limit` or behind their camera, and tracks left with fewer than two; then tracks that the full-track assessment refuses. Changes list every point as kept or deleted."""
    own = model.images.where(F.col("source") == primary)
    if own.isEmpty():
        raise ValueError("the model has no primary images")
    _must_be_none(_said(own.join(model.images.where(~F.col("source").eqNullSafe(primary)).select("frame_id"), "frame_id", "left_semi").select("frame_id").distinct(), "primary and other images share a frame", "frame_id"))
    seen = stored(seen_by(own, model.observations.where("point3d_id IS NOT NULL"), "point3d_id", "idx"), "seen")
    placed = stored(tracks.placed(tracks.gathered(seen, model.points), linear=True).where("xyz IS NOT NULL AND captures >= 3").select("point3d_id", "xyz"), "placed")
    near = stored(tracks.with_errors(seen, placed).where(F.col("error") <= limit), "near")
    left = tracks.gathered(near, placed).where(F.size("seen") >= 2)
    judged = stored(tracks.assessed(left, limit=limit, **limits).select("point3d_id", "reason"), "judged")
    good = judged.where(tracks.kept()).select("point3d_id")
    points = model.points.join(good, "point3d_id", "left_semi").drop("xyz").join(placed, "point3d_id").select("point3d_id", "xyz", "rgb")
    stays = near.join(good, "point3d_id", "left_semi").select("image_id", "idx", F.col("point3d_id").alias("__point"))
    observations = model.observations.join(own.select("image_id"), "image_id", "left_semi").join(stays, ["image_id", "idx"], "left").withColumn("point3d_id", F.col("__point")).select(*model.observations.columns)
    status = F.when(tracks.kept(), "kept").otherwise("deleted")
    changes = model.points.select("point3d_id").join(judged, "point3d_id", "left").select("point3d_id", F.coalesce(F.when(F.col("reason").isNotNull(), status), F.lit("deleted")).alias("status"), "reason", F.lit(None).cast("double").alias("moved"))
    return Repaired(Model(own, observations, points), changes)
