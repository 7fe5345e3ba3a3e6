"""Frame selection: the quality gate as columns, the ordered choices as folds over one source.

A fold runs per source in applyInPandas, as each choice depends on the one before it; a source is
one recording, so its candidates are bounded by its length.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reject_reason(sharpness: Column, exposure_ok: Column, features: Column, shutter: Column, min_sharpness: float = 0, min_features: int = 0, max_shutter: float | None = None) -> Column:
    """The first gate a frame fails: blur, exposure, few_features, rolling_shutter; null if none."""
    reason = F.when(F.lit(min_sharpness > 0) & (sharpness < min_sharpness), "blur").when(~exposure_ok, "exposure").when(F.lit(min_features > 0) & (features < min_features), "few_features")
    return reason.when(shutter > max_shutter, "rolling_shutter") if max_shutter is not None else reason


def bridgeable(exposure_ok: Column, features: Column, min_features: int = 0) -> Column:
    """Good enough to close a gap: sharpness and shutter do not matter."""
    return exposure_ok & (F.lit(min_features <= 0) | (features >= min_features))


def reason_counts(df: DataFrame, by: list[str], reason: Column) -> DataFrame:
    return df.withColumn("reason", F.coalesce(reason, F.lit("keep"))).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def exposure_ok(pixels: DataFrame, by: list[str], value: str, low: int = 8, high: int = 247, most: float = 0.25) -> DataFrame:
    """Per image the shares of pixels too dark and too bright, and whether both are small enough."""
    share = lambda c: F.avg(c.cast("double"))
    out = pixels.groupBy(*by).agg(share(F.col(value) <= low).alias("under"), share(F.col(value) >= high).alias("over"))
    return out.withColumn("exposure_ok", (F.col("under") <= most) & (F.col("over") <= most))


def sharpest(df: DataFrame, by: list[str], score: str, at: str) -> DataFrame:
    """Per group the place of the largest score, the first of equal ones."""
    return df.groupBy(*by).agg(F.max_by(at, F.struct(score, -F.col(at))).alias("best"))


def shutter_safe_pick(df: DataFrame, by: list[str], score: str, motion: str, at: str, limit: float) -> DataFrame:
    """Per group the sharpest frame whose motion is within the limit or unknown; if none, the one that moves least."""
    safe = F.col(motion).isNull() | (F.col(motion) <= limit)
    rank = F.struct(safe.cast("int"), F.when(safe, F.col(score)).otherwise(-F.col(motion)), -F.col(at))
    return df.groupBy(*by).agg(F.max_by(at, rank).alias("best"))


def neighbourhood(centre: Column, span: int, count: int, last: Column) -> Column:
    """`count` frame numbers spread over `span` around a centre, within 0 and last, sorted, each once."""
    if count <= 1:
        return F.array(F.greatest(F.lit(0), F.least(centre, last)))
    places = [F.bround(centre - span // 2 + i * span / (count - 1)).cast("int") for i in range(count)]
    return F.array_sort(F.array_distinct(F.array(*(F.greatest(F.lit(0), F.least(p, last)) for p in places))))


def interval_targets(sources: DataFrame, duration: str, interval: float, most: int) -> DataFrame:
    """One row per target time of a source, from 0 in steps of interval, before its end; the first `most` of them."""
    n = F.least(F.ceil(F.col(duration) / interval), F.lit(most)).cast("int")
    return sources.where(F.col(duration) > 0).withColumn("target", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * interval)))


def uniform_fallback(df: DataFrame, by: str, order: str, stride: int) -> DataFrame:
    """Every stride-th frame, where selection found none."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return df.withColumn("__at", at).where(F.col("__at") % stride == 0).drop("__at").withColumn("fallback", F.lit(True))


def nudged(selected: DataFrame, frames: DataFrame, by: str, at: str, motion: str, limit: float, reach: int) -> DataFrame:
    """Selected frames moved off fast motion: to the nearest safe frame within reach (of equally near ones the one that moves less), else the one that moves least (of equal ones the nearest). Frames of unknown motion move alike; where nothing near is measured, frames stay."""
    s = selected.select(by, F.col(at).alias("chosen"))
    own = frames.select(by, F.col(at).alias("chosen"), F.col(motion).alias("own"))
    near = s.withColumn(at, F.explode(F.sequence(F.col("chosen") - reach, F.col("chosen") + reach))).join(frames.select(by, at, motion), [by, at])
    away, safe = F.abs(F.col(at) - F.col("chosen")), F.col(motion) <= limit
    rank = F.struct((~safe).cast("int"), F.when(safe, away.cast("double")).otherwise(F.col(motion)), F.when(safe, F.col(motion)).otherwise(away.cast("double")), F.col(at))
    best = near.where(F.col(motion).isNotNull()).groupBy(by, "chosen").agg(F.min_by(at, rank).alias("moved"))
    out = s.join(own, [by, "chosen"], "left").join(best, [by, "chosen"], "left")
    return out.select(by, "chosen", F.when(F.col("own") <= limit, F.col("chosen")).otherwise(F.coalesce("moved", "chosen")).alias("frame"))


def spread_places(n: int, most: int) -> list[int]:
    """Which of n rows stay when at most `most` may: ends included, halves to even."""
    if n <= most:
        return list(range(n))
    if most <= 1:
        return [0][:most]
    return sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})


def moved_by(a: dict, b: dict) -> float:
    """The motion between two frames: the difference of their positions."""
    return abs(b["position"] - a["position"])


def choose_spatially(frames: list[dict], target: float, most: int, slack: float = 0.7, motion=moved_by) -> list[int]:
    """Places of the chosen frames of one source. frames: position, quality, valid, in time order.

    From the last chosen frame on, frames gather until one has moved by the target; the best of those
    that moved at least slack * target is next (the first of equal ones), and gathering begins anew behind the
    frame that ended it. The last valid frame always belongs."""
    valid = [k for k, f in enumerate(frames) if f["valid"]]
    if not valid:
        return []
    chosen, waiting = [valid[0]], []
    for k in valid[1:]:
        moved = motion(frames[chosen[-1]], frames[k])
        waiting.append((k, moved))
        if moved >= target:
            chosen.append(max((w for w in waiting if w[1] >= slack * target), key=lambda w: (frames[w[0]]["quality"], -w[0]))[0])
            waiting = []
    if chosen[-1] != valid[-1]:
        chosen.append(valid[-1])
    return [chosen[k] for k in spread_places(len(chosen), most or len(chosen))]


def _bridge_of(pool: list[int], last: int, frames: list[dict], target: float, slack: float, policy: str, motion) -> int:
    """The frame of the pool that continues best from `last`; of equal ones the later."""
    quality, t = (lambda j: frames[j]["quality"]), (lambda j: frames[j]["t"])
    if policy == "quality":
        return max(pool, key=lambda j: (quality(j), t(j)))
    moved = {j: motion(frames[last], frames[j]) for j in pool}
    enough = [j for j in pool if moved[j] >= slack * target]
    if not enough:
        return max(pool, key=lambda j: (moved[j], quality(j), t(j)))
    useful = [j for j in enough if moved[j] <= max(slack, 1.5) * target]
    if policy == "balanced" and useful:
        return max(useful, key=lambda j: (quality(j), t(j)))
    return min(enough, key=lambda j: (abs(moved[j] - target), -quality(j), -t(j)))


def bridge(frames: list[dict], chosen: list[int], max_gap: float, most: int, policy: str = "quality", target: float = 0.0, slack: float = 0.7, motion=moved_by) -> tuple[list[int], int]:
    """Adds frames until no gap exceeds max_gap seconds (0: none is added). Gives all places, and the gaps left open for want of frames or room.

    A bridge comes from (previous, previous + max_gap], from its later half if there is one. By policy: quality takes the
    best; parallax, of those that moved by slack * target, the one nearest the target; balanced the best of those that moved
    by no more than 1.5 targets, else as parallax. Where none moved enough, both take the one that moved most. most = 0: no limit."""
    gap, out, open_ = int(max_gap * 1e6), [], 0
    if max_gap <= 0 or len(chosen) < 2:
        return list(chosen), 0
    room = max(0, most - len(chosen)) if most else len(frames)
    for k in chosen:
        while out and frames[k]["t"] - frames[out[-1]]["t"] > gap:
            last = out[-1]
            pool = [j for j in range(last + 1, k) if frames[j]["bridgeable"] and frames[last]["t"] < frames[j]["t"] <= frames[last]["t"] + gap]
            if not pool or room <= 0:
                open_ += 1
                break
            late = [j for j in pool if frames[j]["t"] >= frames[last]["t"] + gap // 2]
            out.append(_bridge_of(late or pool, last, frames, target, slack, policy, motion))
            room -= 1
        out.append(k)
    return out, open_


def spatial_selection(candidates: DataFrame, by: str, target: float, most: int, max_gap: float, policy: str = "quality", motion=moved_by) -> DataFrame:
    """by, frame, bridge (added to close a gap), open_gaps. candidates: by, frame, t (microseconds), position, quality, valid, bridgeable.

    motion: of two frames (their columns as dicts), how far apart they are; position may be whatever it takes. most = 0: no limit."""
    columns = ["frame", "t", "position", "quality", "valid", "bridgeable"]

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "frame"])
        frames = group[columns].to_dict("records")
        chosen = choose_spatially(frames, target, most, motion=motion)
        places, left = bridge(frames, chosen, max_gap, most, policy, target, motion=motion)
        first = set(chosen)
        return pd.DataFrame({by: [key[0]] * len(places), "frame": [frames[k]["frame"] for k in places], "bridge": [k not in first for k in places], "open_gaps": left})

    kind = candidates.schema[by].dataType.simpleString()
    return candidates.select(by, *columns).groupBy(by).applyInPandas(fold, f"{by} {kind}, frame long, bridge boolean, open_gaps int")


def arithmetic_runs(numbers: list[int], least: int = 3) -> list[tuple[int, int, int]]:
    """A sorted list as runs (first, last, step); what is shorter than `least` stands alone with step 0."""
    out, k = [], 0
    while k < len(numbers):
        end = k + 1
        step = numbers[end] - numbers[k] if end < len(numbers) else 0
        while end + 1 < len(numbers) and numbers[end + 1] - numbers[end] == step:
            end += 1
        if end < len(numbers) and end - k + 1 >= least:
            out.append((numbers[k], numbers[end], step))
            k = end + 1
        else:
            out.append((numbers[k], numbers[k], 0))
            k += 1
    return out


def halved(parts: list[str], most: int = 3000) -> list[list[str]]:
    """A list cut in halves until each, joined, has at most `most` characters."""
    if len(parts) <= 1 or sum(map(len, parts)) + len(parts) - 1 <= most:
        return [parts]
    middle = math.ceil(len(parts) / 2)
    return halved(parts[:middle], most) + halved(parts[middle:], most)


def conflict_free(candidates: DataFrame, taken: DataFrame, ident: str, image: str, idx: str) -> DataFrame:
    """Candidates none of whose observations is taken, by the base or by an accepted candidate of smaller id.

    Rounds: in each, a candidate is accepted that leads all its observations, and what it touches is out."""
    from fieldloom.operators.work import stored

    key = [image, idx]
    touched = candidates.join(taken.select(*key).distinct(), key, "left_semi").select(ident).distinct()
    rest = stored(candidates.join(touched, ident, "left_anti").select(ident, *key), "candidates")
    accepted = None
    while not rest.isEmpty():
        first = rest.groupBy(*key).agg(F.min(ident).alias("__first"))
        lead = stored(rest.join(first, key).groupBy(ident).agg(F.bool_and(F.col("__first") == F.col(ident)).alias("leads")).where("leads").select(ident), "leading")
        accepted = lead if accepted is None else accepted.union(lead)
        used = rest.join(lead, ident, "left_semi").select(*key).distinct()
        out = rest.join(used, key, "left_semi").select(ident).distinct()
        rest = stored(rest.join(out, ident, "left_anti"), "candidates")
    return accepted if accepted is not None else candidates.select(ident).limit(0)
