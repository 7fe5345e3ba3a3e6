"""Robust statistics per group. Percentiles are exact and interpolate linearly.

`percentile` keeps a count per distinct value and group, merged before the shuffle; groups of a
source or trajectory are its use. Results of empty groups are null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def quantile(x: Column | str, f: float) -> Column:
    return F.percentile(x, F.lit(f))


def few_quantiles(df: DataFrame, by: list[str], value: str, fractions: tuple[float, ...], parts: int = 1 << 16) -> DataFrame:
    """Per group n and q, the exact interpolated percentiles of the finite values, as `percentile` gives them; for few groups (their ranges go to the driver) of any size.

    Each wanted rank is enclosed in ever narrower ranges by counting: a range's rows fall into slots, counts merged before the shuffle, and the slot with the rank is the next range,
    cut to the least and largest value in it, until these are one. No task holds a group's values. df is read once for each round (some six for doubles), so store it first."""
    rows = df.where(finite(F.col(value))).select(*(F.col(c).alias(f"b{k}") for k, c in enumerate(by)), F.col(value).cast("double").alias("v"))
    if not by:
        rows = rows.withColumn("b0", F.lit(0))
    keys = [c for c in rows.columns if c != "v"]
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    open_, done = [], {}  # of each group and rank: how many are before it within low and high
    for g, r in enumerate(stats):
        for rank in sorted({f(round((r["n"] - 1) * q, 9)) for q in fractions for f in (math.floor, math.ceil)}):
            open_.append((g, rank, rank, r["low"], r["high"]))
    spark, kinds = df.sparkSession, dict(rows.dtypes)
    while True:
        done |= {(g, rank): low for g, rank, _, low, high in open_ if low == high}
        open_ = [x for x in open_ if x[3] < x[4]]
        if not open_:
            break
        slots = max(2, parts // len(open_))
        asked = [(*(stats[g][k] for k in keys), i, low, high, max(high / slots - low / slots, math.ulp(max(abs(low), abs(high))))) for i, (g, _, _, low, high) in enumerate(open_)]
        ranges = spark.createDataFrame(asked, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "i int, low double, high double, width double"]))
        same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(ranges[k]) for k in keys), F.col("v").between(F.col("low"), F.col("high")))
        slot = F.least(F.floor(F.col("v") / F.col("width") - F.col("low") / F.col("width")), F.lit(slots - 1))
        met = rows.join(F.broadcast(ranges), same)  # a row for each open rank: groups are few
        counted = met.groupBy("i", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        left, narrowed = [x[2] for x in open_], {}
        for r in sorted(counted, key=lambda r: (r["i"], r["slot"])):
            if r["i"] in narrowed:
                continue
            if left[r["i"]] < r["n"]:
                narrowed[r["i"]] = (*open_[r["i"]][:2], left[r["i"]], r["low"], r["high"])
            else:
                left[r["i"]] -= r["n"]
        open_ = [narrowed[i] for i in range(len(open_))]
    out = []
    for g, r in enumerate(stats):
        at = [round((r["n"] - 1) * q, 9) for q in fractions]
        ends = [(done[g, math.floor(a)], done[g, math.ceil(a)], a - math.floor(a)) for a in at]
        out.append((*(r[k] for k in keys[: len(by)]), r["n"], [low if low == high else low * (1 - t) + high * t for low, high, t in ends]))
    return spark.createDataFrame(out, ", ".join([*(f"`{c}` {kinds[k]}" for c, k in zip(by, keys[: len(by)], strict=True)), "n long", "q array<double>"]))


def with_mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group n, median, mad (median absolute deviation), p95."""
    middle = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), quantile(value, 0.5).alias("median"), quantile(value, 0.95).alias("p95"))
    apart = df.join(middle.select(*by, "median"), by).groupBy(*by).agg(quantile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    return middle.join(apart, by)


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: rows, rows that are not finite, and of the finite ones p50, p90, p95, p99, max."""
    x = F.when(finite(F.col(value)), F.col(value))
    q = F.percentile(x, F.array(*(F.lit(f) for f in (0.5, 0.9, 0.95, 0.99))))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("n_not_finite"), q.alias("q"), F.max(x).alias("largest"))
    return out.select(*by, "n", "n_not_finite", *(F.col("q")[k].alias(name) for k, name in enumerate(("p50", "p90", "p95", "p99"))), "largest")


def few_distributions(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """As `distribution`, for few groups of any size, or one (by=[])."""
    x = F.when(finite(F.col(value)), F.col(value))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("n_not_finite"), F.max(x).alias("largest"))
    q = few_quantiles(df, by, value, (0.5, 0.9, 0.95, 0.99)).select(*(F.col(c).alias(f"__{c}") for c in by), "q")
    if by:
        both = counts.join(F.broadcast(q), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)), "left")  # a row a group
    else:
        found = [r["q"] for r in q.collect()]  # one row, or none
        both = counts.withColumn("q", F.array(*map(F.lit, found[0])) if found else F.lit(None).cast("array<double>"))
    return both.select(*by, "n", "n_not_finite", *(F.col("q")[k].alias(name) for k, name in enumerate(("p50", "p90", "p95", "p99"))), "largest")


def stereo_observability(observations: DataFrame, by: list[str], point: str, capture: str, sensor: str) -> DataFrame:
    """Per group the points that two sensors of one capture see, and the captures with such points: stereo_points, stereo_captures."""
    seen = observations.groupBy(*by, point, capture).agg(F.count_distinct(sensor).alias("__sensors")).where("__sensors >= 2")
    return seen.groupBy(*by).agg(F.count_distinct(point).alias("stereo_points"), F.count_distinct(capture).alias("stereo_captures"))


def metric_scale(ratios: DataFrame, by: list[str], ratio: str, stereo: DataFrame, least: int = 8, least_points: int = 8, most_mad: float = 0.02) -> DataFrame:
    """Scale from ratios of measured to known baselines: the inverse of the median of those near the median.

    stereo: by, stereo_points, stereo_captures (see stereo_observability). reason: why there is no scale, the first of too few
    baselines, too little seen by two sensors of a capture, and ratios apart; null where there is one.
    Fixed values: inliers within max(5 MAD, 0.5 % of the median); applied where the scale differs from 1 by more than 1e-9."""
    s = with_mad(ratios, by, ratio)
    near = ratios.join(s, by).where(F.abs(F.col(ratio) - F.col("median")) <= F.greatest(5 * F.col("mad"), 0.005 * F.col("median")))
    inner = near.groupBy(*by).agg(F.count(F.lit(1)).alias("inliers"), (1 / quantile(ratio, 0.5)).alias("found"))
    both = s.join(inner, by, "left").join(stereo, by, "left").fillna(0, ["inliers", "stereo_points", "stereo_captures"])
    reason = (
        F.when(F.col("n") < least, "too_few_registered_rig_baselines")
        .when((F.col("stereo_points") < least_points) | (F.col("stereo_captures") < least), "rig_baseline_not_observable")
        .when((F.col("inliers") < least) | (F.col("mad") > most_mad * F.col("median")), "inconsistent_rig_baseline_scale")
    )
    out = both.withColumn("reason", reason).withColumn("metric", F.col("reason").isNull()).withColumn("scale", F.when(F.col("metric"), F.col("found")))
    applied = F.coalesce(F.abs(F.col("scale") - 1) > 1e-9, F.lit(False)).alias("applied")
    return out.select(*by, "n", "median", "mad", "inliers", "stereo_points", "stereo_captures", "scale", "metric", applied, "reason")


def dominant_offset(pairs: DataFrame, by: list[str], offset: str, weight: str, order: str) -> DataFrame:
    """The weighted mode of time offsets per group: n, total, support, second, accepted, centre (null unless accepted).

    Offsets fall into bins of one second. The best bin has the most weight of its own (the one seen
    first wins ties, by `order`); its support is the weight within two bins. It is accepted with at least 20
    pairs, 20 % of all weight, and 1.25 times the support of any bin more than two away. The centre is the weighted median of what is near it.
    Bins are few per group; pairs are summed into them before any window."""
    rows = pairs.where(F.col(offset).isNotNull()).withColumn("w", F.greatest(F.lit(1), F.coalesce(F.col(weight), F.lit(1))).cast("double")).withColumn("bin", F.floor(F.col(offset)))
    bins = rows.groupBy(*by, "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    near = Window.partitionBy(*by).orderBy("bin").rangeBetween(-2, 2)
    group = Window.partitionBy(*by)
    bins = bins.withColumn("support", F.sum("w").over(near)).withColumn("total", F.sum("w").over(group)).withColumn("pairs", F.sum("n").over(group))
    best = bins.withColumn("place", F.row_number().over(group.orderBy(F.desc("w"), "seen"))).withColumn("best", F.first(F.when(F.col("place") == 1, F.col("bin")), ignorenulls=True).over(group))
    s = best.groupBy(*by).agg(
        F.max("pairs").alias("n"), F.max("total").alias("total"), F.max("best").alias("best"), F.max(F.when(F.col("place") == 1, F.col("support"))).alias("support"),
        F.coalesce(F.max(F.when(F.abs(F.col("bin") - F.col("best")) > 2, F.col("support"))), F.lit(0.0)).alias("second"),
    )
    s = s.withColumn("accepted", (F.col("n") >= 20) & (F.col("support") >= 0.2 * F.col("total")) & (F.col("support") >= 1.25 * F.col("second")))
    cluster = rows.join(s, by).where(F.abs(F.col("bin") - F.col("best")) <= 2).groupBy(*by, offset, "support").agg(F.sum("w").alias("w"))
    running = F.sum("w").over(Window.partitionBy(*by).orderBy(offset).rowsBetween(Window.unboundedPreceding, 0))
    centre = cluster.withColumn("running", running).where(F.col("running") >= F.col("support") / 2).groupBy(*by).agg(F.min(offset).alias("centre"))
    return s.join(centre, by).select(*by, "n", "total", "support", "second", "accepted", F.when(F.col("accepted"), F.col("centre")).alias("centre"))


def trajectory_steps(rows: DataFrame, source: str, capture: str, position: list[str]) -> DataFrame:
    """Steps between consecutive captures of a source: source, capture (the later one), step. Others have none."""
    w = Window.partitionBy(source).orderBy(capture)
    before = [F.lag(p).over(w) for p in position]
    step = F.sqrt(sum(((F.col(p) - b) * (F.col(p) - b) for p, b in zip(position, before, strict=True)), F.lit(0.0)))
    return rows.withColumn("step", F.when(F.col(capture) == F.lag(capture).over(w) + 1, step)).where("step IS NOT NULL").select(source, capture, "step")


def trajectory_gate(steps: DataFrame, source: str, ratio: float = 10.0, baseline: str = "median", digits: int = 9) -> DataFrame:
    """Per source the step statistics, the jump threshold and the number of steps beyond it.

    Threshold: ratio times the 95th percentile; or the larger of ratio times the median and the median
    plus six MAD; at least 1e-9. It is rounded to `digits` before it is compared, so that equal steps stay equal."""
    s = with_mad(steps, [source], "step")
    high = ratio * F.col("p95") if baseline == "p95" else F.greatest(ratio * F.col("median"), F.col("median") + 6 * F.col("mad"))
    s = s.withColumn("threshold", F.round(F.greatest(high, F.lit(1e-9)), digits))
    over = steps.join(s.select(source, "threshold"), source).groupBy(source).agg(F.count_if(F.col("step") > F.col("threshold")).alias("jumps"), F.max("step").alias("largest"))
    return s.join(over, source).withColumn("passed", F.col("jumps") == 0)


def rank_threshold(df: DataFrame, by: list[str], value: str, share: float = 0.2, step: int = 5, most: int = 2000) -> DataFrame:
    """Sharpness threshold: the value at rank floor((n - 1) * share), floored to a multiple of `step`, within 0 and `most`. Not interpolated."""
    rows = df.where(finite(F.col(value)))
    w = Window.partitionBy(*by)
    at = rows.withColumn("rank", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(w))
    found = at.where(F.col("rank") == F.floor((F.col("n") - 1) * share) + 1)
    return found.select(*by, F.greatest(F.lit(0), F.least(F.lit(most), (F.floor(F.col(value) / step) * step))).cast("long").alias("threshold"))
