"""Time-ordered operators: as-of and band joins, steps, gaps, runs, neighbours.

As-of joins work per key and time bucket: windows run within a bucket, and only one row per
bucket is carried to the next ones, so that one key with a third of all rows is still many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sided(probe: DataFrame, build: DataFrame, key: str, t: str, payload: list[str], bucket: float) -> DataFrame:
    at = lambda df: F.floor(df[t].cast("double") / bucket).cast("long")
    one = probe.withColumn("__bucket", at(probe)).withColumn("__side", F.lit(1))
    p = F.struct(F.col(t).alias("t"), *(F.col(c) for c in payload))
    two = build.where(F.col(t).isNotNull()).select(key, t, at(build).alias("__bucket"), F.lit(0).alias("__side"), p.alias("__payload"))
    return one.unionByName(two, allowMissingColumns=True)


def asof(probe: DataFrame, build: DataFrame, key: str, t: str, payload: list[str], direction: str = "nearest", bucket: float = 86_400.0, prefix: str = "m_") -> DataFrame:
    """For each probe row the build row of its key that is nearest in time; ties take the earlier one.

    direction: nearest, backward (at or before), forward (at or after; the last one if none).
    Adds m_<t> and m_<payload>; null where the key has no build row. Build rows at equal times: the
    one with the larger payload counts before, the smaller after."""
    rows = _sided(probe, build, key, t, payload, bucket)
    inner = Window.partitionBy(key, "__bucket")
    past = inner.orderBy(t, "__side", "__payload").rowsBetween(Window.unboundedPreceding, 0)
    future = inner.orderBy(F.desc(t), F.asc("__side"), F.desc("__payload")).rowsBetween(Window.unboundedPreceding, 0)
    edges = rows.where("__side = 0").groupBy(key, "__bucket").agg(F.min("__payload").alias("__low"), F.max("__payload").alias("__high"))
    buckets = rows.select(key, "__bucket").distinct().join(edges, [key, "__bucket"], "left")
    line = Window.partitionBy(key).orderBy("__bucket")
    carried = buckets.select(
        key, "__bucket",
        F.last("__high", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__was"),
        F.first("__low", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("__next"),
    )
    found = rows.withColumn("__back", F.last("__payload", ignorenulls=True).over(past)).withColumn("__ahead", F.last("__payload", ignorenulls=True).over(future))
    found = found.where("__side = 1").join(carried, [key, "__bucket"], "left")
    back, ahead = F.coalesce("__back", "__was"), F.coalesce("__ahead", "__next")
    now = F.col(t).cast("double")
    away = lambda s: F.abs(s["t"].cast("double") - now)
    pick = {"backward": back, "forward": F.coalesce(ahead, back), "nearest": F.when(ahead.isNull() | (away(back) <= away(ahead)), back).otherwise(ahead)}[direction]
    return found.withColumn("__pick", pick).select(*probe.columns, F.col("__pick.t").alias(prefix + t), *(F.col("__pick")[c].alias(prefix + c) for c in payload))


def band_median(probe: DataFrame, build: DataFrame, key: str, t: str, values: list[str], half_width: float, probe_id: str) -> DataFrame:
    """Per probe row the componentwise median of the build rows of its key within half_width of its time, and their number.

    Both sides meet in buckets as wide as the band, so only neighbours join."""
    width = max(2 * half_width, 1e-9)
    at = lambda c: F.floor(c.cast("double") / width)
    p = probe.select(key, F.col(t).cast("double").alias("__p"), probe_id).withColumn("__bucket", F.explode(F.array(at(F.col("__p") - half_width), at(F.col("__p") + half_width)))).distinct()
    b = build.select(key, F.col(t).cast("double").alias("__b"), *values).withColumn("__bucket", at(F.col("__b")))
    near = p.join(b, [key, "__bucket"]).where(F.abs(F.col("__b") - F.col("__p")) <= half_width)
    found = near.groupBy(probe_id).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(v, F.lit(0.5)).alias(v) for v in values))
    return probe.select(probe_id, key).join(found, probe_id, "left").select(probe_id, key, F.coalesce("n", F.lit(0)).alias("n"), *values)


def max_gap(df: DataFrame, by: str, t: str) -> DataFrame:
    """Per group the largest gap between neighbours in time, 0 for a single row."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(by).orderBy(t))
    return df.withColumn("__gap", gap).groupBy(by).agg(F.coalesce(F.max("__gap"), F.lit(0)).alias("max_gap"), F.count(F.lit(1)).alias("n"))


def sequence_neighbours(df: DataFrame, by: list[str], order: str, ident: str, k: int) -> DataFrame:
    """Pairs a, b of rows at most k places apart in the order of their group."""
    w = Window.partitionBy(*by).orderBy(order, ident)
    ahead = df.select(F.col(ident).alias("a"), F.array(*(F.lead(ident, j).over(w) for j in range(1, k + 1))).alias("ahead"))
    return ahead.select("a", F.explode(F.array_compact("ahead")).alias("b"))


def missing_neighbours(df: DataFrame, by: list[str], order: str, ident: str, k: int, *tried: DataFrame) -> DataFrame:
    """Neighbour pairs that none of `tried` (a, b in any order) holds; an attempt counts whatever came of it."""
    known = None
    for t in tried:
        pairs = t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        known = pairs if known is None else known.union(pairs)
    wanted = sequence_neighbours(df, by, order, ident, k).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return wanted.join(known.distinct(), ["a", "b"], "left_anti")


def too_far_in_time(pairs: DataFrame, gap: float, source: str = "source", t: str = "t") -> Column:
    """Whether a pair (columns <source>_a, <source>_b, <t>_a, <t>_b) of one source is more than `gap` apart. Null times never are; gap 0 switches it off."""
    if gap < 0:
        raise ValueError("the gap must not be negative")
    if gap == 0:
        return F.lit(False)
    same = F.col(f"{source}_a") == F.col(f"{source}_b")
    return F.coalesce(same & (F.abs(F.col(f"{t}_a") - F.col(f"{t}_b")) > gap), F.lit(False))


def offset_filter(pairs: DataFrame, centres: DataFrame, by: list[str], offset: str, window: float) -> DataFrame:
    """Pairs whose offset lies within `window` of their group's centre; groups without an accepted centre keep all, as do null offsets."""
    joined = pairs.join(centres.select(*by, F.col("centre").alias("__centre")), by, "left")
    return joined.where(F.coalesce(F.abs(F.col(offset) - F.col("__centre")) <= window, F.lit(True))).drop("__centre")


def runs(df: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Neighbouring rows of equal state, merged: by, state, first, last, n."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(*by, "__run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def carried(df: DataFrame, by: list[str], order: str, value: str, as_: str) -> DataFrame:
    """The last value that is not null, up to each row."""
    return df.withColumn(as_, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def running_max(df: DataFrame, by: list[str], order: str, value: str, as_: str) -> DataFrame:
    """Progress that never falls."""
    return df.withColumn(as_, F.max(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def timings(packets: DataFrame, stream: str, pts: str) -> DataFrame:
    """Packets numbered from 0 by presentation time in each stream; `monotone` is false where a time repeats."""
    w = Window.partitionBy(stream).orderBy(pts)
    return packets.withColumn("idx", F.row_number().over(w) - 1).withColumn("monotone", F.coalesce(F.col(pts) > F.lag(pts).over(w), F.lit(True)))


def zipped(left: DataFrame, right: DataFrame, idx: str, pts: str) -> DataFrame:
    """Two streams side by side: rows in both, rows in one only, largest skew."""
    both = left.select(idx, F.col(pts).alias("l")).join(right.select(idx, F.col(pts).alias("r")), idx, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("paired"), F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("unpaired"), F.max(F.abs(F.col("l") - F.col("r"))).alias("max_skew"))


def quarters(df: DataFrame, by: list[str], order: str, as_: str = "quarter") -> DataFrame:
    """Four parts in order; the first ones are longer by one where they don't come out even."""
    return df.withColumn(as_, F.ntile(4).over(Window.partitionBy(*by).orderBy(order)))


def dense_index(df: DataFrame, source_order: str, source: str, within: str, as_: str = "index") -> DataFrame:
    """A running number over all sources, in the order of sources and of rows in them: numbers in a source plus the sizes of those before it."""
    sizes = df.groupBy(source_order, source).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(source_order, source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(source, "__before")
    inner = F.row_number().over(Window.partitionBy(source).orderBy(within)) - 1
    return df.join(before, source).withColumn(as_, F.col("__before") + inner).drop("__before")
