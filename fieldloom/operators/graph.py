"""Match graphs, tracks and observations: joins of pairs with images, filters, votes, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.expr import dot, pair_high, pair_low
from fieldloom.operators.robust import distribution
from fieldloom.operators.work import dealt


def with_endpoints(pairs: DataFrame, images: DataFrame, columns: list[str], pair: str = "pair_id", ident: str = "image_id") -> DataFrame:
    """Pairs with <column>_a, <column>_b of both images. Pairs of unknown images drop out."""
    side = lambda s: images.select(F.col(ident).alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    ids = pairs.withColumn("id_a", pair_low(pair)).withColumn("id_b", pair_high(pair))
    return ids.join(side("a"), "id_a").join(side("b"), "id_b")


def strict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join in which every left row must find exactly one right row; raises an error at run time otherwise."""
    counted = right.withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy(key)))
    joined = left.join(counted, key, "left")
    wrong = F.concat(F.lit(f"no single match for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(F.coalesce(F.col("__times"), F.lit(0)) == 1, True).otherwise(F.raise_error(wrong).cast("boolean"))
    return joined.where(checked).drop("__times")


def match_summary(pairs: DataFrame, threshold: int, rows: str = "inliers", by: list[str] | None = None) -> DataFrame:
    """Pairs tried, and of those with matches: number, least, mean, most, sum, at and below the threshold."""
    good = F.when(F.col(rows) > 0, F.col(rows))
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("raw_pairs"), F.count(good).alias("verified"), F.min(good).alias("least"), F.round(F.avg(good), 6).alias("mean"), F.max(good).alias("most"),
        F.coalesce(F.sum(good), F.lit(0)).alias("matches"), F.count_if(good >= threshold).alias("at_threshold"), F.count_if(good < threshold).alias("below_threshold"),
    )


def impossible_pairs(ends: DataFrame) -> DataFrame:
    """Pairs of one capture whose fields of view cannot meet: the axes are further apart than both half angles together.

    ends: source_a/b, capture_a/b, axis_a/b (arrays of three), theta_a/b. Unknown axes or angles decide nothing."""
    a, b = ([F.col(f"axis_{s}")[k] for k in range(3)] for s in "ab")
    same = (F.col("source_a") == F.col("source_b")) & (F.col("capture_a") == F.col("capture_b"))
    cosine = F.greatest(F.least(dot(a, b), F.lit(1.0)), F.lit(-1.0))
    return ends.where(F.coalesce(same & (F.acos(cosine) > F.col("theta_a") + F.col("theta_b")), F.lit(False)))


def holdout_classes(ends: DataFrame, held: DataFrame, name: str, distance: str, least: float, source: str = "source") -> DataFrame:
    """Each pair's class: validation (touches a held-out image), short_baseline (same source, too near), retained."""
    h = held.select(F.col(name).alias("__held")).distinct()
    touched = ends.join(h.withColumnRenamed("__held", f"{name}_a").withColumn("__va", F.lit(True)), f"{name}_a", "left").join(h.withColumnRenamed("__held", f"{name}_b").withColumn("__vb", F.lit(True)), f"{name}_b", "left")
    near = (F.col(f"{source}_a") == F.col(f"{source}_b")) & (F.col(distance) < least)
    return touched.withColumn("class", F.when(F.col("__va") | F.col("__vb"), "validation").when(near, "short_baseline").otherwise("retained")).drop("__va", "__vb")


def support(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Per image the pairs and matches that touch it."""
    return pairs.select(F.explode(F.array(a, b)).alias("image"), weight).groupBy("image").agg(F.count(F.lit(1)).alias("pairs"), F.sum(weight).alias("matches"))


def without(pairs: DataFrame, removed: DataFrame, key: str = "pair_id") -> DataFrame:
    """The pairs less the removed ones; apply it to tried and to verified pairs alike."""
    return pairs.join(removed.select(key).distinct(), key, "left_anti")


def capture_pairs(images: DataFrame, capture: list[str], ident: str, rows: int = 16384, pairs: float = 5e6) -> DataFrame:
    """All pairs a < b of images of one capture (a capture has a few sensors).

    The images of a large capture are dealt into blocks of about `rows`, and every two blocks meet once. Blocks move as lists and become rows again in the task that joins them, so that n images of a capture
    move n * n / rows numbers, not as many rows. There is a partition for so many pairs or 250,000 images, up to 4,000."""
    known = images.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in capture))).select(*capture, F.col(ident).alias("__id"))
    sizes = known.groupBy(*capture).agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.where(F.col("__n") > rows).select(*capture, F.ceil(F.col("__n") / rows).cast("int").alias("__blocks"))  # one in `rows` images has a row here at most
    work = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__n") / pairs + F.col("__n") / 250_000)).first()[0] or 0
    tasks = min(4000, max(1, int(work)))
    blocks = F.coalesce("__blocks", F.lit(1))
    placed = known.join(F.broadcast(large), capture, "left").select(*capture, blocks.alias("__blocks"), F.pmod(F.xxhash64("__id"), blocks).cast("int").alias("__block"), "__id")
    lists = placed.groupBy(*capture, "__blocks", "__block").agg(F.collect_list("__id").alias("__ids"))
    one = lists.select(*capture, F.col("__block").alias("__i"), F.explode(F.sequence("__block", F.col("__blocks") - 1)).alias("__j"), "__ids")
    two = lists.select(*capture, F.explode(F.sequence(F.lit(0), "__block")).alias("__i"), F.col("__block").alias("__j"), "__ids")
    key = [*capture, "__i", "__j"]
    first, second = (side.repartition(tasks, *key).select(*key, F.explode("__ids").alias(name)) for side, name in ((one, "__a"), (two, "__b")))
    met = first.join(second.hint("merge"), key).where("__i < __j OR __a < __b")  # equal ids are in one block
    return met.select(*capture, F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))


def observable_points(tracks: DataFrame, point: str, capture: str, sensor: str) -> DataFrame:
    """Per point the captures in which at least two sensors see it."""
    stereo = tracks.groupBy(point, capture).agg(F.count_distinct(sensor).alias("sensors")).where("sensors >= 2")
    return stereo.groupBy(point).agg(F.count(F.lit(1)).alias("captures"))


def votes(links: DataFrame, tracks: DataFrame, query: str, anchor: str, point: str, capture: str, least: int = 2) -> DataFrame:
    """Votes of queries for points: a query's anchors are observations of points; what counts is from how many captures.

    links: query, anchor. tracks: anchor, point, capture. Points with fewer captures than `least` drop out."""
    return links.join(tracks, anchor).groupBy(query, point).agg(F.count_distinct(capture).alias("votes")).where(F.col("votes") >= least)


def mutual_best(votes_: DataFrame, query: str, point: str, n: str = "votes") -> DataFrame:
    """Assignments in which each side is the other's only best. Ties drop out on both sides."""
    q, p = Window.partitionBy(query), Window.partitionBy(point)
    sole = lambda w: (F.col(n) == F.max(n).over(w)) & (F.sum(F.lit(1)).over(w.partitionBy(*([query] if w is q else [point]), n)) == 1)
    first = votes_.withColumn("__q", sole(q)).where("__q").drop("__q")
    return first.withColumn("__p", sole(p)).where("__p").drop("__p")


def compare(base: DataFrame, other: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full join on key: state common, added or lost, with both values."""
    a, b = base.select(*key, F.col(value).alias("base")).withColumn("__in_base", F.lit(True)), other.select(*key, F.col(value).alias("other")).withColumn("__in_other", F.lit(True))
    state = F.when(F.col("__in_base").isNull(), "added").when(F.col("__in_other").isNull(), "lost").otherwise("common")
    return a.join(b, key, "full").withColumn("state", state).drop("__in_base", "__in_other")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, problem: missing (only expected) or unexpected (only actual)."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("problem", F.lit("missing")).union(a.join(e, key, "left_anti").withColumn("problem", F.lit("unexpected")))


def track_length_histogram(tracks: DataFrame, point: str) -> DataFrame:
    return tracks.groupBy(point).agg(F.count(F.lit(1)).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("points"))


def integrity(images: DataFrame, observations: DataFrame, tracks: DataFrame) -> DataFrame:
    """Violations of a model: problem, n. Tracks and observations must name each other, once, and be finite and known."""
    o = observations.where("point3d_id IS NOT NULL").select("image_id", "point2d_idx", F.col("point3d_id").alias("o_point"))
    both = o.join(tracks.select("image_id", "point2d_idx", F.col("point3d_id").alias("t_point")), ["image_id", "point2d_idx"], "full")
    odd = both.select(F.when(F.col("t_point").isNull(), "observation_without_track").when(F.col("o_point").isNull(), "track_without_observation").when(F.col("o_point") != F.col("t_point"), "other_point").alias("problem"))
    repeated = tracks.groupBy("image_id", "point2d_idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_track_element").alias("problem"))
    values = observations.where("isnan(x) OR isnan(y) OR abs(x) = double('inf') OR abs(y) = double('inf')").select(F.lit("not_finite").alias("problem"))
    orphans = observations.join(images.select("image_id"), "image_id", "left_anti").select(F.lit("unknown_image").alias("problem"))
    return odd.where("problem IS NOT NULL").union(repeated).union(values).union(orphans).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def without_images(removed: DataFrame, images: DataFrame, observations: DataFrame, tracks: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, observations, tracks after images go: tracks shrink, points seen less than `least` times go, and what observed them is null."""
    left = images.join(removed, "image_id", "left_anti")
    shorter = tracks.join(removed, "image_id", "left_anti")
    alive = shorter.groupBy("point3d_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select("point3d_id")
    return left, *retained(alive, observations.join(removed, "image_id", "left_anti"), shorter)


def retained(points: DataFrame, observations: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations and tracks with only these points; observations of others lose their point."""
    keep = points.select(F.col("point3d_id").alias("__keep")).distinct()
    o = observations.join(keep, F.col("point3d_id") == F.col("__keep"), "left").withColumn("point3d_id", F.col("__keep")).drop("__keep")
    return o, tracks.join(points.select("point3d_id").distinct(), "point3d_id", "left_semi")


def outlier_captures(edges: DataFrame) -> DataFrame:
    """The captures at fault for bad steps from a to b: of each the first if more of the distinct steps touch it than the second, and at least two; else the second."""
    steps = edges.select("a", "b").distinct()
    touched = steps.select(F.explode(F.array("a", "b")).alias("capture")).groupBy("capture").agg(F.count(F.lit(1)).alias("n"))
    of = lambda s: touched.select(F.col("capture").alias(s), F.col("n").alias(f"n_{s}"))
    ends = steps.join(of("a"), "a").join(of("b"), "b")
    return ends.select(F.when((F.col("n_a") >= 2) & (F.col("n_a") > F.col("n_b")), F.col("a")).otherwise(F.col("b")).alias("capture")).distinct()


def heldout_audit(proposals: DataFrame, query: str, capture: str, error: str, least: int = 2, within: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """One row: queries, eligible ones (seen from enough captures), and how many of these have their best error within each bound."""
    q = proposals.groupBy(query).agg(F.count_distinct(capture).alias("captures"), F.min(error).alias("best"))
    fit = F.col("captures") >= least
    return q.agg(F.count(F.lit(1)).alias("queries"), F.count_if(fit).alias("eligible"), *(F.count_if(fit & (F.col("best") <= w)).alias(f"within_{w}") for w in within))


def _supported(proposed: DataFrame, eligible: DataFrame, by: list[str], query: str, capture: str, error: str, *more: Column, least: int) -> DataFrame:
    """by, support and e: proposals of eligible queries from `least` captures and their least error. Rows are dealt by query before they are grouped, as hardly any two share a group."""
    bad = F.col(error).isNull() | F.isnan(error)
    met = dealt(proposed, query).join(eligible.select(query), query, "left_semi")
    once = met.groupBy(*by).agg(F.count_distinct(capture).alias("support"), F.min(F.when(bad, float("inf")).otherwise(F.col(error))).alias("e"), *more)
    return once.where(F.col("support") >= least)


def heldout_report(proposed: DataFrame, eligible: DataFrame, query: str, point: str, capture: str, error: str, distance: str, least: int = 2, within: tuple[int, ...] = (1, 2, 4, 8), plausible: float = 2.0) -> DataFrame:
    """One row on held-out queries, by the reference's rules.

    proposed: query, point, capture, error and distance of the point from the query's camera; error and distance are
    those of query and point, and an error without a value (a point behind the camera) counts as infinite. A proposal needs `least`
    captures. Only queries with one proposal are predicted; of the others, those with two plausible ones or more are
    contested, and their largest distance over their smallest is compared. eligible: query; ratios are of all of them."""
    supported = _supported(proposed, eligible, [query, point], query, capture, error, F.min(distance).alias("d"), least=least)
    fine = F.col("e") <= plausible
    each = supported.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e"), F.count_if(fine).alias("fine"), (F.max(F.when(fine, F.col("d"))) / F.min(F.when(fine, F.col("d")))).alias("ratio"))
    sole, contested = F.col("n") == 1, F.col("fine") >= 2
    found = each.agg(
        F.count_if(sole).alias("predicted"), F.count_if(~sole).alias("ambiguous"), F.count_if(sole & (F.col("e") == float("inf"))).alias("invalid"), *(F.count_if(sole & (F.col("e") <= w)).alias(f"within_{w}") for w in within),
        F.count_if(contested).alias("contested"), F.count_if(contested & (F.col("ratio") > 1.1)).alias("over_10pct"), F.count_if(contested & (F.col("ratio") > 1.25)).alias("over_25pct"), F.percentile(F.when(contested, F.col("ratio")), 0.5).alias("ratio_p50"), F.max(F.when(contested, F.col("ratio"))).alias("ratio_max"),
    )
    both = dealt(eligible.select(query), query).distinct().agg(F.count(query).alias("eligible")).crossJoin(found)
    share = lambda c: F.try_divide(c, F.col("eligible"))
    return both.withColumns({"unsupported_or_ambiguous": F.col("eligible") - F.col("predicted"), "coverage": share(F.col("predicted")), **{f"ratio_within_{w}": share(F.col(f"within_{w}")) for w in within}})


def heldout_errors(proposed: DataFrame, eligible: DataFrame, query: str, image: str, point: str, capture: str, error: str, least: int = 2) -> DataFrame:
    """image, query, error of the queries with one supported proposal; error is infinite where it has no value. See heldout_report."""
    supported = _supported(proposed, eligible, [image, query, point], query, capture, error, least=least)
    return supported.groupBy(image, query).agg(F.count(F.lit(1)).alias("n"), F.min("e").alias(error)).where("n = 1").drop("n")


def heldout_images(errors: DataFrame, image: str, error: str, bound: float = 2.0) -> DataFrame:
    """Per image the predictions, those within the bound, those that are not finite, and p50, p90, p95, p99 and the largest of the finite ones."""
    within = errors.groupBy(image).agg(F.count_if(F.col(error) <= bound).alias("within"))
    return distribution(errors, [image], error).withColumnRenamed("n", "predictions").join(within, image)


def capture_centres(images: DataFrame, capture: list[str], centre: list[str]) -> DataFrame:
    """The mean of the sensors' centres of each capture."""
    return images.groupBy(*capture).agg(*(F.avg(c).alias(c) for c in centre), F.count(F.lit(1)).alias("sensors"))


def anchor_support(queries: DataFrame, query: str, anchors: str, least: int = 10) -> DataFrame:
    """Anchors, and how many inliers name each; those with fewer than `least` drop out. anchors: an array per inlier."""
    return queries.select(query, F.explode(F.array_distinct(anchors)).alias("anchor")).groupBy(query, "anchor").agg(F.count(F.lit(1)).alias("inliers")).where(F.col("inliers") >= least)


def longest_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """Names with the columns of the longest prefix that begins them, or nulls. Joins by the prefixes' lengths, of which there are few."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().limit(1001).collect()]
    if len(lengths) > 1000:
        raise ValueError("too many lengths of prefixes")
    begins = names.select(name).distinct().select(name, F.explode(F.array(*(F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")).alias(prefix))
    best = begins.join(prefixes.select(prefix, *columns), prefix).groupBy(name).agg(F.max_by(F.struct(*columns), F.length(prefix)).alias("__best"))
    return names.join(best, name, "left").select(*names.columns, *(F.col(f"__best.{c}").alias(c) for c in columns))


def largest_change(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: rows in one only, and the largest absolute change of each value over rows in both."""
    x, y = a.select(key, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("in_a")), b.select(key, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("in_b"))
    both = x.join(y, key, "full")
    return both.agg(F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("unmatched"), *(F.max(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}"))).alias(v) for v in values))
