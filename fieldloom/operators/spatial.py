"""Spatial operators: voxels, grids, nearest neighbours by hashing, profiles, thinning, quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.robust import finite, quantile
from fieldloom.operators.work import stored


def voxel_best(points: DataFrame, xyz: list[str], size: float, error: str, order: str) -> DataFrame:
    """Per voxel the row with the least error; of equal ones the first in order."""
    keys = [F.floor(F.col(c) / size).alias(f"v{k}") for k, c in enumerate(xyz)]
    row = F.struct(*points.columns)
    best = points.select(*keys, F.struct(error, order).alias("rank"), row.alias("row")).groupBy(*(f"v{k}" for k in range(len(xyz)))).agg(F.min_by("row", "rank").alias("row"))
    return best.select("row.*")


def _finite_rows(df: DataFrame, xyz: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (finite(F.col(c)) for c in xyz))


def _met(left: DataFrame, right: DataFrame, xy: list[str], radius: float, left_id: str, right_id: str) -> DataFrame:
    """left_id, match, distance of the left rows with a right row within the radius.

    Rows meet in square cells as wide as the radius: right rows go to their own, left rows to all around it."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    names = [f"c{k}" for k in range(len(xy))]
    r = right.select(*(cell(c).alias(n) for c, n in zip(xy, names, strict=True)), F.col(right_id).alias("match"), *(F.col(c).alias(f"r{k}") for k, c in enumerate(xy)))
    l = left.select(F.col(left_id), *(F.col(c).alias(f"l{k}") for k, c in enumerate(xy)), *(F.sequence(cell(c) - 1, cell(c) + 1).alias(n) for c, n in zip(xy, names, strict=True)))  # noqa: E741
    for n in names:
        l = l.withColumn(n, F.explode(n))  # noqa: E741
    d = F.sqrt(reduce(lambda a, b: a + b, ((F.col(f"l{k}") - F.col(f"r{k}")) * (F.col(f"l{k}") - F.col(f"r{k}")) for k in range(len(xy)))))
    near = l.join(r, names).withColumn("distance", d).where(F.col("distance") <= radius)
    return near.groupBy(left_id).agg(F.min(F.struct("distance", "match")).alias("b")).select(left_id, "b.match", "b.distance")


def _fine_radius(places: DataFrame, xy: list[str], radius: float, full: int) -> float:
    """The radius, quartered until the fullest cell holds at most `full` places, 12 times at most."""
    for _ in range(12):
        cells = places.groupBy(*(F.floor(F.col(c) / radius) for c in xy)).agg(F.count(F.lit(1)).alias("n"))
        if (cells.agg(F.max("n")).first()[0] or 0) <= full:
            break
        radius /= 4
    return radius


def nearest_within(left: DataFrame, right: DataFrame, xy: list[str], radius: float, left_id: str, right_id: str, full: int = 64) -> DataFrame:
    """For each left row the nearest right row within the radius, ties by smaller id: left_id, match (-1 if none), distance (infinite if none, or with a null or a number that is not finite).

    Rows at one place are searched once. The search starts with cells that hold at most `full` places (or after 12 quarterings) and grows fourfold, up to the radius, for what is left."""
    places = stored(right.where(_finite_rows(right, xy)).groupBy(*xy).agg(F.min(right_id).alias(right_id)), "places")
    asked = stored(left.where(_finite_rows(left, xy)).groupBy(*xy).agg(F.min(left_id).alias("__asked")), "asked")
    now, rest, found = _fine_radius(places, xy, radius, full), asked, None
    while True:
        got = stored(_met(rest, places, xy, now, "__asked", right_id), "nearest")
        found = got if found is None else found.unionByName(got)
        if now >= radius:
            break
        rest = stored(rest.join(got.select("__asked"), "__asked", "left_anti"), "far")
        if rest.isEmpty():
            break
        now = min(4 * now, radius)
    best = asked.join(found, "__asked").select(*xy, "match", "distance")
    return left.select(left_id, *xy).join(best, xy, "left").select(left_id, F.coalesce("match", F.lit(-1).cast("long")).alias("match"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def grid_cells(points: DataFrame, by: list[str], x: str, y: str, width: str, height: str, n: int, least: int = 1) -> DataFrame:
    """Cells of an n by n grid over each image with at least so many points: by, cell_x, cell_y, points."""
    cell = lambda v, size: F.least(F.floor(F.col(v) * n / F.col(size)), F.lit(n - 1)).cast("int")
    return points.groupBy(*by, cell(x, width).alias("cell_x"), cell(y, height).alias("cell_y")).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= least)


def lost_cells(base: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """Per image the cells before, after, lost, and the share retained."""
    key = [*by, "cell_x", "cell_y"]
    both = base.select(*key, F.lit(1).alias("was")).join(now.select(*key, F.lit(1).alias("still")), key, "full")
    kept = F.count_if(F.col("was").isNotNull() & F.col("still").isNotNull())
    counted = both.groupBy(*by).agg(F.count("was").alias("before"), F.count("still").alias("after"), F.count_if(F.col("still").isNull()).alias("lost"), kept.alias("kept"))
    return counted.withColumn("retention", F.when(F.col("before") > 0, F.col("kept") / F.col("before"))).drop("kept")


def best_per_group(df: DataFrame, by: str, total: int, error: str, order: str) -> DataFrame:
    """`total` rows shared out evenly over the groups (the first ones get one more), each keeping its best by error."""
    groups = df.select(by).distinct().withColumn("__rank", F.row_number().over(Window.orderBy(by)) - 1)
    n = groups.count()
    quota = F.lit(total // max(n, 1)) + (F.col("__rank") < total % max(n, 1)).cast("int")
    ranked = df.withColumn("__row", F.row_number().over(Window.partitionBy(by).orderBy(error, order)))
    return ranked.join(groups.select(by, quota.alias("__quota")), by).where("__row <= __quota").drop("__row", "__quota")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds __at, the row's place in the order from 0, without one task for all: ranges are sorted on their own and offset by the sizes before them.

    The sorted ranges are written once with each row's number in its range, and sizes and rows both come from that table:
    ranges that are drawn twice need not be the same."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part, inner = F.shiftright("__id", 33), F.col("__id") % (1 << 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("__at", F.col("__before") + inner).drop("__part", "__before", "__id")  # one row a range


def thinned(df: DataFrame, order: list[str], most: int, rule: str) -> DataFrame:
    """At most `most` rows, evenly spaced in the order. rule: stride (int(i n / most)), floor (linspace, cut off) or round (linspace, halves to even)."""
    df = stored(df, "whole")  # read three times below
    n = df.count()
    if n <= most:
        return df
    places = numbered(df.select(*order), order)  # only the order's columns move again
    i = F.col("id").cast("double")
    last = float(max(most - 1, 1))
    at = {"stride": F.floor(i * n / most), "floor": F.floor(i * ((n - 1) / last)), "round": F.bround(i * ((n - 1) / last))}[rule]
    wanted = df.sparkSession.range(most).select(at.cast("long").alias("__at")).distinct()
    chosen = stored(places.join(F.broadcast(wanted), "__at", "left_semi").groupBy(*order).agg(F.count(F.lit(1)).alias("__of")), "chosen")  # `most` rows at most
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in order))
    again = df.alias("a").join(F.broadcast(chosen).alias("b"), same).select("a.*", "b.__of")
    rank = F.row_number().over(Window.partitionBy(*order).orderBy(*order))  # of rows that the order does not tell apart, as many as were chosen
    return again.withColumn("__rank", rank).where("__rank <= __of").drop("__rank", "__of")


def scene_scale(points: DataFrame, xyz: list[str], by: list[str]) -> DataFrame:
    """Per group the componentwise median and the median distance to it."""
    centre = points.groupBy(*by).agg(*(quantile(c, 0.5).alias(f"centre_{c}") for c in xyz))
    d = F.sqrt(reduce(lambda a, b: a + b, ((F.col(c) - F.col(f"centre_{c}")) * (F.col(c) - F.col(f"centre_{c}")) for c in xyz)))
    return centre.join(points.join(centre, by).groupBy(*by).agg(quantile(d, 0.5).alias("scale"), quantile(d, 0.95).alias("p95_radius"), F.max(d).alias("max_radius")), by)


def nearest_others(cameras: DataFrame, among: DataFrame, by: list[str], ident: str, xyz: list[str], k: int, full: int = 32, direct: int = 20_000_000) -> DataFrame:
    """by, ident, other, d: each camera's k nearest rows of its group in `among` but itself, and their squared distances; ties by smaller id. Exact. Rows with a null or a number that is not finite are left out.

    Groups of up to `direct` pairs in all are joined whole. Beyond that rows at one place are searched once, and meet in cells around them: each group's cells hold at most `full` places
    first (or what 12 quarterings leave), and are doubled for the places whose k nearest are not yet all within one cell's width."""
    g, c = [f"g{i}" for i in range(len(by))], [f"c{i}" for i in range(len(xyz))]
    fine = lambda df: df.where(_finite_rows(df, xyz)).select(*(F.col(b).alias(n) for b, n in zip(by, g, strict=True)), *(F.col(x).cast("double").alias(n) for x, n in zip(xyz, c, strict=True)), F.col(ident).alias("id"))
    apart = reduce(lambda a, b: a + b, ((F.col(n) - F.col(f"o_{n}")) * (F.col(n) - F.col(f"o_{n}")) for n in c))
    others = lambda df: df.select(*g, F.col("id").alias("other"), *(F.col(n).alias(f"o_{n}") for n in c))
    named = lambda df: df.select(*(F.col(n).alias(b) for b, n in zip(by, g, strict=True)), F.col("id").alias(ident), "other", "d")
    left, right = fine(cameras), fine(among)
    pairs = left.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).join(right.groupBy(*g).agg(F.count(F.lit(1)).alias("m")), g).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    if pairs <= direct:
        met = left.join(others(right), g).where("id <> other").withColumn("d", apart)
        return named(met.withColumn("place", F.row_number().over(Window.partitionBy(*g, "id").orderBy("d", "other"))).where(F.col("place") <= k))
    # Of rows at one place only the first k + 1 can be among anyone's k nearest.
    right = stored(right.withColumn("copy", F.row_number().over(Window.partitionBy(*g, *c).orderBy("id"))).where(F.col("copy") <= k + 1), "views")
    rest = left.select(*g, *c).distinct()
    box = right.where("copy = 1").groupBy(*g).agg(F.count(F.lit(1)).alias("n"), *(f(n).alias(f"{a}_{n}") for n in c for a, f in (("low", F.min), ("high", F.max))))
    asked = rest.groupBy(*g).agg(*(f(n).alias(f"{a}_{n}") for n in c for a, f in (("from", F.min), ("to", F.max))))
    extent = F.greatest(*(F.col(f"high_{n}") - F.col(f"low_{n}") for n in c))
    reach = F.greatest(*(F.greatest(f"high_{n}", f"to_{n}") - F.least(f"low_{n}", f"from_{n}") for n in c)) * len(c) ** 0.5
    radii = stored(box.join(asked, g).select(*g, reach.alias("reach"), F.when(extent > 0, extent / F.pow("n", F.lit(1 / len(c)))).when(reach > 0, reach).otherwise(1.0).alias("r")), "radii")
    cell = lambda n: F.floor(F.col(n) / F.col("r"))
    for _ in range(12):
        crowded = right.where("copy = 1").join(F.broadcast(radii), g).groupBy(*g, *(cell(n) for n in c)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > full).select(*g).distinct().withColumn("crowded", F.lit(True))
        crowded = stored(crowded, "crowded")
        if crowded.isEmpty():
            break
        radii = stored(radii.join(crowded, g, "left").select(*g, "reach", F.when(F.col("crowded"), F.col("r") / 4).otherwise(F.col("r")).alias("r")), "radii")
    rest, found = stored(rest.join(F.broadcast(radii), g), "asked"), None
    at = [f"at{i}" for i in range(len(c))]
    query = Window.partitionBy(*g, *c).orderBy("d", "other")
    while True:
        spread = rest
        for n, a in zip(c, at, strict=True):
            spread = spread.withColumn(a, F.explode(F.sequence(cell(n) - 1, cell(n) + 1)))
        sizes = rest.select(*g, "r").distinct()  # one radius a group: all double together
        own = right.join(F.broadcast(sizes), g).select(*g, F.col("id").alias("other"), *(F.col(n).alias(f"o_{n}") for n in c), *(cell(n).alias(a) for n, a in zip(c, at, strict=True)))
        met = spread.join(own, [*g, *at]).withColumn("d", apart)
        first = met.withColumn("place", F.row_number().over(query)).where(F.col("place") <= k + 1)
        best = first.groupBy(*g, *c).agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("best"))
        sure = (F.col("r") > F.col("reach")) | F.coalesce(F.try_element_at("best", F.lit(k + 1))["d"] <= F.col("r") * F.col("r") * (1 - 1e-9), F.lit(False))
        got = stored(rest.join(best, [*g, *c], "left").withColumn("sure", sure), "nearest")
        hit = got.where("sure").select(*g, *c, "best")
        found = hit if found is None else found.unionByName(hit)
        rest = stored(got.where("NOT sure").select(*g, *c, "reach", (F.col("r") * 2).alias("r")), "far")
        if rest.isEmpty():
            break
    own = F.slice(F.filter("best", lambda b: b["other"] != F.col("id")), 1, k)
    return named(left.join(found, [*g, *c]).select(*g, "id", F.explode(own).alias("b")).select(*g, "id", "b.other", "b.d"))


def nearest_views(cameras: DataFrame, by: list[str], ident: str, xyz: list[str], k: int, among: DataFrame | None = None) -> DataFrame:
    """Pairs a < b: each camera with its k nearest of its group, or of the group's rows in `among`. Groups are the views of one sensor."""
    near = nearest_others(cameras, cameras if among is None else among, by, ident, xyz, k)
    return near.select(F.least(ident, "other").alias("a"), F.greatest(ident, "other").alias("b")).distinct()


def view_pairs(cameras: DataFrame, by: list[str], ident: str, order: str, xyz: list[str], fraction: float, k: int) -> DataFrame:
    """Pairs a < b: of each group references at even places (the first and the last among them), each with its k nearest views of the whole group; ties by smaller id."""
    at = cameras.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(order, ident)) - 1)
    sizes = at.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).withColumn("__m", F.greatest(F.lit(1), F.bround(F.col("__n") * fraction).cast("int")))
    last = F.col("__n") - 1
    place = F.transform(F.sequence(F.lit(0), F.col("__m") - 1), lambda i: F.when((i > 0) & (i == F.col("__m") - 1), last).otherwise(F.bround(i * (last / F.greatest(F.col("__m") - 1, F.lit(1))))).cast("int"))
    chosen = at.join(sizes.select(*by, F.explode(F.array_distinct(place)).alias("__at")), [*by, "__at"]).select(*by, ident, *xyz)
    return nearest_views(chosen, by, ident, xyz, k, among=cameras)


def camera_spacing(cameras: DataFrame, ident: str, xyz: list[str], by: list[str]) -> DataFrame:
    """Per group the median of the cameras' distances to their nearest other camera; groups of one camera are left out."""
    gaps = nearest_others(cameras, cameras, by, ident, xyz, 1).withColumn("gap", F.sqrt("d"))
    return gaps.groupBy(*by).agg(F.percentile("gap", 0.5).alias("spacing"))


def lowest_confidence_dropped(df: DataFrame, confidence: str, order: list[str], percent: int = 8) -> DataFrame:
    """All but the floor(n * percent / 100) rows of least confidence, over all groups, ties by order."""
    drop = df.count() * percent // 100
    return numbered(df, [confidence, *order]).where(F.col("__at") >= drop).drop("__at")


def ground_mode(points: DataFrame, height: str, x: str, z: str, bin_: float = 0.05, top: int = 20, band: float = 0.15, share: float = 0.005, least: int = 1000) -> DataFrame:
    """Candidate ground heights: the fullest bins, each with the points within the band, their horizontal span (norm of p95 - p5), whether supported.

    Chosen is the lowest supported height whose score reaches 0.9 of the best; score is support times span ratio. A few bins meet all points by band cells."""
    n = points.count()
    bins = points.groupBy(F.floor(F.col(height) / bin_).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bin").limit(top).withColumn("candidate", (F.col("bin") + 0.5) * bin_)
    cell = lambda c: F.floor(c / band).cast("long")
    wide = bins.select("candidate", F.explode(F.sequence(cell(F.col("candidate")) - 1, cell(F.col("candidate")) + 1)).alias("cell"))
    near = points.select(F.col(height).alias("h"), F.col(x).alias("px"), F.col(z).alias("pz"), cell(F.col(height)).alias("cell")).join(F.broadcast(wide), "cell").where(F.abs(F.col("h") - F.col("candidate")) <= band)
    span = lambda c: quantile(c, 0.95) - quantile(c, 0.05)
    got = near.groupBy("candidate").agg(F.count(F.lit(1)).alias("support"), F.hypot(span("px"), span("pz")).alias("span"), quantile("h", 0.5).alias("height"))
    whole = points.agg(F.hypot(span(x), span(z)).alias("s")).first()["s"] or 1.0
    fit = got.withColumn("ratio", F.col("span") / whole).withColumn("supported", (F.col("support") >= max(least, share * n)) & (F.col("span") >= 0.25 * whole)).withColumn("score", F.col("support") * F.col("ratio"))
    best = F.max(F.when(F.col("supported"), F.col("score"))).over(Window.partitionBy())
    ready = fit.withColumn("dominant", F.col("supported") & (F.col("score") >= 0.9 * best))
    lowest = F.min(F.when(F.col("dominant"), F.col("height"))).over(Window.partitionBy())
    return ready.withColumn("chosen", F.col("dominant") & (F.col("height") == lowest))


def nearest(left: DataFrame, right: DataFrame, xyz: list[str], left_id: str, right_id: str, full: int = 64) -> DataFrame:
    """For each left row the nearest right row, ties by smaller id: left_id, match, distance; -1 and infinite for left rows with a null or a number that is not finite, or where no right row is finite.

    Right rows at one place are one row of the smallest id. The radius starts where the fullest cell holds at most `full` places (or after 12 quarterings), so that
    clustered rows do not meet in one cell, and grows fourfold for what is left; it ends at the latest when it covers both boxes."""
    fine = lambda df: df.where(reduce(lambda a, b: a & b, (finite(F.col(c)) for c in xyz)))
    places = stored(fine(right.select(right_id, *xyz)).groupBy(*xyz).agg(F.min(right_id).alias(right_id)), "places")
    rest = fine(left.select(left_id, *xyz))
    odd = left.select(left_id, *xyz).where(~reduce(lambda a, b: a & b, (finite(F.col(c)) for c in xyz)))
    found = odd.select(left_id, F.lit(-1).cast("long").alias("match"), F.lit(float("inf")).alias("distance"))
    box = lambda df: df.agg(F.count(F.lit(1)), *(f(c) for c in xyz for f in (F.min, F.max))).first()
    b, a = box(places), box(rest)
    if not b[0] or not a[0]:
        return found.unionByName(rest.select(left_id, F.lit(-1).cast("long").alias("match"), F.lit(float("inf")).alias("distance")))
    extent = max(b[2 + 2 * k] - b[1 + 2 * k] for k in range(len(xyz)))
    reach = max(max(a[2 + 2 * k], b[2 + 2 * k]) - min(a[1 + 2 * k], b[1 + 2 * k]) for k in range(len(xyz))) * len(xyz) ** 0.5
    radius = (extent or reach or 1.0) / b[0] ** (1 / len(xyz))
    radius = _fine_radius(places, xyz, radius, full)
    while True:
        hit = stored(_met(rest, places, xyz, radius, left_id, right_id), "nearest")
        found = found.unionByName(hit)
        if radius > reach:
            return found
        rest = stored(rest.join(hit.select(left_id), left_id, "left_anti"), "far")
        if rest.isEmpty():
            return found
        radius = min(4 * radius, max(reach * 1.01, 2 * radius))
