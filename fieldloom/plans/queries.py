"""Registered queries of the capture-graph operators, with their SQL.

Roles of the tables: events are frames (user_id the source, ts the time, value the quality); lineitem
is a bipartite track table (l_orderkey the image, l_partkey the point, l_suppkey the capture); embeddings
are points (the first components are coordinates). Aggregates are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import expr
from fieldloom.operators import graph, reports, robust, select, spatial, temporal
from fieldloom.operators.work import stored
from fieldloom.plans import stages
from fieldloom.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: t in seconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "props", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


T = "epoch_us(ts) / 1e6"


@query(f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS capture, value FROM events),
    s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY capture)) AS step FROM e QUALIFY step IS NOT NULL),
    m AS (SELECT user_id, count(*) AS n, quantile_cont(step, 0.5) AS median, quantile_cont(step, 0.95) AS p95 FROM s GROUP BY 1),
    d AS (SELECT user_id, quantile_cont(abs(step - median), 0.5) AS mad FROM s JOIN m USING (user_id) GROUP BY 1),
    g AS (SELECT *, round(greatest(3.0::DOUBLE * median, median + 6 * mad, 1e-9), 6) AS threshold FROM m JOIN d USING (user_id))
    SELECT user_id, n, round(median, 6) AS median, round(p95, 6) AS p95, round(mad, 6) AS mad, threshold, count(*) FILTER (step > threshold) AS jumps, round(max(step), 6) AS largest,
    count(*) FILTER (step > threshold) = 0 AS passed FROM s JOIN g USING (user_id) GROUP BY ALL""")
def trajectory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each source, robust threshold, jumps."""
    f = frames(spark, sf_dir).withColumn("capture", F.row_number().over(Window.partitionBy("user_id").orderBy("t")))
    g = robust.trajectory_gate(robust.trajectory_steps(f, "user_id", "capture", ["value"]), "user_id", ratio=3.0, digits=6)
    return g.select("user_id", "n", *(F.round(c, 6).alias(c) for c in ("median", "p95", "mad")), "threshold", "jumps", F.round("largest", 6).alias("largest"), "passed")


_PROBE = f"""p AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'error'),
    b AS (SELECT event_id AS m_event_id, user_id, {T} AS m_t FROM events WHERE event_type <> 'error')"""


@query(f"""WITH {_PROBE}, l AS (SELECT p.*, b.m_event_id AS l_id, b.m_t AS l_t FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.t >= b.m_t),
    r AS (SELECT p.event_id, b.m_event_id AS r_id, b.m_t AS r_t FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.t <= b.m_t)
    SELECT event_id, user_id, CASE WHEN r_t IS NULL OR t - l_t <= r_t - t THEN l_id ELSE r_id END AS m_event_id FROM l JOIN r USING (event_id)""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest in time, ties to the earlier."""
    f = frames(spark, sf_dir)
    return temporal.asof(f.where("event_type = 'error'").select("event_id", "user_id", "t"), f.where("event_type <> 'error'"), "user_id", "t", ["event_id"]).select("event_id", "user_id", "m_event_id")


@query(f"""WITH {_PROBE}, x AS (SELECT user_id, max_by(m_event_id, m_t) AS last_id FROM b GROUP BY 1),
    r AS (SELECT p.*, b.m_event_id FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.t <= b.m_t)
    SELECT event_id, user_id, coalesce(m_event_id, last_id) AS m_event_id FROM r LEFT JOIN x USING (user_id)""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first at or after, else the last."""
    f = frames(spark, sf_dir)
    return temporal.asof(f.where("event_type = 'error'").select("event_id", "user_id", "t"), f.where("event_type <> 'error'"), "user_id", "t", ["event_id"], "forward").select("event_id", "user_id", "m_event_id")


@query(f"""WITH p AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'error'), b AS (SELECT user_id, {T} AS t, value FROM events)
    SELECT p.event_id, p.user_id, count(b.t) AS n, round(quantile_cont(b.value, 0.5), 6) AS value FROM p LEFT JOIN b ON p.user_id = b.user_id AND abs(b.t - p.t) <= 7200 GROUP BY 1, 2""")
def band_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of what lies within two hours."""
    f = frames(spark, sf_dir)
    return temporal.band_median(f.where("event_type = 'error'"), f, "user_id", "t", ["value"], 7200.0, "event_id").withColumn("value", F.round("value", 6))


_OFFSETS = f"""e AS (SELECT event_id, user_id, event_type, {T} AS t, value FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS k FROM e),
    pairs AS (SELECT a.user_id // 10 AS g, a.event_id AS ord, (b.t - a.t) / 86400 AS off, greatest(1, floor(a.value))::DOUBLE AS w FROM r a JOIN r b ON a.user_id = b.user_id AND a.k = b.k AND a.event_type = 'view' AND b.event_type = 'click'),
    bins AS (SELECT g, floor(off) AS bin, sum(w) AS w, count(*) AS n, min(ord) AS seen FROM pairs GROUP BY 1, 2),
    s AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS support FROM bins),
    best AS (SELECT g, bin AS best, support FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY w DESC, seen) = 1),
    q AS (SELECT s.g, sum(n)::BIGINT AS n, sum(w) AS total, best, best.support, coalesce(max(s.support) FILTER (abs(bin - best) > 2), 0) AS second FROM s JOIN best ON s.g = best.g GROUP BY s.g, best, best.support),
    acc AS (SELECT *, n >= 20 AND support >= 0.2 * total AND support >= 1.25 * second AS accepted FROM q),
    cl AS (SELECT pairs.g, off, support, sum(sum(w)) OVER (PARTITION BY pairs.g ORDER BY off) AS running FROM pairs JOIN acc ON pairs.g = acc.g AND abs(floor(off) - best) <= 2 GROUP BY pairs.g, off, support),
    ce AS (SELECT g, min(off) AS centre FROM cl WHERE running >= support / 2 GROUP BY 1)"""


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("t")))
    a, b = f.where("event_type = 'view'"), f.where("event_type = 'click'").select("user_id", "k", F.col("t").alias("t_b"))
    return a.join(b, ["user_id", "k"]).select(F.floor(F.col("user_id") / 10).alias("g"), F.col("event_id").alias("ord"), ((F.col("t_b") - F.col("t")) / 86400).alias("off"), F.floor("value").alias("w"))


@query(f"WITH {_OFFSETS} SELECT g, n, round(total, 6) AS total, round(support, 6) AS support, round(second, 6) AS second, accepted, round(CASE WHEN accepted THEN centre END, 6) AS centre FROM acc JOIN ce USING (g)")
def dominant_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mode of offsets between two sensors."""
    s = robust.dominant_offset(_offsets(spark, sf_dir), ["g"], "off", "w", "ord")
    return s.select("g", "n", *(F.round(c, 6).alias(c) for c in ("total", "support", "second")), "accepted", F.round("centre", 6).alias("centre"))


@query(f"WITH {_OFFSETS} SELECT pairs.g, ord FROM pairs LEFT JOIN (SELECT g, centre FROM acc JOIN ce USING (g) WHERE accepted) c ON pairs.g = c.g WHERE centre IS NULL OR abs(off - centre) <= 3")
def offset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs near their group's offset."""
    p = _offsets(spark, sf_dir)
    return temporal.offset_filter(p, robust.dominant_offset(p, ["g"], "off", "w", "ord"), ["g"], "off", 3.0).select("g", "ord")


_GRAPH = """m AS (SELECT event_id AS id, user_id AS source, epoch_us(ts) / 1e6 AS t, lead(event_id, 3) OVER (PARTITION BY user_id // 2 ORDER BY ts, event_id) AS other, value FROM events),
    pairs AS (SELECT least(id, other) * 2147483647::BIGINT + greatest(id, other) AS pair_id, floor(value)::BIGINT AS inliers FROM m WHERE other IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, sf_dir)
    other = F.lead("event_id", 3).over(Window.partitionBy(F.floor(F.col("user_id") / 2)).orderBy("t", "event_id"))
    pairs = f.withColumn("other", other).where("other IS NOT NULL").select(expr.pair_id("event_id", "other").alias("pair_id"), F.floor("value").alias("inliers"))
    return pairs, f.select(F.col("event_id").alias("image_id"), F.col("user_id").alias("source"), "t")


@query(f"""WITH {_GRAPH} SELECT pair_id FROM pairs JOIN m a ON a.id = (pair_id - pair_id % 2147483647) // 2147483647 JOIN m b ON b.id = pair_id % 2147483647
    WHERE NOT (a.source = b.source AND abs(a.t - b.t) > 86400)""")
def gap_pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one source too far apart in time go."""
    pairs, images = _pairs(spark, sf_dir)
    ends = graph.with_endpoints(pairs, images, ["source", "t"])
    return graph.without(pairs, ends.where(temporal.too_far_in_time(ends, 86400.0))).select("pair_id")


@query(f"""WITH {_GRAPH}, x AS (SELECT least(a.source, b.source) AS source_1, greatest(a.source, b.source) AS source_2, inliers FROM pairs JOIN m a ON a.id = (pair_id - pair_id % 2147483647) // 2147483647 JOIN m b ON b.id = pair_id % 2147483647)
    SELECT source_1, source_2, count(*) AS raw_pairs, count(*) FILTER (inliers > 0) AS verified, min(inliers) FILTER (inliers > 0) AS least, round(avg(inliers) FILTER (inliers > 0), 6) AS mean, max(inliers) FILTER (inliers > 0) AS most,
    coalesce(sum(inliers) FILTER (inliers > 0), 0)::BIGINT AS matches, count(*) FILTER (inliers >= 15) AS at_threshold, count(*) FILTER (inliers > 0 AND inliers < 15) AS below_threshold FROM x GROUP BY 1, 2""")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by pair of sources."""
    pairs, images = _pairs(spark, sf_dir)
    ends = graph.with_endpoints(pairs, images, ["source"])
    sides = ends.select(F.least("source_a", "source_b").alias("source_1"), F.greatest("source_a", "source_b").alias("source_2"), "inliers")
    return graph.match_summary(sides, 15, by=["source_1", "source_2"])


@query(f"""WITH {_GRAPH}, o AS (SELECT event_id AS a, lead(event_id, k) OVER (PARTITION BY user_id, event_type, k ORDER BY ts, event_id) AS b FROM events, (SELECT unnest([1, 2]) AS k))
    SELECT least(a, b) AS a, greatest(a, b) AS b FROM o WHERE b IS NOT NULL EXCEPT SELECT (pair_id - pair_id % 2147483647) // 2147483647, pair_id % 2147483647 FROM pairs""")
def missing_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a sequence that were never matched."""
    pairs, _ = _pairs(spark, sf_dir)
    tried = pairs.select(expr.pair_low("pair_id").alias("a"), expr.pair_high("pair_id").alias("b"))
    return temporal.missing_neighbours(frames(spark, sf_dir), ["user_id", "event_type"], "t", "event_id", 2, tried)


_REASON = "CASE WHEN value < 10 THEN 'blur' WHEN event_type = 'error' THEN 'exposure' WHEN CAST(json_extract(props, '$.k') AS INT) < 20 THEN 'few_features' WHEN event_id % 17 > 14 THEN 'rolling_shutter' ELSE 'keep' END"


@query(f"SELECT user_id, {_REASON} AS reason, count(*) AS n FROM events GROUP BY ALL")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failed gate of each frame, counted."""
    f = frames(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    return select.reason_counts(f, ["user_id"], select.reject_reason(F.col("value"), F.col("event_type") != "error", k, (F.col("event_id") % 17).cast("double"), 10, 20, 14.0))


@query("""WITH p AS (SELECT l_partkey AS point, count(*) AS n, avg(l_discount) AS error FROM lineitem GROUP BY 1)
    SELECT count(*) AS points, sum(n)::BIGINT AS observations, round(avg(error), 6) AS mean_error, round(quantile_cont(error, 0.5), 6) AS median_error, round(quantile_cont(error, 0.95), 6) AS p95_error,
    round(avg(n), 6) AS mean_track, quantile_cont(n, 0.5)::DOUBLE AS median_track, count(*) FILTER (n = 2) AS two_observations, round(count(*) FILTER (n = 2) / greatest(1, count(*)), 6) AS two_ratio FROM p""")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: counts, errors and track lengths of a model."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("error"))
    two = F.count_if(F.col("n") == 2)
    return p.agg(
        F.count(F.lit(1)).alias("points"), F.sum("n").alias("observations"), F.round(F.avg("error"), 6).alias("mean_error"), F.round(robust.quantile("error", 0.5), 6).alias("median_error"), F.round(robust.quantile("error", 0.95), 6).alias("p95_error"),
        F.round(F.avg("n"), 6).alias("mean_track"), robust.quantile("n", 0.5).alias("median_track"), two.alias("two_observations"), F.round(two / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("two_ratio"),
    )


@query("SELECT length, count(*) AS points FROM (SELECT count(*) AS length FROM lineitem GROUP BY l_partkey) GROUP BY 1")
def track_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A39."""
    return graph.track_length_histogram(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("""WITH r AS (SELECT l_suppkey, l_tax + 1 + l_discount / 50 AS r FROM lineitem), m AS (SELECT l_suppkey, count(*) AS n, quantile_cont(r, 0.5) AS median FROM r GROUP BY 1),
    d AS (SELECT l_suppkey, quantile_cont(abs(r - median), 0.5) AS mad FROM r JOIN m USING (l_suppkey) GROUP BY 1), s AS (SELECT * FROM m JOIN d USING (l_suppkey)),
    i AS (SELECT l_suppkey, count(*) AS inliers, quantile_cont(r, 0.5) AS ratio FROM r JOIN s USING (l_suppkey) WHERE abs(r - median) <= greatest(5 * mad, 0.005 * median) GROUP BY 1),
    two AS (SELECT l_suppkey, l_partkey, l_orderkey % 50 AS capture FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber % 2) >= 2),
    o AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS stereo_points, count(DISTINCT capture) AS stereo_captures FROM two GROUP BY 1),
    x AS (SELECT *, CASE WHEN n < 8 THEN 'too_few_registered_rig_baselines' WHEN coalesce(stereo_points, 0) < 8 OR coalesce(stereo_captures, 0) < 8 THEN 'rig_baseline_not_observable' WHEN inliers < 8 OR mad / median > 0.02 THEN 'inconsistent_rig_baseline_scale' END AS reason FROM s JOIN i USING (l_suppkey) LEFT JOIN o USING (l_suppkey))
    SELECT l_suppkey, n, round(median, 6) AS median, round(mad, 6) AS mad, inliers, coalesce(stereo_points, 0) AS stereo_points, coalesce(stereo_captures, 0) AS stereo_captures, CASE WHEN reason IS NULL THEN round(1 / ratio, 6) END AS scale, reason IS NULL AS metric, reason IS NULL AND abs(1 / ratio - 1) > 1e-9 AS applied, reason FROM x""")
def metric_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale from baseline ratios, where two sensors of a capture see enough points."""
    l = table(spark, sf_dir, "lineitem").withColumns({"r": F.col("l_tax") + 1 + F.col("l_discount") / 50, "capture": F.col("l_orderkey") % 50, "sensor": F.col("l_linenumber") % 2})  # noqa: E741
    s = robust.metric_scale(l, ["l_suppkey"], "r", robust.stereo_observability(l, ["l_suppkey"], "l_partkey", "capture", "sensor"))
    return s.withColumns({c: F.round(c, 6) for c in ("median", "mad", "scale")})


@query("""SELECT l_shipmode, count(*) AS n, 0::BIGINT AS n_not_finite, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99, round(max(x), 4) AS largest
    FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice AS x FROM lineitem) GROUP BY 1""")
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26, A27, A30."""
    d = robust.distribution(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("l_shipmode"), "l_extendedprice"), ["l_shipmode"], "l_extendedprice")
    return d.select("l_shipmode", "n", "n_not_finite", *(F.round(c, 4).alias(c) for c in ("p50", "p90", "p95", "p99", "largest")))


@query("SELECT user_id, greatest(0, least(2000, floor(x / 5) * 5))::BIGINT AS threshold FROM (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = floor((n - 1) * 0.2) + 1")
def sharpness_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank, not interpolated."""
    return robust.rank_threshold(table(spark, sf_dir, "events"), ["user_id"], "value")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")), F.abs(F.col("embedding")[3].cast("double")).alias("error"))


_POINTS = "p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, abs(embedding[4]::DOUBLE) AS error FROM embeddings)"


@query(f"WITH {_POINTS} SELECT vec_id, round(error, 6) AS error FROM p QUALIFY row_number() OVER (PARTITION BY floor(x / 0.1), floor(y / 0.1), floor(z / 0.1) ORDER BY error, vec_id) = 1")
def voxel_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a voxel."""
    return spatial.voxel_best(_points(spark, sf_dir), ["x", "y", "z"], 0.1, "error", "vec_id").select("vec_id", F.round("error", 6).alias("error"))


@query(f"""WITH {_POINTS}, l AS (SELECT * FROM p WHERE label = 0), r AS (SELECT * FROM p WHERE label <> 0), d AS (SELECT l.vec_id, r.vec_id AS match, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d FROM l JOIN r ON true WHERE d <= 0.05)
    SELECT l.vec_id, coalesce(arg_min(match, (d, match)), -1) AS match, round(coalesce(min(d), 1e9), 6) AS distance FROM l LEFT JOIN d USING (vec_id) GROUP BY 1""")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbour within a radius."""
    p = _points(spark, sf_dir)
    n = spatial.nearest_within(p.where("label = 0"), p.where("label <> 0"), ["x", "y"], 0.05, "vec_id", "vec_id")
    return n.select("vec_id", "match", F.round(F.least("distance", F.lit(1e9)), 6).alias("distance"))


_CELLS = "c AS (SELECT label, least(floor((x + 1) * 16 / 2), 15)::INT AS cell_x, least(floor((y + 1) * 16 / 2), 15)::INT AS cell_y, count(*) AS points, count(*) FILTER (error < 0.1) AS good FROM p GROUP BY ALL)"


@query(f"""WITH {_POINTS}, {_CELLS} SELECT label, count(*) FILTER (points >= 3) AS before, count(*) FILTER (good >= 3) AS after, count(*) FILTER (points >= 3 AND good < 3) AS lost,
    round(count(*) FILTER (good >= 3) / count(*) FILTER (points >= 3), 6) AS retention FROM c WHERE points >= 3 GROUP BY 1""")
def coverage_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells that points cover, and lose when the bad ones go."""
    p = _points(spark, sf_dir).withColumn("u", F.col("x") + 1).withColumn("v", F.col("y") + 1).withColumn("two", F.lit(2.0))
    cells = lambda rows: spatial.grid_cells(rows, ["label"], "u", "v", "two", "two", 16, 3)
    return spatial.lost_cells(cells(p), cells(p.where("error < 0.1")), ["label"]).withColumn("retention", F.round("retention", 6))


@query(f"""WITH {_POINTS}, g AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM p)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY error, vec_id) AS place FROM p)
    SELECT vec_id, label FROM r JOIN g USING (label) WHERE place <= 127 // n + (k < 127 % n)::INT""")
def quota_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a quota of the best for each group."""
    return spatial.best_per_group(_points(spark, sf_dir), "label", 127, "error", "vec_id").select("vec_id", "label")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS n FROM part) WHERE k IN (SELECT DISTINCT floor(i * n / 150) FROM (SELECT unnest(range(150)) AS i), (SELECT count(*) AS n FROM part))")
def thinned_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced rows by place."""
    return spatial.thinned(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 150, "stride")


@query(f"""WITH {_POINTS}, c AS (SELECT label, quantile_cont(x, 0.5) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(z, 0.5) AS c FROM p GROUP BY 1),
    d AS (SELECT label, a, b, c, sqrt((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c)) AS d FROM p JOIN c USING (label))
    SELECT label, round(a, 6) AS centre_x, round(b, 6) AS centre_y, round(c, 6) AS centre_z, round(quantile_cont(d, 0.5), 6) AS scale, round(quantile_cont(d, 0.95), 6) AS p95_radius, round(max(d), 6) AS max_radius FROM d GROUP BY label, a, b, c""")
def scene_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and radii."""
    s = spatial.scene_scale(_points(spark, sf_dir), ["x", "y", "z"], ["label"])
    return s.select("label", *(F.round(c, 6).alias(c) for c in s.columns if c != "label"))


@query(f"""WITH {_POINTS}, r AS (SELECT l.vec_id AS i, o.vec_id AS j, row_number() OVER (PARTITION BY l.vec_id ORDER BY (l.x - o.x) * (l.x - o.x) + (l.y - o.y) * (l.y - o.y) + (l.z - o.z) * (l.z - o.z), o.vec_id) AS k FROM p l JOIN p o ON l.label = o.label AND l.vec_id <> o.vec_id WHERE l.vec_id % 5 = 0 AND o.vec_id % 5 = 0)
    SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM r WHERE k <= 3""")
def nearest_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 over every fifth view only, as its SQL; nearest_views_whole searches all views."""
    return spatial.nearest_views(_points(spark, sf_dir).where("vec_id % 5 = 0"), ["label"], "vec_id", ["x", "y", "z"], 3)


@query(f"""WITH {_POINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM p), g AS (SELECT DISTINCT label, n, greatest(1, round_even(n * 0.2::DOUBLE, 0)::BIGINT) AS m FROM n),
    i AS (SELECT label, n, m, unnest(range(m)) AS i FROM g), c AS (SELECT DISTINCT label, CASE WHEN i > 0 AND i = m - 1 THEN n - 1 ELSE round_even(i * ((n - 1) / greatest(m - 1, 1)), 0)::BIGINT END AS place FROM i),
    r AS (SELECT l.vec_id AS i, o.vec_id AS j, row_number() OVER (PARTITION BY l.vec_id ORDER BY (l.x - o.x) * (l.x - o.x) + (l.y - o.y) * (l.y - o.y) + (l.z - o.z) * (l.z - o.z), o.vec_id) AS k FROM n l JOIN c USING (label, place) JOIN p o ON l.label = o.label AND l.vec_id <> o.vec_id)
    SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM r WHERE k <= 3""")
def nearest_views_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each group's views as references, at even places; neighbours from all views."""
    return spatial.view_pairs(_points(spark, sf_dir), ["label"], "vec_id", "vec_id", ["x", "y", "z"], 0.2, 3)


@query(f"""WITH {_POINTS}, g AS (SELECT l.label, l.vec_id, sqrt(min((l.x - o.x) * (l.x - o.x) + (l.y - o.y) * (l.y - o.y) + (l.z - o.z) * (l.z - o.z))) AS gap FROM p l JOIN p o ON l.label = o.label AND l.vec_id <> o.vec_id GROUP BY 1, 2) SELECT label, round(quantile_cont(gap, 0.5), 6) AS spacing FROM g GROUP BY 1""")
def camera_spacings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median distance to the nearest camera."""
    return spatial.camera_spacing(_points(spark, sf_dir), "vec_id", ["x", "y", "z"], ["label"]).withColumn("spacing", F.round("spacing", 6))


@query(f"""WITH {_POINTS} SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY error, vec_id) - 1 AS k, count(*) OVER () AS n FROM p) WHERE k >= n * 8 // 100""")
def confidence_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the least confident 8 % go, over all groups."""
    return spatial.lowest_confidence_dropped(_points(spark, sf_dir), "error", ["vec_id"]).select("vec_id")


@query("""SELECT user_id, event_type, arg_max(event_id, ts) AS latest, arg_max(json_extract(props, '$.k')::INT, CASE WHEN json_extract(props, '$.k')::INT > 50 THEN ts END) FILTER (json_extract(props, '$.k')::INT > 50) AS progress FROM events GROUP BY 1, 2""")
def event_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, W6, ST5: the latest event and the latest number of each stage."""
    f = frames(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rows = f.select("user_id", "event_type", "event_id", "t", F.when(F.col("k") > 50, F.col("k")).alias("progress"))
    s = streams.snapshot(rows, ["user_id", "event_type"], "t")
    return s.select("user_id", "event_type", F.col("activity.event_id").alias("latest"), "progress")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER w AS k, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY k) AS run FROM e)
    SELECT user_id, event_type, min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal states."""
    f = frames(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("t")))
    return temporal.runs(f, ["user_id"], "k", "event_type")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS context, max(value) OVER (PARTITION BY user_id ORDER BY ts) AS progress FROM events""")
def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state seen, and progress that never falls."""
    f = frames(spark, sf_dir).withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    f = temporal.running_max(temporal.carried(f, ["user_id"], "t", "mark", "context"), ["user_id"], "t", "value", "progress")
    return f.select("event_id", "context", "progress")


@query("SELECT user_id, max(coalesce(gap, 0)) AS max_gap, count(*) AS n FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY 1")
def max_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return temporal.max_gap(e, "user_id", "us")


@query("SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY ts) AS quarter, row_number() OVER (ORDER BY user_id, ts) - 1 AS index FROM events")
def quarters_and_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of each source, one running number over all."""
    q = temporal.dense_index(temporal.quarters(frames(spark, sf_dir), ["user_id"], "t"), "user_id", "user_id", "t")
    return q.select("event_id", "quarter", "index")


@query("SELECT point, count(*) AS captures FROM (SELECT l_partkey AS point, l_orderkey % 500 AS capture FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2) GROUP BY 1")
def observable_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that two sensors of one capture see."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("point"), (F.col("l_orderkey") % 500).alias("capture"), "l_suppkey")  # noqa: E741
    return graph.observable_points(l, "point", "capture", "l_suppkey")


_VOTES = "v AS (SELECT q.o_custkey AS query, l_partkey AS point, count(DISTINCT l_suppkey) AS votes FROM orders q JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("anchor"))
    tracks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("anchor"), F.col("l_partkey").alias("point"), F.col("l_suppkey").alias("capture"))
    return graph.votes(links, tracks, "query", "anchor", "point", "capture")


@query(f"WITH {_VOTES} SELECT * FROM v")
def point_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes for points by captures."""
    return _votes(spark, sf_dir)


@query(f"""WITH {_VOTES}, q AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY votes DESC) AS r, count(*) OVER (PARTITION BY query, votes) AS n FROM v), s AS (SELECT query, point, votes FROM q WHERE r = 1 AND n = 1),
    p AS (SELECT *, rank() OVER (PARTITION BY point ORDER BY votes DESC) AS r, count(*) OVER (PARTITION BY point, votes) AS n FROM s) SELECT query, point, votes FROM p WHERE r = 1 AND n = 1""")
def mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query, one point, no ties."""
    return graph.mutual_best(_votes(spark, sf_dir), "query", "point")


@query("""WITH q AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS c, min(l_discount * 100) AS best FROM lineitem GROUP BY 1)
    SELECT count(*) AS queries, count(*) FILTER (c >= 2) AS eligible, count(*) FILTER (c >= 2 AND best <= 1) AS within_1, count(*) FILTER (c >= 2 AND best <= 2) AS within_2, count(*) FILTER (c >= 2 AND best <= 4) AS within_4, count(*) FILTER (c >= 2 AND best <= 8) AS within_8 FROM q""")
def heldout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by their least error, as its SQL; A28 itself is heldout_report, heldout_quantiles and heldout_images."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_discount") * 100).alias("e"))  # noqa: E741
    return graph.heldout_audit(l, "l_orderkey", "l_suppkey", "e")


_HELD = """l AS (SELECT l_orderkey AS query, l_orderkey % 40 AS image, l_partkey % 3 AS point, l_suppkey % 4 AS capture FROM lineitem), g AS (SELECT o_orderkey AS query FROM orders WHERE o_custkey % 4 <> 0),
    s AS (SELECT image, query, point, CASE WHEN (query + point) % 50 = 0 THEN 'inf'::DOUBLE ELSE (query * 7 + point * 13) % 500 / 40.0::DOUBLE END AS e, 1 + (query + point * 5) % 20 / 10.0::DOUBLE AS d FROM l WHERE query IN (SELECT query FROM g) GROUP BY ALL HAVING count(DISTINCT capture) >= 2),
    q AS (SELECT image, query, count(*) AS n, min(e) AS e, count(*) FILTER (e <= 2) AS fine, max(d) FILTER (e <= 2) / min(d) FILTER (e <= 2) AS ratio FROM s GROUP BY ALL), o AS (SELECT * FROM q WHERE n = 1), f AS (SELECT e FROM o WHERE e < 'inf'::DOUBLE)"""


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lineitems as links of held-out keypoints (orders, in images) to points that captures see; a point's error and distance come from the keys, some without a value."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_orderkey") % 40).alias("image"), (F.col("l_partkey") % 3).alias("point"), (F.col("l_suppkey") % 4).alias("capture"))  # noqa: E741
    q, p = F.col("query"), F.col("point")
    made = l.withColumns({"e": F.when((q + p) % 50 != 0, (q * 7 + p * 13) % 500 / 40.0), "d": 1 + (q + p * 5) % 20 / 10.0})
    return made, table(spark, sf_dir, "orders").where("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("query"))


@query(f"""WITH {_HELD}, t AS (SELECT count(DISTINCT query) AS eligible FROM g), c AS (SELECT ratio FROM q WHERE fine >= 2), w AS (SELECT count(*) AS predicted, count(*) FILTER (e <= 1) AS within_1, count(*) FILTER (e <= 2) AS within_2, count(*) FILTER (e <= 4) AS within_4, count(*) FILTER (e <= 8) AS within_8 FROM o)
    SELECT eligible, predicted, (SELECT count(*) FROM q WHERE n > 1) AS ambiguous, eligible - predicted AS unsupported_or_ambiguous, round(predicted / eligible, 6) AS coverage, (SELECT count(*) FROM o WHERE e = 'inf'::DOUBLE) AS invalid, within_1, within_2, within_4, within_8,
    round(within_1 / eligible, 6) AS ratio_within_1, round(within_2 / eligible, 6) AS ratio_within_2, round(within_4 / eligible, 6) AS ratio_within_4, round(within_8 / eligible, 6) AS ratio_within_8, (SELECT count(*) FROM c) AS contested, (SELECT count(*) FROM c WHERE ratio > 1.1) AS over_10pct, (SELECT count(*) FROM c WHERE ratio > 1.25) AS over_25pct,
    round((SELECT quantile_cont(ratio, 0.5) FROM c), 6) AS ratio_p50, round((SELECT max(ratio) FROM c), 6) AS ratio_max FROM t, w""")
def heldout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sole, ambiguous and contested proposals of held-out keypoints, and shares of all eligible ones."""
    r = graph.heldout_report(*_held(spark, sf_dir), "query", "point", "capture", "e", "d")
    return r.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes))


@query(f"""WITH {_HELD} SELECT (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM o WHERE e = 'inf'::DOUBLE) AS n_not_finite, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.9), 6) AS p90, round(quantile_cont(e, 0.95), 6) AS p95, round(quantile_cont(e, 0.99), 6) AS p99, round(max(e), 6) AS largest FROM f""")
def heldout_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of all sole predictions, their quantiles exact by counting."""
    d = robust.few_distributions(stored(graph.heldout_errors(*_held(spark, sf_dir), "query", "image", "point", "capture", "e"), "heldout"), [], "e")
    return d.select("n", "n_not_finite", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "largest")))


@query(f"""WITH {_HELD}, i AS (SELECT image, count(*) AS predictions, count(*) FILTER (e = 'inf'::DOUBLE) AS n_not_finite, count(*) FILTER (e <= 2) AS within FROM o GROUP BY 1), v AS (SELECT image, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.9) AS p90, quantile_cont(e, 0.95) AS p95, quantile_cont(e, 0.99) AS p99, max(e) AS largest FROM o WHERE e < 'inf'::DOUBLE GROUP BY 1)
    SELECT image, predictions, n_not_finite, within, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p95, 6) AS p95, round(p99, 6) AS p99, round(largest, 6) AS largest FROM i LEFT JOIN v USING (image)""")
def heldout_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by image."""
    i = graph.heldout_images(graph.heldout_errors(*_held(spark, sf_dir), "query", "image", "point", "capture", "e"), "image", "e")
    return i.select("image", "predictions", "n_not_finite", "within", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "largest")))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS a, o_custkey + 1 + o_orderkey % 5 AS b FROM orders), t AS (SELECT c, count(*) AS n FROM (SELECT a AS c FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
    x AS (SELECT a, b, ta.n AS na, tb.n AS nb FROM e JOIN t ta ON a = ta.c JOIN t tb ON b = tb.c)
    SELECT DISTINCT CASE WHEN na >= 2 AND nb < na THEN a WHEN nb >= 2 AND na < nb THEN b WHEN na >= 2 AND nb >= 2 THEN CASE WHEN na > nb THEN a ELSE b END ELSE b END AS capture FROM x""")
def outlier_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which captures bad edges are due to."""
    o = table(spark, sf_dir, "orders")
    return graph.outlier_captures(o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 5).alias("b")))


@query("""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS image, coalesce(a.l_linenumber, b.l_linenumber) AS idx, a.l_discount AS base, b.l_discount AS other, CASE WHEN a.l_orderkey IS NULL THEN 'added' WHEN b.l_orderkey IS NULL THEN 'lost' ELSE 'common' END AS state
    FROM (SELECT * FROM lineitem WHERE l_quantity > 10) a FULL JOIN (SELECT * FROM lineitem WHERE l_tax < 0.06) b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def predictions_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common, added and lost observations."""
    l = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "image", "l_linenumber": "idx"})  # noqa: E741
    c = graph.compare(l.where("l_quantity > 10"), l.where("l_tax < 0.06"), ["image", "idx", "l_partkey", "l_suppkey"], "l_discount")
    return c.select("image", "idx", "base", "other", "state")


@query("""SELECT c, 'missing' AS problem FROM (SELECT c_custkey AS c FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT c, 'unexpected' FROM (SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT c_custkey FROM customer)""")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing and what is unexpected."""
    return graph.differences(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c")), "c")


@query("""SELECT r_name, count(*) AS total, count(*) FILTER (n > 0) AS registered, round(count(*) FILTER (n > 0) / count(*), 6) AS ratio, count(*) FILTER (n = 0) AS unsupported FROM (SELECT c_custkey, r_name, count(o_orderkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY 1""")
def source_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered captures of each source, and those without observations."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    seen = F.count_if(F.col("n") > 0)
    return rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("total"), seen.alias("registered"), F.round(seen / F.count(F.lit(1)), 6).alias("ratio"), F.count_if(F.col("n").isNull()).alias("unsupported"))


@query("""SELECT p_partkey, round(CASE WHEN p_size > 25 THEN sqrt(p_size * p_size + 400) * p_size / sqrt(36 * 36 + 24 * 24) ELSE 1.2 * greatest(p_size, 20) END, 6) AS focal, p_size > 25 AS known, round(CASE WHEN p_size > 1 THEN -10 * log10((p_size - 1) / 50.0) END, 6) AS psnr, round(1 / (1 + exp(-(p_size - 25.0))), 6) AS sigmoid FROM part""")
def scalar_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, F24, F25."""
    size = F.col("p_size")
    focal, known = expr.focal_guess(size, F.lit(20), F.when(size > 25, size.cast("double")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(focal, 6).alias("focal"), known.alias("known"), F.round(expr.psnr((size - 1) / 50.0), 6).alias("psnr"), F.round(expr.sigmoid(size - 25.0), 6).alias("sigmoid"))


_W = "(SELECT vec_id, [embedding[k]::DOUBLE FOR k IN range(1, 13)] AS e FROM embeddings)"


@query(f"""WITH v AS (SELECT vec_id, e, e[1] - e[4] AS w1, e[2] - e[5] AS w2, e[3] - e[6] AS w3 FROM {_W}),
    d AS (SELECT vec_id, e[7]*e[7]+e[8]*e[8]+e[9]*e[9] AS a, e[7]*e[10]+e[8]*e[11]+e[9]*e[12] AS b, e[10]*e[10]+e[11]*e[11]+e[12]*e[12] AS c, e[7]*w1+e[8]*w2+e[9]*w3 AS d, e[10]*w1+e[11]*w2+e[12]*w3 AS f FROM v)
    SELECT vec_id, round((b*f - c*d) / (a*c - b*b), 4) AS depth_1, round((a*f - b*d) / (a*c - b*b), 4) AS depth_2, round(degrees(acos(greatest(least(b / sqrt(a*c), 1), -1))), 4) AS parallax FROM d WHERE abs(a*c - b*b) > 1e-7""")
def triangulated_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two rays, in closed form."""
    e = [F.col("embedding")[k].cast("double") for k in range(12)]
    t = expr.triangulated(e[:3], e[6:9], e[3:6], e[9:12])
    below = expr.dot(e[6:9], e[6:9]) * expr.dot(e[9:12], e[9:12]) - expr.dot(e[6:9], e[9:12]) * expr.dot(e[6:9], e[9:12])
    return table(spark, sf_dir, "embeddings").where(F.abs(below) > 1e-7).select("vec_id", *(F.round(t[c], 4).alias(c) for c in ("depth_1", "depth_2", "parallax")))


@query("""SELECT page_id, replace(url, '\\', '/') AS name, NOT regexp_matches(url, '^(/|[A-Za-z]:)') AND url <> '' AND NOT regexp_matches(url, '(^|/)\\.\\.(/|$)') AS safe, regexp_matches(lower(url), '(frame|image|img)[_-]?[0-9]+') AS sequence FROM pages""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26, F27, P11."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", expr.slashes(u).alias("name"), expr.safe_path(u).alias("safe"), expr.trajectory_name(u).alias("sequence"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 AND event_type = 'click' ORDER BY event_id LIMIT 200")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, T2: a page behind a cursor."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    return streams.page(e, 100, event_type="click").withColumnRenamed("id", "event_id")


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT n_regionkey AS src, 10 + n_nationkey AS dst FROM nation UNION SELECT 10 + s_nationkey, 1000 + s_suppkey FROM supplier), reach(stage, uses_it) AS (SELECT src, dst FROM edges UNION SELECT reach.stage, edges.dst FROM reach JOIN edges ON uses_it = src) SELECT stage::BIGINT AS stage, uses_it::BIGINT AS uses_it FROM reach""")
def stage_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: what depends on what, at any remove."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 10).cast("long").alias("dst")).distinct()
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 10).cast("long").alias("src"), (F.col("s_suppkey") + 1000).alias("dst"))
    return stages.lineage(n.union(s))


@query("SELECT a.c_nationkey, a.c_mktsegment, a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")
def capture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a capture."""
    return graph.capture_pairs(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row finds exactly one."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return graph.strict(table(spark, sf_dir, "customer"), n, "c_nationkey").select("c_custkey", "n_name")


@query("""WITH e AS (SELECT o_orderkey, o_custkey AS source_a, lag(o_custkey) OVER (ORDER BY o_orderkey) AS source_b, o_orderkey AS name_a, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS name_b, o_totalprice AS d FROM orders)
    SELECT o_orderkey, CASE WHEN name_a % 10 = 0 OR name_b % 10 = 0 THEN 'validation' WHEN source_a % 40 = source_b % 40 AND d < 100000 THEN 'short_baseline' ELSE 'retained' END AS class FROM e WHERE source_b IS NOT NULL""")
def holdout_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by class for a held-out check."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    at = spatial.numbered(o, ["o_orderkey"])
    before = at.select((F.col("__at") + 1).alias("__at"), F.col("o_custkey").alias("was"), F.col("o_orderkey").alias("name_b"))
    ends = at.join(before, "__at").select("o_orderkey", (F.col("o_custkey") % 40).alias("source_a"), (F.col("was") % 40).alias("source_b"), F.col("o_orderkey").alias("name_a"), "name_b", F.col("o_totalprice").alias("d"))
    return graph.holdout_classes(ends, o.where("o_orderkey % 10 = 0").withColumnRenamed("o_orderkey", "name"), "name", "d", 100000.0).select("o_orderkey", "class")


@query("""SELECT l_suppkey, count(*) AS images, count(DISTINCT (l_returnflag = 'R', l_linestatus = 'O')) = 1 AS consistent, bool_or(l_returnflag = 'R') AND NOT bool_or(l_linestatus = 'O') AND count(DISTINCT (l_returnflag = 'R', l_linestatus = 'O')) = 1 AS fixed FROM lineitem WHERE l_quantity > 49 GROUP BY 1""")
def camera_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A41 over the rows of its SQL only; camera_policies_whole takes all."""
    return _policies(table(spark, sf_dir, "lineitem").where("l_quantity > 49"))


def _policies(rows: DataFrame) -> DataFrame:
    rows = rows.select("l_suppkey", (F.col("l_returnflag") == "R").alias("prior"), (F.col("l_linestatus") == "O").alias("refine"))
    return reports.camera_policy(rows, "l_suppkey", "prior", "refine")


@query("""SELECT l_suppkey, count(*) AS images, count(DISTINCT (l_returnflag = 'R', l_linestatus = 'O')) = 1 AS consistent, bool_or(l_returnflag = 'R') AND NOT bool_or(l_linestatus = 'O') AND count(DISTINCT (l_returnflag = 'R', l_linestatus = 'O')) = 1 AS fixed FROM lineitem GROUP BY 1""")
def camera_policies_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy of each camera."""
    return _policies(table(spark, sf_dir, "lineitem"))


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'F' || c_custkey WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'O' || c_custkey END AS path FROM customer""")
def mask_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate that exists."""
    there = table(spark, sf_dir, "orders").select(F.concat("o_orderstatus", F.col("o_custkey").cast("string")).alias("path"))
    key = F.col("c_custkey").cast("string")
    return reports.first_existing(table(spark, sf_dir, "customer"), "c_custkey", [F.concat(F.lit("F"), key), F.concat(F.lit("O"), key)], there, "path")


@query("""SELECT CASE WHEN (o_orderkey // 20) % 2 = 0 THEN 'fit' ELSE 'heldout' END AS part, o_orderkey % 5 = 2 AS holdout, count(*) AS n FROM orders GROUP BY ALL""")
def block_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16."""
    o = table(spark, sf_dir, "orders").select(reports.block_split(F.col("o_orderkey")).alias("part"), reports.is_holdout(F.col("o_orderkey")).alias("holdout"))
    return o.groupBy("part", "holdout").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, dense_rank() OVER (ORDER BY f) - 1 AS "group" FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS f FROM part)""")
def camera_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal signatures, numbered as they appear."""
    return reports.camera_groups(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey").select("p_partkey", F.col("group").cast("long").alias("group"))


@query("""WITH gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0), k AS (SELECT l_suppkey AS frame_id, l_linenumber % 2 AS sensor_type, l_orderkey AS data_id FROM lineitem WHERE NOT (l_linenumber % 2 = 0 AND l_orderkey IN (SELECT id FROM gone)))
    SELECT * FROM k WHERE frame_id IN (SELECT frame_id FROM k WHERE sensor_type = 0)""")
def frames_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: frames after images are removed."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame_id"), (F.col("l_linenumber") % 2).alias("sensor_type"), F.col("l_orderkey").alias("data_id"))
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("image_id"))
    return reports.frames_without(f, gone, 0).select("frame_id", "sensor_type", "data_id")


@query(f"""WITH {_POINTS}, u AS (SELECT label, vec_id, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM p WHERE vec_id % 10 = 0)
    SELECT a.label, round(degrees(acos(least(min(abs(a.x*b.x + a.y*b.y + a.z*b.z)), 1))), 4) AS angle FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def widest_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L14 over every tenth point only, as its SQL; widest_angles_whole takes all."""
    return _widest(_points(spark, sf_dir).where("vec_id % 10 = 0"))


def _widest(p: DataFrame) -> DataFrame:
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    rays = p.select("label", "vec_id", F.array(*(F.col(c) / n for c in "xyz")).alias("ray"))
    return reports.widest_angles(rays, "label", "vec_id", "ray").withColumn("angle", F.round("angle", 4))


@query(f"""WITH {_POINTS}, u AS (SELECT label, vec_id, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM p)
    SELECT a.label, round(degrees(acos(least(min(abs(a.x*b.x + a.y*b.y + a.z*b.z)), 1))), 4) AS angle FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def widest_angles_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest angle in each track; tracks are the labels' points."""
    return _widest(_points(spark, sf_dir))


@query("""WITH s AS (SELECT CASE c_nationkey % 4 WHEN 0 THEN 'equirectangular' WHEN 1 THEN 'dual_fisheye' WHEN 2 THEN 'perspective' ELSE 'other' END AS kind, floor(c_acctbal)::BIGINT AS w, c_nationkey * 200 AS h FROM customer WHERE c_mktsegment <> 'BUILDING'),
    v AS (SELECT *, greatest(w, h) AS edge, CASE kind WHEN 'equirectangular' THEN ceil(w / 4 / 256) * 256 WHEN 'dual_fisheye' THEN ceil(greatest(w, h) / 2 / 256) * 256 ELSE 0 END AS view FROM s WHERE w <> 0 AND h <> 0)
    SELECT greatest(2048, coalesce(max(CASE kind WHEN 'perspective' THEN 2048 WHEN 'equirectangular' THEN greatest(2048, ceil(w / 256) * 256) ELSE greatest(2048, ceil(edge / 256) * 256) END), 2048))::BIGINT AS feature_size,
    greatest(8192, coalesce(max(CASE kind WHEN 'perspective' THEN 8192 WHEN 'equirectangular' THEN 32768 ELSE 16384 END), 8192))::BIGINT AS feature_count,
    greatest(2048, coalesce(max(CASE kind WHEN 'equirectangular' THEN greatest(2048, least(4096, ceil(w / 256) * 256)) WHEN 'dual_fisheye' THEN greatest(2048, least(3072, ceil(edge / 256) * 256)) ELSE 2048 END), 2048))::BIGINT AS mask_size,
    greatest(1024, coalesce(max(least(4096, greatest(1024, view))) FILTER (view > 0), 1024))::BIGINT AS view_size FROM v""")
def resolution_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the enabled sources need of four settings."""
    kind = F.when(F.col("c_nationkey") % 4 == 0, "equirectangular").when(F.col("c_nationkey") % 4 == 1, "dual_fisheye").when(F.col("c_nationkey") % 4 == 2, "perspective").otherwise("other")
    c = table(spark, sf_dir, "customer").select(kind.alias("kind"), F.floor("c_acctbal").alias("w"), (F.col("c_nationkey") * 200).alias("h"), (F.col("c_mktsegment") != "BUILDING").alias("on"))
    return reports.resolution_needs(c, "kind", "w", "h", "on")


@query("""SELECT arg_min(l_suppkey, (-n, l_suppkey)) AS l_suppkey FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def reference_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent camera."""
    return reports.reference_camera(table(spark, sf_dir, "lineitem"), "l_suppkey", F.lit(False))


@query()
def spatial_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames chosen one after the other, and bridges."""
    f = frames(spark, sf_dir)
    running = F.sum("value").over(Window.partitionBy("user_id").orderBy("t"))
    c = f.select("user_id", F.col("event_id").alias("frame"), (F.col("t") * 1e6).cast("long").alias("t"), running.alias("position"), F.col("value").alias("quality"), (F.col("value") > 5).alias("valid"), (F.col("event_type") != "error").alias("bridgeable"))
    return select.spatial_selection(c, "user_id", 500.0, 40, 2 * 86400.0)


@query(f"""WITH {_POINTS}, w AS (SELECT count(*) AS n, sqrt((quantile_cont(x, 0.95) - quantile_cont(x, 0.05))**2 + (quantile_cont(z, 0.95) - quantile_cont(z, 0.05))**2) AS whole FROM p), b AS (SELECT (floor(y / 0.05::DOUBLE) + 0.5) * 0.05::DOUBLE AS candidate, count(*) AS n FROM p GROUP BY floor(y / 0.05::DOUBLE) ORDER BY n DESC, floor(y / 0.05::DOUBLE) LIMIT 20),
    g AS (SELECT candidate, count(*) AS support, sqrt((quantile_cont(x, 0.95) - quantile_cont(x, 0.05))**2 + (quantile_cont(z, 0.95) - quantile_cont(z, 0.05))**2) AS span, quantile_cont(y, 0.5) AS height FROM p JOIN b ON abs(y - candidate) <= 0.15::DOUBLE GROUP BY 1),
    s AS (SELECT *, span / whole AS ratio, support >= greatest(20, 0.005 * n) AND span >= 0.25 * whole AS supported, support * (span / whole) AS score FROM g, w), d AS (SELECT *, supported AND score >= 0.9 * max(score) FILTER (supported) OVER () AS dominant FROM s)
    SELECT round(candidate, 6) AS candidate, support, round(span, 6) AS span, round(height, 6) AS height, round(ratio, 6) AS ratio, supported, round(score, 6) AS score, dominant, dominant AND height = min(height) FILTER (dominant) OVER () AS chosen FROM d""")
def ground_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate ground heights of a scene by themselves; A22 itself is ground_position."""
    g = spatial.ground_mode(_points(spark, sf_dir), "y", "x", "z", least=20)
    return g.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in g.dtypes))
