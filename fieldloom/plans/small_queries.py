"""Registered queries of small operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import expr
from fieldloom.operators import graph, reports, scene, select, temporal
from fieldloom.plans.audit_queries import rounded
from fieldloom.plans.queries import query, table

UNIT = "x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z"


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the unit vector of the first components."""
    at = [F.get("embedding", F.lit(k)).cast("double") for k in range(3)]
    n = expr.norm(at)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(*(c / n for c in at)).alias("axis"))


@query("""WITH p AS (SELECT user_id, epoch(ts)::BIGINT // 7200 AS pts FROM events) SELECT user_id, pts, row_number() OVER (PARTITION BY user_id ORDER BY pts) - 1 AS idx, coalesce(pts > lag(pts) OVER (PARTITION BY user_id ORDER BY pts), true) AS monotone FROM p""")
def packet_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of each stream by presentation time, in whole seconds to the nearest, halves to even; times repeat."""
    seconds = F.bround(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    p = table(spark, sf_dir, "events").select("user_id", F.call_function("div", seconds, F.lit(7200)).alias("pts"))
    return temporal.timings(p, "user_id", "pts")


@query("""SELECT s_suppkey, unnest(range(least(ceil(s_acctbal / 100 / 7.5::DOUBLE), 5)::INT)) * 7.5::DOUBLE AS target FROM supplier WHERE s_acctbal > 0""")
def interval_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target times of each source, the first five."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("seconds"))
    return select.interval_targets(s, "seconds", 7.5, 5).select("s_suppkey", "target")


@query("""SELECT DISTINCT c_custkey, greatest(0, least(c_custkey % 100 - 6 + 3 * i, 99)) AS frame FROM customer, range(5) r(i)""")
def neighbour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five frames around each centre, kept within the recording."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(select.neighbourhood(F.col("c_custkey") % 100, 12, 5, F.lit(99))).alias("frame"))
    return c.withColumn("frame", F.col("frame").cast("long"))


@query("""WITH e AS (SELECT user_id, event_id, value, CASE WHEN event_type <> 'click' THEN value END AS motion FROM events), r AS (SELECT *, coalesce(motion <= 5, true) AS safe FROM e)
    SELECT user_id, event_id AS best FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY safe DESC, CASE WHEN safe THEN value ELSE -motion END DESC, event_id) = 1""")
def shutter_safe_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharpest frame of each source that does not move too fast."""
    e = table(spark, sf_dir, "events").withColumn("motion", F.when(F.col("event_type") != "click", F.col("value")))
    return select.shutter_safe_pick(e, ["user_id"], "value", "motion", "event_id", 5.0)


@query("""SELECT user_id, event_id, true AS fallback FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3 = 0""")
def fallback_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame of each source."""
    return select.uniform_fallback(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 3)


@query("""SELECT l_suppkey, l_linenumber, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax, count(*) AS sensors FROM lineitem GROUP BY 1, 2""")
def capture_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the mean place of the sensors of each capture."""
    return rounded(graph.capture_centres(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"], ["l_quantity", "l_tax"]))


@query(f"""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), u AS (SELECT vec_id, label, {UNIT} FROM p)
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 WHERE a.label % 2 = b.label % 2 AND acos(greatest(least(a.x*b.x + a.y*b.y + a.z*b.z, 1), -1)) > 0.7::DOUBLE + 0.6::DOUBLE""")
def impossible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: pairs of one capture whose views cannot meet; the source is the label's parity."""
    side = lambda s, theta: _axes(spark, sf_dir).select(F.col("vec_id").alias(s), (F.col("label") % 2).alias(f"source_{s}"), F.lit(1).alias(f"capture_{s}"), F.col("axis").alias(f"axis_{s}"), F.lit(theta).alias(f"theta_{s}"))
    ends = side("a", 0.7).join(side("b", 0.6), F.col("b") == F.col("a") + 1)
    return graph.impossible_pairs(ends).select("a", "b")


@query("""SELECT l_returnflag, 'all' AS prompt, count(*) AS n, round(avg(l_discount), 6) AS mean, max(l_discount) AS largest, count(*) FILTER (l_quantity > 40) AS warnings FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'person', count(*), round(avg(l_tax), 6), NULL, NULL FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'tripod', count(*), round(avg(l_discount * l_tax), 6), NULL, NULL FROM lineitem GROUP BY 1""")
def mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and warnings of masks, and the mean of each prompt."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", F.create_map(F.lit("person"), F.col("l_tax"), F.lit("tripod"), F.col("l_discount") * F.col("l_tax")).alias("prompts"), (F.col("l_quantity") > 40).alias("warned"))  # noqa: E741
    whole, each = reports.mask_statistics(l, ["l_returnflag"], "l_discount", "prompts", "warned")
    return rounded(whole.withColumn("prompt", F.lit("all")).unionByName(each, allowMissingColumns=True))


@query("""WITH p AS (SELECT l_partkey, sum(l_quantity) AS texture, count(*) % 13 AS angle, count(DISTINCT l_suppkey % 5) AS captures FROM lineitem GROUP BY 1), c AS (SELECT quantile_cont(texture, 0.2) AS cut FROM p)
    SELECT subset, c AS captures, d AS angle, count(*) FILTER (p.captures >= c AND p.angle >= d AND (subset = 'all' OR texture <= cut)) AS n FROM p, c, (SELECT unnest(['all', 'weak']) AS subset), (SELECT unnest([3, 4]) AS c), (SELECT unnest([6, 8, 10]) AS d) GROUP BY ALL""")
def texture_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points each filter leaves, of all and of weakly textured ones."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("texture"), (F.count(F.lit(1)) % 13).alias("angle"), F.count_distinct(F.col("l_suppkey") % 5).alias("captures"))
    return reports.texture_grid(p, "texture", "angle", "captures")


@query("""WITH m AS (SELECT vec_id % 2 AS model, vec_id // 2 AS place, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE vec_id % 14 <> 1), s AS (SELECT a.model, b.place, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS step FROM m a JOIN m b ON a.model = b.model AND b.place = a.place + 1)
    SELECT model, place, round(step, 6) AS step FROM s QUALIFY count(*) OVER (PARTITION BY place) = 2""")
def common_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between neighbours that both models have."""
    m = table(spark, sf_dir, "embeddings").where("vec_id % 14 <> 1").select((F.col("vec_id") % 2).alias("model"), F.floor(F.col("vec_id") / 2).alias("place"), *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xy")))
    return rounded(reports.common_steps(m, "model", "place", ["x", "y"]))


@query("""SELECT l_suppkey, count(*) AS n, round(quantile_cont(l_discount, 0.5), 6) AS ground, round(quantile_cont(l_tax, 0.5), 6) AS height FROM lineitem WHERE l_quantity < 3 GROUP BY 1 HAVING count(*) >= 3""")
def camera_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground under each camera that sees enough of it."""
    return rounded(reports.ground_per_camera(table(spark, sf_dir, "lineitem").where("l_quantity < 3"), "l_suppkey", "l_discount", "l_tax"))


@query("""WITH e AS (SELECT vec_id, label, [embedding[i]::DOUBLE for i in range(1, 9)] AS v FROM embeddings), n AS (SELECT *, sqrt(v[1]**2 + v[2]**2 + v[3]**2 + v[4]**2) AS n1, sqrt(v[5]**2 + v[6]**2 + v[7]**2 + v[8]**2) AS n2, sqrt(((vec_id - 320.0::DOUBLE) / 500)**2 + ((label - 240.0::DOUBLE) / 510)**2 + 1) AS l FROM e)
    SELECT vec_id, round((1000 + vec_id) / 2 / tan(radians(45)), 6) AS focal, round((vec_id - 320.0::DOUBLE) / 500 / l, 6) AS ray_x, round((label - 240.0::DOUBLE) / 510 / l, 6) AS ray_y, round(1 / l, 6) AS ray_z, round(v[1] * (1 + label), 6) AS quality,
    round(degrees(2 * acos(least(abs((v[1]*v[5] + v[2]*v[6] + v[3]*v[7] + v[4]*v[8]) / n1 / n2), 1))), 4) AS turned, v[1] > 0 AND v[2] > 0 AND label >= 0.5 AND v[3] <= 0.002 AND v[4] <= 1.5 AS sound FROM n""")
def camera_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focal lengths, rays, qualities, angles between orientations and the check of a match's geometry."""
    e = table(spark, sf_dir, "embeddings")
    v = [F.get("embedding", F.lit(k)).cast("double") for k in range(8)]
    ray = expr.pinhole_ray(F.col("vec_id"), F.col("label"), F.lit(500.0), F.lit(510.0), F.lit(320.0), F.lit(240.0))
    turned = expr.rotation_degrees(expr.unit(v[:4]), expr.unit(v[4:]))
    sound = expr.sound_geometry(v[0], v[1], F.col("label").cast("double"), v[2], v[3], F.lit(1.0))
    made = e.select("vec_id", expr.view_focal(1000 + F.col("vec_id"), 90.0).alias("focal"), *(r.alias(f"ray_{c}") for r, c in zip(ray, "xyz", strict=True)), expr.candidate_quality(v[0], F.col("label")).alias("quality"), F.round(turned, 4).alias("turned"), sound.alias("sound"))
    return rounded(made)


_STEPS = """m AS (SELECT vec_id % 2 AS model, vec_id // 2 % 3 AS source, vec_id // 6 * 2 AS capture, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, [embedding[i]::DOUBLE for i in [4, 5, 6, 7]] AS q FROM embeddings WHERE vec_id % 22 <> 1),
    e AS (SELECT DISTINCT vec_id // 2 % 3 AS source, vec_id // 6 * 2 AS capture FROM embeddings), p AS (SELECT source, lag(capture) OVER (PARTITION BY source ORDER BY capture) AS a, capture AS b FROM e),
    s AS (SELECT p.source, f.model, p.a, p.b, sqrt((f.x - t.x)*(f.x - t.x) + (f.y - t.y)*(f.y - t.y) + (f.z - t.z)*(f.z - t.z)) AS distance, degrees(2 * acos(least(abs(list_dot_product(f.q, t.q)) / sqrt(list_dot_product(f.q, f.q)) / sqrt(list_dot_product(t.q, t.q)), 1))) AS rotation
        FROM p JOIN m f ON f.source = p.source AND f.capture = p.a JOIN m t ON t.source = p.source AND t.capture = p.b AND t.model = f.model), w AS (SELECT *, count(*) OVER (PARTITION BY source, a) AS n FROM s), r AS (SELECT * FROM w WHERE n = 2)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", (v % 2).alias("model"), (F.floor(v / 2) % 3).alias("source"), (F.floor(v / 6) * 2).alias("capture"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("centre"), F.transform(F.slice("embedding", 4, 4), lambda x: x.cast("double")).alias("q"))
    return reports.trajectory_steps(e.where("vec_id % 22 <> 1"), e.select("source", "capture").distinct())


@query(f"""WITH {_STEPS} SELECT source, model, count(*) AS n, round(quantile_cont(distance, 0.5), 6) AS distance_p50, round(quantile_cont(distance, 0.95), 6) AS distance_p95, round(max(distance), 6) AS distance_max, round(quantile_cont(rotation, 0.5), 4) AS rotation_p50, round(max(rotation), 4) AS rotation_max FROM r GROUP BY 1, 2""")
def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and rotations of the steps that all models have."""
    d = lambda c, q: F.percentile(c, F.lit(q))
    s = _steps(spark, sf_dir).groupBy("source", "model").agg(F.count(F.lit(1)).alias("n"), d("distance", 0.5).alias("distance_p50"), d("distance", 0.95).alias("distance_p95"), F.max("distance").alias("distance_max"), F.round(d("rotation_degrees", 0.5), 4).alias("rotation_p50"), F.round(F.max("rotation_degrees"), 4).alias("rotation_max"))
    return rounded(s)


@query(f"""WITH {_STEPS} SELECT source, model, a, b, round(distance, 6) AS distance, round(rotation, 4) AS rotation_degrees, row_number() OVER (PARTITION BY source, model ORDER BY distance DESC, a) AS place FROM r QUALIFY place <= 30""")
def largest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 largest steps of each model and source."""
    return rounded(reports.largest_steps(_steps(spark, sf_dir)).withColumn("rotation_degrees", F.round("rotation_degrees", 4)).withColumn("place", F.col("place").cast("long")))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), c AS (SELECT * FROM p WHERE vec_id % 7 = 0), k AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c), s AS (SELECT 1.1 * max(sqrt((c.x - k.x)**2 + (c.y - k.y)**2 + (c.z - k.z)**2)) AS scale FROM c, k),
    m AS (SELECT [quantile_cont(x, 0.5), quantile_cont(y, 0.5), quantile_cont(z, 0.5)] AS m, [quantile_cont(x, 0.025), quantile_cont(y, 0.025), quantile_cont(z, 0.025)] AS lo, [quantile_cont(x, 0.975), quantile_cont(y, 0.975), quantile_cont(z, 0.975)] AS hi FROM p), d AS (SELECT sqrt((x - m[1])**2 + (y - m[2])**2 + (z - m[3])**2) AS d FROM p, m),
    r AS (SELECT count(*) AS n, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.95) AS p95, quantile_cont(d, 0.99) AS p99, max(d) AS most FROM d)
    SELECT round(scale, 6) AS scene_scale_camera, n AS points, round(p50, 6) AS radius_median, round(p95, 6) AS radius_p95, round(p99, 6) AS radius_p99, round(most, 6) AS radius_max, round(p99 / p50, 6) AS radius_p99_to_median, [round(v, 4) for v in lo] AS bbox_min, [round(v, 4) for v in hi] AS bbox_max,
        round(sqrt((hi[1] - lo[1])**2 + (hi[2] - lo[2])**2 + (hi[3] - lo[3])**2) / 2, 6) AS bbox_radius, round(n / ((hi[1] - lo[1]) * (hi[2] - lo[2]) * (hi[3] - lo[3])), 6) AS point_density FROM s, m, r""")
def training_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents, radii, box and density of a scene; its percentiles by counting."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")))
    return rounded(scene.training_profile(e, e.where("vec_id % 7 = 0")))
