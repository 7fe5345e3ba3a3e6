"""What round 3's findings named: large ids, odd times, groups and copies that grow."""

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import expr
from fieldloom.operators import audits, graph, rigs, spatial, work
from fieldloom.plans import small_queries


def test_pair_ids_beyond_doubles_come_back(spark):
    rows = spark.range(4_500_000, 4_501_000).select(F.col("id").alias("a"), (F.col("id") + 1_500_000_000).alias("b")).withColumn("p", expr.pair_id("b", "a"))
    assert rows.where((expr.pair_low("p") != F.col("a")) | (expr.pair_high("p") != F.col("b"))).count() == 0


def test_packet_times_round_to_whole_seconds(spark, tmp_path):
    times = ["2024-01-01 01:59:59.400000", "2024-01-01 01:59:59.600000", "2024-01-01 02:00:00.500000"]
    spark.createDataFrame([(1, t) for t in times], "user_id long, ts string").withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    first = 1_704_067_200 // 7200
    assert sorted((r.pts, r.idx) for r in small_queries.packet_times(spark, str(tmp_path)).collect()) == [(first, 0), (first + 1, 1), (first + 1, 2)]


def test_frame_names_keep_all_digits(spark):
    assert [r[0] for r in spark.createDataFrame([(7,), (1_000_068,), (1_000_069,)], "k long").select(audits.frame_name(F.col("k"))).collect()] == ["frame_000007", "frame_1000068", "frame_1000069"]


def test_nearest_others_by_cells_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(0, 1e-4, (150, 3)) + 2, np.repeat(rng.normal(0, 1, (5, 3)), 20, axis=0), [[500.0, 0, 0]]])
    rows = [(int(k), int(k % 3), *map(float, p)) for k, p in enumerate(xyz)] + [(1000, 7, 0.0, 0.0, 0.0), (1001, 8, 1.0, 1.0, 1.0), (1002, 8, 1.0, 1.0, 1.0), (1003, 0, float("nan"), 0.0, 0.0), (1004, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double, z double")
    want = set()
    for i, g, *a in rows[:-2]:
        d = sorted((sum((p - q) ** 2 for p, q in zip(a, b, strict=True)), j) for j, h, *b in rows[:-2] if h == g and j != i)
        want |= {(i, j) for _, j in d[:3]}
    for direct in (0, 10**9):
        got = spatial.nearest_others(df, df, ["g"], "id", ["x", "y", "z"], 3, full=4, direct=direct)
        assert {(r.id, r.other) for r in got.collect()} == want


def test_nearest_within_meets_each_place_once(spark):
    rng = np.random.default_rng(6)
    a = np.concatenate([rng.uniform(0, 1, (100, 2)), np.full((50, 2), 0.5), [[9.0, 9.0]]])
    b = np.concatenate([rng.uniform(0, 1, (100, 2)), np.full((300, 2), 0.51), rng.normal(0.3, 1e-4, (300, 2))])
    frame = lambda v: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(v)] + [(9999, float("nan"), None)], "id long, x double, y double")
    got = {r.id: (r.match, r.distance) for r in spatial.nearest_within(frame(a), frame(b).withColumnRenamed("id", "o"), ["x", "y"], 0.05, "id", "o", full=8).collect()}
    for k, p in enumerate(a):
        d = np.sqrt(((b - p) ** 2).sum(1))
        j = int(np.lexsort((np.arange(len(b)), d))[0])
        assert got[k][0] == (j if d[j] <= 0.05 else -1) and (d[j] > 0.05 or abs(got[k][1] - d[j]) < 1e-12)
    assert got[9999] == (-1, float("inf")) and len(got) == len(a) + 1


def test_large_captures_are_dealt_over_parts(spark):
    df = spark.createDataFrame([(k, k % 2 if k < 60 else None) for k in range(64)], "id long, c int")
    got = sorted((r.c, r.a, r.b) for r in graph.capture_pairs(df, ["c"], "id", rows=7, pairs=100).collect())
    assert got == sorted((a % 2, a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2)
    assert graph.capture_pairs(df, ["c"], "id", rows=7, pairs=100).rdd.getNumPartitions() > 4


def test_each_make_of_camera_and_region_is_worked_out_once(spark):
    cameras = spark.createDataFrame([(k, "OPENCV_FISHEYE", [1.0, 1.0, 0.0, 0.0, -0.02 * (k % 5), 0.0, 0.0, 0.0], 1.2 if k % 2 else float("nan")) for k in range(40)], "id long, model string, params array<double>, theta double")
    got = {r.id: r.monotone for r in rigs.monotone(cameras, "theta").collect()}
    assert all(got[k] == rigs.is_monotone([1.0, 1.0, 0.0, 0.0, -0.02 * (k % 5), 0.0, 0.0, 0.0], "OPENCV_FISHEYE", 1.2 if k % 2 else float("nan")) for k in range(40))
    images = spark.createDataFrame([(k, 8 + k % 2, 6, "circle", 0.5, 0.5, 0.4, None) for k in range(20)], "id long, width int, height int, kind string, cx double, cy double, r double, operations array<struct<mode string, x double, y double, r double>>")
    keyed = rigs.region_keys(images, "id")
    once = rigs.distinct_regions(keyed, "id")
    assert once.count() == 2
    count = lambda df, key: df.groupBy(key).agg(F.count_if("valid").alias("n"))
    each = {r.id: r.n for r in count(rigs.region_pixels(images, "id"), "id").collect()}
    assert {r.id: r.n for r in keyed.select("id", "key").join(count(rigs.region_pixels(once, "key"), "key"), "key").collect()} == each


def test_rows_are_dealt_in_bounded_parts(spark):
    df = work.dealt(spark.range(1000).withColumn("k", F.col("id") % 100), "k", rows=50)
    assert df.rdd.getNumPartitions() == 20 and df.select("k", F.spark_partition_id().alias("p")).distinct().count() == 100
    assert df.groupBy("k").count().where("count <> 10").count() == 0


def test_eligible_queries_count_once(spark):
    seen = spark.createDataFrame([(1, 0, 1, c, 0.5, 1.0) for c in (1, 2, 2)] + [(2, 0, 1, 1, 0.5, 1.0)] + [(3, 0, p, c, 1.5, 1.0 + p) for p in (1, 2) for c in (1, 2)], "query long, image long, point long, capture long, e double, d double")
    r = graph.heldout_report(seen, spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "query long"), "query", "point", "capture", "e", "d").first()
    assert (r.eligible, r.predicted, r.ambiguous, r.contested, r.within_1) == (4, 1, 1, 1, 1)
