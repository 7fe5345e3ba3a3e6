"""What round 4's findings named: what queries move and write."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph, repair, work
from fieldloom.plans import camera_queries


def shuffled_rows(spark, run):
    """Rows that the stages of run() wrote to be shuffled."""
    sc = spark.sparkContext
    store, none, kinds = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda l: [l.apply(k) for k in range(l.size())])(store.stageList(None, False, False, none, kinds))}
    before = stages()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.fixture
def no_small_tables(spark):
    """Tables of more than 100 kB are not broadcast, as large ones are not."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_captures_move_as_lists(spark):
    """A capture of thirty blocks: each block meets all others, but its images don't move as rows once for each of them."""
    df = spark.range(3000).selectExpr("id % 2999 AS id", "id div 100000 AS c")
    pairs = graph.capture_pairs(df, ["c"], "id", rows=100, pairs=1e5)
    assert shuffled_rows(spark, lambda: pairs.write.format("noop").mode("overwrite").save()) < 6000
    assert pairs.count() == 3000 * 2999 // 2 - 1 and pairs.where("a >= b").isEmpty()  # one id is there twice
    assert pairs.dropDuplicates().count() == 2999 * 2998 // 2


def test_pairs_of_captures_that_are_unknown_or_without_images(spark):
    rows = [(1, "x", 5), (1, "x", 3), (1, None, 4), (1, None, 6), (2, "x", None), (2, "x", 7), (2, "x", 8), (None, "x", 1), (None, "x", 2), (3, "x", 9), (3, "x", 9)]
    df = spark.createDataFrame(rows, "c int, d string, id long")
    for size in (1, 16384):
        assert sorted((r.c, r.d, r.a, r.b) for r in graph.capture_pairs(df, ["c", "d"], "id", rows=size).collect()) == [(1, "x", 3, 5), (2, "x", 7, 8)]



def test_repair_moves_keys_and_touched_tracks_only(spark, tmp_path, no_small_tables):
    """Images and observations lie in the same buckets: neither moves to be joined by image, and of the observations only those of touched tracks move by point."""
    lines = spark.range(30_000).selectExpr("id div 4 AS l_orderkey", "id * 7919 % 1000 AS l_partkey", "(id * 31 + id div 7) % 40 AS l_suppkey", "int(id % 4) AS l_linenumber")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    moved = shuffled_rows(spark, lambda: camera_queries.poses_repaired(spark, str(tmp_path)).write.format("noop").mode("overwrite").save())
    assert moved < 2.5 * 30_000  # once by image, and what is touched


def test_recovered_tracks_do_not_move_the_model(spark, no_small_tables):
    """The rules of recovered tracks look up what the tracks name, not every observation and image."""
    images = spark.range(40_000).select(F.col("id").alias("image_id"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    seen = spark.range(200_000).selectExpr("id % 40000 AS image_id", "id div 40000 AS idx", "IF(id % 3 = 0, id, NULL) AS point3d_id")
    images, seen = work.stored(images, "images"), work.stored(seen, "seen")
    found = []
    entries = work.stored(spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1500, 0), (2, 5, 99)], "old_id long, image_id long, idx long"), "entries")
    recovered = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3])], "old_id long, rgb array<int>")
    moved = shuffled_rows(spark, lambda: found.extend(repair.track_faults(images, seen, entries, recovered, "a").collect()))
    assert sorted(map(tuple, found)) == [("a recovered track may use primary observations only", "1"), ("recovered observation already belongs to a point", "1"), ("recovered observation already belongs to a point", "1"), ("recovered observation that does not exist", "2")] and moved < 1000


def test_likely_lets_all_members_pass_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("IF(id = 7, NULL, id * 1000003 - 5000000000) AS k", "id AS v")
    members = rows.where("v % 40 = 0 AND k IS NOT NULL").select("k")
    passed = work.likely(rows, members, "k")
    assert passed.columns == ["k", "v"] and passed.where("v % 40 = 0").count() == members.count()
    assert passed.count() < 20_000 / 40 + 20_000 / 8 and work.likely(rows, members.limit(0), "k").isEmpty()


def test_work_tables_in_buckets_are_cleared(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), "id").repartition(3, "k")
    made = work.bucketed(rows, "k", 3)
    counted = made.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert counted.where("n <> 10").isEmpty() and counted.count() == 100
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    names, paths = list(spark.sparkContext._fieldloom_buckets), list(spark.sparkContext._fieldloom_work)
    assert names and all(spark.catalog.tableExists(n) for n in names)
    work.cleared(spark)
    assert not any(spark.catalog.tableExists(n) for n in names) and not any(Path(p.removeprefix("file:")).exists() for p in paths)
