"""Small functions that queries do not reach, on cases worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import expr
from fieldloom.operators import audits, graph, rigs, work


def test_orders_and_samples(spark):
    s = spark.createDataFrame([(3, True, 1, 5, "b"), (1, True, 1, 5, "A"), (2, False, 0, 1, "c"), (4, True, 0, 9, "a")], "id int, enabled boolean, ordinal int, created_at int, name string")
    assert [r["id"] for r in audits.in_project_order(s).collect()] == [4, 1, 3]
    assert [r["name"] for r in audits.by_name(s, "name").collect()] == ["A", "a", "b", "c"]
    assert [r["id"] for r in audits.by_name(s, "name", newest="created_at").collect()] == [4, 1, 3, 2]
    many = spark.range(100)
    one, other = ([r["id"] for r in audits.sampled(many.repartition(n), 10, ["id"], 3).collect()] for n in (1, 7))
    assert one == other == sorted(set(one)) and len(one) == 10 and audits.sampled(many, 1000, ["id"]).count() == 100
    assert [r["id"] for r in audits.sampled(many, 10, ["id"], 4).collect()] != one


def test_primary_images(spark):
    images = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "image_id int, source_id string")
    assert audits.initial_pair(images, "p", 0, 0) is None and audits.initial_pair(images, "p", 1, 2) == (1, 2)
    for pair, said in (((1, 0), "both initial images"), ((1, 3), "of the primary source"), ((1, 9), "of the primary source")):
        with pytest.raises(ValueError, match=said):
            audits.initial_pair(images, "p", *pair)
    mine, counts = audits.primary_only(images, "p")
    assert sorted(r["image_id"] for r in mine.collect()) == [1, 2] and tuple(counts.first()) == (2, 1)


def test_same_rows_and_digests(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert graph.same_rows(a, a.orderBy(F.desc("k"))) and not graph.same_rows(a, a.distinct()) and not graph.same_rows(a.distinct(), a)
    got = {r["d"] for r in a.select(expr.row_digest("v", "k").alias("d")).collect()}
    assert got == {hashlib.sha256(b'{"k":1,"v":"x"}').hexdigest(), hashlib.sha256(b'{"k":2}').hexdigest()}


def test_calibrations_and_sensors(spark):
    records = spark.createDataFrame([("r", 3, 5, "old"), ("r", 6, 1, "first"), ("r", 6, 4, "best"), ("s", 3, 0, "only")], "rec string, version int, place int, what string")
    assert {r["rec"]: r["what"] for r in rigs.best_calibration(records, ["rec"], "version", "place").collect()} == {"r": "best", "s": "only"}
    half = math.sqrt(0.5)
    sensors = spark.createDataFrame([("a\\front", None, None, True), ("a/back", [half, 0.0, half, 0.0], [0.0, 0.0, 2.0], False)], "image_prefix string, rotation array<double>, translation array<double>, ref_sensor boolean")
    centres = {r["image_prefix"]: r["centre"] for r in rigs.sensor_centres(sensors).collect()}
    assert centres["a/front"] == [0.0, 0.0, 0.0] and centres["a/back"] == pytest.approx([2.0, 0.0, 0.0])
    axes = {r["image_prefix"]: r["axis"] for r in rigs.sensor_axes(sensors).collect()}
    assert axes["a/front"] == [0.0, 0.0, 1.0] and axes["a/back"] == pytest.approx([-1.0, 0.0, 0.0])
    grey = spark.createDataFrame([(1, 0, 0, 127), (1, 1, 0, 128)], "i int, px int, py int, v int")
    assert [r["valid"] for r in rigs.bitmap_pixels(grey, "i", "v").collect()] == [False, True]


def test_rays_and_sizes(spark):
    one = spark.range(1)
    half = math.sqrt(0.5)
    ray = expr.ray_to_world([F.lit(0.0), F.lit(0.0), F.lit(1.0)], [F.lit(half), F.lit(0.0), F.lit(half), F.lit(0.0)])
    assert list(one.select(*ray).first()) == pytest.approx([-1.0, 0.0, 0.0], abs=1e-12)
    size = (F.lit(100.0), F.lit(50.0)), (F.lit(200.0), F.lit(25.0))
    assert list(one.select(*expr.rescaled(F.lit(10.0), F.lit(20.0), F.lit(3.0), F.lit(4.0), *size)).first()) == [20.0, 10.0, 6.0, 2.0]


def test_work_tables_are_removed(spark, tmp_path):
    made = work.stored(spark.range(3), "gone")
    path = spark.sparkContext._fieldloom_work[-1]
    assert made.count() == 3
    keep, spark.sparkContext._fieldloom_work = spark.sparkContext._fieldloom_work[:-1], [path]
    work.cleared(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    spark.sparkContext._fieldloom_work = keep
