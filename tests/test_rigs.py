"""Camera systems of two lenses against matrices, and masks shared by images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import rigs

LENS = "rec int, lens int, xi double, fx double, fy double, cx double, cy double, yaw double, pitch double, roll double, tx double, ty double, tz double, ref_width int, ref_height int, distortion array<double>, distortion_model string"
CROP = "rec int, source_width int, source_height int, cropped_width int, cropped_height int"


def about(axis, a):
    c, s = math.cos(a), math.sin(a)
    return np.array({"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis])


def pose(yaw, pitch, roll, first):
    r = about("y", math.pi / 2 + math.radians(pitch)) @ about("z", math.radians(yaw)) @ about("x", math.radians(roll))
    return r @ about("z", math.pi) if first else r


def lens(rec, k, r, width=2000, height=900):
    return (rec, k, 1.1, 700.0, 701.0, 500.0 + 1000 * k, 450.0, *(float(v) for v in r.normal(size=3) * 20 + [180 * k, 0, 0]), *(float(v) for v in r.normal(size=3)), width, height, [0.1, 0.2], "RADTAN")


def test_systems_equal_matrices(spark):
    r = np.random.default_rng(1)
    rows = [lens(i, k, r) for i in range(30) for k in (0, 1)]
    crops = spark.createDataFrame([(i, 1000, 900, 960, 800) for i in range(0, 30, 2)], CROP)
    got = {(x["rec"], x["lens"]): x for x in rigs.camera_systems(spark.createDataFrame(rows, LENS), ["rec"], crops).collect()}
    assert len(got) == 60
    for i in range(30):
        a, b = rows[2 * i], rows[2 * i + 1]
        turn = pose(*b[7:10], False) @ pose(*a[7:10], True).T
        one, two = got[i, 0], got[i, 1]
        assert two["rotation"] == pytest.approx(turn.ravel().tolist(), abs=1e-12) and two["translation"] == pytest.approx((np.array(b[10:13]) - turn @ np.array(a[10:13])).tolist(), abs=1e-12)
        assert one["rotation"] == np.eye(3).ravel().tolist() and one["translation"] == [0.0, 0.0, 0.0]
        assert (one["width"], one["height"], two["cx"], two["cy"]) == ((960, 800, 480.0, 400.0) if i % 2 == 0 else (1000, 900, 500.0, 450.0))
        assert one["cx"] == two["cx"] and two["distortion"] == [0.1, 0.2]


@pytest.mark.parametrize(("change", "said"), [(lambda a, b: [a], "two lenses"), (lambda a, b: [a, b, b], "two lenses"), (lambda a, b: [a, (*b[:13], 2002, *b[14:])], "one reference size"), (lambda a, b: [(*a[:13], 2001, *a[14:]), (*b[:13], 2001, *b[14:])], "cannot be halved"), (lambda a, b: [(*a[:13], 1998, *a[14:]), (*b[:13], 1998, *b[14:])], "another size")])
def test_records_that_are_refused(spark, change, said):
    r = np.random.default_rng(1)
    rows = change(lens(0, 0, r), lens(0, 1, r))
    with pytest.raises(Exception, match=said):
        rigs.camera_systems(spark.createDataFrame(rows, LENS), ["rec"], spark.createDataFrame([(0, 1000, 900, 960, 800)], CROP)).collect()


def test_masks_are_made_once_for_each_key(spark):
    circle, full = ("circle", 50.0, 40.0, 30.0), ("full", None, None, None)
    records = [(f"i{k}", 100, 80, circle if k % 2 else full, (10, 20, 60, 50) if k % 3 else None) for k in range(24)] + [("far", 100, 80, ("circle", 50.0, 40.0, 5.0), (0, 0, 10, 10)), ("unused", 5, 5, full, None)]
    df = spark.createDataFrame(records, "name string, width int, height int, region struct<kind string, cx double, cy double, radius double>, crop struct<left int, top int, width int, height int>")
    images = spark.createDataFrame([(r[0],) for r in records[:-1]] + [("i0",)], "name string")
    keyed = rigs.mask_keys(images, df)
    assert keyed.count() == 25 and keyed.select("key").distinct().count() == 5
    assert rigs.mask_rows(keyed).groupBy("key", "y").count().where("count > 1").count() == 0
    got = {r["name"]: r for r in rigs.shared_masks(images, df).collect()}
    for name, width, height, region, crop in records[:-1]:
        yy, xx = np.mgrid[:height, :width]
        mask = (xx - 50.0) ** 2 + (yy - 40.0) ** 2 <= region[3] ** 2 if region[0] == "circle" else np.ones((height, width), bool)
        if crop:
            mask = mask[crop[1] : crop[1] + crop[3], crop[0] : crop[0] + crop[2]]
        assert (got[name]["width"], got[name]["height"], got[name]["pixels"]) == (mask.shape[1], mask.shape[0], int(mask.sum()))
    with pytest.raises(Exception, match="no record of the image i99"):
        rigs.shared_masks(images.unionByName(images.limit(1).select(F.lit("i99").alias("name"))), df).collect()
