"""Scans of model files: rows as the whole reader gives them, fewer bytes, and errors."""

import struct

import numpy as np
import pytest

from fieldloom.sources import model_files, model_scan


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("models")
    r = np.random.default_rng(1)
    for scene in ("a", "b"):
        (out / scene).mkdir()
        (out / scene / "cameras.bin").write_bytes(struct.pack("<Q", 0))
        points = [struct.pack("<Q3d3BdQ", p, *r.normal(size=3), 1, 2, 250, float(r.random()), n) + struct.pack(f"<{2 * n}i", *range(2 * n)) for p in range(1, 200) for n in [int(r.integers(0, 40))]]
        (out / scene / "points3D.bin").write_bytes(struct.pack("<Q", len(points)) + b"".join(points))
        images = []
        for i in range(1, 12):
            n = int(r.integers(0, 60)) if i != 3 else 0
            seen = [struct.pack("<ddQ", *r.normal(size=2), model_files.NO_POINT[0] if k % 3 == 0 else k) for k in range(n)]
            images.append(struct.pack("<i7di", i, *r.normal(size=7), 1) + f"sources/{'x' * 70}/é{i}.png".encode() + b"\0" + struct.pack("<Q", n) + b"".join(seen))
        (out / scene / "images.bin").write_bytes(struct.pack("<Q", len(images)) + b"".join(images))
    return out


def paths(folder, name):
    return [str(folder / s / name) for s in ("a", "b")]


def read(reader, path, schema, filters=()):
    from pyspark.sql.types import _parse_datatype_string

    made = reader([path], _parse_datatype_string(schema))
    rest = list(made.pushFilters(list(filters)))
    stream = model_scan.Stream(path)
    rows = [row for batch in made.rows(stream, "s") for row in batch.to_pylist()]
    return rows, stream, rest


def test_points_equal_the_whole_reader(spark, folder):
    whole = model_files.read_model(spark, str(folder / "*"))["points"].collect()
    got = model_scan.points(spark, paths(folder, "points3D.bin")).collect()
    assert sorted((r["point3d_id"], r["x"], r["y"], r["z"], r["r"], r["g"], r["b"], r["error"]) for r in got) == sorted((r["point3d_id"], *r["xyz"], *r["rgb"], r["error"]) for r in whole)
    one = model_scan.points(spark, paths(folder, "points3D.bin"), ["point3d_id"]).where("point3d_id IN (5, 7, 999) OR point3d_id = 9")
    assert sorted(r["point3d_id"] for r in one.collect()) == [5, 5, 7, 7, 9, 9]
    plan = model_scan.points(spark, paths(folder, "points3D.bin"), ["point3d_id"]).where("point3d_id > 190")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan model_points[point3d_id#" in text and "Filter (" not in text
    assert plan.count() == 18


def test_observations_equal_the_whole_reader(spark, folder):
    whole = model_files.read_model(spark, str(folder / "*"))["observations"].collect()
    got = model_scan.observations(spark, paths(folder, "images.bin")).collect()
    key = lambda r: (r["image_id"], r["point2d_idx"], r["x"], r["y"], -1 if r["point3d_id"] is None else r["point3d_id"])
    assert sorted(map(key, got)) == sorted(map(key, whole)) and {r["name"] for r in got if r["image_id"] == 4} == {f"sources/{'x' * 70}/é4.png"}
    some = model_scan.observations(spark, paths(folder, "images.bin"), ["image_id", "point3d_id"]).where("image_id IN (2, 4) AND point3d_id IS NOT NULL AND point3d_id <= 20").collect()
    assert sorted((r["image_id"], r["point3d_id"]) for r in some) == sorted((r["image_id"], r["point3d_id"]) for r in whole if r["image_id"] in (2, 4) and r["point3d_id"] is not None and r["point3d_id"] <= 20)


def test_fewer_bytes_are_read(folder):
    path = paths(folder, "points3D.bin")[0]
    rows, stream, _ = read(model_scan.PointReader, path, "point3d_id long")
    assert len(rows) == 199 and stream.taken == 8 + 199 * 51 < stream.size / 3
    path = paths(folder, "images.bin")[0]
    _, every, _ = read(model_scan.ObservationReader, path, "image_id int, x double")
    rows, few, rest = read(model_scan.ObservationReader, path, "image_id int, x double", [model_scan.In(("image_id",), (2,)), model_scan.GreaterThan(("x",), 0.0)])
    assert {r["image_id"] for r in rows} == {2} and few.taken < every.taken / 2 and len(rest) == 1


def test_files_that_are_cut_or_too_long(folder, tmp_path):
    for name, reader, schema in (("points3D.bin", model_scan.PointReader, "point3d_id long"), ("images.bin", model_scan.ObservationReader, "image_id int")):
        data = (folder / "a" / name).read_bytes()
        for k, (content, error) in enumerate(((data + b"\0", ValueError), (data[:-1], EOFError), (data[:100], EOFError), (b"", EOFError))):
            (tmp_path / f"{k}{name}").write_bytes(content)
            with pytest.raises(error):
                read(reader, str(tmp_path / f"{k}{name}"), schema)
        (tmp_path / f"none{name}").write_bytes(struct.pack("<Q", 0))
        assert read(reader, str(tmp_path / f"none{name}"), schema)[0] == []
