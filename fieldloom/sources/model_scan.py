"""Scans of binary model files that read only what is asked for: data sources with pruned columns and pushed filters.

Points and observations lie behind heads that say how long the rest is. A scan reads the heads and seeks past the rest: past all tracks (points), and past the
observations of images that the filters rule out. Rows are made of whole arrays, in Arrow batches; columns that the schema does not name are not made. A file is a
partition; files of many scenes are read side by side. A file that ends too early, or holds bytes behind its last row, is an error.

    points(spark, paths, ["point3d_id"]).where("point3d_id IN (3, 5)")

Executors need this package on their path, as for any Python data source.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from fieldloom.sources.model_files import NO_POINT

#: The layouts of a point's head, an image's head and an observation.
POINT = np.dtype([("point3d_id", "<u8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("error", "<f8"), ("track_length", "<u8")])
IMAGE = np.dtype([("image_id", "<i4"), ("pose", "<f8", 7), ("camera_id", "<i4")])
SEEN = np.dtype([("x", "<f8"), ("y", "<f8"), ("point3d_id", "<u8")])
POINTS = "scene string, point3d_id long, x double, y double, z double, r int, g int, b int, error double, track_length long"
OBSERVATIONS = "scene string, image_id int, name string, camera_id int, point2d_idx int, x double, y double, point3d_id long"
BATCH = 50_000
_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class Stream:
    """A file read from front to end; `taken` counts the bytes that were read, not those sought past."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.path, self.size, self.taken, self.at = path, system.get_file_info(inner).size or 0, 0, 0
        self.file = system.open_input_file(inner)

    def take(self, n: int) -> bytes:
        if self.at + n > self.size:
            raise EOFError(f"{self.path} ends early")
        self.file.seek(self.at)
        data = self.file.read(n)
        self.at, self.taken = self.at + n, self.taken + n
        return data

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.size:
            raise EOFError(f"{self.path} ends early")

    def name(self) -> str:
        out = b""
        while b"\0" not in out:
            out += self.take(min(64, max(1, self.size - self.at)))
        self.at -= len(out) - out.index(b"\0") - 1
        return out[: out.index(b"\0")].decode()

    def end(self) -> None:
        if self.at != self.size:
            raise ValueError(f"bytes behind the last row of {self.path}")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Scan(DataSource):
    def reader(self, schema: StructType) -> DataSourceReader:
        return self.READER(json.loads(self.options["paths"]), schema)


class _Reader(DataSourceReader):
    """Subclasses say in `known` which columns their filters may bind."""

    known: tuple[str, ...] = ()

    def __init__(self, paths: list[str], schema: StructType):
        self.paths, self.columns, self.filters = paths, schema.names, []
        self.arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (*_COMPARE, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in self.known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in self.paths]

    def kept(self, column: str, values: np.ndarray, null: np.ndarray | None = None) -> np.ndarray:
        """Which values the pushed filters let pass; null ones pass none."""
        ok = np.ones(len(values), bool)
        for f in self.filters:
            if f.attribute[0] == column:
                ok &= np.ones(len(values), bool) if isinstance(f, IsNotNull) else np.isin(values, [v for v in f.value if v is not None]) if isinstance(f, In) else _COMPARE[type(f)](values, f.value)
                if null is not None:
                    ok &= ~null
        return ok

    def batch(self, made: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([made[c]().cast(self.arrow.field(c).type) for c in self.columns], schema=self.arrow)

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield from self.rows(Stream(partition.path), partition.path.rsplit("/", 1)[0])


class PointReader(_Reader):
    known = ("point3d_id",)

    def rows(self, stream: Stream, scene: str) -> Iterator[pa.RecordBatch]:
        left = int.from_bytes(stream.take(8), "little")
        while left:
            heads = bytearray()
            for _ in range(min(left, BATCH)):
                head = stream.take(POINT.itemsize)
                heads += head
                stream.skip(8 * int.from_bytes(head[-8:], "little"))
            left -= len(heads) // POINT.itemsize
            rows = np.frombuffer(bytes(heads), POINT)
            rows = rows[self.kept("point3d_id", rows["point3d_id"].astype(np.int64))]
            if len(rows):
                yield self.batch({"scene": lambda rows=rows: pa.array([scene] * len(rows), pa.string())} | {c: lambda rows=rows, c=c: pa.array(np.ascontiguousarray(rows[c]).astype(np.int64 if rows[c].dtype.kind == "u" else float)) for c in POINT.names})
        stream.end()


class ObservationReader(_Reader):
    known = ("image_id", "point3d_id")

    def rows(self, stream: Stream, scene: str) -> Iterator[pa.RecordBatch]:
        for _ in range(int.from_bytes(stream.take(8), "little")):
            head, name = np.frombuffer(stream.take(IMAGE.itemsize), IMAGE)[0], stream.name()
            n = int.from_bytes(stream.take(8), "little")
            if not self.kept("image_id", np.array([head["image_id"]]))[0]:
                stream.skip(n * SEEN.itemsize)
                continue
            for first in range(0, n, BATCH):
                seen = np.frombuffer(stream.take(min(BATCH, n - first) * SEEN.itemsize), SEEN)
                null = seen["point3d_id"] == np.uint64(NO_POINT[0])
                at = np.flatnonzero(self.kept("point3d_id", seen["point3d_id"].astype(np.int64), null))
                if len(at):
                    seen, null, index = seen[at], null[at], at + first
                    one = lambda v, kind, k=len(at): lambda: pa.array([v] * k, kind)
                    yield self.batch({
                        "scene": one(scene, pa.string()), "image_id": one(int(head["image_id"]), pa.int32()), "name": one(name, pa.string()), "camera_id": one(int(head["camera_id"]), pa.int32()),
                        "point2d_idx": lambda index=index: pa.array(index), "x": lambda seen=seen: pa.array(np.ascontiguousarray(seen["x"])), "y": lambda seen=seen: pa.array(np.ascontiguousarray(seen["y"])),
                        "point3d_id": lambda seen=seen, null=null: pa.array(seen["point3d_id"].astype(np.int64), mask=null),
                    })
        stream.end()


class PointScan(_Scan):
    READER = PointReader

    @classmethod
    def name(cls) -> str:
        return "model_points"

    def schema(self) -> str:
        return POINTS


class ObservationScan(_Scan):
    READER = ObservationReader

    @classmethod
    def name(cls) -> str:
        return "model_observations"

    def schema(self) -> str:
        return OBSERVATIONS


def _read(spark: SparkSession, source: type[_Scan], whole: str, paths: list[str], columns: list[str] | None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    kinds = dict(c.split(" ") for c in whole.split(", "))
    asked = columns or list(kinds)
    return spark.read.format(source.name()).schema(", ".join(f"{c} {kinds[c]}" for c in asked)).option("paths", json.dumps(paths)).load()


def points(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """POINTS (or some of its columns) of points3D.bin files, without their tracks. Filters on point3d_id are applied while reading."""
    return _read(spark, PointScan, POINTS, paths, columns)


def observations(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """OBSERVATIONS (or some of its columns) of images.bin files. Filters on image_id skip images, those on point3d_id rows; other images' observations are sought past."""
    return _read(spark, ObservationScan, OBSERVATIONS, paths, columns)
