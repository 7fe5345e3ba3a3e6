"""Sparse models, containers, sensor records and side files as DataFrames; and the writers of models.

The binary model files are read by Spark's binaryFile source and parsed in Arrow batches: one
row per file in, many rows out. Files are models of one scene; scenes are what is spread over tasks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Camera models by number, and how many parameters each has.
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 3),
    1: ("PINHOLE", 4),
    2: ("SIMPLE_RADIAL", 4),
    3: ("RADIAL", 5),
    4: ("OPENCV", 8),
    5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12),
    7: ("FOV", 5),
    8: ("SIMPLE_RADIAL_FISHEYE", 4),
    9: ("RADIAL_FISHEYE", 5),
    10: ("THIN_PRISM_FISHEYE", 12),
}
#: Both stand for no point.
NO_POINT = (2**64 - 1, -1)

CAMERAS = "camera_id int, model string, model_id int, width long, height long, params array<double>"
IMAGES = "ord long, image_id int, qvec array<double>, tvec array<double>, camera_id int, name string"
OBSERVATIONS = "image_id int, point2d_idx int, x double, y double, point3d_id long"
POINTS = "point3d_id long, xyz array<double>, rgb array<int>, error double"
TRACKS = "point3d_id long, image_id int, point2d_idx int"


def parse_cameras(data: bytes) -> Iterator[tuple]:
    (n,), at = struct.unpack_from("<Q", data), 8
    for _ in range(n):
        ident, model, width, height = struct.unpack_from("<iiQQ", data, at)
        if model not in CAMERA_MODELS:
            raise ValueError(f"unknown camera model {model}")
        name, count = CAMERA_MODELS[model]
        yield ident, name, model, width, height, list(struct.unpack_from(f"<{count}d", data, at + 24))
        at += 24 + 8 * count


def parse_images(data: bytes, observations: bool) -> Iterator[tuple]:
    (n,), at = struct.unpack_from("<Q", data), 8
    for k in range(n):
        head = struct.unpack_from("<i7di", data, at)
        end = data.index(b"\0", at + 64)
        name = data[at + 64 : end].decode("utf-8", "replace")
        (count,) = struct.unpack_from("<Q", data, end + 1)
        at = end + 9
        if observations:
            for i in range(count):
                x, y, point = struct.unpack_from("<ddQ", data, at + 24 * i)
                yield head[0], i, x, y, None if point in NO_POINT else point
        else:
            yield k, head[0], list(head[1:5]), list(head[5:8]), head[8], name
        at += 24 * count


def parse_points(data: bytes, tracks: bool) -> Iterator[tuple]:
    (n,), at = struct.unpack_from("<Q", data), 8
    for _ in range(n):
        ident, x, y, z, r, g, b, error, count = struct.unpack_from("<Q3d3BdQ", data, at)
        at += 51
        if tracks:
            for i in range(count):
                yield (ident, *struct.unpack_from("<ii", data, at + 8 * i))
        else:
            yield ident, [x, y, z], [r, g, b], error
        at += 8 * count
    if at != len(data):
        raise ValueError("bytes behind the last point")


def _parsed(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    names = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, data in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                for row in parse(bytes(data)):
                    rows.append((scene.rsplit("/", 1)[0], *row))
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=["scene", *names])
                        rows = []
                frame = pd.DataFrame(rows, columns=["scene", *names])
                yield frame.astype({"point3d_id": "Int64"}) if "point3d_id" in names else frame

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"scene string, {schema}")


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """cameras, images, observations, points and tracks of all models in a folder (a glob names several). Each table reads its file only when used."""
    return {
        "cameras": _parsed(spark, f"{folder}/cameras.bin", CAMERAS, parse_cameras),
        "images": _parsed(spark, f"{folder}/images.bin", IMAGES, lambda d: parse_images(d, False)),
        "observations": _parsed(spark, f"{folder}/images.bin", OBSERVATIONS, lambda d: parse_images(d, True)),
        "points": _parsed(spark, f"{folder}/points3D.bin", POINTS, lambda d: parse_points(d, False)),
        "tracks": _parsed(spark, f"{folder}/points3D.bin", TRACKS, lambda d: parse_points(d, True)),
    }


def camera_bytes(rows: list) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in sorted(rows, key=lambda r: r["camera_id"]):
        out.append(struct.pack(f"<iiQQ{len(r['params'])}d", r["camera_id"], r["model_id"], r["width"], r["height"], *r["params"]))
    return b"".join(out)


def image_bytes(rows: list) -> bytes:
    """rows with observations (idx, x, y, point); kept in their first order (ord), on which readers rely."""
    out = [struct.pack("<Q", len(rows))]
    for r in sorted(rows, key=lambda r: r["ord"]):
        seen = sorted(r["observations"] or [], key=lambda o: o["point2d_idx"])
        out.append(struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(seen)))
        out += [struct.pack("<ddQ", o["x"], o["y"], NO_POINT[0] if o["point3d_id"] is None else o["point3d_id"]) for o in seen]
    return b"".join(out)


def point_bytes(rows: list) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in sorted(rows, key=lambda r: r["point3d_id"]):
        track = r["track"] or []
        out.append(struct.pack("<Q3d3BdQ", r["point3d_id"], *r["xyz"], *r["rgb"], r["error"], len(track)) + b"".join(struct.pack("<ii", t["image_id"], t["point2d_idx"]) for t in track))
    return b"".join(out)


def model_files(model: dict[str, DataFrame]) -> DataFrame:
    """scene, file, content: the three files of each model, made in one task per scene and kind."""
    seen = model["observations"].groupBy("scene", "image_id").agg(F.collect_list(F.struct("point2d_idx", "x", "y", "point3d_id")).alias("observations"))
    track = model["tracks"].groupBy("scene", "point3d_id").agg(F.sort_array(F.collect_list(F.struct("image_id", "point2d_idx"))).alias("track"))
    parts = (("cameras.bin", model["cameras"], camera_bytes), ("images.bin", model["images"].join(seen, ["scene", "image_id"], "left"), image_bytes), ("points3D.bin", model["points"].join(track, ["scene", "point3d_id"], "left"), point_bytes))
    out = None
    for name, rows, make in parts:
        pack = F.udf(lambda group, make=make: make([r.asDict() for r in group]), "binary")
        one = rows.groupBy("scene").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "scene"])).alias("rows")).select("scene", F.lit(name).alias("file"), pack("rows").alias("content"))
        out = one if out is None else out.union(one)
    return out


def thinned_preview(points: DataFrame, most: int) -> DataFrame:
    """ordinal, stride (20 bytes): position as float32, colour, a pad byte and error, of at most `most` points, evenly spaced by id."""
    from fieldloom.operators.spatial import thinned

    layout = struct.Struct("<3f3Bxf")

    @F.pandas_udf("binary")
    def pack(xyz: pd.Series, rgb: pd.Series, error: pd.Series) -> pd.Series:
        return pd.Series([layout.pack(*p, *c, e) for p, c, e in zip(xyz, rgb, error, strict=True)], dtype=object)

    return thinned(points, ["point3d_id"], most, "stride").select("point3d_id", pack("xyz", "rgb", "error").alias("stride"))


def match_list(pairs: DataFrame) -> DataFrame:
    """One text block per pair: both names, a line for each match, an empty line. Pairs without matches are skipped. matches: array<struct<a,b>>."""
    lines = F.transform("matches", lambda m: F.concat_ws(" ", m["a"].cast("string"), m["b"].cast("string")))
    return pairs.where(F.size("matches") > 0).select(F.concat(F.concat_ws(" ", "name_a", "name_b"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


# --- containers and sensors ----------------------------------------------------------------


def boxes(data: bytes) -> list[tuple[str, int, int, int]]:
    """Top-level MP4 boxes: type, offset, header size, size. Size 1 has 64 bits, size 0 ends with the file; an odd type ends the scan."""
    out, at = [], 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if not re.fullmatch(rb"[a-zA-Z0-9 ]{4}", kind):
            break
        if size == 1 and at + 16 <= len(data):
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = len(data) - at
        if size < head:
            break
        out.append((kind.decode(), at, head, size))
        at += size
    return out


def container_boxes(spark: SparkSession, path: str) -> DataFrame:
    """path, box_type, offset, header_size, total_size."""
    scan = F.udf(boxes, "array<struct<box_type: string, offset: long, header_size: int, total_size: long>>")
    return spark.read.format("binaryFile").load(path).select("path", F.inline(scan("content")))


def imu_samples(data: bytes, raw: bool) -> list[tuple]:
    """Time in microseconds, three accelerations, three rates: doubles, or unsigned shorts around 32768."""
    size, form = (20, "<Q6H") if raw else (56, "<Q6d")
    off = 32768 if raw else 0
    return [(s[0], *(float(v - off) for v in s[1:])) for s in struct.iter_unpack(form, data[: len(data) // size * size])]


def imu(records: DataFrame, content: str, raw: bool, keep: list[str]) -> DataFrame:
    names = ("ax", "ay", "az", "gx", "gy", "gz")
    parse = F.udf(lambda d: imu_samples(bytes(d), raw), f"array<struct<t: long, {', '.join(f'{n}: double' for n in names)}>>")
    return records.select(*keep, F.inline(parse(content)))


def imu_rank(samples: DataFrame, by: list[str]) -> DataFrame:
    """How plausible a reading is: rate within 50 to 2000 Hz, magnitude near gravity, steps forward in time. Larger structs are better; equal ones decide nothing."""
    from pyspark.sql.window import Window

    step = F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("ord"))
    s = samples.withColumn("ahead", (step > 0).cast("int")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"), F.percentile(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2), F.lit(0.5)).alias("g"), F.sum("ahead").alias("ahead"))
    rate = (F.col("n") - 1) * 1e6 / F.col("span")
    return s.select(*by, F.struct(rate.between(50, 2000).alias("rate_ok"), (F.col("g").between(0.5, 2.0) | F.col("g").between(5.0, 20.0)).alias("magnitude_ok"), F.col("ahead")).alias("rank"))


def sample_rate(samples: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """(n - 1) over the time from first to last, in Hz for microseconds."""
    span = F.max(t) - F.min(t)
    return samples.groupBy(*by).agg(F.when(span > 0, (F.count(F.lit(1)) - 1) * 1e6 / span).alias("hz"))


def gravity(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean acceleration as a unit vector, and the mean magnitude; null where the mean is nearly zero."""
    mean = samples.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("ax", "ay", "az")), F.avg(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)).alias("magnitude"))
    n = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)
    return mean.select(*by, *(F.when(n >= 1e-6, F.col(c) / n).alias(c) for c in ("ax", "ay", "az")), "magnitude")


def calibrations(text: Column) -> Column:
    """The number strings of a device text that look like a two-lens calibration: version 3 or 6, with 2 + 2 * 19 or 2 + 2 * 27 values; the best is the last of the highest version."""
    found = F.regexp_extract_all(text, F.lit(r"((?:-?\d+(?:\.\d+)?_){20,}-?\d+(?:\.\d+)?)"), 1)
    values = F.transform(found, lambda s: F.transform(F.split(s, "_"), lambda v: v.cast("double")))
    fit = F.filter(values, lambda v: (v[0].isin(3.0, 6.0) | v[F.size(v) - 1].isin(3.0, 6.0)) & F.size(v).isin(40, 56))
    return F.element_at(F.array_sort(fit, lambda a, b: F.when(a[0] < b[0], -1).when(a[0] > b[0], 1).otherwise(0)), -1)


# --- side files ----------------------------------------------------------------------------


def documents(spark: SparkSession, path: str, version: int) -> DataFrame:
    """JSON documents, one a file; one of another version is an error."""
    rows = spark.read.json(path, multiLine=True)
    ok = F.when(F.col("version") == version, True).otherwise(F.raise_error(F.concat(F.lit("version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))).cast("boolean"))
    return rows.where(ok)


def partial_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that may still be written: whole lines only; a last line without its line end, or not JSON, is left for later."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", "\n"), 1, F.greatest(F.size(F.split("value", "\n")) - 1, F.lit(0)))).alias("line"))
    return whole.where("trim(line) <> ''").select(F.from_json("line", schema).alias("row")).where("row IS NOT NULL").select("row.*")


def metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, encoding="UTF-8")


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Image files below a folder by path: path, length. The six suffixes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,tif,tiff,webp}").load(folder).select("path", "length").orderBy("path")


def stream_info(probe: Column) -> Column:
    """Video streams of probe output (JSON): index, codec, size, frames a second."""
    parsed = F.from_json(probe, "streams array<struct<index int, codec_type string, codec_name string, width int, height int, r_frame_rate string>>")
    fps = lambda s: F.split(s["r_frame_rate"], "/")[0].cast("double") / F.nullif(F.split(s["r_frame_rate"], "/")[1].cast("double"), F.lit(0.0))
    video = F.filter(parsed["streams"], lambda s: s["codec_type"] == "video")
    return F.transform(video, lambda s: F.struct(s["index"].alias("index"), s["codec_name"].alias("codec"), s["width"].alias("width"), s["height"].alias("height"), fps(s).alias("fps")))


def is_dual(streams: Column) -> Column:
    """Exactly two streams, hevc or h264, of one size and rate."""
    a, b = streams[0], streams[1]
    return (F.size(streams) == 2) & F.forall(streams, lambda s: s["codec"].isin("hevc", "h264")) & (a["width"] == b["width"]) & (a["height"] == b["height"]) & (a["fps"] == b["fps"])



# --- match tables --------------------------------------------------------------------------


def match_rows(pairs: DataFrame, blob: str = "data") -> DataFrame:
    """image_a, image_b, index_a, index_b of every match. pairs: pair_id and a BLOB of two unsigned 32-bit numbers a match; pairs without matches have no rows."""
    from fieldloom.functions.expr import pair_high, pair_low

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(b, "<u4").reshape(-1, 2).astype(np.int64) for b in batch[blob]]
            both = np.concatenate([*found, np.zeros((0, 2), np.int64)])
            n = [len(f) for f in found]
            yield pd.DataFrame({"image_a": np.repeat(batch["a"].to_numpy(), n), "image_b": np.repeat(batch["b"].to_numpy(), n), "index_a": both[:, 0], "index_b": both[:, 1]})

    chosen = pairs.where(F.col(blob).isNotNull()).select(pair_low("pair_id").alias("a"), pair_high("pair_id").alias("b"), blob)
    return chosen.mapInPandas(run, "image_a long, image_b long, index_a long, index_b long")


def keypoint_rows(images: DataFrame, columns: str = "cols", blob: str = "data") -> DataFrame:
    """image_id, point2d_idx, x, y of every keypoint. images: image_id, the number of columns, and a BLOB of so many 32-bit floats a keypoint."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(b, "<f4").reshape(-1, c)[:, :2].astype(float) for b, c in zip(batch[blob], batch[columns], strict=True)]
            both = np.concatenate([*found, np.zeros((0, 2))])
            n = [len(f) for f in found]
            places = np.concatenate([*(np.arange(k) for k in n), np.zeros(0, int)])
            yield pd.DataFrame({"image_id": np.repeat(batch["image_id"].to_numpy(), n), "point2d_idx": places, "x": both[:, 0], "y": both[:, 1]})

    return images.where(F.col(blob).isNotNull()).select("image_id", columns, blob).mapInPandas(run, "image_id long, point2d_idx int, x double, y double")


def heldout_links(matches: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches between a held-out image and one that is not, as query, query_idx, anchor, anchor_idx, source_id, capture_index; and the queries that two captures or more match.

    images: image_id, held_out, source_id, capture_index."""
    of = lambda x: images.select(F.col("image_id").alias(f"image_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("held_out", "source_id", "capture_index")))
    m = matches.join(of("a"), "image_a").join(of("b"), "image_b").where("held_out_a <> held_out_b")
    pick = lambda held, other, c: F.when(F.col("held_out_a"), F.col(f"{c}_{held}")).otherwise(F.col(f"{c}_{other}"))
    links = m.select(pick("a", "b", "image").alias("query"), pick("a", "b", "index").alias("query_idx"), pick("b", "a", "image").alias("anchor"), pick("b", "a", "index").alias("anchor_idx"), pick("b", "a", "source_id").alias("source_id"), pick("b", "a", "capture_index").alias("capture_index"))
    eligible = links.groupBy("query", "query_idx").agg(F.count_distinct(F.struct("source_id", "capture_index")).alias("captures")).where("captures >= 2").select("query", "query_idx")
    return links, eligible


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a run, JSON lines: t, gpu_memory_mib, utilization (null where a sample lacks it)."""
    return spark.read.schema("t double, gpu_memory_mib double, utilization double").json(path)


def assessments(spark: SparkSession, path: str) -> DataFrame:
    """point3d_id, reason of assessed points, as written by the assessment of tracks; both must be there."""
    rows = spark.read.schema("point3d_id long, reason string").parquet(path)
    return rows.withColumn("reason", F.coalesce("reason", F.raise_error("an assessment without reason").cast("string")))


def append_lines(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows to JSON lines below a folder; every row once, whatever fails in between. partial_lines reads what is there."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Readers by the kind of a source; `register` adds one.
READERS: dict[str, object] = {"documents": documents, "lines": partial_lines, "metrics": metrics_csv, "pictures": pictures, "telemetry": telemetry, "assessments": assessments}


def register(kind: str, reader) -> None:
    """A kind is registered once."""
    if kind in READERS:
        raise ValueError(f"{kind} is registered already")
    READERS[kind] = reader


def read(kind: str, *args, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; there are {sorted(READERS)}")
    return READERS[kind](*args, **options)
