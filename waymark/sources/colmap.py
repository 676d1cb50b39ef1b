"""COLMAP models as DataFrames: text and binary, cameras, images and points.

Text is read by Spark, split by split; images.txt has two lines a record, which
are paired by their number in the file (a prefix sum over the splits' numbers of
lines). Binary files are decoded one file per task, some thousand rows at a time.
"""

from __future__ import annotations

import io
import itertools
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.sources import lists
from waymark.tables import cut, exists

CAMERAS = "camera_id bigint, camera_model string, width bigint, height bigint, params array<double>"
IMAGES = "image_id bigint, qvec array<double>, tvec array<double>, camera_id bigint, image_name string, xs array<double>, ys array<double>, point3d_ids array<bigint>"
POINTS = "point3d_id bigint, xyz array<double>, rgb array<int>, point_error double, image_ids array<bigint>, point2d_idxs array<int>"

# Numbers of the camera models in binary files, and their numbers of parameters.
MODEL_NUMBERS = {
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


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return spark.read.text(path).select(text.alias("line")).filter("line <> '' and not startswith(line, '#')").select(F.split("line", " ").alias("t"))


def _num(c, kind: str):
    return F.transform(c, lambda x: x.cast(kind))


def cameras_text(spark: SparkSession, path: str) -> DataFrame:
    t = F.col("t")
    return _lines(spark, path).select(t[0].cast("bigint").alias("camera_id"), t[1].alias("camera_model"), t[2].cast("bigint").alias("width"), t[3].cast("bigint").alias("height"), _num(F.slice(t, 5, F.size(t)), "double").alias("params"))


def points_text(spark: SparkSession, path: str) -> DataFrame:
    t = F.col("t")
    track = F.slice(t, 9, F.size(t))
    every = lambda k: F.filter(track, lambda x, i: i % 2 == k)
    return _lines(spark, path).select(
        t[0].cast("bigint").alias("point3d_id"),
        _num(F.slice(t, 2, 3), "double").alias("xyz"),
        _num(F.slice(t, 5, 3), "int").alias("rgb"),
        t[7].cast("double").alias("point_error"),
        _num(every(0), "bigint").alias("image_ids"),
        _num(every(1), "int").alias("point2d_idxs"),
    )


def images_text(spark: SparkSession, path: str) -> DataFrame:
    """Records of two lines; the second may be empty (an image without keypoints)."""
    lines = cut(lists.numbered(spark, path, skip=r"^\s*#"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row for each split
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    placed = lines.join(F.broadcast(sizes.select("file", "block", before.alias("before"))), ["file", "block"]).withColumn("i", F.col("before") + F.col("k"))
    line = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.trim("line")))
    both = placed.groupBy("file", F.expr("i div 2").alias("pair")).agg(line(0).alias("first"), F.coalesce(line(1), F.lit("")).alias("second")).filter("first <> ''")
    rows = both.select(F.split("first", r"\s+").alias("a"), F.when(F.col("second") == "", F.array().cast("array<string>")).otherwise(F.split("second", r"\s+")).alias("b"))
    each = lambda k: F.filter("b", lambda x, i: i % 3 == k)
    c = F.col("a")
    return rows.select(
        c[0].cast("bigint").alias("image_id"),
        _num(F.slice(c, 2, 4), "double").alias("qvec"),
        _num(F.slice(c, 6, 3), "double").alias("tvec"),
        c[8].cast("bigint").alias("camera_id"),
        F.array_join(F.slice(c, 10, F.size(c)), " ").alias("image_name"),
        _num(each(0), "double").alias("xs"),
        _num(each(1), "double").alias("ys"),
        _num(each(2), "bigint").alias("point3d_ids"),
    )


class _Reader:
    """Little-endian numbers of a binary file; a read beyond the end fails."""

    def __init__(self, data: bytes):
        self.file = io.BytesIO(data)

    def take(self, kinds: str) -> tuple:
        n = struct.calcsize("<" + kinds)
        data = self.file.read(n)
        if len(data) < n:
            raise EOFError(f"wanted {n} bytes, got {len(data)}")
        return struct.unpack("<" + kinds, data)

    def text(self) -> str:
        out = bytearray()
        while (b := self.take("c")[0]) != b"\0":
            out += b
        return out.decode("utf-8")


def decode_cameras(data: bytes) -> Iterator[tuple]:
    r = _Reader(data)
    for _ in range(r.take("Q")[0]):
        number, model, width, height = r.take("iiQQ")
        name, n = MODEL_NUMBERS[model]
        yield (number, name, width, height, list(r.take("d" * n)))


def decode_images(data: bytes) -> Iterator[tuple]:
    r = _Reader(data)
    for _ in range(r.take("Q")[0]):
        number, *pose, camera = r.take("i7di")
        name = r.text()
        n = r.take("Q")[0]
        flat = r.take("ddq" * n)
        yield (number, pose[:4], pose[4:], camera, name, list(flat[0::3]), list(flat[1::3]), list(flat[2::3]))


def decode_points(data: bytes) -> Iterator[tuple]:
    r = _Reader(data)
    for _ in range(r.take("Q")[0]):
        number, x, y, z, red, green, blue, error = r.take("Q3d3Bd")
        n = r.take("Q")[0]
        flat = r.take("ii" * n)
        yield (number, [x, y, z], [red, green, blue], error, list(flat[0::2]), list(flat[1::2]))


def encode_cameras(rows: list[tuple]) -> bytes:
    numbers = {name: k for k, (name, _) in MODEL_NUMBERS.items()}
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack(f"<iiQQ{len(p)}d", i, numbers[m], w, h, *p) for i, m, w, h, p in rows)


def encode_images(rows: list[tuple]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for i, q, t, camera, name, xs, ys, ids in rows:
        out.append(struct.pack("<i7di", i, *q, *t, camera) + name.encode() + b"\0" + struct.pack("<Q", len(xs)))
        out += [struct.pack("<ddq", *k) for k in zip(xs, ys, ids)]
    return b"".join(out)


def encode_points(rows: list[tuple]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for i, xyz, rgb, error, images, places in rows:
        out.append(struct.pack("<Q3d3BdQ", i, *xyz, *rgb, error, len(images)) + b"".join(struct.pack("<ii", *k) for k in zip(images, places)))
    return b"".join(out)


def encoded(rows: DataFrame, encode) -> DataFrame:
    """(content): a binary model file for every batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"content": pa.array([encode(list(zip(*(c.to_pylist() for c in b.columns))))], pa.binary())})

    return rows.mapInArrow(run, "content binary")


def decoded(files: DataFrame, decode, ddl: str) -> DataFrame:
    """The rows of binary model files (content)."""
    schema = files.sparkSession.createDataFrame([], ddl).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = decode(data)
                while some := list(itertools.islice(rows, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for c, n in zip(zip(*some), names)], names=names)

    return files.select("content").mapInArrow(run, schema)


def _binary(spark: SparkSession, path: str, decode, ddl: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path), decode, ddl)


def cameras_binary(spark, path):
    return _binary(spark, path, decode_cameras, CAMERAS)


def images_binary(spark, path):
    return _binary(spark, path, decode_images, IMAGES)


def points_binary(spark, path):
    return _binary(spark, path, decode_points, POINTS)


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cameras, images, points): the binary files if all three are there, else the text files."""
    for end, readers in ((".bin", (cameras_binary, images_binary, points_binary)), (".txt", (cameras_text, images_text, points_text))):
        paths = [os.path.join(folder, n + end) for n in ("cameras", "images", "points3D")]
        if all(exists(spark, p) for p in paths):
            return tuple(f(spark, p) for f, p in zip(readers, paths))
    raise FileNotFoundError(f"no complete model in {folder}")


def map_frames(images: DataFrame, cameras: DataFrame, prefixes: list[str] | None = None, names: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Map frames in order of image id: those with a listed prefix or name; frame_seq is the place in that order."""
    from waymark.functions import pose

    rows = images
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith("image_name", F.lit(p))
        rows = rows.filter(hit)
    if names is not None:
        rows = rows.join(names.select("image_name").distinct(), "image_name", "left_semi")
    if most is not None:
        rows = rows.orderBy("image_id").limit(most)
    shown = rows.join(cameras.select("camera_id", "camera_model", "params", "width", "height"), "camera_id", "left")
    seq = F.row_number().over(Window.orderBy("image_id")) - 1  # a model's images: thousands of rows
    return shown.select(seq.alias("frame_seq"), "image_id", "image_name", pose.image_pose(F.col("qvec"), F.col("tvec")).alias("T_wc"), pose.intrinsics(F.col("camera_model"), F.col("params")).alias("intr"), pose.distortion(F.col("camera_model"), F.col("params")).alias("dist"), "width", "height")


def keypoints(images: DataFrame) -> DataFrame:
    """(image_id, idx, x, y, point3d_id): one row for each keypoint; lists of different lengths end with the shortest."""
    zipped = F.arrays_zip("xs", "ys", "point3d_ids")
    return images.select("image_id", F.posexplode(zipped).alias("idx", "k")).select("image_id", "idx", F.col("k.xs").alias("x"), F.col("k.ys").alias("y"), F.col("k.point3d_ids").alias("point3d_id")).filter("x is not null and y is not null")
