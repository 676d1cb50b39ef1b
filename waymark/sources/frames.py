"""Frames of image sequences and scenes from folders, manifests and lists.

Every loader gives the same columns: frame_id, seq, image_path, depth_path,
T_wc, intr (each may be null). Only names and small text files are read here.
"""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.spatial import nearest_time, stem, strided
from waymark.sources import lists
from waymark.tables import exists, is_folder, put, small_text

# Fx, fy, cx, cy of the three published presets.
PRESETS = {"fr1": (517.3, 516.5, 318.6, 255.3), "fr2": (520.9, 521.0, 325.1, 249.7), "fr3": (535.4, 539.2, 320.1, 247.6)}
DEPTH_ENDS = (".npy", ".png", ".tif", ".tiff")


def listing(spark: SparkSession, folder: str, ends: tuple[str, ...] = ()) -> DataFrame:
    """(path, name) of the files of a folder; contents aren't read."""
    if not is_folder(spark, folder):
        return spark.createDataFrame([], "path string, name string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    rows = files.select("path", stem(F.col("path")).alias("name"))
    if ends:
        hit = F.lit(False)
        for e in ends:
            hit = hit | F.endswith(F.lower("path"), F.lit(e))
        rows = rows.filter(hit)
    return rows


def first_by_end(rows: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """One path for each name: that with the first of the endings."""
    rank = F.lit(len(ends))
    for i, e in reversed(list(enumerate(ends))):
        rank = F.when(F.endswith(F.lower("path"), F.lit(e)), i).otherwise(rank)
    return rows.groupBy("name").agg(F.min_by("path", rank).alias("path"))


def split_frames(spark: SparkSession, folder: str, stride: int = 1, most: int | None = None, start: int = 0, numeric: bool = False) -> DataFrame:
    """Frames of one split folder (images or rgb or color, depth, poses or pose): sorted, strided, then cut."""
    pick = lambda *names: next((os.path.join(folder, n) for n in names if is_folder(spark, os.path.join(folder, n))), os.path.join(folder, names[0]))
    images = first_by_end(listing(spark, pick("images", "rgb", "color"), (".jpg", ".png", ".jpeg")), (".jpg", ".png", ".jpeg"))
    if not images.take(1):
        images = listing(spark, pick("poses", "pose"), (".txt",)).select("name", F.lit(None).cast("string").alias("path"))
    if numeric:
        images = images.filter(F.regexp_like("name", F.lit("^[0-9]+$")))
    order = F.col("name").cast("int") if numeric else F.col("name")
    seq = images.withColumn("o", order)
    chosen = strided(seq, [], ["o"], start, stride, most)
    chosen = chosen.withColumn("seq", F.row_number().over(Window.orderBy("o")) - 1)
    depth = first_by_end(listing(spark, pick("depth"), DEPTH_ENDS), DEPTH_ENDS).withColumnRenamed("path", "depth_path")
    where = pick("poses", "pose")
    poses = spark.createDataFrame([], "name string, T_wc array<double>")
    if is_folder(spark, where):
        poses = lists.matrices(lists.read_whole(spark, where)).select(stem(F.col("file")).alias("name"), F.col("m").alias("T_wc"))
    return chosen.withColumnRenamed("path", "image_path").join(depth, "name", "left").join(poses, "name", "left").select(F.col("name").alias("frame_id"), "seq", "image_path", "depth_path", "T_wc")


def scannet_frames(spark: SparkSession, scene: str, start: int = 0, stride: int = 10, most: int | None = None, literal: bool = False) -> DataFrame:
    """Frames of a scene in numeric order (literal: in the order of their names); intrinsics from the colour matrix."""
    frames = split_frames(spark, scene, stride, most, start, numeric=not literal)
    path = os.path.join(scene, "intrinsic", "intrinsic_color.txt")
    intr = lists.intrinsics_matrix(lists.read_whole(spark, path)).select("intr") if exists(spark, path) else spark.createDataFrame([(None,)], "intr struct<fx:double,fy:double,cx:double,cy:double>")
    return frames.crossJoin(F.broadcast(intr.limit(1)))  # a single row


def tum_frames(spark: SparkSession, root: str, preset: str = "fr1", max_assoc: float = 0.02, max_pose: float = 0.05, stride: int = 1, most: int | None = None) -> DataFrame:
    """Frames of a sequence: each image with the nearest depth image (needed) and the nearest pose (if any), by time."""
    micro = lambda df: df.withColumn("t", F.round(F.col("ts") * 1_000_000).cast("bigint")).withColumn("id", F.row_number().over(Window.orderBy("ts", *([] if "path" not in df.columns else ["path"]))) - 1)
    read = lambda n: lists.read_lines(spark, os.path.join(root, n))
    rgb, depth, gt = micro(lists.timed_paths(read("rgb.txt"))), micro(lists.timed_paths(read("depth.txt"))), micro(lists.timed_poses(read("groundtruth.txt")))
    d = nearest_time(rgb, depth.withColumnRenamed("id", "did"), "id", "did", round(max_assoc * 1e6)).select("id", "did")
    g = nearest_time(rgb, gt.withColumnRenamed("id", "gid"), "id", "gid", round(max_pose * 1e6)).select("id", "gid")
    joined = rgb.join(d, "id").join(depth.select(F.col("id").alias("did"), F.col("path").alias("depth_path")), "did").join(g, "id", "left").join(gt.select(F.col("id").alias("gid"), "T_wc"), "gid", "left")
    fx, fy, cx, cy = PRESETS[preset]
    intr = F.struct(*[F.lit(v).alias(n) for v, n in ((fx, "fx"), (fy, "fy"), (cx, "cx"), (cy, "cy"))])
    chosen = strided(joined, [], ["ts"], 0, stride, most)
    return chosen.select(F.col("ts").cast("string").alias("frame_id"), (F.row_number().over(Window.orderBy("ts")) - 1).alias("seq"), F.col("path").alias("image_path"), "depth_path", "T_wc", intr.alias("intr"))


def manifest_frames(spark: SparkSession, path: str, stride: int = 1, most: int | None = None) -> DataFrame:
    """Frames of a JSON ({"frames": [...]} or a list) or CSV manifest; empty cells are null."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        rows = rows.select(*[F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c) for c in rows.columns])
        rows = rows.withColumn("__o", F.monotonically_increasing_id())
    else:
        data = json.loads(small_text(spark, path))
        frames = data["frames"] if isinstance(data, dict) else data
        names = ("image", "depth", "pose", "fx", "fy", "cx", "cy", "width", "height")
        rows = spark.createDataFrame([(i, *[None if r.get(n) is None else str(r[n]) for n in names]) for i, r in enumerate(frames)], "__o bigint, " + ", ".join(f"{n} string" for n in names))
    for n in ("image", "depth", "pose", "fx", "fy", "cx", "cy", "width", "height"):
        if n not in rows.columns:
            rows = rows.withColumn(n, F.lit(None).cast("string"))
    chosen = strided(rows, [], ["__o"], 0, stride, most)
    num = lambda n: F.col(n).try_cast("double")
    intr = F.when(num("fx").isNotNull(), F.struct(*[num(n).alias(n) for n in ("fx", "fy", "cx", "cy", "width", "height")]))
    seq = F.row_number().over(Window.orderBy("__o")) - 1
    return chosen.select(seq.cast("string").alias("frame_id"), seq.alias("seq"), F.col("image").alias("image_path"), F.col("depth").alias("depth_path"), F.col("pose").alias("pose_path"), intr.alias("intr"))


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width, data: RGB bytes) of image files; the built-in source has blue first."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for h, w, n, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "nChannels", "data"))):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out.append((np.repeat(x, 3, axis=2) if n == 1 else x[:, :, 2::-1]).tobytes())
            yield pa.RecordBatch.from_pydict({"image_id": b.column("origin"), "height": b.column("height"), "width": b.column("width"), "data": pa.array(out, pa.binary())})

    return rows.mapInArrow(run, "image_id string, height int, width int, data binary")


def read_depth(data: bytes, name: str) -> np.ndarray:
    """Depth in metres of an .npy file, or of a 16-bit grey PNG or TIFF file in millimetres; TIFF files of floats hold metres."""
    import io

    if name.endswith(".npy"):
        return np.load(io.BytesIO(data)).astype(np.float32)
    if name.lower().endswith((".tif", ".tiff")):
        got = read_grey_tiff(data)
        return got.astype(np.float32) if got.dtype.kind == "f" else got.astype(np.float32) / 1000.0
    return read_grey_png(data).astype(np.float32) / 1000.0


def write_depth(depth: np.ndarray, name: str) -> bytes:
    """The file content of a depth image: metres as .npy or float TIFF, rounded millimetres as PNG."""
    import io

    if name.endswith(".npy"):
        out = io.BytesIO()
        np.save(out, depth.astype(np.float32))
        return out.getvalue()
    if name.lower().endswith((".tif", ".tiff")):
        return write_grey_tiff(depth.astype(np.float32))
    return write_png(np.clip(np.rint(depth * 1000.0), 0, 65535).astype(np.uint16))


def write_png(pixels: np.ndarray) -> bytes:
    """A PNG file of grey pixels (h, w) of 8 or 16 bits, or of colours (h, w, 3) of 8 bits."""
    import struct
    import zlib

    height, width = pixels.shape[:2]
    colour, depth = (2, 8) if pixels.ndim == 3 else (0, 8 * pixels.dtype.itemsize)
    raw = pixels.astype(">u2" if depth == 16 else np.uint8).tobytes()
    line = len(raw) // height
    body = b"".join(b"\0" + raw[y * line : (y + 1) * line] for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


# Tag numbers of TIFF files, and the sizes of their number types.
TIFF_TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strips": 273, "samples": 277, "rows": 278, "bytes": 279, "predictor": 317, "format": 339}
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}


def write_grey_tiff(pixels: np.ndarray) -> bytes:
    """One grey page without compression, in one strip."""
    import struct

    data = pixels.astype(pixels.dtype.newbyteorder("<")).tobytes()
    t = TIFF_TAGS
    kind = 3 if pixels.dtype.kind == "f" else 1
    tags = [(t["width"], pixels.shape[1]), (t["height"], pixels.shape[0]), (t["bits"], 8 * pixels.dtype.itemsize), (t["compression"], 1), (t["photometric"], 1), (t["strips"], 8), (t["samples"], 1), (t["rows"], pixels.shape[0]), (t["bytes"], len(data)), (t["format"], kind)]
    pad = b"\0" * (len(data) % 2)
    head = struct.pack("<2sHI", b"II", 42, 8 + len(data) + len(pad))
    return head + data + pad + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in tags) + struct.pack("<I", 0)


def read_grey_tiff(data: bytes) -> np.ndarray:
    """Pixels of the first page of a grey TIFF file in strips, plain or deflated, of integers or floats."""
    import struct
    import zlib

    if data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    end = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(end + "I", data[4:8])[0]
    found: dict[int, list[int]] = {}
    for i in range(struct.unpack(end + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(end + "HHI", entry[:8])
        if kind not in (3, 4):
            continue
        size = TIFF_SIZES[kind] * n
        where = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(end + "I", entry[8:])[0]) : p + size]
        found[tag] = list(struct.unpack(end + ("H" if kind == 3 else "I") * n, where))
    get = lambda name, default: found.get(TIFF_TAGS[name], [default])
    width, height, bits = get("width", 0)[0], get("height", 0)[0], get("bits", 1)[0]
    packing, kind = get("compression", 1)[0], get("format", 1)[0]
    if packing not in (1, 8, 32946) or get("samples", 1)[0] != 1 or get("predictor", 1)[0] != 1 or bits not in (8, 16, 32, 64):
        raise ValueError("only plain or deflated grey TIFF without predictor")
    strips = [data[a : a + n] for a, n in zip(get("strips", 0), get("bytes", 0))]
    raw = b"".join(s if packing == 1 else zlib.decompress(s) for s in strips)
    dtype = np.dtype(f"{end}{'f' if kind == 3 else 'i' if kind == 2 else 'u'}{bits // 8}")
    return np.frombuffer(raw, dtype, width * height).reshape(height, width)


def write_scene(spark: SparkSession, folder: str, n: int, step: int = 1, size: tuple[int, int] = (4, 6)) -> None:
    """A synthetic RGB-D scene in the folder layout (color, depth, pose, intrinsic): frame i looks along z from (i, i / 2, 0), at depth 1 + i / 10 metres."""
    for i in range(n):
        name = str(i * step)
        pixels = np.zeros((*size, 3), np.uint8)
        pixels[..., 0], pixels[..., 1] = (i * 7) % 256, np.arange(size[1])[None, :]
        put(spark, f"{folder}/color/{name}.png", write_png(pixels))
        put(spark, f"{folder}/depth/{name}.png", write_depth(np.full(size, 1 + i / 10), "d.png"))
        put(spark, f"{folder}/pose/{name}.txt", f"1 0 0 {i}\n0 1 0 {i / 2}\n0 0 1 0\n0 0 0 1\n".encode())
    put(spark, f"{folder}/intrinsic/intrinsic_color.txt", b"260 0 160 0\n0 261 120 0\n0 0 1 0\n0 0 0 1\n")


def write_sequence(spark: SparkSession, root: str, images: list[tuple[float, str]], depths: list[tuple[float, str]], poses: list[tuple]) -> None:
    """A timed sequence as three lists: (seconds, path), (seconds, path), (seconds, tx, ty, tz, qx, qy, qz, qw)."""
    text = lambda rows: ("# timed list\n" + "".join(" ".join([f"{r[0]:.6f}", *map(str, r[1:])]) + "\n" for r in rows)).encode()
    for name, rows in (("rgb.txt", images), ("depth.txt", depths), ("groundtruth.txt", poses)):
        put(spark, f"{root}/{name}", text(rows))


def read_grey_png(data: bytes) -> np.ndarray:
    """Pixels of a grey PNG of 8 or 16 bits, without interlacing."""
    import struct
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    width, height, depth, colour, _, _, interlace = head
    if colour != 0 or depth not in (8, 16) or interlace:
        raise ValueError("only grey PNG of 8 or 16 bits")
    bpp, raw = depth // 8, np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, -1)
    out = np.zeros((height, width * bpp), np.uint8)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(width * bpp, np.int64)
        if kind in (0, 2):
            out[y] = (line + (up if kind == 2 else 0)) & 255
            continue
        now = [0] * len(line)
        for x in range(len(line)):
            left = now[x - bpp] if x >= bpp else 0
            corner = int(up[x - bpp]) if x >= bpp else 0
            if kind == 1:
                guess = left
            elif kind == 3:
                guess = (left + int(up[x])) // 2
            else:
                p = left + int(up[x]) - corner
                guess = min((left, int(up[x]), corner), key=lambda v: abs(p - v))
            now[x] = (int(line[x]) + guess) & 255
        out[y] = now
    return out.view(">u2").astype(np.uint16) if bpp == 2 else out


LOADERS = {
    "generic_rgbd": split_frames,
    "generic": split_frames,
    "scannet_rgbd": scannet_frames,
    "scannet": scannet_frames,
    "scannet_sequence": scannet_frames,
    "tum_rgbd_sequence": tum_frames,
    "tum": tum_frames,
    "manifest_sequence": manifest_frames,
    "fourseasons_sequence": manifest_frames,
}


def load_frames(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Frames of a dataset by the name of its type."""
    if kind not in LOADERS:
        raise ValueError(f"unknown dataset type: {kind}")
    return LOADERS[kind](spark, path, **options)
