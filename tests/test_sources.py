"""Sources and sinks on small files of every format."""

import io
import json
import struct
import zlib

import numpy as np
import pytest

from waymark.functions import pose
from waymark.sources import colmap, frames, lists, sinks

CAMS = [(1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0]), (2, "SIMPLE_RADIAL", 320, 240, [250.0, 160.0, 120.0, 0.1])]
IMGS = [(3, [1.0, 0.0, 0.0, 0.0], [0.5, 0.0, 2.0], 1, "db/a b.jpg", [1.0, 2.5], [3.0, 4.0], [7, -1]), (4, [0.6, 0.8, 0.0, 0.0], [0.0, 1.0, 0.0], 2, "db/c.jpg", [], [], []), (5, [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0], 1, "q/d.jpg", [9.0], [8.0], [7])]
PTS = [(7, [0.1, 0.2, 0.3], [1, 2, 255], 0.5, [3, 5], [0, 0]), (8, [1.0, 1.0, 1.0], [0, 0, 0], 9.0, [], [])]


def write_text(folder):
    (folder / "cameras.txt").write_text("# cameras\n" + "\n".join(" ".join(map(str, [a, b, c, d, *e])) for a, b, c, d, e in CAMS) + "\n")
    lines = ["# images"]
    for i, q, t, c, n, xs, ys, ids in IMGS:
        lines += [" ".join(map(str, [i, *q, *t, c, n])), " ".join(f"{x} {y} {p}" for x, y, p in zip(xs, ys, ids))]
    (folder / "images.txt").write_text("\n".join(lines) + "\n")
    (folder / "points3D.txt").write_text("\n".join(" ".join(map(str, [i, *x, *c, e, *sum(([a, b] for a, b in zip(im, ix)), [])])) for i, x, c, e, im, ix in PTS) + "\n")


def write_binary(folder):
    number = {n: k for k, (n, _) in colmap.MODEL_NUMBERS.items()}
    (folder / "cameras.bin").write_bytes(struct.pack("<Q", len(CAMS)) + b"".join(struct.pack("<iiQQ", i, number[m], w, h) + struct.pack(f"<{len(p)}d", *p) for i, m, w, h, p in CAMS))
    out = struct.pack("<Q", len(IMGS))
    for i, q, t, c, n, xs, ys, ids in IMGS:
        out += struct.pack("<i7di", i, *q, *t, c) + n.encode() + b"\0" + struct.pack("<Q", len(xs)) + b"".join(struct.pack("<ddq", *z) for z in zip(xs, ys, ids))
    (folder / "images.bin").write_bytes(out)
    out = struct.pack("<Q", len(PTS))
    for i, x, c, e, im, ix in PTS:
        out += struct.pack("<Q3d3Bd", i, *x, *c, e) + struct.pack("<Q", len(im)) + b"".join(struct.pack("<ii", *z) for z in zip(im, ix))
    (folder / "points3D.bin").write_bytes(out)


@pytest.mark.parametrize("write", [write_text, write_binary])
def test_models(spark, tmp_path, write):
    write(tmp_path)
    c, i, p = colmap.load_model(spark, str(tmp_path))
    assert sorted(map(tuple, c.collect())) == CAMS
    assert sorted(map(tuple, i.collect())) == IMGS
    assert sorted(map(tuple, p.collect())) == PTS
    f = colmap.map_frames(i, c, prefixes=["db/"]).orderBy("frame_seq").collect()
    assert [r.image_id for r in f] == [3, 4] and f[0].intr.fx == 500.0 and f[1].dist.k1 == 0.1
    assert np.allclose(np.array(f[0].T_wc).reshape(4, 4)[:3, 3], [-0.5, 0, -2])
    assert colmap.keypoints(i).count() == 3
    names = spark.createDataFrame([("q/d.jpg",)], "image_name string")
    assert [r.image_id for r in colmap.map_frames(i, c, names=names).collect()] == [5]


def test_images_text_across_splits(spark, tmp_path):
    """Pairs of lines, some of them empty, in many splits."""
    rows = [(i, [1.0, 0.0, 0.0, 0.0], [float(i), 0.0, 0.0], 1, f"n {i}.jpg", *([[float(i)] * k, [2.0] * k, [i] * k] if (k := i % 4) else [[], [], []])) for i in range(1, 200)]
    lines = ["# head", "# tail"]
    for i, q, t, c, n, xs, ys, ids in rows:
        lines += [" ".join(map(str, [i, *q, *t, c, n])), " ".join(f"{x} {y} {p}" for x, y, p in zip(xs, ys, ids))] + (["# between"] if i % 9 == 0 else [])
    (tmp_path / "images.txt").write_text("\r\n".join(lines) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted(map(tuple, colmap.images_text(spark, str(tmp_path / "images.txt")).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == rows


def test_incomplete_models(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        colmap.load_model(spark, str(tmp_path))
    with pytest.raises(EOFError):
        list(colmap.decode_points(struct.pack("<Q", 2)))


def lines(spark, *texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, no int, line string")


def test_lists(spark):
    q = lists.query_list(lines(spark, "# x", "", None, "a.jpg", "b.jpg PINHOLE 640 480  1 2 3 4", "c.jpg bad")).collect()
    assert [(r.name, r.camera_model, r.params) for r in q] == [("a.jpg", None, None), ("b.jpg", "PINHOLE", [1, 2, 3, 4]), ("c.jpg", None, None)]
    pairs = lines(spark, "q1 d1", "q1 d2 0.5", "q1 d3 d4", "q2 d1 d2 d3", "q3", "# q d")
    got = sorted((r.query_name, r.rnk, r.db_name) for r in lists.retrieval_pairs(pairs).collect())
    assert got == [("q1", 0, "d1"), ("q1", 1, "d2"), ("q1", 2, "d3"), ("q1", 3, "d4"), ("q2", 0, "d1"), ("q2", 1, "d2"), ("q2", 2, "d3")]
    assert lists.retrieval_pairs(pairs, literal=True).filter("query_name = 'q1'").count() == 3
    assert lists.timed_paths(lines(spark, "1.5 rgb/a.png", "x y", "2.0")).count() == 1
    p = lists.timed_poses(lines(spark, "1.0 1 2 3 0 0 0 1", "2 3")).collect()
    assert len(p) == 1 and p[0].T_wc[3] == 1.0 and p[0].T_wc[0] == 1.0
    e = lists.recall_lines(lines(spark, "(0.25m, 2 deg): 41.3%", "T 0.5 m R 5 deg = 0.7", "nothing")).collect()
    assert [(r.metres, r.degrees, round(r.score, 3)) for r in e] == [(0.25, 2.0, 0.413), (0.5, 5.0, 0.7)]


def test_matrices(spark):
    t = spark.createDataFrame([("a", " ".join(map(str, range(16)))), ("b", "1 2"), ("c", "nan " * 16), ("d", "1 2 3 4 5 6")], "file string, value string")
    assert {r.file: r.m is not None for r in lists.matrices(t).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert [r.intr.width for r in lists.intrinsics_six(t).collect() if r.intr] == [5.0]
    assert [r.intr.fy for r in lists.intrinsics_matrix(t).collect() if r.intr] == [5.0]


def test_sequences(spark, tmp_path):
    (tmp_path / "rgb.txt").write_text("# t\n1.000 rgb/1.png\n2.000 rgb/2.png\n3.000 rgb/3.png\n")
    (tmp_path / "depth.txt").write_text("1.015 depth/1.png\n2.500 depth/2.png\n2.99 depth/3.png\n")
    (tmp_path / "groundtruth.txt").write_text("1.04 1 0 0 0 0 0 1\n1.02 2 0 0 0 0 0 1\n")
    got = frames.load_frames(spark, "tum", str(tmp_path), preset="fr2").orderBy("seq").collect()
    assert [(r.image_path, r.depth_path, None if r.T_wc is None else r.T_wc[3]) for r in got] == [("rgb/1.png", "depth/1.png", 2.0), ("rgb/3.png", "depth/3.png", None)]
    assert got[0].intr.fx == frames.PRESETS["fr2"][0]
    rows = [{"image": f"{i}.png", "depth": None, "fx": "" if i == 1 else 5 + i} for i in range(4)]
    (tmp_path / "m.json").write_text(json.dumps({"frames": rows}))
    (tmp_path / "m.csv").write_text("image,depth,fx\n" + "\n".join(f"{r['image']},,{r['fx']}" for r in rows) + "\n")
    for name in ("m.json", "m.csv"):
        m = frames.load_frames(spark, "manifest_sequence", str(tmp_path / name), stride=1, most=3).orderBy("seq").collect()
        assert [r.image_path for r in m] == ["0.png", "1.png", "2.png"] and m[1].intr is None and m[2].intr.fx == 7.0
    with pytest.raises(ValueError):
        frames.load_frames(spark, "nothing", "x")


def test_folders(spark, tmp_path):
    for sub in ("images", "depth", "poses"):
        (tmp_path / sub).mkdir()
    for i in range(12):
        (tmp_path / "images" / f"{i}.png").write_bytes(b"x")
        (tmp_path / "depth" / f"{i}.png").write_bytes(b"x")
    (tmp_path / "depth" / "4.npy").write_bytes(b"x")
    (tmp_path / "poses" / "4.txt").write_text("1 0 0 9\n0 1 0 0\n0 0 1 0\n0 0 0 1\n")
    got = frames.split_frames(spark, str(tmp_path), stride=2, most=4, numeric=True).orderBy("seq").collect()
    assert [r.frame_id for r in got] == ["0", "2", "4", "6"]
    assert got[2].depth_path.endswith("4.npy") and got[2].T_wc[3] == 9.0 and got[1].T_wc is None
    assert [r.frame_id for r in frames.split_frames(spark, str(tmp_path), most=3).orderBy("seq").collect()] == ["0", "1", "10"]
    s = frames.scannet_frames(spark, str(tmp_path), stride=5).orderBy("seq").collect()
    assert [r.frame_id for r in s] == ["0", "5", "10"] and s[0].intr is None


def png16(values):
    h, w = values.shape
    raw = b"".join((b"\2" if y else b"\0") + ((values[y].astype(">u2").view(np.uint8).astype(int) - (values[y - 1].astype(">u2").view(np.uint8).astype(int) if y else 0)) % 256).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_depth_and_images(spark, tmp_path):
    v = np.random.default_rng(0).integers(0, 65535, size=(5, 7)).astype(np.uint16)
    assert np.allclose(frames.read_depth(png16(v), "d.png"), v / 1000.0)
    buf = io.BytesIO()
    np.save(buf, np.ones((2, 2)))
    assert frames.read_depth(buf.getvalue(), "d.npy").sum() == 4
    rgb = np.zeros((2, 3, 3), np.uint8)
    rgb[..., 0] = 200
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    got = frames.decoded_images(spark, str(tmp_path / "i.png")).first()
    assert (got.height, got.width, bytes(got.data)) == (2, 3, rgb.tobytes())


def test_store_and_sinks(spark, tmp_path):
    lms = spark.createDataFrame([(1, 0.5)], "landmark_id bigint, staticness double")
    idx = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "frame_id bigint, lm_idx bigint, rnk int")
    sinks.save_store(lms, idx, str(tmp_path / "store"))
    a, b = sinks.load_store(spark, str(tmp_path / "store"))
    assert a.first().min_cos == -1.0 and a.first().basis == [] and b.count() == 2
    t = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    rows = spark.createDataFrame([("x.jpg", t), ("y.jpg", None)], "name string, T_wc array<double>")
    sinks.save_poses(rows, str(tmp_path / "poses"))
    back = lists.predicted_poses(spark.read.text(str(tmp_path / "poses")).selectExpr("'f' as file", "0 as no", "value as line")).collect()
    assert len(back) == 1 and np.allclose(back[0].T_wc, t, atol=1e-6)
    sinks.save_metrics(lms, lms, str(tmp_path / "metrics"), {"name": "d"})
    assert "landmark_id" in spark.read.json(str(tmp_path / "metrics/frames")).columns
    sinks.save_table(lms, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    pairs = spark.createDataFrame([("a", "d1", 0), ("a", "d2", 1), ("b", "d1", 0), ("b", "d3", 1), ("c", "d9", 0)], "query_name string, db_name string, rnk int")
    q, d = sinks.subset(pairs, 2, 2)
    assert sorted(r.query_name for r in q.collect()) == ["a", "b"] and [r.db_name for r in d.collect()] == ["d1", "d2"]
    assert pose.FAR_OFF == 1e9
