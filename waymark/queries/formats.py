"""Queries that write whole tables in a format, load them again and give what was loaded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from waymark import config
from waymark.catalog import query
from waymark.functions import pose
from waymark.operators import spatial
from waymark.queries import views
from waymark.queries.views import IMAGES_SQL, RETRIEVALS_SQL
from waymark.sources import colmap, frames, lists, sinks
from waymark.tables import micros, put, scratch, table


def text(c, kind: str = "string"):
    """The elements of a list, separated by blanks."""
    return F.array_join(F.transform(c, lambda x: x.cast(kind).cast("string")), " ")


# --- models ------------------------------------------------------------------

_CAMERAS_SQL = """
WITH c AS (SELECT camera_id, any_value(camera_model) AS camera_model, any_value(width) AS width, any_value(height) AS height, any_value(params) AS params FROM cameras WHERE camera_id IS NOT NULL GROUP BY 1)
SELECT camera_id, camera_model, width::BIGINT AS width, height::BIGINT AS height, params FROM c WHERE len(params) > 0 AND camera_model IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL
"""
_IMAGES_SQL = (
    IMAGES_SQL.rstrip()
    + """,
names AS (SELECT image_id, any_value(image_name) AS image_name FROM images WHERE image_id IS NOT NULL GROUP BY 1)
SELECT image_id, q AS qvec, t AS tvec, camera_id, image_name, xs::DOUBLE[] AS xs, ys::DOUBLE[] AS ys, pids AS point3d_ids FROM img JOIN names USING (image_id)
WHERE camera_id IS NOT NULL AND image_name IS NOT NULL AND len(xs) = len(ys) AND len(xs) = len(pids) AND len(list_filter(xs, lambda v: v IS NULL)) + len(list_filter(ys, lambda v: v IS NULL)) + len(list_filter(pids, lambda v: v IS NULL)) = 0
"""
)
_POINTS_SQL = """
WITH p AS (SELECT point3d_id, any_value(xyz) AS xyz, any_value(rgb) AS rgb, any_value(point_error) AS point_error, any_value(image_ids) AS image_ids, any_value(point2d_idxs) AS point2d_idxs FROM points3d WHERE point3d_id IS NOT NULL GROUP BY 1)
SELECT point3d_id, xyz, rgb, point_error, image_ids, point2d_idxs FROM p WHERE xyz IS NOT NULL AND rgb IS NOT NULL AND isfinite(point_error) AND len(image_ids) = len(point2d_idxs)
  AND len(list_filter(image_ids, lambda v: v IS NULL)) + len(list_filter(point2d_idxs, lambda v: v IS NULL)) = 0
"""


def _full(*cols):
    """Lists without nulls, of the same length."""
    good = F.lit(True)
    for c in cols:
        good = good & F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()) & (F.size(c) == F.size(cols[0]))
    return F.coalesce(good, F.lit(False))


def model_cameras(spark, sf_dir):
    rows = views.cameras(spark, sf_dir).filter(F.coalesce(F.size("params") > 0, F.lit(False)))
    return rows.filter("camera_model is not null and width is not null and height is not null").select("camera_id", "camera_model", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"), "params")


def model_images(spark, sf_dir):
    rows = table(spark, sf_dir, "images").filter("image_id is not null").dropDuplicates(["image_id"])
    good = views.finite("qvec", 4) & views.finite("tvec", 3) & _full("xs", "ys", "point3d_ids")
    return rows.filter(good & F.col("camera_id").isNotNull() & F.col("image_name").isNotNull()).select(
        "image_id", "qvec", "tvec", "camera_id", "image_name", F.col("xs").cast("array<double>").alias("xs"), F.col("ys").cast("array<double>").alias("ys"), "point3d_ids"
    )


def model_points(spark, sf_dir):
    rows = views.points(spark, sf_dir).filter("xyz is not null and rgb is not null and point_error is not null and not isnan(point_error) and abs(point_error) < double('infinity')")
    return rows.filter(_full("image_ids", "point2d_idxs")).select("point3d_id", "xyz", "rgb", "point_error", "image_ids", "point2d_idxs")


def write_model(spark, sf_dir) -> str:
    """The model as text files; images have two lines each, the second of which may be empty."""
    at = scratch(spark, "model")
    model_cameras(spark, sf_dir).select(F.concat_ws(" ", "camera_id", "camera_model", "width", "height", text("params"))).write.text(f"{at}/cameras.txt")
    i = model_images(spark, sf_dir)
    keys = F.array_join(F.transform(F.arrays_zip("xs", "ys", "point3d_ids"), lambda k: F.concat_ws(" ", k["xs"], k["ys"], k["point3d_ids"])), " ")
    i.select(F.concat(F.concat_ws(" ", "image_id", text("qvec"), text("tvec"), "camera_id", "image_name"), F.lit("\n"), keys)).write.text(f"{at}/images.txt")
    p = model_points(spark, sf_dir)
    track = F.array_join(F.transform(F.arrays_zip("image_ids", "point2d_idxs"), lambda k: F.concat_ws(" ", k["image_ids"], k["point2d_idxs"])), " ")
    p.select(F.concat_ws(" ", "point3d_id", text("xyz"), text("rgb"), "point_error", track)).write.text(f"{at}/points3D.txt")
    return at


@query("model_text_cameras", _CAMERAS_SQL)
def model_text_cameras(spark, sf_dir):
    return colmap.load_model(spark, write_model(spark, sf_dir))[0]


@query("model_text_images", _IMAGES_SQL)
def model_text_images(spark, sf_dir):
    return colmap.load_model(spark, write_model(spark, sf_dir))[1]


@query("model_text_points", _POINTS_SQL)
def model_text_points(spark, sf_dir):
    return colmap.load_model(spark, write_model(spark, sf_dir))[2]


@query("model_binary_cameras", _CAMERAS_SQL)
def model_binary_cameras(spark, sf_dir):
    return colmap.decoded(colmap.encoded(model_cameras(spark, sf_dir), colmap.encode_cameras), colmap.decode_cameras, colmap.CAMERAS)


@query("model_binary_images", _IMAGES_SQL)
def model_binary_images(spark, sf_dir):
    return colmap.decoded(colmap.encoded(model_images(spark, sf_dir), colmap.encode_images), colmap.decode_images, colmap.IMAGES)


@query("model_binary_points", _POINTS_SQL)
def model_binary_points(spark, sf_dir):
    return colmap.decoded(colmap.encoded(model_points(spark, sf_dir), colmap.encode_points), colmap.decode_points, colmap.POINTS)


@query(
    "map_frames",
    IMAGES_SQL.rstrip()
    + """,
names AS (SELECT image_id, any_value(image_name) AS image_name FROM images WHERE image_id IS NOT NULL GROUP BY 1),
f AS (SELECT image_id, camera_id, cx, cy, cz, image_name FROM img JOIN names USING (image_id) WHERE starts_with(image_name, 'scene000001/') OR starts_with(image_name, 'scene000003/'))
SELECT (row_number() OVER (ORDER BY image_id) - 1)::INTEGER AS frame_seq, image_id, image_name, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(fx, 6) AS fx FROM f LEFT JOIN intr USING (camera_id)""",
)
def map_frames(spark, sf_dir):
    """Map frames of two scenes, by the prefixes of their names."""
    posed = views.posed_images(spark, sf_dir).select("image_id")
    images = table(spark, sf_dir, "images").filter("image_id is not null").dropDuplicates(["image_id"]).join(posed, "image_id", "left_semi")
    got = colmap.map_frames(images, views.cameras(spark, sf_dir), prefixes=["scene000001/", "scene000003/"])
    return got.select("frame_seq", "image_id", "image_name", *[F.round(F.col("T_wc")[4 * i + 3], 6).alias(n) for i, n in enumerate(("cx", "cy", "cz"))], F.round("intr.fx", 6).alias("fx"))


# --- sequences ---------------------------------------------------------------


@query("timed_poses_parse", "SELECT event_id, round(epoch_us(ts) / 1000000::DOUBLE, 6) AS ts, round(value, 6) AS x, user_id::DOUBLE AS y FROM events")
def timed_poses_parse(spark, sf_dir):
    """Ground-truth lines `ts tx ty tz qx qy qz qw` of a walk: rotations about z that hold the event's number."""
    e = table(spark, sf_dir, "events").withColumn("s", F.format_string("%.6f", micros(F.col("ts")) / 1e6))
    lines = e.select(F.lit("f").alias("file"), F.col("event_id").alias("no"), F.concat_ws(" ", "s", "value", "user_id", "event_id", F.lit("0 0 0 1")).alias("line"))
    got = lists.timed_poses(lines)
    return got.select(F.col("T_wc")[11].cast("bigint").alias("event_id"), F.round("ts", 6).alias("ts"), F.round(F.col("T_wc")[3], 6).alias("x"), F.col("T_wc")[7].alias("y"))


@query(
    "tum_sequence",
    """
WITH e AS (SELECT *, (epoch_us(ts) // 1000) * 1000 AS t FROM events),
a AS (SELECT 'rgb/' || event_id AS p, t, event_id FROM e WHERE event_type = 'click'), d AS (SELECT 'depth/' || event_id AS dp, t AS td FROM e WHERE event_type = 'view'), g AS (SELECT event_id AS ge, t AS tg FROM e WHERE event_type = 'purchase'),
j AS (SELECT p, t, event_id, dp FROM a JOIN d ON td BETWEEN t - 30000000 AND t + 30000000 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(t - td), td, dp) = 1),
k AS (SELECT event_id, ge FROM a JOIN g ON tg BETWEEN t - 60000000 AND t + 60000000 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(t - tg), tg, ge) = 1)
SELECT p AS image_path, dp AS depth_path, ge::DOUBLE AS x, 517.3::DOUBLE AS fx FROM j LEFT JOIN k USING (event_id)""",
)
def tum_sequence(spark, sf_dir):
    """Events as a timed sequence: clicks are images, views depth images, purchases poses."""
    at = scratch(spark, "sequence")
    e = table(spark, sf_dir, "events").withColumn("s", F.format_string("%.3f", F.floor(micros(F.col("ts")) / 1000) / 1000))
    e.filter("event_type = 'click'").select(F.concat_ws(" ", "s", F.concat(F.lit("rgb/"), "event_id"))).write.text(f"{at}/rgb.txt")
    e.filter("event_type = 'view'").select(F.concat_ws(" ", "s", F.concat(F.lit("depth/"), "event_id"))).write.text(f"{at}/depth.txt")
    e.filter("event_type = 'purchase'").select(F.concat_ws(" ", "s", "event_id", F.lit("0 0 0 0 0 1"))).write.text(f"{at}/groundtruth.txt")
    got = frames.load_frames(spark, "tum", at, max_assoc=30.0, max_pose=60.0)
    return got.select("image_path", "depth_path", F.col("T_wc")[3].alias("x"), "intr.fx")


@query("manifest_csv", "SELECT 'i' || o_orderkey AS image_path, CASE WHEN o_orderkey % 3 > 0 THEN 'd' || o_orderkey END AS depth_path, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS fx FROM orders")
def manifest_csv(spark, sf_dir):
    at = scratch(spark, "manifest") + ".csv"
    rows = table(spark, sf_dir, "orders").selectExpr("concat('i', o_orderkey) as image", "if(o_orderkey % 3 > 0, concat('d', o_orderkey), null) as depth", "if(o_orderkey % 2 = 0, o_totalprice, null) as fx")
    rows.write.option("header", True).csv(at)
    got = frames.load_frames(spark, "manifest_sequence", at)
    return got.select("image_path", "depth_path", "intr.fx")


_POSES16 = "WITH s AS (SELECT record_id, any_value(pose) AS p FROM sensor_records WHERE record_id IS NOT NULL AND pose IS NOT NULL GROUP BY 1)\n"


@query("matrix_texts", _POSES16 + "SELECT record_id, CASE WHEN len(p) = 16 AND len(list_filter(p, lambda v: v IS NOT NULL AND isfinite(v))) = 16 THEN p END AS m FROM s")
def matrix_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "sensor_records").filter("record_id is not null and pose is not null").dropDuplicates(["record_id"])
    texts = rows.select(F.col("record_id").cast("string").alias("file"), F.array_join(F.transform("pose", lambda x: x.cast("string")), "\n", "null").alias("value"))
    m = F.transform("m", lambda x: x + 0.0)  # the SQL's any_value knows no negative zero
    return lists.matrices(texts).select(F.col("file").cast("bigint").alias("record_id"), m.alias("m"))


@query("intrinsics_texts", IMAGES_SQL + "SELECT camera_id, fx, fy, px AS cx, py AS cy FROM intr WHERE fx IS NOT NULL AND fy IS NOT NULL AND px IS NOT NULL AND py IS NOT NULL")
def intrinsics_texts(spark, sf_dir):
    """Camera matrices, every other one of 3 x 3 and of 4 x 4 numbers, written as text and read again."""
    c = views.cameras(spark, sf_dir).select("camera_id", pose.intrinsics(F.col("camera_model"), F.col("params")).alias("i"))
    c = c.select("camera_id", pose.camera_matrix(F.col("i.fx"), F.col("i.fy"), F.col("i.cx"), F.col("i.cy")).alias("k")).filter("not exists(k, x -> x is null)")
    num = lambda i: F.col("k")[i].cast("string")
    three = F.concat_ws(" ", *[num(i) for i in range(9)])
    four = F.concat_ws(" ", *[num(i) if i < 3 else F.lit("0") for i in range(4)], *[num(3 + i) if i < 3 else F.lit("0") for i in range(4)], *[num(6 + i) if i < 3 else F.lit("0") for i in range(4)], F.lit("0 0 0 1"))
    got = lists.intrinsics_matrix(c.select(F.col("camera_id").cast("string").alias("file"), F.when(F.col("camera_id") % 2 == 0, three).otherwise(four).alias("value")))
    return got.filter("intr is not null").select(F.col("file").cast("bigint").alias("camera_id"), "intr.fx", "intr.fy", "intr.cx", "intr.cy")


# --- stores and reports ------------------------------------------------------


@query(
    "store_roundtrip",
    RETRIEVALS_SQL + "SELECT frame_id, i.lm_idx, staticness, 0.0::DOUBLE AS sigma_perp2, -1.0::DOUBLE AS min_cos, 1.0::DOUBLE AS max_cos FROM v_idx i JOIN v_lm_attr a ON i.lm_idx = a.lm_idx",
)
def store_roundtrip(spark, sf_dir):
    """The landmark store and its index saved and loaded; columns that an old store lacks have their defaults."""
    at = scratch(spark, "store")
    entries = views.idx(spark, sf_dir).withColumn("rnk", F.lit(1))
    sinks.save_store(views.lm_attr(spark, sf_dir), entries, at)
    sinks.save_store(views.lm_attr(spark, sf_dir), entries, at)  # replaces the first one
    lms, index = sinks.load_store(spark, at)
    return index.join(lms, "lm_idx").select("frame_id", "lm_idx", "staticness", "sigma_perp2", "min_cos", "max_cos")


@query("metrics_json", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def metrics_json(spark, sf_dir):
    at = scratch(spark, "metrics")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    sinks.save_metrics(e.agg(F.count("*").alias("n")), e, at, {"name": "events"})
    back = spark.read.schema("user_id bigint, value double").json(f"{at}/frames")
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("table_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_csv(spark, sf_dir):
    at = scratch(spark, "table")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.save_table(rows, at)
    return spark.read.csv(at, header=True, schema=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


@query(
    "retrieval_subset",
    """
WITH p AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY d) - 1 AS r FROM (SELECT DISTINCT 'q' || l_suppkey AS q, l_orderkey AS d FROM lineitem) z),
n AS (SELECT DISTINCT q FROM p ORDER BY q LIMIT 5), i AS (SELECT d, min({'q': q, 'r': r}) AS o FROM p WHERE q IN (SELECT q FROM n) GROUP BY 1)
SELECT d AS db_name FROM i ORDER BY o, d LIMIT 40""",
)
def retrieval_subset(spark, sf_dir):
    """The first 40 database images that the first five queries retrieve."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat('q', l_suppkey) as query_name", "l_orderkey as db_name").distinct()
    return sinks.subset(rows.selectExpr("*", "row_number() over (partition by query_name order by db_name) - 1 as rnk"), 5, 40)[1]


@query(
    "name_lookup",
    """
WITH i AS (SELECT image_id, any_value(image_name) AS nm FROM images WHERE image_id IS NOT NULL GROUP BY 1), k AS (SELECT image_id, nm, regexp_replace(nm, '^.*/', '') AS base, regexp_replace(regexp_replace(nm, '^.*/', ''), '\\.[^.]*$', '') AS st FROM i WHERE nm IS NOT NULL),
q AS (SELECT CASE image_id % 5 WHEN 0 THEN nm WHEN 1 THEN base WHEN 2 THEN st WHEN 3 THEN image_id::VARCHAR ELSE 'no such ' || image_id END AS name FROM k),
a AS (SELECT nm, min(image_id) AS v FROM k GROUP BY 1), b AS (SELECT base, min(image_id) AS v FROM k GROUP BY 1), c AS (SELECT st, min(image_id) AS v FROM k GROUP BY 1), d AS (SELECT DISTINCT image_id AS v FROM k)
SELECT q.name, coalesce(a.v, b.v, c.v, d.v) AS image_id FROM q LEFT JOIN a ON q.name = a.nm LEFT JOIN b ON q.name = b.base LEFT JOIN c ON q.name = c.st LEFT JOIN d ON q.name = d.v::VARCHAR""",
)
def name_lookup(spark, sf_dir):
    """Images named in full, by file name, by stem, by number, or not at all."""
    i = table(spark, sf_dir, "images").filter("image_id is not null").dropDuplicates(["image_id"]).filter("image_name is not null")
    k = i.select("image_id", "image_name", F.regexp_replace("image_name", r"^.*/", "").alias("base"), spatial.stem(F.col("image_name")).alias("st"))
    q = k.select(F.expr("case image_id % 5 when 0 then image_name when 1 then base when 2 then st when 3 then cast(image_id as string) else concat('no such ', image_id) end").alias("name"))
    named = k.select("image_name", "base", "st", F.col("image_id").cast("string").alias("number"), "image_id")
    return spatial.resolve_names(q, "name", named, ["image_name", "base", "st", "number"], "image_id")


# --- images and depth --------------------------------------------------------


@query(
    "depth_files",
    "SELECT p_partkey, (p_size + 1) / 8 AS at_centre, CASE WHEN p_size < 25 THEN (p_size + 2) / 8 ELSE 0.0::DOUBLE END AS at_edge FROM part",
)
def depth_files(spark, sf_dir):
    """Depth images of 3 x 4 pixels in every format, read again and sampled: at (1.5, 1.5), which rounds to (2, 2), and at a pixel that may be outside."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("size"))

    def run(batches):
        from waymark.operators.anchors import sample_depth

        for b in batches:
            centre, edge = [], []
            for key, size in zip(b.column("p_partkey").to_pylist(), b.column("size").to_pylist()):
                depth = np.full((3, 4), size / 8)
                depth[2, 2], depth[2, 3] = (size + 1) / 8, (size + 2) / 8
                name = ("d.npy", "d.png", "d.tiff")[key % 3]
                back = frames.read_depth(frames.write_depth(depth, name), name)
                centre.append(sample_depth(back, 1.5, 1.5))
                edge.append(sample_depth(back, 3.4 if size < 25 else 3.6, 2.2))
            yield pa.RecordBatch.from_pydict({"p_partkey": b.column("p_partkey"), "at_centre": pa.array(centre, pa.float64()), "at_edge": pa.array(edge, pa.float64())})

    return rows.mapInArrow(run, "p_partkey bigint, at_centre double, at_edge double")


_SCENE_SQL = "SELECT (i * 3)::VARCHAR AS frame_id, (i // 2)::INTEGER AS seq, (i * 3) || '.png' AS image, (i * 3) || '.png' AS depth, i::DOUBLE AS x, i / 2 AS y, 260.0::DOUBLE AS fx, 261.0::DOUBLE AS fy FROM range(24) t(i) WHERE i % 2 = 0"


@query("scene_folder", _SCENE_SQL)
def scene_folder(spark, sf_dir):
    """A generated scene of 24 frames, written in the folder layout and loaded with a stride of two."""
    at = scratch(spark, "scene")
    frames.write_scene(spark, at, 24, step=3)
    got = frames.load_frames(spark, "scannet", at, stride=2)
    base = lambda c: F.regexp_replace(c, r"^.*/", "")
    return got.select("frame_id", "seq", base("image_path").alias("image"), base("depth_path").alias("depth"), F.col("T_wc")[3].alias("x"), F.col("T_wc")[7].alias("y"), "intr.fx", "intr.fy")


@query("image_files", "SELECT i::INTEGER AS frame, 4 AS height, 6 AS width, ((i * 7) % 256)::INTEGER AS red, c::INTEGER AS green FROM range(24) t(i), range(6) u(c)")
def image_files(spark, sf_dir):
    """The colour images of the generated scene, decoded: the first line's pixels."""
    at = scratch(spark, "scene")
    frames.write_scene(spark, at, 24)
    got = frames.decoded_images(spark, f"{at}/color").select(spatial.stem(F.col("image_id")).cast("int").alias("frame"), "height", "width", F.hex("data").alias("h"))
    byte = lambda k: F.conv(F.substring(F.col("h"), 6 * F.col("c") + 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    return got.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("frame", "height", "width", byte(0).alias("red"), byte(1).alias("green"))


@query(
    "config_sections",
    "SELECT * FROM (VALUES ('matching.topk_landmarks', '16'), ('matching.scorer', 'ppca'), ('matching.ratio_margin', '0.0'), ('pnp.reproj_error_px', '12.5'), ('pnp.iterations', '1000'), ('retrieval.grouping', 'covisibility'), ('landmarks.merge_radius_m', '0.08'), ('anchors.topk', '200'), ('suggested.1000', '10'), ('suggested.100000', '16'), ('suggested.1000000', '32')) t(name, value)",
)
def config_sections(spark, sf_dir):
    """A configuration file read, overridden and typed; settings that aren't named have their defaults."""
    at = scratch(spark, "config") + ".yaml"
    put(spark, at, b"matching:\n  topk_landmarks: 12\n  scorer: ppca\n  unknown: 1\npnp:\n  reproj_error_px: 12.5\n")
    c = config.override(config.load_config(at, spark), {"matching.topk_landmarks": 16})
    m, p, r = config.Matching.of(c.get("matching")), config.Pnp.of(c.get("pnp")), config.Retrieval.of(c.get("retrieval"))
    rows = [("matching.topk_landmarks", m.topk_landmarks), ("matching.scorer", m.scorer), ("matching.ratio_margin", m.ratio_margin), ("pnp.reproj_error_px", p.reproj_error_px), ("pnp.iterations", p.iterations), ("retrieval.grouping", r.grouping)]
    rows += [("landmarks.merge_radius_m", config.Landmarks.of({}).merge_radius_m), ("anchors.topk", config.Anchors.of(None).topk)]
    rows += [(f"suggested.{n}", config.suggested(n).topk_landmarks) for n in (1_000, 100_000, 1_000_000)]
    return spark.createDataFrame([(a, str(b)) for a, b in rows], "name string, value string")
