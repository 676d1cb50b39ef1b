"""Inputs that several queries share: cleaned tables, and projections of the relational tables.

The projections use integer arithmetic and exact fractions only, so Spark and
the checking SQL build the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import pose
from waymark.operators.landmarks import once
from waymark.tables import micros, table


def finite(c: str, n: int):
    return F.coalesce((F.size(c) == n) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def posed_images(spark, sf_dir) -> DataFrame:
    """Images with a finite pose: image_id, scene_id, camera_id, T_wc, xs, ys, point3d_ids."""
    rows = once(table(spark, sf_dir, "images"), "image_id").filter(finite("qvec", 4) & finite("tvec", 3))
    return rows.select("image_id", "scene_id", "camera_id", "xs", "ys", "point3d_ids", pose.image_pose(F.col("qvec"), F.col("tvec")).alias("T_wc"))


def cameras(spark, sf_dir) -> DataFrame:
    return once(table(spark, sf_dir, "cameras"), "camera_id")


def points(spark, sf_dir) -> DataFrame:
    return once(table(spark, sf_dir, "points3d"), "point3d_id")


#: Image poses in SQL: r00..r22 are the rotation world to camera, t0..t2 the translation, cx, cy, cz the centre.
IMAGES_SQL = """
WITH img0 AS (SELECT image_id, any_value(scene_id) AS scene_id, any_value(camera_id) AS camera_id, any_value(qvec) AS q, any_value(tvec) AS t, any_value(xs) AS xs, any_value(ys) AS ys, any_value(point3d_ids) AS pids
  FROM images WHERE image_id IS NOT NULL GROUP BY image_id),
img1 AS (SELECT *, q[1] AS w, q[2] AS x, q[3] AS y, q[4] AS z, t[1] AS t0, t[2] AS t1, t[3] AS t2 FROM img0
  WHERE len(q) = 4 AND len(t) = 3 AND len(list_filter(list_concat(q, t), lambda v: v IS NOT NULL AND isfinite(v))) = 7),
img2 AS (SELECT *, 1-2*y*y-2*z*z AS r00, 2*x*y-2*w*z AS r01, 2*z*x+2*w*y AS r02, 2*x*y+2*w*z AS r10, 1-2*x*x-2*z*z AS r11, 2*y*z-2*w*x AS r12,
  2*z*x-2*w*y AS r20, 2*y*z+2*w*x AS r21, 1-2*x*x-2*y*y AS r22 FROM img1),
img AS (SELECT *, -(r00*t0+r10*t1+r20*t2) AS cx, -(r01*t0+r11*t1+r21*t2) AS cy, -(r02*t0+r12*t1+r22*t2) AS cz FROM img2),
pt AS (SELECT point3d_id, any_value(xyz) AS xyz, any_value(point_error) AS point_error, any_value(image_ids) AS image_ids FROM points3d WHERE point3d_id IS NOT NULL GROUP BY point3d_id),
cam AS (SELECT camera_id, any_value(camera_model) AS camera_model, any_value(params) AS params FROM cameras WHERE camera_id IS NOT NULL GROUP BY camera_id),
intr AS (SELECT *, params[1] AS fx, CASE WHEN two THEN params[2] ELSE params[1] END AS fy, CASE WHEN two THEN params[3] ELSE params[2] END AS px, CASE WHEN two THEN params[4] ELSE params[3] END AS py
  FROM (SELECT *, camera_model IN ('PINHOLE','OPENCV','OPENCV_FISHEYE','FULL_OPENCV','THIN_PRISM_FISHEYE') AS two FROM cam) c0)
"""


def obs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.selectExpr("vec_id", "cast(embedding as array<double>) as d", "vec_id % 50 as point_id", "vec_id div 50 as frame_id", "(vec_id * 7919) % 10 >= 7 as held_out", "(vec_id % 5) / 10 as reproj_error")


def idx(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as frame_id", "l_partkey as lm_idx").distinct()


def lm_attr(spark, sf_dir) -> DataFrame:
    n = idx(spark, sf_dir).groupBy("lm_idx").agg(F.count("*").alias("n_obs"))
    return table(spark, sf_dir, "part").selectExpr("p_partkey as lm_idx", "p_size / 50 as staticness").join(n, "lm_idx")


def retrievals(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as query_id", "l_orderkey as frame_id").distinct()
    return rows.selectExpr("query_id", "frame_id", "row_number() over (partition by query_id order by frame_id) - 1 as rnk").filter("rnk < 20")


RETRIEVALS_SQL = """
WITH v_idx AS (SELECT DISTINCT l_orderkey AS frame_id, l_partkey AS lm_idx FROM lineitem),
v_lm_attr AS (SELECT p_partkey AS lm_idx, p_size / 50 AS staticness, count(DISTINCT l_orderkey) AS n_obs FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size),
v_retrievals AS (SELECT query_id, frame_id, rnk FROM (SELECT query_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY frame_id) - 1 AS rnk
  FROM (SELECT DISTINCT l_suppkey AS query_id, l_orderkey AS frame_id FROM lineitem) d) r WHERE rnk < 20)
"""


def seq(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t_us", micros(F.col("ts")))
    return rows.selectExpr("user_id as sequence_id", "event_id", "t_us", "row_number() over (partition by user_id order by ts, event_id) - 1 as seq", "event_type <> 'error' as success", "if(event_type <> 'error', value / 10, null) as trans_err_m", "if(event_type <> 'error', (event_id % 180) / 10, null) as rot_err_deg", "event_type")


SEQ_SQL = """
WITH v_seq AS (SELECT user_id AS sequence_id, event_id, epoch_us(ts) AS t_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  event_type <> 'error' AS success, CASE WHEN event_type <> 'error' THEN value / 10 END AS trans_err_m, CASE WHEN event_type <> 'error' THEN (event_id % 180) / 10 END AS rot_err_deg, event_type FROM events)
"""


def matches(spark, sf_dir) -> DataFrame:
    """Scored candidates once: usable scores of match_output with the configuration's limits."""
    rows = table(spark, sf_dir, "match_output").filter("score is not null and not isnan(score) and abs(score) < double('infinity') and coarse_cos is not null and not isnan(coarse_cos)")
    once_ = rows.groupBy("query_id", "anchor_index", "landmark_id", "config_id").agg(F.max("score").alias("score"), F.max("coarse_cos").alias("coarse_cos"))
    return once_.join(table(spark, sf_dir, "match_config"), "config_id")


MATCHES_SQL = """
WITH m AS (SELECT * FROM (SELECT query_id, anchor_index, landmark_id, config_id, max(score) AS score, max(coarse_cos) AS coarse_cos FROM match_output
  WHERE score IS NOT NULL AND isfinite(score) AND coarse_cos IS NOT NULL AND NOT isnan(coarse_cos) GROUP BY 1, 2, 3, 4) g JOIN match_config USING (config_id))
"""
