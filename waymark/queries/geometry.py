"""Queries over poses, cameras and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.catalog import query
from waymark.functions import pose
from waymark.operators import evaluate, landmarks, spatial
from waymark.queries import views
from waymark.queries.views import IMAGES_SQL
from waymark.sources import colmap
from waymark.tables import table


def r(c, n=6):
    return F.round(c, n)


@query(
    "image_poses",
    IMAGES_SQL
    + """SELECT image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(sqrt(greatest(0, 1+r00+r11+r22)) / 2, 6) AS qw,
 round(sqrt(greatest(0, 1+r00-r11-r22)) / 2 * CASE WHEN r12 - r21 < 0 THEN -1 ELSE 1 END, 6) + 0.0 AS qx,
 round(sqrt(greatest(0, 1-r00+r11-r22)) / 2 * CASE WHEN r20 - r02 < 0 THEN -1 ELSE 1 END, 6) + 0.0 AS qy,
 round(sqrt(greatest(0, 1-r00-r11+r22)) / 2 * CASE WHEN r01 - r10 < 0 THEN -1 ELSE 1 END, 6) + 0.0 AS qz FROM img""",
)
def image_poses(spark, sf_dir):
    t = F.col("T_wc")
    q, c = pose.to_quaternion(t), pose.centre(t)
    names = [("cx", c[0]), ("cy", c[1]), ("cz", c[2]), ("qw", q[0]), ("qx", q[1] + 0.0), ("qy", q[2] + 0.0), ("qz", q[3] + 0.0)]
    return views.posed_images(spark, sf_dir).select("image_id", *[r(x).alias(n) for n, x in names])


@query(
    "camera_intrinsics",
    IMAGES_SQL
    + """SELECT camera_id, fx, fy, px AS cx, py AS cy, CASE WHEN camera_model IN ('SIMPLE_RADIAL', 'RADIAL') THEN params[4] WHEN camera_model IN ('OPENCV', 'FULL_OPENCV') THEN params[5] ELSE 0.0 END AS k1,
 CASE WHEN camera_model = 'RADIAL' THEN params[5] WHEN camera_model IN ('OPENCV', 'FULL_OPENCV') THEN params[6] ELSE 0.0 END AS k2,
 CASE WHEN camera_model IN ('OPENCV', 'FULL_OPENCV') THEN params[7] ELSE 0.0 END AS p1, CASE WHEN camera_model IN ('OPENCV', 'FULL_OPENCV') THEN params[8] ELSE 0.0 END AS p2 FROM intr""",
)
def camera_intrinsics(spark, sf_dir):
    rows = views.cameras(spark, sf_dir)
    return rows.select("camera_id", pose.intrinsics(F.col("camera_model"), F.col("params")).alias("i"), pose.distortion(F.col("camera_model"), F.col("params")).alias("d")).select("camera_id", "i.*", "d.*")


_PROJECTED = (
    IMAGES_SQL
    + """, kp AS (SELECT image_id, camera_id, r00, r01, r02, r10, r11, r12, r20, r21, r22, -(r00*cx+r01*cy+r02*cz) AS w0, -(r10*cx+r11*cy+r12*cz) AS w1, -(r20*cx+r21*cy+r22*cz) AS w2, unnest(range(least(len(xs), len(ys), len(pids)))) AS idx, xs, ys, pids FROM img),
k AS (SELECT kp.*, xs[idx+1]::DOUBLE AS x, ys[idx+1]::DOUBLE AS y, pids[idx+1] AS point3d_id FROM kp),
p AS (SELECT k.*, xyz, fx, fy, px, py FROM k JOIN pt USING (point3d_id) JOIN intr USING (camera_id)
  WHERE k.point3d_id >= 0 AND len(xyz) = 3 AND point_error <= 8 AND NOT isnan(point_error) AND len(image_ids) >= 2 AND k.x IS NOT NULL AND k.y IS NOT NULL),
c AS (SELECT *, r00*xyz[1]+r01*xyz[2]+r02*xyz[3]+w0 AS xc, r10*xyz[1]+r11*xyz[2]+r12*xyz[3]+w1 AS yc, r20*xyz[1]+r21*xyz[2]+r22*xyz[3]+w2 AS zc FROM p),
uv AS (SELECT *, CASE WHEN zc > 1e-6 THEN fx*xc/zc+px END AS u, CASE WHEN zc > 1e-6 THEN fy*yc/zc+py END AS v FROM c)
"""
)


def projected(spark, sf_dir):
    """Keypoints with good points: the quality filter, two joins, a projection."""
    images, pts, cams = views.posed_images(spark, sf_dir), views.points(spark, sf_dir), views.cameras(spark, sf_dir)
    keys = colmap.keypoints(images).filter("point3d_id >= 0")
    good = pts.filter(views.finite("xyz", 3) & (F.col("point_error") <= 8) & ~F.isnan("point_error") & (F.size("image_ids") >= 2)).select("point3d_id", "xyz")
    rows = keys.join(good, "point3d_id").join(images.select("image_id", "camera_id", "T_wc"), "image_id").join(cams.select("camera_id", pose.intrinsics(F.col("camera_model"), F.col("params")).alias("i")), "camera_id")
    rows = rows.withColumn("p", pose.project(F.col("T_wc"), F.col("xyz"), F.col("i.fx"), F.col("i.fy"), F.col("i.cx"), F.col("i.cy")))
    return rows.withColumn("err", pose.reprojection_error(F.col("p"), F.col("x"), F.col("y")))


@query("project_points", _PROJECTED + "SELECT image_id, idx::INTEGER AS idx, point3d_id, round(u, 1) AS u, round(v, 1) AS v, round(zc, 5) AS z FROM uv WHERE u IS NOT NULL")
def project_points(spark, sf_dir):
    rows = projected(spark, sf_dir).filter("not isnan(p.u)")
    return rows.select("image_id", "idx", "point3d_id", r(F.col("p.u"), 1).alias("u"), r(F.col("p.v"), 1).alias("v"), r(F.col("p.z"), 5).alias("z"))


@query(
    "reprojection_stats",
    _PROJECTED
    + """, e AS (SELECT image_id, CASE WHEN u IS NULL THEN 1e9 ELSE sqrt((u-x)*(u-x)+(v-y)*(v-y)) END AS err FROM uv)
SELECT image_id, count(*) AS n, round(avg(err), 3) AS mean, round(median(err), 3) AS median, round(max(err), 3) AS max, round(avg(CASE WHEN err < 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS near_share FROM e GROUP BY image_id""",
)
def reprojection_stats(spark, sf_dir):
    return evaluate.reprojection_stats(projected(spark, sf_dir), ["image_id"], "err")


@query(
    "pose_errors",
    IMAGES_SQL
    + """, n AS (SELECT image_id, scene_id, r00, r01, r02, r10, r11, r12, r20, r21, r22, cx, cy, cz, lead(image_id) OVER w AS next_id, lead(r00) OVER w AS s00, lead(r01) OVER w AS s01, lead(r02) OVER w AS s02,
  lead(r10) OVER w AS s10, lead(r11) OVER w AS s11, lead(r12) OVER w AS s12, lead(r20) OVER w AS s20, lead(r21) OVER w AS s21, lead(r22) OVER w AS s22, lead(cx) OVER w AS dx, lead(cy) OVER w AS dy, lead(cz) OVER w AS dz
  FROM img WINDOW w AS (PARTITION BY scene_id ORDER BY image_id))
SELECT image_id, next_id, round(degrees(acos(greatest(-1, least(1, (r00*s00+r01*s01+r02*s02+r10*s10+r11*s11+r12*s12+r20*s20+r21*s21+r22*s22-1)/2)))), 4) AS rot_err_deg,
 round(sqrt((cx-dx)*(cx-dx)+(cy-dy)*(cy-dy)+(cz-dz)*(cz-dz)), 5) AS trans_err_m FROM n WHERE next_id IS NOT NULL""",
)
def pose_errors(spark, sf_dir):
    w = Window.partitionBy("scene_id").orderBy("image_id")
    rows = views.posed_images(spark, sf_dir).select("image_id", "scene_id", "T_wc", F.lead("image_id").over(w).alias("next_id"), F.lead("T_wc").over(w).alias("n")).filter("next_id is not null")
    got = evaluate.errors(rows, "T_wc", "n")
    return got.select("image_id", "next_id", r(F.col("rot_err_deg"), 4).alias("rot_err_deg"), r(F.col("trans_err_m"), 5).alias("trans_err_m"))


@query(
    "backproject_depth",
    """
WITH a AS (SELECT anchor_id, any_value(uv) AS uv, any_value(score) AS score FROM anchors WHERE anchor_id IS NOT NULL GROUP BY 1)
SELECT anchor_id, round((uv[1]::DOUBLE - 160) / 260 * (1 + score), 9) AS x, round((uv[2]::DOUBLE - 120) / 260 * (1 + score), 9) AS y, round(1 + score, 9) AS z FROM a WHERE len(uv) = 2 AND score IS NOT NULL AND isfinite(score)""",
)
def backproject_depth(spark, sf_dir):
    rows = landmarks.once(table(spark, sf_dir, "anchors"), "anchor_id").filter("size(uv) = 2 and score is not null and not isnan(score) and abs(score) < double('infinity')")
    f, cx, cy = F.lit(260.0), F.lit(160.0), F.lit(120.0)
    p = pose.backproject(F.col("uv")[0].cast("double"), F.col("uv")[1].cast("double"), 1 + F.col("score"), f, f, cx, cy)
    return rows.select("anchor_id", *[r(p[i], 9).alias(n) for i, n in enumerate("xyz")])


@query(
    "quaternion_roundtrip",
    """
WITH s AS (SELECT record_id, any_value(pose) AS p FROM sensor_records WHERE record_id IS NOT NULL AND sensor = 'pose' GROUP BY 1),
g AS (SELECT * FROM s WHERE len(p) = 16 AND len(list_filter(p, lambda v: v IS NOT NULL AND isfinite(v))) = 16)
SELECT record_id, round(-(p[1]*p[4]+p[5]*p[8]+p[9]*p[12]), 5) + 0.0 AS ix, round(-(p[2]*p[4]+p[6]*p[8]+p[10]*p[12]), 5) + 0.0 AS iy, round(-(p[3]*p[4]+p[7]*p[8]+p[11]*p[12]), 5) + 0.0 AS iz,
 round(sqrt(greatest(0, 1+p[1]+p[6]+p[11])) / 2, 4) AS qw, round(sqrt(greatest(0, 1+p[1]-p[6]-p[11])) / 2 * CASE WHEN p[10] - p[7] < 0 THEN -1 ELSE 1 END, 4) + 0.0 AS qx,
 round(sqrt(greatest(0, 1-p[1]+p[6]-p[11])) / 2 * CASE WHEN p[3] - p[9] < 0 THEN -1 ELSE 1 END, 4) + 0.0 AS qy, round(sqrt(greatest(0, 1-p[1]-p[6]+p[11])) / 2 * CASE WHEN p[5] - p[2] < 0 THEN -1 ELSE 1 END, 4) + 0.0 AS qz FROM g""",
)
def quaternion_roundtrip(spark, sf_dir):
    """Inverse translation and quaternion of recorded poses."""
    rows = landmarks.once(table(spark, sf_dir, "sensor_records").filter("sensor = 'pose'"), "record_id").filter(views.finite("pose", 16))
    t = F.col("pose")
    inv, q = pose.invert(t), pose.to_quaternion(t)
    return rows.select("record_id", (r(inv[3], 5) + 0.0).alias("ix"), (r(inv[7], 5) + 0.0).alias("iy"), (r(inv[11], 5) + 0.0).alias("iz"), *[(r(q[i], 4) + 0.0).alias(f"q{c}") for i, c in enumerate("wxyz")])


_VIEWS = (
    IMAGES_SQL
    + """, e AS (SELECT DISTINCT point3d_id, xyz, i AS image_id FROM (SELECT point3d_id, xyz, unnest(image_ids) AS i FROM pt WHERE xyz IS NOT NULL) z WHERE i IS NOT NULL),
d0 AS (SELECT point3d_id, image_id, cx - xyz[1] AS a, cy - xyz[2] AS b, cz - xyz[3] AS c FROM e JOIN img USING (image_id)),
d AS (SELECT point3d_id, image_id, a / n AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a*a+b*b+c*c) AS n FROM d0) y)
"""
)


@query(
    "view_diversity",
    _VIEWS
    + """, g AS (SELECT x.point3d_id, degrees(acos(greatest(-1, least(1, x.a*y.a+x.b*y.b+x.c*y.c)))) AS g FROM d x JOIN d y ON x.point3d_id = y.point3d_id AND x.image_id < y.image_id),
n AS (SELECT point3d_id, count(*) AS n_views FROM d GROUP BY 1), s AS (SELECT point3d_id, avg(g) AS m, max(g) AS t FROM g GROUP BY 1)
SELECT point3d_id, n_views, round(CASE WHEN n_views <= 1 THEN 0.35 ELSE greatest(0, least(1, 0.65::DOUBLE * m / 25 + 0.35::DOUBLE * t / 45)) END, 5)::DOUBLE AS diversity FROM n LEFT JOIN s USING (point3d_id)""",
)
def view_diversity(spark, sf_dir):
    from waymark.functions import scores

    seen = landmarks.view_diversity(landmarks.track_views(table(spark, sf_dir, "points3d"), table(spark, sf_dir, "images")))
    return seen.select("point3d_id", "n_views", r(scores.view_diversity(F.col("mean_angle"), F.col("max_angle"), F.col("n_views")), 5).alias("diversity"))


@query(
    "view_envelope",
    _VIEWS
    + """, m0 AS (SELECT point3d_id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM d GROUP BY 1), m AS (SELECT point3d_id, a / n AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a*a+b*b+c*c) AS n FROM m0) y)
SELECT d.point3d_id, round(min(d.a*m.a+d.b*m.b+d.c*m.c), 5) AS min_cos, round(max(d.a*m.a+d.b*m.b+d.c*m.c), 5) AS max_cos FROM d JOIN m USING (point3d_id) GROUP BY 1""",
)
def view_envelope(spark, sf_dir):
    box = landmarks.view_envelope(landmarks.track_views(table(spark, sf_dir, "points3d"), table(spark, sf_dir, "images")))
    return box.select("point3d_id", r(F.col("min_cos"), 5).alias("min_cos"), r(F.col("max_cos"), 5).alias("max_cos"))


def _angle(x: str, y: str) -> str:
    return f"degrees(acos(greatest(-1, least(1, {x}.a*{y}.a + {x}.b*{y}.b + {x}.c*{y}.c))))"


@query(
    "bounded_diverse_obs",
    _VIEWS.replace("WITH img0", "WITH RECURSIVE img0", 1)
    + f""", vw AS (SELECT point3d_id AS p, row_number() OVER (PARTITION BY point3d_id ORDER BY image_id) AS n, {{'i': image_id, 'a': a, 'b': b, 'c': c}} AS v FROM d),
bd(p, n, kept) AS (SELECT p, n, [v] FROM vw WHERE n = 1
  UNION ALL SELECT bd.p, vw.n, CASE WHEN len(kept) < 3 THEN list_append(kept, v)
      WHEN least({_angle("kept[1]", "v")}, {_angle("kept[2]", "v")}, {_angle("kept[3]", "v")}) > least({_angle("kept[1]", "kept[2]")}, {_angle("kept[1]", "kept[3]")}, {_angle("kept[2]", "kept[3]")}) + 1
      THEN CASE WHEN least({_angle("kept[1]", "kept[2]")}, {_angle("kept[1]", "kept[3]")}) <= {_angle("kept[2]", "kept[3]")} THEN [v, kept[2], kept[3]] ELSE [kept[1], v, kept[3]] END ELSE kept END
    FROM bd JOIN vw ON vw.p = bd.p AND vw.n = bd.n + 1)
SELECT p AS point3d_id, unnest(arg_max(kept, n)).i AS image_id FROM bd GROUP BY 1""",
)
def bounded_diverse_obs(spark, sf_dir):
    seen = landmarks.track_views(table(spark, sf_dir, "points3d"), table(spark, sf_dir, "images"))
    return landmarks.bounded_views(seen, 3).select("point3d_id", "image_id")


@query(
    "nearest_keypoint_radius",
    IMAGES_SQL
    + """, k0 AS (SELECT image_id, xs, ys, unnest(range(least(len(xs), len(ys), len(pids)))) AS i FROM img0 i2 JOIN (SELECT image_id AS j FROM img) z ON j = image_id),
k AS (SELECT image_id, i::INTEGER AS idx, xs[i+1]::DOUBLE AS x, ys[i+1]::DOUBLE AS y FROM k0 WHERE xs[i+1] IS NOT NULL AND ys[i+1] IS NOT NULL),
n AS (SELECT a.image_id, a.idx, b.idx AS near_idx, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM k a JOIN k b ON a.image_id = b.image_id AND a.idx % 2 = 0 AND b.idx % 2 = 1 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 400)
SELECT image_id, idx, near_idx, round(d2, 3) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id, idx ORDER BY d2, near_idx) AS r FROM n) q WHERE r = 1""",
)
def nearest_keypoint_radius(spark, sf_dir):
    """Nearest odd keypoint of each even one of the same image within 20 pixels."""
    keys = colmap.keypoints(views.posed_images(spark, sf_dir)).selectExpr("image_id", "idx", "cast(x as double) as x", "cast(y as double) as y")
    near = spatial.nearest_keypoint(keys.filter("idx % 2 = 0"), keys.filter("idx % 2 = 1").withColumnRenamed("idx", "near_idx"), "image_id", "idx", "near_idx", 20.0)
    return near.select("image_id", "idx", "near_idx", r(F.col("d2"), 3).alias("d2"))


@query(
    "percentile_trim",
    """
WITH p AS (SELECT point3d_id, any_value(xyz) AS q FROM points3d WHERE point3d_id IS NOT NULL GROUP BY 1),
x AS (SELECT point3d_id, q[1] AS x, q[2] AS y, q[3] AS z FROM p WHERE len(q) = 3 AND len(list_filter(q, lambda v: v IS NOT NULL AND isfinite(v))) = 3),
b AS (SELECT quantile_cont(x, 0.05) AS lx, quantile_cont(x, 0.95) AS hx, quantile_cont(y, 0.05) AS ly, quantile_cont(y, 0.95) AS hy, quantile_cont(z, 0.05) AS lz, quantile_cont(z, 0.95) AS hz FROM x)
SELECT point3d_id FROM x, b WHERE x BETWEEN lx - greatest((hx-lx)*0.02::DOUBLE, 0.001::DOUBLE) AND hx + greatest((hx-lx)*0.02::DOUBLE, 0.001::DOUBLE)
 AND y BETWEEN ly - greatest((hy-ly)*0.02::DOUBLE, 0.001::DOUBLE) AND hy + greatest((hy-ly)*0.02::DOUBLE, 0.001::DOUBLE) AND z BETWEEN lz - greatest((hz-lz)*0.02::DOUBLE, 0.001::DOUBLE) AND hz + greatest((hz-lz)*0.02::DOUBLE, 0.001::DOUBLE)""",
)
def percentile_trim(spark, sf_dir):
    rows = views.points(spark, sf_dir).filter(views.finite("xyz", 3)).select("point3d_id", *[F.col("xyz")[i].alias(n) for i, n in enumerate("xyz")])
    return evaluate.trim(rows, ["x", "y", "z"], 0.05, 0.95).select("point3d_id")


@query(
    "cubic_bounds",
    """
WITH p AS (SELECT point3d_id, any_value(xyz) AS q FROM points3d WHERE point3d_id IS NOT NULL GROUP BY 1),
x AS (SELECT q[1] AS x, q[2] AS y, q[3] AS z FROM p WHERE len(q) = 3 AND len(list_filter(q, lambda v: v IS NOT NULL AND isfinite(v))) = 3)
SELECT round((min(x)+max(x))/2, 6) AS mid_x, round((min(y)+max(y))/2, 6) AS mid_y, round((min(z)+max(z))/2, 6) AS mid_z, round(greatest(0.55::DOUBLE * greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)), 1), 6) AS half FROM x""",
)
def cubic_bounds(spark, sf_dir):
    rows = views.points(spark, sf_dir).filter(views.finite("xyz", 3)).select(*[F.col("xyz")[i].alias(n) for i, n in enumerate("xyz")])
    got = evaluate.cubic_bounds(rows, ["x", "y", "z"])
    return got.select(*[r(F.col(c)).alias(c) for c in got.columns])


@query(
    "view_scores",
    IMAGES_SQL
    + """, l AS (SELECT landmark_id, any_value(xyz) AS xyz, any_value(min_view_cos)::DOUBLE AS lo, any_value(max_view_cos)::DOUBLE AS hi, any_value(staticness)::DOUBLE AS st FROM landmarks WHERE landmark_id IS NOT NULL GROUP BY 1),
o AS (SELECT DISTINCT landmark_id, frame_id FROM observations WHERE landmark_id IS NOT NULL AND frame_id IS NOT NULL),
v AS (SELECT landmark_id, frame_id, lo, hi, st, cx - xyz[1]::DOUBLE AS a, cy - xyz[2]::DOUBLE AS b, cz - xyz[3]::DOUBLE AS c FROM o JOIN l USING (landmark_id) JOIN img ON image_id = frame_id WHERE len(xyz) = 3 AND lo IS NOT NULL AND hi IS NOT NULL AND st IS NOT NULL),
w AS (SELECT *, c / sqrt(a*a+b*b+c*c) AS k FROM v)
SELECT landmark_id, frame_id, round(CASE WHEN k < lo THEN k - lo WHEN k > hi THEN hi - k ELSE k END, 4) + 0.0 AS view, round(0.6::DOUBLE * st + 0.3::DOUBLE * CASE WHEN k < lo THEN k - lo WHEN k > hi THEN hi - k ELSE k END, 4) + 0.0 AS aux FROM w""",
)
def view_scores(spark, sf_dir):
    """View compatibility of every observation with its landmark's envelope about the z axis, and the auxiliary score."""
    from waymark.functions import scores

    lms = landmarks.once(table(spark, sf_dir, "landmarks"), "landmark_id").filter("size(xyz) = 3 and min_view_cos is not null and max_view_cos is not null and staticness is not null")
    pairs = table(spark, sf_dir, "observations").select("landmark_id", "frame_id").filter("landmark_id is not null and frame_id is not null").distinct()
    images = views.posed_images(spark, sf_dir).select(F.col("image_id").alias("frame_id"), pose.centre(F.col("T_wc")).alias("centre"))
    rows = pairs.join(lms.select("landmark_id", "xyz", "min_view_cos", "max_view_cos", "staticness"), "landmark_id").join(images, "frame_id")
    view = scores.view_compatibility(pose.view_direction(F.col("xyz"), F.col("centre")), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("min_view_cos").cast("double"), F.col("max_view_cos").cast("double"))
    rows = rows.withColumn("v", view)
    return rows.select("landmark_id", "frame_id", (r(F.col("v"), 4) + 0.0).alias("view"), (r(scores.auxiliary(F.col("staticness").cast("double"), F.col("v"), F.lit(0.0)), 4) + 0.0).alias("aux"))

