"""Queries of matching as a whole, of single scores and of geometry, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.catalog import query
from waymark.functions import pose, scores, vec
from waymark.operators import landmarks, pnp
from waymark.plans import localize
from waymark.queries import maps, runs, views
from waymark.queries.views import IMAGES_SQL, MATCHES_SQL
from waymark.tables import cut, table


def r6(c):
    return F.round(c, 6)


# --- scores and directions ---------------------------------------------------

_DIRS = (
    IMAGES_SQL.rstrip()
    + """,
en AS (SELECT DISTINCT point3d_id, xyz, unnest(image_ids) AS image_id FROM pt WHERE xyz IS NOT NULL),
v AS (SELECT point3d_id, image_id, cx - xyz[1] AS a, cy - xyz[2] AS b, cz - xyz[3] AS c FROM en JOIN img USING (image_id)),
d AS (SELECT point3d_id, image_id, a / n AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a*a+b*b+c*c) AS n FROM v) z WHERE n > 1e-8),
f AS (SELECT point3d_id, arg_min({'a': a, 'b': b, 'c': c}, image_id) AS f, count(*) AS n FROM d GROUP BY 1)
"""
)


@query(
    "view_angles",
    _DIRS
    + """, g AS (SELECT d.point3d_id, image_id, degrees(acos(greatest(-1, least(1, a*f.f.a + b*f.f.b + c*f.f.c)))) AS g FROM d JOIN f USING (point3d_id)),
s AS (SELECT point3d_id, arg_min(image_id, image_id) AS first, min(g) FILTER (image_id > (SELECT min(image_id) FROM d e WHERE e.point3d_id = g.point3d_id)) AS least, max(g) AS most FROM g GROUP BY 1)
SELECT point3d_id, round(coalesce(least, 180), 4) AS least, round(most, 4) AS most FROM s""",
)
def view_angles(spark, sf_dir):
    """Least and greatest angle between the first view of a point (by image) and its other views."""
    v = landmarks.track_views(table(spark, sf_dir, "points3d"), table(spark, sf_dir, "images")).filter(vec.norm(F.col("dir")) > 0.5)
    per = v.groupBy("point3d_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "dir"))).alias("l"))  # a track
    first, rest = F.col("l")[0]["dir"], F.expr("transform(slice(l, 2, size(l)), x -> x.dir)")
    most = F.array_max(F.transform("l.dir", lambda d: pose.angle_between(first, d)))
    return per.select("point3d_id", F.round(pose.least_angle(first, rest), 4).alias("least"), F.round(most, 4).alias("most"))


@query(
    "gate_and_fine_scores",
    MATCHES_SQL
    + """SELECT query_id, anchor_index, landmark_id, config_id, round(CASE WHEN landmark_id % 7 = 0 THEN 0.0 WHEN landmark_id % 5 = 0 OR e > 60 THEN -1.0 ELSE 1 - e / 60::DOUBLE END, 6) AS gate,
 round(0.8::DOUBLE * coarse_cos + 0.6::DOUBLE * score + 0.05::DOUBLE * ln(1 + anchor_index), 6) AS fine, round(0.8::DOUBLE * coarse_cos + 0.6::DOUBLE * score + 0.05::DOUBLE * ln(1 + anchor_index) + 0.25::DOUBLE * score, 6) AS mixed
 FROM (SELECT *, (landmark_id % 130)::DOUBLE AS e FROM m) z""",
)
def gate_and_fine_scores(spark, sf_dir):
    """The geometry gate and the fine scores of all scored candidates."""
    m = views.matches(spark, sf_dir)
    error = (F.col("landmark_id") % 130).cast("double")
    gate = scores.geometry_gate(error, F.col("landmark_id") % 5 != 0, F.col("landmark_id") % 7 != 0)
    fine = lambda **k: r6(scores.fine(F.col("coarse_cos"), 0.6 * F.col("score"), F.col("anchor_index"), 0.8, 0.05, **k))
    return m.select("query_id", "anchor_index", "landmark_id", "config_id", r6(gate).alias("gate"), fine().alias("fine"), fine(coarse=F.col("score"), coarse_weight=0.25).alias("mixed"))


@query("normalize_variants", "SELECT anchor_id, i::INTEGER AS i, round(CASE WHEN n > 1e-8 THEN x[i + 1] / n ELSE 0 END, 6) AS zero, round(x[i + 1] / greatest(n, 1e-8), 6) AS clamped FROM (SELECT anchor_id, x, sqrt(list_inner_product(x, x)) AS n, unnest(range(len(x))) AS i FROM (SELECT anchor_id, any_value(descriptor)::DOUBLE[] AS x FROM anchors WHERE anchor_id IS NOT NULL GROUP BY 1) a WHERE len(x) = 64 AND len(list_filter(x, lambda v: v IS NOT NULL AND isfinite(v))) = 64) z")
def normalize_variants(spark, sf_dir):
    a = landmarks.once(table(spark, sf_dir, "anchors"), "anchor_id").filter(views.finite("descriptor", 64))
    both = a.select("anchor_id", F.posexplode(F.arrays_zip(vec.normalize_or_zero(F.col("descriptor")).alias("z"), vec.normalize_clamped(F.col("descriptor")).alias("c"))).alias("i", "k"))
    return both.select("anchor_id", "i", r6(F.col("k.z")).alias("zero"), r6(F.col("k.c")).alias("clamped"))


@query("valid_depths", "SELECT event_id, value > 1e-4 AND isfinite(value) AS ok FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 1e-4 WHEN 3 THEN -value ELSE value END AS value FROM events) e")
def valid_depths(spark, sf_dir):
    z = F.expr("case event_id % 5 when 0 then double('nan') when 1 then double('infinity') when 2 then 1e-4 when 3 then -value else value end")
    return table(spark, sf_dir, "events").select("event_id", pose.valid_depth(z).alias("ok"))


@query("ppca_checks", "SELECT DISTINCT vec_id % 50 AS point_id, true AS orthonormal, true AS principal, true AS ordered FROM embeddings")
def ppca_checks(spark, sf_dir):
    """What must hold of every landmark's subspace: orthonormal directions that the scatter of its descriptors maps to
    their variances' multiples, the greatest variances first, and none below the mean of what is left."""
    e = views.obs(spark, sf_dir).select("point_id", "vec_id", "d")
    s = cut(landmarks.subspaces(e, "point_id", "d", 2, order="vec_id"))
    z = F.zip_with("d", "mu", lambda a, b: a - b)
    rows = e.join(s, "point_id").select("point_id", "n_obs", z.alias("z"), "basis", "eigvals")
    rows = rows.select("point_id", "n_obs", "z", F.posexplode("basis").alias("k", "u"), "eigvals").withColumn("c", vec.dot(F.col("u"), F.col("z")))
    parts = rows.select("point_id", "k", "n_obs", F.col("eigvals")[F.col("k")].alias("value"), "c", F.posexplode(F.arrays_zip("z", "u")).alias("i", "p"))
    moved = parts.groupBy("point_id", "k", "i").agg((F.sum(F.col("c") * F.col("p.z")) / (F.first("n_obs") - 1) - F.first("value") * F.first("p.u")).alias("off"))
    off = moved.groupBy("point_id").agg(F.max(F.abs("off")).alias("off"))
    u, v = F.col("basis")[0], F.col("basis")[1]
    near = lambda x, want: F.abs(x - want) < 1e-9
    rest = F.col("sigma_perp2") * F.col("n_obs") / (F.col("n_obs") - 1)
    return s.join(off, "point_id").select(
        "point_id",
        (near(vec.dot(u, u), 1.0) & near(vec.dot(v, v), 1.0) & near(vec.dot(u, v), 0.0)).alias("orthonormal"),
        (F.col("off") < 1e-9).alias("principal"),
        ((F.col("eigvals")[0] >= F.col("eigvals")[1]) & (F.col("eigvals")[1] >= rest - 1e-12)).alias("ordered"),
    )


# --- lookups and merging -----------------------------------------------------


@query(
    "observation_in_frames",
    """
WITH o AS (SELECT obs_id, any_value(landmark_id) AS l, any_value(frame_id) AS f, any_value(u) AS u, any_value(v) AS v FROM observations WHERE obs_id IS NOT NULL GROUP BY 1), w AS (SELECT DISTINCT image_id AS f FROM images WHERE image_id % 2 = 0)
SELECT l AS landmark_id, f AS frame_id, min(obs_id) AS obs_id, arg_min(u, obs_id) AS u FROM o JOIN w USING (f) WHERE l IS NOT NULL AND u IS NOT NULL GROUP BY 1, 2""",
)
def observation_in_frames(spark, sf_dir):
    """The first observation of each landmark in each image of an even number."""
    o = landmarks.once(table(spark, sf_dir, "observations"), "obs_id").filter("landmark_id is not null and u is not null")
    wanted = table(spark, sf_dir, "images").filter("image_id % 2 = 0").select(F.col("image_id").alias("frame_id"))
    return landmarks.observation_in(o, wanted).select("landmark_id", "frame_id", "obs_id", "u")


@query(
    "fine_mean_vectors",
    """
WITH a AS (SELECT anchor_id, any_value(query_id) AS q, any_value(descriptor)::DOUBLE[] AS d FROM anchors WHERE anchor_id IS NOT NULL GROUP BY 1),
g AS (SELECT * FROM a WHERE q IS NOT NULL AND len(d) = 64 AND len(list_filter(d, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND list_inner_product(d, d) > 1e-16),
x AS (SELECT q, i, avg(x) AS x FROM (SELECT q, unnest(range(64)) AS i, unnest(d) AS x FROM g) z GROUP BY 1, 2), n AS (SELECT q, sqrt(sum(x * x)) + 1e-8 AS n FROM x GROUP BY 1)
SELECT q AS query_id, i::INTEGER AS i, round(x / n, 6) AS x FROM x JOIN n USING (q)""",
)
def fine_mean_vectors(spark, sf_dir):
    """Mean of the usable descriptors of each query; zero vectors have no part in it."""
    a = landmarks.once(table(spark, sf_dir, "anchors"), "anchor_id").filter(views.finite("descriptor", 64) & F.col("query_id").isNotNull())
    return landmarks.fine_means(a, "query_id", "descriptor").select("query_id", F.posexplode("mu").alias("i", "x")).select("query_id", "i", r6(F.col("x")).alias("x"))


@query("merged_landmarks", "SELECT vec_id AS obs_id, (dense_rank() OVER (PARTITION BY (vec_id // 50) % 2 ORDER BY vec_id % 50) - 1)::BIGINT AS landmark_no FROM embeddings")
def merged_landmarks(spark, sf_dir):
    """Observations of fixed points, moved by a millimetre and with the point's descriptor, merge to the points in the order they came."""
    e = table(spark, sf_dir, "embeddings")
    point = e.groupBy(F.expr("vec_id % 50").alias("p")).agg(F.min_by("embedding", "vec_id").alias("d"))
    rows = e.selectExpr("vec_id as obs_id", "vec_id % 50 as p", "(vec_id div 50) % 2 as scene", "(vec_id div 50) % 3 / 1000 as off").join(F.broadcast(point), "p")  # 50 points
    rows = rows.select("scene", "obs_id", vec.normalize(F.col("d")).alias("desc"), F.expr("array(p % 10 * 0.4d + off, p div 10 * 0.4d - off, cast(3 as double))").alias("xyz"))
    return landmarks.merge_within(rows, "scene", 0.08, 0.7).select("obs_id", "landmark_no")


@query(
    "triangulated_points",
    """WITH p AS (SELECT DISTINCT vec_id % 50 AS p FROM embeddings) SELECT p AS point_id, round((p % 10 * 4 - 20) / 10, 4) + 0.0 AS x, round((p // 10 * 4 - 8) / 10, 4) + 0.0 AS y, round((40 + (p * 7) % 30) / 10, 4) AS z FROM p WHERE p % 5 <> 4""",
)
def triangulated_points(spark, sf_dir):
    """Points from their pixels in the first and the last camera that see them; the SQL is the true place."""
    frames, seen = runs._scene(spark, sf_dir)
    cams = frames.select("query_id", pose.projection_matrix(F.expr("array(c, 0d, s, cast(tx as double), 0d, 1d, 0d, cast(ty as double), -s, 0d, c, cast(tz as double), 0d, 0d, 0d, 1d)"), F.lit(260.0), F.lit(260.0), F.lit(160.0), F.lit(120.0)).alias("P"))
    rows = seen.filter("point_id % 5 <> 4").join(cams, "query_id")
    view = F.struct("query_id", "P", "u", "v")
    per = rows.groupBy("point_id").agg(F.min(view).alias("a"), F.max(view).alias("b")).filter("a.query_id < b.query_id")
    got = pose.triangulated(per.select("point_id", F.col("a.P").alias("p1"), F.col("b.P").alias("p2"), F.array("a.u", "a.v").alias("x1"), F.array("b.u", "b.v").alias("x2")), "point_id")
    return got.select("point_id", *[(F.round(F.col("xyz")[i], 4) + 0.0).alias(n) for i, n in enumerate("xyz")])


# --- matching and localization as a whole ------------------------------------


@query(
    "match_within_images",
    """
WITH a AS (SELECT anchor_id, any_value(query_id) AS query_id, any_value(anchor_index) AS anchor_idx, any_value(descriptor)::DOUBLE[] AS x FROM anchors WHERE anchor_id IS NOT NULL GROUP BY 1),
g AS (SELECT * FROM a WHERE query_id IS NOT NULL AND anchor_idx IS NOT NULL AND len(x) = 64 AND len(list_filter(x, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND list_inner_product(x, x) > 0),
l AS (SELECT landmark_id, any_value(mu)::DOUBLE[] AS y, any_value(staticness)::DOUBLE AS st FROM landmarks WHERE landmark_id IS NOT NULL GROUP BY 1),
h AS (SELECT * FROM l WHERE st IS NOT NULL AND len(y) = 64 AND len(list_filter(y, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND list_inner_product(y, y) > 0),
s AS (SELECT DISTINCT frame_id AS query_id, landmark_id FROM observations WHERE frame_id IS NOT NULL AND landmark_id IS NOT NULL),
c AS (SELECT query_id, anchor_idx, landmark_id, round(list_cosine_similarity(x, y), 9) AS cos, pow(list_distance(x, y), 2) AS res, st FROM g JOIN s USING (query_id) JOIN h USING (landmark_id)),
k AS (SELECT *, round(-1.0 * res + 1.2::DOUBLE * cos + 0.6::DOUBLE * st, 9) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id, anchor_idx ORDER BY cos DESC, landmark_id) <= 5),
b AS (SELECT *, row_number() OVER w AS sr, lead(score) OVER w AS s2 FROM k WINDOW w AS (PARTITION BY query_id, anchor_idx ORDER BY score DESC, landmark_id)),
f AS (SELECT * FROM b WHERE sr = 1 AND (s2 IS NULL OR score - s2 >= 0.005::DOUBLE) QUALIFY row_number() OVER (PARTITION BY query_id, landmark_id ORDER BY score DESC, anchor_idx) = 1)
SELECT query_id, anchor_idx, landmark_id, round(score, 5) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor_idx) <= 64""",
)
def match_within_images(spark, sf_dir):
    """The whole matching plan: every anchor against the landmarks seen in its own image, scores, margin, one to one, at most 64 matches."""
    good = lambda c: views.finite(c, 64) & (vec.norm(F.col(c)) > 0)
    a = landmarks.once(table(spark, sf_dir, "anchors"), "anchor_id").filter(good("descriptor") & F.col("query_id").isNotNull() & F.col("anchor_index").isNotNull())
    a = a.select("anchor_id", "query_id", F.col("anchor_index").alias("anchor_idx"), F.col("descriptor").alias("desc"))
    h = landmarks.once(table(spark, sf_dir, "landmarks"), "landmark_id").filter(good("mu") & F.col("staticness").isNotNull())
    h = h.select(F.col("landmark_id").alias("point_id"), "mu", F.col("staticness").cast("double").alias("staticness"), F.col("support_count").alias("n_obs"))
    s = table(spark, sf_dir, "observations").select(F.col("frame_id").alias("query_id"), F.col("landmark_id").alias("point_id")).filter("query_id is not null and point_id is not null").distinct()
    got = localize.match(a, h, localize.Matcher(topk=5, margin=0.005, per_anchor=5, most_matches=64), s)
    return got.select("query_id", "anchor_idx", F.col("point_id").alias("landmark_id"), F.round("score", 5).alias("score"))


def _described_scene(spark, sf_dir):
    """Anchors, landmarks and cameras of the generated scene; an anchor has its point's mean descriptor."""
    _, seen = runs._scene(spark, sf_dir)
    lms, _ = maps.memory(spark, sf_dir)
    places = seen.groupBy("point_id").agg(*[F.first(c).cast("double").alias(c) for c in "xyz"])
    lms = cut(lms.join(places, "point_id").select("point_id", "mu", "staticness", "n_obs", "x", "y", "z"))  # read many times, as are the anchors
    anchors = seen.join(lms.select("point_id", F.col("mu").alias("desc")), "point_id").selectExpr("query_id * 1000 + point_id as anchor_id", "query_id", "cast(point_id as int) as anchor_idx", "desc", "u", "v", "camera")
    anchors = cut(anchors)
    return anchors, lms, cut(anchors.groupBy("query_id").agg(F.first("camera").alias("camera")))


_SEEN_SQL = """
WITH f AS (SELECT DISTINCT vec_id // 50 AS f FROM embeddings), p AS (SELECT DISTINCT vec_id % 50 AS p FROM embeddings),
fr AS (SELECT f, (f * 3 - 15) / 10 AS tx, (f % 3 - 1) / 10 AS ty, (1 - t * t) / (1 + t * t) AS c, 2 * t / (1 + t * t) AS s FROM (SELECT f, (f % 5 - 2) / 20 AS t FROM f) z),
pt AS (SELECT p, (p % 10 * 4 - 20) / 10 AS x, (p // 10 * 4 - 8) / 10 AS y, (40 + (p * 7) % 30) / 10 AS z FROM p),
seen AS (SELECT f, p FROM fr, pt WHERE s * (x - tx) + c * z > 1e-6),
lm AS (SELECT DISTINCT vec_id % 50 AS p FROM embeddings WHERE (vec_id * 7919) % 10 < 7)
"""
_TRUTH = "SELECT f AS query_id, true AS success, round(any_value(tx), 4) + 0.0 AS x, round(any_value(ty), 4) + 0.0 AS y, 0.0::DOUBLE AS z"


@query("localize_refined", _SEEN_SQL + _TRUTH + ", count(*) FILTER (p % 5 <> 4)::INTEGER AS num_matches FROM seen JOIN fr USING (f) JOIN lm USING (p) GROUP BY 1")
def localize_refined(spark, sf_dir):
    """Early geometry: a first pose closes the matches that lie off it, the second pass has none of them left."""
    anchors, lms, cameras = _described_scene(spark, sf_dir)
    got = localize.localize_refined(anchors.drop("camera"), lms, cameras, localize.Matcher(topk=3, margin=0.001), edge=20.0)
    return got.select("query_id", "success", *[(F.round(F.col("T_wc")[4 * i + 3], 4) + 0.0).alias(n) for i, n in enumerate("xyz")], F.col("num_matches").cast("int").alias("num_matches"))


@query("localize_staged", _SEEN_SQL + _TRUTH + " FROM seen JOIN fr USING (f) JOIN lm USING (p) GROUP BY 1")
def localize_staged(spark, sf_dir):
    """Staged verification over groups of ten points each: stages of two groups, of four, then of all."""
    anchors, lms, cameras = _described_scene(spark, sf_dir)
    parts = lms.selectExpr("point_id", "point_id div 10 as group_no").join(F.broadcast(cameras.select("query_id")), F.lit(True))  # 50 points
    groups = parts.select("query_id", "group_no").distinct().withColumn("stage", F.expr("case when group_no < 2 then 2 when group_no < 4 then 4 else 5 end"))
    schedule = cameras.select("query_id", F.array(F.lit(2), F.lit(4), F.lit(5)).alias("stages"))
    got = localize.localize_staged(anchors.drop("camera"), lms, cameras, groups, schedule, parts.select("query_id", "group_no", "point_id"), localize.Matcher(topk=3), enough=24, hard=40)
    return got.select("query_id", "success", *[(F.round(F.col("T_wc")[4 * i + 3], 4) + 0.0).alias(n) for i, n in enumerate("xyz")])


@query("pnp_inliers", _SEEN_SQL + "SELECT f AS query_id, e AS error_px, true AS success, count(*) FILTER (p % 5 <> 4)::INTEGER AS num_inliers FROM seen, (SELECT unnest([2.0::DOUBLE, 8.0::DOUBLE]) AS e) t GROUP BY 1, 2")
def pnp_inliers(spark, sf_dir):
    """Inliers at two thresholds below the displacement of the wrong matches: exactly the right matches."""
    _, seen = runs._scene(spark, sf_dir)
    got = pnp.solve_poses(seen, thresholds=[2.0, 8.0])
    return got.select("query_id", "error_px", "success", F.col("num_inliers").cast("int").alias("num_inliers"))
