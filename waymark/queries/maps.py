"""Queries over landmarks, retrieval, candidates and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.catalog import query
from waymark.functions import scores, vec
from waymark.operators import assign, candidates, landmarks, retrieval
from waymark.plans import localize
from waymark.queries import views
from waymark.queries.geometry import _VIEWS
from waymark.queries.views import MATCHES_SQL, RETRIEVALS_SQL
from waymark.tables import cut, table


def r6(c):
    return F.round(c, 6)


# --- summaries ---------------------------------------------------------------

_OBS = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS d, vec_id % 50 AS point_id, vec_id // 50 AS frame_id, (vec_id * 7919) % 10 >= 7 AS ho FROM embeddings),
o AS (SELECT * FROM e WHERE NOT ho),
x AS (SELECT point_id, generate_subscripts(d, 1) AS i, unnest(d) AS x FROM o),
m0 AS (SELECT point_id, list(x ORDER BY i) AS m FROM (SELECT point_id, i, avg(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT point_id, list_transform(m, lambda v: v / (sqrt(list_inner_product(m, m)) + 1e-8)) AS mu FROM m0),
sp AS (SELECT o.point_id, count(*) AS n_obs, avg(list_distance(d, mu)) AS spread FROM o JOIN m USING (point_id) GROUP BY 1),
lm AS (SELECT m.point_id, mu, n_obs, spread, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.45::DOUBLE * tanh(n_obs / 6.0::DOUBLE) + 0.25::DOUBLE * exp(-spread) + 0.2::DOUBLE + 0.1::DOUBLE * 0.35::DOUBLE)) AS st
  FROM m JOIN sp USING (point_id))
"""


def memory(spark, sf_dir):
    """Landmarks of the seen observations, and the held-out ones as anchors."""
    e = views.obs(spark, sf_dir)
    seen = e.filter("not held_out")
    means = landmarks.mean_vectors(seen, "point_id", "d")
    spread = landmarks.spreads(seen, means, "point_id", "d")
    static = scores.staticness(F.col("n_obs"), F.col("spread"), F.lit(0.0), F.lit(0.35))
    lms = cut(means.join(spread, "point_id").withColumn("staticness", static))  # read several times below
    anchors = e.filter("held_out").select(F.col("vec_id").alias("anchor_id"), F.col("frame_id").alias("query_id"), F.col("vec_id").alias("anchor_idx"), F.col("d").alias("desc"))
    return lms, anchors


@query(
    "flagship_match",
    _OBS
    + """, c AS (SELECT e.frame_id AS query_id, vec_id AS anchor_idx, lm.point_id, list_inner_product(d, mu) AS cos, pow(list_distance(d, mu), 2) AS res, st FROM e, lm WHERE ho),
k AS (SELECT *, -1.0 * res + 1.2::DOUBLE * cos + 0.6::DOUBLE * st AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id, anchor_idx ORDER BY cos DESC, point_id) <= 10),
b AS (SELECT *, row_number() OVER w AS sr, lead(score) OVER w AS s2 FROM k WINDOW w AS (PARTITION BY query_id, anchor_idx ORDER BY score DESC, point_id)),
g AS (SELECT * FROM b WHERE sr = 1 AND (s2 IS NULL OR score - s2 >= 0.005::DOUBLE) QUALIFY row_number() OVER (PARTITION BY query_id, point_id ORDER BY score DESC, anchor_idx) = 1)
SELECT query_id, anchor_idx, point_id, round(cos, 6) AS cos, round(score, 6) AS score FROM g""",
)
def flagship_match(spark, sf_dir):
    """Landmarks from observations, top 10 by cosine, score, margin, best anchor of each landmark."""
    lms, anchors = memory(spark, sf_dir)
    top = retrieval.topk_cosine(anchors, "anchor_id", "desc", lms, "point_id", "mu", 10)
    rows = top.join(anchors, "anchor_id").join(lms, "point_id").withColumn("cosine", vec.dot(F.col("desc"), F.col("mu")))
    rows = localize.score_rows(rows, localize.Matcher())
    best = retrieval.accepted(rows, ["query_id", "anchor_idx"], "score", "point_id", margin=0.005)
    kept = retrieval.best_per_item(best, ["query_id"], "point_id", "score", "anchor_idx")
    return kept.select("query_id", "anchor_idx", "point_id", r6(F.col("cosine")).alias("cos"), r6(F.col("score")).alias("score"))


@query("vector_normalize", "SELECT vec_id, i::INTEGER AS i, round(x[i + 1] / (n + 1e-8), 6) AS x, round(n, 6) AS norm FROM (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n, unnest(range(len(x))) AS i FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) e) z")
def vector_normalize(spark, sf_dir):
    both = table(spark, sf_dir, "embeddings").select("vec_id", vec.norm(F.col("embedding")).alias("n"), F.posexplode(vec.normalize(F.col("embedding"))).alias("i", "x"))
    return both.select("vec_id", "i", r6(F.col("x")).alias("x"), r6(F.col("n")).alias("norm"))


@query("vector_mean_by_group", _OBS + "SELECT point_id, i::INTEGER AS i, round(x, 6) AS x FROM (SELECT point_id, unnest(range(64)) AS i, unnest(mu) AS x FROM m) z")
def vector_mean_by_group(spark, sf_dir):
    lms, _ = memory(spark, sf_dir)
    return lms.select("point_id", F.posexplode("mu").alias("i", "x")).select("point_id", "i", r6(F.col("x")).alias("x"))


@query("descriptor_spread", _OBS + "SELECT point_id, n_obs, round(spread, 6) AS spread, round(st, 6) AS staticness FROM lm")
def descriptor_spread(spark, sf_dir):
    lms, _ = memory(spark, sf_dir)
    return lms.select("point_id", "n_obs", r6(F.col("spread")).alias("spread"), r6(F.col("staticness")).alias("staticness"))


@query(
    "observation_stats",
    """
WITH o AS (SELECT obs_id, any_value(landmark_id) AS landmark_id, any_value(frame_id) AS frame_id, any_value(reproj_error)::DOUBLE AS e FROM observations WHERE obs_id IS NOT NULL GROUP BY 1)
SELECT landmark_id, least(count(*), 65535) AS n_obs, count(DISTINCT frame_id) AS n_frames, min(frame_id) AS first_frame, max(frame_id) AS last_frame, round(avg(e), 5) AS mean_error
FROM o WHERE landmark_id IS NOT NULL AND frame_id IS NOT NULL GROUP BY 1""",
)
def observation_stats(spark, sf_dir):
    got = landmarks.observation_stats(table(spark, sf_dir, "observations"))
    return got.withColumn("mean_error", F.round("mean_error", 5))


@query(
    "landmark_staticness",
    """
WITH o AS (SELECT obs_id, any_value(landmark_id) AS landmark_id, any_value(reproj_error)::DOUBLE AS e, any_value(frame_id) AS f FROM observations WHERE obs_id IS NOT NULL GROUP BY 1),
s AS (SELECT landmark_id, count(*) AS n, avg(e) AS e FROM o WHERE landmark_id IS NOT NULL AND f IS NOT NULL GROUP BY 1),
l AS (SELECT landmark_id, any_value(sigma_perp2)::DOUBLE AS s2 FROM landmarks WHERE landmark_id IS NOT NULL GROUP BY 1)
SELECT landmark_id, round(least(1, greatest(0, 0.45::DOUBLE * tanh(n / 6.0::DOUBLE) + 0.25::DOUBLE * exp(-sqrt(s2)) + 0.2::DOUBLE * exp(-greatest(0, e)) + 0.035::DOUBLE)), 5) AS staticness
FROM s JOIN l USING (landmark_id) WHERE s2 IS NOT NULL AND s2 >= 0 AND e IS NOT NULL""",
)
def landmark_staticness(spark, sf_dir):
    stats = landmarks.observation_stats(table(spark, sf_dir, "observations"))
    lms = landmarks.once(table(spark, sf_dir, "landmarks"), "landmark_id").select("landmark_id", F.col("sigma_perp2").cast("double").alias("s2")).filter("s2 >= 0")
    rows = stats.join(lms, "landmark_id").filter("mean_error is not null")
    return rows.select("landmark_id", F.round(scores.staticness(F.col("n_obs"), F.sqrt("s2"), F.col("mean_error"), F.lit(0.35)), 5).alias("staticness"))


@query("running_mean", "SELECT obs_id, round(avg(e) OVER (PARTITION BY landmark_id ORDER BY obs_id ROWS UNBOUNDED PRECEDING), 5) AS running_mean FROM (SELECT obs_id, any_value(landmark_id) AS landmark_id, any_value(u)::DOUBLE AS e FROM observations WHERE obs_id IS NOT NULL GROUP BY 1) o WHERE landmark_id IS NOT NULL")
def running_mean(spark, sf_dir):
    rows = landmarks.once(table(spark, sf_dir, "observations"), "obs_id").filter("landmark_id is not null").withColumn("e", F.col("u").cast("double"))
    return landmarks.running_means(rows, "landmark_id", ["obs_id"], "e").select("obs_id", F.round("running_mean", 5).alias("running_mean"))


_PPCA = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS d, vec_id % 50 AS point_id FROM embeddings),
x AS (SELECT point_id, generate_subscripts(d, 1) AS i, unnest(d) AS x FROM e),
m0 AS (SELECT point_id, list(x ORDER BY i) AS m FROM (SELECT point_id, i, avg(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT point_id, list_transform(m, lambda v: v / (sqrt(list_inner_product(m, m)) + 1e-8)) AS mu FROM m0)
SELECT point_id, count(*) AS n_obs, round(avg(list_distance(d, mu)), 6) AS spread, round(sum(pow(list_distance(d, mu), 2)), 5) AS energy FROM e JOIN m USING (point_id) GROUP BY 1
"""


@query("ppca_landmarks", _PPCA)
def ppca_landmarks(spark, sf_dir):
    """Subspaces of rank 2; their variances and the residual together make the total energy."""
    s = landmarks.subspaces(views.obs(spark, sf_dir), "point_id", "d", 2, order="vec_id")
    kept = F.aggregate("eigvals", F.lit(0.0), lambda a, x: a + x)
    rank = F.size("eigvals")
    energy = F.col("sigma_perp2") * (64 - rank) * F.col("n_obs") + (F.col("n_obs") - 1) * kept
    return s.select("point_id", "n_obs", r6(F.col("spread")).alias("spread"), F.round(energy, 5).alias("energy"))


@query("ppca_compact", _PPCA.replace(", 6) AS spread", ", 4) AS spread").replace(", 5) AS energy", ", 3) AS energy"))
def ppca_compact(spark, sf_dir):
    """The floored variant; where no floor is reached, its variances make the total energy too."""
    s = landmarks.subspaces(views.obs(spark, sf_dir), "point_id", "d", 2, floored=True, order="vec_id")
    kept = F.aggregate("eigvals", F.lit(0.0), lambda a, x: a + x)
    energy = (F.col("n_obs") - 1) * (kept + F.col("sigma_perp2") * (64 - F.size("eigvals")))
    return s.select("point_id", "n_obs", F.round("spread", 4).alias("spread"), F.round(energy, 3).alias("energy"))


@query("ppca_score")
def ppca_score(spark, sf_dir):
    """Observations of odd frames scored against their landmark's subspace of the even ones, by all scorers."""
    e = views.obs(spark, sf_dir)
    s = landmarks.subspaces(e.filter("frame_id % 2 = 0"), "point_id", "d", 2, order="vec_id")
    rows = e.filter("frame_id % 2 = 1").select("vec_id", "point_id", F.col("d").alias("desc")).join(s, "point_id").withColumn("cosine", vec.dot(F.col("desc"), F.col("mu"))).withColumn("staticness", F.lit(0.5))
    a = localize.score_rows(rows, localize.Matcher(scorer="ppca")).select("vec_id", r6(F.col("score")).alias("ppca"))
    b = localize.score_rows(rows, localize.Matcher(scorer="residual")).select("vec_id", r6(F.col("score")).alias("residual"))
    c = localize.score_rows(rows, localize.Matcher(scorer="compact")).select("vec_id", r6(F.col("score")).alias("compact"))
    return a.join(b, "vec_id").join(c, "vec_id")


_STORE = (
    _VIEWS
    + """, o AS (SELECT obs_id, any_value(landmark_id) AS landmark_id, any_value(frame_id) AS frame_id, any_value(reproj_error)::DOUBLE AS e FROM observations WHERE obs_id IS NOT NULL GROUP BY 1),
os AS (SELECT landmark_id, least(count(*), 65535) AS n_obs, count(DISTINCT frame_id) AS n_frames, avg(e) AS e FROM o WHERE landmark_id IS NOT NULL AND frame_id IS NOT NULL GROUP BY 1),
lm AS (SELECT landmark_id, any_value(mu) AS mu, any_value(eigvals) AS eigvals, any_value(sigma_perp2) AS sigma_perp2 FROM landmarks WHERE landmark_id IS NOT NULL GROUP BY 1),
ok AS (SELECT *, sqrt(sigma_perp2::DOUBLE) AS spread FROM lm WHERE len(mu) = 64 AND len(list_filter(mu, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND sigma_perp2 >= 0 AND NOT isnan(sigma_perp2)),
ag AS (SELECT x.point3d_id, degrees(acos(greatest(-1, least(1, x.a*y.a+x.b*y.b+x.c*y.c)))) AS g FROM d x JOIN d y ON x.point3d_id = y.point3d_id AND x.image_id < y.image_id),
nv AS (SELECT point3d_id, count(*) AS n_views FROM d GROUP BY 1), sv AS (SELECT point3d_id, avg(g) AS m, max(g) AS t FROM ag GROUP BY 1),
mz AS (SELECT point3d_id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM d GROUP BY 1), mm AS (SELECT point3d_id, a / n AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a*a+b*b+c*c) AS n FROM mz) y),
ev AS (SELECT d.point3d_id, min(d.a*mm.a+d.b*mm.b+d.c*mm.c) AS lo, max(d.a*mm.a+d.b*mm.b+d.c*mm.c) AS hi FROM d JOIN mm USING (point3d_id) GROUP BY 1),
al AS (SELECT os.landmark_id, pt.xyz, mu, eigvals, sigma_perp2, n_obs, n_frames, spread, e, lo, hi, CASE WHEN coalesce(n_views, 0) <= 1 THEN 0.35 ELSE greatest(0, least(1, 0.65::DOUBLE * m / 25 + 0.35::DOUBLE * t / 45)) END AS dv
  FROM os JOIN pt ON pt.point3d_id = os.landmark_id JOIN ok ON ok.landmark_id = os.landmark_id LEFT JOIN nv ON nv.point3d_id = os.landmark_id LEFT JOIN sv ON sv.point3d_id = os.landmark_id LEFT JOIN ev ON ev.point3d_id = os.landmark_id
  WHERE n_obs >= 2 AND pt.xyz IS NOT NULL),
sc AS (SELECT *, least(1, greatest(0, 0.45::DOUBLE * tanh(n_obs / 6.0::DOUBLE) + 0.25::DOUBLE * exp(-spread) + 0.2::DOUBLE * exp(-greatest(0, coalesce(e, 0))) + 0.1::DOUBLE * dv)) AS st FROM al)
SELECT landmark_id, xyz, mu, eigvals, sigma_perp2, n_obs, n_frames, round(spread, 5) AS spread, round(st, 5) AS staticness, round(coalesce(lo, -1), 5) AS min_cos, round(coalesce(hi, 1), 5) AS max_cos FROM sc WHERE st >= 0.2
"""
)


@query("landmark_store", _STORE)
def landmark_store(spark, sf_dir):
    """The landmark table built from observations, tracks and the summaries of the descriptors."""
    points = table(spark, sf_dir, "points3d")
    seen = landmarks.track_views(points, table(spark, sf_dir, "images"))
    described = landmarks.stored_summaries(table(spark, sf_dir, "landmarks"), 64)
    s = landmarks.build_store(table(spark, sf_dir, "observations"), seen, points, described, min_obs=2, min_static=0.2)
    return s.select(
        *("landmark_id", "xyz", "mu", "eigvals", "sigma_perp2", "n_obs", "n_frames"),
        *(F.round(c, 5).alias(c) for c in ("spread", "staticness", "min_cos", "max_cos")),
    )


# --- retrieval -----------------------------------------------------------------

_TOP = (
    _OBS
    + """, c AS (SELECT vec_id AS anchor_id, lm.point_id, list_cosine_similarity(d, mu) AS cos FROM e, lm WHERE ho),
k AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY round(cos, 12) DESC, point_id) AS rk FROM c)
"""
)


def top10(spark, sf_dir):
    lms, anchors = memory(spark, sf_dir)
    return retrieval.topk_cosine(anchors, "anchor_id", "desc", lms, "point_id", "mu", 10)


@query("topk_cosine_join", _TOP + "SELECT anchor_id, point_id, rk::INTEGER AS rk, round(cos, 6) AS cosine FROM k WHERE rk <= 10")
def topk_cosine_join(spark, sf_dir):
    return top10(spark, sf_dir).withColumn("cosine", r6(F.col("cosine")))


@query(
    "topk_within_images",
    """
WITH a AS (SELECT anchor_id, any_value(query_id) AS query_id, any_value(descriptor)::DOUBLE[] AS x FROM anchors WHERE anchor_id IS NOT NULL GROUP BY 1),
g AS (SELECT * FROM a WHERE len(x) = 64 AND len(list_filter(x, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND list_inner_product(x, x) > 0),
l AS (SELECT landmark_id, any_value(mu)::DOUBLE[] AS y FROM landmarks WHERE landmark_id IS NOT NULL GROUP BY 1),
h AS (SELECT * FROM l WHERE len(y) = 64 AND len(list_filter(y, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND list_inner_product(y, y) > 0),
s AS (SELECT DISTINCT frame_id AS query_id, landmark_id FROM observations WHERE frame_id IS NOT NULL AND landmark_id IS NOT NULL),
c AS (SELECT anchor_id, landmark_id, list_cosine_similarity(x, y) AS cos FROM g JOIN s USING (query_id) JOIN h USING (landmark_id))
SELECT anchor_id, landmark_id, rk::INTEGER AS rk, round(cos, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY round(cos, 9) DESC, landmark_id) AS rk FROM c) z WHERE rk <= 5""",
)
def topk_within_images(spark, sf_dir):
    """Top 5 landmarks of each anchor among those observed in its own image, block by block."""
    good = lambda c: views.finite(c, 64) & (vec.norm(F.col(c)) > 0)
    a = landmarks.once(table(spark, sf_dir, "anchors"), "anchor_id").filter(good("descriptor")).select("anchor_id", "query_id", F.col("descriptor").alias("x"))
    h = landmarks.once(table(spark, sf_dir, "landmarks"), "landmark_id").filter(good("mu")).select("landmark_id", F.col("mu").alias("y"))
    s = table(spark, sf_dir, "observations").select(F.col("frame_id").alias("query_id"), "landmark_id").filter("query_id is not null and landmark_id is not null")
    got = retrieval.topk_cosine_within(a, "anchor_id", "x", h, "landmark_id", "y", s, "query_id", 5)
    return got.select("anchor_id", "landmark_id", "rk", F.round("cosine", 5).alias("cosine"))


@query(
    "mutual_nearest",
    _TOP + """, b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(cos, 12) DESC, anchor_id) AS rb FROM k)
SELECT anchor_id, point_id, round(cos, 6) AS cosine FROM b WHERE rk = 1 AND rb = 1 AND cos >= 0.05""",
)
def mutual_nearest(spark, sf_dir):
    lms, anchors = memory(spark, sf_dir)
    got = retrieval.mutual_nearest(anchors, "anchor_id", "desc", lms, "point_id", "mu", 0.05)
    return got.select("anchor_id", "point_id", r6(F.col("cosine")).alias("cosine"))


@query(
    "adaptive_cosine_filter",
    MATCHES_SQL + """, b AS (SELECT *, max(coarse_cos) OVER (PARTITION BY query_id, anchor_index) AS best FROM m)
SELECT query_id, anchor_index, landmark_id, coarse_cos FROM b WHERE coarse_cos >= greatest(0.2::DOUBLE, best - 0.2::DOUBLE)""",
)
def adaptive_cosine_filter(spark, sf_dir):
    got = retrieval.adaptive_cosine(views.matches(spark, sf_dir), ["query_id", "anchor_index"], "coarse_cos", 0.2, 0.2)
    return got.select("query_id", "anchor_index", "landmark_id", "coarse_cos")


_ACCEPTED = (
    MATCHES_SQL
    + """, r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS s2 FROM m WINDOW w AS (PARTITION BY query_id, anchor_index ORDER BY score DESC, landmark_id)),
g AS (SELECT * FROM r WHERE rk = 1 AND (s2 IS NULL OR score - s2 >= margin_min) AND coarse_cos >= coarse_cosine_min)
"""
)


def accepted_matches(spark, sf_dir):
    rows = views.matches(spark, sf_dir)
    return retrieval.accepted(rows, ["query_id", "anchor_index"], "score", "landmark_id", margin=F.col("margin_min"), cosine="coarse_cos", least_cosine=F.col("coarse_cosine_min"))


@query("ratio_margin_filter", _ACCEPTED + "SELECT query_id, anchor_index, landmark_id, score FROM g")
def ratio_margin_filter(spark, sf_dir):
    return accepted_matches(spark, sf_dir).select("query_id", "anchor_index", "landmark_id", "score")


@query("best_per_landmark", _ACCEPTED + "SELECT query_id, landmark_id, anchor_index, score FROM g QUALIFY row_number() OVER (PARTITION BY query_id, landmark_id ORDER BY score DESC, anchor_index) = 1")
def best_per_landmark(spark, sf_dir):
    return retrieval.best_per_item(accepted_matches(spark, sf_dir), ["query_id"], "landmark_id", "score", "anchor_index").select("query_id", "landmark_id", "anchor_index", "score")


@query(
    "materialize_cap",
    MATCHES_SQL
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, anchor_index ORDER BY coarse_cos DESC, landmark_id) AS rk FROM m),
s AS (SELECT * FROM (SELECT *, max(coarse_cos) OVER (PARTITION BY query_id, anchor_index) AS top FROM f WHERE rk <= 4) z WHERE top < 0.5::DOUBLE OR coarse_cos >= 0.5::DOUBLE),
h AS (SELECT query_id, landmark_id, count(*) AS n_hits, max(coarse_cos) AS best FROM s GROUP BY 1, 2)
SELECT query_id, landmark_id, n_hits, best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_hits DESC, best DESC, landmark_id) AS k FROM h) y WHERE k <= 20""",
)
def materialize_cap(spark, sf_dir):
    return retrieval.materialize_cap(views.matches(spark, sf_dir), ["query_id"], "anchor_index", "landmark_id", "coarse_cos", 4, 0.5, 20)


@query(
    "fine_fusion_rerank",
    MATCHES_SQL
    + """, f AS (SELECT *, 0.5::DOUBLE * coarse_cos + 0.5::DOUBLE * score AS fused FROM m)
SELECT query_id, anchor_index, landmark_id, round(fused, 6) AS fused, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, anchor_index ORDER BY fused DESC, landmark_id) AS rk FROM f) z WHERE rk <= 3""",
)
def fine_fusion_rerank(spark, sf_dir):
    got = retrieval.fuse(views.matches(spark, sf_dir), ["query_id", "anchor_index"], "coarse_cos", "score", "landmark_id", 0.5).filter("rk <= 3")
    return got.select("query_id", "anchor_index", "landmark_id", r6(F.col("fused")).alias("fused"), "rk")


@query(
    "fine_rerank_shortlist",
    _TOP
    + """, f AS (SELECT anchor_id, k.point_id, k.cos, list_inner_product(e.d[33:64], lm.mu[33:64]) AS fine, st FROM k JOIN e ON e.vec_id = anchor_id JOIN lm ON lm.point_id = k.point_id WHERE rk <= 4)
SELECT anchor_id, point_id, round(fine, 6) AS fine, round(fine + 0.6::DOUBLE * st, 6) AS final FROM f""",
)
def fine_rerank_shortlist(spark, sf_dir):
    lms, anchors = memory(spark, sf_dir)
    rows = top10(spark, sf_dir).join(lms, "point_id").join(anchors, "anchor_id")
    rows = rows.withColumns({"fa": F.slice("desc", 33, 32), "fs": F.array(F.slice("mu", 33, 32))})
    got = retrieval.fine_rerank(rows, ["anchor_id"], "cosine", "point_id", "fa", "fs", 4, 0.6 * F.col("staticness"), F.col("n_obs"))
    return got.select("anchor_id", "point_id", r6(F.col("fine")).alias("fine"), r6(F.col("final")).alias("final"))


# --- indexes and candidates ---------------------------------------------------------


@query("image_landmark_index", RETRIEVALS_SQL + "SELECT frame_id, lm_idx, rnk::INTEGER AS rnk FROM (SELECT frame_id, i.lm_idx, row_number() OVER (PARTITION BY frame_id ORDER BY staticness DESC, n_obs DESC, i.lm_idx) AS rnk FROM v_idx i JOIN v_lm_attr a ON i.lm_idx = a.lm_idx) x WHERE rnk <= 2")
def image_landmark_index(spark, sf_dir):
    return landmarks.image_index(views.idx(spark, sf_dir), views.lm_attr(spark, sf_dir), 2)


@query(
    "keypoint_landmark_index",
    """
WITH e AS (SELECT DISTINCT image_id AS frame_id, unnest(point3d_ids) AS lm_idx FROM images WHERE image_id IS NOT NULL),
l AS (SELECT landmark_id AS lm_idx, any_value(staticness) AS s, any_value(support_count) AS n FROM landmarks WHERE landmark_id IS NOT NULL GROUP BY 1)
SELECT frame_id, lm_idx, rnk::INTEGER AS rnk FROM (SELECT frame_id, lm_idx, row_number() OVER (PARTITION BY frame_id ORDER BY s DESC NULLS LAST, n DESC NULLS LAST, lm_idx) AS rnk FROM e JOIN l USING (lm_idx)) z WHERE rnk <= 50""",
)
def keypoint_landmark_index(spark, sf_dir):
    """The image index of the reconstruction itself."""
    e = table(spark, sf_dir, "images").filter("image_id is not null").select(F.col("image_id").alias("frame_id"), F.explode("point3d_ids").alias("lm_idx")).distinct()
    a = landmarks.once(table(spark, sf_dir, "landmarks"), "landmark_id").select(F.col("landmark_id").alias("lm_idx"), "staticness", F.col("support_count").alias("n_obs"))
    return landmarks.image_index(e, a, 50)


@query(
    "rank_weighted_votes",
    RETRIEVALS_SQL + """SELECT query_id, lm_idx, vote, rk::INTEGER AS rk FROM (SELECT query_id, lm_idx, vote, row_number() OVER (PARTITION BY query_id ORDER BY vote DESC, lm_idx) AS rk
 FROM (SELECT query_id, lm_idx, round(sum(1.0E0 / (rnk + 1)), 6) AS vote FROM v_retrievals r JOIN v_idx i ON r.frame_id = i.frame_id GROUP BY query_id, lm_idx) a) b WHERE rk <= 20""",
)
def rank_weighted_votes(spark, sf_dir):
    return landmarks.votes(views.retrievals(spark, sf_dir), views.idx(spark, sf_dir), 20)


def expanded(spark, sf_dir):
    return candidates.expand(candidates.retrieved(views.retrievals(spark, sf_dir), 20), views.idx(spark, sf_dir))


_EXPANDED = RETRIEVALS_SQL + ", x AS (SELECT query_id, r.frame_id, rnk, lm_idx FROM v_retrievals r JOIN v_idx i ON r.frame_id = i.frame_id)"


@query("covisibility_pairs", _EXPANDED + "SELECT a.query_id, a.frame_id AS f1, b.frame_id AS f2, count(*) AS n FROM x a JOIN x b ON a.query_id = b.query_id AND a.lm_idx = b.lm_idx AND a.frame_id < b.frame_id GROUP BY 1, 2, 3")
def covisibility_pairs(spark, sf_dir):
    return candidates.covisibility(expanded(spark, sf_dir))


@query("candidates_first_seen", _EXPANDED + "SELECT query_id, lm_idx, rnk::INTEGER AS rnk, pos::INTEGER AS pos FROM (SELECT query_id, lm_idx, rnk, row_number() OVER (PARTITION BY query_id, lm_idx ORDER BY rnk) AS k, row_number() OVER (PARTITION BY query_id ORDER BY rnk, lm_idx) AS pos FROM x) z WHERE k = 1")
def candidates_first_seen(spark, sf_dir):
    return candidates.first_seen(expanded(spark, sf_dir)).withColumn("rnk", F.col("rnk").cast("int"))


@query(
    "candidate_budget",
    _EXPANDED + """, f AS (SELECT query_id, lm_idx, min(rnk) AS rnk FROM x GROUP BY 1, 2)
SELECT query_id, lm_idx, rnk::INTEGER AS rnk, k::INTEGER AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rnk ORDER BY lm_idx) AS k FROM f) z WHERE k <= 3""",
)
def candidate_budget(spark, sf_dir):
    return candidates.budgets(expanded(spark, sf_dir), 60, 20).withColumn("rnk", F.col("rnk").cast("int"))


@query(
    "covisibility_groups",
    _EXPANDED.replace("WITH v_idx", "WITH RECURSIVE v_idx", 1)
    + """, se AS (SELECT query_id AS q, rnk, frame_id AS f, list(lm_idx) AS lms FROM x GROUP BY 1, 2, 3),
fi AS (SELECT q, list(rnk ORDER BY rnk) AS rest FROM se GROUP BY 1),
st(q, grp, place, rest, un, f) AS (SELECT fi.q, 0, 0, rest[2:], lms, f FROM fi JOIN se ON se.q = fi.q AND se.rnk = rest[1]
  UNION ALL SELECT q, CASE WHEN place = 4 THEN grp + 1 ELSE grp END, CASE WHEN place = 4 THEN 0 ELSE place + 1 END, list_filter(rest, lambda v: v <> rnk), CASE WHEN place = 4 THEN lms ELSE list_distinct(list_concat(un, lms)) END, f2
    FROM (SELECT st.q, grp, place, rest, un, se.rnk, se.lms, se.f AS f2, row_number() OVER (PARTITION BY st.q ORDER BY CASE WHEN place = 4 THEN 0 ELSE len(list_intersect(lms, un)) END DESC, se.rnk) AS k
      FROM st JOIN se ON se.q = st.q AND list_contains(st.rest, se.rnk)) z WHERE k = 1)
SELECT q AS query_id, f AS frame_id, grp AS group_no, place FROM st""",
)
def covisibility_groups(spark, sf_dir):
    return candidates.covisibility_groups(expanded(spark, sf_dir), 5)


@query("sequential_groups", RETRIEVALS_SQL + "SELECT query_id, frame_id, (rnk // 5)::INTEGER AS group_no FROM v_retrievals")
def sequential_groups(spark, sf_dir):
    return candidates.groups_in_order(views.retrievals(spark, sf_dir), 5).select("query_id", "frame_id", "group_no")


@query(
    "stage_schedule",
    RETRIEVALS_SQL
    + """, t AS (SELECT query_id, count(*) AS n FROM v_retrievals GROUP BY 1),
s AS (SELECT DISTINCT query_id, least(x, n) AS s FROM t, (SELECT unnest([4, 10, 20]) AS x) l UNION SELECT query_id, n FROM t),
g AS (SELECT query_id, rnk // 3 AS group_no, count(*) AS k FROM v_retrievals GROUP BY 1, 2),
c AS (SELECT *, sum(k) OVER (PARTITION BY query_id ORDER BY group_no) AS so_far FROM g)
SELECT c.query_id, c.group_no::INTEGER AS group_no, any_value(so_far)::BIGINT AS images_so_far, min(s)::BIGINT AS stage FROM c JOIN s ON c.query_id = s.query_id AND so_far - k < s GROUP BY 1, 2""",
)
def stage_schedule(spark, sf_dir):
    r = views.retrievals(spark, sf_dir)
    schedule = candidates.stage_schedule(r.groupBy("query_id").agg(F.count("*").alias("n_images")), [4, 10, 20])
    return candidates.stage_of_groups(candidates.groups_in_order(r, 3), schedule)


@query("index_restrict_semi", RETRIEVALS_SQL + "SELECT frame_id, count(*) AS n FROM v_idx WHERE frame_id IN (SELECT frame_id FROM v_retrievals) GROUP BY 1")
def index_restrict_semi(spark, sf_dir):
    return candidates.restrict_index(views.idx(spark, sf_dir), views.retrievals(spark, sf_dir)).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("cache_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def cache_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return candidates.pending(table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query(
    "set_union_diff",
    """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) u UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) i
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) e""",
)
def set_union_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a, b = (rows.filter(F.col("l_returnflag") == f).select("l_partkey").distinct() for f in "RA")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersect")).unionByName(count(a.subtract(b), "except"))


@query("top_landmarks", RETRIEVALS_SQL + "SELECT lm_idx, staticness, n_obs FROM v_lm_attr ORDER BY staticness DESC, n_obs DESC, lm_idx LIMIT 100")
def top_landmarks(spark, sf_dir):
    return landmarks.top_landmarks(views.lm_attr(spark, sf_dir), 100).select("lm_idx", "staticness", "n_obs")


@query(
    "preferred_observations",
    """
WITH o AS (SELECT obs_id, any_value(landmark_id) AS landmark_id, any_value(frame_id) AS frame_id FROM observations WHERE obs_id IS NOT NULL GROUP BY 1),
p AS (SELECT *, frame_id % 3 = 0 AS pref FROM o WHERE landmark_id IS NOT NULL AND frame_id IS NOT NULL), c AS (SELECT *, count(*) FILTER (pref) OVER (PARTITION BY landmark_id) AS n FROM p)
SELECT obs_id, landmark_id, frame_id FROM c WHERE n < 2 OR pref""",
)
def preferred_observations(spark, sf_dir):
    rows = landmarks.once(table(spark, sf_dir, "observations"), "obs_id").filter("landmark_id is not null and frame_id is not null").withColumn("pref", F.col("frame_id") % 3 == 0)
    return candidates.preferred(rows, "landmark_id", "pref").select("obs_id", "landmark_id", "frame_id")


# --- assignment -------------------------------------------------------------------


def edges(spark, sf_dir):
    rows = views.matches(spark, sf_dir).filter("coarse_cos >= coarse_cosine_min")
    return rows.select("query_id", "anchor_index", "landmark_id", "score")


def _greedy_sql(edges: str, out: str) -> str:
    """Tables of rounds: the edges that are the best left at both ends are taken, what shares an end with them leaves."""
    return f""", {out}_r(query_id, anchor_index, landmark_id, score, done) AS (SELECT query_id, anchor_index, landmark_id, score, false FROM {edges}
  UNION ALL SELECT query_id, anchor_index, landmark_id, score, b FROM (SELECT *, bool_or(b) OVER (PARTITION BY query_id, anchor_index) AS lt, bool_or(b) OVER (PARTITION BY query_id, landmark_id) AS rt
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, anchor_index ORDER BY score DESC, anchor_index, landmark_id) = 1 AND row_number() OVER (PARTITION BY query_id, landmark_id ORDER BY score DESC, anchor_index, landmark_id) = 1 AS b
      FROM {out}_r WHERE NOT done) y) x WHERE b OR NOT (lt OR rt)),
{out} AS (SELECT query_id, anchor_index, landmark_id, score FROM {out}_r WHERE done)
"""


_RECURSIVE = MATCHES_SQL.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + ", e AS (SELECT query_id, anchor_index, landmark_id, score FROM m WHERE coarse_cos >= coarse_cosine_min)"


@query("greedy_assignment", _RECURSIVE + _greedy_sql("e", "g") + "SELECT query_id, anchor_index, landmark_id, score FROM g")
def greedy_assignment(spark, sf_dir):
    """One-to-one matches of every query by rounds of locally best edges."""
    return assign.greedy_rounds(edges(spark, sf_dir), "query_id", "anchor_index", "landmark_id", "score")


_FILLED = """, r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS s2 FROM m WINDOW w AS (PARTITION BY query_id, anchor_index ORDER BY score DESC, landmark_id)),
acc AS (SELECT query_id, anchor_index, landmark_id, score FROM r WHERE rk = 1 AND (s2 IS NULL OR score - s2 >= margin_min) AND coarse_cos >= coarse_cosine_min),
cnt AS (SELECT query_id, count(*) AS n, list(landmark_id) AS used FROM acc GROUP BY 1),
st(query_id, n, used, a, l, s, i) AS (SELECT q.query_id, coalesce(n, 0), coalesce(used, []::BIGINT[]), NULL::INTEGER, NULL::BIGINT, NULL::DOUBLE, 0 FROM (SELECT DISTINCT query_id FROM e) q LEFT JOIN cnt ON q.query_id = cnt.query_id WHERE coalesce(n, 0) < 4
  UNION ALL SELECT query_id, n + 1, list_append(used, landmark_id), anchor_index, landmark_id, score, i + 1 FROM (SELECT st.query_id, n, used, i, e.anchor_index, e.landmark_id, e.score,
      row_number() OVER (PARTITION BY st.query_id ORDER BY e.anchor_index, e.score DESC, e.landmark_id) AS k
    FROM st JOIN e ON st.query_id = e.query_id WHERE n < 4 AND (a IS NULL OR e.anchor_index > a) AND NOT list_contains(used, e.landmark_id)) z WHERE k = 1),
fil AS (SELECT * FROM acc UNION ALL SELECT query_id, a, l, s FROM st WHERE i > 0)
"""


@query("assignment_capped", _RECURSIVE + _FILLED + _greedy_sql("fil", "g") + "SELECT query_id, anchor_index, landmark_id, score FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor_index) <= 32")
def assignment_capped(spark, sf_dir):
    """The same in one pass over each query, cut to the 32 best matches, filled up to 4."""
    all_edges = edges(spark, sf_dir)
    best = accepted_matches(spark, sf_dir).select("query_id", "anchor_index", "landmark_id", "score")
    filled = assign.fill_matches(best, all_edges, "query_id", "anchor_index", "landmark_id", "score", 4)
    return assign.capped(assign.greedy(filled, "query_id", "anchor_index", "landmark_id", "score"), "query_id", "score", 32, "anchor_index")


@query(
    "all_pairs_by_scene",
    """
WITH i AS (SELECT image_id, any_value(scene_id) AS scene_id FROM images WHERE image_id IS NOT NULL GROUP BY 1), d AS (SELECT scene_id, image_id AS frame_id, row_number() OVER (PARTITION BY scene_id ORDER BY image_id) - 1 AS rnk FROM i WHERE scene_id IS NOT NULL)
SELECT i.image_id AS query_id, frame_id, rnk::INTEGER AS rnk FROM i JOIN d USING (scene_id) WHERE rnk < 10""",
)
def all_pairs_by_scene(spark, sf_dir):
    i = landmarks.once(table(spark, sf_dir, "images"), "image_id").filter("scene_id is not null")
    return candidates.all_pairs(i.select("scene_id", F.col("image_id").alias("query_id")), i.select("scene_id", F.col("image_id").alias("frame_id")), "scene_id", 10)


