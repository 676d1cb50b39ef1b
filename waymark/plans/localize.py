"""Plans: matching, staged verification and localization of queries against a landmark map.

The matching core is one DataFrame plan: retrieval gives narrow rows (query,
anchor, landmark, cosine); wide landmark columns are joined for the shortlist
only; scores are column expressions; acceptance, fallback and one-to-one
assignment follow. Staged verification repeats it on growing candidate sets for
the queries that aren't solved yet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import scores, vec
from waymark.operators import assign, evaluate, landmarks, pnp, retrieval
from waymark.tables import cut


@dataclass(frozen=True)
class Matcher:
    """Settings of one matching pass; scorer: residual, ppca or compact."""

    topk: int = 10
    weights: scores.Weights = scores.Weights(l4=0.0, l5=0.0)
    scorer: str = "residual"
    least_cosine: float = -1.0
    adaptive_margin: float | None = None
    least_score: float = -1e9
    margin: float = 0.0
    per_anchor: int = 4
    most_loaded: int = 1_000_000
    guarantee: int = 0
    most_matches: int = 256
    dim: int = 64


def score_rows(rows: DataFrame, m: Matcher) -> DataFrame:
    """rows: desc, mu, cosine, staticness, n_obs, and where they exist basis, eigvals, sigma_perp2, spread, view, geometry."""
    have = set(rows.columns)
    view = F.col("view") if "view" in have else F.lit(0.0)
    geometry = F.col("geometry") if "geometry" in have else F.lit(0.0)
    aux = scores.auxiliary(F.col("staticness"), view, geometry, m.weights)
    offset = F.zip_with(vec.doubles(F.col("desc")), vec.doubles(F.col("mu")), lambda a, b: a - b)
    c = F.transform("basis", lambda u: vec.dot(u, offset)) if "basis" in have else F.array().cast("array<double>")
    off2 = vec.distance2(F.col("desc"), F.col("mu"))
    if m.scorer == "residual":
        s = scores.coarse_residual(scores.residual(off2, c), F.col("cosine"), aux, geometry, m.weights)
    else:
        sigma = scores.sigma_or_fallback(F.col("sigma_perp2"), F.col("spread"), m.dim)
        parallel = scores.parallel_term(c, F.col("eigvals"))
        perpendicular = scores.residual(off2, c) / (sigma + 1e-6)
        if m.scorer == "ppca":
            s = scores.coarse_ppca(parallel, perpendicular, F.col("cosine"), aux, geometry, F.col("n_obs"), m.weights)
        else:
            s = scores.compact(F.col("cosine"), parallel, perpendicular, F.col("staticness"), F.col("n_obs"), view, F.lit(0.0))
    return rows.withColumn("score", s)


def match(anchors: DataFrame, lms: DataFrame, m: Matcher = Matcher(), candidates: DataFrame | None = None, prior: DataFrame | None = None, edge: float = 60.0) -> DataFrame:
    """(query_id, anchor_idx, point_id, score, cosine): one-to-one matches of each query.

    anchors: anchor_id, query_id, anchor_idx, desc. lms: point_id, mu, staticness, n_obs, ... candidates:
    (query_id, point_id) if a query may only see some landmarks; without it, all. prior: (query_id, T_wc, camera)
    of queries whose pose is known roughly: candidates off it by `edge` pixels or behind it are closed (then anchors
    also have u, v and lms x, y, z).
    """
    if candidates is None:
        top = retrieval.topk_cosine(anchors, "anchor_id", "desc", lms, "point_id", "mu", m.topk, m.dim).drop("rk")
        near = top.join(anchors.select("anchor_id", "query_id", "anchor_idx"), "anchor_id")
    else:
        top = retrieval.topk_cosine_within(anchors, "anchor_id", "desc", lms, "point_id", "mu", candidates, "query_id", m.topk, m.dim)
        near = top.drop("rk").join(anchors.select("anchor_id", "query_id", "anchor_idx"), "anchor_id")
    near = cut(near)  # k rows an anchor, read three times
    anchor = ["query_id", "anchor_idx"]
    short = retrieval.materialize_cap(near, ["query_id"], "anchor_idx", "point_id", "cosine", m.per_anchor, m.least_cosine, m.most_loaded)
    passed = near.filter(F.col("cosine") >= m.least_cosine) if m.adaptive_margin is None else retrieval.adaptive_cosine(near, anchor, "cosine", m.least_cosine, m.adaptive_margin).drop("floor")
    passed = passed.join(short.select("query_id", "point_id"), ["query_id", "point_id"], "left_semi")
    wide = retrieval.late_join(passed, short, lms, "point_id").join(anchors.select("anchor_id", "desc"), "anchor_id")
    if prior is not None:
        gates = with_prior(passed, prior, lms, anchors, edge)
        wide = wide.join(gates, ["query_id", "anchor_idx", "point_id"])
    scored = score_rows(wide, m).filter(F.col("score") > scores.GATED)  # the geometry gate closes candidates
    scored = cut(scored.select("query_id", "anchor_idx", "point_id", "cosine", "score"))
    best = retrieval.accepted(scored, anchor, "score", "point_id", m.least_score, m.margin)
    edges = best.select("query_id", "anchor_idx", "point_id", "score")
    if m.guarantee:
        edges = assign.fill_matches(edges, scored, "query_id", "anchor_idx", "point_id", "score", m.guarantee)
    chosen = assign.greedy(edges, "query_id", "anchor_idx", "point_id", "score")
    return assign.capped(chosen, "query_id", "score", m.most_matches, "anchor_idx")


def localize(anchors: DataFrame, lms: DataFrame, cameras: DataFrame, m: Matcher = Matcher(), how: pnp.Ransac = pnp.Ransac(), candidates: DataFrame | None = None, prior: DataFrame | None = None, edge: float = 60.0) -> DataFrame:
    """A pose row for every query of `cameras` (query_id, camera); anchors also have u, v; lms also have x, y, z."""
    found = match(anchors, lms, m, candidates, prior, edge)
    full = found.join(anchors.select("query_id", "anchor_idx", "u", "v"), ["query_id", "anchor_idx"]).join(lms.select("point_id", "x", "y", "z"), "point_id").join(cameras, "query_id")
    poses = pnp.solve_poses(full, "query_id", how)
    none = {"success": F.lit(False), "num_inliers": F.lit(0), "num_matches": F.lit(0)}
    out = cameras.select("query_id").join(poses, "query_id", "left")
    return out.withColumns({c: F.coalesce(c, v) for c, v in none.items()})


def localize_refined(anchors: DataFrame, lms: DataFrame, cameras: DataFrame, m: Matcher = Matcher(), how: pnp.Ransac = pnp.Ransac(), candidates: DataFrame | None = None, least_matches: int = 12, least_inliers: int = 8, edge: float = 60.0) -> DataFrame:
    """Early geometry: a fast first pose with a wider threshold, then matching and pose again with that pose as prior.

    Queries whose first pose rests on too few matches or inliers keep their first matches; all get the final pose solver.
    """
    fast = replace(how, error_px=max(1.5 * how.error_px, 8.0), iterations=min(how.iterations, 512))
    first = cut(localize(anchors, lms, cameras, m, fast, candidates))
    sure = first.filter((F.col("num_matches") >= least_matches) & (F.col("num_inliers") >= least_inliers) & F.col("success"))
    prior = cut(sure.select("query_id", "T_wc").join(cameras, "query_id"))
    return localize(anchors, lms, cameras, m, how, candidates, prior, edge)


def localize_staged(anchors: DataFrame, lms: DataFrame, cameras: DataFrame, groups: DataFrame, schedule: DataFrame, group_landmarks: DataFrame, m: Matcher = Matcher(), how: pnp.Ransac = pnp.Ransac(), enough: int = 24, hard: int = 40) -> DataFrame:
    """Staged verification: candidates grow by stage, queries stop once a pose has `enough` inliers; the best pose of all stages stays.

    groups: (query_id, group_no, stage) of candidates.stage_of_groups joined with the stage's number; schedule:
    (query_id, stages); group_landmarks: (query_id, group_no, point_id).
    """
    active = cut(cameras.join(schedule, "query_id"))
    best = None
    depth = active.select(F.max(F.size("stages"))).first()[0] or 0
    for i in range(depth):
        now = active.filter(F.size("stages") > i).withColumn("limit", F.col("stages")[i])
        seen = groups.join(now.select("query_id", "limit"), "query_id").filter(F.col("stage") <= F.col("limit")).select("query_id", "group_no")
        candidates = group_landmarks.join(seen, ["query_id", "group_no"]).select("query_id", "point_id").distinct()
        mine = anchors.join(now.select("query_id"), "query_id", "left_semi")
        got = cut(localize(mine, lms, now.select("query_id", "camera"), m, how, candidates).withColumn("stage_no", F.lit(i)))
        best = got if best is None else best.unionByName(got)
        done = got.filter(F.col("num_inliers") >= min(enough, hard)).select("query_id")
        active = cut(active.join(done, "query_id", "left_anti"))
        if active.isEmpty():
            break
    order = F.struct("num_inliers", -F.coalesce("reproj_error", F.lit(1e18)), -F.col("stage_no"))
    stop = F.when(F.col("num_inliers") >= hard, "hard").when(F.col("num_inliers") >= enough, "min").otherwise("all")
    top = best.groupBy("query_id").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
    return top.withColumn("stop", stop)


def with_prior(matches_of: DataFrame, poses: DataFrame, lms: DataFrame, anchors: DataFrame, edge: float = 60.0) -> DataFrame:
    """Early geometry: the geometry gate of each candidate from a first pose; (query_id, anchor_idx, point_id, geometry)."""
    from waymark.functions import pose

    rows = matches_of.join(poses.select("query_id", "T_wc", "camera"), "query_id", "left").join(lms.select("point_id", "x", "y", "z"), "point_id").join(anchors.select("query_id", "anchor_idx", "u", "v"), ["query_id", "anchor_idx"])
    cam = F.col("camera")
    rows = rows.withColumn("__p", pose.project(F.col("T_wc"), F.array("x", "y", "z"), cam[0], cam[1], cam[2], cam[3]))
    p = F.col("__p")
    rows = rows.withColumn("__e", pose.reprojection_error(p, F.col("u"), F.col("v")))
    gate = scores.geometry_gate(F.col("__e"), F.coalesce(p["z"] > 1e-6, F.lit(False)), F.col("T_wc").isNotNull(), edge)
    return rows.select("query_id", "anchor_idx", "point_id", gate.alias("geometry"))


def report(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Pose errors of the queries and the summary of the run."""
    with_errors = evaluate.errors(rows.join(truth, "query_id", "left"), "T_wc", "gt")
    return evaluate.summary(with_errors, [], "success", ["trans_err_m", "rot_err_deg"])


__all__ = ["Matcher", "match", "localize", "localize_staged", "with_prior", "report", "score_rows", "landmarks"]
