"""Operators without SQL: subspaces, assignment, groups, selection, poses, tracks, extraction."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark import config
from waymark.functions import pose, vec
from waymark.operators import anchors, assign, candidates, evaluate, landmarks, pnp, retrieval, spatial, tracks
from waymark.plans import localize


def turned(rng):
    return pnp.absolute_orientation(rng.normal(size=(5, 3)), rng.normal(size=(5, 3)))[0]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 4), st.integers(0, 10**6))
def test_subspace_identities(n, rank, seed):
    x = np.random.default_rng(seed).normal(size=(n, 8))
    s = landmarks.subspace(x, rank)
    b = s["basis"]
    assert np.allclose(b @ b.T, np.eye(len(b)), atol=1e-9)
    z = x - s["mu"]
    total = (z * z).sum()
    if n > 1:
        kept = (n - 1) * s["eigvals"].sum() + s["sigma_perp2"] * max(1, 8 - len(b)) * n
        assert np.isclose(kept, total) or s["sigma_perp2"] == 1e-6
    assert np.allclose(landmarks.subspace(x[::-1], rank)["eigvals"], s["eigvals"])


def test_subspace_floored():
    x = np.random.default_rng(0).normal(size=(9, 6))
    s = landmarks.subspace_floored(x, 3)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = n - s["mu"]
    assert np.isclose(s["eigvals"].sum() + 3 * s["sigma_perp2"], (z * z).sum() / 8)
    one = landmarks.subspace_floored(x[:1], 3)
    assert one["sigma_perp2"] == 1e-3 and not one["basis"].any()


def test_greedy_forms_agree(spark):
    rnd = random.Random(5)
    rows = [(q, rnd.randint(0, 12), rnd.randint(0, 12), rnd.choice([0.1, 0.2, 0.3, 0.4, None, float("nan")])) for q in range(4) for _ in range(80)]
    rows = list({(q, a, b): (q, a, b, s) for q, a, b, s in rows}.values())
    df = spark.createDataFrame(rows, "q int, l int, r int, s double")
    want = set()
    for q in range(4):
        used_l, used_r = set(), set()
        for s, a, b in sorted((-s, a, b) for x, a, b, s in rows if x == q and s is not None and s == s):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                want.add((q, a, b, -s))
    for f in (assign.greedy, assign.greedy_rounds):
        assert {tuple(r) for r in f(df, "q", "l", "r", "s").collect()} == want


def test_fill_matches(spark):
    kind = "q int, l int, r int, s double"
    m = spark.createDataFrame([(1, 0, 0, 0.9)], kind)
    c = spark.createDataFrame([(1, 0, 0, 0.9), (1, 1, 0, 0.8), (1, 1, 2, 0.5), (1, 2, 2, 0.7), (1, 2, 3, 0.1), (2, 0, 7, 0.3)], kind)
    got = {(r.q, r.l, r.r) for r in assign.fill_matches(m, c, "q", "l", "r", "s", 3).collect()}
    assert got == {(1, 0, 0), (1, 1, 2), (1, 2, 3), (2, 0, 7)}


def test_covisibility_groups(spark):
    rows = [(1, 0, 10, x) for x in (1, 2, 3)] + [(1, 1, 11, x) for x in (7, 8)] + [(1, 2, 12, x) for x in (2, 3, 7)] + [(1, 3, 13, x) for x in (9,)]
    got = candidates.covisibility_groups(spark.createDataFrame(rows, "query_id bigint, rnk int, frame_id bigint, lm_idx bigint"), 2).collect()
    assert {(r.frame_id, r.group_no, r.place) for r in got} == {(10, 0, 0), (12, 0, 1), (11, 1, 0), (13, 1, 1)}


def test_bounded_views(spark):
    rows = [(1, i, [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(np.radians([0, 1, 2, 90, 45]))]
    df = spark.createDataFrame(rows, "point3d_id int, image_id int, dir array<double>")
    assert {r.image_id for r in landmarks.bounded_views(df, 3).collect()} == {2, 3, 4}
    assert landmarks.bounded_views(df, 0).count() == 0
    assert landmarks.bounded_views(df, 9).count() == 5


def test_selection_invariants():
    rng = np.random.default_rng(2)
    r, c = (x.ravel() for x in np.indices((13, 11)))
    s = rng.random(len(r))
    keep = anchors.select_cells(r, c, s, 10, (3, 3), 1)
    assert len(keep) <= 10 and list(s[keep]) == sorted(s[keep], reverse=True)
    for i in keep:
        for j in keep:
            assert i == j or max(abs(r[i] - r[j]), abs(c[i] - c[j])) > 2


def test_pose_solver(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for q in range(4):
        turn, move = turned(rng), np.array([0.3 * q, -0.2, 6.0])
        p = rng.uniform(-2, 2, size=(40, 3))
        c = p @ turn.T + move
        uv = c[:, :2] / c[:, 2:] * 400 + [320, 240]
        uv[:10] += 60
        truth[q] = -turn.T @ move
        rows += [(q, *map(float, (*a, *b)), [400.0, 400.0, 320.0, 240.0]) for a, b in zip(uv, p)]
    rows += [(9, 1.0, 1.0, 0.0, 0.0, 1.0, [400.0, 400.0, 320.0, 240.0]), (8, None, 1.0, 0.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "query_id int, u double, v double, x double, y double, z double, camera array<double>")
    got = {r.query_id: r for r in pnp.solve_poses(df).collect()}
    for q, centre in truth.items():
        t = np.array(got[q].T_wc).reshape(4, 4)
        assert np.allclose(t[:3, 3], centre, atol=1e-5) and got[q].num_inliers == 30
    assert not got[9].success and got[9].num_inliers == 0 and got[9].num_matches == 1 and 8 not in got


def test_distortion_is_undone():
    rng = np.random.default_rng(3)
    xy, k = rng.uniform(-0.3, 0.3, size=(50, 2)), np.array([0.1, -0.02, 0.001, -0.002])
    r2 = (xy**2).sum(axis=1)
    x, y = xy.T
    bent = np.stack([x * (1 + k[0] * r2 + k[1] * r2**2) + 2 * k[2] * x * y + k[3] * (r2 + 2 * x * x), y * (1 + k[0] * r2 + k[1] * r2**2) + k[2] * (r2 + 2 * y * y) + 2 * k[3] * x * y], axis=1)
    assert np.allclose(pnp.undistort(bent, k), xy, atol=1e-8)


def test_pose_algebra(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(5):
        t = np.eye(4)
        t[:3, :3], t[:3, 3] = turned(rng), rng.normal(size=3)
        rows.append((i, t.ravel().tolist()))
    rows.append((9, None))
    df = spark.createDataFrame(rows, "i int, t array<double>")
    q = pose.to_quaternion(F.col("t"))
    back = pose.from_quaternion(q[0], q[1], q[2], q[3], F.col("t")[3], F.col("t")[7], F.col("t")[11])
    got = df.select("i", "t", pose.compose(pose.invert(F.col("t")), F.col("t")).alias("e"), back.alias("b"), pose.rotation_error(F.col("t"), F.col("t")).alias("r")).collect()
    for r in got:
        if r.t is None:
            assert r.e is None
        else:
            assert np.allclose(r.e, np.eye(4).ravel()) and np.allclose(r.b, r.t) and r.r < 1e-4


def test_vectors_with_nulls(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, [], [])], "i int, a array<float>, b array<float>")
    got = {r.i: r for r in df.select("i", vec.norm(F.col("a")).alias("n"), vec.dot(F.col("a"), F.col("b")).alias("d"), vec.normalize_or_zero(F.col("a")).alias("u")).collect()}
    assert got[1].n == 5.0 and got[1].d == 3.0 and np.allclose(got[1].u, [0.6, 0.8])
    assert got[2].n is None and got[2].d is None and got[3].u == [0.0, 0.0] and got[4].n == 0.0


def test_topk_edges(spark):
    kind = "id bigint, v array<double>"
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], kind)
    b = spark.createDataFrame([(7, [2.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0])], kind)
    ren = lambda d, n: d.withColumnsRenamed({"id": n, "v": "v_" + n})
    got = retrieval.topk_cosine(ren(a, "q"), "q", "v_q", ren(b, "m"), "m", "v_m", 9, dim=2).orderBy("rk").collect()
    assert [(r.q, r.m, r.rk) for r in got] == [(1, 5, 1), (1, 7, 2), (1, 6, 3)]
    assert retrieval.topk_cosine(ren(a, "q"), "q", "v_q", ren(b.limit(0), "m"), "m", "v_m", 3, dim=2).count() == 0


def test_blocks_give_the_same_top(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(30)], "q bigint, x array<double>")
    b = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(90)], "m bigint, y array<double>")
    one = {tuple(r) for r in retrieval.topk_cosine(a, "q", "x", b, "m", "y", 4, 8).collect()}
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    many = {tuple(r) for r in retrieval.topk_cosine(a, "q", "x", b, "m", "y", 4, 8).collect()}
    assert one == many and len(one) == 120


def test_tracks(spark):
    e = np.eye(6)
    rows = [(1, 0, 0, e[0]), (1, 0, 1, e[1]), (1, 1, 0, e[1]), (1, 1, 1, e[2]), (1, 2, 0, e[2]), (1, 2, 1, e[1]), (1, 4, 0, e[1])]
    df = spark.createDataFrame([(s, q, i, v.tolist()) for s, q, i, v in rows], "sequence_id bigint, seq bigint, anchor_index int, desc array<double>")
    got = {(r.seq, r.anchor_index): r.track_id for r in tracks.build_tracks(df, 0.5).collect()}
    assert got[0, 1] == got[1, 0] == got[2, 1] and got[1, 1] == got[2, 0] and got[0, 0] != got[0, 1] and got[4, 0] not in {got[2, 1]}


def test_extraction(spark):
    rng = np.random.default_rng(7)
    image = rng.integers(0, 255, size=(40, 60, 3), dtype=np.uint8)
    d, xy = anchors.gradient_tokens(image, (6, 8), 16)
    assert d.shape == (6, 8, 16) and np.allclose(np.linalg.norm(d, axis=2), 1, atol=1e-4)
    assert xy[0, 0].tolist() == [0, 0] and xy[-1, -1].tolist() == [59, 39]
    dark, soft = anchors.perturb(image)
    assert dark.shape == soft.shape == image.shape and (dark <= image).all()
    flat = np.full((9, 9, 3), 100, np.uint8)
    assert (anchors.perturb(flat)[1] == 100).all()
    df = spark.createDataFrame([("a", 40, 60, bytearray(image.tobytes()))], "image_id string, height int, width int, data binary")
    assert anchors.extract_tokens(df).count() == 24 * 24
    assert anchors.sample_depth(np.arange(12.0).reshape(3, 4), 0.5, 1.5) == 8.0 and anchors.sample_depth(np.ones((2, 2)), 9, 0) == 0.0


def test_time_join_edges(spark):
    a = spark.createDataFrame([(1, 100), (2, None), (3, 500)], "a int, t bigint")
    b = spark.createDataFrame([(7, 90), (8, 110), (9, None)], "b int, t bigint")
    got = {r.a: (r.b, r.dt) for r in spatial.nearest_time(a, b, "a", "b", 10, keep_left=True).collect()}
    assert got == {1: (7, 10), 2: (None, None), 3: (None, None)}


def test_names_resolve(spark):
    q = spark.createDataFrame([("x/a.jpg",), ("b",), ("zz",)], "name string")
    t = spark.createDataFrame([("x/a.jpg", "a", 1), ("y/b.png", "b", 2)], "full string, stem string, v int")
    got = {r.name: r.v for r in spatial.resolve_names(q, "name", t, ["full", "stem"], "v").collect()}
    assert got == {"x/a.jpg": 1, "b": 2, "zz": None}


def test_localization_end_to_end(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(-2, 2, size=(60, 3))
    mu = rng.normal(size=(60, 16))
    mu /= np.linalg.norm(mu, axis=1, keepdims=True)
    lms = spark.createDataFrame([(i, mu[i].tolist(), 0.5, 3, *map(float, p[i])) for i in range(60)], "point_id bigint, mu array<double>, staticness double, n_obs bigint, x double, y double, z double")
    rows, truth = [], []
    for q in range(3):
        turn, move = turned(rng), np.array([0.1 * q, 0.0, 7.0])
        c = p @ turn.T + move
        uv = c[:, :2] / c[:, 2:] * 400 + [320, 240]
        t = np.eye(4)
        t[:3, :3], t[:3, 3] = turn.T, -turn.T @ move
        truth.append((q, t.ravel().tolist()))
        rows += [(q * 100 + i, q, i, (mu[i] + rng.normal(size=16) * 0.02).tolist(), float(uv[i, 0]), float(uv[i, 1])) for i in range(60)]
    a = spark.createDataFrame(rows, "anchor_id bigint, query_id bigint, anchor_idx int, desc array<double>, u double, v double")
    cams = spark.createDataFrame([(q, [400.0, 400.0, 320.0, 240.0]) for q in range(4)], "query_id bigint, camera array<double>")
    m = localize.Matcher(dim=16, topk=5, margin=0.01)
    got = localize.localize(a, lms, cams, m)
    gt = spark.createDataFrame(truth, "query_id bigint, gt array<double>")
    s = localize.report(got, gt).first()
    assert s.num_queries == 4 and s.num_success == 3 and s.mean_trans_err_m < 1e-4
    groups = spark.createDataFrame([(q, g, 2 * g + 2) for q in range(3) for g in range(3)], "query_id bigint, group_no int, stage int")
    schedule = spark.createDataFrame([(q, [2, 4, 6]) for q in range(3)], "query_id bigint, stages array<int>")
    members = spark.createDataFrame([(q, i % 3, i) for q in range(3) for i in range(60)], "query_id bigint, group_no int, point_id bigint")
    staged = localize.localize_staged(a, lms, cams.filter("query_id < 3"), groups, schedule, members, m, enough=30, hard=50).collect()
    assert {r.query_id for r in staged} == {0, 1, 2} and all(r.success and r.num_inliers >= 30 and r.stage_no == 1 for r in staged)
    prior = localize.with_prior(localize.match(a, lms, m), got.join(cams, "query_id"), lms, a).agg(F.min("geometry")).first()[0]
    assert prior > 0.99


def test_config():
    c = config.override({"a": {"b": 1}}, {"a.b": 2, "x.y.z": 3})
    assert c == {"a": {"b": 2}, "x": {"y": {"z": 3}}}
    assert config.Matching.of({"topk_landmarks": 7, "nobody": 1}).topk_landmarks == 7
    assert config.key_of({"a": 1, "b": 2}) == config.key_of({"b": 2, "a": 1})


def test_empty_evaluation(spark):
    none = spark.createDataFrame([], "g int, ok boolean, trans_err_m double, rot_err_deg double")
    assert evaluate.summary(none, ["g"], "ok", ["trans_err_m"]).count() == 0
    one = spark.createDataFrame([(1, False, None, None)], none.schema)
    r = evaluate.recall(one, ["g"], "trans_err_m", "rot_err_deg").first()
    assert r.recall_0 is None and r.recall_all_0 == 0.0


def test_store_scores_spread_and_needs_a_position(spark):
    """Landmark 1 has descriptors close together, 2 scattered ones, 3 no position, 4 no descriptor."""
    obs = spark.createDataFrame([(10 * n + i, n, i, 9.0) for n in (1, 2, 3, 4) for i in (1, 2)], "obs_id bigint, landmark_id bigint, frame_id bigint, reproj_error double")
    points = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [2.0, 0.0, 0.0])], "point3d_id bigint, xyz array<double>")
    views = spark.createDataFrame([], "point3d_id bigint, image_id bigint, dir array<double>")
    desc = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.0]), (2, [-1.0, 0.01]), (3, [1.0, 0.0])], "landmark_id bigint, d array<double>")
    found = {r.landmark_id: r for r in landmarks.build_store(obs, views, points, landmarks.subspaces(desc, "landmark_id", "d", 1)).collect()}
    assert sorted(found) == [1, 2] and found[2].xyz == [1.0, 0.0, 0.0] and len(found[2].mu) == 2 and len(found[2].basis) == 1
    for r in found.values():
        want = 0.45 * np.tanh(2 / 6) + 0.25 * np.exp(-r.spread) + 0.2 * np.exp(-9.0) + 0.035
        assert np.isclose(r.staticness, want)
    assert found[2].spread > 1 > found[1].spread
    kept = landmarks.build_store(obs, views, points, landmarks.subspaces(desc, "landmark_id", "d", 1), min_static=0.4)
    assert [r.landmark_id for r in kept.collect()] == [1]


def test_rounds_that_run_out_lose_no_edge(spark):
    """All scores tie: each round yields one edge a query."""
    edges = spark.createDataFrame([(q, a, b, 1.0) for q in (1, 2) for a in range(5) for b in range(5)], "q bigint, a bigint, b bigint, s double")
    got = {tuple(r) for r in assign.greedy_rounds(edges, "q", "a", "b", "s", rounds=2).select("q", "a", "b").collect()}
    assert got == {(q, i, i) for q in (1, 2) for i in range(5)}


@pytest.mark.parametrize("kind", ["spread", "equal", "two", "skewed"])
def test_quantiles_narrow_to_the_exact_value(spark, monkeypatch, kind):
    monkeypatch.setattr(evaluate, "MOST_VALUES", 50)
    rng = np.random.default_rng(4)
    x = {"spread": rng.normal(size=5001), "equal": np.full(3000, 2.5), "two": np.repeat([1.0, 7.0], 1500), "skewed": np.concatenate([np.full(4000, 3.0), rng.normal(size=900)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "v double")
    shares = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]
    assert np.allclose(evaluate.quantiles(df, "v", shares), np.quantile(x, shares), atol=1e-12)
    assert evaluate.quantiles(df.limit(0), "v", [0.5]) == [None]
