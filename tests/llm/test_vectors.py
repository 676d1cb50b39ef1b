"""The hash-prefix forest against brute force: exact on small sets, recall on larger ones, skew and edge cases."""

import numpy as np
import pytest

from waymark.llm import vectors
from waymark.llm.vectors import Forest, most_similar


def brute(a, b, k, least):
    out = set()
    for i, x in a:
        cos = [(float(np.float64(x) @ y / np.linalg.norm(x) / np.linalg.norm(y)), j) for j, y in b]
        out |= {(i, j) for c, j in sorted(cos, key=lambda t: (-t[0], t[1]))[:k] if c >= least}
    return out


def tables(spark, a, b):
    mk = lambda rows, i, v: spark.createDataFrame([(n, x if x is None else [None if y is None else float(y) for y in x]) for n, x in rows], f"{i} bigint, {v} array<float>")
    return mk(a, "q", "x"), mk(b, "m", "y")


def run(spark, a, b, k, least, forest):
    da, db = tables(spark, a, b)
    rows = [(r.q, r.m) for r in most_similar(da, "q", "x", db, "m", "y", k, least, forest).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def cloud(n, centres, noise, seed, dim=16):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(99).normal(size=(centres, dim))
    return [(i, (c[rng.integers(centres)] + rng.normal(size=dim) * noise).astype(np.float32)) for i in range(n)]


def test_small_set_is_exact(spark):
    a, b = cloud(60, 20, 0.3, 1), cloud(200, 20, 0.3, 2)
    f = Forest(trees=3, candidates=3000, dim=16)
    assert run(spark, a, b, 4, 0.8, f) == brute(a, b, 4, 0.8)
    assert run(spark, a, b, 4, None, f) == brute(a, b, 4, -2)


@pytest.mark.parametrize("least", [0.9, None])
def test_recall_of_a_deep_forest(spark, least):
    a, b = cloud(150, 60, 0.15, 3), cloud(3000, 60, 0.15, 4)
    got, want = run(spark, a, b, 5, least, Forest(trees=8, candidates=1600, dim=16, leaf=200)), brute(a, b, 5, -2 if least is None else least)
    assert len(got & want) >= 0.9 * len(want)


def test_one_dense_cluster_is_cut_into_subtrees(spark, monkeypatch):
    """A third of all vectors within a tiny angle: more than a subtree holds, even at the depth of the counts."""
    monkeypatch.setattr(vectors, "MOST_PREFIXES", 16)
    a, b = cloud(40, 30, 0.3, 5), cloud(600, 30, 0.3, 6)
    rng = np.random.default_rng(7)
    b += [(1000 + i, (b[0][1] + rng.normal(size=16) * 1e-3).astype(np.float32)) for i in range(300)]
    a += [(1000 + i, (b[0][1] + rng.normal(size=16) * 1e-3).astype(np.float32)) for i in range(20)]
    got, want = run(spark, a, b, 5, 0.8, Forest(trees=6, candidates=400, dim=16, leaf=60, counted=4)), brute(a, b, 5, 0.8)
    assert len(got & want) >= 0.85 * len(want)


def test_plan_is_bounded_and_covers_everything():
    rng = np.random.default_rng(1)
    codes = np.sort(rng.integers(0, 2**56, 5000) >> rng.integers(0, 40, 5000))
    p, c = np.unique(codes >> 44, return_counts=True)
    leaves = vectors._cut_tree((p, c), (p, c), 12, 0, 0, 100)
    leaves.sort(key=lambda x: x.start)
    assert sum(x.size for x in leaves) == 5000 == sum(x.asked for x in leaves)
    assert leaves[0].start == 0 and all(a.start + (1 << (56 - a.depth)) == b.start for a, b in zip(leaves, leaves[1:]))
    assert all(x.size <= 100 or x.depth == 12 for x in leaves)


def test_equal_vectors_and_copies(spark):
    v = [1.0] + [0.0] * 15
    a = [(i, v) for i in range(50)] + [(7, v)]
    b = [(i, v) for i in range(400, 100, -1)] + [(105, v), (99, [0.5] * 16)]
    want = {(q, m) for q in range(50) for m in (101, 102, 103)}
    assert run(spark, a, b, 3, 0.5, Forest(trees=2, candidates=64, dim=16)) == want


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    ok = [1.0] + [0.0] * 15
    bad = [None, [], ok[:15], [*ok, 1.0], [None, *ok], [*ok, None], [0.0] * 16, [nan, *ok[1:]], [inf, *ok[1:]], [None, *ok[1:]]]
    a = [(0, ok)] + [(1 + i, x) for i, x in enumerate(bad)]
    b = [(50, [3.0] + [0.0] * 15), (51, [1e-30] + [0.0] * 15)] + [(60 + i, x) for i, x in enumerate(bad)]
    assert run(spark, a, b, 5, 0.9, Forest(trees=2, candidates=64, dim=16)) == {(0, 50), (0, 51)}


@pytest.mark.parametrize("empty", ["a", "b", "both"])
def test_empty_tables(spark, empty):
    one = [(1, [1.0] * 16)]
    a, b = ([] if empty in ("a", "both") else one), ([] if empty in ("b", "both") else one)
    assert run(spark, a, b, 5, 0.9, Forest(trees=2, candidates=64, dim=16)) == set()


def test_error_bound_of_the_16_bit_form():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[0] = np.eye(64)[0]
    s = np.abs(x).max(axis=1) / 32767
    err = np.linalg.norm(np.rint(x / s[:, None]) * s[:, None] - x, axis=1)
    assert (err <= s * np.sqrt(64) / 2).all()


def test_forest_grows_with_the_collection():
    for n in (10**4, 10**5, 10**6, 10**7, 10**9):
        f = Forest().grown(n, 0.85)
        depth = min(f.counted, f.deepest(0.85))
        same = (1 - np.arccos(0.85) / np.pi) ** depth
        assert 1 - (1 - same) ** f.trees >= 0.95
        assert f.candidates // f.trees == Forest().candidates // Forest().trees
    assert Forest().grown(125_000, 0.85).trees == 6 < Forest().grown(1_250_000, 0.85).trees < Forest().grown(12_500_000, 0.85).trees
    assert Forest().deepest(-1.0) == 0 and Forest().deepest(1.0) == vectors.BITS


def test_a_dense_cluster_is_compared_whole(spark):
    """A third of the vectors and of the queries in one narrow cone: many times a tree's share of the candidates."""
    b = cloud(4000, 30, 0.3, 6)
    rng = np.random.default_rng(7)
    near = lambda n: [(10_000 + i, (b[0][1] + rng.normal(size=16) * 0.2).astype(np.float32)) for i in range(n)]
    a, b = near(40), b + near(2000)
    got, want = run(spark, a, b, 5, 0.9, Forest(trees=4, candidates=80, dim=16, leaf=100)), brute(a, b, 5, 0.9)
    assert len(want) == 200 and len(got & want) >= 0.9 * len(want)


def planted(n, cosines, m=2000):
    """(comparisons of a query, recall of planted pairs by cosine) among n isotropic unit vectors, by the forest's own rules."""
    f = Forest().grown(n, min(cosines))
    rng = np.random.default_rng(1)
    unit = lambda z: (z / np.linalg.norm(z, axis=1, keepdims=True)).astype(np.float32)
    x, centre, planes = unit(rng.normal(size=(n, 64))), np.zeros(64, np.float32), f.planes()
    shift = vectors.BITS - f.counted
    codes = vectors._codes(x, centre, planes, f.trees)
    sums = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, t] >> shift, minlength=1 << f.counted))]) for t in range(f.trees)]
    plan = vectors.Plan(centre, min(f.counted, f.deepest(min(cosines))), sums, [], [], [], [])
    q, asked = x[:m], codes[:m]
    depth = vectors._depths(asked, plan, f)
    width = (np.int64(1) << (f.counted - depth))[:, None]
    p = asked >> (vectors.BITS - depth)[:, None]
    visited = sum(s[(p[:, t] + 1) * width[:, 0]] - s[p[:, t] * width[:, 0]] for t, s in enumerate(sums))
    out = {}
    for c in cosines:
        away = unit(rng.normal(size=(m, 64)))
        away = unit(away - (away * q).sum(1, keepdims=True) * q)
        y = (c * q + np.sqrt(1 - c * c) * away).astype(np.float32)
        out[c] = float(((vectors._codes(y, centre, planes, f.trees) >> (vectors.BITS - depth)[:, None]) == p).any(axis=1).mean())
    return float(visited.mean()), out


@pytest.mark.parametrize("n", [12_000, 120_000, 500_000])
def test_recall_and_comparisons_by_size(n, capsys):
    """Fewer comparisons than all pairs from sf0.1's size on, and the wanted recall at the least cosine."""
    visited, found = planted(n, (0.85, 0.9))
    with capsys.disabled():
        print(f"\n{n} vectors: {visited:.0f} comparisons a query, recall {found}")
    assert visited < 0.8 * n and found[0.85] >= 0.93 and found[0.9] >= 0.96


def test_a_large_mean_counts_in_the_depth():
    """Vectors about a far centre: pairs of one cosine have a wider angle there, so queries stay higher."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64)) / 8 + np.array([0.8] + [0.0] * 63)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x.mean(axis=0)
    i, j = rng.integers(0, 4000, (2, 20_000))
    cos, y = (x[i] * x[j]).sum(axis=1), x - centre
    seen = (y[i] * y[j]).sum(axis=1) / np.linalg.norm(y[i], axis=1) / np.linalg.norm(y[j], axis=1)
    at = np.abs(cos - np.median(cos)) < 0.01
    assert abs(seen[at].mean() - vectors.seen_from(centre, float(np.median(cos)))) < 0.05
    assert Forest().deepest(vectors.seen_from(centre, 0.85)) < Forest().deepest(0.85)
