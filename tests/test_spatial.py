"""Nearest time by sorted scan: brute force, bursts, ties, groups, nulls."""

import random

import pytest

from waymark.operators.spatial import nearest_keypoint, nearest_time


@pytest.mark.parametrize("span,tolerance,group", [(50, 5, "g"), (1000, 7, None), (1000, 300, "g"), (20, 0, None), (5, 100, "g")])
def test_against_brute_force(spark, span, tolerance, group):
    rnd = random.Random(span + tolerance)
    row = lambda i: (i, rnd.choice([0, 0, 1, 2]), rnd.choice([None, *[rnd.randint(-span, span)] * 9]))
    left, right = [row(i) for i in range(150)], [row(i) for i in range(200)]
    got = nearest_time(spark.createDataFrame(left, "a bigint, g int, t bigint"), spark.createDataFrame(right, "r bigint, g int, t bigint"), "a", "r", tolerance, group)
    want = set()
    for a, g, t in left:
        near = [(abs(t - s), s, r) for r, h, s in right if t is not None and s is not None and abs(t - s) <= tolerance and (group is None or g == h)]
        if near:
            want.add((a, min(near)[2], min(near)[0]))
    assert {(r.a, r.r, r.dt) for r in got.collect()} == want


def test_a_burst_makes_no_pairs(spark):
    """20,000 records on either side in one bucket: a join would make 400 million pairs."""
    left = spark.range(20_000).selectExpr("id as a", "id as t")
    right = spark.range(20_000).selectExpr("id as r", "id as t")
    got = nearest_time(left, right, "a", "r", 1_000_000)
    assert got.count() == 20_000 and got.filter("a <> r or dt <> 0").count() == 0
    kept = nearest_time(left, right.limit(0), "a", "r", 5, keep_left=True)
    assert kept.count() == 20_000 and kept.filter("r is not null").count() == 0


@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_keypoints_against_brute_force(spark, monkeypatch, pairs):
    """Ties, copies of an id, the radius itself, negative places, images of one side, odd coordinates."""
    from waymark.operators import spatial

    monkeypatch.setattr(spatial, "PAIRS", pairs)
    rnd = random.Random(5)
    odd = [float("nan"), float("inf"), None]
    row = lambda i: (rnd.choice([None, 1, 2, 3, 3, 3]), i % 170, *(rnd.choice(odd) if rnd.random() < 0.03 else rnd.randint(-30, 30) / rnd.choice([1, 3]) for _ in "xy"))
    left, right = [row(i) for i in range(200)] + [(8, 1, 0.0, 0.0)], [row(i) for i in range(250)] + [(9, 1, 0.0, 0.0)]
    got = nearest_keypoint(spark.createDataFrame(left, "g int, a bigint, x double, y double"), spark.createDataFrame(right, "g int, r int, x double, y double"), "g", "a", "r", 5.0)
    want = {}
    for g, a, x, y in left:
        for h, r, u, v in right:
            if g is not None and g == h and None not in (x, y, u, v) and (d2 := (x - u) * (x - u) + (y - v) * (y - v)) <= 25.0:
                want[g, a] = min(want.get((g, a), (d2, r)), (d2, r))
    assert {(r.g, r.a): (r.d2, r.r) for r in got.collect()} == want and len(want) > 50


def test_keypoints_are_not_broadcast(spark):
    """Rows out of long lists count as little as the lists: as a broadcast they would be all in the driver."""
    rows = spark.range(40).selectExpr("id as g", "explode(sequence(0, 99)) as i").selectExpr("g", "i", "cast(i as double) as x", "0d as y")
    got = nearest_keypoint(rows.filter("i % 2 = 0"), rows.filter("i % 2 = 1").withColumnRenamed("i", "r"), "g", "i", "r", 20.0)
    assert got.count() == 2000 and got.filter("d2 <> 1").count() == 0
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
