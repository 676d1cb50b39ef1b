"""Tree aggregation against plain counting, with one key holding most rows."""

import random
from collections import Counter

from waymark.operators import treeagg

OBS = "obs_id bigint, landmark_id bigint, frame_id bigint, reproj_error float, key_id int, __extra string"
POINTS = "point3d_id bigint, point_error double, image_ids array<bigint>"


def observations(n=4000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        frame = 1 if rnd.random() < 0.6 else rnd.randint(2, 40)
        row = (i, rnd.choice([None, *range(30)]), rnd.choice([frame, frame, frame, None]), rnd.random(), 0, "x")
        rows += [row] * rnd.choice([1, 1, 1, 3])
    return rows


def test_modes(spark):
    rows = observations()
    counts = {}
    for o, lm, f, *_ in set(rows):
        if f is not None and lm is not None:
            counts.setdefault(f, Counter())[lm] += 1
    want = {f: min(c, key=lambda k: (-c[k], k)) for f, c in counts.items()}
    got = treeagg.modes(spark.createDataFrame(rows, OBS)).collect()
    assert len(got) == len(want) and {r.key_id: r.top_id for r in got} == want


def test_lowest_errors(spark):
    rnd = random.Random(4)
    nan = float("nan")
    rows = [(i, rnd.choice([None, nan, 0.5, rnd.random()]), rnd.choice([None, [], [1, 1, None, rnd.randint(1, 20)]])) for i in range(2000)]
    best = {}
    for p, e, l in rows:
        if e is not None and e == e:
            for i in {x for x in l or [] if x is not None}:
                best[i] = min(best.get(i, (9, 0)), (e, p))
    got = treeagg.lowest_errors(spark.createDataFrame(rows + rows[:50], POINTS)).collect()
    assert {r.key_id: r.top_id for r in got} == {i: p for i, (_, p) in best.items()}


def test_more_chunks_than_fan_in(spark):
    rows = spark.range(5000).selectExpr("id % 3 as k", "id")
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = treeagg.tree_aggregate(rows, ["k"], ["id"], lambda x: x.groupBy("__chunk", "k").agg(F.count("*").alias("n")), {"n": F.sum("n")}, fan_in=3)
        assert {r.k: r.n for r in got.collect()} == {0: 1667, 1: 1667, 2: 1666}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    assert treeagg.top_per_key(spark.createDataFrame([], OBS), spark.createDataFrame([], POINTS)).count() == 0
    assert treeagg.key_loads(spark.createDataFrame([], OBS), spark.createDataFrame([], POINTS)).count() == 0


def test_chunks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(treeagg, "CHUNK_ROWS", 10)
    assert [treeagg.chunks_for(spark.range(n)) for n in (0, 10, 95, 950)] == [1, 1, 10, 95]
    rows = spark.createDataFrame([(i, 1 if i % 3 else 2, i % 7) for i in range(200)], "obs_id bigint, frame_id bigint, landmark_id bigint")
    assert {tuple(r) for r in treeagg.modes(rows).collect()} == {(1, 1), (2, 0)}
