"""Nearest time against brute force: entities larger than a partition, equal times, edges, nulls."""

import random

import pytest

from waymark.llm.astime import frame_records, nearest_in_time

LEFT = "left_id string, entity bigint, at bigint"
RIGHT = "right_id bigint, entity bigint, at bigint, kind string"
TOL = {"depth": 5, "pose": 12}


def brute(left, right):
    out = set()
    for i, e, t in set(left):
        for k, tol in TOL.items():
            near = [(abs(t - a), a, r) for r, f, a, kk in right if kk == k and f == e and f is not None and a is not None and t is not None and abs(t - a) <= tol]
            if near:
                out.add((i, k, min(near)[2]))
    return out


@pytest.mark.parametrize("span,partitions,batch", [(400, "4", "10000"), (30, "7", "10"), (4000, "13", "3"), (1, "5", "10000"), (400, "2", "1"), (60, "1", "7")])
def test_against_brute_force(spark, span, partitions, batch):
    rnd = random.Random(span)
    entity = lambda: rnd.choice([1, 1, 1, 2, 3, None])
    left = [(f"f{i}", entity(), rnd.choice([None, *[rnd.randint(0, span)] * 9])) for i in range(300)]
    left += left[:40]
    right = [(i, entity(), rnd.choice([None, *[rnd.randint(0, span)] * 9]), rnd.choice(["depth", "pose", "other", None])) for i in range(500)]
    right += right[:60]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = [tuple(r) for r in nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), TOL).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(set(rows)) and set(rows) == brute(left, right)


def test_right_records_far_apart_cross_empty_partitions(spark):
    """One right record on either side of very many left ones: the scan must carry it across whole partitions."""
    left = [(f"f{i}", 1, 1000 + i) for i in range(400)]
    right = [(1, 1, 999, "pose"), (2, 1, 1400, "pose")]
    got = {(r.left_id, r.right_id) for r in nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), {"pose": 10_000}).collect()}
    assert got == {(f"f{i}", 1 if i + 1 <= 400 - i else 2) for i in range(400)}


@pytest.mark.parametrize("which", ["left", "right", "both"])
def test_empty(spark, which):
    left = [] if which in ("left", "both") else [("a", 1, 1)]
    right = [] if which in ("right", "both") else [(1, 1, 1, "pose")]
    assert nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), TOL).count() == 0


def test_unusable_records_and_extra_columns(spark):
    f = spark.sql("select 'f' as frame_id, 1L as sequence_id, timestamp_ntz'2024-01-01 00:00:01' as ts, 1 as record_id, 'x' as sensor, 2 as at, 3 as kind")
    pose = "array_repeat(cast(0.5 as double), {})"
    rows = [
        (1, "depth", "00:00:01.001", "''", "null"),
        (2, "depth", "00:00:01.020", "'p'", "null"),
        (3, "pose", "00:00:01.001", "null", pose.format(15)),
        (4, "pose", "00:00:01.002", "null", "transform(sequence(1, 16), x -> double('nan'))"),
        (5, "pose", "00:00:00.950", "null", pose.format(16)),
        (6, "pose", "00:00:01.050", "null", pose.format(16)),
    ]
    sql = " union all ".join(f"select {i}L as record_id, 1L as sequence_id, '{s}' as sensor, timestamp_ntz'2024-01-01 {t}' as ts, cast({d} as string) as depth_path, cast({p} as array<double>) as pose, 1 as frame_id, 1 as entity" for i, s, t, d, p in rows)
    got = {tuple(r) for r in frame_records(f, spark.sql(sql)).collect()}
    assert got == {("f", "depth", 2), ("f", "pose", 5)}
