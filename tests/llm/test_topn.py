"""Top N against sorting: ties, copies, groups that span batches, hot groups."""

import random

import pytest

from waymark.llm import topn
from waymark.llm.topn import best_landmarks, top_n

KIND = "g bigint, h int, item bigint, score double, n int, most int, g0 string"


def brute(rows):
    groups = {}
    for g, h, item, s, n, *_ in set(rows):
        if None not in (g, h, item, s, n) and s == s and abs(s) != float("inf") and n > 0:
            groups.setdefault((g, h), (n, []))[1].append((-s, item))
    return {(g, h, i) for (g, h), (n, x) in groups.items() for _, i in sorted(x)[:n]}


@pytest.mark.parametrize("chunk,batch", [(1 << 18, "10000"), (64, "50"), (7, "3")])
def test_against_sorting(spark, monkeypatch, chunk, batch):
    monkeypatch.setattr(topn, "CHUNK", chunk)
    rnd = random.Random(chunk)
    scores = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.5, 0.5, 0.25, 1.0, -2.0]
    rows = []
    for i in range(2000):
        g = 1 if rnd.random() < 0.4 else rnd.choice([None, *range(2, 40)])
        h = rnd.choice([0, 1])
        s = rnd.choice([*scores, rnd.random()])
        rows.append((g, h, rnd.choice([None, *[i] * 20]), s if s != 0 else 0.0, {0: 5, 1: 2}[h] if g != 7 else 0, 0, "x"))
    rows += rows[:300]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(r.g, r.h, r["item"]) for r in top_n(spark.createDataFrame(rows, KIND), ["g", "h"], "item", "score", "n").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_negative_zero_ties_with_zero(spark):
    df = spark.createDataFrame([(1, 1, 9, 0.0, 1, 0, ""), (1, 1, 3, -0.0, 1, 0, "")], KIND)
    assert [r["item"] for r in top_n(df, ["g", "h"], "item", "score", "n").collect()] == [3]


def test_empty_and_unknown_configuration(spark):
    m = spark.createDataFrame([(1, 1, 1, 9, 0.5)], "query_id bigint, anchor_index int, landmark_id bigint, config_id int, score double")
    c = spark.createDataFrame([(1, 3)], "config_id int, topk_retrieval int")
    assert best_landmarks(m, c).count() == 0 and best_landmarks(m.limit(0), c).count() == 0 and best_landmarks(m, c.limit(0)).count() == 0
