"""Work on whole groups in sorted batches, and the top k inside groups of very different sizes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.operators import candidates, retrieval
from waymark.operators.groups import by_key


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_every_key_once_and_whole(spark, batch):
    rows = [(k, i) for k in [None, *range(40)] for i in range(1 + (k or 0) % 7)] + [(99, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")

    def run(t: pa.Table) -> pa.Table:
        v = t.column("v").to_pylist()
        return pa.table({"k": t.column("k").slice(0, 1), "n": pa.array([len(v)]), "sorted": pa.array([v == sorted(v)])})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = by_key(df, ["k"], run, "k int, n bigint, sorted boolean", ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, _ in rows:
        want[k] = want.get(k, 0) + 1
    assert {r.k: r.n for r in got} == want and len(got) == len(want) and all(r.sorted for r in got)
    assert by_key(df.limit(0), ["k"], run, "k int, n bigint, sorted boolean").count() == 0


def test_top_k_inside_a_hot_group(spark, monkeypatch):
    """One group with most of both sides: many small blocks, none of which sees all pairs, and the exact result."""
    monkeypatch.setattr(retrieval, "ASKED", 20)
    monkeypatch.setattr(retrieval, "STORED", 50)
    rng = np.random.default_rng(2)
    vec = lambda: [float(x) for x in rng.normal(size=8).round(2)]
    asked = [(i, 1 if i % 3 else i % 11, vec()) for i in range(200)] + [(900, 1, None), (901, None, vec()), (902, 1, [0.0] * 8), (903, 77, vec())]
    stored = [(i, vec()) for i in range(300)] + [(950, None), (951, [0.0] * 8), (952, [1.0])]
    members = [(1, i) for i in range(300)] + [(g, i) for g in (0, 3, 5, 9) for i in range(g, 300, 17)] + [(1, 5), (1, 950), (1, 951), (1, 952), (None, 4), (1, None)]
    args = spark.createDataFrame(asked, "q bigint, g int, x array<double>"), "q", "x", spark.createDataFrame(stored, "m bigint, y array<double>"), "m", "y", spark.createDataFrame(members, "g int, m bigint"), "g", 4, 8
    got = {(r.q, r.rk): r.m for r in retrieval.topk_cosine_within(*args).collect()}
    base = {i: np.array(y) for i, y in stored if y and len(y) == 8 and any(y)}
    want = {}
    for q, g, x in asked:
        if x is None or g is None or not any(x):
            continue
        x = np.array(x)
        mine = {m for h, m in members if h == g and m in base}
        sims = sorted((-round(float(x @ base[m] / np.linalg.norm(x) / np.linalg.norm(base[m])), 9), m) for m in mine)
        want |= {(q, r + 1): m for r, (_, m) in enumerate(sims[:4])}
    assert got == want


def test_covisible_pairs(spark):
    rows = [(1, 7, f) for f in (3, 1, 2, 2)] + [(1, 8, f) for f in (1, 2)] + [(2, 7, 5), (2, 9, 6)]
    got = candidates.covisibility(spark.createDataFrame(rows, "query_id int, lm_idx int, frame_id int"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 2, 2), (1, 1, 3, 1), (1, 2, 3, 1)}
    assert got.filter(F.col("query_id") == 2).count() == 0


def test_best_in_a_large_block():
    """Ties, equal and nearly equal vectors: as exact as comparing all pairs in double precision."""
    rng = np.random.default_rng(4)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    base = unit(rng.normal(size=(700, 64)))
    y = unit(base[rng.integers(0, 700, 9000)] + rng.normal(size=(9000, 64)) * rng.choice([0, 1e-9, 1e-7, 1e-4], (9000, 1)))
    x = unit(base[rng.integers(0, 700, 600)] + rng.normal(size=(600, 64)) * 0.01)
    r, c, v = retrieval._best(x, y, 5)
    sims = np.stack([np.round(np.einsum("ij,j->i", y, q), 9) for q in x])
    want = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    assert (r == np.repeat(np.arange(600), 5)).all() and (c.reshape(-1, 5) == want).all() and (v == sims[r, c]).all()
    assert retrieval._best(x[:9], np.repeat(y[:1], 9000, axis=0), 3)[1].tolist() == [0, 1, 2] * 9


def test_a_hot_group_is_copied_little(spark, monkeypatch):
    """4,000 queries against 6,000 members, all in one group: each vector travels once."""
    vector = F.expr("transform(sequence(0, 7), i -> cast(sin(id * 7 + i * i) as float))")
    asked = spark.range(4000).select(F.col("id").alias("q"), F.lit(1).alias("g"), vector.alias("x"))
    stored = spark.range(6000).select(F.col("id").alias("m"), vector.alias("y"))
    members, travel, real = spark.range(6000).select(F.lit(1).alias("g"), F.col("id").alias("m")), [], type(asked).unionByName
    monkeypatch.setattr(type(asked), "unionByName", lambda *a, **k: travel.append(real(*a, **k)) or travel[-1])
    got = retrieval.topk_cosine_within(asked, "q", "x", stored, "m", "y", members, "g", 2, 8)
    assert got.count() == 8000 and travel[0].count() == 10_000 and dict(travel[0].dtypes)["x"] == "array<float>"
