"""SQL names, the data source, the command line, sweeps, merging."""

import numpy as np
import pytest

from tests.test_sources import PTS, write_binary
from waymark import __main__ as cli
from waymark.functions import pose, sql
from waymark.operators import landmarks
from waymark.plans import experiments


def test_sql_names(spark, tmp_path):
    sql.register(spark)
    r = spark.sql("select wm_cosine(array(1d, 0d), array(1d, 1d)) as c, wm_cosine(array(0d), array(1d)) as z, wm_cosine(null, array(1d)) as n").first()
    assert abs(r.c - 0.5**0.5) < 1e-12 and r.z is None and r.n is None
    eye = "array(1d,0d,0d,1d,0d,1d,0d,2d,0d,0d,1d,3d,0d,0d,0d,1d)"
    r = spark.sql(f"select wm_rotation_error({eye}, {eye}) as e, wm_invert_pose({eye}) as i").first()
    assert r.e < 1e-5 and r.i[3] == -1.0
    assert [tuple(x) for x in spark.sql("select * from wm_retrieval_line('q d1 0.5')").collect()] == [("q", "d1", 0)]
    assert spark.sql("select * from wm_retrieval_line('q d1 d2')").count() == 2 and spark.sql("select * from wm_retrieval_line('# x y')").count() == 0
    write_binary(tmp_path)
    got = spark.read.format("colmap").option("table", "points").load(str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == PTS


def test_command_line(spark, data, tmp_path, capsys):
    cli.main(["list"])
    assert "flagship_match" in capsys.readouterr().out
    cli.main(["run", "map_stats", "--data", data, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    for n in ("a", "b"):
        (tmp_path / n).write_text("x.jpg 1 0 0 0 0 0 0\n")
    cli.main(["evaluate", str(tmp_path / "a"), str(tmp_path / "b")])
    assert "1.0" in capsys.readouterr().out


def test_sweep(spark, tmp_path):
    seen = []

    def run(config):
        seen.append(config["m"]["k"])
        return spark.createDataFrame([(config["m"]["k"] * 0.1,)], "success_rate double")

    manifest = {"base": {"m": {"k": 1}}, "runs": [{"name": "a"}, {"name": "b", "overrides": {"m.k": 2}}]}
    for _ in range(2):
        rows = {r.run: r.success_rate for r in experiments.sweep(spark, manifest, run, str(tmp_path)).collect()}
    assert rows == {"a": 0.1, "b": 0.2} and seen == [1, 2]
    kind = "m string, {} double"
    got = experiments.collected(spark.createDataFrame([("x", 41.0)], kind.format("score")), spark.createDataFrame([("x", 0.1), ("y", 0.2)], kind.format("recall")), spark.createDataFrame([("z", 0.3)], kind.format("success_rate")), ["m"])
    assert {r.m: r.score for r in got.collect()} == {"x": 0.41, "y": 0.2, "z": 0.3}


def test_triangulation():
    k = np.array([[400.0, 0, 320], [0, 400, 240], [0, 0, 1]])
    a = k @ np.hstack([np.eye(3), np.zeros((3, 1))])
    b = k @ np.hstack([np.eye(3), [[-1.0], [0], [0]]])
    p = np.array([0.5, -0.2, 4.0, 1.0])
    see = lambda m: (m @ p)[:2] / (m @ p)[2]
    assert np.allclose(pose.triangulate(a, b, see(a), see(b)), p[:3])


@pytest.mark.parametrize("radius,want", [(0.5, [0, 0, 1, 2]), (0.01, [0, 1, 2, 3])])
def test_merging(spark, radius, want):
    rows = [(1, 0, [0.0, 0.0, 0.0], [1.0, 0.0]), (1, 1, [0.1, 0.0, 0.0], [1.0, 0.0]), (1, 2, [0.1, 0.0, 0.0], [0.0, 1.0]), (1, 3, [9.0, 0.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, obs_id bigint, xyz array<double>, desc array<double>")
    assert [r.landmark_no for r in landmarks.merge_within(df, "g", radius, 0.7).orderBy("obs_id").collect()] == want


def test_observation_in_frames(spark):
    obs = spark.createDataFrame([(5, 1, 7, 1.0, 1.0), (4, 1, 7, 2.0, 2.0), (6, 1, 8, 3.0, 3.0)], "obs_id bigint, landmark_id bigint, frame_id bigint, u double, v double")
    got = landmarks.observation_in(obs, spark.createDataFrame([(7,)], "frame_id bigint")).collect()
    assert [(r.landmark_id, r.frame_id, r.obs_id) for r in got] == [(1, 7, 4)]
    fine = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "k int, d array<double>")
    assert [(r.k, [round(x, 6) for x in r.mu]) for r in landmarks.fine_means(fine, "k", "d").collect()] == [(1, [0.0, 1.0])]
