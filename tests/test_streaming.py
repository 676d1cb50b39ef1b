"""The streamed memory gives the rows of the batch fold; late frames are set apart."""

from pyspark.sql import functions as F

from waymark.queries import runs
from waymark.streaming import online


def key(r):
    return (r.sequence_id, r.seq, r.mode, r.success, r.num_matches, r.num_inliers, r.num_candidates, r.num_integrated)


def test_stream_equals_batch(spark, data, tmp_path):
    frames = runs.online_frames(spark, data)
    how = online.Online(bootstrap=2)
    want = sorted(key(r) for r in online.run_batch(frames, how).collect())
    assert sum(r[3] for r in want) >= len(want) - 2
    where = str(tmp_path / "in")
    ordered = frames.withColumn("part", F.expr("seq div 2"))
    for p in sorted(r.part for r in ordered.select("part").distinct().collect()):
        ordered.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(where)
    q = online.run_stream(stream, how).writeStream.format("memory").queryName("online_rows").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = sorted(key(r) for r in spark.table("online_rows").collect())
    assert got == want


def test_late_frames_and_forgetting(spark, data):
    rows = [r for r in online._frames(runs.online_frames(spark, data).filter("sequence_id = 0").toPandas())]
    m = online.Memory(64)
    how = online.Online(bootstrap=1, max_age=1)
    first = m.step(rows[0], how)
    assert first["mode"] == "bootstrap" and m.step(rows[0], how)["mode"] == "late"
    n = len(m.ids)
    far = dict(rows[1], seq=99, uv=rows[1]["uv"][:0], z=rows[1]["z"][:0], desc=rows[1]["desc"][:0])
    assert m.step(far, how)["success"] is False and len(m.ids) == n
    m.prune(99, how)
    assert len(m.ids) == 0
    strict = online.Memory(64)
    literal = online.Online(bootstrap=1, literal=True)
    for f in rows:
        strict.step(f, literal)
    assert (strict.last == strict.last.max()).all()
