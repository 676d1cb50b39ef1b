"""A few keys holding most records: multi-level tree aggregation.

Rows go to chunks of about CHUNK_ROWS rows by a hash of the row, not of the key, so no
chunk is larger because a key is. Each chunk combines its rows locally into one
state per key. Then the states are merged in rounds: FAN_IN chunks become one
in each round, and a round is keyed by (key, chunk), so a hot key's states are
merged in parallel and no task ever receives more than FAN_IN states of a key.
After ceil(log_FAN_IN(chunks)) rounds one state per key is left.

Defined results
* rows with a null key or a null in what is counted are left out.
* repeated deliveries (same row id) count once: they hash to the same chunk and are combined there.
* ties go to the smaller id; null and NaN errors don't compete.
* empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 8
CHUNK_ROWS = 1_000_000


def chunks_for(df: DataFrame) -> int:
    """Chunks of the first level: so many that each has about CHUNK_ROWS rows, however many rows there are."""
    return max(1, -(-df.count() // CHUNK_ROWS))


def merge_rounds(states: DataFrame, keys: list[str], merge: dict[str, Column], chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """One state per key from one per (key, __chunk), by rounds of fan_in.

    merge: for each state column, the aggregate that combines it.
    """
    for _ in range(max(1, math.ceil(math.log(max(chunks, 2), fan_in)))):
        states = states.withColumn("__chunk", (F.col("__chunk") / fan_in).cast("int"))
        states = states.groupBy(*keys, "__chunk").agg(*[c.alias(n) for n, c in merge.items()])
    return states.drop("__chunk")


def tree_aggregate(rows: DataFrame, keys: list[str], chunk_by: list[str], local: Callable[[DataFrame], DataFrame], merge: dict[str, Column], fan_in: int = FAN_IN) -> DataFrame:
    """Per-key states: `local` combines the rows of a chunk (it gets and keeps __chunk), rounds merge them."""
    n = chunks_for(rows)
    chunked = rows.withColumn("__chunk", F.expr(f"cast(pmod(xxhash64({', '.join(chunk_by)}), {n}) as int)"))
    return merge_rounds(local(chunked), keys, merge, n, fan_in)


def modes(observations: DataFrame, key: str = "frame_id", value: str = "landmark_id", row_id: str = "obs_id") -> DataFrame:
    """(key_id, top_id): per key the value in most rows, ties to the smaller."""
    rows = observations.select(F.col(key).alias("key_id"), F.col(value).alias("value_id"), row_id).filter(f"key_id is not null and value_id is not null and {row_id} is not null")

    def local(x: DataFrame) -> DataFrame:
        once = x.dropDuplicates(["__chunk", row_id, "key_id", "value_id"])  # the chunk is a function of row_id
        return once.groupBy("__chunk", "key_id", "value_id").agg(F.count("*").alias("n"))

    counted = tree_aggregate(rows, ["key_id", "value_id"], [row_id], local, {"n": F.sum("n")})
    best = F.max(F.struct("n", (-F.col("value_id")).alias("v")))
    n = chunks_for(rows)
    local_best = counted.withColumn("__chunk", F.expr(f"cast(pmod(xxhash64(value_id), {n}) as int)")).groupBy("__chunk", "key_id").agg(best.alias("s"))
    top = merge_rounds(local_best, ["key_id"], {"s": F.max("s")}, n)
    return top.select("key_id", (-F.col("s.v")).alias("top_id"))


def lowest_errors(points: DataFrame) -> DataFrame:
    """(key_id, top_id): per image the point of lowest error among the points that list it, ties to the smaller."""
    usable = points.filter("point_error is not null and not isnan(point_error) and point3d_id is not null")
    entries = usable.select("point_error", "point3d_id", F.explode(F.array_distinct("image_ids")).alias("key_id")).filter("key_id is not null")
    best = F.min(F.struct(F.col("point_error").alias("e"), F.col("point3d_id").alias("p")))
    top = tree_aggregate(entries, ["key_id"], ["point3d_id"], lambda x: x.groupBy("__chunk", "key_id").agg(best.alias("s")), {"s": F.min("s")})
    return top.select("key_id", F.col("s.p").alias("top_id"))


def top_per_key(observations: DataFrame, points: DataFrame) -> DataFrame:
    """Both results of problem 6, by key_field."""
    frames = modes(observations).select(F.lit("observations.frame_id").alias("key_field"), "key_id", "top_id")
    images = lowest_errors(points).select(F.lit("points3d.image_ids").alias("key_field"), "key_id", "top_id")
    return frames.unionByName(images)


def key_loads(observations: DataFrame, points: DataFrame) -> DataFrame:
    """(key_field, key_id, n_rows, mean_error): a summary per frame and per image by the same tree."""
    rows = observations.filter("frame_id is not null and obs_id is not null").select("obs_id", F.col("frame_id").alias("key_id"), F.col("reproj_error").cast("double").alias("e"))

    def local(x: DataFrame) -> DataFrame:
        once = x.groupBy("__chunk", "obs_id", "key_id").agg(F.max("e").alias("e"))
        return once.groupBy("__chunk", "key_id").agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.count("e").alias("m"))

    merge = {"n": F.sum("n"), "s": F.sum("s"), "m": F.sum("m")}
    mean = F.round(F.try_divide("s", "m"), 6).alias("mean_error")
    frames = tree_aggregate(rows, ["key_id"], ["obs_id"], local, merge).select(F.lit("observations.frame_id").alias("key_field"), "key_id", F.col("n").alias("n_rows"), mean)
    entries = points.filter("point3d_id is not null").select("point3d_id", F.when(~F.isnan("point_error"), F.col("point_error")).alias("e"), F.explode(F.array_distinct("image_ids")).alias("key_id")).filter("key_id is not null")

    def local_points(x: DataFrame) -> DataFrame:
        once = x.groupBy("__chunk", "point3d_id", "key_id").agg(F.max("e").alias("e"))
        return once.groupBy("__chunk", "key_id").agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.count("e").alias("m"))

    images = tree_aggregate(entries, ["key_id"], ["point3d_id"], local_points, merge).select(F.lit("points3d.image_ids").alias("key_field"), "key_id", F.col("n").alias("n_rows"), mean)
    return frames.unionByName(images)
