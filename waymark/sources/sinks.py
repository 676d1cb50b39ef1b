"""Writers: landmark store, pose lines, metrics, comparison tables, result registry."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import pose


def save_store(landmarks: DataFrame, index: DataFrame, folder: str) -> None:
    """Landmarks and the image index as Parquet; the index is clustered by frame, so reads of a frame prune files."""
    landmarks.write.mode("overwrite").parquet(os.path.join(folder, "landmarks"))
    index.repartitionByRange("frame_id").sortWithinPartitions("frame_id", "rnk").write.mode("overwrite").parquet(os.path.join(folder, "image_index"))


def load_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Landmarks with defaults for columns that an older store lacks, and the index."""
    rows = spark.read.parquet(os.path.join(folder, "landmarks"))
    defaults = {"basis": F.array().cast("array<array<double>>"), "eigvals": F.array().cast("array<double>"), "sigma_perp2": F.lit(0.0), "min_cos": F.lit(-1.0), "max_cos": F.lit(1.0)}
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows, spark.read.parquet(os.path.join(folder, "image_index"))


def pose_line(name: Column, t: Column, world_to_camera: bool = True) -> Column:
    """`name qw qx qy qz tx ty tz` with eight decimals."""
    p = pose.invert(t) if world_to_camera else t
    q, c = pose.to_quaternion(p), pose.centre(p)
    numbers = [F.format_string("%.8f", q[i]) for i in range(4)] + [F.format_string("%.8f", c[i]) for i in range(3)]
    return F.concat_ws(" ", name, *numbers)


def save_poses(rows: DataFrame, path: str, world_to_camera: bool = True) -> None:
    rows.filter("T_wc is not null").select(pose_line(F.col("name"), F.col("T_wc"), world_to_camera).alias("value")).write.mode("overwrite").text(path)


def save_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def save_metrics(summary: DataFrame, frames: DataFrame, path: str, dataset: dict | None = None) -> None:
    """The payload {dataset, frames, summary}: rows of frames as JSON lines, dataset and summary beside them."""
    save_json(frames, os.path.join(path, "frames"))
    save_json(summary.withColumn("dataset", F.lit(json.dumps(dataset or {}))), os.path.join(path, "summary"))


def save_table(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def config_key(*columns: Column) -> Column:
    """Key of a cached result: SHA-1 of the JSON of everything it depends on."""
    return F.sha1(F.to_json(F.struct(*columns)))


def active_pairs(pairs: DataFrame, queries: DataFrame, database: DataFrame) -> DataFrame:
    """Retrieval pairs whose query and database image are both wanted."""
    q = queries.select(F.col("name").alias("query_name")).distinct()
    d = database.select(F.col("name").alias("db_name")).distinct()
    return pairs.join(q, "query_name", "left_semi").join(d, "db_name", "left_semi")


def subset(pairs: DataFrame, n_queries: int, most_images: int) -> tuple[DataFrame, DataFrame]:
    """The first queries by name, and the database images they retrieve, in order of first use, up to a cap."""
    names = pairs.select("query_name").distinct().orderBy("query_name").limit(n_queries)
    images = pairs.join(names, "query_name", "left_semi").groupBy("db_name").agg(F.min(F.struct("query_name", "rnk")).alias("o"))
    return names, images.orderBy("o", "db_name").limit(most_images).select("db_name")
