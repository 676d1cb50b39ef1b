"""Line formats: query lists, retrieval pairs, trajectories, poses, intrinsics, evaluation texts.

All parsers take a DataFrame with the lines (columns `file`, `no`, `line`), so
they work on files, tables and streams alike; `read_lines` makes one from files.
Blank lines and `#` comments are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """(file, block, k, line): lines with their place in the split they were read from, without those that match `skip`."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r$", "").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if skip:
                b = b.filter(pc.invert(pc.match_substring_regex(b.column("line"), skip)))
            names, blocks = b.column("file").to_pylist(), b.column("block").to_numpy()
            places = np.zeros(b.num_rows, np.int64)
            for i, here in enumerate(zip(names, blocks.tolist())):
                k = k + 1 if here == at else 0
                at, places[i] = here, k
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(places), b.column("line")], names=["file", "block", "k", "line"])

    return rows.mapInArrow(run, "file string, block bigint, k bigint, line string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line) with numbers that follow the order in each file, read split by split: in the first split they count the lines."""
    return numbered(spark, path).select("file", (F.col("block") + F.col("k")).alias("no"), "line")


def tokens(lines: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("line", r"\s+", " "))
    return lines.withColumn("line", text).filter("line is not null and line <> '' and not startswith(line, '#')").withColumn("t", F.split("line", " "))


def query_list(lines: DataFrame) -> DataFrame:
    """(no, name, camera_model, width, height, params): `name [MODEL W H params...]`; null camera for fewer than five tokens."""
    t = F.col("t")
    full = F.size(t) >= 5
    return tokens(lines).select(
        "no",
        t[0].alias("name"),
        F.when(full, t[1]).alias("camera_model"),
        F.when(full, F.get(t, F.lit(2)).try_cast("int")).alias("width"),
        F.when(full, F.get(t, F.lit(3)).try_cast("int")).alias("height"),
        F.when(full, F.transform(F.slice(t, 5, F.size(t)), lambda x: x.try_cast("double"))).alias("params"),
    )


def retrieval_pairs(lines: DataFrame, literal: bool = False) -> DataFrame:
    """(query_name, db_name, rnk): ranked database images; lines of a query accumulate.

    `q db`, `q db score` or `q db1 db2 ...`. A third token is a score if it is a number; literal: always.
    """
    t = F.col("t")
    scored = F.lit(True) if literal else t[2].try_cast("double").isNotNull()
    names = F.when(F.size(t) == 3, F.when(scored, F.slice(t, 2, 1)).otherwise(F.slice(t, 2, 2))).otherwise(F.slice(t, 2, F.size(t)))
    rows = tokens(lines).filter(F.size("t") >= 2).select("no", t[0].alias("query_name"), F.posexplode(names).alias("pos", "db_name"))
    w = Window.partitionBy("query_name").orderBy("no", "pos")
    return rows.select("query_name", "db_name", (F.row_number().over(w) - 1).alias("rnk"))


def timed_paths(lines: DataFrame) -> DataFrame:
    """(ts, path) of association lists: at least two tokens."""
    return tokens(lines).filter("size(t) >= 2").select(F.col("t")[0].try_cast("double").alias("ts"), F.col("t")[1].alias("path")).filter("ts is not null")


def timed_poses(lines: DataFrame) -> DataFrame:
    """(ts, T_wc) of ground-truth lists `ts tx ty tz qx qy qz qw`."""
    from waymark.functions import pose

    n = F.transform(F.slice("t", 1, 8), lambda x: x.try_cast("double"))
    rows = tokens(lines).filter("size(t) >= 8").select(n.alias("n")).filter(~F.exists("n", lambda x: x.isNull()))
    v = F.col("n")
    return rows.select(v[0].alias("ts"), pose.from_quaternion(v[7], v[4], v[5], v[6], v[1], v[2], v[3]).alias("T_wc"))


def predicted_poses(lines: DataFrame) -> DataFrame:
    """(name, T_wc) of result lists `name qw qx qy qz tx ty tz` (world to camera)."""
    from waymark.functions import pose

    n = F.transform(F.slice("t", 2, 7), lambda x: x.try_cast("double"))
    rows = tokens(lines).filter("size(t) >= 8").select(F.col("t")[0].alias("name"), n.alias("n")).filter(~F.exists("n", lambda x: x.isNull()))
    v = F.col("n")
    return rows.select("name", pose.invert(pose.from_quaternion(v[0], v[1], v[2], v[3], v[4], v[5], v[6])).alias("T_wc"))


def matrices(texts: DataFrame, size: int = 16) -> DataFrame:
    """(file, m): whole texts of exactly `size` finite numbers; others give null."""
    n = F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x.try_cast("double"))
    good = (F.size("n") == size) & ~F.exists("n", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return texts.withColumn("n", n).select("file", F.when(good, F.col("n")).alias("m"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def intrinsics_six(texts: DataFrame) -> DataFrame:
    """(file, intr): `fx fy cx cy width height`, exactly six numbers."""
    m = matrices(texts, 6)
    names = ("fx", "fy", "cx", "cy", "width", "height")
    return m.select("file", F.when(F.col("m").isNotNull(), F.struct(*[F.col("m")[i].alias(n) for i, n in enumerate(names)])).alias("intr"))


def intrinsics_matrix(texts: DataFrame) -> DataFrame:
    """(file, intr): fx, fy, cx, cy of a 4x4 or 3x3 matrix."""
    four, three = matrices(texts, 16).withColumnRenamed("m", "a"), matrices(texts, 9).withColumnRenamed("m", "b")
    pick = lambda c, w: F.struct(F.col(c)[0].alias("fx"), F.col(c)[w + 1].alias("fy"), F.col(c)[2].alias("cx"), F.col(c)[w + 2].alias("cy"))
    return four.join(three, "file").select("file", F.when(F.col("a").isNotNull(), pick("a", 4)).when(F.col("b").isNotNull(), pick("b", 3)).alias("intr"))


def recall_lines(lines: DataFrame) -> DataFrame:
    """(metres, degrees, score) of evaluation texts: `0.25 m, 2 deg: 41.3 %` in any wording; see `normal_score`."""
    pattern = r"([0-9.]+)\s*m\b.*?([0-9.]+)\s*deg[^0-9]*([0-9.]+)"
    got = lambda i: F.regexp_extract("line", pattern, i).try_cast("double")
    return lines.filter(F.regexp_like("line", F.lit(pattern))).select("no", got(1).alias("metres"), got(2).alias("degrees"), normal_score(got(3)).alias("score"))


def normal_score(c):
    """Values above 1.5 are percents; the result lies in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1.5, c / 100).otherwise(c)))
