"""Joins by time and by place, without products of whole tables.

By place, both sides of an image meet in one task, where a left row is measured against
the right rows of a strip about it, some at a time. By time, rows of a bucket are scanned
in order, so however many fall together no pairs are made. Null keys and coordinates take
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from waymark.operators.groups import whole_groups


def nearest_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tolerance: int, group: str | None = None, keep_left: bool = False) -> DataFrame:
    """(left_id, right_id, dt): the right row nearest in time (column t, integer) within the tolerance; on a tie the earlier one.

    Not one-to-one: a right row may serve several left rows. keep_left: left rows without a partner stay, with nulls.
    """
    keys = [group] if group else []
    width = max(1, tolerance)
    bucket = F.floor(F.col("t") / width).alias("b")
    rows = right.filter(F.col("t").isNotNull() & F.col(right_id).isNotNull()).groupBy(*keys, "t").agg(F.min(right_id).alias("r")).select(*keys, "t", bucket, F.struct("t", "r").alias("s"))
    ask = left.filter(F.col("t").isNotNull()).select(*keys, "t", bucket, F.col(left_id).alias("a"))
    # Inside a bucket a sorted scan; of the neighbouring buckets only the last and the first record can be nearest.
    both = ask.withColumn("s", F.lit(None).cast(rows.schema["s"].dataType)).withColumn("asks", F.lit(True)).unionByName(rows.withColumns({"a": F.lit(None).cast(ask.schema["a"].dataType), "asks": F.lit(False)}))
    w = Window.partitionBy(*keys, "b").orderBy("t")
    inside = both.withColumns({"before": F.max("s").over(w.rangeBetween(Window.unboundedPreceding, 0)), "after": F.min("s").over(w.rangeBetween(0, Window.unboundedFollowing))}).filter("asks")
    ends = rows.groupBy(*keys, "b").agg(F.max("s").alias("last"), F.min("s").alias("first"))
    on = [*keys, "b"]
    near = inside.join(ends.select(*keys, (F.col("b") + 1).alias("b"), "last"), on, "left").join(ends.select(*keys, (F.col("b") - 1).alias("b"), "first"), on, "left")
    told = lambda c: F.when(F.abs(F.col("t") - F.col(f"{c}.t")) <= tolerance, F.struct(F.abs(F.col("t") - F.col(f"{c}.t")).alias("dt"), F.col(f"{c}.t").alias("tr"), F.col(f"{c}.r").alias("r")))
    best = near.withColumn("m", F.least(*map(told, ("before", "after", "last", "first")))).filter("m is not null")
    found = best.groupBy(*keys, "a").agg(F.min("m").alias("m")).select(*keys, F.col("a").alias(left_id), F.col("m.r").alias(right_id), F.col("m.dt").alias("dt"))
    return left.select(*keys, left_id).join(found, [*keys, left_id], "left") if keep_left else found


def nearest_keypoint(left: DataFrame, right: DataFrame, image: str, left_id: str, right_id: str, radius: float) -> DataFrame:
    """(image, left_id, right_id, d2): the right keypoint (x, y) nearest to the left one within a radius; ties to the smaller id.

    A task holds the keypoints of one image. Coordinates that aren't finite are near to nothing.
    """
    kind = lambda df, c: df.schema[c].dataType
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xy")
    spot = [F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    usable = lambda df: df.filter(F.col(image).isNotNull()).filter(finite)
    ask = usable(left).select(image, F.lit(True).alias("asks"), F.col(left_id).alias("a"), F.lit(None).cast(kind(right, right_id)).alias("r"), *spot)
    have = usable(right).select(image, F.lit(False).alias("asks"), F.lit(None).cast(kind(left, left_id)).alias("a"), F.col(right_id).alias("r"), *spot)

    pairs = PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in whole_groups(batches, [image]):
            if not groups:
                continue
            rows = pa.concat_tables(groups).combine_chunks()
            ours, theirs, d2 = _nearest_rows(np.repeat(np.arange(len(groups)), [len(g) for g in groups]), *(rows.column(c).to_numpy() for c in ("asks", "x", "y")), radius, pairs)
            at, to = rows.take(pa.array(ours)), rows.take(pa.array(theirs))
            yield from pa.table({image: at.column(image), "a": at.column("a"), "r": to.column("r"), "d2": pa.array(d2)}).combine_chunks().to_batches()

    schema = StructType([StructField(image, kind(left, image)), StructField("a", kind(left, left_id)), StructField("r", kind(right, right_id)), StructField("d2", DoubleType())])
    near = ask.unionByName(have).repartition(image).sortWithinPartitions(image, "asks", "a", "r").mapInArrow(run, schema)
    best = near.groupBy(image, F.col("a").alias(left_id)).agg(F.min(F.struct("d2", "r")).alias("m"))
    return best.select(image, left_id, F.col("m.r").alias(right_id), F.col("m.d2").alias("d2"))


PAIRS = 1 << 20  # that are measured at once


def _nearest_rows(group: np.ndarray, asks: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking row, its nearest row, squared distance) inside the groups, within the radius; ties to the earlier row.

    Each asking row is measured against the rows of a strip of x about it, about `pairs` at a time.
    """
    ours, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
    theirs = theirs[np.lexsort((x[theirs], group[theirs]))]
    reach = radius + 1e-9 * (radius + np.abs(x[ours]))  # a little more than the rounding of the ends can take away

    def before(ends: np.ndarray, side: int) -> np.ndarray:
        """How many of theirs come before an end: side 0 puts it before equal ones, 2 behind them."""
        g, at = np.concatenate([group[theirs], group[ours]]), np.concatenate([x[theirs], ends])
        order = np.lexsort((np.repeat([1, side], [len(theirs), len(ours)]), at, g))
        n = np.empty(len(order), np.int64)
        n[order] = np.cumsum(order < len(theirs))
        return n[len(theirs) :]

    first, end = before(x[ours] - reach, 0), before(x[ours] + reach, 2)
    ours, first, many = (z[end > first] for z in (ours, first, end - first))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    sums, i = np.cumsum(many), 0
    while i < len(ours):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + pairs, "right")))
        n = many[i:j]
        a = np.repeat(ours[i:j], n)
        r = theirs[np.arange(n.sum()) + np.repeat(first[i:j] - (np.cumsum(n) - n), n)]
        d2 = (x[a] - x[r]) * (x[a] - x[r]) + (y[a] - y[r]) * (y[a] - y[r])
        near = d2 <= radius * radius
        a, r, d2 = a[near], r[near], d2[near]
        order = np.lexsort((r, d2, a))
        order = order[np.diff(a[order], prepend=-1) > 0]
        out.append((a[order], r[order], d2[order]))
        i = j
    return tuple(np.concatenate(z) for z in zip(*out))


def resolve_names(queries: DataFrame, name: str, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Look a name up by several keys of a table (full name, base name, stem, id), the first that matches."""
    out = queries
    found = []
    for i, k in enumerate(keys):
        side = table.filter(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias(f"__k{i}")).agg(F.min(value).alias(f"__v{i}"))
        out = out.join(side, F.col(name) == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__v{i}"))
    return out.withColumn(value, F.coalesce(*found)).select(*queries.columns, value)


def stem(path):
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def strided(rows: DataFrame, group: list[str], order: list[str], start: int = 0, stride: int = 1, most: int | None = None) -> DataFrame:
    """Every stride-th row of each group from `start` on, the first `most` of them."""
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    n = F.row_number().over(w) - 1
    out = rows.withColumn("__n", n).filter((F.col("__n") >= start) & ((F.col("__n") - start) % stride == 0))
    return (out if most is None else out.filter((F.col("__n") - start) / stride < most)).drop("__n")
