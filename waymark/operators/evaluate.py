"""Evaluation of localization runs: summaries, recall, trajectory errors, comparison tables.

Failed queries have null errors and take no part in error aggregates. Empty
groups give no row; an aggregate over no errors is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import pose, vec

# The usual (metres, degrees) thresholds.
THRESHOLDS = ((0.25, 2.0), (0.5, 5.0), (5.0, 10.0))


def summary(rows: DataFrame, by: list[str], success: str, values: list[str]) -> DataFrame:
    """Counts, success rate, and mean and median of each value where it is present."""
    aggs = [F.count("*").alias("num_queries"), F.sum(F.col(success).cast("int")).alias("num_success"), F.round(F.avg(F.col(success).cast("double")), 6).alias("success_rate")]
    for v in values:
        aggs += [F.round(F.avg(v), 6).alias(f"mean_{v}"), F.round(F.median(v), 6).alias(f"median_{v}")]
    return rows.groupBy(*by).agg(*aggs)


def recall(rows: DataFrame, by: list[str], trans: str, rot: str, thresholds=THRESHOLDS) -> DataFrame:
    """Share of rows within each threshold: of the rows that have errors, and of all rows."""
    have = F.col(trans).isNotNull() & F.col(rot).isNotNull()
    aggs = []
    for i, (t, r) in enumerate(thresholds):
        inside = have & (F.col(trans) <= t) & (F.col(rot) <= r)
        aggs += [F.round(F.avg(F.when(have, inside.cast("double"))), 6).alias(f"recall_{i}"), F.round(F.avg(F.coalesce(inside, F.lit(False)).cast("double")), 6).alias(f"recall_all_{i}")]
    return rows.groupBy(*by).agg(*aggs)


def ate(rows: DataFrame, by: list[str], error: Column) -> DataFrame:
    """Root mean square of the position errors."""
    return rows.groupBy(*by).agg(F.round(F.sqrt(F.avg(error * error)), 6).alias("ate"))


def ate_of_poses(rows: DataFrame, by: list[str], got: str, want: str) -> DataFrame:
    return ate(rows.filter(F.col(got).isNotNull() & F.col(want).isNotNull()), by, pose.translation_error(F.col(got), F.col(want)))


def rpe(rows: DataFrame, by: list[str], order: list[str], got: str, want: str) -> DataFrame:
    """Relative pose errors of consecutive rows with both poses: (n, trans_rmse, trans_median, rot_rmse, rot_median)."""
    w = Window.partitionBy(*by).orderBy(*order)
    both = rows.filter(F.col(got).isNotNull() & F.col(want).isNotNull())
    steps = both.withColumns({"g0": F.lag(got).over(w), "w0": F.lag(want).over(w)}).filter("g0 is not null")
    a, b = pose.relative(F.col("g0"), F.col(got)), pose.relative(F.col("w0"), F.col(want))
    errors = steps.select(*by, a.alias("a"), b.alias("b")).select(*by, pose.translation_error(F.col("a"), F.col("b")).alias("t"), pose.rotation_error(F.col("a"), F.col("b")).alias("r"))
    rms = lambda c: F.round(F.sqrt(F.avg(F.col(c) * F.col(c))), 5)
    return errors.groupBy(*by).agg(F.count("*").alias("n"), rms("t").alias("trans_rmse"), F.round(F.median("t"), 5).alias("trans_median"), rms("r").alias("rot_rmse"), F.round(F.median("r"), 5).alias("rot_median"))


def reprojection_stats(rows: DataFrame, by: list[str], error: str, near: float = 2.0) -> DataFrame:
    """(n, mean, median, max, near_share) of reprojection errors."""
    e = F.col(error)
    return rows.groupBy(*by).agg(F.count(e).alias("n"), F.round(F.avg(e), 3).alias("mean"), F.round(F.median(e), 3).alias("median"), F.round(F.max(e), 3).alias("max"), F.round(F.avg((e < near).cast("double")), 6).alias("near_share"))


def comparison(rows: DataFrame, method: str, dataset: str, datasets: list[str], value: Column) -> DataFrame:
    """A row per method, a column per dataset."""
    return rows.groupBy(method).pivot(dataset, datasets).agg(F.round(F.avg(value), 6))


def runtimes(rows: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Time per query of a run: the mean of its queries, else its wall time over its number of queries."""
    mean = rows.groupBy(key).agg(F.avg("query_time_s").alias("mean_s"))
    fallback = F.try_divide(F.col("wall_s"), F.col("num_queries"))
    return runs.join(mean, key, "left").select(key, F.coalesce("mean_s", fallback).alias("runtime_s"))


def totals(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"))


MOST_VALUES = 100_000  # different ones that come to the driver to find a quantile among them


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a whole table, interpolated between neighbours; None without values. Nulls take no part.

    Approximate quantiles on either side of the wanted rank bound a slice of the values; the slice is narrowed until it
    is small, and only that is sorted. So no task holds the table's values, and the result doesn't hang on the approximation.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = values.count()
    if not n:
        return [None] * len(shares)

    def around(rank: int) -> tuple[list[tuple[float, int]], int]:
        """Values in order with their counts, among them those of this rank and the next, and how many there are below them."""
        part, below, size, step, flat = values, 0, n, 0.001, False
        while True:
            if size <= 20 * MOST_VALUES or flat:
                got = part.groupBy("v").agg(F.count("*").alias("c")).limit(MOST_VALUES + 1).collect()
                if len(got) <= MOST_VALUES:
                    return sorted((r["v"], r["c"]) for r in got), below
            at = (rank - below) / size
            a, b = part.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, at - step)), F.lit(min(1.0, at + 2 / size + step))), F.lit(10_000))).first()[0]
            under, inside = values.agg(F.count_if(F.col("v") < a), F.count_if((F.col("v") >= a) & (F.col("v") <= b))).first()
            if under <= rank and under + inside >= min(rank + 2, n):
                flat = a == b or inside >= size  # perhaps few values, but very many of each
                step = step / 4 if inside >= size else step
                part, below, size = values.filter((F.col("v") >= a) & (F.col("v") <= b)), under, inside
            else:
                step *= 4  # the approximation was off by more

    def value(got: list[tuple[float, int]], place: int) -> float:
        for v, c in got:
            if place < c:
                return v
            place -= c
        return got[-1][0]

    out = []
    for q in shares:
        place = q * (n - 1)
        rank = min(int(place), n - 1)
        got, below = around(rank)
        first, second = value(got, rank - below), value(got, rank + 1 - below)
        out.append(first if rank == place else (rank + 1 - place) * first + (place - rank) * second)
    return out


def trim(rows: DataFrame, columns: list[str], low: float, high: float, pad: float = 0.02, least: float = 1e-3) -> DataFrame:
    """Rows inside the box between two percentiles of each column, padded by a share of its extent (at least `least`)."""
    out = rows
    for c in columns:
        a, b = quantiles(rows, c, [low, high])
        if a is None:
            return rows.limit(0)
        extra = max((b - a) * pad, least)
        out = out.filter((F.col(c) >= a - extra) & (F.col(c) <= b + extra))
    return out


def cubic_bounds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal half extents for all axes about the middle: max(0.55 * greatest extent, 1)."""
    span = rows.agg(*[x for c in columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    half = F.greatest(0.55 * F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in columns]), F.lit(1.0))
    return span.select(*[((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2).alias(f"mid_{c}") for c in columns], half.alias("half"))


def map_stats(landmarks: DataFrame) -> DataFrame:
    middle = F.lit(quantiles(landmarks, "staticness", [0.5])[0]).cast("double")
    return landmarks.agg(F.count("*").alias("n_landmarks"), F.round(F.avg("staticness"), 6).alias("mean_static"), F.round(middle, 6).alias("median_static"), F.round(F.avg("n_obs"), 6).alias("mean_obs"))


def sampled(rows: DataFrame, most: int, id_: str, seed: int = 0) -> DataFrame:
    """A seeded subsample of at most `most` rows."""
    return rows.orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_).limit(most)


def errors(rows: DataFrame, got: str, want: str) -> DataFrame:
    """Rows with trans_err_m and rot_err_deg; null where either pose is missing."""
    both = F.col(got).isNotNull() & F.col(want).isNotNull()
    return rows.withColumns({"trans_err_m": F.when(both, vec.distance(pose.centre(F.col(got)), pose.centre(F.col(want)))), "rot_err_deg": F.when(both, pose.rotation_error(F.col(got), F.col(want)))})
