"""Landmarks from observations: summaries, indexes, votes and budgets.

Null vectors, null ids and rows without a position take no part in a summary;
empty inputs give empty results. Ties are always broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import vec
from waymark.operators.groups import by_key


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: repeated deliveries have the same content."""
    return df.filter(" and ".join(f"{k} is not null" for k in keys)).dropDuplicates(list(keys))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mu): the mean of each key's vectors, normalised. Aggregated by component, so partial sums shuffle, not vectors."""
    parts = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.posexplode(vec.doubles(F.col(vector))).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg("x").alias("x"))
    arrays = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return arrays.select(key, vec.normalize(F.col("m")).alias("mu"))


def spreads(rows: DataFrame, means: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n_obs, spread): mean distance of the vectors to mu."""
    return rows.join(means, key).groupBy(key).agg(F.count("*").alias("n_obs"), F.avg(vec.distance(F.col(vector), F.col("mu"))).alias("spread"))


def observation_stats(obs: DataFrame, key: str = "landmark_id") -> DataFrame:
    """(key, n_obs, n_frames, first_frame, last_frame, mean_error); n_obs clipped to 65535 as the stores do."""
    rows = once(obs, "obs_id").filter(F.col(key).isNotNull() & F.col("frame_id").isNotNull())
    per = rows.groupBy(key, "frame_id").agg(F.count("*").alias("n"), F.sum(F.col("reproj_error").cast("double")).alias("s"), F.count("reproj_error").alias("m"))
    return per.groupBy(key).agg(
        F.least(F.sum("n"), F.lit(65535)).alias("n_obs"),
        F.count("*").alias("n_frames"),
        F.min("frame_id").alias("first_frame"),
        F.max("frame_id").alias("last_frame"),
        F.try_divide(F.sum("s"), F.sum("m")).alias("mean_error"),
    )


def running_means(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Mean of a value over a key's rows so far, as an incremental update would keep it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.avg(value).over(w))


# --- subspaces -------------------------------------------------------------


def subspace(x: np.ndarray, rank: int, floor: float = 1e-6) -> dict:
    """Mean direction, principal directions about it, their variances, the residual variance and the spread."""
    n, d = x.shape
    mean = x.mean(axis=0)
    mu = mean / (np.linalg.norm(mean) + 1e-8)
    z = x - mu
    spread = float(np.linalg.norm(z, axis=1).mean())
    if n <= 1:
        return {"mu": mu, "basis": np.zeros((0, d)), "eigvals": np.zeros(0), "sigma_perp2": floor, "spread": spread}
    r = min(rank, n, d)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    basis = vt[:r]
    basis = basis * np.where(basis[np.arange(r), np.abs(basis).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    rest = z - z @ basis.T @ basis
    sigma2 = max(floor, float((rest * rest).sum(axis=1).mean()) / max(1, d - r))
    return {"mu": mu, "basis": basis, "eigvals": s[:r] ** 2 / max(1, n - 1), "sigma_perp2": sigma2, "spread": spread}


def subspace_floored(x: np.ndarray, rank: int, floor: float = 1e-3) -> dict:
    """The variant on normalised rows: eigenvalues of the covariance, floored; the residual is the mean of those left out."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    n, d = x.shape
    mean = x.mean(axis=0)
    mu = mean / max(float(np.linalg.norm(mean)), 1e-8)
    z = x - mu
    spread = float(np.linalg.norm(z, axis=1).mean())
    if n <= 1:
        return {"mu": mu, "basis": np.zeros((rank, d)), "eigvals": np.full(rank, floor), "sigma_perp2": floor, "spread": spread}
    values, vectors = np.linalg.eigh(z.T @ z / max(1, n - 1))
    values, vectors = values[::-1], vectors[:, ::-1]
    r = min(rank, n - 1, d)
    sigma2 = max(floor, float(values[r:].mean())) if d > r else floor
    return {"mu": mu, "basis": vectors[:, :r].T, "eigvals": np.maximum(values[:r], floor), "sigma_perp2": sigma2, "spread": spread}


def subspaces(rows: DataFrame, key: str, vector: str, rank: int = 2, floored: bool = False, order: str | None = None) -> DataFrame:
    """(key, n_obs, mu, basis, eigvals, sigma_perp2, spread) of each key's vectors.

    A key's vectors meet in one task, as the decomposition needs them together; `bounded_views`
    or another cap on observations per landmark keeps that small.
    """
    kind = dict(rows.dtypes)[key]
    ddl = f"{key} {kind}, n_obs bigint, mu array<double>, basis array<array<double>>, eigvals array<double>, sigma_perp2 double, spread double"
    fit = subspace_floored if floored else subspace
    cols = [key, vector] + ([order] if order else [])

    def run(table: pa.Table) -> pa.Table:
        if order:
            table = table.sort_by(order)
        x = np.array(table.column(vector).to_pylist(), dtype=np.float64)
        s = fit(x, rank)
        return pa.table(
            {
                key: table.column(key).slice(0, 1),
                "n_obs": pa.array([len(x)], pa.int64()),
                **{c: pa.array([s[c].tolist()], t) for c, t in (("mu", pa.list_(pa.float64())), ("basis", pa.list_(pa.list_(pa.float64()))), ("eigvals", pa.list_(pa.float64())))},
                "sigma_perp2": pa.array([s["sigma_perp2"]]),
                "spread": pa.array([s["spread"]]),
            }
        )

    usable = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*cols)
    return by_key(usable, [key], run, ddl)


# --- views -----------------------------------------------------------------


def track_views(points: DataFrame, images: DataFrame) -> DataFrame:
    """(point3d_id, image_id, dir): unit view direction of every image of a point's track that has a pose."""
    from waymark.functions import pose

    entries = once(points, "point3d_id").filter("xyz is not null").select("point3d_id", "xyz", F.explode(F.array_distinct("image_ids")).alias("image_id")).filter("image_id is not null")
    finite = ~F.exists("qvec", lambda x: x.isNull() | F.isnan(x)) & (F.size("qvec") == 4) & (F.size("tvec") == 3)
    cameras = once(images, "image_id").filter(finite).select("image_id", pose.centre(pose.image_pose(F.col("qvec"), F.col("tvec"))).alias("centre"))
    return entries.join(cameras, "image_id").select("point3d_id", "image_id", pose.view_direction(F.col("xyz"), F.col("centre")).alias("dir"))


def view_diversity(views: DataFrame, key: str = "point3d_id") -> DataFrame:
    """(key, n_views, mean_angle, max_angle) over all pairs of a key's directions.

    The mean over pairs comes from one product matrix of the key's directions, in blocks.
    """
    kind = dict(views.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        d = np.array(table.column("dir").to_pylist(), dtype=np.float64).reshape(-1, 3)
        n, total, top = len(d), 0.0, 0.0
        for a in range(0, n, 1024):
            cos = np.clip(d[a : a + 1024] @ d.T, -1.0, 1.0)
            ang = np.degrees(np.arccos(cos))
            upper = np.arange(n)[None, :] > np.arange(a, min(n, a + 1024))[:, None]
            if upper.any():
                total += float(ang[upper].sum())
                top = max(top, float(ang[upper].max()))
        pairs = n * (n - 1) // 2
        return pa.table({key: table.column(key).slice(0, 1), "n_views": pa.array([n], pa.int64()), "mean_angle": pa.array([total / pairs if pairs else None], pa.float64()), "max_angle": pa.array([top if pairs else None], pa.float64())})

    return by_key(views.select(key, "dir"), [key], run, f"{key} {kind}, n_views bigint, mean_angle double, max_angle double")


def view_envelope(views: DataFrame, key: str = "point3d_id") -> DataFrame:
    """(key, mean_dir, min_cos, max_cos): mean direction (the first view's if the mean vanishes) and the range of cosines to it."""
    sums = views.groupBy(key).agg(*[F.avg(F.col("dir")[i]).alias(f"m{i}") for i in range(3)], F.min_by("dir", "image_id").alias("first"))
    n = F.sqrt(F.col("m0") * F.col("m0") + F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2"))
    mean = F.when(n > 1e-12, F.array(*[F.col(f"m{i}") / n for i in range(3)])).otherwise(F.col("first"))
    means = sums.select(key, mean.alias("mean_dir"))
    cos = vec.dot(F.col("dir"), F.col("mean_dir"))
    return views.join(means, key).groupBy(key).agg(F.first("mean_dir").alias("mean_dir"), F.min(cos).alias("min_cos"), F.max(cos).alias("max_cos"))


def bounded_views(views: DataFrame, most: int, key: str = "point3d_id", order: str = "image_id", gain: float = 1.0) -> DataFrame:
    """At most `most` rows of each key, kept for their diversity of view: in order, a row beyond the bound
    replaces the most redundant kept one if its least angle to the kept exceeds that one's by `gain` degrees.
    most <= 0 keeps none. (An ordered fold over each key's rows, which a task holds together.)
    """
    schema = views.schema
    names = views.columns

    def least(d: np.ndarray, others: np.ndarray) -> float:
        return float(np.degrees(np.arccos(np.clip(others @ d, -1, 1))).min()) if len(others) else 180.0

    def fold(rows: list[tuple]) -> list[int]:
        kept: list[int] = []
        dirs = [np.array(r) for r in rows]
        for i, d in enumerate(dirs):
            if most <= 0:
                break
            if len(kept) < most:
                kept.append(i)
                continue
            current = np.array([dirs[k] for k in kept])
            own = [least(current[j], np.delete(current, j, axis=0)) for j in range(len(kept))]
            worst = int(np.argmin(own))
            if least(d, current) > own[worst] + gain:
                kept[worst] = i
        return sorted(kept)

    def run(table: pa.Table) -> pa.Table:
        return table.take(pa.array(fold(table.column("dir").to_pylist()), pa.int64()))

    return by_key(views.select(*names), [key], run, schema, [order])


# --- indexes, votes, budgets ------------------------------------------------


def image_index(entries: DataFrame, attributes: DataFrame, most: int | None = None) -> DataFrame:
    """(frame_id, rank, lm_idx): the landmarks of each frame by staticness, observations and id; the first `most`.

    A frame with very many landmarks: the window's group limit prunes before the shuffle.
    """
    rows = entries.select("frame_id", "lm_idx").distinct().join(attributes.select("lm_idx", "staticness", "n_obs"), "lm_idx")
    w = Window.partitionBy("frame_id").orderBy(F.desc("staticness"), F.desc("n_obs"), "lm_idx")
    ranked = rows.withColumn("rnk", F.row_number().over(w))
    return (ranked if most is None else ranked.filter(F.col("rnk") <= most)).select("frame_id", "lm_idx", "rnk")


def votes(retrieved: DataFrame, entries: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """(query_id, lm_idx, vote, rk): landmarks of the retrieved frames by the sum of 1 / (rank + 1), or of `weight`."""
    w = F.lit(1.0) / (F.col("rnk") + 1) if weight is None else weight
    summed = retrieved.join(entries.select("frame_id", "lm_idx").distinct(), "frame_id").groupBy("query_id", "lm_idx").agg(F.round(F.sum(w), 6).alias("vote"))
    per = Window.partitionBy("query_id").orderBy(F.desc("vote"), "lm_idx")
    return summed.withColumn("rk", F.row_number().over(per)).filter(F.col("rk") <= most)


def top_landmarks(attributes: DataFrame, most: int | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The best landmarks by staticness, (further columns,) observations and id; None: all of them, in order."""
    ordered = attributes.orderBy(F.desc("staticness"), *[F.desc(c) for c in extra], F.desc("n_obs"), "lm_idx")
    return ordered if most is None else ordered.limit(most)


def active_set(landmarks: DataFrame, sequence: str, now: Column, max_age: int, most: int, min_obs: int = 1, min_static: float = 0.0) -> DataFrame:
    """Valid landmarks of each sequence: enough observations, static enough, seen within max_age frames; the best `most`."""
    valid = landmarks.filter((F.col("n_obs") >= min_obs) & (F.col("staticness") >= min_static) & (now - F.col("last_frame") <= max_age))
    w = Window.partitionBy(sequence).orderBy(F.desc("staticness"), F.desc("last_frame"), F.desc("n_obs"), "lm_idx")
    return valid.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= most)


def stored_summaries(landmarks: DataFrame, dim: int) -> DataFrame:
    """(landmark_id, mu, eigvals, sigma_perp2, spread) of landmarks whose descriptors are summarised already.

    The mean distance to mu isn't kept beside them; spread is sqrt(sigma_perp2), as in landmark_staticness.
    Landmarks without a finite mu of `dim` entries or a residual variance have no summary.
    """
    finite = (F.size("mu") == dim) & ~F.exists("mu", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = once(landmarks, "landmark_id").filter(finite & (F.col("sigma_perp2") >= 0) & ~F.isnan("sigma_perp2"))
    return rows.select("landmark_id", "mu", "eigvals", "sigma_perp2", F.sqrt(F.col("sigma_perp2").cast("double")).alias("spread"))


def build_store(entries: DataFrame, views: DataFrame, points: DataFrame, summaries: DataFrame, min_obs: int = 1, min_static: float = 0.0) -> DataFrame:
    """The landmark table: summaries of observations, descriptors and views joined, scored and cut by staticness.

    entries: landmark_id, frame_id, obs_id, reproj_error. views: point3d_id, image_id, dir. points: point3d_id, xyz.
    summaries: landmark_id, spread and what else the table shall have of the descriptors (mu, basis, eigvals,
    sigma_perp2), from `subspaces` or `stored_summaries`. Landmarks without a position or a summary are left out.
    """
    from waymark.functions import scores

    stats = observation_stats(entries).filter(F.col("n_obs") >= min_obs)
    seen = view_diversity(views).withColumnRenamed("point3d_id", "landmark_id")
    box = view_envelope(views).withColumnRenamed("point3d_id", "landmark_id")
    placed = once(points, "point3d_id").filter("xyz is not null").select(F.col("point3d_id").alias("landmark_id"), "xyz")
    described = summaries.filter("spread is not null").drop("n_obs")
    joined = stats.join(placed, "landmark_id").join(described, "landmark_id").join(seen, "landmark_id", "left").join(box, "landmark_id", "left")
    diversity = scores.view_diversity(F.col("mean_angle"), F.col("max_angle"), F.coalesce("n_views", F.lit(0)))
    static = scores.staticness(F.col("n_obs"), F.col("spread"), F.coalesce("mean_error", F.lit(0.0)), diversity)
    filled = joined.withColumns({"view_diversity": diversity, "staticness": static, "min_cos": F.coalesce("min_cos", F.lit(-1.0)), "max_cos": F.coalesce("max_cos", F.lit(1.0))})
    return filled.filter(F.col("staticness") >= min_static)


def observation_in(obs: DataFrame, frames: DataFrame, key: str = "landmark_id") -> DataFrame:
    """The first observation (by obs_id) of each landmark in each wanted frame."""
    near = once(obs, "obs_id").join(frames.select("frame_id").distinct(), "frame_id", "left_semi")
    return near.groupBy(key, "frame_id").agg(F.min_by(F.struct("obs_id", "u", "v"), "obs_id").alias("o")).select(key, "frame_id", "o.*")


def fine_means(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of each key's non-zero fine descriptors, normalised; keys without any have none."""
    return mean_vectors(rows.filter(vec.norm(F.col(vector)) > vec.EPS), key, vector)


def merge_within(points: DataFrame, group: str, radius: float, least: float) -> DataFrame:
    """(group, obs_id, landmark_no): observations merged, in order of obs_id, into the landmark within the radius and
    with at least this cosine whose cosine less a quarter of its distance is greatest; else a new landmark.

    Every merge moves its landmark, so the fold over a group is sequential; groups (scenes, sequences) run in parallel.
    """
    import numpy as np

    from waymark.streaming.online import Memory, Online

    kind = dict(points.dtypes)[group]
    how = Online(merge_radius=radius, merge_cosine=least)

    def run(table: pa.Table) -> pa.Table:
        desc = np.array(table.column("desc").to_pylist(), dtype=np.float64)
        xyz = np.array(table.column("xyz").to_pylist(), dtype=np.float64)
        numbers = Memory(desc.shape[1]).add(xyz, desc, 0, how)
        return pa.table({group: table.column(group), "obs_id": table.column("obs_id"), "landmark_no": pa.array(numbers, pa.int64())})

    return points.select(group, "obs_id", "xyz", "desc").filter("xyz is not null and desc is not null").transform(by_key, [group], run, f"{group} {kind}, obs_id bigint, landmark_no bigint", ["obs_id"])
