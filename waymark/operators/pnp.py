"""Camera poses from 2D-3D matches, in numpy, one query after another.

Minimal solver: three points by Grunert's quartic for the distances to the
camera, a fourth point picks the root; RANSAC draws with a generator seeded by
the query; refinement is Levenberg-Marquardt on the reprojection errors of the
inliers. Lens distortion of the radial-tangential model is undone first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.groups import by_key


@dataclass(frozen=True)
class Ransac:
    error_px: float = 8.0
    iterations: int = 1000
    confidence: float = 0.999
    seed: int = 0
    retries: tuple[float, ...] = ()  # larger thresholds tried in turn after a failure


def undistort(xy: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Ideal normalised coordinates of distorted ones, by fixed-point iteration."""
    if not np.any(k):
        return xy
    k1, k2, p1, p2 = k
    out = xy.copy()
    for _ in range(20):
        x, y = out[:, 0], out[:, 1]
        r2 = x * x + y * y
        radial = 1 + k1 * r2 + k2 * r2 * r2
        dx = 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
        dy = p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
        out = np.stack([(xy[:, 0] - dx) / radial, (xy[:, 1] - dy) / radial], axis=1)
    return out


def absolute_orientation(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t with c = R p + t, from at least three pairs."""
    mp, mc = p.mean(axis=0), c.mean(axis=0)
    u, _, vt = np.linalg.svd((c - mc).T @ (p - mp))
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    r = u @ d @ vt
    return r, mc - r @ mp


def three_point(p: np.ndarray, f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Poses (R, t world to camera) that see three points along three unit rays."""
    a2, b2, c2 = ((p[1] - p[2]) @ (p[1] - p[2]), (p[0] - p[2]) @ (p[0] - p[2]), (p[0] - p[1]) @ (p[0] - p[1]))
    if min(a2, b2, c2) < 1e-18:
        return []
    ca, cb, cg = f[1] @ f[2], f[0] @ f[2], f[0] @ f[1]
    q1, q2 = (a2 - c2) / b2, (a2 + c2) / b2
    r1, r2 = (b2 - c2) / b2, (b2 - a2) / b2
    quartic = [
        (q1 - 1) ** 2 - 4 * c2 / b2 * ca * ca,
        4 * (q1 * (1 - q1) * cb - (1 - q2) * ca * cg + 2 * c2 / b2 * ca * ca * cb),
        2 * (q1 * q1 - 1 + 2 * q1 * q1 * cb * cb + 2 * r1 * ca * ca - 4 * q2 * ca * cb * cg + 2 * r2 * cg * cg),
        4 * (-q1 * (1 + q1) * cb + 2 * a2 / b2 * cg * cg * cb - (1 - q2) * ca * cg),
        (1 + q1) ** 2 - 4 * a2 / b2 * cg * cg,
    ]
    out = []
    for v in np.roots(quartic):
        if abs(v.imag) > 1e-6 or v.real <= 0:
            continue
        v = v.real
        below = 2 * (cg - v * ca)
        if abs(below) < 1e-12:
            continue
        u = ((q1 - 1) * v * v - 2 * q1 * cb * v + 1 + q1) / below
        s = 1 + v * v - 2 * v * cb
        if u <= 0 or s <= 0:
            continue
        s1 = np.sqrt(b2 / s)
        out.append(absolute_orientation(p, f * np.array([s1, u * s1, v * s1])[:, None]))
    return out


def _errors(r: np.ndarray, t: np.ndarray, p: np.ndarray, xy: np.ndarray, focal: np.ndarray) -> np.ndarray:
    c = p @ r.T + t
    z = c[:, 2]
    ok = z > 1e-6
    e = np.full(len(p), 1e9)
    d = (c[ok, :2] / z[ok, None] - xy[ok]) * focal
    e[ok] = np.sqrt((d * d).sum(axis=1))
    return e


def _turn(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if a < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / (a * a) * k @ k


def refine(r: np.ndarray, t: np.ndarray, p: np.ndarray, xy: np.ndarray, focal: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt over rotation and translation."""
    damping, now = 1e-4, (_errors(r, t, p, xy, focal) ** 2).sum()
    for _ in range(rounds):
        q = p @ r.T
        c = q + t
        z = np.where(np.abs(c[:, 2]) < 1e-9, 1e-9, c[:, 2])
        res = ((c[:, :2] / z[:, None] - xy) * focal).ravel()
        jc = np.zeros((len(p), 2, 3))
        jc[:, 0, 0], jc[:, 1, 1] = focal[0] / z, focal[1] / z
        jc[:, 0, 2], jc[:, 1, 2] = -focal[0] * c[:, 0] / z**2, -focal[1] * c[:, 1] / z**2
        cross = np.zeros((len(p), 3, 3))
        cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 2] = q[:, 2], -q[:, 1], q[:, 0]
        cross[:, 1, 0], cross[:, 2, 0], cross[:, 2, 1] = -q[:, 2], q[:, 1], -q[:, 0]
        j = np.concatenate([jc @ cross, jc], axis=2).reshape(-1, 6)
        h, g = j.T @ j, j.T @ res
        try:
            step = -np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-12), g)
        except np.linalg.LinAlgError:
            break
        r2, t2 = _turn(step[:3]) @ r, t + step[3:]
        new = (_errors(r2, t2, p, xy, focal) ** 2).sum()
        if new < now:
            gain, (r, t, now) = now - new, (r2, t2, new)
            damping = max(damping / 10, 1e-12)
            if gain < 1e-12 * max(1.0, now):
                break
        else:
            damping *= 10
            if damping > 1e8:
                break
    return r, t


def solve(uv: np.ndarray, xyz: np.ndarray, camera: np.ndarray, how: Ransac = Ransac(), seed: int = 0) -> dict:
    """Pose of one query. camera: fx fy cx cy k1 k2 p1 p2.

    success, T_wc (16 numbers), num_inliers, num_matches, reproj_error, inliers; fewer than four matches or
    inliers fail with num_inliers 0.
    """
    n = len(uv)
    for px in (how.error_px, *how.retries):
        got = _attempt(uv, xyz, camera, px, how, seed) if n >= 4 else None
        if got is not None:
            return got
    return {"success": False, "T_wc": None, "num_inliers": 0, "num_matches": n, "reproj_error": None, "inliers": []}


def _attempt(uv, xyz, camera, px, how: Ransac, seed: int) -> dict | None:
    n, focal = len(uv), camera[:2]
    xy = undistort((uv - camera[2:4]) / focal, camera[4:8])
    rays = np.concatenate([xy, np.ones((n, 1))], axis=1)
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    rng = np.random.default_rng([how.seed, seed & 0x7FFFFFFF])
    best, best_key, needed, i = None, (-1, 0.0), how.iterations, 0
    while i < min(needed, how.iterations):
        i += 1
        pick = rng.choice(n, 4, replace=False)
        poses = three_point(xyz[pick[:3]], rays[pick[:3]])
        if not poses:
            continue
        r, t = min(poses, key=lambda s: _errors(*s, xyz[pick[3:]], xy[pick[3:]], focal)[0])
        e = _errors(r, t, xyz, xy, focal)
        inside = e <= px
        k = int(inside.sum())
        key = (k, -float(e[inside].mean()) if k else 0.0)
        if key > best_key:
            best, best_key = (r, t, inside), key
            share = k / n
            if share > 0:
                chance = 1 - share**4
                needed = i if chance <= 0 else min(how.iterations, int(np.ceil(np.log(1 - how.confidence) / np.log(max(chance, 1e-12)))))
    if best is None or best_key[0] < 4:
        return None
    r, t, inside = best
    r2, t2 = refine(r, t, xyz[inside], xy[inside], focal)
    e, e2 = _errors(r, t, xyz, xy, focal), _errors(r2, t2, xyz, xy, focal)
    k, k2 = e <= px, e2 <= px
    if k2.sum() > k.sum() or (k2.sum() == k.sum() and e2[k2].mean() < e[k].mean()):
        r, t, e, k = r2, t2, e2, k2
    if k.sum() < 4:
        return None
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = r.T, -r.T @ t
    return {"success": True, "T_wc": pose.ravel().tolist(), "num_inliers": int(k.sum()), "num_matches": n, "reproj_error": float(e[k].mean()), "inliers": np.flatnonzero(k).tolist()}


POSES = "success boolean, T_wc array<double>, num_inliers int, num_matches int, reproj_error double"


def solve_poses(matches: DataFrame, query: str = "query_id", how: Ransac = Ransac(), thresholds: list[float] | None = None) -> DataFrame:
    """A pose per query from its matches: columns query, u, v, x, y, z and camera (fx fy cx cy k1 k2 p1 p2).

    Matches with null or non-finite numbers take no part. thresholds: solve at each of these instead and
    report it as error_px. A query's matches are few (assignment is capped), so they fit one task.
    """
    kind = dict(matches.dtypes)[query]
    values = ["u", "v", "x", "y", "z"]
    fine = None
    for c in values:
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        fine = ok if fine is None else fine & ok
    rows = matches.filter(fine & F.col("camera").isNotNull()).select(query, *[F.col(c).cast("double").alias(c) for c in values], F.col("camera").cast("array<double>").alias("camera"))
    sizes = thresholds or [how.error_px]

    def run(table: pa.Table) -> pa.Table:
        m = np.stack([table.column(c).to_numpy() for c in values], axis=1)
        cam = np.array(table.column("camera")[0].as_py() + [0.0] * 8)[:8]
        q = table.column(query)[0].as_py()
        seed = q if isinstance(q, int) else int.from_bytes(str(q).encode()[-4:], "little")
        got = [solve(m[:, :2], m[:, 2:], cam, Ransac(px, how.iterations, how.confidence, how.seed, how.retries), seed) for px in sizes]
        return pa.table(
            {
                query: pa.array([q] * len(got), table.schema.field(query).type),
                "error_px": pa.array(sizes, pa.float64()),
                "success": pa.array([g["success"] for g in got]),
                "T_wc": pa.array([g["T_wc"] for g in got], pa.list_(pa.float64())),
                "num_inliers": pa.array([g["num_inliers"] for g in got], pa.int32()),
                "num_matches": pa.array([g["num_matches"] for g in got], pa.int32()),
                "reproj_error": pa.array([g["reproj_error"] for g in got], pa.float64()),
            }
        )

    out = by_key(rows, [query], run, f"{query} {kind}, error_px double, {POSES}", values)
    return out if thresholds else out.drop("error_px")
