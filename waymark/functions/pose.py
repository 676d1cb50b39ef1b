"""Poses and cameras as columns.

A pose is an array<double> of 16, row-major, camera to world unless said
otherwise; a point is array<double> of 3. All functions give null for null
arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import vec

FAR_OFF = 1e9  # reprojection error of a point behind the camera
IMAGE_EDGE = 60.0  # pixels at which the geometry gate closes


def _arr(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def rotation(t: Column, i: int, j: int) -> Column:
    return t[4 * i + j]


def camera_matrix(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """K, row-major 3x3."""
    return _arr(fx, 0, cx, 0, fy, cy, 0, 0, 1)


def _rows(t: Column) -> list[list[Column]]:
    return [[t[4 * i + j] for j in range(4)] for i in range(3)]


def _inverse(m: list[list[Column]]) -> list[list[Column]]:
    """[R', -R't], element by element, so that no array is built in between."""
    out = []
    for i in range(3):
        r = [m[k][i] for k in range(3)]
        out.append([*r, -(r[0] * m[0][3] + r[1] * m[1][3] + r[2] * m[2][3])])
    return out


def _product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    cell = lambda i, j: a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j]
    return [[cell(i, j) + a[i][3] if j == 3 else cell(i, j) for j in range(4)] for i in range(3)]


def _moved(m: list[list[Column]], p: Column) -> list[Column]:
    return [m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + m[i][3] for i in range(3)]


def _packed(m: list[list[Column]]) -> Column:
    return _arr(*[x for row in m for x in row], 0, 0, 0, 1)


def invert(t: Column) -> Column:
    """Inverse of a rigid transform."""
    return F.when(t.isNotNull(), _packed(_inverse(_rows(t))))


def compose(a: Column, b: Column) -> Column:
    """a @ b for rigid transforms."""
    return F.when(a.isNotNull() & b.isNotNull(), _packed(_product(_rows(a), _rows(b))))


def relative(a: Column, b: Column) -> Column:
    """Motion from pose a to pose b: inverse of a, times b."""
    return F.when(a.isNotNull() & b.isNotNull(), _packed(_product(_inverse(_rows(a)), _rows(b))))


def apply(t: Column, p: Column) -> Column:
    """Transformed point."""
    return F.when(t.isNotNull() & p.isNotNull(), F.array(*_moved(_rows(t), p)))


def centre(t: Column) -> Column:
    return _arr(t[3], t[7], t[11])


def backproject(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return _arr((u - cx) / fx * z, (v - cy) / fy * z, z)


def project(t: Column, p: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel and depth (u, v, z) of a world point; u and v are NaN unless z > 1e-6. t: camera to world."""
    x, y, z = _moved(_inverse(_rows(t)), p)
    seen, nan = z > 1e-6, F.lit(float("nan"))
    return F.when(t.isNotNull() & p.isNotNull(), F.struct(F.when(seen, fx * x / z + cx).otherwise(nan).alias("u"), F.when(seen, fy * y / z + cy).otherwise(nan).alias("v"), z.alias("z")))


def reprojection_error(pixel: Column, u: Column, v: Column) -> Column:
    """Distance in pixels; 1e9 where the projection isn't finite."""
    d = F.sqrt((pixel["u"] - u) * (pixel["u"] - u) + (pixel["v"] - v) * (pixel["v"] - v))
    return F.when(F.isnan(d) | (d == float("inf")), F.lit(FAR_OFF)).otherwise(d)


def rotation_error(a: Column, b: Column) -> Column:
    """Angle between two rotations in degrees."""
    trace = sum((a[4 * i + j] * b[4 * i + j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def translation_error(a: Column, b: Column) -> Column:
    return vec.distance(centre(a), centre(b))


def to_quaternion(t: Column) -> Column:
    """(w, x, y, z) of the rotation, by the half roots of the diagonal and the signs of the differences."""
    m = [[t[4 * i + j] for j in range(3)] for i in range(3)]
    half = lambda x: F.sqrt(F.greatest(F.lit(0.0), x)) / 2
    signed = lambda x, s: F.when(s < 0, -x).otherwise(x)
    return _arr(
        half(1 + m[0][0] + m[1][1] + m[2][2]),
        signed(half(1 + m[0][0] - m[1][1] - m[2][2]), m[2][1] - m[1][2]),
        signed(half(1 - m[0][0] + m[1][1] - m[2][2]), m[0][2] - m[2][0]),
        signed(half(1 - m[0][0] - m[1][1] + m[2][2]), m[1][0] - m[0][1]),
    )


def _turned(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    return [
        [1 - 2 * y * y - 2 * z * z, 2 * x * y - 2 * w * z, 2 * z * x + 2 * w * y],
        [2 * x * y + 2 * w * z, 1 - 2 * x * x - 2 * z * z, 2 * y * z - 2 * w * x],
        [2 * z * x - 2 * w * y, 2 * y * z + 2 * w * x, 1 - 2 * x * x - 2 * y * y],
    ]


def from_quaternion(w: Column, x: Column, y: Column, z: Column, tx, ty, tz) -> Column:
    """Rigid transform of a quaternion, taken as it is (not normalised), and a translation."""
    return _packed([[*r, t] for r, t in zip(_turned(w, x, y, z), (tx, ty, tz))])


def image_pose(qvec: Column, tvec: Column) -> Column:
    """Camera-to-world pose of a registered image (world to camera: qvec w x y z, tvec)."""
    w, x, y, z = (qvec[i] for i in range(4))
    turn = _turned(w, x, y, z)
    return F.when(qvec.isNotNull() & tvec.isNotNull(), _packed(_inverse([[*turn[i], tvec[i]] for i in range(3)])))


# Which models have one focal length and which have two.
ONE_FOCAL = ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL", "RADIAL_FISHEYE", "FOV")
TWO_FOCAL = ("PINHOLE", "OPENCV", "OPENCV_FISHEYE", "FULL_OPENCV", "THIN_PRISM_FISHEYE")


def intrinsics(model: Column, params: Column, strict: bool = False) -> Column:
    """(fx, fy, cx, cy) of a camera; an unknown model gives null, or fails the query if strict."""
    pick = lambda *i: F.struct(*[F.get(params, F.lit(k)).alias(n) for k, n in zip(i, ("fx", "fy", "cx", "cy"))])
    known = F.when(model.isin(*ONE_FOCAL), pick(0, 0, 1, 2)).when(model.isin(*TWO_FOCAL), pick(0, 1, 2, 3))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown camera model: "), model))) if strict else known


def distortion(model: Column, params: Column) -> Column:
    """(k1, k2, p1, p2); zeros for models whose distortion isn't used."""
    p = lambda k: F.coalesce(F.get(params, F.lit(k)), F.lit(0.0))
    zero = F.lit(0.0)
    pack = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("k1", "k2", "p1", "p2"))])
    return F.when(model == "SIMPLE_RADIAL", pack(p(3), zero, zero, zero)).when(model == "RADIAL", pack(p(3), p(4), zero, zero)).when(model.isin("OPENCV", "FULL_OPENCV"), pack(p(4), p(5), p(6), p(7))).otherwise(pack(zero, zero, zero, zero))


def view_direction(from_point: Column, camera_centre: Column) -> Column:
    """Unit vector from a point to a camera; zeros if they coincide."""
    d = F.transform(F.zip_with(vec.doubles(camera_centre), vec.doubles(from_point), lambda a, b: a - b), lambda x: x)
    return vec.normalize_or_zero(d)


def angle_between(a: Column, b: Column) -> Column:
    """Degrees between two directions; 0 if either is degenerate."""
    n = vec.norm(a) * vec.norm(b)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.dot(a, b) / n))
    return F.when((vec.norm(a) <= vec.EPS) | (vec.norm(b) <= vec.EPS), 0.0).otherwise(F.degrees(F.acos(cos)))


def least_angle(d: Column, others: Column) -> Column:
    """Smallest angle to a set of directions; 180 for an empty set."""
    return F.coalesce(F.array_min(F.transform(others, lambda o: angle_between(d, o))), F.lit(180.0))


def valid_depth(z: Column) -> Column:
    """Finite and greater than 1e-4; False for null."""
    return F.coalesce((z > 1e-4) & ~F.isnan(z) & (z < float("inf")), F.lit(False))


def projection_matrix(t: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """K [R | t] of a camera-to-world pose, row-major 3x4."""
    m = _inverse(_rows(t))
    line = lambda f, c, i: [f * a + c * b for a, b in zip(m[i], m[2])]
    return F.array(*line(fx, cx, 0), *line(fy, cy, 1), *m[2])


def triangulated(rows: DataFrame, key: str) -> DataFrame:
    """(key, xyz): points of two pixels (x1, x2) seen by two projection matrices (p1, p2), a batch of rows at a time."""
    import numpy as np
    import pyarrow as pa

    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            p = np.stack([np.array(b.column(c).to_pylist(), dtype=np.float64).reshape(-1, 3, 4) for c in ("p1", "p2")])
            x = np.stack([np.array(b.column(c).to_pylist(), dtype=np.float64).reshape(-1, 2) for c in ("x1", "x2")])
            lines = [x[i, :, k, None] * p[i, :, 2] - p[i, :, k] for i in (0, 1) for k in (0, 1)]
            h = np.linalg.svd(np.stack(lines, axis=1))[2][:, -1]
            yield pa.RecordBatch.from_pydict({key: b.column(key), "xyz": pa.array(list(h[:, :3] / h[:, 3:]), pa.list_(pa.float64()))})

    return rows.select(key, "p1", "p2", "x1", "x2").mapInArrow(run, f"{key} {kind}, xyz array<double>")


def triangulate(p1, p2, x1, x2):
    """World point of two pixels seen by two 3x4 projection matrices (numpy): the direct linear solution."""
    import numpy as np

    rows = [x[k] * p[2] - p[k] for p, x in ((np.asarray(p1), x1), (np.asarray(p2), x2)) for k in (0, 1)]
    h = np.linalg.svd(np.stack(rows))[2][-1]
    return h[:3] / h[3]
