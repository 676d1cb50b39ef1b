"""Tokens of images: scores, anchor selection, sampling, a built-in extractor.

Tokens are rows (image, r, c, x, y, desc). Scores are window and join
expressions; selection is a greedy pass over one image's tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import vec
from waymark.operators.groups import by_key


def scaled(value: Column, image: str) -> Column:
    """Min-max scaling within an image, with 1e-8 in the divisor."""
    w = Window.partitionBy(image)
    low = F.min(value).over(w)
    return (value - low) / (F.max(value).over(w) - low + 1e-8)


def distinctiveness(tokens: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, r, c, distinct): 1 - mean cosine to the neighbours inside the grid, scaled within the image."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]))
    near = tokens.select(image, "r", "c", "desc", steps.alias("s")).select(image, "r", "c", "desc", (F.col("r") + F.col("s.dr")).alias("r2"), (F.col("c") + F.col("s.dc")).alias("c2"))
    other = tokens.select(F.col(image), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("desc").alias("d2"))
    mean = near.join(other, [image, "r2", "c2"]).groupBy(image, "r", "c").agg((1 - F.avg(vec.dot(F.col("desc"), F.col("d2")))).alias("raw"))
    return mean.withColumn("distinct", scaled(F.col("raw"), image)).drop("raw")


def stability(base: DataFrame, changed: list[DataFrame], image: str = "image_id") -> DataFrame:
    """(image, r, c, stable): mean cosine of each token with its changed versions, scaled within the image."""
    out = base.select(image, "r", "c", "desc")
    total = F.lit(0.0)
    for i, d in enumerate(changed):
        out = out.join(d.select(image, "r", "c", F.col("desc").alias(f"d{i}")), [image, "r", "c"])
        total = total + vec.dot(F.col("desc"), F.col(f"d{i}"))
    return out.withColumn("stable", scaled(total / max(1, len(changed)), image)).select(image, "r", "c", "stable")


def token_scores(distinct: DataFrame, stable: DataFrame | None, alpha: float = 0.6, beta: float = 0.4, image: str = "image_id") -> DataFrame:
    """(image, r, c, score): weighted sum, scaled again; stability is 1 where it isn't used."""
    rows = distinct.withColumn("stable", F.lit(1.0)) if stable is None else distinct.join(stable, [image, "r", "c"])
    return rows.withColumn("score", scaled(alpha * F.col("distinct") + beta * F.col("stable"), image)).select(image, "r", "c", "score")


def select_cells(r: np.ndarray, c: np.ndarray, score: np.ndarray, topk: int, cells: tuple[int, int], radius: int) -> list[int]:
    """Token numbers by grid quota and suppression, best first.

    Each cell may keep topk // cells tokens (one more in the first cells of the remainder), the last cells
    take the rows and columns left over; a token is passed over if its neighbourhood holds a taken place,
    and takes its whole neighbourhood if it is kept.
    """
    height, width = int(r.max()) + 1, int(c.max()) + 1
    ch, cw = max(1, height // cells[0]), max(1, width // cells[1])
    cell = np.minimum(r // ch, cells[0] - 1) * cells[1] + np.minimum(c // cw, cells[1] - 1)
    n_cells = cells[0] * cells[1]
    quota = np.full(n_cells, topk // n_cells) + (np.arange(n_cells) < topk % n_cells)
    place = r * width + c
    taken, kept = np.zeros((height, width), bool), []
    for k in range(n_cells):
        own = np.flatnonzero(cell == k)
        own = own[np.lexsort((place[own], -score[own]))]
        left = int(quota[k])
        for i in own:
            if left == 0:
                break
            box = (slice(max(0, r[i] - radius), r[i] + radius + 1), slice(max(0, c[i] - radius), c[i] + radius + 1))
            if not taken[box].any():
                taken[box] = True
                kept.append(int(i))
                left -= 1
    kept.sort(key=lambda i: (-score[i], place[i]))
    return kept[:topk]


def select_anchors(tokens: DataFrame, topk: int = 200, cells: tuple[int, int] = (4, 4), radius: int = 1, image: str = "image_id") -> DataFrame:
    """(image, anchor_idx, r, c, score, cell): anchors of each image. One image's token grid fits a task."""
    kind = dict(tokens.dtypes)[image]

    def run(table: pa.Table) -> pa.Table:
        r, c, s = (table.column(x).to_numpy() for x in ("r", "c", "score"))
        keep = select_cells(r.astype(int), c.astype(int), s.astype(float), topk, cells, radius)
        got = table.take(pa.array(keep, pa.int64()))
        return got.append_column("anchor_idx", pa.array(range(len(keep)), pa.int32())).select([image, "anchor_idx", "r", "c", "score"])

    return tokens.select(image, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("score").cast("double").alias("score")).transform(by_key, [image], run, f"{image} {kind}, anchor_idx int, r int, c int, score double")


def bilinear(points: DataFrame, tokens: DataFrame, grid: tuple[int, int], image: str = "image_id", keep: list[str] | None = None) -> DataFrame:
    """Descriptor of a place (gr, gc in grid units) from the four tokens around it, normalised.

    Places outside are clamped to the grid. A four-corner join and a weighted sum.
    """
    keep = keep or ["point_id"]
    h, w = grid
    clamp = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), c.cast("double")))
    at = points.select(image, *keep, clamp(F.col("gr"), h).alias("gr"), clamp(F.col("gc"), w).alias("gc"))
    r0, c0 = F.floor("gr"), F.floor("gc")
    fr, fc = F.col("gr") - r0, F.col("gc") - c0
    corner = lambda a, b, wt: F.struct(F.least(r0 + a, F.lit(h - 1)).cast("int").alias("r"), F.least(c0 + b, F.lit(w - 1)).cast("int").alias("c"), wt.alias("w"))
    four = at.withColumn("k", F.explode(F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc))))
    joined = four.select(image, *keep, "k.r", "k.c", "k.w").join(tokens.select(image, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "desc"), [image, "r", "c"])
    parts = joined.select(image, *keep, "w", F.posexplode(vec.doubles(F.col("desc"))).alias("i", "x")).groupBy(image, *keep, "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    arrays = parts.groupBy(image, *keep).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return arrays.select(image, *keep, vec.normalize(F.col("m")).alias("desc"))


def sample_depth(depth: np.ndarray, u: float, v: float) -> float:
    """Depth at the pixel nearest to (u, v), halves to the even one; 0 outside."""
    c, r = round(float(u)), round(float(v))
    return float(depth[r, c]) if 0 <= r < depth.shape[0] and 0 <= c < depth.shape[1] else 0.0


# --- extraction --------------------------------------------------------------


def _resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * image.shape[0] / h - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * image.shape[1] / w - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def filtered(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of each channel with a kernel, mirrored at the border without repeating the edge."""
    kh, kw = kernel.shape
    pad = np.pad(image, ((kh // 2, kh // 2), (kw // 2, kw // 2), (0, 0)), mode="reflect")
    out = np.zeros(image.shape)
    for i in range(kh):
        for j in range(kw):
            out += kernel[i, j] * pad[i : i + image.shape[0], j : j + image.shape[1]]
    return out


def gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return np.outer(x, x) / x.sum() ** 2


def perturb(image: np.ndarray) -> list[np.ndarray]:
    """The two changed versions used for stability: gamma 1.15, and a 5x5 blur of sigma 0.8 (fixed values). Image: 8-bit."""
    table = np.clip(np.round((np.arange(256) / 255.0) ** 1.15 * 255), 0, 255).astype(np.uint8)
    blurred = np.clip(np.round(filtered(image.astype(float), gaussian(5, 0.8))), 0, 255).astype(np.uint8)
    return [table[image], blurred]


# The 3 x 3 blur, the gradient kernel and the grey weights (of 2^14) of common image libraries.
BLUR = np.outer([0.25, 0.5, 0.25], [0.25, 0.5, 0.25])
SOBEL = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])
GREY = np.array([4899, 9617, 1868])


def gradient_tokens(image: np.ndarray, grid: tuple[int, int] = (24, 24), dim: int = 128, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors (h, w, dim) and centres (h, w, 2) of a simple extractor for tests.

    Colour, blurred colour, grey value (of bytes) and its two gradients of the image shrunk to the grid, through a
    fixed random projection whose columns have length 1.
    """
    h, w = grid
    small = _resize(image.astype(np.float64) / 255.0, h, w)
    blurred = filtered(small, BLUR)
    grey = ((((small * 255.0).astype(np.uint8).astype(np.int64) @ GREY) + (1 << 13)) >> 14)[..., None] / 255.0
    features = np.concatenate([small, blurred, grey, filtered(grey, SOBEL), filtered(grey, SOBEL.T)], axis=2)
    projection = np.random.default_rng(seed).standard_normal((features.shape[2], dim), dtype=np.float32)
    out = features @ (projection / (np.linalg.norm(projection, axis=0, keepdims=True) + 1e-8))
    out /= np.linalg.norm(out, axis=2, keepdims=True) + 1e-8
    xs, ys = np.linspace(0, image.shape[1] - 1, w), np.linspace(0, image.shape[0] - 1, h)
    return out.astype(np.float32), np.stack(np.meshgrid(xs, ys), axis=2).astype(np.float32)


Extractor = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
EXTRACTORS: dict[str, Extractor] = {"gradient": gradient_tokens}


def register_extractor(name: str, extract: Extractor) -> None:
    """Add an extractor: image (h, w, 3) of bytes -> descriptors (r, c, dim) and centres (r, c, 2)."""
    EXTRACTORS[name] = extract


def extract_tokens(images: DataFrame, extractor: str | Extractor = "gradient", perturbation: int | None = None) -> DataFrame:
    """(image_id, r, c, x, y, desc) of decoded images (image_id, height, width, data: RGB bytes)."""
    extract = EXTRACTORS[extractor] if isinstance(extractor, str) else extractor

    def run(batches):
        for b in batches:
            for name, h, w, data in zip(*(b.column(c).to_pylist() for c in ("image_id", "height", "width", "data"))):
                image = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                desc, xy = extract(image if perturbation is None else perturb(image)[perturbation])
                r, c = (z.ravel() for z in np.indices(desc.shape[:2]))
                n = len(r)
                yield pa.RecordBatch.from_pydict(
                    {
                        "image_id": pa.array([name] * n, pa.string()),
                        "r": pa.array(r.astype(np.int32)),
                        "c": pa.array(c.astype(np.int32)),
                        "x": pa.array(xy[..., 0].ravel().astype(np.float32)),
                        "y": pa.array(xy[..., 1].ravel().astype(np.float32)),
                        "desc": pa.array(list(desc.reshape(n, -1)), pa.list_(pa.float32())),
                    }
                )

    return images.select("image_id", "height", "width", "data").mapInArrow(run, "image_id string, r int, c int, x float, y float, desc array<float>")
