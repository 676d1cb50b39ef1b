"""Vector retrieval, acceptance tests and reranking.

The exact top-k join packs the vectors of both sides into blocks and compares a
block of queries with a block of the memory by one matrix product; each task
keeps k of every query, and a final ranking merges the blocks. The query side
is a stated set of queries. (For very large memories the approximate forest of
the optional subpackage visits only a part of them.) Inside groups, such as the
landmarks of one image, both sides of a group are cut into blocks by its own
sizes: a group with a third of all rows is many pairs of blocks, of each of
which k rows a query come out, and never all its pairs.

Null vectors and vectors of the wrong width take no part; k beyond the memory
gives all of it; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from waymark.functions import vec
from waymark.operators.groups import whole_groups
from waymark.tables import cut

BLOCK = 8192


def _packed(df: DataFrame, id_: str, vector: str, dim: int, blocks: int, side: int) -> DataFrame:
    """(block, side, ids, xs): unit vectors packed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("v").to_pylist(), dtype=np.float64).reshape(-1, dim)
            norms = np.linalg.norm(x, axis=1)
            good = np.isfinite(norms) & (norms > 0)
            ids, x = b.column("id").to_numpy()[good], x[good] / norms[good, None]
            place = ids % blocks
            for k in np.unique(place):
                at = place == k
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(k)], pa.int32()), "side": pa.array([side], pa.int32()), "ids": pa.array([ids[at].tobytes()], pa.binary()), "xs": pa.array([x[at].tobytes()], pa.binary())})

    usable = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull())
    rows = df.filter(F.col(id_).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, "block int, side int, ids binary, xs binary")


def topk_cosine(queries: DataFrame, query_id: str, query_vector: str, memory: DataFrame, memory_id: str, memory_vector: str, k: int, dim: int = 64) -> DataFrame:
    """(query_id, memory_id, cosine, rk) of the k most similar memory vectors of every query.

    Ids must be unique on both sides (see `landmarks.once`).
    """
    n_base = memory.count()
    n_ask = queries.count()
    base_blocks, ask_blocks = max(1, -(-n_base // BLOCK)), max(1, -(-n_ask // BLOCK))
    base = _packed(memory, memory_id, memory_vector, dim, base_blocks, 0).select(F.col("block").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(ask_blocks - 1))).alias("q"), "side", "ids", "xs")
    ask = _packed(queries, query_id, query_vector, dim, ask_blocks, 1).select(F.explode(F.sequence(F.lit(0), F.lit(base_blocks - 1))).alias("b"), F.col("block").alias("q"), "side", "ids", "xs")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        out = []
        if (side == 0).any() and (side == 1).any():
            get = lambda name, s, t: np.frombuffer(b"".join(x for x, y in zip(table.column(name).to_pylist(), side) if y == s), t)
            base_ids, ask_ids = get("ids", 0, np.int64), get("ids", 1, np.int64)
            y, x = get("xs", 0, np.float64).reshape(-1, dim), get("xs", 1, np.float64).reshape(-1, dim)
            order = np.argsort(base_ids, kind="stable")
            base_ids, y = base_ids[order], y[order]
            m = min(k, len(base_ids))
            for a in range(0, len(ask_ids), 512):
                sims = np.round(x[a : a + 512] @ y.T, 12)
                if m < sims.shape[1]:
                    floor = -np.partition(-sims, m - 1, axis=1)[:, m - 1 : m]
                    r, c = np.nonzero(sims >= floor)
                else:
                    r, c = (z.ravel() for z in np.indices(sims.shape))
                out.append((ask_ids[a + r], base_ids[c], sims[r, c]))
        cols = [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"qid": pa.array(cols[0]), "mid": pa.array(cols[1]), "cosine": pa.array(cols[2])})

    parts = base.unionByName(ask).groupBy("b", "q").applyInArrow(run, "qid bigint, mid bigint, cosine double")
    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "mid")
    return parts.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select(F.col("qid").alias(query_id), F.col("mid").alias(memory_id), "cosine", "rk")


ASKED, STORED = 65536, 65536  # rows of a block on either side, inside groups: what is copied is rows of one side times blocks of the other
ROWS, COLUMNS = 512, 4096  # pairs that are compared at once
DOUBT = 1e-5  # more than twice what single precision can be off in a cosine of 64 numbers, and the rounding to nine decimals


def _best(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine rounded to nine decimals): the k best of y for every x, ties to the earlier row. Rows are unit vectors.

    Cosines in single precision leave out what can't be among the k best; the rest is computed in double precision.
    """
    k, doubt = min(k, len(y)), DOUBT * max(1, x.shape[1] / 64)
    width, keep, out = max(COLUMNS, k), np.arange(len(y)), []
    if len(y) > width:  # of equal vectors only the first k can be among the best
        same = np.unique(np.ascontiguousarray(y).view(f"V{y.itemsize * y.shape[1]}").ravel(), return_inverse=True)[1].ravel()
        order, many = np.argsort(same, kind="stable"), np.bincount(same)
        keep = np.sort(order[np.arange(len(y)) - np.repeat(np.cumsum(many) - many, many) < k])
        y = y[keep]
    y32 = y.astype(np.float32)
    for a in range(0, len(x), ROWS):
        part = x[a : a + ROWS]
        x32, n = part.astype(np.float32), len(part)
        best, at = np.zeros((n, 0)), np.zeros((n, 0), np.int64)
        for b in range(0, len(y), width):
            sims = x32 @ y32[b : b + width].T
            floor = best[:, -1:] if b else -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero(sims >= floor - doubt)
            if not len(r):
                continue
            c += b
            exact = [np.round(np.einsum("ij,ij->i", part[r[i : i + 65536]], y[c[i : i + 65536]]), 9) for i in range(0, len(r), 65536)]
            rows, values, places = (np.concatenate(z) for z in ((np.repeat(np.arange(n), best.shape[1]), r), (best.ravel(), *exact), (at.ravel(), c)))
            order = np.lexsort((places, -values, rows))
            many = np.bincount(rows, minlength=n)
            first = order[((np.cumsum(many) - many)[:, None] + np.arange(k)).ravel()]
            best, at = values[first].reshape(n, k), places[first].reshape(n, k)
        out.append((np.repeat(np.arange(a, a + n), k), keep[at.ravel()], best.ravel()))
    return tuple(np.concatenate(z) for z in zip(*out))


def topk_cosine_within(queries: DataFrame, query_id: str, query_vector: str, memory: DataFrame, memory_id: str, memory_vector: str, members: DataFrame, group: str, k: int, dim: int = 64) -> DataFrame:
    """(query_id, memory_id, cosine, rk): the k most similar of those memory vectors that are members of the query's group.

    queries have `group`; members: (group, memory_id). Ids are unique on their sides; repeated members count once.
    Cosines are rounded to nine decimals before they are ranked; ties go to the smaller id.
    """
    usable = lambda c: F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))
    floats = all(df.schema[c].dataType == ArrayType(FloatType()) for df, c in ((queries, query_vector), (memory, memory_vector)))
    numbers = lambda c: F.col(c).cast("array<float>" if floats else "array<double>").alias("x")
    ask = queries.filter(F.col(query_id).isNotNull() & F.col(group).isNotNull() & usable(query_vector)).select(F.col(group).alias("g"), F.col(query_id).cast("bigint").alias("id"), numbers(query_vector))
    named = members.filter(F.col(group).isNotNull() & F.col(memory_id).isNotNull()).select(F.col(group).alias("g"), F.col(memory_id).cast("bigint").alias("id")).distinct()
    sizes = ask.groupBy("g").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("na")).join(named.groupBy("g").agg(F.ceil(F.count("*") / STORED).cast("int").alias("nb")), "g")
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = ask.join(sizes, "g").select("g", spread("na").alias("a"), every("nb").alias("b"), F.lit(1).alias("side"), "id", "x")
    # Only members of groups that are asked get their vectors.
    wide = named.join(sizes, "g").join(memory.filter(usable(memory_vector)).select(F.col(memory_id).cast("bigint").alias("id"), numbers(memory_vector)), "id")
    right = wide.select("g", every("na").alias("a"), spread("nb").alias("b"), F.lit(0).alias("side"), "id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in whole_groups(batches, ["g", "a", "b"]):
            out = []
            for table in groups:
                side = table.column("side").to_numpy()
                if side[0] == side[-1]:
                    continue
                x = table.column("x").combine_chunks()
                x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                norms = np.linalg.norm(x, axis=1)
                good = np.isfinite(norms) & (norms > 0)
                ids, side, x = table.column("id").to_numpy()[good], side[good], x[good] / norms[good, None]
                mids, qids, y, x = ids[side == 0], ids[side == 1], x[side == 0], x[side == 1]
                if not len(mids) or not len(qids):
                    continue
                order = np.argsort(mids)
                r, c, sims = _best(x, y[order], k)
                out.append((qids[r], mids[order[c]], sims))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["qid", "mid", "cosine"])

    parts = left.unionByName(right).repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "side").mapInArrow(run, "qid bigint, mid bigint, cosine double")
    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "mid")
    return parts.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select(F.col("qid").alias(query_id), F.col("mid").alias(memory_id), "cosine", "rk")


def topk_within(pairs: DataFrame, group: list[str], similarity: Column, item: str, k: int) -> DataFrame:
    """Top k of candidates that are already joined, by built-in expressions only."""
    w = Window.partitionBy(*group).orderBy(F.desc("cosine"), item)
    return pairs.withColumn("cosine", similarity).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def mutual_nearest(a: DataFrame, a_id: str, a_vector: str, b: DataFrame, b_id: str, b_vector: str, least: float, dim: int = 64) -> DataFrame:
    """Pairs that are each other's most similar vector, with at least this cosine."""
    forth = topk_cosine(a, a_id, a_vector, b, b_id, b_vector, 1, dim).drop("rk")
    back = topk_cosine(b, b_id, b_vector, a, a_id, a_vector, 1, dim).drop("rk", "cosine")
    return forth.join(back, [a_id, b_id]).filter(F.col("cosine") >= least)


def adaptive_cosine(rows: DataFrame, anchor: list[str], cosine: str, least: float, margin: float) -> DataFrame:
    """Rows whose cosine is at least max(least, best of the anchor - margin)."""
    best = F.max(cosine).over(Window.partitionBy(*anchor))
    return rows.withColumn("floor", F.greatest(F.lit(least), best - margin)).filter(F.col(cosine) >= F.col("floor"))


def accepted(rows: DataFrame, anchor: list[str], score: str, item: str, least: float | Column = -1e9, margin: float | Column = 0.0, cosine: str | None = None, least_cosine: float | Column = -1.0) -> DataFrame:
    """The best row of every anchor if it passes: score and cosine high enough, ahead of the second by the margin.

    An anchor with a single row has no second and passes the margin test. Null and NaN scores don't compete.
    """
    w = Window.partitionBy(*anchor).orderBy(F.desc(score), item)
    ranked = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumns({"rk": F.row_number().over(w), "second": F.lead(score).over(w)})
    ahead = F.col("second").isNull() | (F.col(score) - F.col("second") >= margin)
    best = ranked.filter((F.col("rk") == 1) & (F.col(score) >= least) & ahead)
    return (best if cosine is None else best.filter(F.col(cosine) >= least_cosine)).drop("rk")


def best_per_item(rows: DataFrame, query: list[str], item: str, score: str, anchor: str) -> DataFrame:
    """The best anchor of every item of a query."""
    w = Window.partitionBy(*query, item).orderBy(F.desc(score), anchor)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def materialize_cap(rows: DataFrame, query: list[str], anchor: str, item: str, cosine: str, per_anchor: int, least: float, most: int) -> DataFrame:
    """(query..., item, n_hits, best): the items worth loading in full.

    Of each anchor's first per_anchor rows those of at least this cosine, or all of them if none is; of their
    items the `most` hit most often, then by best cosine, then by id.
    """
    w = Window.partitionBy(*query, anchor).orderBy(F.desc(cosine), item)
    first = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_anchor)
    none = F.max(cosine).over(Window.partitionBy(*query, anchor)) < least
    short = first.withColumn("__none", none).filter(F.col("__none") | (F.col(cosine) >= least))
    hits = short.groupBy(*query, item).agg(F.count("*").alias("n_hits"), F.max(cosine).alias("best"))
    rank = Window.partitionBy(*query).orderBy(F.desc("n_hits"), F.desc("best"), item)
    return hits.withColumn("__r", F.row_number().over(rank)).filter(F.col("__r") <= most).drop("__r")


def fuse(rows: DataFrame, anchor: list[str], coarse: str, fine: str, item: str, weight: float) -> DataFrame:
    """Rows ranked again by (1 - weight) * coarse + weight * fine; without a fine value the coarse one stands."""
    fused = F.coalesce((1 - weight) * F.col(coarse) + weight * F.col(fine), F.col(coarse))
    w = Window.partitionBy(*anchor).orderBy(F.desc("fused"), item)
    return rows.withColumn("fused", fused).withColumn("rk", F.row_number().over(w))


def fine_rerank(rows: DataFrame, anchor: list[str], coarse: str, item: str, anchor_desc: str, stored: str, topk: int, aux: Column, n_obs: Column, weight: float = 1.0, support: float = 0.0, require: bool = False) -> DataFrame:
    """The first topk rows of each anchor scored by their best stored fine descriptor.

    Rows without a fine descriptor keep the coarse score, or leave if one is required.
    """
    w = Window.partitionBy(*anchor).orderBy(F.desc(coarse), item)
    short = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= topk)
    best = vec.best_dot(F.col(anchor_desc), F.col(stored))
    scored = short.withColumn("fine", best).withColumn("final", F.coalesce(weight * F.col("fine") + aux + support * F.log1p(F.greatest(n_obs, F.lit(0))), F.col(coarse)))
    return (scored.filter("fine is not null") if require else scored).drop("__r")


def late_join(scored: DataFrame, shortlist: DataFrame, wide: DataFrame, item: str) -> DataFrame:
    """Late materialization: the wide columns are read only for items of the shortlist."""
    return scored.join(wide.join(shortlist.select(item).distinct(), item, "left_semi"), item)


__all__ = ["topk_cosine", "topk_cosine_within", "topk_within", "mutual_nearest", "adaptive_cosine", "accepted", "best_per_item", "materialize_cap", "fuse", "fine_rerank", "late_join", "cut"]
