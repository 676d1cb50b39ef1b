"""Top N items within every group (problem 5).

Secondary sort: rows are hash-partitioned by group and sorted inside the
partitions by (group, score descending, identifier); the sorted rows stream
through as Arrow batches, of which the first N of every group pass. Only the
place in the current group is kept from one batch to the next, so a group of
any size needs no memory. Before the shuffle, chunks of each input partition
keep only what can still be among the first N of their group; so a group with
a third of all rows reaches its partition with at most N rows of each chunk.

Defined results
* null, NaN and infinite scores, null groups, null identifiers and null or non-positive N take no part.
* ties go to the smaller identifier; -0.0 equals 0.0.
* rows equal in group, identifier and score count once.
* groups with fewer than N rows give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.tables import partitions

CHUNK = 1 << 18


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _prune(names: list[str], groups: int, size: int):
    """Keeps, of every chunk, the rows that are among the first N of their group there."""

    def chunk(got: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(got).combine_chunks()
        cols = [rows.column(c).to_numpy() for c in names]
        keys, item, score, most = cols[:groups], cols[groups], cols[groups + 1], cols[groups + 2]
        order = np.lexsort((item, -score, *reversed(keys)))
        keys, item, score, most = [k[order] for k in keys], item[order], score[order], most[order]
        new = _changes(keys)
        fresh = _changes([*keys, item, score])
        run = np.cumsum(fresh)
        place = run - run[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        return rows.take(pa.array(order[fresh & (place < most)])).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for b in batches:
            got.append(b)
            n += b.num_rows
            if n >= size:
                yield from chunk(got)
                got, n = [], 0
        if n:
            yield from chunk(got)

    return run


def _stream(names: list[str], groups: int):
    """Passes the first N rows of every group of a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, -1  # the last row and its place in its group
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            keys, item, score, most = cols[:groups], cols[groups], cols[groups + 1], cols[groups + 2]
            new, fresh = _changes(keys), _changes([*keys, item, score])
            carried = last is not None and all(k[0] == v for k, v in zip(keys, last))
            if carried:
                fresh[0] = item[0] != last[groups] or score[0] != last[groups + 1]
            run_no = np.cumsum(fresh)
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            places = run_no - run_no[start]
            if carried:
                head = start == 0
                places[head] += place + int(fresh[0])
            last, place = [c[-1] for c in cols], int(places[-1])
            keep = fresh & (places < most)
            if keep.any():
                yield b.filter(pa.array(keep))

    return run


def top_n(rows: DataFrame, groups: list[str], item: str, score: str, n: str) -> DataFrame:
    """(groups..., item, score) of the first rows of every group; n names the column with its N.

    groups and item are of integer types. score: double, higher is better.
    """
    number = F.col(score).cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")) & (F.col(n) > 0) & F.col(item).isNotNull()
    for g in groups:
        usable &= F.col(g).isNotNull()
    names = [f"g{i}" for i in range(len(groups))] + ["item", "score", "most"]
    renamed = rows.filter(usable).select(*[F.col(g).cast("bigint").alias(f"g{i}") for i, g in enumerate(groups)], F.col(item).cast("bigint").alias("item"), (number + 0.0).alias("score"), F.col(n).cast("int").alias("most"))
    keys = names[: len(groups)]
    pruned = renamed.mapInArrow(_prune(names, len(groups), CHUNK), renamed.schema)
    ordered = pruned.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, F.desc("score"), "item")
    top = ordered.mapInArrow(_stream(names, len(groups)), renamed.schema)
    kinds = dict(rows.dtypes)
    return top.select(*[F.col(f"g{i}").cast(kinds[g]).alias(g) for i, g in enumerate(groups)], F.col("item").cast(kinds[item]).alias(item), F.col("score").alias(score))


def best_landmarks(matches: DataFrame, configs: DataFrame) -> DataFrame:
    """(query_id, anchor_index, landmark_id, score): the topk_retrieval best of each anchor's configuration."""
    limits = configs.groupBy("config_id").agg(F.max("topk_retrieval").alias("__n"))
    rows = matches.select("query_id", "anchor_index", "landmark_id", "config_id", "score").join(limits, "config_id")
    return top_n(rows, ["query_id", "anchor_index"], "landmark_id", "score", "__n")
