"""Python work on whole groups, many of them in one call.

Rows are hash-partitioned by key and sorted inside the partitions; sorted batches
stream past, and what belongs to the last key of a batch waits for the next one.
So a task holds a batch and one group, and starts nothing for each key. A null
key is a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of every run of equal keys."""
    new = np.zeros(rows.num_rows - 1, bool)
    for k in keys:
        a, b = rows.column(k).slice(1), rows.column(k).slice(0, rows.num_rows - 1)
        differ = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= differ.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """Lists of tables, each of which has all rows of one key; batches are sorted by the keys."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if waiting:
            ends = pa.Table.from_batches([waiting[-1].slice(waiting[-1].num_rows - 1), b.slice(0, 1)])
            inner = pa.Table.from_batches([b])
            if len(_starts(ends, keys)) == 1 and len(_starts(inner, keys)) == 1:
                waiting.append(b)  # still the same key
                continue
        rows = pa.Table.from_batches([*waiting, b]).combine_chunks()
        starts = _starts(rows, keys)
        yield [rows.slice(a, z - a) for a, z in zip(starts[:-1], starts[1:])]
        waiting = rows.slice(starts[-1]).to_batches()
    if waiting:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        starts = np.append(_starts(rows, keys), rows.num_rows)
        yield [rows.slice(a, z - a) for a, z in zip(starts[:-1], starts[1:])]


def by_key(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], ddl, order: list[str] = ()) -> DataFrame:
    """`run` of each key's rows, which come in the given order; ddl: the result's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in whole_groups(batches, keys):
            if groups:
                done = pa.concat_tables([run(g).select(schema.names).cast(schema) for g in groups])
                yield from done.combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(scan, ddl)
