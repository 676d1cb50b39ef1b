"""Matching records by nearest time (problem 2).

Both tables become one stream of events that is range-partitioned by (entity,
time) and sorted, so an entity larger than a task simply spans several
partitions. A local scan streams over the partition and finds, for each left
record and each kind of right record, the right record before and the one after
it; it keeps only the rows within the largest tolerance of the end of what it has
read, so neither a partition nor an entity has to fit into memory. What a
partition can't know are the right records beyond its edges: it reports the
last and first right record of the entities at its two edges, a parallel prefix
scan over these few rows (at most two entities for each partition and kind)
carries them across partitions in both directions, and the carried records join
the local ones. The scan's merge is a maximum (minimum) of (time, id), which is
associative, so equal times split by a partition edge still give the smaller id.

Defined results
* left records without entity or time, and unusable right records, take no part.
* equal distance: the earlier record, then the smaller id; the tolerance is inclusive.
* repeated deliveries of a left record come out once; those of a right record are one candidate.
* empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.tables import cut, micros, partitions

_LOCAL = "edge boolean, part int, entity bigint, kind int, left_id string, at bigint, before_at bigint, before_id bigint, after_at bigint, after_id bigint"


class _Edges:
    """Per kind the first and the last right record of a partition's first and last entity: [first at, id, last at, id]."""

    def __init__(self, kinds: int):
        self.kinds, self.entities, self.found = kinds, [], {}

    def see(self, entity: np.ndarray, at: np.ndarray, kind: np.ndarray, rid: np.ndarray) -> None:
        for e in dict.fromkeys((self.entities or [int(entity[0])])[:1] + [int(entity[-1])]):
            if e not in self.entities:
                self.entities = self.entities[:1] + [e]  # entities between the first and the last one have no edge
                self.found = {k: v for k, v in self.found.items() if k[0] in self.entities}
            for k in range(1, self.kinds + 1):
                here = np.flatnonzero((kind == k) & (entity == e))
                if not len(here):
                    continue
                old = self.found.get((e, k))
                last = int(at[here[-1]])
                start = here[np.searchsorted(at[here], last)]
                if old is None:
                    self.found[e, k] = [int(at[here[0]]), int(rid[here[0]]), last, int(rid[start])]
                elif last != old[2]:
                    old[2:] = [last, int(rid[start])]

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        for k in range(1, self.kinds + 1):
            ends = np.array(self.entities, np.int64)
            has = np.array([(e, k) in self.found for e in self.entities], bool)
            got = np.array([self.found.get((e, k), [0] * 4) for e in self.entities], np.int64)
            yield _rows(len(ends), True, part, ends, k, pa.nulls(len(ends), pa.string()), ends, got[:, 2], got[:, 3], has, got[:, 0], got[:, 1], has)


def _local_scan(kinds: int, reach: int):
    """Streams over a sorted partition; kept from batch to batch are the rows within `reach` of the end and a record of each kind."""

    def settle(rows: pa.Table, final: bool, part: int) -> tuple[list[pa.RecordBatch], pa.Table]:
        entity, at, kind, rid = (rows.column(c).to_numpy() for c in ("entity", "at", "kind", "rid"))
        n = len(entity)
        here = np.arange(n)
        open_ = n if final else int(np.argmax((entity == entity[-1]) & (at >= at[-1] - reach)))  # from here on, records may still come
        left = np.flatnonzero(kind[:open_] == 0)
        names = rows.column("left_id").combine_chunks()
        if len(left) > 1:
            texts = names.take(pa.array(left)).to_numpy(zero_copy_only=False)
            copied = (texts[1:] == texts[:-1]) & (entity[left[1:]] == entity[left[:-1]]) & (at[left[1:]] == at[left[:-1]])
            left = left[np.concatenate([[True], ~copied])]
        out, kept = [], []
        for k in range(1, kinds + 1):
            is_k = kind == k
            mine = np.flatnonzero(is_k)
            fresh = np.ones(len(mine), bool)  # the first of the records of its time
            fresh[1:] = (entity[mine[1:]] != entity[mine[:-1]]) | (at[mine[1:]] != at[mine[:-1]])
            run_start = np.full(n, -1)
            run_start[mine[fresh]] = mine[fresh]
            run_start = np.maximum.accumulate(run_start)
            last = np.maximum.accumulate(np.where(is_k, here, -1))
            nxt = np.minimum.accumulate(np.where(is_k, here, n)[::-1])[::-1]
            b, a = last[left], nxt[left]
            b_ok, a_ok = b >= 0, a < n
            b_ok[b_ok] = entity[b[b_ok]] == entity[left[b_ok]]
            a_ok[a_ok] = entity[a[a_ok]] == entity[left[a_ok]]
            b0, a0 = np.where(b_ok, run_start[b], 0), np.where(a_ok, a, 0)
            out.append(_rows(len(left), False, part, entity[left], k, names.take(pa.array(left)), at[left], at[b0], rid[b0], b_ok, at[a0], rid[a0], a_ok))
            if 0 < open_ < n and last[open_ - 1] >= 0 and entity[last[open_ - 1]] == entity[-1]:
                kept.append(int(run_start[last[open_ - 1]]))
        return out, rows.take(pa.array(np.concatenate([np.sort(np.array(kept, np.int64)), np.arange(open_, n)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, kept, part = _Edges(kinds), None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select(["entity", "at", "kind", "rid", "left_id"])
            rows = rows.set_column(3, "rid", pc.fill_null(rows.column("rid"), 0))
            edges.see(*(rows.column(c).to_numpy() for c in ("entity", "at", "kind", "rid")))
            done, kept = settle(rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks(), False, part)
            yield from done
        if kept is not None:
            yield from settle(kept, True, part)[0]
            yield from edges.rows(part)

    return run


def _rows(n, edge, part, entity, kind, left_id, at, b_at, b_id, b_ok, a_at, a_id, a_ok) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, edge)),
            pa.array(np.full(n, part, np.int32)),
            pa.array(entity),
            pa.array(np.full(n, kind, np.int32)),
            left_id.cast(pa.string()),
            pa.array(at),
            pa.array(b_at, mask=~b_ok),
            pa.array(b_id, mask=~b_ok),
            pa.array(a_at, mask=~a_ok),
            pa.array(a_id, mask=~a_ok),
        ],
        names=["edge", "part", "entity", "kind", "left_id", "at", "before_at", "before_id", "after_at", "after_id"],
    )


def _carried(edges: DataFrame, parts: int) -> DataFrame:
    """(part, entity, kind, cb, ca): what comes to each partition from those before and after it.

    A parallel prefix scan in both directions: blocks of about sqrt(parts) partitions are scanned side by side, then
    their totals, and both are put together. At most 2 x kinds rows of each partition take part.
    """
    e = edges.withColumns(
        {
            "block": F.floor(F.col("part") / max(1, round(parts**0.5))),
            "b": F.when(F.col("before_at").isNotNull(), F.struct("before_at", (-F.col("before_id")).alias("i"))),
            "a": F.when(F.col("after_at").isNotNull(), F.struct("after_at", F.col("after_id").alias("i"))),
        }
    )

    def scan(keys: list[str], by: str, b: str, a: str) -> list[Column]:
        w = Window.partitionBy(*keys).orderBy(by)
        return [F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(b), F.min("a").over(w.rowsBetween(1, Window.unboundedFollowing)).alias(a)]

    inside = e.select("part", "entity", "kind", "block", *scan(["entity", "kind", "block"], "part", "b0", "a0"))
    totals = e.groupBy("entity", "kind", "block").agg(F.max("b").alias("b"), F.min("a").alias("a"))
    across = totals.select("entity", "kind", "block", *scan(["entity", "kind"], "block", "b1", "a1"))
    both = inside.join(across, ["entity", "kind", "block"])
    return both.select("part", "entity", "kind", F.greatest("b0", "b1").alias("cb"), F.least("a0", "a1").alias("ca")).filter("cb is not null or ca is not null")


def nearest_in_time(left: DataFrame, right: DataFrame, tolerances: dict[str, int]) -> DataFrame:
    """(left_id, kind, right_id) of the nearest right record of each kind within its tolerance.

    left: left_id string, entity bigint, at bigint (microseconds).
    right: right_id bigint, entity bigint, at bigint, kind string (one of tolerances).
    """
    spark = left.sparkSession
    names = list(tolerances)
    number = F.expr("case kind " + " ".join(f"when '{k}' then {i + 1}" for i, k in enumerate(names)) + " end")
    events = (
        left.filter("entity is not null and at is not null")
        .select("entity", "at", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("rid"), "left_id")
        .unionByName(
            right.filter("entity is not null and at is not null and right_id is not null").select("entity", "at", number.alias("kind"), F.col("right_id").alias("rid"), F.lit(None).cast("string").alias("left_id")).filter("kind is not null")
        )
    )
    order = ["entity", "at", "kind", "rid", "left_id"]
    spread = events.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    local = cut(spread.mapInArrow(_local_scan(len(names), max(tolerances.values(), default=0)), _LOCAL))

    carried = _carried(local.filter("edge"), partitions(spark))
    rows = local.filter("not edge").join(F.broadcast(carried), ["part", "entity", "kind"], "left")
    joined = rows.selectExpr(
        "left_id",
        "kind",
        "at",
        "greatest(if(before_at is null, null, named_struct('before_at', before_at, 'i', -before_id)), cb) as b",
        "least(if(after_at is null, null, named_struct('after_at', after_at, 'i', after_id)), ca) as a",
    )
    picked = joined.selectExpr(
        "left_id",
        "kind",
        "case when b is null and a is null then null when a is null or at - b.before_at <= a.after_at - at then named_struct('d', at - b.before_at, 'id', -b.i) else named_struct('d', a.after_at - at, 'id', a.i) end as p",
    )
    most = F.expr("case kind " + " ".join(f"when {i + 1} then {tolerances[k]}" for i, k in enumerate(names)) + " end")
    label = F.expr("case kind " + " ".join(f"when {i + 1} then '{k}'" for i, k in enumerate(names)) + " end")
    return picked.filter(F.col("p").isNotNull() & (F.col("p.d") <= most)).select("left_id", label.alias("kind"), F.col("p.id").alias("right_id"))


def frame_records(frames: DataFrame, records: DataFrame, depth_us: int = 20_000, pose_us: int = 50_000) -> DataFrame:
    """(frame_id, sensor, record_id): the usable depth and pose record of each frame closest to its ts."""
    left = frames.select(F.col("frame_id").alias("left_id"), F.col("sequence_id").alias("entity"), micros(F.col("ts")).alias("at"))
    finite = F.coalesce((F.size("pose") == 16) & ~F.exists("pose", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    usable = ((F.col("sensor") == "depth") & (F.coalesce(F.length("depth_path"), F.lit(0)) > 0)) | ((F.col("sensor") == "pose") & finite)
    right = records.filter(usable).select(F.col("record_id").alias("right_id"), F.col("sequence_id").alias("entity"), micros(F.col("ts")).alias("at"), F.col("sensor").alias("kind"))
    found = nearest_in_time(left, right, {"depth": depth_us, "pose": pose_us})
    return found.select(F.col("left_id").alias("frame_id"), F.col("kind").alias("sensor"), F.col("right_id").alias("record_id"))
