"""References to records that do not exist: keyed pending-orphan state.

The state holds, per (field, target) key, what is known of the parent (its
arrival, its deletion) and the references that wait for it. `advance` takes the
state and an increment of references and parents and gives the new state: new
references probe the parent index, an arriving parent resolves the orphans that
wait for it (they turn from `missing` to `late`), a deletion reopens references
that were sound until then. One increment with everything, or many increments
one after another, lead to the same state.

The state is a table in the shared folder, cut into buckets: blocks of
neighbouring targets are dealt to them by hash. An increment reads and rewrites
only the buckets that its own keys fall into; all others stay as they are, files
and all. What opens and closes in a period is counted from the buckets the
increment rewrote, so a snapshot costs what the increment costs.

A bucket is probed by a stream over rows sorted by key, parents first: nothing is
kept but the parent of the key at hand, however many references it has. A key with
more than HOT_ROWS references and more than one HOT_KEYS-th of all (so fewer than
HOT_KEYS keys, however many references there are) is salted by the referring row,
and its parent goes to every salt.

Defined results
* null targets, and -1 among point ids, are no references; rows without an id of their own are left out.
* repeated deliveries of a record count as one that arrived with the earliest; a record without arrival time is left out.
* equal times: an arrival or deletion at the very time of the reference comes before it.
* empty tables give empty results; a missing parent table is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.tables import cut, micros, partitions, remove, scratch

HOT_ROWS, HOT_KEYS = 50_000, 10_000
NEVER = np.iinfo(np.int64).max
STATUS = ("sound", "missing", "deleted", "late")
BUCKET_ROWS, BLOCK_BITS = 250_000, 8  # references of a bucket that are aimed at; neighbouring targets of a block
STATE = "bucket int, field int, target bigint, salt int, kind int, row_id bigint, at bigint, gone bigint, status int, arrived bigint"
# kind 0: parent index entry (at: arrival or null, gone: deletion or null); kind 1: reference (at: arrival of the referring record)


def references(rows: DataFrame, field: int, row_id: str, target, loaded_at: str = "loaded_at") -> DataFrame:
    """(field, target, row_id, at) of one reference column; an array column refers once for each distinct element."""
    if dict(rows.dtypes)[target].startswith("array"):
        rows = rows.select(row_id, loaded_at, F.explode(F.array_distinct(target)).alias("__t"))
    else:
        rows = rows.select(row_id, loaded_at, F.col(target).alias("__t"))
    return rows.filter(f"__t is not null and `{row_id}` is not null and `{loaded_at}` is not null").select(
        F.lit(field).alias("field"), F.col("__t").cast("bigint").alias("target"), F.col(row_id).cast("bigint").alias("row_id"), micros(F.col(loaded_at)).alias("at")
    )


def parents(rows: DataFrame, field: int, key: str) -> DataFrame:
    """(field, target, at, gone) of a parent table: earliest arrival and deletion per key."""
    return (
        rows.filter(F.col(key).isNotNull() & F.col("loaded_at").isNotNull())
        .groupBy(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("target"))
        .agg(F.min(micros(F.col("loaded_at"))).alias("at"), F.min(micros(F.col("deleted_at"))).alias("gone"))
    )


@dataclass
class State:
    """A pending-orphan state: which version of which bucket is the current one, and what each period changed."""

    spark: SparkSession
    root: str
    buckets: int
    versions: dict[int, int] = field(default_factory=dict)
    latest: int = 0
    ledger: list[tuple[int, str, int, int]] = field(default_factory=list)  # (field, period, opened, closed)

    def paths(self, buckets: list[int]) -> list[str]:
        return [f"{self.root}/v{self.versions[b]}/bucket={b}" for b in buckets if b in self.versions]

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """STATE's columns of these buckets, or of all."""
        paths = self.paths(sorted(self.versions) if buckets is None else buckets)
        kind = ", ".join(c for c in STATE.split(", ")[1:])
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.select(self.bucket().alias("bucket"), *rows.columns)

    def bucket(self) -> Column:
        return F.expr(f"cast(pmod(xxhash64(field, shiftright(target, {BLOCK_BITS})), {self.buckets}) as int)")


def new_state(spark: SparkSession, rows: int = 0) -> State:
    """An empty state, with buckets for about so many references."""
    return State(spark, scratch(spark, "orphans"), max(8, -(-rows // BUCKET_ROWS)))


def _hot(refs: DataFrame) -> dict[tuple[int, int], int]:
    """Salts of the keys with very many references; fewer than HOT_KEYS keys, as each has more than one HOT_KEYS-th of all."""
    counts = refs.groupBy("field", "target").count()
    if counts.filter(F.col("count") > HOT_ROWS).isEmpty():
        return {}
    most = max(HOT_ROWS, refs.count() // HOT_KEYS)
    return {(r["field"], r["target"]): -(-r["count"] // most) for r in counts.filter(F.col("count") > most).collect()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes rows in order of (bucket, field, target, salt, kind, row_id, at): a key's parents come before its references."""
    keys = ("bucket", "field", "target", "salt")
    out = [c.split()[0] for c in STATE.split(", ")]
    last, arrived, gone, row = None, NEVER, NEVER, None  # the key at hand, its parent, its last reference

    def batch(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        arrays = {}
        for c, (name, kind) in zip(out, (x.split() for x in STATE.split(", "))):
            v = cols[name].astype(np.int64)
            arrays[c] = pa.array(v, mask=v == NEVER).cast(pa.int32() if kind == "int" else pa.int64())
        return pa.RecordBatch.from_pydict(arrays)

    def parents_of(heads: list[np.ndarray], a: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
        there = (a != NEVER) | (g != NEVER)
        n = int(there.sum())
        cols = {k: h[there] for k, h in zip(keys, heads)}
        zero = np.zeros(n, np.int64)
        return batch(cols | {"kind": zero, "row_id": zero, "at": a[there], "gone": g[there], "status": zero, "arrived": a[there]})

    for b in batches:
        if not b.num_rows:
            continue
        d = {c: b.column(c).fill_null(NEVER if c in ("gone", "at") else 0).to_numpy(zero_copy_only=False) for c in (*keys, "kind", "row_id", "at", "gone")}
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([d[k][1:] != d[k][:-1] for k in keys], axis=0)
        key = np.cumsum(new) - 1
        heads = [d[k][new] for k in keys]
        a, g = np.full(key[-1] + 1, NEVER), np.full(key[-1] + 1, NEVER)
        first = tuple(int(h[0]) for h in heads)
        if last == first:
            a[0], g[0] = arrived, gone
        elif last is not None:
            yield parents_of([np.array([x]) for x in last], np.array([arrived]), np.array([gone]))
            row = None
        p = d["kind"] == 0
        np.minimum.at(a, key[p], d["at"][p])
        np.minimum.at(g, key[p], d["gone"][p])
        r = np.flatnonzero(~p)
        fresh = np.ones(len(r), bool)  # one reference per (key, row): that of the earliest delivery
        fresh[1:] = (key[r[1:]] != key[r[:-1]]) | (d["row_id"][r[1:]] != d["row_id"][r[:-1]])
        if len(r) and last == first and key[r[0]] == 0 and row is not None and row == d["row_id"][r[0]]:
            fresh[0] = False
        mine = r[fresh]
        ka, kg, at = a[key[mine]], g[key[mine]], d["at"][mine]
        status = np.where(ka == NEVER, 1, np.where(kg <= at, 2, np.where(ka > at, 3, 0)))
        if len(mine):
            yield batch({c: d[c][mine] for c in (*keys, "kind", "row_id", "at")} | {"gone": kg, "status": status, "arrived": ka})
        if len(a) > 1:
            yield parents_of([h[:-1] for h in heads], a[:-1], g[:-1])
        if key[-1] > 0:
            row = None
        if len(r) and key[r[-1]] == key[-1]:
            row = int(d["row_id"][r[-1]])
        last, arrived, gone = tuple(int(h[-1]) for h in heads), a[-1], g[-1]
    if last is not None:
        yield parents_of([np.array([x]) for x in last], np.array([arrived]), np.array([gone]))


def _probe(refs: DataFrame, parent_rows: DataFrame, bucket: Column) -> DataFrame:
    """The state of the keys of these references and parents."""
    spark = refs.sparkSession
    hot = _hot(refs)
    if hot:
        kinds = "field int, target bigint, salts int"
        salts = F.broadcast(spark.createDataFrame([(f, t, n) for (f, t), n in hot.items()], kinds))
        refs = refs.join(salts, ["field", "target"], "left").withColumn("salt", F.expr("cast(if(salts is null, 0, pmod(xxhash64(row_id), salts)) as int)"))
        parent_rows = parent_rows.join(salts, ["field", "target"], "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")))
    else:
        refs, parent_rows = (x.withColumn("salt", F.lit(0)) for x in (refs, parent_rows))
    none = F.lit(None).cast("bigint")
    cols = ("field", "target", "salt", "kind", "row_id", "at", "gone")
    events = refs.withColumns({"kind": F.lit(1), "gone": none}).select(*cols).unionByName(parent_rows.withColumns({"kind": F.lit(0), "row_id": none}).select(*cols))
    order = ("bucket", "field", "target", "salt", "kind", "row_id", "at")
    keyed = events.withColumn("bucket", bucket).repartition(partitions(spark), "bucket", "salt").sortWithinPartitions(*order)
    return keyed.mapInArrow(_scan, STATE)


def advance(state: State, refs: DataFrame, parent_rows: DataFrame, period: tuple[str, int | None, int | None] | None = None) -> State:
    """The state after an increment. Only the buckets that the increment's keys fall into are read and written again.

    period: (name, from, to) in microseconds; then the ledger also gets what opened and closed in it.
    """
    spark, bucket = state.spark, state.bucket()
    touched = sorted(r["bucket"] for r in refs.select(bucket.alias("bucket")).unionByName(parent_rows.select(bucket.alias("bucket"))).distinct().collect())  # at most state.buckets numbers
    if not touched:
        return state
    known = state.rows(touched)
    refs = refs.select("field", "target", "row_id", "at").unionByName(known.filter("kind = 1").select("field", "target", "row_id", "at"))
    parent_rows = parent_rows.select("field", "target", "at", "gone").unionByName(known.filter("kind = 0").select("field", "target", "at", "gone").distinct())
    number = state.latest + 1
    _probe(refs, parent_rows, bucket).write.partitionBy("bucket").parquet(f"{state.root}/v{number}")
    after = State(spark, state.root, state.buckets, state.versions | dict.fromkeys(touched, number), number, list(state.ledger))
    if period:
        name, low, high = period
        inside = " and ".join(["true", *([f"e.t >= {low}"] if low is not None else []), *([f"e.t < {high}"] if high is not None else [])])
        per = _changes(after.rows(touched)).filter(inside).groupBy("field").agg(F.count_if(F.col("e.d") > 0).alias("o"), F.count_if(F.col("e.d") < 0).alias("c"))
        after.ledger += [(r["field"], name, r["o"], r["c"]) for r in sorted(per.collect())]  # a row per field
    return after


def drop_replaced(before: State, after: State) -> None:
    """Delete the files of `before` that `after` replaced."""
    remove(after.spark, *before.paths([b for b, v in before.versions.items() if after.versions[b] != v]))


@dataclass
class Periods:
    """Events of both kinds in the shared folder, by the period in which they happened."""

    spark: SparkSession
    root: str
    names: list[str]
    edges: list[int]

    def increment(self, i: int) -> tuple[DataFrame, DataFrame]:
        """(references, parents) of the i-th period; only its files are read."""
        rows = self.spark.read.parquet(self.root).filter(F.col("period") == i)
        refs = rows.filter("kind = 1").select("field", "target", "row_id", "at")
        return refs, rows.filter("kind = 0").select("field", "target", "at", "gone")

    def bounds(self, i: int) -> tuple[str, int | None, int | None]:
        return self.names[i], self.edges[i - 1] if i else None, self.edges[i] if i < len(self.edges) else None


def in_periods(refs: DataFrame, parent_rows: DataFrame, edges: list[int], names: list[str] | None = None) -> Periods:
    """Events before the first edge (microseconds), between edges, and from the last one on.

    A parent's arrival and its deletion are events of their own; a deletion that comes first is known without an arrival.
    """
    spark, root = refs.sparkSession, scratch(refs.sparkSession, "orphan-events")
    when = lambda c: F.expr("cast(" + " + ".join([*(f"int({c} >= {e})" for e in edges), "0"]) + " as int)")
    none = F.lit(None).cast("bigint")
    cols = ("period", "kind", "field", "target", "row_id", "at", "gone")
    asked = refs.withColumns({"period": when("at"), "kind": F.lit(1), "gone": none}).select(*cols)
    told = parent_rows.withColumns({"kind": F.lit(0), "row_id": none, "p_at": when("at"), "p_gone": F.when(F.col("gone").isNotNull(), when("gone"))})
    arrivals = told.withColumn("period", F.col("p_at")).withColumn("gone", F.when(F.col("p_gone") <= F.col("p_at"), F.col("gone")))
    deletions = told.filter("p_gone <> p_at").withColumn("period", F.col("p_gone")).withColumn("at", F.when(F.col("p_at") < F.col("p_gone"), F.col("at")))
    asked.unionByName(arrivals.select(*cols)).unionByName(deletions.select(*cols)).write.partitionBy("period").parquet(root)
    return Periods(spark, root, names or [str(i) for i in range(len(edges) + 1)], edges)


def by_increments(periods: Periods, rows: int = 0, count: bool = False) -> State:
    """The state after all periods, one increment each; with count, also their ledger."""
    state = new_state(periods.spark, rows)
    for i in range(len(periods.names)):
        after = advance(state, *periods.increment(i), periods.bounds(i) if count else None)
        drop_replaced(state, after)
        state = after
    return state


FIELDS = ("points3d.image_ids", "images.point3d_ids", "images.camera_id")


def model_events(points: DataFrame, images: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and parents of a reconstruction's three reference fields."""
    named = images.withColumn("point3d_ids", F.filter("point3d_ids", lambda x: x != -1))
    refs = references(points, 0, "point3d_id", "image_ids").unionByName(references(named, 1, "image_id", "point3d_ids")).unionByName(references(images, 2, "image_id", "camera_id"))
    known = parents(images, 0, "image_id").unionByName(parents(points, 1, "point3d_id")).unionByName(parents(cameras, 2, "camera_id"))
    return refs, known


def months_of(refs: DataFrame, parent_rows: DataFrame) -> tuple[list[str], int]:
    """All months from the first to the last event, and the number of references."""
    times = refs.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).unionByName(
        parent_rows.agg(F.least(F.min("at"), F.min("gone")).alias("low"), F.greatest(F.max("at"), F.max("gone")).alias("high"), F.lit(0).cast("bigint").alias("n"))
    )
    low, high, n = times.agg(F.min("low"), F.max("high"), F.sum("n")).first()
    if low is None:
        return ["1970-01"], 0
    first, last = (d.year * 12 + d.month - 1 for d in (datetime(1970, 1, 1) + timedelta(microseconds=x) for x in (low, high)))
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)], n


def model_state(points: DataFrame, images: DataFrame, cameras: DataFrame, months: int = 3, count: bool = False) -> State:
    """The pending-orphan state of a reconstruction, by increments of so many months; with count, and their ledger."""
    refs, known = model_events(points, images, cameras)
    known = cut(known)
    all_months, n = months_of(refs, known)
    names = all_months[::months]
    edges = [int((datetime.strptime(m, "%Y-%m") - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for m in names[1:]]
    return by_increments(in_periods(refs, known, edges, names), n, count)


def _named(state: State) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + 1)
    statuses = F.element_at(F.array(*map(F.lit, STATUS)), F.col("status") + 1)
    month = F.expr("date_format(timestampadd(MICROSECOND, at, timestamp_ntz'1970-01-01 00:00:00'), 'yyyy-MM')")
    return state.rows().filter("kind = 1").withColumns({"ref_field": names, "status": statuses, "load_month": month})


def unsound(state: State) -> DataFrame:
    """The references that were not sound when they arrived."""
    return _named(state).filter("status <> 'sound'").select("ref_field", "row_id", F.col("target").alias("target_id"), "status", "load_month")


def per_month(state: State) -> DataFrame:
    """Counts of references by field, month of arrival and status."""
    return _named(state).groupBy("ref_field", "load_month", "status").agg(F.count("*").alias("n_refs"))


def _changes(rows: DataFrame) -> DataFrame:
    """(field, e.t, e.d): when each reference became an orphan (d = 1) and when it no longer was (d = -1).

    A reference is an orphan from its arrival until its parent arrives, and again from the parent's
    deletion on; a reference to a parent that was deleted before stays open.
    """
    return rows.filter("kind = 1").selectExpr(
        "field",
        """explode(case
             when arrived is null then array(struct(at as t, 1 as d))
             when gone <= at then array(struct(at as t, 1 as d))
             when arrived > at and gone is not null and gone > arrived then array(struct(at as t, 1 as d), struct(arrived as t, -1 as d), struct(gone as t, 1 as d))
             when arrived > at and gone is not null then array(struct(at as t, 1 as d))
             when arrived > at then array(struct(at as t, 1 as d), struct(arrived as t, -1 as d))
             when gone is not null then array(struct(gone as t, 1 as d))
             else cast(array() as array<struct<t: bigint, d: int>>) end) as e""",
    )


def _counted(per: DataFrame) -> DataFrame:
    """(ref_field, month, opened, closed, open_at_end) from a row per field and month: small."""
    name = F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + 1)
    return per.selectExpr("field", "month", "opened", "closed", "sum(opened - closed) over (partition by field order by month) as open_at_end").select(name.alias("ref_field"), "month", "opened", "closed", "open_at_end")


def snapshots(state: State) -> DataFrame:
    """Per field and period in which something changed: orphans opened, closed, and open at its end, as the increments counted them."""
    rows = [x for x in state.ledger if x[2] or x[3]]
    return _counted(state.spark.createDataFrame(rows, "field int, month string, opened bigint, closed bigint"))


def snapshots_of(rows: DataFrame) -> DataFrame:
    """The same by month, from the rows of a state in one pass."""
    month = F.expr("date_format(timestampadd(MICROSECOND, e.t, timestamp_ntz'1970-01-01 00:00:00'), 'yyyy-MM')")
    return _counted(_changes(rows).groupBy("field", month.alias("month")).agg(F.count_if(F.col("e.d") > 0).alias("opened"), F.count_if(F.col("e.d") < 0).alias("closed")))
