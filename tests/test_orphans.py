"""Orphan references: increments, hot keys, edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.operators import orphans
from waymark.operators.orphans import by_increments, in_periods, new_state, references, snapshots, snapshots_of, unsound

START = datetime(2024, 1, 1)
REFS = "field int, target bigint, row_id bigint, at bigint"
PARENTS = "field int, target bigint, at bigint, gone bigint"


def brute(refs, parents):
    known = {}
    for f, t, a, g in parents:
        b = known.setdefault((f, t), [a, g])
        b[0] = min(b[0], a)
        b[1] = g if b[1] is None else b[1] if g is None else min(b[1], g)
    first = {}
    for f, t, r, a in refs:
        first[f, t, r] = min(a, first.get((f, t, r), a))
    out = set()
    for (f, t, r), a in first.items():
        p = known.get((f, t))
        s = "missing" if p is None else "deleted" if p[1] is not None and p[1] <= a else "late" if p[0] > a else None
        if s:
            out.add((orphans.FIELDS[f], r, t, s))
    return out


def cases(n=3000, seed=1):
    rnd = random.Random(seed)
    refs = [(rnd.randint(0, 2), 1 if rnd.random() < 0.4 else rnd.randint(1, 60), rnd.randint(1, 500), rnd.randint(0, 50)) for _ in range(n)]
    parents = [(rnd.randint(0, 2), rnd.randint(1, 50), rnd.randint(0, 50), rnd.choice([None, None, rnd.randint(0, 60)])) for _ in range(120)]
    return refs, parents


def result(state):
    return {(r.ref_field, r.row_id, r.target_id, r.status) for r in unsound(state).collect()}


def advance(state, refs, parents, **more):
    spark = refs.sparkSession
    return orphans.advance(new_state(spark) if state is None else state, refs, parents, **more)


def earliest(parents):
    first = {}
    for f, t, a, g in parents:
        b = first.setdefault((f, t), [a, g])
        b[0], b[1] = min(b[0], a), g if b[1] is None else b[1] if g is None else min(b[1], g)
    return [(f, t, a, g) for (f, t), (a, g) in first.items()]


@pytest.mark.parametrize("hot,batch", [(10, "10000"), (10**9, "10000"), (10**9, "3"), (25, "1")])
def test_against_brute_force(spark, monkeypatch, hot, batch):
    monkeypatch.setattr(orphans, "HOT_ROWS", hot)
    refs, parents = cases(3000 if batch == "10000" else 600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = result(advance(None, spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(refs, parents)


def test_every_key_beyond_the_bound_is_salted(spark, monkeypatch):
    """More large keys than a list of HOT_KEYS could have named: the bound goes by the share of all references."""
    monkeypatch.setattr(orphans, "HOT_ROWS", 5)
    monkeypatch.setattr(orphans, "HOT_KEYS", 20)
    refs = [(0, t, r, 1) for t in range(12) for r in range(40)] + [(0, 100 + t, 1, 1) for t in range(50)]
    df = spark.createDataFrame(refs, REFS)
    assert set(orphans._hot(df)) == {(0, t) for t in range(12)}
    state = advance(None, df, spark.createDataFrame([(0, 3, 0, None)], PARENTS))
    assert state.rows().filter("kind = 1").groupBy("target", "salt").count().agg(F.max("count")).first()[0] < 40
    assert result(state) == brute(refs, [(0, 3, 0, None)])


def test_increments_give_the_same_state(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_ROWS", 100)
    refs, parents = cases(1500, 2)
    state = None
    for i in range(3):
        state = advance(state, spark.createDataFrame(refs[i::3], REFS), spark.createDataFrame(parents[i::3], PARENTS))
    assert result(state) == brute(refs, parents)


@pytest.mark.parametrize("edges", [[15, 30], [5, 10, 20, 40, 55]])
def test_periods_give_the_same_state(spark, edges):
    refs, parents = cases(1500, 3)
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(earliest(parents), PARENTS)
    state = by_increments(in_periods(r, p, edges), count=True)
    assert result(state) == brute(refs, parents)
    whole = advance(None, r, p).rows()
    opened = {}
    for x in orphans._changes(whole).collect():
        k = (x.field, sum(x.e.t >= e for e in edges))
        o = opened.setdefault(k, [0, 0])
        o[x.e.d < 0] += 1
    assert sorted((f, int(n), o, c) for f, n, o, c in state.ledger if o or c) == sorted((f, n, o, c) for (f, n), (o, c) in opened.items())


def test_a_small_increment_reads_and_writes_little(spark):
    """1 % of the keys: about 1 % of the state is read and written again, the other files stay."""
    refs = [(0, t, r, 1) for t in range(40_000) for r in range(2)]
    state = orphans.advance(orphans.State(spark, orphans.scratch(spark, "orphans"), 200), spark.createDataFrame(refs, REFS), spark.createDataFrame([(0, t, 0, None) for t in range(0, 40_000, 2)], PARENTS))
    more = spark.createDataFrame([(0, t, 5, 2) for t in range(20_000, 20_400)], REFS)
    after = orphans.advance(state, more, spark.createDataFrame([], PARENTS))
    touched = [b for b, v in after.versions.items() if state.versions.get(b) != v]
    assert len(touched) <= 4 and {b: v for b, v in after.versions.items() if b not in touched} == {b: v for b, v in state.versions.items() if b not in touched}
    assert state.rows(touched).count() <= 0.04 * state.rows().count()
    assert after.rows().filter("kind = 1").count() == 80_000 + 400


def test_arrivals_resolve_and_deletions_reopen(spark):
    one = advance(None, spark.createDataFrame([(0, 5, 1, 10)], REFS), spark.createDataFrame([], PARENTS))
    assert {r[3] for r in result(one)} == {"missing"}
    two = advance(one, spark.createDataFrame([], REFS), spark.createDataFrame([(0, 5, 20, None)], PARENTS))
    assert {r[3] for r in result(two)} == {"late"}
    three = advance(two, spark.createDataFrame([(0, 5, 2, 30)], REFS), spark.createDataFrame([(0, 5, 20, 25)], PARENTS))
    assert {(r[1], r[3]) for r in result(three)} == {(1, "late"), (2, "deleted")}
    orphans.drop_replaced(two, three)
    assert {(r[1], r[3]) for r in result(three)} == {(1, "late"), (2, "deleted")}


def test_snapshots_add_up(spark):
    day = 86_400_000_000
    base = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    refs = [(0, 1, 1, base), (0, 1, 2, base + 40 * day), (0, 2, 3, base)]
    parents = [(0, 1, base + 20 * day, base + 70 * day)]
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    names, n = orphans.months_of(r, p)
    assert names == ["2024-01", "2024-02", "2024-03"] and n == 3
    edges = [base + 31 * day, base + 60 * day]
    for got in (snapshots_of(advance(None, r, p).rows()), snapshots(by_increments(in_periods(r, p, edges, names), count=True))):
        assert {x.month: (x.opened, x.closed, x.open_at_end) for x in got.collect()} == {"2024-01": (2, 1, 1), "2024-03": (2, 0, 3)}


def test_lists_nulls_and_copies(spark):
    t = lambda d: START + timedelta(days=d)
    rows = spark.createDataFrame([(1, [5, 5, None], t(3)), (1, [5, 5, None], t(1)), (2, None, t(1)), (3, [], t(1)), (None, [5], t(1)), (4, [6], None)], "id bigint, l array<bigint>, loaded_at timestamp_ntz")
    got = references(rows, 0, "id", "l").collect()
    assert {(r.target, r.row_id) for r in got} == {(5, 1)}
    known = spark.createDataFrame([(5, t(2), None, 1)], "k bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz, target int")
    state = advance(None, references(rows, 0, "id", "l"), orphans.parents(known, 0, "k"))
    assert result(state) == {("points3d.image_ids", 1, 5, "late")}


def test_empty_tables(spark):
    state = advance(None, spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS))
    assert state.rows().count() == 0 and unsound(state).count() == 0 and snapshots(state).count() == 0
    assert orphans.months_of(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)) == (["1970-01"], 0)
    assert orphans.per_month(state).agg(F.count("*")).first()[0] == 0
