"""The record parser against a parser that walks through the characters."""

import math
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from waymark.operators import rejects
from waymark.operators.rejects import CAMERA_MODELS, parse_batch


def fields_of(body):
    fields, i, n = [], 0, len(body)
    while True:
        if i < n and body[i] == '"':
            j, text = i + 1, ""
            while True:
                if j >= n:
                    return None
                if body[j] == '"':
                    if j + 1 < n and body[j + 1] == '"':
                        text, j = text + '"', j + 2
                        continue
                    break
                text, j = text + body[j], j + 1
            i = j + 1
            if i < n and body[i] != ",":
                return None
        else:
            j = body.find(",", i)
            j = n if j < 0 else j
            text = body[i:j]
            if '"' in text:
                return None
            i = j
        fields.append(text)
        if i >= n:
            return fields
        i += 1


def whole(s, low, high):
    return bool(re.fullmatch(r" *-?[0-9]+ *", s)) and low <= int(s) <= high


def decimal(s):
    return bool(re.fullmatch(r" *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *", s)) and math.isfinite(float(s))


def expected(kind, body):
    f = fields_of(body)
    if f is None:
        return "quoting"
    if len(f) != {"camera": 6, "point3d": 10}.get(kind, -1):
        return "column_count"
    items = lambda s: s.split(",") if s.strip(" ") else []
    if kind == "camera":
        ok = whole(f[0], 1, 2**63 - 1) and f[1] in CAMERA_MODELS and whole(f[2], 1, 2**31 - 1) and whole(f[3], 1, 2**31 - 1) and len(items(f[4])) == CAMERA_MODELS[f[1]] and all(map(decimal, items(f[4])))
    else:
        a, b = items(f[8]), items(f[9])
        ok = whole(f[0], 1, 2**63 - 1) and all(map(decimal, f[1:4])) and all(whole(x, 0, 255) for x in f[4:7]) and decimal(f[7]) and float(f[7]) >= 0 and len(a) == len(b)
        ok = ok and all(whole(x, 1, 2**31 - 1) for x in a) and all(whole(x, 0, 2**31 - 1) for x in b)
    return None if ok else "invalid_value"


def reasons(records):
    batch = pa.RecordBatch.from_pydict({"record_id": pa.array([i for i, *_ in records], pa.int64()), "rec_type": pa.array([k for _, k, _ in records], pa.string()), "body": pa.array([b for *_, b in records], pa.string())})
    out = {}
    for b in parse_batch(batch):
        out |= dict(zip(b.column("record_id").to_pylist(), b.column("reason").to_pylist()))
    return out


GOOD = '7,1.5,-2.,+.5e3,0,255, 7 ,0.25,"1, 2,3","0,0,9"'
TRICKY = [
    ("point3d", GOOD),
    ("point3d", GOOD.replace("0.25", "1e400")),
    ("point3d", GOOD.replace("0.25", "-0.0")),
    ("point3d", GOOD.replace("255", "256")),
    ("point3d", GOOD.replace("255", "-0")),
    ("point3d", GOOD.replace("7,1.5", "9223372036854775807,1.5")),
    ("point3d", GOOD.replace("7,1.5", "9223372036854775808,1.5")),
    ("point3d", GOOD.replace("7,1.5", "000000000000000000000000012,1.5")),
    ("point3d", GOOD.replace("7,1.5", "٧,1.5")),
    ("point3d", GOOD.replace("7,1.5", "\t7,1.5")),
    ("point3d", GOOD.replace('"1, 2,3","0,0,9"', ",")),
    ("point3d", GOOD.replace('"1, 2,3","0,0,9"', '"  ",')),
    ("point3d", GOOD.replace('"0,0,9"', '"0,0,"')),
    ("point3d", GOOD + ","),
    ("point3d", GOOD[:-1]),
    ("point3d", GOOD.replace('"1, 2,3"', ' "1, 2,3"')),
    ("point3d", GOOD.replace('"1, 2,3"', '"1, 2,3" ')),
    ("camera", '1,FOV,10,10,"1,2,3,4,5","a ""b"" , \nc"'),
    ("camera", '1,FOV,10,10,"1,2,3,4,5",a ""b""'),
    ("camera", '1,"FOV",10,10,"1,2,3,4,5",'),
    ("camera", '1,fov,10,10,"1,2,3,4,5",x'),
    ("camera", '1,FOV,10,10,"1,2,3,4",x'),
    ("camera", '1,FOV,10,0,"1,2,3,4,5",x'),
    ("camera", '1,FOV,10,10,"1,2,3,nan,5",x'),
    ("camera", '"'),
    ("camera", '""'),
    ("camera", '"""'),
    ("camera", '"","'),
    (None, "1,2"),
    ("other", "1"),
    ("camera", "x" * 100_000),
]


def test_tricky_records():
    records = [(i, k, b) for i, (k, b) in enumerate(TRICKY)]
    got = reasons(records)
    for i, k, b in records:
        assert got[i] == expected(k, b), (k, b)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["camera", "point3d"]), st.text(alphabet='",1 \n-é.a', max_size=24)), min_size=1, max_size=12))
def test_any_text(records):
    rows = [(i, k, b) for i, (k, b) in enumerate(records)]
    got = reasons(rows)
    for i, k, b in rows:
        if b.strip() and not b.lstrip().startswith("#"):
            assert got[i] == expected(k, b), (k, b)
        else:
            assert i not in got


def test_tables(spark):
    raw = spark.read.parquet(f"{DATA}/raw_records.parquet").withColumnRenamed("file_name", "reason")
    want = {(r.record_id, x) for r in raw.collect() if r.body is not None and r.body.strip() and not r.body.lstrip().startswith("#") and (x := expected(r.rec_type, r.body))}
    got = [tuple(r) for r in rejects.failing(raw).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    n_good = rejects.loaded_cameras(raw).count() + rejects.loaded_points(raw).count()
    ids = {r.record_id for r in raw.collect() if r.body is not None and r.body.strip() and not r.body.lstrip().startswith("#")}
    assert n_good == len(ids) - len({i for i, _ in want})


def test_loaded_values(spark):
    raw = spark.createDataFrame([(1, "f", "camera", '3,FOV,10,20,"1,2,3,4,5.5","a ""b"""'), (1, "f", "camera", '3,FOV,10,20,"1,2,3,4,5.5","a ""b"""'), (2, "f", "point3d", GOOD), (None, None, None, None)], "record_id bigint, file_name string, rec_type string, body string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as loaded_at")
    c = rejects.loaded_cameras(raw).collect()
    assert len(c) == 1 and c[0].params == [1, 2, 3, 4, 5.5] and c[0].label == 'a "b"'
    p = rejects.loaded_points(raw).collect()[0]
    assert (p.point3d_id, p.xyz, p.rgb, p.image_ids, p.point2d_idxs) == (7, [1.5, -2.0, 500.0], [0, 255, 7], [1, 2, 3], [0, 0, 9])


@pytest.mark.parametrize("kind", ["found", "cameras", "points"])
def test_empty_table(spark, kind):
    raw = spark.createDataFrame([], "record_id bigint, file_name string, rec_type string, body string, loaded_at timestamp_ntz")
    f = {"found": rejects.failing, "cameras": rejects.loaded_cameras, "points": rejects.loaded_points}[kind]
    assert f(raw).count() == 0


def test_long_and_extreme_decimals():
    import numpy as np

    texts = pa.array(["0." + "1" * 200_000] + ["+1.5", ".5", "2.", "1e5", " -3 ", "1e999", "-1e-999", "x", ""] * 50, pa.large_string())
    values, ok = rejects.decimals(texts)
    assert ok[:8].tolist() == [True, True, True, True, True, True, False, True] and not ok[8] and not ok[9]
    assert values[1:6].tolist() == [1.5, 0.5, 2.0, 1e5, -3.0] and abs(values[0] - 1 / 9) < 1e-15
    values, ok = rejects.decimals(pa.array(["1", "+2.5"], pa.large_string()))
    assert values.tolist() == [1.0, 2.5] and np.all(ok)


@pytest.mark.parametrize("split,batch", [(64, "10000"), (200, "3"), (10**6, "1"), (10**6, "10000")])
def test_record_ends_across_splits(spark, tmp_path, split, batch):
    """Quoted line ends, records longer than splits, several files: records come out as they went in."""
    import random

    rnd = random.Random(split)
    want = []
    for f in range(3):
        bodies = []
        for i in range(120):
            parts = [rnd.choice(["", "a", 'q""q', "line\nend", "x" * rnd.choice([1, 5, 300]), "\n\n", "c,d"]) for _ in range(4)]
            if rnd.random() < 0.05:
                bodies.append(rnd.choice(['# say "so', '  # 1 "" 2', "#", '#"""']))
            bodies.append(",".join([f"{f}-{i}"] + [f'"{p}"' if any(c in p for c in ',\n"') or rnd.random() < 0.3 else p for p in parts]))
        (tmp_path / f"f{f}.txt").write_text("\n".join(bodies) + ("\n" if f else ""))
        want += bodies
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rejects.read_records(spark, str(tmp_path)).collect()
    finally:
        for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(c)
    assert sorted(r.body for r in got) == sorted(want) and len({r.record_id for r in got}) == len(want)
