"""Rows that fail to parse: loading delimited records and setting the failing ones apart.

Method: structural indexing. A batch of records is looked at as one byte
buffer. A mask of the quotes and its running parity (restarted at each record)
tell which commas and line ends lie inside a quoted field; the remaining commas
and the record ends delimit the fields. Everything afterwards is a comparison
of whole columns: field counts, patterns, ranges. No record is walked through
by Python. Raw files, whose quoted fields may hold line ends, are cut into records
first (`read_records`): the parity of the quotes before each line end tells whether
it ends a record, a prefix sum of the splits' quotes gives the parity at the start
of every split, and records that cross splits are put together from their pieces.

Defined results
* null, blank and `#...` bodies (after leading blanks) are no records: they come out nowhere.
* a record_id that is null is kept and reported like any other.
* an unknown or null rec_type has no layout, so such a record fails with `column_count`.
* repeated deliveries of a record (same record_id) come out once, with the earliest loaded_at.
* an empty table gives empty results; further columns of the input are ignored.
* in raw files a quote that is never closed runs on to the next quote or to a comment line with an odd number of quotes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.tables import cut

# COLMAP's camera models and their numbers of parameters.
CAMERA_MODELS = {
    "SIMPLE_PINHOLE": 3,
    "PINHOLE": 4,
    "SIMPLE_RADIAL": 4,
    "RADIAL": 5,
    "OPENCV": 8,
    "OPENCV_FISHEYE": 8,
    "FULL_OPENCV": 12,
    "FOV": 5,
    "SIMPLE_RADIAL_FISHEYE": 4,
    "RADIAL_FISHEYE": 5,
    "THIN_PRISM_FISHEYE": 12,
}
LAYOUTS = {
    "camera": ("camera_id", "camera_model", "width", "height", "params", "label"),
    "point3d": ("point3d_id", "x", "y", "z", "r", "g", "b", "error", "image_ids", "point2d_idxs"),
}
INT32, INT64 = 2**31 - 1, 2**63 - 1
INTEGER = r"^ *-?[0-9]+ *$"
DECIMAL = r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$"

LOADED = pa.schema(
    [
        ("record_id", pa.int64()),
        ("rec_type", pa.string()),
        ("reason", pa.string()),
        ("object_id", pa.int64()),
        ("camera_model", pa.string()),
        ("width", pa.int32()),
        ("height", pa.int32()),
        ("params", pa.list_(pa.float64())),
        ("label", pa.string()),
        ("xyz", pa.list_(pa.float64())),
        ("rgb", pa.list_(pa.int32())),
        ("point_error", pa.float64()),
        ("image_ids", pa.list_(pa.int64())),
        ("point2d_idxs", pa.list_(pa.int32())),
    ]
)
LOADED_DDL = (
    "record_id bigint, rec_type string, reason string, object_id bigint, camera_model string, width int, "
    "height int, params array<double>, label string, xyz array<double>, rgb array<int>, point_error double, "
    "image_ids array<bigint>, point2d_idxs array<int>"
)


class Index:
    """Field boundaries of a batch of records and which records are quoted wrongly."""

    def __init__(self, bodies: pa.Array):
        bodies = pc.fill_null(bodies.cast(pa.large_string()), "")
        ends = np.frombuffer(bodies.buffers()[1], dtype=np.int64, count=len(bodies) + bodies.offset + 1)[bodies.offset :]
        raw = bodies.buffers()[2]
        base = int(ends[0])
        self.data = np.frombuffer(raw, dtype=np.uint8)[base : int(ends[-1])] if raw is not None else np.zeros(0, np.uint8)
        at = ends - base
        n, size = len(bodies), len(self.data)
        quote = self.data == 34
        before = np.zeros(size + 1, dtype=np.int64)  # quotes before each byte
        np.cumsum(quote, out=before[1:])
        q, commas = np.flatnonzero(quote), np.flatnonzero(self.data == 44)
        row_q, row_c = (np.searchsorted(at, x, "right") - 1 for x in (q, commas))
        outside = (before[commas] - before[at[row_c]]) % 2 == 0
        cuts, row_cut = commas[outside], row_c[outside]

        self.count = np.bincount(row_cut, minlength=n) + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        total = int(self.first[-1])
        opens, closes = np.zeros(total, bool), np.zeros(total, bool)
        opens[self.first[:-1]], closes[self.first[1:] - 1] = True, True
        self.start, self.end = np.empty(total, np.int64), np.empty(total, np.int64)
        self.start[opens], self.start[~opens] = at[:-1], cuts + 1
        self.end[closes], self.end[~closes] = at[1:], cuts

        begins, stops = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        begins[self.start], stops[self.end] = True, True
        opening = (before[q] - before[at[row_q]]) % 2 == 0
        joined = np.zeros(len(q) + 1, bool)  # joined[i]: quote i follows quote i-1 directly
        joined[1:-1] = (np.diff(q) == 1) & (np.diff(row_q) == 0)
        fine = np.where(opening, begins[q] | joined[:-1], stops[q + 1] | joined[1:])
        self.misquoted = (before[at[1:]] - before[at[:-1]]) % 2 == 1
        self.misquoted[row_q[~fine]] = True

    def column(self, rows: np.ndarray, k: int) -> pa.Array:
        """The k-th field of these records, without its enclosing quotes."""
        i = self.first[rows] + k
        start, end = self.start[i].copy(), self.end[i].copy()
        quoted = end > start
        quoted[quoted] = self.data[start[quoted]] == 34
        start[quoted] += 1
        end[quoted] -= 1
        size = end - start
        offsets = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[where]))


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(bool)


def integers(texts: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether each text is an integer from low to high (0 or more)."""
    good = _matches(texts, INTEGER)
    kept = pc.if_else(pa.array(good), texts, "0")
    digits = pc.replace_substring_regex(pc.utf8_trim(kept, " "), r"^(-?)0+([0-9])", r"\1\2")
    width = pc.utf8_length(digits).to_numpy(zero_copy_only=False)
    fits = (width <= 18) | ((width == 19) & pc.and_(pc.less_equal(digits, str(INT64)), pc.invert(pc.starts_with(digits, "-"))).to_numpy(zero_copy_only=False))
    values = pc.if_else(pa.array(fits), digits, "0").cast(pa.int64()).to_numpy(zero_copy_only=False)
    return values, good & fits & (values >= low) & (values <= high)


def decimals(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether each text is a decimal that is finite as a double."""
    good = _matches(texts, DECIMAL)
    kept = pc.if_else(pa.array(good), pc.replace_substring_regex(pc.utf8_trim(texts, " "), r"^\+", ""), "0")
    try:
        values = kept.cast(pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # some number is beyond what a double holds
        values = np.array([float(t) for t in kept.to_pylist()], np.float64)
    return values, good & np.isfinite(values)


def _lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements of comma-separated lists, and the number of each list's elements; blank: none."""
    blank = pc.equal(pc.utf8_trim(texts, " "), "")
    parts = pc.split_pattern(pc.if_else(blank, None, texts), ",")
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(parts), sizes


def _each(good: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether all elements of each list are good."""
    bad = np.concatenate([[0], np.cumsum(~good)])
    ends = np.cumsum(sizes)
    return bad[ends] == bad[ends - sizes]


def _list_array(values: np.ndarray, sizes: np.ndarray, keep: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = values[np.repeat(keep, sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def _cameras(index: Index, rows: np.ndarray) -> tuple[np.ndarray, dict]:
    text = [index.column(rows, k) for k in range(6)]
    ids, ok = integers(text[0], 1, INT64)
    models = text[1].to_numpy(zero_copy_only=False)
    needs = pc.index_in(text[1].cast(pa.string()), value_set=pa.array(list(CAMERA_MODELS)))
    known = pc.is_valid(needs).to_numpy(zero_copy_only=False)
    needs = np.array(list(CAMERA_MODELS.values()))[pc.fill_null(needs, 0).to_numpy(zero_copy_only=False)]
    width, ok_w = integers(text[2], 1, INT32)
    height, ok_h = integers(text[3], 1, INT32)
    flat, sizes = _lists(text[4])
    params, ok_p = decimals(flat)
    ok &= known & ok_w & ok_h & (sizes == needs) & _each(ok_p, sizes)
    label = pc.replace_substring(text[5], '""', '"')
    keep = pa.array(ok)
    return ok, {
        "object_id": ids[ok],
        "camera_model": pa.array(models[ok], pa.string()),
        "width": width[ok],
        "height": height[ok],
        "params": _list_array(params, sizes, ok, pa.float64()),
        "label": label.filter(keep),
    }


def _points(index: Index, rows: np.ndarray) -> tuple[np.ndarray, dict]:
    text = [index.column(rows, k) for k in range(10)]
    ids, ok = integers(text[0], 1, INT64)
    xyz, rgb = [], []
    for t in text[1:4]:
        v, good = decimals(t)
        xyz.append(v)
        ok &= good
    for t in text[4:7]:
        v, good = integers(t, 0, 255)
        rgb.append(v)
        ok &= good
    error, good = decimals(text[7])
    ok &= good & (error >= 0)
    images, n_images = _lists(text[8])
    spots, n_spots = _lists(text[9])
    image_ids, ok_i = integers(images, 1, INT32)
    idxs, ok_s = integers(spots, 0, INT32)
    ok &= (n_images == n_spots) & _each(ok_i, n_images) & _each(ok_s, n_spots)
    three = np.full(int(ok.sum()), 3)
    every = np.ones(len(three), bool)
    return ok, {
        "object_id": ids[ok],
        "xyz": _list_array(np.stack(xyz, 1)[ok].ravel(), three, every, pa.float64()),
        "rgb": _list_array(np.stack(rgb, 1)[ok].ravel(), three, every, pa.int32()),
        "point_error": error[ok],
        "image_ids": _list_array(image_ids, n_images, ok, pa.int64()),
        "point2d_idxs": _list_array(idxs, n_spots, ok, pa.int32()),
    }


def parse_batch(batch: pa.RecordBatch, values: bool = True) -> Iterator[pa.RecordBatch]:
    """The valid records of a batch with their values, then the failing ones with a reason."""
    body = batch.column("body").cast(pa.large_string())
    skip = pc.fill_null(pc.match_substring_regex(body, r"^\s*(#|$)"), True)
    skip = pc.if_else(pc.fill_null(pc.match_substring_regex(body, r"^\s*$"), True), True, skip)
    batch = batch.filter(pc.invert(skip))
    index = Index(batch.column("body"))
    kinds = batch.column("rec_type").cast(pa.string())
    ids = batch.column("record_id").cast(pa.int64())
    reason = np.full(len(batch), None, dtype=object)
    reason[index.misquoted] = "quoting"
    wanted = np.zeros(len(batch), np.int64)
    for kind, fields in LAYOUTS.items():
        wanted[pc.fill_null(pc.equal(kinds, kind), False).to_numpy(zero_copy_only=False)] = len(fields)
    reason[~index.misquoted & (index.count != wanted)] = "column_count"
    for kind, read in (("camera", _cameras), ("point3d", _points)):
        rows = np.flatnonzero(pc.fill_null(pc.equal(kinds, kind), False).to_numpy(zero_copy_only=False) & (reason == None))  # noqa: E711
        if not len(rows):
            continue
        ok, columns = read(index, rows)
        reason[rows[~ok]] = "invalid_value"
        if values:
            good = pa.array(rows[ok])
            columns |= {"record_id": ids.take(good), "rec_type": kinds.take(good)}
            yield _batch(columns, len(good))
    failed = np.flatnonzero(reason != None)  # noqa: E711
    at = pa.array(failed)
    yield _batch({"record_id": ids.take(at), "rec_type": kinds.take(at), "reason": pa.array(reason[failed], pa.string())}, len(failed))


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    arrays = []
    for f in LOADED:
        c = columns.get(f.name)
        arrays.append(pa.nulls(n, f.type) if c is None else (c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=LOADED)


def parse_records(raw: DataFrame, values: bool = True) -> DataFrame:
    """Every record once: reason is null and the values are set, or reason says why it failed.

    values=False leaves out the values of the valid records and the valid records themselves.
    """
    narrow = raw.select("record_id", "rec_type", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield from parse_batch(b, values)

    return narrow.mapInArrow(run, LOADED_DDL)


def failing(raw: DataFrame) -> DataFrame:
    """(record_id, reason) of the records that fail, each once."""
    return parse_records(raw, values=False).filter("reason is not null").select("record_id", "reason").distinct()


def _loaded(raw: DataFrame, kind: str, columns: list) -> DataFrame:
    first = raw.groupBy("record_id").agg(F.min("loaded_at").alias("loaded_at"))
    rows = parse_records(raw.filter(F.col("rec_type") == kind)).filter("reason is null").dropDuplicates(["record_id"])
    return rows.join(first, rows.record_id.eqNullSafe(first.record_id)).select(rows.record_id, *columns, first.loaded_at)


def loaded_cameras(raw: DataFrame) -> DataFrame:
    return _loaded(raw, "camera", [F.col("object_id").alias("camera_id"), "camera_model", "width", "height", "params", "label"])


def loaded_points(raw: DataFrame) -> DataFrame:
    return _loaded(raw, "point3d", [F.col("object_id").alias("point3d_id"), "xyz", "rgb", "point_error", "image_ids", "point2d_idxs"])


def _quotes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(running number of quotes after each line, the last line up to each that surely ends outside quotes, -1 before).

    A comment with an odd number of quotes is such a line: as a comment it stays outside, within quotes it closes them.
    """
    n = len(lines)
    offsets = np.frombuffer(lines.buffers()[1], np.int64, count=n + 1 + lines.offset)[lines.offset :]
    raw = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    total = np.concatenate([[0], np.cumsum(raw == 34)])[offsets - offsets[0]]
    comment = pc.match_substring_regex(lines, r"^\s*#").to_numpy(zero_copy_only=False).astype(bool)
    reset = comment & (np.diff(total) % 2 == 1)
    return total[1:], np.maximum.accumulate(np.where(reset, np.arange(n), -1))


def _runs(b: pa.RecordBatch) -> list[tuple[int, int]]:
    """Runs of rows of one split."""
    file, block = b.column("file").to_numpy(), b.column("block").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    return [(int(a), int(z)) for a, z in zip(np.append(0, cuts), np.append(cuts, b.num_rows))]


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of lines: whether its end doesn't hang on its start, and the quotes that count for its end."""
    for b in batches:
        if b.num_rows:
            rows = []
            for a, z in _runs(b):
                total, last = _quotes(b.column("value").slice(a, z - a).cast(pa.large_string()))
                rows.append((b.column("file")[a].as_py(), b.column("block")[a].as_py(), b.column("n")[a].as_py(), int(last[-1] >= 0), int(total[-1] - (total[last[-1]] if last[-1] >= 0 else 0)) % 2))
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("file", "block", "n", "reset", "q"), zip(*rows))})


_PIECES = "file bigint, block bigint, seq bigint, begins boolean, ends boolean, body string"


def _record_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one split after another, in order: the records in them, and the pieces of those that cross their edges."""
    at, seq, odd, begins, open_ = None, 0, False, True, []  # split, pieces so far, within quotes, whether the piece begins a record, its lines

    def piece(ends: bool) -> pa.RecordBatch:
        cols = {"file": [at[0]], "block": [at[1]], "seq": [seq], "begins": [begins], "ends": [ends], "body": ["\n".join(open_)]}
        return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(cols.items(), (pa.int64(),) * 3 + (pa.bool_(),) * 2 + (pa.string(),))})

    def split(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal seq, odd, begins, open_
        lines = rows.column("value").cast(pa.large_string())
        total, last = _quotes(lines)
        after = np.where(last < 0, total + odd, total - total[np.maximum(last, 0)]) % 2  # parity of the quotes before each line end
        ends = np.flatnonzero(after == 0)
        odd = bool(after[-1])
        if not len(ends):
            open_ += lines.to_pylist()
            return
        open_ += lines.slice(0, ends[0] + 1).to_pylist()
        yield piece(True)
        seq, begins, open_ = seq + 1, True, []
        if len(ends) > 1:  # records that begin and end here: one line each, or several joined
            starts, stops = ends[:-1] + 1, ends[1:] + 1
            sizes = stops - starts
            body = lines.take(pa.array(starts))
            many = np.flatnonzero(sizes > 1)
            if len(many):
                texts = body.to_pylist()
                for i in many:
                    texts[i] = "\n".join(lines.slice(starts[i], sizes[i]).to_pylist())
                body = pa.array(texts)
            m = len(starts)
            yes = pa.array(np.ones(m, bool))
            yield pa.RecordBatch.from_pydict({"file": pa.array(np.full(m, at[0])), "block": pa.array(np.full(m, at[1])), "seq": pa.array(seq + np.arange(m)), "begins": yes, "ends": yes, "body": body.cast(pa.string())})
            seq += m
        open_ = lines.slice(ends[-1] + 1).to_pylist()

    for b in batches:
        if not b.num_rows:
            continue
        for lo, hi in _runs(b):
            here = (b.column("file")[lo].as_py(), b.column("block")[lo].as_py())
            if here != at:
                if open_:
                    yield piece(False)
                at, seq, open_ = here, 0, []
                odd = bool(b.column("inside")[lo].as_py())
                begins = not odd
            yield from split(b.slice(lo, hi - lo))
    if open_:
        yield piece(False)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, body): the records of delimited text files below path; record_id is a hash of the record's place."""
    where = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.option("lineSep", "\n").text(path).select(*where, "value")
    runs = lines.withColumn("n", F.monotonically_increasing_id()).mapInArrow(_parities, "file bigint, block bigint, n bigint, reset bigint, q bigint")
    order = Window.partitionBy("file").orderBy("block", "n")
    after = runs.withColumn("resets", F.sum("reset").over(order)).withColumn("odd", F.sum("q").over(Window.partitionBy("file", "resets").orderBy("block", "n")) % 2)
    before = after.select("file", "block", F.lag("odd").over(order).alias("odd"), F.coalesce(F.lag("block").over(order) != F.col("block"), F.lit(False)).alias("first"))
    inside = before.filter("first and odd = 1").select("file", "block", F.lit(True).alias("inside"))  # at most a row of 17 bytes for each split
    pieces = cut(lines.join(F.broadcast(inside), ["file", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False))).mapInArrow(_record_ends, _PIECES))
    edge = pieces.filter("not (begins and ends)")  # at most two of each split
    number = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("block", "seq"))
    whole = edge.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "body"))).alias("parts"))
    joined = whole.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["seq"].alias("seq"), F.array_join("parts.body", "\n").alias("body"))
    rows = pieces.filter("begins and ends").select("file", "block", "seq", "body").unionByName(joined)
    return rows.select(F.xxhash64("file", "block", "seq").alias("record_id"), "body")


def load_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of raw files of one kind: with reason null the loaded ones, else the rejected."""
    return parse_records(read_records(spark, path).withColumn("rec_type", F.lit(kind)))
