"""SQL names for the functions, and a data source and table function for the formats.

After `register(spark)`: `SELECT wm_rotation_error(a, b)`, `SELECT * FROM
wm_retrieval_line('q d1 d2')`, `spark.read.format("colmap").option("table",
"points").load(folder)`.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from waymark.sources import colmap


_SUM = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0d, (s, x) -> s + x)"
_INNER = "(" + " + ".join(f"a[{4 * i + j}] * b[{4 * i + j}]" for i in range(3) for j in range(3)) + ")"
_MOVED = [f"-(t[{i}] * t[3] + t[{4 + i}] * t[7] + t[{8 + i}] * t[11])" for i in range(3)]

#: SQL functions over built-in expressions: name -> (parameters, type, body).
FUNCTIONS = {
    # null for null, empty, zero or unequally long vectors
    "wm_cosine": (
        "a array<double>, b array<double>",
        "double",
        f"case when size(a) = size(b) and size(a) > 0 then {_SUM.format('a', 'b')} / nullif(sqrt({_SUM.format('a', 'a')}) * sqrt({_SUM.format('b', 'b')}), 0d) end",
    ),
    # degrees between the rotations of two poses of 16 numbers
    "wm_rotation_error": ("a array<double>, b array<double>", "double", f"case when a is not null and b is not null then degrees(acos(greatest(-1d, least(1d, ({_INNER} - 1) / 2)))) end"),
    "wm_invert_pose": (
        "t array<double>",
        "array<double>",
        "case when t is not null then array(" + ", ".join(f"t[{i}], t[{4 + i}], t[{8 + i}], {_MOVED[i]}" for i in range(3)) + ", 0d, 0d, 0d, 1d) end",
    ),
}


class RetrievalLine:
    """Rows of one line of retrieval pairs; nothing for blank lines and comments."""

    def eval(self, line: str):
        t = (line or "").split()
        if len(t) < 2 or t[0].startswith("#"):
            return
        names = t[1:]
        if len(t) == 3:
            try:
                float(t[2])
                names = t[1:2]
            except ValueError:
                pass
        for i, n in enumerate(names):
            yield t[0], n, i


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ModelReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.table = options["path"], options.get("table", "points")

    def partitions(self):
        name = {"points": "points3D"}.get(self.table, self.table) + ".bin"
        root = [os.path.join(self.folder, name)]
        inner = sorted(os.path.join(self.folder, d, name) for d in os.listdir(self.folder) if os.path.isdir(os.path.join(self.folder, d)))
        return [_Part(p) for p in root + inner if os.path.exists(p)]

    def read(self, partition: _Part):
        decode = {"cameras": colmap.decode_cameras, "images": colmap.decode_images, "points": colmap.decode_points}[self.table]
        with open(partition.path, "rb") as f:
            yield from decode(f.read())


class ColmapSource(DataSource):
    """Binary models: a folder, or a folder of model folders, one task for each model."""

    @classmethod
    def name(cls) -> str:
        return "colmap"

    def schema(self) -> str:
        return {"cameras": colmap.CAMERAS, "images": colmap.IMAGES, "points": colmap.POINTS}[self.options.get("table", "points")]

    def reader(self, schema) -> DataSourceReader:
        return _ModelReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    spark.udtf.register("wm_retrieval_line", udtf(RetrievalLine, returnType="query_name string, db_name string, pos int"))
    spark.dataSource.register(ColmapSource)
