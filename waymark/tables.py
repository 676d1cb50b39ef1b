"""Reading tables, cutting lineage and other session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their path has it already."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="waymark-"), "waymark.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((_ROOT / "waymark").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir` (one file or one folder)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; where that is unset, on one machine only, a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = os.path.join(tempfile.gettempdir(), f"waymark-checkpoint-{os.getuid()}")
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, for tables that are written there and read again."""
    return f"{shared(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system."""
    for p in paths:
        at, fs = _at(spark, p)
        fs.delete(at, True)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file into any file system that Spark knows."""
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(data))
    out.close()


def small_text(spark: SparkSession, path: str) -> str:
    """The text of one small file, such as a configuration or a manifest."""
    return spark.read.text(path, wholetext=True).first()[0]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def usable_vector(c: Column, dim: int) -> Column:
    """True for `dim` finite entries, not all of them zero; False otherwise, also for null."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) == dim) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))
