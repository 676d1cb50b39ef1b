"""Sweeps and comparison tables: a run per override, skipping runs that are stored.

A manifest is {base: path or dict, runs: [{name, overrides: {dotted key: value}}]}.
`run` is any function from a configuration to a one-row DataFrame of metrics.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.config import key_of, load_config, override
from waymark.sources.lists import normal_score


def sweep(spark: SparkSession, manifest: dict, run: Callable[[dict], DataFrame], store: str, only: list[str] | None = None, skip: list[str] | None = None, rerun: bool = False) -> DataFrame:
    """All stored metrics of the manifest's runs, with `run` and `config_key`. One job after another, as runs may be large."""
    base = manifest["base"] if isinstance(manifest["base"], dict) else load_config(manifest["base"])
    parts = []
    for r in manifest["runs"]:
        if (only and r["name"] not in only) or (skip and r["name"] in skip):
            continue
        config = override(base, r.get("overrides", {}))
        at = os.path.join(store, r["name"], key_of(config))
        if rerun or not os.path.exists(os.path.join(at, "_SUCCESS")):
            run(config).write.mode("overwrite").parquet(at)
        parts.append(spark.read.parquet(at).withColumns({"run": F.lit(r["name"]), "config_key": F.lit(key_of(config))}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def collected(evaluated: DataFrame, thresholds: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., score): of each method the evaluation file's score, else that of its thresholds, else its success rate."""
    a = evaluated.select(*keys, normal_score(F.col("score")).alias("a"))
    b = thresholds.select(*keys, F.col("recall").alias("b"))
    c = summaries.select(*keys, F.col("success_rate").alias("c"))
    return a.join(b, keys, "full").join(c, keys, "full").select(*keys, F.coalesce("a", "b", "c").alias("score"))
