"""Configuration: nested YAML or JSON, overrides by dotted keys, typed sections."""

from __future__ import annotations

import copy
import hashlib
import json
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import SparkSession

from waymark.tables import small_text


def load_config(path: str, spark: SparkSession | None = None) -> dict:
    """A YAML or JSON file; with a session, from any file system that Spark knows."""
    if spark is not None:
        text = small_text(spark, path)
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def override(config: dict, changes: dict[str, Any]) -> dict:
    """A copy with each `a.b.c` set; missing levels are made."""
    out = copy.deepcopy(config)
    for key, value in changes.items():
        *path, last = key.split(".")
        at = out
        for p in path:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        at[last] = value
    return out


def key_of(config: dict) -> str:
    """SHA-1 of the whole configuration, for cached maps and results."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


class _Section:
    @classmethod
    def of(cls, config: dict):
        """From the matching section; keys that aren't known are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (config or {}).items() if k in known})


# The names and defaults of the settings below.


@dataclass(frozen=True)
class Anchors(_Section):
    alpha: float = 0.6
    beta: float = 0.4
    use_stability: bool = True
    topk: int = 200
    grid_cells: tuple = (4, 4)
    nms_radius: int = 1


@dataclass(frozen=True)
class Landmarks(_Section):
    merge_radius_m: float = 0.08
    merge_cos_sim: float = 0.70
    manifold_rank: int = 2
    min_obs: int = 2
    min_staticness: float = 0.0
    max_obs_per_landmark: int = 20
    max_colmap_point_error: float = 8.0
    min_colmap_track_len: int = 2


@dataclass(frozen=True)
class Matching(_Section):
    topk_landmarks: int = 10
    lambdas: tuple = (1.0, 1.2, 0.6, 0.3, 0.5)
    scorer: str = "residual"
    min_cosine_sim: float = -1.0
    min_score: float = -1e9
    ratio_margin: float = 0.0
    materialize_topk_per_anchor: int = 4
    max_materialized_landmarks: int | None = None
    adaptive_min_cosine: bool = False
    adaptive_cosine_margin: float = 0.2
    min_match_guarantee: int = 0
    max_matches: int = 256
    group_verify_min_inliers: int = 24
    group_verify_hard_inliers: int = 40


@dataclass(frozen=True)
class Pnp(_Section):
    reproj_error_px: float = 8.0
    iterations: int = 1000
    multi_pass: bool = False


@dataclass(frozen=True)
class Retrieval(_Section):
    topk_db_images: int = 20
    max_candidate_landmarks: int | None = 4000
    max_index_landmarks_per_image: int | None = None
    verify_image_batch_size: int = 1
    verify_image_schedule: tuple = (4, 10, 20)
    grouping: str = "covisibility"


def suggested(n_landmarks: int) -> Matching:
    """Settings by the size of the map: more candidates and a cap on loading for large ones."""
    if n_landmarks > 500_000:
        return Matching(topk_landmarks=32, max_materialized_landmarks=4000)
    return Matching(topk_landmarks=16 if n_landmarks > 50_000 else 10)
