"""Online localization with a pruned landmark memory, as a stream and as a batch.

`Memory.step` takes one frame and returns its result row: localize against the
memory, integrate the frame's observations if it was localized, forget what is
old, seldom seen or over budget. The batch form folds a sequence's frames in
order; the streaming form keeps the same object as the state of its key, so
both give the same rows. Frames that arrive out of order inside a micro-batch
are sorted; a frame not newer than the last one is reported as `late` and
leaves the memory as it is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.operators.pnp import Ransac, solve


@dataclass(frozen=True)
class Online:
    """Settings; `literal` forgets, after each integrated frame, every landmark the frame didn't touch."""

    bootstrap: int = 5
    merge_radius: float = 0.08
    merge_cosine: float = 0.70
    min_obs: int = 1
    max_age: int = 20
    most: int = 5000
    min_staticness: float = 0.0
    min_cosine: float = 0.5
    use_prior: bool = False  # match with the last frame's pose as prior; a failed frame leaves none
    prior_edge: float = 60.0  # pixels from the prior's projection at which a landmark is closed
    prior_weight: float = 0.5
    margin: float = 0.0
    integrate_pose: str = "pred"  # or "gt"
    on_success: bool = True
    literal: bool = False
    ransac: Ransac = field(default_factory=lambda: Ransac(iterations=200))


class Memory:
    """Landmarks of one sequence: position, mean descriptor (as sums), times seen."""

    FIELDS = ("xyz", "sums", "squares", "errors", "ids", "n", "last")

    def __init__(self, dim: int):
        self.xyz, self.sums = np.zeros((0, 3)), np.zeros((0, dim))
        self.squares, self.errors = np.zeros(0), np.zeros(0)  # sums of |d|^2 and of pixel errors
        self.ids, self.n, self.last = (np.zeros(0, np.int64) for _ in range(3))
        self.next_id, self.frames, self.last_seq = 0, 0, None
        self.prior: list[float] | None = None

    def mus(self) -> np.ndarray:
        return self.sums / (np.linalg.norm(self.sums, axis=1, keepdims=True) + 1e-8)

    def staticness(self) -> np.ndarray:
        """By times seen, root mean square distance to the mean descriptor and mean pixel error; views count as one."""
        n = np.maximum(self.n, 1)
        mu = self.mus()
        spread = np.sqrt(np.maximum(0.0, self.squares / n - 2 * (mu * self.sums).sum(axis=1) / n + (mu * mu).sum(axis=1)))
        return np.clip(0.45 * np.tanh(self.n / 6.0) + 0.25 * np.exp(-spread) + 0.2 * np.exp(-self.errors / n) + 0.1 * 0.35, 0.0, 1.0)

    def _keep(self, at) -> None:
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f)[at])

    def add(self, world: np.ndarray, desc: np.ndarray, seq: int, how: Online, uv: np.ndarray | None = None, pose: np.ndarray | None = None, cam: np.ndarray | None = None) -> list[int]:
        """Merge each observation into the best landmark within reach, or start a new one; in the order given. Gives their ids.

        With pixels, pose and camera, an observation that merges also adds its distance from the landmark in the image.
        """
        went, size = [], len(self.xyz)
        for f in self.FIELDS:
            old = getattr(self, f)
            setattr(self, f, np.concatenate([old, np.zeros((len(world), *old.shape[1:]), old.dtype)]))
        mu = self.mus()
        for i, (p, d) in enumerate(zip(world, desc)):
            k = -1
            if size:
                dist = np.linalg.norm(self.xyz[:size] - p, axis=1)
                sim = mu[:size] @ d
                value = np.where((dist <= how.merge_radius) & (sim >= how.merge_cosine), sim - 0.25 * dist, -np.inf)
                k = int(value.argmax())
                k = k if value[k] > -1 else -1
            if k < 0:
                k, size = size, size + 1
                self.ids[k], self.next_id = self.next_id, self.next_id + 1
            elif uv is not None:
                local = pose[:3, :3].T @ (self.xyz[k] - pose[:3, 3])
                if local[2] > 1e-6:
                    self.errors[k] += float(np.hypot(cam[0] * local[0] / local[2] + cam[2] - uv[i, 0], cam[1] * local[1] / local[2] + cam[3] - uv[i, 1]))
            self.n[k] += 1
            self.xyz[k] += (p - self.xyz[k]) / self.n[k]
            self.sums[k] += d
            self.squares[k] += d @ d
            self.last[k] = seq
            mu[k] = self.sums[k] / (np.linalg.norm(self.sums[k]) + 1e-8)
            went.append(int(self.ids[k]))
        self._keep(slice(0, size))
        return went

    def prune(self, seq: int, how: Online) -> None:
        static = self.staticness()
        keep = np.flatnonzero((self.n >= how.min_obs) & (seq - self.last <= how.max_age) & (static >= how.min_staticness))
        if how.literal:
            keep = keep[self.last[keep] == seq]
        if len(keep) > how.most:
            order = np.lexsort((self.ids[keep], -self.n[keep], -self.last[keep], -static[keep]))
            keep = np.sort(keep[order[: how.most]])
        self._keep(keep)

    def gate(self, uv: np.ndarray, cam: np.ndarray, how: Online) -> np.ndarray:
        """(anchors, landmarks): 1 less the share of `prior_edge` by which the prior's projection is off; -1 where closed."""
        t = np.asarray(self.prior).reshape(4, 4)
        local = (self.xyz - t[:3, 3]) @ t[:3, :3]
        z = np.where(local[:, 2] > 1e-6, local[:, 2], 1.0)
        at = np.stack([cam[0] * local[:, 0] / z + cam[2], cam[1] * local[:, 1] / z + cam[3]], axis=1)
        off = np.linalg.norm(uv[:, None, :] - at[None], axis=2)
        return np.where((local[:, 2] > 1e-6)[None] & (off <= how.prior_edge), 1 - off / how.prior_edge, -1.0)

    def match(self, desc: np.ndarray, how: Online, uv: np.ndarray | None = None, cam: np.ndarray | None = None) -> list[tuple[int, int]]:
        """(anchor, landmark row): best landmark by cosine with a margin to the second, one to one.

        With a pose prior, landmarks that it puts elsewhere are closed and nearness adds to the cosine.
        """
        if not len(self.xyz) or not len(desc):
            return []
        sims = desc @ self.mus().T
        if how.use_prior and self.prior is not None and uv is not None:
            gate = self.gate(uv, cam, how)
            sims = np.where((gate < -0.5) | (sims < how.min_cosine), -1e9, sims + how.prior_weight * gate)
        best = sims.argmax(axis=1)
        top = sims[np.arange(len(desc)), best]
        if sims.shape[1] > 1:
            second = np.partition(sims, sims.shape[1] - 2, axis=1)[:, -2]
        else:
            second = np.full(len(desc), -np.inf)
        good = np.flatnonzero((top >= how.min_cosine) & (top - second >= how.margin))
        used, out = set(), []
        for i in good[np.lexsort((good, -top[good]))]:
            if best[i] not in used:
                used.add(best[i])
                out.append((int(i), int(best[i])))
        return out

    def step(self, frame: dict, how: Online) -> dict:
        """frame: seq, uv (n, 2), z (n), desc (n, dim), camera (8), gt (16 numbers or None)."""
        seq = int(frame["seq"])
        row = {"seq": seq, "mode": "online", "success": False, "num_matches": 0, "num_inliers": 0, "num_candidates": len(self.ids), "T_wc": None, "num_integrated": 0}
        if self.last_seq is not None and seq <= self.last_seq:
            return row | {"mode": "late"}
        self.last_seq = seq
        uv, z, desc, cam = (np.asarray(frame[c], dtype=np.float64) for c in ("uv", "z", "desc", "camera"))
        gt = frame["gt"]
        if self.frames < how.bootstrap:
            row |= {"mode": "bootstrap", "success": gt is not None, "T_wc": gt}
        else:
            pairs = self.match(desc, how, uv, cam)
            row["num_matches"] = len(pairs)
            if len(pairs) >= 4:
                a, b = (np.array(x) for x in zip(*pairs))
                got = solve(uv[a], self.xyz[b], cam, how.ransac, seq)
                row |= {"success": got["success"], "num_inliers": got["num_inliers"], "T_wc": got["T_wc"]}
        self.frames += 1
        self.prior = row["T_wc"] if row["success"] else None
        pose = gt if row["mode"] == "bootstrap" or how.integrate_pose == "gt" else row["T_wc"]
        if pose is not None and (row["success"] or not how.on_success):
            good = np.isfinite(z) & (z > 1e-4)
            t = np.asarray(pose).reshape(4, 4)
            local = np.stack([(uv[good, 0] - cam[2]) / cam[0] * z[good], (uv[good, 1] - cam[3]) / cam[1] * z[good], z[good]], axis=1)
            self.add(local @ t[:3, :3].T + t[:3, 3], desc[good], seq, how, uv[good], t, cam)
            row["num_integrated"] = int(good.sum())
            self.prune(seq, how)
        return row


_KIND = {"seq": "bigint", "mode": "string", "success": "boolean", "num_matches": "int", "num_inliers": "int", "num_candidates": "int", "T_wc": "array<double>", "num_integrated": "int"}
DDL = "sequence_id bigint, " + ", ".join(f"{k} {v}" for k, v in _KIND.items())


def _frames(pdf: pd.DataFrame) -> Iterator[dict]:
    for r in pdf.sort_values("seq", kind="stable").itertuples():
        desc = np.array([np.asarray(d) for d in r.desc], dtype=np.float64)
        uv = np.array([np.asarray(p) for p in r.uv], dtype=np.float64).reshape(-1, 2)
        yield {"seq": r.seq, "uv": uv, "z": np.asarray(r.z, dtype=np.float64), "desc": desc, "camera": np.asarray(r.camera), "gt": None if r.gt is None else [float(x) for x in r.gt]}


def _rows(key: int, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{"sequence_id": key} | r for r in rows], columns=["sequence_id", *_KIND])


COLUMNS = ["sequence_id", "seq", "uv", "z", "desc", "camera", "gt"]


def run_batch(frames: DataFrame, how: Online = Online(), dim: int = 64) -> DataFrame:
    """Result rows of every sequence. frames: COLUMNS, one row a frame (uv array<array>, desc array<array>)."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        memory = Memory(dim)
        return _rows(int(key[0]), [memory.step(f, how) for f in _frames(pdf)])

    return frames.select(*COLUMNS).groupBy("sequence_id").applyInPandas(fold, DDL)


def run_stream(frames: DataFrame, how: Online = Online(), dim: int = 64) -> DataFrame:
    """The same rows from a streaming DataFrame; the memory is the state of its sequence."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = pickle.loads(state.get[0]) if state.exists else Memory(dim)
        pdf = pd.concat(list(parts))
        rows = [memory.step(f, how) for f in _frames(pdf)]
        state.update((pickle.dumps(memory),))
        yield _rows(int(key[0]), rows)

    return frames.select(*COLUMNS).groupBy("sequence_id").applyInPandasWithState(update, DDL, "memory binary", "append", GroupStateTimeout.NoTimeout)


__all__ = ["Memory", "Online", "run_batch", "run_stream"]
