"""Tracks: chains of mutual nearest anchors over consecutive frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.operators.groups import by_key


def mutual_pairs(a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of rows that are each other's most similar, best first."""
    if not len(a) or not len(b):
        return []
    s = a @ b.T
    forth, back = s.argmax(axis=1), s.argmax(axis=0)
    i = np.flatnonzero((back[forth] == np.arange(len(a))) & (s[np.arange(len(a)), forth] >= least))
    out = [(int(x), int(forth[x]), float(s[x, forth[x]])) for x in i]
    return sorted(out, key=lambda t: (-t[2], t[0], t[1]))


def build_tracks(anchors: DataFrame, least: float, sequence: str = "sequence_id") -> DataFrame:
    """(sequence, track_id, seq, anchor_index, alive): a track goes on while its last anchor has a mutual nearest in the next frame.

    anchors: sequence, seq, anchor_index, desc. An ordered fold over each sequence, whose
    anchors a task holds together; sequences run in parallel. A frame without anchors ends all tracks.
    """
    kind = dict(anchors.dtypes)[sequence]

    def run(table: pa.Table) -> pa.Table:
        seqs = table.column("seq").to_numpy()
        index = table.column("anchor_index").to_numpy()
        desc = table.column("desc").to_pylist()
        rows, before, owner, last, new = [], np.zeros((0, 1)), [], None, 0
        final: dict[int, int] = {}
        for s in np.unique(seqs):
            at = np.flatnonzero(seqs == s)
            d = np.array([desc[i] for i in at], dtype=np.float64)
            ids = [-1] * len(at)
            if last is not None and s == last + 1:
                for i, j, _ in mutual_pairs(before, d, least):
                    ids[j] = owner[i]
            for j in range(len(at)):
                if ids[j] < 0:
                    ids[j], new = new, new + 1
                rows.append((ids[j], int(s), int(index[at[j]])))
                final[ids[j]] = int(s)
            before, owner, last = d, ids, s
        alive = [final[t] == last for t, _, _ in rows]
        q = table.column(sequence)[0].as_py()
        return pa.table({sequence: pa.array([q] * len(rows), table.schema.field(sequence).type), "track_id": pa.array([r[0] for r in rows], pa.int64()), "seq": pa.array([r[1] for r in rows], pa.int64()), "anchor_index": pa.array([r[2] for r in rows], pa.int32()), "alive": pa.array(alive)})

    return anchors.select(sequence, "seq", "anchor_index", "desc").transform(by_key, [sequence], run, f"{sequence} {kind}, track_id bigint, seq bigint, anchor_index int, alive boolean", ["seq", "anchor_index"])


def mutual_within(a: DataFrame, b: DataFrame, group: str, left: str, right: str, least: float) -> DataFrame:
    """Mutual nearest pairs inside each group, by built-in expressions: candidates (group, left, right, sim) ranked both ways."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    pairs = a.join(b, group)
    forth = Window.partitionBy(group, left).orderBy(F.desc("sim"), right)
    back = Window.partitionBy(group, right).orderBy(F.desc("sim"), left)
    return pairs.withColumns({"f": F.row_number().over(forth), "g": F.row_number().over(back)}).filter((F.col("f") == 1) & (F.col("g") == 1) & (F.col("sim") >= least)).drop("f", "g")
