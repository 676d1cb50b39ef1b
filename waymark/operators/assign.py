"""One-to-one assignment of anchors to landmarks.

Greedy assignment takes edges by score, then by ids, and skips used ends. With
a strict total order this equals taking, in rounds, every edge that is the best
left at both of its ends; the rounds work on all queries at once and on edges
spread by (query, end), so a query of any size is no single task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.groups import by_key
from waymark.tables import cut


def greedy_rounds(edges: DataFrame, query: str, left: str, right: str, score: str, rounds: int = 1000) -> DataFrame:
    """The greedy one-to-one edges, by rounds of locally best edges. Null and NaN scores are no edges.

    What is left after `rounds` (long chains of ties) is finished by the sorted pass of `greedy`.
    """
    order = (F.desc(score), left, right)
    rest = cut(edges.filter(F.col(score).isNotNull() & ~F.isnan(score)).select(query, left, right, score))
    chosen = None
    for _ in range(rounds):
        ranked = rest.withColumns({"__l": F.row_number().over(Window.partitionBy(query, left).orderBy(*order)), "__r": F.row_number().over(Window.partitionBy(query, right).orderBy(*order))})
        best = cut(ranked.filter("__l = 1 and __r = 1").drop("__l", "__r"))
        chosen = best if chosen is None else chosen.unionByName(best)
        rest = cut(rest.join(best.select(query, left), [query, left], "left_anti").join(best.select(query, right), [query, right], "left_anti"))
        if rest.isEmpty():
            return chosen
    last = greedy(rest, query, left, right, score)
    return last if chosen is None else chosen.unionByName(last)


def greedy(edges: DataFrame, query: str, left: str, right: str, score: str) -> DataFrame:
    """The same edges by one sorted pass over each query; for queries whose edges fit a task (budgeted candidates)."""
    narrow = edges.filter(F.col(score).isNotNull() & ~F.isnan(score)).select(query, left, right, score)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(score, "descending"), (left, "ascending"), (right, "ascending")])
        used_l, used_r, keep = set(), set(), []
        for i, (a, b) in enumerate(zip(table.column(left).to_pylist(), table.column(right).to_pylist())):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                keep.append(i)
        return table.take(pa.array(keep, pa.int64()))

    return by_key(narrow, [query], run, narrow.schema)


def capped(rows: DataFrame, query: str, score: str, most: int, *ids: str) -> DataFrame:
    """The best `most` matches of each query."""
    w = Window.partitionBy(query).orderBy(F.desc(score), *ids)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def fill_matches(matches: DataFrame, candidates: DataFrame, query: str, left: str, right: str, score: str, wanted: int) -> DataFrame:
    """Fallback matches for queries with fewer than `wanted`: anchors in order, each with its best candidate whose landmark is free."""
    have = matches.groupBy(query).agg(F.count("*").alias("n"), F.collect_set(right).alias("used"))
    short = candidates.join(have, query, "left").filter(F.coalesce("n", F.lit(0)) < wanted).select(query, left, right, score, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("used", F.array().cast(f"array<{dict(candidates.dtypes)[right]}>")).alias("used"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(left, "ascending"), (score, "descending"), (right, "ascending")])
        used, n, done, keep = set(table.column("used")[0].as_py()), table.column("n")[0].as_py(), None, []
        for i, (a, b) in enumerate(zip(table.column(left).to_pylist(), table.column(right).to_pylist())):
            if n >= wanted:
                break
            if a != done and b not in used:
                used.add(b)
                keep.append(i)
                done, n = a, n + 1
        return table.take(pa.array(keep, pa.int64())).select([query, left, right, score])

    added = by_key(short, [query], run, matches.select(query, left, right, score).schema)
    return matches.select(query, left, right, score).unionByName(added)
