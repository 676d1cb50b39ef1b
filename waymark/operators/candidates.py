"""Candidate landmarks of queries from retrieved images: order, budgets, groups, stages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.groups import by_key


def retrieved(pairs: DataFrame, most: int) -> DataFrame:
    """The first `most` retrieved images of every query; rnk starts at 0."""
    return pairs.filter(F.col("rnk") < most)


def all_pairs(queries: DataFrame, database: DataFrame, group: str, most: int) -> DataFrame:
    """(query_id, frame_id, rnk): every query of a group with the group's first images. Joined by group, bounded by `most`."""
    w = Window.partitionBy(group).orderBy("frame_id")
    first = database.select(group, "frame_id").withColumn("rnk", F.row_number().over(w) - 1).filter(F.col("rnk") < most)
    return queries.select(group, "query_id").join(first, group).select("query_id", "frame_id", "rnk")


def expand(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, rnk, frame_id, lm_idx): landmarks seen in the retrieved images."""
    return pairs.join(index.select("frame_id", "lm_idx"), "frame_id")


def first_seen(expanded: DataFrame) -> DataFrame:
    """(query_id, lm_idx, rnk, pos): each landmark at the first retrieved image that has it.

    pos is its place in the order of images and landmarks, counted with the repetitions.
    """
    w = Window.partitionBy("query_id", "lm_idx").orderBy("rnk")
    order = Window.partitionBy("query_id").orderBy("rnk", "lm_idx")
    return expanded.select("query_id", "lm_idx", "rnk", F.row_number().over(w).alias("k"), F.row_number().over(order).alias("pos")).filter("k = 1").drop("k")


def budgets(expanded: DataFrame, most: int, images: Column | int) -> DataFrame:
    """At most ceil(most / images) landmarks from each retrieved image, first occurrence only."""
    each = F.ceil(F.lit(most) / images)
    w = Window.partitionBy("query_id", "rnk").orderBy("lm_idx")
    return first_seen(expanded).drop("pos").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each)


def covisibility(expanded: DataFrame) -> DataFrame:
    """(query_id, f1, f2, n): landmarks that two retrieved images of a query share.

    Pairs exist only among the retrieved images of one query, whose number the retrieval bounds.
    """
    seen = expanded.groupBy("query_id", "lm_idx").agg(F.array_sort(F.collect_set("frame_id")).alias("f")).filter("size(f) > 1")  # at most the retrieved images
    pairs = F.expr("flatten(transform(f, (a, i) -> transform(slice(f, i + 2, size(f)), b -> named_struct('f1', a, 'f2', b))))")
    return seen.select("query_id", F.explode(pairs).alias("p")).groupBy("query_id", F.col("p.f1").alias("f1"), F.col("p.f2").alias("f2")).agg(F.count("*").alias("n"))


def groups_in_order(pairs: DataFrame, size: int) -> DataFrame:
    """Sequential batches of the retrieved images."""
    return pairs.withColumn("group_no", F.floor(F.col("rnk") / size).cast("int"))


def covisibility_groups(expanded: DataFrame, size: int) -> DataFrame:
    """(query_id, frame_id, group_no, place): greedy groups of images that see the same landmarks.

    A group starts with the best-ranked image left and takes, one after another, the image that shares most
    landmarks with the union of the group so far (the better-ranked on a tie), up to `size` images.
    One query's retrieved images meet in one task; their number is bounded by the retrieval depth.
    """

    def run(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], set] = {}
        for rnk, frame, lm in zip(*(table.column(c).to_pylist() for c in ("rnk", "frame_id", "lm_idx"))):
            seen.setdefault((rnk, frame), set()).add(lm)
        rest = sorted(seen)
        rows, no = [], 0
        while rest:
            group = [rest.pop(0)]
            union = set(seen[group[0]])
            while rest and len(group) < size:
                best = max(range(len(rest)), key=lambda i: (len(seen[rest[i]] & union), -i))
                group.append(rest.pop(best))
                union |= seen[group[-1]]
            rows += [(f, no, i) for i, (_, f) in enumerate(group)]
            no += 1
        q = table.column("query_id")[0].as_py()
        return pa.table({"query_id": pa.array([q] * len(rows), pa.int64()), "frame_id": pa.array([r[0] for r in rows], pa.int64()), "group_no": pa.array([r[1] for r in rows], pa.int32()), "place": pa.array([r[2] for r in rows], pa.int32())})

    return expanded.select("query_id", "rnk", "frame_id", "lm_idx").transform(by_key, ["query_id"], run, "query_id bigint, frame_id bigint, group_no int, place int")


def stage_schedule(totals: DataFrame, limits: list[int]) -> DataFrame:
    """(query_id, stages): distinct sorted stage sizes, none above the number of images, which is the last."""
    good = [x for x in limits if isinstance(x, int) and x > 0]
    each = F.array(*[F.least(F.lit(x).cast("bigint"), F.col("n_images")) for x in good], F.col("n_images"))
    return totals.select("query_id", F.array_sort(F.array_distinct(each)).alias("stages"))


def stage_of_groups(groups: DataFrame, schedule: DataFrame) -> DataFrame:
    """(query_id, group_no, images_so_far, stage): the first stage whose limit isn't reached before the group.

    Images are charged by group, so a group may carry a stage beyond its limit.
    """
    per = groups.groupBy("query_id", "group_no").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("query_id").orderBy("group_no").rowsBetween(Window.unboundedPreceding, 0))
    counted = per.withColumn("images_so_far", so_far).join(schedule, "query_id")
    before = F.col("images_so_far") - F.col("n")
    return counted.withColumn("stage", F.array_min(F.filter("stages", lambda s: before < s))).select("query_id", "group_no", "images_so_far", "stage")


def restrict_index(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Index entries of retrieved images only."""
    return index.join(pairs.select("frame_id").distinct(), "frame_id", "left_semi")


def preferred(rows: DataFrame, key: str, flag: str, least: int = 2) -> DataFrame:
    """Rows flagged as preferred where a key has at least `least` of them, else all of the key's rows."""
    n = F.count_if(F.col(flag)).over(Window.partitionBy(key))
    return rows.withColumn("__n", n).filter((F.col("__n") < least) | F.col(flag)).drop("__n")


def pending(queries: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Queries without a stored result."""
    return queries.join(results, key, "left_anti")
