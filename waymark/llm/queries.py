"""Queries of the operators in this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.llm import astime, bpe, mixing, reading, topn, vectors
from waymark.tables import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, the SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_SIMILAR = """
WITH a AS (SELECT DISTINCT anchor_id, descriptor::DOUBLE[] AS x FROM anchors
  WHERE len(descriptor) = 64 AND len(list_filter(descriptor, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND len(list_filter(descriptor, lambda v: v <> 0)) > 0),
b AS (SELECT DISTINCT landmark_id, mu::DOUBLE[] AS y FROM landmarks
  WHERE len(mu) = 64 AND len(list_filter(mu, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND len(list_filter(mu, lambda v: v <> 0)) > 0),
c AS (SELECT anchor_id, landmark_id, list_cosine_similarity(x, y) AS cosine FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY cosine DESC, landmark_id) AS k FROM c WHERE cosine >= 0.85)
"""


@query("p1_found", _SIMILAR + "SELECT anchor_id, landmark_id FROM r WHERE k <= 10")
def p1_found(spark, sf_dir):
    return vectors.similar_landmarks(table(spark, sf_dir, "anchors"), table(spark, sf_dir, "landmarks")).drop("cosine")


@query("p1_neighbors", _SIMILAR + "SELECT anchor_id, list_sort(list(landmark_id)) AS landmark_ids, count(*) AS n_found FROM r WHERE k <= 10 GROUP BY 1")
def p1_neighbors(spark, sf_dir):
    """The list of each anchor's landmarks, by id; at most ten."""
    found = vectors.similar_landmarks(table(spark, sf_dir, "anchors"), table(spark, sf_dir, "landmarks"))
    return found.groupBy("anchor_id").agg(F.array_sort(F.collect_list("landmark_id")).alias("landmark_ids"), F.count("*").alias("n_found"))


@query(
    "p2_found",
    """
WITH f AS (SELECT DISTINCT frame_id, sequence_id, epoch_us(ts) AS t FROM frames WHERE ts IS NOT NULL),
r AS (SELECT DISTINCT record_id, sequence_id, sensor, epoch_us(ts) AS t, CASE sensor WHEN 'depth' THEN 20000 ELSE 50000 END AS most
  FROM sensor_records WHERE ts IS NOT NULL AND sequence_id IS NOT NULL AND ((sensor = 'depth' AND depth_path <> '')
    OR (sensor = 'pose' AND len(pose) = 16 AND len(list_filter(pose, lambda x: x IS NOT NULL AND isfinite(x))) = 16))),
x AS (SELECT frame_id, sensor, record_id, row_number() OVER (PARTITION BY frame_id, sensor ORDER BY abs(r.t - f.t), r.t, record_id) AS k
  FROM f JOIN r ON f.sequence_id = r.sequence_id AND r.t BETWEEN f.t - most AND f.t + most)
SELECT frame_id, sensor, record_id FROM x WHERE k = 1
""",
)
def p2_found(spark, sf_dir):
    return astime.frame_records(table(spark, sf_dir, "frames"), table(spark, sf_dir, "sensor_records"))


_BEST = """
WITH m AS (SELECT DISTINCT query_id, anchor_index, landmark_id, score, topk_retrieval AS n FROM match_output JOIN match_config USING (config_id)
  WHERE score IS NOT NULL AND isfinite(score) AND query_id IS NOT NULL AND anchor_index IS NOT NULL AND landmark_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, anchor_index ORDER BY score DESC, landmark_id) AS k FROM m)
"""


@query("p5_found", _BEST + "SELECT query_id, anchor_index, landmark_id FROM r WHERE k <= n")
def p5_found(spark, sf_dir):
    return topn.best_landmarks(table(spark, sf_dir, "match_output"), table(spark, sf_dir, "match_config")).drop("score")


@query("p7_ids")
def p7_ids(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def _mix(spark, sf_dir, total=None):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"), total)


@query("p8_mix")
def p8_mix(spark, sf_dir):
    return _mix(spark, sf_dir)[0]


@query("p8_shares")
def p8_shares(spark, sf_dir):
    return _mix(spark, sf_dir)[1]


@query("p8_shares_corpus")
def p8_shares_corpus(spark, sf_dir):
    return _mix(spark, sf_dir, "corpus")[1]


@query("p8_checks", "SELECT source, true AS within_cap, true AS sums_agree, true AS own_documents, true AS close FROM source_mix WHERE source IS NOT NULL")
def p8_checks(spark, sf_dir):
    """The caps and shares of p8_mix, checked against the tables; the SQL says what must come out."""
    documents, mix = table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix")
    chosen, told = mixing.mix_sources(documents, mix)
    return mixing.checks(documents, mix, cut(chosen), told)


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")


@query("p9_found")
def p9_found(spark, sf_dir):
    return reading.reading_levels(*_texts(spark, sf_dir))


@query("p9_validation")
def p9_validation(spark, sf_dir):
    return reading.validation(*_texts(spark, sf_dir))


@query("p9_profile")
def p9_profile(spark, sf_dir):
    return reading.profile(*_texts(spark, sf_dir))
