"""Queries p3, p4 and p6: rejects, orphan references and results per hot key."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.catalog import query
from waymark.operators import orphans, rejects, treeagg
from waymark.tables import scratch, table


_INT = "(regexp_full_match({0}, ' *-?[0-9]+ *') AND coalesce(TRY_CAST(trim({0}, ' ') AS HUGEINT) BETWEEN {1} AND {2}, false))"
_DEC = r"(regexp_full_match({0}, ' *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *') AND coalesce(isfinite(TRY_CAST(ltrim(trim({0}, ' '), '+') AS DOUBLE)), false))"
_NUM = "TRY_CAST(ltrim(trim({0}, ' '), '+') AS DOUBLE)"


def _int(x: str, low: int, high: int) -> str:
    return _INT.format(x, low, high)


def _all(items: str, test: str) -> str:
    return f"len(list_filter({items}, lambda v: NOT {test})) = 0"


def _as_int(i: int) -> str:
    return f"CAST(trim(f[{i}], ' ') AS INTEGER)"


_RAW = (
    r"""
WITH raw AS (SELECT record_id, any_value(rec_type) AS rec_type, any_value(body) AS body, min(loaded_at) AS loaded_at FROM raw_records GROUP BY record_id),
rec AS (SELECT *, regexp_full_match(body, '(?s)(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*') AS well,
    list_transform(regexp_extract_all(',' || body, '(?s),("(?:[^"]|"")*"|[^,"]*)', 1), lambda x: CASE WHEN x[1] = '"' THEN x[2:len(x) - 1] ELSE x END) AS f
  FROM raw WHERE body IS NOT NULL AND NOT regexp_full_match(body, '\s*') AND NOT regexp_matches(body, '^\s*#')),
lst AS (SELECT *, CASE WHEN trim(f[5], ' ') = '' THEN [] ELSE string_split(f[5], ',') END AS ps, CASE WHEN trim(f[9], ' ') = '' THEN [] ELSE string_split(f[9], ',') END AS ims,
    CASE WHEN trim(f[10], ' ') = '' THEN [] ELSE string_split(f[10], ',') END AS ixs, CASE f[2] """
    + " ".join(f"WHEN '{m}' THEN {n}" for m, n in rejects.CAMERA_MODELS.items())
    + """ END AS needs FROM rec),
told AS (SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN len(f) <> CASE rec_type WHEN 'camera' THEN 6 WHEN 'point3d' THEN 10 ELSE -1 END THEN 'column_count'
  WHEN rec_type = 'camera' AND NOT ("""
    + " AND ".join([_int("f[1]", 1, 2**63 - 1), _int("f[3]", 1, 2**31 - 1), _int("f[4]", 1, 2**31 - 1), "coalesce(len(ps) = needs, false)", _all("ps", _DEC.format("v"))])
    + ") THEN 'invalid_value' WHEN rec_type = 'point3d' AND NOT ("
    + " AND ".join(
        [_int("f[1]", 1, 2**63 - 1), *[_DEC.format(f"f[{i}]") for i in (2, 3, 4, 8)], *[_int(f"f[{i}]", 0, 255) for i in (5, 6, 7)]]
        + ["coalesce(" + _NUM.format("f[8]") + " >= 0, false)", "len(ims) = len(ixs)", _all("ims", _int("v", 1, 2**31 - 1)), _all("ixs", _int("v", 0, 2**31 - 1))]
    )
    + ") THEN 'invalid_value' END AS reason FROM lst)\n"
)
_P3_FOUND = _RAW + "SELECT record_id, reason FROM told WHERE reason IS NOT NULL"
_P3_CAMERAS = (
    _RAW
    + "SELECT record_id, CAST(trim(f[1], ' ') AS BIGINT) AS camera_id, f[2] AS camera_model, "
    + f"{_as_int(3)} AS width, {_as_int(4)} AS height, list_transform(ps, lambda v: {_NUM.format('v')}) AS params, "
    + """replace(f[6], '""', '"') AS label, loaded_at FROM told WHERE reason IS NULL AND rec_type = 'camera'"""
)
_P3_POINTS = (
    _RAW
    + "SELECT record_id, CAST(trim(f[1], ' ') AS BIGINT) AS point3d_id, "
    + f"[{', '.join(_NUM.format(f'f[{i}]') for i in (2, 3, 4))}] AS xyz, [{', '.join(map(_as_int, (5, 6, 7)))}] AS rgb, {_NUM.format('f[8]')} AS point_error, "
    + "list_transform(ims, lambda v: CAST(trim(v, ' ') AS BIGINT)) AS image_ids, list_transform(ixs, lambda v: CAST(trim(v, ' ') AS INTEGER)) AS point2d_idxs, loaded_at FROM told WHERE reason IS NULL AND rec_type = 'point3d'"
)


@query("p3_found", _P3_FOUND)
def p3_found(spark, sf_dir):
    return rejects.failing(table(spark, sf_dir, "raw_records"))


@query("p3_cameras", _P3_CAMERAS)
def p3_cameras(spark, sf_dir):
    return rejects.loaded_cameras(table(spark, sf_dir, "raw_records"))


@query("p3_points", _P3_POINTS)
def p3_points(spark, sf_dir):
    return rejects.loaded_points(table(spark, sf_dir, "raw_records"))


@query(
    "p3_files",
    _RAW
    + "SELECT rec_type, coalesce(reason, 'loaded') AS outcome, count(*) AS n FROM told WHERE coalesce(reason, '') <> 'quoting' AND rec_type IN ('camera', 'point3d') GROUP BY 1, 2",
)
def p3_files(spark, sf_dir):
    """The well-quoted records written as raw text, quoted line ends and all, and loaded again from the files."""
    raw = table(spark, sf_dir, "raw_records").dropDuplicates(["record_id"])
    bad = rejects.failing(raw).filter("reason = 'quoting'")
    told = []
    for kind in ("camera", "point3d"):
        at = scratch(spark, "raw-records")
        raw.filter((F.col("rec_type") == kind) & F.col("body").isNotNull()).join(bad, "record_id", "left_anti").select("body").write.text(at)
        told.append(rejects.load_files(spark, at, kind))
    rows = told[0].unionByName(told[1])
    return rows.groupBy("rec_type", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n"))


def _state(spark, sf_dir):
    return orphans.model_state(*(table(spark, sf_dir, n) for n in ("points3d", "images", "cameras")))


_REFS = """
WITH pt AS (SELECT point3d_id AS id, min(loaded_at) AS a, min(deleted_at) AS g, any_value(image_ids) AS l FROM points3d WHERE point3d_id IS NOT NULL GROUP BY 1),
im AS (SELECT image_id AS id, min(loaded_at) AS a, min(deleted_at) AS g, any_value(point3d_ids) AS l, any_value(camera_id) AS cam FROM images WHERE image_id IS NOT NULL GROUP BY 1),
ca AS (SELECT camera_id AS id, min(loaded_at) AS a, min(deleted_at) AS g FROM cameras GROUP BY 1),
r AS (SELECT DISTINCT 'points3d.image_ids' AS ref_field, id AS row_id, unnest(l) AS target_id, a FROM pt
  UNION SELECT DISTINCT 'images.point3d_ids', id, unnest(l), a FROM im
  UNION SELECT 'images.camera_id', id, cam, a FROM im),
p AS (SELECT 'points3d.image_ids' AS ref_field, id, a AS pa, g FROM im
  UNION ALL SELECT 'images.point3d_ids', id, a, g FROM pt
  UNION ALL SELECT 'images.camera_id', id, a, g FROM ca),
s AS (SELECT r.ref_field, row_id, target_id,
    CASE WHEN p.id IS NULL THEN 'missing' WHEN g <= a THEN 'deleted' WHEN pa > a THEN 'late' ELSE 'sound' END AS status,
    strftime(a, '%Y-%m') AS load_month
  FROM r LEFT JOIN p ON r.ref_field = p.ref_field AND r.target_id = p.id
  WHERE target_id IS NOT NULL AND NOT (r.ref_field = 'images.point3d_ids' AND target_id = -1))
"""


@query("p4_found", _REFS + "SELECT ref_field, row_id, target_id, status, load_month FROM s WHERE status <> 'sound'")
def p4_found(spark, sf_dir):
    return orphans.unsound(_state(spark, sf_dir))


@query("p4_per_month", _REFS + "SELECT ref_field, load_month, status, count(*) AS n_refs FROM s GROUP BY 1, 2, 3")
def p4_per_month(spark, sf_dir):
    return orphans.per_month(_state(spark, sf_dir))


_SNAPSHOTS = """
, all_refs AS (SELECT r.ref_field, a, pa, g FROM r LEFT JOIN p ON r.ref_field = p.ref_field AND r.target_id = p.id
  WHERE target_id IS NOT NULL AND NOT (r.ref_field = 'images.point3d_ids' AND target_id = -1)),
e AS (SELECT ref_field, a AS t, 1 AS d FROM all_refs WHERE pa IS NULL OR g <= a OR pa > a
  UNION ALL SELECT ref_field, pa, -1 FROM all_refs WHERE pa > a AND (g IS NULL OR (g > a AND g > pa))
  UNION ALL SELECT ref_field, g, 1 FROM all_refs WHERE g > a AND g > pa),
m AS (SELECT ref_field, strftime(t, '%Y-%m') AS month, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS opened, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS closed FROM e GROUP BY 1, 2)
SELECT ref_field, month, opened, closed, (sum(opened - closed) OVER (PARTITION BY ref_field ORDER BY month))::BIGINT AS open_at_end FROM m
"""


@query("p4_snapshots", _REFS.rstrip() + _SNAPSHOTS)
def p4_snapshots(spark, sf_dir):
    """Open orphans by month: an increment and a snapshot for each."""
    state = orphans.model_state(*(table(spark, sf_dir, n) for n in ("points3d", "images", "cameras")), months=1, count=True)
    return orphans.snapshots(state)


@query(
    "p6_found",
    """
WITH o AS (SELECT DISTINCT obs_id, frame_id, landmark_id FROM observations WHERE obs_id IS NOT NULL AND frame_id IS NOT NULL AND landmark_id IS NOT NULL),
n AS (SELECT frame_id, landmark_id, count(*) AS n FROM o GROUP BY 1, 2),
e AS (SELECT DISTINCT point3d_id, point_error, unnest(image_ids) AS i FROM points3d WHERE point_error IS NOT NULL AND NOT isnan(point_error)),
a AS (SELECT frame_id, landmark_id, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, landmark_id) AS k FROM n),
b AS (SELECT i, point3d_id, row_number() OVER (PARTITION BY i ORDER BY point_error, point3d_id) AS k FROM e WHERE i IS NOT NULL)
SELECT 'observations.frame_id' AS key_field, frame_id AS key_id, landmark_id AS top_id FROM a WHERE k = 1
UNION ALL SELECT 'points3d.image_ids', i, point3d_id FROM b WHERE k = 1
""",
)
def p6_found(spark, sf_dir):
    return treeagg.top_per_key(table(spark, sf_dir, "observations"), table(spark, sf_dir, "points3d"))


@query(
    "p6_loads",
    """
WITH o AS (SELECT obs_id, frame_id, max(reproj_error::DOUBLE) AS e FROM observations WHERE obs_id IS NOT NULL AND frame_id IS NOT NULL GROUP BY 1, 2),
t AS (SELECT point3d_id, i, max(e) AS e FROM (SELECT point3d_id, CASE WHEN NOT isnan(point_error) THEN point_error END AS e, unnest(image_ids) AS i FROM points3d) x WHERE i IS NOT NULL GROUP BY 1, 2)
SELECT 'observations.frame_id' AS key_field, frame_id AS key_id, count(*) AS n_rows, round(avg(e), 6) AS mean_error FROM o GROUP BY 2
UNION ALL SELECT 'points3d.image_ids', i, count(*), round(avg(e), 6) FROM t GROUP BY 2
""",
)
def p6_loads(spark, sf_dir):
    return treeagg.key_loads(table(spark, sf_dir, "observations"), table(spark, sf_dir, "points3d"))
