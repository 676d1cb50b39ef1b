"""Queries over sequences, evaluation, parsers, tokens, poses and the online memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.catalog import query
from waymark.functions import vec
from waymark.operators import anchors as tokens_
from waymark.operators import evaluate, landmarks, pnp, spatial, tracks
from waymark.queries import views
from waymark.queries.views import IMAGES_SQL, SEQ_SQL
from waymark.sources import lists, sinks
from waymark.streaming import online
from waymark.tables import micros, scratch, table


def r6(c):
    return F.round(c, 6)


# --- time ----------------------------------------------------------------------


@query(
    "nearest_timestamp_join",
    """
WITH l AS (SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS rid, epoch_us(ts) AS rt FROM events WHERE event_type = 'view')
SELECT event_id, rid, dt FROM (SELECT event_id, rid, abs(t - rt) AS dt, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - rt), rt) AS k FROM l JOIN r ON rt BETWEEN t - 20000000 AND t + 20000000) x WHERE k = 1""",
)
def nearest_timestamp_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", micros(F.col("ts")))
    return spatial.nearest_time(e.filter("event_type = 'click'"), e.filter("event_type = 'view'").withColumnRenamed("event_id", "rid"), "event_id", "rid", 20_000_000)


@query(
    "stride_split",
    "SELECT frame_id, sequence_id, seq FROM (SELECT frame_id, sequence_id, seq, row_number() OVER (PARTITION BY sequence_id ORDER BY seq, frame_id) - 1 AS n FROM (SELECT frame_id, any_value(sequence_id) AS sequence_id, any_value(seq) AS seq FROM frames WHERE frame_id IS NOT NULL GROUP BY 1) f) z WHERE n >= 2 AND (n - 2) % 5 = 0 AND (n - 2) // 5 < 20",
)
def stride_split(spark, sf_dir):
    f = landmarks.once(table(spark, sf_dir, "frames"), "frame_id")
    return spatial.strided(f, ["sequence_id"], ["seq", "frame_id"], 2, 5, 20).select("frame_id", "sequence_id", "seq")


@query(
    "age_window_active_set",
    SEQ_SQL
    + """SELECT sequence_id, event_id, rk::INTEGER AS rk FROM (SELECT s.sequence_id, event_id, row_number() OVER (PARTITION BY s.sequence_id ORDER BY trans_err_m DESC, seq DESC, event_id) AS rk
 FROM v_seq s JOIN (SELECT sequence_id, max(seq) AS mx FROM v_seq GROUP BY 1) m ON s.sequence_id = m.sequence_id WHERE mx - seq <= 20 AND success) x WHERE rk <= 10""",
)
def age_window_active_set(spark, sf_dir):
    s = views.seq(spark, sf_dir)
    now = F.max("seq").over(Window.partitionBy("sequence_id"))
    rows = s.withColumn("now", now).filter("success").selectExpr("sequence_id", "event_id", "event_id as lm_idx", "trans_err_m as staticness", "seq as last_frame", "1 as n_obs", "now")
    return landmarks.active_set(rows, "sequence_id", F.col("now"), 20, 10).select("sequence_id", "event_id", "rk")


# --- evaluation -------------------------------------------------------------------


@query(
    "localization_summary",
    SEQ_SQL
    + """SELECT sequence_id, count(*) AS num_queries, sum(CASE WHEN success THEN 1 ELSE 0 END)::BIGINT AS num_success, round(avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, round(avg(trans_err_m), 6) AS mean_trans_err_m,
 round(median(trans_err_m), 6) AS median_trans_err_m, round(avg(rot_err_deg), 6) AS mean_rot_err_deg, round(median(rot_err_deg), 6) AS median_rot_err_deg FROM v_seq GROUP BY sequence_id""",
)
def localization_summary(spark, sf_dir):
    return evaluate.summary(views.seq(spark, sf_dir), ["sequence_id"], "success", ["trans_err_m", "rot_err_deg"])


@query(
    "threshold_recall",
    SEQ_SQL
    + "SELECT sequence_id, "
    + ", ".join(
        f"round(avg(CASE WHEN success THEN CASE WHEN trans_err_m <= {t}::DOUBLE AND rot_err_deg <= {r} THEN 1.0::DOUBLE ELSE 0 END END), 6) AS recall_{i}, round(avg(CASE WHEN success AND trans_err_m <= {t}::DOUBLE AND rot_err_deg <= {r} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_all_{i}"
        for i, (t, r) in enumerate(evaluate.THRESHOLDS)
    )
    + " FROM v_seq GROUP BY sequence_id",
)
def threshold_recall(spark, sf_dir):
    return evaluate.recall(views.seq(spark, sf_dir), ["sequence_id"], "trans_err_m", "rot_err_deg")


@query("ate_rmse", SEQ_SQL + "SELECT sequence_id, round(sqrt(avg(trans_err_m * trans_err_m)), 6) AS ate FROM v_seq WHERE success GROUP BY sequence_id")
def ate_rmse(spark, sf_dir):
    return evaluate.ate(views.seq(spark, sf_dir).filter("success"), ["sequence_id"], F.col("trans_err_m"))


_POSES = """
WITH s AS (SELECT record_id, any_value(sequence_id) AS sequence_id, any_value(epoch_us(ts)) AS t, any_value(pose) AS p FROM sensor_records WHERE record_id IS NOT NULL AND sensor = 'pose' GROUP BY 1),
g AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY t, record_id) - 1 AS n FROM s WHERE sequence_id IS NOT NULL AND t IS NOT NULL AND len(p) = 16 AND len(list_filter(p, lambda v: v IS NOT NULL AND isfinite(v))) = 16),
b AS (SELECT a.sequence_id, a.n // 2 AS k, a.p AS got, c.p AS want FROM g a JOIN g c ON a.sequence_id = c.sequence_id AND a.n % 2 = 0 AND c.n = a.n + 1)
"""


def pose_pairs(spark, sf_dir):
    """Two interleaved trajectories of each sequence: every other recorded pose as estimate, the next one as truth."""
    rows = landmarks.once(table(spark, sf_dir, "sensor_records").filter("sensor = 'pose'"), "record_id").filter(views.finite("pose", 16) & F.col("sequence_id").isNotNull() & F.col("ts").isNotNull())
    w = Window.partitionBy("sequence_id").orderBy("ts", "record_id")
    n = rows.select("sequence_id", "pose", (F.row_number().over(w) - 1).alias("n"), F.lead("pose").over(w).alias("want"))
    return n.filter("n % 2 = 0 and want is not null").select("sequence_id", F.expr("n div 2").alias("k"), F.col("pose").alias("got"), "want")


@query("ate_poses", _POSES + "SELECT sequence_id, round(sqrt(avg((got[4]-want[4])*(got[4]-want[4])+(got[8]-want[8])*(got[8]-want[8])+(got[12]-want[12])*(got[12]-want[12]))), 6) AS ate FROM b GROUP BY 1")
def ate_poses(spark, sf_dir):
    return evaluate.ate_of_poses(pose_pairs(spark, sf_dir), ["sequence_id"], "got", "want")


def _relative_sql(now: str, before: str, out: str) -> str:
    """SQL of the relative pose's nine rotation and three translation numbers."""
    cell = lambda i, j: f"{before}[{i + 1}]*{now}[{j + 1}]+{before}[{i + 5}]*{now}[{j + 5}]+{before}[{i + 9}]*{now}[{j + 9}]"
    rot = [f"{cell(i, j)} AS {out}{i}{j}" for i in range(3) for j in range(3)]
    move = [f"{before}[{i + 1}]*({now}[4]-{before}[4])+{before}[{i + 5}]*({now}[8]-{before}[8])+{before}[{i + 9}]*({now}[12]-{before}[12]) AS {out}{i}3" for i in range(3)]
    return ", ".join(rot + move)


@query(
    "rpe_stats",
    _POSES
    + ", l AS (SELECT *, lag(got) OVER w AS g0, lag(want) OVER w AS w0 FROM b WINDOW w AS (PARTITION BY sequence_id ORDER BY k)), "
    + f"r AS (SELECT sequence_id, {_relative_sql('got', 'g0', 'a')}, {_relative_sql('want', 'w0', 'c')} FROM l WHERE g0 IS NOT NULL), "
    + "e AS (SELECT sequence_id, sqrt((a03-c03)*(a03-c03)+(a13-c13)*(a13-c13)+(a23-c23)*(a23-c23)) AS t, degrees(acos(greatest(-1, least(1, ("
    + "+".join(f"a{i}{j}*c{i}{j}" for i in range(3) for j in range(3))
    + "-1)/2)))) AS r FROM r) SELECT sequence_id, count(*) AS n, round(sqrt(avg(t*t)), 5) AS trans_rmse, round(median(t), 5) AS trans_median, round(sqrt(avg(r*r)), 3) AS rot_rmse, round(median(r), 3) AS rot_median FROM e GROUP BY 1",
)
def rpe_stats(spark, sf_dir):
    got = evaluate.rpe(pose_pairs(spark, sf_dir), ["sequence_id"], ["k"], "got", "want")
    return got.withColumns({"rot_rmse": F.round("rot_rmse", 3), "rot_median": F.round("rot_median", 3)})


@query(
    "method_threshold_pivot",
    "SELECT method, "
    + ", ".join(f"round(avg(CASE WHEN dataset = 'd{i}' THEN CASE WHEN trans_err_m <= 0.25E0 THEN 1E0 ELSE 0E0 END END), 6) AS d{i}" for i in range(3))
    + " FROM (SELECT event_type AS method, 'd' || CAST(user_id % 3 AS VARCHAR) AS dataset, value / 10 AS trans_err_m FROM events) r GROUP BY method",
)
def method_threshold_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type as method", "concat('d', user_id % 3) as dataset", "value / 10 as trans_err_m")
    return evaluate.comparison(rows, "method", "dataset", ["d0", "d1", "d2"], (F.col("trans_err_m") <= 0.25).cast("double"))


@query(
    "query_runtimes",
    "WITH w AS (SELECT user_id, sum(value) AS wall, count(*) AS n FROM events GROUP BY 1), q AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'view' GROUP BY 1) SELECT w.user_id, round(coalesce(m, wall / n), 6) AS runtime_s FROM w LEFT JOIN q USING (user_id)",
)
def query_runtimes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.groupBy("user_id").agg(F.sum("value").alias("wall_s"), F.count("*").alias("num_queries"))
    rows = e.filter("event_type = 'view'").select("user_id", F.col("value").alias("query_time_s"))
    return evaluate.runtimes(rows, runs, "user_id").withColumn("runtime_s", r6(F.col("runtime_s")))


@query("time_totals", "SELECT event_type, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1")
def time_totals(spark, sf_dir):
    return evaluate.totals(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(
    "map_stats",
    "WITH l AS (SELECT landmark_id, any_value(staticness)::DOUBLE AS s, any_value(support_count) AS n FROM landmarks WHERE landmark_id IS NOT NULL GROUP BY 1) SELECT count(*) AS n_landmarks, round(avg(s), 6) AS mean_static, round(median(s), 6) AS median_static, round(avg(n), 6) AS mean_obs FROM l",
)
def map_stats(spark, sf_dir):
    l = landmarks.once(table(spark, sf_dir, "landmarks"), "landmark_id").select(F.col("staticness").cast("double").alias("staticness"), F.col("support_count").alias("n_obs"))
    return evaluate.map_stats(l)


# --- parsers ------------------------------------------------------------------------


def _order_lines(spark, sf_dir, text: str):
    return table(spark, sf_dir, "orders").selectExpr("cast('orders' as string) as file", "o_orderkey as no", f"{text} as line")


@query("query_list_parse", "SELECT o_orderkey AS no, 'q' || o_orderkey || '.jpg' AS name, CASE WHEN o_orderkey % 3 > 0 THEN 'SIMPLE_RADIAL' END AS camera_model, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 2000)::INTEGER END AS width, CASE WHEN o_orderkey % 3 > 0 THEN 480 END AS height, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS focal FROM orders WHERE o_orderkey % 7 > 0")
def query_list_parse(spark, sf_dir):
    lines = _order_lines(spark, sf_dir, "case when o_orderkey % 7 = 0 then concat('# ', o_orderkey) when o_orderkey % 3 = 0 then concat('q', o_orderkey, '.jpg') else concat('  q', o_orderkey, '.jpg SIMPLE_RADIAL  ', o_custkey % 2000, ' 480 ', o_totalprice, ' 1 2 0.5') end")
    return lists.query_list(lines).select("no", "name", "camera_model", "width", "height", F.col("params")[0].alias("focal"))


@query(
    "retrieval_parse",
    """
WITH p AS (SELECT o_custkey AS q, o_orderkey AS no, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey] WHEN o_orderkey % 3 = 1 THEN [o_orderkey] ELSE [o_orderkey, o_orderkey + 1, o_orderkey + 2] END) AS d FROM orders)
SELECT 'q' || q AS query_name, 'db' || d AS db_name, (row_number() OVER (PARTITION BY q ORDER BY no, d) - 1)::INTEGER AS rnk FROM p""",
)
def retrieval_parse(spark, sf_dir):
    lines = _order_lines(spark, sf_dir, "case o_orderkey % 3 when 0 then concat('q', o_custkey, ' db', o_orderkey) when 1 then concat('q', o_custkey, ' db', o_orderkey, ' 0.75') else concat('q', o_custkey, ' db', o_orderkey, ' db', o_orderkey + 1, ' db', o_orderkey + 2) end")
    return lists.retrieval_pairs(lines)


@query("eval_text_parse", "SELECT o_orderkey AS no, 0.25 ::DOUBLE AS metres, 2.0::DOUBLE AS degrees, greatest(0, least(1, CASE WHEN s > 1.5 THEN s / 100 ELSE s END))::DOUBLE AS score FROM (SELECT o_orderkey, ((o_custkey % 1000) / 10)::DOUBLE AS s FROM orders) o")
def eval_text_parse(spark, sf_dir):
    return lists.recall_lines(_order_lines(spark, sf_dir, "concat('recall (0.25m, 2 deg): ', (o_custkey % 1000) / 10, ' %')"))


@query("config_cache_key", """SELECT o_orderkey, sha1('{"a":' || o_orderkey || ',"b":"' || o_orderstatus || '"}') AS key FROM orders""")
def config_cache_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", sinks.config_key(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("b")).alias("key"))


@query(
    "active_pairs",
    """
WITH p AS (SELECT l_suppkey AS q, l_orderkey AS d FROM lineitem GROUP BY 1, 2)
SELECT 'q' || q AS query_name, count(*) AS n FROM p WHERE q IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AND d IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
)
def active_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").selectExpr("concat('q', l_suppkey) as query_name", "concat('d', l_orderkey) as db_name").distinct()
    q = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").selectExpr("concat('q', s_suppkey) as name")
    d = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").selectExpr("concat('d', o_orderkey) as name")
    return sinks.active_pairs(p, q, d).groupBy("query_name").agg(F.count("*").alias("n"))


@query(
    "pose_lines",
    IMAGES_SQL.rstrip()
    + """,
ln0 AS (SELECT image_id, sqrt(greatest(0, 1+r00+r11+r22)) / 2 AS w, sqrt(greatest(0, 1+r00-r11-r22)) / 2 * CASE WHEN r21 < r12 THEN -1 ELSE 1 END AS x, sqrt(greatest(0, 1-r00+r11-r22)) / 2 * CASE WHEN r02 < r20 THEN -1 ELSE 1 END AS y,
  sqrt(greatest(0, 1-r00-r11+r22)) / 2 * CASE WHEN r10 < r01 THEN -1 ELSE 1 END AS z, -(r00*cx+r01*cy+r02*cz) AS t0, -(r10*cx+r11*cy+r12*cz) AS t1, -(r20*cx+r21*cy+r22*cz) AS t2 FROM img),
ln AS (SELECT image_id, round(w, 8) AS w, round(x, 8) AS x, round(y, 8) AS y, round(z, 8) AS z, round(t0, 8) AS t0, round(t1, 8) AS t1, round(t2, 8) AS t2 FROM ln0)
SELECT 'img' || image_id AS name, round(-((1-2*y*y-2*z*z)*t0 + (2*x*y+2*w*z)*t1 + (2*z*x-2*w*y)*t2), 4) + 0.0 AS cx, round(-((2*x*y-2*w*z)*t0 + (1-2*x*x-2*z*z)*t1 + (2*y*z+2*w*x)*t2), 4) + 0.0 AS cy,
 round(-((2*z*x+2*w*y)*t0 + (2*y*z-2*w*x)*t1 + (1-2*x*x-2*y*y)*t2), 4) + 0.0 AS cz FROM ln""",
)
def pose_lines(spark, sf_dir):
    """Result lines of all images, written and read again."""
    rows = views.posed_images(spark, sf_dir).select(F.concat(F.lit("img"), "image_id").alias("name"), "T_wc")
    at = scratch(spark, "pose-lines")
    sinks.save_poses(rows, at)
    back = lists.predicted_poses(spark.read.text(at).selectExpr("'f' as file", "0 as no", "value as line"))
    return back.select("name", *[(F.round(F.col("T_wc")[4 * i + 3], 4) + 0.0).alias(n) for i, n in enumerate(("cx", "cy", "cz"))])


# --- tokens --------------------------------------------------------------------------


def grid(spark, sf_dir):
    """Embeddings as token grids of 10 x 10 per image."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id div 100 as image_id", "cast((vec_id % 100) div 10 as int) as r", "cast(vec_id % 10 as int) as c", "cast(embedding as array<double>) as desc")


_GRID = """
WITH t AS (SELECT vec_id // 100 AS image_id, ((vec_id % 100) // 10)::INTEGER AS r, (vec_id % 10)::INTEGER AS c, embedding::DOUBLE[] AS d FROM embeddings)
"""
_DISTINCT = (
    _GRID
    + """, n AS (SELECT a.image_id, a.r, a.c, 1 - avg(list_inner_product(a.d, b.d)) AS raw FROM t a JOIN t b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY 1, 2, 3),
s AS (SELECT image_id, r, c, (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w + 1e-8) AS dist FROM n WINDOW w AS (PARTITION BY image_id))
"""
)


@query("distinctiveness_grid", _DISTINCT + "SELECT image_id, r, c, round(dist, 6) AS score FROM s")
def distinctiveness_grid(spark, sf_dir):
    return tokens_.distinctiveness(grid(spark, sf_dir)).select("image_id", "r", "c", r6(F.col("distinct")).alias("score"))


@query(
    "token_scores",
    _DISTINCT
    + """, p AS (SELECT a.image_id, a.r, a.c, list_inner_product(a.d, b.d) AS k FROM t a JOIN t b ON a.image_id = b.image_id AND a.r = b.r AND b.c = (a.c + 1) % 10),
q AS (SELECT image_id, r, c, (k - min(k) OVER w) / (max(k) OVER w - min(k) OVER w + 1e-8) AS st FROM p WINDOW w AS (PARTITION BY image_id)),
u AS (SELECT image_id, r, c, 0.6::DOUBLE * dist + 0.4::DOUBLE * st AS z FROM s JOIN q USING (image_id, r, c))
SELECT image_id, r, c, round((z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w + 1e-8), 6) AS score FROM u WINDOW w AS (PARTITION BY image_id)""",
)
def token_scores(spark, sf_dir):
    g = grid(spark, sf_dir)
    moved = g.withColumn("c", ((F.col("c") + 9) % 10).cast("int"))
    got = tokens_.token_scores(tokens_.distinctiveness(g), tokens_.stability(g, [moved]))
    return got.withColumn("score", r6(F.col("score")))


_SELECTED = """, sc AS (SELECT image_id, r, c, 0.6::DOUBLE * dist + 0.4::DOUBLE AS z FROM s),
tk AS (SELECT image_id, r, c, (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w + 1e-8) AS score, least(r // 5, 1) * 2 + least(c // 5, 1) AS cell FROM sc WINDOW w AS (PARTITION BY image_id)),
od AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cell, score DESC, r * 10 + c) AS n FROM tk),
wk(image_id, n, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::STRUCT(r INTEGER, c INTEGER, cell INTEGER)[] FROM od
  UNION ALL SELECT wk.image_id, wk.n + 1, CASE WHEN len(list_filter(kept, lambda k: k.cell = od.cell)) < 3 AND len(list_filter(kept, lambda k: abs(k.r - od.r) <= 2 AND abs(k.c - od.c) <= 2)) = 0
    THEN list_append(kept, {'r': od.r, 'c': od.c, 'cell': od.cell}) ELSE kept END FROM wk JOIN od ON wk.image_id = od.image_id AND od.n = wk.n + 1),
fin AS (SELECT image_id, unnest(arg_max(kept, n)) AS k FROM wk GROUP BY 1)
SELECT fin.image_id, (row_number() OVER (PARTITION BY fin.image_id ORDER BY score DESC, tk.r * 10 + tk.c) - 1)::INTEGER AS anchor_idx, tk.r, tk.c, round(score, 9) AS score FROM fin JOIN tk ON fin.image_id = tk.image_id AND k.r = tk.r AND k.c = tk.c
"""


@query("anchor_grid_nms", _DISTINCT.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + _SELECTED)
def anchor_grid_nms(spark, sf_dir):
    scored = tokens_.token_scores(tokens_.distinctiveness(grid(spark, sf_dir)), None)
    return tokens_.select_anchors(scored, topk=12, cells=(2, 2), radius=1).withColumn("score", F.round("score", 9))


@query(
    "bilinear_sample",
    _GRID
    + """, k AS (SELECT p_partkey AS point_id, p_partkey % (SELECT max(image_id) + 1 FROM t) AS image_id, (p_partkey % 91) / 10 AS gr, (p_partkey % 83) / 9 AS gc FROM part),
f AS (SELECT *, least(9, greatest(0, gr)) AS y, least(9, greatest(0, gc)) AS x FROM k),
o AS (SELECT *, floor(y)::INTEGER + a AS r, floor(x)::INTEGER + b AS c, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM f, (SELECT unnest([0, 1]) AS a) q, (SELECT unnest([0, 1]) AS b) v),
j AS (SELECT point_id, w, d FROM o JOIN t ON o.image_id = t.image_id AND t.r = least(9, o.r) AND t.c = least(9, o.c)),
e AS (SELECT point_id, i, sum(w * x) AS x FROM (SELECT point_id, w, generate_subscripts(d, 1) AS i, unnest(d) AS x FROM j) z GROUP BY 1, 2),
n AS (SELECT point_id, sqrt(sum(x * x)) + 1e-8 AS n FROM e GROUP BY 1)
SELECT point_id, (i - 1)::INTEGER AS i, round(x / n, 6) AS x FROM e JOIN n USING (point_id)""",
)
def bilinear_sample(spark, sf_dir):
    g = grid(spark, sf_dir)
    images = g.select((F.max("image_id") + 1).alias("n"))
    p = table(spark, sf_dir, "part").crossJoin(F.broadcast(images))  # a single row
    p = p.selectExpr("p_partkey as point_id", "p_partkey % n as image_id", "(p_partkey % 91) / 10 as gr", "(p_partkey % 83) / 9 as gc")
    return tokens_.bilinear(p, g, (10, 10)).select("point_id", F.posexplode("desc").alias("i", "x")).select("point_id", "i", r6(F.col("x")).alias("x"))


# --- poses and sequences -----------------------------------------------------------------


def _scene(spark, sf_dir):
    """Synthetic matches: cameras on an arc see all points; every fifth match is wrong."""
    frames = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 50 as f").distinct().selectExpr("f as query_id", "(f * 3 - 15) / 10 as tx", "(f % 3 - 1) / 10 as ty", "(f % 5 - 2) / 20 as t").selectExpr("query_id", "tx", "ty", "cast(0 as double) as tz", "(1 - t * t) / (1 + t * t) as c", "2 * t / (1 + t * t) as s")
    points = table(spark, sf_dir, "embeddings").selectExpr("vec_id % 50 as p").distinct().selectExpr("p as point_id", "(p % 10 * 4 - 20) / 10 as x", "(p div 10 * 4 - 8) / 10 as y", "(40 + (p * 7) % 30) / 10 as z")
    seen = frames.join(F.broadcast(points), F.lit(True))  # 50 points
    cam = seen.selectExpr("*", "c * (x - tx) - s * (z - tz) as xc", "y - ty as yc", "s * (x - tx) + c * (z - tz) as zc").filter("zc > 1e-6")
    wrong = "if(point_id % 5 = 4, 37.0 + point_id % 7, 0.0)"
    return frames, cam.selectExpr("query_id", "point_id", f"260 * xc / zc + 160 + {wrong} as u", f"260 * yc / zc + 120 - {wrong} as v", "x", "y", "z", "zc", "array(260d, 260d, 160d, 120d, 0d, 0d, 0d, 0d) as camera")


_FRAME_TRUTH = """
WITH f AS (SELECT DISTINCT vec_id // 50 AS f FROM embeddings)
SELECT f AS query_id, true AS success, round((f * 3 - 15) / 10, 4) + 0.0 AS x, round((f % 3 - 1) / 10, 4) + 0.0 AS y, 0.0::DOUBLE AS z FROM f
"""


@query("pnp_pose", _FRAME_TRUTH)
def pnp_pose(spark, sf_dir):
    """Poses solved from matches of which a fifth is wrong; the SQL is the true camera centre."""
    _, matches = _scene(spark, sf_dir)
    got = pnp.solve_poses(matches)
    return got.select("query_id", "success", *[(F.round(F.col("T_wc")[4 * i + 3], 4) + 0.0).alias(n) for i, n in enumerate("xyz")])


@query("pnp_thresholds", "WITH f AS (SELECT DISTINCT vec_id // 50 AS f FROM embeddings), p AS (SELECT DISTINCT vec_id % 50 AS p FROM embeddings) SELECT f AS query_id, e AS error_px, true AS success, count(*) FILTER (e > 20 OR p % 5 <> 4)::INTEGER AS num_inliers FROM f, p, (SELECT unnest([2.0::DOUBLE, 8.0::DOUBLE, 60.0::DOUBLE]) AS e) t GROUP BY 1, 2")
def pnp_thresholds(spark, sf_dir):
    _, matches = _scene(spark, sf_dir)
    return pnp.solve_poses(matches, thresholds=[2.0, 8.0, 60.0]).select("query_id", "error_px", "success", "num_inliers")


def online_frames(spark, sf_dir):
    """Frames of a synthetic walk past fixed points, two sequences; a point's descriptor is the mean of its embeddings. A fifth of the pixels are wrong and have no depth."""
    frames, matches = _scene(spark, sf_dir)
    desc = landmarks.mean_vectors(table(spark, sf_dir, "embeddings").withColumn("point_id", F.expr("vec_id % 50")), "point_id", "embedding").withColumnRenamed("mu", "d")
    good = matches.join(desc, "point_id")
    rows = good.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("point_id", F.array("u", "v").alias("uv"), F.expr("if(point_id % 5 = 4, double('nan'), zc)").alias("z"), "d", "camera"))).alias("k"))
    rows = rows.join(frames, "query_id")
    gt = F.expr("array(c, 0d, s, cast(tx as double), 0d, 1d, 0d, cast(ty as double), -s, 0d, c, tz, 0d, 0d, 0d, 1d)")
    return rows.select((F.col("query_id") % 2).alias("sequence_id"), F.expr("query_id div 2").alias("seq"), F.col("k.uv").alias("uv"), F.col("k.z").alias("z"), F.col("k.d").alias("desc"), F.col("k.camera")[0].alias("camera"), gt.alias("gt"))


_WALK = """
WITH f AS (SELECT vec_id // 50 AS f, count(DISTINCT vec_id % 50) AS n FROM embeddings GROUP BY 1),
w AS (SELECT f % 2 AS sequence_id, f // 2 AS seq, CASE WHEN row_number() OVER (PARTITION BY f % 2 ORDER BY f) <= 2 THEN 'bootstrap' ELSE 'online' END AS mode, (SELECT count(DISTINCT vec_id % 50) FILTER (vec_id % 5 <> 4) FROM embeddings) AS n, (f * 3 - 15) / 10 AS x, (f % 3 - 1) / 10 AS y FROM f)
"""


@query("online_sequence_batch", _WALK + "SELECT sequence_id, seq, mode, true AS success, n::INTEGER AS num_integrated, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM w")
def online_sequence_batch(spark, sf_dir):
    """The walk localized against its growing memory, without and with the last pose as prior (the same places); the SQL is the true walk."""
    frames = online_frames(spark, sf_dir)
    place = lambda df: df.select("sequence_id", "seq", "mode", "success", "num_integrated", (F.round(F.col("T_wc")[3], 3) + 0.0).alias("x"), (F.round(F.col("T_wc")[7], 3) + 0.0).alias("y"))
    plain = place(online.run_batch(frames, online.Online(bootstrap=2)))
    prior = place(online.run_batch(frames, online.Online(bootstrap=2, use_prior=True, prior_edge=200.0)))
    return plain.join(prior, plain.columns)


@query("online_metrics", _WALK + "SELECT sequence_id, count(*) AS num_queries, count(*) AS num_success, 1.0::DOUBLE AS success_rate, 0.0::DOUBLE AS mean_trans_err_m, 0.0::DOUBLE AS median_trans_err_m, 0.0::DOUBLE AS ate, 0.0::DOUBLE AS trans_rmse FROM w GROUP BY 1")
def online_metrics(spark, sf_dir):
    """Summary of the online runs: success, trajectory error over bootstrapped and localized frames."""
    frames = online_frames(spark, sf_dir)
    rows = online.run_batch(frames, online.Online(bootstrap=2)).join(frames.select("sequence_id", "seq", "gt"), ["sequence_id", "seq"])
    done = evaluate.errors(rows, "T_wc", "gt")
    told = evaluate.summary(done, ["sequence_id"], "success", ["trans_err_m"]).join(evaluate.ate_of_poses(rows, ["sequence_id"], "T_wc", "gt"), "sequence_id")
    steps = evaluate.rpe(rows, ["sequence_id"], ["seq"], "T_wc", "gt").select("sequence_id", "trans_rmse")
    whole = lambda c: F.round(c, 3).alias(c)
    return told.join(steps, "sequence_id").select("sequence_id", "num_queries", "num_success", "success_rate", *map(whole, ("mean_trans_err_m", "median_trans_err_m", "ate", "trans_rmse")))


@query(
    "anchor_tracks",
    """
WITH RECURSIVE a0 AS (SELECT anchor_id, any_value(query_id) AS q, any_value(anchor_index) AS i, any_value(descriptor)::DOUBLE[] AS d FROM anchors WHERE anchor_id IS NOT NULL GROUP BY 1),
a AS (SELECT q % 4 AS s, q // 4 AS t, i, d FROM a0 WHERE len(d) = 64 AND len(list_filter(d, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
p AS (SELECT x.s, x.t, x.i, y.i AS j, list_inner_product(x.d, y.d) AS k FROM a x JOIN a y ON x.s = y.s AND y.t = x.t + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY s, t, i ORDER BY k DESC, j) AS f, row_number() OVER (PARTITION BY s, t, j ORDER BY k DESC, i) AS g FROM p),
l AS (SELECT s, t, i, j FROM r WHERE f = 1 AND g = 1 AND k >= 0.8::DOUBLE),
w(s, t, i, rt, ri) AS (SELECT s, t, i, t, i FROM a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.s = a.s AND l.t + 1 = a.t AND l.j = a.i)
  UNION ALL SELECT w.s, w.t + 1, l.j, rt, ri FROM w JOIN l ON w.s = l.s AND w.t = l.t AND w.i = l.i)
SELECT s AS sequence_id, dense_rank() OVER (PARTITION BY s ORDER BY rt, ri) - 1 AS track_id, t AS seq, i AS anchor_index, max(t) OVER (PARTITION BY s, rt, ri) = max(t) OVER (PARTITION BY s) AS alive FROM w""",
)
def anchor_tracks(spark, sf_dir):
    """Chains of mutual nearest anchors over consecutive queries."""
    a = landmarks.once(table(spark, sf_dir, "anchors"), "anchor_id").filter(views.finite("descriptor", 64))
    rows = a.select((F.col("query_id") % 4).alias("sequence_id"), F.expr("query_id div 4").alias("seq"), "anchor_index", F.col("descriptor").alias("desc"))
    return tracks.build_tracks(rows, 0.8)


@query("scene_grids", "SELECT 'r' || r_regionkey AS image_id, r::INTEGER AS r, c::INTEGER AS c, round(c * 47 / 5::DOUBLE, 3)::FLOAT AS x, round(r * 31 / 3::DOUBLE, 3)::FLOAT AS y, 16 AS dim, 1.0::DOUBLE AS length FROM region, range(4) t(r), range(6) u(c)")
def scene_grids(spark, sf_dir):
    """Tokens of the built-in extractor on generated images."""
    images = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) as image_id", "32 as height", "48 as width", "r_regionkey as k")
    pixels = images.select("image_id", "height", "width", F.expr("to_binary(repeat(lpad(hex(cast((k * 37 + 11) % 200 as int)), 6, '3C7F10'), 1536), 'hex')").alias("data"))
    got = tokens_.extract_tokens(pixels, lambda im: tokens_.gradient_tokens(im, (4, 6), 16))
    return got.select("image_id", "r", "c", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.size("desc").alias("dim"), F.round(vec.norm(F.col("desc")), 4).alias("length"))
