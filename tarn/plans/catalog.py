"""The library's queries and their SQL. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import dedup, evaluate, pose, quality, relational
from tarn.plans.registry import QUERIES, SQL, Query, query, rounded
from tarn.sources import tables as T
from tarn.streaming import tracker

FLAGSHIP = "pose2d_by_class"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- pose -----------------------------------------------------------------------------------------------------------

_ANG = lambda a, b: f"CASE WHEN sqrt({'+'.join(f'({x})*({x})' for x in a)}) >= 1e-6 AND sqrt({'+'.join(f'({x})*({x})' for x in b)}) >= 1e-6 THEN degrees(acos(greatest(-1, least(1, ({'+'.join(f'({x})*({y})' for x, y in zip(a, b, strict=True))}) / (sqrt({'+'.join(f'({x})*({x})' for x in a)}) * sqrt({'+'.join(f'({x})*({x})' for x in b)})))))) END"
_E = lambda i: f"embedding[{i + 1}]::DOUBLE"
_SQL_VIEW = f"""
WITH p AS (SELECT vec_id, label, vec_id % 2 = 1 AS lat, (vec_id // 2) % 3 = 0 AS left_side, {', '.join(f'{_E(3 * j)} AS x{j}, {_E(3 * j + 1)} AS y{j}, {_E(3 * j + 2)} + 0.5 AS c{j}' for j in (0, 3, 4, 5, 6, 11, 12))} FROM embeddings),
v AS (SELECT *, CASE WHEN c5 < 0.25 THEN 'missing_left_shoulder' WHEN c6 < 0.25 THEN 'missing_right_shoulder' WHEN c11 < 0.25 THEN 'missing_left_hip' WHEN c12 < 0.25 THEN 'missing_right_hip' END AS reason, c0 >= 0.25 AS nose_ok,
  CASE WHEN lat AND left_side THEN -1 ELSE 1 END AS f, (x11 + x12) / 2 AS hx, (y11 + y12) / 2 AS hy,
  CASE WHEN lat AND greatest(c3, c4) >= 0.25 THEN CASE WHEN c3 >= c4 THEN x3 ELSE x4 END END AS xe, CASE WHEN lat AND greatest(c3, c4) >= 0.25 THEN CASE WHEN c3 >= c4 THEN y3 ELSE y4 END END AS ye FROM p),
q AS (SELECT vec_id, label, lat, left_side, reason, nose_ok, {', '.join(f'f * (x{j} - hx) AS x{j}, y{j} - hy AS y{j}' for j in ('0', '5', '6', '11', '12', 'e'))} FROM v),
s AS (SELECT *, greatest({', '.join(f'sqrt(x{j}*x{j}+y{j}*y{j})' for j in (5, 6, 11, 12))}, CASE WHEN nose_ok THEN sqrt(x0*x0+y0*y0) END) AS far FROM q),
n AS (SELECT vec_id, label, reason, nose_ok, reason IS NULL AND far >= 1e-6 AS ok, {', '.join(f'CASE WHEN reason IS NULL AND far >= 1e-6 THEN x{j}/far END AS x{j}, CASE WHEN reason IS NULL AND far >= 1e-6 THEN y{j}/far END AS y{j}' for j in ('0', '5', '6', '11', '12', 'e'))} FROM s),
m AS (SELECT *, (x5+x6)/2 AS mx, (y5+y6)/2 AS my, (x5+x6)/2 - (x11+x12)/2 AS tx, (y5+y6)/2 - (y11+y12)/2 AS ty, x0 - (x5+x6)/2 AS dx, y0 - (y5+y6)/2 AS dy, greatest(sqrt((x6-x5)*(x6-x5)+(y6-y5)*(y6-y5)), 1e-6) AS span FROM n),
f AS (SELECT vec_id, label, reason, nose_ok, ok,
  CASE WHEN nose_ok THEN x0 END AS nose_x, CASE WHEN nose_ok THEN y0 END AS nose_y, x5 AS left_shoulder_x, y5 AS left_shoulder_y, x6 AS right_shoulder_x, y6 AS right_shoulder_y, x11 AS left_hip_x, y11 AS left_hip_y, x12 AS right_hip_x, y12 AS right_hip_y,
  degrees(atan2(y6-y5, x6-x5)) AS shoulder_slope_deg, degrees(atan2(y12-y11, x12-x11)) AS hip_slope_deg, {_ANG(('tx', 'ty'), ('0.0', '-1.0'))} AS torso_inclination_deg,
  CASE WHEN nose_ok THEN {_ANG(('dx', 'dy'), ('tx', 'ty'))} END AS head_torso_angle_deg, sqrt(tx*tx+ty*ty) AS torso_length_norm, CASE WHEN nose_ok THEN sqrt(dx*dx+dy*dy) END AS head_to_shoulder_norm, mx - (x11+x12)/2 AS torso_horizontal_offset_norm, CASE WHEN nose_ok THEN x0 - mx END AS head_horizontal_offset_norm,
  (xe - mx)/span AS ear_shoulder_horizontal_norm, (my - ye)/span AS ear_shoulder_vertical_norm, CASE WHEN nose_ok THEN {_ANG(('(x0+mx)/2-xe', '(y0+my)/2-ye'), ('(x0+mx)/2-mx', '(y0+my)/2-my'))} END AS ear_neck_angle_deg FROM m)
"""
_VIEW_JOINTS = (0, 3, 4, 5, 6, 11, 12)
_R = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(f"{_SQL_VIEW} SELECT vec_id, ok, reason, nose_ok, {_R(pose.VIEW)} FROM f")
def pose2d_features(spark, d):
    return rounded(pose.view_features(T.pose2d(spark, d, _VIEW_JOINTS)).select("vec_id", "ok", "reason", "nose_ok", *pose.VIEW))


@query(f"""{_SQL_VIEW} SELECT vec_id // 2 AS capture_id, count(DISTINCT vec_id % 2) AS views, bool_and(ok) AS usable, max(CASE WHEN vec_id % 2 = 0 THEN label END) AS label,
{', '.join(f"round(max(CASE WHEN vec_id % 2 = {i} THEN {c} END), 6) AS {cam}_{c}" for i, cam in enumerate(('cam01', 'cam02')) for c in pose.VIEW)} FROM f GROUP BY 1""")
def pose2d_multiview(spark, d):
    return rounded(pose.two_views(pose.view_features(T.pose2d(spark, d, _VIEW_JOINTS))))


@query(f"""{_SQL_VIEW} SELECT label, count(*) AS views, count(*) FILTER (WHERE ok) AS usable, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 4) AS usable_pct, round(avg(torso_inclination_deg), 6) AS inclination, round(avg(head_torso_angle_deg), 6) AS head_torso FROM f GROUP BY label""")
def pose2d_by_class(spark, d):
    f = pose.view_features(T.pose2d(spark, d, _VIEW_JOINTS))
    usable = F.count_if("ok")
    return f.groupBy("label").agg(F.count("*").alias("views"), usable.alias("usable"), F.round(100.0 * usable / F.count("*"), 4).alias("usable_pct"), F.round(F.avg("torso_inclination_deg"), 6).alias("inclination"), F.round(F.avg("head_torso_angle_deg"), 6).alias("head_torso"))


@query(f"{_SQL_VIEW} SELECT coalesce(reason, 'valid') AS reason, nose_ok, count(*) AS n FROM f GROUP BY 1, 2")
def pose_validity_reasons(spark, d):
    return pose.validity(T.pose2d(spark, d, (0, 5, 6, 11, 12))).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason"), "nose_ok").agg(F.count("*").alias("n"))


_J3 = (0, 5, 6, 11, 12)
_SQL_3D = f"""WITH p AS (SELECT vec_id, label, {', '.join(f'CASE WHEN {_E(63 - j % 13)} >= -0.2 THEN {_E(3 * j + k)} END AS {a}{j}' for j in _J3 for k, a in enumerate('xyz'))} FROM embeddings),
q AS (SELECT vec_id, label, x0 IS NOT NULL AS nose_ok, x5 IS NOT NULL AND x6 IS NOT NULL AND x11 IS NOT NULL AND x12 IS NOT NULL AS valid, {', '.join(f'{a}{j} - ({a}11 + {a}12) / 2 AS {a}{j}' for j in _J3 for a in 'xyz')} FROM p)"""


@query(f"""{_SQL_3D}, s AS (SELECT *, CASE WHEN valid THEN greatest({', '.join(f'sqrt(x{j}*x{j}+y{j}*y{j}+z{j}*z{j})' for j in _J3)}) END AS far FROM q),
n AS (SELECT vec_id, nose_ok, valid AND far >= 1e-6 AS ok, {', '.join(f'CASE WHEN valid AND far >= 1e-6 THEN {a}{j}/far END AS {a}{j}' for j in _J3 for a in 'xyz')} FROM s),
m AS (SELECT *, (x5+x6)/2-(x11+x12)/2 AS tx, (y5+y6)/2-(y11+y12)/2 AS ty, (z5+z6)/2-(z11+z12)/2 AS tz, x0-(x5+x6)/2 AS dx, y0-(y5+y6)/2 AS dy, z0-(z5+z6)/2 AS dz FROM n)
SELECT vec_id, coalesce(ok, false) AS ok, {', '.join(f'round({a}{j}, 6) AS {pose.NAMES[j]}_{a}' for j in _J3 for a in 'xyz')}, round(degrees(atan2(y6-y5, x6-x5)), 6) AS shoulder_roll_deg, round(degrees(atan2(y12-y11, x12-x11)), 6) AS hip_roll_deg, round(degrees(atan2(tx, -ty)), 6) AS torso_lateral_lean_deg, round(degrees(atan2(tz, -ty)), 6) AS torso_sagittal_lean_deg,
round({_ANG(('tx', 'ty', 'tz'), ('0.0', '-1.0', '0.0'))}, 6) AS torso_3d_inclination_deg, round({_ANG(('dx', 'dy', 'dz'), ('tx', 'ty', 'tz'))}, 6) AS head_torso_angle_3d_deg, round(dz, 6) AS head_depth_offset_norm, round(dx, 6) AS head_lateral_offset_norm, round(z6-z5, 6) AS shoulder_depth_asymmetry_norm, round(z12-z11, 6) AS hip_depth_asymmetry_norm FROM m""")
def pose3d_features(spark, d):
    return rounded(pose.space_features(T.pose3d(spark, d)).withColumn("ok", F.coalesce("ok", F.lit(False))).drop("label"))


@query(f"""{_SQL_3D}, t AS (SELECT *, (x5+x6)/2 AS tx, (y5+y6)/2 AS ty, (z5+z6)/2 AS tz, x12-x11 AS wx, y12-y11 AS wy, z12-z11 AS wz FROM q),
u AS (SELECT *, tx/sqrt(tx*tx+ty*ty+tz*tz) AS a0, ty/sqrt(tx*tx+ty*ty+tz*tz) AS a1, tz/sqrt(tx*tx+ty*ty+tz*tz) AS a2, wx/sqrt(wx*wx+wy*wy+wz*wz) AS w0, wy/sqrt(wx*wx+wy*wy+wz*wz) AS w1, wz/sqrt(wx*wx+wy*wy+wz*wz) AS w2 FROM t),
v AS (SELECT *, w0-(w0*a0+w1*a1+w2*a2)*a0 AS u0, w1-(w0*a0+w1*a1+w2*a2)*a1 AS u1, w2-(w0*a0+w1*a1+w2*a2)*a2 AS u2 FROM u),
x AS (SELECT *, u0/sqrt(u0*u0+u1*u1+u2*u2) AS b0, u1/sqrt(u0*u0+u1*u1+u2*u2) AS b1, u2/sqrt(u0*u0+u1*u1+u2*u2) AS b2 FROM v),
z AS (SELECT vec_id, nose_ok, {', '.join(f'b0*x{j}+b1*y{j}+b2*z{j} AS x{j}, a0*x{j}+a1*y{j}+a2*z{j} AS y{j}, (b1*a2-b2*a1)*x{j}+(b2*a0-b0*a2)*y{j}+(b0*a1-b1*a0)*z{j} AS z{j}' for j in _J3)} FROM x),
s AS (SELECT *, greatest({', '.join(f'sqrt(x{j}*x{j}+y{j}*y{j}+z{j}*z{j})' for j in _J3)}) AS far FROM z),
n AS (SELECT vec_id, nose_ok, {', '.join(f'{a}{j}/far AS {a}{j}' for j in _J3 for a in 'xyz')} FROM s),
m AS (SELECT *, (x5+x6)/2-(x11+x12)/2 AS tx, (y5+y6)/2-(y11+y12)/2 AS ty, (z5+z6)/2-(z11+z12)/2 AS tz, x0-(x5+x6)/2 AS dx, y0-(y5+y6)/2 AS dy, z0-(z5+z6)/2 AS dz FROM n)
SELECT vec_id, {', '.join(f'round({a}{j}, 5) + 0.0 AS {pose.NAMES[j]}_{a}' for j in _J3 for a in 'xyz')}, round(degrees(atan2(y6-y5, x6-x5)), 5) + 0.0 AS shoulder_roll_deg, round(degrees(atan2(y12-y11, x12-x11)), 5) + 0.0 AS hip_roll_deg,
round({_ANG(('tx', 'ty', 'tz'), ('0.0', '1.0', '0.0'))}, 4) + 0.0 AS torso_3d_inclination_deg, round({_ANG(('dx', 'dy', 'dz'), ('tx', 'ty', 'tz'))}, 5) AS head_torso_angle_3d_deg, round(dz, 5) AS head_depth_offset_norm, round(dx, 5) AS head_lateral_offset_norm, round(z6-z5, 5) + 0.0 AS shoulder_depth_asymmetry_norm FROM m""")
def pose3d_canonical(spark, d):
    """FEA-06, FEA-08: all 22 values; zero has no sign here."""
    f = pose.body_features(T.pose3d(spark, d))
    digits = {"torso_3d_inclination_deg": 4}
    return f.select("vec_id", *((F.round(c, digits.get(c, 5)) + 0.0).alias(c) for c in f.columns if c not in ("vec_id", "label", "reason")))


@query("""SELECT label, j, count(*) FILTER (WHERE c < 0.2) AS unseen, count(*) FILTER (WHERE c >= 0.2 AND c < 0.4) AS hidden, count(*) FILTER (WHERE c >= 0.4) AS visible, round(avg(CASE WHEN c >= 0.4 THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM (SELECT label, unnest(range(17)) AS j, embedding FROM embeddings), LATERAL (SELECT embedding[3*j+3]::DOUBLE + 0.5 AS c) GROUP BY label, j""")
def keypoint_visibility(spark, d):
    """AGG-20, AGG-21."""
    e = T.read(spark, d, "embeddings").select("label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.get("embedding", 3 * j + 2).cast("double") + 0.5)).alias("j", "c"))
    c = F.col("c")
    return e.groupBy("label", F.col("j").cast("bigint").alias("j")).agg(F.count_if(c < 0.2).alias("unseen"), F.count_if((c >= 0.2) & (c < 0.4)).alias("hidden"), F.count_if(c >= 0.4).alias("visible"), F.round(F.avg((c >= 0.4).cast("double")), 6).alias("rate"))


# --- detections -----------------------------------------------------------------------------------------------------

_SQL_CAND = """WITH c AS (SELECT l_orderkey AS image_id, l_linenumber AS cand, least(1900.0, 40 * l_quantity) AS w, 0.5 * least(1900.0, 40 * l_quantity) AS h, 1920 * (0.25 + 5 * l_discount) AS cx, 540 + 1000 * (l_tax - 0.04) AS cy, 1 - 5 * l_tax AS conf, l_linenumber % 5 AS torso, 0.2::DOUBLE + 0.7::DOUBLE * (l_suppkey % 10) / 10 AS kpt FROM lineitem)"""


@query(_SQL_CAND + """, r AS (SELECT *, greatest(1, w) * greatest(1, h) / 2073600.0::DOUBLE AS ratio FROM c),
s AS (SELECT *, round(0.35::DOUBLE * (least(1, ratio / 0.22::DOUBLE) * CASE WHEN ratio < 0.05 THEN 0.2::DOUBLE ELSE 1 END) + 0.30::DOUBLE * greatest(0, 1 - sqrt(power(abs(cx - 960) / 960, 2) + power(abs(cy - 540) / 540, 2))) + 0.25::DOUBLE * torso / 4 + 0.10::DOUBLE * kpt, 9) AS score FROM r),
b AS (SELECT image_id, count(*) AS n, arg_max(cand, [score, -cand]) AS best, max(score) AS score, arg_max(cand, [conf, -cand]) AS by_conf FROM s GROUP BY image_id)
SELECT image_id, n, score >= 0.22 AS has_target, CASE WHEN score >= 0.22 THEN best ELSE -1 END AS cand, round(score, 6) AS score, by_conf FROM b""")
def target_person(spark, d):
    """FEA-16, ORD-04, ORD-05."""
    return rounded(quality.select_target(T.detections(spark, d)))


@query(_SQL_CAND + """, b AS (SELECT image_id, count(*) AS n, arg_max({'cand': cand, 'kpt': kpt, 'torso': torso}, [conf, -cand]) AS c, arg_max(cand, [round(2 * w * h / 2073600.0::DOUBLE - sqrt(power(cx / 960 - 1, 2) + power(cy / 540 - 1, 2)) + 0.5::DOUBLE * torso, 9), -cand]) AS likely FROM c GROUP BY image_id),
t AS (SELECT CASE WHEN n IS NULL THEN 'no_target_detected' WHEN n = 1 AND (c.kpt < 0.30 OR c.torso < 2) THEN 'low_keypoint_confidence' WHEN n = 1 THEN 'correct_target' WHEN c.cand = likely THEN 'multiple_candidates' ELSE 'wrong_person_risk' END AS status FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN b ON image_id = o_orderkey)
SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM t GROUP BY status""")
def detection_status(spark, d):
    """QC-10, AGG-04."""
    images = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")).distinct()
    n = quality.detection_status(T.detections(spark, d), images).groupBy("status").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


# --- manifests, joins, sets -----------------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.source, coalesce(CASE WHEN l.toxic = 1 THEN 'EXCLUDE' WHEN l.quality = 1 THEN 'INCLUDE' WHEN l.doc_id IS NOT NULL THEN 'REVIEW' END, 'NO_QC') AS decision FROM documents d LEFT JOIN labels l USING (doc_id)")
def manifest_left_join(spark, d):
    """JOI-02, JOI-03, PRJ-08."""
    q = T.read(spark, d, "labels").select("doc_id", relational.first_match((F.col("toxic") == 1, "EXCLUDE"), (F.col("quality") == 1, "INCLUDE"), otherwise="REVIEW").alias("q"))
    return T.read(spark, d, "documents").select("doc_id", "source").join(q, "doc_id", "left").select("doc_id", "source", F.coalesce("q", F.lit("NO_QC")).alias("decision"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def usable_semi_join(spark, d):
    """JOI-04."""
    return T.read(spark, d, "documents").select("doc_id", "lang").join(T.read(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def pending_anti_join(spark, d):
    """JOI-05, SRC-15."""
    return T.read(spark, d, "documents").select("doc_id", "source").join(T.read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey AS custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def usable_intersection(spark, d):
    """SET-01."""
    return T.read(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).intersect(T.read(spark, d, "orders").select("o_custkey"))


@query("SELECT coalesce(lang, '(all)') AS lang, count(*) AS n, count(*) FILTER (WHERE n_chars >= 1000) AS usable, round(100.0 * count(*) FILTER (WHERE n_chars >= 1000) / count(*), 4) AS pct FROM documents GROUP BY ROLLUP(lang)")
def coverage_by_class_total(spark, d):
    """AGG-06, AGG-07, AGG-13."""
    usable = F.count_if(F.col("n_chars") >= 1000)
    return T.read(spark, d, "documents").rollup("lang").agg(F.count("*").alias("n"), usable.alias("usable"), F.round(100.0 * usable / F.count("*"), 4).alias("pct")).withColumn("lang", F.coalesce("lang", F.lit("(all)")))


@query("SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def decision_pivot(spark, d):
    """AGG-08."""
    p = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("priority", *(F.col(c).alias(c.lower()) for c in "FOP"))


@query("SELECT coalesce(c_mktsegment, 'All') AS segment, coalesce(o_orderstatus, 'All') AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE(c_mktsegment, o_orderstatus)")
def crosstab_margins(spark, d):
    """AGG-09: counted by customer key first, so that the join and the cube see counts."""
    per = T.read(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    j = per.join(T.read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.cube("c_mktsegment", "o_orderstatus").agg(F.sum("n").alias("n")).select(F.coalesce("c_mktsegment", F.lit("All")).alias("segment"), F.coalesce("o_orderstatus", F.lit("All")).alias("status"), "n")


@query("""WITH j AS (SELECT d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'lang' AS name, round(avg((lang IS NULL)::INT) * 100, 4) AS pct FROM j UNION ALL SELECT 'quality', round(avg((quality IS NULL)::INT) * 100, 4) FROM j UNION ALL SELECT 'toxic', round(avg((toxic IS NULL)::INT) * 100, 4) FROM j""")
def null_rates(spark, d):
    """AGG-10."""
    j = T.read(spark, d, "documents").select("doc_id", "lang").join(T.read(spark, d, "labels"), "doc_id", "left")
    return relational.null_rates(j, "lang", "quality", "toxic")


@query("SELECT l_returnflag AS flag, 'quantity' AS name, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS least, max(l_quantity) AS most, count(*) FILTER (WHERE l_quantity IS NULL) AS nulls FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'discount', round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), max(l_discount), count(*) FILTER (WHERE l_discount IS NULL) FROM lineitem GROUP BY 1")
def column_statistics(spark, d):
    """AGG-11, AGG-12."""
    li = T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return rounded(relational.describe_columns(li, "flag", "quantity", "discount"))


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY source, lang")
def class_distribution_split(spark, d):
    """AGG-05, AGG-15: texts are counted by 256 bits, NULL is no text."""
    return T.read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct(F.sha2(F.col("text").cast("binary"), 256)).alias("texts"))


@query("SELECT source, max(n) AS most, min(n) AS least, round(max(n)::DOUBLE / min(n), 6) AS ratio FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def imbalance_ratio(spark, d):
    """AGG-17."""
    n = T.read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.round(F.max("n").cast("double") / F.min("n"), 6).alias("ratio"))


@query("SELECT source, string_agg(lang, ' | ' ORDER BY lang) AS langs, string_agg(lang || ':' || n, ' | ' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def concat_labels(spark, d):
    """AGG-18, AGG-19."""
    n = T.read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.struct("lang", "n")))
    return n.groupBy("source").agg(each.alias("e")).select("source", F.array_join("e.lang", " | ").alias("langs"), F.array_join(F.transform("e", lambda s: F.concat_ws(":", s["lang"], s["n"].cast("string"))), " | ").alias("counts"))


@query("SELECT event_id // 2 AS pair, round(abs(epoch_us(max(CASE WHEN event_id % 2 = 0 THEN ts END)) - epoch_us(max(CASE WHEN event_id % 2 = 1 THEN ts END))) / 1000.0, 3) AS delta_ms FROM events GROUP BY 1 HAVING count(*) = 2")
def pair_time_delta(spark, d):
    """JOI-06, JOI-12, DT-01, DT-02."""
    e = T.read(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    one = lambda k: F.max(F.when(F.col("event_id") % 2 == k, F.col("us")))
    return e.groupBy(F.floor(F.col("event_id") / 2).alias("pair")).agg(F.count("*").alias("n"), F.round(F.abs(one(0) - one(1)) / 1000.0, 3).alias("delta_ms")).filter("n = 2").drop("n")


@query(r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, coalesce(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), ''), nullif(regexp_extract(url, '/(\d+)', 1), ''), '') AS number, regexp_replace(regexp_replace(url, '#.*$', ''), '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM pages")
def source_clip_regex(spark, d):
    """STR-01, STR-02, STR-04, STR-07: first pattern that matches wins."""
    g = lambda p: F.regexp_extract("url", p, 1)
    return T.read(spark, d, "pages").select("page_id", F.lower(g(r"^https?://([^/]+)")).alias("host"), g(r"/([a-z]{2})/").alias("lang"), F.coalesce(F.nullif(g(r"[?&]page=(\d+)"), F.lit("")), F.nullif(g(r"/(\d+)"), F.lit("")), F.lit("")).alias("number"), F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "[^A-Za-z0-9_-]", "_").alias("safe"))


@query("SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS k, round(avg(value), 6) AS mean, median(value) AS middle FROM events GROUP BY event_type")
def props_json(spark, d):
    """JSN-01, AGG-14."""
    events = T.read(spark, d, "events")
    plain = events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"), F.round(F.avg("value"), 6).alias("mean"))
    return plain.join(relational.exact_median(events, "value", "event_type").withColumnRenamed("median", "middle"), "event_type", "left")


@query("SELECT user_id, event_id, round(avg(value) OVER w, 6) AS mean30, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def fps_moving_mean(spark, d):
    """ORD-10, ORD-11."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.read(spark, d, "events").select("user_id", "event_id", F.round(F.avg("value").over(w.rowsBetween(-29, 0)), 6).alias("mean30"), F.row_number().over(w).alias("frame"))


_SQL_FRAMES = """WITH RECURSIVE f AS (SELECT user_id AS stream, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, ts, (320 + value % 20 - 10)::DOUBLE AS cx, greatest(20, 100 + value % 8 - 4)::DOUBLE AS w,
CASE WHEN event_type <> 'error' THEN (60 + value % 12 - 6)::DOUBLE END AS head, event_id % 17 = 0 AS calibrate FROM events)"""
_SQL_TRACK = _SQL_FRAMES + """, s AS (
SELECT stream, event_id, nth, cx AS bx, w AS bw, CASE WHEN head IS NULL THEN 0.6::DOUBLE ELSE greatest(0.15::DOUBLE, greatest(5, head) / w) END AS br, 0::BIGINT AS adapted, {fixed0} AS fixed FROM f WHERE nth = 1
UNION ALL SELECT f.stream, f.event_id, f.nth, CASE WHEN {cal} THEN f.cx WHEN near THEN 0.995::DOUBLE * bx + 0.005::DOUBLE * f.cx ELSE bx END, CASE WHEN {cal} THEN f.w WHEN near THEN 0.995::DOUBLE * bw + 0.005::DOUBLE * f.w ELSE bw END,
CASE WHEN {cal} THEN CASE WHEN head IS NULL THEN 0.6::DOUBLE ELSE greatest(0.15::DOUBLE, greatest(5, head) / f.w) END WHEN near AND head IS NOT NULL THEN 0.995::DOUBLE * br + 0.005::DOUBLE * greatest(0.15::DOUBLE, head / f.w) ELSE br END, adapted + near::INT, fixed OR {cal}
FROM (SELECT f.*, s.bx, s.bw, s.br, s.adapted, s.fixed, NOT s.fixed AND NOT {cal} AND abs(f.cx - s.bx) / greatest(1, s.bw) < 0.10::DOUBLE AND f.w / greatest(1, s.bw) >= 0.95::DOUBLE AND f.w / greatest(1, s.bw) <= 1.05::DOUBLE AS near FROM f JOIN s ON f.stream = s.stream AND f.nth = s.nth + 1) f)"""


@query(_SQL_TRACK.format(cal="FALSE", fixed0="FALSE") + " SELECT stream, nth AS frames, round(bx, 6) AS cx, round(bw, 6) AS width, round(br, 6) AS ratio, adapted FROM s QUALIFY row_number() OVER (PARTITION BY stream ORDER BY nth DESC) = 1")
def ema_tracker(spark, d):
    """STM-02: a recursion whose gate depends on the state."""
    return rounded(tracker.baselines(T.frames(spark, d)))


@query(_SQL_TRACK.format(cal="calibrate", fixed0="calibrate") + """, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY stream ORDER BY nth))) / 1000000.0::DOUBLE AS gap FROM f), r AS (SELECT stream, event_id, nth, CASE WHEN gap IS NOT NULL THEN 1 / greatest(0.0001::DOUBLE, gap) END AS rate FROM g),
a AS (SELECT stream, event_id, avg(rate) OVER (PARTITION BY stream ORDER BY nth ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS fps FROM r)
SELECT stream, event_id, round(bx, 6) AS base_cx, round(bw, 6) AS base_w, round(br, 6) AS base_ratio, fixed AS calibrated, round(fps, 6) AS fps FROM s JOIN a USING (stream, event_id)""")
def tracker_frames(spark, d):
    """STM-02, STM-03, STM-08: the baseline after each frame, with calibrations as control events, and the rolling frame rate."""
    frames = T.frames(spark, d).withColumn("control", F.when(F.col("event_id") % 17 == 0, "calibrate"))
    return rounded(tracker.follow(frames))


# --- duplicates -----------------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'valid' ELSE 'test' END"


def _docs(spark, d):
    return T.read(spark, d, "documents").withColumn("split", F.expr(_SPLIT))


@query(f"SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first, count(DISTINCT {_SPLIT}) AS splits FROM documents GROUP BY 1 HAVING count(*) >= 2")
def exact_duplicate_groups(spark, d):
    """BIT-01, DUP-01."""
    return dedup.exact_groups(_docs(spark, d), "doc_id", "text")


@query(f"SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1")
def split_leakage(spark, d):
    """DUP-05, SPL-07."""
    return dedup.exact_groups(_docs(spark, d), "doc_id", "text").filter("splits > 1").drop("splits")


_SQL_HASH = """WITH t AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(t), 9, 8))::BIGINT AS lo FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM documents)),
h AS (SELECT doc_id, """ + ", ".join("(" + " + ".join(f"CASE WHEN sum((({c} >> {b}) & 1) * 2 - 1) > 0 THEN {1 << b} ELSE 0 END" for b in range(32)) + f")::BIGINT AS {c}" for c in ("hi", "lo")) + """ FROM t GROUP BY doc_id),
o AS (SELECT hi, lo, min(doc_id) AS key FROM h GROUP BY hi, lo)"""
_SQL_NEAR = _SQL_HASH + """, pr AS (SELECT a.key AS a_key, b.key AS b_key, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance FROM o a JOIN o b ON a.key < b.key
WHERE (a.hi >> 16 = b.hi >> 16 OR a.hi & 65535 = b.hi & 65535 OR a.lo >> 16 = b.lo >> 16 OR a.lo & 65535 = b.lo & 65535) AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 5)"""


def _hashes(spark, d):
    return dedup.simhash(T.read(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "key")


@query(_SQL_NEAR + " SELECT a_key, b_key, distance FROM pr")
def hash_near_duplicates(spark, d):
    """BIT-03..05, DUP-02, DUP-03, JOI-07."""
    return dedup.near_pairs(_hashes(spark, d), 5)


@query(_SQL_NEAR.replace("WITH t AS", "WITH RECURSIVE t AS") + """, b AS (SELECT a_key AS u, b_key AS v FROM pr UNION SELECT b_key, a_key FROM pr), r AS (SELECT u AS node, u AS other FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.other = b.u)
SELECT node, min(other) AS root FROM r GROUP BY node""")
def dup_components(spark, d):
    """DUP-06, DUP-07."""
    return dedup.components(dedup.near_pairs(_hashes(spark, d), 5), "a_key", "b_key")


@query(f"""WITH c AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS sha, {_SPLIT} AS split FROM documents),
s AS (SELECT sha, count(*) AS size, count(DISTINCT source) > 1 AS mixed, count(DISTINCT split) > 1 AS cross, min(doc_id) AS first FROM c GROUP BY sha),
f AS (SELECT doc_id, CASE WHEN size <= 1 THEN 'SINGLETON' WHEN mixed AND s."cross" THEN 'P1_MIXED_CROSS' WHEN s."cross" THEN 'P2_CROSS_SPLIT' WHEN mixed THEN 'P3_MIXED_LABEL' ELSE 'P4_SAME' END AS flag, doc_id = first AS rep FROM c JOIN s USING (sha))
SELECT doc_id, flag, CASE WHEN flag = 'SINGLETON' THEN 'KEEP' WHEN flag IN ('P1_MIXED_CROSS', 'P3_MIXED_LABEL') THEN 'REVIEW' WHEN flag = 'P2_CROSS_SPLIT' THEN CASE WHEN rep THEN 'KEEP' ELSE 'REVIEW' END WHEN rep THEN 'KEEP' ELSE 'EXCLUDE' END AS decision FROM f""".replace("AS cross,", 'AS "cross",'))
def curation_flags(spark, d):
    """QC-17, DUP-09, DUP-10."""
    c = _docs(spark, d).select("doc_id", "source", "split", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    s = c.groupBy("sha").agg(F.count("*").alias("size"), (F.count_distinct("source") > 1).alias("mixed"), (F.count_distinct("split") > 1).alias("cross"), F.min("doc_id").alias("first"))
    return quality.curation_flags(c.join(s, "sha").withColumn("rep", F.col("doc_id") == F.col("first"))).select("doc_id", "flag", "decision")


@query("SELECT doc_id, sha256(text) AS sha FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, source, doc_id) = 1")
def cluster_representative(spark, d):
    """ORD-03, SET-05."""
    c = T.read(spark, d, "documents").select("doc_id", "n_chars", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return quality.representatives(c, "sha", F.desc("n_chars"), "source", "doc_id").select("doc_id", "sha")


# --- splits, scaling, evaluation ------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT c_nationkey AS grp, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT *, (SELECT count(*) FROM customer) AS total FROM g),
a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('split:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < floor(total * 0.70::DOUBLE) AS tr FROM t),
b AS (SELECT *, coalesce(sum(CASE WHEN tr THEN 0 ELSE n END) OVER (ORDER BY md5('split:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM a)
SELECT grp, n, CASE WHEN tr THEN 'train' WHEN rest < floor(total * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM b""")
def group_split_fill(spark, d):
    """SPL-01."""
    c = T.read(spark, d, "customer")
    return relational.groups_in_order(c.groupBy(F.col("c_nationkey").alias("grp")).agg(F.count("*").alias("n")), "grp", "n", c.count())


@query("SELECT grp, (dense_rank() OVER (ORDER BY grp) - 1)::INT AS fold, n FROM (SELECT c_nationkey AS grp, count(*) AS n FROM customer GROUP BY 1)")
def logo_folds(spark, d):
    """SPL-05."""
    return relational.numbered_groups(T.read(spark, d, "customer").withColumnRenamed("c_nationkey", "grp"), "grp")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS q, l_extendedprice AS p FROM lineitem), m AS (SELECT median(q) AS mq, median(p) AS mp FROM b),
f AS (SELECT l_orderkey, l_linenumber, coalesce(q, mq) AS q, coalesce(p, mp) AS p FROM b, m), s AS (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(p) AS ap, stddev_pop(p) AS sp FROM f)
SELECT l_orderkey, l_linenumber, round((q - aq) / sq, 6) AS q, round((p - ap) / sp, 6) AS p FROM f, s""")
def impute_scale(spark, d):
    """ML-01, ML-02."""
    b = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("p"))
    return rounded(relational.fit_scale(b, "q", "p"))


_SQL_PRED = """WITH o AS (SELECT o_orderkey AS capture_id, o_custkey % 5 AS fold, o_orderkey % 6 AS y, CASE WHEN o_orderkey % 7 < 5 THEN o_orderkey % 6 ELSE (o_orderkey * 5 + 1) % 6 END AS a, CASE WHEN o_orderkey % 11 < 7 THEN o_orderkey % 6 ELSE (o_orderkey * 3 + 2) % 6 END AS b FROM orders),
pred AS (SELECT 'a' AS model, fold, y, a AS p FROM o UNION ALL SELECT 'b', fold, y, b FROM o)"""
_SQL_CLASS = """, n AS (SELECT model, fold, y, p, count(*) AS n FROM pred GROUP BY ALL), e AS (SELECT model, fold, y AS cls, CASE WHEN y = p THEN n ELSE 0 END AS tp, n AS s, 0 AS g FROM n UNION ALL SELECT model, fold, p, 0, 0, n FROM n),
k AS (SELECT model, fold, cls, sum(tp)::DOUBLE AS tp, sum(s)::DOUBLE AS s, sum(g)::DOUBLE AS g FROM e GROUP BY ALL), c AS (SELECT *, coalesce(tp / nullif(g, 0), 0) AS pr, coalesce(tp / nullif(s, 0), 0) AS re, coalesce(2 * tp / nullif(g + s, 0), 0) AS f1 FROM k)"""


def _models(spark, d):
    p = T.predictions(spark, d)
    return p.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), "fold", "y", F.col(m).alias("p")) for m in "ab"))).alias("r")).select("r.*")


@query(_SQL_PRED + " SELECT model, y, p, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY model, y), 6) AS share FROM pred GROUP BY model, y, p")
def confusion_matrix(spark, d):
    """EVL-06."""
    return rounded(evaluate.confusion(_models(spark, d), "model"))


@query(_SQL_PRED + _SQL_CLASS + " SELECT model, fold, sum(s)::BIGINT AS n, round(sum(tp) / sum(s), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * s) / sum(s), 6) AS weighted_f1, round(avg(CASE WHEN s > 0 THEN re END), 6) AS balanced_accuracy FROM c GROUP BY model, fold")
def macro_metrics(spark, d):
    """EVL-01..05, by model and fold."""
    return rounded(evaluate.summary(_models(spark, d), "model", "fold"))


@query(_SQL_PRED + _SQL_CLASS + ", q AS (SELECT model, fold, avg(f1) AS f, sum(tp) / sum(s) AS acc FROM c GROUP BY 1, 2) SELECT model, round(avg(f), 6) AS mean_f1, round(stddev_pop(f), 6) AS pop_f1, round(stddev_samp(f), 6) AS samp_f1, round(avg(acc), 6) AS mean_acc FROM q GROUP BY model")
def pooled_vs_fold(spark, d):
    """EVL-07."""
    s = evaluate.summary(_models(spark, d), "model", "fold")
    return rounded(s.groupBy("model").agg(F.avg("macro_f1").alias("mean_f1"), F.stddev_pop("macro_f1").alias("pop_f1"), F.stddev_samp("macro_f1").alias("samp_f1"), F.avg("accuracy").alias("mean_acc")))


@query(_SQL_PRED + ", n AS (SELECT count(*) FILTER (WHERE a = y AND b = y) AS \"both\", count(*) FILTER (WHERE a = y AND b <> y) AS only_a, count(*) FILTER (WHERE a <> y AND b = y) AS only_b, count(*) FILTER (WHERE a <> y AND b <> y) AS neither FROM o) SELECT *, round(power(abs(only_a - only_b) - 1, 2)::DOUBLE / (only_a + only_b), 6) AS chi2 FROM n")
def paired_mcnemar(spark, d):
    """EVL-09, EVL-10."""
    return rounded(evaluate.paired(T.predictions(spark, d)))


@query("SELECT y AS cls, count(*) AS n, sum(CASE y WHEN 5 THEN 1.5::DOUBLE WHEN 2 THEN 1.3::DOUBLE ELSE 1 END) AS weight FROM (SELECT o_orderkey % 6 AS y FROM orders) GROUP BY 1")
def sample_weights(spark, d):
    """SPL-09."""
    w = F.when(F.col("y") == 5, 1.5).when(F.col("y") == 2, 1.3).otherwise(1.0)
    return rounded(T.predictions(spark, d).groupBy(F.col("y").alias("cls")).agg(F.count("*").alias("n"), F.sum(w).alias("weight")))


@query("SELECT fold, count(*) AS n, count(*) FILTER (WHERE y = 5 AND a = 2) AS slouching_as_forward, count(*) FILTER (WHERE y = 2 AND a = 5) AS forward_as_slouching FROM (" + _SQL_PRED.split("AS (", 1)[1].split("FROM orders)")[0] + " FROM orders) GROUP BY fold")
def specific_confusions(spark, d):
    """EVL-13."""
    y, a = F.col("y"), F.col("a")
    return T.predictions(spark, d).groupBy("fold").agg(F.count("*").alias("n"), F.count_if((y == 5) & (a == 2)).alias("slouching_as_forward"), F.count_if((y == 2) & (a == 5)).alias("forward_as_slouching"))


@query(_SQL_PRED + _SQL_CLASS.replace("fold, ", "") + ", x AS (SELECT cls, max(CASE WHEN model = 'a' THEN f1 END) AS fa, max(CASE WHEN model = 'b' THEN f1 END) AS fb FROM c GROUP BY cls) SELECT cls, round(fa - fb, 6) AS delta, CASE WHEN fa > fb THEN 'a' WHEN fb > fa THEN 'b' ELSE 'tie' END AS advantage FROM x")
def model_advantage(spark, d):
    """EVL-08, EVL-12."""
    c = evaluate.per_class(_models(spark, d), "model")
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("f1"))).alias(m)
    x = c.groupBy("cls").agg(one("a"), one("b"))
    return x.select("cls", F.round(F.col("a") - F.col("b"), 6).alias("delta"), F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b").otherwise("tie").alias("advantage"))


@query("SELECT c_custkey, k AS fold, CASE WHEN c_nationkey % 5 = k THEN 'test' ELSE 'train' END AS role FROM customer, range(5) r(k)")
def fold_manifest(spark, d):
    """JOI-11, A9: the long form is an explode of five numbers, not a join."""
    c = T.read(spark, d, "customer").select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return c.select("c_custkey", F.col("k").cast("bigint").alias("fold"), F.when(F.col("c_nationkey") % 5 == F.col("k"), "test").otherwise("train").alias("role"))


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('sample:' || doc_id), doc_id) <= 25")
def sample_per_class(spark, d):
    """SPL-06, ORD-07: 25 rows a class in seeded order. A limit per class is the feature; partial ranks drop the rest before the shuffle."""
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    return T.read(spark, d, "documents").select("lang", "doc_id").withColumn("nth", F.row_number().over(w)).filter("nth <= 25").drop("nth")


@query("SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, part LIMIT 10")
def top_ten(spark, d):
    """AGG-02, AGG-16: a top-k report with ties in order of the key."""
    return T.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").limit(10)


@query("SELECT event_id, coalesce(trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE))::INT, 0) AS k, upper(trim(event_type)) AS kind, split_part(event_type || '_x', '_', 1) AS head, TRY_CAST(event_type AS DOUBLE) IS NULL AS bad FROM events")
def safe_casts(spark, d):
    """STR-05, STR-06, STR-09."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return T.read(spark, d, "events").select("event_id", F.coalesce(k.cast("int"), F.lit(0)).alias("k"), F.upper(F.trim("event_type")).alias("kind"), F.split(F.concat("event_type", F.lit("_x")), "_")[0].alias("head"), F.col("event_type").try_cast("double").isNull().alias("bad"))


from tarn.plans import answers, audits, learning, live, surfaces, vision  # noqa: E402, F401  (they register their queries)
