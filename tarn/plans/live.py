"""Queries of the live chain and of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.plans.registry import query, rounded
from tarn.sources import tables as T
from tarn.streaming import live

_SQL_FRAMES = "WITH f AS (SELECT user_id AS stream, ts, event_id, 320 + value % 20 - 10 AS cx, 100 + value % 8 - 4 AS w, CASE WHEN event_type <> 'error' THEN 60 + value % 12 - 6 END AS head FROM events)"


@query(_SQL_FRAMES + """, b AS (SELECT stream, arg_min({'cx': cx, 'w': w, 'head': head}, [ts::VARCHAR, lpad(event_id::VARCHAR, 20, '0')]) AS s FROM f GROUP BY stream),
j AS (SELECT event_id, cx, w * (1 + (event_id % 5 - 2) * 0.04::DOUBLE) AS w, head, s.cx AS bx, greatest(20, s.w) AS bw, CASE WHEN s.head IS NULL THEN 0.6 ELSE greatest(0.15, greatest(5, s.head) / greatest(20, s.w)) END AS br FROM f JOIN b USING (stream)),
r AS (SELECT *, (cx - bx) / greatest(1, bw) AS dx, greatest(1, w) / greatest(1, bw) AS wr, CASE WHEN head IS NULL THEN 1 ELSE greatest(0, head) / greatest(1, w) / greatest(0.001, br) END AS dr FROM j)
SELECT CASE WHEN dx > 0.15 THEN 'leaning_left' WHEN dx < -0.15 THEN 'leaning_right' WHEN wr >= 1.03 AND dr <= 0.92 THEN 'slouching' WHEN wr >= 1.07 THEN 'leaning_forward' WHEN wr <= 0.93 THEN 'leaning_backward' ELSE 'upright' END AS profile, count(*) AS n FROM r GROUP BY 1""")
def live_profiles(spark, d):
    """FEA-18, STM-03, STM-06: the baseline is each stream's first frame, kept by a minimum (calibrated and frozen), so no stream is folded in one task."""
    f = T.frames(spark, d)
    first = f.groupBy("stream").agg(F.min(F.struct("ts", "event_id", "cx", "w", "head")).alias("s"))
    w = F.greatest(F.lit(20.0), "s.w")
    base = first.select("stream", F.col("s.cx").alias("base_cx"), w.alias("base_w"), F.when(F.col("s.head").isNull(), 0.6).otherwise(F.greatest(F.lit(0.15), F.greatest(F.lit(5.0), "s.head") / w)).alias("base_ratio"))
    moved = f.withColumn("w", F.col("w") * (1 + (F.col("event_id") % 5 - 2) * 0.04))
    return live.choose_profile(moved.join(base, "stream")).groupBy("profile").agg(F.count("*").alias("n"))


_XY = {5: ("300 + 500", 0, "300 + 400", 1), 6: ("420 + 500", 2, "300 + 400", 3), 11: ("310 + 300", 4, "450 + 300", 5), 12: ("400 + 300", 6, "450 + 300", 7)}


@query(f"""WITH p AS (SELECT vec_id, label % 2 = 1 AS side, {', '.join(f'{x} * embedding[{i + 1}]::DOUBLE AS x{j}, {y} * embedding[{k + 1}]::DOUBLE AS y{j}, 0.35 + embedding[{20 + j}]::DOUBLE AS c{j}' for j, (x, i, y, k) in _XY.items())}, CASE WHEN vec_id % 3 > 0 THEN 350.0::DOUBLE END AS base FROM embeddings),
q AS (SELECT *, c5 >= 0.25 AND c6 >= 0.25 AS b, c5 >= 0.25 OR c6 >= 0.25 AS o, c11 < 0.25 OR c12 < 0.25 AS gone FROM p),
r AS (SELECT *, (b OR (side AND o)) AND gone AS ex, CASE WHEN b THEN greatest(20, sqrt(pow(x6 - x5, 2) + pow(y6 - y5, 2))) ELSE 60 END AS w, CASE WHEN b THEN (x5 + x6) / 2 WHEN c5 >= 0.25 THEN x5 ELSE x6 END AS sx, CASE WHEN b THEN (y5 + y6) / 2 WHEN c5 >= 0.25 THEN y5 ELSE y6 END AS sy FROM q),
s AS (SELECT *, least(470, sy + greatest(1.15 * w, 70)) AS low, coalesce(base + 0.15 * (sx - base), sx) AS mx FROM r)
SELECT vec_id, ex AS extrapolated, round(CASE WHEN ex THEN mx - 0.45 * w ELSE x11 END, 6) AS x11, round(CASE WHEN ex THEN low ELSE y11 END, 6) AS y11, round(CASE WHEN ex THEN mx + 0.45 * w ELSE x12 END, 6) AS x12, round(CASE WHEN ex THEN low ELSE y12 END, 6) AS y12 FROM s""")
def desk_hips(spark, d):
    """FEA-17, STM-04: the lateral toggle is a column."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    num = lambda s, i: float(s.split(" + ")[0]) + float(s.split(" + ")[1]) * e(i)
    cols = [c for j, (x, i, y, k) in _XY.items() for c in (num(x, i).alias(f"x{j}"), num(y, k).alias(f"y{j}"), (0.35 + e(19 + j)).alias(f"c{j}"))]
    p = T.read(spark, d, "embeddings").select("vec_id", (F.col("label") % 2 == 1).alias("lateral"), F.when(F.col("vec_id") % 3 > 0, 350.0).alias("base_cx"), *cols)
    return rounded(live.extrapolate_hips(p, 480, F.col("lateral")).select("vec_id", "extrapolated", "x11", "y11", "x12", "y12"))


@query("""WITH f AS (SELECT user_id AS stream, event_id % 2 AS cam, ts, event_id FROM events), n AS (SELECT stream, max(CASE WHEN cam = 0 THEN {'t': ts, 'e': event_id} END) AS a, max(CASE WHEN cam = 1 THEN {'t': ts, 'e': event_id} END) AS b FROM f GROUP BY stream)
SELECT stream, a.e AS frame1, b.e AS frame2, abs(epoch_us(a.t) - epoch_us(b.t)) AS gap_us FROM n WHERE a IS NOT NULL AND b IS NOT NULL""")
def latest_frame_pairs(spark, d):
    """STM-01, SRC-13."""
    e = T.read(spark, d, "events").select(F.col("user_id").alias("stream"), F.when(F.col("event_id") % 2 == 0, "CAM01").otherwise("CAM02").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("frame"))
    return live.latest_pair(e)


@query("""WITH r AS (SELECT event_type AS truth, CASE WHEN event_id % 9 > 0 THEN CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END END AS prediction FROM events)
SELECT truth, count(*) AS frames, count(*) FILTER (WHERE truth = prediction) AS "right", round(avg((truth = prediction)::INT), 6) AS accuracy FROM r WHERE prediction IS NOT NULL GROUP BY ROLLUP (truth)""")
def recording_accuracy(spark, d):
    """STM-09, AGG-25."""
    k = F.col("event_id")
    return rounded(live.recording_summary(T.read(spark, d, "events").select(F.col("event_type").alias("truth"), F.when(k % 9 > 0, F.when(k % 4 == 0, "view").otherwise(F.col("event_type"))).alias("prediction"))))
