"""Queries over public joint schemes, pairs of views and stereo geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tarn.operators import batch, pairs, pose, public, quality, stereo
from tarn.plans.catalog import _SQL_3D, _SQL_CAND, _SQL_VIEW, _VIEW_JOINTS
from tarn.plans.registry import SQL, query, rounded
from tarn.sources import tables as T
from tarn.streaming import chain, live

_E = lambda i: f"embedding[{i + 1}]::DOUBLE"
_LEN = lambda a, b: f"sqrt(pow({b}_x - {a}_x, 2) + pow({b}_y - {a}_y, 2))"
_DEG = lambda a, b: f"degrees(atan2({b}_y - {a}_y, {b}_x - {a}_x))"
_OUT = lambda d: ", ".join(f"round({v}, 6) AS {k}" for k, v in d.items())


def _points(names):
    return "SELECT vec_id, label, " + ", ".join(f"{_E(3 * j)} AS {n}_x, {_E(3 * j + 1)} AS {n}_y" for j, n in enumerate(names)) + f", {_E(51)} AS bx, {_E(52)} AS byy, greatest(0, {_E(53)}) AS bw, abs({_E(54)}) AS bh, {_E(55)} AS e55 FROM embeddings"


def _seven_sql():
    box = ", ".join(f"({n}_x - bx) / bw AS {n}_x, ({n}_y - byy) / bh AS {n}_y" for n in public.SEVEN)
    mids = ", ".join(f"(l{p}_{a} + r{p}_{a}) / 2 AS {p}m_{a}" for p in ("sho", "eye", "ear") for a in "xy")
    out = {}
    for p in ("sho", "eye", "ear"):
        out |= {f"{p}_mid_x": f"{p}m_x", f"{p}_mid_y": f"{p}m_y", f"{p}_width": _LEN(f"l{p}", f"r{p}"), f"{p}_slope": _DEG(f"l{p}", f"r{p}"), f"{p}_dy": f"r{p}_y - l{p}_y"}
    out |= {"nose_at_x": "nose_x", "nose_at_y": "nose_y", "nose_sho_dx": "nose_x - shom_x", "nose_sho_dy": "nose_y - shom_y", "nose_eye_dy": "nose_y - eyem_y", "head_tilt": _DEG("earm", "nose"), "lateral_offset": "nose_x - shom_x", "vertical_gap": "shom_y - nose_y"}
    out |= {f"{n}_{a}": f"{n}_{a}" for n in public.SEVEN for a in "xy"}
    return f"WITH p AS ({_points(public.SEVEN)}), b AS (SELECT vec_id, label, {box} FROM p WHERE bw <> 0 AND bh <> 0), m AS (SELECT *, {mids} FROM b) SELECT vec_id, label, {_OUT(out)} FROM m"


@query(_seven_sql())
def public7_features(spark, d):
    """FEA-12, GEO-15."""
    return rounded(public.seven_points(T.boxed(spark, d, public.SEVEN)))


def _four_sql():
    out = {f"{n}_{a}": f"CASE WHEN bw > 0 AND bh > 0 THEN ({n}_{a} - {b}) / {s} ELSE {n}_{a} END" for n in public.FOUR for a, b, s in (("x", "bx", "bw"), ("y", "byy", "bh"))}
    lines = {"spine_lower": ("bottom", "shoulder"), "spine_upper": ("shoulder", "head"), "spine_full": ("bottom", "head"), "back": ("shoulder", "back")}
    out |= {f"{k}_slope": _DEG(*v) for k, v in lines.items()} | {f"{k}_length": _LEN(*v) for k, v in lines.items()} | {"bottom_back_length": _LEN("bottom", "back")}
    out |= {f"{n}_sho_d{a}": f"{n}_{a} - shoulder_{a}" for n in ("head", "back") for a in "xy"}
    out |= {"curvature": f"{_DEG('shoulder', 'head')} - {_DEG('bottom', 'shoulder')}", "forward_offset": "head_x - bottom_x"} | {f"raw_{n}_{a}": f"{n}_{a}" for n in public.FOUR for a in "xy"}
    return f"WITH p AS ({_points(public.FOUR)}) SELECT vec_id, label, {_OUT(out)} FROM p"


@query(_four_sql())
def public4_features(spark, d):
    """FEA-13, GEO-15."""
    return rounded(public.four_points(T.boxed(spark, d, public.FOUR)))


_NINE = (*public.UPPER, "lhip", "rhip")


def _seventeen_sql():
    mids = ", ".join(f"(l{p}_{a} + r{p}_{a}) / 2 AS {p}m_{a}" for p in ("sho", "hip") for a in "xy")
    out = {"sho_width": _LEN("lsho", "rsho"), "sho_slope": _DEG("lsho", "rsho"), "sho_dy": "rsho_y - lsho_y", "hip_width": _LEN("lhip", "rhip"), "hip_slope": _DEG("lhip", "rhip"), "head_dx": "nose_x - shom_x", "head_dy": "nose_y - shom_y", "head_slope": _DEG("shom", "nose"),
           "torso_length": _LEN("hipm", "shom"), "torso_slope": _DEG("hipm", "shom"), "torso_dx": "shom_x - hipm_x", "ear_slope": _DEG("lear", "rear"), "ear_dy": "rear_y - lear_y", "eye_slope": _DEG("leye", "reye")}
    out |= {f"{n}_{a}": f"{n}_{a}" for n in ("nose", "lsho", "rsho", "lear", "rear", "lhip", "rhip") for a in "xy"}
    return f"WITH p AS ({_points(_NINE)}), m AS (SELECT *, {mids} FROM p) SELECT vec_id, label, {_OUT({k: f'CASE WHEN e55 > -0.25 THEN {v} ELSE 0 END' for k, v in out.items()})} FROM m"


@query(_seventeen_sql())
def public17_features(spark, d):
    """FEA-14, GEO-17."""
    found = F.coalesce(F.col("e55") > -0.25, F.lit(False))
    e = T.read(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(55)).cast("double").alias("e55"), "label", *(F.get("embedding", F.lit(3 * j + k)).cast("double").alias(f"{n}_{a}") for j, n in enumerate(_NINE) for k, a in enumerate("xy")))
    return rounded(public.seventeen_points(e, found))


_CLASS = "['" + "', '".join(T.CLASSES) + "']"
_SQL_PAIRS = f"""WITH g AS (SELECT vec_id // 2 AS capture_id, max(CASE WHEN vec_id % 2 = 0 THEN label END) AS label, max(CASE WHEN vec_id % 2 = 0 THEN embedding END) AS ea, max(CASE WHEN vec_id % 2 = 1 THEN embedding END) AS eb FROM embeddings GROUP BY 1),
p AS (SELECT capture_id, CASE WHEN label = 9 THEN 'reject' ELSE {_CLASS}[label % 6 + 1] END AS posture, {', '.join(f'960 + 900 * e{p}[{3 * j + 1}]::DOUBLE AS {p}_x{j}, 540 + 500 * e{p}[{3 * j + 2}]::DOUBLE AS {p}_y{j}, e{p}[{3 * j + 3}]::DOUBLE + 0.5 AS {p}_c{j}' for p in 'ab' for j in range(17))},
{', '.join(f'300 + 900 * abs(e{p}[52]::DOUBLE) AS {p}_left, 100 + 400 * abs(e{p}[53]::DOUBLE) AS {p}_top, 200 + 1500 * abs(e{p}[54]::DOUBLE) AS {p}_w, 300 + 1000 * abs(e{p}[55]::DOUBLE) AS {p}_h, coalesce(e{p}[56]::DOUBLE > -0.25, false) AS {p}_has' for p in 'ab')} FROM g)"""
_CNT = lambda p: " + ".join(f"coalesce({p}_c{j} >= 0.25, false)::INT" for j in range(17))


@query(_SQL_PAIRS + f""", n AS (SELECT *, {_CNT('a')} AS na, {_CNT('b')} AS nb,
a_c5 >= 0.25 AND a_c6 >= 0.25 AND a_c11 >= 0.25 AND a_c12 >= 0.25 AND greatest(b_c5, b_c6) >= 0.25 AND greatest(b_c11, b_c12) >= 0.25 AS torso, (a_c0 >= 0.25 OR least(a_c1, a_c2) >= 0.25) AND greatest(b_c0, b_c1, b_c2) >= 0.25 AS head, least(a_h, b_h) / greatest(1, a_h, b_h) >= 0.4 AS even FROM p)
SELECT capture_id, posture, CASE WHEN a_has AND b_has THEN na ELSE 0 END AS a_n, CASE WHEN a_has AND b_has THEN nb ELSE 0 END AS b_n, CASE WHEN NOT (a_has AND b_has) THEN CASE WHEN posture = 'reject' THEN 'PASS' ELSE 'FAIL' END WHEN torso AND head AND na >= 10 AND nb >= 10 AND even THEN 'PASS' WHEN torso AND na >= 8 AND nb >= 8 THEN 'REVIEW' ELSE 'FAIL' END AS status FROM n""")
def keypoint_quality(spark, d):
    """QC-01, ARR-03, ARR-05."""
    return pairs.keypoint_quality(T.pairs(spark, d)).select("capture_id", "posture", "a_n", "b_n", "status")


def _same_person_sql(thorough: bool) -> str:
    rel = ", ".join(f"{p}_w * {p}_h / 2073600.0::DOUBLE AS {p}_area, CASE WHEN {p}_c0 > 0.25 THEN ({p}_y0 - {p}_top) / greatest({p}_h, 1) END AS {p}_nose, CASE WHEN {p}_c5 > 0.25 AND {p}_c6 > 0.25 THEN abs({p}_x5 - {p}_x6) / greatest({p}_w, 1) END AS {p}_span, CASE WHEN {p}_c0 > 0.25 AND {p}_c11 > 0.25 THEN abs({p}_y11 - {p}_y0) END AS {p}_rise, ({p}_left + {p}_w / 2) / 1920 AS {p}_mid" for p in "ab")
    text = lambda head, *values: "{'n': %d, 't': '" + head + "'" + "".join(f" || format('{{:.{n}f}}', {v}) || '{tail}'" for v, n, tail in values) + "}"
    gap, rise = "abs(a_nose - b_nose)", "(b_rise / greatest(a_rise, 1))"
    cases = [
        f"WHEN r > 2.5 OR r < 0.4 THEN {text('AREA_RATIO_EXTREME(', ('r', 2, ')')) % 2} WHEN r > 2 OR r < 0.5 THEN {text('AREA_RATIO_HIGH(', ('r', 2, ')')) % 1}",
        f"WHEN {gap} > 0.20 THEN {text('NOSE_POS_MISMATCH(d=', (gap, 3, ')')) % 2} WHEN {gap} > 0.10 THEN {text('NOSE_POS_DIVERGENT(d=', (gap, 3, ')')) % 1}",
        f"WHEN a_span > 0.30 AND b_span > 0.30 THEN {text('BOTH_FRONTAL_SPAN(c1=', ('a_span', 3, ',c2='), ('b_span', 3, ')')) % 3}",
    ]
    if thorough:
        cases[2] += f" WHEN a_span IS NOT NULL AND b_span > 0.25 THEN {text('LATERAL_WIDE_SPAN(c2=', ('b_span', 3, ')')) % 1}"
        cases += [f"WHEN {rise} > 2 OR {rise} < 0.5 THEN {text('TORSO_V_EXTREME(ratio=', (rise, 2, ')')) % 2}", f"WHEN NOT (a_mid > 0.2 AND a_mid < 0.8) THEN {text('C1_OFF_CENTER') % 1}", f"WHEN NOT (b_mid > 0.2 AND b_mid < 0.9) THEN {text('C2_OFF_CENTER') % 1}"]
    fired = ", ".join(f"CASE {c} END" for c in cases)
    said = "CASE WHEN NOT ok THEN 'C1_target=' || CASE WHEN a_has THEN 'True' ELSE 'False' END || ', C2_target=' || CASE WHEN b_has THEN 'True' ELSE 'False' END WHEN len(fl) = 0 THEN 'CLEAN' ELSE array_to_string([x.t FOR x IN fl], '; ') END AS flags, " if thorough else ""
    return _SQL_PAIRS + f""", r AS (SELECT capture_id, a_has, b_has, a_has AND b_has AS ok, {rel} FROM p), q AS (SELECT *, b_area / greatest(a_area, 0.001) AS r FROM r), f AS (SELECT capture_id, a_has, b_has, ok, list_filter([{fired}], lambda x: x IS NOT NULL) AS fl FROM q),
s AS (SELECT *, CASE WHEN ok THEN coalesce(list_sum([x.n FOR x IN fl]), 0) ELSE 0 END::INT AS score FROM f)
SELECT capture_id, score, {said}CASE WHEN NOT ok THEN 'NO_TARGET' WHEN score = 0 THEN 'SAME_PERSON' WHEN score <= 2 THEN 'LIKELY_SAME' WHEN score <= 4 THEN 'SUSPICIOUS' ELSE 'WRONG_PERSON' END AS verdict FROM s"""


@query(_same_person_sql(False))
def same_person_short(spark, d):
    """QC-02."""
    return pairs.correspondence(T.pairs(spark, d, (0, 5, 6, 11))).select("capture_id", "score", "verdict")


@query(_same_person_sql(True))
def same_person_long(spark, d):
    """QC-03, STR-08."""
    return pairs.correspondence(T.pairs(spark, d, (0, 5, 6, 11)), thorough=True).select("capture_id", "score", "flags", "verdict")


def _gate_sql(desk: bool, source: str = "p") -> str:
    """QC-07 in SQL: a CASE in the order of the checks."""
    rules = [f"NOT {p}_has THEN 'REJECT_NO_PERSON_{cam}'" for cam, p in (("CAM01", "a"), ("CAM02", "b"))]
    for j in (5, 6, 11, 12):
        for cam, p in (("CAM01", "a"), ("CAM02", "b")):
            rules.append(f"{p}_c{j} < 0.25{f' AND NOT {p}_ex' if desk and j > 6 else ''} THEN 'REJECT_{cam}_LOW_CONF_JOINT_{j}'")
    for cam, p, n in (("CAM01", "a", 5), ("CAM02", "b", 3)):
        rules.append(f"sqrt({' + '.join(f'pow(({p}_{a}5 + {p}_{a}6 - {p}_{a}11 - {p}_{a}12) / 2, 2)' for a in 'xy')}) < {n} THEN 'REJECT_{cam}_DEGENERATE_TORSO_SCALE'")
    return "CASE " + " ".join(f"WHEN {r}" for r in rules) + " ELSE 'VALID_2D' END"


@query(_SQL_PAIRS + f" SELECT capture_id, {_gate_sql(False)} AS code FROM p")
def reject_gate_codes(spark, d):
    """QC-07."""
    return quality.reject_gate(T.pairs(spark, d, (5, 6, 11, 12))).select("capture_id", "code")


# where both shoulders (or, seen from the side, one) are there and a hip isn't, hips are put under them
_SQL_DESK = _SQL_PAIRS + ", e AS (SELECT *, " + ", ".join(f"{p}_c5 >= 0.25 AND {p}_c6 >= 0.25 AS {p}_b, ({p}_c5 >= 0.25 {op} {p}_c6 >= 0.25) AND ({p}_c11 < 0.25 OR {p}_c12 < 0.25) AS {p}_ex" for p, op in (("a", "AND"), ("b", "OR"))) + " FROM p), " + (
    "k AS (SELECT *, " + ", ".join(f"CASE WHEN {p}_b THEN greatest(20, sqrt(pow({p}_x6 - {p}_x5, 2) + pow({p}_y6 - {p}_y5, 2))) ELSE 60 END AS {p}_wd, CASE WHEN {p}_b THEN ({p}_x5 + {p}_x6) / 2 WHEN {p}_c5 >= 0.25 THEN {p}_x5 ELSE {p}_x6 END AS {p}_sx, CASE WHEN {p}_b THEN ({p}_y5 + {p}_y6) / 2 WHEN {p}_c5 >= 0.25 THEN {p}_y5 ELSE {p}_y6 END AS {p}_sy" for p in "ab") + " FROM e), "
    "h AS (SELECT capture_id, a_has, b_has, a_ex, b_ex, " + ", ".join(
        f"{p}_x5, {p}_y5, {p}_c5, {p}_x6, {p}_y6, {p}_c6, CASE WHEN {p}_ex THEN {p}_mx - 0.45 * {p}_wd ELSE {p}_x11 END AS {p}_x11, CASE WHEN {p}_ex THEN {p}_mx + 0.45 * {p}_wd ELSE {p}_x12 END AS {p}_x12, "
        f"CASE WHEN {p}_ex THEN 0.85 ELSE {p}_c11 END AS {p}_c11, CASE WHEN {p}_ex THEN 0.85 ELSE {p}_c12 END AS {p}_c12, CASE WHEN {p}_ex THEN least(1070, {p}_sy + greatest(1.15 * {p}_wd, 70)) ELSE {p}_y11 END AS {p}_y11, CASE WHEN {p}_ex THEN least(1070, {p}_sy + greatest(1.15 * {p}_wd, 70)) ELSE {p}_y12 END AS {p}_y12"
        for p in "ab") + " FROM (SELECT *, " + ", ".join(f"CASE WHEN capture_id % 3 = 0 THEN {p}_sx ELSE 950 + 0.15 * ({p}_sx - 950) END AS {p}_mx" for p in "ab") + " FROM k))"
)


def _desk_pairs(spark, d):
    base = F.when(F.col("capture_id") % 3 > 0, 950.0)
    return T.pairs(spark, d, chain.JOINTS).withColumns({"a_base_cx": base, "b_base_cx": base, "left_side": F.col("capture_id") % 2 == 0})


@query(_SQL_DESK + f""", z AS (SELECT capture_id, a_ex, b_ex, a_has, b_has, {_gate_sql(True)} AS code FROM h)
SELECT capture_id, a_ex AS a_extrapolated, b_ex AS b_extrapolated, CASE WHEN a_has AND b_has AND code = 'VALID_2D' THEN 'VALID' ELSE 'REJECTED' END AS status, CASE WHEN NOT a_has THEN 'CAM01: No person detected' WHEN NOT b_has THEN 'CAM02: No person detected' WHEN code = 'VALID_2D' THEN 'OK' ELSE code END AS reason FROM z""")
def desk_pairs(spark, d):
    """STM-05 up to the model: extrapolation, gate and features of both views in one call."""
    return chain.infer_pairs(_desk_pairs(spark, d))


_ANSWER = """'{"a_extrapolated":' || a_ex || ',"b_extrapolated":' || b_ex || ',"status":"' || CASE WHEN reason = 'OK' THEN 'VALID' ELSE 'REJECTED' END || '","reason":"' || reason || '"}'"""


@query(_SQL_DESK + f""", z AS (SELECT capture_id, a_ex, b_ex, CASE WHEN NOT a_has THEN 'CAM01: No person detected' WHEN NOT b_has THEN 'CAM02: No person detected' ELSE replace({_gate_sql(True)}, 'VALID_2D', 'OK') END AS reason FROM h) SELECT capture_id, {_ANSWER} AS value FROM z""")
def pair_answers(spark, d):
    """ORC-03: the answer to each pair as JSON, up to the model."""
    return chain.as_json(chain.infer_pairs(_desk_pairs(spark, d)))


@query(_SQL_DESK + """, w AS (SELECT *, (a_x5 + a_x6) / 2 AS cx, sqrt(pow(a_x6 - a_x5, 2) + pow(a_y6 - a_y5, 2)) AS w, (a_y5 + a_y6) / 2 - nose AS head FROM (SELECT h.*, p.a_y0 AS nose FROM h JOIN p USING (capture_id))),
q AS (SELECT *, (cx - 950) / 700 AS dx, greatest(1, w) / 700 AS wr, greatest(0, head) / greatest(1, w) / 0.5 AS dr FROM w)
SELECT capture_id, a_ex AS a_extrapolated, CASE WHEN capture_id % 3 = 0 THEN 'upright' WHEN dx > 0.15 THEN 'leaning_left' WHEN dx < -0.15 THEN 'leaning_right' WHEN wr >= 1.03 AND dr <= 0.92 THEN 'slouching' WHEN wr >= 1.07 THEN 'leaning_forward' WHEN wr <= 0.93 THEN 'leaning_backward' ELSE 'upright' END AS profile,
CASE WHEN NOT a_has THEN 'REJECT_NO_PERSON_DETECTED' WHEN a_c5 < 0.25 THEN 'REJECT_CAM01_LOW_CONF_JOINT_5' WHEN a_c6 < 0.25 THEN 'REJECT_CAM01_LOW_CONF_JOINT_6' WHEN a_c11 < 0.25 THEN 'REJECT_CAM01_LOW_CONF_JOINT_11' WHEN a_c12 < 0.25 THEN 'REJECT_CAM01_LOW_CONF_JOINT_12' ELSE 'OK' END AS reason FROM q""")
def desk_singles(spark, d):
    """STM-06 up to the model: one view, the other's features from the profile that the baseline suggests (FEA-18)."""
    known = F.col("capture_id") % 3 > 0
    one = _desk_pairs(spark, d).withColumns({"base_cx": F.when(known, 950.0), "base_w": F.when(known, 700.0), "base_ratio": F.when(known, 0.5)})
    return chain.infer_single(one, live.profile_table(spark)).select("capture_id", "a_extrapolated", "profile", "reason")


def _nine_sql():
    mids = ", ".join(f"({p}_{a}{i} + {p}_{a}{j}) / 2 AS {p}{n}_{a}" for p in "ab" for n, i, j in (("top", 5, 6), ("low", 11, 12)) for a in "xy")
    at = ", ".join(f"{p}_{a}{j} AS {p}{j}_{a}" for p, js in (("a", (1, 2, 5, 6)),) for j in js for a in "xy")
    pick = ", ".join(f"CASE WHEN b_c{i} > b_c{j} THEN b_{a}{i} ELSE b_{a}{j} END AS {n}_{a}" for n, i, j in (("ear", 3, 4), ("sho", 5, 6)) for a in "xy")
    out = {"shoulder_slope": _DEG("a5", "a6"), "head_tilt": _DEG("a1", "a2"), "torso_lateral": f"{_DEG('alow', 'atop')} - 90", "shoulder_width": f"{_LEN('a5', 'a6')} / ({_LEN('alow', 'atop')} + 1e-5)", "cervical": _DEG("sho", "ear"), "trunk_sagittal": _DEG("blow", "btop"), "head_forward": f"(ear_x - sho_x) / ({_LEN('alow', 'atop')} + 1e-5)", "has_3d": "1.0", "depth_z": "1.5"}
    out["has_3d"], out["depth_z"] = "(depth IS NOT NULL)::INT::DOUBLE", "coalesce(abs(depth), 1.5)"
    return _SQL_PAIRS + f", m AS (SELECT capture_id, posture, a_has AND b_has AS ok, CASE WHEN a_c0 > 0.3 THEN a_x0 / 960 END AS depth, {mids}, {at}, {pick} FROM p) SELECT capture_id, posture, {_OUT({k: f'CASE WHEN ok THEN {v} END' for k, v in out.items()})} FROM m"


@query(_nine_sql())
def pair_nine_features(spark, d):
    """FEA-15."""
    p = T.pairs(spark, d, (0, 1, 2, 3, 4, 5, 6, 11, 12)).withColumn("depth", F.when(F.col("a_c0") > 0.3, F.col("a_x0") / 960))
    return rounded(public.pair_nine(p))


@query(_SQL_CAND + """, r AS (SELECT *, greatest(1, w) * greatest(1, h) / 2073600.0::DOUBLE AS ratio FROM c),
s AS (SELECT *, round(0.35::DOUBLE * (least(1, ratio / 0.22::DOUBLE) * CASE WHEN ratio < 0.05 THEN 0.2::DOUBLE ELSE 1 END) + 0.30::DOUBLE * greatest(0, 1 - sqrt(power(abs(cx - 960) / 960, 2) + power(abs(cy - 540) / 540, 2))) + 0.25::DOUBLE * torso / 4 + 0.10::DOUBLE * kpt, 9) AS score, w * h / 2073600.0::DOUBLE >= 0.08::DOUBLE AND abs(cx / 960 - 1) <= 0.65::DOUBLE AS ok FROM r),
b AS (SELECT image_id, arg_max({'ok': ok, 'kpt': kpt, 's': score}, [score, -cand]) AS s, arg_max({'ok': ok, 'kpt': kpt}, [conf, -cand, score]) AS c FROM s GROUP BY image_id),
m AS (SELECT 'surest' AS method, c.ok AS ok, c.kpt AS kpt FROM b UNION ALL SELECT 'selected', CASE WHEN s.s >= 0.22 THEN s.ok END, s.kpt FROM b)
SELECT method, count(*) AS n, count(*) FILTER (WHERE ok) AS "right", count(*) FILTER (WHERE NOT ok) AS wrong, count(*) FILTER (WHERE ok IS NULL) AS "none", round(avg(CASE WHEN ok THEN kpt END), 6) AS kpt FROM m GROUP BY method""")
def selector_benchmark(spark, d):
    """QC-11, GEO-14."""
    return rounded(quality.selector_benchmark(T.detections(spark, d)))


def _rig_values() -> str:
    """The example rigs as a VALUES list: lists of intrinsics, distortion, and matrices by rows."""
    lists = lambda m: "[" + ", ".join(repr(float(v)) for v in np.ravel(m)) + "]"
    return ", ".join(f"('{k}', {', '.join(lists(m) for m in (r.K1, r.D1, r.K2, r.D2, r.R, r.T, r.R1, r.R2, r.P1, r.P2, r.scale))})" for k, r in stereo.example_rigs().items())


def _lens_sql(x: str, y: str, v: int, width: float = 1.0) -> tuple[str, str]:
    """A camera's pixel of the normalised point (x, y)."""
    k = lambda i: f"D{v}[{i}]"
    r2 = f"({x}*{x} + {y}*{y})"
    gain = f"(1 + {k(1)}*{r2} + {k(2)}*pow({r2}, 2) + {k(5)}*pow({r2}, 3))"
    px, py = f"({gain}*{x} + 2*{k(3)}*{x}*{y} + {k(4)}*({r2} + 2*{x}*{x}))", f"({gain}*{y} + {k(3)}*({r2} + 2*{y}*{y}) + 2*{k(4)}*{x}*{y})"
    return f"K{v}[1]*{px} + K{v}[2]*{py} + K{v}[3]", f"K{v}[5]*{py} + K{v}[6]"


def _times_sql(m: str, v: tuple[str, str, str], wide: int = 3, turned: bool = False) -> list[str]:
    """A 3x3 matrix (by rows in a list of rows of ``wide``) times a point; ``turned`` takes its transpose."""
    at = lambda i, j: f"{m}[{wide * (j if turned else i) + (i if turned else j) + 1}]"
    return ["(" + " + ".join(f"{at(i, j)}*{v[j]}" for j in range(3)) + ")" for i in range(3)]


def _stereo_sql() -> str:
    """Captured pairs a row a joint, then to three dimensions. The least eigenvector is found unlike in the library: (trace - matrix) is squared until only its greatest direction is left."""
    names = "calibration_id, K1, D1, K2, D2, R, T, R1, R2, P1, P2, scale"
    far = [f"{p} + T[{i + 1}]" for i, p in enumerate(_times_sql("R", ("X", "Y", "Z")))]
    one, two = _lens_sql("(X/Z)", "(Y/Z)", 1), _lens_sql("ox/oz", "oy/oz", 2)
    two = tuple(t.replace("ox/oz", "(ox/oz)").replace("oy/oz", "(oy/oz)") for t in two)
    upper = [(i, j) for i in range(4) for j in range(i, 4)]
    out = f"""WITH rig AS (SELECT * FROM (VALUES {_rig_values()}) t({names})),
seen AS (SELECT vec_id, label, unnest(range(17)) AS j, embedding FROM embeddings),
world AS (SELECT vec_id, label, j, embedding[64 - j % 13]::DOUBLE >= -0.2 AS ok, format('CAL_{{:03d}}', label + 1) AS calibration_id, {', '.join(f"{s} + {m}*CASE WHEN embedding[64 - j % 13]::DOUBLE >= -0.2 THEN embedding[3*j + {k}]::DOUBLE ELSE 0 END AS {a}" for k, (a, m, s) in enumerate((('X', 0.6, 0.0), ('Y', 0.6, 0.0), ('Z', 0.4, 1.8)), 1))} FROM seen),
turned AS (SELECT *, {', '.join(f'{e} AS {a}' for e, a in zip(far, ('ox', 'oy', 'oz'), strict=True))} FROM world JOIN rig USING (calibration_id)),
pix AS MATERIALIZED (SELECT vec_id, label, j, ok, {names}, ({one[0]})/scale[1]*scale[1] AS x1, ({one[1]})/scale[2]*scale[2] AS y1, ({two[0]})/scale[1]*scale[1] AS x2, (({two[1]})/scale[2] + CASE WHEN (vec_id + j) % 11 = 0 THEN 400 ELSE 0 END)*scale[2] AS y2 FROM turned),
un0 AS (SELECT *, {', '.join(f'(x{v} - K{v}[3] - K{v}[2]*(y{v} - K{v}[6])/K{v}[5])/K{v}[1] AS u{v}, (y{v} - K{v}[6])/K{v}[5] AS v{v}, (x{v} - K{v}[3] - K{v}[2]*(y{v} - K{v}[6])/K{v}[5])/K{v}[1] AS a{v}, (y{v} - K{v}[6])/K{v}[5] AS b{v}' for v in (1, 2))} FROM pix)"""
    for n in range(5):
        new = []
        for v in (1, 2):
            r2 = f"(a{v}*a{v} + b{v}*b{v})"
            gain = f"(1 + D{v}[1]*{r2} + D{v}[2]*pow({r2}, 2) + D{v}[5]*pow({r2}, 3))"
            new += [f"(u{v} - 2*D{v}[3]*a{v}*b{v} - D{v}[4]*({r2} + 2*a{v}*a{v}))/{gain} AS a{v}", f"(v{v} - D{v}[3]*({r2} + 2*b{v}*b{v}) - 2*D{v}[4]*a{v}*b{v})/{gain} AS b{v}"]
        out += f", un{n + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(new)}) FROM un{n})"
    turn = {v: _times_sql(f"R{v}", (f"a{v}", f"b{v}", "1")) for v in (1, 2)}
    straight = {v: _times_sql(f"P{v}", tuple(f"t{v}{i}" for i in range(3)), 4) for v in (1, 2)}
    out += f""", tur AS (SELECT *, {', '.join(f'{e} AS t{v}{i}' for v in (1, 2) for i, e in enumerate(turn[v]))} FROM un5),
rec AS MATERIALIZED (SELECT *, {', '.join(f'{straight[v][i]}/{straight[v][2]} AS {a}r{v}' for v in (1, 2) for i, a in enumerate('uv'))} FROM tur),
eqs AS (SELECT *, {', '.join(f'{a}r{v}*P{v}[{9 + k}] - P{v}[{4 * i + 1 + k}] AS n{v}{i}{k}' for v in (1, 2) for i, a in enumerate('uv') for k in range(4))} FROM rec),
nor AS MATERIALIZED (SELECT *, {', '.join(' + '.join(f'n{v}{i}{p}*n{v}{i}{q}' for v in (1, 2) for i in (0, 1)) + f' AS w{p}{q}' for p, q in upper)} FROM eqs),
sq0 AS MATERIALIZED (SELECT vec_id, label, j, ok, K1, D1, K2, D2, R, T, R1, x1, y1, x2, y2, {', '.join((f'w00 + w11 + w22 + w33 - w{p}{q}' if p == q else f'-w{p}{q}') + f' AS w{p}{q}' for p, q in upper)} FROM nor)"""
    w = lambda p, q: f"w{min(p, q)}{max(p, q)}"
    for n in range(22):
        square = {(p, q): "(" + " + ".join(f"{w(p, k)}*{w(k, q)}" for k in range(4)) + ")" for p, q in upper}
        size = " + ".join(square[i, i] for i in range(4))
        out += f", sq{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (s) REPLACE ({', '.join(f'w{p}{q}/s AS w{p}{q}' for p, q in upper)}) FROM (SELECT * REPLACE ({', '.join(f'{square[p, q]} AS w{p}{q}' for p, q in upper)}), {size} AS s FROM sq{n}))"
    back = _times_sql("R1", ("rx", "ry", "rz"), turned=True)
    again = [f"{e} + T[{i + 1}]" for i, e in enumerate(_times_sql("R", ("x", "y", "z")))]
    l1, l2 = _lens_sql("(x/z)", "(y/z)", 1), tuple(t.replace("ox/oz", "(ox/oz)").replace("oy/oz", "(oy/oz)") for t in _lens_sql("ox/oz", "oy/oz", 2))
    return out + f""", rct AS (SELECT *, w03/w33 AS rx, w13/w33 AS ry, w23/w33 AS rz FROM sq22), cam AS (SELECT *, {', '.join(f'{e} AS {a}' for e, a in zip(back, 'xyz', strict=True))} FROM rct), oth AS (SELECT *, {', '.join(f'{e} AS {a}' for e, a in zip(again, ('ox', 'oy', 'oz'), strict=True))} FROM cam),
joint AS (SELECT vec_id, label, j, ok, x, y, z, rx, ry, rz, sqrt(pow({l1[0]} - x1, 2) + pow({l1[1]} - y1, 2)) AS e1, sqrt(pow({l2[0]} - x2, 2) + pow({l2[1]} - y2, 2)) AS e2 FROM oth)"""


def _gap_sql(p: str, q: str) -> str:
    return "sqrt(" + " + ".join(f"pow({p.replace('#', a)} - ({q.replace('#', a)}), 2)" for a in "xyz") + ")"


_STEREO = _stereo_sql()
_TWO = lambda c, n: f"format('{{:.{n}f}}', {c})"


@query(_STEREO + f""", f AS (SELECT *, ok AND rz >= 0.3 AS seen, (e1 + e2) / 2 AS e FROM joint), k AS (SELECT *, seen AND e <= 65 AS fine FROM f),
p AS (SELECT vec_id, any_value(label) AS label, count(*) FILTER (WHERE seen) AS total, count(*) FILTER (WHERE fine) AS core, coalesce(max(CASE WHEN seen AND NOT fine THEN e END), 0) AS worst, avg(CASE WHEN fine THEN e END) AS core_err, avg(CASE WHEN fine AND rz > 0.4 AND rz < 8 THEN rz END) AS depth,
{', '.join(f'max(CASE WHEN fine AND j = {j} THEN r{a} END) AS {a}_{j}' for j in (5, 6, 11, 12) for a in 'xyz')} FROM k GROUP BY vec_id),
q AS (SELECT *, {_gap_sql('#_5', '#_6')} AS shoulder, {_gap_sql('(#_5 + #_6) / 2', '(#_11 + #_12) / 2')} AS torso, CASE WHEN vec_id % 7 < 5 THEN 1 ELSE vec_id % 5 + 1 END AS rank, format('CAL_{{:03d}}', label + 1) AS calibration_id FROM p),
d AS (SELECT *, ['SAME_PERSON', 'LIKELY_SAME', 'SUSPICIOUS', 'WRONG_PERSON', 'NO_TARGET'][rank] AS verdict, [0, 2, 4, 5, 0][rank] AS score, coalesce(depth BETWEEN 0.50 AND 3.80, false) AS deep FROM q),
r AS (SELECT *, CASE WHEN rank = 5 THEN 0 WHEN rank = 4 THEN 1 WHEN calibration_id IN ('CAL_006', 'CAL_010') THEN 2 WHEN core >= 8 AND deep AND coalesce(shoulder BETWEEN 0.15 AND 0.65, true) AND coalesce(torso BETWEEN 0.22 AND 0.85, true) AND core_err <= 45 THEN 3 WHEN core >= 4 AND deep THEN 4 WHEN rank = 3 THEN 5 ELSE 6 END AS rule FROM d)
SELECT vec_id AS capture_id, calibration_id, verdict, ['EXCLUDE_3D', 'EXCLUDE_3D_WRONG_PERSON', 'EXCLUDE_3D_DEGENERATE_RIG', 'INCLUDE_3D_FULL', 'INCLUDE_3D_WITH_MASKING', 'EXCLUDE_3D_SUSPICIOUS_CORRESPONDENCE', 'EXCLUDE_3D'][rule + 1] AS decision,
CASE WHEN rule = 3 OR (rule = 0 AND label = 9) THEN 'PASS' WHEN rule = 4 THEN 'REVIEW' ELSE 'FAIL' END AS status,
CASE rule WHEN 0 THEN CASE WHEN label = 9 THEN 'Clean negative sample (empty chair)' ELSE 'Target lost' END WHEN 1 THEN 'Strong evidence of cross-camera person mismatch (score=' || score || ')' WHEN 2 THEN 'Rig ' || calibration_id || ' excluded (Baseline=' || {_TWO('(SELECT sqrt(pow(T[1], 2) + pow(T[2], 2) + pow(T[3], 2)) FROM rig WHERE rig.calibration_id = r.calibration_id)', 1)} || 'm)'
WHEN 3 THEN 'Full 3D: ' || core || '/17 core joints, core_err=' || {_TWO('core_err', 1)} || 'px, Z=' || {_TWO('depth', 2)} || 'm' WHEN 4 THEN 'Partial 3D: ' || core || '/17 core joints - usable with NaN masking'
WHEN 5 THEN 'Suspicious correspondence (score=' || score || ') + insufficient core joints (' || core || ')' ELSE 'Insufficient core joints (' || core || '/17) or depth anomaly (Z=' || {_TWO('coalesce(depth, 0)', 2)} || 'm)' END AS reason,
{', '.join(f'CASE WHEN rule > 2 THEN {e} END AS {n}' for e, n in (('core', 'core'), ('total', 'total'), ('round(core_err, 6)', 'core_err'), ('round(worst, 6)', 'masked_err'), ('round(shoulder, 6)', 'shoulder'), ('round(torso, 6)', 'torso'), ('round(depth, 6)', 'depth')))} FROM r""")
def stereo_quality(spark, d):
    """QC-04, GEO-08..10, 13: ten rigs that differ, each row by its own."""
    rigs = stereo.example_rigs()
    return rounded(stereo.final_quality(stereo.synthetic_pairs(T.pose3d(spark, d, range(17)), rigs), rigs))


@query(_STEREO + f""", p AS (SELECT vec_id, {', '.join(f'max(CASE WHEN ok AND z > 0.2 AND j = {j} THEN {a} END) AS {a}_{j}' for j in (5, 6, 11, 12) for a in 'xyz')}, sum(CASE WHEN j IN (5, 6, 11, 12) THEN e1 END) / 4 AS err FROM joint GROUP BY vec_id),
t AS (SELECT *, {_gap_sql('(#_5 + #_6) / 2', '(#_11 + #_12) / 2')} AS torso FROM p)
SELECT vec_id AS capture_id, CASE {' '.join(f"WHEN z_{j} IS NULL THEN 'REJECT_3D_INVALID_CORE_JOINT_{j}'" for j in (5, 6, 11, 12))} WHEN torso NOT BETWEEN 0.15 AND 0.90 THEN 'REJECT_3D_TORSO_LENGTH' WHEN err > 45 THEN 'REJECT_3D_REPROJECTION' ELSE 'VALID_3D' END AS code, round(err, 6) AS core_err FROM t""")
def live_stereo_gate(spark, d):
    """QC-08, GEO-11, GEO-12: the live gate over the same ten rigs."""
    rigs = stereo.example_rigs()
    return rounded(stereo.live_gate(stereo.synthetic_pairs(T.pose3d(spark, d, range(17)), rigs), rigs))


@query(_SQL_PAIRS + """, v AS (SELECT capture_id, posture, coalesce(a_c0 * 17, 0)::INT AS joints, a_y0 / 200 AS depth, CASE WHEN a_c5 >= 0.25 THEN abs(a_x5) / 2000 END AS shoulder, CASE WHEN a_c11 >= 0.25 THEN abs(a_y11) / 1500 END AS torso FROM p)
SELECT capture_id, CASE WHEN joints >= 8 AND depth > 0.5 AND depth < 4.5 THEN 'PASS' WHEN joints >= 5 THEN 'REVIEW' ELSE 'FAIL' END AS plain,
CASE WHEN joints >= 8 AND NOT coalesce(CASE WHEN posture IN ('upright', 'forward_head') THEN (shoulder IS NOT NULL AND (shoulder < 0.18 OR shoulder > 0.68)) OR (torso IS NOT NULL AND (torso < 0.28 OR torso > 0.85)) ELSE shoulder < 0.15 OR shoulder > 1.20 END, false) THEN 'PASS' WHEN joints >= 5 THEN 'REVIEW' ELSE 'FAIL' END AS by_posture FROM v""")
def stereo_quality_variants(spark, d):
    """QC-05, QC-06 on given joint counts, depths and lengths."""
    p = T.pairs(spark, d, (0, 5, 11))
    v = p.select("capture_id", "posture", F.coalesce(F.round(F.col("a_c0") * 17).cast("int"), F.lit(0)).alias("joints"), (F.col("a_y0") / 200).alias("depth"), F.when(F.col("a_c5") >= 0.25, F.abs("a_x5") / 2000).alias("shoulder"), F.when(F.col("a_c11") >= 0.25, F.abs("a_y11") / 1500).alias("torso"))
    return stereo.variants(v).select("capture_id", "plain", "by_posture")


_DECISION = "CASE capture_id % 4 WHEN 0 THEN 'INCLUDE_3D_FULL' WHEN 1 THEN 'INCLUDE_3D_WITH_MASKING' WHEN 2 THEN 'INCLUDE_3D_FULL' ELSE 'EXCLUDE_3D' END"


def _manifest(spark, d):
    """Captures of twice as many ids as there are poses, so some have no document."""
    return T.read(spark, d, "documents").select(F.col("doc_id").alias("capture_id")).withColumn("decision", F.expr(_DECISION))


@query(_SQL_VIEW + f""", t AS (SELECT vec_id // 2 AS capture_id, count(DISTINCT vec_id % 2) AS views, bool_and(ok) AS usable, {', '.join(f"max(CASE WHEN vec_id % 2 = {i} THEN {c} END) AS {cam}_{c}" for i, cam in enumerate(('cam01', 'cam02')) for c in pose.VIEW)} FROM f GROUP BY 1),
st AS (SELECT doc_id AS capture_id, CASE WHEN coalesce(views, 0) < 2 THEN 'INVALID_ANNOTATION' WHEN NOT coalesce(usable, false) THEN 'INVALID_CORE_KEYPOINTS' ELSE 'USABLE' END AS status, t.* EXCLUDE (capture_id) FROM documents LEFT JOIN t ON doc_id = t.capture_id)
SELECT capture_id, status, {', '.join(f"round(CASE WHEN status = 'USABLE' THEN {c} END, 6) AS {c}" for c in (f'{cam}_{v}' for cam in ('cam01', 'cam02') for v in pose.VIEW))} FROM st""")
def batch_2d(spark, d):
    """FEA-09, JSN-01, AGG-24."""
    f = batch.views_of(_manifest(spark, d).select("capture_id"), T.pose2d(spark, d, _VIEW_JOINTS))
    return rounded(f.select("capture_id", "status", *(f"{cam}_{c}" for cam in ("cam01", "cam02") for c in pose.VIEW)))


@query(_SQL_3D + f""", s AS (SELECT vec_id, valid AND greatest(sqrt(x5*x5+y5*y5+z5*z5), sqrt(x6*x6+y6*y6+z6*z6), sqrt(x11*x11+y11*y11+z11*z11), sqrt(x12*x12+y12*y12+z12*z12)) >= 1e-6 AS ok FROM q), m AS (SELECT doc_id AS capture_id FROM documents),
j AS (SELECT capture_id, {_DECISION} AS decision, vec_id, ok FROM m LEFT JOIN s ON capture_id = vec_id)
SELECT decision, CASE WHEN decision NOT LIKE 'INCLUDE%' THEN 'EXCLUDED' WHEN vec_id IS NULL THEN 'INVALID_ANNOTATION' WHEN NOT coalesce(ok, false) THEN 'INVALID_3D_GEOMETRY' ELSE 'USABLE' END AS status, CASE WHEN decision NOT LIKE 'INCLUDE%' THEN 'EXCLUDED' WHEN vec_id IS NULL THEN 'NO_FILE' WHEN NOT coalesce(ok, false) THEN 'CANON_FAILED' ELSE 'USABLE' END AS body_status, count(*) AS n FROM j GROUP BY ALL""")
def batch_3d(spark, d):
    """FEA-10, FEA-11: both drivers over one manifest."""
    m, p = _manifest(spark, d), T.pose3d(spark, d)
    a, b = batch.spaces_of(m, p).select("capture_id", "decision", "status"), batch.bodies_of(m, p).select("capture_id", F.col("status").alias("body_status"))
    return a.join(b, "capture_id").groupBy("decision", "status", "body_status").agg(F.count("*").alias("n"))


_BODY = [*pose.PLACES, *pose.BODY]


@query(f"SELECT doc_id AS capture_id, {', '.join(_BODY)} FROM ({SQL['pose3d_canonical']}) JOIN documents ON vec_id = doc_id WHERE ({_DECISION.replace('capture_id', 'doc_id')}) LIKE 'INCLUDE%' AND left_shoulder_x IS NOT NULL")
def batch_bodies(spark, d):
    """FEA-11: the 22 values of every usable capture of a manifest."""
    f = batch.bodies_of(_manifest(spark, d), T.pose3d(spark, d)).filter("status = 'USABLE'")
    return f.select("capture_id", *((F.round(c, 4 if c == "torso_3d_inclination_deg" else 5) + 0.0).alias(c) for c in _BODY))


@query(_SQL_3D + " SELECT n AS bodies, n AS hips_centred, n AS hip_axis, n AS shoulders_above, n AS torso_upright FROM (SELECT count(*) AS n FROM q WHERE valid)")
def body_semantics(spark, d):
    """FEA-07: the facts hold for every body."""
    return batch.semantics(pose.body_frame(T.pose3d(spark, d)))
