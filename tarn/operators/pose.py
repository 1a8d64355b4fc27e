"""Pose features of one row's joints: pure projections, no shuffle and no Python.

FEA-01, FEA-02, FEA-03 (two views), FEA-05 (camera frame), FEA-06 and FEA-08 (body frame). A joint is missing where its coordinate is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.geometry import EPS, angle, dot, mid, minus, norm, slope

CORE = (5, 6, 11, 12)
NAMES = {0: "nose", 5: "left_shoulder", 6: "right_shoulder", 11: "left_hip", 12: "right_hip"}
# Feature names as models and files have them.
VIEW = (
    "nose_x", "nose_y", "left_shoulder_x", "left_shoulder_y", "right_shoulder_x", "right_shoulder_y", "left_hip_x", "left_hip_y", "right_hip_x", "right_hip_y",
    "shoulder_slope_deg", "hip_slope_deg", "torso_inclination_deg", "head_torso_angle_deg", "head_to_shoulder_norm", "torso_length_norm", "head_horizontal_offset_norm", "torso_horizontal_offset_norm",
    "ear_shoulder_horizontal_norm", "ear_shoulder_vertical_norm", "ear_neck_angle_deg",
)


def validity(df: DataFrame, least: float = 0.25) -> DataFrame:
    """Adds ``reason`` (the first core joint that is missing or unsure, NULL if none) and ``nose_ok``."""
    seen = lambda j: F.coalesce((F.col(f"c{j}") >= least) & F.col(f"x{j}").isNotNull() & F.col(f"y{j}").isNotNull(), F.lit(False))
    reason = F.coalesce(*(F.when(~seen(j), F.lit(f"missing_{NAMES[j]}")) for j in CORE))
    return df.withColumn("reason", reason).withColumn("nose_ok", seen(0))


def view_features(df: DataFrame, least: float = 0.25) -> DataFrame:
    """The features of VIEW for each view; NULL unless its core joints are valid. Needs columns of pose2d and ``lateral``, ``left_side``."""
    df = validity(df, least)
    keep = [c for c in df.columns if not (c[0] in "xyc" and c[1:].isdigit())]
    flip = F.when(F.col("lateral") & F.col("left_side"), -1.0).otherwise(1.0)
    ear = lambda a: F.when(F.col("c3") >= F.col("c4"), F.col(f"{a}3")).otherwise(F.col(f"{a}4"))
    ear_ok = F.col("lateral") & F.coalesce(F.greatest("c3", "c4") >= least, F.lit(False))
    df = df.select(*keep, flip.alias("flip"), *(F.col(f"{a}{j}") for j in (0, *CORE) for a in "xy"), F.when(ear_ok, ear("x")).alias("xe"), F.when(ear_ok, ear("y")).alias("ye"), ((F.col("x11") + F.col("x12")) / 2).alias("hx"), ((F.col("y11") + F.col("y12")) / 2).alias("hy"))
    joints = ("0", "5", "6", "11", "12", "e")
    df = df.select(*keep, *((F.col("flip") * (F.col(f"x{j}") - F.col("hx"))).alias(f"x{j}") for j in joints), *((F.col(f"y{j}") - F.col("hy")).alias(f"y{j}") for j in joints))
    far = F.greatest(*(norm(F.col(f"x{j}"), F.col(f"y{j}")) for j in CORE), F.when(F.col("nose_ok"), norm(F.col("x0"), F.col("y0"))))
    ok = F.col("reason").isNull() & (F.col("far") >= EPS)
    df = df.withColumn("far", far)
    df = df.select(*keep, ok.alias("ok"), *(F.when(ok, F.col(f"{a}{j}") / F.col("far")).alias(f"{a}{j}") for j in joints for a in "xy"))
    p = {j: (F.col(f"x{j}"), F.col(f"y{j}")) for j in joints}
    m, hip, nose = mid(p["5"], p["6"]), mid(p["11"], p["12"]), F.col("nose_ok")
    torso, head = minus(m, hip), minus(p["0"], m)
    span = F.greatest(norm(*minus(p["6"], p["5"])), F.lit(EPS))
    neck = mid(p["0"], m)
    values = [
        F.when(nose, p["0"][0]), F.when(nose, p["0"][1]), *p["5"], *p["6"], *p["11"], *p["12"],
        slope(p["6"][0] - p["5"][0], p["6"][1] - p["5"][1]), slope(p["12"][0] - p["11"][0], p["12"][1] - p["11"][1]), angle(torso, (F.lit(0.0), F.lit(-1.0))),
        F.when(nose, angle(head, torso)), F.when(nose, norm(*head)), norm(*torso), F.when(nose, p["0"][0] - m[0]), m[0] - hip[0],
        (p["e"][0] - m[0]) / span, (m[1] - p["e"][1]) / span, F.when(nose, angle(minus(neck, p["e"]), minus(neck, m))),
    ]
    return df.select(*keep, "ok", *(F.when(F.col("ok"), v).alias(n) for v, n in zip(values, VIEW, strict=True)))


def two_views(df: DataFrame) -> DataFrame:
    """One row a capture: the features of both views, prefixed (FEA-03, JOI-06). One shuffle on the capture."""
    camera = F.when(F.col("vec_id") % 2 == 0, "cam01").otherwise("cam02")
    pairs = df.withColumn("capture_id", F.floor(F.col("vec_id") / 2)).withColumn("camera", camera)
    pick = lambda cam, c: F.max(F.when(F.col("camera") == cam, F.col(c))).alias(f"{cam}_{c}")
    return pairs.groupBy("capture_id").agg(F.count_distinct("camera").alias("views"), F.bool_and("ok").alias("usable"), F.max(F.when(F.col("camera") == "cam01", F.col("label"))).alias("label"), *(pick(cam, c) for cam in ("cam01", "cam02") for c in VIEW))


# Names of what is derived from joints in space.
SPACE = (
    "shoulder_roll_deg", "hip_roll_deg", "torso_lateral_lean_deg", "torso_sagittal_lean_deg", "torso_3d_inclination_deg", "head_torso_angle_3d_deg", "head_depth_offset_norm", "head_lateral_offset_norm",
    "shoulder_depth_asymmetry_norm", "hip_depth_asymmetry_norm",
)
#: names of the coordinates in space, before SPACE
PLACES = tuple(f"{NAMES[j]}_{a}" for j in (0, *CORE) for a in "xyz")


def _scaled(df: DataFrame) -> DataFrame:
    """Joints of pose3d centred at the hips and scaled by the farthest core joint; ``ok`` and ``nose_ok``."""
    seen = lambda j: F.col(f"x{j}").isNotNull() & F.col(f"y{j}").isNotNull() & F.col(f"z{j}").isNotNull()
    df = df.select("vec_id", "label", seen(0).alias("nose_ok"), (seen(5) & seen(6) & seen(11) & seen(12)).alias("valid"), *((F.col(f"{a}{j}") - (F.col(f"{a}11") + F.col(f"{a}12")) / 2).alias(f"{a}{j}") for j in (0, *CORE) for a in "xyz"))
    far = F.greatest(*(F.when(F.col("valid"), norm(*(F.col(f"{a}{j}") for a in "xyz"))) for j in (0, *CORE)))
    df = df.withColumn("far", far)
    return df.select("vec_id", "label", "nose_ok", (F.col("valid") & (F.col("far") >= EPS)).alias("ok"), *(F.when(F.col("valid") & (F.col("far") >= EPS), F.col(f"{a}{j}") / F.col("far")).alias(f"{a}{j}") for j in (0, *CORE) for a in "xyz"))


def space_features(df: DataFrame) -> DataFrame:
    """Camera-frame features and coordinates (FEA-05)."""
    df = _settled(_scaled(df))
    p = {j: tuple(F.col(f"{a}{j}") for a in "xyz") for j in (0, *CORE)}
    m, hip, nose = mid(p[5], p[6]), mid(p[11], p[12]), F.col("nose_ok")
    t, head = minus(m, hip), minus(p[0], m)
    values = [
        slope(p[6][0] - p[5][0], p[6][1] - p[5][1]), slope(p[12][0] - p[11][0], p[12][1] - p[11][1]), F.degrees(F.atan2(t[0], -t[1])), F.degrees(F.atan2(t[2], -t[1])),
        angle(t, (F.lit(0.0), F.lit(-1.0), F.lit(0.0))), F.when(nose, angle(head, t)), F.when(nose, head[2]), F.when(nose, head[0]), p[6][2] - p[5][2], p[12][2] - p[11][2],
    ]
    return df.select("vec_id", "label", "ok", *(F.when(nose if j == 0 else F.lit(True), F.col(f"{a}{j}")).alias(f"{NAMES[j]}_{a}") for j in (0, *CORE) for a in "xyz"), *(F.when(F.col("ok"), v).alias(n) for v, n in zip(values, SPACE, strict=True)))


def _settled(df: DataFrame) -> DataFrame:
    """The same rows behind a one-row ``inline``: filters and projections above aren't merged into those below, whose nested expressions would be
    repeated at every use (a filter on the body frame didn't plan within a minute without it). Stays in generated code."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def body_frame(df: DataFrame) -> DataFrame:
    """Canonical coordinates: Y along the torso, X along the hips made orthogonal, Z = X x Y; reason of failure (FEA-06)."""
    seen = lambda j: F.col(f"x{j}").isNotNull() & F.col(f"y{j}").isNotNull() & F.col(f"z{j}").isNotNull()
    c = {a: (F.col(f"{a}11") + F.col(f"{a}12")) / 2 for a in "xyz"}
    df = df.select("vec_id", "label", seen(0).alias("nose_ok"), (seen(5) & seen(6) & seen(11) & seen(12)).alias("valid"), *((F.col(f"{a}{j}") - c[a]).alias(f"{a}{j}") for j in (0, *CORE) for a in "xyz"))
    t = tuple((F.col(f"{a}5") + F.col(f"{a}6")) / 2 for a in "xyz")
    w = tuple(F.col(f"{a}12") - F.col(f"{a}11") for a in "xyz")
    df = df.withColumns({"tn": norm(*t), "wn": norm(*w)})
    df = df.withColumns({f"axis_Y{i}": F.when(F.col("tn") >= EPS, t[i] / F.col("tn")) for i in range(3)} | {f"axis_W{i}": F.when(F.col("wn") >= EPS, w[i] / F.col("wn")) for i in range(3)})
    Y, W = tuple(F.col(f"axis_Y{i}") for i in range(3)), tuple(F.col(f"axis_W{i}") for i in range(3))
    df = df.withColumn("wy", dot(W, Y)).withColumns({f"axis_U{i}": W[i] - F.col("wy") * Y[i] for i in range(3)})
    U = tuple(F.col(f"axis_U{i}") for i in range(3))
    df = df.withColumn("un", norm(*U)).withColumns({f"axis_X{i}": F.when(F.col("un") >= EPS, U[i] / F.col("un")) for i in range(3)})
    X = tuple(F.col(f"axis_X{i}") for i in range(3))
    df = df.withColumns({"axis_Z0": X[1] * Y[2] - X[2] * Y[1], "axis_Z1": X[2] * Y[0] - X[0] * Y[2], "axis_Z2": X[0] * Y[1] - X[1] * Y[0]})
    df = _settled(df)
    axes = {a: tuple(F.col(f"axis_{A}{i}") for i in range(3)) for a, A in zip("xyz", "XYZ", strict=True)}
    out = df.select("vec_id", "label", "nose_ok", "valid", "tn", "wn", "un", *(dot(axes[a], tuple(F.col(f"{b}{j}") for b in "xyz")).alias(f"{a}{j}") for j in (0, *CORE) for a in "xyz"))
    far = F.greatest(*(norm(*(F.col(f"{a}{j}") for a in "xyz")) for j in (0, *CORE)))
    out = _settled(out.withColumn("far", far))
    reason = F.when(~F.col("valid"), "missing_core").when(F.col("tn") < EPS, "torso").when(F.col("wn") < EPS, "hip_width").when(F.col("un") < EPS, "x_axis").when(F.col("far") < EPS, "scale")
    return out.select("vec_id", "label", "nose_ok", reason.alias("reason"), *(F.when(reason.isNull(), F.col(f"{a}{j}") / F.col("far")).alias(f"{a}{j}") for j in (0, *CORE) for a in "xyz"))


#: joints of the body frame, in order, and what is derived from them
BODY_JOINTS = (0, *CORE)
BODY = tuple(n for n in SPACE if n not in ("torso_lateral_lean_deg", "torso_sagittal_lean_deg", "hip_depth_asymmetry_norm"))


def body_features(df: DataFrame) -> DataFrame:
    """FEA-08: 22 features in the body frame, inclination against (0, 1, 0): coordinates of the nose and the core joints, then BODY; what needs the nose is NULL without it."""
    df = body_frame(df)
    p = {j: tuple(F.col(f"{a}{j}") for a in "xyz") for j in BODY_JOINTS}
    m, nose = mid(p[5], p[6]), F.col("nose_ok")
    t, head = minus(m, mid(p[11], p[12])), minus(p[0], m)
    values = [
        slope(p[6][0] - p[5][0], p[6][1] - p[5][1]), slope(p[12][0] - p[11][0], p[12][1] - p[11][1]), angle(t, (F.lit(0.0), F.lit(1.0), F.lit(0.0))),
        F.when(nose, angle(head, t)), F.when(nose, head[2]), F.when(nose, head[0]), p[6][2] - p[5][2],
    ]
    joints = [F.when(nose if j == 0 else F.lit(True), F.col(f"{a}{j}")).alias(f"{NAMES[j]}_{a}") for j in BODY_JOINTS for a in "xyz"]
    return df.select("vec_id", "label", "reason", *joints, *(v.alias(n) for v, n in zip(values, BODY, strict=True)))
