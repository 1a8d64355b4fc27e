"""From detected joints to a predicted class, the same for one pair, a table and a stream (STM-05, 06, 07; ORC-03, 04). Projections only, so streams share them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.geometry import norm
from tarn.operators import pose, quality, stereo
from tarn.operators.learning import Fitted
from tarn.streaming import live

JOINTS = (0, 3, 4, 5, 6, 11, 12)


def _answer(df: DataFrame, model: Fitted) -> DataFrame:
    valid = F.col("code") == "VALID"
    out = model.predict(df)
    return out.select("capture_id", "code", *(F.when(valid, F.col(c)).alias(c) for c in ("label_pred", "probs", "confidence")))


def predict_pairs(views: DataFrame, model: Fitted) -> DataFrame:
    """STM-05: two views of each capture (pose2d). Captures that fail a check have a code and no prediction."""
    f = pose.two_views(pose.view_features(views))
    return _answer(f.withColumn("code", F.when(F.col("views") < 2, "REJECT_MISSING_VIEW").when(~F.col("usable"), "REJECT_CORE_KEYPOINTS").otherwise("VALID")), model)


def _described(df: DataFrame, p: str, cam: str, lateral: bool, desk: bool, height: int) -> DataFrame:
    """One view of each row, columns {p}_*: hips put under the shoulders where they are hidden (desk), then its features as {cam}_*, {p}_ok, {p}_reason and {p}_extrapolated."""
    own = {f"{p}_{a}{j}": f"{a}{j}" for a in "xyc" for j in JOINTS} | {f"{p}_base_cx": "base_cx"}
    df = df.withColumnsRenamed({k: v for k, v in own.items() if k in df.columns})
    if "base_cx" not in df.columns:
        df = df.withColumn("base_cx", F.lit(None).cast("double"))
    df = live.extrapolate_hips(df, height, lateral) if desk else df.withColumn("extrapolated", F.lit(False))
    # the gate sees what the features see
    df = df.withColumns({f"{p}_{a}{j}": F.col(f"{a}{j}") for a in "xyc" for j in pose.CORE}).withColumnRenamed("extrapolated", f"{p}_extrapolated")
    df = pose._settled(df.withColumns({"lateral": F.lit(lateral), "left_side": F.coalesce(F.col("left_side"), F.lit(False)) if lateral else F.lit(False)}))
    df = pose.view_features(df).drop("base_cx", "nose_ok", "lateral")
    return pose._settled(df.withColumnsRenamed({"ok": f"{p}_ok", "reason": f"{p}_reason"} | {c: f"{cam}_{c}" for c in pose.VIEW}))


def _prediction(df: DataFrame, model: Fitted | None, keep: list[str]) -> DataFrame:
    """``status``, ``reason``, ``prediction``, ``confidence`` and ``probabilities``: REJECT with zeros where a reason stands."""
    valid = F.col("reason") == "OK"
    if model is None:
        return df.select(*keep, F.when(valid, "VALID").otherwise("REJECTED").alias("status"), "reason")
    out = model.predict(df)
    none = F.map_from_arrays(F.array(*map(F.lit, model.classes)), F.array_repeat(F.lit(0.0), len(model.classes)))
    return out.select(
        *keep, F.when(valid, "VALID").otherwise("REJECTED").alias("status"), "reason", F.when(valid, F.col("label_pred")).otherwise("REJECT").alias("prediction"),
        F.when(valid, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(valid, F.col("probs")).otherwise(none).alias("probabilities"),
    )


def infer_pairs(pairs: DataFrame, model: Fitted | None = None, desk: bool = True, height: int = 1080) -> DataFrame:
    """STM-05, in one call: two views a row to a class. Needs ``capture_id``, {a,b}_has, {a,b}_x, _y, _c of JOINTS and ``left_side``; optional {a,b}_base_cx (``tracker.follow`` has it after the same frame)
    and ``swap`` (STM-04). The first failing step gives the ``reason``: nobody in view, the gate (QC-07), the features. Without a model the answer ends there. Nothing is shuffled."""
    df = live.swapped(pairs) if "swap" in pairs.columns else pairs
    df = _described(_described(df, "a", "cam01", False, desk, height), "b", "cam02", True, desk, height)
    df = quality.reject_gate(df, desk=desk)
    failed = F.format_string("REJECT_2D_FEATURE_EXTRACTION_FAILED: %s | %s", *(F.coalesce(f"{p}_reason", F.lit("Success")) for p in "ab"))
    nobody = [F.when(~F.coalesce(F.col(f"{p}_has"), F.lit(False)), f"{cam}: No person detected") for p, cam in (("a", "CAM01"), ("b", "CAM02"))]
    reason = F.coalesce(*nobody, F.when(F.col("code") != "VALID_2D", F.col("code")), F.when(~F.coalesce(F.col("a_ok") & F.col("b_ok"), F.lit(False)), failed), F.lit("OK"))
    return _prediction(pose._settled(df.withColumn("reason", reason)), model, ["capture_id", "a_extrapolated", "b_extrapolated"])


def infer_single(views: DataFrame, profiles: DataFrame, model: Fitted | None = None, desk: bool = True, height: int = 1080) -> DataFrame:
    """STM-06, in one call: a frontal view a row, the other camera's features taken from the profile that the baseline suggests (FEA-18). Needs ``capture_id``, a_has, a_x, a_y, a_c of JOINTS and
    the baseline base_cx, base_w, base_ratio (NULL: none); ``profiles`` as ``live.profile_table``."""
    seen = lambda j: F.col(f"a_x{j}").isNotNull() & F.col(f"a_y{j}").isNotNull()
    middle = lambda a: (F.col(f"a_{a}5") + F.col(f"a_{a}6")) / 2
    df = views.withColumns({"cx": middle("x"), "w": norm(F.col("a_x6") - F.col("a_x5"), F.col("a_y6") - F.col("a_y5")), "head": F.when(seen(0), middle("y") - F.col("a_y0")), "a_base_cx": F.col("base_cx")})
    df = live.choose_profile(df).drop("cx", "w", "head", "base_cx", "base_w", "base_ratio").withColumn("left_side", F.lit(False))
    df = _described(df, "a", "cam01", False, desk, height)
    low = [F.when(~F.coalesce(F.col(f"a_c{j}") >= live.SURE, F.lit(False)), f"REJECT_CAM01_LOW_CONF_JOINT_{j}") for j in pose.CORE]
    failed = F.format_string("REJECT_2D_FEATURE_EXTRACTION_FAILED: %s", F.coalesce("a_reason", F.lit("no extent")))
    reason = F.coalesce(F.when(~F.coalesce(F.col("a_has"), F.lit(False)), "REJECT_NO_PERSON_DETECTED"), *low, F.when(~F.coalesce(F.col("a_ok"), F.lit(False)), failed), F.lit("OK"))
    df = live.with_profile(pose._settled(df.withColumn("reason", reason)), profiles)
    return _prediction(df, model, ["capture_id", "a_extrapolated", "profile"])


def predict_stereo(pairs: DataFrame, rig: stereo.Rig | dict[str, stereo.Rig], model: Fitted) -> DataFrame:
    """STM-07: joints of two calibrated views, lifted, gated and described in the camera's frame."""
    lifted = pose._settled(stereo.live_pose(pairs, rig))
    # the gate's answer goes along as the label, so joints are lifted once and nothing is joined
    code = F.when(F.col("code") == "VALID_3D", "VALID").otherwise(F.col("code"))
    f = pose.space_features(lifted.withColumnRenamed("capture_id", "vec_id").withColumn("label", code))
    return _answer(pose._settled(f).withColumnsRenamed({"vec_id": "capture_id", "label": "code"}), model)


def as_json(answers: DataFrame) -> DataFrame:
    """ORC-03, ORC-04: one JSON text a capture with all fields of its answer; what a rejected one lacks is null."""
    return answers.select("capture_id", F.to_json(F.struct(*(c for c in answers.columns if c != "capture_id")), {"ignoreNullFields": "false"}).alias("value"))


def serve(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Answers each micro-batch of whole pairs and appends it under its number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
