"""Feature drivers over a manifest: every capture gets a status, and features only where it is USABLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators import pose


def _only_usable(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    return df.select(*keep, "status", *(F.when(F.col("status") == "USABLE", F.col(c)).alias(c) for c in features))


def views_of(manifest: DataFrame, views: DataFrame) -> DataFrame:
    """FEA-09: 42 features of both views. INVALID_ANNOTATION: a view is missing; INVALID_CORE_KEYPOINTS: a core joint of one is. ``manifest`` has ``capture_id``, ``views`` is pose2d."""
    two = pose.two_views(pose.view_features(views)).drop("label")
    features = [f"{cam}_{c}" for cam in ("cam01", "cam02") for c in pose.VIEW]
    status = F.when(F.coalesce("views", F.lit(0)) < 2, "INVALID_ANNOTATION").when(~F.coalesce("usable", F.lit(False)), "INVALID_CORE_KEYPOINTS").otherwise("USABLE")
    return _only_usable(manifest.join(two, "capture_id", "left").withColumn("status", status), manifest.columns, features)


def spaces_of(manifest: DataFrame, poses: DataFrame) -> DataFrame:
    """FEA-10: camera-frame features. EXCLUDED: the manifest's ``decision`` does not include it; INVALID_ANNOTATION: no document; INVALID_3D_GEOMETRY: a core joint is missing or it has no extent."""
    f = pose.space_features(poses).drop("label").withColumnRenamed("vec_id", "capture_id").withColumn("_there", F.lit(1))
    features = [c for c in f.columns if c not in ("capture_id", "ok", "_there")]
    status = F.when(~F.coalesce(F.col("decision").startswith("INCLUDE_3D"), F.lit(False)), "EXCLUDED").when(F.col("_there").isNull(), "INVALID_ANNOTATION").when(~F.coalesce("ok", F.lit(False)), "INVALID_3D_GEOMETRY").otherwise("USABLE")
    return _only_usable(manifest.join(f, "capture_id", "left").withColumn("status", status), manifest.columns, features)


def bodies_of(manifest: DataFrame, poses: DataFrame) -> DataFrame:
    """FEA-11: body-frame features; NO_FILE without a document, CANON_FAILED with the ``reason``."""
    f = pose.body_features(poses).drop("label").withColumnRenamed("vec_id", "capture_id").withColumn("_there", F.lit(1))
    features = [c for c in f.columns if c not in ("capture_id", "reason", "_there")]
    status = F.when(~F.coalesce(F.col("decision").startswith("INCLUDE_3D"), F.lit(False)), "EXCLUDED").when(F.col("_there").isNull(), "NO_FILE").when(F.col("reason").isNotNull(), "CANON_FAILED").otherwise("USABLE")
    return _only_usable(manifest.join(f, "capture_id", "left").withColumn("status", status), [*manifest.columns, "reason"], features)


def semantics(bodies: DataFrame) -> DataFrame:
    """FEA-07: four facts that hold in every body frame: hips centred, right hip on the positive side, shoulders above, torso upright."""
    tiny = lambda c: F.abs(c) < 1e-6
    c = lambda a, i, j: F.col(f"{a}{i}") + F.col(f"{a}{j}")
    facts: dict[str, Column] = {
        "hips_centred": tiny(c("x", 11, 12)) & tiny(c("y", 11, 12)) & tiny(c("z", 11, 12)), "hip_axis": F.col("x12") > F.col("x11"), "shoulders_above": c("y", 5, 6) > 0, "torso_upright": tiny(c("x", 5, 6)) & tiny(c("z", 5, 6)),
    }
    return bodies.filter(F.col("reason").isNull()).agg(F.count("*").alias("bodies"), *(F.count_if(v).alias(k) for k, v in facts.items()))
