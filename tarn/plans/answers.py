"""Queries from joints to a class: a model is fitted, saved, read back and asked by the live chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import learning, pose, stereo
from tarn.plans.registry import query, rounded
from tarn.plans.vision import _desk_pairs
from tarn.session import workspace
from tarn.sources import tables as T
from tarn.streaming import chain, live

_VIEWS = [f"{cam}_{c}" for cam in ("cam01", "cam02") for c in pose.VIEW]


def _saved(spark, rows, features: list[str]) -> learning.Fitted:
    """A small model of boosted trees, written to the shared folder and read again (SNK-08)."""
    where = workspace(spark, "model")
    learning.fit(rows, features, list(T.CLASSES), "boosted", rounds=3, depth=3, rate=0.3).save(where)
    return learning.Fitted.load(spark, where)


def _views_model(spark, d) -> learning.Fitted:
    two = pose.two_views(pose._settled(pose.view_features(T.pose2d(spark, d, chain.JOINTS)))).filter("usable")
    return _saved(spark, two.withColumn("label", T.label("label")), _VIEWS)


def _space_model(spark, d) -> learning.Fitted:
    space = pose.space_features(T.pose3d(spark, d)).filter("ok").withColumn("label", T.label("label"))
    return _saved(spark, space.withColumnRenamed("vec_id", "capture_id"), [*pose.PLACES, *pose.SPACE])


def _flat(answers, *keep: str):
    """Probabilities as columns, one a class."""
    return rounded(answers.select(*keep, "prediction", "confidence", *(F.element_at("probabilities", c).alias(f"p_{c}") for c in T.CLASSES)))


@query()
def pair_predictions(spark, d):
    """STM-05, ORC-03, SNK-08: two views of each capture, from joints to class and probabilities; tested against the model asked by itself."""
    return _flat(chain.infer_pairs(_desk_pairs(spark, d), _views_model(spark, d)), "capture_id", "status", "reason")


@query()
def single_predictions(spark, d):
    """STM-06, ORC-04, SNK-08: one view of each capture, the other's features from the profile that the baseline suggests."""
    known = F.col("capture_id") % 3 > 0
    one = _desk_pairs(spark, d).withColumns({"base_cx": F.when(known, 950.0), "base_w": F.when(known, 700.0), "base_ratio": F.when(known, 0.5)})
    return _flat(chain.infer_single(one, live.profile_table(spark), _views_model(spark, d)), "capture_id", "status", "reason", "profile")


@query()
def stereo_predictions(spark, d):
    """STM-07, SNK-08: two calibrated views to joints in space, gated, described and classified; each row by its own rig."""
    rigs = stereo.example_rigs()
    out = chain.predict_stereo(stereo.synthetic_pairs(T.pose3d(spark, d, range(17)), rigs), rigs, _space_model(spark, d))
    return rounded(out.select("capture_id", "code", "label_pred", "confidence", *(F.element_at("probs", c).alias(f"p_{c}") for c in T.CLASSES)))
