"""Learners on a separable toy set; what is fitted must not see the held-out fold."""

import math

import pytest
from pyspark.sql import functions as F

from tarn.operators import evaluate, learning

CLASSES = ["upright", "slouching", "leaning"]


@pytest.fixture(scope="module")
def toy(spark):
    k = F.col("id") % 3
    return spark.range(240).select(
        F.col("id").alias("capture_id"), (F.col("id") % 4).cast("int").alias("fold"), F.element_at(F.array(*map(F.lit, CLASSES)), (k + 1).cast("int")).alias("label"),
        F.when(F.col("id") % 10 > 0, k * 2.0 + F.sin(F.col("id") * 1.7) * 0.3).alias("f1"), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.cos(F.col("id") * 0.9) - k).alias("f2"), F.lit(None).cast("double").alias("f3"),
    ).cache()


@pytest.mark.parametrize("kind", ["forest", "perceptron", "boosted"])
def test_out_of_fold(toy, kind):
    small = {"boosted": {"rounds": 5, "depth": 3}, "forest": {"trees": 10}, "perceptron": {"hidden": (8,)}}[kind]
    rows = learning.out_of_fold(toy, ["f1", "f2", "f3"], CLASSES, kind, [0, 1], **small).collect()
    assert len(rows) == 120 and len({r.capture_id for r in rows}) == 120
    assert sum(r.label_true == r.label_pred for r in rows) / len(rows) > 0.85
    for r in rows:
        assert set(r.probs) == set(CLASSES) and abs(sum(r.probs.values()) - 1) < 1e-6 and abs(max(r.probs.values()) - r.confidence) < 1e-9
        assert r.probs[r.label_pred] == pytest.approx(r.confidence)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_save_and_load(spark, toy, tmp_path, kind):
    m = learning.fit(toy, ["f1", "f2", "f3"], CLASSES, kind, weights={"slouching": 1.5}, **({"trees": 5} if kind == "forest" else {"rounds": 3, "depth": 2}))
    assert m.features == ["f1", "f2"]
    m.save(str(tmp_path / "m"))
    again = learning.Fitted.load(spark, str(tmp_path / "m"))
    key = lambda f: sorted((r.capture_id, r.label_pred, round(r.confidence, 9)) for r in f.predict(toy).collect())
    assert key(m) == key(again)


def test_draws():
    got = list(learning.draws({"a": [1, 2], "b": [3, 4, 5]}, 25))
    assert len(got) == 6 and got == list(learning.draws({"a": [1, 2], "b": [3, 4, 5]}, 25))


def test_search(toy):
    params, score = learning.search(toy, ["f1", "f2"], CLASSES, "forest", {"trees": [3, 5], "depth": [2]}, 2, [0, 1])
    assert params["depth"] == 2 and score > 0.8
    params, score = learning.search(toy, ["f1", "f2", "f3"], CLASSES, "boosted", {"rounds": [2], "depth": [1, 3], "rate": [0.0, 0.5]}, 4, [0, 1])
    assert params["rate"] == 0.5 and score > 0.8


def test_paired_t():
    t, p = evaluate.paired_t([0.70, 0.68, 0.72, 0.66, 0.71], [0.60, 0.63, 0.61, 0.64, 0.62])
    u = t / math.sqrt(1 + t * t / 4)  # four degrees of freedom have a closed form
    assert t == pytest.approx(0.074 / math.sqrt(0.00143 / 5)) and p == pytest.approx(1 - 0.75 * u * (1 - u * u / 12), abs=1e-9)
    assert evaluate.paired_t([0.5, 0.5], [0.5, 0.5]) == (0.0, 1.0)
