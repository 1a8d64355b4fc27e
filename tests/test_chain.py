"""The chain from joints to classes, the runner, and the live rules on hand-made rows."""

import json

from pyspark.sql import functions as F

from tarn.operators import learning, pose, stereo
from tarn.plans import runner
from tarn.sources import tables
from tarn.streaming import chain, live

SF = "/root/testdata/sf0.001"


def test_pairs_one_table_and_stream(spark, tmp_path):
    views = tables.pose2d(spark, SF, (0, 3, 4, 5, 6, 11, 12))
    f = pose.two_views(pose.view_features(views)).withColumn("label", tables.label("label"))
    names = [f"{cam}_{c}" for cam in ("cam01", "cam02") for c in pose.VIEW]
    model = learning.fit(f.filter("usable"), names, list(tables.CLASSES), "forest", trees=3)
    assert len(model.features) == 39  # the ear features of the frontal view are never there
    got = chain.predict_pairs(views, model)
    rows = {r.capture_id: r for r in got.collect()}
    assert {r.code for r in rows.values()} == {"VALID", "REJECT_CORE_KEYPOINTS"}
    assert all((r.label_pred is None) == (r.code != "VALID") for r in rows.values())
    alone = chain.predict_pairs(views.filter("vec_id < 1"), model).first()
    assert alone.code == "REJECT_MISSING_VIEW" and json.loads(chain.as_json(chain.predict_pairs(views.filter("vec_id < 1"), model)).first().value)["label_pred"] is None
    views.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = chain.serve(spark.readStream.schema(views.schema).parquet(str(tmp_path / "in")), lambda b: chain.predict_pairs(b, model), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {r.capture_id: r.code for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {k: r.code for k, r in rows.items()}


def test_stereo(spark):
    pose3 = tables.pose3d(spark, SF, range(17))
    f = pose.space_features(tables.pose3d(spark, SF)).filter("ok").withColumn("label", tables.label("label"))
    model = learning.fit(f.withColumnRenamed("vec_id", "capture_id"), list(pose.SPACE), list(tables.CLASSES), "boosted", rounds=2, depth=2)
    rigs = stereo.example_rigs()
    rows = chain.predict_stereo(stereo.synthetic_pairs(pose3, rigs), rigs, model).collect()
    assert len(rows) == pose3.count() and all((r.label_pred is None) == (r.code != "VALID") for r in rows)
    assert any(r.code == "VALID" for r in rows) and any(r.code.startswith("REJECT_3D") for r in rows)


def test_a_saved_model_answers_the_same(spark, tmp_path):
    """From joints to class: the model read back from its files gives the answers of the one that was fitted, and those of its trees asked one row at a time."""
    views = pose.two_views(pose._settled(pose.view_features(tables.pose2d(spark, SF, chain.JOINTS)))).filter("usable").withColumn("label", tables.label("label"))
    names = [f"{cam}_{c}" for cam in ("cam01", "cam02") for c in pose.VIEW]
    model = learning.fit(views, names, list(tables.CLASSES), "boosted", rounds=3, depth=2)
    model.save(f"file://{tmp_path}/m")
    again = learning.Fitted.load(spark, f"file://{tmp_path}/m")
    base = F.when(F.col("capture_id") % 3 > 0, 950.0)
    pairs = tables.pairs(spark, SF, chain.JOINTS).withColumns({"a_base_cx": base, "b_base_cx": base, "left_side": F.col("capture_id") % 2 == 0})
    rows = {r.capture_id: r for r in chain.infer_pairs(pairs, model).collect()}
    assert rows == {r.capture_id: r for r in chain.infer_pairs(pairs, again).collect()}
    assert {r.status for r in rows.values()} == {"VALID", "REJECTED"}
    for r in rows.values():
        if r.status == "VALID":
            assert r.prediction == max(tables.CLASSES, key=lambda c: (r.probabilities[c], -tables.CLASSES.index(c))) and r.confidence == max(r.probabilities.values()) and abs(sum(r.probabilities.values()) - 1) < 1e-9
        else:
            assert r.prediction == "REJECT" and r.confidence == 0 and not any(r.probabilities.values())
    # views as they are, without desk rules: features straight to the trees
    asked = views.select("capture_id", *again.features).toPandas().set_index("capture_id")
    filled = asked.astype(float).fillna(again.medians)
    scaled = (filled - [again.scales[c][0] for c in again.features]) / [again.scales[c][1] or 1.0 for c in again.features]
    want = dict(zip(asked.index, again.model.probabilities(scaled.to_numpy()), strict=True))
    for r in chain.predict_pairs(tables.pose2d(spark, SF, chain.JOINTS), again).filter("code = 'VALID'").collect():
        assert all(abs(r.probs[c] - p) < 1e-9 for c, p in zip(tables.CLASSES, want[r.capture_id], strict=True))


def test_profiles(spark):
    rows = [("aside", 120.0, 100.0, 60.0, 100.0), ("other", 80.0, 100.0, 60.0, 100.0), ("slouch", 100.0, 104.0, 50.0, 100.0), ("front", 100.0, 108.0, 70.0, 100.0), ("back", 100.0, 93.0, 60.0, 100.0), ("none", 100.0, 104.0, None, 100.0), ("unknown", 500.0, 100.0, 60.0, None)]
    df = spark.createDataFrame([(n, cx, w, h, b, b, 0.6) for n, cx, w, h, b in rows], "n string, cx double, w double, head double, base_cx double, base_w double, base_ratio double")
    got = {r.n: r.profile for r in live.choose_profile(df).collect()}
    assert got == {"aside": "leaning_left", "other": "leaning_right", "slouch": "slouching", "front": "leaning_forward", "back": "leaning_backward", "none": "upright", "unknown": "upright"}
    profiles = spark.createDataFrame([(p, float(i)) for i, p in enumerate(live.PROFILES)], "profile string, nose_x double")
    assert live.with_profile(live.choose_profile(df), profiles).filter("n = 'back'").first().cam02_nose_x == 2.0


def test_recording_stream(spark, tmp_path):
    spark.range(6).select(F.col("id").alias("frame"), F.lit("upright").alias("truth"), F.when(F.col("id") > 1, F.when(F.col("id") > 2, "upright").otherwise("slouching")).alias("prediction")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("frame long, truth string, prediction string").parquet(str(tmp_path / "in"))
    q = live.record(src, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = {r.truth: (r.frames, r.right) for r in live.recording_summary(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"upright": (4, 3), None: (4, 3)}


def test_runner(spark, tmp_path):
    out = str(tmp_path / "a")
    write = runner.Step("write", lambda s: s.range(3).write.parquet(out), (out,))
    bad = runner.Step("bad", lambda s: None, (str(tmp_path / "b"),))
    last = runner.Step("last", lambda s: None)
    assert [r["status"] for r in runner.run(spark, [write, bad, last])] == ["done", "failed"]
    assert [r["status"] for r in runner.run(spark, [write, bad, last], skip_written=True, go_on=True)] == ["skipped", "failed", "done"]
    assert [r["status"] for r in runner.run(spark, [write, bad, last], first=3)] == ["done"]
    assert [r["status"] for r in runner.run(spark, [write], audit_only=True)] == ["checked"]
