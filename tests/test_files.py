"""Sources and sinks on small files written here."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import audit
from tarn.sources import files


def test_csv_mark_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,n,x\r\nä,1,NaN\r\n,2,0.5\r\n".encode())
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "name string, n int, x double").collect()
    assert [tuple(r) for r in rows] == [("ä", 1, None), (None, 2, 0.5)]
    assert files.read_csv(spark, str(tmp_path / "a.csv")).columns == ["name", "n", "x"]


def person(**more):
    return {"keypoints": [[1.0, 2.0]] * 17, "confidences": [0.9] * 17} | more


def test_documents_with_fallback(spark, tmp_path):
    (tmp_path / "s").mkdir(), (tmp_path / "k").mkdir()
    (tmp_path / "s" / "i1_selected_person.json").write_text(json.dumps(person(has_target=True, composite_score=0.5)))
    (tmp_path / "s" / "i2_selected_person.json").write_text(json.dumps(person(has_target=False)))
    (tmp_path / "k" / "i3.json").write_text(json.dumps(person(has_pose=True)))
    (tmp_path / "k" / "i4.json").write_text(json.dumps(person(has_pose=True, confidences=[0.9] * 16)))
    (tmp_path / "k" / "i1.json").write_text(json.dumps(person(has_pose=False)))
    images = spark.createDataFrame([(f"i{k}",) for k in range(1, 6)], "image_id string")
    got = files.annotated(images, files.read_documents(spark, str(tmp_path / "s"), files.PERSON, "_selected_person"), files.read_documents(spark, str(tmp_path / "k"), files.PERSON))
    assert {r.image_id: r.status for r in got.collect()} == {"i1": "OK", "i2": "NO_TARGET", "i3": "OK", "i4": "INVALID_SHAPE", "i5": "INVALID_ANNOTATION"}


def test_literal_nan_and_rigs(spark, tmp_path):
    (tmp_path / "c1_3d_keypoints.json").write_text('{"capture_id": "c1", "valid_core_joints": 4, "keypoints_3d_m": [[NaN, NaN, NaN], [1, 2, 3]]}')
    (tmp_path / "CAL_001_stereo.json").write_text(json.dumps({"calibration_id": "CAL_001", "extrinsics": {"translation_vector_T": [[0.1], [0], [0]]}}))
    r = files.read_documents(spark, str(tmp_path), files.SPACE, "_3d_keypoints").first()
    assert r.key == "c1" and np.isnan(r.doc.keypoints_3d_m[0][0]) and r.doc.keypoints_3d_m[1] == [1, 2, 3]
    assert [x.calibration_id for x in files.read_rigs(spark, str(tmp_path)).collect()] == ["CAL_001"]
    assert files.read_rigs(spark, str(tmp_path), ["CAL_002"]).collect() == []


def test_coco(spark, tmp_path):
    (tmp_path / "train").mkdir()
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 5}, {"id": 2, "file_name": "b.jpg", "width": 4, "height": 5}], "categories": [{"id": 7, "name": "good"}],
           "annotations": [{"id": 9, "image_id": 1, "category_id": 7, "bbox": [0, 0, 1, 1], "keypoints": [1, 2, 2, 3, 4, 0]}]}
    (tmp_path / "train" / "annotations.json").write_text(json.dumps(doc))
    rows = {r.image_id: r for r in files.read_coco(spark, str(tmp_path)).collect()}
    assert rows[1].class_name == "good" and rows[1].points == [[1, 2, 2], [3, 4, 0]] and rows[1].split == "train"
    assert rows[2].annotation_id == -1 and rows[2].class_name == "no_annotation"


def test_config():
    got = files.read_config("# set\ntrain: ../train/images\nkpt_shape: [7, 3]\nnames:\n  0: good\n  1: 'bad'\nflip:\n- 1\n- 0\nnc: 2 # two\n")
    assert got == {"train": "../train/images", "kpt_shape": [7, 3], "names": {0: "good", 1: "bad"}, "flip": [1, 0], "nc": 2}


def test_listing(spark, tmp_path):
    (tmp_path / "valid" / "upright").mkdir(parents=True)
    (tmp_path / "valid" / "upright" / "x.png").write_bytes(b"abc")
    r = files.list_files(spark, str(tmp_path)).first()
    assert (r.split, r.label, r.bytes, r.sha256) == ("valid", "upright", 3, hashlib.sha256(b"abc").hexdigest())


def test_difference_hash(spark):
    rng = np.random.default_rng(5)
    px = rng.integers(0, 256, (20, 8, 9))
    rows = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(px)] + [(99, [1, 2])], "k int, gray array<int>").select("k", files.difference_hash().alias("h")).collect()
    for r in rows:
        if r.k == 99:
            assert r.h is None
        else:
            bits = (px[r.k][:, 1:] > px[r.k][:, :-1]).ravel()
            assert r.h == f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_csv(df, str(tmp_path / "c"), ["v", "k"])
    files.write_csv(df.filter("k = 1"), str(tmp_path / "c"), ["v", "k"], append=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    with pytest.raises(ValueError):
        files.write_csv(df, str(tmp_path / "c"), ["k", "v"], append=True)
    files.write_csv(df.limit(0), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["k", "v"]
    files.write_documents(df, str(tmp_path / "d"), "k")
    assert json.loads(spark.read.text(str(tmp_path / "d")).filter("value like '%:2%'").first().value) == {"k": 2, "v": None}
    df.write.parquet(str(tmp_path / "p"))
    files.delete_keys(spark, str(tmp_path / "p"), str(tmp_path / "q"), "k", df.filter("k = 1"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "q")).collect()] == [2]
    assert files.markdown(df).splitlines()[2] == "| 1 | a |"
    assert [r.k for r in files.pending(df, df.filter("k = 2"), "k").collect()] == [1]


def test_checks(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None)], "k int, v double")
    got = {r.expectation: r.violations for r in audit.expectations(df, {"set": F.col("v") > 0}, unique="k").collect()}
    assert got == {"set": 1, "unique_key": 1}
    with pytest.raises(ValueError):
        audit.require(audit.expectations(df, {"set": F.col("v") > 0}))
    assert audit.with_defaults(df, chair="none", V=1).columns == ["k", "v", "chair"]
    assert audit.next_id(spark.createDataFrame([], "id string"), "id", "CAP", 6).first().next_id == "CAP000001"


def test_a_report_in_files(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else f"a|{i}") for i in range(50)], "k long, v string").repartition(4)
    files.write_report(df, f"file://{tmp_path}/r", "k")
    text = [r.value for p in sorted((tmp_path / "r").glob("part-*")) for r in spark.read.text(f"file://{p}").collect()]
    assert text == ["| k | v |", "|---|---|", *(f"| {i} | {'' if i == 3 else f'a{chr(92)}|{i}'} |" for i in range(50))]
    assert "\n".join(text) == files.markdown(df.orderBy("k"))
    assert [r.line for r in files.report_lines(df.limit(0), "k").orderBy("nth").collect()] == text[:2]


def test_configurations_and_keys_in_folders(spark, tmp_path):
    rows = spark.createDataFrame([("a b", "x: 1\ny: [2, z]"), ("c", ""), ("d", None)], "name string, text string")
    files.write_texts(rows, f"file://{tmp_path}/c", "name", "text")
    got = {(r.path.split("/key=")[1].split("/")[0], r.entry, r["value"]) for r in files.read_configs(spark, f"file://{tmp_path}/c", "*.txt").collect()}
    assert {(e, v) for _, e, v in got} == {("x", "1"), ("y", "[2, 'z']")}
    docs = spark.createDataFrame([("k/1+ %", '{"image_id": "i", "composite_score": NaN}'), ("k2", '{"image_id": "br'), ("k3", "")], "name string, text string")
    files.write_texts(docs, f"file://{tmp_path}/d", "name", "text")
    read = {r.key: r.doc for r in files.read_documents(spark, f"file://{tmp_path}/d", files.PERSON, glob="*.txt").collect()}
    assert read["k/1+ %"].image_id == "i" and read["k/1+ %"].composite_score != read["k/1+ %"].composite_score
    assert read["k2"] is None or read["k2"].image_id is None
