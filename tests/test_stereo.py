"""Stereo geometry against a plain version with singular values; the rules on the result by hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import stereo
from tarn.sources import tables

SF = "/root/testdata/sf0.001"


def bent(x, y, D):
    k1, k2, p1, p2, k3 = D
    r = x * x + y * y
    radial = 1 + r * k1 + r * r * k2 + r**3 * k3
    return x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y


def projected(X, K, D):
    x, y = bent(X[0] / X[2], X[1] / X[2], D)
    return np.array([K[0, 0] * x + K[0, 1] * y + K[0, 2], K[1, 1] * y + K[1, 2]])


def straightened(p, K, D, R, P):
    y0 = (p[1] - K[1, 2]) / K[1, 1]
    x0 = (p[0] - K[0, 2] - K[0, 1] * y0) / K[0, 0]
    x, y = x0, y0
    for _ in range(stereo.UNDISTORT):
        k1, k2, p1, p2, k3 = D
        r = x * x + y * y
        radial = 1 + r * k1 + r * r * k2 + r**3 * k3
        x, y = (x0 - 2 * p1 * x * y - p2 * (r + 2 * x * x)) / radial, (y0 - p1 * (r + 2 * y * y) - 2 * p2 * x * y) / radial
    h = P[:, :3] @ R @ np.array([x, y, 1])
    return h[:2] / h[2]


def lifted(rig, a, b):
    """(place in the first camera, rectified place, both errors) of one joint seen at a and b (capture size)."""
    a, b = a * rig.scale, b * rig.scale
    u, v = straightened(a, rig.K1, rig.D1, rig.R1, rig.P1), straightened(b, rig.K2, rig.D2, rig.R2, rig.P2)
    A = np.stack([q[i] * P[2] - P[i] for q, P in ((u, rig.P1), (v, rig.P2)) for i in (0, 1)])
    X = np.linalg.svd(A)[2][-1]
    rect = X[:3] / X[3]
    place = rig.R1.T @ rect
    return place, rect, np.linalg.norm(projected(place, rig.K1, rig.D1) - a), np.linalg.norm(projected(rig.R @ place + rig.T, rig.K2, rig.D2) - b)


def seen(rig, X):
    return projected(X, rig.K1, rig.D1) / rig.scale, projected(rig.R @ X + rig.T, rig.K2, rig.D2) / rig.scale


PAIRS = "capture_id long, calibration_id string, p1 array<array<double>>, p2 array<array<double>>, c1 array<double>, c2 array<double>"


def test_lift_equals_singular_values(spark):
    """Exact views, views off by a few pixels, and views that don't fit at all, through rigs that differ."""
    rng, rigs = np.random.default_rng(1), stereo.example_rigs()
    rows, want = [], {}
    for i in range(60):
        name = f"CAL_{i % 10 + 1:03d}"
        X = rng.uniform([-0.4, -0.4, 1.2], [0.4, 0.4, 2.5], (17, 3))
        views = [seen(rigs[name], x) for x in X]
        noise = rng.normal(size=(2, 17, 2)) * (0, 3, 150)[i % 3]
        a, b = (np.stack([v[k] for v in views]) + noise[k] for k in (0, 1))
        rows.append((i, name, a.tolist(), b.tolist(), [0.9] * 17, [0.25] * 17))
        for j in range(17):
            want[i, j] = lifted(rigs[name], a[j], b[j]), X[j]
    got = stereo.lift(spark.createDataFrame(rows, PAIRS), rigs).select("*", "rest.capture_id").collect()
    assert len(got) == 60 * 17 and all(r.ok for r in got)
    for r in got:
        (place, rect, e1, e2), X = want[r.capture_id, r.j]
        size = max(1, np.abs(rect).max())
        assert np.allclose([r.x, r.y, r.z], place, atol=1e-7 * size) and np.allclose([r.rx, r.ry, r.rz], rect, atol=1e-7 * size)
        assert math.isclose(r.e1, e1, rel_tol=1e-5, abs_tol=1e-4) and math.isclose(r.e2, e2, rel_tol=1e-5, abs_tol=1e-4)
        if r.capture_id % 3 == 0:
            assert np.allclose([r.x, r.y, r.z], X, atol=5e-3)  # five rounds leave a little distortion


def test_odd_pairs(spark):
    """NULL and NaN coordinates or confidences, other numbers of joints, unknown rigs, repeated rows and an empty table."""
    rig = stereo.example_rig()
    a, b = (v.tolist() for v in seen(rig, np.array([0.1, -0.2, 1.8])))
    full = lambda p: [p] * 17
    sure = [0.9] * 17
    rows = [
        (1, "near", full(a), full(b), sure, sure), (1, "near", full(a), full(b), sure, sure), (2, "lost", full(a), full(b), sure, sure), (3, None, full(a), full(b), sure, sure), (4, "near", full(a)[:16], full(b), sure, sure),
        (5, "near", None, full(b), sure, sure), (6, "near", [[None, 1.0]] + full(a)[1:], [b, [float("nan"), 2.0]] + full(b)[2:], [0.9, 0.9, None, float("nan"), 0.1] + sure[5:], sure), (7, "near", full([]), full(b), sure, sure), (8, "near", full(a), full(b), [0.25] * 17, [0.2499] * 17),
    ]
    got = stereo.lift(spark.createDataFrame(rows, PAIRS), {"near": rig}).groupBy("pair", "rest.capture_id").agg(F.count_if("ok").alias("n")).collect()
    assert sorted((r.capture_id, r.n) for r in got) == [(1, 34), (2, 0), (3, 0), (4, 0), (5, 0), (6, 12), (7, 0), (8, 0)]
    twice = spark.createDataFrame(rows[:2] + rows[7:8], PAIRS).withColumns({"verdict": F.lit("SAME_PERSON"), "score": F.lit(0), "posture": F.lit("upright")})
    assert sorted((r.capture_id, r.total, r.core) for r in stereo.final_quality(twice, {"near": rig}).collect()) == [(1, 17, 17), (1, 17, 17), (7, 0, 0)]
    assert sorted(r.capture_id for r in stereo.live_gate(twice, rig).collect()) == [1, 1, 7]
    empty = spark.createDataFrame([], PAIRS + ", verdict string, score int, posture string")
    assert stereo.final_quality(empty, {"near": rig}).collect() == [] and stereo.live_gate(empty, rig).collect() == []


@pytest.mark.parametrize("guard", [False, True])
def test_parallel_rays_have_no_place_or_a_far_one(spark, guard):
    """Equal points in two rectified views meet at infinity; with the guard the place is 1e7 away instead."""
    rig = stereo.example_rig()
    plain = stereo.Rig(rig.K1, rig.D1 * 0, rig.K2, rig.D2 * 0, np.eye(3), np.array([-0.5, 0, 0]), np.eye(3), np.eye(3), rig.P1, np.hstack([rig.K1, rig.K1 @ np.array([[-0.5], [0], [0]])]), (1.0, 1.0))
    row = (1, "x", [[400.0, 300.0]] * 17, [[400.0, 300.0]] * 17, [0.9] * 17, [0.9] * 17)
    r = stereo.lift(spark.createDataFrame([row], PAIRS), plain, guard).first()
    assert not r.ok or abs(r.rz) > 1e5


def test_lift_finds_the_poses(spark):
    pose = tables.pose3d(spark, SF, range(17)).limit(40)
    rows = stereo.lift(stereo.synthetic_pairs(pose), stereo.example_rig()).select("*", "rest.capture_id").collect()
    want = {r.vec_id: r for r in pose.collect()}
    found = 0
    for r in rows:
        w = want[r.capture_id]
        if r.ok and (r.capture_id + r.j) % 11:
            assert abs(r.x - 0.6 * w[f"x{r.j}"]) < 2e-3 and abs(r.z - (1.8 + 0.4 * w[f"z{r.j}"])) < 5e-3
            assert r.e1 < 0.5 and r.e2 < 0.5
            found += 1
        elif r.ok:
            assert r.e1 + r.e2 > 65
    assert found > 200


def test_decisions_cover_the_early_exits(spark):
    rows = stereo.final_quality(stereo.synthetic_pairs(tables.pose3d(spark, SF, range(17))), stereo.example_rig()).collect()
    got = {r.decision for r in rows}
    assert {"EXCLUDE_3D", "EXCLUDE_3D_WRONG_PERSON", "EXCLUDE_3D_DEGENERATE_RIG"} <= got and len(got) >= 5
    assert all(r.core is None for r in rows if r.verdict == "NO_TARGET" or "RIG" in r.decision) and all(r.core is not None and r.masked_err >= 0 for r in rows if r.decision.startswith("INCLUDE"))
    said = {r.reason.split("(")[0].split(":")[0] for r in rows}
    assert {"Target lost", "Full 3D", "Partial 3D", "Strong evidence of cross-camera person mismatch "} <= said


def test_each_row_has_its_own_rig(spark):
    """Two rigs in one table give what each gives alone; a row without a rig, or with 16 joints, has no joint."""
    near, far = stereo.example_rig(), stereo.example_rig()
    far = stereo.Rig(**{**far.__dict__, "T": far.T * 1.2, "P2": far.P2 * np.array([[1, 1, 1, 1.2]] * 3)})
    pairs = stereo.synthetic_pairs(tables.pose3d(spark, SF, range(17)))
    even = F.col("capture_id") % 2 == 0
    both = pairs.withColumn("calibration_id", F.when(F.col("capture_id") == 7, "lost").when(even, "near").otherwise("far")).withColumn("c1", F.when(F.col("capture_id") == 8, F.slice("c1", 1, 16)).otherwise(F.col("c1")))
    got = {r.capture_id: r for r in stereo.final_quality(both, {"near": near, "far": far}).collect()}
    alone = {k: {r.capture_id: r for r in stereo.final_quality(pairs.withColumn("calibration_id", F.lit(k)), rig).collect()} for k, rig in (("near", near), ("far", far))}
    for i, r in got.items():
        if i in (7, 8):
            assert r.core in (None, 0)
            continue
        want = alone["near" if i % 2 == 0 else "far"][i]
        assert (r.decision, r.core, r.depth, r.core_err, r.reason) == (want.decision, want.core, want.depth, want.core_err, want.reason)
    assert any(alone["near"][i].depth != alone["far"][i].depth for i in got)


def test_calibration_document():
    rig = stereo.example_rig()
    doc = {"intrinsics_refined": {"K1": rig.K1.tolist(), "D1": [rig.D1.tolist()], "K2": rig.K2.tolist(), "D2": [rig.D2.tolist()]}, "extrinsics": {"rotation_matrix_R": rig.R.tolist(), "translation_vector_T_m": [[v] for v in rig.T]},
           "rectification": {"R1": rig.R1.tolist(), "R2": rig.R2.tolist(), "P1": rig.P1.tolist(), "P2": rig.P2.tolist()}}
    assert np.allclose(stereo.Rig.of(doc).T, rig.T) and stereo.Rig.of(doc).D1.shape == (5,)
