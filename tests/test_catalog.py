"""Each query against its SQL in DuckDB on the smallest tables; those without SQL against plain Python."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tarn.operators import dedup, evaluate, pose
from tarn.plans import catalog
from tarn.sources import tables
from tarn.streaming import tracker

SF = "/root/testdata/sf0.001"
NEAR = [q for q in catalog.oracle_sql()]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NEAR)
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    key = [c for c in cols if got[c].dtype != float] or cols
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if got[c].dtype == float or want[c].dtype == float:
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True), c
        elif got[c].dtype == bool or want[c].dtype == bool:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
        else:
            empty = {"None": "", "nan": "", "<NA>": ""}
            assert got[c].astype(str).replace(empty).tolist() == want[c].astype(str).replace(empty).tolist(), c


def test_tracker_gate_and_floor():
    first = tracker.step(None, 300.0, 10.0, None)
    assert first == (300.0, 20.0, 0.6, 1, 0)
    assert tracker.step(first, 400.0, 20.0, None)[3:] == (2, 0)  # too far to adapt
    near = tracker.step(first, 301.0, 20.0, 10.0)
    assert near[4] == 1 and abs(near[0] - 300.005) < 1e-9 and abs(near[2] - (0.995 * 0.6 + 0.005 * 0.5)) < 1e-12


def test_tracker_over_streams(spark):
    frames = tables.frames(spark, SF)
    got = {r.stream: r.asDict() for r in tracker.baselines(frames).collect()}
    rows = frames.toPandas().sort_values(["ts", "event_id"])
    for s, own in rows.groupby("stream"):
        state = None
        for cx, w, head in zip(own.cx, own.w, own["head"]):
            state = tracker.step(state, cx, w, None if pd.isna(head) else head)
        assert abs(got[s]["cx"] - state[0]) < 1e-9 and got[s]["frames"] == len(own) and got[s]["adapted"] == state[4]


def test_tracker_streaming(spark, tmp_path):
    frames = tables.frames(spark, SF)
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = tracker.track(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tracked").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {r.stream: round(r.cx, 9) for r in spark.table("tracked").collect()}
    assert got == {r.stream: round(r.cx, 9) for r in tracker.baselines(frames).collect()}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (3, 4), (4, 5), (5, 6), (11, 12)], "a long, b long")
    assert {r.node: r.root for r in dedup.components(edges, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 10: 10, 11: 10, 12: 10}
    assert dedup.components(edges.limit(0), "a", "b").collect() == []


def test_body_frame_invariants(spark):
    f = pose.body_frame(tables.pose3d(spark, SF)).toPandas()
    ok = f[f.reason.isna()]
    assert len(ok) and np.allclose(ok.z12, 0, atol=1e-9) and np.allclose(ok.x11 + ok.x12, 0, atol=1e-9)
    assert (ok.x12 > ok.x11).all() and ((ok.y5 + ok.y6) > 0).all() and np.allclose(ok.x5 + ok.x6, 0, atol=1e-9)


def test_body_frame_can_be_filtered(spark):
    f = pose.body_features(tables.pose3d(spark, SF))
    whole = f.toPandas()
    assert f.filter("reason is null and head_depth_offset_norm > 0").count() == int((whole.reason.isna() & (whole.head_depth_offset_norm > 0)).sum()) > 0


def test_mcnemar_p():
    assert abs(evaluate.mcnemar_p((abs(74 - 55) - 1) ** 2 / (74 + 55)) - 0.1130) < 5e-5
