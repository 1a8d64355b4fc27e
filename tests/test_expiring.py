"""Streams with late frames and idle times: what comes out is the ordered table's answer, and what stays is bounded."""

import datetime as dt
import random

import pytest

from tarn.streaming import expiring, tracker

SCHEMA = "stream long, event_id long, ts timestamp, cx double, w double, head double, control string"
START = dt.datetime(2024, 5, 1, 12)


def frames(seed=2, n=160):
    """Three streams, a frame or so a second; controls, missing heads, and equal times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=i // 2, milliseconds=rng.choice((0, 0, 250)))
        rows.append((rng.randrange(3), i, at, 320 + rng.uniform(-8, 8), 100 + rng.uniform(-3, 3), None if i % 9 == 0 else 60 + rng.uniform(-3, 3), "calibrate" if i in (70, 100) else None))
    return rows


def streamed(spark, tmp_path, batches, schema, build, name):
    """Each list of rows is a micro-batch; the last frame is far ahead, so that all others are passed by the watermark."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={i:03d}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    q = build(src).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(300)
    return spark.table(name).collect(), [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_late_frames_are_taken_in_order(spark, tmp_path):
    rows = frames()
    rng = random.Random(4)
    arriving = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.uniform(0, 7)))  # up to seven seconds late
    assert [r[1] for r in arriving] != [r[1] for r in rows]
    batches = [arriving[i : i + 40] for i in range(0, len(arriving), 40)]
    end = (99, 10_000, START + dt.timedelta(hours=2), 1.0, 1.0, None, None)
    got, kept = streamed(spark, tmp_path, [*batches, [end]], SCHEMA, lambda s: expiring.follow(s, "10 seconds", 3600), "late")
    want = tracker.follow(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.event_id: tuple(r) for r in got if r.stream != 99} == {r.event_id: tuple(r) for r in want} and len(want) == len(rows)
    assert max(kept) < 150 and kept[-1] <= 12  # streams that are idle for an hour are gone


def test_an_idle_stream_starts_anew(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, 1, at(0), 300.0, 100.0, 60.0, None), (1, 2, at(1), 301.0, 100.0, 60.0, None), (1, 3, at(500), 900.0, 50.0, 40.0, None), (1, 4, at(501), 901.0, 50.0, 40.0, None), (2, 5, at(2000), 1.0, 30.0, None, None)]
    got, _ = streamed(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]], SCHEMA, lambda s: expiring.follow(s, "1 second", 60), "idle")
    r = {g.event_id: g for g in got}
    assert (r[1].base_cx, r[3].base_cx) == (300.0, 900.0) and r[2].fps == pytest.approx(1.0) and r[3].fps is None and r[4].fps == pytest.approx(1.0)


def test_pairs_of_cameras(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    schema = "stream long, camera string, ts timestamp, frame long"
    rows = [(1, "CAM01", at(2), 3), (1, "CAM02", at(1), 2), (1, "CAM01", at(0), 1), (1, "CAM03", at(3), 9), (2, "CAM01", at(1), 4), (1, "CAM02", at(5), 5), (7, "CAM01", at(900), 8)]
    got, kept = streamed(spark, tmp_path, [rows[:3], rows[3:6], rows[6:]], schema, lambda s: expiring.pairs(s, "3 seconds", 60), "pairs")
    assert sorted((r.stream, r.frame1, r.frame2, r.gap_us) for r in got) == [(1, 1, 2, 1_000_000), (1, 3, 2, 1_000_000), (1, 3, 5, 3_000_000)]
    assert kept
