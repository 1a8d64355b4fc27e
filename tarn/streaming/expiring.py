"""Streams whose state is bounded (STM-01, 02, 03, 08): frames wait until no earlier one can come, and a stream that is idle for long is forgotten.

Frames may come ``late`` by so much event time. They wait in the state until the watermark has passed them and are then taken in the order of their time, so the result is that of the whole table in order, whatever the order of
arrival within that bound; frames later than that are dropped, as by any watermark. A stream without frames for ``idle`` event time loses its state: its next frame is a first one again. So what is kept is one baseline, or one pair of frames,
for each stream seen lately, and the frames of the last ``late``. Timers and state survive restarts by the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tarn.streaming import tracker

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PAIR = "stream bigint, frame1 bigint, frame2 bigint, gap_us bigint"


class _Waiting(StatefulProcessor):
    """Keeps rows until the watermark has passed them. ``fields`` are their columns, ``at`` (microseconds) and ``event_id`` the first two, which order them; ``kept`` is the schema of what stays of a stream."""

    fields = ""
    kept = ""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", self.kept)
        self.rows = handle.getListState("rows", self.fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        names = [f.split()[0] for f in self.fields.split(", ")]
        for batch in rows:
            values = [tuple(None if pd.isna(v) else v for v in r) for r in batch[names].itertuples(index=False)]
            if values:
                self.rows.appendList(values)
                self.handle.registerTimer(-(-min(r[0] for r in values) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.rows.get(), key=lambda r: (r[0], r[1])) if self.rows.exists() else []
        ready, later = [r for r in waiting if r[0] <= now * 1000], [r for r in waiting if r[0] > now * 1000]
        own = tuple(self.own.get()) if self.own.exists() else None
        out = []
        for r in ready:
            if own is not None and r[0] - self.last(own) >= self.idle * 1000:
                own = None
            own, row = self.take(key[0], own, tuple(r))
            if row is not None:
                out.append(row)
        if ready:
            self.rows.put([tuple(r) for r in later]) if later else self.rows.clear()
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        if own is not None:
            over = -(-self.last(own) // 1000) + self.idle
            if over <= now and not later:
                self.own.clear()
            else:
                self.own.update(own)
                if ready:
                    self.handle.registerTimer(over)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class _Following(_Waiting):
    fields = "at bigint, event_id bigint, cx double, w double, head double, control string"
    kept = tracker._HELD
    names = [x.split()[0] for x in tracker.FOLLOWED.split(", ")]

    @staticmethod
    def last(own: tuple) -> int:
        return int(own[6])

    @staticmethod
    def take(key: int, own: tuple | None, r: tuple) -> tuple[tuple, tuple]:
        at, event, cx, w, head, control = r
        own = tracker.held(None if own is None else (*own[:6], int(own[6]), list(own[7])), int(at), cx, w, head, control)
        own = (*map(float, own[:3]), int(own[3]), int(own[4]), bool(own[5]), int(own[6]), [float(x) for x in own[7]])
        return own, (key, event, *own[:3], own[5], sum(own[7]) / len(own[7]) if own[7] else None)


class _Pairing(_Waiting):
    fields = "at bigint, event_id bigint, camera string"
    kept = "a_at bigint, a bigint, b_at bigint, b bigint"
    names = [x.split()[0] for x in _PAIR.split(", ")]

    @staticmethod
    def last(own: tuple) -> int:
        return max(v for v in (own[0], own[2]) if v is not None)

    @staticmethod
    def take(key: int, own: tuple | None, r: tuple) -> tuple[tuple, tuple | None]:
        at, event, camera = r
        own = own or (None, None, None, None)
        own = (at, event, *own[2:]) if camera == "CAM01" else (*own[:2], at, event) if camera == "CAM02" else own
        return own, None if None in own else (key, own[1], own[3], abs(own[0] - own[2]))


def _started(frames: DataFrame, columns: list, processor, schema: str, late: str) -> DataFrame:
    spark = frames.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # state with timers needs it
    light = frames.select("stream", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *columns)
    return light.withWatermark("ts", late).groupBy("stream").transformWithStateInPandas(processor, schema, "append", "EventTime")


def follow(frames: DataFrame, late: str = "10 seconds", idle_seconds: int = 3600) -> DataFrame:
    """``tracker.follow`` on a stream of frames, each answered once, when the watermark has passed it."""
    control = F.col("control") if "control" in frames.columns else F.lit(None).cast("string")
    columns = ["event_id", *(F.col(c).cast("double").alias(c) for c in ("cx", "w", "head")), control.alias("control")]
    return _started(frames, columns, _Following(idle_seconds * 1000), tracker.FOLLOWED, late)


def pairs(frames: DataFrame, late: str = "10 seconds", idle_seconds: int = 3600) -> DataFrame:
    """``live.latest_pair`` after each frame of a stream, once both cameras have one. Needs ``stream``, ``camera``, ``ts``, ``frame``; frames of other cameras change nothing."""
    known = frames.filter(F.col("camera").isin("CAM01", "CAM02"))
    return _started(known, [F.col("frame").alias("event_id"), "camera"], _Pairing(idle_seconds * 1000), _PAIR, late)
