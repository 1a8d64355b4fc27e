"""Seated baseline per stream (STM-01, 02, 03, 08). The gate of each frame depends on the state that all earlier frames left, so a stream is folded in order; frames are sorted
within partitions with spilling and pass through by batches, and only the state of one stream is held."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHA = 0.005
RECENT = 30
OUT = "stream bigint, frames bigint, cx double, width double, ratio double, adapted bigint"
FOLLOWED = "stream bigint, event_id bigint, base_cx double, base_w double, base_ratio double, calibrated boolean, fps double"
_STATE = "cx double, width double, ratio double, frames bigint, adapted bigint"
_HELD = "cx double, width double, ratio double, frames bigint, adapted bigint, fixed boolean, last bigint, rates array<double>"


def step(state: tuple | None, cx: float, w: float, head: float | None) -> tuple:
    """One frame: the first sets the baseline; later ones move it by ALPHA while they are close to it. The width's gate uses the old width."""
    w = max(20.0, w)
    ratio = 0.6 if head is None else max(0.15, max(5.0, head) / w)
    if state is None:
        return cx, w, ratio, 1, 0
    bx, bw, br, n, k = state
    if abs(cx - bx) / max(1.0, bw) < 0.10 and 0.95 <= w / max(1.0, bw) <= 1.05:
        br = br if head is None else (1 - ALPHA) * br + ALPHA * max(0.15, head / w)
        return (1 - ALPHA) * bx + ALPHA * cx, (1 - ALPHA) * bw + ALPHA * w, br, n + 1, k + 1
    return bx, bw, br, n + 1, k


def held(state: tuple | None, at: int, cx: float, w: float, head: float | None, control: str | None) -> tuple:
    """``step`` with controls and the frame rate: (*state, fixed, time, recent rates). A frame with control ``calibrate`` becomes the baseline, which then stays as it is (STM-03).
    The rate of a frame is 1 / max(0.0001, seconds since the last) (DT-04)."""
    own, fixed, last, rates = (None, False, None, []) if state is None else (state[:5], *state[5:])
    if control == "calibrate":
        own, fixed = (*step(None, cx, w, head)[:3], 1 if own is None else own[3] + 1, 0 if own is None else own[4]), True
    elif fixed:
        own = (*own[:3], own[3] + 1, own[4])
    else:
        own = step(own, cx, w, head)
    if last is not None:
        rates = [*rates, 1 / max(1e-4, (at - last) / 1e6)][-RECENT:]
    return (*own, fixed, at, rates)


def _ordered(frames: DataFrame) -> DataFrame:
    control = F.col("control") if "control" in frames.columns else F.lit(None).cast("string")
    light = frames.select("stream", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *(F.col(c).cast("double").alias(c) for c in ("cx", "w", "head")), control.alias("control"))
    return light.repartition("stream").sortWithinPartitions("stream", "at", "event_id")


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in ("stream", "event_id", "at", "cx", "w", "head", "control")), strict=True)


def baselines(frames: DataFrame) -> DataFrame:
    """The state after the whole history of each stream."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, done = None, None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), *(pa.float64(),) * 3, pa.int64()))], ["stream", "frames", "cx", "width", "ratio", "adapted"])

        for batch in batches:
            for key, _, _, cx, w, head, _ in _rows(batch):
                if state is not None and key != stream:
                    done.append((stream, state[3], *state[:3], state[4]))
                    state = None
                stream, state = key, step(state, cx, w, head)
            if len(done) >= 10_000:
                yield out()
                done = []
        if state is not None:
            done.append((stream, state[3], *state[:3], state[4]))
        yield out()

    return _ordered(frames).mapInArrow(fold, OUT)


def follow(frames: DataFrame) -> DataFrame:
    """The baseline after each frame, and the mean rate of the last RECENT frames (STM-02, 03, 08); a column ``control`` may hold ``calibrate``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state = None, None
        for batch in batches:
            out = []
            for key, event, at, cx, w, head, control in _rows(batch):
                state = held(state if state is not None and key == stream else None, at, cx, w, head, control)
                stream = key
                out.append((key, event, *state[:3], state[5], sum(state[7]) / len(state[7]) if state[7] else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), *(pa.float64(),) * 3, pa.bool_(), pa.float64()))], [x.split()[0] for x in FOLLOWED.split(", ")])

    return _ordered(frames).mapInArrow(fold, FOLLOWED)


def track(frames: DataFrame) -> DataFrame:
    """``baselines`` on a streaming frame table, in update mode."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        own = tuple(state.get) if state.exists else None
        for cx, w, head in zip(rows["cx"], rows["w"], rows["head"], strict=True):
            own = step(own, float(cx), float(w), None if pd.isna(head) else float(head))
        cx, w, r, n, k = own
        state.update((cx, w, r, n, k))
        yield pd.DataFrame({"stream": [key[0]], "frames": [n], "cx": [cx], "width": [w], "ratio": [r], "adapted": [k]})

    return frames.groupBy("stream").applyInPandasWithState(update, OUT, _STATE, "update", "NoTimeout")


def follow_stream(frames: DataFrame) -> DataFrame:
    """``follow`` on a streaming frame table, in append mode: control events come with the frames. State is kept between micro-batches."""
    light = frames.select("stream", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *(F.col(c).cast("double").alias(c) for c in ("cx", "w", "head")), "control")

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        own = None
        if state.exists:
            s = tuple(state.get)
            own = (*s[:6], int(s[6]), list(s[7]))
        out = []
        for event, at, cx, w, head, control in zip(rows["event_id"], rows["at"], rows["cx"], rows["w"], rows["head"], rows["control"], strict=True):
            own = held(own, int(at), float(cx), float(w), None if pd.isna(head) else float(head), control)
            out.append((key[0], event, *own[:3], own[5], sum(own[7]) / len(own[7]) if own[7] else None))
        state.update((*own[:5], bool(own[5]), own[6], [float(x) for x in own[7]]))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FOLLOWED.split(", ")])

    return light.groupBy("stream").applyInPandasWithState(update, FOLLOWED, _HELD, "append", "NoTimeout")
