"""The live chain on frames: hip extrapolation, profile choice, recording. Projections given the tracker's state, so batch and stream share them.

The state (``tracker.baselines`` or ``tracker.track``) is joined or carried by the caller as ``base_cx``, ``base_w``, ``base_ratio``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.geometry import norm
from tarn.operators import pose

SURE = 0.25
PROFILES = ("upright", "leaning_forward", "leaning_backward", "leaning_left", "leaning_right", "slouching")


def latest_pair(frames: DataFrame) -> DataFrame:
    """STM-01: the newest frame of each camera by stream; a stream counts once both cameras have one. Needs ``stream``, ``camera``, ``ts``, ``frame``."""
    newest = lambda cam: F.max(F.when(F.col("camera") == cam, F.struct("ts", "frame"))).alias(cam.lower())
    both = frames.groupBy("stream").agg(newest("CAM01"), newest("CAM02"))
    return both.filter(F.col("cam01").isNotNull() & F.col("cam02").isNotNull()).select("stream", F.col("cam01.frame").alias("frame1"), F.col("cam02.frame").alias("frame2"), F.abs(F.unix_micros(F.col("cam01.ts")) - F.unix_micros(F.col("cam02.ts"))).alias("gap_us"))


def extrapolate_hips(df: DataFrame, height: int, lateral: Column | bool = False) -> DataFrame:
    """FEA-17: where shoulders are seen but a hip isn't, both hips are put under them. Needs x, y, c of joints 5, 6, 11, 12 and ``base_cx`` (NULL: no baseline).
    A lateral view does with one shoulder, taken as 60 pixels wide. Adds ``extrapolated``."""
    lateral = F.lit(lateral) if isinstance(lateral, bool) else lateral
    ok = lambda j: F.coalesce((F.col(f"c{j}") >= SURE) & F.col(f"x{j}").isNotNull(), F.lit(False))
    both, one = ok(5) & ok(6), lateral & (ok(5) | ok(6))
    width = F.when(both, F.greatest(F.lit(20.0), norm(F.col("x6") - F.col("x5"), F.col("y6") - F.col("y5")))).otherwise(60.0)
    at = {a: F.when(both, (F.col(f"{a}5") + F.col(f"{a}6")) / 2).when(ok(5), F.col(f"{a}5")).otherwise(F.col(f"{a}6")) for a in "xy"}
    df = df.withColumns({"extrapolated": (both | one) & ~(ok(11) & ok(12)), "_w": width, "_sx": at["x"], "_sy": at["y"]})
    low = F.least(F.lit(float(height - 10)), F.col("_sy") + F.greatest(1.15 * F.col("_w"), F.lit(70.0)))
    middle = F.when(F.col("base_cx").isNull(), F.col("_sx")).otherwise(F.col("base_cx") + 0.15 * (F.col("_sx") - F.col("base_cx")))
    put = lambda new, old: F.when(F.col("extrapolated"), new).otherwise(F.col(old)).alias(old)
    hips = {"x11": middle - 0.45 * F.col("_w"), "y11": low, "c11": F.lit(0.85), "x12": middle + 0.45 * F.col("_w"), "y12": low, "c12": F.lit(0.85)}
    return df.select(*(c for c in df.columns if c not in hips and not c.startswith("_")), *(put(v, k) for k, v in hips.items()))


def choose_profile(df: DataFrame) -> DataFrame:
    """FEA-18: ``profile`` of a single frontal view against its baseline, the first rule that holds: aside, slouching, forward, backward, else upright.
    Needs ``cx``, ``w`` and ``head`` (height of the nose over the shoulders, NULL without nose) and the baseline; without one it is upright."""
    base = F.greatest(F.lit(1.0), "base_w")
    w = F.greatest(F.lit(1.0), "w")
    aside, wider = (F.col("cx") - F.col("base_cx")) / base, w / base
    drop = F.when(F.col("head").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), "head") / w / F.greatest(F.lit(1e-3), F.coalesce("base_ratio", F.lit(0.60))))
    known = F.col("base_cx").isNotNull() & F.col("base_w").isNotNull()
    return df.withColumn("profile", F.when(~known, "upright").when(aside > 0.15, "leaning_left").when(aside < -0.15, "leaning_right").when((wider >= 1.03) & (drop <= 0.92), "slouching").when(wider >= 1.07, "leaning_forward").when(wider <= 0.93, "leaning_backward").otherwise("upright"))


#: features of the second camera's view, in the order of PROFILE_VALUES
PROFILE_FEATURES = pose.VIEW
# What the second camera typically sees of each posture.
PROFILE_VALUES = {
    "upright": (0.1622, -0.9837, -0.0576, -0.7358, -0.0049, -0.703, -0.0144, -0.0261, 0.0144, 0.0261, 44.3802, 76.6574, 6.7579, 48.3779, 0.3573, 0.7271, 0.1934, -0.0312, 1.2313, 4.5309, 119.5911),
    "leaning_forward": (0.2535, -0.9208, 0.0363, -0.7211, 0.0786, -0.6927, -0.0122, -0.0221, 0.0122, 0.0221, 30.9484, 78.2687, 8.181, 46.0543, 0.3676, 0.7183, 0.2029, 0.0574, 1.8776, 4.4247, 121.3679),
    "leaning_backward": (0.0094, -0.9915, -0.1619, -0.714, -0.1539, -0.6844, 0.0004, -0.0293, -0.0004, 0.0293, 64.9556, 94.0692, 17.9205, 50.1643, 0.3493, 0.7413, 0.1673, -0.1579, 0.3437, 3.5647, 117.1729),
    "slouching": (0.2566, -0.9464, 0.0184, -0.7248, 0.0221, -0.6925, 0.0008, -0.0277, -0.0008, 0.0277, 67.3428, 88.4698, 5.1238, 50.1096, 0.3816, 0.7139, 0.2364, 0.0202, 1.6125, 4.7514, 117.021),
    "leaning_left": (0.1839, -0.9702, -0.0477, -0.7486, -0.0081, -0.7481, -0.0079, -0.021, 0.0079, 0.021, 2.5866, 80.1472, 4.8056, 51.9088, 0.3435, 0.7536, 0.2118, -0.0279, 1.4757, 4.7478, 113.4874),
    "leaning_right": (0.1483, -0.9825, -0.0516, -0.7319, -0.0604, -0.6669, 0.0039, -0.0328, -0.0039, 0.0328, 106.7496, 93.2947, 8.0054, 48.6868, 0.3803, 0.7099, 0.2043, -0.056, 0.8904, 3.2695, 118.6081),
}


def profile_table(spark: SparkSession) -> DataFrame:
    """PROFILE_VALUES, a row a posture."""
    return spark.createDataFrame([(name, *values) for name, values in PROFILE_VALUES.items()], ", ".join(["profile string", *(f"{c} double" for c in PROFILE_FEATURES)]))


def swapped(df: DataFrame, swap: str = "swap") -> DataFrame:
    """STM-04: where ``swap`` is true the two cameras change places (columns a_ and b_)."""
    other = {f"{p}_{c[2:]}": f"{'ba'['ab'.index(p)]}_{c[2:]}" for c in df.columns for p in c[:1] if c[:2] in ("a_", "b_")}
    return df.select(*(F.when(F.col(swap), F.col(other[c])).otherwise(F.col(c)).alias(c) if c in other else F.col(c) for c in df.columns))


def with_profile(features: DataFrame, profiles: DataFrame, prefix: str = "cam02_") -> DataFrame:
    """The second half of FEA-18: the constant features of the chosen profile stand in for the missing camera. ``profiles`` has one row a class (six at most), so it is broadcast."""
    cols = [F.col(c).alias(f"{prefix}{c}") for c in profiles.columns if c != "profile"]
    return features.join(F.broadcast(profiles.select("profile", *cols)), "profile", "left")


def recording_summary(rec: DataFrame) -> DataFrame:
    """STM-09, AGG-25: recorded frames with a valid prediction: count, right ones and accuracy by truth, and over all (truth NULL)."""
    valid = rec.filter(F.col("prediction").isNotNull()).withColumn("right", (F.col("truth") == F.col("prediction")).cast("int"))
    return valid.rollup("truth").agg(F.count("*").alias("frames"), F.sum("right").alias("right"), F.avg("right").alias("accuracy"))


def record(frames: DataFrame, path: str, checkpoint: str):
    """STM-09: appends valid frames of a stream to a table; restarts go on where they ended."""
    return frames.filter(F.col("prediction").isNotNull()).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
