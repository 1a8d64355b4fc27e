"""Readers and the views that let the driver's tables stand in for pose, detection, prediction and frame tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("upright", "forward_head", "leaning_forward", "leaning_backward", "leaning_sideways", "slouching")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label(c: str):
    return F.element_at(F.array(*map(F.lit, CLASSES)), (F.pmod(F.col(c), F.lit(len(CLASSES))) + 1).cast("int"))


def pose2d(spark: SparkSession, sf_dir: str, joints=range(17)) -> DataFrame:
    """Joints x{j}, y{j}, c{j} of each view; even views are frontal, odd ones lateral."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cols = [c for j in joints for c in (e(3 * j).alias(f"x{j}"), e(3 * j + 1).alias(f"y{j}"), (e(3 * j + 2) + 0.5).alias(f"c{j}"))]
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2 == 1).alias("lateral"), (F.floor(F.col("vec_id") / 2) % 3 == 0).alias("left_side"), *cols)


def pose3d(spark: SparkSession, sf_dir: str, joints=(0, 5, 6, 11, 12)) -> DataFrame:
    """Joints x{j}, y{j}, z{j}, NULL where masked."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cols = [F.when(e(63 - j % 13) >= -0.2, e(3 * j + k)).alias(f"{a}{j}") for j in joints for k, a in enumerate("xyz")]
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *cols)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    w = F.least(F.lit(1900.0), 40 * F.col("l_quantity"))
    return li.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("cand"), w.alias("w"), (0.5 * w).alias("h"),
        (1920 * (0.25 + 5 * F.col("l_discount"))).alias("cx"), (540 + 1000 * (F.col("l_tax") - 0.04)).alias("cy"), (1 - 5 * F.col("l_tax")).alias("conf"),
        (F.col("l_linenumber") % 5).alias("torso_joints"), (0.2 + 0.7 * (F.col("l_suppkey") % 10) / 10).alias("mean_kpt"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of two models over six classes."""
    k = F.col("o_orderkey")
    y = k % 6
    return read(spark, sf_dir, "orders").select(
        k.alias("capture_id"), (F.col("o_custkey") % 5).alias("fold"), y.alias("y"),
        F.when(k % 7 < 5, y).otherwise((k * 5 + 1) % 6).alias("a"), F.when(k % 11 < 7, y).otherwise((k * 3 + 2) % 6).alias("b"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"), "ts", "event_id", (320 + v % 20 - 10).alias("cx"), (100 + v % 8 - 4).alias("w"),
        F.when(F.col("event_type") != "error", 60 + v % 12 - 6).alias("head"),
    )


def pairs(spark: SparkSession, sf_dir: str, joints=range(17)) -> DataFrame:
    """One row a capture with both views: pixel joints {a,b}_x{j}, _y{j}, _c{j}, box {a,b}_left, _top, _w, _h and {a,b}_has (a target was found).
    One shuffle on the capture; the arrays are taken apart after it."""
    even = F.col("vec_id") % 2 == 0
    one = read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 2).alias("capture_id")).agg(
        F.max(F.when(even, F.col("label"))).alias("label"), F.max(F.when(even, F.col("embedding"))).alias("a"), F.max(F.when(~even, F.col("embedding"))).alias("b"),
    )
    cols = []
    for p in "ab":
        e = lambda i, p=p: F.get(p, F.lit(i)).cast("double")
        cols += [c for j in joints for c in ((960 + 900 * e(3 * j)).alias(f"{p}_x{j}"), (540 + 500 * e(3 * j + 1)).alias(f"{p}_y{j}"), (e(3 * j + 2) + 0.5).alias(f"{p}_c{j}"))]
        cols += [(300 + 900 * F.abs(e(51))).alias(f"{p}_left"), (100 + 400 * F.abs(e(52))).alias(f"{p}_top"), (200 + 1500 * F.abs(e(53))).alias(f"{p}_w"), (300 + 1000 * F.abs(e(54))).alias(f"{p}_h"), F.coalesce(e(55) > -0.25, F.lit(False)).alias(f"{p}_has")]
    return one.select("capture_id", F.when(F.col("label") == 9, "reject").otherwise(label("label")).alias("posture"), *cols)


def boxed(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """Named joints {name}_x, {name}_y and a box box_x, box_y, box_w, box_h (its width is 0 in some rows)."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cols = [c for j, n in enumerate(names) for c in (e(3 * j).alias(f"{n}_x"), e(3 * j + 1).alias(f"{n}_y"))]
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *cols, e(51).alias("box_x"), e(52).alias("box_y"), F.greatest(F.lit(0.0), e(53)).alias("box_w"), F.abs(e(54)).alias("box_h"))
