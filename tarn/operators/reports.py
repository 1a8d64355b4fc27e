"""Reports that join results of many steps: summaries of experiments and the audit of an image set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators import dedup

RESULT = "array<struct<dataset string, model string, accuracy double, f1_macro double>>"


def experiments(docs: DataFrame, unnamed: str = "EfficientNet-B0") -> DataFrame:
    """JSN-04, ORC-02: one row a result from JSON lists: ``experiment``, ``dataset``, ``model``, ``accuracy``, ``f1_macro``. ``docs`` has ``experiment`` and ``value`` (the text) and may have ``dataset``,
    which then stands for the list's own; a list that can't be read gives no row, a result without a model is ``unnamed``."""
    own = F.col("dataset") if "dataset" in docs.columns else F.lit(None).cast("string")
    each = docs.select("experiment", own.alias("own"), F.explode(F.from_json("value", RESULT)).alias("r"))
    return each.select("experiment", F.coalesce("own", "r.dataset").alias("dataset"), F.coalesce("r.model", F.lit(unnamed)).alias("model"), "r.accuracy", "r.f1_macro")


def _hash(c: str) -> tuple[Column, Column]:
    return tuple(F.conv(F.substring(c, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def audit(images: DataFrame, most: int = 5, dark: float = 40.0, blurry: float = 100.0, small: tuple[int, int] = (224, 224)) -> dict[str, DataFrame]:
    """ORC-05: the audit of an image set in one call. ``images`` has path, split, label, bytes, sha256, dhash64 and the measures of ``sources.images``. Gives tables: ``classes`` (AGG-26), ``exact`` (DUP-01),
    ``near`` (DUP-02/03, one row a pair of distinct hashes), ``leakage`` (DUP-05) and ``summary``, one row. Corrupt files count only as such."""
    good = images.filter(~F.col("is_corrupt"))
    classes = good.groupBy("split", "label").agg(F.count("*").alias("count"))
    groups = good.groupBy("sha256").agg(F.count("*").alias("files"), F.min("path").alias("path"), F.count_distinct("split").alias("splits")).filter("files > 1")
    hi, lo = _hash("dhash64")
    hashes = good.select(F.col("path").alias("key"), "split", hi.alias("hi"), lo.alias("lo"))
    near = dedup.near_pairs(hashes, most)
    place = good.select("path", "split", "label")
    at = lambda p: place.select(F.col("path").alias(f"{p}_key"), F.col("split").alias(f"split_{p}"), F.col("label").alias(f"label_{p}"))
    near = near.join(at("a"), "a_key").join(at("b"), "b_key").select("distance", (F.col("split_a") == F.col("split_b")).alias("same_split"), (F.col("label_a") == F.col("label_b")).alias("same_label"), "split_a", "label_a", F.col("a_key").alias("path_a"), "split_b", "label_b", F.col("b_key").alias("path_b"))
    leaks = near.filter("not same_split").select(F.lit("near_duplicate").alias("type"), "distance", "path_a", "path_b")
    leaks = leaks.unionByName(groups.filter("splits > 1").select(F.lit("exact_duplicate").alias("type"), F.lit(0).alias("distance"), F.col("path").alias("path_a"), F.lit(None).cast("string").alias("path_b")))
    per = classes.groupBy("label").agg(F.sum("count").alias("n")).agg(F.count("*").alias("classes"), F.round(F.max("n") / F.min("n"), 4).alias("imbalance"))
    counts = images.agg(
        F.count("*").alias("files"), F.count_if(~F.col("is_corrupt")).alias("valid"), F.count_if("is_corrupt").alias("corrupt"), F.count_if(~F.col("is_corrupt") & (F.col("brightness_mean") < dark)).alias("dark"),
        F.count_if(~F.col("is_corrupt") & (F.col("edge_variance") < blurry)).alias("blurry"), F.count_if(~F.col("is_corrupt") & ((F.col("width") < small[0]) | (F.col("height") < small[1]))).alias("small"),
    )
    numbers = [counts, per, groups.agg(F.count("*").alias("exact_groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("exact_files")), near.agg(F.count("*").alias("near_pairs")), leaks.agg(F.count("*").alias("leaks"))]
    summary = numbers[0].withColumn("_k", F.lit(1))
    for part in numbers[1:]:  # one row each
        summary = summary.join(F.broadcast(part.withColumn("_k", F.lit(1))), "_k")
    return {"classes": classes, "exact": groups, "near": near, "leakage": leaks, "summary": summary.drop("_k")}
