"""Selection of the target person, reject gates and curation rules as ordered CASE cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_score(width: int = 1920, height: int = 1080) -> Column:
    """FEA-16: .35 area + .30 centre + .25 torso + .10 mean confidence, to nine digits."""
    w, h = F.greatest(F.lit(1.0), "w"), F.greatest(F.lit(1.0), "h")
    ratio = w * h / F.lit(float(width * height))
    area = F.least(F.lit(1.0), ratio / 0.22) * F.when(ratio < 0.05, 0.2).otherwise(1.0)
    dx, dy = F.abs(F.col("cx") - width / 2) / (width / 2), F.abs(F.col("cy") - height / 2) / (height / 2)
    centre = F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy))
    return F.round(0.35 * area + 0.30 * centre + 0.25 * F.col("torso_joints") / 4 + 0.10 * F.col("mean_kpt"), 9)


def select_target(cands: DataFrame, width: int = 1920, height: int = 1080, least: float = 0.22) -> DataFrame:
    """FEA-16 and ORD-04: the best-scored candidate of each image (ties: lowest index), target only from ``least`` on.
    Aggregates structs instead of ranking, so candidates are combined before the shuffle."""
    best = cands.select("image_id", "cand", "conf", target_score(width, height).alias("score")).groupBy("image_id").agg(F.count("*").alias("n"), F.max(F.struct("score", (-F.col("cand")).alias("i"))).alias("b"), F.max(F.struct("conf", (-F.col("cand")).alias("i"))).alias("c"))
    ok = F.col("b.score") >= least
    return best.select("image_id", "n", ok.alias("has_target"), F.when(ok, -F.col("b.i")).otherwise(-1).alias("cand"), F.col("b.score").alias("score"), (-F.col("c.i")).alias("by_conf"))


def reject_gate(df: DataFrame, least: float = 0.25, desk: bool = False) -> DataFrame:
    """QC-07: ``code`` of the first check that a live pair fails, or VALID_2D. Needs {a,b}_has and {a,b}_x, _y, _c of the core joints; with ``desk`` also {a,b}_extrapolated:
    hips that were put there are exempt from the confidence check. Joint by joint, first camera before second; then torso lengths of 5 and 3 pixels.
    A missing confidence fails, a missing coordinate counts as NaN."""
    views = (("CAM01", "a", 5.0), ("CAM02", "b", 3.0))
    terms = [F.when(~F.coalesce(F.col(f"{p}_has"), F.lit(False)), f"REJECT_NO_PERSON_{cam}") for cam, p, _ in views]
    for j in (5, 6, 11, 12):
        for cam, p, _ in views:
            low = ~F.coalesce(F.col(f"{p}_c{j}") >= least, F.lit(False))
            if desk and j in (11, 12):
                low = low & ~F.coalesce(F.col(f"{p}_extrapolated"), F.lit(False))
            gone = F.isnan(F.coalesce(F.col(f"{p}_x{j}"), F.lit(float("nan")))) | F.isnan(F.coalesce(F.col(f"{p}_y{j}"), F.lit(float("nan"))))
            terms += [F.when(low, f"REJECT_{cam}_LOW_CONF_JOINT_{j}"), F.when(gone, f"REJECT_{cam}_NAN_JOINT_{j}")]
    for cam, p, shortest in views:
        d = [(F.col(f"{p}_{a}5") + F.col(f"{p}_{a}6") - F.col(f"{p}_{a}11") - F.col(f"{p}_{a}12")) / 2 for a in "xy"]
        terms.append(F.when(F.sqrt(d[0] * d[0] + d[1] * d[1]) < shortest, f"REJECT_{cam}_DEGENERATE_TORSO_SCALE"))
    return df.withColumn("code", F.coalesce(*terms, F.lit("VALID_2D")))


def curation_flags(df: DataFrame) -> DataFrame:
    """QC-17 and QC-19: flag and decision of each row from its cluster's size, mixed, cross and whether it is the representative."""
    flag = F.when(F.coalesce(F.col("size"), F.lit(1)) <= 1, "SINGLETON").when(F.col("mixed") & F.col("cross"), "P1_MIXED_CROSS").when(F.col("cross"), "P2_CROSS_SPLIT").when(F.col("mixed"), "P3_MIXED_LABEL").otherwise("P4_SAME")
    df = df.withColumn("flag", flag)
    decision = F.when(F.col("flag") == "SINGLETON", "KEEP").when(F.col("flag").isin("P1_MIXED_CROSS", "P3_MIXED_LABEL"), "REVIEW").when(F.col("flag") == "P2_CROSS_SPLIT", F.when(F.col("rep"), "KEEP").otherwise("REVIEW")).otherwise(F.when(F.col("rep"), "KEEP").otherwise("EXCLUDE"))
    return df.withColumn("decision", decision)


def detection_status(cands: DataFrame, images: DataFrame | None = None, width: int = 1920, height: int = 1080) -> DataFrame:
    """QC-10, ORD-06: status of each image from the number of its candidates and whether the surest one is also first by the prior
    2 * area - distance from the centre + torso joints / 2. Candidates are combined before the shuffle. With ``images`` (image_id), those without any have ``no_target_detected``."""
    dx, dy = F.col("cx") / (width / 2) - 1, F.col("cy") / (height / 2) - 1
    prior = F.round(2 * F.col("w") * F.col("h") / (width * height) - F.sqrt(dx * dx + dy * dy) + 0.5 * F.col("torso_joints"), 9)
    best = cands.groupBy("image_id").agg(F.count("*").alias("n"), F.max_by(F.struct("cand", "mean_kpt", "torso_joints"), F.struct("conf", -F.col("cand"))).alias("c"), F.max_by("cand", F.struct(prior, -F.col("cand"))).alias("likely"))
    if images is not None:
        best = images.select("image_id").join(best, "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low = (F.col("c.mean_kpt") < 0.30) | (F.col("c.torso_joints") < 2)
    status = (
        F.when(F.col("n") == 0, "no_target_detected").when((F.col("n") == 1) & low, "low_keypoint_confidence").when(F.col("n") == 1, "correct_target")
        .when(F.col("c.cand") == F.col("likely"), "multiple_candidates").otherwise("wrong_person_risk")
    )
    return best.select("image_id", "n", status.alias("status"))


def selector_benchmark(cands: DataFrame, width: int = 1920, height: int = 1080, least: float = 0.22) -> DataFrame:
    """QC-11: how often the surest candidate and the selected one are right (area from 0.08 on, at most 0.65 off the centre), wrong or missing; mean keypoints of the right ones."""
    area, off = F.col("w") * F.col("h") / (width * height), F.abs(F.col("cx") / (width / 2) - 1)
    c = cands.select("image_id", (-F.col("cand")).alias("i"), "conf", target_score(width, height).alias("score"), ((area >= 0.08) & (off <= 0.65)).alias("right"), F.col("mean_kpt").alias("kpt"))
    best = c.groupBy("image_id").agg(F.max(F.struct("conf", "i", "score", "right", "kpt")).alias("c"), F.max(F.struct("score", "i", "right", "kpt")).alias("s"))
    pick = lambda name, p, ok: F.struct(F.lit(name).alias("method"), F.when(ok, F.col(f"{p}.right")).alias("right"), F.col(f"{p}.kpt").alias("kpt"))
    each = best.select(F.explode(F.array(pick("surest", "c", F.lit(True)), pick("selected", "s", F.col("s.score") >= least))).alias("p")).select("p.*")
    return each.groupBy("method").agg(F.count("*").alias("n"), F.count_if("right").alias("right"), F.count_if(~F.col("right")).alias("wrong"), F.count_if(F.col("right").isNull()).alias("none"), F.avg(F.when(F.col("right"), F.col("kpt"))).alias("kpt"))


def representatives(df: DataFrame, cluster: str, *order) -> DataFrame:
    """ORD-03: top row of each cluster by a composite key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).filter("nth = 1").drop("nth")
