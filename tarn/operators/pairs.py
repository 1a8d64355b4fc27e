"""Rules on a capture's two views: keypoint quality and whether both show one person. Projections only."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.geometry import decimals
from tarn.operators import pose

SURE = 0.25


def _seen(p: str, *joints: int, all_of: bool = True) -> Column:
    return reduce(and_ if all_of else or_, (F.coalesce(F.col(f"{p}_c{j}") >= SURE, F.lit(False)) for j in joints))


def keypoint_quality(df: DataFrame) -> DataFrame:
    """QC-01: PASS, REVIEW or FAIL; a capture of posture ``reject`` without a target passes. Frontal joints must all be seen, one lateral joint is enough."""
    n = {p: sum((_seen(p, j).cast("int") for j in range(1, 17)), _seen(p, 0).cast("int")) for p in "ab"}
    head = (_seen("a", 0) | _seen("a", 1, 2)) & _seen("b", 0, 1, 2, all_of=False)
    torso = _seen("a", 5, 6, 11, 12) & _seen("b", 5, 6, all_of=False) & _seen("b", 11, 12, all_of=False)
    even = F.least("a_h", "b_h") / F.greatest(F.lit(1.0), F.greatest("a_h", "b_h")) >= 0.40
    both = F.col("a_has") & F.col("b_has")
    few = F.least(F.col("a_n"), F.col("b_n"))
    df = df.withColumns({"a_n": F.when(both, n["a"]).otherwise(0), "b_n": F.when(both, n["b"]).otherwise(0)})
    status = (
        F.when(~both, F.when(F.col("posture") == "reject", "PASS").otherwise("FAIL")).when(torso & head & (few >= 10) & even, "PASS").when(torso & (few >= 8), "REVIEW").otherwise("FAIL")
    )
    return df.withColumn("status", status)


def _relative(p: str) -> dict[str, Column]:
    over = lambda j: F.col(f"{p}_c{j}") > SURE
    return {
        "area": F.col(f"{p}_w") * F.col(f"{p}_h") / (1920 * 1080),
        "nose": F.when(over(0), (F.col(f"{p}_y0") - F.col(f"{p}_top")) / F.greatest(F.col(f"{p}_h"), F.lit(1.0))),
        "span": F.when(over(5) & over(6), F.abs(F.col(f"{p}_x5") - F.col(f"{p}_x6")) / F.greatest(F.col(f"{p}_w"), F.lit(1.0))),
        "rise": F.when(over(0) & over(11), F.abs(F.col(f"{p}_y11") - F.col(f"{p}_y0"))),
        "centre": (F.col(f"{p}_left") + F.col(f"{p}_w") / 2) / 1920,
    }


def correspondence(df: DataFrame, thorough: bool = False) -> DataFrame:
    """QC-02 (three checks) and QC-03 (``thorough``: five, and ``flags``, the checks that fired with their numbers, joined by ``; ``, or CLEAN; STR-08). Adds ``score`` and ``verdict``."""
    a, b = _relative("a"), _relative("b")
    measures = {"_ratio": b["area"] / F.greatest(a["area"], F.lit(0.001)), "_gap": F.abs(a["nose"] - b["nose"]), "_a_span": a["span"], "_b_span": b["span"]}
    if thorough:
        measures |= {"_rise": b["rise"] / F.greatest(a["rise"], F.lit(1.0)), "_a_centre": a["centre"], "_b_centre": b["centre"]}
    columns = df.columns
    # numbers once; the texts of the checks name them many times
    df = pose._settled(df.withColumns(measures))
    ratio, gap = F.col("_ratio"), F.col("_gap")
    a, b = ({k: F.col(f"_{p}_{k}") for k in ("span", "centre")} for p in "ab")

    def says(text: str, *values: tuple[Column, int]) -> Column:
        return F.format_string(text, *(decimals(c, n) for c, n in values)) if values else F.lit(text)

    # of each group the first check that holds counts
    checks: list[list[tuple[Column, Column, int]]] = [
        [((ratio > 2.5) | (ratio < 0.4), says("AREA_RATIO_EXTREME(%s)", (ratio, 2)), 2), ((ratio > 2.0) | (ratio < 0.5), says("AREA_RATIO_HIGH(%s)", (ratio, 2)), 1)],
        [(gap > 0.20, says("NOSE_POS_MISMATCH(d=%s)", (gap, 3)), 2), (gap > 0.10, says("NOSE_POS_DIVERGENT(d=%s)", (gap, 3)), 1)],
        [((a["span"] > 0.30) & (b["span"] > 0.30), says("BOTH_FRONTAL_SPAN(c1=%s,c2=%s)", (a["span"], 3), (b["span"], 3)), 3)],
    ]
    if thorough:
        rise = F.col("_rise")
        checks[2].append(((b["span"] > 0.25) & a["span"].isNotNull(), says("LATERAL_WIDE_SPAN(c2=%s)", (b["span"], 3)), 1))
        checks.append([((rise > 2.0) | (rise < 0.5), says("TORSO_V_EXTREME(ratio=%s)", (rise, 2)), 2)])
        checks.append([((a["centre"] <= 0.2) | (a["centre"] >= 0.8), says("C1_OFF_CENTER"), 1)])
        checks.append([((b["centre"] <= 0.2) | (b["centre"] >= 0.9), says("C2_OFF_CENTER"), 1)])
    both = F.col("a_has") & F.col("b_has")
    points = sum(F.coalesce(*(F.when(c, n) for c, _, n in group), F.lit(0)) for group in checks)
    df = df.withColumn("score", F.when(both, points).otherwise(0))
    if thorough:
        flags = F.array_compact(F.array(*(F.coalesce(*(F.when(c, text) for c, text, _ in group)) for group in checks)))
        said = [F.initcap(F.col(f"{p}_has").cast("string")) for p in "ab"]
        df = df.withColumn("flags", F.when(~both, F.format_string("C1_target=%s, C2_target=%s", *said)).when(F.size(flags) == 0, "CLEAN").otherwise(F.array_join(flags, "; ")))
    s = F.col("score")
    return df.select(*columns, "score", *(["flags"] if thorough else []), F.when(~both, "NO_TARGET").when(s == 0, "SAME_PERSON").when(s <= 2, "LIKELY_SAME").when(s <= 4, "SUSPICIOUS").otherwise("WRONG_PERSON").alias("verdict"))
