"""Feature sets of joint schemes with seven, four and seventeen points (FEA-12, 13, 14) and the early nine features of a pair (FEA-15).

Pure projections over named joints {name}_x, {name}_y. Angles are directed slopes in degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.geometry import mid, minus, norm, slope

SEVEN = ("lsho", "rsho", "leye", "lear", "nose", "rear", "reye")
FOUR = ("head", "shoulder", "back", "bottom")
UPPER = ("nose", "leye", "reye", "lear", "rear", "lsho", "rsho")


def _point(name: str) -> tuple[Column, Column]:
    return F.col(f"{name}_x"), F.col(f"{name}_y")


def _toward(a: tuple, b: tuple) -> Column:
    return slope(*minus(b, a))


def in_box(df: DataFrame, names: tuple[str, ...], empty: str = "drop") -> DataFrame:
    """GEO-15: joints relative to the box's centre (box_x, box_y) and size. A box without area drops the row (``drop``) or leaves its joints as they are (``raw``)."""
    w, h = F.col("box_w"), F.col("box_h")
    if empty == "drop":
        df, ok = df.filter((w != 0) & (h != 0)), F.lit(True)
    else:
        ok = (w > 0) & (h > 0)
    scaled = {f"{n}_{a}": F.when(ok, F.try_divide(F.col(f"{n}_{a}") - F.col(f"box_{a}"), s)).otherwise(F.col(f"{n}_{a}")) for n in names for a, s in (("x", w), ("y", h))}
    return df.withColumns(scaled)


def seven_points(df: DataFrame) -> DataFrame:
    """FEA-12: 23 measures of shoulders, eyes, ears and nose, then the 14 box-relative coordinates."""
    df = in_box(df, SEVEN)
    out, middle = {}, {}
    for part in ("sho", "eye", "ear"):
        left, right = _point(f"l{part}"), _point(f"r{part}")
        middle[part] = mid(left, right)
        out |= {f"{part}_mid_x": middle[part][0], f"{part}_mid_y": middle[part][1], f"{part}_width": norm(*minus(right, left)), f"{part}_slope": _toward(left, right), f"{part}_dy": right[1] - left[1]}
    nose = _point("nose")
    dx, dy = minus(nose, middle["sho"])
    out |= {"nose_at_x": nose[0], "nose_at_y": nose[1], "nose_sho_dx": dx, "nose_sho_dy": dy, "nose_eye_dy": nose[1] - middle["eye"][1], "head_tilt": _toward(middle["ear"], nose), "lateral_offset": dx, "vertical_gap": -dy}
    return df.select("vec_id", "label", *(c.alias(n) for n, c in out.items()), *(F.col(f"{n}_{a}") for n in SEVEN for a in "xy"))


def four_points(df: DataFrame) -> DataFrame:
    """FEA-13: box-relative coordinates, then angles, distances and offsets of the joints as given, then those joints."""
    inside = in_box(df.withColumns({f"raw_{n}_{a}": F.col(f"{n}_{a}") for n in FOUR for a in "xy"}), FOUR, "raw")
    p = {n: (F.col(f"raw_{n}_x"), F.col(f"raw_{n}_y")) for n in FOUR}
    lines = {"spine_lower": ("bottom", "shoulder"), "spine_upper": ("shoulder", "head"), "spine_full": ("bottom", "head"), "back": ("shoulder", "back")}
    out = {f"{n}_slope": _toward(p[a], p[b]) for n, (a, b) in lines.items()}
    out |= {f"{n}_length": norm(*minus(p[b], p[a])) for n, (a, b) in (lines | {"bottom_back": ("bottom", "back")}).items()}
    for n in ("head", "back"):
        dx, dy = minus(p[n], p["shoulder"])
        out |= {f"{n}_sho_dx": dx, f"{n}_sho_dy": dy}
    out |= {"curvature": out["spine_upper_slope"] - out["spine_lower_slope"], "forward_offset": p["head"][0] - p["bottom"][0]}
    return inside.select("vec_id", "label", *(F.col(f"{n}_{a}") for n in FOUR for a in "xy"), *(c.alias(n) for n, c in out.items()), *(F.col(f"raw_{n}_{a}") for n in FOUR for a in "xy"))


def seventeen_points(df: DataFrame, found: Column) -> DataFrame:
    """FEA-14 and GEO-17: 14 measures and 14 coordinates of an image's person; all 0 where none was found or a value isn't finite."""
    p = {n: _point(n) for n in (*UPPER, "lhip", "rhip")}
    sho, hip = mid(p["lsho"], p["rsho"]), mid(p["lhip"], p["rhip"])
    torso, head = minus(sho, hip), minus(p["nose"], sho)
    out = {
        "sho_width": norm(*minus(p["rsho"], p["lsho"])), "sho_slope": _toward(p["lsho"], p["rsho"]), "sho_dy": p["rsho"][1] - p["lsho"][1],
        "hip_width": norm(*minus(p["rhip"], p["lhip"])), "hip_slope": _toward(p["lhip"], p["rhip"]), "head_dx": head[0], "head_dy": head[1], "head_slope": slope(*head),
        "torso_length": norm(*torso), "torso_slope": slope(*torso), "torso_dx": torso[0],
        "ear_slope": _toward(p["lear"], p["rear"]), "ear_dy": p["rear"][1] - p["lear"][1], "eye_slope": _toward(p["leye"], p["reye"]),
    }
    out |= {f"{n}_{a}": F.col(f"{n}_{a}") for n in ("nose", "lsho", "rsho", "lear", "rear", "lhip", "rhip") for a in "xy"}
    keep = lambda c: F.when(found & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c).otherwise(0.0)
    return df.select("vec_id", "label", *(keep(c).alias(n) for n, c in out.items()))


def pair_nine(df: DataFrame) -> DataFrame:
    """FEA-15: nine features of a capture with both views; rows without both are NULL. Needs columns of ``pairs`` and ``depth`` (NULL: none, taken as 1.5)."""
    a = {j: (F.col(f"a_x{j}"), F.col(f"a_y{j}")) for j in (1, 2, 5, 6, 11, 12)}
    b = {j: (F.col(f"b_x{j}"), F.col(f"b_y{j}")) for j in (3, 4, 5, 6, 11, 12)}
    surer = lambda i, j: tuple(F.when(F.col(f"b_c{i}") > F.col(f"b_c{j}"), x).otherwise(y) for x, y in zip(b[i], b[j], strict=True))
    ear, sho = surer(3, 4), surer(5, 6)
    top, low = mid(a[5], a[6]), mid(a[11], a[12])
    length = norm(*minus(top, low)) + 1e-5
    out = {
        "shoulder_slope": _toward(a[5], a[6]), "head_tilt": _toward(a[1], a[2]), "torso_lateral": _toward(low, top) - 90.0, "shoulder_width": norm(*minus(a[5], a[6])) / length,
        "cervical": _toward(sho, ear), "trunk_sagittal": _toward(mid(b[11], b[12]), mid(b[5], b[6])), "head_forward": (ear[0] - sho[0]) / length,
        "has_3d": F.col("depth").isNotNull().cast("double"), "depth_z": F.coalesce(F.abs(F.col("depth")), F.lit(1.5)),
    }
    both = F.col("a_has") & F.col("b_has")
    return df.select("capture_id", "posture", *(F.when(both, c).alias(n) for n, c in out.items()))
