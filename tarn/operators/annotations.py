"""Annotation files: label lines of a pose detector, boxes, image measures, roll-ups of an audit. No Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_lines(files: DataFrame, path: str = "path", body: str = "value") -> DataFrame:
    """SRC-07: one row a line of each file (``line`` from 1) with its white-space separated ``tokens``; a file without any is one row with ``line`` NULL."""
    text = F.trim(F.regexp_replace(F.col(body), r"^\s+|\s+$", ""))
    lines = F.when(text != "", F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"))
    return files.select(path, F.posexplode_outer(lines).alias("line", "raw")).select(path, (F.col("line") + 1).alias("line"), F.filter(F.split(F.col("raw"), r"\s+"), lambda t: t != "").alias("tokens"))


def label_issues(lines: DataFrame, classes: int | None, points: int, size: int = 3) -> DataFrame:
    """QC-15: lines with ``values`` (doubles, NULL where the line can't be read), ``cls``, ``valid`` and ``issues``; every rule that fails is named, in order.
    A point at (0, 0) counts as not annotated, so only its visibility is checked."""
    want = 5 + points * size
    lines = lines.withColumn("values", F.transform("tokens", lambda t: t.try_cast("double")))
    finite = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    count = F.size("tokens") == want
    v = lambda i: F.get("values", F.lit(i))
    out = lambda c: ~c.between(0.0, 1.0)
    whole = F.when(v(0) >= 0, F.floor(v(0))).otherwise(F.ceil(v(0)))
    rules: list[tuple[Column, str]] = [(v(0) != whole, "class_not_integer"), (whole < 0, "class_negative")]
    if classes is not None:
        rules.append((whole >= classes, "class_out_of_range"))
    rules += [(out(v(1 + i)), f"box_{n}_outside") for i, n in enumerate("xywh")] + [((v(3) <= 0) | (v(4) <= 0), "box_without_area")]
    for k in range(points):
        at = 5 + k * size
        placed = ~((v(at) == 0) & (v(at + 1) == 0))
        rules += [(placed & out(v(at)), f"point{k}_x_outside"), (placed & out(v(at + 1)), f"point{k}_y_outside")]
        if size >= 3:
            rules.append((~v(at + 2).between(0.0, 2.0), f"point{k}_visibility_outside"))
    named = lambda rs: F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rs)))
    read = count & finite
    issues = F.when(F.col("line").isNull(), F.array(F.lit("empty_label"))).when(~read, named([(~count, "token_count"), (~finite, "not_a_finite_number")])).otherwise(named(rules))
    return lines.select(*(c for c in lines.columns if c not in ("tokens", "values")), F.when(read, F.col("values")).alias("values"), F.when(read, whole).cast("int").alias("cls"), issues.alias("issues"), (F.size(issues) == 0).alias("valid"))


def box_issue(x: Column, y: Column, w: Column, h: Column) -> Column:
    """QC-14: the first thing wrong with a box, NULL if nothing is."""
    return F.when(x.isNull() | y.isNull() | w.isNull() | h.isNull(), "box_incomplete").when((w <= 0) | (h <= 0), "box_without_area").when((x < 0) | (y < 0), "box_outside")


def annotation_issue(box: Column, seen: Column) -> Column:
    """QC-21: a wrong box comes before points of which none is visible."""
    return F.when(box.isNotNull(), "bbox_invalid").when(F.coalesce(seen, F.lit(0)) == 0, "all_keypoints_invisible")


def image_quality(df: DataFrame) -> DataFrame:
    """QC-12 and AGG-26: valid, corrupt, dark (brightness < 45), blurred (edge variance < 120) and small (a side < 224) images by split, with warnings. Corrupt images count as nothing else."""
    ok = ~F.coalesce(F.col("corrupt"), F.lit(False))
    n = df.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("corrupt"), F.count_if(ok & (F.col("brightness") < 45)).alias("dark"),
        F.count_if(ok & (F.col("edge_variance") < 120)).alias("blurred"), F.count_if(ok & (F.least("width", "height") < 224)).alias("small"),
    )
    return n.withColumn("warnings", F.array_join(F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in ("corrupt", "dark", "blurred", "small")))), "; "))


def audit_rollup(images: DataFrame, boxes: DataFrame, only_valid: bool) -> DataFrame:
    """AGG-26, class part: images without annotations count as class ``no_annotation`` (JOI-10); ``only_valid`` counts boxes without issue alone."""
    b = boxes.filter(F.col("issue").isNull()) if only_valid else boxes
    per = b.groupBy("image_id", "cls").agg(F.count("*").alias("n"))
    j = images.select("image_id", "split").join(per, "image_id", "left")
    return j.groupBy("split", F.coalesce("cls", F.lit("no_annotation")).alias("cls")).agg(F.count_distinct("image_id").alias("images"), F.sum(F.coalesce("n", F.lit(0))).alias("boxes"))


def group_rates(df: DataFrame, sure: float) -> DataFrame:
    """AGG-21, 22: mean over the joints of head (0-4), torso (5-10) and lower body (11-16) of each joint's share of sure views, by camera. Needs ``camera``, ``j``, ``c``."""
    part = F.when(F.col("j") <= 4, "head").when(F.col("j") <= 10, "torso").otherwise("lower")
    each = df.groupBy("camera", "j").agg(F.avg(F.coalesce(F.col("c") >= sure, F.lit(False)).cast("double")).alias("rate"), F.count_if(F.col("c") >= sure).alias("seen"))
    return each.groupBy("camera", part.alias("part")).agg(F.avg("rate").alias("rate"), F.sum("seen").alias("seen"))


def apply_decisions(df: DataFrame) -> DataFrame:
    """QC-18, PRJ-08: the manual decision, else the automatic one, trimmed and in capitals; REMOVE counts as EXCLUDE, unknown ones are kept apart."""
    d = F.coalesce(F.nullif(F.upper(F.trim("manual")), F.lit("")), F.upper(F.trim("automatic")), F.lit(""))
    return df.withColumn("final", F.when(d.isin("KEEP", "RELABEL", "REVIEW"), d).when(d.isin("EXCLUDE", "REMOVE"), "EXCLUDE").otherwise("UNKNOWN"))
