"""Evaluation from one confusion count: predictions are read once and shrink to classes squared before anything else."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, *by: str, truth: str = "y", guess: str = "p") -> DataFrame:
    """EVL-06: counts and row shares."""
    n = pred.groupBy(*by, truth, guess).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, truth)))


def per_class(pred: DataFrame, *by: str, truth: str = "y", guess: str = "p") -> DataFrame:
    """EVL-02: precision, recall and F1 of each class present in truth or prediction; 0 where the denominator is."""
    n = pred.groupBy(*by, truth, guess).agg(F.count("*").alias("n"))
    hit = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)
    each = n.select(*by, F.col(truth).alias("cls"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).alias("guessed")).unionByName(n.select(*by, F.col(guess).alias("cls"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("guessed")))
    s = each.groupBy(*by, "cls").agg(*(F.sum(c).cast("double").alias(c) for c in ("tp", "support", "guessed")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select(*by, "cls", F.col("support").cast("bigint").alias("support"), ratio(F.col("tp"), F.col("guessed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1"), "tp")


def summary(pred: DataFrame, *by: str, truth: str = "y", guess: str = "p") -> DataFrame:
    """EVL-01, 03, 04, 05: accuracy, macro scores, weighted F1, balanced accuracy."""
    c = per_class(pred, *by, truth=truth, guess=guess)
    return c.groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def paired(pred: DataFrame, truth: str = "y", a: str = "a", b: str = "b") -> DataFrame:
    """EVL-09, 10: outcomes of two models and McNemar's statistic with continuity."""
    x, y = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    n = pred.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    d = F.col("only_a") + F.col("only_b")
    gap = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return n.withColumn("chi2", F.when(d == 0, 0.0).otherwise(F.try_divide((gap * gap).cast("double"), d.cast("double"))))


def mcnemar_p(chi2: float) -> float:
    return math.erfc(math.sqrt(chi2 / 2))


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by numerical integration of its density in a variable that tames both ends."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    steps = 4000
    end = math.asin(math.sqrt(x))
    log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    f = lambda t: 2 * math.exp((2 * a - 1) * math.log(math.sin(t)) + (2 * b - 1) * math.log(math.cos(t)) - log_b) if t > 0 else (2 * math.exp(-log_b) if 2 * a == 1 else 0.0)
    h = end / steps
    return h / 3 * sum(f(i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))


def paired_t(a: list[float], b: list[float]) -> tuple[float, float]:
    """EVL-11: paired t statistic over folds (a handful of numbers) and its two-sided probability; equal lists give (0, 1)."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    n, mean = len(d), sum(d) / len(d)
    var = sum((x - mean) ** 2 for x in d) / (n - 1)
    if var == 0:
        return (0.0, 1.0) if mean == 0 else (math.copysign(math.inf, mean), 0.0)
    t = mean / math.sqrt(var / n)
    return t, _beta((n - 1) / (n - 1 + t * t), (n - 1) / 2, 0.5)


def fold_t(pred: DataFrame, truth: str = "y", a: str = "a", b: str = "b") -> DataFrame:
    """EVL-11 as a plan: number of folds, mean difference of accuracies and the statistic (NULL where all differences are equal)."""
    each = pred.groupBy("fold").agg((F.avg((F.col(a) == F.col(truth)).cast("double")) - F.avg((F.col(b) == F.col(truth)).cast("double"))).alias("d"))
    return each.agg(F.count("*").alias("folds"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).select("folds", "mean", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("folds")).alias("t"))


def against_baseline(summary: DataFrame, baseline: str, score: str = "macro_f1", name: str = "model") -> DataFrame:
    """EVL-17: each model's score less the baseline's (NULL, not 0, where the baseline has none)."""
    base = summary.filter(F.col(name) == baseline).agg(F.max(score).alias("_b"))
    return summary.crossJoin(F.broadcast(base)).select(name, score, (F.col(score) - F.col("_b")).alias("delta"))


def extremes(df: DataFrame, name: str, value: str) -> DataFrame:
    """ORD-08: the rows with the greatest and the least value (ties: least name), as one row; NULLs don't count."""
    some = df.filter(F.col(value).isNotNull())
    top = some.agg(F.max(value).alias("_h"), F.min(value).alias("_l"))
    both = some.join(F.broadcast(top), (F.col(value) == F.col("_h")) | (F.col(value) == F.col("_l")))
    return both.agg(F.min(F.when(F.col(value) == F.col("_h"), F.col(name))).alias("best"), F.max("_h").alias("best_value"), F.min(F.when(F.col(value) == F.col("_l"), F.col(name))).alias("worst"), F.max("_l").alias("worst_value"))
