"""Queries of training, prediction and further evaluation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarn.operators import boosting, evaluate, learning, pose
from tarn.plans.catalog import _SQL_CLASS, _SQL_PRED, _SQL_VIEW, _models
from tarn.plans.registry import query, rounded
from tarn.sources import tables as T


def _features(spark, d):
    f = pose._settled(pose.view_features(T.pose2d(spark, d, (0, 3, 4, 5, 6, 11, 12)))).filter("ok")
    return f.select(F.col("vec_id").alias("capture_id"), (F.floor(F.col("vec_id") / 2) % 3).cast("int").alias("fold"), T.label("label").alias("label"), *pose.VIEW)


@query()
def forest_out_of_fold(spark, d):
    """ML-01, 02, 06, 08, 10: tested on a separable set."""
    oof = learning.out_of_fold(_features(spark, d), list(pose.VIEW), list(T.CLASSES), "forest", [0, 1, 2], trees=20)
    return rounded(oof.select("capture_id", "model", "fold", "label_true", "label_pred", "confidence"))


# features that every usable view has
_TREE_FEATURES = ("left_shoulder_x", "left_shoulder_y", "right_shoulder_x", "right_shoulder_y", "right_hip_x", "right_hip_y", "shoulder_slope_deg", "hip_slope_deg", "torso_inclination_deg", "torso_length_norm", "torso_horizontal_offset_norm")
_TREE_ROUNDS, _TREE_RATE, _TREE_BINS = 2, 0.3, 16


def _level_sql(r: int, level: int, rows: str) -> str:
    """One level of all trees of a round: histograms, running sums over bins, and the best split of each node."""
    n = f"{r}_{level}"
    part = lambda g, h: f"pow({g} / s, 2) / ({h} / s + 1)"
    first = 1 if level == 0 else 3
    return f"""
h{n} AS (SELECT k, node, f, bin, sum(g) AS g, sum(h) AS h FROM {rows} JOIN tb USING (id) GROUP BY ALL),
c{n} AS (SELECT k, node, f, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY k, node, f) AS g, sum(h) OVER (PARTITION BY k, node, f) AS h FROM h{n} WINDOW w AS (PARTITION BY k, node, f ORDER BY bin)),
e{n} AS (SELECT *, ({part('gl', 'hl')} + {part('(g - gl)', '(h - hl)')} - {part('g', 'h')}) / 2 AS gain FROM c{n}, ts WHERE hl / s >= 1 AND (h - hl) / s >= 1),
t{n} AS (SELECT *, {first} + 2 * (row_number() OVER (PARTITION BY k ORDER BY node) - 1) AS kid FROM (SELECT * FROM e{n} WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, bin) = 1)),
n{n} AS (SELECT a.id, a.k, a.g, a.h, coalesce(t.kid + (b.bin > t.bin)::INT, a.node) AS node FROM {rows} a LEFT JOIN t{n} t ON t.k = a.k AND t.node = a.node LEFT JOIN tb b ON b.id = a.id AND b.f = t.f)"""


def _trees_sql() -> str:
    names = ", ".join(f"'{c}'" for c in _TREE_FEATURES)
    out = _SQL_VIEW + f""", tx AS (SELECT vec_id AS id, label % 6 AS y, {', '.join(_TREE_FEATURES)} FROM f WHERE ok),
tu AS (SELECT id, unnest(range({len(_TREE_FEATURES)})) AS f, unnest([{', '.join(_TREE_FEATURES)}]) AS v FROM tx), tq AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS nth, count(*) OVER (PARTITION BY f) AS n FROM tu),
tcuts AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS bin FROM (SELECT DISTINCT f, v FROM tq JOIN range(1, {_TREE_BINS}) i(i) ON nth = greatest(1, ceil(i * n / {_TREE_BINS}.0::DOUBLE)))),
tb AS (SELECT u.id, u.f, count(cuts.v) AS bin FROM tu u LEFT JOIN tcuts cuts ON cuts.f = u.f AND cuts.v < u.v GROUP BY u.id, u.f), ts AS (SELECT pow(2, least(36, 56 - floor(log2(count(*))))) AS s FROM tx),
m0 AS (SELECT id, y, k, 0::DOUBLE AS margin FROM tx, range(6) k(k))"""
    for r in range(_TREE_ROUNDS):
        out += f""",
p{r} AS (SELECT id, y, k, e / sum(e) OVER (PARTITION BY id) AS p FROM (SELECT *, exp(margin - max(margin) OVER (PARTITION BY id)) AS e FROM m{r})),
g{r} AS (SELECT id, k, 0 AS node, round_even((p - (y = k)::INT) * s, 0)::HUGEINT AS g, round_even(greatest(2 * p * (1 - p), 1e-16) * s, 0)::HUGEINT AS h FROM p{r}, ts),{_level_sql(r, 0, f'g{r}')},{_level_sql(r, 1, f'n{r}_0')},
l{r} AS (SELECT k, node, -(sum(g) / any_value(s)) / (sum(h) / any_value(s) + 1) * {_TREE_RATE}::DOUBLE AS value FROM n{r}_1, ts GROUP BY k, node),
m{r + 1} AS (SELECT id, y, m.k, margin + value AS margin FROM m{r} m JOIN n{r}_1 USING (id, k) JOIN l{r} USING (k, node))"""
    parts = []
    for r in range(_TREE_ROUNDS):
        parts += [f"SELECT {r} AS round, k AS cls, t.node, [{names}][t.f + 1] AS feature, round(c.v, 6) AS threshold, round(gain, 6) AS gain, 0::DOUBLE AS value FROM t{r}_{level} t JOIN tcuts c ON c.f = t.f AND c.bin = t.bin" for level in (0, 1)]
        parts.append(f"SELECT {r}, k, node, NULL, NULL, 0, round(value, 6) FROM l{r}")
    return out + " SELECT round::INT AS round, cls::INT AS cls, node::INT AS node, feature, threshold, gain, value FROM (" + " UNION ALL ".join(parts) + ")"


@query(_trees_sql())
def boosted_trees(spark, d):
    """ML-03: every node of the trees of two rounds, one tree a class a round on shared softmax gradients."""
    f = _features(spark, d)
    model = boosting.fit(f, list(_TREE_FEATURES), list(T.CLASSES), boosting.Params(rounds=_TREE_ROUNDS, depth=2, rate=_TREE_RATE), ["capture_id"], bins=_TREE_BINS)
    return rounded(spark.createDataFrame(model.splits(), "round int, cls int, node int, feature string, threshold double, gain double, value double"))


@query()
def boosted_predictions(spark, d):
    """ML-03, 04, 09, 10: one held-out fold by boosted trees; the trees are tested against a plain version."""
    f = _features(spark, d)
    out = learning.fit(f.filter("fold <> 0"), list(pose.VIEW), list(T.CLASSES), "boosted", rounds=5, depth=3).predict(f.filter("fold = 0"))
    return rounded(out.select("capture_id", "label", "label_pred", "confidence"))


#: what a search draws from
SPACE = {
    "rounds": [3, 4, 5], "depth": [2, 3, 4], "rate": [0.03, 0.05, 0.08, 0.1], "rows": [0.7, 0.8, 0.9, 1.0], "columns": [0.7, 0.8, 0.9, 1.0],
    "child": [1.0, 2.0, 3.0], "gamma": [0.0, 0.1, 0.5], "alpha": [0.0, 0.01, 0.1], "lam": [0.1, 1.0, 2.0],
}


@query()
def search_draws(spark, d):
    """ML-07, SPL-04: eight draws on three grouped folds, all trained in the same passes; tested against one model after the other."""
    picks = list(learning.draws(SPACE, 8))
    found = boosting.search(_features(spark, d), list(pose.VIEW), list(T.CLASSES), [boosting.Params(**p) for p in picks], [0, 1, 2], ["capture_id"], bins=32)
    rows = [(i, json.dumps(p), score, rounds, score == max(s for _, s, _, _ in found)) for i, (p, (_, score, rounds, _)) in enumerate(zip(picks, found, strict=True))]
    return rounded(spark.createDataFrame(rows, "draw int, params string, macro_f1 double, rounds int, best boolean"))


@query()
def perceptron_predictions(spark, d):
    """ML-05: tested on a separable set."""
    f = _features(spark, d)
    out = learning.fit(f.filter("fold <> 0"), list(pose.VIEW), list(T.CLASSES), "perceptron", hidden=(32, 16), rounds=40).predict(f.filter("fold = 0"))
    return rounded(out.select("capture_id", "label", "label_pred", "confidence"))


@query(_SQL_PRED + ", e AS (SELECT fold, avg((a = y)::INT) - avg((b = y)::INT) AS d FROM o GROUP BY fold) SELECT count(*) AS folds, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM e")
def fold_paired_t(spark, d):
    """EVL-11."""
    return rounded(evaluate.fold_t(T.predictions(spark, d)))


@query("SELECT d.source, count(*) AS captures, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.quality = 1) AS usable, round(100.0 * count(l.doc_id) / count(*), 4) AS coverage, round(100.0 * count(*) FILTER (WHERE l.quality = 1) / count(*), 4) AS usable_pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def source_coverage(spark, d):
    """EVL-14."""
    j = T.read(spark, d, "documents").select("doc_id", "source").join(T.read(spark, d, "labels").select("doc_id", "quality", F.lit(1).alias("l")), "doc_id", "left")
    usable = F.count_if(F.coalesce(F.col("quality") == 1, F.lit(False)))
    return j.groupBy("source").agg(F.count("*").alias("captures"), F.count("l").alias("labelled"), usable.alias("usable"), F.round(100.0 * F.count("l") / F.count("*"), 4).alias("coverage"), F.round(100.0 * usable / F.count("*"), 4).alias("usable_pct"))


@query(_SQL_PRED + " SELECT capture_id % 24 AS subject, y AS cls, count(*) AS n, count(*) FILTER (WHERE a = y) AS \"right\" FROM o GROUP BY 1, 2")
def subject_batch(spark, d):
    """EVL-15."""
    return T.predictions(spark, d).groupBy((F.col("capture_id") % 24).alias("subject"), F.col("y").alias("cls")).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("y")).alias("right"))


@query(_SQL_PRED.replace("SELECT 'a' AS model, fold, y, a AS p FROM o UNION ALL SELECT 'b', fold, y, b FROM o", "SELECT 'a' AS model, 0 AS fold, CASE WHEN y = 0 THEN 'good' ELSE 'bad' END AS y, CASE WHEN a = 0 THEN 'good' ELSE 'bad' END AS p FROM o") + _SQL_CLASS + " SELECT cls, s::BIGINT AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM c")
def binary_transfer(spark, d):
    """EVL-16, STR-10: six classes folded to good and bad by the taxonomy, then scored."""
    good = lambda c: F.when(F.col(c) == 0, "good").otherwise("bad").alias({"y": "y", "a": "p"}[c])
    return rounded(evaluate.per_class(T.predictions(spark, d).select(good("y"), good("a"))).select("cls", "support", "precision", "recall", "f1"))


@query(_SQL_PRED + _SQL_CLASS.replace("fold, ", "") + ", s AS (SELECT model, avg(f1) AS macro_f1 FROM c GROUP BY model) SELECT model, round(macro_f1, 6) AS macro_f1, round(macro_f1 - (SELECT macro_f1 FROM s WHERE model = 'a'), 6) AS delta FROM s")
def variant_deltas(spark, d):
    """EVL-17."""
    return rounded(evaluate.against_baseline(evaluate.summary(_models(spark, d), "model"), "a"))
