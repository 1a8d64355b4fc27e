"""Boosted trees against a plain version that looks at every row for every split; draws of a search against one model after the other."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.operators import boosting
from tarn.operators.boosting import Params

CLASSES = ["a", "b", "c"]
FEATURES = ["f0", "f1", "f2", "f3"]


def table(spark, n=400, seed=0, classes=CLASSES):
    """Rows with missing values, ties, repeated keys and a label outside the classes."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(1)
    y = np.clip((x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) * 0.3 + 1.5).astype(int), 0, len(classes))
    rows = []
    for i in range(n):
        v = [None if rng.random() < 0.15 and f == 1 else float("nan") if rng.random() < 0.1 and f == 2 else float(x[i, f]) for f in range(4)]
        rows.append((i // 2 if i < 40 else i, [*classes, "other"][y[i]], i % 3, 1.5 if y[i] == 1 else 1.0, *v))
    return spark.createDataFrame(rows, "id long, label string, fold int, w double, f0 double, f1 double, f2 double, f3 double").repartition(5)


def plain(rows, cuts, params, scale, out=None, classes=CLASSES, weighted=False):
    """(trees as nested tuples a round and class, margins) by loops over rows and thresholds; gradients rounded to the same fixed point."""
    rows = [r for r in rows if r["label"] in classes]
    x = np.array([[math.nan if r[f] is None else r[f] for f in FEATURES] for r in rows])
    y = np.array([classes.index(r["label"]) for r in rows])
    fold, key = np.array([r["fold"] for r in rows]), np.array([r["key"] for r in rows])
    w = np.array([r["w"] if weighted else 1.0 for r in rows])
    k = 1 if len(classes) == 2 else len(classes)
    margins, made = np.zeros((len(x), k)), []
    for turn in range(params.rounds):
        p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True) if k > 1 else 1 / (1 + np.exp(-margins))
        use = (fold != out if out is not None else np.ones(len(x), bool)) & boosting.drawn(key, params, turn)
        trees, step = [], np.zeros_like(margins)
        for c in range(k):
            q = p[:, c]
            hit = y == (1 if k == 1 else c)
            g = np.rint((q - hit) * w * scale).astype(int)
            h = np.rint(np.maximum((1 if k == 1 else 2) * q * (1 - q), 1e-16) * w * scale).astype(int)
            allowed = boosting.columns_of(params, turn, c, len(FEATURES))
            score = lambda a, b: (math.copysign(max(abs(a) - params.alpha, 0), a) ** 2) / (b + params.lam)

            def grow(rows_in, train, depth, g=g, h=h, score=score, allowed=allowed, c=c, step=step):
                G, H = int(g[train].sum()), int(h[train].sum())
                best = None
                if depth < params.depth:
                    for f in range(len(FEATURES)):
                        if not allowed[f]:
                            continue
                        lost = np.isnan(x[:, f])
                        for t in [*cuts[f], math.inf]:
                            low = x[:, f] <= t
                            for send in (False, True):
                                left = train & (low | (lost & send))
                                GL, HL = int(g[left].sum()), int(h[left].sum())
                                if HL <= 0 or H - HL <= 0 or HL / scale < params.child or (H - HL) / scale < params.child:
                                    continue
                                gain = (score(GL / scale, HL / scale) + score((G - GL) / scale, (H - HL) / scale) - score(G / scale, H / scale)) / 2 - params.gamma
                                if gain > 1e-6 and (best is None or gain > best[0]):
                                    best = (gain, f, t, send)
                if best is None:
                    v = -math.copysign(max(abs(G / scale) - params.alpha, 0), G) / (H / scale + params.lam) * params.rate
                    step[rows_in, c] = v
                    return ("leaf", round(v, 9))
                gain, f, t, send = best
                left = (x[:, f] <= t) | (np.isnan(x[:, f]) & send)
                return (FEATURES[f], t, round(gain, 9), grow(rows_in & left, train & left, depth + 1), grow(rows_in & ~left, train & ~left, depth + 1))

            trees.append(grow(np.ones(len(x), bool), use, 0))
        margins += step
        made.append(trees)
    return made, margins, y, fold


def nested(model, tree, n=0):
    f = tree.feature[n]
    if f < 0:
        return ("leaf", round(tree.value[n], 9))
    t = [*model.cuts[f], math.inf][min(tree.at[n], len(model.cuts[f]))]
    return (model.features[f], t, round(tree.gain[n], 9), nested(model, tree, tree.left[n]), nested(model, tree, tree.left[n] + 1))


def keyed(df):
    return [r.asDict() for r in df.withColumn("key", F.xxhash64("id")).collect()]


def scale_of(df, classes=CLASSES):
    return float(1 << min(36, 57 - df.filter(F.col("label").isin(classes)).count().bit_length()))


@pytest.mark.parametrize(
    "params",
    [Params(rounds=3, depth=3, rate=0.3), Params(rounds=2, depth=2, rate=0.5, rows=0.7, columns=0.6, child=3.0, gamma=0.2, alpha=0.1, lam=2.0, seed=7), Params(rounds=2, depth=4, child=0.0, lam=0.1)],
)
def test_trees_equal_a_plain_version(spark, params):
    df = table(spark)
    model = boosting.fit(df, FEATURES, CLASSES, params, ["id"], fold="fold", out=1, weight="w", bins=16)
    want, *_ = plain(keyed(df), model.cuts, params, scale_of(df), out=1, weighted=True)
    assert [[nested(model, t) for t in r] for r in model.trees] == want
    assert any(t[0] != "leaf" for r in want for t in r)


def test_two_classes_have_one_tree_a_round(spark):
    df, params = table(spark, classes=["a", "b"]), Params(rounds=3, depth=2)
    model = boosting.fit(df, FEATURES, ["a", "b"], params, ["id"], bins=16)
    want, margins, y, _ = plain(keyed(df), model.cuts, params, scale_of(df, ["a", "b"]), classes=["a", "b"])
    assert [[nested(model, t) for t in r] for r in model.trees] == want
    got = df.select("label", model.predicted(*map(F.col, FEATURES)).alias("p")).filter(F.col("label") != "other").collect()
    assert sorted(round(r.p[1], 9) for r in got) == sorted(np.round(1 / (1 + np.exp(-margins[:, 0])), 9))
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in got)


def test_margins_written_out_change_nothing(spark, monkeypatch):
    df, params = table(spark, 150), Params(rounds=5, depth=2, rows=0.8)
    whole = boosting.fit(df, FEATURES, CLASSES, params, ["id"], bins=8).splits()
    monkeypatch.setattr(boosting, "ROUNDS_HELD", 2)
    monkeypatch.setattr(boosting, "CELLS", 1)
    assert boosting.fit(df.repartition(2), FEATURES, CLASSES, params, ["id"], bins=8).splits() == whole


def test_json_round_trip(spark):
    model = boosting.fit(table(spark, 100), FEATURES, CLASSES, Params(rounds=2, depth=2), ["id"], bins=8)
    again = boosting.Boosted.from_json(model.to_json())
    assert again == model


@pytest.mark.parametrize("slack", [2.0, 1e-6])
def test_cuts_are_exact_beyond_the_sketch(spark, slack):
    """on 40,000 rows a sketch alone is some ranks off; brackets that miss a rank (1e-6) are widened."""
    rng = np.random.default_rng(3)
    n = 40_000
    x = np.stack([rng.normal(size=n), rng.normal(size=n).round(1), np.exp(9 * rng.normal(size=n)), np.where(np.arange(n) < 0.6 * n, 0.0, rng.normal(size=n))], 1)
    x[rng.random((n, 4)) < 0.1] = np.nan
    x[:50, 0], x[50:90, 0] = np.inf, -np.inf
    df = spark.createDataFrame(pd.DataFrame(x, columns=FEATURES)).repartition(7).withColumn("f1", F.when(~F.isnan("f1"), F.col("f1")))
    for bins in (16, 30):
        want = []
        for v in (np.sort(c[~np.isnan(c)]) for c in x.T):
            want.append(sorted({float(v[-(-i * len(v) // bins) - 1]) for i in range(1, bins)}))
        assert boosting.quantile_cuts(df, FEATURES, bins, slack) == want


def test_stops_when_the_held_out_loss_rises(spark):
    rng = np.random.default_rng(1)
    noise = spark.createDataFrame([(i, CLASSES[rng.integers(3)], i % 2, *map(float, rng.normal(size=4))) for i in range(120)], "id long, label string, fold int, f0 double, f1 double, f2 double, f3 double")
    table_ = boosting.Table(noise, FEATURES, CLASSES, ["id"], "label", "fold", None, 16)
    t = boosting.Training(Params(rounds=40, depth=3, rate=0.5, child=0.0, patience=3), 0)
    boosting.train(table_, [t])
    best = int(np.argmin(t.losses))
    assert len(t.trees) == best < 40 and len(t.losses) == best + 4
    assert t.losses[0] == pytest.approx(math.log(3), abs=1e-6)


def test_nothing_to_learn(spark):
    df = table(spark, 60)
    for rows in (df.limit(0), df.withColumn("label", F.lit("a")), df.withColumns({f: F.lit(None).cast("double") for f in FEATURES})):
        model = boosting.fit(rows, FEATURES, CLASSES, Params(rounds=2, depth=2), ["id"])
        assert all(len(t.feature) == 1 for r in model.trees for t in r)
    with pytest.raises(ValueError, match="weights"):
        boosting.fit(df.withColumn("w", F.lit(100.0)), FEATURES, CLASSES, Params(rounds=1), ["id"], weight="w")


def _macro(y, p):
    out = []
    for c in sorted({*y} | {*p}):
        tp = sum(a == c == b for a, b in zip(y, p, strict=True))
        out.append(2 * tp / (sum(a == c for a in y) + sum(b == c for b in p)))
    return sum(out) / len(out)


def test_search_equals_one_model_after_the_other(spark):
    df = table(spark, 180)
    draws = [Params(rounds=2, depth=2, rate=0.3), Params(rounds=3, depth=1, rate=0.1, rows=0.7), Params(rounds=1, depth=3, columns=0.5, lam=3.0), Params(rounds=3, depth=2, rate=1.0, gamma=0.5)]
    got = boosting.search(df, FEATURES, CLASSES, draws, [0, 1, 2], ["id"], bins=8)
    cuts = boosting.quantile_cuts(df.filter(F.col("label").isin(CLASSES)), FEATURES, 8)
    rows, scale = keyed(df), scale_of(df)
    for p, score, rounds, complete in got:
        each = []
        for k in (0, 1, 2):
            _, margins, y, fold = plain(rows, cuts, p, scale, out=k)
            each.append(_macro(y[fold == k].tolist(), margins[fold == k].argmax(1).tolist()))
        assert score == pytest.approx(sum(each) / 3, abs=1e-9) and rounds == p.rounds and complete


def test_search_can_give_up_bad_draws(spark):
    df = table(spark, 180)
    draws = [Params(rounds=6, depth=1, rate=1e-9, columns=0.25), Params(rounds=6, depth=3, rate=0.3), Params(rounds=6, depth=2, rate=0.3), Params(rounds=6, depth=1, gamma=1e9)]
    whole = boosting.search(df, FEATURES, CLASSES, draws, [0, 1], ["id"], bins=8)
    some = boosting.search(df, FEATURES, CLASSES, draws, [0, 1], ["id"], bins=8, halve_at=(1, 3))
    assert sorted(s[2] for s in some) == [1, 1, 3, 6]
    left = [i for i in range(4) if some[i][3]]
    assert len(left) == 1 and some[left[0]] == whole[left[0]] and not {0, 3} & {*left}
    assert all(some[i][1] < whole[left[0]][1] for i in (0, 3))
