"""Training and prediction on pose features: boosted trees of this library (``boosting``), forests and perceptrons of Spark's.

Each fit is distributed; the folds of an evaluation, and the draws of a search, are fitted several at a time. Medians and scales come from training rows alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import boosting
from tarn.operators.relational import medians
from tarn.session import cut

LEARNERS = ("boosted", "forest", "perceptron")


def learner(kind: str, width: int, classes: int, weighted: bool = False, **p):
    """ML-05, ML-06: a forest or a perceptron."""
    cols = {"featuresCol": "_v", "labelCol": "_y", "predictionCol": "_p"}
    if kind == "forest":
        return RandomForestClassifier(numTrees=p.get("trees", 50), maxDepth=p.get("depth", 6), seed=42, rawPredictionCol="_raw", probabilityCol="_prob", **cols, **({"weightCol": "_w"} if weighted else {}))
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(layers=[width, *p.get("hidden", (64, 32)), classes], maxIter=p.get("rounds", 60), seed=42, rawPredictionCol="_raw", probabilityCol="_prob", **cols)
    raise ValueError(f"unknown learner {kind!r}; one of {LEARNERS}")


class Fitted:
    """A model with what it takes to apply it: features in order, class names, medians and scales (ML-01, 02, 09, 10; SNK-08)."""

    def __init__(self, model: PipelineModel, features: list[str], classes: list[str], medians: dict, scales: dict):
        self.model, self.features, self.classes, self.medians, self.scales = model, features, classes, medians, scales

    def prepared(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.features:
            m, s = self.scales[c]
            out[f"_f_{c}"] = (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(self.medians[c])) - m) / (s or 1.0)
        return df.withColumns(out)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``label_pred``, ``probs`` (class name to probability) and ``confidence``. Ties go to the earlier class."""
        names = F.array(*map(F.lit, self.classes))
        if isinstance(self.model, boosting.Boosted):
            out = self.prepared(df)
            out = out.withColumn("_q", self.model.predicted(*(F.col(f"_f_{c}") for c in self.features)))
            best = F.array_position("_q", F.array_max("_q")).cast("int")
        else:
            out = self.model.transform(self.prepared(df))
            out = out.withColumn("_q", F.slice(vector_to_array("_prob"), 1, len(self.classes)))
            best = (F.col("_p") + 1).cast("int")
        return out.select(*df.columns, F.element_at(names, best).alias("label_pred"), F.map_from_arrays(names, "_q").alias("probs"), F.array_max("_q").alias("confidence"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        trees = self.model.to_json() if isinstance(self.model, boosting.Boosted) else None
        if trees is None:
            self.model.write().overwrite().save(f"{path}/model")
        meta = json.dumps({"features": self.features, "classes": self.classes, "medians": self.medians, "scales": self.scales, "trees": trees})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark, path: str) -> Fitted:
        m = json.loads(spark.read.text(f"{path}/metadata").first().value)
        model = boosting.Boosted.from_json(m["trees"]) if m.get("trees") else PipelineModel.load(f"{path}/model")
        return cls(model, m["features"], m["classes"], m["medians"], {k: tuple(v) for k, v in m["scales"].items()})


def fit(train: DataFrame, features: list[str], classes: list[str], kind: str, weights: dict[str, float] | None = None, key: str = "capture_id", **params) -> Fitted:
    """ML-09. Rows whose label is not in ``classes`` are left out. A feature that is NULL in all rows is dropped. Weights are by class (SPL-09). For boosted trees ``params`` are those of ``boosting.Params``, and ``key`` names the rows that are drawn together."""
    own = [c for c in (key, "fold") if c in train.columns and c not in features]
    # what is scanned several times is computed once
    train = cut(train.filter(F.col("label").isin(classes)).select("label", *own, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features)))
    found = medians(train, features)
    features = [c for c in features if found[c] is not None]
    if not features:
        raise ValueError("no feature has a value in the training rows")
    found = {c: found[c] for c in features}
    filled = [F.coalesce(F.col(c), F.lit(found[c])) for c in features]
    st = train.agg(*(F.avg(x).alias(f"a_{c}") for c, x in zip(features, filled, strict=True)), *(F.stddev_pop(x).alias(f"s_{c}") for c, x in zip(features, filled, strict=True))).first()
    made = Fitted(None, features, list(classes), found, {c: (float(st[f"a_{c}"]), float(st[f"s_{c}"])) for c in features})
    w = F.coalesce(*(F.when(F.col("label") == n, float(v)) for n, v in (weights or {}).items()), F.lit(1.0))
    ready = made.prepared(train)
    if kind == "boosted":
        named = ready.select(F.col(key), "label", w.alias("_w"), *(F.col(f"_f_{c}") for c in features))
        made.model = boosting.fit(named, [f"_f_{c}" for c in features], list(classes), boosting.Params(**params), [key], weight="_w")
        made.model.features = list(features)
        return made
    y = F.coalesce(*(F.when(F.col("label") == n, float(i)) for i, n in enumerate(classes)))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_v"), learner(kind, len(features), len(classes), bool(weights), **params)])
    made.model = pipe.fit(ready.withColumns({"_y": y, "_w": w}))
    return made


def at_once(tasks: list[Callable], threads: int = 4) -> list:
    """Results of independent fits, several of them on the cluster at a time, in order."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda f: f(), tasks))


def out_of_fold(df: DataFrame, features: list[str], classes: list[str], kind: str, folds: list[int], **params) -> DataFrame:
    """ML-08: each row predicted by the model that didn't see its fold, in one schema for all learners: ``model``, ``fold``, ``label_true``, ``label_pred``, ``probs``, ``confidence``."""
    fits = at_once([lambda k=k: fit(df.filter(F.col("fold") != k), features, classes, kind, **params) for k in folds])
    parts = [m.predict(df.filter(F.col("fold") == k)) for k, m in zip(folds, fits, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("capture_id", F.lit(kind).alias("model"), "fold", F.col("label").alias("label_true"), "label_pred", "probs", "confidence")


def draws(space: dict[str, list], n: int, seed: int = 42) -> Iterator[dict]:
    """Seeded draws from a grid, without repeats (at most all of it)."""
    import random
    from math import prod

    rng, seen = random.Random(seed), set()
    while len(seen) < min(n, prod(map(len, space.values()))):
        pick = tuple(rng.randrange(len(v)) for v in space.values())
        if pick not in seen:
            seen.add(pick)
            yield {k: v[i] for (k, v), i in zip(space.items(), pick, strict=True)}


def search(df: DataFrame, features: list[str], classes: list[str], kind: str, space: dict[str, list], n: int, folds: list[int], halve_at: tuple[int, ...] = ()) -> tuple[dict, float]:
    """ML-07: the draw with the best mean macro F1 over grouped inner folds (ties: the first). Boosted draws are trained in the same passes (``boosting.search``; values that are missing stay missing), those of other learners several at a time over one cached table."""
    from tarn.operators.evaluate import summary

    picks = list(draws(space, n))
    if kind == "boosted":
        found = boosting.search(df, features, classes, [boosting.Params(**p) for p in picks], folds, ["capture_id"], halve_at=halve_at)
        scores = [s if whole else -1.0 for _, s, _, whole in found]
    else:
        rows = df.select("capture_id", "fold", "label", *features).cache()

        def score(params: dict) -> float:
            oof = out_of_fold(rows, features, classes, kind, folds, **params)
            found = summary(oof.select("fold", F.col("label_true").alias("y"), F.col("label_pred").alias("p")), "fold").agg(F.avg("macro_f1")).first()[0]
            return -1.0 if found is None else float(found)

        scores = at_once([lambda p=p: score(p) for p in picks])
        rows.unpersist()
    best = max(range(len(picks)), key=lambda i: (scores[i], -i))
    return picks[best], scores[best]
