"""Each pipeline stage on rows with nulls, repeats, ties, empty texts and clashing columns, against a plain version; the whole pipeline on small tables."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, corpus

import corpus_pipeline
from tarn.llm import decontaminate, mixing, pii, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels and a benchmark for the small corpus."""
    at = tmp_path_factory.mktemp("tables")
    long = max((r[1] or "" for r in corpus() if r[0] and r[0] % 12 == 0), key=len).split()
    spark.createDataFrame([(1, " ".join(long[10:40])), (2, None), (3, "of three words")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(r[0], i % 2, i % 3 == 0) for i, r in enumerate(corpus()) if r[0] is not None], "doc_id long, quality int, t boolean").select("doc_id", "quality", F.col("t").cast("int").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_every_stage_keeps_columns_and_survives_empty_tables(spark, docs, empty, tables):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        want = [*docs.columns, "copy"] if i + 1 == len(corpus_pipeline.STAGES) else docs.columns
        assert out.columns == want, name
        assert stage(spark, empty, tables).collect() == [], name
        extra = stage(spark, docs.withColumns({"mark": F.lit(1), "copy": F.lit(2), "_text": F.lit("t"), "cls": F.lit(None).cast("string")}), tables)
        assert extra.columns[: len(docs.columns) + 4] == [*docs.columns, "mark", "copy", "_text", "cls"], name
        assert extra.count() == out.count(), name


def test_toxicity_stage(spark, docs, tables):
    scores = {r.doc_id: r.predicted for r in toxicity.digest(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    out = corpus_pipeline.STAGES[0][1](spark, docs, tables)
    assert rows_of(out) == collections.Counter(tuple(r) for r in corpus() if not scores[r[0]]) and 0 < out.count()


def test_benchmark_stage(spark, docs, tables):
    windows = set()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    clean = lambda t: not any(tuple(words(t)[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(words(t)) - n + 1))
    out = rows_of(corpus_pipeline.STAGES[2][1](spark, docs, tables))
    assert out == collections.Counter(tuple(r) for r in corpus() if clean(r[1])) and sum(out.values()) < len(corpus())
    assert rows_of(decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string"))) == collections.Counter(map(tuple, corpus()))


def test_mask_stage(spark, tables):
    rows = [(1, "a@b.cc and 10.0.0.1", "en", "a", 19, 1, "x"), (1, "a@b.cc and 10.0.0.1", "en", "a", 19, 1, "x"), (None, None, None, None, None, None, None), (3, "", "en", "a", 0, 7, "y"), (4, "plain " * 50, "en", "b", 300, 7, "z")]
    out = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(rows, SCHEMA), tables)
    masked = lambda r: (r[0], "<email> and <ip>", *r[2:4], 16, *r[5:]) if r[0] == 1 else r
    assert rows_of(out) == collections.Counter(map(masked, rows)) and pii._masked("1.2.3.4", []) == "<ip>"


def test_mixing_stage_emits_what_was_decided(spark, docs, tables):
    decided = collections.Counter()
    for r in mixing.copies(mixing._light(docs)).collect():
        decided[r.doc_id, r.source, r.size] += r["copies"]
    got = collections.Counter()
    for r in corpus_pipeline.STAGES[4][1](spark, docs, tables).collect():
        got[r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))] += 1
        assert r.copy in (1, 2)
    assert got == +decided


def test_words_taken_are_near_the_target_of_small_sources(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice((5, 30, 60, 90, 200, 400, 3000 if i % 40 == 0 else 50)), f"s{i % 5}") for i in range(200)]
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        source = f"s{r.doc_id % 5}"
        taken[source] += r.taken
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.03 * target[s] for s in target), (taken, target)


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "copy"]
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    assert rows_of(step) == rows_of(out) and len(kept) > 0.5 * docs.count()
