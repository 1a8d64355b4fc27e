"""Sequential splits against plain loops; augmentation by its invariants."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.operators import folds, relational
from tarn.plans import catalog

SF = "/root/testdata/sf0.001"
md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


@pytest.mark.parametrize("sizes", [{f"g{i}": (i * 7) % 13 + 1 for i in range(60)} | {"huge": 900}, {f"g{i}": 1 for i in range(300)} | {f"h{i}": 40 for i in range(5)} | {"none": 0, "nil": 0}, {f"g{i}": 3 for i in range(7)}])
def test_greedy_split(spark, sizes):
    total = sum(sizes.values())
    df = spark.createDataFrame(list(sizes.items()), "grp string, n long").repartition(5)
    got = {r.grp: r.split for r in folds.greedy_split(df, "grp", "n", total).collect()}
    room = {"train": int(total * 0.7), "valid": int(total * 0.15)}
    room["test"] = total - sum(room.values())
    for g in sorted(sizes, key=lambda g: (-sizes[g], md5(f"split:{g}"))):
        left = {s: max(0, v) for s, v in room.items()}
        want = "train" if not any(left.values()) else max(left, key=left.get)
        assert got[g] == want
        room[want] -= sizes[g]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-20, 60), min_size=3, max_size=3), st.integers(0, 9), st.integers(1, 80))
def test_stretches_of_equal_groups(room, size, count):
    left, want = list(room), []
    for _ in range(count):
        want.append(max(range(3), key=lambda k: (max(0, left[k]), -k)))
        left[want[-1]] -= size
    got = folds.filled(room, size, count)
    assert [p[i % len(p)] for _, n, p in got for i in range(n)] == want and [s for s, *_ in got] == [sum(n for _, n, _ in got[:i]) for i in range(len(got))]
    assert room == left and len(got) <= 40


@given(st.lists(st.integers(0, 2), max_size=40))
def test_repeated_picks(picks):
    assert [p[i % len(p)] for _, n, p in folds.repeated(picks, 3) for i in range(n)] == picks


@pytest.mark.parametrize("kind", ["mixed", "alike", "single"])
def test_stratified_folds(spark, kind):
    """Groups that differ, runs of equal ones after an uneven beginning, and one class only."""
    rng = np.random.default_rng(3)
    if kind == "mixed":
        rows = [(f"s{g}", c) for g in range(30) for c in rng.choice(["a", "b", "c"], rng.integers(1, 30), p=[0.6, 0.3, 0.1]).tolist()]
    elif kind == "alike":
        rows = [(f"s{g}", c) for g in range(90) for c in ("aab", "ab", "abbbc")[g % 3]] + [("big", "a")] * 25 + [("other", "zz"), ("none", None)]
    else:
        rows = [(f"s{g}", "a") for g in range(41)]
    got = {r.grp: r.fold for r in folds.stratified_folds(spark.createDataFrame(rows, "grp string, y string").repartition(6), "grp", "y", ["a", "b", "c"]).collect()}
    counts = {g: np.array([sum(1 for h, y in rows if h == g and y == c) for c in "abc"], float) for g in {g for g, _ in rows}}
    whole, held = np.maximum(sum(counts.values()), 1), np.zeros((5, 3))
    for g in sorted(counts, key=lambda g: (-round(float(counts[g].std()), 9), *(-counts[g]), md5(f"42:{g}"))):
        costs = []
        for f in range(5):
            h = held.copy()
            h[f] += counts[g]
            costs.append((round(float((h / whole).std(axis=0).mean()), 12), h[f].sum(), f))
        assert got[g] == min(costs)[2]
        held[min(costs)[2]] += counts[g]


def test_only_kinds_pass_one_task(spark, monkeypatch):
    """1,000 groups of three kinds: three rows reach the task that decides."""
    rows = spark.range(1000).selectExpr("id AS grp", "explode(sequence(0, int(id % 3))) AS i").selectExpr("grp", "if(i % 2 = 0, 'a', 'b') AS y")
    seen, made = [], folds.dealt
    monkeypatch.setattr(folds, "dealt", lambda held, whole, row, count: seen.append(count) or made(held, whole, row, count))
    held = np.zeros((5, 2))
    for kind in folds._stretches([pd.DataFrame({"_s": [0.5, 0.5, 0.0], "n0": [2, 1, 1], "n1": [1, 0, 1], "_count": [333, 334, 333]})], ["_s", "n0", "n1"], lambda v, c: folds.dealt(held, np.array([1333, 666]), np.array(v[1:], float), c)):
        assert sum(map(len, kind._runs)) < 20
    assert seen == [333, 334, 333]
    sizes = [r.n for r in folds.stratified_folds(rows, "grp", "y", ["a", "b"]).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) - min(sizes) <= 2


def test_running_sums(spark):
    df = spark.range(500).selectExpr("id % 50 AS a", "id AS b", "id % 7 AS v").repartition(9)
    got = relational.in_order(df, F.desc("a"), "b", parts=7, total="v").collect()
    want, before = [], 0
    for i, (a, b, v) in enumerate(sorted(((r.a, r.b, r.v) for r in got), key=lambda r: (-r[0], r[1]))):
        want.append((a, b, v, i, before))
        before += v
    assert sorted((r.a, r.b, r.v, r["_at"], r.total) for r in got) == sorted(want) and len({r["_part"] for r in got}) > 1


def test_empty_groups(spark):
    assert folds.greedy_split(spark.createDataFrame([], "grp string, n long"), "grp", "n", 0).collect() == []
    assert folds.stratified_folds(spark.createDataFrame([], "grp string, y string"), "grp", "y", ["a"]).collect() == []
    assert relational.groups_in_order(spark.createDataFrame([], "grp string, n long"), "grp", "n", 0).collect() == []
    assert relational.numbered_groups(spark.createDataFrame([], "grp string"), "grp").collect() == []


def test_augment(spark):
    before = catalog.queries()["augmented_rows"](spark, SF).filter("key not like 'aug%'").count()
    rows = catalog.queries()["augmented_rows"](spark, SF).filter("key like 'aug%'").collect()
    again = catalog.queries()["augmented_rows"](spark, SF).filter("key like 'aug%'").collect()
    assert sorted(rows) == sorted(again) and len(rows) == 80 and {r.label for r in rows} == {1, 2}
    own = spark.read.parquet(f"{SF}/supplier.parquet").toPandas()
    assert before == len(own)
    for r in rows:
        x = own[own.s_nationkey % 3 == r.label].s_acctbal
        slack = 6 * 0.015 * x.std(ddof=0)
        assert x.min() - slack <= r.f1 <= x.max() + slack
