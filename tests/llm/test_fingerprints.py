"""The fingerprint query, all columns, against a plain version without vectors."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import corpus

from tarn.llm import winnowing

LEAST = -(1 << 63)


def plain_fingerprint(text):
    """Hashes by the module's k-gram hash, windows by a loop."""
    if not text:
        return []
    codes = [ord(c) for c in text]
    folded = np.array([(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c) + 1 for c in codes], np.uint64)
    gram = min(winnowing.GRAM, len(folded))
    hashes = [int(winnowing.ngrams(folded[i : i + gram], gram)[0]) >> 32 for i in range(len(folded) - gram + 1)]
    window, out = min(winnowing.WINDOW, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        best = min(range(i, i + window), key=lambda j: (hashes[j], -j))
        if not out or out[-1][1] != best:
            out.append((hashes[best], best))
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_all_columns(spark, docs, partitions):
    odd = docs.withColumn("part", F.lit(1)).withColumn("o", F.lit("x")).withColumn("edge", F.lit(True))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = winnowing.digest(odd).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = [((LEAST if r[0] is None else r[0]), r[1] or "") for r in corpus()]
    twice = {k for k, n in collections.Counter(k for k, _ in rows).items() if n > 1}
    rows.sort(key=lambda r: -r[0])
    have = collections.defaultdict(list)
    for r in got:
        have[LEAST if r.doc_id is None else r.doc_id].append(r)
    assert sum(map(len, have.values())) == len(rows)
    marks = {t: plain_fingerprint(t) for _, t in rows}
    hexed = lambda f: "".join(f"{h:08x}" for h, _ in f)
    for i, (k, t) in enumerate(rows):
        nexts = [n for j, n in ((j, rows[j % len(rows)][1]) for j in range(i + 1, i + 2))]
        for r in have[k]:
            assert r.n_chars == len(t) and r.fingerprint == hexed(marks[t]) and r.positions == [p for _, p in marks[t]]
        if k in twice or rows[(i + 1) % len(rows)][0] in twice:
            continue
        (r,), third = have[k], len(t) // 3
        edited = t[: len(t) - third] + nexts[0][:third]
        mark = plain_fingerprint(edited)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.edited_fingerprint == hexed(mark)
        assert abs(r.near_edited - likeness(marks[t], mark)) < 1e-12 and abs(r.near_next - likeness(marks[t], marks[nexts[0]])) < 1e-12


def test_plan_does_not_grow_with_partitions(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sizes = []
    try:
        for n in (2, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
            sizes.append(winnowing.with_next(many)._jdf.queryExecution().analyzed().treeString().count("\n"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes[0] == sizes[1]
