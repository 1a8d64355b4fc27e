"""Substring deduplication of rows that share a doc_id, or have none: one place in the order, spread over groups."""

import collections
import random

import pytest

from tarn.llm import substrings


@pytest.mark.parametrize("groups", [1, 1 << 21])
def test_one_id_in_most_rows(spark, monkeypatch, groups):
    monkeypatch.setattr(substrings, "GROUP_BYTES", groups)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=40)
    rows = []
    for i in range(90):
        w = rng.choices(words, k=rng.randrange(60))
        at = rng.randrange(len(w) + 1)
        w[at:at] = passage[rng.randrange(15) :]
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(w)))
    rows += [(7, rows[1][1]), (None, rows[0][1]), (7, None)]
    first, least = {}, -(1 << 63)
    split = [((least if k is None else k), (t or "").split()) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            first[g] = min(first.get(g, (k, i)), (k, i))
    want = collections.Counter()
    for (k, w), (key, _) in zip(split, rows):
        gone = {p for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (k, i) for p in range(i, i + 20)}
        want[key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert collections.Counter(map(tuple, got.collect())) == want
