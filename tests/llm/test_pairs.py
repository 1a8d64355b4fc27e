"""Near-duplicate pairs: whole results against brute force, recall at size, and what keep_one keeps."""

import collections
import random

import pytest

from tarn.llm import ngram_join


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_recall_by_likeness(spark):
    """Pairs planted at likeness 0.8 to 1 among 3,000 texts; found links are held against brute force over an inverted index."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(1500):
        base = rng.choices(words, k=rng.randrange(40, 300))
        other = list(base)
        for _ in range(rng.randrange(0, max(1, len(base) // 45) + 1)):
            other[rng.randrange(len(other))] = rng.choice(words)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    sets = [shingle_set(t) for _, t in rows]
    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    shared = collections.Counter()
    for x in index.values():
        for j in range(1, len(x)):
            for i in range(j):
                shared[x[i], x[j]] += 1
    links = {p: n / len(sets[p[0]] | sets[p[1]]) for p, n in shared.items() if n >= 0.8 * len(sets[p[0]] | sets[p[1]]) and rows[p[0]][1] != rows[p[1]][1]}
    got = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = collections.Counter()
    total = collections.Counter()
    for (i, j), x in links.items():
        band = int(x * 20) / 20
        total[band] += 1
        found[band] += got[rows[i][0]].n_links > 0 and got[rows[i][0]].class_id == got[rows[j][0]].class_id
    assert sum(total.values()) > 500 and total[0.8] > 50
    assert all(found[b] >= 0.95 * total[b] for b in total), (found, total)
    of = collections.Counter(i for p in links for i in p)
    wrong = [k for k, r in got.items() if r.n_links > of[k]]
    assert not wrong


def test_a_chain_of_buckets_joins_nothing(spark):
    """Texts that are alike in steps: each is linked with its neighbours alone, whatever the blocks."""
    rng = random.Random(5)
    text = [f"a{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(text)))
        text[rng.randrange(100)] = f"n{i}"
    sets = [shingle_set(t) for _, t in rows]
    want = [sum(i != j and rows[i][1] != rows[j][1] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(40)) for i in range(40)]
    for block in (8 << 20, 1500):
        got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block).collect()}
        assert all(0 <= want[i] - got[i] <= 1 for i in range(40)) and sum(got.values()) >= 0.95 * sum(want)


@pytest.mark.parametrize("clash", [False, True])
def test_keep_one_loses_no_text(spark, clash):
    a, b, c, d, e = ("".join(rng.choices("abcdefgh ", k=400)) for rng in map(random.Random, range(5)))
    near = c + " more"
    rows = [(3, b), (5, a), (5, b), (7, a), (9, a), (9, c), (11, near), (12, d), (12, e), (None, e), (None, "alone " * 3), (None, "alone " * 3), (14, None), (14, None), (15, "")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], f"doc_id long, text string, {'mark' if clash else 'n'} int, {'cls' if clash else 's'} string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter({(3, b): 1, (5, a): 1, (9, c): 1, (12, d): 1, (12, e): 1, (None, "alone " * 3): 1, (14, None): 2, (15, ""): 1})


def test_hot_copies_and_empty_tables(spark):
    rows = [(i, "one two three four five six seven") for i in range(3000)] + [(5000 + i, f"text number {i} of its own kind {i * 7}") for i in range(50)] + [(9000 + i, None) for i in range(500)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert (got.loc[:2999, "class_id"] == 0).all() and (got.loc[:2999, "n_linked_docs"] == 2999).all() and (got.loc[9000:, "n_links"] == 0).all() and len(got) == len(rows)
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
