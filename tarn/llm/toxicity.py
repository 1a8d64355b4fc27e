"""Toxicity by a counterfactually regularised classifier (operator 7).

A logistic model over which words (letters and digits, A-Z lowered) and which runs of GRAM bytes within words a text has, not how often; identity terms
have no runs, so that a swap of a term changes its word feature alone. Besides the log loss and a ridge, training penalises score changes
under counterfactuals: in each labelled text with identity terms, every such term is swapped, one at a time, for the others of its group, and the squared
difference of the logits of the swapped text and the text is added (a partner that the text has already counts once, as in any text). Terms of one group are pulled to one weight, so that naming a group neutrally doesn't move
the score. The bound of the training sample, ``sample`` labelled rows in order of a hash of doc_id, is a parameter; its texts are
used whole, and so is every text that is scored. Features are counted and chosen on the executors; only the ``vocabulary`` chosen reach the driver.
Scoring needs no shuffle.

Nulls: null or empty text is scored by the intercept alone. Labels that are null, or whose document is missing, are not learned from; a document with
several labels counts as toxic if any says so. A null doc_id is scored, never learned from. Without labels, or with labels of one kind only, every score is
that kind's (0 without any). Repeated rows get equal scores. Other columns are never read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._spark import by_text, cut
from tarn.llm._words import ALNUM, LOWER, ngrams, word_chunks

SAMPLE = 12_000
VOCABULARY = 4_096
GRAM = 6
THRESHOLD = 0.3

# Identity terms, by groups within which they are swapped.
IDENTITY = (
    ("he", "she", "they"),
    ("him", "her", "them"),
    ("man", "woman", "person"),
    ("men", "women", "people"),
    ("boy", "girl", "child"),
    ("male", "female", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled", "able"),
    ("mann", "frau"),
    ("homme", "femme"),
    ("hombre", "mujer"),
)


def word_ids(words: list[str]) -> np.ndarray:
    out = []
    for _, _, w in word_chunks(pa.array(words, pa.string()), ALNUM, LOWER):
        out.append((w.hash >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def swaps() -> dict[int, list[int]]:
    """For each identity term's id, the ids it is swapped for."""
    out: dict[int, list[int]] = {}
    for group in IDENTITY:
        ids = word_ids(list(group)).tolist()
        for i in ids:
            out[i] = out.get(i, []) + [j for j in ids if j != i]
    return out


@functools.cache
def _terms() -> np.ndarray:
    return np.array(sorted(swaps()), np.uint32)


def _ids(words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature id) of every word and every run of GRAM bytes within a word that is no identity term, repeats included."""
    inside = np.zeros(len(words.data), bool)
    number = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(number, words.start, 1)
    number = np.cumsum(number[:-1])
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start] += 1
    np.add.at(edge, words.end, -1)
    inside = np.cumsum(edge[:-1]) > 0
    h = ngrams(LOWER[words.data].astype(np.uint64) + np.uint64(1), GRAM)
    at = np.flatnonzero(inside[: len(h)] & inside[GRAM - 1 :][: len(h)] & (number[: len(h)] == number[GRAM - 1 :][: len(h)])) if len(h) else np.zeros(0, np.int64)
    ids = (words.hash >> np.uint64(32)).astype(np.uint32)
    if len(at):
        at = at[~np.isin(ids, _terms())[number[at] - 1]]
    doc = np.concatenate([words.doc, words.doc[number[at] - 1] if len(at) else words.doc[:0]])
    return doc, np.concatenate([ids, (h[at] >> np.uint64(32)).astype(np.uint32)])


def _distinct(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((doc.astype(np.uint64) << np.uint64(32)) | ids)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64((1 << 32) - 1)).astype(np.uint32)


class Model:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[ids >> np.uint32(12)] = True

    def known(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of a feature), each once."""
        doc, ids = _ids(words)
        some = self.maybe[ids >> np.uint32(12)]
        doc, ids = _distinct(doc[some], ids[some])
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        hit = self.ids[at] == ids
        return doc[hit], at[hit]

    def logits(self, words) -> np.ndarray:
        n = len(words.offsets) - 1
        out = np.full(n, self.bias)
        if len(self.ids) and len(words.hash):
            doc, at = self.known(words)
            out += np.bincount(doc, self.weights[at], n)
        return out

    def scores(self, words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(words), -60, 60)))


def train(rows: list[np.ndarray], y: np.ndarray, ridge: float = 2e-4, fairness: float = 1.0, vocabulary: int = VOCABULARY, least: int = 5, rounds: int = 250) -> Model:
    """Rows hold the distinct word ids of each labelled text."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint32), np.zeros(0), 60.0 if len(y) and y[0] else -60.0)
    n = len(y)
    flat = np.concatenate([*rows, np.zeros(0, np.uint32)])
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    ids, col = np.unique(flat, return_inverse=True)
    df, hit = np.bincount(col, minlength=len(ids)), np.bincount(col, y[row], len(ids))
    rate = y.mean()
    score = (hit - df * rate) ** 2 / (df * rate * (1 - rate) + 1e-9)
    swap = swaps()
    named = np.isin(ids, np.array(list(swap), np.uint32))
    keep = np.flatnonzero((df >= least) | named)
    keep = np.sort(keep[np.lexsort((ids[keep], -score[keep] - 1e9 * named[keep]))][:vocabulary])
    # terms of a group that no text has still get a place, so that they share the group's weight
    extra = np.setdiff1d(np.array([j for i in ids[keep] if int(i) in swap for j in swap[int(i)]], np.uint32), ids[keep])
    place = np.full(len(ids), -1)
    place[keep] = np.arange(len(keep))
    c = place[col]
    row, col = row[c >= 0], c[c >= 0]
    names = np.concatenate([ids[keep], extra])
    where = {int(x): i for i, x in enumerate(names)}
    # counterfactuals, for each text, term and partner: logit(swapped) - logit(text) = w[to] - w[from], or -w[from] where the text has the partner already
    terms = np.flatnonzero(np.isin(names, _terms()))
    has = np.zeros((n, len(terms)))
    spot = np.full(len(names), -1)
    spot[terms] = np.arange(len(terms))
    named = spot[col] >= 0
    has[row[named], spot[col[named]]] = 1
    both = has.T @ has
    pair_rows = [(where[i], where[j], both[x, x] - both[x, y], both[x, y]) for i in map(int, names[terms]) for x in [spot[where[i]]] for j in swap[i] if j in where for y in [spot[where[j]]]]
    a, b = (np.array([p[k] for p in pair_rows], np.int64) for k in range(2))
    times, lone = (np.array([p[k] for p in pair_rows], float) / max(1, n) for k in (2, 3))
    w, bias, m = np.zeros(len(names)), float(np.log(rate / (1 - rate))), len(names)
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + bias, -60, 60)))
        gap = (p - y) / n
        g = np.bincount(col, gap[row], m) + ridge * w
        if len(a):
            pull = 2 * fairness * times * (w[b] - w[a])
            g += np.bincount(b, pull, m) - np.bincount(a, pull - 2 * fairness * lone * w[a], m)
        g = np.append(g, gap.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) * (1 - step / (rounds + 1))
        w -= move[:-1]
        bias -= move[-1]
    order = np.argsort(names)
    return Model(names[order], w[order], float(bias))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, fold: int | None = 2, vocabulary: int = VOCABULARY) -> Model:
    """Learn from at most ``sample`` labelled documents outside the fold (crc32 of doc_id as text, mod 4)."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null")
    if fold is not None:
        known = known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != fold)
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("id"), F.lit("toxicity")), "id").limit(sample)
    known = F.broadcast(known)  # at most ``sample`` rows of 16 bytes
    body = docs.select(F.col(doc_id).cast("string").alias("id2"), F.col(text).alias("body"))
    chosen = cut(body.join(known, F.col("id2") == F.col("id").cast("string")).select(F.col("id2").alias("id"), "y", "body"))
    size = chosen.agg(F.count("*").alias("n"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("rate")).first()

    def count(batches):
        ids, hits = [np.zeros(0, np.uint32)], [np.zeros(0)]
        for batch in batches:
            y = batch.column("y").to_numpy()
            for i, _, words in word_chunks(batch.column("body"), ALNUM, LOWER):
                doc, own = _distinct(*_ids(words))
                kinds, which, times = np.unique(np.concatenate([ids[0], own]), return_inverse=True, return_counts=True)
                total = np.bincount(which, np.concatenate([hits[0], y[i + doc]]), len(kinds))
                times = times.astype(np.int64)
                times[np.searchsorted(kinds, ids[0])] += seen - 1 if len(ids[0]) else 0
                ids, hits, seen = [kinds], [total], times
        if len(ids[0]):
            for k in range(0, len(ids[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (ids[0].astype(np.int64), seen, hits[0])], ["f", "df", "hit"])

    if not size.n or size.rate in (0.0, 1.0):
        return train([np.zeros(0, np.uint32)] * size.n, np.full(size.n, size.rate))
    counted = chosen.mapInArrow(count, "f bigint, df bigint, hit double").groupBy("f").agg(F.sum("df").alias("df"), F.sum("hit").alias("hit"))
    terms = np.array(sorted(swaps()), np.uint32)
    named = F.col("f").isin([int(x) for x in terms])
    gain = F.pow(F.col("hit") - F.col("df") * size.rate, F.lit(2.0)) / (F.col("df") * F.lit(size.rate * (1 - size.rate)))
    best = counted.filter((F.col("df") >= 5) | named).orderBy(named.desc(), gain.desc(), "f").limit(vocabulary).select("f").collect()
    probe = Model(np.array(sorted(r.f for r in best), np.uint32), np.zeros(len(best)), 0.0)

    def features(batches):
        for batch in batches:
            for i, j, words in word_chunks(batch.column("body"), ALNUM, LOWER):
                doc, place = probe.known(words) if len(probe.ids) else (np.zeros(0, np.int64),) * 2
                at = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("y").slice(i, j - i), pa.array([probe.ids[place[at[d] : at[d + 1]]].tobytes() for d in range(j - i)], pa.binary())], ["id", "y", "words"])

    # rows come in the order of ids, so that reruns learn the same model
    table = chosen.mapInArrow(features, "id string, y double, words binary").toArrow().sort_by("id")
    return train([np.frombuffer(x, np.uint32) for x in table.column("words").to_pylist()], np.array(table.column("y").to_pylist(), float).clip(0, 1), vocabulary=vocabulary)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of each document."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            for i, j, words in word_chunks(batch.column("body"), ALNUM, LOWER):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(model.scores(words))], [*names, name])

    return by_text(docs, keep, text, run, f"`{name}` double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = score(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return score(docs, fit(docs, labels), docs.columns, name=name).filter(F.col(f"`{name}`") < threshold).select(*docs.columns)
