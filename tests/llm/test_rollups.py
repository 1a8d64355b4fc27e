"""The rollup store: idempotent batches, and what readers see if a writer stops between any two steps."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import token_counts
from tarn.llm.token_counts import Rollup, inserts, revisions

SCHEMA = "source string, lang string, n long"
ROWS = [("a", "en", 3), ("a", "en", 4), (None, None, 1)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return Rollup(spark, f"file://{tmp_path}/r")


def totals(store):
    return {(r.source, r.docs, r.tokens) for r in store.totals().collect()}


def test_batches_count_once(store, rows):
    assert totals(store) == set()
    assert store.commit("one", inserts(rows, "t", "n")) and not store.commit("one", inserts(rows, "t", "n"))
    store.commit("two", inserts(rows.filter("n = 3"), "t", "n", -1))
    store.commit("three", revisions(rows.filter("n = 4"), "t", "n", F.lit(9)))
    want = {("a", 1, 9), (None, 1, 1)}
    assert totals(store) == want
    assert store.compact() and totals(store) == want and not store.compact()
    assert not store.commit("two", inserts(rows, "t", "n")) and totals(store) == want
    assert store.commit("empty", inserts(rows.limit(0), "t", "n")) and totals(store) == want and store.committed() == {"one", "two", "three", "empty"}
    assert store.commit("any id: it's only a name", inserts(rows.limit(0), "t", "n"))


class Stopped(Exception):
    pass


def stopping(monkeypatch, method):
    def stop(*_):
        raise Stopped

    monkeypatch.setattr(Rollup, method, stop)


def test_stop_before_and_after_each_step_of_a_commit(store, rows, monkeypatch):
    store.commit("one", inserts(rows, "t", "n"))
    before = totals(store)
    for method in ("_write", "_append"):  # nothing written; written, but not in the log
        with monkeypatch.context() as m:
            stopping(m, method)
            with pytest.raises(Stopped):
                store.commit("two", inserts(rows, "t", "n"))
        assert totals(store) == before and store.committed() == {"one"}
    assert store.commit("two", inserts(rows, "t", "n"))
    assert totals(store) == {("a", 4, 14), (None, 2, 2)}
    assert store.vacuum() == 1 and totals(store) == {("a", 4, 14), (None, 2, 2)}  # what the second stop left behind


def test_stop_in_compact_and_vacuum(store, rows, monkeypatch):
    for name in ("one", "two", "three"):
        store.commit(name, inserts(rows, "t", "n"))
    want = {("a", 6, 21), (None, 3, 3)}
    for method in ("_write", "_append"):
        with monkeypatch.context() as m:
            stopping(m, method)
            with pytest.raises(Stopped):
                store.compact()
        assert totals(store) == want
    early = store.totals()  # a reader that began before the fold
    assert store.compact() and totals(store) == want
    assert {(r.source, r.docs, r.tokens) for r in early.collect()} == want
    store.commit("four", inserts(rows, "t", "n"))
    store.compact()
    want = {("a", 8, 28), (None, 4, 4)}
    assert totals(store) == want  # two folds, with every folder they replaced still there
    assert store.vacuum() == 6 and totals(store) == want and store.vacuum() == 0


def test_two_writers(spark, store, rows, monkeypatch):
    """Another writer takes the number between a writer's look at the log and its entry."""
    other, real = Rollup(spark, store.path), Rollup._append

    def late(self, number, entry):
        if self is store and not late.done:
            late.done = True
            assert other.commit(late.batch, inserts(rows, "t", "n"))
        return real(self, number, entry)

    monkeypatch.setattr(Rollup, "_append", late)
    late.done, late.batch = False, "one"
    assert not store.commit("one", inserts(rows, "t", "n")) and totals(store) == {("a", 2, 7), (None, 1, 1)}
    late.done, late.batch = False, "two"
    assert store.commit("three", inserts(rows, "t", "n")) and totals(store) == {("a", 6, 21), (None, 3, 3)}
    late.done, late.batch = False, "four"
    assert not store.compact() and totals(store) == {("a", 8, 28), (None, 4, 4)}


def test_tokens_of_bytes():
    texts = ["", None, "a b", "  x,,y!", "É ß日本 z", "\x00\x01a\x7fb", "-_-", "a b c\x0b\x0cd"]
    one, two = token_counts.tokens(pa.array(texts))
    assert one.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert two.tolist() == [len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", t or "")) for t in texts]


def test_digest_of_odd_rows(spark, docs, empty):
    """Nulls, repeated rows, copies and clashing extra columns, against a plain count."""
    odd = docs.withColumn("mark", F.lit("x")).withColumn("rows", F.lit(1)).withColumn("guess", F.lit(2))
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    want = {}
    for r in rows:
        if r.doc_id is None or r.doc_id == least[r.text or ""]:
            for name, counts in zip(token_counts.TOKENIZERS, token_counts.tokens(pa.array([r.text], pa.string()))):
                n, t = want.get((r.source, r.lang, name), (0, 0))
                want[r.source, r.lang, name] = n + 1, t + int(counts[0])
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_counts.digest(odd).collect()} == want
    assert token_counts.digest(empty).collect() == []
