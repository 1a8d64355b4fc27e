"""Benchmark decontamination by winnowing (operator 9).

An item's windows are its runs of ``window`` words; an item of fewer words (not none) is one window. For each window
length n in use, k-grams of k = min(GRAM, n) words are hashed on both sides and the minimum of every n - k + 1
consecutive hashes is kept (rightmost on ties). Equal windows keep equal minima, so every shared window is met by at least one
shared fingerprint: the guarantee of winnowing. Fingerprints that both sides share are hits; each hit is extended to the
windows around it that hold it, and these are compared word by word with the items' windows.

Two ways to join, chosen by the measured size of the benchmark, with the same results:

* up to ``broadcast_bytes`` of benchmark text (a parameter, and a proven bound on what is sent), the sorted fingerprints and
  windows go to the executors and documents are scanned once, without a shuffle;
* beyond it, fingerprints of documents and of items are joined by a shuffle, hits go back to their documents by key, and the
  windows they extend to are joined with the items' windows by a second shuffle. Texts that are equal, by a 64-bit hash and their length, go as one.

Nulls: null text has no words, a null ``item_id`` gives an item without a name: its words count as hit, it isn't listed.
Empty benchmark: nothing is hit. Items with equal text are all listed; an ``item_id`` that repeats is listed once. Repeated
documents each get their row. Further columns of either table are ignored. Very long texts are handled alone, in vectors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._words import ALNUM, LOWER, Words, ngrams, window_min, word_chunks

WINDOW = 10
GRAM = 5
BROADCAST_BYTES = 4 << 20

FOUND = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
_FOUND_PA = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def winnow(words: Words, n: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints for window length n: (hash, word position), each once, never across texts."""
    k = min(gram, n)
    w = n - k + 1
    h, _ = words.grams(k)
    if len(h) < w:
        return h[:0], np.zeros(0, np.int64)
    # the upper half of the hash decides; the position in the lower half makes the rightmost of equals the least
    low = np.uint64((1 << 32) - 1)
    least = window_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), w)
    pos = (low - (least & low)).astype(np.int64)
    inside = words.doc[: len(pos)] == words.doc[n - 1 : n - 1 + len(pos)]
    pos = pos[inside]
    pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])] if len(pos) else pos
    return h[pos], pos


def _surface(words: Words, i: int, n: int) -> bytes:
    """The words of a window, lowered, joined by spaces."""
    return b" ".join(words.data[words.start[j] : words.end[j]].tobytes().lower() for j in range(i, i + n))


class _Index:
    """Windows and fingerprints of the items, by window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.prints: dict[int, np.ndarray] = {}
        self.hashes: dict[int, np.ndarray] = {}
        self.windows: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        prints, hashes = defaultdict(set), defaultdict(set)
        for name, text in items:
            for _, _, w in word_chunks(pa.array([text], pa.string()), ALNUM, LOWER):
                if not len(w.hash):
                    continue
                n = min(window, len(w.hash))
                prints[n].update(winnow(w, n, gram)[0].tolist())
                full = ngrams(w.hash, n)
                hashes[n].update(full.tolist())
                for i in range(len(full)):
                    self.windows[n][_surface(w, i, n)].add(name)
        for n in prints:
            self.prints[n] = np.array(sorted(prints[n]), np.uint64)
            self.hashes[n] = np.array(sorted(hashes[n]), np.uint64)
        self.windows = {n: dict(x) for n, x in self.windows.items()}

    def occurrences(self, words: Words) -> Iterator[tuple[int, int, set]]:
        """(first word, length, items) of each window that occurs."""
        for n, prints in self.prints.items():
            found, pos = winnow(words, n, self.gram)
            pos = pos[_member(found, prints)]
            if not len(pos):
                continue
            starts = extend(words, pos, n, self.gram)
            full = ngrams(words.hash, n)
            for i in starts[_member(full[starts], self.hashes[n])].tolist():
                if (names := self.windows[n].get(_surface(words, i, n))) is not None:
                    yield i, n, names


def _member(x: np.ndarray, in_sorted: np.ndarray) -> np.ndarray:
    if not len(in_sorted) or not len(x):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(in_sorted, x), len(in_sorted) - 1)
    return in_sorted[at] == x


def extend(words: Words, pos: np.ndarray, n: int, gram: int) -> np.ndarray:
    """Starts of the windows of n words that hold a k-gram at any of ``pos``, within their text."""
    near = np.zeros(len(words.hash) + 1, np.int32)
    np.add.at(near, np.maximum(pos - (n - min(gram, n)), 0), 1)
    np.add.at(near, pos + 1, -1)
    starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    starts = starts[starts + n <= len(words.hash)]
    return starts[words.doc[starts] == words.doc[starts + n - 1]]


def _summary(words: Words, occurrences) -> list[list]:
    """Columns of FOUND for the texts of ``words``; spans are word numbers, end exclusive, merged."""
    docs = len(words.offsets) - 1
    cover = np.zeros(len(words.hash) + 1, np.int32)
    items: dict[int, set] = defaultdict(set)
    for i, n, names in occurrences:
        cover[i] += 1
        cover[i + n] -= 1
        items[int(words.doc[i])] |= names
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    spans = [[] for _ in range(docs)]
    for d in np.flatnonzero(n_hit).tolist():
        own = np.concatenate([[0], hit[words.first[d] : words.first[d + 1]].astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(own))
        spans[d] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return [words.counts().tolist(), n_hit.tolist(), [sorted(x for x in items.get(d, ()) if x is not None) for d in range(docs)], spans]


def _answer(batch: pa.RecordBatch, keep: list[str], columns: list[list]) -> pa.RecordBatch:
    arrays = [batch.column(c) for c in keep] + [pa.array(x, t) for x, t in zip(columns, _FOUND_PA, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [*keep, "n_words", "n_hit", "items", "spans"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: the ``key`` columns, n_words, n_hit, items (names of the items found, sorted as strings), spans (hit words)."""
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("body"))
    size = items.agg(F.sum(F.octet_length("body") + F.lit(8))).first()[0] or 0
    if size <= broadcast_bytes:
        return _by_scan(docs, items, key, text, window, gram)
    return _by_shuffle(docs, items, key, text, window, gram)


def _kept(docs: DataFrame, key: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in key)


def _by_scan(docs: DataFrame, items: DataFrame, key: list[str], text: str, window: int, gram: int) -> DataFrame:
    rows = sorted({(r.name, r.body) for r in items.collect()}, key=str)  # at most broadcast_bytes
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def scan(batches):
        index = _Index(sent.value, window, gram)
        for batch in batches:
            for i, j, words in word_chunks(batch.column("_text"), ALNUM, LOWER):
                yield _answer(batch.slice(i, j - i), key, _summary(words, index.occurrences(words)))

    return docs.select(*key, F.col(text).alias("_text")).mapInArrow(scan, f"{_kept(docs, key)}, {FOUND}")


def _by_shuffle(docs: DataFrame, items: DataFrame, key: list[str], text: str, window: int, gram: int) -> DataFrame:
    def item_rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                for _, _, w in word_chunks(pa.array([body], pa.string()), ALNUM, LOWER):
                    if len(w.hash):
                        n = min(window, len(w.hash))
                        out += [(n, int(x), None, None) for x in winnow(w, n, gram)[0].view(np.int64).tolist()]
                        out += [(n, int(x), _surface(w, i, n), name) for i, x in enumerate(ngrams(w.hash, n).view(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.string()))], ["n", "h", "surface", "name"])

    of_items = items.mapInArrow(item_rows, "n int, h bigint, surface binary, name string")
    prints = of_items.filter("surface is null").select("n", "h").distinct()
    windows = of_items.filter("surface is not null").groupBy("n", "h", "surface").agg(F.collect_set("name").alias("names"))
    lengths = sorted(r.n for r in prints.select("n").distinct().collect())  # at most ``window`` numbers
    id1, id2 = "_doc_hash", "_doc_size"
    kinds = "_doc_hash bigint, _doc_size int"
    base = docs.select(*key, F.col(text).alias("_text"), F.xxhash64(text).alias(id1), F.coalesce(F.octet_length(text), F.lit(-1)).alias(id2))

    def doc_rows(batches):
        for batch in batches:
            for i, _, words in word_chunks(batch.column("_text"), ALNUM, LOWER):
                a, b = (batch.column(c).to_numpy()[i:] for c in (id1, id2))
                for n in lengths:
                    h, pos = winnow(words, n, gram)
                    d = words.doc[pos]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[d], b[d], np.full(len(h), n, np.int32), h.view(np.int64), (pos - words.first[d]).astype(np.int32))], [id1, id2, "n", "h", "pos"])

    # equal texts have equal windows: everything up to the last join is done once for each text
    texts = base.groupBy(id1, id2).agg(F.first("_text").alias("_text"))
    met = texts.mapInArrow(doc_rows, f"{kinds}, n int, h bigint, pos int").join(prints, ["n", "h"], "left_semi").groupBy(id1, id2).agg(F.collect_list(F.struct("n", "pos")).alias("hits"))

    def extended(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for _, _, words in word_chunks(pa.array([row["_text"]], pa.string()), ALNUM, LOWER):
                    by = defaultdict(list)
                    for hit in row["hits"]:
                        by[hit["n"]].append(hit["pos"])
                    for n, pos in by.items():
                        starts = extend(words, np.array(sorted(pos)), n, gram)
                        full = ngrams(words.hash, n).view(np.int64)[starts]
                        m = len(starts)
                        yield pa.RecordBatch.from_arrays([pa.array([row[id1]] * m, pa.int64()), pa.array([row[id2]] * m, pa.int32()), pa.array([n] * m, pa.int32()), pa.array(full), pa.array(starts.astype(np.int32)), pa.array([_surface(words, i, n) for i in starts.tolist()], pa.binary())], [id1, id2, "n", "h", "start", "surface"])

    near = texts.join(met, [id1, id2]).select(id1, id2, "_text", "hits").mapInArrow(extended, f"{kinds}, n int, h bigint, start int, surface binary")
    found = near.join(windows, ["n", "h", "surface"]).groupBy(id1, id2).agg(F.collect_list(F.struct("n", "start", "names")).alias("_found"))

    def finish(batches):
        for batch in batches:
            found = batch.column("_found")
            for i, j, words in word_chunks(batch.column("_text"), ALNUM, LOWER):
                hits = ((int(words.first[d]) + x["start"], x["n"], set(x["names"])) for d in range(j - i) for x in found[i + d].as_py() or ())
                yield _answer(batch.slice(i, j - i), key, _summary(words, hits))

    return base.join(found, [id1, id2], "left").select(*key, "_text", "_found").mapInArrow(finish, f"{_kept(docs, key)}, {FOUND}")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any hit, whole and with all their columns."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    found = decontaminate(inner, benchmark, inner.columns, names[text])
    return found.filter(F.col("n_hit") == 0).select(*(F.col(n).alias(c) for c, n in names.items()))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, bw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
