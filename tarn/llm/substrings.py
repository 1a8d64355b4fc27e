"""Exact substring deduplication by fixed-block anchors (operator 8).

A window is ``WINDOW`` consecutive words of one document. A word goes when a window that covers it has a word sequence that
also starts earlier, in order of (doc_id, start). Each document is cut into non-overlapping reference blocks of BLOCK words.
As WINDOW >= 2 * BLOCK - 1, every window holds a whole block of its own document, so a repeated window always shares a
block of its first occurrence with a rolling BLOCK-word run of the other. Hence:

1. *Index and probe.* Documents are dealt into groups of a few MB (the bytes of all texts are counted first) by a hash of doc_id and text. Each group sends the distinct hashes
   of all its rolling runs of BLOCK words once, marked when one of them is a reference block (index) and when it occurs more
   than once in the group; hash buckets tell each group by one bit per hash which of them met a block elsewhere.
2. *Extend.* Only windows around a met anchor go on. Each group sends the distinct hashes of these with the least (doc_id, start);
   the buckets answer with one bit: does another group have an earlier one. Within a group earlier starts are known already.
3. Words covered by a later window go; unions of such windows are the maximal exact repeats.

A passage of a third of all documents costs each group one entry, so no bucket and no task grows with a hot passage, and
nothing but bits comes back. Texts are shuffled once (Spark reuses the exchange), positions never are.

Nulls: null text has no words; null doc_id sorts before all others. Rows that repeat a doc_id are one place in the order: neither is earlier
than the other at equal starts. They are spread by their texts, so a doc_id, or none, in a third of all rows fills no task unless the texts are equal too. Copies: all but the least doc_id lose every word if they have a window. Empty tables give no rows.
Hashes have 64 bits in step 2; equal hashes count as equal windows (for 10**12 windows the chance that any two clash is below 3 %).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._spark import text_bytes
from tarn.llm._words import Words, buffers, dilate

WINDOW = 20
BLOCK = 10
GROUP_BYTES = 1 << 21
_LEAST = -(1 << 63)


def _group(table: pa.Table) -> tuple[Words, np.ndarray]:
    data, offsets = buffers(table.column("text"))
    ids = np.array([_LEAST if x is None else x for x in table.column("doc").to_pylist()], np.int64)
    return Words(data, offsets), ids


def _anchors(words: Words, block: int):
    """Distinct hashes of the rolling runs, what each position's is, and the marks of each: 1 a reference block, 2 twice or more here."""
    h, ok = words.grams(block)
    pos = np.flatnonzero(ok)
    kinds, which, times = np.unique(h[pos], return_inverse=True, return_counts=True)
    marks = np.where(times > 1, 2, 0).astype(np.uint32)
    marks[which[(pos - words.first[words.doc[pos]]) % block == 0]] |= 1
    return kinds, pos, which, marks


def _parts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted hashes."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    return np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64))


def _bits(answers: pa.Table, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of all buckets, in order of the hashes."""
    out, at = np.zeros(len(hashes), bool), _parts(hashes, buckets)
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        lo, hi = at[b], at[b + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def _candidates(words: Words, ids: np.ndarray, met: np.ndarray, pos: np.ndarray, which: np.ndarray, window: int, block: int):
    """Windows that hold a met anchor: starts, distinct hashes, which one each is, (doc_id, start) of each one's first here."""
    h, ok = words.grams(window)
    flag = np.zeros(len(words.hash), bool)
    flag[pos[met[which]]] = True
    at = np.flatnonzero(dilate(flag, 0, window - block)[: len(h)] & ok)
    doc, start = ids[words.doc[at]], at - words.first[words.doc[at]]
    kinds, which = np.unique(h[at], return_inverse=True)
    order = np.lexsort((start, doc, which))
    first = order[np.concatenate([[True], which[order][1:] != which[order][:-1]])] if len(order) else order
    return at, doc, start, kinds, which, doc[first], start[first]


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, so that the shuffle's compression drops equal high bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _unplanes32(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _planes32(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _entries(group: int, bucket: list, a: list, b: list) -> pa.Table:
    return pa.table({"grp": pa.array([group] * len(bucket), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


_ENTRIES = "grp int, bucket int, a binary, b binary"
_ANSWERS = "grp int, bucket int, bits binary"


def _answered(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    cut = np.split(flags, np.cumsum(sizes)[:-1])
    return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in cut], pa.binary())})


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by spaces)."""
    return _repeats(docs, doc_id, text, window, block, whole=True)


def _repeats(docs: DataFrame, doc_id: str, text: str, window: int, block: int, whole: bool) -> DataFrame:
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    n, size = text_bytes(docs, text)
    size += 32 * n
    groups = max(32, size // GROUP_BYTES)
    buckets = 1 << max(6, (size // (1 << 22)).bit_length())
    dealt = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(groups)).cast("int").alias("grp"), F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    spread = F.col("grp")

    def index(table: pa.Table) -> pa.Table:
        words, _ = _group(table)
        kinds, _, _, marks = _anchors(words, block)
        at = _parts(kinds, buckets)
        low = ((kinds >> np.uint64(64 - buckets.bit_length() + 1 - 30)) & np.uint64((1 << 30) - 1)).astype(np.uint32) << np.uint32(2) | marks
        full = [b for b in range(buckets) if at[b + 1] > at[b]]
        return _entries(table.column("grp")[0].as_py(), full, [low[at[b] : at[b + 1]].tobytes() for b in full], [b""] * len(full))

    def probe(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
        values = np.concatenate(own)
        keys = values >> np.uint32(2)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        run = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        marks = np.bitwise_or.reduceat(values[order] & np.uint32(3), at)
        met = (marks & 1).astype(bool) & ((np.diff(np.append(at, len(order))) > 1) | (marks & 2).astype(bool))
        flags = np.empty(len(values), bool)
        flags[order] = met[run]
        return _answered(table, flags, [len(x) for x in own])

    def extend(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _entries(0, [], [], [])
        words, ids = _group(left)
        kinds, pos, which, _ = _anchors(words, block)
        _, _, _, kinds, _, doc, start = _candidates(words, ids, _bits(right, kinds, buckets), pos, which, window, block)
        at = _parts(kinds, buckets)
        full = [b for b in range(buckets) if at[b + 1] > at[b]]
        return _entries(key[0].as_py(), full, [kinds[at[b] : at[b + 1]].tobytes() for b in full], [_planes(doc[at[b] : at[b + 1]]) + _planes32(start[at[b] : at[b + 1]]) for b in full])

    def earliest(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
        places = [(_unplanes(x[: 8 * len(h)]), _unplanes32(x[8 * len(h) :])) for x, h in zip(table.column("b").to_pylist(), own, strict=True)]
        keys, doc, start = np.concatenate(own), np.concatenate([x for x, _ in places]), np.concatenate([x for _, x in places])
        order = np.lexsort((start, doc, keys))
        keys, doc, start = keys[order], doc[order], start[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        least = np.flatnonzero(new)[np.cumsum(new) - 1]
        flags = np.empty(len(keys), bool)
        flags[order] = (doc > doc[least]) | (start > start[least])
        return _answered(table, flags, [len(x) for x in own])

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        out = {"doc_id": left.column("doc") if n else pa.array([], pa.int64()), "n_words": [], "n_removed": [], "kept": []}
        if n:
            words, ids = _group(left)
            kinds, pos, which, _ = _anchors(words, block)
            one = right.column("step").to_numpy() == 1
            at, doc, start, kinds, which, first_doc, first_start = _candidates(words, ids, _bits(right.filter(pa.array(one)), kinds, buckets), pos, which, window, block)
            later = _bits(right.filter(pa.array(~one)), kinds, buckets)[which] | (doc > first_doc[which]) | ((doc == first_doc[which]) & (start > first_start[which]))
            flag = np.zeros(len(words.hash), bool)
            flag[at[later]] = True
            stay = ~dilate(flag, window - 1, 0)
            total = np.concatenate([[0], np.cumsum(stay)])
            out["n_words"] = words.counts()
            out["n_removed"] = out["n_words"] - (total[words.first[1:]] - total[words.first[:-1]])
            raw = memoryview(words.data)
            for d in range(n):
                own = bytes(raw[words.offsets[d] : words.offsets[d + 1]]).split()
                lo, hi = words.first[d], words.first[d + 1]
                kept = b" ".join(own if out["n_removed"][d] == 0 else compress(own, stay[lo:hi].tolist()))
                out["kept"].append(kept.decode() if whole else hashlib.sha256(kept).hexdigest())
        return pa.table([out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    met = dealt.groupBy(spread).applyInArrow(index, _ENTRIES).groupBy("bucket").applyInArrow(probe, _ANSWERS)
    later = dealt.groupBy(spread).cogroup(met.groupBy("grp")).applyInArrow(extend, _ENTRIES).groupBy("bucket").applyInArrow(earliest, _ANSWERS)
    answers = met.withColumn("step", F.lit(1)).unionByName(later.withColumn("step", F.lit(2)))
    return dealt.groupBy(spread).cogroup(answers.groupBy("grp")).applyInArrow(judge, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return _repeats(docs, "doc_id", "text", WINDOW, BLOCK, whole=False).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r)),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
