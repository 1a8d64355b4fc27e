"""Document fingerprints by winnowing (operator 1).

Rolling hashes of all runs of GRAM characters; of every WINDOW consecutive hashes the least is chosen, the rightmost on ties, and kept with its position. Any
passage of GUARANTEE = WINDOW + GRAM - 1 or more characters that two texts share gives them a common fingerprint; none shorter than GRAM can.
Characters are code points, A-Z lowered and each of [\\x20\\x09-\\x0D] taken as a space, so positions are those of the text.
A text of fewer than WINDOW hashes has one window; one of fewer than GRAM characters is a single gram; an empty one has no fingerprint.

Likeness is the Jaccard likeness of the sets of hashes: 1 for two empty texts, 0 if one is empty.

The next document of each, in descending order of doc_id, is found without a total sort: documents are dealt into ranges of doc_id, each range sends its first document to
the range before it as well, and each task reads its ranges in order, holding two texts at a time. There are RANGES_PER_PARTITION ranges a
shuffle partition, and one row for each on the driver.

Nulls: null text counts as empty; null doc_id sorts below all others. Rows that repeat a doc_id are ordered by a hash of the text. A single document is its own next. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._spark import by_text
from tarn.llm._words import ngrams, window_min

GRAM = 24
WINDOW = 77
GUARANTEE = GRAM + WINDOW - 1
RANGES_PER_PARTITION = 4

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[0x09:0x0E] = 0x20
_LOW = np.uint64((1 << 32) - 1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(code: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) in order of the text."""
    if not len(code):
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    small = code < 256
    x = np.where(small, _FOLD[np.where(small, code, 0)], code).astype(np.uint64) + np.uint64(1)
    h = ngrams(x, min(gram, len(x)))
    keyed = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    least = window_min(keyed, min(window, len(h)))
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (least >> np.uint64(32)).astype(np.uint32), (_LOW - (least & _LOW)).astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The columns ``keep``, hashes and positions of each document; no shuffle."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            got = [fingerprint(codes(t or ""), gram, window) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int32()))], [*names, "hashes", "positions"])

    return by_text(docs, keep, text, run, "hashes array<bigint>, positions array<int>")


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"


def _longs(values: list[int]) -> Column:
    """A constant array, one literal in the plan whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document in its range (``part``) in descending order, and at the end of each range the document that follows (``edge``)."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("o"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    ranges = RANGES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in base.approxQuantile("o", [i / ranges for i in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    part = F.lit(0)
    if cuts:
        # number of borders at or above o, by halving: ranges count up as doc_id goes down
        border = _longs(cuts)

        def half(s, _):
            at = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            above = F.element_at(border, at + 1) <= F.col("o")
            return F.when(s["lo"] >= s["hi"], s).when(above, F.struct((at + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), at.alias("hi")))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), half, lambda s: s["lo"])
        part = F.lit(len(cuts)) - found
    placed = base.withColumn("part", part.cast("int"))
    # the first of each range, one row a range
    heads = sorted((r.part, r.h.o, r.h.t) for r in placed.select("part", "o", "t").groupBy("part").agg(F.max(F.struct("o", "t")).alias("h")).collect())
    if not heads:
        return placed.withColumn("edge", F.lit(False))
    first = {p: (o, t, heads[i - 1][0]) for i, (p, o, t) in enumerate(heads)}
    head = [F.element_at(_longs([first.get(p, (0, 0, 0))[c] for p in range(len(cuts) + 1)]), F.col("part") + 1) for c in range(3)]
    also = F.when((F.col("o") == head[0]) & (F.col("t") == head[1]), head[2].cast("int"))
    own = F.struct(F.col("part"), F.lit(False).alias("edge"))
    return placed.withColumn("to", F.when(also.isNull(), F.array(own)).otherwise(F.array(own, F.struct(also.alias("part"), F.lit(True).alias("edge"))))).select("doc_id", "o", "t", "text", F.explode("to").alias("to")).select("doc_id", "o", "t", "text", "to.part", "to.edge")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The query's rows: each text against its edited text and the next document."""

    def answer(doc, body, mark, after, after_set):
        """doc_id, ... of one document, given the code points of the next and its set of hashes."""
        code, h, p, own = mark
        n = len(code)
        third = n // 3
        edited = np.concatenate([code[: n - third], after[:third]]) if third else code
        eh = fingerprint(edited, gram, window)[0] if third else h
        edited_set = np.unique(eh) if third else own
        raw = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return doc, n, hashlib.sha256(raw).hexdigest(), h.astype(">u4").tobytes().hex(), eh.astype(">u4").tobytes().hex(), likeness(own, edited_set), likeness(own, after_set), p

    def marked(body):
        code = codes(body or "")
        h, p = fingerprint(code, gram, window)
        return code, h, p, np.unique(h)

    def flush(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"])

    def run(batches):
        last, part, ended, rows = None, None, False, []
        for batch in batches:
            for p, edge, doc, body in zip(*(batch.column(c).to_pylist() for c in ("part", "edge", "doc_id", "text")), strict=True):
                if p != part:
                    last, part, ended = None, p, False
                if ended:
                    continue  # rows that repeat the following document
                mark = marked(body)
                if last is not None:
                    rows.append(answer(*last, mark[0], mark[3]))
                last, ended = (doc, body, mark), edge
                if len(rows) >= 500:
                    yield flush(rows)
                    rows = []
        if rows:
            yield flush(rows)

    dealt = with_next(docs, doc_id, text).repartition("part").sortWithinPartitions("part", "edge", F.desc("o"), F.desc("t"))
    return dealt.select("part", "edge", "doc_id", "text").mapInArrow(run, _OUT)


def digest(docs: DataFrame) -> DataFrame:
    return compare_edited(docs)
